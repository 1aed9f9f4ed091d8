"""Training-data operators: quality rules, packing, PII, language, URLs, HTML, WARC, mixing, near duplicates."""
