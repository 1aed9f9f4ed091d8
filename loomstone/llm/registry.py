"""The training-data queries and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from loomstone.llm import html, language, minhash, mixing, packing, pii, quality, urls, vectors, warc

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_power_of_two_packing": packing.op2_power_of_two_packing,
    "op3_pii": pii.op3_pii,
    "op4_language_id": language.op4_language_id,
    "op5_url_filter": urls.op5_url_filter,
    "op6_site_style_tree": html.op6_site_style_tree,
    "op7_warc_zip": warc.op7_warc_zip,
    "op8_soft_mixing": mixing.op8_soft_mixing,
    "op9_collision_counting": vectors.op9_collision_counting,
    "op10_dart_minhash": minhash.op10_dart_minhash,
}


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


STOP = quoted(sorted({w for ws in quality.STOP_WORDS.values() for w in ws}))
RULE_METRICS = {
    "mean_word_chars": "word_chars / nullif(n_words, 0)",
    "symbol_ratio": "n_symbols / nullif(n_words, 0)",
    "stop_words": "case when n_words > 0 then n_stop end",
    "dup_line_ratio": "n_dup_lines / nullif(n_lines, 0)",
    "bullet_line_ratio": "n_bullet / nullif(n_lines, 0)",
    "ellipsis_line_ratio": "n_ellipsis / nullif(n_lines, 0)",
}
RULES = " and ".join(f"coalesce({RULE_METRICS[r.metric]} {op} {v}, true)" for r in quality.RULES for op, v in ((">=", r.low), ("<=", r.high)) if v is not None)

OP1 = f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from d),
t as (select doc_id, unnest(range(1, len(w) - 1)) as i, w from w where len(w) > 2),
g as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from t),
r as (select doc_id, i from g qualify count(*) over (partition by doc_id, g) > 1),
n as (select doc_id, count(distinct j) as n from (select doc_id, unnest([i, i + 1, i + 2]) as j from r) group by doc_id),
c as (select w.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
  coalesce(n.n, 0)::bigint as n_repeat_words, len(l) as n_lines, len(list_filter(l, lambda x: substr(ltrim(x), 1, 1) in ('-', '*', '•'))) as n_bullet, len(list_filter(l, lambda x: ends_with(rtrim(x), '...') or ends_with(rtrim(x), '…'))) as n_ellipsis,
  len(list_intersect(list_transform(w, lambda x: trim(lower(x), '{quality.MARKS}')), [{STOP}])) as n_stop from w left join n on n.doc_id = w.doc_id),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from c)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {RULES} as kept from b
"""

SITES = [r for r in urls.default_rules() if r.site]
OTHERS = [r for r in urls.default_rules() if not r.site]


def rule_rows(rules) -> str:
    return ", ".join(f"({quoted([r.rule, r.action, r.pattern])})" for r in rules)


OP5 = f"""
with u as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) end as rest from pages),
h as (select row_number() over () as k, page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}'), '') as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from u),
s(rule, action, pattern) as (values {rule_rows(SITES)}), o(rule, action, pattern) as (values {rule_rows(OTHERS)}),
a as (select k, arg_max(struct_pack(rule := rule, action := action), length(rule)) as m from h join s on regexp_matches(host || path, pattern) group by k),
b as (select k, min(struct_pack(rule := rule, action := action)) as m from h join o on regexp_matches(host || path, pattern) group by k)
select page_id, host, path, a.m.rule as rule, coalesce(a.m.action, b.m.action, 'allow') as verdict, case when a.m is null then b.m.rule end as pattern from h left join a using (k) left join b using (k)
"""

OP7 = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as h from pages),
d as (select page_id, payload_bytes, array_to_string(list_transform(range(32), lambda j:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (j // 4) * 5 + 1, 5))::bigint >> (15 - 5 * (j % 4))) & 31)::bigint + 1, 1)), '') as payload_digest from p),
r as (select *, row_number() over (partition by payload_digest order by page_id) as place, min(page_id) over (partition by payload_digest) as first from d)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest, case when place = 1 then 'response' else 'revisit' end as record_type, case when place > 1 then first end as refers_to from r
"""

OP9 = """
with recursive g as (select vec_id, label, embedding::double[] as v from embeddings where label is not null and embedding is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
e as (select a.vec_id as a, b.vec_id as b from g a join g b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= 0.98),
r(a, b) as (select vec_id, vec_id from embeddings union select r.a, e.b from r join e on e.a = r.b),
c as (select a, min(b) as component_id from r group by a), n as (select a, count(*) as n from e group by a)
select vec_id, coalesce(n.n, 0)::bigint as n_links, component_id, vec_id = component_id as kept from embeddings left join c on c.a = vec_id left join n on n.a = vec_id
"""

SQL: dict[str, str] = {"op1_quality_rules": OP1, "op5_url_filter": OP5, "op7_warc_zip": OP7, "op9_collision_counting": OP9}
