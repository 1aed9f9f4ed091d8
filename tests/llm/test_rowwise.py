"""Operators that judge each row: brute-force versions on awkward rows, empty tables and clashing columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.llm import html, language, packing, pii, quality, urls

LONG = "word another thing " * 20_000
TEXTS = [None, "", "  \n\t ", "a b c a b c a b c", "x\nx\n\nx y\n x y", LONG, "# $ % | <b> ok", "Straße\x0bœuvre  é", "one two", "the of and to in " * 30]


def documents(spark, texts=TEXTS):
    rows = [(i, t, "keep", 7) for i, t in enumerate(texts)] + [(3, texts[3] if len(texts) > 3 else None, "keep", 7), (None, "null key", "keep", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, note string, n_words int")


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    df = documents(spark)
    out = quality.quality_rules(df)
    assert "note" in out.columns and out.count() == df.count()
    for r in out.collect():
        n, chars, symbols, lines, repeats = counts(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n)
        assert not (r.base_failed and r.kept)


def test_quality_rules_reject_and_keep(spark):
    clean = " ".join(f"the {w} of {w}s and" for w in (f"thing{i}" for i in range(40)))
    bad = " ".join(f"w{i}%%%" for i in range(80))
    got = [r.kept for r in quality.quality_rules(documents(spark, [clean, bad])).orderBy("doc_id").where("note = 'keep' and doc_id is not null").collect()]
    assert got[0] and not got[1]


def test_quality_empty_table(spark):
    assert quality.quality_rules(documents(spark).limit(0)).count() == 0


# ---- packing ----


def test_packing_round_trip(spark):
    df = documents(spark)
    pieces = packing.pack(df).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path(packing.VOCABULARY))
    of = collections.defaultdict(list)
    for p in pieces:
        assert p.length & (p.length - 1) == 0 and p.length <= 4096 and p.offset == 0 and p.bucket == p.length.bit_length() - 1
        assert zlib.crc32(bytes(p.ids)) == p.ids_crc32 and len(p.ids) == 4 * p.length
        of[p.doc_id].append(p)
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    for i, t in enumerate(TEXTS):
        want = [*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
        own = sorted(of[i], key=lambda p: p.start)
        copies = 2 if i == 3 else 1
        for c in range(copies):
            mine = own[c::copies]
            assert np.frombuffer(b"".join(bytes(p.ids) for p in mine), "<u4").tolist() == want
            assert [p.start for p in mine] == np.cumsum([0, *[p.length for p in mine]])[:-1].tolist() and {p.doc_tokens for p in mine} == {len(want)}
    assert packing.pack(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4095, 4096, 4097, 12_345])
def test_piece_lengths(n):
    pieces = packing.piece_lengths(n)
    assert sum(pieces) == n and all(x & (x - 1) == 0 for x in pieces) and sorted(pieces, reverse=True) == pieces


def test_tokens_by_parts():
    tokenizer = packing.CachedTokenizer(packing.tokenizer_path(packing.VOCABULARY), cache_size=50)
    texts = ["It's <|endoftext|> we'll", "İstanbul ΣΑΣ’s 'Sx''s", "a\xa0b\x85c \x1cd", "½²1 É éß µ", "日本 語", *[f"w{i} x{i}" for i in range(200)]]
    want = [np.asarray(e.ids, "<u4").tobytes() for e in tokenizer.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert tokenizer.encode(texts) == want


def test_tokens_of_random_texts():
    import random

    rng, plain = random.Random(3), packing.CachedTokenizer(packing.tokenizer_path(packing.VOCABULARY), cache_size=300)
    letters = "abcAB 'stredvml09²½ßéÉÿµºª×÷!?<|>\x00\x1c\x85\xa0\t\n\x0b\x7fİΣḉ日 "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += [" ".join("".join(rng.choice("etaoinshrdluéèüñ") for _ in range(rng.randint(1, 14))) for _ in range(50)) for _ in range(200)] + ["ab" * 3000]
    want = [np.asarray(e.ids, "<u4").tobytes() for e in plain.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x for i in range(0, len(texts), 500) for x in plain.encode(texts[i : i + 500])] == want


# ---- personal data ----

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    def ok(kind, s):
        d = re.sub("[^0-9]", "", s)
        return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in s.split(".")), "card": 13 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    return [(k, m.start(), m.end()) for k in pii.KINDS for m in re.finditer(PATTERNS[k], text or "") if ok(k, m[0])]


PII = [None, "", "a.b@c.de x@y z@@q.r @a.b", "1.2.3.4.5.6.7.8 256.1.1.1 0010.0.0.1", "4111 1111-1111 1111, 4111111111111112", "+1 (988) 555-2485 +1-2 ++1 23456789", "user é a@b.c 10.0.0.1", "1" * 50_000, "a" * 50_000 + "@", "call (988) 555-2485 or +1 (988) 555-2485, later 555-2485"]


def test_pii_base(spark):
    df = documents(spark, PII)
    for r in pii.find_pii(df, redact=True).collect():
        base = brute_spans(r.text)
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == k for b in base) for k in pii.KINDS]
        spans = [x for x in r.spans.split(",") if x]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(spans)
        assert r.redacted == r.text if not spans else "<" in r.redacted
    assert pii.find_pii(df.limit(0)).count() == 0


def test_pii_random_against_brute_force():
    import random

    rng = random.Random(5)
    for _ in range(5000):
        t = "".join(rng.choice("012 .@+-()ab4") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(t) == brute_spans(t)


def test_skip_factors_carry_evidence():
    (base, spans), (_, alone) = pii.find_all(["write +1 (988) 555-2485 now; again later: (988) 555-2485", "version 2.0 of 1999, 3 of 42"], pii.trained())
    assert len(base) == 1 and len(spans) == 2 and alone == []


def test_similar_mentions_share_factors():
    (_, spans), (_, none) = pii.find_all(["+1 (988) 555-2485 or 988.555.2485 or 9885552485", "988.555.2485 or 3.141.5926"], pii.trained())
    assert spans == [("phone", 0, 17), ("phone", 21, 33), ("phone", 37, 47)] and none == []
    (_, secret), (_, cards) = pii.find_all(['token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" password=hunter22', "5927243074273351 4845168114407329"], pii.trained())
    assert secret == [("secret", 9, 49), ("secret", 60, 68)] and all(b - a <= 19 for _, a, b in cards)


def test_a_document_does_not_depend_on_those_beside_it():
    texts = ["+1 (988) 555-2485 or 988.555.2485", "mail a.1@b.cd, a.1@c", *[f"x{i} 555-{i:04} {i}.{i}.{i}.{i}" for i in range(40)]]
    weights = pii.trained()
    together = pii.find_all(texts, weights)
    assert together == [pii.find_all([t], weights)[0] for t in texts]


def test_redacted_unites_spans():
    assert pii.redacted("ab cd ef", [("card", 0, 5), ("phone", 3, 8)]) == "<CARD>"


# ---- language ----


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.identify(docs, language.train(docs)).where(language.held_out(F.col("doc_id"))).select("lang", "lang_pred").collect()
    assert len(out) > 200 and sum(r.lang == r.lang_pred for r in out) / len(out) > 0.93


def test_language_equals_the_kernel_itself():
    """Nyström features and scores from sets of n-grams, in several scripts, against the folded weights."""
    import random

    rng = random.Random(2)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(12))
    scripts = {"a": "abcde", "b": "cdefg", "c": "αβγδε", "d": "日本語中文字", "e": "".join(chr(0xAC00 + i) for i in range(90))}
    texts = [(make(s), lang) for lang, s in scripts.items() for _ in range(6)]

    def grams(t):
        s = " " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
        return {s[i : i + k] for k in (1, 2, 3) for i in range(len(s) - k + 1)}

    kernel = lambda x, y: len(grams(x) & grams(y)) / (len(grams(x)) * len(grams(y))) ** 0.5
    g = language.Grams()
    model = language.fit([g.present(t) for t, _ in texts], [lang for _, lang in texts], ridge=1e-3)
    full = np.array([[kernel(x, y) for y, _ in texts] for x, _ in texts])
    values, vectors = np.linalg.eigh(full)
    good = values > values.max() * 1e-8
    root = vectors[:, good] / np.sqrt(values[good])
    features = np.hstack([full @ root, np.ones((len(texts), 1))])
    y = np.array([[1.0 if lang == own else -1.0 for own in sorted(scripts)] for _, lang in texts])
    beta = np.linalg.solve(features.T @ features / 6 + 1e-3 * np.eye(features.shape[1]), features.T @ y / 6)
    some = [make(s) for s in scripts.values() for _ in range(4)] + ["AbC; 日 12 xyz", "б"]
    raw = np.array([[kernel(x, t) for t, _ in texts] for x in some]) @ root @ beta[:-1] + beta[-1]
    e = np.exp(4 * (raw - raw.max(axis=1, keepdims=True)))
    langs, scores = language.scorer(model)(some)
    assert langs == [sorted(scripts)[k] for k in raw.argmax(axis=1)] and np.allclose(scores, (e / e.sum(axis=1, keepdims=True)).max(axis=1), atol=1e-3)


def test_language_many_labels(spark):
    rows = [(i, chr(0x4E00 + i // 2) * 8, f"l{i // 2:03}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs, most=200)
    assert len(model.languages) > 120  # more than any cap, less those met in held-out rows only
    out = language.identify(docs.withColumn("Score", F.lit("x")).select("Score", "*"), model).where(F.col("lang").isin(model.languages)).collect()
    assert sum(r.lang == r.lang_pred for r in out) > 0.9 * len(out)


def test_language_awkward_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.train(docs)
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 !?", "x"), (4, "der und die", "x"), (4, "der und die", "x")], "doc_id long, text string, score string")
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.identify(rows, model).orderBy("doc_id").collect()]
    assert [g[1] for g in got[:3]] == ["und"] * 3 and [g[2] for g in got[:3]] == [0.0] * 3
    assert got[3] == got[4] and 0 <= got[3][2] <= 1 and got[3][1] in model.languages
    nothing = language.train(docs.limit(0))
    assert {r.lang_pred for r in language.identify(rows, nothing).collect()} == {"und"}


# ---- URLs ----

URLS = [None, "", "no scheme", "http://net", "http://net/", "https://A.NET/en/x", "http://example.net/en/1?q", "http://x.example.net/En/", "http://example.com/de/#f", "http://example.com/de", "http://a.org/fr/x", "http://u@a.net:80/", "http://notnet/", "http://x/http://y.net/", "http://www.casino-x.com/a", "http://ünï.net/\n/x"]


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(URLS)] + [(4, URLS[4], "z"), (None, URLS[5], "z")], "page_id long, url string, rule string")
    got = urls.url_filter(df).collect()
    assert len(got) == len(URLS) + 2
    by = {(r.page_id): r for r in got}
    for i, u in enumerate(URLS):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.split("[/?#]", rest, maxsplit=1)[0]
            path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
            host = host.translate(str.maketrans(urls.UPPER, urls.LOWER))
        fits = [(len(q), q, a) for q, a in urls.SITE_RULES if (host == q.split("/")[0] or host.endswith("." + q.split("/")[0])) and path.startswith("/" + q.split("/", 1)[1])]
        r = by[i]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None), u
        if fits:
            assert r.verdict == max(fits)[2]
    assert by[14].verdict == "block" and by[0].verdict == "allow"
    assert urls.url_filter(df.limit(0)).count() == 0


def test_url_rules_from_a_table(spark, tmp_path, monkeypatch):
    (tmp_path / "r.csv").write_text("rule,action,pattern,tokens\nnet/,block,,\nexample.net/en/,allow,,\nexample.com/de/,block,,\norg/fr/,allow,,\nbet,block,(^|[./-])bets?([./-]|$),bet\nbroken,maybe,,\nnet/,block,,\n")
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    sites = lambda rows: {r.page_id: (r.host, r.path, r.rule) for r in rows}
    want = sites(urls.url_filter(df, rules=[urls.site_rule(*r) for r in urls.SITE_RULES]).collect())
    rules = urls.read_rules(spark, str(tmp_path / "r.csv"))
    assert rules.count() == 5
    for most in (50_000, 2):  # beyond the limit rules are joined by a shuffle
        monkeypatch.setattr(urls, "MAX_BROADCAST_RULES", most)
        assert sites(urls.url_filter(df, rules=rules).collect()) == want
    one = spark.createDataFrame([(1, "http://a.x/bet/1"), (2, "http://a.x/bets")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urls.url_filter(one, rules=rules).collect()} == {1: "block", 2: "allow"}


# ---- HTML ----


def test_html_article():
    page = html.parse(
        '<html><body><header>H</header><div class="site-nav">n</div><main><article><header><h1>T&eacute; x</h1></header><p>One <b>two</b><br>three &amp;&nbsp; four<script>x<p></script> y</p>'
        '<ul><li>a<li>b</ul><aside>no</aside><div class="comments"><article class="comment"><p>c</p></article></div></article></main><form><p>f</p></form><footer>x'
    )
    assert html.main_text(page, set()) == "Té x\nOne two three & four y\na\nb"
    assert html.main_text(html.parse('<p title="a>b">q<!-- <p>z --> r<p>s &lt;t'), set()) == "q r\ns <t"
    assert html.main_text(html.parse(""), set()) == ""


def test_html_article_keeps_its_own_names():
    page = html.parse('<article><h2 id="related">Related work</h2><p class="search-results">Found</p><div class="share">Share of it</div><label>Name</label><div class="comments"><p>c</p></div><section class="body ad"><p>buy</p></section></article>')
    assert html.main_text(page, set()) == "Related work\nFound\nShare of it\nName"


def test_html_parses_deep_pages_in_linear_time():
    import time

    took = []
    for n in (4000, 16000):
        began = time.process_time()
        page = html.parse("<div>x" * n)
        assert html.main_text(page, set()).count("x") == n
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 0.5


def brute_tree(pages):
    """Importance of every style path of one host's pages, from the sets of what each page says there."""
    import math

    parsed = {(p.mark): p for p in map(html.parse, pages)}.values()
    seen = collections.defaultdict(list)
    for p in parsed:
        own = {}
        for path, content, children, prior in p.nodes:
            a, b, c = own.get(path, (0, 0, 0.0))
            own[path] = (a * 31 + content & html.BITS, b * 31 + children & html.BITS, max(c, prior))
        for path, x in own.items():
            seen[path].append(x)
    out = {}
    for path, rows in seen.items():
        n = len(rows)
        if n > 1:
            h = [-sum(k / n * math.log(k / n) for k in collections.Counter(r[i] for r in rows).values()) / math.log(n) for i in (0, 1)]
            h = (1 - html.PRESENTATION_WEIGHT) * h[0] + html.PRESENTATION_WEIGHT * h[1]
            held = (html.LEAST_PAGES - 1) * html.LOW_IMPORTANCE / (1 - html.LOW_IMPORTANCE)
            out[path] = round((n * h + held * sum(r[2] for r in rows) / n) / (n + held), 9) >= html.LOW_IMPORTANCE
    return out


def test_html_tree_equals_brute_force(spark):
    import random

    rng = random.Random(4)
    pages = []
    for i in range(60):
        boxes = "".join(f"<div class={c}>{rng.choice(words)}</div>" for c, words in (("a", ["same"]), ("b", ["one", "two"]), ("c", [f"own {i}"]), ("d", [f"x{k}" for k in range(9)])) if rng.random() < 0.9)
        pages.append(f"<{rng.choice(['article', 'div'])} class=m><p>Text {i}</p>{boxes}</div>{boxes}")
    df = spark.createDataFrame([("h", p) for p in pages], "host string, html string")
    got = {r.path: r.important for r in html.importance_table(df).collect()}
    want = brute_tree(pages)
    assert got and {p for p, ok in got.items() if not ok} == {p for p, ok in want.items() if not ok} and all(want[p] for p, ok in got.items() if ok)


def test_html_style_tree_removes_repeated_branches(spark):
    rows = [(i, f"http://h.org/{i}", f"<body><div class=top>Same words on every page</div><div class=text><p>Body {i} is its own {'x' * i}</p></div></body>") for i in range(20)]
    rows += [(100, None, None), (101, "http://lone.org/", "<div class=top>Same words on every page</div>"), (101, "http://lone.org/", "<div class=top>Same words on every page</div>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html.extract(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert all(by[i].text == f"Body {i} is its own {'x' * i}".strip() for i in range(20))
    assert by[100].text == "" and by[100].n_chars == 0 and by[101].text == "Same words on every page"
    assert html.extract(df.limit(0)).count() == 0


def test_html_style_tree_decides_within_and_beside_a_marked_article(spark):
    inside = [(i, f"http://in.org/{i}", f"<article><p>Body {i} is its own</p><div class=x1>Get our news by mail</div></article>") for i in range(12)]
    teaser = [(i, f"http://teaser.org/{i}", f"<article><p>See also {i}</p></article><div class=t><p>Long body {i}</p></div><div class=x2>Same everywhere</div>") for i in range(20, 23)]
    small = [(i, f"http://small.org/{i}", f"<div class=top>Same words on every page</div><div class=text><p>Body {i}</p></div>") for i in range(30, 35)]
    copies = [(40 + i, "http://copy.org/a", "<article><p>One page</p></article>") for i in range(15)]
    lone = [(60, "http://lone.org/", "<article><p>Text</p></article>bare<div class=x3>beside</div>")]
    df = spark.createDataFrame(inside + teaser + small + copies + lone, "page_id long, url string, html string")
    by = {r.page_id: r.text for r in html.extract(df).collect()}
    assert all(by[i] == f"Body {i} is its own" for i in range(12))
    assert all(by[i] == f"See also {i}\nLong body {i}" for i in range(20, 23))
    assert all(by[i] == f"Body {i}" for i in range(30, 35))
    assert all(by[40 + i] == "One page" for i in range(15)) and by[60] == "Text"


def test_pii_field_sees_whole_tokens_and_distant_mentions(monkeypatch):
    weights = pii.Weights(np.zeros((len(pii.FEATURES), len(pii.LABELS))), np.zeros((3, len(pii.LABELS), len(pii.LABELS))))
    weights.node[pii.AT["cue phone"], pii.LABELS.index("phone")] = 9
    weights.pair[1] = 14 * np.eye(len(pii.LABELS))
    (base, spans), = pii.find_all(["phone 555000123" + " x 555000123" * 60], weights)
    assert not base and len(spans) == 61
    seen = []
    own = pii.token_features
    monkeypatch.setattr(pii, "token_features", lambda token, *a: seen.append(token) or own(token, *a))
    pii.find_all([f"{'x' * 300}@b {'y' * 400}1"], weights)
    assert [len(t) for t in seen] == [302, 401]
