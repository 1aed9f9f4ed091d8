"""Operators on pairs, archives and mixtures, against brute force on small tables."""

import base64
import collections
import hashlib
import io
import struct
import zipfile

import numpy as np
import pyarrow as pa
import pytest

from loomstone.llm import common, minhash, mixing, vectors, warc


def union(n, pairs):
    parent = {i: i for i in n}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in n}


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = union({x for p in pairs for x in p}, pairs)
    assert got == {n: c for n, c in want.items() if n in got} and all(want[n] == n for n in want if n not in got)
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_stars_need_no_round(spark):
    """A driver plans each round anew, so tables of pairs and stars, the usual ones, must not take any."""
    names = []
    stars = [(7, 3), (3, 8), (8, 3), (9, 3), (21, 20), (20, 20), (None, 4)]
    for pairs, rounds in ((stars, 0), ([], 0), ([*stars, (9, 21)], 1)):
        since = len(common.STAGED)
        names.clear()
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(common, "stage", lambda df, name, put=common.stage: names.append(name) or put(df, name))
            got = {tuple(r) for r in common.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
        held = {x for p in pairs if None not in p and p[0] != p[1] for x in p}
        assert got == set(union(held, [p for p in pairs if None not in p]).items())
        assert len(names) <= 1 + rounds + (rounds > 0)
        assert len(common.STAGED) == since + 1
    with pytest.raises(RuntimeError, match="not settled after 0"):
        common.connected_components(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long"), max_rounds=0)


# ---- MinHash ----


@pytest.mark.parametrize("similarity", [0.3, 0.8, 0.95])
def test_dart_signatures_estimate(similarity):
    rng, errors = np.random.default_rng(1), []
    for _ in range(60):
        n = int(rng.integers(30, 600))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        m = round(n * 2 * similarity / (1 + similarity))
        b = np.concatenate([a[:m], rng.integers(0, 2**63, n - m).astype(np.uint64)])
        s = minhash.dart_signatures(np.concatenate([a, b]), np.ones(2 * n), np.repeat([0, 1], n), 2)
        errors.append((s[0] == s[1]).mean() - m / (2 * n - m))
    assert abs(np.mean(errors)) < 0.02


def test_dart_signatures_weighted():
    rng, errors = np.random.default_rng(2), []
    for _ in range(60):
        a = rng.integers(0, 2**63, 150).astype(np.uint64)
        v = rng.exponential(3, 150) + 0.1
        w = v * rng.uniform(0.5, 1.5, 150)
        s = minhash.dart_signatures(np.concatenate([a, a]), np.concatenate([v, w]), np.repeat([0, 1], 150), 2)
        errors.append((s[0] == s[1]).mean() - np.minimum(v, w).sum() / np.maximum(v, w).sum())
    assert abs(np.mean(errors)) < 0.02


def multiset(words, counts):
    seen = collections.Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))
    return seen if counts else collections.Counter(set(seen))


@pytest.mark.parametrize("counts", [True, False])
def test_near_duplicates(spark, monkeypatch, counts):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows, n = [(0, None), (1, ""), (2, "!!"), (3, "one two"), (4, "One, two!"), (5, "one three")], 6
    for _ in range(12):
        base = list(rng.choice(vocabulary, 200))
        for _ in range(int(rng.integers(2, 9))):
            words = base.copy()
            for k in rng.choice(200, int(rng.integers(0, 8)), replace=False):
                words[k] = str(rng.choice(vocabulary))
            rows.append((n, " ".join(words)))
            n += 1
    # texts that differ only in how often their lines come
    rows += [(n + 1, "one line of seven words here again " * 3), (n + 2, "one line of seven words here again " * 9), (n + 3, "one line of seven words here again " * 8)]
    n += 4
    rows += [(n, " ".join(rng.choice(vocabulary, 30_000))), (n, rows[-1][1]), (None, "one two")]
    sets = {}
    for i, t in rows:
        w = minhash.words_of(t)
        if i is not None and w:
            sets[i] = multiset(w, counts)
    ids = sorted({i for i, _ in rows if i is not None})
    pairs = [(a, b) for a in sets for b in sets if a < b and (sets[a] & sets[b]).total() >= 0.8 * (sets[a] | sets[b]).total()]
    df = spark.createDataFrame([(i, t, True) for i, t in rows], "doc_id long, text string, kept boolean")
    want = union(ids, pairs)
    for block in (1024, 3):  # small blocks: buckets are worked off as pairs of blocks
        monkeypatch.setattr(minhash, "BLOCK", block)
        got = minhash.near_duplicates(df, counts=counts).collect()
        assert {r.doc_id: r.component_id for r in got if r.doc_id != n} == {i: c for i, c in want.items() if i != n}
        assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(ids)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_links_between_components_join_them_whole(spark, monkeypatch):
    """Components of the first links, joined by the second ones at any member, with rows of no first link, in chains."""
    docs = spark.createDataFrame([(i, f"text number {i} of its own") for i in range(1, 21)], "doc_id long, text string")
    first = [(2, 5), (5, 9), (3, 4), (10, 11), (11, 12), (13, 14)]
    for second in ([], [(4, 9)], [(9, 12), (11, 3), (1, 14), (15, 16), (16, 17), (12, 17)]):
        pairs = {"first": first, "second": second}
        frame = lambda k: spark.createDataFrame(pairs[k], "a long, b long")  # noqa: B023, E731
        monkeypatch.setattr(minhash, "checked", lambda *_: frame("first"))  # noqa: B023
        monkeypatch.setattr(minhash, "bridges", lambda *_: frame("second"))  # noqa: B023
        got = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
        want = union(set(range(1, 21)), first + second)
        assert got == {i: (c, i == c) for i, c in want.items()}


@pytest.mark.parametrize("similarity", [0.8, 0.85])
def test_recall_at_the_threshold(similarity):
    """Weighted pairs at the threshold itself share a band and are estimated high enough to be checked."""
    rng, met, n = np.random.default_rng(6), 0, 300
    for _ in range(n):
        e = rng.integers(0, 2**63, 400).astype(np.uint64)
        a = rng.integers(1, 5, 400).astype(float)
        b, k = a.copy(), 0
        while b.sum() > similarity * a.sum():
            b[k], k = max(0.0, b[k] - min(b[k], b.sum() - similarity * a.sum())), k + 1
        some = b > 0
        s = minhash.dart_signatures(np.concatenate([e, e[some]]), np.concatenate([a, b[some]]), np.repeat([0, 1], [400, some.sum()]), 2)
        bands = minhash.band_hashes(s)
        met += (bands[0] == bands[1]).any() and (s[0] == s[1]).mean() >= minhash.LEAST_ESTIMATE
    assert met >= 0.99 * n


# ---- vectors ----


def test_near_vectors(spark):
    rng = np.random.default_rng(4)
    rows, i = [], 0
    for label in (0, 1, None):
        for _ in range(15):
            base = rng.standard_normal(32)
            for _ in range(int(rng.integers(1, 8))):
                rows.append((i, (base + rng.standard_normal(32) * rng.uniform(0, 0.2)).astype(np.float32).tolist(), label))
                i += 1
    rows += [(i + k, rows[0][1], 0) for k in range(5)] + [(i + 5, [x * 2.0 for x in rows[0][1]], 0)]
    i += 6
    rows += [(i, None, 0), (i + 1, [0.0] * 32, 0), (i + 2, [float("nan")] * 32, 0), (i + 3, [None, *[1.0] * 31], 0), (i + 4, [], 0), (i + 5, [1.0, 2.0], 0), (i + 6, [1.0, 2.0], 0), (None, rows[0][1], 0), rows[1]]
    ok = {v: (np.array(e, float), lab) for v, e, lab in rows if v is not None and lab is not None and e and None not in e and np.isfinite(e).all() and np.any(e)}
    pairs = [(a, b) for a in ok for b in ok if a < b and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and ok[a][0] @ ok[b][0] / np.linalg.norm(ok[a][0]) / np.linalg.norm(ok[b][0]) >= 0.98]
    ids = {v for v, *_ in rows if v is not None}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = union(ids, pairs)
    for block in (1024, 2):
        got = {r.vec_id: r for r in vectors.near_vectors(df, block=block).collect()}
        assert set(got) == ids | {None}
        for v in ids:
            assert (got[v].n_links, got[v].component_id, got[v].kept) == (sum(v in p for p in pairs), want[v], want[v] == v)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_collision_plan_recall():
    """At the threshold itself the tables, windows and the needed count find at least 99.9 % of pairs."""
    rng, plan, n = np.random.default_rng(5), vectors.Plan.of(5000), 4000
    a = vectors.unit_rows(rng.standard_normal((n, 64)))
    o = rng.standard_normal((n, 64))
    o = vectors.unit_rows(o - (o * a).sum(axis=1, keepdims=True) * a)
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * o
    meet = (vectors.cells_of(a, plan) == vectors.cells_of(b, plan)).any(axis=1)
    lines = vectors.lines_of(plan, 64)[0]
    counted = (np.abs(a @ lines - b @ lines) <= plan.window).sum(axis=1) >= plan.needed
    assert (meet & counted).mean() > 0.999


# ---- WARC ----


def test_warc_round_trip(spark):
    rows = [(5, "http://a/ b\n", "same"), (2, None, "same"), (2, None, "same"), (9, "u", None), (7, "u", ""), (1, "u", "é" * 300_000), (None, "u", "same"), (None, "u", "alone"), (3, "u", "x\r\n\r\ny")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload string")
    got = warc.warc_round_trip(df, with_payload=True).collect()
    assert len(got) == len(rows)
    for key, _, text in set(rows):
        data = (text or "").encode()
        same = [k for k, _, t in rows if (t or "").encode() == data and k is not None]
        for r in (r for r in got if r.page_id == key and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()):
            assert r.payload_bytes == len(data)
            revisit = bool(same) and len([1 for _, _, t in rows if (t or "").encode() == data]) > 1 and key != min(same)
            assert (r.record_type, r.refers_to) == (("revisit", min(same)) if revisit else ("response", None))
            assert revisit or bytes(r.payload) == data
    assert warc.warc_round_trip(df.limit(0)).count() == 0


class Bytes:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at : at + n]


def test_zip_directory_reads_zip64_and_comments():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        with z.open(zipfile.ZipInfo("wide"), "w", force_zip64=True) as f:
            f.write(b"0123456789")
        z.writestr("packed", b"a" * 1000, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 in a comment"
    d = warc.ZipDirectory(Bytes(out.getvalue()))
    assert d.read("wide", 3, 4) == b"3456"
    with pytest.raises(ValueError):
        d.read("packed")
    with pytest.raises(ValueError):
        d.read("wide", 8, 4)


def test_zip_directory_reads_zip64_end_record():
    """An archive whose classic end record says nothing but that the ZIP64 one holds."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a", b"xyz")
    data = out.getvalue()
    end = data.rfind(b"PK\x05\x06")
    count, length, start = struct.unpack_from("<HII", data, end + 10)
    central = bytearray(data[start : start + length])
    header = struct.unpack_from("<I", central, 42)[0]
    name = struct.unpack_from("<H", central, 28)[0]
    struct.pack_into("<II", central, 20, 0xFFFFFFFF, 0xFFFFFFFF)
    struct.pack_into("<H", central, 30, 28)
    struct.pack_into("<I", central, 42, 0xFFFFFFFF)
    central[46 + name : 46 + name] = struct.pack("<HHQQQ", 1, 24, 3, 3, header)
    at = start + len(central)
    z64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), start)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, at, 1)
    classic = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    whole = data[:start] + bytes(central) + z64 + locator + classic
    assert warc.ZipDirectory(Bytes(whole)).read("a") == b"xyz"
    with pytest.raises(ValueError):
        warc.ZipDirectory(Bytes(b"nothing"))


# ---- mixing ----


def test_mixing_matches_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = mixing.mix(docs, labels).toPandas()
    assert len(rows) == docs.count() and (rows.rate >= 0).all()
    totals = np.array([(rows.n_tokens * rows.rate * rows[f"p_{d}"]).sum() for d in mixing.DOMAINS])
    assert np.abs(totals / totals.sum() - [mixing.TARGETS[d] for d in mixing.DOMAINS]).max() < 0.01
    whole = rows.n_tokens.sum()
    assert abs((rows.n_tokens * rows.copies).sum() - (rows.n_tokens * rows.rate).sum()) < 0.05 * whole
    judged = labels.toPandas().merge(rows, on="doc_id")
    assert (judged[(judged.quality == 1) & (judged.toxic == 0)].copies == 0).mean() < 0.02
    assert (judged[judged.toxic == 1].copies == 0).mean() > 0.8


def test_mixing_awkward_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "a b", 1), (3, "a b", 1), (None, "c", 1)], "doc_id long, text string, p int")
    labels = spark.createDataFrame([(3, 1, 0), (3, None, 1), (1, 0, None)], "doc_id long, quality int, toxic int")
    assert mixing.mix(docs, labels).count() == 5
    assert mixing.mixed(docs, labels.limit(0)).columns == docs.columns
    assert mixing.mix(docs.limit(0), labels).count() == 0


def test_rates_solve_the_least_squares(spark):
    """Rates of the steps against a plain projected gradient over all rates at once."""
    rng = np.random.default_rng(8)
    p, w = rng.dirichlet([2.0, 0.6, 0.3], 60), rng.integers(5, 400, 60).astype(float)
    table = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(w, p, strict=True)], "tokens long, p array<double>")
    steps = mixing.fit_rates(table, mixing.TARGETS, mixing.ANCHOR, mixing.HEADROOM)
    got = np.array([r.rate for r in table.select("tokens", "p", mixing.rate_of(steps).alias("rate")).collect()])
    share = np.array([mixing.TARGETS[d] for d in mixing.DOMAINS])
    total, natural = w.sum(), w @ p / w.sum()
    wanted, inverse = share * mixing.HEADROOM * natural[0] / share[0], np.linalg.inv((p.T * w) @ p / total + 1e-6 * np.eye(3))
    r = np.ones(60)
    for _ in range(20_000):
        off = (w * r) @ p / total - wanted
        r = np.maximum(0, r - 0.2 * (p @ (inverse @ off) + mixing.PULL * (r - 1)))
    loss = lambda x: (o := (w * x) @ p / total - wanted) @ inverse @ o + mixing.PULL * (w * (x - 1) ** 2).sum() / total
    assert (got >= 0).all() and loss(got) < loss(r) + 1e-4 and np.abs((w * got) @ p / total - wanted).max() < 2e-3


def test_domain_features_of_nothing():
    model = mixing.fit(pa.table({"domain": pa.array([], pa.string())}), {})
    tokens, p = mixing.posteriors(model)(None)
    assert tokens == 0 and np.allclose(p, 1 / 3)
