"""Semantics that need small fixtures of their own."""

import json
import os

from pyspark.sql import functions as F

from loomstone.functions import text as X
from loomstone.operators import chunking, identify, mining, retrieval, session
from loomstone.sources import corpus
from loomstone.streaming import log


def test_budget_is_a_prefix(spark):
    rows = spark.createDataFrame([(i, "x" * n, "t", "u", None, 1.0 - i / 10) for i, n in enumerate((11, 11, 31, 0))], "seq long, content string, thread string, role string, ts timestamp, score double")
    assert [r.running for r in retrieval.budget(rows, 15).orderBy("seq").collect()] == [5, 10]
    assert [r.running for r in retrieval.budget(rows, 22).orderBy("seq").collect()] == [5, 10, 20, 22]


def test_fusion_is_never_below_a_part(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.9)], "seq long, score double")
    k = spark.createDataFrame([(1, 1.0), (3, 1.0)], "seq long, score double")
    got = {r.seq: round(r.score, 6) for r in retrieval.fuse([(a, 1.0)], k).collect()}
    assert got == {1: 0.9, 2: 0.9, 3: 0.3}


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "seq long, role string, content string, thread string, ts timestamp")
    assert retrieval.keyword(none, "alpha beta").count() == 0
    assert retrieval.keyword(none, "the of").count() == 0
    assert identify.extracted(none).count() == 0
    assert chunking.markdown_sections(none).count() == 0


def test_decay(spark):
    rows = spark.createDataFrame([("user", "plain", "2024-01-01 00:00:00"), ("user", "it failed", "2024-01-01 00:00:00"), ("user", "fixed it, it failed", "2024-01-01 00:00:00"), ("kernel", "x", None), ("user", "x", None)], "role string, content string, t string")
    f = X.decay_factor(F.col("role"), F.col("content"), F.col("t").cast("timestamp"), F.lit("2024-01-31 00:00:00").cast("timestamp"))
    assert [round(r[0], 6) for r in rows.select(f).collect()] == [0.5, 0.7, 1.5, 2.0, 1.0]


def test_identifiers_and_resolution(spark):
    rows = spark.createDataFrame([(1, "see bridge/web_server.py and def load_all(self)"), (2, "class FooBar; snake_case_name is_ok")], "seq long, content string")
    found = {r.identifier for r in identify.index(rows).collect()}
    assert {"bridge/web_server.py", "load_all", "FooBar", "snake_case_name"} <= found and "is_ok" not in found
    known = spark.createDataFrame([("session_spoof",), ("retrieval",)], "known string")
    got = {(r.raw, r.known) for r in identify.resolved(["spoof_session", "retreival", "zzz"], known).collect()}
    assert got == {("spoof_session", "session_spoof"), ("retreival", "retrieval")}


def test_chunkers():
    py = chunking.python_chunks("import os\n\nclass Foo(Base):\n    def bar(self):\n        return 1234567890\n\nasync def baz():\n    return 12345678901\n\ndef no(): pass\n", "p.py")
    assert [(k, n) for k, n, _ in py] == [("file", "p.py"), ("class", "p.py:class Foo"), ("function", "p.py:def baz")]
    go = chunking.go_chunks("type T struct {\n a int\n}\nfunc (t T) Go() {\n x()\n}\nfunc f() {}\n", "g.go")
    assert [(k, n) for k, n, _ in go[1:]] == [("type", "g.go:T"), ("function", "g.go:Go")] and go[2][2].endswith("}")
    js = chunking.js_chunks("export function a() {\n  return 1;\n}\nconst b = (x) => {\n  return 2;\n}\n  function inner() { return 3; }\nconst c = async (y\n", "j.js")
    assert [n for _, n, _ in js[1:]] == ["j.js:a", "j.js:b"] and "inner" in js[2][2]
    java = chunking.java_chunks("public class Aa {\n  void go(int x) {\n    if (x > 0) { y(); }\n  }\n  abstract int size(String names);\n}\nrecord Point(int x, int y) { int z; }\n", "A.java")
    assert [n for _, n, _ in java[1:]][:2] == ["A.java:Aa", "A.java:go"] and {"A.java:size", "A.java:Point"} <= {n for _, n, _ in java}
    assert chunking.json_chunks("{" + ", ".join(f'"k{i}": "{"v" * 900}"' for i in range(4)) + "}", "x.json")[1][1] == "x.json:k0"


def test_truncate_middle_keeps_short_threads(spark):
    rows = spark.createDataFrame([("t", i, "user", "x" * 10, 1) for i in range(5)], "thread string, seq long, role string, content string, turn long")
    assert session.truncate_middle(rows, 1000).count() == 5
    cut = session.truncate_middle(rows, 20).orderBy("seq").collect()
    assert [r.content[:5] for r in cut] == ["xxxxx", "[... ", "xxxxx"] and "3 turns" in cut[1].content


def test_duplicate_chains_are_symmetric_in_order(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (2, 4), (3, 9)], "chain long, member long")
    assert [tuple(r) for r in mining.overlapping_chains(rows).collect()] == [(1, 2, 0.75)]


def test_session_files(spark, tmp_path):
    lines = [{"type": "user", "message": {"role": "user", "content": "hi"}, "timestamp": "2024-01-01T00:00:00Z", "sessionId": "s", "uuid": "u"}]
    (tmp_path / "a.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines) + "\nnot json\n")
    os.mkdir(tmp_path / "subagents")
    (tmp_path / "subagents" / "b.jsonl").write_text(json.dumps(lines[0]) + "\n")
    assert [r.content for r in corpus.read_sessions(spark, str(tmp_path)).collect()] == ["hi"]


def test_incremental_read(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    args = (str(source), "turn int, content string", str(tmp_path / "out"), str(tmp_path / "check"))
    (source / "1.jsonl").write_text('{"turn": 1, "content": "a"}\n')
    assert log.incremental(spark, *args).count() == 1
    (source / "2.jsonl").write_text('{"turn": 2, "content": "b"}\n')
    assert sorted(r.turn for r in log.incremental(spark, *args).collect()) == [1, 2]


def test_cleaner_keeps_broken_lines(spark, tmp_path):
    from loomstone.sources import sinks

    (tmp_path / "a.jsonl").write_text('{"role": "user", "content": "hi"}\n{"role": "assistant", "content": "[x]"}\nnot json\n{"role": "kernel", "content": ""}\n')
    kept, counts = sinks.cleaned(spark, str(tmp_path))
    assert sorted(r.value for r in kept.collect()) == ["not json", '{"role": "user", "content": "hi"}']
    assert tuple(counts.first()) == (2, 2)


def test_report_and_sinks(spark, tmp_path):
    from loomstone.sources import sinks

    rows = spark.createDataFrame([("pattern", 7, "b"), ("orphan", None, "a"), ("pattern", 0, "c"), ("other", 9, "d")], "kind string, importance int, content string")
    assert sinks.markdown_report(rows) == "## orphan\n- a\n\n## pattern\n- b\n- c\n"
    sinks.write_kernels(rows, str(tmp_path / "k"))
    assert spark.read.parquet(str(tmp_path / "k")).where("importance is null").count() == 0
    sinks.write_corpus(rows, str(tmp_path / "c"), "kind")
    sinks.write_corpus(rows.where("kind = 'orphan'"), str(tmp_path / "c"), "kind")
    assert spark.read.parquet(str(tmp_path / "c")).count() == 4


def test_json_turns_and_fences(spark):
    from loomstone.operators import extract

    rows = spark.createDataFrame([('[{"role": "user", "content": "x"}]',), ('so: [{"role": "a", "content": "y"}] ok',), ("none",), ('[{"content": "z"}]',)], "t string")
    got = [r[0] for r in rows.select(extract.json_turns(F.col("t"))).collect()]
    assert [g and g[0].content for g in got] == ["x", "y", None, None]
    assert spark.range(1).select(extract.unfenced(F.lit("```json\n[1]\n```"))).first()[0] == "[1]"


def test_retriever_cull_and_tail(spark):
    from loomstone.engine import Retriever
    from loomstone.providers import HashEmbedder, HeadAndTail

    rows = [(i, "context", f"alpha beta item {i}", "t", None) for i in range(12)]
    docs = spark.createDataFrame(rows, "seq long, role string, content string, thread string, ts timestamp")
    vectors = spark.createDataFrame([(i, HashEmbedder().embed([r[2]])[0]) for i, r in enumerate(rows)], "seq long, embedding array<double>")

    class Two:
        def keep(self, query, chunks):
            return [1, 0, 99]

    now = F.lit("2024-02-01").cast("timestamp")
    assert Retriever(docs, vectors, embedder=HashEmbedder()).retrieve("alpha item", 1000, now, tail="earlier").count() == 12
    assert Retriever(docs, vectors, embedder=HashEmbedder(), culler=Two()).retrieve("alpha item", 1000, now, cull=True).count() == 2
    assert HeadAndTail().summarise("abcdefgh", 4) == "ab\n  [...]\ngh"


def test_integration_rounds(spark):
    from loomstone.operators import integrate
    from loomstone.providers import HashEmbedder

    rows = [(i, "user", f"t{i % 2}", None, f"{'alpha' if i < 6 else 'gamma'} subject number{i}") for i in range(12)]
    df = spark.createDataFrame([(*r, HashEmbedder().embed([r[4]])[0]) for r in rows], "seq long, role string, thread string, ts timestamp, content string, embedding array<double>")
    assert integrate.integrate(df, limits=integrate.Limits(rounds=1)).chains == []
    run = integrate.integrate(df, integrate.SharedWords(), integrate.Limits(rounds=2))
    sets = [set(c["member_uids"]) for c in run.chains]
    assert sets and all(len(a & b) <= 0.5 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert run.stopped == "seeds" and min(map(min, run.seeds)) >= 0  # each entry is a seed once
    fed = integrate.integrate(df, integrate.SharedWords(), integrate.Limits(rounds=2, seeds=3), HashEmbedder())
    first = fed.history[0]
    assert first and fed.seeds[1][:first] == [-k - 1 for k in range(first)] and len(fed.seeds[1]) == 3 and fed.stopped == "rounds"
    assert not set(fed.seeds[0]) & set(fed.seeds[1]) and len({c["uid"] for c in fed.chains}) == len(fed.chains)
    assert all(0 <= int(u) < 12 for c in fed.chains for u in c["member_uids"])  # chains are seeds, not members
    few = integrate.integrate(df, integrate.SharedWords(), integrate.Limits(tokens=1))
    assert few.stopped == "tokens" and few.tokens > 0 and len(few.chains) == 1
    assert integrate.integrate(df, integrate.SharedWords(), integrate.Limits(seconds=0)).stats() == {"passes": 1, "chains": 0, "by_pass": [0], "tokens": 0, "stopped": "time"}
    assert run.stats()["chains"] == len(sets) and integrate.converged([5, 2, 1, 0]) and not integrate.converged([0, 0])
    assert integrate.chain_of(integrate.Found(("[1]", "zz"), " x "), [{"seq": 1, "thread": ""}], [], 0)["thread"] == "unknown"
    assert integrate.chain_of(integrate.Found(("zz",), "x"), [{"seq": 1, "thread": ""}], [], 0) is None


def test_index_and_files(spark, tmp_path):
    from loomstone.operators import index

    rows = spark.createDataFrame([(1, "user", "see tool.py", [1.0]), (2, "user", "none", None)], "seq long, role string, content string, embedding array<double>")
    assert index.build(rows, str(tmp_path / "i")) == {"total": 2, "embedded": 1, "keyword_only": 1}
    assert [r.identifier for r in index.load(spark, str(tmp_path / "i"), "identifiers").collect()] == ["tool.py"]
    code = tmp_path / "code"
    for name in ("a.py", "b.txt", "venv/c.py", ".hidden/d.py", "sub/e.GO"):
        (code / name).parent.mkdir(parents=True, exist_ok=True)
        (code / name).write_text("x")
    assert sorted(r.path.rsplit("/", 1)[1] for r in index.read_codebase(spark, str(code)).collect()) == ["a.py", "e.GO"]
    (code / "s1.jsonl").write_text("{}")
    (code / "s2.jsonl").write_text("{}")
    assert index.latest_session(spark, str(code), "s1").endswith("s1.jsonl")
    assert index.changed(spark, str(code), "2000-01-01").count() >= 6


def test_paragraphs(spark):
    rows = spark.createDataFrame([(1, "aaaa\n\nbb\ncccc\n\nd"), (2, "x")], "seq long, content string")
    assert [(r.seq, r.pos, r.content) for r in session.paragraphs(rows, 4).orderBy("seq", "pos").collect()] == [(1, 0, "aaaa\n"), (1, 1, "bb\ncccc\n"), (1, 2, "d"), (2, 0, "x")]


def moved(spark, run):
    """Shuffle bytes that run() writes."""
    import time

    def total():
        time.sleep(0.3)
        spark.range(1).count()  # a later job brings the sums up to date
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    before = total()
    run()
    return total() - before


def test_blocks_are_written_once(spark):
    import numpy as np
    from pyspark.sql import functions as F

    found = []
    for n in (400, 1600):
        v = np.random.default_rng(n).normal(size=(n, 16))
        rows = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(n)], "seq long, v array<double>")
        links = spark.range(1).select(F.lit(0).alias("group_a"), F.lit(0).alias("group_b"))
        side = rows.select("seq", "v", F.array(F.lit(0)).alias("groups"), F.lit(0).alias("group"))
        found.append(moved(spark, lambda: mining.nearest(side, side, links, 3, 0.3, block=32).collect()))
    assert found[1] < 6 * found[0], found  # 4 times the rows


def test_links_of_rows_in_many_groups(spark, monkeypatch):
    import datetime

    import numpy as np
    from pyspark.sql import functions as F

    monkeypatch.setattr(mining, "TILE", 8)
    v = np.random.default_rng(2).normal(size=(60, 6)).round(1)
    v[20:40] = v[1] * 2  # full scores that tie
    v[5] = 0
    day = datetime.datetime(2024, 1, 1)
    held = {i: {(i * 7 + m) % 5 for m in range(i % 3 + 1)} for i in range(60)}
    rows = [(i, day + datetime.timedelta(days=7 * w + r), v[i].tolist()) for i in range(60) for w in held[i] for r in range(2)]
    df = spark.createDataFrame(rows, "seq long, ts timestamp, embedding array<float>")
    pairs = [(a, b) for a in range(5) for b in range(5) if abs(a - b) > 1]
    date = lambda w: (day + datetime.timedelta(days=7 * w)).date()
    weeks = spark.createDataFrame([(date(a), date(b)) for a, b in pairs], "week_a date, week_b date")
    u = v.astype(np.float32).astype(float)
    size = np.linalg.norm(u, axis=1)
    cos = np.round(u @ u.T / np.where(size[:, None] * size == 0, 1, size[:, None] * size), 6)
    want = []
    for a, b in pairs:
        best = sorted((-cos[i, j], i, j) for i in range(60) for j in range(60) if a in held[i] and b in held[j] and i != j and cos[i, j] > 0.3)[:3]
        want += [(date(a), date(b), n + 1, i, j) for n, (_, i, j) in enumerate(best)]
    assert sorted((r.week_a, r.week_b, r.place, r.seq_a, r.seq_b) for r in mining.chunk_links(df, weeks, 0.3).collect()) == sorted(want)
    assert mining.chunk_links(df, weeks.limit(0), 0.3).count() == 0


def test_pairs_of_unlike_chains_are_not_moved(spark):
    import random

    draw, found = random.Random(5), []
    for n in (600, 2400):
        # chains of 4 of 100 members: the more there are the more share one; every tenth differs in a member from the one before
        sets = [set(draw.sample(range(100), 4)) for _ in range(n)]
        for i in range(9, n, 10):
            sets[i] = set(list(sets[i - 1])[:3]) | {draw.randrange(100)}
        df = spark.createDataFrame([(i, x) for i, s in enumerate(sets) for x in s for _ in range(2)], "chain long, member long")
        got = []
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with larger tables
        try:
            found.append(moved(spark, lambda: got.extend(tuple(r) for r in mining.overlapping_chains(df).collect())))  # noqa: B023
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert sorted(got) == [(a, b, round(k / u, 6)) for a in range(n) for b in range(a + 1, n) if (k := len(sets[a] & sets[b])) > (u := len(sets[a] | sets[b])) / 2] and got
    assert found[1] < 6 * found[0], found  # 4 times the rows


def test_overlaps_at_every_share_and_size(spark):
    import random

    draw = random.Random(6)
    sets = [set(draw.sample(range(24), draw.randint(1, 12))) for _ in range(80)] + [set(range(200)), set(range(10, 205))]
    df = spark.createDataFrame([(i, x) for i, s in enumerate(sets) for x in s], "chain long, member long")
    for least in (0.2, 0.5, 0.57, 0.9):
        want = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > least]
        assert sorted((r.a, r.b) for r in mining.overlapping_chains(df, least).collect()) == want


def test_cross_references_of_a_task_are_bounded(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    monkeypatch.setattr(mining, "ROWS", 500, raising=False)
    draw = random.Random(7)
    sets = [[draw.randrange(200) for _ in range(6)] for _ in range(400)]  # with repeated members, and pairs in several chains
    df = spark.createDataFrame([(i, x) for i, s in enumerate(sets) for x in s], "chain long, member long")
    want = {(x, f"c{i}") for i, s in enumerate(sets) for x in s} | {(x, f"m{y}") for s in sets for x in s for y in s if x != y}
    edges = mining.xrefs(df)
    got = [(r.member, r.ref, r.part) for r in edges.withColumn("part", F.spark_partition_id()).collect()]
    assert sorted(r[:2] for r in got) == sorted(want)
    most = max(sum(r[2] == part for r in got) for part in {r[2] for r in got})
    assert most < 2000, most
    assert {r.member: r.refs for r in mining.xref_sets(edges).collect()} == {m: sorted(r for x, r in want if x == m) for m in {x for x, _ in want}}
    assert mining.xrefs(df.limit(0)).count() == 0


def test_nearest_pairs_of_blocks_equal_all_pairs(spark, monkeypatch):
    import datetime

    import numpy as np
    from pyspark.sql import functions as F

    made = []
    apart = mining.nearest
    monkeypatch.setattr(mining, "nearest", lambda *a, **b: made.append(apart(*a, **b, block=16)) or made[-1])
    v = np.random.default_rng(1).normal(size=(120, 8)).round(1)
    v[7] = 0
    v[50:60] = v[3]  # ties
    day = datetime.datetime(2024, 1, 1)
    rows = [(i, "t", day + datetime.timedelta(days=(i % 3) * 21), f"w{i % 5} x", v[i].tolist()) for i in range(120)] + [(200, "t", day, "w", None)]
    df = spark.createDataFrame(rows, "seq long, thread string, ts timestamp, content string, embedding array<float>")
    size = np.linalg.norm(v, axis=1)
    cos = np.round(v @ v.T / np.where(size[:, None] * size == 0, 1, size[:, None] * size), 6)
    weeks = df.select(mining.week(F.col("ts")).alias("week_a")).distinct().crossJoin(df.select(mining.week(F.col("ts")).alias("week_b")).distinct()).where("week_a < week_b")
    got = sorted((r.week_a.isoformat(), r.week_b.isoformat(), r.place, r.seq_a, r.seq_b, round(r.cos, 5)) for r in mining.chunk_links(df, weeks, 0.3).collect())
    want = []
    monday = ["2024-01-01", "2024-01-22", "2024-02-12"]
    for a, b in ((0, 1), (0, 2), (1, 2)):
        best = sorted((-cos[i, j], i, j) for i in range(a, 120, 3) for j in range(b, 120, 3) if cos[i, j] > 0.3)[:3]
        want += [(monday[a], monday[b], n + 1, i, j, round(-c, 5)) for n, (c, i, j) in enumerate(best)]
    assert got == sorted(want)
    found = mining.clusters(df, df.where("seq % 3 = 0"), near=5, most=5)
    by = {}
    for r in found.collect():
        by.setdefault(r.seed_seq, set()).add(r.seq)
    assert by == {q: {i for _, i in sorted((-cos[i, q], i) for i in range(120))[:5]} for q in range(0, 120, 3)}
    # what leaves the blocks is cut there, never all pairs
    assert made[0].count() < 3 * 40 * 40 / 4 and made[1].count() < 120 * 40


def test_static_budget_reads_behind_sixty_short_documents(spark, tmp_path):
    from loomstone.plans import catalogue

    texts = [(i, None if i in (100, 105) else "x" * (400 if i < 180 else 20_000), "en", "s", 0) for i in range(100, 300)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.seq, r.chars) for r in catalogue.QUERIES["context_budget_static"](spark, str(tmp_path)).collect())
    want, running = [], 0
    for i, text, *_ in texts:
        n = len(f"--- doc-{i} ---\n{text or ''}\n") // 4
        if running + n <= 9000:
            want.append((i, len(f"--- doc-{i} ---\n{text or ''}\n")))
        elif 9000 - running > 100:
            want.append((i, len(f"--- doc-{i} (truncated) ---\n\n") + (9000 - running) * 4))
        running += n
    assert got == want and len(got) > 60
    paragraphs = catalogue.QUERIES["paragraph_groups"](spark, str(tmp_path))
    assert paragraphs.select("seq").distinct().count() == 198


def test_rendered_chunks_and_empty_entity(spark):
    rows = spark.createDataFrame([(1, "code", "pass", "t", None, "a.py:def f", "function"), (2, "user", "hi", None, None, "", "")], "seq long, role string, content string, thread string, ts timestamp, heading string, chunk_type string")
    assert [r.chunk for r in retrieval.rendered(rows).orderBy("seq").collect()] == ["[1 t function] a.py:def f\npass", "[2 ?  user] hi"]
    assert retrieval.entity(rows, "").count() == 0
    assert retrieval.cull_indices("keep [3, 0,9] and [1]", 5) == [3, 0] and retrieval.cull_indices("none", 5) == [] and retrieval.cull_indices("[,]", 5) == []


def test_retriever_resolves_names_and_falls_back(spark):
    from loomstone.engine import Retriever
    from loomstone.operators.retrieval import Decomposition

    docs = spark.createDataFrame([(1, "context", "about session_spoof here", "t", None), (2, "context", "other words", "t", None)], "seq long, role string, content string, thread string, ts timestamp")

    class Plan:
        def decompose(self, query):
            return Decomposition("rewritten", identifiers=("spoof_session",))

    now = F.lit("2024-02-01").cast("timestamp")
    known = spark.createDataFrame([("session_spoof",)], "identifier string")
    assert [r.seq for r in Retriever(docs, decomposer=Plan(), known=known).retrieve("words", 1000, now).collect()] == [1]
    assert Retriever(docs, decomposer=Plan()).retrieve("words", 1000, now).count() == 0
    static = spark.createDataFrame([(0, "a.md", "x" * 400), (1, "b.md", "y" * 4000)], "seq long, path string, content string")
    got = [r.chunk for r in Retriever(None, static=static).retrieve("q", 300, now).orderBy("seq").collect()]
    assert got[0] == f"--- a.md ---\n{'x' * 400}\n" and got[1].startswith("--- b.md (truncated) ---\nyyy") and got[1].count("y") == (300 - len(got[0]) // 4) * 4


def test_static_sources_and_markdown(spark, tmp_path):
    (tmp_path / "plans").mkdir()
    (tmp_path / "p").mkdir()
    (tmp_path / "plans" / "one.md").write_text("# A\nbody\n# B\nmore")
    (tmp_path / "p" / "CLAUDE.md").write_text("n" * 600_000)
    (tmp_path / "p" / "other.md").write_text("z")
    (tmp_path / "t.txt").write_text("text")
    found = corpus.static_sources(spark, [str(tmp_path / "*.txt"), str(tmp_path / "p"), str(tmp_path / "missing")])
    assert [r.path.rsplit("/", 1)[1] for r in found.orderBy("seq").collect()] == ["t.txt", "CLAUDE.md", "other.md"]
    entries = corpus.markdown_entries(corpus.read_markdown(spark, str(tmp_path))).orderBy("thread", "pos").collect()
    assert [(r.thread, r.heading, len(r.content)) for r in entries] == [("p", "preamble", 600_000), ("plans", "A", 8), ("plans", "B", 8)]
    assert corpus.static_sources(spark, []).count() == 0 and corpus.read_head(spark, str(tmp_path / "p")).where("length(text) > 16000").count() == 0


def test_session_ingest_from_files(spark, tmp_path):
    folder = tmp_path / "-home-u-projects-bridge"
    folder.mkdir()
    say = lambda kind, content, **more: json.dumps({"type": kind, "message": {"role": kind, "content": content}, **more}) + "\n"
    tool = [{"type": "text", "text": "done"}, {"type": "tool_use", "name": "Read", "input": {"file_path": "a.py"}}]
    lines = say("user", "first") + say("summary", "no") + say("assistant", [tool[1]]) + say("user", "  ") + say("assistant", tool, sessionId="s9") + "{broken\n" + say("user", [{"type": "text", "text": "typed"}])
    (folder / "x.jsonl").write_text(lines)
    got = [(r.seq, r.role, r.content, r.turn, r.thread, r.source_session) for r in corpus.read_sessions(spark, str(tmp_path)).orderBy("seq").collect()]
    assert got[0] == (0, "user", "first", 1, "bridge", "x") and got[1] == (4, "assistant", "done\n[Read: a.py]", 2, "bridge", "s9") and got[2][0] == 6 and got[2][3] == 3
    assert corpus.read_sessions(spark, str(folder / "x.jsonl"), project="mine").first().thread == "mine"
    said = [r.content for r in corpus.conversation_turns(corpus.read_lines(spark, str(tmp_path))).orderBy("seq").collect()]
    assert said[0] == "first" and said[-1] == "typed" and said[1].startswith("done") and len(said) == 3
    seen = corpus.read_lines(spark, str(tmp_path)).groupBy("path").agg(F.count("*").alias("n")).collect()
    with open(folder / "x.jsonl", "a") as f:
        f.write(say("assistant", "later"))
    known = spark.createDataFrame([tuple(r) for r in seen], "path string, n long")
    new = corpus.new_lines(corpus.read_lines(spark, str(tmp_path)), known)
    assert [r.line for r in new.collect()] == [7] and [r.content for r in log.entries(new).collect()] == ["later"]


def test_cleaner_rewrites(spark, tmp_path):
    from loomstone.sources import sinks

    root = tmp_path / "corpus"
    root.mkdir()
    (root / "a.jsonl").write_text('{"role": "user", "content": "hi"}\n{"role": "assistant", "content": "[x]"}\n')
    (root / "b.jsonl").write_text("not json\n")
    assert sinks.clean_corpus(spark, str(root)) == [("a.jsonl", 1, 1), ("b.jsonl", 1, 0)]
    assert (root / "a.jsonl").exists()
    sinks.clean_corpus(spark, str(root), dry_run=False)
    assert sorted(r.value for r in spark.read.option("recursiveFileLookup", "true").text(str(root)).collect()) == ["not json", '{"role": "user", "content": "hi"}']


def test_state_report_and_blocks(spark, tmp_path):
    from loomstone.sources import sinks

    state = str(tmp_path / "state")
    assert sinks.read_state(spark, state) is None
    sinks.write_state(spark, state, {"pass_count": 2, "converged": True})
    sinks.write_state(spark, state, {"pass_count": 3, "converged": False})
    assert sinks.read_state(spark, state)["pass_count"] == 3
    chains = spark.createDataFrame([("c1", "orphan", True, "text")], "chain string, chain_type string, cross_project boolean, content string")
    members = spark.createDataFrame([("c1", "1:t:x", 1)], "chain string, members string, threads long")
    kernels = spark.createDataFrame([("k1", "orphan", 5, "c1", 1)], "kernel string, kind string, importance int, chains string, place int")
    rows = mining.report_rows(chains, members, kernels, spark.range(1).select(F.lit(7).alias("corpus_entries")))
    sinks.write_report(rows, str(tmp_path / "live"), str(tmp_path / "versions"), "r1")
    sinks.write_report(rows, str(tmp_path / "live"), str(tmp_path / "versions"), "r2")
    back = spark.read.text(str(tmp_path / "live"))
    assert {r.section for r in back.collect()} == {"profile", "kernels", "orphan", "cross_project", "unfinished"} and len(os.listdir(tmp_path / "versions")) == 2
    assert "## orphan chains" in sinks.markdown_report(kernels.withColumn("content", F.lit("k")), chains=mining.chains_by_type(chains).join(chains, "chain"))


def test_missing_index_is_empty(spark, tmp_path):
    from loomstone.operators import index

    assert index.load(spark, str(tmp_path), "identifiers").count() == 0 and index.newest(spark, str(tmp_path / "none")) is None
    (tmp_path / "f.py").write_text("x")
    assert index.newest(spark, str(tmp_path)) is not None
    assert [(r.project, r.content) for r in index.read_codebases(spark, {"p": str(tmp_path)}).collect()] == [("p", "x")]


def test_due_and_config():
    from datetime import datetime, timedelta

    from loomstone import config

    now = datetime(2024, 1, 2)
    back = lambda h: now - timedelta(hours=h)
    assert log.due(back(1), back(5), now) and log.due(back(1), None, now)
    assert not log.due(None, None, now) and not log.due(back(0.1), back(5), now) and not log.due(back(6), back(5), now) and not log.due(back(0.4), back(0.5), now)
    own = config.merged({"token_budgets": {"recent_tail": 5}, "models": {"cull": "m"}})
    assert own["token_budgets"]["recent_tail"] == 5 and own["token_budgets"]["dynamic_context"] == 30_000
    assert config.model_name("cull", own, environment={}) == "m" and config.model_name("cull", own, environment={"LOOMSTONE_CULL_MODEL": "e"}) == "e" and config.model_name("embed", own, "d", {}) == "d"


def test_providers_embed_and_retell(spark):
    from loomstone import providers

    class FlakyEmbedder:
        def embed(self, texts):
            if len(texts) > 1 or "bad" in texts[0]:
                raise ValueError("down")
            return [[float(len(texts[0]))]]

    class Retelling:
        def narrate(self, turns):
            return None if "keep" in turns[0][1] else 'so [{"role": "user", "content": "all of it"}]'


    rows = spark.createDataFrame([(1, "x" * 9000), (2, "bad"), (3, None)], "seq long, content string")
    assert [r.embedding for r in providers.embedded(rows, FlakyEmbedder()).orderBy("seq").collect()] == [[8000.0], None, [0.0]]
    turns = [(t, i, "user" if i % 2 == 0 else "assistant", f"{t} {i}") for t, n in (("long", 30), ("keep", 30), ("short", 5)) for i in range(n)]
    out = providers.narrated(spark.createDataFrame(turns, "thread string, seq long, role string, content string"), Retelling())
    assert {r.thread: r.n for r in out.groupBy("thread").agg(F.count("*").alias("n")).collect()} == {"long": 1, "keep": 30, "short": 5}
    assert set(providers.POLICIES) == {"tokens", "turns"}


def test_transcript_sections(spark):
    log_rows = spark.createDataFrame([("t", i, "user" if i % 2 == 0 else "assistant", "x" * 40, 1 + i // 2, "2024-03-01 10:00:00" if i == 5 else None) for i in range(6)], "thread string, seq long, role string, content string, turn long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    recall = spark.createDataFrame([("t", 0, "one\n\ntwo")], "thread string, seq long, content string")
    blocks = session.compressed_blocks(log_rows.where("turn = 1"), 2)
    base = F.lit("2024-01-01 00:00:00").cast("timestamp")
    out = session.transcript_sections(log_rows, 130, base, "me", recall, blocks)
    got = out.orderBy("pos").collect()
    assert [r.zone for r in got] == [1] * 6 + [2] * 4 + [3] * 2 and [r.content for r in got[:4]] == [session.IDENTITY, "me", session.RECALL, "one\n\ntwo"]
    assert got[0].timestamp == "2023-12-31T23:59:00.000Z" and got[5].timestamp == "2023-12-31T23:59:05.000Z" and got[5].content == "Noted."
    assert [r.timestamp[11:19] for r in got[6:]] == ["00:00:00", "00:20:00", "00:40:00", "01:00:00", "02:00:00", "10:00:00"]
    assert got[0].parent_uuid is None and all(b.parent_uuid == a.uuid for a, b in zip(got, got[1:], strict=False))
    record = json.loads(session.transcript_records(out, "/w").orderBy("pos").collect()[1].value)
    assert record["type"] == "assistant" and record["message"]["content"] == [{"type": "text", "text": "me"}] and record["parentUuid"] == got[0].uuid and record["cwd"] == "/w"


def test_seed_bands(spark):
    rows = [(i, r, t, ts, "text") for i, (r, t, ts) in enumerate([("user", "f", None)] * 3 + [("chain", "f", None)] * 2 + [("user", "o", "2024-01-30")] * 2 + [("user", "o", "2023-01-01")] * 2 + [("user", "o", None)])]
    df = spark.createDataFrame(rows, "seq long, role string, thread string, ts string, content string").withColumn("ts", F.col("ts").cast("timestamp"))
    chained = spark.createDataFrame([(9,)], "seq long")
    got = mining.seeds(df, chained, "f", 100, F.lit("2024-02-01").cast("timestamp")).orderBy("place").collect()
    assert [r.priority for r in got] == [2.5] * 3 + [2.0, 1.5, 1.0] * 2 + [0.5]


def test_clusters_leave_chains_and_low_signal_out(spark):
    rows = spark.createDataFrame([(i, r, "t", None, c, [1.0, i / 100]) for i, (r, c) in enumerate([("user", "a b"), ("chain", "a c"), ("user", "[Read: x]"), ("user", "a d"), ("user", "a e")])], "seq long, role string, thread string, ts timestamp, content string, embedding array<double>")
    assert sorted(r.seq for r in mining.clusters(rows, rows.where("seq = 0")).collect()) == [0, 3, 4]
    assert sorted(r.seq for r in mining.clusters(rows, rows.where("seq in (0, 1)")).where("seed_seq = 0").collect()) == [0, 1, 3, 4]
