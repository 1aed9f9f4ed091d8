"""Catalogue of named queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions import text as X
from loomstone.functions import vector as V
from loomstone.engine import SUFFIX, Retriever
from loomstone.operators import chunking, extract, identify, mining, session
from loomstone.operators import retrieval as R
from loomstone.providers import HashEmbedder
from loomstone.sources import corpus as C
from loomstone.streaming import log

QUERY = "rewh, orantion, éonierç, que"
TERMS = X.query_terms(QUERY)
AS_OF = "2024-02-01 00:00:00"
VECTOR = [((i * 7) % 11 - 5) / 5.0 for i in range(64)]
NAMES = ["thereon", "an/Onan.py", "ouen", "the"]


def values(spark: SparkSession, columns: str, rows: str) -> DataFrame:
    return spark.sql(f"select * from values {rows} as t({columns})")


def as_of() -> F.Column:
    return F.lit(AS_OF).cast("timestamp")


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return keep


# ---- retrieval -------------------------------------------------------------------------------------------

HITS = " + ".join(f"contains(lower(text), '{t}')::int" for t in TERMS)
KEYWORD = f"select doc_id as seq, round(({HITS}) / {len(TERMS)}.0, 6) as score from documents where ({HITS}) > 0 order by score desc, seq limit 30"
COSINE = "case when sqrt(list_sum(list_transform({a}, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform({b}, lambda x: x::double * x::double))) = 0 then 0 else list_inner_product({a}::double[], {b}::double[]) / (sqrt(list_sum(list_transform({a}, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform({b}, lambda x: x::double * x::double)))) end"
QVEC = f"[{', '.join(map(str, VECTOR))}]::double[]"
SEMANTIC = f"select vec_id as seq, round({COSINE.format(a='embedding', b=QVEC)}, 6) as score from embeddings"


@query(KEYWORD)
def keyword_search(spark, d):
    return R.keyword(C.documents(spark, d), QUERY).select("seq", F.round("score", 6).alias("score"))


@query(
    f"with k as (select doc_id as seq, text, coalesce(source, '?') as source, round(({HITS}) / {len(TERMS)}.0 * 1.5, 6) as score from documents where ({HITS}) > 0 order by score desc, seq limit 30), "
    "t as (select seq, score, length('[' || seq || ' ' || source || '  context] ' || text) // 4 as tokens from k), r as (select *, sum(tokens) over (order by score desc, seq rows unbounded preceding) as running from t) select seq, score, tokens, running::bigint as running from r where running <= 6000"
)
def keyword_budget(spark, d):
    docs = C.documents(spark, d)
    ranked = R.decayed(R.keyword(docs, QUERY), docs, as_of()).withColumn("score", F.round("score", 6))
    return R.budget(ranked, 6000).select("seq", "score", "tokens", "running")


@query(f"{SEMANTIC} order by score desc, seq limit 30")
def semantic_topk(spark, d):
    return R.semantic(C.table(spark, d, "embeddings").withColumnRenamed("vec_id", "seq"), VECTOR)


@query(f"select * from ({SEMANTIC} where label in (3)) order by score desc, seq limit 20")
def project_semantic(spark, d):
    e = C.table(spark, d, "embeddings").select(F.col("vec_id").alias("seq"), F.col("label").cast("string").alias("thread"), "embedding")
    return R.project(e, "3", e, VECTOR)


@query("select event_id as seq, 0.5::double as score from events where contains(user_id::varchar, '12') order by ts desc, seq limit 20")
def project_recency(spark, d):
    return R.project(C.events(spark, d), "12")


TEMPORAL = "select event_id as seq, ({score})::double as score from events {where} order by {order}, event_id limit 20"


@query(TEMPORAL.format(score="round(1.0 - 0.02 * (row_number() over (order by ts, event_id) - 1), 6)", where="", order="ts"))
def temporal_oldest(spark, d):
    return R.temporal(C.events(spark, d), "oldest").select("seq", F.round("score", 6).alias("score"))


@query(TEMPORAL.format(score="round(1.0 - 0.02 * (row_number() over (order by ts desc, event_id) - 1), 6)", where="", order="ts desc"))
def temporal_newest(spark, d):
    return R.temporal(C.events(spark, d), "newest").select("seq", F.round("score", 6).alias("score"))


@query(TEMPORAL.format(score="0.8", where="where ts >= timestamp '2024-01-20'", order="ts desc"))
def temporal_after(spark, d):
    return R.temporal(C.events(spark, d), "after:2024-01-20")


@query(TEMPORAL.format(score="0.8", where="where ts < timestamp '2024-01-10'", order="ts desc"))
def temporal_before(spark, d):
    return R.temporal(C.events(spark, d), "before:2024-01-10")


@query(TEMPORAL.format(score="0.8", where="where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-10'", order="ts desc"))
def temporal_range(spark, d):
    return R.temporal(C.events(spark, d), "range:2024-01-05..2024-01-10")


@query("select doc_id as seq, 0.8::double as score from documents where contains(lower(text), 'eronha') order by seq limit 20")
def entity_search(spark, d):
    return R.entity(C.documents(spark, d), "Eronha")


def _ident_case(n: str) -> str:
    stem = n.rsplit("/", 1)[-1].rsplit(".", 1)[0].lower()
    extra = f"when contains(lower(text), '{stem}') then 0.7 " if len(stem) >= 4 else ""
    return f"case when contains(text, '{n}') then 1.0 when contains(lower(text), '{n.lower()}') then 0.9 {extra}else 0.0 end"


IDENT = f"select doc_id as seq, greatest({', '.join(map(_ident_case, NAMES[:3]))})::double as score from documents"


@query(f"select * from ({IDENT}) where score > 0 order by score desc, seq limit 30")
def identifier_search(spark, d):
    return R.identifiers(C.documents(spark, d), NAMES[:3])


@query(
    f"with s as ({SEMANTIC} order by score desc, seq limit 30), k as ({KEYWORD}), i as (select * from ({IDENT}) where score > 0 order by score desc, seq limit 30), "
    "u as (select seq, score * 0.7 as s, 0.0 as kw, 1 as ax from s union all select seq, 0.0, score, 0 from k union all select seq, score * 0.6, 0.0, 0 from i) "
    "select seq, round(sum(s) + sum(kw) * case when max(ax) = 1 then 0.4 else 0.3 end, 6) as score from u group by seq"
)
def fusion_rank(spark, d):
    docs, e = C.documents(spark, d), C.table(spark, d, "embeddings").withColumnRenamed("vec_id", "seq")
    k = R.keyword(docs, QUERY).withColumn("score", F.round("score", 6))
    return R.fuse([(R.semantic(e, VECTOR), 0.7)], k, R.identifiers(docs, NAMES[:3])).select("seq", F.round("score", 6).alias("score"))


FAILURE = " or ".join("contains(c, '" + w.replace("'", "''") + "')" for w in X.FAILURE_WORDS)
CORRECTION = " or ".join("contains(c, '" + w.replace("'", "''") + "')" for w in X.CORRECTION_WORDS)


@query(
    f"with e as (select event_id as seq, lower(event_type || ' ' || coalesce(props, '')) as c, (epoch_us(timestamp '{AS_OF}') - epoch_us(ts)) / 86400000000.0 as age from events) "
    f"select seq, round(case when {CORRECTION} then 1 + least(age / 30, 0.5) when {FAILURE} then greatest(0.7, 1 - age / 60) else greatest(0.3, pow(0.5, age / 30)) end, 6) as factor from e"
)
def temporal_decay(spark, d):
    return C.events(spark, d).select("seq", F.round(X.decay_factor(F.col("role"), F.col("content"), F.col("ts"), as_of()), 6).alias("factor"))


@query(
    "with c as (select doc_id as seq, coalesce(text, '') as text, length('--- doc-' || doc_id || ' ---' || chr(10) || coalesce(text, '') || chr(10)) // 4 as n from documents), t as (select *, sum(n) over (order by seq rows unbounded preceding) as r from c), "
    "o as (select *, 9000 - (r - n) as rest, sum((r > 9000)::int) over (order by seq rows unbounded preceding) as k from t) "
    "select seq, length(case when r <= 9000 then '--- doc-' || seq || ' ---' || chr(10) || text || chr(10) else '--- doc-' || seq || ' (truncated) ---' || chr(10) || substr(text, 1, (rest * 4)::int) || chr(10) end)::bigint as chars from o where r <= 9000 or (k = 1 and rest > 100)"
)
def context_budget_static(spark, d):
    sources = C.documents(spark, d).select("seq", F.concat(F.lit("doc-"), F.col("seq").cast("string")).alias("path"), "content")
    return R.static_budget(sources, 9000).select("seq", F.length("chunk").cast("long").alias("chars"))


# ---- filters ---------------------------------------------------------------------------------------------

LOW_ROWS = [
    ("assistant", "[Read: a.py]"), ("user", "[Read: a.py]"), ("assistant", "No response requested."), ("kernel", ""), ("chain", "[x]"), ("user", "[{'tool_use_id': 'a'}]"), ("assistant", "fixed the PTY resize bug"),
    ("user", "The user doesn't want to proceed with this tool use now"), ("assistant", "  "), ("user", " ok "),
]
LOW = ", ".join("('" + r + "', '" + c.replace("'", "''") + "')" for r, c in LOW_ROWS)
_T = "trim(content, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"
_BR, _FI = f"({_T}[1] = '[' and ends_with({_T}, ']') and length({_T}) < 200)", f"({_T} in ('No response requested.', 'I have this context. Ready to continue.'))"
_RE = f"(contains({_T}, 'The user doesn''t want to proceed with this tool use') and length({_T}) < 400)"
_EM = f"(starts_with({_T}, '[' || chr(123) || '''tool_use_id'':') and length({_T}) < 80)"
INGEST = f"({_T} = '' or (role = 'assistant' and ({_BR} or {_FI})) or (role = 'user' and ({_RE} or {_EM})))"
LOW_SQL = f"with t(role, content) as (values {LOW.replace(chr(123), chr(123) * 2).replace(chr(125), chr(125) * 2)}), u as (select * from t union all select role, text from conversations) select role, content, count(*) as n from u where not {{p}} group by all"


def _low(spark, d, predicate):
    fixed = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in LOW_ROWS])))
    rows = fixed.unionByName(C.conversations(spark, d).select("role", "content"))
    return rows.where(~predicate(F.col("role"), F.col("content"))).groupBy("role", "content").agg(F.count("*").alias("n"))


@query(LOW_SQL.format(p=INGEST))
def low_signal_ingest(spark, d):
    return _low(spark, d, X.low_signal_ingest)


@query(LOW_SQL.format(p=f"({_T} = '' or (role not in ('kernel', 'chain') and {INGEST}))"))
def low_signal_clean(spark, d):
    return _low(spark, d, X.low_signal_clean)


@query(LOW_SQL.format(p=f"(role not in ('kernel', 'chain') and ({_T} = '' or {_BR} or {_FI} or {_RE} or {_EM}))"))
def low_signal_mining(spark, d):
    return _low(spark, d, X.low_signal_mining)


# ---- chunks and identifiers ------------------------------------------------------------------------------

MD = "(1, '# One\\nalpha\\n## Two\\nbeta\\ngamma'), (2, 'intro\\n\\n# Three'), (3, 'no heading here'), (4, '#\\n\\n')"


@query(
    "with t(seq, content) as (values " + MD.replace("'# One", "e'# One").replace("'intro", "e'intro").replace("'#\\n", "e'#\\n") + "), l as (select seq, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) as i from t), "
    "s as (select *, sum((starts_with(line, '#') or i = 1)::int) over (partition by seq order by i) - 1 as section from l), "
    "g as (select seq, section::int as section, arg_min(line, i) as head, trim(string_agg(line, chr(10) order by i), ' ' || chr(10) || chr(9) || chr(13)) as content from s group by all) "
    "select seq, section, case when starts_with(head, '#') then trim(ltrim(head, '#')) else 'preamble' end as heading, content from g where content <> ''"
)
def markdown_sections(spark, d):
    return chunking.markdown_sections(values(spark, "seq, content", MD))


IDS = "(1, 'see bridge/web_server.py and /home/a/x.js, def load_all(self): self.other_name'), (2, 'class FooBar in tool.py; ./../n.py /tmp/z.md'), (3, 'nothing here'), (4, 'snake_case_name and is_ok')"
ID_FILES = "[\\w-]+(?:/[\\w.-]+)+\\.\\w{1,5}"


@query()
def identifier_extract(spark, d):
    pages = C.table(spark, d, "pages").select((F.col("page_id") + 10).alias("seq"), F.col("html").alias("content"))
    return identify.index(values(spark, "seq, content", IDS).withColumn("seq", F.col("seq").cast("long")).unionByName(pages))


KNOWN = "('session_spoof'), ('_replace_session'), ('load_config.py'), ('retrieval'), ('do_session')"
RAW = "('spoof_session'), ('replace_session'), ('LOAD_CONFIG.PY'), ('retrievals'), ('zzz')"
_TS = "list_sort(list_distinct(list_filter(regexp_split_to_array(lower({c}), '[_./-]'), lambda x: x <> '')))"


@query(
    f"with k(known) as (values {KNOWN}), r(raw) as (values {RAW}), p as (select raw, known, case when lower(raw) = lower(known) then 1.0 when {_TS.format(c='raw')} = {_TS.format(c='known')} then 0.95 "
    "when contains(lower(known), lower(raw)) and length(raw) / length(known) >= 0.6 then 0.5 + length(raw) / length(known) * 0.4 when contains(lower(raw), lower(known)) and length(known) / length(raw) >= 0.6 then 0.4 + length(known) / length(raw) * 0.3 end as score from r, k) "
    "select raw, known, round(score::double, 6) as score from p where score >= 0.55"
)
def identifier_resolve_native(spark, d):
    return identify.resolved_native(values(spark, "raw", RAW), values(spark, "known", KNOWN))


@query("select * from (values ('spoof_session', 'session_spoof', 0.95), ('spoof_session', 'do_session', round(2 * 9 / 23.0 * 10 / 13.0, 6)), ('replace_sesion', '_replace_session', round(2 * 14 / 30.0 * 14 / 16.0, 6)), ('LOAD_CONFIG.PY', 'LOAD_CONFIG.PY', 1.0), ('retreival', 'retrieval', round(2 * 8 / 18.0, 6))) t(raw, known, score)")
def identifier_resolve_full(spark, d):
    return identify.resolved(["spoof_session", "replace_sesion", "LOAD_CONFIG.PY", "retreival"], values(spark, "known", KNOWN))


GOLDEN_CHUNKS = [
    (1, 0, "file", "a.py", "import os\n\nclass Foo:\n    def bar(self):\n        return 1234567890\n\ndef baz():\n    return 12345678901\n"), (1, 1, "class", "a.py:class Foo", "class Foo:\n    def bar(self):\n        return 1234567890\n"), (1, 2, "function", "a.py:def baz", "def baz():\n    return 12345678901\n"),
    (2, 0, "file", "b.go", "type T struct {\n a int\n}\nfunc (t T) Go() {\n x()\n}\n"), (2, 1, "type", "b.go:T", "type T struct {\n a int\n}"), (2, 2, "function", "b.go:Go", "func (t T) Go() {\n x()\n}"), (3, 0, "file", "c.txt", "plain"),
]


def _golden_sql() -> str:
    text = lambda v: "e'" + v.replace("\n", "\\n") + "'" if isinstance(v, str) else str(v)
    return "select * from (values " + ", ".join(f"({', '.join(map(text, r))})" for r in GOLDEN_CHUNKS) + ") t(seq, pos, chunk_type, heading, content)"


@query(_golden_sql())
def code_chunks(spark, d):
    rows = "(1, 'a.py', 'import os\\n\\nclass Foo:\\n    def bar(self):\\n        return 1234567890\\n\\ndef baz():\\n    return 12345678901\\n'), (2, 'b.go', 'type T struct {\\n a int\\n}\\nfunc (t T) Go() {\\n x()\\n}\\n'), (3, 'c.txt', 'plain')"
    return chunking.source_chunks(values(spark, "seq, path, content", rows).withColumn("seq", F.col("seq").cast("long")))


ACT = "'hi <action project=\"p\" type=\"read\">\\na.py\\n</action> and <action project=\"q\" type=\"run\">ls</action> bye'"


@query(
    f"with t(seq, content) as (values (1, e{ACT})), b as (select seq, unnest(regexp_extract_all(content, '(?s)<action\\s+project=\"([^\"]+)\"\\s+type=\"([^\"]+)\">\\s*(.*?)\\s*</action>')) as block, "
    "generate_subscripts(regexp_extract_all(content, '(?s)<action\\s+project=\"([^\"]+)\"\\s+type=\"([^\"]+)\">\\s*(.*?)\\s*</action>'), 1) - 1 as pos from t) "
    "select seq, pos::int as pos, regexp_extract(block, 'project=\"([^\"]+)\"', 1) as project, regexp_extract(block, 'type=\"([^\"]+)\"', 1) as type, regexp_extract(block, '(?s)\">\\s*(.*?)\\s*</action>', 1) as body from b"
)
def action_blocks(spark, d):
    return session.actions(values(spark, "seq, content", f"(1, {ACT})"))


BLOCK_ROWS = [
    (1, [("text", "hello", None, {}), ("tool_use", None, "Read", {"file_path": "a.py"}), ("thinking", "x", None, {})]),
    (2, [("tool_use", None, "Bash", {"command": "ls " * 60}), ("tool_use", None, "Edit", {}), ("tool_use", None, "Grep", {"file_path": "", "pattern": "p"})]),
    (3, [("tool_result", "r", None, {}), ("tool_use", None, "Task", {}), ("text", "end", None, {})]),
]


def _block_sql() -> str:
    rows = []
    for seq, blocks in BLOCK_ROWS:
        for pos, (kind, text, name, given) in enumerate(blocks):
            cells = [str(seq), str(pos), *("null" if x is None else f"'{x}'" for x in (kind, text, name, *(given.get(k) for k in ("file_path", "pattern", "path", "command"))))]
            rows.append(f"({', '.join(cells)})")
    return ", ".join(rows)


@query(
    f"with b(seq, pos, kind, body, name, f, p, q, c) as (values {_block_sql()}), t as (select seq, pos, case when kind = 'text' then coalesce(body, '') when kind = 'tool_use' then case when name in ('Read', 'Glob', 'Grep') then '[' || name || ': ' || coalesce(nullif(f, ''), nullif(p, ''), q, '') || ']' "
    "when name in ('Edit', 'Write') then '[' || name || ': ' || coalesce(f, '?') || ']' when name = 'Bash' then '[Bash: ' || substr(coalesce(c, ''), 1, 100) || ']' else '[' || coalesce(name, '?') || ']' end end as x from b) "
    "select seq, string_agg(x, chr(10) order by pos) as content from t where x is not null group by seq"
)
def block_text(spark, d):
    def lit(v):
        return F.lit(v).cast("string")

    def block(kind, text, name, given):
        return F.struct(lit(kind).alias("type"), lit(text).alias("text"), lit(name).alias("name"), (F.create_map(*[F.lit(x) for kv in given.items() for x in kv]) if given else F.create_map().cast("map<string,string>")).alias("input"), lit(None).alias("content"))

    rows = F.array(*[F.struct(F.lit(seq).alias("seq"), F.array(*[block(*b) for b in blocks]).alias("blocks")) for seq, blocks in BLOCK_ROWS])
    return spark.range(1).select(F.inline(rows)).select("seq", extract.block_text(F.col("blocks")).alias("content"))


_ASKED = f"[{', '.join(map(str, HashEmbedder().embed([QUERY])[0]))}]::double[]"


@query(
    f"with s as (select vec_id as seq, round({COSINE.format(a='embedding', b=_ASKED)}, 6) as score from embeddings order by score desc, seq limit 30), k as ({KEYWORD}), "
    "f as (select seq, coalesce(s.score, 0) + coalesce(k.score, 0) * case when s.seq is not null then 0.4 else 0.3 end as score from s full join k using (seq)), "
    "t as (select seq, round(score * 1.5, 6) as score, '[' || seq || ' ' || coalesce(source, '?') || '  context] ' || coalesce(text, '') as chunk from f join documents on doc_id = seq), "
    "r as (select *, length(chunk) // 4 as tokens, sum(length(chunk) // 4) over (order by score desc, seq rows unbounded preceding) as running from t) "
    "select seq, score, tokens, running::bigint as running, chunk from r where running <= 6000"
)
def retrieve(spark, d):
    """The whole facade, with hashed vectors standing in for a model's."""
    docs = C.documents(spark, d)
    vectors = C.table(spark, d, "embeddings").withColumnRenamed("vec_id", "seq").select("seq", "embedding")
    return Retriever(docs, vectors, embedder=HashEmbedder()).retrieve(QUERY, 6000, as_of()).select("seq", "score", "tokens", "running", "chunk")


# ---- sessions --------------------------------------------------------------------------------------------

CONV = "select conv_id as thread, turn as seq, role, text as content, sum((role = 'user')::int) over (partition by conv_id order by turn rows unbounded preceding)::bigint as turn from conversations"


def _turns(spark, d):
    return session.turns(C.conversations(spark, d))


@query(f"select thread, seq, role, turn from ({CONV})")
def turn_numbering(spark, d):
    return _turns(spark, d).select("thread", "seq", "role", "turn")


@query(f"select thread, seq, sum(length(content) // 4 + 4) over (partition by thread order by seq desc rows unbounded preceding) <= 500 as in_tail from ({CONV})")
def tail_token_budget(spark, d):
    return session.tail_by_tokens(_turns(spark, d), 500).select("thread", "seq", "in_tail")


@query(f"select thread, seq, dense_rank() over (partition by thread order by turn desc) <= 2 as in_tail from ({CONV})")
def tail_last_turns(spark, d):
    return session.tail_by_turns(_turns(spark, d), 2).select("thread", "seq", "in_tail")


@query(
    f"with t as (select *, length(content) + 20 as own from ({CONV})) select thread, seq, sum(own) over (partition by thread) >= 3000 and sum(own) over (partition by thread order by seq desc rows unbounded preceding) - own < 3000 as in_tail from t"
)
def raw_tail_split(spark, d):
    return session.raw_tail(_turns(spark, d)).select("thread", "seq", "in_tail")


@query(
    f"with t as (select *, length(content) as n from ({CONV})), c as (select *, sum(n) over (partition by thread) as total, sum(n) over (partition by thread order by seq rows unbounded preceding) - n < 300 as h, "
    "sum(n) over (partition by thread order by seq desc rows unbounded preceding) - n < 1000 as l from t), "
    "g as (select *, bool_or(h and l) over (partition by thread) as meet, count(*) filter (where not h and not l) over (partition by thread) as gap from c) "
    "select thread, seq, role, content from g where total <= 2000 or meet or gap = 0 or h or l union all "
    "select thread, min(seq), 'user', '[... ' || count(*) || ' turns of iterative work omitted ...]' from g where not (total <= 2000 or meet or gap = 0) and not h and not l group by thread"
)
def truncate_middle(spark, d):
    return session.truncate_middle(_turns(spark, d), 2000)


_B = " or ".join("contains(c, '" + w.replace("'", "''") + "')" for w in X.BLOCK_FAILURE_WORDS)
_G = " or ".join("contains(c, '" + w.replace("'", "''") + "')" for w in X.BLOCK_SUCCESS_WORDS)


@query(
    f"with t as (select *, lower(substr(content, 1, 500)) as c, (row_number() over (partition by thread order by seq) - 1) // 3 as block from ({CONV})) "
    f"select thread, block, string_agg('[' || role || '] ' || substr(content, 1, 100), ' | ' order by seq) as summary, string_agg(seq::varchar, ',' order by seq) as refs, "
    f"list_aggregate(list_transform(list_sort(list_distinct(list(turn))), lambda x: x::varchar), 'string_agg', ',') as turns, case when bool_or({_B}) and not bool_or({_G}) then 'failure' when bool_or({_G}) and not bool_or({_B}) then 'success' else 'neutral' end as polarity from t group by thread, block"
)
def compress_blocks(spark, d):
    return session.compressed_blocks(_turns(spark, d), 3)


@query(f"select thread, seq, turn from ({CONV}) where turn > 1")
def uncompressed_entries(spark, d):
    t = _turns(spark, d)
    return session.uncompressed(t, t.where("turn <= 1").select("thread", "turn").distinct()).select("thread", "seq", "turn")


@query(
    f"with t as (select thread, seq, substr(sha256(thread || '|' || seq), 1, 12) as uuid, row_number() over (partition by thread order by seq) - 1 as k, count(*) over (partition by thread) as n from ({CONV})) "
    f"select thread, seq, uuid, lag(uuid) over (partition by thread order by seq) as parent_uuid, strftime(make_timestamp(epoch_us(timestamp '{AS_OF}') - 3600000000 + k * greatest(1000000, 3600000000 // greatest(n - 1, 1))), '%Y-%m-%dT%H:%M:%S.%gZ') as timestamp from t"
)
def transcript_projection(spark, d):
    return session.transcript(_turns(spark, d), as_of()).select("thread", "seq", "uuid", "parent_uuid", "timestamp")


@query(
    f"with t as (select *, sum(length(content) // 4 + 4) over (partition by thread order by seq desc rows unbounded preceding) <= 500 as tail from ({CONV})), "
    "u as (select thread, 1 as layer, 0::bigint as pos, '[' || count(*) || ' earlier entries]' as content from t where not tail group by thread union all select thread, 2, seq, content from t where tail union all select distinct thread, 3, 0, 'What next?' from t) "
    "select thread, layer, pos, content, length(content) // 4 + 4 as tokens from u"
)
def context_layers(spark, d):
    return session.layers(_turns(spark, d), 500, "What next?")


@query("select conv_id as thread, turn as seq, role from conversations where turn between 1 and 2 union all select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations) where r = 1 and turn > 2")
def log_lookup(spark, d):
    c = C.conversations(spark, d)
    last = c.groupBy("thread").agg(F.max_by(F.struct("seq", "role"), "seq").alias("r")).select("thread", "r.seq", "r.role").where("seq > 2")
    return c.where("seq between 1 and 2").select("thread", "seq", "role").unionByName(last)


@query(
    f"with t as (select *, lower(substr(content, 1, 500)) as c, (row_number() over (partition by thread order by seq) - 1) // 3 as block from ({CONV})), "
    f"b as (select thread, block, string_agg('[' || role || '] ' || substr(content, 1, 100), ' | ' order by seq) as summary, list(seq::varchar order by seq) as refs, case when bool_or({_B}) and not bool_or({_G}) then '[FAILED APPROACH] ' when bool_or({_G}) and not bool_or({_B}) then '[CONFIRMED] ' else '' end as p from t group by thread, block) "
    "select thread, block, p || summary || chr(10) || '[refs: ' || array_to_string(refs[1:6], ', ') || case when len(refs) > 6 then ' (+' || (len(refs) - 6) || ' more)' else '' end || ']' as content from b"
)
def history_messages(spark, d):
    return session.rendered_blocks(session.compressed_blocks(_turns(spark, d), 3))


@query()
def paragraph_groups(spark, d):
    return session.paragraphs(C.documents(spark, d))


@query("select conv_id as thread, sum(length(text) // 4 + 4)::bigint as tokens, count(*) as messages, round(count(*) filter (where role = 'user') / nullif(count(*) filter (where role in ('user', 'assistant')), 0), 6) as user_share from conversations group by conv_id")
def token_totals(spark, d):
    c = C.conversations(spark, d)
    share = F.count_if(F.col("role") == "user") / F.nullif(F.count_if(F.col("role").isin("user", "assistant")), F.lit(0))
    return c.groupBy("thread").agg(F.sum(X.tokens(F.col("content")) + 4).alias("tokens"), F.count("*").alias("messages"), F.round(share, 6).alias("user_share"))


@query("select user_id::varchar as thread, arg_min(event_id, (ts, event_id)) as first_seq, arg_max(event_id, (ts, event_id)) as last_seq from events group by user_id")
def thread_bounds(spark, d):
    key = F.struct("ts", "seq")
    return C.events(spark, d).groupBy("thread").agg(F.min_by("seq", key).alias("first_seq"), F.max_by("seq", key).alias("last_seq"))


@query("select conv_id * 3 + turn as member, count(*) as n from conversations where conv_id * 3 + turn in (select doc_id from documents) group by all")
def known_members(spark, d):
    members = C.table(spark, d, "conversations").select((F.col("conv_id") * 3 + F.col("turn")).alias("member"))
    return members.join(C.documents(spark, d).select(F.col("seq").alias("member")), "member", "left_semi").groupBy("member").agg(F.count("*").alias("n"))


# ---- mining ----------------------------------------------------------------------------------------------


@query("select count(*) as total, count(l.doc_id) as labelled, count(*) - count(l.doc_id) as unlabelled from documents d left join (select distinct doc_id from labels) l using (doc_id)")
def corpus_stats(spark, d):
    docs = C.table(spark, d, "documents").select("doc_id")
    return docs.join(C.table(spark, d, "labels").select("doc_id", F.lit(1).alias("l")).distinct(), "doc_id", "left").agg(F.count("*").alias("total"), F.count("l").alias("labelled"), (F.count("*") - F.count("l")).alias("unlabelled"))


@query("select source as thread, count(*) as n from documents where trim(text) <> '' and coalesce(source, '') <> '' group by source")
def project_counts(spark, d):
    return mining.project_counts(C.documents(spark, d).where(F.trim("content") != ""))


COVER = "select source as thread, count(*) as rows, count(l.doc_id) as chains, round(count(l.doc_id) / count(*), 6) as coverage from documents d left join (select distinct doc_id from labels) l using (doc_id) group by source"


def _labelled(spark, d):
    return C.table(spark, d, "labels").select(F.col("doc_id").alias("seq"))


@query(COVER)
def project_coverage(spark, d):
    return mining.coverage(C.documents(spark, d), _labelled(spark, d))


@query(f"select * from ({COVER}) order by coverage, thread limit 1")
def focus_project(spark, d):
    return mining.focus(mining.coverage(C.documents(spark, d), _labelled(spark, d)))


@query("with n as (select l.quality as chain, d.source as thread, count(*) as n from labels l join documents d using (doc_id) group by all) select chain, arg_min(thread, (-n, thread)) as primary_thread from n group by chain")
def primary_thread(spark, d):
    rows = C.table(spark, d, "labels").select("doc_id", F.col("quality").alias("chain")).join(C.table(spark, d, "documents").select("doc_id", F.col("source").alias("thread")), "doc_id")
    return mining.thread_mode(rows)


def _dated(spark, d):
    """Vectors dated by events that count through all of them."""
    v = C.table(spark, d, "embeddings").select(F.col("vec_id").alias("seq"), "embedding")
    e = C.table(spark, d, "events").select((F.col("event_id") % v.count()).alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    return e.join(v, "seq")


WEEKS = "with j as (select date_trunc('week', ts)::date as week, vec_id, embedding from events e join embeddings v on e.event_id % (select count(*) from embeddings) = v.vec_id), x as (select week, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as pos from j), c as (select week, pos, avg(x) as x from x group by all)"


@query(f"{WEEKS} select week, pos::int as pos, round(x, 6) as x from c")
def week_centroids(spark, d):
    c = V.centroids(_dated(spark, d).withColumn("week", mining.week(F.col("ts"))), ["week"], "embedding")
    return c.select("week", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


LINKS = f"{WEEKS}, v as (select week, list(x order by pos) as c from c group by week), l as (select a.week as week_a, b.week as week_b, (b.week - a.week)::int as days, round({COSINE.format(a='a.c', b='b.c')}, 3) as similarity from v a join v b on b.week - a.week >= 14)"


@query(f"{LINKS} select * from l where similarity >= 0.7")
def week_links(spark, d):
    return mining.week_links(_dated(spark, d))


@query(
    f"{LINKS}, w as (select * from l where similarity >= 0.7), r as (select distinct week, vec_id, embedding from j), "
    f"p as (select week_a, week_b, a.vec_id as seq_a, b.vec_id as seq_b, round({COSINE.format(a='a.embedding', b='b.embedding')}, 6) as cos from w join r a on a.week = week_a join r b on b.week = week_b where a.vec_id <> b.vec_id), "
    "k as (select *, row_number() over (partition by week_a, week_b order by cos desc, seq_a, seq_b) as place from p where cos > 0.3) select week_a, week_b, seq_a, seq_b, cos, place::int as place from k where place <= 3"
)
def temporal_links(spark, d):
    dated = _dated(spark, d)
    return mining.chunk_links(dated, mining.week_links(dated), 0.3)


def _entries(spark, d):
    return C.table(spark, d, "embeddings").join(C.table(spark, d, "documents"), F.col("vec_id") == F.col("doc_id")).select(F.col("vec_id").alias("seq"), F.col("source").alias("thread"), F.timestamp_seconds(F.lit(1704067200) + F.col("vec_id") * 21600).alias("ts"), F.lit("context").alias("role"), F.col("text").alias("content"), "embedding")


_W = "list_distinct(list_filter(string_split_regex(lower({c}), '\\s+'), lambda x: x <> ''))"


@query(
    "with r as (select vec_id as seq, source as thread, vec_id * 0.25 as day, text as content, embedding from embeddings join documents on vec_id = doc_id), s as (select * from r where seq % 100 = 0), "
    f"p as (select s.seq as seed_seq, r.seq, round({COSINE.format(a='r.embedding', b='s.embedding')}, 6) as cos, r.thread = s.thread as same, r.content as body, abs(r.day - s.day) as days, {_W.format(c='r.content')} as a, {_W.format(c='s.content')} as b from r, s), "
    "n as (select *, row_number() over (partition by seed_seq order by cos desc, seq) as k from p), "
    f"m as (select * from n where k <= 24 and {_T.replace('content', 'coalesce(body, chr(32))')} <> ''), "
    "c as (select seed_seq, seq, cos, round(0.5 * cos + case when same then 0.15 else 0 end + case when days < 1 then 0.2 when days < 7 then 0.1 else 0 end + 0.15 * (len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))), 6) as score from m), "
    "t as (select *, row_number() over (partition by seed_seq order by score desc, seq) as place from c) select seed_seq, seq, cos, score, place::int as place from t where place <= 8"
)
def cluster_members(spark, d):
    rows = _entries(spark, d)
    return mining.clusters(rows, rows.where("seq % 100 = 0"))


SEED_TIME = "2024-01-08 12:00:00"


def _seed_rows(spark, d):
    """Documents as entries: Spanish ones stand for chains, ten minutes lie between two."""
    return C.table(spark, d, "documents").select(
        F.col("doc_id").alias("seq"), F.when(F.col("lang") == "es", "chain").otherwise("context").alias("role"), F.col("source").alias("thread"), F.col("text").alias("content"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 600).alias("ts")
    )


@query(
    f"with f as (select d.doc_id as seq, coalesce(text, '') as content, source as thread, case when lang = 'es' then 'chain' else 'context' end as role, l.doc_id is not null as held, make_timestamp((1704067200 + d.doc_id * 600) * 1000000) as ts from documents d left join (select distinct doc_id from labels) l using (doc_id)), "
    f"g as (select *, case when role = 'chain' then 1 when thread = 'src3' then 0 when held then 4 when ts >= timestamp '{SEED_TIME}' - interval 7 day then 2 else 3 end as band from f where not (role not in ('kernel', 'chain') and ({_T} = '' or {_BR} or {_FI} or {_RE} or {_EM}))), "
    "t as (select *, row_number() over (partition by band order by md5(seq::varchar), seq) as turn from g) "
    "select seq, thread, band, [2.5, 2.0, 1.5, 1.0, 0.5][band + 1]::double as priority, turn::int as turn, row_number() over (order by [0, 1, 1, 1, 2][band + 1], turn, band, seq)::int as place from t where turn <= 1000 qualify place <= 1000"
)
def seed_pool(spark, d):
    return mining.seeds(_seed_rows(spark, d), _labelled(spark, d), "src3", 1000, F.lit(SEED_TIME).cast("timestamp"))


CHAINS = "select distinct l_orderkey as chain, l_partkey as member from lineitem"


def _chains(spark, d):
    return C.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chain"), F.col("l_partkey").alias("member"))


@query(
    f"with m as ({CHAINS}), n as (select chain, count(*) as n from m group by chain), o as (select x.chain as a, y.chain as b, count(*) as k from m x join m y on x.member = y.member and x.chain < y.chain group by all) "
    "select a, b, round(k / (p.n + q.n - k), 6) as jaccard from o join n p on p.chain = a join n q on q.chain = b where k / (p.n + q.n - k) > 0.5"
)
def chain_dedup_pairs(spark, d):
    return mining.overlapping_chains(_chains(spark, d))


@query(f"with m as ({CHAINS}) select member, 'c' || chain as ref from m union select x.member, 'm' || y.member from m x join m y on x.chain = y.chain and x.member <> y.member")
def xrefs(spark, d):
    return mining.xrefs(_chains(spark, d))


@query(
    "with c as (select conv_id as chain, turn as pos, conv_id * 3 + turn as member from conversations), j as (select c.*, d.source, substr(d.text, 1, 40) as head from c left join documents d on d.doc_id = c.member) "
    "select chain, string_agg(member || ':' || coalesce(source, '') || ':' || coalesce(head, ''), '|' order by pos) as members, count(distinct source) as threads from j group by chain"
)
def report_chains(spark, d):
    chains = C.table(spark, d, "conversations").select(F.col("conv_id").alias("chain"), F.col("turn").alias("pos"), (F.col("conv_id") * 3 + F.col("turn")).alias("member"))
    return mining.report(chains, C.documents(spark, d))


KERNELS = [("k1", "orphan", 7, ["c2", "zz", "c1"]), ("k2", "pattern", 0, ["c1"]), ("k3", None, 9, []), ("k4", "other", 1, ["c1"]), ("k5", "orphan", None, ["zz"]), ("k6", "question", 5, ["c2", "c2"])]
ORDER = str(list(mining.SECTIONS))


def _kernel_sql() -> str:
    say = lambda v: "null" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::varchar[]" if isinstance(v, list) else str(v)
    return ", ".join(f"({', '.join(map(say, k))})" for k in KERNELS)


@query(
    f"with k(kernel, kind, importance, refs) as (values {_kernel_sql()}), c(chain) as (values ('c1'), ('c2')), n as (select kernel, coalesce(kind, 'pattern') as kind, coalesce(nullif(importance, 0), 5) as importance, refs from k), "
    "e as (select kernel, unnest(refs) as chain, generate_subscripts(refs, 1) as pos from k), m as (select kernel, string_agg(chain, ',' order by pos) as chains from e join c using (chain) group by kernel) "
    f"select kernel, kind, importance, coalesce(chains, '') as chains, row_number() over (order by list_position({ORDER}, kind), importance desc, kernel)::int as place from n left join m using (kernel) where list_contains({ORDER}, kind)"
)
def kernel_drilldown(spark, d):
    kernels = spark.createDataFrame(KERNELS, "kernel string, kind string, importance int, refs array<string>")
    return mining.kernels_shown(kernels, values(spark, "chain", "('c1'), ('c2')"))


@query(
    "with g as (select user_id, ts, coalesce((ts - lag(ts) over (partition by user_id order by ts) >= interval 15 minute)::int, 1) as new from events), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g) "
    "select user_id::varchar as thread, epoch_us(min(ts)) as start_us, count(*) as n from s group by user_id, k"
)
def idle_sessions(spark, d):
    return log.sessions(C.events(spark, d)).select("thread", F.unix_micros("start").alias("start_us"), "n")


# ---- ingest and sources ----------------------------------------------------------------------------------


def _log_lines(spark, d):
    """Conversations as lines of session files, with a blank and a broken line in each."""
    c = C.table(spark, d, "conversations")
    path = F.concat(F.lit("/logs/-home-u-projects-p"), F.col("conv_id").cast("string"), F.lit("/s.jsonl"))
    value = F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", F.col("text").alias("content")).alias("message"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("sessionId")))
    rows = c.select(path.alias("path"), (F.col("turn") * 2).cast("long").alias("line"), value.alias("value"))
    return rows.unionByName(c.select(path.alias("path"), (F.col("turn") * 2 + 1).cast("long").alias("line"), F.when(F.col("turn") % 2 == 0, "").otherwise("{broken").alias("value")))


_SAID = "select conv_id, turn * 2 as seq, role, text as content, sum((role = 'user')::int) over (partition by conv_id order by turn rows unbounded preceding)::bigint as turn from conversations where role in ('user', 'assistant')"


@query(f"select 'p' || conv_id as thread, seq, role, content, turn, 's' || conv_id as source_session from ({_SAID}) where not {INGEST}")
def session_ingest(spark, d):
    return C.session_entries(_log_lines(spark, d)).select("thread", "seq", "role", "content", "turn", "source_session")


@query(f"select conv_id, seq, role, content from ({_SAID}) where {_T} <> '' and (role = 'user' or not starts_with(content, '['))")
def conversation_turns(spark, d):
    return C.conversation_turns(_log_lines(spark, d)).select(F.regexp_extract("path", "-p(\\d+)/", 1).cast("long").alias("conv_id"), "seq", "role", "content")


@query("with l as (select conv_id, turn * 2 as line from conversations union all select conv_id, turn * 2 + 1 from conversations) select conv_id, count(*) as lines, min(line) as first from l where line >= 3 group by conv_id")
def incremental_read(spark, d):
    lines = _log_lines(spark, d)
    new = C.new_lines(lines, lines.groupBy("path").agg(F.lit(3).cast("long").alias("n")))
    return new.groupBy(F.regexp_extract("path", "-p(\\d+)/", 1).cast("long").alias("conv_id")).agg(F.count("*").alias("lines"), F.min("line").alias("first"))


PATHS = "('/x/-home-u-projects-bridge/a.jsonl'), ('/x/-home-u-projects/a.jsonl'), ('/x/-home-u-project-a-b/a.jsonl'), ('/x/-home-u---fence/a.jsonl'), ('/x/-home-u--/a.jsonl'), ('/x/other/a.jsonl')"


@query(
    f"with p(path) as (values {PATHS}), f as (select path, regexp_extract(path, '([^/]*)/[^/]*$', 1) as g from p) select path, case when regexp_matches(g, '^-home-[a-z]+-projects?') then coalesce(nullif(replace(regexp_extract(g, '^-home-[a-z]+-projects?-?(.*)$', 1), '-', '/'), ''), 'home') "
    "else coalesce(nullif(replace(regexp_extract(g, '^-home-[a-z]+---?(.*)$', 1), '-', '/'), ''), 'unknown') end as project, '-' || ltrim(replace(path, '/', '-'), '-') as folder from f"
)
def project_paths(spark, d):
    return values(spark, "path", PATHS).select("path", extract.project_of(F.col("path")).alias("project"), C.mangled(F.col("path")).alias("folder"))


NOISE = ["a/b.py", "0a1b2c3d-4e5f.js", "x/2024-01-02T10.log", "d/0123456789abcdef.py", "./../q.py", "/tmp/z.md", "a/screenshots/p.md", "n" * 118 + ".py", "n" * 117 + ".py", "plain_name"]


@query(
    f"with t(s) as (values {', '.join(f'({n!r})' for n in NOISE)}) select s, regexp_matches(s, '[0-9a-f]{{8}}-[0-9a-f]{{4}}') or regexp_matches(s, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}') or regexp_matches(regexp_extract(s, '([^/]*)$', 1), '^[0-9a-f]{{10,}}[.]') "
    "or starts_with(s, './..') or contains(s, '/tmp/') or contains(s, '/screenshots/') or length(s) > 120 as noise from t"
)
def identifier_noise(spark, d):
    return values(spark, "s", ", ".join(f"('{n}')" for n in NOISE)).select("s", identify.noise(F.col("s")).alias("noise"))


@query(
    "select * from (values (1, 'bridge/web_server.py'), (1, '/home/a/x.js'), (1, 'load_all'), (1, 'other_name'), (2, 'FooBar'), (2, 'tool.py'), (2, 'n.py'), (4, 'snake_case_name')) t(seq, identifier)"
)
def identifier_examples(spark, d):
    """The names that the worked examples hold."""
    found = identify.extracted(values(spark, "seq, content", IDS))
    wanted = values(spark, "seq, identifier", "(1, 'bridge/web_server.py'), (1, '/home/a/x.js'), (1, 'load_all'), (1, 'other_name'), (2, 'FooBar'), (2, 'tool.py'), (2, 'n.py'), (4, 'snake_case_name'), (2, '/tmp/z.md'), (4, 'is_ok')")
    return found.join(wanted, ["seq", "identifier"], "left_semi")


@query(
    f"with k(known) as (values {KNOWN}), r(raw) as (values {RAW}), p as (select raw, known, case when lower(raw) = lower(known) then 1.0 when {_TS.format(c='raw')} = {_TS.format(c='known')} then 0.95 "
    "when contains(lower(known), lower(raw)) and length(raw) / length(known) >= 0.6 then 0.6 when contains(lower(raw), lower(known)) and length(known) / length(raw) >= 0.6 then 0.6 end as score from r, k) "
    "select distinct known from p where score >= 0.55 and known not in (select raw from p where score >= 0.55)"
)
def identifier_new_names(spark, d):
    return identify.added_names(identify.resolved_native(values(spark, "raw", RAW), values(spark, "known", KNOWN)))


@query("select 3 as files, 3 as definitions")
def chunk_counts(spark, d):
    return chunking.chunk_counts(code_chunks(spark, d)).select(F.col("files").cast("int").alias("files"), F.col("definitions").cast("int").alias("definitions"))


ANSWERS = [(1, '[{"role": "user", "content": "x"}]'), (2, 'so: [{"role": "a", "content": "y"}, {"role": "b", "content": "z"}] ok'), (3, "none"), (4, '[{"content": "z"}]'), (5, '```json\n[1, 2]\n```')]


@query("select * from (values (1, 'user', 'x', 1), (2, 'a', 'y', 2), (3, null, null, null), (4, null, null, null), (5, null, null, null)) t(seq, role, content, n)")
def answer_turns(spark, d):
    t = extract.json_turns(F.col("a"))
    return spark.createDataFrame(ANSWERS, "seq int, a string").select("seq", t[0]["role"].alias("role"), t[0]["content"].alias("content"), F.when(t.isNotNull(), F.size(t)).alias("n"))


@query("select * from (values (1, 'hi  and  bye'), (2, 'plain')) t(seq, content)")
def stripped_actions(spark, d):
    return values(spark, "seq, content", f"(1, {ACT}), (2, ' plain ')").select("seq", session.without_actions(F.col("content")).alias("content"))


RESULTS = [(1, [("text", "hello", None, {}, None), ("tool_use", None, "Read", {"file_path": "a.py"}, None), ("tool_result", None, None, {}, "r" * 300)]), (2, [("thinking", "x", None, {}, None), ("tool_use", None, None, {}, None)])]


@query("select * from (values (1, 'hello' || chr(10) || '[Read: {\"file_path\":\"a.py\"}]' || chr(10) || '[result: ' || repeat('r', 200) || ']'), (2, '[?: {}]')) t(seq, content)")
def transcript_text(spark, d):
    rows = spark.createDataFrame([(seq, [dict(zip(("type", "text", "name", "input", "content"), b, strict=True)) for b in blocks]) for seq, blocks in RESULTS], f"seq int, blocks {extract.BLOCKS}")
    return rows.select("seq", extract.transcript_text(F.col("blocks")).alias("content"))


TIMES = "('2024-01-02T03:04:05Z'), ('2024-01-02T03:04:05.678901+02:00'), ('2024-01-02T03:04:05.1-05:30'), ('none'), (null)"


@query("select * from (values ('2024-01-02T03:04:05Z', '2024-01-02T03:04:05.000Z'), ('2024-01-02T03:04:05.678901+02:00', '2024-01-02T01:04:05.678Z'), ('2024-01-02T03:04:05.1-05:30', '2024-01-02T08:34:05.100Z'), ('none', null), (null, null)) t(ts, shown)")
def iso_times(spark, d):
    return values(spark, "ts", TIMES).select("ts", session.shown_time(F.unix_micros(session.parsed_time(F.col("ts")))).alias("shown"))


# ---- further axes, logs, compression, transcripts --------------------------------------------------------


def _vector_sql(text: str) -> str:
    return f"{HashEmbedder().embed([text])[0]}::double[]"


def _suffixed(axis: str) -> str:
    return f"select vec_id as seq, round({COSINE.format(a='embedding', b=_vector_sql(QUERY + SUFFIX[axis]))}, 6) as score from embeddings order by score desc, seq limit 20"


def _axis(spark, d, axis: str, **how):
    vectors = C.table(spark, d, "embeddings").withColumnRenamed("vec_id", "seq").select("seq", "embedding")
    return Retriever(C.events(spark, d), vectors, embedder=HashEmbedder()).axis(R.Axis(axis, **how), QUERY)


@query(_suffixed("anti_pattern"))
def anti_pattern_axis(spark, d):
    return _axis(spark, d, "anti_pattern")


@query(_suffixed("causal"))
def causal_axis(spark, d):
    return _axis(spark, d, "causal")


_EC = "lower(substr(concat_ws(' ', event_type, props), 1, 500))"


@query(f"with t as (select event_id, ts, {_EC} as c from events) select event_id as seq, 0.8::double as score from t where ({_B}) and not ({_G}) order by ts desc nulls last, event_id limit 20")
def polarity_axis(spark, d):
    return _axis(spark, d, "polarity", filter="failure")


@query(f"with k as ({KEYWORD}), e as (select vec_id as seq, 0.5::double as score from embeddings where vec_id < 0), u as (select seq, score * 0.3 as score from k) select u.seq, round(u.score, 6) as score from u join documents d on d.doc_id = u.seq where contains(lower(d.source), 'src1')")
def filtered_project(spark, d):
    docs = C.documents(spark, d)
    fused = R.fuse([], R.keyword(docs, QUERY).withColumn("score", F.round("score", 6)))
    return R.filtered(docs.join(fused, "seq"), role="CONTEXT", project="SRC1").select("seq", F.round("score", 6).alias("score"))


@query("select event_id as seq, user_id::varchar as thread from events order by event_id desc limit 25")
def log_last(spark, d):
    return session.lookup(C.events(spark, d), last=25).select("seq", "thread")


@query(f"select thread, seq, turn from ({CONV}) where turn between 2 and 3")
def log_turns(spark, d):
    return session.lookup(_turns(spark, d), turns=(2, 3)).select("thread", "seq", "turn")


@query(f"select thread, seq from ({CONV}) where thread = 3 and (thread || '-' || seq) in ('3-1', '3-0', '4-1')")
def log_uids(spark, d):
    log = _turns(spark, d).withColumn("uid", F.concat_ws("-", "thread", "seq"))
    return session.lookup(log, thread=3, uids=["3-1", "3-0", "4-1"]).select("thread", "seq")


@query(f"select thread, max(turn) as turn from ({CONV}) group by thread")
def log_resume(spark, d):
    return session.last_turn(_turns(spark, d))


@query(f"with r as (select *, row_number() over (partition by thread order by seq desc) as r from ({CONV})) select thread, string_agg('[' || role || '] ' || substr(content, 1, 300), chr(10) order by seq) as tail from r where r <= 3 group by thread")
def conversation_tail(spark, d):
    return session.conversation_tail(_turns(spark, d), 3)


_STEP = (
    f"w as (select *, count(*) over (partition by thread) as n from ({CONV})), left_(thread, seq, role, content, turn) as (select thread, seq, role, content, turn from w where n >= 6 and turn > 1), l as (select *, count(*) over (partition by thread) as n from left_), "
    "o as (select *, sum(length(content) // 4 + 4) over (partition by thread order by seq desc rows unbounded preceding) > 100 as old from l where n >= 6), "
    "t as (select *, lower(substr(content, 1, 500)) as c, (row_number() over (partition by thread order by seq) - 1) // 10 as block from o where old)"
)


@query(f"with {_STEP} select thread, block, string_agg(seq::varchar, ',' order by seq) as refs, count(*) as n from t group by thread, block")
def compression_step(spark, d):
    log = _turns(spark, d)
    blocks = session.compression_step(log, log.where("turn <= 1"), 100)
    return blocks.select("thread", "block", "refs", F.size(F.split("refs", ",")).cast("long").alias("n"))


_HISTORY = (
    f"t as (select *, lower(substr(content, 1, 500)) as c, (row_number() over (partition by thread order by seq) - 1) // 3 as block from ({CONV}) where turn <= 2), "
    f"b as (select thread, block, string_agg('[' || role || '] ' || substr(content, 1, 100), ' | ' order by seq) as summary, list(seq::varchar order by seq) as refs, case when bool_or({_B}) and not bool_or({_G}) then '[FAILED APPROACH] ' when bool_or({_G}) and not bool_or({_B}) then '[CONFIRMED] ' else '' end as p from t group by thread, block), "
    "m as (select thread, block, p || summary || chr(10) || '[refs: ' || array_to_string(refs[1:6], ', ') || case when len(refs) > 6 then ' (+' || (len(refs) - 6) || ' more)' else '' end || ']' as content from b)"
)
_WITHIN = f"{_HISTORY}, h as (select *, sum(length(content) // 4 + 4) over (partition by thread order by block desc rows unbounded preceding) as running from m)"


def _blocks(spark, d):
    return session.compressed_blocks(_turns(spark, d).where("turn <= 2"), 3)


@query(f"with {_WITHIN} select thread, block, content from h where running <= 120")
def history_budget(spark, d):
    return session.history_within(session.rendered_blocks(_blocks(spark, d)), 120).select("thread", "block", "content")


@query(
    f"with {_WITHIN}, k as (select * from h where running <= 120), c as (select *, sum(length(content) // 4 + 4) over (partition by thread order by seq desc rows unbounded preceding) as running from ({CONV}) where turn > 2), "
    "u as (select distinct thread, 4 as layer, 0 as pos, 'user' as role, 'What next?' as content from (select conv_id as thread from conversations) union all select distinct thread, 2, -1, 'user', '<compressed_history>The following are summaries of earlier parts of our conversation:</compressed_history>' from k "
    "union all select thread, 2, block, 'user', content from k union all select thread, 3, seq, role, content from c where running <= 300) select thread, layer, pos::bigint as pos, role, content from u"
)
def context_messages(spark, d):
    return session.assembled(_turns(spark, d), _blocks(spark, d), "What next?", 300, 120)


_BASE = f"epoch_us(timestamp '{AS_OF}')"


@query(
    f"with c as (select *, sum(length(content) // 4 + 50) over (partition by thread order by seq desc rows unbounded preceding) <= 300 as tail from ({CONV})), "
    "i as (select thread, 1 as zone, 1 as part, x as spot, case x when 0 then 'user' else 'assistant' end as role, case x when 0 then 'Who are you?' else 'I am here.' end as content from (select distinct conv_id as thread from conversations), (values (0), (1)) v(x)), "
    "a as (select * from i union all select thread, case when tail then 3 else 2 end, case when tail then 5 else 4 end, seq, case when role = 'user' then 'user' else 'assistant' end, content from c), "
    "n as (select *, row_number() over (partition by thread, zone order by part, spot) - 1 as k, count(*) over (partition by thread, zone) as n, row_number() over (partition by thread order by part, spot) - 1 as pos from a) "
    f"select thread, pos, zone, role, content, strftime(make_timestamp({_BASE} + case zone when 1 then (k - 60) * 1000000 when 2 then k * case when n > 1 then greatest(1000000, 3600000000 // (n - 1)) else 1000000 end else (7200 + k) * 1000000 end), '%Y-%m-%dT%H:%M:%S.%gZ') as timestamp from n"
)
def transcript_zones(spark, d):
    return session.transcript_sections(_turns(spark, d), 300, as_of(), identity="I am here.").select("thread", "pos", "zone", "role", "content", "timestamp")


# ---- further mining --------------------------------------------------------------------------------------


@query(f"with m as ({CHAINS}), e as (select member, 'c' || chain as ref from m union select x.member, 'm' || y.member from m x join m y on x.chain = y.chain and x.member <> y.member) select member, string_agg(ref, ',' order by ref) as refs from e group by member")
def xref_lists(spark, d):
    return mining.xref_sets(mining.xrefs(_chains(spark, d))).select("member", F.array_join("refs", ",").alias("refs"))


def _chain_rows(spark, d):
    """Conversations as chains over documents, typed by their number."""
    c = C.table(spark, d, "conversations").select(F.col("conv_id").alias("chain"), (F.col("conv_id") * 3 + F.col("turn")).alias("member"))
    docs = C.table(spark, d, "documents").select(F.col("doc_id").alias("member"), "source")
    rows = c.join(docs, "member", "left").groupBy("chain").agg(F.array_sort(F.collect_set(F.col("member").cast("string"))).alias("member_uids"), F.array_sort(F.collect_set("source")).alias("member_projects"))
    kind = F.element_at(F.array(*map(F.lit, ("thematic", "causal", "correction", "orphan", "temporal"))), (F.col("chain") % 5 + 1).cast("int"))
    return rows.select("chain", kind.alias("chain_type"), (F.size("member_projects") > 1).alias("cross_project"), F.concat(F.lit("about "), F.col("chain").cast("string")).alias("content"), "member_uids", "member_projects")


_CHAIN_ROWS = "m as (select conv_id as chain, conv_id * 3 + turn as member from conversations), r as (select chain, count(distinct member) as n, list_sort(list_distinct(list(source) filter (where source is not null))) as projects from m left join documents on doc_id = member group by chain), k as (select *, ['thematic', 'causal', 'correction', 'orphan', 'temporal'][(chain % 5 + 1)::int] as kind from r)"


@query(f"with {_CHAIN_ROWS}, p as (select chain, unnest(projects) as thread from k) select thread, count(*) as chains from p where thread <> '' group by thread")
def project_chains(spark, d):
    return mining.project_chains(_chain_rows(spark, d))


@query(f"with {_CHAIN_ROWS} select kind as bucket, chain from k where kind <> 'temporal' union all select 'cross_project', chain from k where len(projects) > 1 union all select 'unfinished', chain from k where kind = 'orphan'")
def report_buckets(spark, d):
    return mining.chains_by_type(_chain_rows(spark, d))


@query(f"with {_CHAIN_ROWS} select chain, '[' || chain || '] (' || kind || ') about ' || chain || ' [' || n || ' members, projects: ' || array_to_string(list_filter(projects, lambda p: p <> ''), ', ') || ']' as line from k")
def synthesis_lines(spark, d):
    return mining.synthesis_lines(_chain_rows(spark, d))


@query(f"with {_CHAIN_ROWS}, p as (select unnest(projects) as thread from k) select count(distinct thread) as projects from p where thread <> ''")
def synthesis_projects(spark, d):
    return mining.project_total(_chain_rows(spark, d))


_MINED = f"{_T} = '' or {_BR} or {_FI} or {_RE} or {_EM}".replace("content", "coalesce(dd.text, chr(32))")
_LINKED = SQL["temporal_links"].replace("= v.vec_id)", f"= v.vec_id join documents dd on dd.doc_id = v.vec_id where not ({_MINED}))", 1)


@query(
    f"with l as ({_LINKED}), o as (select *, row_number() over (partition by least(seq_a, seq_b), greatest(seq_a, seq_b) order by week_a, week_b, cos desc) as r from l), h as (select * from o where r = 1) "
    "select seq_a || ',' || seq_b as members, 'temporal: ' || week_a || ' ↔ ' || week_b as heading, (week_b - week_a)::int as days, round(cos, 3) as similarity, x.source <> y.source as cross_project, 'Temporal link (' || (week_b - week_a) || 'd): ' || substr(x.text, 1, 80) || ' ↔ ' || substr(y.text, 1, 80) as content "
    "from h join documents x on x.doc_id = seq_a join documents y on y.doc_id = seq_b"
)
def temporal_chains(spark, d):
    docs = C.documents(spark, d).select("seq", "role", "content", "thread")
    dated = mining.minable(_dated(spark, d).join(docs, "seq"))
    weeks = mining.week_links(dated)
    found = mining.temporal_chains(docs, mining.chunk_links(dated, weeks, 0.3), weeks)
    return found.select(F.array_join("member_uids", ",").alias("members"), "heading", F.col("temporal_distance_days").alias("days"), "similarity", "cross_project", "content")
