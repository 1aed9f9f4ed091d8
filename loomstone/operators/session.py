"""Session operators: tails, splits, truncation, batches, transcripts. All windows are partitioned by thread."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions import text as X

ACTION = r'(?s)<action\s+project="([^"]+)"\s+type="([^"]+)">\s*(.*?)\s*</action>'


def _backwards():
    return Window.partitionBy("thread").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)


def _forwards():
    return Window.partitionBy("thread").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)


def turns(df: DataFrame) -> DataFrame:
    """Number of user rows so far, which is the turn of every row."""
    return df.withColumn("turn", F.sum((F.col("role") == "user").cast("long")).over(_forwards()))


def tail_by_tokens(df: DataFrame, most: int, overhead: int = 4) -> DataFrame:
    """in_tail: the longest suffix of a thread whose tokens, with an overhead a row, stay within the budget."""
    cost = X.tokens(F.col("content")) + overhead
    return df.withColumn("tokens", cost).withColumn("in_tail", F.sum(cost).over(_backwards()) <= most)


def tail_by_turns(df: DataFrame, last: int) -> DataFrame:
    """in_tail: rows of the last distinct turns."""
    return df.withColumn("in_tail", F.dense_rank().over(Window.partitionBy("thread").orderBy(F.desc("turn"))) <= last)


def raw_tail(df: DataFrame, chars: int = 3000) -> DataFrame:
    """in_tail: rows from the end up to and with the one that crosses the limit; none in a thread below it."""
    own = F.coalesce(F.length("content"), F.lit(0)) + 20
    total = F.sum(own).over(Window.partitionBy("thread"))
    return df.withColumn("in_tail", (total >= chars) & (F.sum(own).over(_backwards()) - own < chars))


def truncate_middle(df: DataFrame, most: int) -> DataFrame:
    """Keep a thread's first 15 % and last 50 % of the limit, with a marker row between; short threads stay whole."""
    head, tail = int(most * 0.15), int(most * 0.5)
    n = F.length("content")
    w = Window.partitionBy("thread")
    t = df.withColumns({"__total": F.sum(n).over(w), "__from": F.sum(n).over(_forwards()) - n, "__to": F.sum(n).over(_backwards()) - n})
    t = t.withColumns({"__head": F.col("__from") < head, "__tail": F.col("__to") < tail})
    # rows of both halves: they overlap, and the thread stays as it is
    t = t.withColumn("__meet", F.max((F.col("__head") & F.col("__tail")).cast("int")).over(w) == 1)
    t = t.withColumn("__gap", F.sum((~F.col("__head") & ~F.col("__tail")).cast("long")).over(w))
    whole = (F.col("__total") <= most) | F.col("__meet") | (F.col("__gap") == 0)
    kept = t.where(whole | F.col("__head") | F.col("__tail")).select("thread", "seq", "role", "content")
    marks = t.where(~whole & ~F.col("__head") & ~F.col("__tail")).groupBy("thread").agg(F.min("seq").alias("seq"), F.count("*").alias("n"))
    return kept.unionByName(marks.select("thread", "seq", F.lit("user").alias("role"), F.format_string("[... %d turns of iterative work omitted ...]", "n").alias("content")))


def polarity(content: Column) -> tuple[Column, Column]:
    """(has failure words, has success words) in the first 500 characters."""
    text = F.lower(F.substring(content, 1, 500))
    return X.any_of(text, X.BLOCK_FAILURE_WORDS), X.any_of(text, X.BLOCK_SUCCESS_WORDS)


def compressed_blocks(df: DataFrame, size: int = 10) -> DataFrame:
    """Batches of consecutive rows of a thread as blocks: mechanical summary, references, polarity."""
    bad, good = polarity(F.col("content"))
    numbered = df.withColumn("block", F.floor((F.row_number().over(Window.partitionBy("thread").orderBy("seq")) - 1) / size).cast("long"))
    row = F.struct("seq", F.concat(F.lit("["), F.col("role"), F.lit("] "), F.substring("content", 1, 100)).alias("line"))
    g = numbered.groupBy("thread", "block").agg(
        F.array_sort(F.collect_list(row)).alias("rows"), F.array_sort(F.collect_set("turn")).alias("turns"), F.bool_or(bad).alias("bad"), F.bool_or(good).alias("good")
    )
    lines = F.transform("rows", lambda r: r["line"])
    return g.select(
        "thread",
        "block",
        F.array_join(lines, " | ").alias("summary"),
        F.array_join(F.transform("rows", lambda r: r["seq"].cast("string")), ",").alias("refs"),
        F.array_join(F.transform("turns", lambda t: t.cast("string")), ",").alias("turns"),
        F.when(F.col("bad") & ~F.col("good"), "failure").when(F.col("good") & ~F.col("bad"), "success").otherwise("neutral").alias("polarity"),
    )


def uncompressed(df: DataFrame, done: DataFrame) -> DataFrame:
    """Rows whose turn is in no compressed block yet."""
    return df.join(done, ["thread", "turn"], "left_anti")


def transcript(df: DataFrame, base: Column, zone: str = "even") -> DataFrame:
    """Rows with a parent link and times: a minute before base and a second each, spread evenly over a span of
    one hour before it ("even"), or two hours after it and a second each ("tail")."""
    w = Window.partitionBy("thread").orderBy("seq")
    k, n = F.row_number().over(w) - 1, F.count("*").over(Window.partitionBy("thread"))
    start = F.unix_micros(base)
    if zone == "head":
        at = start - 60_000_000 + k * 1_000_000
    elif zone == "tail":
        at = start + 7_200_000_000 + k * 1_000_000
    else:
        at = start - 3_600_000_000 + k * F.greatest(F.lit(1_000_000).cast("long"), F.floor(F.lit(3_600_000_000) / F.greatest(n - 1, F.lit(1)))).cast("long")
    uid = F.substring(F.sha2(F.concat_ws("|", "thread", "seq"), 256), 1, 12)
    return df.withColumn("uuid", uid).withColumns({"parent_uuid": F.lag("uuid").over(w), "timestamp": F.date_format(F.timestamp_micros(at), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")})


def layers(df: DataFrame, tail_tokens: int, question: str) -> DataFrame:
    """Assembled context of each thread: header, what lies before the tail as one block, the tail, the question."""
    t = tail_by_tokens(df, tail_tokens)
    old = t.where(~F.col("in_tail")).groupBy("thread").agg(F.count("*").alias("n"), F.sum(X.tokens(F.col("content"))).alias("tokens"))
    rows = [
        old.select("thread", F.lit(1).alias("layer"), F.lit(0).cast("long").alias("pos"), F.format_string("[%d earlier entries]", "n").alias("content")),
        t.where("in_tail").select("thread", F.lit(2).alias("layer"), F.col("seq").cast("long").alias("pos"), "content"),
        df.select("thread").distinct().select("thread", F.lit(3).alias("layer"), F.lit(0).cast("long").alias("pos"), F.lit(question).alias("content")),
    ]
    out = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return out.withColumn("tokens", X.tokens(F.col("content")) + 4)


def actions(df: DataFrame) -> DataFrame:
    """One row for each action block of a response: project, type, content."""
    each = F.regexp_extract_all("content", F.lit(ACTION), F.lit(0))
    one = df.select("seq", F.posexplode(each).alias("pos", "block"))
    return one.select("seq", "pos", *[F.trim(F.regexp_extract("block", ACTION, i)).alias(n) for i, n in ((1, "project"), (2, "type"), (3, "body"))])


def without_actions(content: Column) -> Column:
    return F.trim(F.regexp_replace(content, ACTION, ""))


def rendered_blocks(blocks: DataFrame) -> DataFrame:
    """Compressed blocks as messages: polarity, summary and up to six references."""
    refs = F.split("refs", ",")
    more = F.when(F.size(refs) > 6, F.format_string(" (+%d more)", F.size(refs) - 6)).otherwise("")
    prefix = F.when(F.col("polarity") == "failure", "[FAILED APPROACH] ").when(F.col("polarity") == "success", "[CONFIRMED] ").otherwise("")
    return blocks.select("thread", "block", F.concat(prefix, F.col("summary"), F.lit("\n[refs: "), F.array_join(F.slice(refs, 1, 6), ", "), more, F.lit("]")).alias("content"))


def paragraphs(df: DataFrame, least: int = 2000) -> DataFrame:
    """(seq, pos, content): lines gathered until they hold enough characters and a blank one comes.

    A fold over the lines' lengths finds the ends; lines are copied once, when a group is cut out.
    """
    lines = F.split("content", "\n")
    sized = F.transform(lines, lambda x: F.struct(F.length(x).alias("n"), (F.trim(x) == "").alias("blank")))
    start = F.struct(F.array().cast("array<int>").alias("ends"), F.lit(0).alias("n"), F.lit(0).alias("i"))

    def step(acc: Column, line: Column) -> Column:
        n = acc["n"] + line["n"]
        cut = (n >= least) & line["blank"]
        return F.struct(F.when(cut, F.concat(acc["ends"], F.array(acc["i"] + 1))).otherwise(acc["ends"]).alias("ends"), F.when(cut, F.lit(0)).otherwise(n).alias("n"), (acc["i"] + 1).alias("i"))

    ends = F.aggregate(sized, start, step, lambda a: F.array_distinct(F.concat(a["ends"], F.array(a["i"]))))
    found = df.select("seq", lines.alias("lines"), ends.alias("ends"))
    cut = F.transform("ends", lambda e, i: F.slice("lines", F.when(i == 0, 1).otherwise(F.get("ends", i - 1) + 1), e - F.when(i == 0, 0).otherwise(F.get("ends", i - 1))))
    return found.select("seq", F.posexplode(cut).alias("pos", "g")).select("seq", "pos", F.array_join("g", "\n").alias("content"))


# ---- log lookups -----------------------------------------------------------------------------------------


def lookup(log: DataFrame, thread: str | None = None, uid: str | None = None, uids: list[str] | None = None, turns: tuple[int, int] | None = None, last: int | None = None) -> DataFrame:
    """Entries by thread, id, ids (in the log's order, not theirs), range of turns (both ends within) or the last n."""
    if thread is not None:
        log = log.where(F.col("thread") == thread)
    if uid is not None:
        log = log.where(F.col("uid") == uid)
    if uids is not None:
        log = log.where(F.col("uid").isin(uids))
    if turns is not None:
        log = log.where(F.col("turn").between(*turns))
    return log if last is None else log.orderBy(F.desc("seq")).limit(last)


def last_turn(log: DataFrame) -> DataFrame:
    """(thread, turn): where each log goes on; 0 for none."""
    return log.groupBy("thread").agg(F.coalesce(F.max("turn"), F.lit(0)).alias("turn"))


def conversation_tail(log: DataFrame, last: int = 10, chars: int = 300) -> DataFrame:
    """(thread, tail): the last entries as lines `[role] content`, cut, for a query's enrichment."""
    place = F.row_number().over(Window.partitionBy("thread").orderBy(F.desc("seq")))
    rows = log.withColumn("r", place).where(F.col("r") <= last)
    line = F.concat(F.lit("["), F.coalesce("role", F.lit("?")), F.lit("] "), F.substring(F.coalesce("content", F.lit("")), 1, chars))
    return rows.groupBy("thread").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"]), "\n").alias("tail"))


# ---- incremental compression -----------------------------------------------------------------------------

LEAST_ENTRIES = 6


def compression_step(log: DataFrame, done: DataFrame, tail_tokens: int, batch: int = 10) -> DataFrame:
    """New blocks of a log (thread, seq, turn, role, content), given the turns (thread, turn) of earlier ones.

    A thread takes part with six entries or more, six of them in no block yet; of those what lies before the tail of
    tail_tokens is compressed in batches. Exclusion is by turn, so a turn cut in two counts as compressed.
    """
    w = Window.partitionBy("thread")
    rows = log.withColumn("entries", F.count("*").over(w)).where(F.col("entries") >= LEAST_ENTRIES)
    left = uncompressed(rows, done.select("thread", "turn").distinct()).withColumn("entries", F.count("*").over(w)).where(F.col("entries") >= LEAST_ENTRIES)
    old = tail_by_tokens(left, tail_tokens).where(~F.col("in_tail")).drop("entries", "tokens", "in_tail")
    return compressed_blocks(old, batch)


def block_turns(blocks: DataFrame) -> DataFrame:
    """(thread, turn) of compressed blocks."""
    return blocks.select("thread", F.explode(F.split("turns", ",")).alias("turn")).select("thread", F.col("turn").cast("long").alias("turn")).distinct()


def history_within(messages: DataFrame, most: int) -> DataFrame:
    """Messages of blocks (thread, block, content), the newest first while their tokens and 4 each stay within the budget."""
    newest = Window.partitionBy("thread").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("tokens", X.tokens(F.col("content")) + 4).withColumn("running", F.sum("tokens").over(newest)).where(F.col("running") <= most).drop("running")


def live_tail(log: DataFrame, done: DataFrame, most: int) -> DataFrame:
    """The suffix of the entries in no block that stays within the budget."""
    return tail_by_tokens(uncompressed(log, done.select("thread", "turn").distinct()), most).where("in_tail").drop("in_tail")


def assembled(log: DataFrame, blocks: DataFrame, question: str, tail_tokens: int, history_tokens: int, context: DataFrame | None = None) -> DataFrame:
    """Messages of each thread (thread, layer, pos, role, content): retrieved context (thread, context) as a pair, a
    header and the compressed history, the tail, the question."""
    threads = log.select("thread").distinct()
    say = lambda df, layer, pos, role, text: df.select("thread", F.lit(layer).alias("layer"), F.lit(pos).cast("long").alias("pos"), F.lit(role).alias("role"), text.alias("content"))
    parts = [say(threads, 4, 0, "user", F.lit(question))]
    if context is not None:
        some = context.where(F.coalesce("context", F.lit("")) != "")
        parts += [say(some, 1, 0, "user", F.concat(F.lit("<context>\n"), "context", F.lit("\n</context>"))), say(some, 1, 1, "assistant", F.lit("Thank you, I have that context."))]
    history = history_within(rendered_blocks(blocks), history_tokens)
    parts.append(say(history.select("thread").distinct(), 2, -1, "user", F.lit("<compressed_history>The following are summaries of earlier parts of our conversation:</compressed_history>")))
    parts.append(history.select("thread", F.lit(2).alias("layer"), F.col("block").cast("long").alias("pos"), F.lit("user").alias("role"), "content"))
    parts.append(live_tail(log, block_turns(blocks), tail_tokens).select("thread", F.lit(3).alias("layer"), F.col("seq").cast("long").alias("pos"), "role", "content"))
    return reduce(DataFrame.unionByName, parts)


# ---- transcripts -----------------------------------------------------------------------------------------

RECALL, IDENTITY = "What do you recall about the current work?", "Who are you?"


def parsed_time(ts: Column) -> Column:
    """A time from ISO text, Z or an offset; null where it is none."""
    return F.try_to_timestamp(ts)


def shown_time(micros: Column) -> Column:
    """Milliseconds and Z."""
    return F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def transcript_sections(log: DataFrame, tail_tokens: int, base: Column, identity: str = "", recall: DataFrame | None = None, blocks: DataFrame | None = None, overhead: int = 50) -> DataFrame:
    """Records of each thread in order (thread, pos, zone, role, content, timestamp, uuid, parent_uuid).

    Zone 1, a minute before base and a second each: who speaks, recalled paragraphs (thread, seq, content), compressed
    blocks with their answers. Zone 2: entries before the tail, spread evenly over the hour from base, a second apart
    at least. Zone 3: the tail with its own times (column ts, null or none: from two hours after base on).
    """
    threads = log.select("thread").distinct()
    piece = lambda df, part, pos, role, text: df.select("thread", F.lit(part).alias("part"), pos.cast("long").alias("at"), F.lit(role).alias("role"), text.alias("content"), F.lit(1).alias("zone"), F.lit(None).cast("timestamp").alias("own"))
    parts = []
    if identity:
        parts += [piece(threads, 1, F.lit(0), "user", F.lit(IDENTITY)), piece(threads, 1, F.lit(1), "assistant", F.lit(identity))]
    if recall is not None:
        some = paragraphs(recall.select(F.struct("thread", "seq").alias("seq"), "content")).select("seq.thread", F.col("seq.seq").alias("s"), "pos", F.btrim("content", F.lit(" \n\t\r")).alias("content")).where("content <> ''")
        order = F.row_number().over(Window.partitionBy("thread").orderBy("s", "pos"))
        parts += [piece(recall.select("thread").distinct(), 2, F.lit(0), "user", F.lit(RECALL)), piece(some.withColumn("k", order), 2, F.col("k"), "assistant", F.col("content"))]
    if blocks is not None:
        told = rendered_blocks(blocks)
        parts += [piece(told, 3, F.col("block") * 2, "user", F.concat(F.lit("<compressed_history>\n"), "content", F.lit("\n</compressed_history>"))), piece(told, 3, F.col("block") * 2 + 1, "assistant", F.lit("Noted."))]
    split = tail_by_tokens(log if "ts" in log.columns else log.withColumn("ts", F.lit(None).cast("timestamp")), tail_tokens, overhead)
    parts.append(split.select("thread", F.when(F.col("in_tail"), 5).otherwise(4).alias("part"), F.col("seq").cast("long").alias("at"), F.when(F.col("role") == "user", "user").otherwise("assistant").alias("role"), "content", F.when(F.col("in_tail"), 3).otherwise(2).alias("zone"), F.col("ts").alias("own")))
    rows = reduce(DataFrame.unionByName, parts)
    zone = Window.partitionBy("thread", "zone").orderBy("part", "at")
    k, n = F.row_number().over(zone) - 1, F.count("*").over(Window.partitionBy("thread", "zone"))
    second, start = F.lit(1_000_000).cast("long"), F.unix_micros(base)
    step = F.greatest(second, F.floor(F.lit(3_600_000_000) / F.greatest(n - 1, F.lit(1))).cast("long"))
    # tail entries without a time count on among themselves
    late = F.sum(F.col("own").isNull().cast("long")).over(zone) - 1
    whole = F.floor((start - 60 * second) / second) * second
    at = F.when(F.col("zone") == 1, whole + k * second).when(F.col("zone") == 2, start + k * F.when(n > 1, step).otherwise(second)).otherwise(F.coalesce(F.unix_micros("own"), start + 7200 * second + late * second))
    order = Window.partitionBy("thread").orderBy("part", "at")
    timed = rows.withColumn("timestamp", shown_time(at)).withColumn("pos", (F.row_number().over(order) - 1).cast("long"))
    uid = F.substring(F.sha2(F.concat_ws("|", "thread", "pos"), 256), 1, 12)
    linked = timed.withColumn("uuid", uid)
    return linked.select("thread", "pos", "zone", "role", "content", "timestamp", "uuid", F.lag("uuid").over(Window.partitionBy("thread").orderBy("pos")).alias("parent_uuid"))


def transcript_records(sections: DataFrame, cwd: str = "", version: str = "1") -> DataFrame:
    """(thread, pos, value): each record as JSON in the neutral transcript form; assistants speak in text blocks."""
    text = F.to_json(F.struct(F.col("role"), F.array(F.struct(F.lit("text").alias("type"), F.col("content").alias("text"))).alias("content")))
    plain = F.to_json(F.struct("role", "content"))
    head = F.to_json(
        F.struct(
            F.col("role").alias("type"), "uuid", F.col("parent_uuid").alias("parentUuid"), F.col("thread").cast("string").alias("sessionId"), F.lit(version).alias("version"), "timestamp",
            F.lit(False).alias("isSidechain"), F.lit("external").alias("userType"), F.lit("cli").alias("entrypoint"), F.lit(cwd).alias("cwd"),
        )
    )
    message = F.when(F.col("role") == "assistant", text).otherwise(plain)
    return sections.withColumns({"h": head, "m": message}).select("thread", "pos", F.concat(F.expr("left(h, length(h) - 1)"), F.lit(',"message":'), F.col("m"), F.lit("}")).alias("value"))
