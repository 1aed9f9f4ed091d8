"""Quality rules: a threshold table compiled into one Spark projection, with no user functions.

Edge cases. A null or empty text has no words: all counts are 0, its ratios are null, and the base rule
(n_words < 50) rejects it. A rule whose ratio is null does not reject. Repeated rows are judged each for
itself. Extra columns stay; one that has the name of a result column gives way to it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Marks around a word that do not belong to it.
MARKS = ".,;:!?\"()"
#: Frequent function words of the four corpus languages.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "on", "with", "as", "be", "by", "are", "this", "from", "or", "an", "at", "not"],
    "fr": ["le", "la", "les", "de", "des", "du", "un", "une", "et", "en", "que", "qui", "dans", "pour", "par", "sur", "est", "au", "pas", "avec"],
    "de": ["der", "die", "das", "und", "in", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"],
    "es": ["el", "la", "los", "las", "de", "que", "y", "en", "un", "una", "por", "con", "para", "su", "se", "del", "al", "lo", "como", "no"],
}


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= metric <= high; a null metric passes."""

    metric: str
    low: float | None = None
    high: float | None = None


#: The production threshold table.
RULES = (
    Rule("mean_word_chars", 2.0, 12.0),
    Rule("symbol_ratio", None, 0.15),
    Rule("stop_words", 2, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("bullet_line_ratio", None, 0.9),
    Rule("ellipsis_line_ratio", None, 0.5),
)


def metrics() -> dict[str, Column]:
    """The ratios that rules can name, as expressions over the counted columns."""
    words, lines = F.nullif(F.col("n_words"), F.lit(0)), F.nullif(F.col("n_lines"), F.lit(0))
    return {
        "n_words": F.col("n_words"),
        "mean_word_chars": F.col("word_chars") / words,
        "symbol_ratio": F.col("n_symbols") / words,
        "stop_words": F.when(F.col("n_words") > 0, F.col("n_stop_words")),
        "stop_word_ratio": F.col("n_stop_words") / words,
        "dup_line_ratio": F.col("n_dup_lines") / lines,
        "bullet_line_ratio": F.col("n_bullet_lines") / lines,
        "ellipsis_line_ratio": F.col("n_ellipsis_lines") / lines,
        "repeat_word_ratio": F.col("n_repeat_words") / words,
    }


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """One boolean expression of all rules, inlined into the projection."""
    known, out = metrics(), F.lit(True)
    for rule in rules:
        value = known[rule.metric]
        if rule.low is not None:
            out = out & F.coalesce(value >= rule.low, F.lit(True))
        if rule.high is not None:
            out = out & F.coalesce(value <= rule.high, F.lit(True))
    return out


def quality_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with the counts, base_failed and kept. Every expression is row-wise: no shuffle, no driver work."""
    body = F.coalesce(F.col(text), F.lit(""))
    stop = F.array(*[F.lit(w) for w in sorted({w for ws in STOP_WORDS.values() for w in ws})])
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines", "n_stop_words", "base_failed", "kept"]
    base = df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in new])
    trimmed = F.btrim(body, F.lit(" \t\n\x0b\f\r"))
    first = base.withColumns({"__w": F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP)), "__l": F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")) != "")})
    counted = repeated_words(first).withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "word_chars": F.length(F.array_join("__w", "")).cast("long"),
            "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("long"),
            "n_lines": F.size("__l").cast("long"),
            "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
            "n_bullet_lines": F.size(F.filter("__l", lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•"))).cast("long"),
            "n_ellipsis_lines": F.size(F.filter("__l", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("long"),
            "n_stop_words": F.size(F.array_intersect(F.transform("__w", lambda w: F.btrim(F.lower(w), F.lit(MARKS))), stop)).cast("long"),
        }
    )
    judged = counted.withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))
    return judged.withColumn("kept", ~F.col("base_failed") & compile_rules(rules)).drop("__w", "__l")


def repeated_words(df: DataFrame) -> DataFrame:
    """Add n_repeat_words: how many words of __w lie in three-word windows found at least twice.

    Each window becomes one long: a hash in the high bits, its position in as few low bits as the row needs.
    A primitive sort brings equal windows together; neighbours with one hash are compared word by word, and a row
    where two of them differ is sorted by the windows themselves, so no match is false or missed. The sorted starts of the matches cover three words each, less what the next one
    covers. O(n log n) in the row, whatever the text repeats.
    """
    hashed = df.withColumns({"__h": F.expr("transform(__w, w -> xxhash64(w))"), "__b": F.expr("length(bin(size(__w)))"), "__k": F.expr("shiftleft(-1L, length(bin(size(__w))))")})
    packed = hashed.withColumn(
        "__p",
        F.expr("""sort_array(transform(slice(__h, 1, greatest(size(__h) - 2, 0)), (x, i) ->
            coalesce(((x ^ shiftleft(get(__h, i + 1), 7) ^ shiftrightunsigned(get(__h, i + 2), 9)) & __k) | i, 0L)))"""),
    )
    met = packed.withColumn(
        "__m",
        F.expr("""array_compact(zip_with(__p, slice(__p, 2, greatest(size(__p) - 1, 0)), (x, y) ->
            if(shiftright(x ^ y, __b) = 0, struct(cast(x & ~__k as int) as i, cast(y & ~__k as int) as j), null)))"""),
    )
    equal = "get(__w, m.i) = get(__w, m.j) and get(__w, m.i + 1) = get(__w, m.j + 1) and get(__w, m.i + 2) = get(__w, m.j + 2)"
    # neighbours of one hash that differ: equal windows may lie apart there, so such a row is sorted by its words
    words = """transform(slice(__w, 1, greatest(size(__w) - 2, 0)), (x, i) -> struct(concat_ws(' ', x, get(__w, i + 1), get(__w, i + 2)) as g, cast(i as int) as i))"""
    exact = f"get(transform(array(sort_array({words})), a -> array_compact(zip_with(a, slice(a, 2, greatest(size(a) - 1, 0)), (x, y) -> if(x.g = y.g, struct(x.i as i, y.i as j), null)))), 0)"
    checked = met.withColumn("__m", F.expr(f"case when exists(__m, m -> not ({equal})) then {exact} else __m end"))
    starts = checked.withColumn("__s", F.expr("sort_array(array_distinct(flatten(transform(__m, m -> array(m.i, m.j)))))"))
    return starts.withColumn(
        "n_repeat_words",
        F.expr("aggregate(__s, named_struct('last', -3, 'n', 0L), (a, i) -> named_struct('last', i, 'n', a.n + least(3, i - a.last)), a -> a.n)"),
    ).drop("__h", "__b", "__k", "__p", "__m", "__s")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
