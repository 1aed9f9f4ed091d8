"""Column functions over text: token estimates, query terms, low-signal predicates, age-aware decay."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: results depend on each of these lists
STOP_WORDS = (
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "had", "her", "was", "one", "our", "out", "has", "have", "been", "this", "that", "with", "from", "they", "will", "what", "when", "how", "who", "which",
    "their", "about", "would", "there", "could",
)
FILLERS = ("No response requested.", "I have this context. Ready to continue.")
REJECTION = "The user doesn't want to proceed with this tool use"
EMPTY_RESULT = "[{'tool_use_id':"
CORRECTION_WORDS = ("fixed", "the fix", "correct approach", "solved", "the solution", "don't do", "instead use", "the right way", "confirmed working")
FAILURE_WORDS = ("failed", "error", "bug", "wrong", "broken", "doesn't work")
BLOCK_FAILURE_WORDS = ("error", "failed", "doesn't work", "bug", "wrong")
BLOCK_SUCCESS_WORDS = ("fixed", "works", "solved", "confirmed", "correct")
ROLE_FACTORS = {"kernel": 2.0, "chain": 1.3, "context": 1.5}


def tokens(text: Column) -> Column:
    """Estimated tokens: a quarter of the code points, rounded down."""
    return F.floor(F.coalesce(F.length(text), F.lit(0)) / 4).cast("long")


def query_terms(query: str) -> list[str]:
    """Lower-cased words of three characters or more that are no stop words; repeats stay."""
    return [t for t in (w.lower() for w in re.split(r"\W+", query)) if len(t) >= 3 and t not in STOP_WORDS]


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def trimmed(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r\x0b\f"))


def noise(text: Column) -> dict[str, Column]:
    """The low-signal shapes of a trimmed content."""
    return {
        "bracket": F.startswith(text, F.lit("[")) & F.endswith(text, F.lit("]")) & (F.length(text) < 200),
        "filler": text.isin(*FILLERS),
        "rejection": F.contains(text, F.lit(REJECTION)) & (F.length(text) < 400),
        "empty_result": F.startswith(text, F.lit(EMPTY_RESULT)) & (F.length(text) < 80),
    }


def low_signal_ingest(role: Column, content: Column) -> Column:
    """Dropped on ingest: empty content; an assistant's summaries and fillers; a user's tool boilerplate."""
    n = noise(trimmed(content))
    return (trimmed(content) == "") | ((role == "assistant") & (n["bracket"] | n["filler"])) | ((role == "user") & (n["rejection"] | n["empty_result"]))


def low_signal_clean(role: Column, content: Column) -> Column:
    """The cleaner's rule: as on ingest, but kernels and chains stay unless they are empty."""
    return (trimmed(content) == "") | (~role.isin("kernel", "chain") & low_signal_ingest(role, content))


def low_signal_mining(role: Column, content: Column) -> Column:
    """The miner's rule: whatever the role, but kernels and chains always stay."""
    n = noise(trimmed(content))
    return ~role.isin("kernel", "chain") & ((trimmed(content) == "") | n["bracket"] | n["filler"] | n["rejection"] | n["empty_result"])


def age_days(ts: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(86_400_000_000.0)


def decay_factor(role: Column, content: Column, ts: Column, as_of: Column) -> Column:
    """Multiplier of a score by role, content and age; a null time does not decay."""
    text, age = F.lower(content), age_days(ts, as_of)
    out = F
    for name, factor in ROLE_FACTORS.items():
        out = out.when(role == name, F.lit(factor))
    return (
        out.when(ts.isNull(), F.lit(1.0))
        .when(any_of(text, CORRECTION_WORDS), 1.0 + F.least(age / 30, F.lit(0.5)))
        .when(any_of(text, FAILURE_WORDS), F.greatest(F.lit(0.7), 1.0 - age / 60))
        .otherwise(F.greatest(F.lit(0.3), F.pow(F.lit(0.5), age / 30)))
    )
