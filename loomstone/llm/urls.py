"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over "host" + "path" with the literal tokens that any match must hold. The
index maps one token of each rule, the rarest in the table of URLs, to the rule. URL tokens fetch candidate
rules, and only those run their expression. Site rules (a host with its subdomains and a path prefix) are
compiled to such rules; the longest that fits decides. Block patterns judge what no site rule decides.

Edge cases. A null URL, or one without "://", has empty host and path and no rule; patterns look at host and
path only, so it is allowed. Repeated rows come back as often as they came. Ties between site rules of one
length go to the smaller text. Extra columns of the input are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The broadcast index holds one row a rule; larger rule tables are joined by a shuffle.
MAX_BROADCAST_RULES = 50_000

SITE_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: (regular expression over host + path, literal tokens it needs), for what no site rule decides.
BLOCK_PATTERNS = (
    (r"(^|[.-])spam-farm([.-]|$|/)", ("spam", "farm")),
    (r"(^|[.-])cheap-pills([.-]|$|/)", ("cheap", "pills")),
    (r"(^|[./-])casino([./-]|$)", ("casino",)),
    (r"(^|[./-])xxx([./-]|$)", ("xxx",)),
    (r"(^|[./-])porn([./-]|$)", ("porn",)),
    (r"(^|[./-])free-bets([./-]|$)", ("free", "bets")),
    (r"(^|[./-])free-download([./-]|$)", ("free", "download")),
    (r"(^|[./-])click-bait([./-]|$)", ("click", "bait")),
)


@dataclass(frozen=True)
class PatternRule:
    rule: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    site: bool


def site_rule(rule: str, action: str) -> PatternRule:
    """host/path: the host and all its subdomains, where the path starts with the rule's."""
    host, _, path = rule.partition("/")
    tokens = tuple(t for t in re.split("[^a-z0-9]+", host) if t) + tuple(t for t in re.split("[^a-z0-9]+", f"/{path}".translate(str.maketrans(UPPER, LOWER)))[:-1] if t)
    return PatternRule(rule, action, rf"^([^/?#]*\.)?{re.escape(host)}{re.escape('/' + path)}", tokens, True)


def default_rules() -> list[PatternRule]:
    return [*(site_rule(*r) for r in SITE_RULES), *(PatternRule(p, "block", p, t, False) for p, t in BLOCK_PATTERNS)]


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def url_parts(df: DataFrame, url: str) -> DataFrame:
    """Add host and path as the contract cuts them."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)"))
    return df.withColumns(
        {
            "host": F.coalesce(lowered(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.lit("")),
            "path": F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit("")),
        }
    )


def tokens_of(host: Column, path: Column) -> Column:
    return F.array_distinct(F.filter(F.split(lowered(F.concat(host, F.lit("/"), path)), "[^a-z0-9]+"), lambda t: t != ""))


RULE_COLUMNS = ("rule", "action", "pattern", "tokens", "site")


def rule_table(spark, rules: list[PatternRule]) -> DataFrame:
    """A list of rules as a table."""
    rows = [(r.rule, r.action, r.pattern, " ".join(r.tokens), r.site) for r in rules]
    return literal_rows(spark, list(RULE_COLUMNS), rows).withColumn("tokens", F.split("tokens", " "))


def read_rules(spark, path: str) -> DataFrame:
    """Rules of a CSV file (header: rule, action, pattern, tokens). Without a pattern a row is a site rule, host/path; with
    one, tokens are the words, between spaces, that any match must hold. Malformed and repeated rows go."""
    rows = spark.read.option("header", "true").schema("rule string, action string, pattern string, tokens string").csv(path)
    rows = rows.where(F.col("rule").isNotNull() & F.col("action").isin("block", "allow")).distinct()
    host, rest = F.substring_index("rule", "/", 1), F.regexp_extract("rule", "^[^/]*(/.*)?$", 1)
    # a prefix may end within a token of a URL's path, so its last piece is no literal
    whole = F.split(lowered(rest), "[^a-z0-9]+")
    literals = F.array_distinct(F.filter(F.concat(F.split(lowered(host), "[^a-z0-9]+"), F.slice(whole, F.lit(1), F.greatest(F.size(whole) - 1, F.lit(0)))), lambda t: t != ""))
    quote = lambda c: F.regexp_replace(c, r"([\\.^$|()\[\]{}*+?\-])", r"\\$1")
    site = F.coalesce("pattern", F.lit("")) == ""
    pattern = F.when(site, F.concat(F.lit(r"^([^/?#]*\.)?"), quote(lowered(host)), quote(F.when(rest == "", "/").otherwise(rest)))).otherwise(F.col("pattern"))
    tokens = F.when(site, literals).otherwise(F.filter(F.split(lowered(F.coalesce("tokens", F.lit(""))), " "), lambda t: t != ""))
    return rows.select("rule", "action", pattern.alias("pattern"), tokens.alias("tokens"), site.alias("site")).where(F.size("tokens") > 0)


def url_filter(df: DataFrame, key: str = "page_id", url: str = "url", rules: list[PatternRule] | DataFrame | None = None) -> DataFrame:
    """Per row: key, host, path, rule, verdict, pattern (the block pattern that decided, if one did).

    rules: a list, or a table (rule, action, pattern, tokens, site) of any size. The only shuffle is of the URLs by
    their key; tokens, candidates and matches stay in those partitions. Tables beyond MAX_BROADCAST_RULES are joined
    by a shuffle of tokens.
    """
    spark = df.sparkSession
    if not isinstance(rules, DataFrame):
        rules = default_rules() if rules is None else rules
        few, rules = len(rules) <= MAX_BROADCAST_RULES, rule_table(spark, rules)
    else:
        few = rules.count() <= MAX_BROADCAST_RULES
    base = url_parts(df.select(F.col(key).alias("__k"), F.col(url).alias("__u")).groupBy("__k", "__u").agg(F.count("*").alias("__n")), "__u")
    tokenized = base.withColumn("__t", tokens_of(F.col("host"), F.col("path")))
    met = url_parts(df.select(F.col(url).alias("__u")), "__u").select(F.explode(tokens_of(F.col("host"), F.col("path"))).alias("token"))
    index = rarest_token_index(met, rules, few)
    found = (
        tokenized.withColumn("token", F.explode_outer("__t"))
        .join(F.broadcast(index) if few else index, "token", "left")
        .withColumn("__hit", F.col("pattern").isNotNull() & F.rlike(F.concat("host", "path"), F.col("pattern")))
        .groupBy("__k", "__u", "__n", "host", "path")
        .agg(
            F.min(F.when(F.col("__hit") & F.col("site"), F.struct((-F.length("rule")).alias("len"), "rule", "action"))).alias("__site"),
            F.min(F.when(F.col("__hit") & ~F.col("site"), F.struct("rule", "action"))).alias("__other"),
        )
    )
    return found.select(
        F.col("__k").alias(key),
        "host",
        "path",
        F.col("__site.rule").alias("rule"),
        F.coalesce("__site.action", "__other.action", F.lit("allow")).alias("verdict"),
        F.when(F.col("__site").isNull(), F.col("__other.rule")).alias("pattern"),
        F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__i"),
    ).drop("__i")


def rarest_token_index(met: DataFrame, rules: DataFrame, few: bool) -> DataFrame:
    """One row a rule: its rarest literal token (ties: the smaller) over all tokens met, with what the rule needs."""
    needed = rules.withColumn("token", F.explode("tokens")).drop("tokens")
    wanted = needed.select("token").distinct()
    counts = met.join(F.broadcast(wanted) if few else wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    counted = needed.join(F.broadcast(counts) if few else counts, "token", "left")
    keys = ["rule", "action", "pattern", "site"]
    return counted.groupBy(*keys).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("m")).select(F.col("m.token").alias("token"), *keys)


def literal_rows(spark, names: list[str], rows: list[tuple]) -> DataFrame:
    """A small table of literals, made in the JVM."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows])))


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
