"""URL filters: pattern rules indexed by their rarest literal token, in DataFrame operations only.

A rule has a name, a verdict and a regular expression over ``host + path`` (host with A-Z lower-cased).
Its literal tokens are those that every matching URL must contain as whole tokens (a token is a run of
digits, letters and characters beyond ASCII). The rule is filed under the one of its tokens that is
rarest among the URLs at hand; a rule without a literal token is filed under the empty token, which
every URL has. A URL's tokens fetch candidate rules by an equi-join, and only those candidates run
their regular expressions. The longest matching base rule decides; without one, the longest matching
pattern rule of the method; without any, ``allow``.

The index has one row per rule: a list up to ``MAX_BROADCAST`` rules is broadcast (checked), a larger
one joins by shuffle, where Spark splits a hot token. Token frequencies are counted over all URLs.

Edge cases: a url that is null or lacks ``://`` has empty host and path; ties between equally long rules
go to the smaller rule name. Verdicts depend on the url only and are computed once per distinct url, so
repeated rows and repeated ids get the same verdict. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Verdict, host, path of the base rules.
BASE = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

#: The method's own patterns (verdict, regular expression over host + path, literal tokens).
PATTERNS = [
    ("block", r"^(?:[^/]*[.-])?casino(?:[.-][^/]*)?(?:/|$)", ["casino"]),
    ("block", r"^(?:[^/]*[.-])?bets(?:[.-][^/]*)?(?:/|$)", ["bets"]),
    ("block", r"^(?:[^/]*[.-])?poker(?:[.-][^/]*)?(?:/|$)", ["poker"]),
    ("block", r"^(?:[^/]*[.-])?pills(?:[.-][^/]*)?(?:/|$)", ["pills"]),
    ("block", r"^(?:[^/]*[.-])?viagra(?:[.-][^/]*)?(?:/|$)", ["viagra"]),
    ("block", r"^(?:[^/]*[.-])?adult(?:[.-][^/]*)?(?:/|$)", ["adult"]),
    ("block", r"^(?:[^/]*[.-])?porn(?:[.-][^/]*)?(?:/|$)", ["porn"]),
    ("block", r"^(?:[^/]*[.-])?xxx(?:[.-][^/]*)?(?:/|$)", ["xxx"]),
    ("block", r"^(?:[^/]*[.-])?spam(?:[.-][^/]*)?(?:/|$)", ["spam"]),
    ("block", r"^(?:[^/]*[.])?ad[.-][^/]*(?:/|$)", ["ad"]),
    ("block", r"^(?:[^/]*[.])?ads[.-][^/]*(?:/|$)", ["ads"]),
    ("block", r"^[^/]*/(?:[^/]+/)*doubleclick/", ["doubleclick"]),
    ("block", r"^(?:[^/]*[.-])?tracker(?:[.-][^/]*)?(?:/|$)", ["tracker"]),
    ("block", r"^(?:[^/]*[.-])?warez(?:[.-][^/]*)?(?:/|$)", ["warez"]),
    ("block", r"^[^/]*/(?:[^/]+/)*torrent/", ["torrent"]),
]


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(target: Column) -> Column:
    """Distinct tokens of a host + path, ASCII-lower-cased; the empty token is always among them."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.translate(target, UPPER, LOWER), _GAPS)))


def rules(spark, base: list[tuple[str, str, str]] = BASE, patterns: list[tuple[str, str, list[str]]] = PATTERNS) -> DataFrame:
    """Rule table: rule (name), verdict, regex, literals, is_base. A base rule's host labels, and those
    segments of its path that a slash closes, are its literal tokens."""
    quote = lambda s: "".join(c if c.isalnum() else "\\" + c for c in s)
    rows = []
    for verdict, h, p in base:
        closed = h.split(".") + [x for x in p.split("/")[:-1] if x]
        literals = [t for x in closed for t in _runs(x) if t]
        rows.append((h + p, verdict, f"(?s)^(?:[^/]*\\.)?{quote(h)}{quote(p)}", literals, True))
    rows += [(regex, verdict, regex, literals, False) for verdict, regex, literals in patterns]
    return spark.createDataFrame(rows, "rule string, verdict string, regex string, literals array<string>, is_base boolean")


def _runs(s: str) -> list[str]:
    return "".join(c if ord(c) > 127 else c.lower() if c.isalnum() else " " for c in s).split(" ")


def index(rule_table: DataFrame, url_tokens: DataFrame) -> DataFrame:
    """The rule table with ``token``, the rarest of each rule's literals (ties: the smaller token)."""
    literals = rule_table.select("rule", F.explode("literals").alias("token"))
    wanted = literals.select("token").distinct()
    counts = url_tokens.join(_small(wanted), "token", "left_semi").groupBy("token").count()
    rarest = literals.join(counts, "token", "left").groupBy("rule").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), F.col("token"))).alias("least"))
    return rule_table.join(rarest, "rule", "left").select(
        "rule", "verdict", "regex", "is_base", F.coalesce(F.col("least.token"), F.lit("")).alias("token"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else df


def judge(df: DataFrame, rule_table: DataFrame, url_col: str = "url") -> DataFrame:
    """One row per distinct url: url, host, path, rule (the base rule), verdict."""
    urls = df.select(F.col(url_col).alias("url")).distinct().select("url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    target = F.concat("host", "path")
    url_tokens = urls.select("url", target.alias("target"), F.explode(tokens(target)).alias("token"))
    candidates = url_tokens.join(_small(index(rule_table, url_tokens)), "token")
    hits = candidates.where(F.expr("target rlike regex")).groupBy("url").agg(
        F.min(F.struct((~F.col("is_base")).alias("own"), (-F.length("rule")).alias("n"), "rule", "verdict")).alias("best"))
    u, h = urls.alias("u"), hits.alias("h")
    return u.join(h, F.col("u.url") == F.col("h.url"), "left").select(
        F.col("u.url").alias("url"), "host", "path", F.when(~F.col("best.own"), F.col("best.rule")).alias("rule"),
        F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


def filter_urls(df: DataFrame, rule_table: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``df``: id, host, path, rule, verdict."""
    p, j = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).alias("p"), judge(df, rule_table, url_col).alias("j")
    return p.join(j, F.col("p.url").eqNullSafe(F.col("j.url")), "left").select(
        F.col("p.id").alias(id_col), "host", "path", "rule", "verdict")
