"""URL filters: pattern rules are indexed by their rarest literal token; only rules that share a token
with a URL are tried on it.

Defined cases: a null URL, or one without ``://``, has an empty host and path, no rule, and the verdict
``allow``. Of site rules of one length the name that sorts last wins, of patterns the verdict and then the name that
sorts last. URLs of any length are judged whole. Repeated rows are judged alike, each on its own row. An empty table
gives an empty result. Other columns of the input are not read, so no name can clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULE_SCHEMA = "rule string, kind string, verdict string, pattern string, tokens array<string>"


@dataclass(frozen=True)
class Rule:
    """``kind`` is ``site`` (host and path prefix; the longest wins) or ``pattern`` (any match blocks
    or allows, after the site rules)."""

    rule: str
    kind: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]


def _tokens(literal: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(t for t in "".join(c if c.isalnum() and c.isascii() else " " for c in literal.lower()).split()))


def _quote(literal: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in literal)


def site(verdict: str, rule: str) -> Rule:
    """``host/path`` as a pattern over ``host path`` joined by a line feed, which neither part of a rule holds."""
    host, _, path = rule.partition("/")
    return Rule(rule, "site", verdict, f"^([^\\n]*\\.)?{_quote(host)}\\n{_quote('/' + path)}", _tokens(rule))


def pattern(verdict: str, name: str, regex: str, *literals: str) -> Rule:
    """A regular expression over host, line feed and path, with the literal tokens that every match must hold.

    Each literal must stand in the match between characters that are no letters (digits, at most, if it is of letters
    only): a rule with alternatives is several of these under one name.
    """
    return Rule(name, "pattern", verdict, regex, tuple(t for x in literals for t in _tokens(x)))


# The contract's rules (fixed values).
SITE_RULES = (
    site("allow", "com/"),
    site("block", "example.com/en/"),
    site("allow", "www.example.com/en/"),
    site("block", "net/es/"),
    site("block", "net/fr/"),
)
# The method's own rules, for URLs that no site rule fits.
PATTERN_RULES = (
    pattern("block", "pharmacy shop", r"(^|[.-])cheap-pills([.-]|\n)", "cheap", "pills"),
    pattern("block", "pharmacy shop", r"(^|[.-])cheappills([.-]|\n)", "cheappills"),
    *(pattern("block", "casino", rf"(^|[./-]){word}([./-]|\n|$)", word) for word in ("casino", "casinos")),
    pattern("block", "adult", r"(^|[./-])xxx([./-]|\n|$)", "xxx"),
    pattern("block", "adult, plain", r"(^|[./-])porn([./-]|\n|$)", "porn"),
    *(pattern("block", "advert server", rf"^{word}[0-9]*\.[^\n]*\n", word) for word in ("ad", "ads", "adserver", "banner", "banners")),
    *(pattern("block", "tracker pixel", rf"\n(/[^/]*)*/{word}\.gif$", "gif", word) for word in ("pixel", "beacon")),
    pattern("block", "log-in page", r"\n(/[^/]*)*/(wp-)?login(\.php)?/?$", "login"),
    *(pattern("block", "free download", rf"(^|[.-])free-{word}[.-]", "free", word) for word in ("download", "downloads")),
)


def rules_frame(spark, rules) -> DataFrame:
    """A list of rules as a table of literals (RULE_SCHEMA)."""
    rows = [F.struct(F.lit(r.rule), F.lit(r.kind), F.lit(r.verdict), F.lit(r.pattern), F.array(*map(F.lit, r.tokens)).cast("array<string>")) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows).cast(f"array<struct<{RULE_SCHEMA.replace(' array', ':array').replace(' string', ':string')}>>")))


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Verdict for every row of ``pages`` (page_id, url) under ``rules`` (RULE_SCHEMA).

    The URLs' tokens are counted once over all distinct URLs; each rule is filed under its token of
    least count (ties: the lesser token). Tokens of a URL fetch the rules filed there, and only these
    run their expressions. A page without candidates keeps ``default``. A URL's tokens are its runs of letters and
    digits and its runs of letters alone, so that ``ads12`` fetches what is filed under ``ads``.
    """
    urls = pages.select("page_id", F.col("url").alias("_u"))
    rest = F.expr("if(instr(_u, '://') > 0, substring(_u, instr(_u, '://') + 3), '')")
    parts = urls.withColumn("_rest", F.coalesce(rest, F.lit(""))).select(
        "page_id",
        F.expr(r"translate(regexp_extract(_rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')").alias("host"),
        F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )
    distinct = parts.select("host", "path").distinct()
    ascii_lower = F.expr("translate(concat(host, '\n', path), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    tokens = distinct.select("host", "path", F.explode(F.array_distinct(F.concat(F.split(ascii_lower, "[^a-z0-9]+"), F.split(ascii_lower, "[^a-z]+")))).alias("token")).where("token <> ''")

    ruled = rules.select("*", F.explode("tokens").alias("token"))
    # No hints: Spark knows the size of a rule list, and broadcasts it if it is small.
    counts = tokens.join(ruled.select("token").distinct(), "token", "left_semi")
    counts = counts.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    index = ruled.join(counts, "token", "left").groupBy("rule", "kind", "verdict", "pattern")
    index = index.agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))

    found = tokens.join(index, "token")
    found = found.where(F.expr("regexp_like(concat(host, '\n', path), pattern)"))
    best = found.groupBy("host", "path").agg(
        F.max(F.expr("if(kind = 'site', struct(length(rule) as size, rule, verdict), null)")).alias("site"),
        F.max(F.expr("if(kind = 'pattern', struct(verdict, rule), null)")).alias("pat"),
    )
    return parts.join(best, ["host", "path"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("site.rule").alias("rule"),
        F.coalesce("site.verdict", "pat.verdict", F.lit(default)).alias("verdict"),
        F.when(F.col("site").isNull(), F.col("pat.rule")).alias("pattern_rule"),
    )
