"""Secret scans: three base patterns, and high-entropy strings found by sliding windows.

All of it is one projection of Spark's own functions: no shuffle, no Python. Positions are code points.

Defined cases: a null or empty text has no spans and empty digests. Spans that start together go by kind as
listed, then by end. Texts of any length are scanned whole. Repeated rows are scanned alike, each on its own row. An
empty table gives an empty table. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Base patterns of the contract, in its order: kind, pattern, group whose length counts, least length (fixed values).
BASE = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    # A run of hex digits is matched whole wherever it starts, so the least length can stand in the pattern.
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
# Candidate strings of the entropy scan: whole runs of these characters, of at least WINDOW characters.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
WINDOW = 20
# Character classes of a candidate, narrowest first: name, pattern of the whole string, least entropy in bits
# that some window must reach (20 random hex digits have about 3.3, 20 random base-64 digits about 4.1).
CLASSES = (
    ("hex", r"^[0-9a-fA-F]+$", 2.95),
    ("alnum", r"^[A-Za-z0-9]+$", 3.65),
    ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.75),
)
# Candidates that look random but are not secrets.
ALLOW = (
    r"^[^0-9]*$",  # no digit: words, however long
    r"^[0-9]+$",  # only digits: numbers and phone or card digits, not keys
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUID
    r"^[A-Za-z]+([_/=-]+[A-Za-z]+)*[_/=-]*[0-9]{0,4}$",  # paths and names with a number at the end
    r"(?i)example|placeholder|your[_-]|xxxx|abcdefghij|0123456789",
    r"^sha(1|256|384|512)-",  # integrity digests
)


def _matches(text: Column, regex: str) -> Column:
    """Structs (start, end, body) of the leftmost non-overlapping matches.

    The texts between matches give the positions, as extraction returns strings only.
    """
    found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    gaps = F.split(text, regex, -1)
    both = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda gap, body: F.struct(gap.alias("gap"), body.alias("body")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,body:string>>").alias("spans"))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["body"])
        return F.struct(end.alias("at"), F.array_append(acc["spans"], F.struct(start.alias("start"), end.alias("end"), x["body"].alias("body"))).alias("spans"))

    return F.when(F.size(found) > 0, F.aggregate(both, zero, step)["spans"]).otherwise(F.array().cast("array<struct<start:int,end:int,body:string>>"))


def _entropy_gain(count: Column) -> Column:
    """c log2 c, with 0 for no occurrence."""
    return F.when(count > 0, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def max_window_entropy(body: Column, window: int = WINDOW) -> Column:
    """Greatest Shannon entropy, in bits, of any ``window`` consecutive characters.

    The counts of the window are a map of the characters in it; each step adds the entering and takes
    away the leaving character, and changes the sum of c log2 c by their two terms only.
    """
    chars = F.split(body, "")
    state = F.struct(
        F.lit(1).alias("at"),
        F.expr("cast(map() as map<string,int>)").alias("counts"),
        F.lit(0.0).alias("total"),
        F.lit(0.0).alias("best"),
    )

    def put(counts, char, n):
        rest = F.map_filter(counts, lambda k, v: k != char)
        return F.when(n > 0, F.map_concat(rest, F.create_map(char, n))).otherwise(rest)

    def step(acc, char):
        old = F.coalesce(acc["counts"][char], F.lit(0))
        counts, total = put(acc["counts"], char, old + 1), acc["total"] + _entropy_gain(old + 1) - _entropy_gain(old)
        gone = F.when(acc["at"] > window, F.element_at(chars, acc["at"] - window))
        was = counts[gone]
        counts2 = F.when(gone.isNull(), counts).otherwise(put(counts, gone, was - 1))
        total2 = F.when(gone.isNull(), total).otherwise(total + _entropy_gain(was - 1) - _entropy_gain(was))
        entropy = F.when(acc["at"] >= window, F.log2(F.lit(float(window))) - total2 / float(window)).otherwise(F.lit(0.0))
        return F.struct((acc["at"] + 1).alias("at"), counts2.alias("counts"), total2.alias("total"), F.greatest(acc["best"], entropy).alias("best"))

    return F.aggregate(chars, state, step)["best"]


def _is_random(body: Column) -> Column:
    """Whether a candidate's entropy reaches the bound of its narrowest class and no allow rule holds."""
    allowed = F.lit(False)
    for rule in ALLOW:
        allowed = allowed | body.rlike(rule)
    least = F.lit(None).cast("double")
    for _, whole, bits in reversed(CLASSES):
        least = F.when(body.rlike(whole), F.lit(bits)).otherwise(least)
    return F.when(allowed | least.isNull(), F.lit(False)).otherwise(max_window_entropy(body) >= least)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _base_spans(order: int, kind: str, regex: str, group: int, least: int) -> Column:
    """Spans of one base pattern; for an assignment only the length of the value counts."""

    def long_enough(x):
        return F.length(F.regexp_extract(x["body"], regex, group) if group else x["body"]) >= least

    def span(x):
        return F.struct(x["start"].alias("start"), F.lit(order).alias("order"), x["end"].alias("end"), F.lit(kind).alias("kind"))

    return F.transform(F.filter(_matches(F.col("_text"), regex), long_enough), span)


def secret_spans(docs: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """The ``keep`` columns of every row with its base spans and all spans (start, order, end, kind), sorted.

    A high-entropy string is added where no base span overlaps it.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    kinds = [_base_spans(order, *rule) for order, rule in enumerate(BASE)]
    strings = F.transform(
        F.filter(_matches(F.col("_text"), CANDIDATE), lambda x: _is_random(x["body"])),
        lambda x: F.struct(x["start"].alias("start"), F.lit(len(BASE)).alias("order"), x["end"].alias("end"), F.lit("entropy").alias("kind")),
    )
    out = docs.select(*keep, whole.alias("_text")).select(*keep, F.array_sort(F.concat(*kinds)).alias("base"), strings.alias("strings"))
    free = F.filter("strings", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return out.select(*keep, "base", F.array_sort(F.concat("base", free)).alias("spans"))


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts and digests of the contract for every row of (doc_id, text)."""
    spans = secret_spans(docs.select("doc_id", "text"), "text", "doc_id")
    n = [F.size(F.expr(f"filter(base, x -> x.kind = '{kind}')")).cast("long").alias(f"n_{kind}") for kind, *_ in BASE]
    return spans.select("doc_id", *n, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
