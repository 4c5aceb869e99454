"""Ranges on ordinal scales: containment and overlap by equi joins.

A scale is a table (scale, label, rank). Written ranges ("T2-4", "stage II or higher", "≤ IIIA", "IB") become
closed rank intervals. An interval is cut into dyadic nodes, at most two per level of a binary tree over the ranks,
and a rank is in an interval exactly if one of its ancestors is one of the nodes: containment is an equi join on
(scale, node), each pair found once, however many intervals or ranks there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The scales' labels in ascending order. Sub-stages lie between their stage and the next one.
SCALES: dict[str, list[str]] = {
    "stage": ["0", "I", "IA", "IB", "II", "IIA", "IIB", "IIC", "III", "IIIA", "IIIB", "IIIC", "IV", "IVA", "IVB", "IVC"],
    "t": ["TX", "T0", "TIS", "T1", "T1A", "T1B", "T1C", "T2", "T2A", "T2B", "T2C", "T3", "T3A", "T3B", "T4", "T4A", "T4B"],
    "n": ["NX", "N0", "N1", "N1A", "N1B", "N1C", "N2", "N2A", "N2B", "N2C", "N3", "N3A", "N3B", "N3C"],
    "ecog": ["0", "1", "2", "3", "4", "5"],
}
LEVELS = 5  # every scale has fewer than 2 ** LEVELS ranks
_NAMES = {"stage": r"(?:stage\s*)?", "t": r"[ycpra]*", "n": r"[ycpra]*", "ecog": r"(?:ecog|ps|performance status)?\s*"}
_BODY = {"stage": r"0|iv[abc]?|i{1,3}[abc]?", "t": r"t(?:is|[0-4x][abc]?)", "n": r"n[0-3x][abc]?", "ecog": r"[0-5]"}
_SECOND = {"stage": _BODY["stage"], "t": r"t?(?:is|[0-4x][abc]?)", "n": r"n?[0-3x][abc]?", "ecog": r"[0-5]"}
_LOW = r"(?:≤|<=|at most|up to|or less|or lower)"
_HIGH = r"(?:≥|>=|at least|or more|or higher|\+)"


def scale_table(spark: SparkSession) -> DataFrame:
    """(scale, label, rank); the rows are in the program."""
    rows = [F.struct(F.lit(s).alias("scale"), F.lit(label).alias("label"), F.lit(i).alias("rank")) for s, labels in SCALES.items() for i, label in enumerate(labels)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _rank(scale: str, label: Column) -> Column:
    known = F.create_map(*[F.lit(v) for i, x in enumerate(SCALES[scale]) for v in (x, i)])
    return F.try_element_at(known, F.upper(label))


def _last(scale: str, label: Column) -> Column:
    """The last rank of a label's group: a stage without a letter holds its sub-stages."""
    ends = {x: max(i for i, y in enumerate(SCALES[scale]) if y == x or (y.startswith(x) and y[len(x) :].strip("ABC") == "")) for x in SCALES[scale]}
    return F.try_element_at(F.create_map(*[F.lit(v) for x, i in ends.items() for v in (x, i)]), F.upper(label))


def rank_range(scale: str, text: Column) -> Column:
    """Struct (lo, hi) of a written label or range, each side with its group; NULL when it is none."""
    clean = F.lower(F.trim(text))
    one = rf"^{_NAMES[scale]}({_BODY[scale]})(?:\s*(?:-|–|to|through)\s*{_NAMES[scale]}({_SECOND[scale]}))?$"
    bare = F.trim(F.regexp_replace(clean, rf"{_LOW}|{_HIGH}", ""))
    first, second = F.regexp_extract(bare, one, 1), F.regexp_extract(bare, one, 2)
    letter = {"t": "t", "n": "n"}.get(scale)
    if letter:
        second = F.when((second != "") & ~second.startswith(letter), F.concat(F.lit(letter), second)).otherwise(second)
    lo, hi = _rank(scale, first), F.coalesce(_last(scale, F.nullif(second, F.lit(""))), _last(scale, first))
    low, high = clean.rlike(_LOW), clean.rlike(_HIGH)
    out = F.struct(F.when(low, 0).otherwise(lo).alias("lo"), F.when(high, len(SCALES[scale]) - 1).otherwise(hi).alias("hi"))
    return F.when(lo.isNotNull() & hi.isNotNull() & (lo <= hi), out)


def members(scale: str, interval: Column) -> Column:
    """The labels of a rank interval, lowest first."""
    labels = F.array(*map(F.lit, SCALES[scale]))
    return F.when(interval.isNotNull(), F.slice(labels, interval["lo"] + 1, interval["hi"] - interval["lo"] + 1))


def cover(lo: Column, hi: Column) -> Column:
    """The dyadic nodes whose ranks are together lo..hi; node 1 holds all ranks, the children of n are 2n and 2n + 1."""
    leaves = 1 << LEVELS
    start = F.struct((lo + leaves).alias("l"), (hi + leaves + 1).alias("r"), F.array().cast("array<int>").alias("nodes"))

    def step(acc: Column, _: Column) -> Column:
        open_ = acc["l"] < acc["r"]
        left = open_ & (acc["l"] % 2 == 1)
        right = open_ & (acc["r"] % 2 == 1)
        added = F.array_compact(F.array(F.when(left, acc["l"]), F.when(right, acc["r"] - 1)))
        return F.struct(
            F.shiftright(F.when(left, acc["l"] + 1).otherwise(acc["l"]), 1).alias("l"), F.shiftright(F.when(right, acc["r"] - 1).otherwise(acc["r"]), 1).alias("r"),
            F.concat(acc["nodes"], added).alias("nodes"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), start, step, lambda a: a["nodes"])


def ancestors(rank: Column) -> Column:
    """The nodes that hold a rank, its leaf and the root among them."""
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: F.call_function("shiftright", rank + (1 << LEVELS), k))


def contained(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """Every point (scale, rank, ...) with every range (scale, lo, hi, ...) that holds it, once.

    Names of the two sides must differ but for ``scale``. Equal points and equal ranges should be grouped by the caller.
    """
    p = points.where("rank is not null").select("*", F.explode(ancestors(F.col("rank"))).alias("_node"))
    r = ranges.where("lo <= hi").select("*", F.explode(cover(F.col("lo"), F.col("hi"))).alias("_node"))
    return p.join(r, ["scale", "_node"]).drop("_node")


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """pairs of ranges (scale, lo, hi, ...) and (scale, low, high, ...) with a common rank, each once.

    Two intervals meet exactly if the lower end of one lies in the other; ends that are equal count on one side only.
    """
    first = contained(left.withColumn("rank", F.col("lo")).withColumnRenamed("lo", "_lo").withColumnRenamed("hi", "_hi"), right.withColumnRenamed("low", "lo").withColumnRenamed("high", "hi"))
    first = first.drop("rank").withColumnsRenamed({"lo": "low", "hi": "high"}).withColumnsRenamed({"_lo": "lo", "_hi": "hi"})
    second = contained(right.withColumn("rank", F.col("low")), left).where("low > lo").drop("rank")
    return first.unionByName(second.select(*first.columns))
