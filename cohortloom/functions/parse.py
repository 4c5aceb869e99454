"""Parsers that turn prose outcomes into numbers (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_group(txt: Column, pattern: str, group: int = 1) -> Column:
    """Text of a regex group at its first hit, NULL without one."""
    return F.nullif(F.regexp_extract(txt, pattern, group), F.lit(""))


def first_number(txt: Column, pattern: str) -> Column:
    return first_group(txt, pattern).try_cast("double")


def extract_percent(txt: Column) -> Column:
    """First percentage in the text."""
    return first_number(txt, r"(\d+\.?\d*)\s*%")


def extract_months(txt: Column) -> Column:
    """First "N months", else first "N years" in months (so "91% at 3 years" gives 36)."""
    return F.coalesce(
        first_number(txt, r"(\d+\.?\d*)\s*months?"), first_number(txt, r"(\d+\.?\d*)\s*years?") * 12.0
    )


def extract_gy(txt: Column) -> Column:
    """First dose written in Gy, else in Gray."""
    return F.coalesce(
        first_number(txt, r"(\d+\.?\d*)\s*-?\s*[Gg][Yy]"), first_number(txt, r"(\d+\.?\d*)\s*[Gg]ray")
    )


def extract_fractions(txt: Column) -> Column:
    """I4: first "N fr..." as an integer."""
    return first_group(txt, r"(\d+)\s*fr").try_cast("int")


def extract_percentage_or_proportion(txt: Column) -> Column:
    """A percentage if written as one, else a bare number, read as a proportion when <= 1."""
    number = first_number(txt, r"(\d+\.?\d*)")
    return F.coalesce(extract_percent(txt), F.when(number <= 1, number * 100).otherwise(number))


def round_half_up(col: Column, digits: int) -> Column:
    """Half-away-from-zero rounding on decimals, returned as double."""
    return F.round(col.cast("decimal(38,10)"), digits).cast("double")


def exact_sum(col: Column) -> Column:
    """Sum on decimals, so that the result does not depend on the order of partial sums."""
    return F.sum(col.cast("decimal(28,6)")).cast("double")


def exact_avg(col: Column) -> Column:
    return exact_sum(col) / F.count(col)


def json_text(col: Column, path: str) -> Column:
    """Text at a JSON path; NULL when absent."""
    return F.get_json_object(col, path)


def metric_label(metric: str) -> str:
    """Column name of a metric as a title."""
    return metric.replace("_rate_percent", " Rate").replace("_median_months", " Median").replace("_", " ").title()


def metric_unit(metric: str) -> str:
    """Unit of a metric, guessed from its name in this order."""
    for needles, unit in (
        (("percent", "rate"), "%"),
        (("months", "followup"), " months"),
        (("patients",), " patients"),
        (("age",), " years"),
        (("dose",), " Gy"),
    ):
        if any(n in metric for n in needles):
            return unit
    return ""
