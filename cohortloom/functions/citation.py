"""Author and citation strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Credentials and titles stripped from names, and the particles that open a surname.
CREDENTIALS = (
    r"(?i),?\s*\b(MD|M\.D\.|DO|D\.O\.|PhD|Ph\.D\.|MBBS|MBChB|FRCP|FRCS|FACS|FACP|MPH|MS|MSc|MA|MBA|RN|NP|PA|PA-C"
    r"|Jr\.?|Sr\.?|III|IV|FRCR|FRANZCR|FASTRO|Professor|Prof\.?|Dr\.?)\b\.?"
)
PARTICLES = ["van", "von", "de", "del", "della", "di", "da", "le", "la", "el", "al"]
BAD_CITATION = r"(?i)\b(MD|PhD)\b\s*(et al|,)"


def clean_name(name: Column) -> Column:
    """Name without credentials, titles and stray commas."""
    out = F.regexp_replace(F.regexp_replace(name, CREDENTIALS, ""), r",\s*,", ",")
    return F.regexp_replace(F.regexp_replace(out, r"\s+", " "), r"^[ ,.]+|[ ,.]+$", "")


def last_name(name: Column) -> Column:
    """Surname of a cleaned name: before a comma, from a particle on, else the last word."""
    parts = F.split(name, " ")
    marks = F.transform(parts, lambda p, i: F.when(F.lower(p).isin(PARTICLES) & (i < F.size(parts) - 1), i))
    start = F.array_min(marks)
    tail = F.when(start.isNotNull(), F.array_join(F.slice(parts, start + 1, F.size(parts)), " ")).otherwise(F.element_at(parts, -1))
    return F.when(name.contains(","), F.trim(F.split_part(name, F.lit(","), F.lit(1)))).otherwise(tail)


def author_et_al(authors: Column) -> Column:
    """One author in full, several as "Surname et al."."""
    names = F.filter(F.transform(authors, clean_name), lambda n: n != "")
    first = F.get(names, F.lit(0))
    several = F.concat(last_name(first), F.lit(" et al."))
    return F.when(F.coalesce(F.size(names), F.lit(0)) < 1, "Unknown author").when(F.size(names) == 1, first).otherwise(several)


def extract_year(text: Column) -> Column:
    return F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1).try_cast("int")


def clean_doi(doi: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(doi, r"(?i)^https?://(dx\.)?doi\.org/", "")), F.lit(""))


def citation(et_al: Column, year: Column, title: Column | None, journal: Column | None, doi: Column) -> Column:
    """Citation string of the parts that are known."""
    parts = [et_al, F.concat(F.lit("("), year.cast("string"), F.lit(")")), title, journal, F.concat(F.lit("doi:"), doi)]
    return F.concat_ws(" ", *[p for p in parts if p is not None])


def repair(df: DataFrame, key: str, before: str, authors: str) -> DataFrame:
    """One row per document whose author string is broken, with the string it should have."""
    bad = df.filter(F.col(before).rlike(BAD_CITATION)).dropDuplicates([key])
    fixed = bad.withColumn("after", author_et_al(F.col(authors)))
    surname = F.regexp_extract(before, r"(?i)^(?:MD|PhD),?\s*(.*)$", 1)
    usable = F.col("after") != "Unknown author"
    return fixed.filter(F.col("after") != F.col(before)).select(key, before, F.when(usable & (surname != "et al."), F.col("after")).otherwise("Unknown author").alias("after"))
