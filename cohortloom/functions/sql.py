"""The scalar parsers as SQL functions (CREATE TEMPORARY FUNCTION), for use inside spark.sql."""

from __future__ import annotations

from pyspark.sql import SparkSession

from cohortloom.functions.rules import PHASE_SPELLINGS, disease_rules, technique_rules

_NUMBER = "try_cast(nullif(regexp_extract(txt, r'{0}', 1), '') as double)"


def _phase_case() -> str:
    body = " ".join(
        "when lower(trim(txt)) in ({}) then '{}'".format(", ".join(f"'{s.lower()}'" for s in [name, *spellings]), name)
        for name, spellings in PHASE_SPELLINGS
    )
    return f"case when nullif(trim(txt), '') is null then null {body} else initcap(trim(txt)) end"


def _contained(rules: list[tuple[str, list[str]]]) -> str:
    """First rule one of whose needles the text contains; the rules are one literal array, as in the column function."""
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    table = ", ".join(f"struct({quote(name)} as name, array({', '.join(map(quote, needles))}) as needles)" for name, needles in rules)
    first = f"get(filter(array({table}), r -> exists(r.needles, n -> contains(lower(trim(txt)), n))), 0).name"
    return f"case when nullif(trim(txt), '') is not null then coalesce({first}, initcap(trim(txt))) end"


def definitions() -> dict[str, tuple[str, str]]:
    """Name -> (return type, body) of every SQL function."""
    n = _NUMBER.format
    return {
        "extract_percent": ("double", n(r"(\d+\.?\d*)\s*%")),
        "extract_months": ("double", f"coalesce({n(r'(\d+\.?\d*)\s*months?')}, {n(r'(\d+\.?\d*)\s*years?')} * 12.0D)"),
        "extract_gy": ("double", f"coalesce({n(r'(\d+\.?\d*)\s*-?\s*[Gg][Yy]')}, {n(r'(\d+\.?\d*)\s*[Gg]ray')})"),
        "extract_fractions": ("int", r"try_cast(nullif(regexp_extract(txt, r'(\d+)\s*fr', 1), '') as int)"),
        "normalize_phase": ("string", _phase_case()),
        "normalize_cancer_type": ("string", _contained(disease_rules())),
        "normalize_technique": ("string", _contained(technique_rules())),
    }


def register(spark: SparkSession) -> list[str]:
    """Register all functions in the session and return their names."""
    for name, (kind, body) in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(txt STRING) RETURNS {kind} RETURN {body}")
    return list(definitions())
