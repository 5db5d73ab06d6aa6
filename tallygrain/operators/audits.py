"""Evidence ids, citation, number and wording audits over claim and evidence tables.

Citations are exploded to rows and met by key joins, so a claim with many citations or an evidence
row cited by very many claims is never gathered in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrain.functions.exprs import as_double, col
from tallygrain.functions.ranking import numbered
from tallygrain.operators.contracts import ERROR, WARNING

# Id prefixes per kind of evidence.
PREFIXES = {
    "sql": "SQL",
    "statistics": "STAT",
    "machine_learning": "ML",
    "forecast": "FORECAST",
    "anomaly": "ANOMALY",
    "data_quality": "DATA",
    "document": "DOC",
}

# What counts as a number, as causal wording, and as its denial.
NUMBER = r"(?<![A-Za-z])[-+]?\d[\d,]*(?:\.\d+)?%?"
CAUSAL_WORDS = r"(caused?|causing|drove|driven|led to|resulted in|responsible for)"
CAUSAL = rf"(?i)\b{CAUSAL_WORDS}\b"
DENIED_CAUSAL = rf"(?i)\b(no|not|cannot|does not|do not|without)\b[^.]{{0,60}}\b{CAUSAL_WORDS}\b"


def evidence_ids(
    evidence: DataFrame,
    *,
    kind: str = "kind",
    identity: str,
    order: str,
    prefixes: Mapping[str, str] = PREFIXES,
) -> DataFrame:
    """G1: evidence numbered per kind in its order, ``PREFIX-001`` on; the same identity is registered once."""
    first = evidence.groupBy(kind, identity).agg(F.min(order).alias(order))
    prefix = F.create_map(*[F.lit(x) for pair in prefixes.items() for x in pair])
    placed = numbered(first, order=[order, identity], by=[kind])
    name = F.format_string("%s-%03d", F.element_at(prefix, F.col(kind)), F.col("position"))
    return placed.select(name.alias("evidence_id"), kind, identity, order)


def citations(claims: DataFrame, *, ids: str = "evidence_ids") -> DataFrame:
    """One row per claim and cited id, with the number of times it is cited."""
    return (
        claims.select("claim_id", F.explode(ids).alias("evidence_id"))
        .groupBy("claim_id", "evidence_id")
        .agg(F.count("*").alias("times"))
    )


def reference_problems(
    claims: DataFrame, evidence: DataFrame, *, ids: str = "evidence_ids", require_verified: bool = True
) -> DataFrame:
    """Claims without a citation, and cited ids that repeat, are unknown or are not verified."""
    cited = citations(claims, ids=ids)
    known = evidence.select("evidence_id", F.col("verified").alias("_verified"), F.lit(True).alias("_known"))
    met = cited.join(known, "evidence_id", "left")
    problems = F.array_compact(
        F.array(
            F.when(F.col("times") > 1, "repeated"),
            F.when(F.col("_known").isNull(), "unknown"),
            F.when(F.lit(require_verified) & F.col("_known") & ~F.coalesce("_verified", F.lit(False)), "not verified"),
        )
    )
    none = claims.filter(F.coalesce(F.size(ids), F.lit(0)) <= 0).select(
        "claim_id", F.lit(None).cast(evidence.schema["evidence_id"].dataType).alias("evidence_id"),
        F.lit("no citation").alias("problem"),
    )
    return met.select("claim_id", "evidence_id", F.explode(problems).alias("problem")).unionByName(none)


def normal_number(token: Column) -> Column:
    """A number token in a form in which equal numbers read equal: twelve significant digits.

    A percentage keeps its digits as written.
    """
    plain = F.regexp_replace(F.regexp_replace(token, ",", ""), r"^\++", "")
    return F.when(plain.endswith("%"), plain).otherwise(F.format_string("%.11e", plain.cast("double")))


def numbers_in(text: Column | str) -> Column:
    """Distinct normalised numbers of a whole text."""
    tokens = F.regexp_extract_all(col(text), F.lit(NUMBER), F.lit(0))
    return F.array_distinct(F.transform(tokens, normal_number))


def metric_forms(value: Column | str) -> Column:
    """The ways a metric value may be quoted: itself, two decimals, and as a percentage."""
    v = as_double(value)
    return F.array(
        F.format_string("%.11e", v),
        normal_number(F.format_string("%.2f", v)),
        F.format_string("%.1f%%", v * 100),
        F.format_string("%.2f%%", v * 100),
    )


def evidence_numbers(evidence: DataFrame, *, text: str = "text", metrics: str | None = None) -> DataFrame:
    """Distinct (evidence, number) rows from the text and from an array of metric values."""
    found = numbers_in(text)
    if metrics is not None:
        forms = F.flatten(F.transform(F.coalesce(col(metrics), F.array().cast("array<double>")), metric_forms))
        found = F.concat(found, forms)
    return evidence.select("evidence_id", F.explode(F.array_distinct(found)).alias("number"))


def ungrounded_numbers(
    claims: DataFrame,
    evidence: DataFrame,
    *,
    ids: str = "evidence_ids",
    statement: str = "statement",
    text: str = "text",
    metrics: str | None = None,
) -> DataFrame:
    """Numbers of a claim that none of its cited evidence holds.

    Evidence keeps only numbers that some claim says before citations repeat it, so a claim of many numbers and many
    citations meets the numbers its evidence holds, not all of its own for each citation.
    """
    said = claims.select("claim_id", F.explode(numbers_in(statement)).alias("number"))
    held = evidence_numbers(evidence, text=text, metrics=metrics)
    useful = held.join(said.select("number").distinct(), "number", "left_semi")
    cited = citations(claims, ids=ids).select("claim_id", "evidence_id").join(useful, "evidence_id")
    grounded = cited.select("claim_id", "number").distinct()
    return said.join(grounded, ["claim_id", "number"], "left_anti")


def causal_wording(statement: Column | str) -> Column:
    """Causal wording that is not denied."""
    return col(statement).rlike(CAUSAL) & ~col(statement).rlike(DENIED_CAUSAL)


def _cited_facts(claims: DataFrame, evidence: DataFrame, ids: str) -> DataFrame:
    """Per claim: whether all cited evidence is documents, and whether any supports causes."""
    facts = evidence.select(
        "evidence_id",
        (F.col("kind") == "document").alias("_document"),
        (F.col("causal_support") if "causal_support" in evidence.columns else F.lit(False)).alias("_causal"),
    )
    return (
        citations(claims, ids=ids)
        .join(facts, "evidence_id")
        .groupBy("claim_id")
        .agg(F.bool_and("_document").alias("document_only"), F.bool_or("_causal").alias("causal_support"))
    )


def unsupported_causes(
    claims: DataFrame, evidence: DataFrame, *, ids: str = "evidence_ids", statement: str = "statement"
) -> DataFrame:
    """Claims with causal wording and no cited evidence that supports causes."""
    return (
        claims.filter(causal_wording(statement))
        .select("claim_id")
        .join(_cited_facts(claims, evidence, ids).filter("causal_support"), "claim_id", "left_anti")
    )


def document_only_problems(
    claims: DataFrame,
    evidence: DataFrame,
    *,
    ids: str = "evidence_ids",
    statement: str = "statement",
    metadata: str = "metadata",
) -> DataFrame:
    """Claims on documents alone that are findings, or hold numbers outside the documents' metadata."""
    alone = _cited_facts(claims, evidence, ids).filter("document_only").select("claim_id")
    chosen = claims.join(alone, "claim_id", "left_semi")
    findings = chosen.filter(F.col("claim_type") == "finding").select(
        "claim_id", F.lit("finding on documents alone").alias("problem")
    )
    outside = ungrounded_numbers(chosen, evidence, ids=ids, statement=statement, text=metadata)
    return findings.unionByName(
        outside.select("claim_id").distinct().select("claim_id", F.lit("number on documents alone").alias("problem"))
    )


def narrative_problems(claims: DataFrame, evidence: DataFrame, *, ids: str = "evidence_ids") -> DataFrame:
    """Reports whose summary cites documents alone, or none of whose findings cites analysis.

    ``claims`` holds ``report_id`` and ``role`` (``summary``, ``finding`` or ``recommendation``).
    """
    facts = claims.select("claim_id", "report_id", "role").join(
        _cited_facts(claims, evidence, ids).select("claim_id", "document_only"), "claim_id"
    )
    per_report = facts.groupBy("report_id").agg(
        F.bool_or((F.col("role") == "summary") & F.col("document_only")).alias("summary_alone"),
        F.coalesce(F.bool_or((F.col("role") == "finding") & ~F.col("document_only")), F.lit(False)).alias("any_finding"),
    )
    problems = F.array_compact(
        F.array(
            F.when(F.col("summary_alone"), "summary cites documents alone"),
            F.when(~F.col("any_finding"), "no finding cites analysis"),
        )
    )
    return per_report.select("report_id", F.explode(problems).alias("problem"))


# --- long-form evidence ----------------------------------------------------------------------


def quality_evidence(validation: DataFrame, cleaning: DataFrame) -> DataFrame:
    """Broken rules, warnings and cleaning actions as (metric, value, unit) rows."""
    broken = F.col("violations") > 0
    checks = validation.agg(
        F.count_if(broken & (F.col("severity") == ERROR)).alias("validation_errors"),
        F.count_if(broken & (F.col("severity") == WARNING)).alias("validation_warnings"),
    )
    names = {
        "duplicates_removed": "duplicate_events_removed",
        "industries_filled": "industries_filled",
        "scores_left_missing": "missing_satisfaction_retained",
    }
    mapped = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    actions = cleaning.filter(F.col("measure").isin(*names)).select(
        F.element_at(mapped, F.col("measure")).alias("metric"), F.col("value").cast("bigint").alias("value"),
        F.lit("rows").alias("unit"),
    )
    rules = checks.unpivot([], checks.columns, "metric", "value").select("metric", "value", F.lit("checks").alias("unit"))
    return rules.unionByName(actions)


def test_evidence(tests: DataFrame, names: Sequence[str] = ()) -> DataFrame:
    """Statistic, p-value and effect of each test as (metric, value, unit) rows."""
    chosen = tests.filter(F.col("test").isin(*names)) if names else tests
    rows = [
        ("statistic", F.col("statistic"), F.lit("test_statistic")),
        ("p_value", F.col("p_value"), F.lit("probability")),
        ("effect_size", F.col("effect_size"), F.col("effect_size_name")),
    ]
    return reduce(
        lambda a, b: a.unionByName(b),
        [
            chosen.select(
                F.concat("test", F.lit(f".{what}")).alias("metric"), value.alias("value"), unit.alias("unit")
            )
            for what, value, unit in rows
        ],
    )
