import pytest

from tallygrain.operators import audits


@pytest.fixture(scope="module")
def evidence(spark):
    return spark.createDataFrame(
        [
            ("SQL-001", "sql", "Revenue was 1,200.50 and cost 10%", "", True, False, [0.125, 300.0]),
            ("DOC-001", "document", "A note with 77 words", "page 3, 2024", True, False, []),
            ("ML-001", "machine_learning", "no digits", "", False, True, []),
        ],
        "evidence_id string, kind string, text string, metadata string, verified boolean, causal_support boolean, metrics array<double>",
    )


def claims(spark, rows):
    return spark.createDataFrame(rows, "claim_id string, statement string, claim_type string, evidence_ids array<string>")


def test_ids_count_per_kind_and_register_once(spark):
    rows = [("document", "c2", 1), ("document", "c1", 2), ("document", "c2", 3), ("sql", "q", 4), ("forecast", "f", 5)]
    got = audits.evidence_ids(spark.createDataFrame(rows, "kind string, what string, at int"), identity="what", order="at").collect()
    assert {r.what: r.evidence_id for r in got} == {"c2": "DOC-001", "c1": "DOC-002", "q": "SQL-001", "f": "FORECAST-001"}


def test_reference_problems(spark, evidence):
    rows = claims(spark, [
        ("a", "", "finding", ["SQL-001"]), ("b", "", "finding", ["SQL-001", "SQL-001"]),
        ("c", "", "finding", ["XXX-001"]), ("d", "", "finding", ["ML-001"]), ("e", "", "finding", []),
    ])
    got = {(r.claim_id, r.problem) for r in audits.reference_problems(rows, evidence).collect()}
    assert got == {("b", "repeated"), ("c", "unknown"), ("d", "not verified"), ("e", "no citation")}
    assert ("d", "not verified") not in {
        (r.claim_id, r.problem) for r in audits.reference_problems(rows, evidence, require_verified=False).collect()
    }


@pytest.mark.parametrize(
    "text, numbers",
    [
        ("1,200.50 equals 1200.5", ["1.20050000000e+03"]),
        ("A12 and -3 and +4", ["2.00000000000e+00", "-3.00000000000e+00", "4.00000000000e+00"]),
        ("up 5% or +5%, not 5", ["5%", "5.00000000000e+00"]),
        ("none", []),
    ],
)
def test_numbers(spark, text, numbers):
    assert spark.createDataFrame([(text,)], "t string").select(audits.numbers_in("t")).first()[0] == numbers


def test_grounding(spark, evidence):
    rows = claims(spark, [
        ("a", "Revenue 1200.5 rose 10%", "finding", ["SQL-001"]),
        ("b", "Revenue 1200.5 and 9", "finding", ["SQL-001", "DOC-001"]),
        ("c", "A share of 12.5% or 12.50%, 300 in all", "finding", ["SQL-001"]),
        ("d", "It was 5", "finding", []),
    ])
    plain = {(r.claim_id, r.number) for r in audits.ungrounded_numbers(rows, evidence).collect()}
    assert {c for c, _ in plain} == {"b", "c", "d"} and ("b", "9.00000000000e+00") in plain
    metric = {r.claim_id for r in audits.ungrounded_numbers(rows, evidence, metrics="metrics").collect()}
    assert metric == {"b", "d"}


def test_a_claim_of_many_numbers_and_citations(spark):
    """A thousand of each: numbers meet what the evidence holds, not every citation."""
    said = " ".join(str(i) for i in range(1000))
    evidence = spark.createDataFrame([(f"SQL-{i:03d}", f"value {i * 2} and -{i}.5") for i in range(1, 1001)], "evidence_id string, text string")
    rows = claims(spark, [("a", said, "finding", [f"SQL-{i:03d}" for i in range(1, 1001)]), ("b", "7", "finding", ["SQL-003"])])
    got = audits.ungrounded_numbers(rows, evidence)
    assert {(r.claim_id, float(r.number)) for r in got.collect()} == {("a", float(i)) for i in range(1000) if i % 2 or not i} | {("b", 7.0)}


def test_causal_wording(spark, evidence):
    rows = claims(spark, [
        ("a", "Delays caused churn", "finding", ["SQL-001"]),
        ("b", "This does not show that delays caused churn", "finding", ["SQL-001"]),
        ("c", "Delays LED TO churn", "finding", ["SQL-001", "ML-001"]),
        ("d", "Because of delays", "finding", ["SQL-001"]),
        ("e", "Not this. Delays drove churn", "finding", []),
    ])
    assert {r.claim_id for r in audits.unsupported_causes(rows, evidence).collect()} == {"a", "e"}


def test_documents_alone(spark, evidence):
    rows = claims(spark, [
        ("a", "As noted", "finding", ["DOC-001"]),
        ("b", "On page 3 of 2024", "context", ["DOC-001"]),
        ("c", "There are 77 words", "context", ["DOC-001"]),
        ("d", "There are 77 words", "finding", ["DOC-001", "SQL-001"]),
    ])
    got = {(r.claim_id, r.problem) for r in audits.document_only_problems(rows, evidence).collect()}
    assert got == {("a", "finding on documents alone"), ("c", "number on documents alone")}


def test_narratives(spark, evidence):
    rows = spark.createDataFrame(
        [
            ("a", 1, "summary", ["DOC-001"]), ("b", 1, "finding", ["SQL-001"]),
            ("c", 2, "summary", ["SQL-001"]), ("d", 2, "finding", ["DOC-001"]),
            ("e", 3, "summary", ["SQL-001"]), ("f", 3, "finding", ["DOC-001", "SQL-001"]),
        ],
        "claim_id string, report_id int, role string, evidence_ids array<string>",
    )
    got = {(r.report_id, r.problem) for r in audits.narrative_problems(rows, evidence).collect()}
    assert got == {(1, "summary cites documents alone"), (2, "no finding cites analysis")}
