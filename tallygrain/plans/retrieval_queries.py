"""Registered document, vector and evidence-audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrain.functions.ranking import numbered
from tallygrain.operators import audits, cleaning, contracts, retrieval as rt, statistics as st
from tallygrain.plans.base import Registry, rounded
from tallygrain.plans.contract_queries import ALL_ROLES, ALLOWED, VALIDATE_SQL, _with_gaps, cleaning_sql
from tallygrain.sources import roles

RETRIEVAL = Registry()

DIMENSIONS = 64

# Blanks and line ends as in the cleaning rule, written for RE2.
_B = r"[ \t\x{1F}\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"


def clean_sql(text: str) -> str:
    steps = [
        (r"\r\n|[\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]", r"\n"),
        (r"[ \t]+", " "),
        (rf"{_B}*\n{_B}*", r"\n"),
        (r"\n{3,}", r"\n\n"),
        (rf"\A(?:{_B}|\n)+|(?:{_B}|\n)+\z", ""),
    ]
    for pattern, new in steps:
        put = "''" if new == "" else "repeat(chr(10), 2)" if new == r"\n\n" else "chr(10)" if new == r"\n" else f"'{new}'"
        text = f"regexp_replace({text}, '{pattern}', {put}, 'g')"
    return text


# Noise that gives the cleaning rule something to do, the same on both sides.
NOISY_SQL = "replace(replace(text, '. ', chr(10) || chr(9) || chr(10) || '  ' || chr(10) || ' .  '), ',', chr(13) || chr(10)) || chr(160)"


def _noisy():
    text = F.replace(F.col("text"), F.lit(". "), F.lit("\n\t\n  \n .  "))
    return F.concat(F.replace(text, F.lit(","), F.lit("\r\n")), F.lit("\u00a0"))


@RETRIEVAL.add("clean_text", f"SELECT doc_id, sha256({clean_sql(NOISY_SQL)}) AS hash, length({clean_sql(NOISY_SQL)}) AS chars FROM documents")
def clean_text(spark, folder):
    cleaned = roles.table(spark, folder, "documents").select("doc_id", rt.clean_text(_noisy()).alias("text"))
    return cleaned.select("doc_id", F.sha2("text", 256).alias("hash"), F.length("text").cast("bigint").alias("chars"))


# Sentences become paragraphs, and every third line a heading, so that there are sections to find.
MARKED_SQL = r"""array_to_string(list_transform(string_split(text, chr(10)), lambda line, i:
  CASE WHEN i % 3 = 0 THEN '## ' || left(line, 12) || ' x' ELSE replace(line, '. ', chr(10) || chr(10)) END), chr(10))"""


def _marked():
    def mark(line, i):
        return F.when((i + 1) % 3 == 0, F.concat(F.lit("## "), F.substring(line, 1, 12), F.lit(" x"))).otherwise(
            F.replace(line, F.lit(". "), F.lit("\n\n"))
        )

    return F.array_join(F.transform(F.split("text", "\n"), mark), "\n")


SECTION_SQL = rf"""
SELECT doc_id, section, sha256(body) AS body_hash, length(body) AS chars, len(string_split(body, repeat(chr(10), 2))) AS paragraphs
FROM (
  SELECT doc_id, heading AS section, {clean_sql("body")} AS body FROM (
    SELECT doc_id, g, coalesce(max(heading), 'Doc ' || doc_id) AS heading,
      coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE heading IS NULL), '') AS body
    FROM (
      SELECT *, sum(CASE WHEN heading IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (
        SELECT doc_id, i, line, CASE WHEN regexp_matches(line, '^#{{1,6}}\s+\S')
          THEN trim(regexp_extract(line, '^#{{1,6}}\s+(.*)$', 1)) END AS heading
        FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i
          FROM (SELECT doc_id, {clean_sql(MARKED_SQL)} AS t FROM documents))))
    GROUP BY doc_id, g))
WHERE body <> ''"""


@RETRIEVAL.add("sections", SECTION_SQL)
def sections(spark, folder):
    marked = roles.table(spark, folder, "documents").select(
        "doc_id", F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), _marked().alias("text")
    )
    parts = marked.select("doc_id", F.inline(rt.sections("text", "title")))
    body = F.array_join("paragraphs", "\n\n")
    return parts.select(
        "doc_id", "section", F.sha2(body, 256).alias("body_hash"), F.length(body).cast("bigint").alias("chars"),
        F.size("paragraphs").cast("bigint").alias("paragraphs"),
    )


def _chunks(spark, folder):
    documents = roles.table(spark, folder, "documents").select(
        "doc_id", F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), "lang",
        rt.line_section("text", "source").alias("parts"),
    )
    return rt.chunk_documents(documents, key="doc_id", title="title", parts="parts", carry=["lang"])


# The chunking fold as a recursion over the lines of each document.
CHUNK_SQL = f"""WITH RECURSIVE
  lines AS (
    SELECT doc_id, lang, source, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i FROM (
      SELECT doc_id, lang, source, unnest(string_split(t, chr(10))) AS line,
        generate_subscripts(string_split(t, chr(10)), 1) AS line_no
      FROM (SELECT *, {clean_sql("text")} AS t FROM documents)) WHERE line <> ''),
  docs AS (SELECT doc_id, any_value(lang) AS lang, any_value(source) AS source, count(*) AS n_lines,
    'Document: Doc ' || doc_id || chr(10) || 'Section: ' || any_value(source) || chr(10) || chr(10) AS prefix
    FROM lines GROUP BY doc_id),
  fold AS (
    SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS first, 0::BIGINT AS n, 0::BIGINT AS chars,
      NULL::BIGINT AS a_first, NULL::BIGINT AS a_n, NULL::BIGINT AS a_chars,
      NULL::BIGINT AS b_first, NULL::BIGINT AS b_n, NULL::BIGINT AS b_chars FROM docs
    UNION ALL
    SELECT doc_id, i, m_first, CASE WHEN closes THEN 0 ELSE m_n END, m_chars,
      CASE WHEN passes THEN first END, CASE WHEN passes THEN n END, CASE WHEN passes THEN chars END,
      CASE WHEN closes THEN m_first END, CASE WHEN closes THEN m_n END, CASE WHEN closes THEN m_chars END
    FROM (SELECT *, greatest(ceil((lead_chars + m_chars) / 4.0), 1)   >= 550 AS closes FROM (
      SELECT *, CASE WHEN passes OR n = 0 THEN i ELSE first END AS m_first, CASE WHEN passes THEN 1 ELSE n + 1 END AS m_n,
        CASE WHEN passes OR n = 0 THEN len ELSE chars + 2 + len END AS m_chars FROM (
        SELECT f.doc_id, l.i, f.first, f.n, f.chars, length(l.line) AS len, length(d.prefix) AS lead_chars,
          f.n > 0 AND greatest(ceil((length(d.prefix) + f.chars + 2 + length(l.line)) / 4.0), 1) > 700 AS passes
        FROM fold f JOIN lines l ON l.doc_id = f.doc_id AND l.i = f.i + 1 JOIN docs d ON d.doc_id = f.doc_id)))
  ),
  closed AS (
    SELECT doc_id, a_first AS first, a_n AS n, a_chars AS chars FROM fold WHERE a_n IS NOT NULL
    UNION ALL SELECT doc_id, b_first, b_n, b_chars FROM fold WHERE b_n IS NOT NULL),
  ends AS (SELECT f.doc_id, f.first, f.n, f.chars, d.prefix FROM fold f JOIN docs d ON d.doc_id = f.doc_id
    WHERE f.i = d.n_lines AND f.n > 0),
  final_closed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first DESC) = 1 AS is_last FROM closed),
  merged AS (SELECT c.doc_id, c.first FROM final_closed c JOIN ends e ON e.doc_id = c.doc_id AND c.is_last
    WHERE greatest(ceil((length(prefix) + e.chars) / 4.0), 1) < 275
      AND greatest(ceil((length(prefix) + c.chars + 2 + e.chars) / 4.0), 1) <= 700),
  pieces AS (
    SELECT c.doc_id, c.first, c.n + coalesce(e.n, 0) AS n FROM closed c
      LEFT JOIN merged m ON m.doc_id = c.doc_id AND m.first = c.first
      LEFT JOIN ends e ON e.doc_id = m.doc_id
    UNION ALL SELECT doc_id, first, n FROM ends WHERE doc_id NOT IN (SELECT doc_id FROM merged)),
  chunks AS (
    SELECT p.doc_id AS document_id, any_value(d.lang) AS lang, any_value(d.source) AS section, p.first,
      any_value(d.prefix) || string_agg(l.line, repeat(chr(10), 2) ORDER BY l.i) AS content
    FROM pieces p JOIN docs d ON d.doc_id = p.doc_id
    JOIN lines l ON l.doc_id = p.doc_id AND l.i >= p.first AND l.i < p.first + p.n GROUP BY p.doc_id, p.first),
  chunked AS (SELECT *, CAST(row_number() OVER (PARTITION BY document_id ORDER BY first) AS INTEGER) AS chunk_index
    FROM chunks),
  final AS (SELECT document_id || '-C' || CASE WHEN chunk_index < 1000 THEN lpad(CAST(chunk_index AS VARCHAR), 3, '0')
      ELSE CAST(chunk_index AS VARCHAR) END AS chunk_id, document_id, lang, section, chunk_index, content,
    sha256(content) AS content_hash, CAST(greatest(ceil(length(content) / 4.0), 1) AS INTEGER) AS estimated_tokens
    FROM chunked)"""


@RETRIEVAL.add(
    "chunk_documents",
    f"{CHUNK_SQL} SELECT chunk_id, document_id, lang, section, chunk_index, content_hash, estimated_tokens FROM final",
)
def chunk_documents(spark, folder):
    return _chunks(spark, folder).drop("document_title", "content")


@RETRIEVAL.add(
    "corpus_summary",
    f"""{CHUNK_SQL} SELECT count(DISTINCT document_id) AS documents, count(*) AS chunks,
      min(estimated_tokens) AS smallest_chunk_tokens, max(estimated_tokens) AS largest_chunk_tokens,
      CAST(sum(estimated_tokens) AS BIGINT) AS estimated_tokens FROM final""",
)
def corpus_summary(spark, folder):
    return rt.corpus_summary(_chunks(spark, folder))


@RETRIEVAL.add(
    "chunk_id_rules",
    f"""{CHUNK_SQL} SELECT 'chunks' AS "table", 'chunk_id is null' AS rule, 'error' AS severity,
      count(*) - count(chunk_id) AS violations FROM final
    UNION ALL SELECT 'chunks', 'chunk_id repeats', 'error', count(chunk_id) - count(DISTINCT chunk_id) FROM final""",
)
def chunk_id_rules(spark, folder):
    return contracts.key_rules(_chunks(spark, folder), "chunks", "chunk_id")


@RETRIEVAL.add(
    "documents_without_chunks",
    f"""SELECT doc_id AS document_id FROM documents
    WHERE {clean_sql("CASE WHEN doc_id % 9 = 0 THEN ' ' || chr(9) || chr(10) ELSE text END")} = ''""",
)
def documents_without_chunks(spark, folder):
    blanked = F.when(F.col("doc_id") % 9 == 0, " \t\n").otherwise(F.col("text"))
    documents = roles.table(spark, folder, "documents").withColumn("text", blanked)
    parts = documents.select("doc_id", "source", rt.line_section("text", "source").alias("parts"))
    chunks = rt.chunk_documents(parts, key="doc_id", title="source", parts="parts")
    return rt.documents_without_chunks(documents, "doc_id", chunks)


def _keyed_vectors(spark, folder):
    return roles.table(spark, folder, "embeddings").select(F.col("vec_id").alias("document_id"), "embedding")


@RETRIEVAL.add(
    "attach_vectors",
    f"""{CHUNK_SQL} SELECT chunk_id, 'fixture' AS embedding_model, 64 AS embedding_dimensions,
      round(CAST(embedding[1] AS DOUBLE), 9) AS first_value FROM final JOIN embeddings ON vec_id = document_id""",
)
def attach_vectors(spark, folder):
    attached = rt.attach_vectors(
        _chunks(spark, folder), _keyed_vectors(spark, folder), "document_id", model="fixture", dimensions=DIMENSIONS,
        check=False,
    )
    return attached.select(
        "chunk_id", "embedding_model", "embedding_dimensions",
        F.round(F.col("embedding")[0].cast("double"), 9).alias("first_value"),
    )


@RETRIEVAL.add(
    "chunks_without_vectors",
    f"{CHUNK_SQL} SELECT chunk_id FROM final WHERE document_id NOT IN (SELECT vec_id FROM embeddings)",
)
def chunks_without_vectors(spark, folder):
    missing = rt.chunks_without_vectors(_chunks(spark, folder), _keyed_vectors(spark, folder), "document_id")
    return missing.select("chunk_id")


def _spoiled(spark, folder):
    v = F.col("embedding")
    spoiled = (
        F.when(F.col("vec_id") % 50 == 0, F.slice(v, 1, 10))
        .when(F.col("vec_id") % 70 == 0, F.concat(F.slice(v, 1, 63), F.array(F.lit(float("nan")).cast("float"))))
        .otherwise(v)
    )
    return roles.table(spark, folder, "embeddings").select("vec_id", spoiled.alias("embedding"))


# Documents play the chunks. Every 30th vector stands there twice.
@RETRIEVAL.add(
    "vector_rejects",
    """SELECT doc_id, CASE WHEN vec_id IS NULL THEN 'missing' WHEN vec_id % 30 = 0 THEN 'repeated'
      WHEN vec_id % 50 = 0 THEN 'wrong size' ELSE 'not finite' END AS problem
    FROM documents LEFT JOIN embeddings ON vec_id = doc_id
    WHERE vec_id IS NULL OR vec_id % 30 = 0 OR vec_id % 50 = 0 OR vec_id % 70 = 0""",
)
def vector_rejects(spark, folder):
    vectors = _spoiled(spark, folder).withColumnRenamed("vec_id", "doc_id")
    vectors = vectors.unionByName(vectors.filter("doc_id % 30 = 0"))
    documents = roles.table(spark, folder, "documents").select("doc_id")
    return rt.vector_rejects(documents, vectors, "doc_id", DIMENSIONS)


# Every 50th vector is cut short and every 70th gets a value that is not a number.
@RETRIEVAL.add(
    "vector_problems",
    """SELECT vec_id, CASE WHEN vec_id % 50 = 0 THEN 'wrong size' ELSE 'not finite' END AS problem FROM embeddings
    WHERE vec_id % 50 = 0 OR vec_id % 70 = 0""",
)
def vector_problems(spark, folder):
    return rt.vector_problems(_spoiled(spark, folder), "vec_id", "embedding", DIMENSIONS)


def search_sql(query: str, where: str, floor: float, k: int) -> str:
    return f"""SELECT query_id, vec_id, round(s, 6) AS similarity_score, CAST(place AS INTEGER) AS place FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS place FROM (
        SELECT q.vec_id AS query_id, e.vec_id,
          list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS s
        FROM embeddings q, embeddings e WHERE {query} AND {where}) WHERE s >= {floor}) WHERE place <= {k}"""


def _queries(spark, folder, rule):
    return roles.table(spark, folder, "embeddings").filter(rule).select(F.col("vec_id").alias("query_id"), "embedding")


# A label plays the embedding model of the filter.
@RETRIEVAL.add("search_one", search_sql("q.vec_id = 7", "e.label = (SELECT label FROM embeddings WHERE vec_id = 7)", 0.0, 5))
def search_one(spark, folder):
    vectors = roles.table(spark, folder, "embeddings")
    label = vectors.filter("vec_id = 7").select("label").scalar()
    found = rt.search(
        vectors.filter(F.col("label") == label), _queries(spark, folder, "vec_id = 7"), key="vec_id",
        dimensions=DIMENSIONS,
    )
    return rounded(found, 6, "similarity_score")


@RETRIEVAL.add("search_many", search_sql("q.vec_id < 10", "TRUE", 0.1, 20))
def search_many(spark, folder):
    found = rt.search(
        roles.table(spark, folder, "embeddings"), _queries(spark, folder, "vec_id < 10"), key="vec_id",
        dimensions=DIMENSIONS, top_k=20, min_similarity=0.1,
    )
    return rounded(found, 6, "similarity_score")


@RETRIEVAL.add("search_all", search_sql("TRUE", "TRUE", -1.0, 5))
def search_all(spark, folder):
    """Every vector asks, in several blocks."""
    found = rt.search(
        roles.table(spark, folder, "embeddings"), _queries(spark, folder, "true"), key="vec_id",
        dimensions=DIMENSIONS, min_similarity=-1.0, block_numbers=200 * DIMENSIONS,
    )
    return rounded(found, 6, "similarity_score")


@RETRIEVAL.add(
    "relevance_label",
    """SELECT doc_id, concat_ws(' · ', upper(left(lang, 1)) || substring(lang, 2) || ' Notes',
      CASE WHEN doc_id % 3 = 0 THEN 'company-wide' ELSE 'EUROPE, ASIA' END,
      CASE WHEN doc_id % 2 = 0 THEN 'from ' || source || ', net revenue' END) AS business_relevance FROM documents""",
)
def relevance_label(spark, folder):
    empty = F.array().cast("array<string>")
    regions = F.when(F.col("doc_id") % 3 != 0, F.array(F.lit("EUROPE"), F.lit("ASIA"))).otherwise(empty)
    topics = F.when(
        F.col("doc_id") % 2 == 0, F.array(F.concat(F.lit("from_"), F.col("source")), F.lit("net_revenue"))
    ).otherwise(empty)
    label = rt.relevance_label(F.concat("lang", F.lit("_notes")), regions, topics)
    return roles.table(spark, folder, "documents").select("doc_id", label.alias("business_relevance"))


# --- evidence audits -------------------------------------------------------------------------

KIND_SQL = "CASE lang WHEN 'en' THEN 'sql' WHEN 'fr' THEN 'document' WHEN 'de' THEN 'statistics' ELSE 'forecast' END"
PREFIX_SQL = "CASE lang WHEN 'en' THEN 'SQL' WHEN 'fr' THEN 'DOC' WHEN 'de' THEN 'STAT' ELSE 'FORECAST' END"


def _kind():
    return F.when(F.col("lang") == "en", "sql").when(F.col("lang") == "fr", "document").when(
        F.col("lang") == "de", "statistics"
    ).otherwise("forecast")


@RETRIEVAL.add(
    "evidence_ids",
    f"""SELECT {PREFIX_SQL} || '-' || CASE WHEN place < 1000 THEN lpad(CAST(place AS VARCHAR), 3, '0')
        ELSE CAST(place AS VARCHAR) END AS evidence_id, {KIND_SQL} AS kind, hash, doc_id
    FROM (SELECT *, row_number() OVER (PARTITION BY {KIND_SQL} ORDER BY doc_id, hash) AS place FROM (
      SELECT any_value(lang) AS lang, sha256(text) AS hash, min(doc_id) AS doc_id FROM documents
      GROUP BY {KIND_SQL}, sha256(text)))""",
)
def evidence_ids(spark, folder):
    evidence = roles.table(spark, folder, "documents").select(
        _kind().alias("kind"), F.sha2("text", 256).alias("hash"), "doc_id"
    )
    return audits.evidence_ids(evidence, identity="hash", order="doc_id")


# A claim is a document; it cites the document before it in its source, one fixed other, and
# sometimes the first again. Its statement is its text and length, with planted causal wording.
CLAIMS_SQL = f"""
  placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents),
  claims AS (SELECT d.doc_id AS claim_id,
      replace(replace(d.text, ' on ', ' driven '), ' the ', ' not ') || ' ' || d.n_chars || ' ' || (d.n_chars / 8.0::DOUBLE) || ' ' || d.doc_id AS statement,
      CASE WHEN d.doc_id % 4 = 0 THEN 'finding' ELSE 'context' END AS claim_type,
      list_filter([p.doc_id, CASE WHEN d.doc_id % 6 = 0 THEN p.doc_id END, (d.doc_id * 3) % 1100], lambda x: x IS NOT NULL)
        AS evidence_ids
    FROM placed d LEFT JOIN placed p ON p.source = d.source AND p.place = d.place - 1),
  evidence AS (SELECT doc_id AS evidence_id, {KIND_SQL} AS kind, text || ' ' || (doc_id + 20) AS text, doc_id % 10 <> 3 AS verified,
    doc_id % 5 = 0 AS causal_support, 'page ' || (n_chars + 1) AS metadata FROM documents)"""


def _claims(spark, folder):
    documents = roles.table(spark, folder, "documents")
    # Positions per source come from distributed numbering, since one source may hold a third of all rows.
    places = numbered(documents.select("doc_id", "source"), order=["doc_id"], by=["source"], name="place")
    before = places.select("source", (F.col("place") + 1).alias("place"), F.col("doc_id").alias("_before"))
    linked = places.join(before, ["source", "place"], "left").select("doc_id", "_before")
    statement = F.replace(
        F.replace(F.col("text"), F.lit(" on "), F.lit(" driven ")), F.lit(" the "), F.lit(" not ")
    )
    return documents.join(linked, "doc_id").select(
        F.col("doc_id").alias("claim_id"),
        F.concat_ws(
            " ", statement, *[c.cast("string") for c in (F.col("n_chars"), F.col("n_chars") / 8, F.col("doc_id"))]
        ).alias("statement"),
        F.when(F.col("doc_id") % 4 == 0, "finding").otherwise("context").alias("claim_type"),
        F.array_compact(
            F.array("_before", F.when(F.col("doc_id") % 6 == 0, F.col("_before")), F.col("doc_id") * 3 % 1100)
        ).alias("evidence_ids"),
    )


def _evidence(spark, folder):
    return roles.table(spark, folder, "documents").select(
        F.col("doc_id").alias("evidence_id"),
        _kind().alias("kind"),
        F.concat_ws(" ", "text", (F.col("doc_id") + 20).cast("string")).alias("text"),
        (F.col("doc_id") % 10 != 3).alias("verified"),
        (F.col("doc_id") % 5 == 0).alias("causal_support"),
        F.concat_ws(" ", F.lit("page"), (F.col("n_chars") + 1).cast("string")).alias("metadata"),
    )


CITED_SQL = """cited AS (SELECT claim_id, evidence_id, count(*) AS times FROM
    (SELECT claim_id, unnest(evidence_ids) AS evidence_id FROM claims) GROUP BY ALL)"""


@RETRIEVAL.add(
    "reference_problems",
    f"""WITH {CLAIMS_SQL}, {CITED_SQL}
    SELECT claim_id, evidence_id, 'repeated' AS problem FROM cited WHERE times > 1
    UNION ALL SELECT claim_id, evidence_id, 'unknown' FROM cited WHERE evidence_id NOT IN (SELECT evidence_id FROM evidence)
    UNION ALL SELECT claim_id, evidence_id, 'not verified' FROM cited JOIN evidence USING (evidence_id) WHERE NOT verified
    UNION ALL SELECT claim_id, NULL, 'no citation' FROM claims WHERE len(evidence_ids) = 0""",
)
def reference_problems(spark, folder):
    return audits.reference_problems(_claims(spark, folder), _evidence(spark, folder))


# RE2 has no look-behind: the sign or digit right after a letter is blanked, as no number starts there.
def numbers_sql(text: str) -> str:
    tokens = (
        rf"regexp_extract_all(regexp_replace({text}, '([A-Za-z])[-+0-9]', '\1 ', 'g'),"
        r" '[-+]?[0-9][0-9,]*(?:\.[0-9]+)?%?')"
    )
    plain = r"regexp_replace(replace(x, ',', ''), '^\++', '')"
    return (
        f"list_distinct(list_transform({tokens}, lambda x: CASE WHEN {plain} LIKE '%!%' ESCAPE '!' THEN {plain}"
        f" ELSE format('{{:.11e}}', CAST({plain} AS DOUBLE)) END))"
    )


UNGROUNDED_SQL = f"""said AS (SELECT claim_id, unnest({numbers_sql('statement')}) AS number FROM claims),
  held AS (SELECT evidence_id, unnest({numbers_sql('text')}) AS number FROM evidence)"""


@RETRIEVAL.add(
    "numbers_in_claims",
    f"WITH {CLAIMS_SQL} SELECT claim_id, unnest({numbers_sql('statement')}) AS number FROM claims",
)
def numbers_in_claims(spark, folder):
    return _claims(spark, folder).select("claim_id", F.explode(audits.numbers_in("statement")).alias("number"))


@RETRIEVAL.add(
    "ungrounded_numbers",
    f"""WITH {CLAIMS_SQL}, {CITED_SQL}, {UNGROUNDED_SQL}
    SELECT claim_id, number FROM said WHERE NOT EXISTS (SELECT 1 FROM cited c JOIN held h ON h.evidence_id = c.evidence_id
      WHERE c.claim_id = said.claim_id AND h.number = said.number)""",
)
def ungrounded_numbers(spark, folder):
    return audits.ungrounded_numbers(_claims(spark, folder), _evidence(spark, folder))


WORDS = "(caused?|causing|drove|driven|led to|resulted in|responsible for)"
CAUSAL_SQL = (
    rf"(regexp_matches(statement, '(?i)\b{WORDS}\b') AND NOT regexp_matches(statement,"
    rf" '(?i)\b(no|not|cannot|does not|do not|without)\b[^.]{{0,60}}\b{WORDS}\b'))"
)


@RETRIEVAL.add(
    "causal_wording", f"WITH {CLAIMS_SQL} SELECT claim_id, {CAUSAL_SQL} AS causal FROM claims"
)
def causal_wording(spark, folder):
    return _claims(spark, folder).select("claim_id", audits.causal_wording("statement").alias("causal"))


FACTS_SQL = """facts AS (SELECT claim_id, bool_and(kind = 'document') AS document_only, bool_or(causal_support) AS support
    FROM cited JOIN evidence USING (evidence_id) GROUP BY claim_id)"""


@RETRIEVAL.add(
    "unsupported_causes",
    f"""WITH {CLAIMS_SQL}, {CITED_SQL}, {FACTS_SQL} SELECT claim_id FROM claims WHERE {CAUSAL_SQL}
    AND claim_id NOT IN (SELECT claim_id FROM facts WHERE support)""",
)
def unsupported_causes(spark, folder):
    return audits.unsupported_causes(_claims(spark, folder), _evidence(spark, folder))


@RETRIEVAL.add(
    "document_only_problems",
    f"""WITH {CLAIMS_SQL}, {CITED_SQL}, {FACTS_SQL},
      alone AS (SELECT * FROM claims WHERE claim_id IN (SELECT claim_id FROM facts WHERE document_only)),
      said AS (SELECT claim_id, unnest({numbers_sql('statement')}) AS number FROM alone),
      held AS (SELECT evidence_id, unnest({numbers_sql('metadata')}) AS number FROM evidence)
    SELECT claim_id, 'finding on documents alone' AS problem FROM alone WHERE claim_type = 'finding'
    UNION ALL SELECT DISTINCT claim_id, 'number on documents alone' FROM said WHERE NOT EXISTS (
      SELECT 1 FROM cited c JOIN held h ON h.evidence_id = c.evidence_id
      WHERE c.claim_id = said.claim_id AND h.number = said.number)""",
)
def document_only_problems(spark, folder):
    return audits.document_only_problems(_claims(spark, folder), _evidence(spark, folder))


@RETRIEVAL.add(
    "narrative_problems",
    f"""WITH {CLAIMS_SQL}, {CITED_SQL}, {FACTS_SQL},
      reports AS (SELECT claim_id // 5 AS report_id, bool_or(claim_id % 5 = 0 AND document_only) AS summary_alone,
        coalesce(bool_or(claim_id % 5 IN (1, 2) AND NOT document_only), FALSE) AS any_finding
        FROM facts GROUP BY claim_id // 5)
    SELECT report_id, 'summary cites documents alone' AS problem FROM reports WHERE summary_alone
    UNION ALL SELECT report_id, 'no finding cites analysis' FROM reports WHERE NOT any_finding""",
)
def narrative_problems(spark, folder):
    role = F.when(F.col("claim_id") % 5 == 0, "summary").when(F.col("claim_id") % 5 <= 2, "finding").otherwise(
        "recommendation"
    )
    claims = _claims(spark, folder).withColumns(
        {"report_id": F.floor(F.col("claim_id") / 5).cast("bigint"), "role": role}
    )
    return audits.narrative_problems(claims, _evidence(spark, folder))


@RETRIEVAL.add(
    "quality_evidence",
    f"""WITH report AS ({VALIDATE_SQL}), cleaned AS ({cleaning_sql()})
    SELECT 'validation_errors' AS metric, count(*) FILTER (WHERE severity = 'error' AND violations > 0) AS value,
      'checks' AS unit FROM report
    UNION ALL SELECT 'validation_warnings', count(*) FILTER (WHERE severity = 'warning' AND violations > 0), 'checks'
      FROM report
    UNION ALL SELECT CASE measure WHEN 'duplicates_removed' THEN 'duplicate_events_removed'
      WHEN 'scores_left_missing' THEN 'missing_satisfaction_retained' ELSE measure END, value, 'rows' FROM cleaned
      WHERE measure IN ('duplicates_removed', 'industries_filled', 'scores_left_missing')""",
    ALL_ROLES,
)
def quality_evidence(spark, folder):
    tables = roles.business_tables(spark, folder)
    gaps = _with_gaps(tables)
    return audits.quality_evidence(
        contracts.validate(tables, allowed=ALLOWED), cleaning.cleaning_report(gaps, cleaning.clean_tables(gaps))
    )


@RETRIEVAL.add("test_evidence")
def test_evidence(spark, folder):
    tables = roles.business_tables(spark, folder, ticket_months_back=336)
    return audits.test_evidence(st.business_tests(tables))
