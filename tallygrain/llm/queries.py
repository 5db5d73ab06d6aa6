"""Registered queries of this package, and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrain.llm.bpe import bpe_decode, bpe_encode
from tallygrain.llm.common import table
from tallygrain.llm.decontamination import contamination
from tallygrain.llm.embedding_dedup import embedding_near_duplicates
from tallygrain.llm.filter_audit import document_failures, filter_interactions
from tallygrain.llm.language_id import identify_language, train_language_model
from tallygrain.llm.near_dedup import near_duplicates
from tallygrain.llm.periodic_runs import periodic_runs
from tallygrain.llm.pii import KINDS, personal_data, train_spans
from tallygrain.llm.quality import score_quality, train_quality
from tallygrain.llm.substring_dedup import substring_dedup
from tallygrain.llm.suffix_dedup import suffix_dedup
from tallygrain.llm.token_counts import token_counts
from tallygrain.llm.url_filter import url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def _sha256(column: str) -> F.Column:
    return F.sha2(F.col(column).cast("binary"), 256)


@_query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", _sha256("kept_text").alias("kept_sha256"))


SQL["op1_substring_dedup"] = r"""
WITH split AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
    FROM documents
), windows AS (
    SELECT doc_id, s AS start, md5(array_to_string(list_slice(words, s, s + 49), ' ')) AS code
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM split)
), flagged AS (
    SELECT DISTINCT doc_id, start FROM (
        SELECT doc_id, start, min(doc_id) OVER (PARTITION BY code) AS first_doc FROM windows
    ) WHERE first_doc < doc_id
), spots AS (
    SELECT DISTINCT doc_id, unnest(range(start, start + 50)) AS place FROM flagged
), gone AS (
    SELECT doc_id, list(place) AS places FROM spots GROUP BY doc_id
), kept AS (
    SELECT doc_id, len(words) AS n_words, coalesce(len(places), 0) AS n_removed,
        CASE WHEN places IS NULL THEN words
            ELSE list_filter(list_transform(range(1, len(words) + 1),
                lambda i: CASE WHEN list_contains(places, i) THEN NULL ELSE words[i] END), lambda w: w IS NOT NULL)
        END AS kept
    FROM split LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM kept
"""


@_query
def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL["op4_minhash_near_dedup"] = r"""
WITH RECURSIVE split AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(list_slice(words, s, s + 4), ' ') AS shingle
    FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS s FROM split WHERE len(words) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
    FROM shingles AS a JOIN shingles AS b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM common JOIN sizes AS x ON x.doc_id = a JOIN sizes AS y ON y.doc_id = b
    WHERE 100 * k >= 85 * (x.n + y.n - k)
), reach AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION
    SELECT r.doc_id, CASE WHEN l.a = r.other THEN l.b ELSE l.a END
    FROM reach AS r JOIN links AS l ON r.other = l.a OR r.other = l.b
), least AS (
    SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN sizes USING (doc_id)
"""


@_query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


SQL["op7_suffix_dedup"] = r"""
WITH coded AS (
    SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS code FROM documents
), sized AS (
    SELECT doc_id, code, length(code) // 2 AS n_bytes FROM coded
), windows AS (
    SELECT doc_id, s AS start, md5(substr(code, 2 * s + 1, 400)) AS print
    FROM (SELECT doc_id, code, unnest(range(0, n_bytes - 199)) AS s FROM sized)
), repeated AS (
    SELECT doc_id, start FROM (SELECT doc_id, start, count(*) OVER (PARTITION BY print) AS k FROM windows) WHERE k > 1
), marked AS (
    SELECT doc_id, start, CASE WHEN start - lag(start) OVER w <= 200 THEN 0 ELSE 1 END AS fresh
    FROM repeated WINDOW w AS (PARTITION BY doc_id ORDER BY start)
), numbered AS (
    SELECT doc_id, start, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS span FROM marked
), spans AS (
    SELECT doc_id, min(start) AS a, max(start) + 200 AS b FROM numbered GROUP BY doc_id, span
), edges AS (
    SELECT doc_id, a, b, coalesce(lag(b) OVER w, 0) AS before, lead(a) OVER w AS after
    FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY a)
), pieces AS (
    SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed,
        string_agg(substr(code, 2 * before + 1, 2 * (a - before)), '' ORDER BY a)
            || max(CASE WHEN after IS NULL THEN substr(code, 2 * b + 1) END) AS kept
    FROM edges JOIN sized USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(coalesce(kept, code))) AS kept_sha256
FROM sized LEFT JOIN pieces USING (doc_id)
"""


@_query
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = {"ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
    decoded = bpe_decode(bpe_encode(table(spark, sf_dir, "documents"), **vocabulary), **vocabulary)
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return decoded.select(
        "doc_id", "n_tokens", F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@_query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


SQL["op3_url_filter"] = r"""
WITH parts AS (
    SELECT page_id,
        translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
    FROM pages
), ruled AS (
    SELECT *, CASE
        WHEN ends_with('.' || host, '.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
        WHEN ends_with('.' || host, '.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
        WHEN ends_with('.' || host, '.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
        WHEN ends_with('.' || host, '.com') AND starts_with(path, '/de/') THEN 'com/de/'
        WHEN ends_with('.' || host, '.org') AND starts_with(path, '/') THEN 'org/'
        END AS rule
    FROM parts
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches('.' || host, '(?s)casino|pills|free-bets|[.]ads-|-track[.]|spam|[.]adult-')
        OR regexp_matches(path, '(?s)^/login|^/cart/|^/.*sessionid=') THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""


@_query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _checksum(column: str) -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


@_query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", _checksum("doc_id") % 3 == 1)
    model = train_language_model(docs.where("not held_out"), vocabulary_path=public_tokenizers.path("piece_bpe_32k.model"))
    return identify_language(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


@_query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = _checksum("doc_id") % 5 == 0
    model = train_quality(docs, labels.where(~held_out))
    scored = score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_query
def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(table(spark, sf_dir, "embeddings"))


SQL["op9_embedding_near_dedup"] = r"""
WITH RECURSIVE vectors AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM vectors AS a JOIN vectors AS b ON a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.9
), counts AS (
    SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
), reach AS (
    SELECT vec_id, vec_id AS other FROM vectors
    UNION
    SELECT r.vec_id, l.b FROM reach AS r JOIN links AS l ON r.other = l.a
), least AS (
    SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN counts USING (vec_id)
"""


def _span_list(column: str, where: str = "true") -> F.Column:
    return F.expr(f"array_join(transform(filter({column}, x -> {where}), x -> concat_ws(':', x.kind, x.start, x.end)), ',')")


@_query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = personal_data(docs, train_spans(docs))
    counts = [F.expr(f"cast(size(filter(pii, x -> x.base and x.kind = '{kind}')) as long)").alias(f"n_{kind}") for kind in KINDS]
    base = F.sha2(_span_list("pii", "x.base").cast("binary"), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), _span_list("pii").alias("spans"))


@_query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    failures = document_failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return filter_interactions(failures, list("ABCDE"), part_col="part", marks=["good", "toxic"], count_col="n")


SQL["op11_filter_audit"] = r"""
WITH split AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
    FROM documents
), marks AS (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), failures AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
            || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
            || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END
            || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
            || CASE WHEN min(doc_id) OVER (PARTITION BY text) < doc_id THEN 'E' ELSE '' END AS fails
    FROM split LEFT JOIN marks USING (doc_id)
), masks AS (
    SELECT part, fails, good, toxic, count(*) AS n FROM failures GROUP BY ALL
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
    FROM letters AS a JOIN letters AS b ON a.x <> b.x JOIN letters AS c ON c.x NOT IN (a.x, b.x)
        JOIN letters AS d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters AS e ON e.x NOT IN (a.x, b.x, c.x, d.x)
), steps AS (
    SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before
    FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders)
), outcomes AS (
    SELECT part, filter_order, step, own, n, good, toxic, fails = own AS only_own, contains(fails, own) AS hit,
        translate(fails, before, '') <> fails AS gone
    FROM masks JOIN steps ON true
), counted AS (
    SELECT part, filter_order, step, own,
        sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN hit AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN only_own THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN hit AND NOT gone AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN hit AND NOT gone AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
    FROM outcomes GROUP BY ALL
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counted
"""


@_query
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(table(spark, sf_dir, "documents"), vocabulary_path=public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def _made_periodic(docs: DataFrame) -> DataFrame:
    """The words of each text, one in ten of the texts with a stretch that repeats to its end, by a checksum of the id."""
    split = docs.select("doc_id", F.coalesce(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda word: word != ""), F.array()).alias("words"))
    sized = split.select("doc_id", "words", F.size("words").alias("n"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    g = F.expr("h div 10")
    first = F.when(F.col("n") > 0, g % F.col("n"))
    period = F.expr("1 + (n - a) div (3 + h div 10 % 8)")
    placed = sized.withColumn("a", first).withColumn("p", period)
    repeated = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1),
        lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")),
    )
    chosen = F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), repeated).otherwise(F.col("words"))
    return placed.select("doc_id", F.array_join(chosen, " ").alias("text"))


@_query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(_made_periodic(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda x: F.struct(x.length.alias("n"), (-x.start).alias("s"), (-x.period).alias("p"))))
    every = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x.start, x.length, x.period), F.lit("\n"))), "")
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.s")).alias("start"),
        F.col("longest.n").alias("length"),
        (-F.col("longest.p")).alias("period"),
        F.expr("1000 * longest.n div -longest.p").alias("exponent_milli"),
        F.sha2(every.cast("binary"), 256).alias("runs_sha256"),
        _sha256("collapsed").alias("collapsed_sha256"),
    )


#: Lengths of the word sequences that the SQL numbers, each twice the one before; periods up to the last are found.
_LENGTHS = [1 << i for i in range(15)]


def _grams_sql(size: int) -> str:
    """Equal sequences of ``size`` words of one text get equal numbers, made from those of half the size."""
    if size == 1:
        return "g1 AS (SELECT doc_id, i, dense_rank() OVER (ORDER BY word) AS g FROM numbered)"
    half = size // 2
    return f"""g{size} AS (
    SELECT doc_id, i, dense_rank() OVER (ORDER BY g, h) AS g
    FROM (SELECT doc_id, i, g, lead(g, {half}) OVER (PARTITION BY doc_id ORDER BY i) AS h FROM g{half}) WHERE h IS NOT NULL
)"""


def _stretches_sql(size: int) -> str:
    """Stretches in which each sequence of ``size`` words comes again after q words, but not before."""
    return f"""
    SELECT doc_id, q, min(i) AS start, max(i) - min(i) + {size} + q AS length
    FROM (
        SELECT doc_id, i, q, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS stretch
        FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id, g ORDER BY i) - i AS q FROM g{size})
        WHERE q <= {size} AND 2 * q > {size}
    ) GROUP BY doc_id, q, stretch"""


SQL["op13_periodic_runs"] = rf"""
WITH split AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
        xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(
            range(1, length(doc_id::VARCHAR) + 1),
            lambda k: list_concat([ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
            lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c // 2, (c % 2) * 3988292384) END)) AS h
    FROM documents
), placed AS (
    SELECT doc_id, words, len(words) AS n, h,
        CASE WHEN len(words) > 0 THEN (h // 10) % len(words) END AS a FROM split
), shaped AS (
    SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM placed
), numbered AS (
    SELECT doc_id, i, CASE WHEN h % 10 = 0 AND i >= a THEN words[1 + a + (i - a) % p] ELSE words[1 + i] END AS word
    FROM (SELECT *, unnest(range(0, n)) AS i FROM shaped)
), {", ".join(map(_grams_sql, _LENGTHS))},
runs AS (
    SELECT * FROM ({" UNION ALL ".join(map(_stretches_sql, _LENGTHS))}) WHERE length >= greatest(6, 4 * q)
), listed AS (
    SELECT doc_id, count(*) AS n_runs, max({{'n': length, 's': -start, 'p': -q}}) AS longest,
        string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS every
    FROM runs GROUP BY doc_id
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM runs
), kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM numbered ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, (-longest.s)::BIGINT AS start, longest.n::BIGINT AS length, (-longest.p)::BIGINT AS period,
    (1000 * longest.n // -longest.p)::BIGINT AS exponent_milli, sha256(coalesce(every, '')) AS runs_sha256,
    sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM documents LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
