"""Token counts of whole texts without their ids: pieces are counted once per distinct pre-token.

A pre-token is a run of spaces (or a run of line ends) with what follows it up to the next one. No piece of the
vocabulary holds a space after another character, and none holds a line end, so no merge crosses from one pre-token
into the next, and the count of a text is the sum over its pre-tokens. That is checked on the vocabulary at hand.

One scan collects the distinct pre-tokens with their frequency, and the library splits each of them once. The most
frequent ones, as many as a fixed bound allows, are sent to every task; a second scan adds up their pieces by document
and gives out only what is left: the rarer pre-tokens with their frequency in the document, which are joined by key.
So a word that stands in every text never meets in one task, and most of the corpus is not shuffled at all.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrain.llm.common import written
from tallygrain.llm.tokens import slices

FREQUENT = 1 << 17  # pre-tokens that are sent to every task, at most
SHORT = 32  # bytes; a longer pre-token goes by its SHA-256
BUCKETS = 4  # of frequency, in each doubling

_MARK = "▁"  # fixed value: the vocabulary's sign for a space
_SPLIT = re.compile(f"[ {_MARK}]+[^ {_MARK}\n]*|\n+[^ {_MARK}\n]*").findall

_DISTINCT = pa.schema([("key", pa.binary()), ("long", pa.string()), ("n", pa.int64())])
_PIECES = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("pieces", pa.int64())])
_RARE = pa.struct([("key", pa.binary()), ("n", pa.int64())])
_KNOWN = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("known", pa.int64()), ("rare", pa.list_(_RARE))])


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, in order; the library starts a text that is not empty with a space of its own."""
    return _SPLIT(f" {text}") if text else []


def _key(token: str) -> bytes:
    data = token.encode()
    return data if len(data) <= SHORT else b"\xff" + hashlib.sha256(data).digest()


def check_vocabulary(model: sentencepiece.SentencePieceProcessor) -> None:
    """Refuse a vocabulary whose pieces could cross from one pre-token into the next, or that changes texts first."""
    crossing = re.compile(f"[^{_MARK}]{_MARK}")
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and (crossing.search(piece) or "\n" in piece):
            raise ValueError(f"piece {piece!r} crosses pre-tokens")
    probe = " Ａ\t ﬁ  x\n"
    if model.normalize(probe) != _MARK + probe.replace(" ", _MARK):
        raise ValueError("the vocabulary rewrites texts before it splits them")


def count_pieces(model: sentencepiece.SentencePieceProcessor, tokens: list[str]) -> list[int]:
    """Number of pieces of each pre-token. The library's own first space stands for the one that a pre-token starts with."""
    own = [token[0] == "\n" for token in tokens]
    split = model.encode([token if line else token[1:] for token, line in zip(tokens, own, strict=True)], num_threads=1)
    # A pre-token that is one space is the empty text to the library, which gives it no piece.
    return [1 if token in (" ", _MARK) else len(ids) - line for token, ids, line in zip(tokens, split, own, strict=True)]


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [text or "" for text in batch.column("text").to_pylist()]


def distinct_pre_tokens(texts: DataFrame) -> DataFrame:
    """Distinct pre-tokens of ``text``: ``key``, the pre-token itself in ``long`` where the key is a digest, and count ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2 << 20):
            counts: Counter[str] = Counter()
            for text in _texts(batch):
                counts.update(pre_tokens(text))
            keys = list(map(_key, counts))
            longs = [token if key[:1] == b"\xff" else None for token, key in zip(counts, keys, strict=True)]
            for begin in range(0, len(keys), 50_000):
                cut = slice(begin, begin + 50_000)
                columns = [keys[cut], longs[cut], list(counts.values())[cut]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _DISTINCT, strict=True)], schema=_DISTINCT)

    found = texts.select("text").mapInArrow(run, "key binary, long string, n long")
    return found.groupBy("key", "long").agg(F.sum("n").alias("n"))


def pre_token_pieces(distinct: DataFrame, vocabulary_path: str) -> DataFrame:
    """``key``, ``n``, ``pieces`` and ``bucket`` (of the frequency, on a log scale) of each distinct pre-token."""
    vocabulary = _vocabulary(distinct, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sentencepiece.SentencePieceProcessor(model_proto=vocabulary.value)
        for batch in batches:
            pairs = zip(batch.column("key").to_pylist(), batch.column("long").to_pylist(), strict=True)
            pieces = count_pieces(model, [key.decode() if long is None else long for key, long in pairs])
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), pa.array(pieces, pa.int64())], schema=_PIECES)

    counted = distinct.mapInArrow(run, "key binary, n long, pieces long")
    return counted.withColumn("bucket", F.floor(F.log2("n") * BUCKETS).cast("int"))


def _vocabulary(frame: DataFrame, path: str):
    with open(path, "rb") as file:
        content = file.read()
    check_vocabulary(sentencepiece.SentencePieceProcessor(model_proto=content))
    return frame.sparkSession.sparkContext.broadcast(content)


def least_bucket(pieces: DataFrame, frequent: int) -> int:
    """The least bucket such that it and all above hold at most ``frequent`` pre-tokens. A row a bucket is collected."""
    sizes = sorted(pieces.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
    least, total = BUCKETS * 64, 0
    for bucket, n in sizes:
        total += n
        if total > frequent:
            break
        least = bucket
    return least


def token_counts(
    docs: DataFrame, *, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT
) -> DataFrame:
    """Bytes and tokens of whole texts: ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens``, as the library for the vocabulary gives them.

    No begin, end or added token is counted, and strings of special tokens are ordinary text. The vocabulary file is
    read on the driver, where ``vocabulary_path`` is, and sent to the tasks. At most ``frequent`` pre-tokens, as keys of
    33 bytes or less, are collected and sent out; any bound gives the same counts.

    A row per input row, in any order. Null and empty texts have no tokens. Ids and texts may repeat, and a missing id
    stays missing. Other columns are not read. An empty table stays empty.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    pieces = written(pre_token_pieces(distinct_pre_tokens(texts), vocabulary_path))
    least = least_bucket(pieces, frequent)
    top = pieces.where(F.col("bucket") >= least).select("key", "pieces").collect()
    known = docs.sparkSession.sparkContext.broadcast({bytes(key): count for key, count in top})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {key.decode(): count for key, count in known.value.items() if key[:1] != b"\xff"}
        digests = {key: count for key, count in known.value.items() if key[:1] == b"\xff"}
        for batch in slices(batches, 2 << 20):
            sums, rare = [], []
            for text in _texts(batch):
                total, left = 0, []
                for token, n in Counter(pre_tokens(text)).items():
                    count = table.get(token)
                    if count is None:
                        key = _key(token)
                        count = digests.get(key)
                        if count is None:
                            left.append({"key": key, "n": n})
                            continue
                    total += n * count
                sums.append(total)
                rare.append(left)
            columns = [batch.column("row"), batch.column("doc_id"), batch.column("n_bytes"), pa.array(sums, pa.int64()), pa.array(rare, pa.list_(_RARE))]
            yield pa.RecordBatch.from_arrays(columns, schema=_KNOWN)

    # Rows are numbered once and written, so that rows with equal ids and texts stay apart in the join.
    numbered = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    base = written(numbered.mapInArrow(run, "row long, doc_id long, n_bytes long, known long, rare array<struct<key:binary,n:long>>"))
    left = base.select("row", F.inline("rare")).withColumnRenamed("n", "times")
    rest = (
        left.join(pieces.where(F.col("bucket") < least).select("key", "pieces"), "key")
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    )
    summed = base.select("row", "doc_id", "n_bytes", "known").join(rest, "row", "left")
    return summed.select("doc_id", "n_bytes", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_tokens"))
