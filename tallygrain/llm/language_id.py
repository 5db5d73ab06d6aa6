"""Language identification by unigram pieces, summed over all segmentations.

Each language gives a probability to every piece of a fixed public vocabulary. A word can be cut into pieces in many
ways; a forward pass over its characters sums the probability of all of them. No piece crosses white space, so the
probability of a text is the product over its words, and a word is scored once per task however often it occurs.
The probabilities are fitted by expectation maximisation: expected piece counts come from forward and backward sums
over the training texts, in Spark tasks, and only their totals by language and piece reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from tallygrain.llm.common import in_pieces, map_whole_rows, written
from tallygrain.llm.tokens import Runs, mix, slices

UNDETERMINED = "und"
SAMPLE = 2_000  # training documents of a language, about
ROUNDS = 2
LONG = 40  # characters; longer words are scored but not learned from
LONGEST = 16  # characters of a piece that is used
REMEMBERED = 1 << 17  # words whose scores a task keeps
_CELLS = 1 << 17  # of the table of forward sums
_FILTER_BITS = 18  # of the table that turns away most fingerprints before they are looked up
_LIFT = np.exp(4.0)  # factor for each character, so that sums stay within reach of doubles
_HUGE = 1e120  # where sums are brought back, and from its inverse
_MARK = "▁"  # fixed value: the vocabulary's sign for the start of a word

_COUNT = pa.schema([("lang", pa.string()), ("piece", pa.int32()), ("expected", pa.float64())])


def read_pieces(path: str) -> list[str]:
    """Pieces of a vocabulary file, without control signs, single bytes and pieces that are too long."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    plain = (i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({piece for piece in map(model.id_to_piece, plain) if 0 < len(piece) <= LONGEST})


class Vocabulary:
    """Finds the pieces inside words."""

    def __init__(self, pieces: list[str]):
        self.unknown = len(pieces)  # number of the piece that stands for any character without one
        self.none = len(pieces) + 1  # where no piece stands
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        runs = Runs(self._codes("".join(pieces)))
        begins = np.cumsum(sizes) - sizes
        self.tables = {}
        for size in np.unique(np.append(sizes, 1)).tolist():
            own = np.flatnonzero(sizes == size)
            prints = runs.grams(size)[begins[own]]
            order = np.argsort(prints)
            maybe = np.zeros(1 << _FILTER_BITS, bool)
            maybe[self._slot(prints)] = True
            self.tables[size] = prints[order], own[order], maybe
        self.lift = np.append(_LIFT**sizes, [_LIFT, 0.0])[:, None]

    @staticmethod
    def _codes(text: str) -> np.ndarray:
        return mix(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))

    @staticmethod
    def _slot(prints: np.ndarray) -> np.ndarray:
        return (prints >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)

    def lifted(self, chances: np.ndarray) -> np.ndarray:
        """Chances by piece, times a factor for each of its characters, and none where no piece stands."""
        return np.concatenate((chances, np.zeros((1, chances.shape[1])))) * self.lift

    def found(self, words: list[str]) -> dict[int, np.ndarray]:
        """For words of one length, the number of the piece of each size at each place: a row a place, a column a word."""
        length = len(words[0])
        runs, out = Runs(self._codes("".join(words))), {}
        for size, (prints, numbers, maybe) in self.tables.items():
            if size > length:
                break
            grams = np.zeros(len(words) * length, np.uint64)
            held = runs.grams(size)
            grams[: len(held)] = held
            grams = grams.reshape(len(words), length)[:, : length - size + 1].T.ravel()
            number = np.full(len(grams), self.unknown if size == 1 else self.none)
            likely = np.flatnonzero(maybe[self._slot(grams)])
            if len(likely):
                at = np.searchsorted(prints, grams[likely]).clip(max=len(prints) - 1)
                known = prints[at] == grams[likely]
                number[likely[known]] = numbers[at[known]]
            out[size] = number.reshape(length - size + 1, len(words))
        return out


def _by_length(words: list[str]) -> Iterator[np.ndarray]:
    """Numbers of the words, in groups of one length and bounded size."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    edges = np.flatnonzero(np.diff(lengths[order], prepend=-1, append=-1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        room = max(1, _CELLS // (int(lengths[order[a]]) + 1))
        for begin in range(a, b, room):
            yield order[begin : min(begin + room, b)]


def _forward(found: dict[int, np.ndarray], lifted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward sums by place, word and language, lifted by a factor for each character; and the log of other factors."""
    length, count = found[1].shape
    sums = np.zeros((length + 1, count, lifted.shape[1]))
    sums[0] = 1
    scale = np.zeros(sums.shape[1:])
    for stop in range(1, length + 1):
        for size, number in found.items():
            if size <= stop:
                sums[stop] += sums[stop - size] * lifted[number[stop - size]]
        for far, factor in ((sums[stop] < 1 / _HUGE, _HUGE), (sums[stop] > _HUGE, 1 / _HUGE)):
            if far.any():
                sums[max(0, stop - LONGEST) : stop + 1, far] *= factor
                scale[far] -= np.log(factor)
    return sums, scale


def word_scores(words: list[str], vocabulary: Vocabulary, chances: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language, over all its segmentations."""
    out = np.empty((len(words), chances.shape[1]))
    lifted = vocabulary.lifted(chances)
    for own in _by_length(words):
        part = [words[i] for i in own]
        sums, scale = _forward(vocabulary.found(part), lifted)
        out[own] = np.log(np.maximum(sums[-1], 1e-300)) + scale - len(part[0]) * np.log(_LIFT)
    return out


def expected_counts(words: list[str], counts: np.ndarray, vocabulary: Vocabulary, chances: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in the words under one language's chances."""
    out = np.zeros(len(chances) + 1)
    lifted = vocabulary.lifted(chances[:, None])
    for own in _by_length(words):
        part = [words[i] for i in own]
        found = vocabulary.found(part)
        sums = _forward(found, lifted)[0][:, :, 0]
        back = np.zeros_like(sums)
        back[-1] = 1
        share = counts[own] / sums[-1]
        for start in reversed(range(len(part[0]))):
            for size, number in found.items():
                if start < len(number):
                    flow = lifted[number[start], 0] * back[start + size]
                    back[start] += flow
                    out += np.bincount(number[start], sums[start] * flow * share, len(out))
    return out[:-1]


def _split(text: str) -> list[str]:
    return text.lower().split()


@dataclass
class LanguageModel:
    pieces: list[str]
    languages: list[str]
    chances: np.ndarray  # a row for each piece and one for any other character, a column for each language


def _smoothed(counts: np.ndarray) -> np.ndarray:
    """Chances from expected counts, none of them zero."""
    counts = counts + 0.01
    return counts / counts.sum(axis=0)


def train_language_model(
    docs: DataFrame,
    *,
    vocabulary_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample: int = SAMPLE,
    rounds: int = ROUNDS,
) -> LanguageModel:
    """Fit piece chances for every language of ``docs`` on about ``sample`` documents of each, picked by id hash.

    Rows without text or language teach nothing. Without any row the model knows no language. The number of languages
    is taken to be small.
    """
    pieces = read_pieces(vocabulary_path)
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("lang is not null and text is not null")
    sizes = {row.lang: row.n for row in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel(pieces, [], np.zeros((len(pieces) + 1, 0)))
    steps = 1 << 30
    limit = F.create_map(*chain.from_iterable((F.lit(x), F.lit(int(steps * min(1.0, sample / sizes[x])))) for x in languages))
    picked = rows.where(F.pmod(F.xxhash64(F.col("id").cast("string"), "text"), F.lit(steps)) < limit[F.col("lang")])
    picked = written(picked.select("lang", "text"))
    context = docs.sparkSession.sparkContext
    known = context.broadcast(pieces)
    chances = _smoothed(np.ones((len(pieces) + 1, len(languages))))
    for _ in range(rounds):
        model = context.broadcast((languages, chances))

        def run(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            names, now = model.value
            vocabulary = Vocabulary(known.value)
            for batch in slices(batches, 1 << 20):
                for place, lang in enumerate(names):
                    own = batch.filter(pc.equal(batch.column("lang"), lang)).column("text").to_pylist()
                    words = [_MARK + word for text in own for word in _split(text) if len(word) <= LONG]
                    if not words:
                        continue
                    unique, count = np.unique(np.array(words, object), return_counts=True)
                    expected = expected_counts(unique.tolist(), count, vocabulary, now[:, place])
                    used = np.flatnonzero(expected)
                    columns = {"lang": np.full(len(used), lang, object), "piece": used, "expected": expected[used]}
                    yield from in_pieces(columns, _COUNT)

        counted = picked.mapInArrow(run, "lang string, piece int, expected double")
        totals = counted.groupBy("lang", "piece").agg(F.sum("expected").alias("expected")).toPandas()
        counts = np.zeros_like(chances)
        counts[totals["piece"], [languages.index(x) for x in totals["lang"]]] = totals["expected"]
        chances = _smoothed(counts)
    return LanguageModel(pieces, languages, chances)


class _Scorer:
    def __init__(self, pieces: list[str], languages: list[str], chances: np.ndarray):
        self.vocabulary, self.languages, self.chances = Vocabulary(pieces), languages, chances
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(languages)))

    def _learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > REMEMBERED:
            self.known, self.scores = {}, self.scores[:0]
        new = sorted(words - self.known.keys())
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.scores = np.concatenate((self.scores, word_scores([_MARK + word for word in new], self.vocabulary, self.chances)))

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and its probability for each text."""
        split = [_split(text or "") for text in texts]
        self._learn(set(chain.from_iterable(split)))
        langs, chances = [], []
        for text, words in zip(texts, split, strict=True):
            if not words or not self.languages or not any(map(str.isalpha, text)):
                langs.append(UNDETERMINED)
                chances.append(0.0)
                continue
            total = self.scores[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].sum(axis=0)
            share = np.exp(total - total.max())
            best = int(share.argmax())
            langs.append(self.languages[best])
            chances.append(float(share[best] / share.sum()))
        return langs, chances


def identify_language(
    docs: DataFrame, model: LanguageModel, *, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score"
) -> DataFrame:
    """All rows and columns of ``docs`` with the language of the text and its probability among the known ones.

    The text is ``und`` with score 0 if it is null, has no letter, or the model knows no language. Of equally likely
    languages the first by name is taken. Whole texts count, whatever their length. Columns that already have the new
    names are replaced. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.pieces, model.languages, model.chances))
    docs = docs.drop(lang_col, score_col)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(*shared.value)
        for batch in slices(batches, 1 << 20, f"c{place}"):
            langs, chances = scorer.judge(batch.column(place).to_pylist())
            columns = [*batch.columns, pa.array(langs, pa.string()), pa.array(chances, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    return map_whole_rows(docs, run, [StructField(lang_col, StringType()), StructField(score_col, DoubleType())])
