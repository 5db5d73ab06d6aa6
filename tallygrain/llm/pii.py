"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds what they miss.

The field scores whole candidate segments by features of the span (digits and letters in it, groups, separators,
checksums, what stands on either side) and picks boundaries and kinds together by dynamic programming over segments of
at most ``MOST_TOKENS`` tokens. It is trained on a bounded sample of the documents themselves: spans that the patterns
find, the same spans rewritten in other notations, and broken numbers as counterexamples. Only stretches around digits
and at signs are decoded, as no segment without them is a candidate. Texts are read once and never shuffled.
"""

from __future__ import annotations

import random
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from tallygrain.llm.common import map_whole_rows
from tallygrain.llm.tokens import slices

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 20_000  # documents that training spans are taken from, about
MOST_SPANS = 1_200  # training spans before rewriting
MOST_TOKENS = 24
MOST_CHARS = 96
BLOCK_TOKENS = 2048  # tokens whose candidate segments are held at a time
EPOCHS = 6
MARGIN = 40  # characters kept on either side of a digit or at sign

# The patterns that every result holds.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_TRIGGER = re.compile(r"[0-9@]+|[(\[]at[)\]]")
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")

SPAN = StructType(
    [StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("base", BooleanType())]
)
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

Span = tuple[int, int, int]  # start, number of the kind, end


def luhn(digits: str) -> bool:
    """Whether the checksum of a card number holds."""
    values = [ord(c) - 48 for c in reversed(digits)]
    return (sum(values[::2]) + sum(v * 2 - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the pattern, from each at sign outwards, so that no run is read again and again."""
    done, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        size = _LOCAL.match(text[done:at][::-1]).end() if domain else 0
        done = at + 1
        if size:
            yield at - size, domain.end()
            done = domain.end()
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by start and then kind; matches that fail their check are dropped without a retry."""
    found = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def _stretches(text: str) -> list[tuple[int, int]]:
    """Parts of a text around digits and at signs, cut at white space where there is some."""
    out: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        a = max(0, m.start() - MARGIN)
        gap = text.find(" ", a, m.start())
        a = gap + 1 if a and gap >= 0 else a
        b = min(len(text), m.end() + MARGIN)
        gap = text.rfind(" ", m.end(), b)
        b = gap if b < len(text) and gap >= 0 else b
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_PUNCT = {c: i for i, c in enumerate(".-()@+[]")}
_WIDTHS = (1, 22, 6, 3, 3, 6, 5, 9, 6, 4, 16, 16, 8, 8, 8, 64, 3, 3, MOST_TOKENS + 1)  # values of each feature
_BEGINS = np.concatenate(([0], np.cumsum(_WIDTHS)))
_OUTSIDE = 24  # looks of a token that is in no segment


@dataclass
class _Lattice:
    """Tokens of some stretches, and the candidate segments with their features."""

    starts: np.ndarray
    ends: np.ndarray
    looks: np.ndarray
    stretch: np.ndarray
    first: np.ndarray
    last: np.ndarray
    features: np.ndarray


def _side(text: str, place: int) -> int:
    if not 0 <= place < len(text):
        return 0
    c = text[place]
    return 1 if c.isspace() else 2 if c.isdigit() else 3 if c.isalpha() else 4 if c in ".,;:!?" else 5 if c in "@+-_/" else 6


def _tokens(stretches: list[tuple[str, int, int]]) -> Iterator[tuple]:
    """Tokens of all stretches (text, begin, end), one after another, as numbers."""
    for number, (text, a, b) in enumerate(stretches):
        before = a
        for m in _TOKEN.finditer(text, a, b):
            token, s, e = m.group(), m.start(), m.end()
            digits = sum("0" <= c <= "9" for c in token) if token[0].isalnum() else 0
            letters = len(token) - digits if token[0].isalnum() else 0
            gap = s - before
            wide = gap > 1 or (gap == 1 and text[before] != " ")
            word = token in ("at", "AT") and s > 0 and text[s - 1] in "(["
            sign = _PUNCT.get(token, 8) if not digits + letters else -1
            yield number, s, e, digits, letters, sign, gap, wide, word, _side(text, s - 1), _side(text, e)
            before = e


def _lattice(stretches: list[tuple[str, int, int]], rows: list[tuple] | None = None) -> _Lattice | None:
    """Segments of all stretches at once, or of the given tokens of theirs."""
    rows = list(_tokens(stretches)) if rows is None else rows
    if not rows:
        return None
    stretch, s, e, digits, letters, sign, gap, wide, word, left, right = np.array(rows, np.int64).T
    count = len(s)
    number = (digits > 0) & (letters == 0)

    def running(values: np.ndarray) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(values)))

    sums = {"digits": running(digits), "letters": running(letters), "gaps": running(gap), "wide": running(wide), "word": running(word), "groups": running(number)}
    sums |= {i: running(sign == i) for i in range(9)}
    can_start = (sign < 0) | (sign == _PUNCT["+"]) | (sign == _PUNCT["("])
    firsts, lasts = [], []
    for size in range(1, MOST_TOKENS + 1):
        i = np.arange(count - size + 1)
        j = i + size - 1
        ok = (stretch[i] == stretch[j]) & can_start[i] & (sign[j] < 0) & (e[j] - s[i] <= MOST_CHARS)
        ok &= (sums["wide"][j + 1] == sums["wide"][i + 1]) & (sums["gaps"][j + 1] - sums["gaps"][i + 1] <= 5)
        ok &= (sums["digits"][j + 1] - sums["digits"][i] >= 4) | (sums[4][j + 1] > sums[4][i]) | (sums["word"][j + 1] > sums["word"][i])
        firsts.append(i[ok])
        lasts.append(j[ok])
    i, j = np.concatenate(firsts), np.concatenate(lasts)
    of = {name: values[j + 1] - values[i] for name, values in sums.items()}
    kind = np.where(sign >= 0, 6 + sign, np.where(number, np.minimum(digits, 5) - 1, 5))  # 0-4 digits, 5 word, 6+ signs
    # Lengths of the first three digit groups, as one small number.
    places = np.append(np.flatnonzero(number), [count] * 3)
    at = np.searchsorted(places[:-3], i)
    shape = np.zeros(len(i), np.int64)
    for k in range(3):
        inside = places[at + k] <= j
        shape = shape * 4 + np.where(inside, np.searchsorted([3, 4], np.append(digits, [0])[places[at + k]], "right") + 1, 0)
    card, quad = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for x in np.flatnonzero((of["digits"] >= 12) & (of["digits"] <= 19) & (of["letters"] == 0)).tolist():
        text = stretches[stretch[i[x]]][0]
        card[x] = 1 + luhn(re.sub("[^0-9]", "", text[s[i[x]] : e[j[x]]]))
    for x in np.flatnonzero((of["groups"] == 4) & (of["letters"] == 0) & (of["digits"] <= 12) & (of[0] == 3) & (of["gaps"] - gap[i] == 0)).tolist():
        text = stretches[stretch[i[x]]][0]
        quad[x] = 1 + all(int(part) <= 255 for part in re.findall("[0-9]+", text[s[i[x]] : e[j[x]]]))
    values = (
        np.zeros(len(i), np.int64),
        of["digits"],
        np.searchsorted([1, 3, 6, 13, 30], of["letters"], "right"),
        of[4],
        of["word"],
        of[0],
        of[1],
        np.minimum(of[2], 2) * 3 + np.minimum(of[3], 2),
        of["gaps"] - gap[i],
        of[8] + of[5] * 2,
        kind[i],
        kind[j],
        left[i],
        right[j],
        of["groups"],
        shape,
        card,
        quad,
        j - i + 1,
    )
    features = np.column_stack([np.clip(v, 0, w - 1) + b for v, w, b in zip(values, _WIDTHS, _BEGINS, strict=False)])
    looks = np.clip(np.where(number, 14 + np.minimum(digits // 3, 8), kind), 0, _OUTSIDE - 1)
    return _Lattice(s, e, looks, stretch, i, j, features)


@dataclass
class SpanModel:
    """Weights of span features by kind, and of tokens outside any span."""

    inside: np.ndarray
    outside: np.ndarray

    def scores(self, lattice: _Lattice) -> np.ndarray:
        """Score of each candidate segment by kind."""
        out = np.zeros((len(lattice.first), len(KINDS)))
        for place in range(lattice.features.shape[1]):
            out += self.inside.T[lattice.features[:, place]]
        return out

    def decode(self, lattice: _Lattice) -> list[tuple[int, Span]]:
        """Stretch number and span of each segment on the best path."""
        path = _Path(self)
        path.extend(lattice, 0)
        return path.spans()

    def find(self, stretches: list[tuple[str, int, int]]) -> list[tuple[int, Span]]:
        """The same for stretches of any length. A block of tokens and those that a segment can reach back to are held at a time."""
        path, tokens, before = _Path(self), _tokens(stretches), []
        while rows := list(islice(tokens, BLOCK_TOKENS)):
            path.extend(_lattice(stretches, before + rows), len(before))
            before = (before + rows)[-MOST_TOKENS:]
        return path.spans()


class _Path:
    """Best segmentation of a growing row of tokens: for each token its place, the best value and the way back."""

    def __init__(self, model: SpanModel):
        self.model = model
        self.value = array("d", [0.0])
        self.back = array("q")  # first token of the segment that ends here, or -1
        self.kind = array("b")
        self.starts, self.ends, self.stretch = array("q"), array("q"), array("q")

    def extend(self, lattice: _Lattice, known: int) -> None:
        """Go on with a lattice whose first ``known`` tokens are the last ones so far."""
        origin = len(self.back) - known
        self.starts.extend(lattice.starts[known:].tolist())
        self.ends.extend(lattice.ends[known:].tolist())
        self.stretch.extend(lattice.stretch[known:].tolist())
        scores = self.model.scores(lattice)
        kinds = scores.argmax(axis=1)
        best = scores[np.arange(len(kinds)), kinds]
        order = np.argsort(lattice.last, kind="stable")
        edges = np.searchsorted(lattice.last[order], np.arange(len(lattice.starts) + 1)).tolist()
        first, gain, kinds = (lattice.first[order] + origin).tolist(), best[order].tolist(), kinds[order].tolist()
        alone = self.model.outside[lattice.looks].tolist()
        value = self.value
        for t in range(known, len(alone)):
            top, back = value[origin + t] + alone[t], -1
            for x in range(edges[t], edges[t + 1]):
                if value[first[x]] + gain[x] > top:
                    top, back = value[first[x]] + gain[x], x
            value.append(top)
            self.back.append(first[back] if back >= 0 else -1)
            self.kind.append(kinds[back] if back >= 0 else -1)

    def spans(self) -> list[tuple[int, Span]]:
        out, t = [], len(self.back)
        while t:
            first = self.back[t - 1]
            if first < 0:
                t -= 1
                continue
            out.append((self.stretch[t - 1], (self.starts[first], self.kind[t - 1], self.ends[t - 1])))
            t = first
        return out[::-1]


def _gradient(model: SpanModel, lattice: _Lattice, gold: list[Span], inside: np.ndarray, outside: np.ndarray) -> bool:
    """Add observed less expected features of one stretch; False if its spans are not candidates."""
    count = len(lattice.starts)
    scores = model.scores(lattice)
    alone = model.outside[lattice.looks]
    wanted = {(a, b): kind for a, kind, b in gold}
    at = {(int(lattice.starts[i]), int(lattice.ends[j])): x for x, (i, j) in enumerate(zip(lattice.first, lattice.last, strict=True))}
    if any(span not in at for span in wanted):
        return False
    total = np.logaddexp.reduce(scores, axis=1)
    by_end = [np.flatnonzero(lattice.last == t) for t in range(count)]
    by_start = [np.flatnonzero(lattice.first == t) for t in range(count)]
    ahead, back = np.zeros(count + 1), np.zeros(count + 1)
    for t in range(count):
        ways = np.concatenate(([ahead[t] + alone[t]], ahead[lattice.first[by_end[t]]] + total[by_end[t]]))
        ahead[t + 1] = np.logaddexp.reduce(ways)
    for t in reversed(range(count)):
        ways = np.concatenate(([back[t + 1] + alone[t]], back[lattice.last[by_start[t]] + 1] + total[by_start[t]]))
        back[t] = np.logaddexp.reduce(ways)
    chance = np.exp(ahead[lattice.first][:, None] + scores + back[lattice.last + 1][:, None] - ahead[-1])
    for kind in range(len(KINDS)):
        np.add.at(inside[kind], lattice.features, -chance[:, kind][:, None])
    np.add.at(outside, lattice.looks, -np.exp(ahead[:-1] + alone + back[1:] - ahead[-1]))
    covered = np.zeros(count, bool)
    for (a, b), kind in wanted.items():
        segment = at[a, b]
        np.add.at(inside[kind], lattice.features[segment], 1)
        covered[lattice.first[segment] : lattice.last[segment] + 1] = True
    np.add.at(outside, lattice.looks[~covered], 1)
    return True


def fit_spans(examples: list[tuple[str, list[Span]]]) -> SpanModel | None:
    """Fit on short texts with their spans; without any example there is no model."""
    cases = [(lattice, gold) for text, gold in examples if (lattice := _lattice([(text, 0, len(text))])) is not None]
    if not any(gold for _, gold in cases):
        return None
    model = SpanModel(np.zeros((len(KINDS), _BEGINS[-1])), np.zeros(_OUTSIDE))
    squares = SpanModel(np.full_like(model.inside, 1e-2), np.full_like(model.outside, 1e-2))
    draw = random.Random(7)
    for _ in range(EPOCHS):
        draw.shuffle(cases)
        for begin in range(0, len(cases), 8):
            inside, outside = np.zeros_like(model.inside), np.zeros_like(model.outside)
            for lattice, gold in cases[begin : begin + 8]:
                _gradient(model, lattice, gold, inside, outside)
            inside -= 1e-3 * model.inside
            squares.inside += inside**2
            squares.outside += outside**2
            model.inside += 0.3 * inside / np.sqrt(squares.inside)
            model.outside += 0.3 * outside / np.sqrt(squares.outside)
    return model


def _rewritten(kind: int, span: str, draw: random.Random) -> list[tuple[str, bool]]:
    """Other notations of a span, and broken ones that are no personal data (False)."""
    digits = re.sub("[^0-9]", "", span)
    if kind == 0:
        name, _, host = span.partition("@")
        return [(f"{name} (at) {host}", True), (f"{name}[at]{host}", True), (f"{name} @ {host}", True), (f"{name}.{host}", False)]
    if kind == 1:
        parts = span.split(".")
        return [("[.]".join(parts), True), (" . ".join(parts), True), (".".join(["999", *parts[1:]]), False), (".".join(parts[:3]), False)]
    if kind == 2:
        groups = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        wrong = digits[:-1] + str((int(digits[-1]) + draw.randint(1, 9)) % 10)
        return [(".".join(groups), True), ("/".join(groups), True), (wrong, False), (digits[:10], False), (digits + wrong[:7], False)]
    local = digits[-10:]
    if len(digits) < 10:
        return [(digits[:5], False)]
    a, b, c = local[:3], local[3:6], local[6:]
    good = [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}){b}-{c}"]
    return [*((x, True) for x in good), (f"{b}-{c}", False), (f"{a}{b}{c}", False), (f"{b}/{c}", False), (a, False)]


def _examples(rows: list[tuple[str, int, int, int]], draw: random.Random) -> list[tuple[str, list[Span]]]:
    """Training texts from stretches (text, start, kind, end), each as found and rewritten."""
    out = []
    for text, a, kind, b in rows:
        before, span, after = text[:a], text[a:b], text[b:]
        if base_spans(before) or base_spans(after):
            out.append((text, base_spans(text)))
            continue
        out.append((text, [(a, kind, b)]))
        for other, good in _rewritten(kind, span, draw):
            out.append((before + other + after, [(a, kind, a + len(other))] if good else []))
    return out


def _taken(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the parts of a text that sorted spans cover; the parts do not touch."""
    starts: list[int] = []
    ends: list[int] = []
    for a, _, b in spans:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _overlap(span: Span, taken: tuple[list[int], list[int]]) -> bool:
    starts, ends = taken
    at = bisect_right(ends, span[0])
    return at < len(starts) and starts[at] < span[2]


def train_spans(docs: DataFrame, *, text_col: str = "text", sample: int = SAMPLE) -> SpanModel | None:
    """Fit on pattern spans in about ``sample`` documents, picked by hash of their text; at most ``MOST_SPANS`` spans."""
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null")
    steps = 1 << 30
    share = int(steps * min(1.0, sample / max(1, texts.count())))
    picked = texts.where(F.pmod(F.xxhash64("text"), F.lit(steps)) < share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                if not _TRIGGER.search(text):
                    continue
                spans = base_spans(text)
                for a, b in _stretches(text):
                    rows += [(text[a:b], x - a, kind, y - a) for x, kind, y in spans if a <= x and y <= b and b - a <= 400]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            names = ("text", "start", "kind", "end")
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "text" else pa.int32()) for c, n in zip(columns, names, strict=True)], names=list(names))

    found = picked.mapInArrow(run, "text string, start int, kind int, end int").dropDuplicates()
    rows = found.orderBy(F.xxhash64("text"), "start", "kind").limit(MOST_SPANS).collect()
    return fit_spans(_examples([tuple(row) for row in rows], random.Random(11)))


def find_spans(texts: list[str | None], model: SpanModel | None) -> list[list[tuple[int, int, int, bool]]]:
    """Spans (start, kind, end, whether a pattern found it) of each text, by start and kind."""
    parts = [_stretches(text or "") for text in texts]
    found = [base_spans(text) if part else [] for text, part in zip(texts, parts, strict=True)]
    out = [[(*span, True) for span in spans] for spans in found]
    if model is not None:
        owners = [(number, texts[number], a, b) for number, part in enumerate(parts) for a, b in part]
        taken = [_taken(spans) for spans in found]
        for stretch, span in model.find([owner[1:] for owner in owners]):
            number = owners[stretch][0]
            if not _overlap(span, taken[number]):
                out[number].append((*span, False))
    return [sorted(spans) for spans in out]


def personal_data(docs: DataFrame, model: SpanModel | None, *, text_col: str = "text", spans_col: str = "pii") -> DataFrame:
    """All rows and columns of ``docs`` with an array of spans: kind, start, end (code points, end exclusive), base.

    Spans of the patterns are always there and marked as base; the field's spans never overlap them. Null and empty
    texts have none. Whole texts count; without a model only the patterns do. A column that already has the new name
    is replaced. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(spans_col)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column=f"c{place}"):
            found = find_spans(batch.column(place).to_pylist(), shared.value)
            spans = [[{"kind": KINDS[k], "start": a, "end": b, "base": base} for a, k, b, base in row] for row in found]
            columns = [*batch.columns, pa.array(spans, _SPAN)]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    return map_whole_rows(docs, run, [StructField(spans_col, ArrayType(SPAN))])


def redact(docs: DataFrame, model: SpanModel | None, *, text_col: str = "text") -> DataFrame:
    """The same rows and columns, with each span of personal data in the text replaced by its kind, as in <email>.

    Of spans that overlap, the text from the first start to the last end becomes the first one's kind.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def clean(text: str | None, spans: list[tuple[int, int, int, bool]]) -> str | None:
        if not spans:
            return text
        out, done = [], 0
        for a, kind, b, _ in spans:
            if a >= done:
                out += [text[done:a], f"<{KINDS[kind]}>"]
            done = max(done, b)
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column=f"c{place}"):
            texts = batch.column(place).to_pylist()
            cleaned = [clean(text, spans) for text, spans in zip(texts, find_spans(texts, shared.value), strict=True)]
            yield batch.set_column(place, f"c{place}", pa.array(cleaned, pa.string()))

    return map_whole_rows(docs, run)
