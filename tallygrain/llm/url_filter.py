"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into one row of 64-bit words: a bit for each state of each rule. A step over one symbol of a
URL moves all rules at once, ``D = (D << 1 & ADVANCE[symbol]) | (D & STAY[symbol])``, with carries from word to word.
A batch of URLs is stepped together.

A glob is matched against the whole canonical URL: a dot, the host, a border that is no byte, the path. In a glob the
first ``/`` stands for the border and itself, as a path starts with it; without one, any path fits. ``*`` stands for
any run of symbols, inside the host for one that does not cross the border, and ``?`` for any one byte.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrain.llm.common import to_batch
from tallygrain.llm.tokens import slices

BORDER = 256
_SYMBOLS = 257
# Upper and lower case of ASCII; other letters stay.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Hosts and paths that decide by their longest rule, and whether they allow or block.
PREFIX_RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: Globs that block a URL for which no rule decides.
BLOCK_GLOBS = ("*casino*", "*pills*", "*free-bets*", "*.ads-*", "*-track.*", "*spam*", "*.adult-*", "*/login*", "*/cart/*", "*/*sessionid=*")

_FOUND = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("blocked", pa.bool_())])


@dataclass
class Automaton:
    """Masks of packed globs; ``words`` and ``bits`` place each glob's first and last state."""

    advance: np.ndarray
    stay: np.ndarray
    first: list[int]
    last: list[int]

    @classmethod
    def of(cls, globs: Sequence[str]) -> Automaton:
        """Pack globs one after another. A glob of n symbols has n + 1 states and may lie across words."""
        steps: list[tuple[int, set[int]]] = []
        loops: list[tuple[int, set[int]]] = []
        first, last, state = [], [], 0
        host_symbols, path_symbols = set(range(256)), set(range(_SYMBOLS))
        for glob in globs:
            host, slash, path = glob.partition("/")
            # Without a slash, whatever follows the host fits.
            pattern = [*host.encode(), BORDER, *((slash + path).encode() if slash else b"*")]
            first.append(state)
            in_host = True
            for symbol in pattern:
                if symbol == ord("*"):
                    loops.append((state, host_symbols if in_host else path_symbols))
                    continue
                state += 1
                steps.append((state, host_symbols if symbol == ord("?") else {symbol}))
                in_host = in_host and symbol != BORDER
            last.append(state)
            state += 1
        width = max(1, -(-state // 64))
        advance, stay = (np.zeros((_SYMBOLS, width), np.uint64) for _ in range(2))
        for masks, entries in ((advance, steps), (stay, loops)):
            for place, symbols in entries:
                masks[list(symbols), place // 64] |= np.uint64(1 << place % 64)
        return cls(advance, stay, first, last)

    def matches(self, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which globs fit which URL: a row for each URL, a column for each glob."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        begin, lengths = offsets[:-1][order], lengths[order]
        state = np.zeros((len(order), self.advance.shape[1]), np.uint64)
        for place in self.first:
            state[:, place // 64] |= np.uint64(1 << place % 64)
        for step in range(int(lengths.max(initial=0))):
            alive = int(np.searchsorted(-lengths, -step, "left"))
            symbol = symbols[begin[:alive] + step]
            now = state[:alive]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:alive] = (moved & self.advance[symbol]) | (now & self.stay[symbol])
        ended = np.empty((len(order), len(self.last)), bool)
        for i, place in enumerate(self.last):
            ended[order, i] = (state[:, place // 64] >> np.uint64(place % 64) & np.uint64(1)).astype(bool)
        return ended


def _canonical(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all canonical URLs, end to end, and where each begins."""
    pieces, sizes = [], []
    for host, path in zip(hosts, paths, strict=True):
        host, path = f".{host}".encode(), path.encode()
        pieces += [host, b"\0", path]
        sizes.append((len(host), len(host) + 1 + len(path)))
    symbols = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
    spans = np.array(sizes, np.int64).reshape(-1, 2)
    offsets = np.concatenate(([0], np.cumsum(spans[:, 1])))
    symbols[offsets[:-1] + spans[:, 0]] = BORDER
    return symbols, offsets


def url_filter(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[tuple[str, str]] = PREFIX_RULES,
    block_globs: Sequence[str] = BLOCK_GLOBS,
) -> DataFrame:
    """Judge every URL: the longest rule that fits decides, else it is blocked if a glob fits, else allowed.

    A rule is a host and the start of a path; it fits that host and its subdomains. Of rules of one length the first
    given wins. Returns a row per input row: ``page_id``, ``host`` (A-Z lower-cased), ``path``, ``rule`` (null if none
    fits), ``verdict``. A null URL, or one without ``://``, has an empty host and path, which no rule and only a glob
    of stars fits. Repeated rows are judged alike, ids may be missing, other columns are not read, and an empty table
    gives an empty result. Rules and globs are parameters of the job and go to the tasks with it.
    """
    if any(verdict not in ("allow", "block") or "/" not in rule for rule, verdict in rules):
        raise ValueError("a rule needs a slash and the verdict allow or block")
    if any(symbol in rule for rule, _ in rules for symbol in "*?"):
        raise ValueError("rules hold no wildcards")
    ranked = sorted(rules, key=lambda rule: -len(rule[0]))
    globs = [f"*.{rule}*" for rule, _ in ranked] + list(block_globs)
    names = np.array([rule for rule, _ in ranked] + [None], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton.of(globs)
        for batch in slices(batches, column="host"):
            fits = automaton.matches(*_canonical(batch.column("host").to_pylist(), batch.column("path").to_pylist()))
            by_rule = np.column_stack((fits[:, : len(ranked)], np.ones(len(fits), bool)))
            rows = {name: batch.column(name) for name in ("page_id", "host", "path")}
            rows |= {"rule": list(names[by_rule.argmax(axis=1)]), "blocked": fits[:, len(ranked) :].any(axis=1)}
            yield to_batch(rows, _FOUND)

    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    parts = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.translate(F.regexp_extract(url, shape, 1), _UPPER, _LOWER).alias("host"),
        F.regexp_extract(url, shape, 2).alias("path"),
    )
    found = parts.mapInArrow(run, "page_id long, host string, path string, rule string, blocked boolean")
    blocked = F.when(F.col("blocked"), "block").otherwise("allow")
    verdict = blocked
    for rule, ruling in ranked:
        verdict = F.when(F.col("rule") == rule, ruling).otherwise(verdict)
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
