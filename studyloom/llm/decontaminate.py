"""Benchmark decontamination by greedy string tiling.

The benchmark is a stated query set: it is read in blocks of bounded size, each of which goes to every task; the
documents are streamed past it and never shuffled. A document meets only those items with which it shares a
seed of five tokens. For these, running Karp-Rabin finds and marks the longest common runs of unmarked tokens again and again;
an item counts as leaked if its tiles cover enough of it, in whatever order its parts stand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_TILE = 5
COVERAGE = 0.5
BLOCK_CHARS = 4_000_000
FIRST_LENGTH = 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
TOKEN = re.compile(r"[^\W_]+")
VOCABULARY = 1_000_000


class Tokens:
    """Texts as arrays of 64-bit hashes of their lower-cased runs of letters and digits."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = TOKEN.findall(text.lower()) if text else []
        known = self.known
        if len(known) > VOCABULARY:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def rolling(tokens: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of a length, modulo 2**64, from one running sum."""
    n = len(tokens)
    if n < length:
        return np.empty(0, np.uint64)
    power = np.full(n, BASE)
    power[0] = 1
    power = np.multiply.accumulate(power)
    down = np.full(n, INVERSE)
    down[0] = 1
    down = np.multiply.accumulate(down)
    total = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(tokens * power)])
    return (total[length:] - total[:-length]) * down[: n - length + 1]


def _free(marked: np.ndarray, length: int) -> np.ndarray:
    """Starts of windows without a marked token."""
    sums = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(sums[length:] == sums[:-length]) if len(marked) >= length else np.empty(0, np.int64)


def _matches(item: np.ndarray, text: np.ndarray, in_item: np.ndarray, in_text: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(length, place in item, place in text) of the common runs of free tokens that can't be made longer on their left, from length on.

    Windows of equal Karp-Rabin hash are compared token by token. A run is looked at from its first window only, so text that
    repeats a token over and over brings no more runs than it has places.
    """
    free, mine = _free(in_text, length), _free(in_item, length)
    if not len(free) or not len(mine):
        return []
    wanted, hashes = rolling(item, length), rolling(text, length)[free]
    hit = np.isin(hashes, wanted[mine])
    free, hashes = free[hit], hashes[hit]
    order = np.argsort(hashes, kind="stable")
    free, hashes = free[order], hashes[order]
    lo, hi = np.searchsorted(hashes, wanted[mine]), np.searchsorted(hashes, wanted[mine], "right")
    found = []
    for i, a, b in zip(mine.tolist(), lo.tolist(), hi.tolist()):
        j = free[a:b]
        if i and not in_item[i - 1] and len(j):
            before = np.maximum(j - 1, 0)
            j = j[(j == 0) | in_text[before] | (text[before] != item[i - 1])]
        for at in j.tolist():
            if not (item[i : i + length] == text[at : at + length]).all():
                continue
            room = min(len(item) - i, len(text) - at)
            ends = (item[i : i + room] != text[at : at + room]) | in_item[i : i + room] | in_text[at : at + room]
            found.append((int(ends.argmax()) if ends.any() else room, i, at))
    return found


def tiles(item: np.ndarray, text: np.ndarray, least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in text, length), no token in two tiles."""
    in_item, in_text = np.zeros(len(item), bool), np.zeros(len(text), bool)
    found: list[tuple[int, int, int]] = []
    length = max(least, min(FIRST_LENGTH, len(item)))
    while True:
        matches = _matches(item, text, in_item, in_text, length)
        longest = max(matches, default=(0,))[0]
        if longest > 2 * length:
            length = longest
            continue
        for k, i, j in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if not in_item[i : i + k].any() and not in_text[j : j + k].any():
                in_item[i : i + k] = in_text[j : j + k] = True
                found.append((i, j, k))
        # a run that another tile has cut may have a free part of this length left, so the same length is searched until it gives nothing
        if not matches:
            if length <= least:
                return found
            length = max(least, length // 2)


class Scanner:
    """A block of items; called with a text, it gives the items that the text leaks."""

    def __init__(self, items: list[tuple[int | None, str | None]], least: int, coverage: float):
        self.hashed, self.least, self.coverage = Tokens(), least, coverage
        self.ids, self.items = [i for i, _ in items], [self.hashed(t) for _, t in items]
        seeds = [np.unique(rolling(t, least)) for t in self.items]
        seed, owner = np.concatenate(seeds), np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        order = np.argsort(seed, kind="stable")
        self.seed, self.owner = seed[order], owner[order]
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[(self.seed >> np.uint64(42)).astype(np.int64)] = True

    def __call__(self, text: str | None) -> list[tuple[int | None, float, int, int]]:
        tokens = self.hashed(text)
        windows = rolling(tokens, self.least)
        at = np.flatnonzero(self.sieve[(windows >> np.uint64(42)).astype(np.int64)])
        lo, hi = np.searchsorted(self.seed, windows[at]), np.searchsorted(self.seed, windows[at], "right")
        at, lo, times = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        out = []
        if not len(at):
            return out
        # every (place, item) whose seed stands there
        place = np.repeat(at, times)
        item = self.owner[np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
        for k in np.unique(item).tolist():
            inside = np.zeros(len(tokens) + 1, np.int64)
            starts = place[item == k]
            np.add.at(inside, starts, 1)
            np.add.at(inside, np.minimum(starts + self.least, len(tokens)), -1)
            held = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
            # only seeded stretches can hold tiles; a zero parts them
            breaks = np.flatnonzero(np.diff(held) > 1) + 1
            found = tiles(self.items[k], np.insert(tokens[held], breaks, np.uint64(0)), self.least)
            covered = sum(n for _, _, n in found)
            if covered and covered >= self.coverage * len(self.items[k]):
                out.append((self.ids[k], covered / len(self.items[k]), covered, len(found)))
        return out


SCHEMA = "doc_id long, item_id long, coverage double, n_tokens long, n_tiles long"


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The benchmark in blocks of about BLOCK_CHARS characters, so what a task gets doesn't grow with it."""
    query = benchmark.where("text IS NOT NULL").select("item_id", "text")
    total = query.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    count = -(-total // BLOCK_CHARS)
    for b in range(count):
        if items := [tuple(r) for r in query.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == b).collect()]:
            yield items


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = MIN_TILE, coverage: float = COVERAGE) -> DataFrame:
    """A row (doc_id, item_id, coverage, n_tokens, n_tiles) for each document and item that it leaks.

    docs(doc_id, text), benchmark(item_id, text). Null or empty texts, and items of fewer than least tokens, leak
    nothing. Repeated rows give repeated results. A null id stays null. Other columns are ignored.
    """

    def matched(items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scan = Scanner(items, least, coverage)
            for batch in batches:
                rows = [(i, *hit) for i, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()) for hit in scan(text)]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "coverage", "n_tokens", "n_tiles"])

        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)

    parts = [matched(items) for items in _blocks(benchmark)]
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], SCHEMA)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least: int = MIN_TILE, coverage: float = COVERAGE) -> DataFrame:
    """docs without the rows whose text leaks an item; all columns stay, and nothing is shuffled."""
    for items in _blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            scan = Scanner(items, least, coverage)
            for batch in batches:
                yield batch.filter(pa.array([not scan(text) for text in batch["text"].to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
