"""Benchmark decontamination with suffix arrays of the training corpus.

Every slice of a partition is a shard with a suffix array of its own over words: all suffixes of its texts, each sorted to
the text's end. Every test suffix is binary-searched in every shard by its window, the first words of it; the range found
holds all its places, and the words that go on equal from there give the longest verbatim matches.
Documents are never shuffled, and a shard's array is used where it is made. The benchmark goes to the tasks in blocks of
bounded size, of which a task holds one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .common import pieces, small_batches

#: Words of a window; a shorter item is one window.
WINDOW = 8
#: Text of a block of the benchmark.
BLOCK_BYTES = 64 << 20
SHARD_BYTES = 8 << 20
#: Pairs of places that are looked at together.
PAIRS = 1 << 21


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at `first` and have `count` numbers."""
    return np.arange(int(count.sum())) + np.repeat(first - np.concatenate(([0], np.cumsum(count)))[:-1], count)


def suffix_array(rank: np.ndarray) -> np.ndarray:
    """Places in order of the suffixes that begin there. rank: numbers from 0; each text's last one is found nowhere else.

    By doubling: places are sorted by their first number, then those that still agree by the ranks of the first h numbers
    here and h further on. Places that agree nowhere are left alone.
    """
    order = np.argsort(rank, kind="stable")
    group, at = np.zeros(len(rank), np.int64), np.arange(len(rank))
    key, h = rank[order], 0
    while len(at):
        # at: positions in order whose places were sorted anew, by key
        new = np.concatenate(([True], key[1:] != key[:-1]))
        group[order[at]] = at[np.flatnonzero(new)][np.cumsum(new) - 1]
        at = at[~(new & np.append(new[1:], True))]
        h = 2 * h or 1
        places = order[at]
        key = group[places] * len(rank) + group[np.minimum(places + h, len(rank) - 1)]
        by = np.argsort(key, kind="stable")
        key, order[at] = key[by], places[by]
    return order


@dataclass
class Items:
    """A block of the test side. sequence: hashes of the words of all texts; places: of the suffixes that have a window,
    in a row for each distinct window; owner: item of each word."""

    ids: list
    sequence: np.ndarray
    ends: np.ndarray  # of the text of each word
    owner: np.ndarray
    windows: dict[int, np.ndarray]  # length -> distinct windows, as rows of hashes
    first: dict[int, np.ndarray]  # length -> where each window's places begin
    places: dict[int, np.ndarray]


def _items(rows: list, window: int) -> Items:
    ids = sorted({r["i"] for r in rows})
    number = {x: n for n, x in enumerate(ids)}
    words = textkit.Words(pa.array([r["t"] for r in rows], pa.large_string()), textkit.LETTERS)
    count = words.counts()
    ends = np.repeat(words.first[1:], count)
    owner = np.repeat(np.array([number[r["i"]] for r in rows], np.int64), count)
    out = Items(ids, words.hashes, ends, owner, {}, {}, {})
    for n in np.unique(np.minimum(count, window)).tolist():
        if n:
            mine = np.minimum(count, window) == n
            at = spread(words.first[:-1][mine], count[mine] - n + 1)
            keys = np.ascontiguousarray(words.hashes[at[:, None] + np.arange(n)]).view(f"V{8 * n}").ravel()
            _, some, which = np.unique(keys, return_index=True, return_inverse=True)
            order = np.argsort(which, kind="stable")
            out.windows[n] = words.hashes[at[some][:, None] + np.arange(n)]
            out.places[n], out.first[n] = at[order], np.concatenate(([0], np.cumsum(np.bincount(which))))
    return out


@dataclass
class Benchmark:
    blocks: list[Broadcast]
    kind: str  # of an item's id

    def __iter__(self) -> Iterator[Items]:
        for block in self.blocks:
            yield block.value
            if len(self.blocks) > 1:
                vars(block).pop("_value", None)  # the next one takes its place


def read_items(items: DataFrame, id_column: str = "item_id", text_column: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Benchmark:
    """The benchmark as blocks of test suffixes. Rows without id or text are ignored; rows with one id are one item with
    several texts."""
    rows = items.select(F.col(id_column).alias("i"), F.col(text_column).alias("t")).where("i is not null and t is not null")
    held = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    number = max(1, -(-held // block_bytes))
    spark = items.sparkSession
    blocks = []
    for n in range(number):
        mine = rows if number == 1 else rows.where(F.pmod(F.xxhash64("i"), F.lit(number)) == n)
        blocks.append(spark.sparkContext.broadcast(_items(mine.collect(), window)))
    return Benchmark(blocks, "long" if rows.schema["i"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else "string")


class Shard:
    """Texts of a slice with their suffix array. sequence: each text's words as ranks, and a number of its own at its end."""

    def __init__(self, texts: pa.Array):
        words = textkit.Words(texts, textkit.LETTERS)
        self.counts = words.counts()
        n = len(self.counts)
        self.vocabulary, ranks = np.unique(words.hashes, return_inverse=True)
        self.first = words.first[:-1] + np.arange(n)
        self.sequence = np.zeros(len(ranks) + n, np.int64)
        self.sequence[self.first + self.counts] = np.arange(n)
        self.sequence[np.arange(len(ranks)) + np.repeat(np.arange(n), self.counts)] = ranks + n
        self.suffixes = suffix_array(self.sequence)
        self.heads = self.sequence[self.suffixes]
        self.hit = np.zeros(len(self.sequence) + 1, np.int64)

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """Of words; -1 where this shard hasn't the word."""
        if not len(self.vocabulary):
            return np.full(hashes.shape, -1, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + len(self.counts), -1)

    def find(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range in the suffix array of each window (rows of ranks): two binary searches, of all windows at once."""
        low, high = (np.searchsorted(self.heads, windows[:, 0], side) for side in ("left", "right"))
        high = np.where(windows.min(1) < 0, low, high)
        for side in ("left", "right"):
            start, end = low.copy(), high.copy()
            open_ = np.flatnonzero(start < end)
            while len(open_):
                middle = (start[open_] + end[open_]) >> 1
                after = self._compare(self.suffixes[middle], windows[open_]) < (0 if side == "left" else 1)
                start[open_] = np.where(after, middle + 1, start[open_])
                end[open_] = np.where(after, end[open_], middle)
                open_ = open_[start[open_] < end[open_]]
            if side == "left":
                low = start
            else:
                high = start
        return low, high

    def _compare(self, places: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """-1, 0 or 1: whether the suffixes that begin at these places sort before, with or after the windows."""
        out, open_ = np.zeros(len(places), np.int64), np.arange(len(places))
        for j in range(windows.shape[1]):
            # a suffix that ends has differed at its end
            out[open_] = np.sign(self.sequence[places[open_] + j] - windows[open_, j])
            open_ = open_[out[open_] == 0]
        return out

    def matches(self, items: Items) -> tuple[np.ndarray, ...]:
        """Marks hit words; gives a row for each text and item that share a window, as columns: the text, the item, and
        the longest match's words, first word in the text and first word in the item."""
        own, of = self.ranks(items.sequence), np.repeat(np.arange(len(self.counts)), self.counts + 1)
        begin = np.searchsorted(items.ends, items.ends)
        found = [np.zeros((5, 0), np.int64)]
        for n, windows in items.windows.items():
            low, high = self.find(self.ranks(windows))
            live = np.flatnonzero(high > low)
            # windows differ, so all their places are no more than the shard has
            at = self.suffixes[spread(low[live], (high - low)[live])]
            np.add.at(self.hit, at, 1)
            np.add.at(self.hit, at + n, -1)
            tests = np.diff(items.first[n])
            for w, part in self._shares(live, (high - low)[live], tests[live]):
                p, q = part
                p = self.suffixes[low[w] + p]
                q = items.places[n][items.first[n][w] + q]
                # matches that begin earlier are longer
                new = (p == self.first[of[p]]) | (q == begin[q])
                new[~new] = self.sequence[p[~new] - 1] != own[q[~new] - 1]
                p, q = p[new], q[new]
                size, open_ = np.full(len(p), n), np.arange(len(p))
                while len(open_):
                    open_ = open_[q[open_] + size[open_] < items.ends[q[open_]]]
                    open_ = open_[self.sequence[p[open_] + size[open_]] == own[q[open_] + size[open_]]]
                    size[open_] += 1
                found.append(self._longest(np.stack([of[p], items.owner[q], size, p - self.first[of[p]], q - begin[q]])))
            if len(found) > 1:
                found = [self._longest(np.concatenate(found, axis=1))]
        return tuple(found[0])

    @staticmethod
    def _shares(live: np.ndarray, here: np.ndarray, there: np.ndarray) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]]:
        """All pairs of a window's places here and there (numbers from 0), PAIRS or so at a time: the window of each."""
        size = here * there
        group = (np.cumsum(size) - size) // PAIRS if len(size) else size
        for g in np.unique(group):
            some = np.flatnonzero(group == g)
            total = int(size[some].sum())
            ends = np.cumsum(size[some])
            for start in range(0, total, PAIRS):
                number = np.arange(start, min(total, start + PAIRS))
                i = np.searchsorted(ends, number, "right")
                k = number - (ends - size[some])[i]
                yield live[some[i]], (k // there[some[i]], k % there[some[i]])

    @staticmethod
    def _longest(rows: np.ndarray) -> np.ndarray:
        """Of rows of a text and item the longest match, the first of those."""
        rows = rows[:, np.lexsort((rows[4], rows[3], -rows[2], rows[1], rows[0]))]
        new = np.ones(rows.shape[1], bool)
        new[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
        return rows[:, new]

    def hits(self) -> np.ndarray:
        """Hit words of each text."""
        ends = np.concatenate(([0], np.cumsum(np.cumsum(self.hit) > 0)))
        return ends[self.first + self.counts] - ends[self.first]


def _over(docs: DataFrame, items: Benchmark, schema: str | object, text_column: str, emit) -> DataFrame:
    """emit(rows, shard, [(block, its matches)]) for each shard."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text_column, SHARD_BYTES):
                shard = Shard(part.column(text_column))
                yield emit(part, shard, [([block.ids[i] for i in found[1]], found) for block in items for found in [shard.matches(block)]])

    return docs.mapInArrow(run, schema)


def annotate(docs: DataFrame, items: Benchmark, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each row of docs: its id, n_words, n_hit, item_ids (sorted list) and longest (words of its longest match).

    A null text has no words; repeated rows give repeated results; other columns of docs are not carried.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def emit(part: pa.RecordBatch, shard: Shard, found: list) -> pa.RecordBatch:
        ids: list[list] = [[] for _ in shard.counts]
        best = np.zeros(len(ids), np.int64)
        for names, (text, _, size, _, _) in found:
            for d, name in zip(text.tolist(), names):
                ids[d].append(name)
            np.maximum.at(best, text, size)
        return pa.RecordBatch.from_arrays(
            [part.column(id_column), pa.array(shard.counts, pa.int64()), pa.array(shard.hits(), pa.int64()), pa.array([sorted(x) for x in ids], pa.list_(_arrow(items))), pa.array(best)],
            [id_column, "n_words", "n_hit", "item_ids", "longest"],
        )

    return _over(docs.select(id_column, text_column), items, f"{id_column} {kind}, n_words long, n_hit long, item_ids array<{items.kind}>, longest long", text_column, emit)


def _arrow(items: Benchmark) -> pa.DataType:
    return pa.int64() if items.kind == "long" else pa.string()


def longest_matches(docs: DataFrame, items: Benchmark, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each row of docs and item that share a window: words of the longest verbatim match and its place in both (the
    first, if several are as long). Rows without a shared window give none."""
    kind = docs.schema[id_column].dataType.simpleString()

    def emit(part: pa.RecordBatch, shard: Shard, found: list) -> pa.RecordBatch:
        names = [x for block, _ in found for x in block]
        text, _, size, p, q = np.concatenate([np.stack(f) for _, f in found], axis=1)
        return pa.RecordBatch.from_arrays(
            [part.column(id_column).take(pa.array(text)), pa.array(names, _arrow(items)), *map(pa.array, (size, p, q))],
            [id_column, "item_id", "words", "doc_word", "item_word"],
        )

    return _over(docs.select(id_column, text_column), items, f"{id_column} {kind}, item_id {items.kind}, words long, doc_word long, item_word long", text_column, emit)


def decontaminate(docs: DataFrame, items: Benchmark, text_column: str = "text", least_items: int = 1) -> DataFrame:
    """The rows of docs, with all their columns, that share windows with fewer than least_items items. A null text shares
    none; each of repeated rows is judged alike; an empty benchmark keeps all."""

    def emit(part: pa.RecordBatch, shard: Shard, found: list) -> pa.RecordBatch:
        count = np.zeros(part.num_rows, np.int64)
        for _, (text, *_) in found:
            count += np.bincount(text, minlength=part.num_rows)
        return part.filter(pa.array(count < least_items))

    return _over(docs, items, docs.schema, text_column, emit)
