"""Jaccard similarity join of word shingles with signature trees.

1. Documents with one set are one class; its smallest id stands for it.
2. Sets that link must share one of the first n - ceil(t * n) + 1 shingles in any fixed order; here those of rare words
   come first, then the hash decides, and frequent shingles are last. Classes that share such a shingle meet in the
   cluster of the smallest of them.
3. A cluster, or a bounded block of a large one, becomes a signature tree: nodes hold the OR of their members' token
   bitmaps and the range of their sizes. Traversing the tree against itself leaves out node pairs whose largest possible
   overlap is too small, and pairs whose members are already connected; what reaches the leaves is verified exactly.
4. Blocks of a large cluster hold its smallest class too, so a family of near copies mostly becomes one component here.
   Only block pairs that still have different components and fitting sizes are then traversed against each other.
No step drops or caps candidates: each pair of different components that could link is pruned by a bound or verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .common import cut, discard, only_ids, pieces, small_batches
from .graph import components

BLOCK, FANOUT = 256, 16
#: Blocks of a cluster that a task compares with the cluster's others.
TOGETHER = 64
#: At most so many frequent words and shingles are told apart in the order; their lists go to all tasks.
FREQUENT = 1 << 18
LEAST_FREQUENT = 32
#: Different words that a task counts at a time.
HELD = 1 << 20


def _sets(part: pa.RecordBatch, text: str, k: int) -> list[np.ndarray]:
    hashes, first = textkit.shingles(textkit.Words(part.column(text)), k)
    return [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:])]


@dataclass
class Order:
    """The common order of shingles: those not frequent first, then by the words' frequencies, then by hash."""

    words: np.ndarray
    classes: np.ndarray
    frequent: np.ndarray

    def prefixes(self, part: pa.RecordBatch, text: str, k: int, num: int, den: int, more: float = 1.0) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The set of each text, and its first shingles in this order: as many as a link needs, times `more`."""
        words = textkit.Words(part.column(text))
        hashes, first = textkit.shingles(words, k)
        known = np.zeros(len(words.hashes) + k, np.int16)
        if len(self.words):
            at = np.searchsorted(self.words, words.hashes)
            at[at == len(self.words)] = 0
            known[: len(words.hashes)] = np.where(self.words[at] == words.hashes, self.classes[at], 0)
        place = np.arange(len(hashes)) - np.repeat(first[:-1] - words.first[:-1], np.diff(first))
        last = np.repeat(words.first[1:], np.diff(first))
        rank = sum(np.where(place + j < last, known[np.minimum(place + j, len(known) - 1)], 0) for j in range(k))
        if len(self.frequent):
            at = np.searchsorted(self.frequent, hashes)
            at[at == len(self.frequent)] = 0
            rank = rank + np.where(self.frequent[at] == hashes, 1 << 12, 0)
        sets, kept = [], []
        for a, b in zip(first[:-1], first[1:]):
            s, at = np.unique(hashes[a:b], return_index=True)
            size = int(_prefix(len(s), num, den) * more)
            sets.append(s)
            kept.append(s[np.argsort(rank[a:b][at], kind="stable")[:size]])
        return sets, kept


def _prefix(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1 if n else 0


def _word_classes(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent words and the logarithms of their counts. Any such list gives a right order, so words that are rare in
    a stretch of a task's texts (as long as HELD different words) needn't be counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def often() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(textkit.signed(keys[n >= 4])), pa.array(n[n >= 4])], ["w", "n"])

        for batch in batches:
            for part in pieces(batch, "text"):
                found = np.unique(textkit.Words(part.column("text")).hashes, return_counts=True)
                keys, at = np.unique(np.concatenate((keys, found[0])), return_inverse=True)
                n = np.bincount(at, np.concatenate((n, found[1])), minlength=len(keys)).astype(np.int64)
                if len(keys) > HELD:
                    yield often()
                    keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        yield often()

    counted = cut(docs.select("text").mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), "words")
    found = _most_frequent(counted, "w", "n", FREQUENT)
    discard(docs.sparkSession, counted)
    keys = found["w"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.log2(found["n"].to_numpy()[order]).astype(np.int16)


def _most_frequent(counted: DataFrame, key: str, n: str, most: int) -> pa.Table:
    """The rows of the largest counts, `most` at most."""
    step = F.floor(F.log2(n) * 4)
    total, least = 0, 1 << 20
    for p, rows in sorted(((r["p"], r["c"]) for r in counted.groupBy(step.alias("p")).agg(F.count(F.lit(1)).alias("c")).collect()), reverse=True):
        total += rows
        if total > most:
            break
        least = p
    return counted.where(step >= least).select(key, n).toArrow()


class Tree:
    """Nodes over members sorted by size. levels[0] has a node for each FANOUT members; each further level combines
    FANOUT nodes."""

    def __init__(self, sets: list[np.ndarray], order: np.ndarray, bits: int):
        self.order, self.sizes = order, np.array([len(sets[i]) for i in order], np.int64)
        shift = np.uint64(64 - (bits.bit_length() - 1))
        self.maps = np.zeros((len(order), bits // 64), np.uint64)
        for row, i in enumerate(order):
            place = sets[i] >> shift
            np.bitwise_or.at(self.maps[row], place >> np.uint64(6), np.uint64(1) << (place & np.uint64(63)))
        # shingles beyond one for each bit that is set
        self.excess = self.sizes - np.bitwise_count(self.maps).sum(1)
        self.levels = []
        maps, low, high, excess = self.maps, self.sizes, self.sizes, self.excess
        while len(maps) > 1 or not self.levels:
            at = np.arange(0, len(maps), FANOUT)
            maps, low, high, excess = np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(excess, at)
            self.levels.append((maps, low, high, excess))

    def members(self, level: int, node: int) -> slice:
        width = FANOUT ** (level + 1)
        return slice(node * width, min((node + 1) * width, len(self.order)))


def _possible(a, b, num: int, den: int) -> np.ndarray:
    """Whether members under each of the nodes a and each of the nodes b may link: sizes fit, and their largest possible
    overlap reaches num * (size + size) / (num + den)."""
    (maps_a, low_a, high_a, excess_a), (maps_b, low_b, high_b, excess_b) = a, b
    common = np.bitwise_count(maps_a[:, None, :] & maps_b[None, :, :]).sum(2).astype(np.int64)
    most = np.minimum(common + np.minimum(excess_a[:, None], excess_b[None, :]), np.minimum(high_a[:, None], high_b[None, :]))
    fits = (den * high_b[None, :] >= num * low_a[:, None]) & (den * high_a[:, None] >= num * low_b[None, :])
    return fits & ((num + den) * most >= num * (low_a[:, None] + low_b[None, :]))


def connect(sets: list[np.ndarray], label: np.ndarray, num: int, den: int, sides: np.ndarray | None = None) -> np.ndarray:
    """label, with linked members' labels joined (the smaller stays). sides: only pairs of different sides are looked at."""
    label = label.copy()
    have = [i for i in range(len(sets)) if len(sets[i])]
    groups = [have] if sides is None else [[i for i in have if sides[i] == s] for s in (0, 1)]
    if not all(groups):
        return label
    bits = 1 << max(9, min(16, int(4 * max(len(sets[i]) for i in have) - 1).bit_length()))
    trees = [Tree(sets, np.array(sorted(g, key=lambda i: (len(sets[i]), int(sets[i][0])))), bits) for g in groups]
    a, b = trees[0], trees[-1]
    same = a is b
    stack = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while stack:
        level_a, node_a, level_b, node_b = stack.pop()
        in_a, in_b = a.members(level_a, node_a), b.members(level_b, node_b)
        here = label[a.order[in_a]]
        if (here == here[0]).all() and (label[b.order[in_b]] == here[0]).all():
            continue
        if level_a or level_b:
            # go down in the higher node, in both if they are equally high
            down_a, down_b = level_a >= level_b, level_b >= level_a
            kids_a = range(node_a * FANOUT, min((node_a + 1) * FANOUT, len(a.levels[level_a - 1][0]))) if down_a else [node_a]
            kids_b = range(node_b * FANOUT, min((node_b + 1) * FANOUT, len(b.levels[level_b - 1][0]))) if down_b else [node_b]
            to_a, to_b = level_a - down_a, level_b - down_b
            ok = _possible([x[list(kids_a)] for x in a.levels[to_a]], [x[list(kids_b)] for x in b.levels[to_b]], num, den)
            stack += [(to_a, kids_a[i], to_b, kids_b[j]) for i, j in zip(*np.nonzero(ok)) if not same or to_a != to_b or kids_a[i] <= kids_b[j]]
            continue
        rows = lambda t, s: (t.maps[s], t.sizes[s], t.sizes[s], t.excess[s])
        for i, j in zip(*np.nonzero(_possible(rows(a, in_a), rows(b, in_b), num, den))):
            x, y = a.order[in_a.start + i], b.order[in_b.start + j]
            if (same and in_a.start + i >= in_b.start + j) or label[x] == label[y]:
                continue
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if den * both >= num * (len(sets[x]) + len(sets[y]) - both):
                new, old = sorted((label[x], label[y]))
                label[label == old] = new
    return label


def _over_blocks(rows: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Edges (a, b) found within each block. rows: block key columns b1, b2, b3, then id, text, label and side."""
    keys = ["b1", "b2", "b3"]

    def flush(held: list) -> tuple[list[int], list[int]]:
        ids = np.array([h[0] for h in held], np.int64)
        label = np.array([h[1] for h in held], np.int64)
        sides = np.array([h[2] for h in held])
        # rows of one id are one node
        new = connect([h[3] for h in held], label, num, den, sides if sides.any() else None)
        moved = np.flatnonzero(new != ids)
        return ids[moved].tolist(), new[moved].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            for part in pieces(batch, "text"):
                out: tuple[list[int], list[int]] = ([], [])
                columns = [part.column(c).to_pylist() for c in (*keys, "id", "label", "side")]
                for x, y, z, i, label, side, s in zip(*columns, _sets(part, "text", k)):
                    if (x, y, z) != last:
                        if len(held) > 1:
                            for o, v in zip(out, flush(held)):
                                o += v
                        held, last = [], (x, y, z)
                    held.append((i, label, side, s))
                yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], ["a", "b"])
        if len(held) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in flush(held)], ["a", "b"])

    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def _order(docs: DataFrame, k: int, num: int, den: int) -> Order:
    """The order for these documents: frequent shingles are those that many sets would otherwise have among their first
    (up to a quarter more are counted, as others make room)."""
    order = Order(*_word_classes(docs), np.zeros(0, np.uint64))
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                kept = shared.value.prefixes(part, "text", k, num, den, 1.25)[1]
                yield pa.RecordBatch.from_arrays([pa.array(textkit.signed(np.concatenate(kept or [np.zeros(0, np.uint64)])))], ["s"])

    counted = docs.select("text").mapInArrow(run, "s long").groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_FREQUENT)
    counted = cut(counted, "frequent")
    found = _most_frequent(counted, "s", "n", FREQUENT)
    discard(docs.sparkSession, counted)
    shared.unpersist()
    return Order(order.words, order.classes, np.sort(found["s"].to_numpy().astype(np.int64).view(np.uint64)))


def join(docs: DataFrame, k: int, num: int, den: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_shingles, component_id of each row: documents whose sets of k-word shingles have a Jaccard similarity of
    num/den or more are linked, and a component is named by its smallest id.

    Words are runs of other bytes than ASCII white space, A-Z lower-cased. A text of fewer than k words is one shingle;
    a null text or one without words has none and is linked with nothing. Rows of one id are one document with several
    texts. A row without id is alone; its component_id is null.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = _sets(part, "text", k)
                prints = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), ">i8").astype(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0].copy()), pa.array(prints[:, 1].copy())], ["id", "n", "f1", "f2"])

    described = cut(rows.mapInArrow(describe, "id long, n long, f1 long, f2 long"), "sets")
    known = described.where("id is not null and n > 0")
    classes = cut(known.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.min("n").alias("n")), "classes")
    shared = spark.sparkContext.broadcast(_order(rows, k, num, den))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                kept = shared.value.prefixes(part, "text", k, num, den)[1]
                ids = part.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(x) for x in kept])), pa.array(textkit.signed(np.concatenate(kept or [np.zeros(0, np.uint64)])))], ["rep", "s"])

    # a few documents that stand for no class may come along: they link to the one that has their set
    tokens = cut(only_ids(rows.where("id is not null"), "id", classes.select("rep")).mapInArrow(begin, "rep long, s long"), "tokens")
    shared.unpersist()
    leaders = tokens.groupBy("s").agg(F.min("rep").alias("leader"), F.max("rep").alias("most")).where("leader < most").drop("most")
    members = cut(tokens.join(leaders, "s").select("leader", "rep").distinct(), "members")
    discard(spark, tokens)
    counts = members.groupBy("leader").agg(F.count(F.lit(1)).alias("c"))
    sizes = known.groupBy(F.col("id").alias("rep")).agg(F.max("n").alias("n"), F.min("n").alias("m"))
    placed = members.join(counts, "leader").join(sizes, "rep")
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num)))
    large = F.col("c") > BLOCK
    # a block's size class and a share of it; a class has at most c members, so shares are of BLOCK members on average
    placed = placed.select("leader", "rep", "n", "m", "c", F.when(large, step).otherwise(0).cast("long").alias("b2"))
    shares = placed.where(large).groupBy("leader", "b2").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("shares"))
    placed = placed.join(shares, ["leader", "b2"], "left")
    split = cut(placed.select("leader", "b2", F.when(F.col("shares").isNull(), 0).otherwise(F.pmod(F.xxhash64("rep"), F.col("shares"))).cast("long").alias("b3"), "rep", "n", "m", large.alias("large")), "placed")
    discard(spark, members)
    placed = split
    blocks = placed.where("large").select("leader", "b2", "b3").distinct()
    seats = placed.select("leader", "b2", "b3", "rep").unionByName(blocks.select("leader", "b2", "b3", F.col("leader").alias("rep"))).distinct()
    texts = only_ids(rows.where("id is not null"), "id", seats.select("rep"))
    first = seats.join(texts, seats["rep"] == texts["id"]).select(F.col("leader").alias("b1"), "b2", "b3", "id", "text", F.col("id").alias("label"), F.lit(0).alias("side"))
    edges = cut(_over_blocks(first, k, num, den), "links")
    found = components(edges)
    if placed.where("large").limit(1).count():
        label = F.coalesce("component", "rep")
        big = cut(placed.where("large").join(found, F.col("rep") == F.col("node"), "left").select("leader", "b2", "b3", "rep", "n", "m", label.alias("label")), "large")
        nodes = big.groupBy("leader", "b2", "b3").agg(F.min("m").alias("low"), F.max("n").alias("high"), F.min("label").alias("l1"), F.max("label").alias("l2"))
        # the blocks of a large cluster are dealt to several tasks, each of which meets all of the cluster's
        parts = nodes.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("parts"))
        nodes = cut(nodes.withColumn("k", F.struct("b2", "b3")).join(parts, "leader"), "nodes")
        x = nodes.withColumn("deal", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int")).alias("x")
        y = nodes.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("y")
        fits = (F.col("x.k") < F.col("y.k")) & (F.col("x.high") * den >= F.col("y.low") * num) & (F.col("y.high") * den >= F.col("x.low") * num)
        differ = (F.least("x.l1", "y.l1") != F.greatest("x.l2", "y.l2"))
        pairs = x.join(y, (F.col("x.leader") == F.col("y.leader")) & (F.col("x.deal") == F.col("y.deal")) & fits & differ).select(F.col("x.leader").alias("leader"), F.col("x.k").alias("kx"), F.col("y.k").alias("ky"))
        pairs = cut(pairs.withColumn("p", F.xxhash64("leader", "kx", "ky")), "pairs")
        ends = pairs.select("leader", "p", F.col("kx").alias("k"), F.lit(0).alias("side")).unionByName(pairs.select("leader", "p", F.col("ky").alias("k"), F.lit(1).alias("side")))
        seats = big.withColumn("k", F.struct("b2", "b3")).join(ends, ["leader", "k"]).select("leader", "p", "side", "rep", "label")
        texts = only_ids(rows.where("id is not null"), "id", seats.select("rep"))
        second = seats.join(texts, seats["rep"] == texts["id"]).select(F.col("leader").alias("b1"), F.col("p").alias("b2"), F.lit(0).cast("long").alias("b3"), "id", "text", "label", "side")
        # labels are nodes too: an edge to a label is an edge to its component
        found = components(edges.unionByName(_over_blocks(second, k, num, den)))
    reps = classes.select("f1", "f2", "rep").join(found, F.col("rep") == F.col("node"), "left").select("f1", "f2", F.coalesce("component", "rep").alias("component_id"))
    out = known.select("id", "n", "f1", "f2").join(reps, ["f1", "f2"]).select("id", "n", "component_id")
    rest = described.where("id is null or n = 0").select("id", "n", F.col("id").alias("component_id"))
    return out.unionByName(rest).select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that stand for their component: the smallest id's, one row of it (that
    with the smallest text). Rows without id all stay; so does each document without words."""
    found = join(docs, k, num, den, id_column, text_column)
    stay = found.where(F.col(id_column) == F.col("component_id")).select(F.col(id_column).alias("stays")).distinct()
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (id_column, text_column)]
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.struct(F.col(text_column), F.col(id_column), *rest).alias("row"))
    kept = rows.join(stay, F.col("id") == F.col("stays")).groupBy("id").agg(F.min("row").alias("row"))
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns)).unionByName(docs.where(F.col(id_column).isNull()))
