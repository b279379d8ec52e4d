"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions, each with a context tree of its own over the bytes before it. A node of a tree mixes
the Krichevsky-Trofimov estimate of its own counts with the product of its children, half and half; so the model mixes
all depths, each weighted by how well it codes the training texts, and gives a code length for every byte.

Training needs only the counts of byte n-grams in the training texts, which are combined before and after one shuffle.
All of them stay. The tree is a table sharded by the SHARD bytes before a byte: a task holds the subtrees of a part of
the shards, only the nodes above them (contexts of under SHARD bytes) go everywhere. Scoring is one pass over all texts
with the exact logs of the MAX_GRAMS most frequent n-grams; the places of others are joined to the shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit
from .common import cut, partitions, pieces, small_batches

DEPTH, SHARD, MAX_GRAMS, MAX_WORDS = 5, 3, 1 << 18, 1 << 19
#: Shards are dealt to so many parts, or as many as tasks if those are more.
PARTS = 1021
#: Texts are worked on in slices of so many bytes: a gram takes eight bytes in each of several arrays.
SLICE_BYTES, HELD = 1 << 20, 1_500_000
_B = np.uint64(8)


def sequence(texts: pa.Array, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' (context, byte) grams: lower-cased bytes, then a 0 that ends each text; contexts begin with zeros.

    Returns the grams, most recent byte lowest, of every place; the first place of each text; its number of places.
    Places beyond those are padding.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    pad = "\0" * (depth + 1)
    one = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(texts)], pa.int64()), texts), pa.scalar(pad, pa.large_string()))
    raw = np.frombuffer(one[0].as_buffer(), np.uint8) if len(texts) else np.zeros(0, np.uint8)
    data = np.zeros(len(raw) + 2 * depth + 1, np.uint8)
    data[depth : depth + len(raw)] = textkit._LOWER[raw]
    grams = data.astype(np.uint64)
    for j in range(1, depth + 1):
        grams[j:] |= data[:-j].astype(np.uint64) << np.uint64(8 * j)
    first = depth + np.concatenate(([0], np.cumsum(size + depth + 1)))[:-1]
    return grams, first, size + 1


def _places(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.arange(int(count.sum())) + np.repeat(first - np.concatenate(([0], np.cumsum(count)))[:-1], count)


def lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0, by Stirling's series at x + 8."""
    shift = sum(np.log(x + i) for i in range(8))
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - lgamma(zeros + ones + 1.0) - np.log(np.pi)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key in sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _add_up(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[at], *(np.add.reduceat(v[order], at) if len(at) else v for v in values)


@dataclass
class Model:
    """grams[d]: kept (context of d bytes, byte) keys; logs[d]: log10 of the byte where no deeper context is kept;
    contexts[d]: kept contexts; nodes[d], one[d], beyond[d]: binary nodes (context, bit prefix), and the probability of
    a 1 where the node's context is the deepest kept, and where a deeper one is kept that never met the prefix."""

    grams: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    nodes: list[np.ndarray]
    one: list[np.ndarray]
    beyond: list[np.ndarray]

    @property
    def depth(self) -> int:
        return len(self.grams) - 1

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of the lowest byte of each gram after the bytes above it."""
        out, open_ = np.zeros(len(grams)), np.arange(len(grams))
        rare: list[tuple[int, np.ndarray]] = []
        for d in range(self.depth, -1, -1):
            key = grams[open_] & np.uint64((1 << 8 * (d + 1)) - 1)
            at, there = _find(self.grams[d], key)
            out[open_[there]] = self.logs[d][at[there]]
            open_, key = open_[~there], key[~there]
            kept = _find(self.contexts[d], key >> _B)[1] if d else np.ones(len(key), bool)
            if kept.any():
                rare.append((d, open_[kept]))
            open_ = open_[~kept]
        for d, at in rare:
            few, back = np.unique(grams[at] & np.uint64((1 << 8 * (d + 1)) - 1), return_inverse=True)
            out[at] = self._bits(d, few)[back]
        return out

    def _bits(self, d: int, grams: np.ndarray) -> np.ndarray:
        """The same for bytes that their deepest kept context, of d bytes, hasn't kept."""
        byte, context = grams & np.uint64(255), grams >> _B
        out = np.zeros(len(grams))
        for j in range(8):
            prefix = (np.uint64(1) << np.uint64(j)) | (byte >> np.uint64(8 - j))
            p, open_ = np.full(len(grams), 0.5), np.arange(len(grams))
            for e in range(d, -1, -1):
                key = (context[open_] & np.uint64((1 << 8 * e) - 1)) << _B | prefix[open_]
                at, there = _find(self.nodes[e], key)
                p[open_[there]] = (self.one if e == d else self.beyond)[e][at[there]]
                open_ = open_[~there]
            bit = (byte >> np.uint64(7 - j)) & np.uint64(1)
            out += np.log10(np.where(bit == 1, p, 1 - p))
        return out


def _tables(counts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, ...]]:
    """Binary nodes and their counts of zeros and ones, of each depth's grams."""
    tables = []
    for keys, n in counts:
        parts = []
        byte, context = keys & np.uint64(255), keys >> _B
        for j in range(8):
            prefix = (np.uint64(1) << np.uint64(j)) | (byte >> np.uint64(8 - j))
            one = ((byte >> np.uint64(7 - j)) & np.uint64(1)).astype(np.float64) * n
            parts.append(_add_up(context << _B | prefix, n - one, one))
        tables.append(_add_up(*(np.concatenate([p[i] for p in parts]) for i in range(3))))
    return tables


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << 8 * n) - 1)


def _parents(keys: np.ndarray, d: int) -> np.ndarray:
    """The nodes above nodes of depth d."""
    return ((keys >> _B) & _mask(d - 1)) << _B | (keys & np.uint64(255))


def _rise(tables: list, low: int, below: np.ndarray | None = None) -> tuple[list, list, list, np.ndarray]:
    """From the deepest up, the tables being of depth low and more: places of the nodes above, weights of stopping, what
    is left of a node's counts for contexts that aren't kept, and the log weights of the subtrees of depth low.

    below: log weights under the deepest nodes, whose contexts are all kept.
    """
    above = [None] + [_find(tables[i - 1][0], _parents(tables[i][0], low + i))[0] for i in range(1, len(tables))]
    stop, rest = [None] * len(tables), [None] * len(tables)
    weight = log_kt(*tables[-1][1:])
    stop[-1] = np.ones(len(weight))
    if below is not None:
        both = np.logaddexp(weight, below)
        stop[-1], weight = np.exp(weight - both), both - np.log(2)
        rest[-1] = (np.zeros(len(weight)), np.zeros(len(weight)))
    for i in range(len(tables) - 2, -1, -1):
        keys, zeros, ones = tables[i]
        sums = [np.bincount(above[i + 1], v, minlength=len(keys)) for v in (*tables[i + 1][1:], weight)]
        rest[i] = (np.maximum(zeros - sums[0], 0), np.maximum(ones - sums[1], 0))
        own, under = log_kt(zeros, ones), sums[2] + log_kt(*rest[i])
        weight = np.logaddexp(own, under) - np.log(2)
        stop[i] = np.exp(own - np.logaddexp(own, under))
    return above, stop, rest, weight


def _fall(tables: list, counts: list, above: list, stop: list, rest: list, mixed: np.ndarray, left: np.ndarray) -> tuple[Model, np.ndarray, np.ndarray]:
    """From the first table down: the mixture so far and the weight that is left for deeper nodes, for the first table's
    nodes at first and for the last one's at last."""
    model = Model([], [], [], [], [], [])
    for d, (keys, zeros, ones) in enumerate(tables):
        if d:
            mixed, left = mixed[above[d]], left[above[d]]
        kt = (ones + 0.5) / (zeros + ones + 1)
        mixed, left = mixed + left * stop[d] * kt, left * (1 - stop[d])
        one = mixed if rest[d] is None else mixed + left * (rest[d][1] + 0.5) / (rest[d][0] + rest[d][1] + 1)
        model.nodes.append(keys)
        model.one.append(np.clip(one, 1e-12, 1 - 1e-12).astype(np.float32).clip(1e-7, 1 - 1e-7))
        model.beyond.append(np.clip(mixed + left / 2, 1e-7, 1 - 1e-7).astype(np.float32).clip(1e-7, 1 - 1e-7))
        grams = counts[d][0]
        byte, context, total = grams & np.uint64(255), grams >> _B, np.zeros(len(grams))
        for j in range(8):
            at = _find(keys, context << _B | (np.uint64(1) << np.uint64(j)) | (byte >> np.uint64(8 - j)))[0]
            p = model.one[d][at].astype(np.float64)
            total += np.log10(np.where((byte >> np.uint64(7 - j)) & np.uint64(1) == 1, p, 1 - p))
        model.grams.append(grams)
        model.logs.append(total.astype(np.float32))
        model.contexts.append(np.unique(context))
    return model, mixed, left


def build(counts: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """A model of the kept grams (sorted keys and counts) of each depth; a gram's shorter ones must be kept too."""
    tables = _tables(counts)
    above, stop, rest, _ = _rise(tables, 0)
    n = len(tables[0][0])
    return _fall(tables, counts, above, stop, rest, np.zeros(n), np.ones(n))[0]


def _shorter(keys: np.ndarray, n: np.ndarray, depth: int, low: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted keys and counts of the grams of depth low to depth, given all of the deepest."""
    out = [_add_up(keys, n)]
    for d in range(depth - 1, low - 1, -1):
        out.append(_add_up(out[-1][0] & _mask(d + 1), out[-1][1]))
    return out[::-1]


@dataclass
class Top:
    """The nodes above the shards, which are alike for all: their model, and what is left for the shards at its last nodes."""

    model: Model
    mixed: np.ndarray
    left: np.ndarray
    depth: int

    def with_shards(self, keys: np.ndarray, n: np.ndarray) -> Model:
        """The whole model for contexts of these shards, all of whose deepest grams are given."""
        low = len(self.model.grams)
        counts = _shorter(keys, n, self.depth, low)
        tables = _tables(counts)
        above, stop, rest, _ = _rise(tables, low)
        at = _find(self.model.nodes[-1], _parents(tables[0][0], low))[0]
        sub = _fall(tables, counts, above, stop, rest, self.mixed[at], self.left[at])[0]
        return Model(*(getattr(self.model, f) + getattr(sub, f) for f in ("grams", "logs", "contexts", "nodes", "one", "beyond")))


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and counts of each part, of rows sorted by part."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    current = None
    for batch in batches:
        part, keys = batch.column("part").to_numpy(), batch.column("key").to_numpy().astype(np.int64).view(np.uint64)
        n = batch.column("n").to_numpy().astype(np.float64)
        edges = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)]))
        for a, b in zip(edges[:-1], edges[1:]):
            if a == b:
                continue
            if held and part[a] != current:
                yield np.concatenate([k for k, _ in held]), np.concatenate([m for _, m in held])
                held = []
            current = part[a]
            held.append((keys[a:b], n[a:b]))
    if held:
        yield np.concatenate([k for k, _ in held]), np.concatenate([m for _, m in held])


def _top(grams: DataFrame, depth: int, low: int) -> Top:
    """The nodes of contexts under low bytes; grams: part, key, n of all deepest grams, a shard's in one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n in _by_part(batches):
            tables = _tables(_shorter(keys, n, depth, low))
            nodes = _add_up(_parents(tables[0][0], low), _rise(tables, low)[3])
            for kind, (k, v) in enumerate((nodes, _add_up(keys & _mask(low), n))):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(v)], ["kind", "key", "v"])

    dealt = grams.repartition(max(2, partitions(grams.sparkSession)), "part").sortWithinPartitions("part")
    found = dealt.mapInArrow(run, "kind int, key long, v double").groupBy("kind", "key").agg(F.sum("v").alias("v")).toArrow().combine_chunks()
    kind, keys, v = found["kind"].to_numpy(), found["key"].to_numpy().view(np.uint64), found["v"].to_numpy()
    counts = _shorter(keys[kind == 1], v[kind == 1], low - 1, 0)
    tables = _tables(counts)
    nodes, weights = _add_up(keys[kind == 0], v[kind == 0])
    assert np.array_equal(nodes, tables[-1][0])
    above, stop, rest, _ = _rise(tables, 0, weights)
    n = len(tables[0][0])
    return Top(*_fall(tables, counts, above, stop, rest, np.zeros(n), np.ones(n)), depth)


def held_out(doc_id: Column, of: int = 10) -> Column:
    """Documents that no training sees: crc32 of the id as text is 0 modulo `of`; so are those without id."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % of == 0


def _threshold(counted: DataFrame, most: int, group: str | None = None) -> int:
    """The least count so that at most `most` rows (of any group) have it or more."""
    step = F.ceil(F.log2("n") * 4)
    rows = counted.groupBy(F.col(group) if group else F.lit(0).alias("g"), step.alias("p")).agg(F.count(F.lit(1)).alias("c")).collect()
    least = 0
    for g in {r[0] for r in rows}:
        total = 0
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: -r["p"]):
            total += r["c"]
            if total > most:
                least = max(least, r["p"] + 1)
                break
    # rows whose rounded-up logarithm is `least` or more have at least this count
    return 1 if not least else int(np.floor(2 ** ((least - 1) / 4))) + 1


def _counted(docs: DataFrame, depth: int) -> DataFrame:
    """kind, key, n: how often each deepest gram (kind 0) and each word (1; the end of a text is the word 0) occurs."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])

        def give(kind: int) -> pa.RecordBatch:
            keys, n = _add_up(np.concatenate([k for k, _ in held[kind]]), np.concatenate([n for _, n in held[kind]]))
            held[kind].clear()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["kind", "key", "n"])

        for batch in batches:
            for part in pieces(batch, "text", SLICE_BYTES):
                grams, first, count = sequence(part.column("text"), depth)
                held[0].append(np.unique(grams[_places(first, count)], return_counts=True))
                words = textkit.Words(part.column("text")).hashes
                held[1].append(np.unique(np.append(words, np.zeros(part.num_rows, np.uint64)), return_counts=True))
                for kind in (0, 1):
                    if sum(len(k) for k, _ in held[kind]) > HELD:
                        yield give(kind)
        for kind in (0, 1):
            if held[kind]:
                yield give(kind)

    return cut(docs.select("text").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")


def _total(words: DataFrame) -> int:
    return int(words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


def train(docs: DataFrame, depth: int = DEPTH, most: int = MAX_GRAMS) -> tuple[Model, DataFrame, int]:
    """A bounded model, for one process, of the texts of docs (column text); their words (key: hash, n: count) as a table;
    their number, ends included. Scoring does not use it.

    At no depth more than `most` grams stay; the contexts that don't share one child of the node above.
    """
    counted = _counted(docs, depth)
    by_depth = None
    grams = counted.where("kind = 0").select("key", "n")
    for d in range(depth, -1, -1):
        if d < depth:
            grams = cut(grams.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * (d + 1)) - 1)).alias("key")).agg(F.sum("n").alias("n")), f"grams{d}")
        this = grams.withColumn("d", F.lit(d))
        by_depth = this if by_depth is None else by_depth.unionByName(this)
    least = _threshold(by_depth, most, "d")
    found = by_depth.where(F.col("n") >= least).toArrow().combine_chunks()
    d_of, keys, n = found["d"].to_numpy(), found["key"].to_numpy().view(np.uint64), found["n"].to_numpy().astype(np.float64)
    model = build([_add_up(keys[d_of == d], n[d_of == d]) for d in range(depth + 1)])
    words = counted.where("kind = 1").select("key", "n")
    return model, words, _total(words)


def score(docs: DataFrame, of: int = 10, depth: int = DEPTH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row.

    A null text is empty: its end is coded all the same. Words' counts beyond the MAX_WORDS most frequent ones, and logs
    of grams beyond the MAX_GRAMS most frequent ones, which go to the tasks, are joined in.
    """
    if depth < 1:
        raise ValueError("contexts have a byte at least")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).withColumn("held", held_out(F.col("id"), of))
    counted = _counted(rows.where("not held"), depth)
    low, n_tasks = min(SHARD, depth), max(2, partitions(spark))
    n_parts = max(PARTS, n_tasks | 1)
    shard = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << 8 * low) - 1))
    # a task takes some parts at a time
    groups = min(n_parts, 4 * n_tasks + 1)
    tree = counted.where("kind = 0").select((shard % F.lit(n_parts) % F.lit(groups)).cast("int").alias("part"), "key", "n")
    shared_top = spark.sparkContext.broadcast(_top(tree, depth, low))
    frequent = _threshold(tree.select("n"), MAX_GRAMS)

    def logs_of_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n in _by_part(batches):
            if (n >= frequent).any():
                keys, n = _add_up(keys, n)
                logs = shared_top.value.with_shards(keys, n).logs[-1]
                yield pa.RecordBatch.from_arrays([pa.array(keys[n >= frequent].view(np.int64)), pa.array(logs[n >= frequent])], ["key", "log"])

    found = tree.repartition(n_tasks, "part").sortWithinPartitions("part").mapInArrow(logs_of_frequent, "key long, log float").toArrow().combine_chunks()
    order = np.argsort(found["key"].to_numpy().astype(np.int64).view(np.uint64))
    gram_keys, gram_logs = found["key"].to_numpy().astype(np.int64).view(np.uint64)[order], found["log"].to_numpy().astype(np.float64)[order]
    words = counted.where("kind = 1").select("key", "n")
    total = _total(words)
    distinct = words.count()
    least = _threshold(words, MAX_WORDS)
    often = words.where(F.col("n") >= least).toArrow().combine_chunks()
    keys, n = _add_up(often["key"].to_numpy().astype(np.int64).view(np.uint64), often["n"].to_numpy().astype(np.int64))
    shared = spark.sparkContext.broadcast((gram_keys, gram_logs, keys, n))
    below = float(np.log10(total + 0.1 * (distinct + 1)))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, held boolean, n_tokens long, n_known long, base double, score double, bytes long, keys array<long>, times array<int>, uid long, part int, grams array<long>, rows array<int>"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram_keys, gram_logs, keys, n = shared.value
        logs = np.log10(n + 0.1) - below
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in pieces(batch, "text", SLICE_BYTES):
                size = part.num_rows
                grams, first, count = sequence(part.column("text"), depth)
                grams = grams[_places(first, count)]
                at, there = _find(gram_keys, grams)
                code = np.where(there, gram_logs[at], 0.0) if len(gram_keys) else np.zeros(len(grams))
                ask, ask_row = grams[~there], np.repeat(np.arange(size), count)[~there]
                ends = np.concatenate(([0], np.cumsum(count)))
                found = np.add.reduceat(code, ends[:-1]) if size else code
                words = textkit.Words(part.column("text"))
                row = np.concatenate((np.repeat(np.arange(size), words.counts()), np.arange(size)))
                token = np.append(words.hashes, np.zeros(size, np.uint64))
                at, there = _find(keys, token)
                base = np.bincount(row[there], logs[at[there]], minlength=size)
                known = np.bincount(row[there], minlength=size)
                order = np.lexsort((token[~there], row[~there]))
                row, token = row[~there][order], token[~there][order]
                new = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (row[1:] != row[:-1])))) if len(row) else np.zeros(0, np.int64)
                offsets = pa.array(np.searchsorted(row[new], np.arange(size + 1)), pa.int32())
                times = np.diff(np.append(new, len(row))).astype(np.int32)
                columns = [part.column("id"), part.column("held"), pa.array(words.counts() + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(found), pa.array(count - 1, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(token[new].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(times))]
                types = [c.type for c in columns]
                empty = [pa.nulls(size, t) for t in (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(uid + np.arange(size)), *empty], names)
                if len(ask):
                    to = ((ask >> _B) & _mask(low)) % np.uint64(n_parts)
                    order = np.argsort(to.astype(np.uint16 if n_parts < 1 << 16 else np.uint64), kind="stable")
                    ask, ask_row, to = ask[order], ask_row[order], to[order]
                    edges = np.concatenate(([0], np.flatnonzero(np.diff(to)) + 1, [len(to)]))
                    offsets = pa.array(edges, pa.int32())
                    lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (ask.view(np.int64), ask_row.astype(np.int32))]
                    m = len(edges) - 1
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(m, t) for t in types), pa.array(np.full(m, uid, np.int64)), pa.array(to[edges[:-1]].astype(np.int32)), *lists], names)
                uid += size

    scored = cut(rows.mapInArrow(run, schema), "scored")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, tree, model = None, [], None
        asked: list[pa.RecordBatch] = []
        waiting = 0

        def work() -> Iterator[pa.RecordBatch]:
            nonlocal model, waiting
            if not asked:
                return
            if model is None:
                keys, n = (np.concatenate([x[i] for x in tree]) if tree else np.zeros(0, t) for i, t in ((0, np.uint64), (1, np.float64)))
                model = shared_top.value.with_shards(keys, n)
            size = np.concatenate([pc.list_value_length(x.column("grams")).to_numpy(zero_copy_only=False) for x in asked])
            few, back = np.unique(np.concatenate([x.column("grams").flatten().to_numpy() for x in asked]).view(np.uint64), return_inverse=True)
            row = np.concatenate([x.column("rows").flatten().to_numpy() for x in asked]).astype(np.uint64)
            keys, code = _add_up(np.repeat(np.arange(len(size), dtype=np.uint64), size) << np.uint64(32) | row, model.log10(few)[back])
            ends = pa.array(np.searchsorted(keys, np.arange(len(size) + 1, dtype=np.uint64) << np.uint64(32)), pa.int32())
            row = (keys & np.uint64((1 << 32) - 1)).astype(np.int32)
            uid = pa.concat_arrays([x.column("uid") for x in asked])
            asked.clear()
            waiting = 0
            yield pa.RecordBatch.from_arrays([uid, pa.ListArray.from_arrays(ends, pa.array(row)), pa.ListArray.from_arrays(ends, pa.array(code))], ["uid", "rows", "codes"])

        for batch in batches:
            part, asks = batch.column("part").to_numpy(), batch.column("asks").to_numpy()
            edges = np.concatenate(([0], np.flatnonzero((np.diff(part) != 0) | (np.diff(asks) != 0)) + 1, [len(part)]))
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if part[a] != current:
                    yield from work()
                    current, tree, model = part[a], [], None
                some = batch.slice(a, b - a)
                if not asks[a]:
                    tree.append((some.column("key").to_numpy().astype(np.int64).view(np.uint64), some.column("n").to_numpy().astype(np.float64)))
                    continue
                asked.append(some)
                waiting += len(some.column("grams").flatten())
                if waiting > HELD:
                    yield from work()
        yield from work()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def give() -> pa.RecordBatch:
            uid, code = _add_up(np.concatenate([u for u, _ in held]), np.concatenate([c for _, c in held]))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(uid), pa.array(code)], ["uid", "code"])

        for batch in batches:
            rows = batch.column("rows")
            size = pc.list_value_length(rows).to_numpy(zero_copy_only=False)
            held.append((np.repeat(batch.column("uid").to_numpy(), size) + rows.flatten().to_numpy(), batch.column("codes").flatten().to_numpy()))
            if sum(len(u) for u, _ in held) > HELD:
                yield give()
        if held:
            yield give()

    asks = scored.where("part is not null").select((F.col("part") % F.lit(groups)).alias("part"), F.lit(1).alias("asks"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("long").alias("n"), "uid", "grams", "rows")
    both = asks.unionByName(tree.withColumn("asks", F.lit(0)), allowMissingColumns=True)
    answers = both.repartition(n_tasks, "part").sortWithinPartitions("part", "asks").mapInArrow(answer, "uid long, rows array<int>, codes array<double>")
    answers = answers.repartition(n_tasks, "uid").sortWithinPartitions("uid").mapInArrow(add_up, "uid long, code double")
    done = scored.where("part is null").drop("part", "grams", "rows")
    rest = done.select("uid", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("uid", F.col("x.keys").alias("key"), F.col("x.times").alias("times"))
    rest = rest.join(words.where(F.col("n") < least), "key", "left")
    more = (F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1)) - F.lit(below)) * F.col("times")
    rest = rest.select("uid", more.alias("more"), F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0).alias("known"))
    rest = rest.unionByName(answers, allowMissingColumns=True).groupBy("uid").agg(F.sum("more").alias("more"), F.sum("known").alias("known"), F.sum("code").alias("code"))
    out = done.drop("keys", "times").join(rest, "uid", "left").withColumn("score", F.col("score") + F.coalesce("code", F.lit(0.0)))
    return out.select(
        F.col("id").alias(id_column),
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
        (-F.col("score") * F.lit(float(np.log2(10))) / F.greatest(F.col("bytes"), F.lit(1))).alias("bits_per_byte"),
    )
