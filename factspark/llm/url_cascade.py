"""URL filters by cascades of Bloom filters.

Level 0 of a cascade encodes the listed keys; each further level encodes those keys of the other kind that the level
before lets through by mistake: false positives over the corpus's complete key universe, then listed keys that those
make look unlisted, and so on until none is left. A key is walked through the levels and the parity of the first level
that rejects it (or of the last) says whether it is listed: exact for every key of the universe, without a join.
Only the filters travel to the tasks; their size follows the list, not the corpus, and is checked.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut
from .textkit import mix

FIRST_RATE, NEXT_RATE = 1 / 256, 1 / 2
MAX_FILTER_BYTES, MAX_LEVELS = 256 << 20, 64
#: Keys that a task at least puts into a level, as each task gives all words that it sets.
TASK_KEYS = 1_000_000
_LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
_PAIR = "low long, high long"


@dataclass(frozen=True)
class Rule:
    action: str  # allow or block
    host: str
    path: str = "/"

    @property
    def key(self) -> str:
        return self.host + self.path


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path: after the first ://, up to /, ? or #, then up to ? or #; both empty without ://."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    stop = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return rest[:end].translate(_LOWER), path[:stop]


def candidates(host: str, path: str, lengths: Iterable[int]) -> list[tuple[str, str]]:
    """Every (host, path) key that fits: the host and its parent domains with the path's beginnings of the given lengths."""
    hosts, at = [host], host.find(".")
    while at >= 0:
        hosts.append(host[at + 1 :])
        at = host.find(".", at + 1)
    return [(h, path[:n]) for h in hosts for n in lengths if n <= len(path)]


def hashed(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    both = b"".join([xxhash.xxh3_128_digest(k.encode("utf-8", "surrogatepass")) for k in keys])
    pairs = np.frombuffer(both, ">u8").astype(np.uint64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


@dataclass
class Level:
    bits: np.ndarray  # uint64
    probes: int
    number: int

    @staticmethod
    def places(low: np.ndarray, high: np.ndarray, probes: int, number: int, size: int) -> Iterator[np.ndarray]:
        salt = np.uint64((number * 0x9E3779B97F4A7C15) % 2**64)
        with np.errstate(over="ignore"):
            a, b = mix(low ^ salt), mix(high + salt) | np.uint64(1)
            for i in range(probes):
                yield (a + np.uint64(i) * b) % np.uint64(size)

    def holds(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = np.ones(len(low), bool)
        for p in self.places(low, high, self.probes, self.number, 64 * len(self.bits)):
            out &= (self.bits[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


@dataclass
class Cascade:
    levels: list[Level]

    def through(self, low: np.ndarray, high: np.ndarray, upto: int | None = None) -> np.ndarray:
        """Keys that the first levels all hold."""
        out = np.ones(len(low), bool)
        for level in self.levels[:upto]:
            at = np.flatnonzero(out)
            out[at] = level.holds(low[at], high[at])
        return out

    def contains(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        listed, alive = np.zeros(len(low), bool), np.arange(len(low))
        for n, level in enumerate(self.levels):
            alive = alive[level.holds(low[alive], high[alive])]
            listed[alive] = n % 2 == 0
            # those that a level rejects keep the verdict of the level before: held by an even one, listed
        return listed


def _pairs(low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(low.view(np.int64)), pa.array(high.view(np.int64))], ["low", "high"])


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for n in ("low", "high"))


def _set_words(keys: DataFrame, count: int, words: int, probes: int, number: int) -> DataFrame:
    """word, bits: what tasks set in a level of so many words. However the count keys are dealt, few tasks set them, so that
    they give about as many words as the level has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(words, np.uint64)
        for batch in batches:
            for p in Level.places(*_columns(batch), probes, number, 64 * words):
                np.bitwise_or.at(bits, p >> np.uint64(6), np.uint64(1) << (p & np.uint64(63)))
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits[at].view(np.int64))], ["word", "bits"])

    return keys.coalesce(1 + count // TASK_KEYS).mapInArrow(run, "word long, bits long")


def _level(keys: DataFrame, count: int, rate: float, number: int) -> Level:
    """A filter over keys (low, high): set words are combined before and after one small shuffle."""
    words = max(1, int(np.ceil(count * np.log2(1 / rate) * np.log2(np.e) / 64)))
    if words * 8 > MAX_FILTER_BYTES:
        raise ValueError(f"a filter of {count} keys takes {words * 8} bytes; at most {MAX_FILTER_BYTES} are sent to the tasks")
    probes = max(1, round(np.log2(1 / rate)))
    found = _set_words(keys, count, words, probes, number).groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(words, np.uint64)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return Level(bits, probes, number)


def build(listed: DataFrame, universe) -> Cascade:
    """A cascade exact over the universe. listed: one string column, nulls ignored; universe(through) gives the distinct
    key hashes (low, high) of the corpus that the function `through` accepts."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _pairs(*hashed([k for k in batch.column(0).to_pylist() if k is not None]))

    wanted = cut(listed.mapInArrow(hashes, _PAIR).distinct(), "listed")
    count, levels = wanted.count(), []
    if not count:
        return Cascade([])
    levels.append(_level(wanted, count, FIRST_RATE, 0))
    first = Cascade(list(levels))
    others = cut(universe(first.contains).join(wanted, ["low", "high"], "left_anti"), "others")
    sets, counts = [wanted, others], [count, others.count()]
    for n in range(1, MAX_LEVELS):
        if not counts[n % 2]:
            return Cascade(levels)
        levels.append(_level(sets[n % 2], counts[n % 2], NEXT_RATE, n))
        if not counts[1 - n % 2]:
            return Cascade(levels)
        last = Cascade(levels[-1:])

        def passing(batches: Iterator[pa.RecordBatch], last: Cascade = last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                low, high = _columns(batch)
                keep = last.through(low, high)
                yield _pairs(low[keep], high[keep])

        sets[1 - n % 2] = cut(sets[1 - n % 2].mapInArrow(passing, _PAIR), "level")
        counts[1 - n % 2] = sets[1 - n % 2].count()
    raise RuntimeError("the cascade doesn't end: two keys have one hash")


@dataclass
class Filter:
    """Judges urls: the longest fitting rule, else the list of hosts; both held as cascades."""

    allow: Cascade
    block: Cascade
    hosts: Cascade
    lengths: list[int]

    def judge(self, urls: list[str | None]) -> list[tuple[str, str, str | None, str]]:
        parts = [split_url(u) for u in urls]
        keys = [candidates(h, p, self.lengths) for h, p in parts]
        low, high = hashed([a + b for row in keys for a, b in row])
        allowed, blocked, listed = (c.contains(low, high) for c in (self.allow, self.block, self.hosts))
        out, at = [], 0
        for (host, path), row in zip(parts, keys):
            best, verdict, bad = None, None, False
            for j, (a, b) in enumerate(row, at):
                if (allowed[j] or blocked[j]) and (best is None or len(a + b) > len(best)):
                    best, verdict = a + b, "block" if blocked[j] else "allow"
                bad |= bool(listed[j] and not b)
            out.append((host, path, best, verdict or ("block" if bad else "allow")))
            at += len(row)
        return out


def build_filter(urls: DataFrame, rules: list[Rule], hosts: DataFrame, url_column: str = "url") -> Filter:
    """Cascades for rules that allow, rules that block (a key in both blocks) and listed hosts, exact for these urls.

    hosts: one string column of host names in lower case; a listed host stands for its subdomains too.
    """
    spark: SparkSession = urls.sparkSession
    lengths = sorted({0, *(len(r.path) for r in rules)})
    rows = urls.select(F.col(url_column).alias("url"))

    def universe(through):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                low, high = hashed([a + b for u in batch.column("url").to_pylist() for a, b in candidates(*split_url(u), lengths)])
                keep = through(low, high)
                yield _pairs(low[keep], high[keep])

        return rows.mapInArrow(run, _PAIR).distinct()

    keys = lambda x: spark.createDataFrame([(k,) for k in x], "key string")
    allow, block = ([r.key for r in rules if r.action == a] for a in ("allow", "block"))
    return Filter(build(keys(allow), universe), build(keys(block), universe), build(hosts, universe), lengths)


def judge(pages: DataFrame, urls: Filter, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """id, host, path, rule (the longest fitting, else null) and verdict (allow or block) of each row; null urls have
    empty host and path and are allowed; repeated rows give repeated results."""
    kind = pages.schema[id_column].dataType.simpleString()
    shared = pages.sparkSession.sparkContext.broadcast(urls)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.judge(batch.column(url_column).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(id_column), *(pa.array([x[j] for x in found], pa.string()) for j in range(4))], [id_column, "host", "path", "rule", "verdict"])

    return pages.select(id_column, url_column).mapInArrow(run, f"{id_column} {kind}, host string, path string, rule string, verdict string")
