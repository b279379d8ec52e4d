"""Token ids in seekable files of independent zstandard frames.

A file is: data frames; one skippable frame (magic 0x184D2A50) with the document index; the seek table of the public
seekable format (a skippable frame, magic 0x184D2A5E, of compressed size, decompressed size and checksum of each frame
before it, then frame count, descriptor 0x80 and magic 0x8F92EAB1). A checksum is the low 32 bits of XXH64 of the
decompressed frame. A data frame holds, little-endian: u32 documents, u8 bytes of an id (2 or 4), a u8 for each document
(0: its id is null), i64 document ids, u32 token counts, and the token ids. The index holds u32 part, u32 file, and for
each data frame i64 first id, i64 last id, u32 documents, u64 tokens. So a reader needs the end of a file and the
frames with the documents it wants, nothing else.

Files leave the executors through Spark's own committed writer, so any file system works and a task that runs again
leaves one copy: one row is one file, and the four bytes that end a seek table are the writer's line separator.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, partitions, pieces, small_batches

FRAME_TOKENS, FILE_BYTES, LEVEL = 1 << 16, 8 << 20, 3
END = "\xb1\xea\x92\x8f"
_INDEX_MAGIC, _SEEK_MAGIC = 0x184D2A50, 0x184D2A5E
_ENTRY = struct.Struct("<qqIQ")


class Encoder:
    """Exact ids of whole texts. Where the tokenizer treats stretches between ASCII white space apart (lower-casing word
    BPE that drops white space), each distinct stretch is encoded once and remembered."""

    #: Distinct stretches that are remembered and not looked up lately go beyond twice this number, which changes no result.
    REMEMBERED = 100_000
    _WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: A full stop or comma after anything but an ASCII letter or digit, a letter from U+00C0 to U+00FF, or white space.
    _JOINED_SIGN = re.compile(rb"[.,](?:(?<=[!-/:-@\[-`{-\x7f\x00-\x08\x0e-\x1f].)|(?<=[\x80-\xff].)(?<!\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        plan = json.loads(self.tokenizer.to_str())
        vocabulary = self.tokenizer.get_vocab()
        self.width = "<u2" if len(vocabulary) <= 1 << 16 else "<u4"
        self.special = [x["content"].lower() for x in plan["added_tokens"]]
        kinds = [x["type"] for x in (plan["normalizer"] or {}).get("normalizers", [])]
        steps = (plan["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.apart = kinds == ["NFC", "Replace", "Lowercase"] and steps[0].get("pattern") == {"Regex": self._WORD_PATTERN} and steps[0].get("invert") is True
        suffix = plan["model"].get("end_of_word_suffix") or None
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.width).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of stretches of letters, encoded together and parted where a word ends."""
        out = []
        for n in range(0, len(words), 500):
            part = words[n : n + 500]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.width)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part):
                raw, ends = ids.tobytes(), (ends * ids.itemsize).tolist()
                out += [raw[a:b] for a, b in zip([0, *ends], ends)]
            else:  # some letter changes its kind when it is lower-cased
                out += self._raw(part)
        return out

    def _learn(self, stretches: set[bytes]) -> None:
        if len(self.known) > self.REMEMBERED:
            self.known, self.older = {}, self.known
        new = stretches - self.known.keys()
        found = new & self.older.keys()
        self.known.update((s, self.older[s]) for s in found)
        new = list(new - found)
        texts = [s.decode() for s in new]
        for letters, encode in ((True, self._words), (False, self._raw)):
            at = [i for i, t in enumerate(texts) if t.isalpha() is letters]
            self.known.update(zip([new[i] for i in at], encode([texts[i] for i in at])))

    def _stretches(self, text: str) -> list[bytes]:
        raw = text.encode()
        # ASCII letters may be lower-cased first unless a combining mark (U+0300 to U+036F) could join them
        if b"\xcc" not in raw and b"\xcd" not in raw:
            raw = raw.lower()
        # a sign that follows a letter or digit begins a stretch of its own, so "word" and "word," share an entry
        if b"'" not in raw and not self._JOINED_SIGN.search(raw):
            raw = raw.replace(b".", b" .").replace(b",", b" ,")
        return raw.split()

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text as little-endian bytes of this encoder's width."""
        texts = list(texts)
        if not self.apart:
            return self._raw(texts)
        whole = [i for i, t in enumerate(texts) if any(x in t.lower() for x in self.special)]
        apart = set(range(len(texts))).difference(whole)
        rows = [self._stretches(t) if i in apart else [] for i, t in enumerate(texts)]
        self._learn(set().union(*rows))
        known = self.known
        out = [b"".join([known[s] for s in r]) for r in rows]
        for i, b in zip(whole, self._raw([texts[i] for i in whole])):
            out[i] = b
        return out


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class FileWriter:
    """Gathers documents into frames and files; finished files come out of add() and close()."""

    def __init__(self, part: int, width: str):
        self.part, self.width, self.files = part, width, 0
        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self._new_file()

    def _new_file(self) -> None:
        self.frames, self.sizes, self.index, self.bytes = [], [], [], 0
        self._new_frame()

    def _new_frame(self) -> None:
        self.ids, self.tokens, self.held = [], [], 0

    def add(self, doc_id: int | None, tokens: bytes) -> Iterator[bytes]:
        self.ids.append(doc_id)
        self.tokens.append(tokens)
        self.held += len(tokens)
        if self.held >= FRAME_TOKENS * int(self.width[-1]):
            self._end_frame()
            if self.bytes >= FILE_BYTES:
                yield self._end_file()

    def _end_frame(self) -> None:
        if not self.ids:
            return
        each = int(self.width[-1])
        counts = np.array([len(t) // each for t in self.tokens], "<u4")
        raw = b"".join([struct.pack("<IB", len(self.ids), each), bytes(i is not None for i in self.ids), np.array([i or 0 for i in self.ids], "<i8").tobytes(), counts.tobytes(), *self.tokens])
        packed = self.pack.compress(raw)
        real = [i for i in self.ids if i is not None] or [0]
        self.frames.append(packed)
        self.sizes.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.index.append(_ENTRY.pack(real[0], real[-1], len(self.ids), int(counts.sum(dtype=np.int64))))
        self.bytes += len(packed)
        self._new_frame()

    def _end_file(self) -> bytes:
        body = struct.pack("<II", self.part, self.files) + b"".join(self.index)
        index = struct.pack("<II", _INDEX_MAGIC, len(body)) + body
        sizes = [*self.sizes, (len(index), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]
        table = b"".join(struct.pack("<III", *x) for x in sizes)
        out = b"".join([*self.frames, index, struct.pack("<II", _SEEK_MAGIC, len(table) + 9), table, struct.pack("<IBI", len(sizes), 0x80, 0x8F92EAB1)])
        self.files += 1
        self._new_file()
        return out

    def close(self) -> Iterator[bytes]:
        self._end_frame()
        if self.frames:
            yield self._end_file()


class FileReader:
    """Random access to one file: its bytes, or its size and a function that fetches (start, length) of them. Only its end
    and the frames asked for are fetched; each frame is verified."""

    def __init__(self, content: bytes | None = None, size: int = 0, fetch: Callable[[int, int], bytes] | None = None):
        if content is not None:
            size, fetch = len(content), lambda start, length: content[start : start + length]
        self.fetch = fetch
        count, flag, magic = struct.unpack("<IBI", fetch(size - 9, 9))
        if magic != 0x8F92EAB1 or flag != 0x80:
            raise ValueError("no seek table")
        table = fetch(size - 9 - 12 * count, 12 * count)
        self.sizes = list(struct.iter_unpack("<III", table))
        self.starts = np.concatenate(([0], np.cumsum([x[0] for x in self.sizes]))).tolist()
        body = fetch(self.starts[-2] + 8, self.starts[-1] - self.starts[-2] - 8)
        self.part, self.file = struct.unpack("<II", body[:8])
        self.index = list(_ENTRY.iter_unpack(body[8:]))
        self.tokens = sum(x[3] for x in self.index)
        self.decompressed = 0

    def frame(self, n: int) -> list[tuple[int | None, np.ndarray]]:
        packed, raw_size, checksum = self.sizes[n]
        raw = zstandard.ZstdDecompressor().decompress(self.fetch(self.starts[n], packed), max_output_size=raw_size)
        if len(raw) != raw_size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {n} is damaged")
        self.decompressed += 1
        docs, each = struct.unpack("<IB", raw[:5])
        there = raw[5 : 5 + docs]
        at = 5 + docs
        ids, counts = np.frombuffer(raw, "<i8", docs, at).tolist(), np.frombuffer(raw, "<u4", docs, at + 8 * docs)
        tokens = np.frombuffer(raw, f"<u{each}", int(counts.sum(dtype=np.int64)), at + 12 * docs)
        return list(zip([i if t else None for i, t in zip(ids, there)], np.split(tokens, np.cumsum(counts)[:-1]) if docs else []))

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for n in range(len(self.index)):
            yield from self.frame(n)

    def lookup(self, doc_ids: Iterable[int]) -> dict[int, np.ndarray]:
        wanted, found = set(doc_ids), {}
        for n, (first, last, _, _) in enumerate(self.index):
            if any(first <= i <= last for i in wanted):
                found |= {i: t for i, t in self.frame(n) if i in wanted}
        return found


def stored_files(spark: SparkSession, path: str) -> Iterator[FileReader]:
    """Readers of the files of a folder on any file system that Spark reaches; each fetches only what it is asked for."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in sorted(fs.listStatus(folder), key=lambda s: s.getPath().getName()):
        if status.isFile() and status.getLen() and not status.getPath().getName().startswith(("_", ".")):

            def fetch(start: int, length: int, at=status.getPath()) -> bytes:
                stream = fs.open(at)
                try:
                    stream.seek(start)
                    return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
                finally:
                    stream.close()

            yield FileReader(size=status.getLen(), fetch=fetch)


def lookup(spark: SparkSession, path: str, doc_ids: Iterable[int]) -> dict[int, np.ndarray]:
    """Token ids of a few documents, from the driver: only the ends of files and the frames that may hold them are read."""
    wanted, found = set(doc_ids), {}
    for file in stored_files(spark, path):
        found |= file.lookup(wanted)
    return found


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Write the ids of each whole text in ascending order of document id, nulls first; a null text is empty.

    Texts are dealt by ranges of the id, so a partition's files follow those of the one before. Rows with one id stay
    next to each other, ordered by text.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        encoder = _encoder(tokenizer)
        end = b"" if end_id is None else np.array([end_id], encoder.width).tobytes()
        out = FileWriter(TaskContext.get().partitionId(), encoder.width)
        row = lambda b: pa.RecordBatch.from_arrays([pa.array([b[:-4]], pa.binary())], ["content"])
        for batch in batches:
            for part in pieces(batch, "t"):
                for i, ids in zip(part.column("i").to_pylist(), encoder.encode(x or "" for x in part.column("t").to_pylist())):
                    yield from map(row, out.add(i, ids + end))
        yield from map(row, out.close())

    rows = docs.select(F.col(id_column).cast("long").alias("i"), F.col(text_column).alias("t"))
    n = max(partitions(spark), rows.rdd.getNumPartitions())
    files = rows.repartitionByRange(n, "i").sortWithinPartitions("i", "t").mapInArrow(run, "content binary")
    files.select(F.col("content").cast("string")).write.option("lineSep", END).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


def _contents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where("length > 0").select("content")


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """A row for each document in the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of
    little-endian unsigned 32-bit ids), part, file, and with with_ids also ids."""
    schema = "part long, file long, doc_id long, within long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                file, at = FileReader(content.as_py()), 0
                for n in range(len(file.index)):
                    rows = file.frame(n)
                    counts = np.array([len(t) for _, t in rows], np.int64)
                    columns = [
                        pa.array([file.part] * len(rows), pa.int64()),
                        pa.array([file.file] * len(rows), pa.int64()),
                        pa.array([i for i, _ in rows], pa.int64()),
                        pa.array(at + np.cumsum(counts) - counts),
                        pa.array(counts),
                        pa.array([zlib.crc32(t.astype("<u4").tobytes()) for _, t in rows], pa.int64()),
                    ]
                    if with_ids:
                        columns.append(pa.array([t.astype(np.int32) for _, t in rows], pa.list_(pa.int32())))
                    at += int(counts.sum())
                    yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [FileReader(c.as_py()) for c in batch.column("content")]
            yield pa.RecordBatch.from_arrays([pa.array([getattr(f, k) for f in files], pa.int64()) for k in ("part", "file", "tokens")], ["part", "file", "tokens"])

    totals = _contents(spark, path).mapInArrow(sums, "part long, file long, tokens long")
    # sums of a part's files, then of the parts: a row for each is all that comes together
    earlier = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = cut(totals, "files")
    parts = totals.groupBy("part").agg(F.sum("tokens").alias("tokens")).select("part", earlier(Window.orderBy("part"), "tokens").alias("parts"))
    before = totals.select("part", "file", earlier(Window.partitionBy("part").orderBy("file"), "tokens").alias("files")).join(parts, "part")
    before = before.select("part", "file", (F.col("files") + F.col("parts")).alias("before"))
    docs = _contents(spark, path).mapInArrow(run, schema).join(before, ["part", "file"])
    return docs.select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "part", "file", *["ids"] * with_ids)
