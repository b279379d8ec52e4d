import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from factspark.llm import queries, tokenfile

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, "Á H̱ ẖ", "<|endoftext|> x<|STARTOFTEXT|>y", "it's we'll 'tis don''t", "a b　c\u0085d\x1ce", "!!!''s $$$ 1234 a1b2", "É“—!” ﬁ İ ſ ß Σς", "x̸ ≠", "word. " * 3000, "日本語テキスト が", "\x00\x07 a\x0b\x0cb"]


def brute(rows):
    t, out, start = Tokenizer.from_file(PATH), [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_encoder_is_exact():
    r = random.Random(5)
    texts = [x or "" for x in ODD] + ["".join(r.choice("aAéÉ \n.'!$1̱́ñß—sStT") for _ in range(r.randint(0, 60))) for _ in range(1500)]
    e, t = tokenfile.Encoder(PATH), Tokenizer.from_file(PATH)
    assert e.apart
    got = e.encode(texts)
    assert [np.frombuffer(b, e.width).tolist() for b in got] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    other = tokenfile.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.apart and np.frombuffer(other.encode(["The  cat"])[0], "<u2").tolist() == other.tokenizer.encode("The  cat").ids


def test_round_trip(spark, tmp_path):
    rows = [(7 * i % 101, x) for i, x in enumerate(ODD * 6)] + [(None, "no id"), (3, "same id"), (3, "same id")]
    spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r)[:4] for r in queries.op7_token_files(spark, str(tmp_path)).collect() if r.doc_id is not None)
    want = brute(rows)
    assert got == sorted(x for x in want if x[0] is not None)
    assert sorted(x.n_tokens for x in tokenfile.read(spark, written(spark, rows, tmp_path), with_ids=True).where("size(ids) = n_tokens").collect()) == sorted(x[2] for x in want)


def written(spark, rows, tmp_path):
    tokenfile.write(spark.createDataFrame(rows, "doc_id long, text string"), f"{tmp_path}/files", PATH, 2)
    return f"{tmp_path}/files"


def test_frames_stand_alone(monkeypatch):
    monkeypatch.setattr(tokenfile, "FRAME_TOKENS", 50)
    out, texts = tokenfile.FileWriter(3, "<u2"), {i: np.arange(i, 2 * i + 9, dtype="<u2") for i in range(40)}
    (content,) = [x for i, t in texts.items() for x in out.add(i, t.tobytes())] + list(out.close())
    reader = tokenfile.FileReader(content)
    assert reader.part == 3 and len(reader.index) > 10 and reader.tokens == sum(map(len, texts.values()))
    assert [(i, t.tolist()) for i, t in reader.documents()] == [(i, t.tolist()) for i, t in texts.items()]
    reader = tokenfile.FileReader(content)
    assert reader.lookup([17])[17].tolist() == texts[17].tolist() and reader.decompressed == 1
    with zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True) as s:
        assert len(s.read()) == sum(x[1] for x in reader.sizes)
    broken = bytearray(content)
    broken[reader.starts[0] + 20] ^= 255
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(tokenfile.FileReader(bytes(broken)).documents())


def test_lookup_reads_ends_and_frames_only(spark, tmp_path, monkeypatch):
    rows = [(i, f"text number {i} " * (i % 7)) for i in range(300)]
    path = written(spark, rows, tmp_path)
    assert {i: t.tolist() for i, t in tokenfile.lookup(spark, path, [5, 299, 1000]).items()} == {i: Tokenizer.from_file(PATH).encode(rows[i][1], add_special_tokens=False).ids + [2] for i in (5, 299)}
    read = 0
    for file in tokenfile.stored_files(spark, path):
        real = file.fetch

        def fetch(start, length, real=real):
            nonlocal read
            read += length
            return real(start, length)

        file.fetch = fetch
        file.lookup([5])
    assert 0 < read < sum(p.stat().st_size for p in (tmp_path / "files").glob("part-*")) / 2


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op7_token_files(spark, str(tmp_path)).collect() == []


def test_encoder_remembers_a_bounded_number():
    e = tokenfile.Encoder(PATH)
    for i in range(30):
        e.encode([" ".join(f"w{8000 * i + j}" for j in range(8000))])
    assert len(e.known) + len(e.older) <= 2 * (100_000 + 8000)
