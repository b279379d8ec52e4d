import random

import numpy as np
import pyarrow as pa
import xxhash

from factspark.llm import ctw, sigtree, suffix, textkit


def thue_morse(n, letters="ab"):
    return "".join(letters[i.bit_count() & 1] for i in range(n))


def test_words_are_told_apart_by_their_bytes():
    r = random.Random(4)
    words = {"".join(r.choice("ab\0é") for _ in range(r.choice([1, 2, 7, 8, 9, 16, 17, 63, 64, 65, 200]))) for _ in range(4000)} | {"a" * n for n in range(1, 100)}
    texts = [f"  {w}\n" for w in words] + [" ".join(words), None, ""]
    found = textkit.Words(pa.array(texts))
    by_word = dict(zip(words, found.hashes[: len(words)].tolist()))
    assert len(set(by_word.values())) == len(words)
    assert found.hashes[len(words) :].tolist() == [by_word[w] for w in " ".join(words).split(" ")]
    assert by_word["a" * 65] == xxhash.xxh3_64_intdigest(b"a" * 65)
    assert found.counts().tolist() == [1] * len(words) + [len(words), 0, 0]


def test_hash_of_a_word_does_not_depend_on_its_place():
    a, b = textkit.Words(pa.array(["one two", "three"])), textkit.Words(pa.array(["three two one"]))
    assert a.hashes.tolist() == b.hashes[[2, 1, 0]].tolist()


def test_words_of_alternating_sums_do_not_collide(spark):
    one, other = thue_morse(1024), thue_morse(1024, "ba")
    docs = spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string")
    assert {r.component_id for r in sigtree.join(docs, 3, 9, 10).collect()} == {1, 2}
    bench = spark.createDataFrame([(5, other)], "item_id long, text string")
    assert {(r.doc_id, tuple(r.item_ids)) for r in suffix.annotate(docs, suffix.read_items(bench)).collect()} == {(1, ()), (2, (5,))}
    # 6 is held out: crc32("6") % 10 is 0
    both = spark.createDataFrame([(6, one), (2, other)], "doc_id long, text string")
    assert {(r.doc_id, r.held_out, r.n_known) for r in ctw.score(both).collect()} == {(6, True, 1), (2, False, 2)}


def test_nothing_is_kept_of_a_long_text():
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert len(np.unique(textkit.Words(pa.array(["word " * (1 << 20)])).hashes)) == 1
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000
