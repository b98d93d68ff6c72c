"""Packing against the tokenizers library, and every id in exactly one place."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stoopwise.llm import packing
from stoopwise.llm.catalog import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def source():
    import public_tokenizers

    return packing.tokenizer_source(public_tokenizers.path("word_bpe_49k.json"))


def check_sequences(pieces, capacity):
    """Sequences are gapless from 0 on, numbered without gaps, and full but for powers of two."""
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for found in sequences.values():
        end = 0
        for offset, length in sorted(found):
            assert offset == end and length > 0
            end += length
        assert end == capacity or (end < capacity and end & (end - 1) == 0)


def test_query_equals_the_library(spark, source):
    from tokenizers import Tokenizer

    known = Tokenizer.from_str(source)
    rows = queries()["op11_packing"](spark, FOLDER).collect()
    check_sequences(rows, 4096)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert set(by_doc) == {d.doc_id for d in docs}
    for d in docs:
        ids = [*known.encode(d.text or "", add_special_tokens=False).ids, 2]
        start = 0
        for p in sorted(by_doc[d.doc_id], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (start, len(ids))
            part = np.array(ids[start : start + p.length], "<u4").tobytes()
            assert p.ids_crc32 == zlib.crc32(part)
            start += p.length
        assert start == len(ids)


def test_words_are_encoded_like_whole_texts(source):
    encoder = packing.WordEncoder(source)
    assert encoder.by_words
    rng = random.Random(3)
    texts = ["<|endoftext|>", "a<|endoftext|>b", "ΑΣ ΣΑΣ", "x\x1cy\x85z\xa0w", "é ́a", "İstanbul ŉ ſt"]
    for alphabet in ("abc dehinorst'", "aeiou \n\t12'éñß漢字🙂ελΣ .,-_İ́²½", "'st 'REa<|endoftext|>"):
        texts += ["".join(rng.choices(alphabet, k=rng.randint(0, 50))) for _ in range(300)]
    for text in texts:
        whole = encoder.whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.ids(text.encode()), "<u4").tolist() == whole


def test_forgetting_changes_nothing(source, monkeypatch):
    monkeypatch.setattr(packing, "MOST_WORDS", 3)
    monkeypatch.setattr(packing, "MOST_PIECES", 2)
    encoder = packing.WordEncoder(source)
    for text in ("one two three four five", "five four one", "six two one, two"):
        whole = encoder.whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.ids(text.encode()), "<u4").tolist() == whole


@pytest.mark.parametrize("seed", range(60))
def test_every_item_has_one_place(seed):
    rng = random.Random(seed)
    capacity = rng.choice([8, 16, 64])
    histogram = {rng.randint(1, capacity): rng.choice([1, 2, 3, 10, 200]) for _ in range(rng.randint(0, 20))}
    plan = packing.Plan(histogram, capacity)
    taken = {}
    for of, count in histogram.items():
        for rank in range(count):
            start = 0
            for at, length, sequence, offset in plan.pieces(of, rank):
                assert at == start
                start += length
                taken.setdefault(sequence, []).append((offset, length))
            assert start == of
    assert sorted(taken) == list(range(len(taken)))
    short = 0
    for found in taken.values():
        end = 0
        for offset, length in sorted(found):
            assert offset == end
            end += length
        short += end < capacity
        assert end == capacity or end & (end - 1) == 0
    assert short <= capacity.bit_length()


def test_longest_first_into_the_shortest_pack():
    # 6 and 5 open packs, 3 fits the pack of 5 as the shorter one, 2 the pack of 6.
    patterns = packing.shortest_pack_first({6: 1, 5: 1, 3: 1, 2: 1}, 8)
    assert sorted(sorted(of for of, _ in p.items) for p in patterns) == [[2, 6], [3, 5]]
    # A class of a million is as quick as one of four.
    patterns = packing.shortest_pack_first({5: 10**6, 3: 10**6 + 1}, 8)
    assert sum(p.count * len(p.items) for p in patterns) == 2 * 10**6 + 1
    assert len(patterns) == 2


def test_small_cases(spark, source):
    long = "the river runs past the old mill and carries leaves " * 3000
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (2, "", None), (3, long, "y"), (4, " \n ", "z")]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string, start string")
    docs = docs.withColumn("_ids", F.lit(1)).withColumn("sequence_id", F.lit("s")).repartition(3)
    pieces = packing.packed(docs, source, capacity=64).collect()
    check_sequences(pieces, 64)
    assert sum(p.length for p in pieces if p.doc_id == 1) == 4 * 3
    assert sum(p.length for p in pieces if p.doc_id is None) == 2
    assert sum(p.length for p in pieces if p.doc_id == 3) == 2 * p_tokens(source, long)
    assert all(len(p.ids) == 4 * p.length for p in pieces)
    assert packing.packed(docs.limit(0), source).count() == 0


def p_tokens(source, text):
    from tokenizers import Tokenizer

    return len(Tokenizer.from_str(source).encode(text, add_special_tokens=False).ids) + 1


def test_other_tokenizers_read_whole_texts(spark):
    import public_tokenizers

    source = packing.tokenizer_source(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = packing.WordEncoder(source)
    assert not encoder.by_words
    text = "  two  spaces\nand more"
    whole = encoder.whole.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.ids(text.encode()), "<u4").tolist() == whole
