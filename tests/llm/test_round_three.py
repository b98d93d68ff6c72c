"""Cases in which operators were wrong, slow or fell over."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from stoopwise.llm import bpe, mixing, ngram_join, passages, pseudonyms, toxicity

PASSAGE = " ".join(f"shared{i}" for i in range(40))
OTHER = " ".join(f"only{i}" for i in range(60))


@pytest.mark.parametrize("second", [2, None])
def test_texts_that_share_an_id_keep_what_only_they_have(spark, second):
    first = None if second is None else 1
    rows = [(first, PASSAGE), (second, "x. " + PASSAGE), (second, OTHER)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.text for r in passages.without_repeats(docs).collect())
    assert OTHER in kept
    assert sum(PASSAGE in t for t in kept) == 1
    assert len(kept) == 3 and sum(len(t) for t in kept) < len(PASSAGE) + len(OTHER) + 30
    # Rows that agree in id and text are one document.
    twice = spark.createDataFrame([(1, PASSAGE), (1, PASSAGE)], "doc_id long, text string")
    assert [r.text for r in passages.without_repeats(twice).collect()] == [PASSAGE] * 2


def test_the_mix_does_not_follow_the_layout_of_files(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 100)
    rng = random.Random(2)
    rows = [(i % 700, rng.choice("abc"), "w " * rng.randint(0, 300)) for i in range(900)]
    rows += rows[:30]
    found = []
    for parts in (1, 7):
        docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
        docs = docs.repartition(parts) if parts > 1 else docs.coalesce(1)
        mix = mixing.mix(docs)
        found.append(sorted((r.doc_id, r.size, r.target, r.taken) for r in mix.collect()))
    assert found[0] == found[1]


LONG = {
    "addresses": "x@" + "a." * 500_000,
    "labels": "x@a.a. " * 100_000,
    "letters": "a" * 1_000_000,
    "dots": "a." * 500_000,
    "digits": "1" * 1_000_000,
    "brackets": "+1 (" + "(b) " * 250_000,
}


def test_pseudonyms_of_very_long_texts(spark):
    docs = spark.createDataFrame(list(LONG.items()), "doc_id string, text string")
    found = {r.doc_id: r for r in pseudonyms.pseudonymised(docs, "key").collect()}
    assert set(found) == set(LONG)
    assert found["letters"].text == LONG["letters"]
    short = spark.createDataFrame([("s", "mail jo.doe@mail.example.org now")], "doc_id string, text string")
    text = pseudonyms.pseudonymised(short, "key").first().text
    assert re.fullmatch(r"mail [a-z]{2}\.[a-z]{3}@mail\.example\.org now", text) and "jo.doe" not in text


def test_features_of_very_long_texts():
    lexicon, kinds = toxicity.Lexicon(frozenset()), toxicity._kinds()
    began = time.time()
    for text in LONG.values():
        toxicity.features(text, lexicon, kinds)
    assert time.time() - began < 30
    assert toxicity._HIDDEN.findall("sh1t b@st@rd a@ x9y zz") == ["sh1t", "b@st@rd", "x9y"]


def test_hidden_words_are_found_as_before():
    old = re.compile(r"[a-z]+[@$*|!0-9]+[a-z][a-z@$*|!0-9]*")
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choices("ab@1 X", k=rng.randint(0, 12)))
        assert toxicity._HIDDEN.findall(text) == old.findall(text)


def test_tiles_of_long_texts_hold_fewer_of_them(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
    rows = []
    for i in range(40):
        words = list(base)
        words[rng.randrange(300)] = f"other{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(tuple(r) for r in ngram_join.jaccard_join(docs).collect())
    monkeypatch.setattr(ngram_join, "GRAMS_PER_SET", 3)
    assert sorted(tuple(r) for r in ngram_join.jaccard_join(docs).collect()) == whole
    assert {r[2] for r in whole} == {40}


def test_encoding_with_a_check(spark):
    from stoopwise.llm.catalog import vocabulary

    known = vocabulary(spark)
    rows = [(1, "Grüße, two words", "a"), (None, None, "b"), (3, "", None), (1, "x " * 3000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(2)
    found = bpe.encode_checked(docs, known).collect()
    assert len(found) == 4 and all(r.restored for r in found)
    decoder = known.coders()[1]
    assert sorted(decoder.text(r["_ids"]) for r in found) == sorted(t or "" for _, t, _ in rows)
    assert all(r.n_tokens == len(r["_ids"]) for r in found)
    known.forget()
    assert not known._made
    assert sorted(r.ids for r in found if r.ids) == ["a", "b", "c"]


def test_one_row_of_each_class_stays(spark):
    rows = [(2, PASSAGE, "b"), (2, PASSAGE, "a"), (None, PASSAGE, "c"), (5, OTHER, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more string").withColumn("_doc", F.lit(1))
    kept = ngram_join.one_of_each_class(docs).collect()
    assert sorted(r.doc_id for r in kept) == [2, 5]
