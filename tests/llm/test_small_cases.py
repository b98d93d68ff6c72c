"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from stoopwise.llm import (
    ann,
    bpe,
    exact_dedup,
    langid,
    mixing,
    ngram_join,
    passages,
    pseudonyms,
    secrets,
    toxicity,
)
from stoopwise.llm.catalog import vocabulary

# Names that operators use inside or give to their results.
CLASHING = ("ids", "n_tokens", "decoded", "score", "size", "kept", "_doc", "_row", "_sha", "_text", "_digest",
            "probability", "removed", "lang_pred", "n_card", "_body", "_of", "spans")
LONG = "Der Fluss rinnt am alten Wehr vorbei und trägt Laub. " * 4000
ROWS = [
    (1, "One quiet  line\tof text here.", "en", "a"),
    (2, "One quiet line of text here.", "en", "a"),
    (2, "One quiet line of text here.", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (None, "no id at all, and words enough for two shingles", "en", None),
    (5, LONG, "de", "b"),
    (6, LONG + "!", "de", "c"),
    (7, "1234 !!! ---", None, "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def messy(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    return docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)]).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def whole(df):
    return [r.asDict() for r in df.collect()]


def test_exact_dedup(messy, nothing):
    found = whole(exact_dedup.exact_groups(messy, digest_all=True))
    assert len(found) == len(ROWS)
    twins = [r for r in found if r["doc_id"] in (1, 2)]
    assert {(r["keep_id"], r["group_size"]) for r in twins} == {(1, 3)}
    assert sorted(r["kept"] for r in twins) == [False, False, True]
    # Null counts as the empty text.
    assert {(r["keep_id"], r["kept"]) for r in found if r["doc_id"] in (3, 4)} == {(3, True), (3, False)}
    assert next(r for r in found if r["doc_id"] is None)["kept"]
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r["text_sha256"] == empty for r in found if r["doc_id"] in (3, 4))
    assert exact_dedup.exact_groups(nothing).count() == 0


def test_exact_dedup_by_a_shuffle_is_the_same(messy):
    narrow = exact_dedup.exact_groups(messy, digest_all=True, broadcast_rows=0)
    rows = sorted(whole(narrow), key=str)
    assert rows == sorted(whole(exact_dedup.exact_groups(messy, digest_all=True)), key=str)
    for few in (0, 1000):
        kept = exact_dedup.without_copies(messy, broadcast_rows=few)
        assert kept.columns == messy.columns
        assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 5, 6, 7]


def test_ngram_join(messy, nothing):
    found = whole(ngram_join.jaccard_join(messy))
    assert len(found) == len(ROWS)
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[1]["class_id"] == by_id[2]["class_id"] == 1
    assert by_id[1]["n_links"] == 2 and by_id[1]["n_text_links"] == 1 and by_id[1]["class_size"] == 3
    assert by_id[6]["class_id"] == 5
    # Texts without words link to equal texts only.
    assert by_id[3]["n_links"] == 1 and by_id[3]["n_text_links"] == 0
    kept = ngram_join.one_of_each_class(messy)
    assert kept.columns == messy.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 5, 7]
    assert ngram_join.jaccard_join(nothing).count() == 0
    assert ngram_join.one_of_each_class(nothing).count() == 0


def test_bpe(spark, messy, nothing):
    coder = vocabulary(spark)
    back = bpe.decode(bpe.encode(messy, coder), coder)
    assert [c for c in back.columns if c.endswith(("_ids", "_n_tokens", "_decoded"))] == ["_ids", "_n_tokens"] + (
        ["_decoded"]
    )
    # The clashing column is a number, so decode the new one.
    tokens = bpe.encode(messy.select("doc_id", "text"), coder)
    assert bpe.checked(tokens, coder).where("not restored").count() == 0
    trips = {r.doc_id: r for r in bpe.round_trip(messy, coder).collect()}
    assert trips[3].n_tokens == trips[4].n_tokens == 0
    assert trips[5].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    assert bpe.round_trip(nothing, coder).count() == bpe.encode(nothing, coder).count() == 0


def test_mixing(messy, nothing):
    found = whole(mixing.mix(messy))
    assert len(found) == len(ROWS)
    for row in found:
        assert row["taken"] in (0, row["size"], 2 * row["size"])
    assert sum({r["source_size"]: r["target"] for r in found}.values()) == pytest.approx(
        1.5 * sum(r["size"] for r in found), rel=1e-9
    )
    kept = mixing.mixed_documents(messy)
    assert kept.columns == messy.columns
    assert kept.count() == sum(r["copies"] for r in found)
    assert mixing.mix(nothing).count() == mixing.mixed_documents(nothing).count() == 0


def test_language(messy, nothing):
    model = langid.learn(messy)
    found = {r.doc_id: r for r in langid.identify(messy, model).collect()}
    assert found[7]["_lang_pred"] == found[3]["_lang_pred"] == found[4]["_lang_pred"] == "und"
    assert found[5]["_lang_pred"] == "de" and 0 <= found[5]["_score"] <= 1
    unlearnt = langid.learn(nothing)
    assert {r["lang_pred"] for r in langid.identify(messy.select("text"), unlearnt).collect()} == {"und"}
    assert langid.identify(nothing, model).count() == 0


def test_toxicity(spark, messy, nothing):
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    scorer = toxicity.learn(messy, labels)
    assert {r.score for r in scorer.score(messy).collect()} == {0.0}
    assert toxicity.without_toxic(messy, scorer).columns == messy.columns
    words = "calm river stone path cloud meadow lantern harbour window garden".split()
    rows = [
        (i, " ".join(words[(i * k) % 10] for k in range(1, 9)) + (" you vermin" if i % 4 == 0 else ""), i % 4 == 0)
        for i in range(400)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bad boolean")
    scorer = toxicity.learn(docs, docs.select("doc_id", F.col("bad").cast("int").alias("toxic")))
    found = scorer.score(docs).select("row.bad", "score").collect()
    assert all((r.score >= 0.5) == r.bad for r in found)
    assert scorer.score(messy).count() == len(ROWS)
    assert scorer.score(nothing).count() == 0


def test_language_is_learnt_from_whole_texts(spark):
    # The first 25,000 characters are the same text in both languages.
    head = "the same words in front of all of them " * 640
    tails = {"xx": "zorka mupilo wexa ", "yy": "brennig stahlfe dochtu "}
    rows = [(n, lang, head + tail * (3000 + n)) for lang, tail in tails.items() for n in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    found = langid.identify(docs, langid.learn(docs)).collect()
    assert all(r.lang_pred == r.lang for r in found)


def test_passages(messy, nothing):
    found = {r.doc_id: r for r in passages.repeats(messy).collect()}
    assert 5 in found and 6 in found  # the long text repeats itself
    assert found[6].kept_in[0] == 5
    cut = {r.doc_id: r for r in passages.without_repeats(messy).collect()}
    assert cut[3].text is None and cut[4].text == "" and len(cut[6].text) < 500
    assert passages.repeats(nothing).count() == passages.without_repeats(nothing).count() == 0


def test_pseudonyms(messy, nothing):
    done = pseudonyms.pseudonymised(messy, "k")
    assert done.columns[: len(messy.columns)] == messy.columns and "_n_card" in done.columns
    before = sorted(str(r.text) for r in messy.collect())
    assert sorted(str(r.text) for r in done.collect()) == before
    assert pseudonyms.pseudonymised(nothing, "k").count() == 0


def test_secrets(messy, nothing):
    assert all(r.spans == [] for r in secrets.scanned(messy).collect())
    assert secrets.redacted(messy).columns == messy.columns
    assert secrets.scanned(nothing).count() == 0


def test_nearest(spark):
    rows = [
        (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [None, 1.0]),
        (6, [float("nan"), 1.0]), (7, [0.5, 0.5]), (8, [1.0]), (9, []), (None, [1.0, 1.0]), (10, [float("inf"), 0.0]),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = ann.search(table, F.col("vec_id") % 1 == 0, k=5).collect()
    pairs = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found)
    assert pairs == [
        (1, 1, 2, 1.0), (1, 2, 7, 0.5), (2, 1, 1, 1.0), (2, 2, 7, 0.5), (7, 1, 1, 0.5), (7, 2, 2, 0.5)
    ]
    assert ann.search(table.where("false"), F.lit(True)).count() == 0


def test_no_operator_leaves_out_a_copy_of_a_hot_text(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "the very same text in a third of all rows of this table")
        .otherwise(F.concat(F.lit("row "), F.col("id").cast("string"), F.lit(" is about something of its own")))
        .alias("text"),
    )
    groups = exact_dedup.exact_groups(docs).where("group_size > 1")
    assert groups.count() == 1000 and groups.where("kept").count() == 1
    joined = ngram_join.jaccard_join(docs).where("class_size > 1")
    assert joined.agg(F.min("n_links"), F.max("class_id"), F.count("*")).first()[:] == (999, 0, 1000)
    assert re.fullmatch(r"\d+", str(passages.repeats(docs).where("kept_in[0] = 0").count()))
