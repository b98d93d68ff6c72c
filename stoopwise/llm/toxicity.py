"""Toxicity scores: boosted trees over dense features, calibrated by isotonic regression.

A scan turns every whole text into a few densities and rates: words of a given and of a
learnt lexicon, the second person, capitals, punctuation and obfuscation. Spark's
gradient-boosted trees score them, and an isotonic regression maps the scores to
probabilities. Scoring shuffles nothing.

What is learnt comes from a bounded sample of labelled rows, the ``most_learnt`` first by a
hash of the id. Its rows fall into four folds by another hash. Three of them give the
lexicon and the trees, where the lexicon a row is measured by comes from the other two, so
that trees do not trust a lexicon that has seen the row; the fourth gives the calibration.
Lexicon entries are words and beginnings of words, which covers inflected forms.

A null text counts as empty; an empty text has features like any other. Of an id's labels
the highest counts, a null label is none. Without labels of both kinds the score is the share of
toxic labels, 0 if there are none.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoopwise.llm.common import few_at_a_time, free_name, ship, text_of
from stoopwise.session import dropped, written

MOST_LEARNT = 20_000
FOLDS = 4
# Beginnings of words that can be lexicon entries, by length.
BEGINNINGS = (4, 5, 6)
# An entry is in so many toxic rows, and in such a share of them, at least; words that only
# a few copies of one text have are none. It is so many times as likely in toxic rows.
LEAST_ROWS = 3
LEAST_SHARE = 0.02
LEAST_RATIO = 12.0
MOST_CANDIDATES = 50_000
MOST_ENTRIES = 2_000
TREES = 30
RAW_SHARE = 0.05
DEPTH = 3
BINS = 400
MOST_WORDS_KNOWN = 300_000

GIVEN = frozenset(
    """
    arse arsehole ass asshole bastard bitch bollocks bullshit clown coward creep crap cretin
    cunt damn degenerate dick dimwit dirtbag disgrace disgusting douche dumb dumbass dunce
    fool freak fuck fucker fucking garbage halfwit hate idiot idiotic imbecile jerk kill lame
    liar loser lunatic maggot moron moronic motherfucker nasty numbskull parasite pathetic pig
    prick psycho rat retard rubbish scum scumbag shit shitty shut simpleton sleazy slob slut
    stupid sucker swine trash twat ugly useless vermin vile weasel whore worthless wretch
    abschaum arschloch depp dumm dummkopf hurensohn idioten mistkerl schwein trottel vollidiot
    abruti batard connard conne cretin debile encule idiote imbecile merde ordure salaud salope
    basura cabron escoria estupido gilipollas hijoputa imbecil inutil mierda pendejo puta tonto
    """.split()
)
SECOND_PERSON = frozenset(
    """
    you your yours yourself yourselves u ur thou thee thy
    du dich dir dein deine deinen deiner deines euch euer eure ihr
    tu te toi ton ta tes vous votre vos
    tú ti tus usted ustedes vosotros vuestro
    """.split()
)
# Characters that stand for letters.
LEET = str.maketrans("@4301!|$5789", "aaeoiiissbbg")
NAMES = (
    "given_density", "given_hits", "learnt_density", "learnt_hits", "hidden_hits", "second_person",
    "capitals", "shouted_words", "exclamations", "questions", "punctuation", "digits",
    "obfuscated", "stretched", "spelled_out", "log_words", "word_length",
)

_WORD = re.compile(r"\w+")
# Possessive and from a border on, so that long runs of letters are read once.
_HIDDEN = re.compile(r"(?<![a-z])[a-z]++[@$*|!0-9]++[a-z][a-z@$*|!0-9]*+")
_STRETCHED = re.compile(r"([^\W\d_])\1\1")
_SPELLED = re.compile(r"(?<!\w)(?:\w[ .*_-]){3,}\w(?!\w)")
_SHOUTED = re.compile(r"\b[^\W\d_a-z]{2,}\b")

_POINTS = 0x3000


def _kinds() -> dict[str, np.ndarray]:
    """Tables of the first code points: letters, capitals, digits, punctuation."""
    chars = [chr(i) for i in range(_POINTS)]
    return {
        "letter": np.array([c.isalpha() for c in chars]),
        "capital": np.array([c.isupper() for c in chars]),
        "digit": np.array([c.isdigit() for c in chars]),
        "mark": np.array([not (c.isalnum() or c.isspace()) for c in chars]),
    }


class Lexicon(dict):
    """Counts of given, learnt and second-person words, packed into one number per word."""

    SHIFT = 40

    def __init__(self, entries: frozenset[str], given: frozenset[str] = GIVEN):
        super().__init__()
        self.entries, self.given = entries, given

    def __missing__(self, word: str) -> int:
        if len(self) > MOST_WORDS_KNOWN:
            self.clear()
        # Given words count as learnt ones too, so that one feature holds all of them.
        learnt = (
            word in self.given
            or word in self.entries
            or any(word[:n] + "*" in self.entries for n in BEGINNINGS if len(word) >= n)
        )
        value = (word in self.given) | learnt << self.SHIFT | (word in SECOND_PERSON) << 2 * self.SHIFT
        self[word] = value
        return value

    def counts(self, words: list[str]) -> tuple[int, int, int]:
        total = sum(map(self.__getitem__, words))
        low = (1 << self.SHIFT) - 1
        return total & low, total >> self.SHIFT & low, total >> 2 * self.SHIFT


def features(text: str, lexicon: Lexicon, kinds: dict[str, np.ndarray]) -> list[float]:
    lower = text.lower()
    words = _WORD.findall(lower)
    count = max(1, len(words))
    given, learnt, second = lexicon.counts(words)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = points[points < _POINTS]
    letters = max(1, int(kinds["letter"][points].sum()))
    chars = max(1, len(text))
    hidden = _HIDDEN.findall(lower)
    shown = lexicon.counts([w.translate(LEET).replace("*", "") for w in hidden])
    return [
        given / count,
        math.log1p(given),
        learnt / count,
        math.log1p(learnt),
        math.log1p(shown[1]),
        second / count,
        int(kinds["capital"][points].sum()) / letters,
        len(_SHOUTED.findall(text)) / count,
        text.count("!") / chars,
        text.count("?") / chars,
        int(kinds["mark"][points].sum()) / chars,
        int(kinds["digit"][points].sum()) / chars,
        len(hidden) / count,
        len(_STRETCHED.findall(lower)) / count,
        len(_SPELLED.findall(lower)) / count,
        math.log1p(len(words)),
        sum(map(len, words)) / count,
    ]


def _terms(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    return words.union(w[:n] + "*" for w in words for n in BEGINNINGS if len(w) >= n)


def _counted(rows: DataFrame, only: frozenset[str] | None) -> DataFrame:
    """In how many rows of each fold a term is; ``rows`` has _fold and _text."""

    def run(batches):
        import pyarrow as pa

        found: Counter[tuple[int, str]] = Counter()
        for batch in batches:
            for fold, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                terms = _terms(text)
                found.update((fold, t) for t in (terms if only is None else terms & only))
        keys = list(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()),
             pa.array(list(found.values()), pa.int64())],
            names=["_fold", "_term", "_n"],
        )

    return (
        rows.select("_fold", "_text")
        .mapInArrow(run, "_fold int, _term string, _n bigint")
        .groupBy("_fold", "_term")
        .agg(F.sum("_n").alias("_n"))
    )


def _lexicon(
    toxic: dict[str, np.ndarray], clean: dict[str, np.ndarray], rows: dict[int, np.ndarray], folds: list[int]
) -> tuple[frozenset[str], frozenset[str]]:
    """Terms of the folds that are so much likelier in toxic rows, and given words that are not refuted.

    A given word is refuted by clean rows: it means something else in their language.
    """
    all_toxic, all_clean = (int(rows[label][folds].sum()) for label in (1, 0))
    scored = []
    none = np.zeros(FOLDS, np.int64)

    def seen(term: str) -> tuple[int, int, float]:
        hits, misses = (int(t.get(term, none)[folds].sum()) for t in (toxic, clean))
        return hits, misses, (hits / max(1, all_toxic)) / ((misses + 0.5) / max(1, all_clean))

    refuted = {word for word in GIVEN if seen(word)[1] >= 2 and seen(word)[2] < LEAST_RATIO}
    for term in toxic:
        hits, _, ratio = seen(term)
        if hits >= max(LEAST_ROWS, LEAST_SHARE * all_toxic) and ratio >= LEAST_RATIO:
            scored.append((-hits, term))
    return frozenset(term for _, term in sorted(scored)[:MOST_ENTRIES]), GIVEN - refuted


class Scorer:
    """What was learnt: the lexicon, the trees and the calibration."""

    def __init__(self, lexicon: tuple[frozenset[str], frozenset[str]], trees, calibration, constant: float | None):
        self.lexicon, self.trees, self.calibration, self.constant = lexicon, trees, calibration, constant

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Each row as the struct ``row``, and its ``score``."""
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
        if self.constant is not None:
            return docs.select(row, F.lit(float(self.constant)).alias("score"))
        # A text goes to Python and back once.
        dense = free_name(docs, "_dense")
        measured = _measured(docs, text, dense, {0: self.lexicon})
        vectors = measured.select(row, array_to_vector(F.col(dense)).alias("_vector"))
        raw = self.trees.setFeaturesCol("_vector").transform(vectors)
        raw = raw.withColumn("_raw", vector_to_array("probability")[1])
        if self.calibration is None:
            return raw.select("row", F.col("_raw").alias("score"))
        done = self.calibration.setFeaturesCol("_raw").setPredictionCol("_step").transform(raw)
        # The steps of the calibration tie many rows; a little of the raw score orders them.
        score = (1 - RAW_SHARE) * F.col("_step") + RAW_SHARE * F.col("_raw")
        return done.select("row", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"))


def _measured(docs: DataFrame, text: str, name: str, lexicons: dict[int, tuple[frozenset[str], frozenset[str]]], fold: str | None = None) -> DataFrame:
    """``docs`` with the features in the column ``name``; ``fold`` chooses the lexicon."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(lexicons)
    at = docs.columns.index(text)
    fold_at = docs.columns.index(fold) if fold else None
    names = [*docs.columns, name]

    def run(batches):
        import pyarrow as pa

        known = {k: Lexicon(*v) for k, v in sent.value.items()}
        kinds = _kinds()
        for batch in few_at_a_time(batches):
            texts = batch.column(at).to_pylist()
            which = batch.column(fold_at).to_pylist() if fold else [0] * len(texts)
            rows = [features(t or "", known[k], kinds) for t, k in zip(texts, which, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.float64()))], names=names)

    fields = docs.select("*", F.lit(None).cast("array<double>").alias(name)).schema
    return docs.mapInArrow(run, fields)


def learn(
    docs: DataFrame,
    labels: DataFrame,
    learnt: Column | None = None,
    id: str = "doc_id",  # noqa: A002
    text: str = "text",
    label: str = "toxic",
    most_learnt: int = MOST_LEARNT,
) -> Scorer:
    """A scorer from the rows of ``labels`` that ``learnt`` chooses, all by default."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull())
    known = known.where(learnt) if learnt is not None else known
    chosen = (
        known.groupBy(F.col(id).alias("_id"))
        .agg(F.max(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id", F.lit(1)), "_id")
        .limit(most_learnt)
        .withColumn("_fold", F.pmod(F.xxhash64("_id", F.lit(2)), F.lit(FOLDS)).cast("int"))
    )
    texts = docs.select(F.col(id).alias("_id"), text_of(text).alias("_text"))
    # The sample is bounded by most_learnt.
    sample = written(texts.join(F.broadcast(chosen), "_id"), "toxic-sample")
    sizes = {0: np.zeros(FOLDS, np.int64), 1: np.zeros(FOLDS, np.int64)}
    for row in sample.groupBy("_label", "_fold").count().collect():
        sizes[min(1, max(0, row["_label"]))][row["_fold"]] += row["count"]
    training = list(range(FOLDS - 1))
    total = sum(int(s.sum()) for s in sizes.values())
    if not all(sizes[k][training].sum() for k in (0, 1)):
        dropped(sample)
        return Scorer((frozenset(), GIVEN), None, None, int(sizes[1].sum()) / total if total else 0.0)

    def counts(rows: DataFrame, only: frozenset[str] | None, most: int | None) -> dict[str, np.ndarray]:
        summed = _counted(rows, only).groupBy("_term").pivot("_fold", list(range(FOLDS))).sum("_n").fillna(0)
        if most:
            summed = summed.withColumn("_all", sum((F.col(str(k)) for k in range(FOLDS)), F.lit(0)))
            summed = summed.where(F.col("_all") >= LEAST_ROWS).orderBy(F.desc("_all"), "_term").limit(most)
        return {r["_term"]: np.array([r[str(k)] for k in range(FOLDS)]) for r in summed.collect()}

    in_training = sample.where(F.col("_fold").isin(training))
    toxic = counts(in_training.where("_label > 0"), None, MOST_CANDIDATES)
    clean = counts(in_training.where("_label <= 0"), GIVEN.union(toxic), None)
    # The calibration fold is measured by the lexicon that will be used.
    lexicons = {k: _lexicon(toxic, clean, sizes, [f for f in training if f != k]) for k in range(FOLDS)}
    rows = written(
        _measured(sample, "_text", "_dense", lexicons, "_fold").select(
            "_fold", (F.col("_label") > 0).cast("double").alias("label"), array_to_vector("_dense").alias("features")
        ),
        "toxic-rows",
    )
    dropped(sample)
    few = rows.coalesce(4)
    # Few rows have any lexicon words; coarse bins would put the first of them with the zeros.
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=BINS, stepSize=0.3, seed=7, minInstancesPerNode=2)
    fitted = trees.fit(few.where(F.col("_fold") < FOLDS - 1))
    calibration = None
    if all(sizes[k][FOLDS - 1] for k in (0, 1)):
        held = fitted.transform(few.where(F.col("_fold") == FOLDS - 1))
        held = held.select("label", vector_to_array("probability")[1].alias("raw"))
        calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(held)
    dropped(rows)
    return Scorer(lexicons[FOLDS - 1], fitted, calibration, None)


def without_toxic(docs: DataFrame, scorer: Scorer, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold."""
    return scorer.score(docs, text).where(F.col("score") < threshold).select("row.*")
