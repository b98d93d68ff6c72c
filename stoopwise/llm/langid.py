"""Language identification by nearest centroid.

A text is the vector of its character n-grams: counts of hashed 1- to 3-grams of its
lower-cased letters, damped by a logarithm, weighted by inverse document frequency and
scaled to length one. Each language has a few centroids, from spherical k-means, and the
language of the nearest centroid by cosine is the answer. A text farther from it than
nearly all learnt texts of that centroid are is marked as rejected.

Document frequencies are counted over all learnt rows. Centroids and their radii come
from a bounded sample: per language the ``most_learnt`` first rows by a hash of the id.
Languages are clustered apart from each other, each in a task of its own. Whole texts count,
in the sample as in predictions; n-grams are counted where a text is read, and the clusters
get the counts.

A text that is null or has no letters is ``und`` with score 0. Equal cosines go to the
language first by code point. Without learnt rows every text is ``und``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stoopwise.llm.common import bounded, free_name, ship
from stoopwise.llm.shingles import mixed
from stoopwise.session import dropped, written

UNDETERMINED = "und"
NGRAMS = (1, 2, 3)
FEATURES = 1 << 13
MOST_LEARNT = 400
CENTROIDS = 4
ROUNDS = 12
# The share of a centroid's learnt texts that its radius covers.
COVERED = 0.995
CHARS_AT_ONCE = 1 << 20
BLANK = 32
SEED = 11

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTERS[0]


def gram_counts(text: str | None) -> np.ndarray | None:
    """How often each hashed n-gram is in the text; None without letters.

    Runs of other characters count as one blank, so n-grams also tell how words start
    and end.
    """
    if not text:
        return None
    letters = _letters()
    total = np.zeros(FEATURES, np.int64)
    some = False
    # Long texts in parts that overlap by what an n-gram needs; each n-gram counts once.
    before = np.zeros(0, np.uint32)
    for start in range(0, len(text), CHARS_AT_ONCE):
        part = text[start : start + CHARS_AT_ONCE].lower()
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        is_letter = letters[points]
        some = some or bool(is_letter.any())
        points[~is_letter] = BLANK
        if start == 0:
            points = np.insert(points, 0, BLANK)
        if start + CHARS_AT_ONCE >= len(text):
            points = np.append(points, np.uint32(BLANK))
        joined = np.concatenate([before, points])
        again = (joined[1:] == BLANK) & (joined[:-1] == BLANK)
        joined = joined[np.insert(~again, 0, True)].astype(np.uint64)
        for n in NGRAMS:
            count = len(joined) - n + 1
            # Of n-grams within the repeated part, the last round has counted all.
            first = max(0, len(before) - n + 1)
            if count <= first:
                continue
            key = np.full(count - first, n, np.uint64)
            for i in range(n):
                key = key * np.uint64(0x110001) + joined[first + i : count + i]
            total += np.bincount((mixed(key) & np.uint64(FEATURES - 1)).astype(np.int64), minlength=FEATURES)
        before = joined[-(max(NGRAMS) - 1) :].astype(np.uint32)
    return total if some else None


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weights = np.log1p(counts) * idf
    length = np.linalg.norm(weights)
    return (weights / length if length else weights).astype(np.float32)


def document_frequencies(rows: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many rows each feature is, and the number of rows with letters."""

    def run(batches):
        import pyarrow as pa

        holds = np.zeros(FEATURES + 1, np.int64)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                counts = gram_counts(value)
                if counts is not None:
                    holds[:-1] += counts > 0
                    holds[-1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1)), pa.array(holds)], names=["f", "n"])

    sums = rows.select(text).mapInArrow(run, "f bigint, n bigint").groupBy("f").agg(F.sum("n").alias("n"))
    # As many rows as there are features, whatever the size of the data.
    found = np.zeros(FEATURES + 1, np.int64)
    for row in sums.collect():
        found[row["f"]] = row["n"]
    return found[:-1], int(found[-1])


def cluster(vectors: np.ndarray, count: int) -> np.ndarray:
    """Centroids of length one by spherical k-means; starts from far-apart rows."""
    count = min(count, len(vectors))
    chosen = [int(np.argmax(vectors @ vectors.mean(axis=0)))]
    nearest = vectors @ vectors[chosen[0]]
    while len(chosen) < count:
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, vectors @ vectors[chosen[-1]])
    centers = vectors[chosen]
    for _ in range(ROUNDS):
        mine = np.argmax(vectors @ centers.T, axis=1)
        moved = np.stack([vectors[mine == k].sum(axis=0) if (mine == k).any() else centers[k] for k in range(count)])
        centers = moved / np.maximum(np.linalg.norm(moved, axis=1, keepdims=True), 1e-12)
    return centers.astype(np.float32)


class Model:
    """Inverse document frequencies, centroids, their languages and radii."""

    def __init__(self, idf: np.ndarray, centers: np.ndarray, langs: list[str], radii: np.ndarray):
        self.idf, self.centers, self.langs, self.radii = idf, centers, langs, radii

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine to the nearest centroid, and whether that is too far."""
        counts = gram_counts(text)
        if counts is None or not self.langs:
            return UNDETERMINED, 0.0, True
        cosines = self.centers @ vector(counts, self.idf)
        best = int(np.argmax(cosines))
        score = float(min(1.0, max(0.0, cosines[best])))
        return self.langs[best], score, bool(cosines[best] < self.radii[best])


def learn(
    docs: DataFrame,
    learnt: Column | None = None,
    id: str = "doc_id",  # noqa: A002
    text: str = "text",
    lang: str = "lang",
    most_learnt: int = MOST_LEARNT,
) -> Model:
    """A model of the rows with a language that ``learnt`` chooses, all by default."""
    ship(docs.sparkSession)
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    known = known.where(learnt) if learnt is not None else known
    rows = known.select(F.col(id).alias("_id"), F.col(lang).alias("_lang"), F.col(text).alias("_text"))
    holds, count = document_frequencies(rows, "_text")
    idf = np.log((1 + count) / (1 + holds)) + 1

    keyed = rows.withColumns({"_hash": F.xxhash64("_id"), "_digest": F.xxhash64("_text")})
    key = ["_lang", "_hash", "_digest"]
    window = Window.partitionBy("_lang").orderBy("_hash", "_digest")
    # Map tasks keep the first rows of each language, so a large language stays small.
    chosen = keyed.select(*key).withColumn("_nth", F.row_number().over(window)).where(F.col("_nth") <= most_learnt)
    chosen = written(chosen.groupBy(*key).agg(F.count("*").alias("_copies")), "language-sample")
    texts = keyed.join(bounded(chosen), key).select(*key, "_copies", "_text")

    def count_grams(batches):
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                counts = gram_counts(batch.column(4)[row].as_py())
                if counts is not None:
                    at = np.flatnonzero(counts)
                    grams = [pa.array([a.tolist()], pa.list_(pa.int64())) for a in (at, counts[at])]
                    columns = [*(batch.column(k).slice(row, 1) for k in range(4)), *grams]
                    yield pa.RecordBatch.from_arrays(columns, names=[*key, "_copies", "_at", "_counts"])

    schema = "_lang string, _hash bigint, _digest bigint, _copies bigint, _at array<bigint>, _counts array<bigint>"
    # Rows that repeat an id and its text come as one, with the number that the sample has of them.
    sample = texts.mapInArrow(count_grams, schema).groupBy(*key).agg(
        F.first("_copies").alias("_copies"), F.first(F.struct("_at", "_counts")).alias("_grams")
    ).select(*key, "_copies", "_grams.*")

    def centers_of(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_hash", "_digest"])
        counted = []
        for copies, at, counts in zip(frame["_copies"], frame["_at"], frame["_counts"], strict=True):
            whole = np.zeros(FEATURES, np.int64)
            whole[at] = counts
            counted += [whole] * int(copies)
        out = {"_lang": [], "center": [], "radius": []}
        if counted:
            vectors = np.stack([vector(c, idf) for c in counted])
            centers = cluster(vectors, CENTROIDS)
            cosines = vectors @ centers.T
            mine = np.argmax(cosines, axis=1)
            for k, center in enumerate(centers):
                own = cosines[mine == k, k]
                out["_lang"].append(frame["_lang"].iloc[0])
                out["center"].append(center.astype(float).tolist())
                out["radius"].append(float(np.quantile(own, 1 - COVERED)) if len(own) else 1.0)
        return pd.DataFrame(out)

    found = sample.groupBy("_lang").applyInPandas(centers_of, "_lang string, center array<double>, radius double")
    # A few centroids per language, however many rows there are.
    centers = sorted(found.collect(), key=lambda r: (r["_lang"], tuple(r["center"])))
    dropped(chosen)
    return Model(
        idf,
        np.array([r["center"] for r in centers], np.float32).reshape(len(centers), FEATURES),
        [r["_lang"] for r in centers],
        np.array([r["radius"] for r in centers]),
    )


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with the columns lang_pred, score (the cosine, 0 to 1) and rejected.

    Columns of these names in ``docs`` get an underscore in front of the new ones.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    added = [free_name(docs, n) for n in ("lang_pred", "score", "rejected")]
    names = [*docs.columns, *added]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [sent.value.predict(t) for t in batch.column(at).to_pylist()]
            langs, scores, far = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(far, pa.bool_())],
                names=names,
            )

    kinds = ("string", "double", "boolean")
    schema = docs.select("*", *[F.lit(None).cast(k).alias(n) for n, k in zip(added, kinds, strict=True)]).schema
    return docs.mapInArrow(run, schema)
