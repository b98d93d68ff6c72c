"""Substring dedup by hashing lines, and parts of texts cut where their words say.

A text is cut into units twice: once after the word with the smallest hash of every
``WINDOW`` words in a row, whatever line breaks are between them, so that a passage is cut
the same way wherever it stands and however it is wrapped; and once at line breaks, and
inside of long lines by the windows that stand in one line. In both, from every unit on,
the shortest run of units with ``least_words`` words or more is normalised (lower case,
white space as one space) and hashed. Two cuts of the first kind are at most ``WINDOW``
words apart, so texts that share 2 * WINDOW + least_words words in a row share a run. Runs
are grouped by digest over all texts; the occurrence that comes first by id, then by
place, stays, and the others are removed, with their offsets in the original text.

The first scan counts 64-bit digests. Only runs whose digest is there twice are built
again, in a second scan, and grouped by 128 bits. Map tasks add up counts and minima
before a shuffle, so a line of every document is a single row per task there; its
occurrences meet the kept one in a join that the adaptive engine splits.

What is removed is always left somewhere: a removed run has an earlier occurrence.
Null and empty texts have no units. Rows that agree in id and text count as one document;
texts that share an id, or have none, are documents of their own. A null id comes after
all others. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoopwise.llm.common import BROADCAST_ROWS, bounded, free_name, ship, text_of
from stoopwise.llm.shingles import mixed, words_of
from stoopwise.session import dropped, written

LEAST_WORDS = 10
# Of so many words in a row one ends a unit.
WINDOW = 12
NEWLINE = 10
# Odd multipliers of the two halves of a digest.
HALVES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def _powers(base: int, count: int) -> np.ndarray:
    powers = np.full(max(count, 1), base, np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


def _shortest(after: np.ndarray, least_words: int) -> np.ndarray:
    """The shortest run from every unit on, as one number: its first word times (words + 1) plus its end.

    ``after`` marks the last words of units.
    """
    cuts = np.concatenate([[0], np.flatnonzero(after) + 1])
    if cuts[-1] != len(after):
        cuts = np.append(cuts, len(after))
    stop_at = np.searchsorted(cuts, cuts[:-1] + least_words)
    whole = stop_at < len(cuts)
    return cuts[:-1][whole] * (len(after) + 1) + cuts[stop_at[whole]]


def runs(text: str | None, least_words: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both halves of the digest, start and end of every run of a text."""
    hashes, starts, ends, points = words_of(text or "")
    count = len(hashes)
    if count < least_words:
        none = np.empty(0, np.int64)
        return none, none, none, none
    line = np.cumsum(points == NEWLINE)[starts]
    after, inner = np.zeros(count, bool), np.zeros(count, bool)
    after[:-1] = line[1:] > line[:-1]
    if count >= WINDOW:
        least = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW).argmin(axis=1) + np.arange(count - WINDOW + 1)
        after[least[line[: count - WINDOW + 1] == line[WINDOW - 1 :]]] = True
        inner[least] = True
    bounds = np.unique(np.concatenate([_shortest(after, least_words), _shortest(inner, least_words)]))
    first, last = np.divmod(bounds, count + 1)
    halves = []
    for base in HALVES:
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(base, count))])
        shift = _powers(_inverse(base), count)[first]
        halves.append(mixed((sums[last] - sums[first]) * shift + (last - first).astype(np.uint64)).view(np.int64))
    return halves[0], halves[1], starts[first], ends[last - 1]


def _key(text: str) -> Column:
    """With the id it tells documents apart; rows that agree in both are copies of one."""
    return F.xxhash64(text_of(text))


def _all_runs(docs: DataFrame, id: str, text: str, least_words: int, whole: bool) -> DataFrame:  # noqa: A002
    """All runs; the first half of their digests alone, or whole rows."""
    ship(docs.sparkSession)
    kind = docs.schema[id].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first_row in range(0, batch.num_rows, 1024):
                part = batch.slice(first_row, 1024)
                found = [runs(t, least_words) for t in part.column(1).to_pylist()]
                columns = [np.concatenate([f[k] for f in found]) for k in range(4 if whole else 1)]
                if not whole:
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0])], names=["_d1"])
                    continue
                rows = np.repeat(np.arange(len(found), dtype=np.int32), [len(f[0]) for f in found])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(pa.array(rows)) for c in (0, 2)), *(pa.array(c.astype(np.int64)) for c in columns)],
                    names=["_id", "_key", "_d1", "_d2", "_start", "_end"],
                )

    rows = docs.select(F.col(id).alias("_id"), text_of(text).alias("_text"), _key(text).alias("_key"))
    schema = f"_id {kind}, _key bigint, _d1 bigint, _d2 bigint, _start bigint, _end bigint" if whole else "_d1 bigint"
    return rows.mapInArrow(run, schema)


def _merged(late: DataFrame, kind: str) -> DataFrame:
    """Spans of each document, those that touch or overlap as one, and where they are kept.

    Rows come sorted by document and stream through; a document's spans are held while
    its rows last.
    """

    def run(batches):
        import pyarrow as pa

        shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        now, spans, kept, done = None, [], set(), []

        def closed():
            if spans:
                places = [{"start": a, "end": b} for a, b in spans]
                done.append((*now, places, sum(b - a for a, b in spans), sorted(kept, key=lambda k: (k is None, k))))

        def sent(schema):
            ids, keys, places, sizes, keeps = zip(*done, strict=True)
            done.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, schema.field(0).type), pa.array(keys, pa.int64()), pa.array(places, shape),
                 pa.array(sizes, pa.int64()), pa.array(keeps, pa.list_(schema.field(0).type))],
                names=["_id", "_key", "spans", "removed_chars", "kept_in"],
            )

        schema = None
        for batch in batches:
            schema = batch.schema
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                *document, start, end, first = row
                if document != now or not spans:
                    closed()
                    now, spans, kept = document, [], set()
                if spans and start <= spans[-1][1] + 1:
                    spans[-1][1] = max(spans[-1][1], end)
                else:
                    spans.append([start, end])
                kept.add(first)
            if done:
                yield sent(schema)
        closed()
        if done:
            yield sent(schema)

    rows = late.select("_id", "_key", "_start", "_end", F.col("_first.id").alias("_kept"))
    rows = rows.repartition("_id", "_key").sortWithinPartitions("_id", "_key", "_start")
    schema = f"_id {kind}, _key bigint, spans array<struct<start:bigint,end:bigint>>, removed_chars bigint, kept_in array<{kind}>"
    return rows.mapInArrow(run, schema)


def repeats(
    docs: DataFrame,
    id: str = "doc_id",  # noqa: A002
    text: str = "text",
    least_words: int = LEAST_WORDS,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """A row per document that loses something: id, spans, removed_chars, kept_in.

    ``kept_in`` holds the ids of the documents where the first occurrences are. An id that
    several texts have gives a row for each that loses something.
    """
    return _repeats(docs, id, text, least_words, broadcast_rows).drop("_key").withColumnRenamed("_id", id)


def _repeats(docs: DataFrame, id: str, text: str, least_words: int = LEAST_WORDS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:  # noqa: A002
    """The rows of ``repeats`` with the key of the text beside the id, ``_id``."""
    kind = docs.schema[id].dataType.simpleString()
    digests = _all_runs(docs, id, text, least_words, whole=False)
    twice = written(digests.groupBy("_d1").count().where("count > 1").select("_d1"), "runs-twice")
    again = _all_runs(docs, id, text, least_words, whole=True).join(bounded(twice, broadcast_rows), "_d1")
    again = written(again, "runs-again")
    dropped(twice)
    place = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), "_key", F.col("_start").alias("at"))
    first = (
        again.groupBy("_d1", "_d2")
        .agg(F.count("*").alias("_n"), F.min(place).alias("_first"))
        .where("_n > 1")
        .select("_d1", "_d2", "_first")
    )
    first = written(first, "runs-first")
    late = again.join(first, ["_d1", "_d2"]).where(~place.eqNullSafe(F.col("_first")))
    return _merged(late, kind)


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:  # noqa: A002
    """``docs`` with repeated passages cut out of the text, and the column ``removed``.

    ``removed`` holds the spans of the original text that are gone, null for none.
    """
    removed, of, key = free_name(docs, "removed"), free_name(docs, "_of"), free_name(docs, "_key_of")
    spans = _repeats(docs, id, text, **options)
    found = written(
        spans.select(F.col("_id").alias(of), F.col("_key").alias(key), F.col("spans").alias(removed)), "repeats"
    )
    same = F.col(id).eqNullSafe(F.col(of)) & (_key(text) == F.col(key))
    joined = docs.join(found, same, "left").drop(of, key)
    names = joined.columns
    text_at, spans_at = names.index(text), names.index(removed)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for t, spans in zip(batch.column(text_at).to_pylist(), batch.column(spans_at).to_pylist(), strict=True):
                for span in reversed(spans or []):
                    t = t[: span["start"]] + t[span["end"] :]
                out.append(t)
            columns = [pa.array(out, pa.string()) if i == text_at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, joined.schema)
