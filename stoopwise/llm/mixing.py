"""Mixing sources to target weights by entropy balancing.

Native: DataFrame functions only. Every document gets a rate, the mean number of its
copies. Of all rates that give each source its target of words, the ones closest in
relative entropy to a common base rate are exponentially tilted,

    rate = min(cap, base * exp(lambda_source * size / mean size of the source)),

and the multipliers solve a convex dual with one unknown per source. Newton's method
solves all sources at once: an iteration joins the multipliers to the distinct sizes of
each source and sums words and their derivative per source. A bracket keeps a step from
overshooting where the cap bends the curve. Sums are taken in whole numbers, so neither
the order of rows nor a repeated task changes a digit.

Rates become copies by systematic rounding: within a source and bucket, in order of size,
the fractions are added up and a document gets a copy more whenever the sum passes a whole
number. Then documents whose size is nearest to what a source still misses, or has too
much, gain or lose a copy, one per source and round.

A null text or one without words has size 0 and adds nothing. A null source is a source,
the last one. Rows that repeat an id are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stoopwise.llm.common import BROADCAST_ROWS, WORD, bounded, text_of
from stoopwise.session import dropped, written

# Fixed values of the contract: weights by rank of the source, share of all words, cap.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2

BASE = SHARE
# Rates are whole multiples of this part of a copy.
UNIT = 1 << 30
ITERATIONS = 60
NEAR = 1e-7
ROUNDS = 6
ROWS_PER_BUCKET = 1_000_000
BIG = "decimal(38,0)"


def _key(id: str, text: str, source: str) -> Column:  # noqa: A002
    """128 bits that tell apart rows that differ in id, source or text."""
    columns = [F.col(id), F.col(source), text_of(text)]
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *reversed(columns)).alias("b"))


def sized(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:  # noqa: A002
    """Id, source, number of words and key of every row, and a number that tells rows apart."""
    return docs.select(
        F.col(id).alias("_id"),
        F.col(source).alias("_source"),
        F.regexp_count(text_of(text), F.lit(WORD)).cast("long").alias("_size"),
        F.monotonically_increasing_id().alias("_row"),
        _key(id, text, source).alias("_key"),
    )


def source_targets(totals: DataFrame, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Targets of sources by weight; ``totals`` holds a row per source.

    A target stops at ``cap`` times its source's words, and what it would have had beyond
    goes to the others by weight. Sources that stop are those with the least room per
    weight, so in that order the level of the others follows from running sums.
    """
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    ranked = totals.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())))
    weighed = ranked.select(
        "_source",
        "_words",
        "_rank",
        F.element_at(weights, (F.col("_rank") - 1) % len(WEIGHTS) + 1).alias("_weight"),
        (F.col("_words") * cap).cast("double").alias("_room"),
    )
    order = [F.col("_room") / F.col("_weight"), F.col("_rank")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (
        F.sum("_words").over(everything) * share - F.coalesce(F.sum("_room").over(before), F.lit(0.0))
    ) / F.sum("_weight").over(after)
    levels = weighed.withColumn("_level", level)
    # The first source with room above the level, and with it all later ones, are not full.
    rest = F.min(F.when(F.col("_room") > F.col("_level") * F.col("_weight"), F.struct(*order, "_level")))
    final = rest.over(everything)["_level"]
    shared = F.col("_weight") * final
    target = F.when(final.isNull() | (shared > F.col("_room")), F.col("_room")).otherwise(shared)
    return levels.select("_source", "_words", target.alias("_target"))


def _rate(base: float, cap: float) -> Column:
    """The tilted rate in whole units; needs _size, _mean, _lambda and _full."""
    tilt = F.col("_lambda") * F.col("_size") / F.col("_mean")
    # Beyond these bounds a rate is the cap or nothing.
    rate = F.least(F.lit(float(cap)), base * F.exp(F.greatest(F.least(tilt, F.lit(50.0)), F.lit(-50.0))))
    rate = F.when(F.col("_full"), F.lit(float(cap))).otherwise(rate)
    return F.round(F.when(F.col("_size") == 0, F.lit(base)).otherwise(rate) * UNIT).cast("long")


def _newton(state: DataFrame, cells: DataFrame, base: float, cap: float) -> DataFrame:
    """The words at the present multipliers, and the next multipliers and brackets."""
    units = F.col("_units")
    words = (F.col("_size") * F.col("_n")).cast(BIG) * units.cast(BIG)
    # A rate at the cap does not move with its multiplier.
    moving = F.when(units < int(cap * UNIT), F.round(units * F.col("_size") / F.col("_mean")).cast("long"))
    slope = (F.col("_size") * F.col("_n")).cast(BIG) * F.coalesce(moving, F.lit(0)).cast(BIG)
    sums = (
        cells.join(state, F.col("_cell_source").eqNullSafe(F.col("_source")))
        .withColumn("_units", _rate(base, cap))
        .groupBy("_source")
        .agg(F.sum(words).alias("_got"), F.sum(slope).alias("_slope"))
        .withColumnRenamed("_source", "_sum_source")
    )
    got, at = F.col("_got").cast("double") / UNIT, F.col("_lambda")
    miss = got - F.col("_target")
    low = F.when(miss < 0, at).otherwise(F.col("_low"))
    high = F.when(miss > 0, at).otherwise(F.col("_high"))
    step = at - miss / (F.col("_slope").cast("double") / UNIT)
    # Without a slope, or outside the bracket, halve the bracket or move by 1.
    inside = (step > F.coalesce(F.col("_l"), F.lit(-1e300))) & (step < F.coalesce(F.col("_h"), F.lit(1e300)))
    inside = inside & (F.abs(step - at) <= 4) & (F.col("_slope") > 0)
    halved = F.coalesce((F.col("_l") + F.col("_h")) / 2, F.when(miss < 0, at + 1).otherwise(at - 1))
    done = F.col("_full") | (F.abs(miss) <= F.greatest(F.col("_target") * NEAR, F.lit(1e-3)))
    done = done | F.coalesce(F.col("_h") - F.col("_l") < 1e-13, F.lit(False))
    return (
        state.join(sums, F.col("_source").eqNullSafe(F.col("_sum_source")))
        .withColumn("_l", low)
        .withColumn("_h", high)
        .select(
            "_source",
            "_words",
            "_target",
            "_mean",
            "_full",
            F.when(done, at).when(inside, step).otherwise(halved).alias("_lambda"),
            F.col("_l").alias("_low"),
            F.col("_h").alias("_high"),
            done.alias("_done"),
        )
    )


def balanced(sizes: DataFrame, targets: DataFrame, base: float = BASE, cap: float = CAP) -> DataFrame:
    """A multiplier per source, as a written table; ``sizes`` and ``targets`` are written ones."""
    cells = written(
        sizes.where("_size > 0").groupBy(F.col("_source").alias("_cell_source"), "_size").agg(F.count("*").alias("_n")),
        "mix-cells",
    )
    counts = cells.groupBy(F.col("_cell_source").alias("_count_source")).agg(F.sum("_n").alias("_count"))
    state = written(
        targets.join(counts, F.col("_source").eqNullSafe(F.col("_count_source"))).select(
            "_source",
            "_words",
            "_target",
            (F.col("_words") / F.col("_count")).alias("_mean"),
            (F.col("_target") >= F.col("_words") * (cap - 1e-12)).alias("_full"),
            F.lit(0.0).alias("_lambda"),
            F.lit(None).cast("double").alias("_low"),
            F.lit(None).cast("double").alias("_high"),
            F.lit(False).alias("_done"),
        ),
        "mix-state",
    )
    for _ in range(ITERATIONS):
        last, state = state, written(_newton(state, cells, base, cap), "mix-state")
        dropped(last)
        if state.where("not _done").isEmpty():
            break
    dropped(cells)
    return state


def _rounded(rated: DataFrame, rows: int) -> DataFrame:
    """Copies by systematic rounding of ``_units``, in buckets that fit a task."""
    buckets = max(1, -(-rows // ROWS_PER_BUCKET))
    # One bucket per source would be one task for a source of any size.
    # What a row holds says its bucket and its place, so the layout of files decides nothing.
    bucket = F.pmod(F.xxhash64("_key"), F.lit(buckets)).cast("int")
    parts = rated.withColumn("_bucket", bucket).withColumn("_part", F.pmod("_units", F.lit(UNIT)))
    sums = parts.groupBy("_source", "_bucket").agg(F.sum("_part").alias("_sum"))
    running = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("_source").alias("_start_source"),
        F.col("_bucket").alias("_start_bucket"),
        F.pmod(F.coalesce(F.sum("_sum").over(running), F.lit(0)) + UNIT // 2, F.lit(UNIT)).alias("_start"),
    )
    order = Window.partitionBy("_source", "_bucket").orderBy("_size", "_id", "_key", "_row")
    upto = F.sum("_part").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_start")
    same = F.col("_source").eqNullSafe(F.col("_start_source")) & (F.col("_bucket") == F.col("_start_bucket"))
    more = F.floor(F.col("_upto") / UNIT) - F.floor((F.col("_upto") - F.col("_part")) / UNIT)
    return (
        parts.join(starts, same)
        .withColumn("_upto", upto)
        .select("_id", "_row", "_key", "_source", "_size", (F.floor(F.col("_units") / UNIT) + more).cast("int").alias("_copies"))
    )


def _corrections(copied: DataFrame, targets: DataFrame, cap: int, rounds: int = ROUNDS) -> DataFrame:
    """Rows that gain or lose a copy, a few per source, as a written table."""
    cells = written(
        copied.where("_size > 0")
        .groupBy(F.col("_source").alias("_cell_source"), "_size", "_copies")
        .agg(F.count("*").alias("_n"), F.min(F.struct("_id", "_key", "_row")).alias("_first")),
        "mix-rounded",
    )
    got = cells.groupBy(F.col("_cell_source").alias("_got_source")).agg(
        F.sum(F.col("_size") * F.col("_copies") * F.col("_n")).alias("_got")
    )
    state = written(
        targets.join(got, F.col("_source").eqNullSafe(F.col("_got_source"))).select(
            "_source",
            (F.round("_target").cast("long") - F.col("_got")).alias("_miss"),
            F.array().cast("array<struct<row:bigint,change:int>>").alias("_moves"),
        ),
        "mix-misses",
    )
    for _ in range(rounds):
        missing = F.col("_miss")
        can = ((missing > 0) & (F.col("_copies") < cap)) | ((missing < 0) & (F.col("_copies") > 0))
        helps = F.col("_size") < 2 * F.abs(missing)
        unused = ~F.exists("_moves", lambda m: m["row"] == F.col("_first._row"))
        off = F.abs(F.abs(missing) - F.col("_size"))
        best = (
            cells.join(state, F.col("_cell_source").eqNullSafe(F.col("_source")))
            .where(can & helps & unused)
            .groupBy(F.col("_source").alias("_best_source"))
            .agg(F.min(F.struct(off.alias("off"), "_size", "_copies", F.col("_first._row").alias("row"))).alias("_best"))
        )
        change = F.signum("_miss").cast("int")
        move = F.struct(F.col("_best.row").alias("row"), change.alias("change"))
        last, state = state, written(
            state.join(best, F.col("_source").eqNullSafe(F.col("_best_source")), "left").select(
                "_source",
                F.coalesce(F.col("_miss") - change * F.col("_best._size"), "_miss").alias("_miss"),
                F.when(F.col("_best").isNull(), F.col("_moves"))
                .otherwise(F.concat("_moves", F.array(move)))
                .alias("_moves"),
            ),
            "mix-misses",
        )
        dropped(last)
    moves = written(state.select(F.explode("_moves").alias("m")).select("m.*"), "mix-moves")
    dropped(state, cells)
    return moves


def mixed(sizes: DataFrame, targets: DataFrame, base: float = BASE, cap: int = CAP) -> DataFrame:
    """A row per document: _id, _row, _key, _source, _size, _words, _target and _copies.

    ``sizes`` is a written table as ``sized`` makes it, ``targets`` a written one as
    ``source_targets`` makes it.
    """
    state = balanced(sizes, targets, base, cap)
    tilts = state.select(F.col("_source").alias("_tilt_source"), "_mean", "_full", "_lambda")
    rated = (
        sizes.join(bounded(tilts), F.col("_source").eqNullSafe(F.col("_tilt_source")), "left")
        .withColumn("_units", F.coalesce(_rate(base, cap), F.lit(int(base * UNIT))))
        .select("_id", "_row", "_key", "_source", "_size", "_units")
    )
    copied = written(_rounded(rated, sizes.count()), "mix-copies")
    moves = _corrections(copied, targets, cap)
    known = targets.select(F.col("_source").alias("_target_source"), "_words", "_target")
    return (
        copied.join(bounded(known), F.col("_source").eqNullSafe(F.col("_target_source")))
        .join(bounded(moves), F.col("_row") == F.col("row"), "left")
        .select(
            "_id",
            "_row",
            "_key",
            "_source",
            "_size",
            "_words",
            "_target",
            (F.col("_copies") + F.coalesce("change", F.lit(0))).alias("_copies"),
        )
    )


def _mixture(docs: DataFrame, id: str, text: str, source: str) -> DataFrame:  # noqa: A002
    sizes = written(sized(docs, id, text, source), "mix-sizes")
    totals = sizes.groupBy("_source").agg(F.sum("_size").alias("_words"))
    targets = written(source_targets(totals), "mix-targets")
    return mixed(sizes, targets)


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:  # noqa: A002
    """A row per row of ``docs``: id, size, source_size, target, taken, and the copies.

    Sources weigh 3, 1, 2, repeating, by code point with null last, and share 1.5 times
    all words; no target and no document goes beyond 2 times its size.
    """
    return _mixture(docs, id, text, source).select(
        F.col("_id").alias(id),
        F.col("_size").alias("size"),
        F.col("_words").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_size") * F.col("_copies")).cast("long").alias("taken"),
        F.col("_copies").alias("copies"),
    )


def mixed_documents(
    docs: DataFrame,
    id: str = "doc_id",  # noqa: A002
    text: str = "text",
    source: str = "source",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Rows are found again by a hash of id, source and text. Rows that agree in all three
    are taken together, as often as the mix takes all of them.
    """
    mixture = _mixture(docs, id, text, source)
    times = mixture.groupBy("_key").agg(F.count("*").alias("_rows"), F.sum("_copies").alias("_times"))
    times = written(times.where("_times > 0"), "mix-times")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("_doc"), _key(id, text, source).alias("_key"))
    taken = rows.join(bounded(times, broadcast_rows), "_key")
    once = taken.where("_rows = 1").select("_doc", "_times")
    many = taken.where("_rows > 1").dropDuplicates(["_key"]).select("_doc", "_times")
    both = once.unionByName(many)
    return both.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select("_doc.*")
