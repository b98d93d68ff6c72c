"""N-gram Jaccard join: MinHash bands find the pairs, full n-gram sets verify them.

Texts are compared by their sets of word 5-grams. Band and row counts follow from the
recall wanted at the threshold; every band of every distinct text is a bucket key.

1. One scan gives each row a digest of its text, the band keys and one byte per hash
   function. Equal texts become one node, after map tasks have merged them.
2. Buckets with two nodes or more are cut into tiles of bounded size, and in each tile
   the bytes estimate the similarity: pairs whose estimate is far below the threshold,
   or whose sizes rule it out, are left out. Nodes that go together form a component.
3. A second scan builds the n-gram sets of the nodes in components only. Components are
   cut into tiles, each set goes to the tiles of its block, and every pair of a tile is
   verified. A tile gives each of its nodes the number of its links and one edge to the
   class it is in, so a group of copies never becomes a list of its pairs.
4. Verified edges form the classes.

Nothing is capped: a bucket or component of any size is cut into more tiles.
A null text counts as empty. Texts without words have no n-grams and link only to equal
texts. Rows with one text are linked to each other whatever their ids are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stoopwise.llm.common import BROADCAST_ROWS, bounded, few_at_a_time, give_back, ship, text_of
from stoopwise.llm.components import components
from stoopwise.llm.shingles import mixed, shingles
from stoopwise.session import dropped, written

NGRAM = 5
THRESHOLD = 0.8
# Of the pairs at the threshold, the share that must meet in a band.
RECALL = 0.9999
MOST_HASHES = 80
# An estimate from about 72 hashes falls this far below the similarity once in 10^8 pairs.
SLACK = 0.3
SEED = 20
NODES_PER_BLOCK = 256
SETS_PER_BLOCK = 128
# A block of longer texts has fewer of them: so many n-grams a set on average.
GRAMS_PER_SET = 4096
HASHES_AT_ONCE = 4096


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """The most rows per band, for the fewest chance meetings, that reach the recall."""
    best = None
    for rows in range(1, most + 1):
        meets = threshold**rows
        bands = 1 if meets >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - meets))
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError(f"no bands of at most {most} hashes reach a recall of {recall}")
    return best


def _multipliers(count: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minhashes(grams: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(grams), HASHES_AT_ONCE):
        part = grams[None, start : start + HASHES_AT_ONCE] * multipliers[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def _digest(text: str | Column) -> Column:
    return F.unhex(F.md5(text_of(text)))


def marked(docs: DataFrame, id: str, text: str, size: int, bands: int, rows: int) -> DataFrame:  # noqa: A002
    """Id, text digest, number of n-grams, one byte per hash function and band keys of each row."""
    ship(docs.sparkSession)
    kind = docs.schema[id].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        multipliers = _multipliers(bands * rows)
        places = np.arange(bands, dtype=np.uint64)
        for batch in few_at_a_time(batches):
            counts, marks, keys = [], [], []
            for text in batch.column(2).to_pylist():
                grams = shingles(text, size)
                counts.append(len(grams))
                if not len(grams):
                    marks.append(b"")
                    keys.append([])
                    continue
                least = minhashes(grams, multipliers)
                marks.append((least >> np.uint64(20)).astype(np.uint8).tobytes())
                key = places.copy()
                for row in least.reshape(bands, rows).T:
                    key = mixed(key * np.uint64(31) + row)
                keys.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int32()), pa.array(marks, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64()))],
                names=["_id", "_digest", "_grams", "_marks", "_bands"],
            )

    rows_in = docs.select(F.col(id).alias("_id"), _digest(text).alias("_digest"), text_of(text).alias("_text"))
    schema = f"_id {kind}, _digest binary, _grams int, _marks binary, _bands array<bigint>"
    return rows_in.mapInArrow(run, schema)


def _tiles(members: DataFrame, key: str, node: str, count: str, per_block: int) -> DataFrame:
    """A row per member and tile; tiles pair the blocks that a key's members are dealt to.

    Adds ``_block`` and the tile ``_low``, ``_high``. Each pair of members meets in one
    tile whose blocks are theirs; a key of at most ``per_block`` members has one tile.
    """
    blocks = F.ceil(F.col(count) / per_block).cast("int")
    dealt = members.withColumn("_blocks", blocks).withColumn(
        "_block", F.pmod(F.xxhash64(node), F.col("_blocks")).cast("int")
    )
    other = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return other.withColumn("_low", F.least("_block", "_other")).withColumn("_high", F.greatest("_block", "_other"))


def _runs(batches, keys: int) -> Iterator:
    """Record batches, each with the rows of one tile, from rows sorted by the first columns."""
    import pyarrow as pa

    held = []

    def joined(parts):
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for column in columns:
            new[1:] |= column[1:] != column[:-1]
        new[0] = last is not None and last != tuple(c[0] for c in columns)
        last = tuple(c[-1] for c in columns)
        cuts = np.flatnonzero(new).tolist()
        start = 0
        for cut in cuts:
            if cut > start:
                held.append(batch.slice(start, cut - start))
            if held:
                yield joined(held)
            held, start = [], cut
        held.append(batch.slice(start))
    if held:
        yield joined(held)
    give_back()


def _roots(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links the first row that it is connected to."""
    count = len(near)
    label = np.arange(count)
    linked = near | np.eye(count, dtype=bool)
    while True:
        least = np.where(linked, label[None, :], count).min(axis=1)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _likely_edges(tiles: DataFrame, hashes: int, threshold: float) -> DataFrame:
    least_alike = (threshold - SLACK) * hashes

    def run(batches):
        import pyarrow as pa

        for part in _runs(batches, 3):
            count = part.num_rows
            if count < 2:
                continue
            nodes = part.column(3).to_numpy()
            grams = part.column(4).to_numpy()
            marks = np.frombuffer(b"".join(part.column(5).to_pylist()), np.uint8).reshape(count, hashes)
            alike = np.empty((count, count), np.int32)
            for i in range(count):
                alike[i] = (marks == marks[i]).sum(axis=1)
            sizes = np.minimum(grams[:, None], grams) >= threshold * np.maximum(grams[:, None], grams)
            roots = _roots((alike >= least_alike) & sizes)
            moved = roots != np.arange(count)
            if moved.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[moved]), pa.array(nodes[roots[moved]])], names=["a", "b"]
                )

    rows = tiles.select("_band", "_low", "_high", "_node", "_grams", "_marks")
    sorted_rows = rows.repartition("_band", "_low", "_high").sortWithinPartitions("_band", "_low", "_high")
    return sorted_rows.mapInArrow(run, "a bigint, b bigint")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each two sets have in common."""
    count = len(sets)
    if count <= 6:
        common = np.zeros((count, count), np.int64)
        for i in range(count):
            common[i, i] = len(sets[i])
            for j in range(i):
                common[i, j] = common[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return common
    owner = np.repeat(np.arange(count), [len(s) for s in sets])
    _, place, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = many > 1
    rank = np.cumsum(shared) - 1
    kept = shared[place]
    owner, place = owner[kept], rank[place[kept]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    common = np.zeros((count, count), np.float64)
    width = int(shared.sum())
    cuts = np.searchsorted(place, np.arange(0, width + HASHES_AT_ONCE, HASHES_AT_ONCE))
    for k in range(len(cuts) - 1):
        part = slice(cuts[k], cuts[k + 1])
        holds = np.zeros((count, HASHES_AT_ONCE), np.float32)
        holds[owner[part], place[part] - k * HASHES_AT_ONCE] = 1
        common += holds @ holds.T
    common = common.astype(np.int64)
    np.fill_diagonal(common, [len(s) for s in sets])
    return common


def _sets(rows: DataFrame, size: int) -> DataFrame:
    """n-gram sets in place of the texts, the last column; of rows with one node, one per task."""
    *names, _ = rows.columns
    at = names.index("_node")

    def run(batches):
        import pyarrow as pa

        seen: set[int] = set()
        for batch in few_at_a_time(batches):
            keep = []
            for i, node in enumerate(batch.column(at).to_pylist()):
                if node not in seen:
                    seen.add(node)
                    keep.append(i)
            if not keep:
                continue
            batch = batch.take(pa.array(keep, pa.int32()))
            *columns, texts = batch.columns
            found = [shingles(text, size).tobytes() for text in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.binary())], names=[*names, "_set"])

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in names), "_set binary"])
    return rows.mapInArrow(run, schema)


def _verified(tiles: DataFrame, threshold: float) -> DataFrame:
    """Per tile and node with links there: the node's class in the tile, its links to texts and rows."""

    def run(batches):
        import pyarrow as pa

        for part in _runs(batches, 3):
            nodes = part.column(3).to_numpy()
            # A text that several tasks have read is there more than once.
            nodes, first = np.unique(nodes, return_index=True)
            if len(nodes) < 2:
                continue
            blocks = part.column(4).to_numpy()[first]
            copies = part.column(5).to_numpy()[first]
            column = part.column(6)
            sets = [np.frombuffer(column[int(i)].as_py(), np.uint64) for i in first]
            sizes = np.array([len(s) for s in sets], np.int64)
            common = common_counts(sets)
            union = sizes[:, None] + sizes - common
            near = common >= threshold * union - 1e-9
            np.fill_diagonal(near, False)
            if part.column(1)[0].as_py() != part.column(2)[0].as_py():
                near &= blocks[:, None] != blocks
            links = near.sum(axis=1)
            some = links > 0
            if some.any():
                roots = _roots(near)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[some]), pa.array(nodes[roots[some]]), pa.array(links[some]),
                     pa.array((near @ copies)[some])],
                    names=["node", "root", "links", "link_rows"],
                )

    rows = tiles.select("_part", "_low", "_high", "_node", "_block", "_rows", "_set")
    sorted_rows = rows.repartition("_part", "_low", "_high").sortWithinPartitions("_part", "_low", "_high")
    return sorted_rows.mapInArrow(run, "node bigint, root bigint, links bigint, link_rows bigint")


def classified(
    docs: DataFrame,
    id: str = "doc_id",  # noqa: A002
    text: str = "text",
    size: int = NGRAM,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    broadcast_rows: int = BROADCAST_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Written tables of the rows and of the distinct texts.

    Rows: _id and _digest. Texts: _digest, _first (smallest id), _rows, _class (the node
    of the class), _links (to other texts), _link_rows (to other rows), _node.
    """
    bands, per_band = bands_and_rows(threshold, recall)
    marks = written(marked(docs, id, text, size, bands, per_band), "ngram-marks")
    nodes = written(
        marks.groupBy("_digest")
        .agg(
            F.count("*").alias("_rows"),
            F.min("_id").alias("_first"),
            F.first("_grams").alias("_grams"),
            F.first("_marks").alias("_marks"),
            F.first("_bands").alias("_bands"),
        )
        .withColumn("_node", F.monotonically_increasing_id()),
        "ngram-nodes",
    )
    rows = written(marks.select("_id", "_digest"), "ngram-rows")
    dropped(marks)

    keyed = nodes.select("_node", F.explode("_bands").alias("_band"))
    shared = keyed.groupBy("_band").agg(F.count("*").alias("_count")).where("_count > 1")
    members = keyed.join(shared, "_band").join(nodes.select("_node", "_grams", "_marks"), "_node")
    likely = _likely_edges(_tiles(members, "_band", "_node", "_count", NODES_PER_BLOCK), bands * per_band, threshold)
    parts = written(components(likely), "ngram-parts")

    placed = parts.join(nodes, F.col("node") == F.col("_node"))
    grams = F.ceil(F.sum("_grams") / GRAMS_PER_SET)
    sizes = placed.groupBy("root").agg(F.greatest(F.count("*"), grams).alias("_count"))
    chosen = written(
        placed.join(sizes, "root").select("_digest", "_node", F.col("root").alias("_part"), "_count", "_rows"),
        "ngram-chosen",
    )
    dropped(parts)
    texts = docs.select(_digest(text).alias("_digest"), text_of(text).alias("_text"))
    found = texts.join(bounded(chosen, broadcast_rows), "_digest")
    sets = _sets(found.select("_node", "_part", "_count", "_rows", "_text"), size)
    links = written(_verified(_tiles(sets, "_part", "_node", "_count", SETS_PER_BLOCK), threshold), "ngram-links")
    dropped(chosen)

    classes = components(links.select("node", "root"))
    sums = links.groupBy("node").agg(F.sum("links").alias("_links"), F.sum("link_rows").alias("_link_rows"))
    texts_out = (
        nodes.join(sums, F.col("_node") == F.col("node"), "left")
        .drop("node")
        .join(classes, F.col("_node") == F.col("node"), "left")
        .select(
            "_digest",
            "_first",
            "_rows",
            F.coalesce("root", "_node").alias("_class"),
            F.coalesce("_links", F.lit(0)).cast("long").alias("_links"),
            (F.coalesce("_link_rows", F.lit(0)) + F.col("_rows") - 1).cast("long").alias("_link_rows"),
            "_node",
        )
    )
    known = written(texts_out, "ngram-texts")
    dropped(nodes, links)
    return rows, known


def jaccard_join(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:  # noqa: A002
    """A row per row of ``docs``: id, class_id, class_size, n_links, n_text_links.

    ``class_id`` is the smallest id among all rows that links connect to the row, itself
    included; ``class_size`` their number; ``n_links`` how many other rows have a
    similarity of at least the threshold, copies included; ``n_text_links`` how many other
    texts have.
    """
    rows, texts = classified(docs, id, text, **options)
    whole = texts.groupBy("_class").agg(F.min("_first").alias("class_id"), F.sum("_rows").alias("class_size"))
    named = written(texts.join(whole, "_class").select("_digest", "class_id", "class_size", "_link_rows", "_links"), "ngram-named")
    return rows.join(named, "_digest").select(
        F.col("_id").alias(id),
        "class_id",
        "class_size",
        F.col("_link_rows").alias("n_links"),
        F.col("_links").alias("n_text_links"),
    )


def one_of_each_class(
    docs: DataFrame,
    id: str = "doc_id",  # noqa: A002
    text: str = "text",
    broadcast_rows: int = BROADCAST_ROWS,
    **options,
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: the smallest id of each class.

    A null id comes after all others. Rows that nothing links to pass where they are read.
    """
    _, texts = classified(docs, id, text, broadcast_rows=broadcast_rows, **options)
    order = F.struct(F.col("_first").isNull().alias("none"), "_first", "_node")
    heads = texts.groupBy("_class").agg(F.min(order).alias("_head"))
    decided = texts.join(heads, "_class").select(
        "_digest", (F.col("_node") == F.col("_head._node")).alias("_stays"), "_rows"
    )
    # Texts that are alone in their class and in one row need no decision.
    decided = written(decided.where("not _stays or _rows > 1"), "ngram-decided")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.select(F.struct(*columns).alias("_doc"), _digest(text).alias("_digest")).join(
        bounded(decided, broadcast_rows), "_digest", "left"
    )
    alone = kept.where("_stays is null").select("_doc.*")
    tie = F.xxhash64(F.col("_doc").cast("string"))
    window = Window.partitionBy("_digest").orderBy(F.col(f"_doc.`{id}`").asc_nulls_last(), tie)
    first = kept.where("_stays").withColumn("_nth", F.row_number().over(window)).where("_nth = 1")
    return alone.unionByName(first.select("_doc.*"))
