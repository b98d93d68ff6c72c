"""Packing documents into token sequences: shortest pack first over the length histogram.

A document's ids, with an end id, are cut into blocks of a sequence's capacity and a
rest. Every block and rest is an item; items of one length are a class, and a class of
unbounded size is nothing but a number in the histogram, which has at most ``capacity``
entries. The plan is made from the histogram alone: lengths are placed longest first,
each into the packs that are shortest so far, and packs that hold the same lengths are
one pattern with a count. Packs left short are laid end to end and cut every
``capacity`` ids, so they need no padding either; what is left at the very end becomes
sequences of a power of two. The plan joins back to items by their rank in their class,
and says for a range of ranks where in which sequences its items go.

Ranks come without a shuffle of texts or ids. A task numbers its own items per class
while it writes them, and the counts per task and class, which are all that is grouped,
give each task its first rank. The ids are written bucketed by task, so that joining the
first ranks to them moves only the counts. Which of two documents of equal length comes
first follows the layout of the files; sequences are equally full with any layout.

A null text counts as empty and is one item, the end id. Rows that repeat an id, or have
none, are packed as documents of their own. An empty table gives no pieces. A text of any
length leaves a task as blocks; the task holds the ids of one document at a time. Only
id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from bisect import bisect_right

from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stoopwise.llm.common import ship
from stoopwise.session import new_path, written

CAPACITY = 4096
END_ID = 2

# Entries that a worker remembers before it forgets them all: about 100 MB.
MOST_WORDS = 400_000
MOST_PIECES = 700_000
# Ids in a batch of rows, four bytes each.
IDS_AT_ONCE = 1_000_000

# The normalizer and pre-tokenizer under which white space never enters a
# token, so that words can be encoded, and remembered, one by one.
BY_WORDS = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
            {"type": "Lowercase"},
        ],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
# Words of these characters are unchanged by NFC, and lower case is a matter of one
# character; "<" begins the special tokens. Other words go through the whole tokenizer.
PLAIN = re.compile("[!-;=-~À-įĲ-ň]+")


class WordEncoder:
    """Ids of texts as the tokenizers library gives them, as little-endian 32-bit numbers."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(source)
        parts = json.loads(source)
        self.by_words = all(parts.get(k) == v for k, v in BY_WORDS.items())
        self.words = _Words(self.whole) if self.by_words else None

    def ids(self, text: bytes) -> bytes:
        if self.words is None:
            return _packed(self.whole.encode(text.decode(), add_special_tokens=False).ids)
        self.words.forget()
        # bytes.split() cuts at ASCII white space alone.
        return b"".join(map(self.words.__getitem__, text.split()))


class _Words(dict):
    """The ids of words, found out when a word is first met."""

    def __init__(self, whole):
        import regex

        super().__init__()
        self.whole, self.model = whole, whole.model
        self.split = regex.compile(BY_WORDS["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.marks = _byte_marks()
        self.pieces: dict[str, bytes] = {}

    def forget(self) -> None:
        if len(self) > MOST_WORDS:
            self.clear()
        if len(self.pieces) > MOST_PIECES:
            self.pieces.clear()

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if PLAIN.fullmatch(text):
            lower = text.lower()
            if lower.isalpha():
                found = self.pieces.get(lower) or self._piece(lower)
            else:
                found = b"".join([self.pieces.get(p) or self._piece(p) for p in self.split(lower)])
        else:
            found = _packed(self.whole.encode(text, add_special_tokens=False).ids)
        self[word] = found
        return found

    def _piece(self, piece: str) -> bytes:
        marked = piece.encode().decode("latin-1").translate(self.marks)
        found = self.pieces[piece] = _packed([t.id for t in self.model.tokenize(marked)])
        return found


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _byte_marks() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(others)}


_ENCODERS: dict[int, WordEncoder] = {}


def _encoder(source: str) -> WordEncoder:
    key = zlib.crc32(source.encode())
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(source)
    return _ENCODERS[key]


# --- the plan -------------------------------------------------------------------------


class Pattern:
    """``count`` packs of the same lengths, ``total`` ids each.

    An item (of, low) stands for one length in every pack: pack p holds the item of
    class ``of`` whose rank is ``low + p``.
    """

    __slots__ = ("count", "total", "items")

    def __init__(self, count: int, total: int, items: list[tuple[int, int]]):
        self.count, self.total, self.items = count, total, items

    def split(self, count: int) -> Pattern:
        """Take ``count`` packs out; the others stay."""
        taken = Pattern(count, self.total, list(self.items))
        self.count -= count
        self.items = [(of, low + count) for of, low in self.items]
        return taken


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that hold every item of the histogram whole, lengths placed longest first."""
    by_room: dict[int, list[Pattern]] = {}
    rooms: list[int] = []  # ascending, each once

    def put(pattern: Pattern) -> None:
        room = capacity - pattern.total
        if room not in by_room:
            by_room[room] = []
            rooms.insert(bisect_right(rooms, room), room)
        by_room[room].append(pattern)

    def take() -> Pattern:
        pattern = by_room[rooms[-1]].pop()
        if not by_room[rooms[-1]]:
            del by_room[rooms.pop()]
        return pattern

    for length in sorted(histogram, reverse=True):
        left, low = histogram[length], 0
        while left:
            if not rooms or rooms[-1] < length:
                # Nothing has room: new packs, each with as many of this length as go in.
                each = min(capacity // length, left)
                pattern = Pattern(left // each, 0, [])
            else:
                pattern = take()
                if pattern.count > left:
                    short = pattern.split(left)
                    put(pattern)
                    pattern = short
                # Shortest first: fill up to the level of the next pack.
                level = rooms[-1] if rooms else 0
                each = max(1, min((capacity - pattern.total - level) // length, left // pattern.count))
            pattern.items += [(length, low + n * pattern.count) for n in range(each)]
            pattern.total += each * length
            left, low = left - each * pattern.count, low + each * pattern.count
            put(pattern)
    return [p for room in rooms for p in by_room[room]]


class Plan:
    """Where every item goes: class and rank give sequences and offsets.

    All packs lie on one line, full ones first, and the line is cut every ``capacity``
    ids. Full packs are cut between each other. Of the short ones, the fuller come
    first, and a cut falls inside of one wherever the line has filled a sequence. What
    is left at the end is cut into powers of two.
    """

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity = capacity
        ranges: dict[int, list[tuple[int, int, int]]] = {}
        at = 0
        for pattern in shortest_pack_first(histogram, capacity):
            inside = at
            for of, low in pattern.items:
                ranges.setdefault(of, []).append((low, inside, pattern.total))
                inside += of
            at += pattern.count * pattern.total
        self.ranges = {}
        for of, found in ranges.items():
            found.sort()
            self.ranges[of] = ([f[0] for f in found], found)
        # Where the sequences after the last one of full capacity begin, and the end.
        self.tail, left = [at - at % capacity], at % capacity
        for power in reversed(range(left.bit_length())):
            if left & (1 << power):
                self.tail.append(self.tail[-1] + (1 << power))

    def pieces(self, of: int, rank: int) -> list[tuple[int, int, int, int]]:
        """Start, length, sequence and offset of every piece of an item."""
        lows, rows = self.ranges[of]
        low, first, step = rows[bisect_right(lows, rank) - 1]
        at = first + (rank - low) * step
        found, start = [], 0
        while start < of:
            if at < self.tail[0]:
                sequence, offset = divmod(at, self.capacity)
                room = self.capacity - offset
            else:
                nth = bisect_right(self.tail, at) - 1
                sequence, offset = self.tail[0] // self.capacity + nth, at - self.tail[nth]
                room = self.tail[nth + 1] - at
            length = min(room, of - start)
            found.append((start, length, sequence, offset))
            start, at = start + length, at + length
        return found


# --- the job --------------------------------------------------------------------------


def _items(docs: DataFrame, source: str, id: str, text: str, capacity: int, end_id: int) -> DataFrame:  # noqa: A002
    """One row per block or rest: its ids, its class and its rank among those of its task."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(source)
    rows = docs.select(F.col(id), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))
    fields = [("_start", T.LongType()), ("_tokens", T.LongType()), ("_ids", T.BinaryType()),
              ("_class", T.IntegerType()), ("_rank", T.LongType()), ("_task", T.IntegerType())]
    schema = T.StructType([rows.schema[0], *(T.StructField(n, t, False) for n, t in fields)])
    end, block = _packed([end_id]), 4 * capacity

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        encoder, target, task = _encoder(shared.value), to_arrow_schema(schema), TaskContext.get().partitionId()
        ranks: dict[int, int] = {}

        def batch_of(ids, found):
            starts, tokens, slices, classes, numbers = zip(*found, strict=True)
            columns = [starts, tokens, slices, classes, numbers, [task] * len(found)]
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays(ids), *(pa.array(c, f.type) for c, f in zip(columns, list(target)[1:], strict=True))],
                schema=target,
            )

        ids, found, held = [], [], 0
        for batch in batches:
            for at, value in enumerate(batch.column(1).to_pylist()):
                all_ids = encoder.ids(value) + end
                for begin in range(0, len(all_ids), block):
                    part = all_ids[begin : begin + block]
                    of = len(part) // 4
                    rank = ranks.get(of, 0)
                    ranks[of] = rank + 1
                    found.append((begin // 4, len(all_ids) // 4, part, of, rank))
                    ids.append(batch.column(0).slice(at, 1))
                    held += of
                    if held >= IDS_AT_ONCE:
                        yield batch_of(ids, found)
                        ids, found, held = [], [], 0
        if found:
            yield batch_of(ids, found)

    return rows.mapInArrow(run, schema)


def _bucketed(df: DataFrame, by: str) -> DataFrame:
    """``df`` written in buckets of ``by`` without a shuffle; a task has one value of it."""
    spark = df.sparkSession
    path, name = new_path(spark, "items"), f"items_{uuid.uuid4().hex}"
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    write = df.write.bucketBy(buckets, by).option("path", path).option("compression", "zstd")
    write.saveAsTable(name)
    table = spark.table(name)
    table.schema  # noqa: B018 - resolved, so that the name is not needed any more
    spark.sql(f"DROP TABLE {name}")
    return table


def packed(
    docs: DataFrame,
    tokenizer: str,
    id: str = "doc_id",  # noqa: A002
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: id, start, length, ids (binary, little-endian unsigned 32 bits),
    doc_tokens, sequence_id, offset.

    ``tokenizer`` is the content of a file of the tokenizers library. Every id is in
    exactly one piece, the pieces of a sequence follow each other from offset 0 on, and
    every sequence has ``capacity`` ids but for the last few, which have a power of two.
    """
    spark = docs.sparkSession
    items = _bucketed(_items(docs, tokenizer, id, text, capacity, end_id), "_task")
    sizes = written(items.groupBy("_task", "_class").count(), "sizes")
    histogram = {r["_class"]: r["n"] for r in sizes.groupBy("_class").agg(F.sum("count").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(Plan(histogram, capacity))
    before = Window.partitionBy("_class").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("_task", "_class", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    # One row per task, so that the join is on the column that the buckets go by.
    first = first.groupBy("_task").agg(F.map_from_entries(F.collect_list(F.struct("_class", "_first"))).alias("_firsts"))
    ranked = items.join(first.hint("shuffle_hash"), "_task").select(
        id, "_start", "_tokens", "_ids", "_class", (F.col("_rank") + F.col("_firsts")[F.col("_class")]).alias("_rank")
    )
    fields = [("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()),
              ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType())]
    schema = T.StructType([ranked.schema[0], *(T.StructField(n, t, False) for n, t in fields)])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target, places = to_arrow_schema(schema), plan.value
        for batch in batches:
            at, found = [], []
            starts, tokens, ids, classes, ranks = (c.to_pylist() for c in batch.columns[1:])
            for n, (of, rank) in enumerate(zip(classes, ranks, strict=True)):
                for start, length, sequence, offset in places.pieces(of, rank):
                    at.append(n)
                    part = ids[n][4 * start : 4 * (start + length)]
                    found.append((starts[n] + start, length, part, tokens[n], sequence, offset))
            if at:
                columns = zip(zip(*found, strict=True), list(target)[1:], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), *(pa.array(c, f.type) for c, f in columns)], schema=target
                )

    return ranked.mapInArrow(run, schema)


def digests(pieces: DataFrame, id: str = "doc_id") -> DataFrame:  # noqa: A002
    """Pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select(
        id, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def tokenizer_source(path: str) -> str:
    """The content of a tokenizer's file, read on the driver: a vocabulary has a fixed size."""
    with open(path, encoding="utf-8") as file:
        return file.read()
