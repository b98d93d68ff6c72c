"""Repair of conversations whose turns do not alternate, by cheapest edits.

A conversation is the rows of one id by turn (nulls first, then role and digest of the
text). A row is blank (nothing but white space), a duplicate (role and text seen
earlier) or truncated (its last visible character ends no sentence); the first that
holds counts. Edits make the initials of the roles read ``(s?(ua)+)?``: Keep costs 0,
Rerole to user or assistant 2, Delete 3 (and blank and duplicate rows must go), Insert
of an empty turn 2; a truncated row that stays adds 1. Of the cheapest edits the ones
whose initials are ASCII-least are taken.

The states of the pattern are four, so what is left to pay after a row is a vector of
four costs. Less its least entry such a vector is one of a few, and a row is one of nine
symbols, so the step over every block of ``BLOCK`` symbols is computed once for each of
the vectors (the Four Russians' tables): a conversation is read backward in blocks by
lookup. Then it is walked forward; each block is expanded backward from the vector at
its end, and the least initial among the cheapest edits is taken row by row. Costs to go
are exact, so no tie is lost.

Rows are range-partitioned by conversation and turn, so a conversation of any size lies
on a run of partitions. A task settles the conversations that it has whole. The first
and the last one of a task, and one whose texts pass ``HELD_CHARS``, are cut into
segments, and a segment is a function too: for each vector at its end the vector at its
beginning, and for each state at its beginning the state at its end. Functions of a few
numbers per segment are folded per conversation, and every segment is then settled on
its own. Only the digest over a whole conversation has to read it in order: it streams
through one task in bounded memory.

Equal rows (same id, turn, role and text) are counted before rows are moved, so that a
row repeated any number of times moves once. A null id is a conversation of its own; null
roles and texts are one space; null turns come first. A role without a known initial
can only be reroled or deleted. An empty table gives no rows. Only the four columns are
read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stoopwise.llm.common import ship
from stoopwise.session import written

BLOCK = 4
HELD_CHARS = 4_000_000
ROWS_PER_PARTITION = 400_000

# The costs of edits, and the white space of the contract.
RENAMED, DELETED, INSERTED, UNFINISHED = 2, 3, 2, 1
SPACES = " \t\n\x0b\x0c\r"
ENDS = ".!?"

# States: nothing yet, after a system turn, a user turn, an assistant turn. The roles
# that may come next and the states they lead to; where a conversation may end.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ROLE = {2: "user", 3: "assistant"}
TURN = tuple(next(state for role, state in after.items() if role != "s") for after in NEXT)
FINAL = (True, False, False, True)
NEVER = 1 << 40

# Symbols: twice the role (s, u, a, any other), plus one if truncated; 8 must go.
ROLES = "sua"
GONE = 8
SYMBOLS = 9


def _closed(costs: list[int]) -> list[int]:
    """Costs to go once turns may be inserted before."""
    for _ in range(3):
        costs = [min(c, INSERTED + costs[TURN[q]]) for q, c in enumerate(costs)]
    return costs


def _kept(state: int, symbol: int) -> int | None:
    role = ROLES[symbol >> 1] if symbol >> 1 < len(ROLES) else ""
    return NEXT[state].get(role)


def _before(after: list[int], symbol: int) -> list[int]:
    """Costs to go before a row, of those after it."""
    if symbol == GONE:
        return [DELETED + c for c in after]
    extra = UNFINISHED * (symbol & 1)
    costs = []
    for state in range(4):
        kept = _kept(state, symbol)
        costs.append(
            min(
                DELETED + after[state],
                RENAMED + extra + after[TURN[state]],
                NEVER if kept is None else extra + after[kept],
            )
        )
    return _closed(costs)


class Tables:
    """Vectors of costs to go, and the steps over symbols and blocks as lookups."""

    def __init__(self, block: int = BLOCK):
        import numpy as np

        self.block = block
        end = _closed([0 if f else NEVER for f in FINAL])
        self.vectors, self.of = [], {}
        self.end, base = self._number(end)
        assert base == 0
        steps = []
        while len(steps) < len(self.vectors):
            vector = self.vectors[len(steps)]
            steps.append([self._number(_before(list(vector), s)) for s in range(SYMBOLS)])
        # One symbol: vector before, and what it costs more.
        self.to = np.array([[v for v, _ in row] for row in steps])
        self.cost = np.array([[c for _, c in row] for row in steps])
        # Blocks by their number in base 9, first symbol highest; read from the last on.
        to, cost = self.to, self.cost
        for _ in range(block - 1):
            # to[v, rest] is the vector after the symbol that is put in front.
            cost = np.concatenate([cost + self.cost[to, s] for s in range(SYMBOLS)], axis=1)
            to = np.concatenate([self.to[to, s] for s in range(SYMBOLS)], axis=1)
        self.block_to, self.block_cost = to.tolist(), cost.tolist()
        self.to, self.cost = self.to.tolist(), self.cost.tolist()

    def _number(self, costs: list[int]) -> tuple[int, int]:
        least = min(costs)
        key = tuple(c - least for c in costs)
        if key not in self.of:
            self.of[key] = len(self.vectors)
            self.vectors.append(key)
        return self.of[key], least

    def ends(self, symbols: bytes, vector: int) -> tuple[list[int], int]:
        """Vectors at the ends of all blocks, and before the first; the cost that is not in them.

        The first block is the short one.
        """
        first = len(symbols) % self.block
        at, cost = [vector], 0
        for begin in range(len(symbols) - self.block, first - 1, -self.block):
            number = 0
            for s in symbols[begin : begin + self.block]:
                number = number * SYMBOLS + s
            cost += self.block_cost[vector][number]
            vector = self.block_to[vector][number]
            at.append(vector)
        for s in reversed(symbols[:first]):
            cost += self.cost[vector][s]
            vector = self.to[vector][s]
        if first:
            at.append(vector)
        at.reverse()
        return at, cost

    def cost_from(self, symbols: bytes, vector: int, state: int) -> tuple[int, int]:
        """Vector before the symbols, and the cost of the cheapest edits from ``state`` on."""
        at, cost = self.ends(symbols, vector)
        return at[0], cost + self.vectors[at[0]][state]

    def edits(self, symbols: bytes, vector: int, state: int, last: bool):
        """Yield (initial, row or -1, state after) of the cheapest, ASCII-least edits.

        ``vector`` holds the costs to go after the symbols. Turns inserted after the last
        row come only if ``last``: else they belong to what follows.
        """
        at, _ = self.ends(symbols, vector)
        begin, n = 0, 0
        while begin < len(symbols):
            size = self.block if (len(symbols) - begin) % self.block == 0 else len(symbols) % self.block
            end = begin + size
            # The block expanded: costs to go before each of its rows, on one scale.
            costs = [list(self.vectors[at[n + 1]])]
            for s in reversed(symbols[begin:end]):
                costs.append(_before(costs[-1], s))
            costs.reverse()
            for row in range(begin, end):
                now, after, s = costs[row - begin], costs[row - begin + 1], symbols[row]
                extra = UNFINISHED * (s & 1) if s != GONE else 0
                while True:
                    left = now[state]
                    if left == DELETED + after[state]:
                        yield "D", row, state
                        break
                    if left == INSERTED + now[TURN[state]]:
                        state = TURN[state]
                        yield "I", -1, state
                        continue
                    kept = _kept(state, s)
                    if kept is not None and left == extra + after[kept]:
                        state = kept
                        yield "K", row, state
                    else:
                        state = TURN[state]
                        yield "R", row, state
                    break
            begin, n = end, n + 1
        while last and not FINAL[state]:
            state = TURN[state]
            yield "I", -1, state

    def exits(self, symbols: bytes, vector: int) -> list[int]:
        """The state after the symbols for each state before them."""
        found = []
        for state in range(4):
            for _, _, after in self.edits(symbols, vector, state, False):
                state = after
            found.append(state)
        return found


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


# --- rows -----------------------------------------------------------------------------


def _spaced(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def messages(conversations: DataFrame, id: str = "conv_id") -> DataFrame:  # noqa: A002
    """The four columns as they are read: id, turn, role and text, nulls of the last two as a space."""
    return conversations.select(F.col(id).alias("conv"), F.col("turn").cast("long"), _spaced("role").alias("role"), _spaced("text").alias("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """Messages damaged by the remainder of a checksum of id and turn.

    0 drops a row, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it
    a user's.
    """
    key = F.concat(_spaced("conv"), F.lit(":"), _spaced("turn"))
    kind = F.crc32(key.cast("binary")) % 20
    return (
        rows.withColumn("_kind", kind)
        .where("_kind <> 0")
        .withColumn("text", F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
        .withColumn("role", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")))
        .withColumn("times", F.when(F.col("_kind") == 3, 2).otherwise(1))
        .drop("_kind")
    )


def _ordered(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number, in order, range-partitioned; ``seen`` marks later ones
    of a role and text that the conversation had at an earlier turn.

    Columns conv, turn, role, mark, times, seen, text.
    """
    if "times" not in rows.columns:
        rows = rows.withColumn("times", F.lit(1))
    keys = ["conv", "turn", "role", "mark"]
    marked = rows.withColumn("mark", F.unhex(F.md5(F.col("text").cast("binary"))))
    once = written(marked.groupBy(*keys).agg(F.sum("times").cast("long").alias("times"), F.any_value("text").alias("text")), "messages")
    narrow = once.select(*keys)
    # Null turns come first, and a struct's null field is its least.
    first = narrow.groupBy("conv", "role", "mark").agg(F.min(F.struct("turn")).alias("_first"))
    first = first.select("conv", F.col("_first.turn").alias("turn"), "role", "mark")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    later = narrow.alias("a").join(first.alias("b"), same, "left_anti")
    # A later one's mark is a row of its own that comes just before it, so texts are not
    # moved for a join.
    both = once.select(*keys, "times", F.lit(False).alias("seen"), "text").unionByName(
        later.select(*keys, F.lit(0).cast("long").alias("times"), F.lit(True).alias("seen"), F.lit("").alias("text"))
    )
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), once.count() // ROWS_PER_PARTITION + 1)
    by = [F.col(k).asc_nulls_first() for k in keys]
    return both.repartitionByRange(parts, *by).sortWithinPartitions(*by, F.col("seen").desc())


class _Segment:
    """Rows of one conversation in order, and what is counted of them."""

    def __init__(self, conv):
        self.conv = conv
        self.symbols = bytearray()
        self.rows: list[tuple[str, str]] = []
        self.chars = 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = None
        self.least = self.most = None
        self.turns = 0
        self.ends_at = None

    def add(self, turn, role, text, times, seen) -> None:
        visible = text.rstrip(SPACES)
        role_at = ROLES.find(role[:1]) if role else -1
        symbol = 2 * (role_at if role_at >= 0 else len(ROLES))
        blank = not visible
        open_end = not blank and visible[-1] not in ENDS
        for nth in (0, 1)[: 2 if times > 1 else 1]:
            many = times - 1 if nth else 1
            if blank:
                self.blank += many
            elif seen or nth:
                self.duplicate += many
            else:
                self.truncated += open_end
            gone = blank or seen or nth
            self.symbols += bytes([GONE if gone else symbol + open_end]) * many
            self.rows += [(role, "" if gone else text)] * many
        if self.rows and self.last is not None:
            self.illegal += self.last + role[:1] not in LEGAL
        if self.first is None:
            self.first = role[:1]
        self.last = role[:1]
        self.illegal += (times - 1) * (role[:1] * 2 not in LEGAL)
        self.chars += len(text) + times
        if turn is not None:
            if turn != self.ends_at:
                self.turns += 1
            self.least = turn if self.least is None else self.least
            self.most = self.ends_at = turn

    def facts(self) -> tuple:
        return (self.blank, self.duplicate, self.truncated, self.illegal, self.first, self.last, self.least, self.most, self.turns)


# Initials that may follow each other.
LEGAL = {"su", "ua", "au"}


def _joined(facts: list[tuple]) -> tuple[int, int, int, int, int]:
    """gaps, blank, duplicate, truncated and illegal of segments that follow each other."""
    blank, duplicate, truncated, illegal = (sum(f[i] for f in facts) for i in range(4))
    illegal += sum(a[5] + b[4] not in LEGAL for a, b in zip(facts, facts[1:], strict=False))
    timed = [f for f in facts if f[8]]
    gaps = 0
    if timed:
        turns = sum(f[8] for f in timed) - sum(a[7] == b[6] for a, b in zip(timed, timed[1:], strict=False))
        gaps = timed[-1][7] - timed[0][6] + 1 - turns
    return gaps, blank, duplicate, truncated, illegal


FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
PART = T.StructType(
    [
        T.StructField("kind", T.StringType(), False),  # whole, segment or row
        T.StructField("part", T.IntegerType(), False),
        T.StructField("segment", T.LongType(), False),
        T.StructField("n", T.LongType(), False),
        # Of a whole conversation.
        *(T.StructField(f, T.LongType()) for f in FACTS),
        T.StructField("audit", T.StringType()),
        T.StructField("sha256", T.StringType()),
        # Of a segment: for each vector after it the vector before, the cost, the states after.
        T.StructField("to", T.ArrayType(T.IntegerType())),
        T.StructField("costs", T.ArrayType(T.LongType())),
        T.StructField("exits", T.ArrayType(T.IntegerType())),
        *(T.StructField(f, T.LongType()) for f in ("s_blank", "s_duplicate", "s_truncated", "s_illegal")),
        T.StructField("first", T.StringType()),
        T.StructField("last", T.StringType()),
        *(T.StructField(f, T.LongType()) for f in ("least", "most", "turns")),
        # Of a row, open or repaired.
        T.StructField("edit", T.StringType()),
        T.StructField("symbol", T.IntegerType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)


def _repaired(segment: _Segment | list, symbols: bytes, vector: int, state: int, last: bool):
    """Yield (initial, role, text) of every edit; role and text are null where a row goes."""
    for letter, row, after in tables().edits(symbols, vector, state, last):
        if letter == "D":
            yield letter, None, None
        elif letter == "I":
            yield letter, ROLE[after], ""
        else:
            role, text = segment[row]
            yield letter, role if letter == "K" else ROLE[after], text


class _Digest:
    """Initials and hash of repaired rows, in order."""

    def __init__(self):
        self.hash, self.audit, self.some = hashlib.sha256(), [], False

    def add(self, edits) -> None:
        for letter, role, text in edits:
            self.audit.append(letter)
            if role is not None:
                self.hash.update(f"{chr(10) if self.some else ''}{role}:{text}".encode())
                self.some = True


def _settled(ordered: DataFrame, detail: bool) -> DataFrame:
    """Whole conversations settled, the others as segments and rows."""
    conv = ordered.schema["conv"]
    schema = T.StructType([conv, *PART])
    names = PART.fieldNames()
    held = HELD_CHARS

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target, part, table = to_arrow_schema(schema), TaskContext.get().partitionId(), tables()
        out, ids, size = [], [], 0
        number = 0

        def row(segment, **values):
            nonlocal size
            ids.append(segment.conv)
            out.append({"part": part, "segment": number, "n": 0} | values)
            size += len(values.get("text") or "") + 50

        def flush():
            nonlocal out, ids, size
            columns = [pa.array(ids, target.field(0).type)]
            columns += [pa.array([o.get(f) for o in out], target.field(f).type) for f in names]
            out, ids, size = [], [], 0
            return pa.RecordBatch.from_arrays(columns, schema=target)

        def close(segment):
            """A conversation that this task has whole."""
            symbols = bytes(segment.symbols)
            digest, edits = _Digest(), _repaired(segment.rows, symbols, table.end, 0, True)
            if detail:
                for n, (letter, role, text) in enumerate(edits):
                    row(segment, kind="row", n=n, edit=letter, role=role, text=text)
                return
            digest.add(edits)
            facts = _joined([segment.facts()])
            cost = table.cost_from(symbols, table.end, 0)[1]
            row(segment, kind="whole", audit="".join(digest.audit), sha256=digest.hash.hexdigest(), **dict(zip(FACTS, (*facts, cost), strict=True)))

        def hand_on(segment):
            """A part of a conversation that others may have parts of."""
            nonlocal number
            symbols = bytes(segment.symbols)
            before = [table.ends(symbols, v) for v in range(len(table.vectors))]
            facts = dict(zip(("s_blank", "s_duplicate", "s_truncated", "s_illegal", "first", "last", "least", "most", "turns"), segment.facts(), strict=True))
            row(segment, kind="segment", to=[at[0] for at, _ in before], costs=[c for _, c in before], exits=[e for v in range(len(table.vectors)) for e in table.exits(symbols, v)], **facts)
            for n, (symbol, (role, text)) in enumerate(zip(symbols, segment.rows, strict=True)):
                row(segment, kind="open", n=n, symbol=symbol, role=role, text=text)
            number += 1

        now, begun, seen = None, False, False
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv", "turn", "role", "times", "seen", "text"))
            for conv_id, turn, role, times, mark, text in zip(*columns, strict=True):
                if now is None or conv_id != now.conv:
                    if now is not None:
                        # The first conversation may have begun in an earlier partition.
                        hand_on(now) if begun is False else close(now)
                        begun = True
                    now, seen = _Segment(conv_id), False
                if mark:
                    seen = True
                    continue
                # A row repeated very often is cut as well: its copies are all to go.
                while times:
                    many = min(times, held)
                    now.add(turn, role, text, many, seen)
                    times -= many
                    seen = seen or times > 0
                    if now.chars > held:
                        hand_on(now)
                        now, begun = _Segment(conv_id), False
                    if size > held:
                        yield flush()
                seen = False
        if now is not None and now.symbols:
            hand_on(now)
        if out:
            yield flush()

    return ordered.mapInArrow(run, schema)


def _fold(parts: DataFrame) -> DataFrame:
    """Per segment the vector after it and the state before it; per conversation its facts."""
    conv = parts.schema["conv"]
    facts = ["s_blank", "s_duplicate", "s_truncated", "s_illegal", "first", "last", "least", "most", "turns"]
    schema = T.StructType(
        [conv, *(T.StructField(f, T.LongType()) for f in FACTS),
         T.StructField("at", T.ArrayType(T.StructType([
             T.StructField("part", T.IntegerType()), T.StructField("segment", T.LongType()),
             T.StructField("vector", T.IntegerType()), T.StructField("state", T.IntegerType()),
             T.StructField("last", T.BooleanType())])))]
    )
    rows = parts.where("kind = 'segment'")
    one = F.struct("part", "segment", "to", "costs", "exits", *facts)
    lists = rows.groupBy("conv").agg(F.sort_array(F.collect_list(one)).alias("segments"))

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target, table = to_arrow_schema(schema), tables()
        for batch in batches:
            out = []
            for segments in batch.column("segments").to_pylist():
                vector, cost, after = table.end, 0, []
                for s in reversed(segments):
                    after.append(vector)
                    cost += s["costs"][vector]
                    vector = s["to"][vector]
                after.reverse()
                cost += table.vectors[vector][0]
                state, at = 0, []
                for s, v in zip(segments, after, strict=True):
                    at.append({"part": s["part"], "segment": s["segment"], "vector": v, "state": state, "last": s is segments[-1]})
                    state = s["exits"][4 * v + state]
                out.append((*_joined([tuple(s[f] for f in facts) for s in segments]), cost, at))
            if out:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), list(target)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("conv"), *columns], schema=target)

    return lists.mapInArrow(run, schema)


def _with_states(parts: DataFrame, folded: DataFrame) -> DataFrame:
    """Rows of segments, with the vector after and the state before their segment."""
    at = folded.select(F.explode("at").alias("at")).select("at.*")
    return parts.where("kind = 'open'").select("conv", "part", "segment", "n", "symbol", "role", "text").join(at, ["part", "segment"])


def repaired(rows: DataFrame) -> DataFrame:
    """One row per edit of every conversation, in order of (part, segment, n).

    ``edit`` is its initial; ``role`` and ``text`` are those of the turn that stands after
    the edit, null where a row goes. Segments are settled each on its own.
    """
    ship(rows.sparkSession)
    parts = written(_settled(_ordered(rows), detail=True), "repaired")
    whole = parts.where("kind = 'row'").select("conv", "part", "segment", "n", "edit", "role", "text")
    opened = _with_states(parts, _fold(parts))

    def settle(frame):
        import pandas as pd

        frame = frame.sort_values("n")
        head = frame.iloc[0]
        texts = list(zip(frame["role"], frame["text"], strict=True))
        edits = list(_repaired(texts, bytes(frame["symbol"].tolist()), int(head["vector"]), int(head["state"]), bool(head["last"])))
        out = pd.DataFrame(edits, columns=["edit", "role", "text"])
        # A conversation's id is that of its rows; a null stays a null.
        out.insert(0, "n", range(len(out)))
        out.insert(0, "segment", head["segment"])
        out.insert(0, "part", head["part"])
        out.insert(0, "conv", [frame["conv"].iloc[0]] * len(out))
        return out

    return whole.unionByName(opened.groupBy("part", "segment").applyInPandas(settle, whole.schema))


def summaries(conversations: DataFrame, rows: DataFrame, id: str = "conv_id") -> DataFrame:  # noqa: A002
    """One row per id of ``conversations``: gaps, faults, cost and initials of the edits, and
    the SHA-256 of the repaired turns, for the messages ``rows``."""
    ship(rows.sparkSession)
    parts = written(_settled(_ordered(rows), detail=False), "settled")
    names = [*FACTS, "audit", "repaired_sha256"]
    whole = parts.where("kind = 'whole'").select("conv", *FACTS, "audit", F.col("sha256").alias("repaired_sha256"))
    folded = written(_fold(parts), "folded")
    opened = folded.select("conv", *FACTS).alias("f").join(
        _streamed(_with_states(parts, folded)).alias("d"), F.col("f.conv").eqNullSafe(F.col("d.conv"))
    ).select("f.*", "audit", "repaired_sha256")
    found = whole.unionByName(opened)
    every = conversations.select(F.col(id)).distinct()
    joined = every.join(found, F.col(f"`{id}`").eqNullSafe(found["conv"]), "left")
    empty = hashlib.sha256(b"").hexdigest()
    blanks = [F.lit(0).cast("long")] * len(FACTS) + [F.lit(""), F.lit(empty)]
    return joined.select(F.col(id), *[F.coalesce(F.col(n), b).alias(n) for n, b in zip(names, blanks, strict=True)])


def _streamed(rows: DataFrame) -> DataFrame:
    """Initials and digest per conversation, its segments read in order."""
    conv = rows.schema["conv"]
    schema = T.StructType([conv, T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    order = ["part", "segment", "n"]
    sorted_rows = rows.repartition("conv").sortWithinPartitions("conv", *order)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)

        def segments():
            key, held = None, []
            for batch in batches:
                columns = (batch.column(c).to_pylist() for c in ("conv", "part", "segment", "symbol", "role", "text", "vector", "state", "last"))
                for conv_id, part, segment, symbol, role, text, *head in zip(*columns, strict=True):
                    if (conv_id, part, segment) != key:
                        if held:
                            yield key[0], held, settings
                        key, held, settings = (conv_id, part, segment), [], head
                    held.append((symbol, role, text))
            if held:
                yield key[0], held, settings

        digest, now = None, None
        for conv_id, held, (vector, state, last) in segments():
            if digest is None or conv_id != now:
                if digest is not None:
                    yield _digest_row(pa, target, now, digest)
                digest, now = _Digest(), conv_id
            digest.add(_repaired([h[1:] for h in held], bytes(h[0] for h in held), vector, state, last))
        if digest is not None:
            yield _digest_row(pa, target, now, digest)

    return sorted_rows.mapInArrow(run, schema)


def _digest_row(pa, target, conv, digest: _Digest):
    values = ([conv], ["".join(digest.audit)], [digest.hash.hexdigest()])
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, target, strict=True)], schema=target)
