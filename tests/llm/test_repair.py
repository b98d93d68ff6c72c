"""Repair against a plain search over all edits, and against its SQL twin."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from stoopwise.llm import repair
from stoopwise.llm.catalog import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(rows):
    """Least (cost, initials) over all edits, tried row by row; rows are (role, text, fault)."""
    best = {0: (0, "", ())}

    def put(found, state, cost, audit, said):
        if state is not None and (state not in found or (cost, audit) < found[state][:2]):
            found[state] = (cost, audit, said)

    def inserted(found):
        for _ in range(4):
            for state, (cost, audit, said) in list(found.items()):
                for role in ("user", "assistant"):
                    put(found, AFTER.get((state, role[0])), cost + 2, audit + "I", (*said, (role, "")))
        return found

    best = inserted(best)
    for role, text, fault in rows:
        found = {}
        for state, (cost, audit, said) in best.items():
            put(found, state, cost + 3, audit + "D", said)
            if fault in ("blank", "duplicate"):
                continue
            extra = fault == "truncated"
            put(found, AFTER.get((state, role[:1])), cost + extra, audit + "K", (*said, (role, text)))
            for other in ("user", "assistant"):
                put(found, AFTER.get((state, other[0])), cost + 2 + extra, audit + "R", (*said, (other, text)))
        best = inserted(found)
    return min(v for state, v in best.items() if state in (0, 3))


def plain(conversations, damage=True):
    """The contract in Python, over (conv, turn, role, text)."""
    out, rows = {}, {}
    for conv, turn, role, text in conversations:
        rows.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20 if damage else 9
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        rows[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    for conv, found in rows.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        seen, marked = set(), []
        for _, role, text in found:
            visible = text.rstrip(repair.SPACES)
            fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = {t for t, _, _ in found if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        count = {f: sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")}
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, said = cheapest(marked)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, digest)
    return out


def random_rows(seed, n):
    rng = random.Random(seed)
    texts = ["Yes.", "Yes.", "No!", "why?", "cut off", " \n", "", None, "Well, it is. ", "é.", " "]
    roles = ["user", "assistant", "user", "assistant", "system", None, "tool", "", "Unknown", "agent"]
    return [
        (rng.choice([1, 2, 3, 3, 3, 3, None]), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts))
        for _ in range(n)
    ]


SCHEMA = "conv_id long, turn long, role string, text string"


def collected(frame):
    return {r.conv_id: tuple(r[n] for n in NAMES) for r in frame.collect()}


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_query_equals_the_plain_version_and_its_twin(spark, folder):
    rows = queries()["op12_repair"](spark, folder)
    found = collected(rows)
    table = spark.read.parquet(f"{folder}/conversations.parquet")
    assert found == plain([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    base = duckdb.connect()
    base.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{folder}/conversations.parquet')")
    twin = base.execute(oracle_sql()["op12_repair"])
    names = [d[0] for d in twin.description]
    assert names == rows.columns
    assert {r[0]: r[1:] for r in twin.fetchall()} == found


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("held", [4_000_000, 40])
def test_conversations_over_many_partitions(spark, monkeypatch, seed, held):
    """Long conversations, nulls, ties and repeated rows; partitions of a few rows, and small segments."""
    monkeypatch.setattr(repair, "HELD_CHARS", held)
    monkeypatch.setattr(repair, "ROWS_PER_PARTITION", 7)
    rows = random_rows(seed, 90)
    # The parameter is read on the driver; what is random must not decide anything.
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for damage in (True, False):
        messages = repair.messages(frame)
        found = repair.summaries(frame, repair.damaged(messages) if damage else messages)
        assert collected(found) == plain(rows, damage)


def test_the_twin_on_nulls_and_ties():
    base = duckdb.connect()
    rows = random_rows(11, 60)
    base.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    base.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    found = {r[0]: r[1:] for r in base.execute(oracle_sql()["op12_repair"]).fetchall()}
    assert found == plain(rows)


def test_repaired_turns(spark, monkeypatch):
    monkeypatch.setattr(repair, "ROWS_PER_PARTITION", 9)
    rows = random_rows(21, 80)
    frame = spark.createDataFrame(rows, SCHEMA)
    edits = repair.repaired(repair.messages(frame)).collect()
    want = plain(rows, damage=False)
    for conv, facts in want.items():
        mine = sorted((e for e in edits if e.conv == conv), key=lambda e: (e.part, e.segment, e.n))
        assert "".join(e.edit for e in mine) == facts[6]
        said = "\n".join(f"{e.role}:{e.text}" for e in mine if e.role is not None)
        assert hashlib.sha256(said.encode()).hexdigest() == facts[7]


def test_a_row_repeated_often(spark, monkeypatch):
    monkeypatch.setattr(repair, "HELD_CHARS", 100)
    rows = [(7, 0, "user", "Hi.")] * 500 + [(7, 1, "assistant", "Yes.")]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = collected(repair.summaries(frame, repair.messages(frame)))
    assert found == plain(rows, damage=False)
    assert found[7][6] == "K" + "D" * 499 + "K"


def test_small_cases(spark):
    frame = spark.createDataFrame([(1, 0, "user", "x" * 300_000 + ".")], SCHEMA)
    frame = frame.withColumn("conv", F.lit("c")).withColumn("_kind", F.lit(0)).withColumn("mark", F.lit(1))
    found = collected(repair.summaries(frame, repair.messages(frame)))
    assert found == plain([(1, 0, "user", "x" * 300_000 + ".")], damage=False)
    # All rows dropped: zeros, no edits, the hash of nothing.
    dropped = next(c for c in range(10**6) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    gone = spark.createDataFrame([(dropped, 0, "user", "Hi.")], SCHEMA)
    found = collected(repair.summaries(gone, repair.damaged(repair.messages(gone))))
    assert found == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    empty = frame.limit(0)
    assert repair.summaries(empty, repair.damaged(repair.messages(empty))).count() == 0
    assert repair.repaired(repair.messages(empty)).count() == 0


def test_blocks_equal_single_steps():
    rng = random.Random(5)
    one = repair.Tables(block=1)
    for block in (2, 3, 4):
        table = repair.Tables(block=block)
        for _ in range(200):
            symbols = bytes(rng.choices(range(9), k=rng.randint(0, 13)))
            for state in range(4):
                assert table.cost_from(symbols, table.end, state) == one.cost_from(symbols, one.end, state)
            edits = list(table.edits(symbols, table.end, 0, True))
            assert edits == list(one.edits(symbols, one.end, 0, True))
