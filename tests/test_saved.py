import datetime
import random

import pytest

from stoopwise.plans import saved

START = datetime.datetime(2024, 1, 1)


def replay(events):
    """The listing as a sequence of requests leaves it."""
    row = None
    for ts, _, action, name, rent in sorted(events):
        if action == "save":
            if row is None:
                row = {"date_saved": ts, "is_deleted": False, "deleted_at": None, "custom_name": None, "rent_price": None}
            elif row["is_deleted"]:
                row.update(is_deleted=False, deleted_at=None, date_saved=ts)
        elif action == "delete" and row and not row["is_deleted"]:
            row.update(is_deleted=True, deleted_at=ts)
        elif action == "update" and row:
            row.update(custom_name=name, rent_price=int(rent) if rent else None)
    return row


@pytest.mark.parametrize("rows_per_task", [1_000_000, 25])
def test_state_equals_the_replay(spark, rows_per_task):
    rng = random.Random(17)
    cases = {}
    for user in range(150):
        n = 60 if user == 0 else rng.randint(1, 9)
        # Times repeat, so the event id has to break ties.
        cases[user] = [
            (
                START + datetime.timedelta(hours=rng.randint(0, 8)),
                user * 1000 + i,
                rng.choice(["save", "delete", "update"]),
                rng.choice([None, "", f"n{i}"]),
                rng.choice(["", None, str(i)]),
            )
            for i in range(n)
        ]
    rows = [(e, t, u, "1 Elm" if u % 2 else "1 ELM", a, n, None, r) for u, es in cases.items() for t, e, a, n, r in es]
    rows.append((999_999, START, 1, "unknown", "save", None, None, None))
    events = spark.createDataFrame(
        rows,
        "event_id int, ts timestamp, user_id int, address string, action string, custom_name string, "
        "remarks string, rent string",
    )
    properties = spark.createDataFrame([(1, "1 Elm")], "property_id int, address string")
    got = {}
    for r in saved.saved_state(events, properties, rows_per_task).collect():
        assert r["address"] == "1 ELM"
        got[r["user_id"]] = {
            k: r[k] for k in ("date_saved", "is_deleted", "deleted_at", "custom_name", "rent_price")
        }
    assert got == {u: replay(es) for u, es in cases.items() if replay(es)}


def test_cards_and_status(spark):
    state = spark.createDataFrame(
        [
            (1, "1 ELM", START, False, None, "", "note", 0),
            (2, "1 ELM", START, False, None, "Home", "", 900),
            (3, "1 ELM", START, True, START, None, None, None),
        ],
        "user_id int, address string, date_saved timestamp, is_deleted boolean, deleted_at timestamp, "
        "custom_name string, remarks string, rent_price int",
    )
    properties = spark.createDataFrame(
        [(2, "1 Elm", None, None), (1, "1 ELM", None, None)],
        "property_id int, address string, bus_stops string, groceries string",
    )
    listed = saved.home_of(saved.active(state), properties)
    cards = {r["user_id"]: r for r in saved.saved_cards(listed, properties.drop("address")).collect()}
    assert set(cards) == {1, 2}
    assert cards[1]["subtitle"] is None and cards[1]["rent"] is None and cards[1]["property_id"] == 1
    assert cards[1]["display_name"] == "1 ELM" and cards[1]["saved_on"] == "Saved on Jan 1, 2024"
    assert cards[2]["rent"] == "900/month" and cards[2]["display_name"] == "Home"
    requests = spark.createDataFrame(
        [(1, 1, "1 elm"), (2, 3, "1 ELM"), (3, 9, "x"), (4, 1, ""), (5, 1, None)],
        "request_id int, user_id int, address string",
    )
    for rows_per_task in (100, 1):
        rows = saved.status_checks(requests, state, rows_per_task).orderBy("request_id").collect()
        assert [r["is_saved"] for r in rows] == [True, False, False, None, None]
        assert rows[3]["error"] == rows[4]["error"] == "Address required"
