"""Which trigrams a regular expression needs: a Boolean query derived from its syntax.

The query is a nest of ("and", parts), ("or", parts), a trigram as bytes, or True where
nothing can be required. Text and pattern are compared in ASCII lower case, so a query holds
for either case; characters beyond ASCII count by their UTF-8 bytes.
"""

from __future__ import annotations

import re
from re import _parser as parser  # type: ignore[attr-defined]

# Alternatives of what a sub-pattern matches exactly are kept up to this number.
MOST_STRINGS = 32
MOST_CLASS = 8

Query = object


def _both(parts: list) -> Query:
    flat: list = []
    for part in parts:
        if part is True:
            continue
        for x in part[1] if isinstance(part, tuple) and part[0] == "and" else [part]:
            if x not in flat:
                flat.append(x)
    if not flat:
        return True
    return flat[0] if len(flat) == 1 else ("and", flat)


def _either(parts: list) -> Query:
    flat: list = []
    for part in parts:
        if part is True:
            return True
        if part not in flat:
            flat.append(part)
    return flat[0] if len(flat) == 1 else ("or", flat)


def _of_string(word: bytes) -> Query:
    return _both([word[i : i + 3] for i in range(len(word) - 2)])


def _fold(char: int) -> bytes:
    return chr(char).encode().lower() if char < 0x110000 else b""


class _Seen:
    """What is known of a part of the pattern: all it can match, or a query for it."""

    def __init__(self, exact: list[bytes] | None, query: Query = True):
        self.exact, self.query = exact, query

    def required(self) -> Query:
        if self.exact is None:
            return self.query
        return _both([self.query, _either([_of_string(w) for w in self.exact])]) if self.exact else self.query


def _joined(items: list[_Seen]) -> _Seen:
    """Parts one after another: exact strings grow until they become too many."""
    queries, run, whole = [], [b""], True
    for item in items:
        if item.exact is not None and len(run) * len(item.exact) <= MOST_STRINGS:
            run = sorted({a + b for a in run for b in item.exact})
            continue
        whole = False
        queries.append(_either([_of_string(w) for w in run]))
        if item.exact is not None:
            run = item.exact
        else:
            queries.append(item.query)
            run = [b""]
    if whole:
        return _Seen(run)
    queries.append(_either([_of_string(w) for w in run]))
    return _Seen(None, _both(queries))


def _class(items) -> _Seen:
    chars: set[bytes] = set()
    for kind, value in items:
        if str(kind) == "LITERAL":
            chars.add(_fold(value))
        elif str(kind) == "RANGE" and value[1] - value[0] < 64:
            chars.update(_fold(c) for c in range(value[0], value[1] + 1))
        else:
            return _Seen(None)
        if len(chars) > MOST_CLASS:
            return _Seen(None)
    return _Seen(sorted(chars))


def _part(kind: str, value) -> _Seen:
    if kind == "LITERAL":
        return _Seen([_fold(value)])
    if kind == "IN":
        return _class(value)
    if kind == "SUBPATTERN":
        return _sequence(value[3])
    if kind == "ATOMIC_GROUP":
        return _sequence(value)
    if kind == "BRANCH":
        ways = [_sequence(way) for way in value[1]]
        if all(w.exact is not None for w in ways) and sum(len(w.exact) for w in ways) <= MOST_STRINGS:
            return _Seen(sorted({s for w in ways for s in w.exact}))
        return _Seen(None, _either([w.required() for w in ways]))
    if kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, inner = value
        found = _sequence(inner)
        if least == 0:
            if most == 1 and found.exact is not None and len(found.exact) < MOST_STRINGS:
                return _Seen(sorted({b"", *found.exact}))
            return _Seen(None)
        if least == most and found.exact is not None and len(found.exact) == 1:
            return _Seen([found.exact[0] * min(least, 64)] if least <= 64 else None, found.required())
        copies = _joined([found] * min(least, 3))
        return _Seen(None, copies.required())
    if kind in ("AT", "ASSERT", "ASSERT_NOT"):
        return _Seen([b""])
    return _Seen(None)


def _sequence(items) -> _Seen:
    return _joined([_part(str(kind), value) for kind, value in items])


def trigram_query(pattern: str) -> Query:
    """The query for all texts the pattern can match in; True if it needs no trigram."""
    return _sequence(parser.parse(pattern, re.ASCII)).required()


def trigrams_of(query: Query) -> set[bytes]:
    if query is True:
        return set()
    if isinstance(query, bytes):
        return {query}
    return set().union(*(trigrams_of(part) for part in query[1]))
