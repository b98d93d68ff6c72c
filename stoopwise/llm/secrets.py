"""Secret scans with a trigram inverted index.

Every rule's regular expression gives a Boolean query over trigrams. The rows of a record
batch are a segment of the index: its postings are one set of row numbers per trigram that
some query names, a query is answered by intersecting and joining postings, and only the
candidates are verified with the expression itself. Rules without a required trigram are
run on every text. Segments are built where the rows are read, so nothing is shuffled and
the postings of a common trigram never come together in one task.

The base kinds are found whatever the other rules find; the others add spans. Offsets count
code points, ends are exclusive. A null text counts as empty.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoopwise.llm.common import ship, text_of
from stoopwise.llm.trigrams import Query, trigram_query, trigrams_of


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and not overlapping, whose group is long enough."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# Fixed values of the contract.
BASE = (
    Rule(
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=12,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    Rule("hex", r"[0-9a-f]+", least=16),
)
# Formats that issuers publish.
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY(?: BLOCK)?-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("url_password", r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@[A-Za-z0-9.-]+"),
)


class Segment:
    """An inverted index of a few texts: bits of rows per trigram."""

    def __init__(self, texts: list[bytes], codes: np.ndarray):
        """``codes`` are the trigrams to index, as sorted numbers."""
        self.rows = len(texts)
        self.codes = codes
        self.postings = np.zeros((len(codes), self.rows), bool)
        if not len(codes):
            return
        wanted = np.zeros(1 << 24, bool)
        wanted[codes] = True
        for row, text in enumerate(texts):
            data = np.frombuffer(text, np.uint8).astype(np.uint32)
            if len(data) < 3:
                continue
            grams = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
            found = grams[wanted[grams]]
            if len(found):
                self.postings[np.searchsorted(codes, np.unique(found)), row] = True

    def answer(self, query: Query) -> np.ndarray:
        """Which rows can match."""
        if query is True:
            return np.ones(self.rows, bool)
        if isinstance(query, bytes):
            return self.postings[np.searchsorted(self.codes, code_of(query))]
        parts = [self.answer(part) for part in query[1]]
        return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)


def code_of(trigram: bytes) -> int:
    return trigram[0] << 16 | trigram[1] << 8 | trigram[2]


class Scanner:
    """Rules with their queries and compiled expressions."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.compiled = [re.compile(r.pattern, re.ASCII) for r in rules]
        named = set().union(*(trigrams_of(q) for q in self.queries))
        self.codes = np.array(sorted(map(code_of, named)), np.int64)

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Per text its spans as (start, number of the rule, end), in that order."""
        folded = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        segment = Segment(folded, self.codes)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for number, (rule, query, expression) in enumerate(zip(self.rules, self.queries, self.compiled, strict=True)):
            for row in np.flatnonzero(segment.answer(query)).tolist():
                for m in expression.finditer(texts[row]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[row].append((m.start(), number, m.end()))
        for spans in out:
            spans.sort()
        return out


# Texts of a segment; also what a task holds of them in two forms at once.
SEGMENT_ROWS = 512


def scanned(docs: DataFrame, id: str = "doc_id", text: str = "text", more: tuple[Rule, ...] = MORE) -> DataFrame:  # noqa: A002
    """Per row the id and ``spans``: kind, start and end of every secret, by start."""
    ship(docs.sparkSession)
    rules = BASE + more

    def run(batches):
        import pyarrow as pa

        scanner = Scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for whole in batches:
            for start in range(0, whole.num_rows, SEGMENT_ROWS):
                batch = whole.slice(start, SEGMENT_ROWS)
                found = scanner.scan(batch.column(1).to_pylist())
                spans = [[{"kind": rules[n].kind, "start": a, "end": b} for a, n, b in s] for s in found]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["_id", "spans"])

    id_kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("_id"), text_of(text).alias("_text"))
    schema = f"_id {id_kind}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id)


def redacted(docs: DataFrame, text: str = "text", more: tuple[Rule, ...] = MORE, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret of the text replaced by a mark; overlapping spans are one."""
    ship(docs.sparkSession)
    at = docs.columns.index(text)
    names = docs.columns
    rules = BASE + more

    def clean(value: str, spans: list[tuple[int, int, int]]) -> str:
        parts, done = [], 0
        for start, _, end in spans:
            if start >= done:
                parts += [value[done:start], mark]
            done = max(done, end)
        return "".join([*parts, value[done:]])

    def run(batches):
        import pyarrow as pa

        scanner = Scanner(rules)
        for whole in batches:
            for start in range(0, whole.num_rows, SEGMENT_ROWS):
                batch = whole.slice(start, SEGMENT_ROWS)
                texts = batch.column(at).to_pylist()
                found = scanner.scan([t or "" for t in texts])
                new = [None if t is None else clean(t, s) for t, s in zip(texts, found, strict=True)]
                columns = [pa.array(new, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, digest of the base spans and all spans as text, per row."""

    def line(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in BASE]))
    kinds = {r.kind: of(r.kind).alias(f"n_{r.kind}") for r in BASE}
    rest = [c for c in found.columns if c != "spans"]
    return found.select(
        *rest, *kinds.values(), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans")
    )
