"""Byte-level BPE: encoding by a lazily determinised transducer, streaming decoding.

The encoding of a text's prefix ends in one token, and a sequence of tokens is an
encoding exactly when every token encodes to itself and every two neighbours, joined,
encode to just these two. That makes the merges a transducer over bytes: a branch is
(last token, place in the trie of tokens), a byte moves all branches on, and of the
branches that complete a token only the one that fits its left neighbour lives on. Sets
of branches are the states of a deterministic transducer, which is built while it is used
and emptied when it passes a fixed number of states. Branches that no token can complete
any more are dropped, and last tokens that allow the same tokens at a place are one, so
texts of many different words still meet the same states.

Each byte sends the token that would end there. Which of them stay is certain where a
single branch is left; there the tokens are read back and emitted, so what is held back
is bounded by the stretch between two such places.

Text is split by a pattern first and every match is encoded separately; a match that is
itself a token becomes that token. Null counts as the empty text, which has no tokens.
Nothing is shuffled: every row is encoded where it is read.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator
from itertools import chain, islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stoopwise.llm.common import free_name, give_back, ship

NONE = -1
# What a Python process remembers at most. Of pieces there may be two such generations:
# a full one becomes the old one, and pieces met again move on to the new one.
MOST_STATES = 200_000
MOST_PAIRS = 600_000
MOST_PIECES = 200_000
MOST_CHUNKS = 100_000
# Last tokens are compared by the tokens they allow where at most so many are left.
MOST_BELOW = 4
# Bytes of a piece between two looks at whether its tokens are certain.
HELD_BACK = 512
# Pieces of a text that are held at one time.
PIECES_AT_ONCE = 100_000
LONG_TEXT = 1_000_000
ROWS_AT_ONCE = 128
# Of the bounds above, what the encoder remembers where whole documents go along.
CHECKED_SHARE = 0.5


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int], least: int = 1) -> list[bytes]:
    """The definition: join the neighbours of lowest rank, the leftmost first, until none is left.

    Stops with ``least`` parts.
    """
    parts = [piece[i : i + 1] for i in range(len(piece))]
    never = 1 << 60
    pairs = [ranks.get(piece[i : i + 2], never) for i in range(len(piece) - 1)]
    while len(parts) > least:
        best = min(pairs)
        if best == never:
            break
        i = pairs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], never)
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], never)
    return parts


class Node(dict):
    """A place in the trie: the next bytes, the token that ends here, a few tokens below."""

    __slots__ = ("token", "below")


class State(dict):
    """A deterministic state: what each byte sends and where it leads, as far as met."""

    __slots__ = ("branches",)


class Transducer:
    """Bytes of a piece to token ids; deterministic states appear as they are met."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.size_of = {v: len(k) for k, v in ranks.items()}
        self.root = self.node()
        self.root.below = None
        for word, rank in ranks.items():
            node = self.root
            for byte in word:
                if node.below is not None:
                    node.below.append(rank)
                    if len(node.below) > MOST_BELOW:
                        node.below = None
                there = node.get(byte)
                if there is None:
                    there = node[byte] = self.node()
                node = there
            node.token = rank
        self.halves_of: dict[int, tuple[int, int] | None] = {}
        self.fits_memo: dict[tuple[int, int], bool] = {}
        self.like: dict[tuple[int, int], int | None] = {}
        self.first_like: dict[tuple, int] = {}
        self.forget()

    @staticmethod
    def node() -> Node:
        made = Node()
        made.token = None
        made.below = []
        return made

    def forget(self) -> None:
        """Start over with no transitions."""
        if len(self.fits_memo) + len(self.like) > MOST_PAIRS:
            self.fits_memo.clear()
            self.like.clear()
            self.first_like.clear()
        self.states: dict[tuple, State] = {}
        self.start = self.state([(NONE, self.root)])

    def state(self, branches: list[tuple[int, Node]]) -> State:
        key = tuple((last, id(node)) for last, node in branches)
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State()
            found.branches = branches
        return found

    def stand_in(self, last: int, node: Node) -> int | None:
        """A last token that allows the same tokens below ``node``; None if none is allowed."""
        if node.below is None:
            return last
        key = (last, id(node))
        if key in self.like:
            return self.like[key]
        allowed = tuple(t for t in node.below if self.fits(last, t))
        found = self.first_like.setdefault((id(node), allowed), last) if allowed else None
        self.like[key] = found
        return found

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a byte."""
        if token not in self.halves_of:
            word = self.bytes_of[token]
            parts = merge_by_rank(word, self.ranks, 2)
            whole = len(word) > 1 and len(parts) == 2 and self.ranks.get(parts[0] + parts[1]) == token
            self.halves_of[token] = tuple(self.ranks[x] for x in parts) if whole else None
        return self.halves_of[token]

    def reachable(self, token: int) -> bool:
        """Whether a token encodes to itself."""
        return len(self.bytes_of[token]) == 1 or self.halves(token) is not None

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` can follow ``left``, or start a piece, in an encoding.

        Looks back through the merges that made the two, the last one first: of the
        tokens that stood at the border at any time, no two may have merged before one
        of them went into a larger token of its own side.
        """
        if left == NONE:
            return self.reachable(right)
        key = (left, right)
        found = self.fits_memo.get(key)
        if found is None:
            found = self.fits_memo[key] = self.reachable(right) and self.apart(left, right)
        return found

    def apart(self, a: int, b: int) -> bool:
        until = 1 << 60
        while True:
            joined = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if joined is not None and joined < until:
                return False
            of_a, of_b = self.halves(a), self.halves(b)
            if of_a is None and of_b is None:
                return True
            # Of equal ranks the left one merges first, so the right one is undone first.
            if of_b is None or (of_a is not None and a > b):
                until, a = a, of_a[1]
            else:
                until, b = b + 1, of_b[0]

    def move(self, state: State, byte: int) -> tuple[int, State]:
        """The token that ends with a byte and the state that follows, worked out once."""
        ending, living = None, []
        for last, node in state.branches:
            there = node.get(byte)
            if there is None:
                continue
            if ending is None and there.token is not None and self.fits(last, there.token):
                ending = there.token
            if there and (alike := self.stand_in(last, there)) is not None:
                living.append((alike, there))
        if ending is None:
            raise ValueError("the ranks lack a single byte")
        living.append((ending, self.root))
        found = state[byte] = (ending, self.state(living))
        return found

    def encode(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(self.states) > MOST_STATES:
            self.forget()
        state, out, held = self.start, [], []
        for start in range(0, len(piece), HELD_BACK):
            for byte in piece[start : start + HELD_BACK]:
                step = state.get(byte)
                if step is None:
                    step = self.move(state, byte)
                token, state = step
                held.append(token)
            if len(state.branches) == 1:
                out += self.read_back(held)
                held = []
        return (*out, *self.read_back(held))

    def read_back(self, held: list[int]) -> list[int]:
        """The tokens that lead to the last of ``held``, one token per byte."""
        out, at, size_of = [], len(held), self.size_of
        while at > 0:
            token = held[at - 1]
            out.append(token)
            at -= size_of[token]
        out.reverse()
        return out


class Apart(Exception):
    """White space stands where a text was to be cut."""


class Encoder(dict):
    """Texts to token ids; what was met is remembered, up to a bound.

    A single space between two other characters always starts a match of the pattern, so
    texts are cut there first, and the ids of whole chunks are remembered. A text with
    white space beside a cut goes through the pattern as a whole.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        super().__init__()
        self.machine = Transducer(ranks)
        self.pattern = regex.compile(pattern)
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.old_pieces: dict[str, tuple[int, ...]] = {}

    def bound(self, share: float) -> None:
        """Forget what is more than a share of the usual bounds."""
        if len(self) > share * MOST_CHUNKS:
            self.clear()
        if len(self.pieces) + len(self.old_pieces) > share * MOST_PIECES:
            self.pieces, self.old_pieces = {}, {}
        if len(self.machine.states) > share * MOST_STATES:
            self.machine.forget()

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise Apart
        if len(self) > MOST_CHUNKS:
            self.clear()
        ids = self[chunk] = tuple(self.matches(self.pattern.findall(" " + chunk)))
        return ids

    def matches(self, pieces: list[str]) -> list[int]:
        known, out = self.pieces, []
        for piece in pieces:
            ids = known.get(piece)
            if ids is None:
                if len(known) > MOST_PIECES:
                    self.old_pieces = known
                    known = self.pieces = {}
                ids = self.old_pieces.get(piece)
                if ids is None:
                    ids = self.machine.encode(piece.encode())
                known[piece] = ids
            out += ids
        return out

    def runs(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, in runs of bounded length."""
        if len(text) <= LONG_TEXT:
            try:
                first, *chunks = text.split(" ")
                if first and first[-1].isspace():
                    raise Apart
                ids = self.matches(self.pattern.findall(first))
                ids.extend(chain.from_iterable(map(self.__getitem__, chunks)))
            except Apart:
                ids = self.matches(self.pattern.findall(text))
            yield ids
            return
        found = self.pattern.finditer(text)
        while pieces := [m[0] for m in islice(found, PIECES_AT_ONCE)]:
            yield self.matches(pieces)


class Utf8:
    """Which characters a byte completes: the states are the bytes of a begun character."""

    REPLACEMENT = "�"

    @staticmethod
    def allowed(begun: bytes, byte: int) -> bool:
        """Whether ``byte`` goes on with a character that ``begun`` starts."""
        low, high = 0x80, 0xBF
        if len(begun) == 1:
            low = {0xE0: 0xA0, 0xF0: 0x90}.get(begun[0], low)
            high = {0xED: 0x9F, 0xF4: 0x8F}.get(begun[0], high)
        return low <= byte <= high

    @staticmethod
    def length(first: int) -> int:
        """How long the character is that a byte starts; 0 if none can start so."""
        if first < 0x80:
            return 1
        if 0xC2 <= first <= 0xDF:
            return 2
        if 0xE0 <= first <= 0xEF:
            return 3
        return 4 if 0xF0 <= first <= 0xF4 else 0

    @classmethod
    def feed(cls, begun: bytes, more: bytes) -> tuple[str, bytes]:
        out = []
        for byte in more:
            if begun:
                if cls.allowed(begun, byte):
                    begun += bytes((byte,))
                    if len(begun) == cls.length(begun[0]):
                        out.append(begun.decode())
                        begun = b""
                    continue
                out.append(cls.REPLACEMENT)
                begun = b""
            size = cls.length(byte)
            if size == 1:
                out.append(chr(byte))
            elif size == 0:
                out.append(cls.REPLACEMENT)
            else:
                begun = bytes((byte,))
        return "".join(out), begun


class Decoder:
    """Token ids to text as they come; a step per token and state is worked out once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = {v: k for k, v in ranks.items()}
        # Of tokens that start and end between characters, by id; None for the others.
        self.plain: dict[int, str | None] = {}
        for token, word in self.bytes_of.items():
            text, begun = Utf8.feed(b"", word)
            self.plain[token] = None if begun or Utf8.REPLACEMENT in text else text
        self.steps: dict[tuple[bytes, int], tuple[str, bytes]] = {}

    def feed(self, ids: list[int], begun: bytes = b"") -> tuple[str, bytes]:
        """The text that ids complete after the bytes ``begun``, and the bytes left over."""
        out = []
        for token in ids:
            text = None if begun else self.plain[token]
            if text is None:
                step = self.steps.get((begun, token))
                if step is None:
                    step = Utf8.feed(begun, self.bytes_of[token])
                    self.steps[begun, token] = step
                text, begun = step
            out.append(text)
        return "".join(out), begun

    def text(self, ids: list[int]) -> str:
        text, begun = self.feed(ids)
        return text + (Utf8.REPLACEMENT if begun else "")


class Vocabulary:
    """The bytes of a rank file and a pattern, sent to the executors once.

    The file is read by the driver, so executors need no path. Its size does not grow
    with the data.
    """

    _made: dict[str, tuple[Encoder, Decoder]] = {}

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        ship(spark)
        ranks = read_ranks(path)
        self.pattern = pattern
        self.name = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
        self.sent = spark.sparkContext.broadcast(ranks)

    def coders(self) -> tuple[Encoder, Decoder]:
        """Of this Python process; tasks that it runs one after another share them."""
        if self.name not in self._made:
            self._made.clear()
            ranks = self.sent.value
            self._made[self.name] = (Encoder(ranks, self.pattern), Decoder(ranks))
            # What is remembered is bounded and long-lived: walk it seldom, the trie never.
            gc.freeze()
            gc.set_threshold(200_000, 20, 50)
        return self._made[self.name]

    def forget(self) -> None:
        """Free what this Python process remembers, for stages that come after."""
        self._made.clear()
        gc.unfreeze()
        give_back()


def _kept(docs: DataFrame, *added: T.StructField) -> T.StructType:
    return T.StructType([*docs.schema.fields, *added])


def _append(batch, arrays, schema):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.RecordBatch.from_arrays([*batch.columns, *arrays], schema=to_arrow_schema(schema))


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """``docs`` with the columns ``ids`` (array of int) and ``n_tokens``.

    Columns of these names in ``docs`` get an underscore in front of the new ones.
    """
    ids_name, count_name = free_name(docs, "ids"), free_name(docs, "n_tokens")
    schema = _kept(
        docs,
        T.StructField(ids_name, T.ArrayType(T.IntegerType(), False), False),
        T.StructField(count_name, T.LongType(), False),
    )
    at = docs.columns.index(text)

    def run(batches):
        import pyarrow as pa

        encoder, _ = vocabulary.coders()
        for batch in batches:
            found = [
                list(chain.from_iterable(encoder.runs(t))) if t else []
                for t in batch.column(at).to_pylist()
            ]
            kind = pa.list_(pa.field("element", pa.int32(), nullable=False))
            yield _append(batch, [pa.array(found, kind), pa.array(map(len, found), pa.int64())], schema)

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """``tokens`` with the column ``decoded``: the text of ``ids``; null ids are empty.

    Bytes that are no UTF-8 become U+FFFD, one for each begun character.
    """
    schema = _kept(tokens, T.StructField(free_name(tokens, "decoded"), T.StringType(), False))
    at = tokens.columns.index(ids)

    def run(batches):
        import pyarrow as pa

        _, decoder = vocabulary.coders()
        for batch in batches:
            texts = [decoder.text(x or []) for x in batch.column(at).to_pylist()]
            yield _append(batch, [pa.array(texts, pa.string())], schema)

    return tokens.mapInArrow(run, schema)


def checked(tokens: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "text") -> DataFrame:
    """``tokens`` with ``restored`` in place of the text: whether the decoded ids are the text."""
    kept = [c for c in tokens.columns if c != text]
    name = free_name(tokens, "restored")
    ids_at, text_at = tokens.columns.index(ids), tokens.columns.index(text)
    kept_at = [tokens.columns.index(c) for c in kept]
    schema = T.StructType([*(tokens.schema[c] for c in kept), T.StructField(name, T.BooleanType(), False)])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        _, decoder = vocabulary.coders()
        target = to_arrow_schema(schema)
        for batch in batches:
            pairs = zip(batch.column(ids_at).to_pylist(), batch.column(text_at).to_pylist(), strict=True)
            same = [decoder.text(x or []) == (t or "") for x, t in pairs]
            columns = [batch.column(i) for i in kept_at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(same, pa.bool_())], schema=target)

    return tokens.mapInArrow(run, schema)


def encode_checked(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """``docs`` with ids, n_tokens and ``restored`` in place of the text, a few rows at a time.

    One Python process encodes and decodes, and holds the ids of ``ROWS_AT_ONCE`` texts.
    """
    ship(docs.sparkSession)
    at = docs.columns.index(text)
    kept = [i for i in range(len(docs.columns)) if i != at]
    names = [docs.columns[i] for i in kept]
    added = [free_name(docs, n) for n in ("ids", "n_tokens", "restored")]
    kinds = ("array<int>", "bigint", "boolean")
    nulls = [F.lit(None).cast(k).alias(n) for n, k in zip(added, kinds, strict=True)]
    schema = docs.select(*[F.col(f"`{n}`") for n in names], *nulls).schema

    def run(batches):
        import pyarrow as pa

        encoder, decoder = vocabulary.coders()
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                texts = batch.column(at).to_pylist()
                found = [list(chain.from_iterable(encoder.runs(t))) if t else [] for t in texts]
                same = [decoder.text(ids) == (t or "") for ids, t in zip(found, texts, strict=True)]
                columns = [pa.array(found, pa.list_(pa.int32())), pa.array(map(len, found), pa.int64()), pa.array(same)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *columns], names=[*names, *added])
                encoder.bound(CHECKED_SHARE)
        del encoder, decoder
        vocabulary.forget()

    return docs.mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary: Vocabulary, id: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: A002
    """Per row the id, ``n_tokens``, and digests of the ids and of the text decoded from them.

    Ids pass from the encoder to the streaming decoder in runs, and only digests leave
    the task, so a text of any length takes bounded memory beside itself.
    """
    rows = docs.select(F.col(id), F.col(text).alias("_text"))
    schema = T.StructType(
        [
            rows.schema[0],
            T.StructField("n_tokens", T.LongType(), False),
            T.StructField("ids_sha256", T.StringType(), False),
            T.StructField("decoded_sha256", T.StringType(), False),
        ]
    )

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        encoder, decoder = vocabulary.coders()
        written = {i: str(i) for i in decoder.plain}
        target = to_arrow_schema(schema)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for t in batch.column(1).to_pylist():
                ids_hash, text_hash, n, begun = hashlib.sha256(), hashlib.sha256(), 0, b""
                for ids in encoder.runs(t or ""):
                    if not ids:
                        continue
                    line = ",".join(map(written.__getitem__, ids))
                    ids_hash.update(("," + line if n else line).encode())
                    n += len(ids)
                    out, begun = decoder.feed(ids, begun)
                    text_hash.update(out.encode())
                text_hash.update(begun)
                counts.append(n)
                of_ids.append(ids_hash.hexdigest())
                of_text.append(text_hash.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)],
                schema=target,
            )

    return rows.mapInArrow(run, schema)
