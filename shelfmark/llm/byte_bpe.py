"""Byte-level BPE as a lazily built transducer, and streaming decode through a UTF-8 machine."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import id_and_text

#: What a worker keeps before it starts afresh; this bounds memory and costs time only.
KEPT_PAIRS, KEPT_PIECES = 1_000_000, 250_000
#: Bytes of one piece that are held before certain tokens are emitted.
HELD_BYTES = 4096
#: Texts longer than this are split piece by piece instead of into one list.
LONG_TEXT = 1_000_000


class Ranks:
    """The vocabulary of a rank file: token bytes by id, ids by bytes, and all prefixes of tokens."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.bytes = {i: token for token, i in self.rank.items()}
        self.prefixes = {token[:k] for token in self.rank for k in range(len(token) + 1)}

        self.halves: dict[int, tuple[int, int] | None] = {}

    def merge(self, piece: bytes, parts_left: int = 1) -> list[int]:
        """Plain merging, lowest rank first, down to ``parts_left`` parts; only ever run on one token."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > parts_left:
            rank, at = min((self.rank.get(parts[i] + parts[i + 1], 1 << 31), i) for i in range(len(parts) - 1))
            if rank == 1 << 31:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[part] for part in parts]

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one last; None for a byte or a token merging never makes."""
        if token not in self.halves:
            data = self.bytes[token]
            made = self.merge(data, 2) if len(data) > 1 else []
            self.halves[token] = (
                (made[0], made[1]) if len(made) == 2 and self.rank[data] == token and self.merge(data) == [token] else None
            )
        return self.halves[token]


class Transducer:
    """Merges compiled, as texts need them, into a transducer over bytes.

    BPE of a text is the one split into tokens whose neighbours are each left alone by merging,
    so the last token of every prefix follows from the last tokens of shorter prefixes. A state
    is the longest end of the input that begins some token; states and transitions are made
    deterministic when a text first needs them, and there are no more than prefixes of tokens.
    A state knows the tokens that may end there, longest first. The output remembers the last
    token of the latest prefixes; tokens that every position still open has behind it are
    certain and are emitted, so the lookahead is less than the longest token.
    """

    def __init__(self, ranks: Ranks) -> None:
        self.ranks = ranks
        self.names, self.ids = [b""], {b"": 0}
        self.ending: list[list[tuple[int, int]]] = [[]]
        self.steps: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}

    def step(self, state: int, byte: int) -> int:
        """Make one transition: drop bytes from the front until the rest begins a token."""
        grown = self.names[state] + bytes([byte])
        while grown not in self.ranks.prefixes:
            grown = grown[1:]
        if not grown:
            raise ValueError("the rank file lacks a byte, so this text has no encoding")
        to = self.ids.get(grown)
        if to is None:
            to = self.ids[grown] = len(self.names)
            self.names.append(grown)
            ends = (self.ranks.rank.get(grown[k:]) for k in range(len(grown)))
            self.ending.append([
                (len(self.ranks.bytes[token]), token) for token in ends if token is not None and self.reachable(token)
            ])
        self.steps[state << 8 | byte] = to
        return to

    def reachable(self, token: int) -> bool:
        """Whether merging the bytes of a token gives that token."""
        return len(self.ranks.bytes[token]) == 1 or self.ranks.split(token) is not None

    def left_alone(self, left: int, right: int) -> bool:
        """Whether merging leaves these two tokens as they are; -1 is the start of the piece.

        Undoing the merges of both sides from the highest rank down, the pair is left alone if
        no token across the border would have been made before its parts were used.
        """
        if len(self.pairs) > KEPT_PAIRS:
            self.pairs.clear()
        self.pairs[left << 32 | right] = alone = left < 0 or not self.crosses(left, right)
        return alone

    def crosses(self, left: int, right: int) -> bool:
        rank, data, split = self.ranks.rank, self.ranks.bytes, self.ranks.split
        used_at = 1 << 31  # the rank at which the two parts facing each other were used up
        while True:
            across = rank.get(data[left] + data[right])
            if across is not None and across < used_at:
                return True
            halves_left, halves_right = split(left), split(right)
            if halves_left and (not halves_right or left > right):
                used_at, left = left, halves_left[1]
            elif halves_right:
                # Among equal ranks the leftmost goes first, so the border wins against the right side.
                used_at, right = right + 1, halves_right[0]
            else:
                return False

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one piece of text."""
        whole = self.ranks.rank.get(piece)
        if whole is not None:
            return [whole]
        ids: list[int] = []
        state, last, sizes, held = 0, [-1], [0], HELD_BYTES
        steps, ending, pairs = self.steps, self.ending, self.pairs
        for byte in piece:
            state = steps.get(state << 8 | byte) or self.step(state, byte)
            for size, token in ending[state]:
                left = last[-size]
                alone = pairs.get(left << 32 | token)
                if alone or (alone is None and self.left_alone(left, token)):
                    break
            else:
                raise ValueError("two ranks contradict each other")
            last.append(token)
            sizes.append(size)
            if len(last) > held:
                last, sizes = self.emit(len(self.names[state]), last, sizes, ids)
                held = HELD_BYTES + 2 * len(last)
        return ids + self.path(len(last) - 1, 0, last, sizes)

    @staticmethod
    def path(end: int, begin: int, last: list[int], sizes: list[int]) -> list[int]:
        """Tokens from one position to a later one, following the last tokens back."""
        tokens = []
        while end > begin:
            tokens.append(last[end])
            end -= sizes[end]
        return tokens[::-1]

    def emit(self, open_bytes: int, last: list[int], sizes: list[int], ids: list[int]) -> tuple[list[int], list[int]]:
        """Emit what all positions a token may still begin at have behind them, and forget it."""
        reached = set(range(len(last) - 1 - open_bytes, len(last)))
        while len(reached) > 1:
            farthest = max(reached)
            reached.remove(farthest)
            reached.add(farthest - sizes[farthest])
        sure = reached.pop()
        ids += self.path(sure, 0, last, sizes)
        return last[sure:], [0, *sizes[sure + 1 :]]


class Pieces(dict):
    """Ids of pieces met before, as little-endian 32-bit numbers."""

    def __init__(self, transducer: Transducer) -> None:
        super().__init__()
        self.transducer = transducer

    def __missing__(self, piece: str) -> bytes:
        ids = b"".join(i.to_bytes(4, "little") for i in self.transducer.encode(piece.encode()))
        if len(self) >= KEPT_PIECES:
            self.clear()
        if len(piece) < 256:
            self[piece] = ids
        return ids


class Utf8Machine:
    """Incremental UTF-8: a state is the unfinished bytes, a step takes a token and gives finished text.

    Bytes that no character can begin or go on with become U+FFFD, one for each longest
    piece that could have begun one.
    """

    # Lead bytes with the range of their second byte and the number of bytes.
    LEADS = [
        (0xC2, 0xDF, 0x80, 0xBF, 2), (0xE0, 0xE0, 0xA0, 0xBF, 3), (0xE1, 0xEC, 0x80, 0xBF, 3), (0xED, 0xED, 0x80, 0x9F, 3),
        (0xEE, 0xEF, 0x80, 0xBF, 3), (0xF0, 0xF0, 0x90, 0xBF, 4), (0xF1, 0xF3, 0x80, 0xBF, 4), (0xF4, 0xF4, 0x80, 0x8F, 4),
    ]

    def __init__(self, tokens: dict[int, bytes]) -> None:
        self.tokens = tokens
        self.lead = {b: (low, high, size) for first, last, low, high, size in self.LEADS for b in range(first, last + 1)}
        self.steps: dict[bytes, dict[int, tuple[bytes, str]]] = {}

    def feed(self, pending: bytes, data: bytes) -> tuple[bytes, str]:
        """The unfinished bytes and the finished text after ``data``."""
        done: list[str] = []
        for b in data:
            if pending:
                low, high, size = self.lead[pending[0]]
                if (low if len(pending) == 1 else 0x80) <= b <= (high if len(pending) == 1 else 0xBF):
                    pending += bytes([b])
                    if len(pending) == size:
                        done.append(pending.decode())
                        pending = b""
                    continue
                done.append("�")
                pending = b""
            if b < 0x80:
                done.append(chr(b))
            elif b in self.lead:
                pending = bytes([b])
            else:
                done.append("�")
        return pending, "".join(done)

    def decode(self, ids: Iterable[int]) -> str:
        """Text of a stream of ids; an unfinished character at its end becomes U+FFFD."""
        text: list[str] = []
        pending, steps = b"", self.steps.setdefault(b"", {})
        for i in ids:
            step = steps.get(i)
            if step is None:
                step = steps[i] = self.feed(pending, self.tokens[i])
            text.append(step[1])
            if step[0] is not pending and step[0] != pending:
                steps = self.steps.setdefault(step[0], {})
            pending = step[0]
        return "".join(text) + ("�" if pending else "")


@functools.lru_cache(maxsize=2)
def load(path: str) -> Ranks:
    return Ranks(path)


@functools.lru_cache(maxsize=1)
def compiled(path: str) -> Pieces:
    """One transducer per worker process, so that later tasks find what earlier ones compiled."""
    return Pieces(Transducer(load(path)))


def encode_text(text: str, pieces: Pieces, split: regex.Pattern) -> bytes:
    if len(text) < LONG_TEXT:
        return b"".join(map(pieces.__getitem__, split.findall(text)))
    return b"".join(pieces[match[0]] for match in split.finditer(text))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ``ids`` (little-endian unsigned 32-bit, binary) of every whole text.

    ``path`` names the rank file, which every worker can open; ``pattern`` splits a text into
    pieces that are encoded separately. A null or empty text has no ids. Rows are encoded one by
    one, so repeated rows repeat; columns other than doc_id and text are not read. A worker keeps
    a bounded number of states, token pairs and pieces.
    """
    return _run(docs, path, pattern).drop("text")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Like ``encode``, with the ``text`` decoded from the ids, in one pass through the workers."""
    return _run(docs, path, pattern)


def _run(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = compiled(path)
        machine = Utf8Machine(load(path).bytes)
        split = regex.compile(pattern)
        for batch in batches:
            ids = [encode_text(text, pieces, split) for text in batch.column("text").to_pylist()]
            yield _rows(batch.column("doc_id"), pa.array(ids, pa.binary()), machine)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return id_and_text(docs).mapInArrow(run, f"doc_id {kind}, ids binary, text string")


def _rows(doc_ids: pa.Array, ids: pa.Array, machine: Utf8Machine) -> pa.RecordBatch:
    texts = [machine.decode(memoryview(row).cast("I")) if row else "" for row in ids.to_pylist()]
    return pa.RecordBatch.from_arrays([doc_ids, ids, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ``ids`` and the ``text`` they stand for; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Utf8Machine(load(path).bytes)
        for batch in batches:
            yield _rows(batch.column("doc_id"), batch.column("ids"), machine)

    kind = encoded.schema["doc_id"].dataType.simpleString()
    given = encoded.select("doc_id", F.coalesce("ids", F.lit(b"")).alias("ids"))
    return given.mapInArrow(run, f"doc_id {kind}, ids binary, text string")


def digest(decoded: DataFrame, *more: str) -> DataFrame:
    """Counts and hashes of ``decode`` rows; ``more`` names columns to keep beside them."""
    return decoded.select(
        "doc_id", *more, (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
