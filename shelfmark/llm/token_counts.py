"""Token counts of a word-level BPE vocabulary, with a shortcut for whole-token words."""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import id_and_text

# How the vocabulary file splits normalised text, and Unicode white space.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
SPACES = regex.compile(r"\p{White_Space}+")
WORD_END = "</w>"

#: Words whose counts a worker keeps; beyond it the worker starts afresh, which costs time only.
KEPT_WORDS = 500_000
#: Pieces that are held at once of one very long text.
PIECES_AT_ONCE = 200_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable bytes stand for themselves."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Apply merges, lowest rank first and leftmost among equals, until none applies.

    Open merges wait in a heap and symbols are linked to their neighbours, so that a word of n
    symbols takes about n log n steps.
    """
    parts: list[str | None] = list(symbols)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    waiting = [(ranks[pair], i, pair) for i, pair in enumerate(itertools.pairwise(symbols)) if pair in ranks]
    heapq.heapify(waiting)
    while waiting:
        _, at, pair = heapq.heappop(waiting)
        right = after[at]
        if right == len(parts) or (parts[at], parts[right]) != pair:
            continue  # a part of it has gone into another merge
        parts[at], parts[right] = pair[0] + pair[1], None
        after[at] = after[right]
        if after[at] < len(parts):
            before[after[at]] = at
        for left in (before[at], at):
            if left >= 0 and after[left] < len(parts):
                now = (parts[left], parts[after[left]])
                if now in ranks:
                    heapq.heappush(waiting, (ranks[now], left, now))
    return [part for part in parts if part is not None]


class WordTokens:
    """Merge ranks, special strings, and the words proven to encode alone as one token."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        self.ranks = {tuple(pair): i for i, pair in enumerate(stated["model"]["merges"])}
        self.special = [token["content"] for token in stated["added_tokens"]]
        self.letters = byte_letters()
        byte_of = {letter: b for b, letter in enumerate(self.letters)}
        self.whole: dict[str, int] = {}
        for token in stated["model"]["vocab"]:
            body = token.removesuffix(WORD_END)
            if body == token or not body or merged(self.symbols(body), self.ranks) != [token]:
                continue
            try:
                self.whole[bytes(byte_of[c] for c in body).decode("utf-8")] = 1
            except (KeyError, UnicodeDecodeError):
                continue  # not a piece any text can hold

    @staticmethod
    def symbols(body: str) -> list[str]:
        return [*body[:-1], body[-1] + WORD_END]

    def merge_count(self, piece: str) -> int:
        return len(merged(self.symbols("".join(self.letters[b] for b in piece.encode())), self.ranks))


class Counts(dict):
    """Tokens per piece: proven words are there from the start, the rest are merged when first met."""

    def __init__(self, tokens: WordTokens) -> None:
        super().__init__(tokens.whole)
        self.tokens = tokens

    def __missing__(self, piece: str) -> int:
        if len(self) > KEPT_WORDS + len(self.tokens.whole):
            self.clear()
            self.update(self.tokens.whole)
        self[piece] = count = self.tokens.merge_count(piece)
        return count


def lower(text: str) -> str:
    """Lower case letter by letter: a final sigma gets no form of its own."""
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


def count_tokens(text: str, counts: Counts, special: regex.Pattern) -> int:
    total = 0
    for k, part in enumerate(special.split(text)):
        if k % 2:
            total += 1
            continue
        normal = lower(SPACES.sub(" ", unicodedata.normalize("NFC", part)))
        if len(normal) < 4 * PIECES_AT_ONCE:
            total += sum(map(counts.__getitem__, PIECES.findall(normal)))
        else:
            total += sum(counts[match[0]] for match in PIECES.finditer(normal))
    return total


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordTokens:
    return WordTokens(path)


def token_counts(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of every whole text.

    The words that are one token are proven once, on the driver, by running the merges over
    every vocabulary string; they travel with the ranks (a few MB, fixed by the vocabulary).
    A null or empty text has 0 bytes and 0 tokens. Rows are counted one by one, so repeated
    rows repeat; columns other than doc_id and text are not read.
    """
    tokens = docs.sparkSession.sparkContext.broadcast(load(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(tokens.value)  # per task: a broadcast value belongs to one job
        special = regex.compile("(" + "|".join(map(regex.escape, tokens.value.special)) + ")")
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"),
                 pa.array([count_tokens(text, counts, special) for text in texts], pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    given = id_and_text(docs).select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = given.mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
