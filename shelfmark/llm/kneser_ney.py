"""Interpolated modified Kneser-Ney word model: counted in Spark, kept as sorted hash arrays, scored by memory map.

The model has order 2. Higher orders need about as much disk again for each order; see README.
"""

from __future__ import annotations

import functools
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import held_out, id_and_text, mixed, text_bytes, word_hashes
from shelfmark.session import fresh_dir

# Words are what stands between blanks; A-Z count as lower case. 0 is kept for blanks.
TOKEN_BYTES = np.arange(256, dtype=np.uint8)
TOKEN_BYTES[0] = 0xFF
TOKEN_BYTES[[0x20, *range(0x09, 0x0E)]] = 0
TOKEN_BYTES[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)

BEGIN, END = (mixed(np.array([k], np.uint64))[0] for k in (0xB, 0xE))
#: Entries that a task gathers before it sends their sums on.
GATHERED = 4_000_000
WORD_COLUMNS = ["count", "one", "two", "before", "more"]


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts with their ends, the token before each, and where each text begins."""
    words, first = word_hashes(*text_bytes(column), TOKEN_BYTES)
    texts = np.arange(len(column))
    tokens = np.empty(len(words) + len(column), np.uint64)
    tokens[np.arange(len(words)) + np.repeat(texts, np.diff(first))] = words
    tokens[first[1:] + texts] = END
    begins = first[:-1] + texts
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[begins] = BEGIN
    return tokens, before, begins


def pair_keys(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(mixed(before + np.uint64(0x9E3779B97F4A7C15)) + tokens)


def summed(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sums of the columns for each distinct key, keys ascending."""
    if not len(keys):
        return keys, columns
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], [np.add.reduceat(column[order], starts) for column in columns]


@dataclass(frozen=True)
class Hashed:
    """Where the sorted arrays lie: one file for each range of key hashes (by their highest bits)."""

    bits: int
    files: dict[int, str]
    kinds: tuple[str, ...]

    def look_up(self, keys: np.ndarray) -> list[np.ndarray]:
        """Values of the keys, which are distinct and ascending; 0 for keys that are not there."""
        out = [np.zeros(len(keys), kind) for kind in self.kinds]
        shards = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        edges = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]])) if len(keys) else []
        for low, high in zip(edges, [*edges[1:], len(keys)]):
            path = self.files.get(int(shards[low]))
            if path is None:
                continue
            known, *values = opened(path, self.kinds)
            part = keys[low:high]
            at = np.searchsorted(known, part)
            at[at == len(known)] = 0
            met = known[at] == part
            for column, value in zip(out, values):
                column[low:high][met] = value[at[met]]
        return out


@functools.lru_cache(maxsize=4096)
def opened(path: str, kinds: tuple[str, ...]) -> list[np.ndarray]:
    """Keys and values of one file: mapped into memory, or read where the folder is no file system path."""
    place = urlparse(path)
    if place.scheme in ("", "file"):
        data: np.ndarray = np.memmap(unquote(place.path), np.uint8, "r")
    else:
        store, inside = fs.FileSystem.from_uri(path)
        with store.open_input_file(inside) as file:
            data = np.frombuffer(file.read(), np.uint8)
    count = int(data[:8].view(np.int64)[0])
    at, arrays = 8, []
    for kind in ("<u8", *kinds):
        size = count * np.dtype(kind).itemsize
        arrays.append(data[at : at + size].view(kind))
        at += size
    return arrays


def write_file(folder: str, shard: int, keys: np.ndarray, values: list[np.ndarray]) -> str:
    """Write one range under a name no other attempt uses; only names that reach the driver count."""
    path = f"{folder}/{shard}-{uuid.uuid4().hex}"
    store, inside = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    store.create_dir(os.path.dirname(inside), recursive=True)
    with store.open_output_stream(inside) as file:
        for array in (np.array([len(keys)], np.int64), keys, *values):
            file.write(np.ascontiguousarray(array).tobytes())
    return path


def _write(sums: DataFrame, label: str, kinds: tuple[str, ...]) -> tuple[Hashed, np.ndarray]:
    """Add up rows (key, then one column per kind), write them by range of keys, and describe the files.

    Besides, the totals of each column and how many entries have 1, 2, 3, 4 and any value, which
    is all the driver gets: one row per range.
    """
    spark = sums.sparkSession
    bits = max(1, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    folder = fresh_dir(spark, label)
    names = sums.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[column.to_numpy(zero_copy_only=False) for column in batch.columns] for batch in batches if batch.num_rows]
        rows = []
        if parts:
            joined = [np.concatenate(column) for column in zip(*parts)]
            keys, values = summed(joined[0].view(np.uint64), joined[1:])
            values = [np.rint(v).astype(kind) for v, kind in zip(values, kinds)]
            shards = (keys >> np.uint64(64 - bits)).astype(np.int64)
            edges = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]]))
            for low, high in zip(edges, [*edges[1:], len(keys)]):
                own = [v[low:high] for v in values]
                path = write_file(folder, int(shards[low]), keys[low:high], own)
                told = [[high - low, int(v.sum(dtype=np.int64)), *(int((v == k).sum()) for k in (1, 2, 3, 4))] for v in own]
                rows.append((int(shards[low]), path, [x for one in told for x in one]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()),
             pa.array([r[2] for r in rows], pa.list_(pa.int64()))],
            ["shard", "path", "told"],
        )

    shard = F.shiftrightunsigned(F.col("key"), 64 - bits)
    found = sums.repartition(shard).select("key", *names).mapInArrow(run, "shard bigint, path string, told array<bigint>").collect()
    told = np.array([row["told"] for row in found], np.int64).sum(axis=0) if found else np.zeros(6 * len(kinds), np.int64)
    return Hashed(bits, {row["shard"]: row["path"] for row in found}, kinds), told.reshape(len(kinds), 6)


def _gathered(rows: Iterator[tuple[np.ndarray, list[np.ndarray]]], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Add up what a task gathers and send it on in parts of bounded size."""

    def sent(held: list) -> Iterator[pa.RecordBatch]:
        keys, values = summed(np.concatenate([h[0] for h in held]), [np.concatenate(c) for c in zip(*[h[1] for h in held])])
        for k in range(0, len(keys), 200_000):
            part = slice(k, k + 200_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[part].view(np.int64)), *[pa.array(v[part], t) for v, t in zip(values, types)]], ["key", *names]
            )

    held, size = [], 0
    for keys, values in rows:
        held.append(summed(keys, values))
        size += len(held[-1][0])
        if size >= GATHERED:
            yield from sent(held)
            held, size = [], 0
    if held:
        yield from sent(held)


@dataclass(frozen=True)
class Model:
    pairs: Hashed
    words: Hashed
    tokens: int
    vocabulary: int
    kinds_of_pairs: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_rest: float

    def token_scores(self, tokens: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Training count and log10 probability, given the token before, of each token."""
        distinct, back = np.unique(np.concatenate([tokens, before]), return_inverse=True)
        count, one, two, ahead, more = (v.astype(np.float64) for v in self.words.look_up(distinct))
        keys, pair_back = np.unique(pair_keys(before, tokens), return_inverse=True)
        pair = self.pairs.look_up(keys)[0].astype(np.float64)[pair_back]
        own, context = back[: len(tokens)], back[len(tokens) :]
        kept = np.maximum(ahead - discount(ahead, self.word_discounts), 0) / max(1, self.kinds_of_pairs)
        lower = (kept + self.word_rest / (self.vocabulary + 1))[own]
        # A context's followers add up to its own count; the beginning is counted as a word for this.
        seen = np.maximum(count, 1)
        rest = (one * self.pair_discounts[0] + two / 2 * self.pair_discounts[1] + more * self.pair_discounts[2]) / seen
        rest = np.where(count > 0, rest, 1.0)[context]
        part = np.where(count[context] > 0, np.maximum(pair - discount(pair, self.pair_discounts), 0) / seen[context], 0.0)
        return count[own], np.log10(part + rest * lower)


def discount(counts: np.ndarray, by: tuple[float, float, float]) -> np.ndarray:
    return np.where(counts >= 3, by[2], np.where(counts >= 2, by[1], np.where(counts >= 1, by[0], 0.0)))


def discounts(told: np.ndarray) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts from the numbers of entries counted 1 to 4 times.

    Where a corpus is too small to tell them, 0.5, 1 and 1.5.
    """
    n1, n2, n3, n4 = (float(n) for n in told[2:])
    if min(n1, n2, n3, n4) == 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k) for k, d in enumerate(found, 1))  # type: ignore[return-value]


def learn(docs: DataFrame) -> Model:
    """Count the pairs and the words of all texts of ``docs`` and write the model to the shared folder.

    First the pairs are counted. Then, with their counts at hand, each occurrence of a pair counted
    c times adds 1/c to the number of different words before its second word, and to the number
    of different words after its first, so the words' own sums need no second table of pairs.
    """
    texts = id_and_text(docs).select("text")

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                tokens, before, _ = tokens_of(batch.column("text"))
                yield pair_keys(before, tokens), [np.ones(len(tokens), np.int64)]

        return _gathered(rows(), ["n"], [pa.int64()])

    pairs, told = _write(texts.mapInArrow(count_pairs, "key bigint, n bigint"), "pairs", ("<u4",))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                tokens, before, _ = tokens_of(batch.column("text"))
                keys, back = np.unique(pair_keys(before, tokens), return_inverse=True)
                n = pairs.look_up(keys)[0][back]
                share = 1 / np.maximum(n, 1)
                none, one = np.zeros(len(tokens)), np.ones(len(tokens))
                begin = (before == BEGIN).astype(np.float64)  # counted as a context
                yield np.concatenate([tokens, before]), [
                    np.concatenate([one, begin]), np.concatenate([none, n == 1]), np.concatenate([none, n == 2]),
                    np.concatenate([share, none]), np.concatenate([none, np.where(n >= 3, share, 0)]),
                ]

        return _gathered(rows(), WORD_COLUMNS, [pa.float64()] * 5)

    schema = "key bigint, " + ", ".join(f"{name} double" for name in WORD_COLUMNS)
    words, word_told = _write(texts.mapInArrow(count_words, schema), "words", ("<u8", "<u4", "<u4", "<u4", "<u4"))
    begun = int(words.look_up(np.array([BEGIN]))[0][0])
    ahead = word_told[3]
    by = discounts(ahead)
    with_any = int(ahead[0]) - (begun > 0)  # the beginning has nothing before it
    more = max(0, with_any - int(ahead[2]) - int(ahead[3]))
    kinds_of_pairs = int(told[0][0])
    return Model(
        pairs, words, int(word_told[0][1]) - begun, with_any, kinds_of_pairs, discounts(told[0]), by,
        (by[0] * int(ahead[2]) + by[1] * int(ahead[3]) + by[2] * more) / kinds_of_pairs if kinds_of_pairs else 1.0,
    )


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every whole text.

    ``score`` is the model's log10 probability of the text, ``base_score`` that of single tokens
    with one added to each count. A null or empty text is the end token alone. Repeated rows score
    alike; columns other than doc_id and text are not read. Workers map the model's files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, before, begins = tokens_of(batch.column("text"))
            counts, logs = model.token_scores(tokens, before)
            base = np.log10((counts + 1) / (model.tokens + model.vocabulary + 1))
            add = lambda values: np.add.reduceat(values, begins) if len(begins) else values
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(add(np.ones(len(tokens), np.int64))),
                 pa.array(add((counts > 0).astype(np.int64))), pa.array(add(base)), pa.array(add(logs))],
                ["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return id_and_text(docs).mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double"
    )


def score_held_out(docs: DataFrame, modulus: int = 7) -> DataFrame:
    """Learn from the documents that are not held out and score all, with perplexity per token."""
    model = learn(docs.where(~held_out(F.col("doc_id"), modulus)))
    scored = score(docs, model)
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), modulus).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
