"""Alignment of two tokenizers by inverted bitmaps: which tokens end together, how often, and how usual that is.

Documents are numbered inside chunks. For every pair of tokens that end together, each chunk has a
compressed bitmap of the documents that hold the pair, and planes with the binary digits of how
often a document holds it beyond the first time. Bitmaps of parts of a chunk are merged by OR, bits
are counted for documents and links, and the counts go back to the documents over the same bitmaps.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import id_and_text, stored
from shelfmark.llm.token_counts import byte_letters

#: Documents of a chunk: as many as Spark's own bitmaps have bits, 4096 bytes.
CHUNK = 32_768
BITMAP_BYTES = CHUNK // 8
#: A chunk ends early with the document that brings it beyond so many postings.
CHUNK_POSTINGS = 1 << 20
#: A single blank between two characters that are none. In both vocabularies a token that holds a
#: blank begins with it or is all blanks, and a blank before a word goes with the word, so no token
#: lies across such a place.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Characters of a text that are encoded at once; longer texts are cut at such places.
TEXT_AT_ONCE = 1 << 17
#: Characters that both libraries for the first vocabulary take apart alike, which tests hold them
#: to; texts with others go to the slower one that the vocabulary file is made for.
_ALIKE = re.compile("[\t-\r\x20-\x7e\xa1-\xffĀ-ſΑ-ΡΣ-ϿА-я‐-‧ぁ-ゖァ-ヺ一-龥가-힣]*")


class Spellings:
    """Texts by number, one after another in one array, so that a row of them is spelled by gathering bytes."""

    def __init__(self, texts: list[bytes]) -> None:
        self.flat = np.frombuffer(b"".join(texts), np.uint8)
        self.sizes = np.array([len(text) for text in texts], np.int32)
        self.starts = (np.cumsum(self.sizes) - self.sizes).astype(np.int32)

    def spelled(self, numbers: np.ndarray) -> np.ndarray:
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0)
        at += np.repeat(self.starts[numbers] - (ends - sizes), sizes)
        return self.flat[at]


@dataclass
class Encoders:
    """Both tokenizers and the bytes of their tokens; ``ranks`` states the first vocabulary a second time."""

    first: str
    second: str
    ranks: str
    pattern: str

    def __post_init__(self) -> None:
        import base64

        import sentencepiece
        import tiktoken

        with open(self.first, encoding="utf-8") as file:
            stated = json.load(file)
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        by_id = {number: token for token, number in stated["model"]["vocab"].items()}
        by_id |= {token["id"]: token["content"] for token in stated["added_tokens"]}
        self.first_tokens = Spellings([bytes(byte_of[c] for c in by_id.get(i, "")) for i in range(max(by_id) + 1)])
        with open(self.ranks, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.quick = tiktoken.Encoding("pairs", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=self.second)
        self.second_tokens = Spellings([piece_bytes(self.pieces.id_to_piece(i)) for i in range(self.pieces.get_piece_size())])
        # Every id with whatever may stand after it: the next id, the other side, the next group, the end.
        ids = max(len(self.first_tokens.sizes), len(self.second_tokens.sizes))
        self.written = Spellings([str(i).encode() + mark for i in range(ids) for mark in (b",", b"|", b";", b"")])

    @functools.cached_property
    def exact(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        made = tokenizers.Tokenizer.from_file(self.first)
        made.encode_special_tokens = True
        return made

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a blank and the text in the first vocabulary, and of the text in the second.

        None where there is no text or where the bytes of either are not those of the blank and the text.
        """
        if not text:
            return None
        a, b = [], []
        for part in parts(text):
            whole = " " + part
            if _ALIKE.fullmatch(part):
                ids = self.quick.encode_to_numpy(whole, disallowed_special=()).astype(np.int64)
            else:
                ids = np.array(self.exact.encode(whole, add_special_tokens=False).ids, np.int64)
            others = np.array(self.pieces.encode(part, num_threads=1), np.int64)
            spelling = np.frombuffer(whole.encode(), np.uint8)
            if not (np.array_equal(self.first_tokens.spelled(ids), spelling) and np.array_equal(self.second_tokens.spelled(others), spelling)):
                return None
            a.append(ids)
            b.append(others)
        return np.concatenate(a), np.concatenate(b)


def piece_bytes(piece: str) -> bytes:
    """The bytes of a piece: U+2581 is a blank, <0xHH> the byte HH."""
    byte = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
    return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()


def parts(text: str) -> Iterator[str]:
    """The text in parts that are encoded one by one with the same tokens; the blank between two parts is left out."""
    begin = 0
    while len(text) - begin > TEXT_AT_ONCE:
        cut = _CUT.search(text, begin + TEXT_AT_ONCE)
        if cut is None:
            break
        yield text[begin : cut.start()]
        begin = cut.end()
    yield text[begin:]


@functools.lru_cache(maxsize=1)
def load(first: str, second: str, ranks: str, pattern: str) -> Encoders:
    return Encoders(first, second, ranks, pattern)


def aligned(a: np.ndarray, b: np.ndarray, encoders: Encoders) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` of the tokens that end together."""
    ends, others = np.cumsum(encoders.first_tokens.sizes[a]), np.cumsum(encoders.second_tokens.sizes[b])
    at = np.searchsorted(ends, others)
    met = np.flatnonzero(ends[np.minimum(at, len(ends) - 1)] == others) if len(ends) else at
    return at[met], met


def group_text(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, encoders: Encoders) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: the ids of both sides of every group, in order."""
    # A token of the first side stands after all groups before its own, one of the second after its group's first side as well.
    before = np.append(0, at_b + 1)[np.searchsorted(at_a, np.arange(len(a)))]
    beside = (at_a + 1)[np.searchsorted(at_b, np.arange(len(b)))]
    left, right = a * 4, b * 4
    left[at_a] += 1
    right[at_b] += 2
    right[-1] += 1
    codes = np.empty(len(a) + len(b), np.int64)
    codes[np.arange(len(a)) + before] = left
    codes[np.arange(len(b)) + beside] = right
    return encoders.written.spelled(codes).tobytes()


def pair_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a << 32 | b


def compressed(places: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Bitmaps of ascending places, cut at ``starts``: two bytes a place, or all bits where that is shorter."""
    ends = np.append(starts[1:], len(places))
    packed = places.astype("<u2").tobytes()
    full = np.flatnonzero(2 * (ends - starts) >= BITMAP_BYTES)
    if not len(full):
        offsets = np.append(starts, len(places)) * 2
        return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype("<i4")), pa.py_buffer(packed)])
    rows = [packed[2 * s : 2 * e] for s, e in zip(starts.tolist(), ends.tolist())]
    for row in full:
        bits = np.zeros(CHUNK, np.uint8)
        bits[places[starts[row] : ends[row]]] = 1
        rows[row] = np.packbits(bits, bitorder="little").tobytes()
    return pa.array(rows, pa.binary())


def places_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The places in all bitmaps of a column, one after another, and how many each has."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    sizes = np.diff(ends)
    full = np.flatnonzero(sizes == BITMAP_BYTES)
    if not len(full):
        whole = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if len(column) else np.zeros(0, np.uint8)
        return whole.view("<u2").astype(np.int64), sizes // 2
    raw = np.frombuffer(data, np.uint8)
    found, counts = [], sizes // 2
    at = 0
    for row in [*full.tolist(), len(column)]:
        found.append(raw[ends[at] : ends[row]].view("<u2").astype(np.int64))
        if row < len(column):
            places = np.flatnonzero(np.unpackbits(raw[ends[row] : ends[row + 1]], bitorder="little"))
            found.append(places)
            counts[row] = len(places)
        at = row + 1
    return np.concatenate(found), counts


def bits_set(bits: Column) -> Column:
    """How many bits a compressed bitmap has set."""
    size = F.octet_length(bits)
    return F.when(size == BITMAP_BYTES, F.bitmap_count(bits)).otherwise((size / 2).cast("bigint"))


class Chunks:
    """Postings of the documents of a task, gathered chunk by chunk."""

    def __init__(self, number: int) -> None:
        # Chunks of a task: its number in the high bits, so that tasks share none.
        self.chunk = number << 32
        self.documents = self.postings = 0
        self.parts: list[np.ndarray] = []

    def add(self, pairs: np.ndarray) -> tuple[int, int, Iterator[pa.RecordBatch]]:
        """Chunk and place of the next document, and the rows of a chunk that ended before it."""
        closed: Iterator[pa.RecordBatch] = iter(())
        if self.documents == CHUNK or self.postings > CHUNK_POSTINGS:
            closed = self.close()
        place = self.documents
        unique, times = np.unique(pairs, return_counts=True)
        self.parts.append(np.stack([unique, np.full(len(unique), place), times]))
        self.documents += 1
        self.postings += len(unique)
        return self.chunk, place, closed

    def close(self) -> Iterator[pa.RecordBatch]:
        """Bitmaps of the chunk, OR of those of its documents, and the planes of further occurrences."""
        chunk, parts = self.chunk, self.parts
        self.chunk, self.documents, self.postings, self.parts = chunk + 1, 0, 0, []
        return bitmap_rows(chunk, parts)


def bitmap_rows(chunk: int, parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if not parts:
        return
    pairs, places, times = np.concatenate(parts, axis=1)
    order = np.argsort(pairs, kind="stable")  # places ascend already
    pairs, places, times = pairs[order], places[order], times[order]
    plane, more = 0, np.ones(len(pairs), bool)
    while more.any():
        chosen, held = pairs[more], places[more]
        starts = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
        yield posting_batch(chosen[starts], np.full(len(starts), chunk), np.full(len(starts), plane), compressed(held, starts))
        further = times - 1
        more = (further >> plane & 1).astype(bool)
        plane += 1
        while not more.any() and (further >> plane).any():
            more = (further >> plane & 1).astype(bool)
            plane += 1


_DOCUMENT = ["doc_id", "place", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
_POSTING = ["pair", "plane", "bits"]


def posting_batch(pairs: np.ndarray, chunks: np.ndarray, planes: np.ndarray, bits: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(chunks, pa.int64()), pa.array(pairs, pa.int64()), pa.array(planes, pa.int32()), bits], ["chunk", *_POSTING]
    )


def postings(docs: DataFrame, first: str, second: str, ranks: str, pattern: str) -> DataFrame:
    """Rows of documents (``pair`` is null) and rows of bitmaps, in one pass over the texts.

    Documents: doc_id, their ``chunk`` and ``place`` in it, n_a, n_b, n_groups, n_links,
    groups_sha256. Bitmaps: ``chunk``, ``pair`` (first id times 2^32 plus second id), ``plane``
    (0: documents that hold the pair; k: binary digit k - 1 of how often beyond once), ``bits``.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    layout = f"chunk bigint, doc_id {kind}, place int, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pair bigint, plane int, bits binary"

    def widened(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
        held = dict(zip(batch.schema.names, batch.columns))
        return pa.RecordBatch.from_arrays(
            [held[f.name] if f.name in held else pa.nulls(batch.num_rows, f.type) for f in schema], schema=schema
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = load(first, second, ranks, pattern)
        chunks = Chunks(TaskContext.get().partitionId())
        schema = None
        for batch in batches:
            if schema is None:
                number, whole = pa.int64(), pa.int32()
                schema = pa.schema([
                    ("chunk", number), ("doc_id", batch.column("doc_id").type), ("place", whole), ("n_a", number), ("n_b", number),
                    ("n_groups", number), ("n_links", number), ("groups_sha256", pa.string()), ("pair", number), ("plane", whole),
                    ("bits", pa.binary()),
                ])
            rows: dict[str, list] = {name: [] for name in ["chunk", *_DOCUMENT[1:]]}
            for text in batch.column("text"):
                encoded = encoders.encode(text.as_py())
                if encoded is None:
                    a = b = at_a = at_b = np.zeros(0, np.int64)
                    mark = ""
                else:
                    a, b = encoded
                    at_a, at_b = aligned(a, b, encoders)
                    mark = hashlib.sha256(group_text(a, b, at_a, at_b, encoders)).hexdigest()
                chunk, place, closed = chunks.add(pair_of(a[at_a], b[at_b]))
                yield from (widened(c, schema) for c in closed)
                for name, value in zip(rows, (chunk, place, len(a), len(b), len(at_a), len(at_a), mark)):
                    rows[name].append(value)
            table = {name: pa.array(values, schema.field(name).type) for name, values in rows.items()}
            yield widened(pa.RecordBatch.from_arrays([*table.values(), batch.column("doc_id")], [*table, "doc_id"]), schema)
        if schema is not None:
            yield from (widened(c, schema) for c in chunks.close())

    return id_and_text(docs).mapInArrow(run, layout)


def pair_counts(rows: DataFrame) -> DataFrame:
    """``pair``, its ids ``a`` and ``b``, ``n_docs`` and ``n_links``, and whether it is its ``b``'s most frequent (``best``)."""
    counted = rows.where("pair IS NOT NULL").select("pair", "plane", bits_set(F.col("bits")).alias("n"))
    links = F.when(F.col("plane") == 0, F.col("n")).otherwise(F.col("n") * F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("plane") - 1))
    pairs = counted.groupBy("pair").agg(F.sum(F.when(F.col("plane") == 0, F.col("n"))).alias("n_docs"), F.sum(links).alias("n_links"))
    pairs = pairs.select("pair", F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), "n_docs", "n_links")
    most = pairs.groupBy("b").agg(F.max("n_links").alias("most"))
    return pairs.join(most, "b").select("pair", "a", "b", "n_docs", "n_links", (F.col("n_links") == F.col("most")).alias("best"))


def align(docs: DataFrame, first: str, second: str, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document.

    ``first`` (byte-level BPE, the text after a blank) and ``second`` (pieces) name the vocabulary
    files, ``ranks`` and ``pattern`` state the first one for a quicker library with the same
    result. A null or empty text, and one whose tokens do not spell a blank and the text, has no
    tokens: zeros and ''. Rows are documents of their own, so repeated rows repeat and count
    twice; columns other than doc_id and text are not read. An empty table gives no rows.
    """
    rows = stored(postings(docs, first, second, ranks, pattern), "postings")
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = pair_counts(rows).select("pair", F.col("n_links").alias("count"), "best")
    scored = rows.where("pair IS NOT NULL").select(F.col("chunk").alias("of"), "pair", "plane", "bits").join(counts, "pair").drop("pair")
    documents = rows.where("pair IS NULL").select("chunk", *_DOCUMENT)

    def back(documents: pa.Table, scored: pa.Table) -> pa.Table:
        total, best = np.zeros(CHUNK, np.int64), np.zeros(CHUNK, np.int64)
        for batch in scored.to_batches():
            places, sizes = places_of(batch.column("bits"))
            plane = batch.column("plane").to_numpy().astype(np.int64)
            times = np.where(plane == 0, 1, 1 << np.maximum(plane - 1, 0))
            np.add.at(total, places, np.repeat(times * batch.column("count").to_numpy(), sizes))
            np.add.at(best, places, np.repeat(times * batch.column("best").to_numpy(zero_copy_only=False), sizes))
        place = documents["place"].to_numpy()
        kept = documents.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        return (
            kept.append_column("n_best", pa.array(best[place])).append_column("count_sum", pa.array(total[place]))
            .append_column("groups_sha256", documents["groups_sha256"])
        )

    return documents.groupBy("chunk").cogroup(scored.groupBy("of")).applyInArrow(
        back, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    )
