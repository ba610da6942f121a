"""Near-duplicate documents by Order MinHash sketches and banded alignment of words."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.llm.common import few_edits, finished, mixed, sifted, stored, text_bytes, word_hashes
from shelfmark.llm.groups import crowded, similar_groups

#: Words in a k-mer; sketches of a text; k-mers in a sketch.
WORDS, SKETCHES, TAKEN = 3, 48, 2
#: Least share of words that an alignment leaves in place.
SIMILARITY = 0.8
#: Parts of the allowed edits that are tried first; most copies need no wider band.
NARROW = (0.05, 0.3)

_LETTERS = np.arange(256, dtype=np.uint8)
#: Words are runs of letters, digits and bytes of longer characters; ASCII case is folded.
WORD_BYTES = np.where(
    ((_LETTERS >= ord("a")) & (_LETTERS <= ord("z"))) | ((_LETTERS >= ord("0")) & (_LETTERS <= ord("9"))) | (_LETTERS >= 0x80),
    _LETTERS, 0,
).astype(np.uint8)
WORD_BYTES[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)

_SALTS = mixed(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Salted hashes of one text that are held at once.
AT_ONCE = 1 << 20
#: Classes of words whose counts, and of repeated words whose parities, are compared before texts are aligned.
BAG, MARKS = 256, 4096
#: Numbers of 64 bits that the parities are laid over each other into.
FOLDED = 4
_FIRST_CODE, _CODES = 0x100, 0xD600


def kmers(words: np.ndarray) -> np.ndarray:
    """Hashes of runs of ``WORDS`` words; a shorter text is one run."""
    if not len(words):
        return words
    size = min(WORDS, len(words))
    total = np.zeros(len(words) - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            total = mixed(total + words[k : len(words) - size + 1 + k])
    return total


def occurrence_labelled(values: np.ndarray) -> np.ndarray:
    """Tell repeated k-mers apart by how often they came before."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    if fresh.all():
        return values
    at = np.arange(len(values))
    seen = np.empty(len(values), np.uint64)
    seen[order] = (at - np.maximum.accumulate(np.where(fresh, at, 0))).astype(np.uint64)
    return mixed(values ^ mixed(seen * np.uint64(0xD1342543DE82EF95)))


def sketches(words: np.ndarray) -> np.ndarray:
    """One number per sketch: the k-mers with the least salted hashes, in the order of the text."""
    labelled = occurrence_labelled(kmers(words))
    if not len(labelled):
        return labelled
    taken = min(TAKEN, len(labelled))
    rows = max(1, AT_ONCE // len(labelled))
    places = [
        np.argpartition(mixed(labelled ^ _SALTS[k : k + rows, None]), taken - 1, axis=1)[:, :taken]
        for k in range(0, SKETCHES, rows)
    ]
    values = labelled[np.sort(np.concatenate(places), axis=1)]
    total = _SALTS
    with np.errstate(over="ignore"):
        for k in range(taken):
            total = mixed(total + values[:, k])
    return np.unique(total)


def parities(codes: np.ndarray) -> np.ndarray:
    """``MARKS`` bits: which classes of hashes an odd number of a text's words falls into, repeated words told apart."""
    ordered = np.sort(codes).astype(np.uint64)
    at = np.arange(len(ordered))
    fresh = np.ones(len(ordered), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    seen = (at - np.maximum.accumulate(np.where(fresh, at, 0))).astype(np.uint64) if len(at) else ordered
    places = mixed(ordered ^ mixed(seen * np.uint64(0xD1342543DE82EF95) + np.uint64(1))) % np.uint64(MARKS)
    odd = np.bincount(places.astype(np.int64), minlength=MARKS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def bag(codes: np.ndarray) -> np.ndarray:
    """How many words fall into each of ``BAG`` classes, 127 at most."""
    return np.minimum(np.bincount(codes % BAG, minlength=BAG), 127).astype(np.int8)


_TRAIT = "struct<n: int, folded: array<bigint>, marks: array<bigint>, bag: array<tinyint>>"


def _traits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.frombuffer(text.encode("utf-16-le"), "<u2") for text in batch.column("codes").to_pylist()]
        marks = [parities(codes) for codes in rows]
        trait = pa.StructArray.from_arrays(
            [pa.array([len(codes) for codes in rows], pa.int32()),
             pa.array([np.bitwise_xor.reduce(m.reshape(-1, FOLDED)) for m in marks], pa.list_(pa.int64())),
             pa.array(marks, pa.list_(pa.int64())),
             pa.array([bag(codes) for codes in rows], pa.list_(pa.int8()))],
            ["n", "folded", "marks", "bag"],
        )
        yield pa.RecordBatch.from_arrays([batch.column("node"), trait], ["node", "trait"])


def may_align(a: Column, b: Column) -> Column:
    """Whether lengths, parities and bags leave it open that two texts are aligned closely enough.

    All words of the longer text but one for each edit stand in the other too, so the words that
    only one of the two holds are twice the edits less the difference in length at most, and each
    changes one parity and one count by one. Texts further apart than the allowed edits leave room
    for are ruled out; parities laid over each other do so for most at the price of a few operations.
    """
    longest, shortest = F.greatest(a["n"], b["n"]), F.least(a["n"], b["n"])
    allowed = F.floor(longest * (1 - SIMILARITY) + 1e-9)
    total = lambda values: F.aggregate(values, F.lit(0), lambda s, x: s + x)
    folded = functools.reduce(Column.__add__, [F.bit_count(a["folded"][k].bitwiseXOR(b["folded"][k])) for k in range(FOLDED)])
    odd = total(F.zip_with(a["marks"], b["marks"], lambda x, y: F.bit_count(x.bitwiseXOR(y))))
    apart = total(F.zip_with(a["bag"], b["bag"], lambda x, y: F.abs(x.cast("int") - y.cast("int"))))
    room = 2 * allowed - (longest - shortest)
    return (longest - shortest <= allowed) & (folded <= room) & (odd <= room) & (apart <= room)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, first = word_hashes(*text_bytes(batch.column("text")), WORD_BYTES)
        codes = (words % np.uint64(_CODES) + np.uint64(_FIRST_CODE)).astype("<u2")
        parts = [slice(first[i], first[i + 1]) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("node"),
             pa.array([codes[part].tobytes().decode("utf-16-le") for part in parts], pa.string()),
             pa.array([sketches(words[part]).view(np.int64) for part in parts], pa.list_(pa.int64()))],
            ["doc_id", "node", "codes", "keys"],
        )


def aligned(a: Column, b: Column) -> Column:
    """Whether two texts, one letter a word, differ by few enough edits; the band is as wide as those."""
    return few_edits(a, b, SIMILARITY, NARROW)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, ``class_id`` (least id of its class), ``class_size`` and ``keep``.

    Two texts are linked if they share an Order MinHash sketch (``TAKEN`` occurrence-labelled
    runs of ``WORDS`` words, in text order) and an alignment of their words leaves at least
    ``SIMILARITY`` of them in place. Classes are the connected groups; equal texts are one node.
    ``keep`` marks one document of each class, the one with the least id (rows without id last).
    A null text counts as empty; all empty texts are equal; texts without words are alike only
    where equal. Every input row has a row; repeated rows (same id and text) are marked alike, and
    ``keep_one`` keeps one of them.
    Columns other than doc_id and text are not read.
    """
    return finished(docs.sparkSession, "classes", lambda: _classes(docs))


def _classes(docs: DataFrame) -> DataFrame:
    """The rows of ``near_duplicates``, which read tables that are still in use."""
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("node", F.unhex(F.md5("text")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketched = stored(
        given.mapInArrow(_sketch, f"doc_id {kind}, node binary, codes string, keys array<bigint>"), "sketches"
    )
    members = sketched.select("node", F.explode("keys").alias("bucket"))

    def of_nodes(nodes: DataFrame, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """What ``of`` makes of node and codes, once for each wanted node; other rows are not shuffled."""
        keyed = sketched.select("node", F.xxhash64("node").alias("key"), "codes")
        near = of(sifted(keyed, "key", nodes.select(F.xxhash64("node").alias("key"))).select("node", "codes"))
        # No semi join: the optimizer would move it before the sieve, and so shuffle all rows.
        chosen = near.join(nodes, "node")
        return chosen.groupBy("node").agg(*[F.first(c).alias(c) for c in chosen.columns if c != "node"])

    def traits(nodes: DataFrame) -> DataFrame:
        return of_nodes(nodes, lambda rows: rows.mapInArrow(_traits, f"node binary, trait {_TRAIT}"))

    def where_both(pairs: DataFrame, of: Callable[[DataFrame], DataFrame], test: Callable[[Column, Column], Column]) -> DataFrame:
        """The pairs whose two nodes pass a test of what ``of`` (nodes) gives for them as second column."""
        def side(name: str) -> DataFrame:
            found = of(stored(pairs.select(F.col(name).alias("node")).distinct(), "nodes"))
            return found.toDF(name, f"{name}_value")

        return pairs.join(side("b"), "b").join(side("a"), "a").where(test(F.col("a_value"), F.col("b_value"))).select("a", "b")

    def align(pairs: DataFrame) -> DataFrame:
        return where_both(pairs, lambda nodes: of_nodes(nodes, lambda rows: rows), aligned)

    def verify(pairs: DataFrame) -> DataFrame:
        return align(stored(where_both(pairs, traits, may_align), "open"))

    grouped = similar_groups(crowded(members), verify, may_align, traits, align)
    placed = (
        sketched.select("doc_id", "node").join(grouped, "node", "left")
        .select("doc_id", "node", F.coalesce("root", "node").alias("root"))
    )
    # One row per class, combined in the map tasks; then one row number per class and id.
    classes = placed.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    first = placed.where("doc_id IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("first"))
    classes = classes.join(first, "root", "left")
    chosen = F.when(F.col("first").isNull(), F.col("node") == F.col("root")).otherwise(
        (F.col("doc_id") == F.col("first.doc_id")) & (F.col("node") == F.col("first.node"))
    )
    return placed.join(classes, "root").select("doc_id", "class_id", "class_size", F.coalesce(chosen, F.lit(False)).alias("keep"), "node")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows, with all their columns, of one document of each class; of repeated rows one stays.

    Of rows with the same id and text, which differ in other columns at most, the one that comes
    first in the order of those columns stays.
    """
    found = near_duplicates(docs)
    kept = found.where("keep").select("doc_id", "node").distinct()
    node = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), node.alias("hash")).withColumn(
        "key", F.xxhash64("hash")
    )
    # Rows that are alone in their class stay as they are, without a shuffle.
    shared = found.where("class_size > 1").select(F.xxhash64("node").alias("key"))
    alone = sifted(packed, "key", shared, met=False)
    among = sifted(packed, "key", shared)
    # No semi join: the optimizer would move it before the sieve.
    chosen = among.join(kept, among["id"].eqNullSafe(kept["doc_id"]) & (among["hash"] == kept["node"])).select("row", "id", "hash")
    others = [F.col("row")[c] for c in docs.columns if c not in ("doc_id", "text")]
    order = F.to_json(F.struct(*others)) if others else F.lit(1)
    ranked = chosen.withColumn("place", F.row_number().over(W.partitionBy("id", "hash").orderBy(order)))
    return alone.select("row.*").unionByName(ranked.where("place = 1").select("row.*"))
