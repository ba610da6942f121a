"""Ranked lexical search: impact vectors in buckets of like length, bounds, and exact integer rescoring.

A document is a vector of impacts over the words of the queries, and a query a vector of weights;
the score is their product. Vectors are taken by falling length. A bucket is skipped for a query
whose length times the bucket's longest vector cannot reach the query's tenth best score so far
(Cauchy-Schwarz). Inside a bucket, the greatest impact of each word bounds what the word can add:
words that cannot reach the threshold even together are left until the end, documents that hold
none of the others are never touched, and the documents left whose bound reaches the threshold are
scored again in 64-bit integers over all words. Every bound is at least the score, so none is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.llm.common import id_and_text, stored, text_bytes, word_hashes
from shelfmark.llm.order_minhash import WORD_BYTES

#: Documents listed for each query.
TOP = 10
#: Query words that are sent to the workers at once; more queries take more passes over the documents.
QUERY_WORDS_AT_ONCE = 1_000_000
#: Documents of like length that share their bounds.
BUCKET = 2048
#: Share of the documents, the longest vectors, that are searched first and set the thresholds for the rest.
HEAD = 1 / 16
#: Rounding of lengths in floating point is far below this.
SLACK = 1 + 1e-9

# Fixed values of the score: growth of a word's impact, and the part of the length that counts.
IMPACT, COUNT_WEIGHT, LENGTH_WEIGHT, LENGTH_SHARE = 1_000_000_000, 1000, 8, 75


@dataclass
class Corpus:
    """Documents with words, words in all documents."""

    documents: int
    words: int

    def norms(self, sizes: np.ndarray) -> np.ndarray:
        """What the number of words of a document puts below its impacts."""
        if int(sizes.max(initial=0)) * LENGTH_SHARE * self.documents < 1 << 63:
            part = LENGTH_SHARE * sizes * self.documents // self.words
        else:
            part = np.array([LENGTH_SHARE * int(n) * self.documents // self.words for n in sizes], np.int64)
        return 100 - LENGTH_SHARE + part

    def impact(self, count: Column, size: Column) -> Column:
        """The same impact in column functions, as a double; it only chooses who is searched first."""
        norm = 100 - LENGTH_SHARE + LENGTH_SHARE * size.cast("double") * self.documents / self.words
        return IMPACT * count.cast("double") / (COUNT_WEIGHT * count.cast("double") + LENGTH_WEIGHT * norm)


@dataclass
class Queries:
    """Weighted words of a block of queries: query ``i`` has the words ``first[i]`` to ``first[i + 1]``."""

    ids: pa.Array
    keys: np.ndarray
    first: np.ndarray
    words: np.ndarray  # places in the block's vocabulary
    weights: np.ndarray
    least: np.ndarray  # scores below it are not among the best

    def __len__(self) -> int:
        return len(self.first) - 1

    def lengths(self) -> np.ndarray:
        return np.sqrt(np.add.reduceat(np.square(self.weights.astype(float)), self.first[:-1])) * SLACK


def query_vectors(queries: DataFrame, key: str) -> DataFrame:
    """``key``, ``text_key`` (hash of the text), and the distinct ``terms`` of each text with their ``counts``."""
    kind = queries.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, first = word_hashes(*text_bytes(batch.column("text")), WORD_BYTES)
            parts = [np.unique(words[a:b].view(np.int64), return_counts=True) for a, b in zip(first, first[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_key"), pa.array([p[0] for p in parts], pa.list_(pa.int64())),
                 pa.array([p[1] for p in parts], pa.list_(pa.int64()))],
                ["id", "text_key", "terms", "counts"],
            )

    given = queries.select(F.col(key).alias("id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    return given.withColumn("text_key", F.xxhash64("text")).mapInArrow(
        run, f"id {kind}, text_key bigint, terms array<bigint>, counts array<bigint>"
    ).where("size(terms) > 0")


def document_vectors(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, number of words ``n``, and the ``terms`` (places in ``vocabulary``) with their ``counts``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, first = word_hashes(*text_bytes(batch.column("text")), WORD_BYTES)
            place = np.searchsorted(vocabulary, words.view(np.int64))
            place[place == len(vocabulary)] = 0
            known = np.flatnonzero(vocabulary[place] == words.view(np.int64))
            doc = np.searchsorted(first, known, side="right") - 1
            pairs, counts = np.unique(doc * len(vocabulary) + place[known], return_counts=True)
            offsets = np.searchsorted(pairs, np.arange(batch.num_rows + 1) * len(vocabulary)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(v.astype(np.int32))) for v in (pairs % len(vocabulary), counts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(first), pa.int64()), *lists], ["doc_id", "n", "terms", "counts"]
            )

    return id_and_text(docs).mapInArrow(run, f"doc_id {kind}, n bigint, terms array<int>, counts array<int>")


def search(docs: DataFrame, queries: DataFrame, key: str = "item_id", top: int = TOP) -> DataFrame:
    """The ``top`` best documents of every query: ``key``, rank from 1, doc_id, score.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower
    case; they are known by 64-bit hashes. A document scores the sum, over the words of the query
    with repeats, of the word's weight times its impact in the document; documents that score 0
    are not listed, equal scores come by ascending doc_id, rows without id last. Null and empty
    texts have no words: such documents do not count and such queries list nothing. Every row of
    ``docs`` is a document of its own, also where an id or a text repeats. Rows of ``queries`` that
    are equal in key and text are one query; further texts of a key are ranked on their own. Other
    columns are not read. Empty tables give no rows.
    """
    spark = docs.sparkSession
    asked = stored(query_vectors(queries, key), "queries")
    total = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("n")).first()["n"]
    blocks = -(-total // QUERY_WORDS_AT_ONCE)
    kinds = f"{key} {queries.schema[key].dataType.simpleString()}, text_key bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score bigint"
    found = spark.createDataFrame([], kinds)
    for block in range(blocks):
        chosen = asked.where(F.pmod(F.xxhash64("id", "text_key"), F.lit(blocks)) == block)
        found = found.unionByName(_search_block(docs, chosen.toArrow(), key, top, kinds))
    ranked = found.withColumn(
        "rank", F.row_number().over(W.partitionBy(key, "text_key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    )
    return ranked.where(F.col("rank") <= top).select(key, F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _search_block(docs: DataFrame, asked: pa.Table, key: str, top: int, kinds: str) -> DataFrame:
    """The best documents of a block of queries, ``top`` for each task that holds any."""
    spark = docs.sparkSession
    asked = asked.combine_chunks()
    terms = asked["terms"].combine_chunks().flatten().to_numpy()
    vocabulary, words = np.unique(terms, return_inverse=True)
    vectors = stored(document_vectors(docs, vocabulary), "vectors")
    seen = vectors.agg(F.count(F.when(F.col("n") > 0, True)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    corpus = Corpus(seen["documents"], seen["words"])
    if not corpus.documents or not len(terms):
        return spark.createDataFrame([], kinds)
    weight = np.zeros(len(vocabulary), np.int64)
    held = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    ratio = (2 * F.lit(corpus.documents).cast("double") + 2) / (2 * F.col("df").cast("double") + 1)
    stated = held.select("term", F.floor(1000 * F.log(ratio)).alias("weight")).toArrow()
    weight[stated["term"].to_numpy()] = stated["weight"].to_numpy()

    sizes = pc.list_value_length(asked["terms"]).to_numpy()
    block = Queries(
        asked["id"].combine_chunks(), asked["text_key"].to_numpy(), np.concatenate([[0], np.cumsum(sizes)]), words,
        weight[words] * asked["counts"].combine_chunks().flatten().to_numpy(), np.ones(len(sizes), np.int64),
    )
    # An impact per word, squared and added up; a document that shares no word with any query is left out.
    squares = F.zip_with("terms", "counts", lambda _, c: F.pow(corpus.impact(c, F.col("n")), 2))
    ordered = vectors.where("size(terms) > 0").withColumn("length", F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))
    cut = ordered.agg(F.percentile_approx("length", 1 - HEAD).alias("cut")).first()["cut"]
    if cut is None:
        return spark.createDataFrame([], kinds)
    columns = ["doc_id", "n", "terms", "counts"]
    searched = lambda rows: rows.select(columns).mapInArrow(_searcher(block, corpus, len(vocabulary), top, key), kinds)
    head = stored(searched(ordered.where(F.col("length") >= cut)), "head")
    # The tenth best score of the longest vectors is what the others have to reach.
    place = F.row_number().over(W.partitionBy(key, "text_key").orderBy(F.desc("score")))
    tenth = head.withColumn("place", place).where(F.col("place") == top).select(key, "text_key", "score").toArrow()
    number = {(i, k): at for at, (i, k) in enumerate(zip(block.ids.to_pylist(), block.keys.tolist()))}
    for i, k, score in zip(*(column.to_pylist() for column in tenth.columns)):
        block.least[number[i, k]] = score
    return head.unionByName(searched(ordered.where(F.col("length") < cut)))


def _searcher(queries: Queries, corpus: Corpus, width: int, top: int, key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The best documents of every query among the batches of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(queries, top)
        id_type = None
        for batch in batches:
            if batch.num_rows:
                id_type = batch.column("doc_id").type
                best.take(Vectors(batch, corpus, width))
        if id_type is not None:
            yield best.rows(key, id_type)

    return run


class Vectors:
    """Impacts of a batch of documents, by falling length and cut into buckets."""

    def __init__(self, batch: pa.RecordBatch, corpus: Corpus, width: int) -> None:
        self.width = width
        sizes = pc.list_value_length(batch.column("terms")).to_numpy()
        counts = batch.column("counts").flatten().to_numpy().astype(np.int64)
        terms = batch.column("terms").flatten().to_numpy().astype(np.int64)
        own = np.repeat(corpus.norms(batch.column("n").to_numpy()), sizes)
        impacts = IMPACT * counts // (COUNT_WEIGHT * counts + LENGTH_WEIGHT * own)
        doc = np.repeat(np.arange(batch.num_rows), sizes)
        lengths = np.sqrt(np.bincount(doc, np.square(impacts.astype(float)), batch.num_rows)) * SLACK
        order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[order]
        self.ids = batch.column("doc_id").take(pa.array(order))
        place = np.empty(len(order), np.int64)
        place[np.asarray(pc.sort_indices(self.ids, null_placement="at_end"))] = np.arange(len(order))
        self.id_order = place
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        doc = rank[doc]
        # By document, for exact scores.
        by_doc = np.argsort(doc, kind="stable")
        self.terms, self.impacts = terms[by_doc], impacts[by_doc]
        self.starts = np.searchsorted(doc[by_doc], np.arange(len(order) + 1))
        # By bucket and term, for bounds.
        keyed = doc // BUCKET * width + terms
        by_term = np.argsort(keyed, kind="stable")
        self.keys, at = np.unique(keyed[by_term], return_index=True)
        self.ends = np.append(at, len(by_term))
        self.posted, self.posted_impacts = doc[by_term], impacts[by_term]
        self.greatest = np.maximum.reduceat(self.posted_impacts, at) if len(at) else np.zeros(0, np.int64)

    def buckets(self) -> Iterator[tuple[int, int]]:
        for low in range(0, len(self.lengths), BUCKET):
            yield low, min(low + BUCKET, len(self.lengths))

    def exact(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Scores of some documents; ``weights`` has an entry for every word of the vocabulary."""
        sizes = self.starts[docs + 1] - self.starts[docs]
        begins = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) + np.repeat(self.starts[docs] - begins, sizes)
        return np.add.reduceat(weights[self.terms[at]] * self.impacts[at], begins)


class Best:
    """The best documents so far of each query of a block, and the score that others have to reach."""

    def __init__(self, queries: Queries, top: int) -> None:
        self.queries, self.top = queries, top
        self.least = queries.least.copy()
        self.lengths = queries.lengths()
        self.listed: list[list[tuple]] = [[] for _ in range(len(queries))]
        self.weights: np.ndarray | None = None

    def take(self, vectors: Vectors) -> None:
        q = self.queries
        if self.weights is None:
            self.weights = np.zeros(vectors.width, np.int64)
        for low, high in vectors.buckets():
            keys = low // BUCKET * vectors.width + q.words
            place = np.searchsorted(vectors.keys, keys)
            place[place == len(vectors.keys)] = 0
            here = vectors.keys[place] == keys
            bounds = np.where(here, q.weights * vectors.greatest[place], 0)
            reach = np.add.reduceat(bounds, q.first[:-1])
            open_ = (self.lengths * vectors.lengths[low] >= self.least) & (reach >= self.least)
            for i in np.flatnonzero(open_):
                part = slice(q.first[i], q.first[i + 1])
                self._one(i, vectors, low, high, place[part], bounds[part])

    def _one(self, i: int, vectors: Vectors, low: int, high: int, place: np.ndarray, bounds: np.ndarray) -> None:
        q = self.queries
        part = slice(q.first[i], q.first[i + 1])
        order = np.argsort(bounds, kind="stable")
        left = np.cumsum(bounds[order])
        # Words up to here cannot reach the threshold together.
        idle = int(np.searchsorted(left, self.least[i]))
        rest = int(left[idle - 1]) if idle else 0
        rest_length = np.sqrt(np.square(q.weights[part][order[:idle]].astype(float)).sum()) * SLACK
        scores = np.zeros(high - low, np.int64)
        for at in order[idle:]:
            begin, end = vectors.ends[place[at]], vectors.ends[place[at] + 1]
            scores[vectors.posted[begin:end] - low] += q.weights[part][at] * vectors.posted_impacts[begin:end]
        bound = (scores + np.minimum(rest, rest_length * vectors.lengths[low:high])) * SLACK
        docs = np.flatnonzero((scores > 0) & (bound >= self.least[i])) + low
        if not len(docs):
            return
        self.weights[q.words[part]] = q.weights[part]
        exact = vectors.exact(docs, self.weights)
        self.weights[q.words[part]] = 0
        docs, exact = docs[exact >= self.least[i]], exact[exact >= self.least[i]]
        first = np.lexsort((vectors.id_order[docs], -exact))[: self.top]
        ids = vectors.ids.take(pa.array(docs[first])).to_pylist()
        listed = self.listed[i] + [(-int(s), d is None, d) for s, d in zip(exact[first], ids)]
        listed.sort(key=lambda row: row[:2] + ((row[2],) if not row[1] else ()))
        self.listed[i] = listed[: self.top]
        if len(self.listed[i]) == self.top:
            self.least[i] = max(self.least[i], -self.listed[i][-1][0])

    def rows(self, key: str, id_type: pa.DataType) -> pa.RecordBatch:
        sizes = [len(listed) for listed in self.listed]
        number = np.repeat(np.arange(len(sizes)), sizes)
        rows = [row for listed in self.listed for row in listed]
        return pa.RecordBatch.from_arrays(
            [self.queries.ids.take(pa.array(number)), pa.array(self.queries.keys[number]),
             pa.array([row[2] for row in rows], id_type), pa.array([-row[0] for row in rows], pa.int64())],
            [key, "text_key", "doc_id", "score"],
        )
