"""Benchmark decontamination: rare word runs as seeds, Smith-Waterman alignment as the verdict."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from shelfmark.llm.common import mixed, stored, text_bytes, word_hashes
from shelfmark.llm.order_minhash import WORD_BYTES

#: Words in a seed; items with fewer words are one seed.
SEED_WORDS = 3
#: A seed is rare if so few places would hold it by chance, were words drawn independently.
CHANCE_PLACES = 1.0
#: In every stretch of so many places of an item, the rarest seed is kept however common it is.
STRETCH = 3
#: Alignment score of an equal word, an unequal pair and a skipped word.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of an item's best possible score from which a passage counts as a copy.
LEAST_SCORE = 0.5
#: Seeds sent to the workers at once; more benchmark seeds take more passes over the documents.
SEEDS_AT_ONCE = 200_000


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(*text_bytes(column), WORD_BYTES)


def runs(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    total = np.full(len(words) - size + 1, size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            total = mixed(total + words[k : len(words) - size + 1 + k])
    return total


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item_id, key and the ``words`` (hashes) of every text of the benchmark.

    ``key`` tells the texts of one id apart; each is searched on its own.
    """
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, first = _words(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(words.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("key"), lists], ["item_id", "key", "words"])

    given = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).where("item_id IS NOT NULL").distinct()
    keyed = given.withColumn("key", F.xxhash64("item_id", "text"))
    return keyed.mapInArrow(run, f"item_id {kind}, key bigint, words array<bigint>")


def benchmark_seeds(items: DataFrame) -> DataFrame:
    """For each seed of the items its item_id, key, hash, place and words."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, seeds, places, parts = [], [], [], []
            for i, own in enumerate(batch.column("words")):
                words = own.values.to_numpy().view(np.uint64)
                size = min(SEED_WORDS, len(words))
                found = runs(words, size) if size else words
                rows.append(np.full(len(found), i))
                seeds.append(found.view(np.int64))
                places.append(np.arange(len(found), dtype=np.int32))
                parts += [words[place : place + size].view(np.int64) for place in range(len(found))]
            at = pa.array(np.concatenate(rows)) if rows else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").take(at), batch.column("key").take(at), pa.array(np.concatenate(seeds) if seeds else [], pa.int64()),
                 pa.array(np.concatenate(places) if places else [], pa.int32()), pa.array(parts, pa.list_(pa.int64()))],
                ["item_id", "key", "seed", "place", "parts"],
            )

    return items.mapInArrow(run, f"item_id {kind}, key bigint, seed bigint, place int, parts array<bigint>")


def _counter(wanted: np.ndarray):
    """Counts of the wanted words, and of all words, over batches of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(len(wanted), np.int64), 0
        for batch in batches:
            words, _ = _words(batch.column("text"))
            total += len(words)
            at = np.searchsorted(wanted, words)
            at[at == len(wanted)] = 0
            counts += np.bincount(at[wanted[at] == words], minlength=len(wanted)) if len(wanted) else 0
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([wanted[met].view(np.int64), np.zeros(1, np.int64)])),
             pa.array(np.concatenate([counts[met], [total]])), pa.array(np.arange(len(met) + 1) == len(met))],
            ["word", "n", "is_total"],
        )

    return run


def rare_seeds(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """The seeds that chance would put in at most ``CHANCE_PLACES`` places of the documents, and one per stretch.

    Word counts are taken over all documents, for the words of the benchmark. Chance goes by
    words, not by how often the run itself occurs, so a passage that very many documents copy
    keeps its seeds. Of every ``STRETCH`` places of an item the rarest seed stays, whatever the size
    of the documents, so that edited copies meet seeds all over the item. Seeds with a word that
    no document has can match nothing and are left out first.
    """
    words = seeds.select(F.explode("parts").alias("word")).distinct()
    counted = []
    for wanted in blocks(words, "word"):
        counted.append(docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
            _counter(wanted), "word bigint, n bigint, is_total boolean"
        ))
    if not counted:
        return seeds
    tallied = counted[0].groupBy("word", "is_total").agg(F.sum("n").alias("n"))
    for more in counted[1:]:
        tallied = tallied.unionByName(more.groupBy("word", "is_total").agg(F.sum("n").alias("n")))
    tallied = stored(tallied, "words")
    total = max((row["n"] for row in tallied.where("is_total").collect()), default=0) or 1
    share = tallied.where("NOT is_total").select("word", F.log(F.col("n") / F.lit(float(total))).alias("share"))
    each = seeds.select("key", "place", F.explode("parts").alias("word"))
    chance = (
        each.join(share, "word", "left").groupBy("key", "place")
        .agg((F.sum("share") + F.log(F.lit(float(total)))).alias("places"), F.bool_or(F.col("share").isNull()).alias("impossible"))
        .where("NOT impossible").withColumn("stretch", F.floor(F.col("place") / STRETCH))
    )
    rarest = chance.groupBy("key", "stretch").agg(F.min(F.struct("places", "place"))["place"].alias("rarest"))
    kept = chance.join(rarest, ["key", "stretch"]).where(
        (F.col("places") <= F.log(F.lit(CHANCE_PLACES))) | (F.col("place") == F.col("rarest"))
    )
    return seeds.join(kept.select("key", "place"), ["key", "place"])


def blocks(values: DataFrame, column: str) -> Iterator[np.ndarray]:
    """Distinct 64-bit values in sorted blocks of bounded size, one block at a time on the driver."""
    distinct = stored(values.select(column).distinct(), "values")
    parts = max(1, -(-distinct.count() // SEEDS_AT_ONCE) * 2 - 1)
    for part in range(parts):
        rows = distinct.where(F.pmod(F.xxhash64(column), F.lit(parts)) == part).toArrow()
        if rows.num_rows:
            yield np.sort(rows.column(0).to_numpy().view(np.uint64))


def smith_waterman(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment score of an item in a run of words, and the words it spans, end exclusive.

    Row by row over the item; skipping words of the text within a row is a running maximum.
    """
    n = len(words)
    steps = np.arange(n + 1) * -GAP
    score = np.zeros(n + 1, np.int64)
    begin = np.arange(n + 1)
    best, best_begin, best_end = 0, 0, 0
    for word in item:
        diagonal = score[:-1] + np.where(words == word, MATCH, MISMATCH)
        up = score[1:] + GAP
        take = diagonal >= up
        here = np.concatenate([[0], np.where(take, diagonal, up)])
        origin = np.concatenate([[0], np.where(take, begin[:-1], begin[1:])])
        fresh = here <= 0
        here[fresh] = 0
        origin[fresh] = np.flatnonzero(fresh)
        lifted = here + steps
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        score = top - steps
        begin = origin[source]
        at = int(np.argmax(score))
        if score[at] > best:
            best, best_begin, best_end = int(score[at]), int(begin[at]), at
    return best, best_begin, best_end


def _searcher(kind: pa.DataType, seeds: np.ndarray, entries: list[tuple[int, int]], start: np.ndarray, items: dict, sizes: list[int]):
    """Finds seeds in texts and aligns each item at the places its seeds point to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, first = _words(batch.column("text"))
            out: list[tuple] = []
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                own = words[first[i] : first[i + 1]]
                out += [(doc, *hit) for hit in _hits(own, seeds, entries, start, items, sizes)]
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], batch.column("doc_id").type), pa.array(columns[1], kind),
                 pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())],
                ["doc_id", "item_id", "score", "first_word", "end_word"],
            )

    return run


def _hits(own: np.ndarray, seeds: np.ndarray, entries: list, start: np.ndarray, items: dict, sizes: list[int]) -> list[tuple]:
    """Best alignment per item, over all its texts: (item, score, first word, end word) from ``LEAST_SCORE`` on."""
    origins: dict[int, set[int]] = {}
    for size in sizes:
        found = runs(own, size)
        at = np.searchsorted(seeds, found)
        at[at == len(seeds)] = 0
        for where in np.flatnonzero(seeds[at] == found):
            for key, place in entries[start[at[where]] : start[at[where] + 1]]:
                origins.setdefault(key, set()).add(int(where) - place)
    hits: dict[object, tuple] = {}
    for key, begins in sorted(origins.items()):
        item, words = items[key]
        margin = len(words)
        best = (0.0, 0, 0)
        # Places that point to overlapping stretches are aligned in one go.
        low = high = None
        for begin in [*sorted(begins), None]:
            if low is not None and (begin is None or begin - margin > high):
                a, b = max(0, low), min(len(own), high)
                # No score exceeds that of all words the stretch holds; common seeds mostly end here.
                if np.isin(words, own[a:b]).sum() >= LEAST_SCORE * len(words):
                    score, s, e = smith_waterman(words, own[a:b])
                    best = max(best, (score / (MATCH * len(words)), a + s, a + e), key=lambda x: x[0])
                low = None
            if begin is not None:
                low = begin - margin if low is None else low
                high = begin + 2 * margin
        if best[0] >= LEAST_SCORE:
            hits[item] = max(hits.get(item, best), best, key=lambda x: (x[0], -x[1], -x[2]))
    return [(item, *hits[item]) for item in sorted(hits)]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold a copy of a benchmark item: doc_id, item_id, score, first_word, end_word.

    Rare seeds of an item find the passages; a passage counts if its local alignment reaches
    ``LEAST_SCORE`` of the item's best possible score, so edited copies count as well. One row
    per document and item, with the best passage (words counted from 0, end exclusive). Null texts, texts and items without words and rows of the
    benchmark without id match nothing; repeated rows repeat; an item text that occurs under
    several ids is reported under each, and of several texts under one id each is searched. Other columns are not read.
    """
    ids = {name: frame.schema[name].dataType.simpleString() for frame, name in ((docs, "doc_id"), (benchmark, "item_id"))}
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    items = stored(benchmark_items(benchmark), "items")
    seeds = stored(rare_seeds(texts, stored(benchmark_seeds(items), "seeds")), "rare")
    kind = to_arrow_type(benchmark.schema["item_id"].dataType)
    schema = f"doc_id {ids['doc_id']}, item_id {ids['item_id']}, score double, first_word bigint, end_word bigint"
    passes = []
    for block in item_blocks(seeds, items):
        passes.append(texts.mapInArrow(_searcher(kind, *block), schema))
    if not passes:
        return docs.sparkSession.createDataFrame([], schema)
    found = passes[0]
    for more in passes[1:]:
        found = found.unionByName(more)
    return found


def item_blocks(seeds: DataFrame, items: DataFrame) -> Iterator[tuple]:
    """The rare seeds of a bounded number of items at a time, as sorted arrays for the workers, and the words of those items once each."""
    parts = max(1, -(-seeds.count() // SEEDS_AT_ONCE) * 2 - 1)
    for part in range(parts):
        chosen = F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part
        table = seeds.where(chosen).select("seed", "key", "place", F.size("parts").alias("size")).toArrow()
        if not table.num_rows:
            continue
        listed = sorted(zip(*[column.to_pylist() for column in table.columns]), key=lambda r: (r[0] % (1 << 64), r[2]))
        values = np.array([row[0] for row in listed], np.int64).view(np.uint64)
        seeds_at, start = np.unique(values, return_index=True)
        held = items.where(chosen).toArrow()
        words = {
            key: (item, own.values.to_numpy().view(np.uint64))
            for key, item, own in zip(held["key"].to_pylist(), held["item_id"].to_pylist(), held["words"])
        }
        yield seeds_at, [(row[1], row[2]) for row in listed], np.append(start, len(listed)), words, sorted({row[3] for row in listed})


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows, with all their columns, whose text holds no copy of a benchmark item."""
    at, clean = docs.columns.index("text"), docs
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    items = stored(benchmark_items(benchmark), "items")
    seeds = stored(rare_seeds(texts, stored(benchmark_seeds(items), "seeds")), "rare")
    for block in item_blocks(seeds, items):
        clean = clean.mapInArrow(_cleaner(at, *block), docs.schema)
    return clean


def _cleaner(at: int, *block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, first = _words(batch.column(at).fill_null(""))
            clean = [not _hits(words[first[i] : first[i + 1]], *block) for i in range(batch.num_rows)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run
