"""Pieces that several training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.session import configure, fresh_dir, ship_package


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark from wherever the folder lies."""
    ship_package(spark)
    # Batches by size, so that a run of long texts takes a worker no more memory than short ones.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return configure(spark).read.parquet(f"{folder}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only the id and the whole text; a null text counts as empty. Other columns cannot clash."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def held_out(doc_id: Column, modulus: int, remainder: int = 2) -> Column:
    """Whether a document is kept out of learning; a row without id never is."""
    crc = F.crc32(doc_id.cast("string").cast("binary"))
    return F.coalesce(crc % modulus == remainder, F.lit(False))


#: Folders written by the steps that are under way, innermost last.
_working: list[list[str]] = []


def working_dir(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; it goes when the ``finished`` step around it has its result."""
    path = fresh_dir(spark, label)
    if _working:
        _working[-1].append(path)
    return path


def removed_dirs(spark: SparkSession, paths: Iterable[str]) -> None:
    """Remove folders that no table in use reads."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a frame once below the shared folder and go on from its files.

    Later steps then start from files that every executor sees, so a lost executor costs no
    replay of what came before.
    """
    path = working_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def finished(spark: SparkSession, label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stored result of a step; what the step stored on its way is removed."""
    _working.append([])
    try:
        result = build()
        path = fresh_dir(spark, label)
        result.write.parquet(path)
    finally:
        removed_dirs(spark, _working.pop())
    if _working:
        _working[-1].append(path)
    return spark.read.schema(result.schema).parquet(path)


def joined_spans(spans: Column, order: list[str]) -> Column:
    """``kind:start:end`` of every span by start, then kind as listed, comma-joined."""
    ranked = F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.array_position(F.array(*map(F.lit, order)), s["kind"]).alias("rank"),
            s["end"].alias("end"), s["kind"].alias("kind"),
        ),
    )
    return F.array_join(
        F.transform(
            F.array_sort(ranked),
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column without nulls, and the offsets of its texts in them."""
    wide = column.cast(pa.large_string())
    _, offsets, data = wide.buffers()
    places = np.frombuffer(offsets, np.int64, len(wide) + 1 + wide.offset)[wide.offset :] if len(wide) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), places


_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; distinct numbers stay distinct."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Bytes of text whose words are hashed at once; what a task holds beyond it is 8 bytes a word.
SLICE = 1 << 18
#: Hashes of a byte at each of the first places of a word, which most words do not go beyond.
_BYTE_HASHES = mixed(np.arange(64 << 8, dtype=np.uint64) * _STEP + _STEP)


def word_hashes(data: np.ndarray, places: np.ndarray, byte_map: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, in order, and where each text's words begin.

    ``byte_map`` sends a byte to the byte that is hashed, 0 for bytes between words. Texts are
    hashed whole, slice by slice; a word's hash is made of a sum over its bytes, so a word of any
    length goes on from slice to slice. The second array has one entry more than there are texts.
    """
    end = int(places[-1])
    parts: list[np.ndarray] = []
    first = np.zeros(len(places), np.int64)
    found = grown = 0  # words so far, and the length so far of a word that the next slice goes on with
    for low in range(int(places[0]), end, SLICE):
        high = min(low + SLICE, end)
        mapped = byte_map[data[low:high]]
        inside = mapped != 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[0] &= not grown
        here = slice(*np.searchsorted(places, [low, high]))
        edges = places[here] - low
        begins[edges] = inside[edges]  # a word never runs on into the next text
        at = np.flatnonzero(begins)
        first[here] = found + np.searchsorted(at, edges)
        kept = np.flatnonzero(inside)
        if len(kept):
            bounds = np.searchsorted(kept, at)
            carried = int(bounds[0]) if len(at) else len(kept)
            starts = np.repeat(at, np.diff(np.append(bounds, len(kept))))
            rank = np.concatenate([kept[:carried] + grown, kept[carried:] - starts])
            # Each byte is hashed together with its place in the word.
            placed = rank << 8 | mapped[kept]
            with np.errstate(over="ignore"):
                if int(rank.max()) < len(_BYTE_HASHES) >> 8:
                    values = _BYTE_HASHES[placed]
                else:
                    values = mixed(placed.astype(np.uint64) * _STEP + _STEP)
                if carried:
                    parts[-1][-1] += np.add.reduce(values[:carried])
                if len(at):
                    parts.append(np.add.reduceat(values, bounds))
        found += len(at)
        grown = int(rank[-1]) + 1 if inside[-1] else 0
    first[np.searchsorted(places, end) :] = found
    return mixed(np.concatenate(parts)) if parts else np.zeros(0, np.uint64), first


#: Bits of the filter below, at most (16 MB once sent to the executors, whatever the data), at least, and for a key.
FILTER_BITS, LEAST_BITS, KEY_BITS = 1 << 27, 1 << 20, 64


def filter_bits(keys: int) -> int:
    """The power of two that gives each key ``KEY_BITS`` bits, within the bounds."""
    return min(FILTER_BITS, max(LEAST_BITS, 1 << (KEY_BITS * keys - 1).bit_length()))


def sifted(rows: DataFrame, key: str, wanted: DataFrame, met: bool = True) -> DataFrame:
    """Rows whose 64-bit ``key`` may be among the keys of ``wanted`` (one column, stored), or the other rows.

    The wanted keys become a bitmap, as large as their number asks for up to a fixed size, which
    every task tests, so that rows without a match need not be shuffled for a join. A full bitmap
    lets rows through; none that matches is lost.
    """
    bits = filter_bits(wanted.count())
    place = lambda column: F.pmod(F.xxhash64(column), F.lit(bits)) + 1
    number, bit = lambda c: F.bitmap_bucket_number(place(c)), lambda c: F.bitmap_bit_position(place(c))
    maps = wanted.groupBy(number(F.col(key)).alias("_part")).agg(F.bitmap_construct_agg(bit(F.col(key))).alias("_bits"))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (bit(F.col(key)) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("getbit", byte, (bit(F.col(key)) % 8).cast("int")) == 1
    joined = rows.withColumn("_part", number(F.col(key))).join(F.broadcast(maps), "_part", "inner" if met else "left")
    return joined.where(is_set if met else ~F.coalesce(is_set, F.lit(False))).drop("_part", "_bits")


def met_by(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows whose 64-bit ``key`` is among the keys of ``wanted`` (one column); other rows are not shuffled."""
    return sifted(rows, key, wanted).join(wanted.select(key).distinct(), key)


#: Longest run of equal letters that is looked for at once.
LONGEST_RUN = 1 << 16


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def few_edits(a: Column, b: Column, similarity: float, narrow: tuple[float, ...]) -> Column:
    """Whether the edit distance of two strings is at most ``1 - similarity`` of the longer one's length.

    Letters that both begin or end with are left out first, which does not change the distance:
    Spark's ``levenshtein`` walks over all pairs of letters, however narrow its band. Bands of the
    parts ``narrow`` of the allowed edits are tried before the whole.
    """
    longest, shortest = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    allowed = F.floor(longest * (1 - similarity) + 1e-9).cast("int")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(LONGEST_RUN.bit_length()))])

    def shared(t: Column, begins: Callable[[str, Column, Column], Column]) -> Column:
        """How many letters of t.a and t.b are the same, where a run that reaches on begins as given."""
        least = F.least(t["m"], t["n"])
        same = lambda at, step: F.substring(t["a"], begins("m", at, step), step) == F.substring(t["b"], begins("n", at, step), step)
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= least) & same(at, step), at + step).otherwise(at))

    def sides(a: Column, b: Column, m: Column, n: Column) -> Column:
        return F.struct(a.alias("a"), b.alias("b"), m.alias("m"), n.alias("n"), allowed.alias("allowed"))

    def headless(t: Column, k: Column) -> Column:
        return sides(F.substring(t["a"], k + 1, t["m"]), F.substring(t["b"], k + 1, t["n"]), t["m"] - k, t["n"] - k)

    def judged(t: Column, k: Column) -> Column:
        cut = F.struct(F.substring(t["a"], F.lit(1), t["m"] - k).alias("a"), F.substring(t["b"], F.lit(1), t["n"] - k).alias("b"))
        return let(cut, lambda c: within(c, t["allowed"]))

    def within(c: Column, edits: Column) -> Column:
        near = lambda band: F.call_function("levenshtein", c["a"], c["b"], band) >= 0
        tried = near(edits)
        for share in reversed(narrow):
            tried = F.when(near(F.floor(edits * share).cast("int")), True).otherwise(tried)
        return tried

    head = lambda t: shared(t, lambda size, at, step: at + 1)
    tail = lambda t: shared(t, lambda size, at, step: t[size] - at - step + 1)
    whole = let(
        sides(a, b, F.length(a), F.length(b)),
        lambda t: let(head(t), lambda k: let(headless(t, k), lambda u: let(tail(u), lambda j: judged(u, j)))),
    )
    return (longest - shortest <= allowed) & whole
