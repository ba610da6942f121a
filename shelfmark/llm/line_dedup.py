"""Fuzzy line de-duplication: SimHash blocks, edit similarity, one occurrence per connected group."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import few_edits, finished, let, met_by, sifted, stored
from shelfmark.llm.groups import crowded, similar_groups

#: Least edit similarity of two lines that count as the same.
SIMILARITY = 0.8
#: A fingerprint is cut into so many blocks; lines that agree in ``AGREE`` of them are compared.
#: Any two fingerprints that differ in at most ``BLOCKS - AGREE`` bits do.
BLOCKS, AGREE = 5, 2
#: Bits in which the fingerprints of compared lines may differ; unrelated ones differ in 32 on average.
NEARBY = 16
#: Widths of a counter; a line gets the least that its features cannot fill. None fills the last.
WIDTHS = (8, 16, 32)
#: What a line must hold to be compared.
LETTER = r"[\p{L}\p{N}]"
#: Features up to which a line is short.
SHORT = 8
#: Letters of words that are taken for common ones, at most.
COMMON_LETTERS = 4
#: Parts of the allowed edits that are tried first; most copies need no wider band.
NARROW = (0.05, 0.3)


def normalised(line: Column) -> Column:
    """Lower case, with every run of anything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def majority(hashes: Column, n: Column, whole: Column, width: int) -> Column:
    """The bits that more than half of ``n`` hashes have, counted in counters of ``width`` bits."""
    ones = sum(1 << at for at in range(0, 64, width))
    spread = lambda h, k: F.shiftrightunsigned(h, k).bitwiseAND(F.lit(ones))
    added = lambda k: lambda count, h: count + spread(h, k)
    tie = (n % 2 == 0) & (n < SHORT)
    # Raised by this, a counter reaches its second highest bit where it exceeds half the features.
    raise_by = (F.lit((1 << (width - 2)) - 1) - F.floor((n + tie.cast("int")) / 2)) * F.lit(ones)
    bits = F.lit(0).cast("bigint")
    for k in range(width):
        count = F.aggregate(hashes, F.when(tie, spread(whole, k)).otherwise(F.lit(0).cast("bigint")), added(k))
        bits = bits.bitwiseOR(F.shiftleft(F.shiftrightunsigned(count + raise_by, width - 2).bitwiseAND(F.lit(ones)), k))
    return bits


def with_simhash(lines: DataFrame) -> DataFrame:
    """Lines (``normal`` and any columns that tell them apart) with a 64-bit ``fingerprint`` for the text.

    Each bit is the majority of that bit of the features' hashes. Words of up to
    ``COMMON_LETTERS`` letters are left out: most are common words, which would make all lines
    of a language look alike. The 64 counters lie side by side in as many long numbers as a
    counter has bits, so that a feature costs that many additions in the row of its line, and no
    feature is a row. In short lines, where many bits tie, the hash of the whole line is
    counted as well if the number of features is even; it alone counts where there is none.
    """
    keys = [c for c in lines.columns if c != "normal"]
    telling = F.regexp_extract_all("normal", F.lit(f"[^ ]{{{COMMON_LETTERS + 1},}}"), F.lit(0))
    hashed = lines.select(*keys, F.xxhash64("normal").alias("_whole"), F.transform(telling, lambda w: F.xxhash64(w)).alias("_hashes"))
    n = F.size("_hashes")
    bits = majority(F.col("_hashes"), n, F.col("_whole"), WIDTHS[-1])
    for width in reversed(WIDTHS[:-1]):
        fits = n < (1 << (width - 1)) - 2
        bits = F.when(fits, majority(F.col("_hashes"), n, F.col("_whole"), width)).otherwise(bits)
    return hashed.select(*keys, bits.alias("fingerprint"))


def buckets(fingerprint: Column) -> Column:
    """One number for every choice of ``AGREE`` blocks: which blocks, and what they hold."""
    edges = [64 * k // BLOCKS for k in range(BLOCKS + 1)]
    block = lambda k: F.shiftrightunsigned(fingerprint, edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1))
    keys = []
    for number, chosen in enumerate(combinations(range(BLOCKS), AGREE)):
        value = F.lit(number).cast("bigint")
        for k in chosen:
            value = F.shiftleft(value, edges[k + 1] - edges[k]).bitwiseOR(block(k))
        keys.append(value)
    return F.array(*keys)


def near_enough(a: Column, b: Column) -> Column:
    """Whether fingerprints and lengths let two lines be alike."""
    longest, shortest = F.greatest(a["size"], b["size"]), F.least(a["size"], b["size"])
    return (F.bit_count(a["fingerprint"].bitwiseXOR(b["fingerprint"])) <= NEARBY) & (
        longest - shortest <= F.floor(longest * (1 - SIMILARITY) + 1e-9)
    )


def alike(a: Column, b: Column) -> Column:
    """Whether two normalised lines differ by at most the allowed edits."""
    return few_edits(a, b, SIMILARITY, NARROW)


def repeated_lines(docs: DataFrame) -> DataFrame:
    """Line numbers (from 0) that repeat an earlier line, per document: doc_id, doc, ``removed``.

    ``doc`` is the 64-bit hash of the text, which tells rows of one id apart. Lines with equal
    normalised text, or linked by SimHash (``AGREE`` equal blocks, at most ``NEARBY`` bits apart) and
    edit similarity, form connected groups; the occurrence with the least (doc_id, doc, line number) stays. Lines are known by the 64-bit
    hash of their normalised text. Lines without letters and digits are never removed.
    """
    split_lines = docs.select(
        "doc_id", F.xxhash64("text").alias("doc"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )
    # By the line itself: a test of the normalised text would be moved below and normalise every line twice.
    normal = split_lines.where(F.lower("line").rlike(LETTER)).select("doc_id", "doc", "line_no", F.xxhash64("line").alias("raw"), normalised(F.col("line")).alias("normal"))
    hashed = normal.withColumn("node", F.xxhash64("normal")).withColumn("size", F.length("normal"))
    lines = stored(with_simhash(hashed), "lines")
    # Rows without id come last among equals, so that any id precedes them.
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "doc", "line_no")
    known = stored(
        lines.groupBy("node").agg(
            F.min(place).alias("first"), F.max("fingerprint").alias("fingerprint"), F.max("raw").alias("raw"),
            F.max("size").alias("size"), F.count("*").alias("times"),
        ),
        "known",
    )
    trait = F.struct("fingerprint", "size").alias("trait")
    blocks = known.select("node", trait, F.explode(buckets(F.col("fingerprint"))).alias("bucket"))
    members = crowded(blocks, near_enough)
    wanted = stored(
        known.join(members.select("node").distinct(), "node", "left_semi").select("node", "raw"), "wanted"
    )
    raw_lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).select(F.xxhash64("line").alias("raw"), "line")
    found = met_by(raw_lines, "raw", wanted.select("raw")).join(wanted.select("node", "raw"), "raw")
    # A line is its raw text here; of equal ones any does.
    texts = stored(found.groupBy("node").agg(F.first(normalised(F.col("line"))).alias("normal")), "texts")

    def verify(pairs: DataFrame) -> DataFrame:
        return (
            pairs.join(texts.select(F.col("node").alias("a"), F.col("normal").alias("a_text")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("normal").alias("b_text")), "b")
            .where(alike(F.col("a_text"), F.col("b_text"))).select("a", "b")
        )

    grouped = similar_groups(members, verify, near_enough)
    placed = known.join(grouped, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = placed.where((F.col("times") > 1) | F.col("root").isNotNull())
    kept = several.groupBy("root").agg(F.min("first").alias("kept"), F.sum("times").alias("times")).where("times > 1")
    verdicts = stored(several.join(kept.select("root", "kept"), "root").select("node", "kept"), "verdicts")
    again = lines.join(verdicts, "node").where(~place.eqNullSafe(F.col("kept")))
    return again.groupBy("doc_id", "doc").agg(F.collect_set("line_no").alias("removed"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The rows with all their columns, ``text`` without repeated lines, and ``removed_lines`` beside it.

    A null text stays null and an empty one empty. Repeated rows (same id and text) count as one
    document and are treated alike. A line is what stands between line feeds. A column that is
    called ``removed_lines`` already stays, and is then there twice; ``keep_documents`` adds none.
    """
    return _deduped(docs).select(*_columns(docs), "removed_lines")


def keep_documents(docs: DataFrame) -> DataFrame:
    """The rows with their columns only; ``n_chars``, if there, follows the text.

    A document that lost lines and has no letter or digit left goes; other documents stay.
    """
    deduped = _deduped(docs)
    emptied = (F.col("removed_lines") > 0) & ~F.col("text").rlike(LETTER)
    columns = _columns(docs)
    if "n_chars" in docs.columns:
        columns[docs.columns.index("n_chars")] = F.when(F.col("removed_lines") > 0, F.length("text")).otherwise(
            F.col("row.n_chars")
        ).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return deduped.where(~F.coalesce(emptied, F.lit(False))).select(*columns)


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]


def _deduped(docs: DataFrame) -> DataFrame:
    """Each row packed as ``row``, its new ``text`` and ``removed_lines``; untouched rows are not shuffled."""
    given = docs.select("doc_id", "text").where("text IS NOT NULL")
    removed = finished(docs.sparkSession, "removed", lambda: repeated_lines(given))
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    touched = removed.select(F.col("doc").alias("hash"))
    maybe = sifted(packed, "hash", touched)
    joined = maybe.join(removed, maybe["id"].eqNullSafe(removed["doc_id"]) & (maybe["hash"] == removed["doc"]), "left").select(
        "row", "removed"
    )
    others = sifted(packed, "hash", touched, met=False)
    joined = joined.unionByName(others.select("row", F.lit(None).cast("array<int>").alias("removed")))

    def rebuilt(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed"))
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    # A text is cut once, not once for each line of it.
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(let(F.split("row.text", "\n"), rebuilt))
    return joined.select("row", text.alias("text"), F.coalesce(F.size("removed"), F.lit(0)).alias("removed_lines"))
