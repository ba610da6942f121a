"""Document fingerprints by spot signatures: content words that follow common words."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.llm.common import id_and_text, stored
from shelfmark.llm.groups import crowded, similar_groups

# Common words of English, French, Spanish and German that open a chain. Words of
# one or two letters open one as well, which serves other languages in Latin letters.
COMMON = (
    "the and that this with from for was were are have has not but they you which their will would there been "
    "les des une est que qui dans pour par sur avec pas plus elle ils nous vous sont mais ont aux ses cette "
    "los las del por con para una como pero sus más este esta son muy sin sobre también hay fue "
    "der die das und den dem ein eine einer eines ist nicht mit sich auf für von auch als wie bei aus nach oder"
).split()
def _opening() -> str:
    """Pattern of a common word after a blank; words are grouped by their first two letters to be tried fast."""
    groups: dict[str, dict[str, list[str]]] = {}
    for word in sorted(set(COMMON)):
        groups.setdefault(word[0], {}).setdefault(word[1], []).append(word[2:])
    firsts = [
        f"{a}(?:" + "|".join(f"{b}(?:{'|'.join(rests)})" for b, rests in seconds.items()) + ")" for a, seconds in groups.items()
    ]
    return rf" (?:\p{{L}}{{1,2}}(?= )|(?:{'|'.join(firsts)})(?= ))"


OPENING = _opening()
#: Content words in a chain.
CHAIN = 2
#: Least likeness of near duplicates.
SIMILARITY = 0.8


def signatures(text: Column) -> Column:
    """Sorted distinct 32-bit hashes of the chains of a text.

    Words are runs of letters and digits in lower case. Each common word opens a chain of the
    next ``CHAIN`` words that are not common. A text without a single chain takes every word
    as the opening of one, and if it has fewer words than that, all its words as one chain; a
    text without words has no signature.
    """
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    more = r"(?: \x01)* [^ \x01]+"

    def chains_of(w: Column) -> Column:
        marked = F.regexp_replace(w, OPENING, " \u0001")
        return F.regexp_extract_all(marked, F.lit(rf"\x01(?=( [^ \x01]+(?:{more}){{{CHAIN - 1}}}))"), F.lit(1))

    def otherwise(w: Column) -> Column:
        plain = F.regexp_extract_all(w, F.lit(rf"(?= ([^ ]+(?: [^ ]+){{{CHAIN}}}) )"), F.lit(1))
        return F.when(F.size(plain) > 0, plain).otherwise(F.filter(F.array(F.trim(w)), lambda x: x != ""))

    # Through arrays of one, so that words and chains are worked out once.
    taken = once(words, lambda w: once(chains_of(w), lambda found: F.when(F.size(found) > 0, found).otherwise(otherwise(w))))
    return F.array_sort(F.array_distinct(F.transform(taken, lambda c: F.hash(F.regexp_replace(c, "[ \x01]+", " ")))))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a costly value once for an expression that reads it several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fingerprint(signs: Column) -> Column:
    """The signatures as one string of eight hexadecimal digits each."""
    return F.array_join(
        F.transform(signs, lambda s: F.lpad(F.lower(F.hex(s.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), ""
    )


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two signature sets; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        both / (F.size(a) + F.size(b) - both)
    )


def surely_alike(a: Column, b: Column, least: float) -> Column:
    """Whether the likeness reaches ``least``; sets whose sizes rule it out are not compared."""
    fits = F.least(F.size(a), F.size(b)) >= F.greatest(F.size(a), F.size(b)) * least - 1e-9
    return fits & (likeness(a, b) >= least - 1e-12)


def followers(docs: DataFrame) -> DataFrame:
    """The order of the documents: doc_id, doc, ``prev_id``, ``prev_doc`` and the prev's ``prev_chars``.

    Ascending doc_id (rows without id last), then text hash; the last is followed by the first.
    The ids are dealt into ranges; neighbours are looked up inside a range, and the first and
    last rows of the ranges, one each, link the ranges.
    """
    keys = docs.groupBy("late", "doc_id", "doc").agg(F.max("n_chars").alias("n_chars"))
    ranged = stored(keys.repartitionByRange("late", "doc_id", "doc").withColumn("part", F.spark_partition_id()), "order")
    inside = W.partitionBy("part").orderBy("late", "doc_id", "doc")
    row = F.struct("late", "doc_id", "doc", "n_chars")
    last = ranged.groupBy("part").agg(F.max(row).alias("last"))
    # One row per range: the last row of the range before, round the end to the first.
    parts = W.orderBy("part")
    ends = last.select(
        "part", F.lag("last").over(parts).alias("before"),
        F.last("last").over(parts.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("very_last"),
    )
    linked = ranged.withColumn("own", F.lag(row).over(inside)).join(ends, "part")
    prev = F.coalesce("own", "before", "very_last")
    return linked.select(
        "late", "doc_id", "doc", prev["late"].alias("prev_late"), prev["doc_id"].alias("prev_id"),
        prev["doc"].alias("prev_doc"), prev["n_chars"].alias("prev_chars"),
    )


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document beside its edited text and its follower, by fingerprint.

    The edited text is the text whose last quarter of code points (rounded down) is replaced by
    the first as many of the next document (all, if it has fewer). Columns: doc_id, n_chars,
    edited, signs, edited_signs, next_signs. A null text counts as empty. Repeated rows (same id
    and text) are one document in the order and have equal results. Only doc_id and text are read.
    """
    given = id_and_text(docs).select(
        F.col("doc_id").isNull().alias("late"), "doc_id", F.xxhash64("text").alias("doc"),
        F.length("text").cast("bigint").alias("n_chars"), "text",
    )
    texts = given.select("late", "doc_id", "doc", "text")
    order = stored(followers(given), "followers")
    same_row = lambda a, b: [a["late"] == b["late"], a["doc_id"].eqNullSafe(b["doc_id"]), a["doc"] == b["doc"]]
    once = order.alias("o").join(texts.alias("t"), [
        F.col("o.late") == F.col("t.late"), F.col("o.doc_id").eqNullSafe(F.col("t.doc_id")), F.col("o.doc") == F.col("t.doc"),
    ])
    heads = once.select(
        F.col("prev_late").alias("late"), F.col("prev_id").alias("doc_id"), F.col("prev_doc").alias("doc"),
        F.substring(F.col("t.text"), F.lit(1), F.floor(F.col("prev_chars") / 4).cast("int")).alias("head"),
        signatures(F.col("t.text")).alias("next_signs"),
    ).groupBy("late", "doc_id", "doc").agg(F.first("head").alias("head"), F.first("next_signs").alias("next_signs"))
    n_chars = F.length("text")
    kept = F.substring(F.col("text"), F.lit(1), (n_chars - F.floor(n_chars / 4)).cast("int"))
    joined = texts.join(heads, same_row(texts, heads)).select(texts["doc_id"], "text", "head", "next_signs")
    edited = joined.select(
        "doc_id", n_chars.cast("bigint").alias("n_chars"), F.concat(kept, "head").alias("edited"),
        signatures(F.col("text")).alias("signs"), "next_signs",
    )
    return edited.withColumn("edited_signs", signatures(F.col("edited")))


def digest(rows: DataFrame) -> DataFrame:
    """Fingerprints, hashes and likenesses of ``edited_fingerprints`` rows."""
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("signs")).alias("fingerprint"), fingerprint(F.col("edited_signs")).alias("edited_fingerprint"),
        likeness(F.col("signs"), F.col("edited_signs")).alias("near_edited"),
        likeness(F.col("signs"), F.col("next_signs")).alias("near_next"),
    )


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id and ``class_id``: connected groups of texts whose signature sets are at least ``least`` alike.

    Sets are partitioned by length, so that alike sets lie in one partition or in neighbouring
    ones. A set is found by its rarest signatures, of which alike sets share at least one; pairs
    whose lengths rule the likeness out are not compared. Equal sets are one node.
    """
    signed = stored(
        id_and_text(docs).select("doc_id", signatures(F.col("text")).alias("signs")).withColumn(
            "node", F.unhex(F.md5(fingerprint(F.col("signs"))))
        ),
        "signs",
    )
    sets = signed.groupBy("node").agg(F.first("signs").alias("signs")).where(F.size("signs") > 0)
    each = sets.select("node", F.size("signs").alias("n"), F.explode("signs").alias("sign"))
    ranked = each.join(each.groupBy("sign").agg(F.count("*").alias("df")), "sign").withColumn(
        "rarity", F.row_number().over(W.partitionBy("node").orderBy("df", "sign"))
    )
    rare = ranked.where(F.col("rarity") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
    length = F.floor(F.log("n") / math.log(1 / least)).cast("int")
    members = rare.select(
        "node", F.explode(F.array(length, length + 1)).alias("part"), "sign"
    ).select("node", F.xxhash64("part", "sign").alias("bucket"))

    def verify(pairs: DataFrame) -> DataFrame:
        return (
            pairs.join(sets.select(F.col("node").alias("a"), F.col("signs").alias("a_signs")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("signs").alias("b_signs")), "b")
            .where(surely_alike(F.col("a_signs"), F.col("b_signs"), least)).select("a", "b")
        )

    placed = signed.join(similar_groups(crowded(members), verify), "node", "left").withColumn("root", F.coalesce("root", "node"))
    return placed.join(placed.groupBy("root").agg(F.min("doc_id").alias("class_id")), "root").select("doc_id", "class_id")
