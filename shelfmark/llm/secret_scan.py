"""Secret scan: fixed patterns plus sliding-window entropy, all in built-in column functions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import id_and_text, joined_spans

# The three base patterns. A run of at least 24 (20) characters of one class is a
# whole leftmost match of the open-ended pattern, so those two carry their length themselves.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_VALUE = 6

BASE_KINDS = ["assign", "access", "hex"]
# Kinds the method adds: the class of the candidate string.
ENTROPY_KINDS = ["hex_entropy", "base64_entropy"]
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"
WINDOW = 20
#: Least bits per character of a window, by class of the candidate string.
HEX_BITS, BASE64_BITS = 3.0, 3.7
# Strings that look random but are known not to be secrets: numbers, plain words and identifiers
# without digits, UUIDs, and the placeholders that documentation uses.
ALLOWED = [
    r"^[0-9_+/-]+$",
    r"^[A-Za-z_+/-]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|changeme|dummy|your[_-]|xxxx|0123456789|abcdefgh",
]

#: Matches that are placed one after another in one pass; longer rows are placed block by block.
BLOCK = 256
_SPAN = "array<struct<start:bigint,end:bigint,kind:string,value:string>>"
_SCALE = 1 << 20


def found_spans(text: Column, pattern: str, kind: str, value_group: int = 0) -> Column:
    """Spans of all leftmost non-overlapping matches, counted in code points, end exclusive."""
    pieces = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else whole
    steps = F.arrays_zip(
        F.transform(pieces, F.length).alias("gap"), F.transform(whole, F.length).alias("size"), value.alias("value")
    )

    # The piece after the last match has no match beside it.
    matched = F.filter(steps, lambda x: x["size"].isNotNull())

    def placed(begin: Column, block: Column) -> Column:
        def step(state: Column, x: Column) -> Column:
            start = state["at"] + x["gap"]
            end = start + x["size"]
            span = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))
            return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

        return F.aggregate(block, F.struct(begin.alias("at"), F.array().cast(_SPAN).alias("spans")), step)["spans"]

    def in_blocks(all_steps: Column) -> Column:
        """Where each block begins is a running sum over blocks, so no array grows beyond the square root of many matches by much."""
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(all_steps) - 1) / BLOCK).cast("int")), lambda b: F.slice(all_steps, b * BLOCK + 1, F.lit(BLOCK))
        )

        def begins(given: Column) -> Column:
            total = lambda block: F.aggregate(block, F.lit(0).cast("bigint"), lambda n, x: n + x["gap"] + x["size"])
            start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("all"))
            return F.aggregate(
                given, start, lambda s, block: F.struct((s["at"] + total(block)).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all"))
            )["all"]

        return _bound(blocks, lambda given: F.flatten(F.zip_with(given, begins(given), lambda block, at: placed(at, block))))

    return F.when(text.rlike(pattern), _bound(matched, in_blocks)).otherwise(F.array().cast(_SPAN))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _weights(window: int) -> Column:
    """``c * log2(c)`` for every count a window can hold, as scaled integers, so that sums are exact."""
    return F.array(*[F.lit(round(c * math.log2(c) * _SCALE) if c else 0).cast("bigint") for c in range(window + 1)])


def hot_range(value: Column, least_bits: Column, window: int = WINDOW) -> Column:
    """First start and last end of the windows of a string whose entropy reaches ``least_bits``.

    One pass keeps a count per character and the sum of ``c log c``. Its steps are characters that
    leave and characters that enter the window, which change one count each; nothing is looked up
    by position in the string. Null fields where no window reaches the bound.
    """
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    weights = _weights(window)

    def changes(entering: Column) -> Column:
        leaving = F.concat(F.array_repeat(F.lit(0), window), entering)
        pairs = F.zip_with(entering, F.slice(leaving, 1, F.size(entering)), lambda e, x: F.array(
            F.struct(x.alias("code"), F.lit(-1).alias("by")), F.struct(e.alias("code"), F.lit(1).alias("by"))
        ))
        return F.filter(F.flatten(pairs), lambda x: x["code"] > 0)

    def step(state: Column, x: Column) -> Column:
        before = F.get(state["counts"], x["code"])
        total = state["total"] + F.get(weights, before + x["by"]) - F.get(weights, before)
        counts = F.concat(
            F.slice(state["counts"], F.lit(1), x["code"]), F.array(before + x["by"]), F.slice(state["counts"], x["code"] + 2, F.lit(len(ALPHABET)))
        )
        at = state["at"] + F.when(x["by"] > 0, 1).otherwise(0)
        hot = (x["by"] > 0) & (at >= window) & (total <= state["most"])
        return F.struct(
            state["most"].alias("most"), counts.alias("counts"), total.alias("total"), at.alias("at"),
            F.coalesce(state["first"], F.when(hot, at - window)).alias("first"), F.when(hot, at).otherwise(state["last"]).alias("last"),
        )

    begin = F.struct(
        ((math.log2(window) - least_bits) * window * _SCALE).cast("bigint").alias("most"),
        F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"), F.lit(0).cast("bigint").alias("total"), F.lit(0).alias("at"),
        F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"),
    )
    return _bound(
        F.aggregate(_bound(codes, changes), begin, step), lambda end: F.struct(end["first"].alias("first"), end["last"].alias("last"))
    )


def entropy_spans(text: Column) -> Column:
    """Spans of candidate strings, cut to their high-entropy windows, without allow-listed ones."""
    found = found_spans(text, CANDIDATE, "")
    kept = F.filter(found, lambda s: ~_any(s["value"].rlike(pattern) for pattern in ALLOWED))

    def judged(s: Column) -> Column:
        is_hex = s["value"].rlike(r"^[0-9a-fA-F]+$")
        hot = hot_range(s["value"], F.when(is_hex, F.lit(HEX_BITS)).otherwise(F.lit(BASE64_BITS)))
        return F.transform(
            F.array(hot),
            lambda h: F.struct(
                (s["start"] + h["first"]).alias("start"), (s["start"] + h["last"]).alias("end"),
                F.when(is_hex, F.lit(ENTROPY_KINDS[0])).otherwise(F.lit(ENTROPY_KINDS[1])).alias("kind"),
                s["value"].alias("value"),
            ),
        )

    return F.filter(F.flatten(F.transform(kept, judged)), lambda s: s["start"].isNotNull())


def _any(tests) -> Column:
    tests = list(tests)
    result = tests[0]
    for test in tests[1:]:
        result = result | test
    return result


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Secrets of every whole text: doc_id, ``base`` and ``added`` arrays of (start, end, kind, value).

    ``base`` holds the pattern matches. ``added`` holds high-entropy strings that no base span
    covers. Offsets count code points. A null or empty text has two empty arrays; each row is
    scanned by itself, so repeated rows give repeated results; columns other than doc_id and
    text are not read.
    """
    text = F.col("text")
    assign = F.filter(found_spans(text, ASSIGN, "assign", 2), lambda s: F.length(s["value"]) >= ASSIGN_VALUE)
    base = F.concat(assign, found_spans(text, ACCESS, "access"), found_spans(text, HEX, "hex"))
    scanned = id_and_text(docs).select("doc_id", base.alias("base"), entropy_spans(text).alias("candidates"))
    uncovered = F.filter(
        F.col("candidates"),
        lambda c: ~F.exists(F.col("base"), lambda b: (b["start"] <= c["start"]) & (c["end"] <= b["end"])),
    )
    return scanned.select("doc_id", "base", uncovered.alias("added"))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and joined spans of ``scan_secrets`` rows."""
    count = lambda kind: F.size(F.filter(F.col("base"), lambda s: s["kind"] == kind)).cast("bigint")
    kinds = BASE_KINDS + ENTROPY_KINDS
    return scanned.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(joined_spans(F.col("base"), kinds), 256).alias("base_sha256"),
        joined_spans(F.concat("base", "added"), kinds).alias("spans"),
    )
