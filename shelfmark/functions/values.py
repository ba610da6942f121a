"""Columns over modality and alias lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark import vocab


# The characters stripped from both ends of user input.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(value: Column | str) -> Column:
    return F.btrim(value, F.lit(BLANKS))


def vocabulary_array(values: list[str]) -> Column:
    return F.array(*[F.lit(value) for value in values])


def normalized_modalities(values: Column) -> Column:
    """Trimmed lower-case modality names, each once, in order."""
    return F.array_sort(F.array_distinct(F.transform(values, lambda v: F.lower(strip(v)))))


def unknown_modalities(values: Column) -> Column:
    return F.array_except(normalized_modalities(values), vocabulary_array(vocab.MODALITIES))


def merged_modalities(stored: Column, added: Column) -> Column:
    """Ordered union of stored and added modalities without empty names."""
    return F.array_sort(F.array_remove(F.array_union(stored, normalized_modalities(added)), ""))


def has_blank(values: Column) -> Column:
    return F.exists(values, lambda v: strip(v) == "")


def normalized_aliases(values: Column, canonical: Column | None = None) -> Column:
    """Trimmed aliases in given order: the first spelling stays, the canonical name goes."""
    trimmed = F.transform(values, lambda v: strip(v))
    folded = F.transform(trimmed, lambda v: F.lower(v))
    keys = F.array_distinct(folded)
    if canonical is not None:
        keys = F.filter(keys, lambda key: ~key.eqNullSafe(F.lower(canonical)))
    return F.transform(keys, lambda key: F.get(trimmed, (F.array_position(folded, key) - 1).cast("int")))
