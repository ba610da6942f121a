"""Redaction and log-line columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark import vocab
from shelfmark.functions import urls

# The white space that ends a secret, and the three redaction patterns.
SPACE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SECRET_ASSIGNMENT = (
    rf"(?i)(authorization|cookie|password|secret|token|api[_-]?key)([{SPACE}]*[:=][{SPACE}]*)([^{SPACE},;]+)"
)
BEARER = rf"(?i)\bBearer[{SPACE}]+[^{SPACE},;]+"
URL_IN_TEXT = rf"https?://[^{SPACE}\]\[)(}}{{<>\"']+"

EVENT_LINE = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[^ ]*)Z (DEBUG|INFO|WARNING|ERROR|CRITICAL) ([^ ]+)(?: (.*))?$"
INGEST_LINE = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[^ ]*) (START|FAILED|SUCCEEDED)(?: (.*))?$"
BEFORE_FIELD = r"\s(?=\w+=)"


def clean_url(u: Column) -> Column:
    """A parsed URL without user data, query and fragment, its host in lower case."""
    number = urls.port(u)
    shown_port = F.when(number.isNull(), F.lit("")).otherwise(F.concat(F.lit(":"), number.cast("string")))
    return F.when(
        urls.port_is_valid(u), F.concat(u["scheme"], F.lit("://"), u["host"], shown_port, u["raw_path"])
    ).otherwise(F.lit("<redacted-url>"))


def redact(text: Column, bearer_first: bool = False) -> Column:
    """Text with likely credentials removed.

    Assignments of secret names lose their value, bearer tokens are masked, and every
    http(s) URL keeps only scheme, host, port and path. By default assignments go first,
    as the catalog always did it; that leaves the token of a free-text
    ``Authorization: Bearer x`` behind, which ``bearer_first`` avoids.
    """
    def assignments(column: Column) -> Column:
        return F.regexp_replace(column, SECRET_ASSIGNMENT, "$1$2<redacted>")

    def bearers(column: Column) -> Column:
        return F.regexp_replace(column, BEARER, "Bearer <redacted>")

    def without_url_details(masked: Column) -> Column:
        between = F.split(masked, URL_IN_TEXT, -1)
        found = F.transform(F.regexp_extract_all(masked, F.lit(URL_IN_TEXT), F.lit(0)), urls.parse)
        woven = F.zip_with(
            between, F.transform(found, clean_url), lambda piece, url: F.concat(piece, F.coalesce(url, F.lit("")))
        )
        # Most texts hold no URL at all, and then the masked text is the whole answer.
        return F.when(masked.contains("://"), F.array_join(woven, "")).otherwise(masked)

    return bound(assignments(bearers(text)) if bearer_first else bearers(assignments(text)), without_url_details)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a costly value once and hand it to an expression that reads it several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def redact_fields(fields: Column) -> Column:
    """Event fields: secret names lose the whole value, other values are redacted."""
    return F.transform_values(
        fields,
        lambda key, value: F.when(F.lower(key).isin(vocab.SENSITIVE_FIELDS), F.lit("<redacted>")).otherwise(redact(value)),
    )


def safe_configuration(fields: Column) -> Column:
    """Configuration entries that may be logged, redacted and ordered by key."""
    kept = F.map_filter(fields, lambda key, value: key.isin(vocab.SAFE_CONFIGURATION_KEYS))
    return F.map_from_entries(F.array_sort(F.map_entries(F.transform_values(kept, lambda key, value: redact(value)))))


def render_fields(fields: Column) -> Column:
    """Fields as ``key=value`` pairs in key order."""
    return F.array_join(
        F.transform(F.array_sort(F.map_entries(fields)), lambda entry: F.concat(entry["key"], F.lit("="), entry["value"])),
        " ",
    )


def size_label(size: Column) -> Column:
    """Human-readable size; a dash where the size is unknown. Halves round to the even digit."""
    amount = size.cast("double")
    label = F.when(size.isNull(), F.lit("-")).when(amount < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for power, unit in enumerate(["KB", "MB", "GB", "TB"], start=1):
        scaled = amount / float(1024**power)
        label = label.when(scaled < 1024, F.format_string(f"%.1f {unit}", F.bround(scaled, 1)))
    return label.otherwise(F.format_string("%.1f PB", F.bround(amount / float(1024**5), 1)))
