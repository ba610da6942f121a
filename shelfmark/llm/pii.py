"""Personal data: fixed patterns, and a character BiLSTM-CRF that adds spans the patterns miss."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import id_and_text, joined_spans
from shelfmark.llm.sequence_tagger import Tagger, symbols

KINDS = ["email", "ip", "card", "phone"]
# The base patterns. An e-mail is found from its @ outwards and an address only at
# the start of a run of digits; both give the same matches, in time linear in the text.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Every kind has one of these, so windows are laid around them only.
TRIGGER = re.compile(r"[0-9@]|[\[(]at[\])]")
#: Characters of a window, of the overlap of neighbouring ones, and around a trigger.
WINDOW, OVERLAP, AROUND = 96, 48, 24
#: Documents that labelled windows are taken from, at most (least id hashes), windows taken, and
#: windows with made-up data in given text.
SAMPLE_DOCS, SAMPLE_WINDOWS, MADE_WINDOWS = 6000, 1500, 1200
#: Windows that are decoded at once.
AT_ONCE = 2048


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Pattern matches that pass their checks, as (start, end, kind)."""
    found = [(a, b, "email") for a, b in emails(text)]
    if TRIGGER.search(text):
        found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if is_ip(m[0])]
        found += [(m.start(), m.end(), "card") for m in CARD.finditer(text) if is_card(m[0])]
        found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return found


def is_ip(value: str) -> bool:
    # Zeros before a part do not count, however many there are.
    return all(len(own := part.lstrip("0")) <= 3 and int(own or "0") <= 255 for part in value.split("."))


def is_card(value: str) -> bool:
    return 14 <= len(digits := digits_of(value)) <= 19 and luhn(digits)


def _parts_of_ip(value: str) -> bool:
    parts = re.findall(r"[0-9]+", value)
    return len(parts) == 4 and all(len(part) <= 3 and int(part) <= 255 for part in parts)


# What a span that the tagger proposes must look like to be added: the checks of the base rules,
# but other letters, blanks and separators, and phone numbers without a country's sign.
PLAUSIBLE = {
    "email": lambda s: re.fullmatch(r"[^\s@]+ ?(?:@|\[at\]|\(at\)) ?[^\s@]+(?:\.| ?\[dot\] ?)[^\s@.,;]+", s) is not None,
    "ip": lambda s: re.fullmatch(r"[0-9]{1,3}(?:(?: ?\. ?|\[\.\]|, )[0-9]{1,3}){3}", s) is not None and _parts_of_ip(s),
    "card": lambda s: re.fullmatch(r"[0-9][0-9 ./-]+[0-9]", s) is not None and is_card(s),
    "phone": lambda s: re.fullmatch(r"[+(]{0,2}[0-9][0-9 ()./-]+[0-9]", s) is not None and 10 <= len(digits_of(s)) <= 15
    and len(re.findall(r"[ ()./-]+", s)) in range(1, 6),
}


def windows(text: str) -> list[tuple[int, int]]:
    """Overlapping windows over every zone around trigger characters, as (start, end)."""
    zones: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if zones and a <= zones[-1][1]:
            zones[-1][1] = b
        else:
            zones.append([a, b])
    return [
        (start, min(start + WINDOW, b))
        for a, b in zones for start in range(a, max(a + 1, b - OVERLAP), WINDOW - OVERLAP)
    ]


def tag_numbers(start: int, end: int, spans: list[tuple[int, int, str]]) -> np.ndarray:
    """Begin and inside tags of a window: 0 outside, 2k+1 begins kind k, 2k+2 goes on."""
    tags = np.zeros(WINDOW, np.int64)
    for a, b, kind in spans:
        if a < end and b > start:
            k = KINDS.index(kind)
            tags[max(a, start) - start : min(b, end) - start] = 2 * k + 2
            if a >= start:
                tags[a - start] = 2 * k + 1
    return tags


def spans_of(tags: np.ndarray, offset: int) -> list[tuple[int, int, str]]:
    """Spans of a run of tags; an inside tag without a beginning begins one."""
    spans, k = [], 0
    while k < len(tags):
        if tags[k]:
            kind, end = (tags[k] - 1) // 2, k + 1
            while end < len(tags) and tags[end] == 2 * kind + 2:
                end += 1
            spans.append((offset + k, offset + end, KINDS[kind]))
            k = end
        else:
            k += 1
    return spans


def reconciled(laid: list[tuple[int, int]], tags: list[np.ndarray]) -> list[tuple[int, int, str]]:
    """Spans of a whole text: each character takes its tag from the window it lies deepest in."""
    spans: list[tuple[int, int, str]] = []
    zone: list[tuple[int, int, np.ndarray]] = []
    for (a, b), own in [*zip(laid, tags), ((1 << 62, 0), None)]:
        if zone and a >= zone[-1][1]:
            low, high = zone[0][0], max(z[1] for z in zone)
            depth, chosen = np.full(high - low, -1), np.zeros(high - low, np.int64)
            for start, end, given in zone:
                at = np.arange(end - start)
                edge = np.full(end - start, WINDOW)  # the ends of a zone are no cuts
                deep = np.minimum(at if start > low else edge, at[::-1] if end < high else edge)
                part = slice(start - low, end - low)
                better = deep > depth[part]
                depth[part][better] = deep[better]
                chosen[part][better] = given[: end - start][better]
            spans += spans_of(chosen, low)
            zone = []
        if own is not None:
            zone.append((a, b, own))
    return spans


class Maker:
    """Made-up personal data: of every kind forms that the base rules find, and forms that they miss."""

    def __init__(self, draw: np.random.Generator) -> None:
        self.draw = draw

    def number(self, size: int) -> str:
        return "".join(str(d) for d in self.draw.integers(0, 10, size))

    def word(self, size: int) -> str:
        return "".join(chr(97 + d) for d in self.draw.integers(0, 26, size))

    def one(self, *choices: str) -> str:
        return choices[int(self.draw.integers(0, len(choices)))]

    def value(self, kind: str, missed: bool) -> str:
        return getattr(self, kind)(missed)

    def email(self, missed: bool) -> str:
        name = self.one(f"{self.word(5)}.{self.number(2)}", self.word(7), f"{self.word(1)}{self.number(3)}", f"{self.word(4)}.{self.word(6)}")
        host, end = self.word(int(self.draw.integers(3, 9))), self.one("com", "org", "net", "de", "example")
        if not missed:
            return f"{name}@{host}.{end}"
        form = self.one("{n} @ {h}.{e}", "{n}[at]{h}.{e}", "{n} (at) {h}.{e}", "{n}[at]{h}[dot]{e}", "{n}@{h}\u00e4{h}.{e}")
        return form.format(n=name, h=host, e=end)

    def ip(self, missed: bool) -> str:
        return (self.one(" . ", "[.]", ", ") if missed else ".").join(str(v) for v in self.draw.integers(0, 256, 4))

    def card(self, missed: bool) -> str:
        body = self.number(15)
        digits = next(v for d in "0123456789" if luhn(v := body + d))
        return (self.one(".", "/", "  ") if missed else self.one("", "-", " ")).join(digits[k : k + 4] for k in range(0, 16, 4))

    def phone(self, missed: bool) -> str:
        area, first, last = self.number(3), self.number(3), self.number(4)
        if not missed:
            return self.one("+", "+1", "+4") + self.number(1) + self.one(f" ({area}) {first}-{last}", f" {area} {first} {last}", f"-{area}-{first}-{last}")
        return self.one(f"({area}) {first}-{last}", f"0{area}/{first}{last}", f"00{self.number(2)} {area} {first}{last}", f"0{area} {first} {last}-{self.number(2)}")

    def other(self) -> str:
        """What looks like data and is none."""
        day = f"20{self.number(2)}-{self.draw.integers(1, 13):02d}-{self.draw.integers(1, 29):02d}"
        return self.one(
            self.number(int(self.draw.integers(1, 9))), "".join("0123456789abcdef"[d] for d in self.draw.integers(0, 16, 40)), day,
            f"{day} {self.number(2)}:{self.number(2)}:{self.number(2)}", f"{self.number(1)},{self.number(3)}.{self.number(2)}",
            f"{self.number(1)}.{self.number(2)}.{self.number(1)}", f"{self.number(2)}/{self.number(2)}/{self.number(4)}", f"@{self.word(6)}",
            f"{self.number(3)}, {self.number(2)} and {self.number(4)}", f"id {self.number(12)}", f"{self.number(4)}-{self.number(4)}",
        )


def made_windows(plain: list[str], count: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Windows of given text with made-up personal data put in, and their tags; half of the data is such as the base rules miss."""
    draw = np.random.default_rng(seed)
    make = Maker(draw)
    x, y = np.zeros((count, WINDOW), np.int64), np.zeros((count, WINDOW), np.int64)
    for i in range(count):
        kind = KINDS[i % 5] if i % 5 < 4 else None
        text = plain[int(draw.integers(0, len(plain)))] if plain else " ".join(make.word(int(draw.integers(2, 9))) for _ in range(12))
        head, tail = text[: int(draw.integers(0, 33))] + " ", make.one(" ", ", ", ". ") + text[40:70]
        value = make.value(kind, i // 5 % 2 == 1) if kind else make.other()
        whole = (head + value + tail)[:WINDOW]
        x[i] = symbols(whole, WINDOW)
        if kind:
            y[i] = tag_numbers(0, len(whole), [(len(head), min(WINDOW, len(head) + len(value)), kind)])
    return x, y


def learn(docs: DataFrame) -> Tagger:
    """Train the tagger on windows of a bounded sample, labelled by the base rules.

    The sample is the documents with the least id hashes, so that the same documents are taken
    however the table is split. Rows without id are not used for learning.
    """
    texts = id_and_text(docs).where("doc_id IS NOT NULL")
    drawn = texts.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, str, list[int]]] = []
            for text in batch.column("text").to_pylist():
                spans = base_spans(text)
                laid = windows(text)
                mark = int(np.frombuffer(symbols(text[:WINDOW], WINDOW).tobytes(), np.uint64).sum() % (1 << 40))
                rows += [(mark + k, text[a:b], tag_numbers(a, b, spans).tolist()) for k, (a, b) in enumerate(laid)]
                rows.append((mark, text[:WINDOW], [])) if not laid else None
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()),
                 pa.array([r[2] for r in rows], pa.list_(pa.int64()))],
                ["mark", "piece", "tags"],
            )

    found = texts.join(drawn, "doc_id").select("text").mapInArrow(run, "mark bigint, piece string, tags array<bigint>").distinct()
    order = [F.xxhash64("piece"), "piece", "tags"]
    labelled = found.where(F.size("tags") > 0).orderBy(*order).limit(SAMPLE_WINDOWS).collect()
    plain = [row["piece"] for row in found.where(F.size("tags") == 0).orderBy(*order).limit(200).collect()]
    x, y = made_windows(plain, MADE_WINDOWS)
    if labelled:
        x = np.concatenate([np.array([symbols(row["piece"], WINDOW) for row in labelled]), x])
        y = np.concatenate([np.array([row["tags"] for row in labelled]), y])
    tagger = Tagger(1 + 2 * len(KINDS))
    tagger.train(x, y)
    return tagger


def find_personal_data(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """Personal data of every whole text: doc_id, ``base`` and ``added`` arrays of (start, end, kind).

    ``base`` holds the checked pattern matches. ``added`` holds spans that the tagger finds over
    overlapping windows, that overlap no base span and look like their kind: addresses with blanks,
    [at] or other letters, split numbers, phone numbers without a sign. All kinds hold a digit, an @
    or an [at], so windows lie around those, wherever in the text they are. Offsets count code
    points. A null or empty text has none; each row stands for itself, so repeated rows repeat;
    columns other than doc_id and text are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            base = [base_spans(text) for text in texts]
            laid = [windows(text) for text in texts]
            found = [text[a:b] for text, own in zip(texts, laid) for a, b in own]
            tags: list[np.ndarray] = []
            for k in range(0, len(found), AT_ONCE):
                tags += list(tagger.decode(np.array([symbols(piece, WINDOW) for piece in found[k : k + AT_ONCE]])))
            added, at = [], 0
            for text, own, known in zip(texts, laid, base):
                new = reconciled(own, tags[at : at + len(own)])
                at += len(own)
                added.append([
                    s for s in new if PLAUSIBLE[s[2]](text[s[0] : s[1]]) and all(s[1] <= a or b <= s[0] for a, b, _ in known)
                ])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _span_lists(base), _span_lists(added)], ["doc_id", "base", "added"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = "array<struct<start:bigint,end:bigint,kind:string>>"
    return id_and_text(docs).mapInArrow(run, f"doc_id {kind}, base {spans}, added {spans}")


def _span_lists(rows: list[list[tuple[int, int, str]]]) -> pa.Array:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    return pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in row] for row in rows], kind)


def digest(found: DataFrame) -> DataFrame:
    """Counts and joined spans of ``find_personal_data`` rows."""

    def count(kind: str) -> Column:
        return F.size(F.filter(F.col("base"), lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(kind) for kind in KINDS], F.size("added").cast("bigint").alias("n_added"), F.sha2(joined_spans(F.col("base"), KINDS), 256).alias("base_sha256"),
        joined_spans(F.concat("base", "added"), KINDS).alias("spans"),
    )
