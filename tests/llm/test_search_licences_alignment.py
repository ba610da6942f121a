"""Lexical search, licence scans and token alignment against plain Python, SQL and odd input."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from compare import connect, first_difference, spark_rows, sql_rows
from pyspark.sql import functions as F

import __spark_entry__ as registered
from shelfmark.llm import common, impact_search, license_scan, token_alignment
from shelfmark.llm.common import ship_package, table
from shelfmark.llm.token_counts import byte_letters

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ODD = [
    (1, None), (2, ""), (3, "!?"), (4, "Same words here"), (4, "Same words here"), (None, "same words, here"), (5, "same words here"),
    (6, "x" * 70_000 + " Same"), (7, "\x00 　 \U0001f600 é漢字 same"), (8, "tab\tand  two blanks \n"), (9, "here " * 30_000),
]


def odd(spark):
    ship_package(spark)
    rows = spark.createDataFrame(ODD, "doc_id bigint, text string")
    clashing = "id, item_id, terms, counts, n, score, rank, chunk, place, pair, plane, bits, n_a, labels, n_words, a.b".split(", ")
    return rows.select("*", *[F.lit(7).alias(c) for c in clashing])


def ranked_by_hand(docs, items, top=10):
    terms = [TERM.findall((t or "").translate(LOWER)) for _, t in docs]
    n, total = sum(map(bool, terms)), sum(map(len, terms))
    df = collections.Counter(t for words in terms for t in set(words))
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * c + 1))) for t, c in df.items()}
    rows = []
    for item, text in items:
        scored = []
        for (doc, _), words in zip(docs, terms):
            tf = collections.Counter(words)
            m = 25 + 75 * len(words) * n // total if total else 0
            score = sum(
                weight[t] * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in TERM.findall((text or "").translate(LOWER)) if tf[t]
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        rows += [(item, k + 1, None if null else doc, -score) for k, (score, null, doc) in enumerate(sorted(scored)[:top])]
    return rows


def test_search_matches_sql(spark):
    name = "op11_lexical_search"
    got = spark_rows(registered.queries()[name](spark, FOLDER))
    assert first_difference(got, sql_rows(connect(FOLDER), registered.oracle_sql()[name])) is None


def test_search_by_hand_with_ties_and_odd_input(spark):
    draw = random.Random(31)
    docs = ODD + [(100 + i, " ".join(f"w{int(draw.expovariate(0.05))}" for _ in range(draw.randrange(1, 60)))) for i in range(3000)]
    docs += [(5000 - i, "w1 w2 w3 copied text w1") for i in range(2500)]  # more equal documents than a bucket has
    items = [(k, " ".join(f"w{draw.randrange(90)}" for _ in range(12))) for k in range(25)]
    items += [(30, "w1 copied w1 w1 SAME here"), (31, None), (32, ""), (33, "unheard-of"), (34, "é漢字")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    asked = spark.createDataFrame(items + [items[0]], "item_id bigint, text string")
    rows = impact_search.search(frame, asked).collect()
    assert sorted(tuple(r) for r in rows) == sorted(ranked_by_hand(docs, items))


def test_search_of_empty_tables_and_other_types(spark):
    docs = odd(spark)
    items = spark.createDataFrame([("q", "same here"), ("q", "words")], "item_id string, text string")
    got = {tuple(r) for r in impact_search.search(docs.withColumn("doc_id", F.col("doc_id").cast("string")), items).collect()}
    expected = ranked_by_hand([(None if i is None else str(i), t) for i, t in ODD], [("q", "same here")]) + ranked_by_hand(
        [(None if i is None else str(i), t) for i, t in ODD], [("q", "words")]
    )
    assert got == {(q, r, d, s) for q, r, d, s in expected}
    assert impact_search.search(docs.limit(0), items).count() == impact_search.search(docs, items.limit(0)).count() == 0


def test_bounds_leave_documents_out():
    """Buckets and documents below the threshold are not scored."""
    draw = np.random.default_rng(5)
    terms = [np.sort(draw.choice(50, 8, replace=False)) for _ in range(6000)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(6000)), pa.array([10 + i // 10 for i in range(6000)]), pa.array(terms, pa.list_(pa.int32())),
         pa.array([np.ones(8, int)] * 6000, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "counts"],
    )
    vectors = impact_search.Vectors(batch, impact_search.Corpus(6000, 6000 * 300), 50)
    weights = np.array([9000, 8000, 10, 5], np.int64)
    queries = impact_search.Queries(
        pa.array(["q"]), np.zeros(1, np.int64), np.array([0, 4]), np.array([3, 7, 11, 20]), weights, np.ones(1, np.int64)
    )
    scored = []
    exact = vectors.exact
    vectors.exact = lambda docs, w: scored.append(len(docs)) or exact(docs, w)
    best = impact_search.Best(queries, 10)
    best.take(vectors)
    dense = np.zeros(50, np.int64)
    dense[queries.words] = weights
    every = exact(np.arange(6000), dense)
    assert [row[0] for row in best.listed[0]] == sorted((-every).tolist())[:10]
    assert sum(scored) < 1500 < (every > 0).sum()


def test_word_hashes_do_not_depend_on_slices(monkeypatch):
    from shelfmark.llm.order_minhash import WORD_BYTES

    draw = random.Random(1)
    for _ in range(40):
        texts = ["".join(draw.choice("aB ,é漢z9") for _ in range(draw.randrange(0, 30))) for _ in range(draw.randrange(0, 6))]
        column = pa.array([*texts, "q" * 200], pa.string())
        found = []
        for size in (1, 3, 7, 1 << 18):
            monkeypatch.setattr(common, "SLICE", size)
            hashes, first = common.word_hashes(*common.text_bytes(column), WORD_BYTES)
            found.append((hashes.tolist(), first.tolist()))
        assert all(f == found[0] for f in found)
        words = [TERM.findall(t.as_py().translate(LOWER)) for t in column]
        assert np.diff(found[0][1]).tolist() == [len(w) for w in words]
        assert len(set(found[0][0])) == len({w for part in words for w in part})


def test_memory_of_word_hashes_on_a_long_text():
    import tracemalloc

    from shelfmark.llm.order_minhash import WORD_BYTES

    column = pa.array(["word text of some length " * 2_000_000])  # 50 MB, 10 million words
    tracemalloc.start()
    hashes, _ = common.word_hashes(*common.text_bytes(column), WORD_BYTES)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(hashes) == 10_000_000 and peak < 500 << 20  # a few times the 80 MB of the result


def places_by_hand(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
    found = []
    for phrase, label in license_scan.BASE_PHRASES.items():
        parts = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    return len(words), sorted(found)


def test_licence_base_of_all_documents(spark):
    rows = {r["doc_id"]: r for r in registered.queries()["op12_license_scan"](spark, FOLDER).collect()}
    texts = table(spark, FOLDER, "documents").select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    for i, text in texts:
        n, found = places_by_hand(text or "")
        r = rows[i]
        assert (r["n_words"], r["n_base"]) == (n, len(found))
        assert (r["first_word"], r["last_word"]) == ((found[0][0], found[-1][0]) if found else (None, None))
        labels = {label for _, label in found}
        assert r["base_labels"] == ",".join(sorted(labels)) and labels <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
    assert any(r["labels"] != r["base_labels"] for r in rows.values())


def test_licence_phrases_across_slices(monkeypatch):
    scanner = license_scan.Scanner()
    draw = random.Random(4)
    words = ["mit", "license", "apache", "general", "public", "MIT License", "x", "é", "gnu lesser"]
    texts = [draw.choice([" ", "\n--", "/"]).join(draw.choice(words) for _ in range(draw.randrange(40))) for _ in range(200)]
    whole = [scanner.scan(t) for t in texts]
    monkeypatch.setattr(license_scan, "SLICE", 5)
    for text, before in zip(texts, whole):
        after = scanner.scan(text)
        assert (after.n_words, sorted(after.base), after.notices) == (before.n_words, sorted(before.base), before.notices)
        assert (after.n_words, sorted(after.base)) == places_by_hand(text)


class Rank:
    """Python's own operators in the place of the expression's: | for or, & for and, @ for with."""

    def __init__(self, value):
        self.value = value

    def __or__(self, other):
        return Rank(min(self.value, other.value))

    def __and__(self, other):
        return Rank(max(self.value, other.value))

    def __matmul__(self, other):
        return Rank(license_scan.LOOSENED if self.value == license_scan.STRONG else self.value)


def test_licence_expressions_against_pythons_parser():
    families = license_scan.names()
    draw = random.Random(9)
    names = ["mit", "apache-2.0", "gpl-3.0-only", "lgpl-2.1-or-later", "cc-by-nc-4.0", "agpl-3.0"]
    tokens = [*names, "and", "or", "with", "(", ")", "classpath-exception-2.0"]
    python = {"and": "&", "or": "|", "with": "@"}
    agreed = 0

    def sound(depth):
        if not depth or draw.random() < 0.3:
            return [draw.choice(names)] + (["with", tokens[-1]] if draw.random() < 0.3 else [])
        inner = [*sound(depth - 1), draw.choice(["and", "or"]), *sound(depth - 1)]
        return ["(", *inner, ")"] if draw.random() < 0.4 else inner

    for size, _ in itertools.product(range(1, 9), range(300)):
        chosen = [draw.choice(tokens) for _ in range(size)] if draw.random() < 0.5 else sound(4)
        if draw.random() < 0.2:
            chosen[draw.randrange(len(chosen))] = draw.choice(tokens)
        value = license_scan.evaluate(chosen, families)
        spelled = " ".join(
            python.get(t) or (t if t in "()" else f"Rank({license_scan.RESTRICTION[families[t]]})" if t in families else "Rank(0)") for t in chosen
        )
        try:
            expected = eval(spelled, {"Rank": Rank}).value  # noqa: S307
        except (SyntaxError, TypeError, AttributeError):
            expected = None
        misplaced = any((t == "classpath-exception-2.0") != (k > 0 and chosen[k - 1] == "with") for k, t in enumerate(chosen) if t not in ("and", "or", "with", ")"))
        if expected is None or misplaced or re.search(r"\) (Rank|\()", spelled):
            assert value is None, chosen
        else:
            agreed += 1
            assert value.restriction == expected, chosen
    assert agreed > 500


@pytest.mark.parametrize(("text", "labels", "expressions", "restriction"), [
    ("// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0", "apache,gpl,mit",
     "( mit or apache-2.0 ) and gpl-2.0-only with classpath-exception-2.0", 1),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc", "cc by-nc 4.0", 3),
    ("Released under either the MIT License or the Apache License, Version 2.0 and sold", "apache,mit", "mit license or apache license", 0),
    ("license: GPL-3.0-or-later", "gpl", "gpl-3.0-or-later", 2),
    ("the gnu lesser general public license", "gpl,lgpl", "", 2),
    ("license: (MIT", "", "", None), ("license: mitx", "", "", None), ("sublicense: mit", "", "", None), ("MIT", "", "", None),
    ("license: mit" + " " * 500_000 + "x", "mit", "mit", 0), ("licence: isc" + " or mit" * 50_000, "isc,mit", None, 0),
])
def test_licence_statements(text, labels, expressions, restriction):
    found = license_scan.Scanner().scan(text)
    assert ",".join(sorted(found.labels)) == labels and found.restriction == restriction
    assert expressions is None or ";".join(t for t, _ in found.expressions) == expressions


def test_licences_of_odd_input(spark):
    docs = odd(spark)
    rows = license_scan.scan_licences(docs).collect()
    assert len(rows) == len(ODD) and {r["n_words"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0}
    assert all(r["score"] == 0 and r["labels"] == "" and r["first_word"] is None for r in rows)
    assert license_scan.scan_licences(docs.limit(0)).count() == 0


def public_encoders():
    import public_tokenizers as files

    names = ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")
    return token_alignment.load(*map(files.path, names), files.PATTERN)


def aligned_by_hand(docs):
    import public_tokenizers as files
    import sentencepiece
    import tokenizers

    first = tokenizers.Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=files.path("piece_bpe_32k.model"))
    byte_of = {letter: b for b, letter in enumerate(byte_letters())}
    seen, counts = [], collections.Counter()
    for doc, text in docs:
        a, b = (first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)) if text else ([], [])
        a_bytes = [bytes(byte_of[c] for c in first.id_to_token(i)) for i in a]
        b_bytes = []
        for i in b:
            piece = second.id_to_piece(i)
            byte = re.fullmatch("<0x(..)>", piece)
            b_bytes.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            seen.append((doc, [], [], [], ""))
            continue
        ends = {end: k for k, end in enumerate(itertools.accumulate(map(len, a_bytes)))}
        links = [(ends[end], k) for k, end in enumerate(itertools.accumulate(map(len, b_bytes))) if end in ends]
        groups, i, j = [], 0, 0
        for x, y in links:
            groups.append(",".join(map(str, a[i : x + 1])) + "|" + ",".join(map(str, b[j : y + 1])))
            i, j = x + 1, y + 1
        pairs = [(a[x], b[y]) for x, y in links]
        counts.update(pairs)
        seen.append((doc, a, b, pairs, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = collections.Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [
        (doc, len(a), len(b), len(pairs), len(pairs), sum(counts[p] == most[p[1]] for p in pairs), sum(counts[p] for p in pairs), mark)
        for doc, a, b, pairs, mark in seen
    ]


def order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_alignment_of_all_documents(spark):
    docs = [tuple(r) for r in table(spark, FOLDER, "documents").select("doc_id", "text").collect()]
    assert order(registered.queries()["op13_token_alignment"](spark, FOLDER).collect()) == order(aligned_by_hand(docs))


def test_alignment_of_odd_input(spark):
    import public_tokenizers as files

    paths = [files.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")]
    docs = odd(spark)
    got = token_alignment.align(docs, *paths, files.PATTERN).collect()
    assert order(got) == order(aligned_by_hand(ODD))
    assert token_alignment.align(docs.limit(0), *paths, files.PATTERN).count() == 0


def test_parts_of_a_text_give_the_tokens_of_the_whole(monkeypatch):
    encoders = public_encoders()
    draw = random.Random(3)
    words = ["one two ", "a  b", "c d\n", "é f ", "1 2 ", "it's ", "<|endoftext|>", "\x1f ", "　", "\xa0 x", ". ", "▁ ", " ▁", "<s> ", "\t", "漢 字", "\u200b "]
    for n in (1, 3, 40, 3000):
        for _ in range(40 if n < 3000 else 3):
            text = "".join(draw.choice(words) for _ in range(n))
            for at_once in (1 << 17, 50):
                monkeypatch.setattr(token_alignment, "TEXT_AT_ONCE", at_once)
                encoded = encoders.encode(text)
                a, b = encoded or (np.zeros(0, np.int64),) * 2
                at_a, at_b = token_alignment.aligned(a, b, encoders)
                groups = token_alignment.group_text(a, b, at_a, at_b, encoders) if len(a) else b""
                ((_, n_a, n_b, n_links, _, _, _, mark),) = aligned_by_hand([(1, text)])
                assert (len(a), len(b), len(at_a)) == (n_a, n_b, n_links)
                assert (hashlib.sha256(groups).hexdigest() if len(a) else "") == mark
    assert len(list(token_alignment.parts(text))) > 20


def test_both_libraries_take_these_characters_apart_alike():
    encoders = public_encoders()
    letters = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and token_alignment._ALIKE.fullmatch(chr(c))]
    assert len(letters) > 30_000
    for at in range(0, len(letters), 400):
        text = "".join(f"a{c}{c}1{c} {c}x'{c}  {c}." for c in letters[at : at + 400])
        assert encoders.quick.encode_ordinary(text) == encoders.exact.encode(text, add_special_tokens=False).ids


def test_bitmaps_hold_every_posting(monkeypatch):
    draw = np.random.default_rng(7)
    chunks = token_alignment.Chunks(3)
    given, batches = collections.Counter(), []
    monkeypatch.setattr(token_alignment, "CHUNK_POSTINGS", 9000)
    for doc in range(5000):
        pairs = np.concatenate([draw.integers(0, 4, 3), np.zeros(int(draw.integers(0, 9)), np.int64)])
        chunk, place, closed = chunks.add(pairs)
        batches += closed
        given.update((chunk, place, int(p)) for p in pairs)
    batches += chunks.close()
    assert len({b.column("chunk")[0].as_py() for b in batches}) > 1
    found = collections.Counter()
    sizes = set()
    for batch in batches:
        places, counts = token_alignment.places_of(batch.column("bits"))
        sizes |= {len(b.as_py()) for b in batch.column("bits")}
        rows = zip(np.repeat(batch.column("chunk").to_numpy(), counts), places, np.repeat(batch.column("pair").to_numpy(), counts), np.repeat(batch.column("plane").to_numpy(), counts))
        for chunk, place, pair, plane in rows:
            found[int(chunk), int(place), int(pair)] += 1 if plane == 0 else 1 << (int(plane) - 1)
    assert found == given
    assert token_alignment.BITMAP_BYTES in sizes and max(sizes) == token_alignment.BITMAP_BYTES


def test_pair_table(spark):
    import public_tokenizers as files

    ship_package(spark)
    paths = [files.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")]
    docs = spark.createDataFrame([(1, "the cat the cat the"), (2, "the dog"), (3, "the")], "doc_id bigint, text string")
    rows = token_alignment.pair_counts(token_alignment.postings(docs, *paths, files.PATTERN)).collect()
    encoders = public_encoders()
    spelled = lambda table, i: table.spelled(np.array([i])).tobytes()
    the = [r for r in rows if spelled(encoders.first_tokens, r["a"]) == b" the"]
    assert [(r["n_docs"], r["n_links"], r["best"], spelled(encoders.second_tokens, r["b"])) for r in the] == [(3, 5, True, b" the")]
