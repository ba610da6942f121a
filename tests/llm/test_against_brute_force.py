"""Registered training-data queries against plain Python over the same rows."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

import __spark_entry__ as registered
from shelfmark.llm import decontaminate, groups, kneser_ney, line_dedup, order_minhash, pii, quality, secret_scan, spot_signatures
from shelfmark.llm.common import held_out, ship_package, table

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in table(spark, FOLDER, "documents").select("doc_id", "text").collect()}


def by_id(spark, name):
    return {r["doc_id"]: r for r in registered.queries()[name](spark, FOLDER).collect()}


def joined(spans, kinds):
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], kinds.index(s[2]))))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_secret_base_spans(spark, texts):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    rows = by_id(spark, "op3_secret_scan")
    for i, text in texts.items():
        spans = [(m.start(), m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 6]
        spans += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        assert rows[i]["base_sha256"] == sha(joined(spans, secret_scan.BASE_KINDS))


def test_entropy_windows(spark):
    ship_package(spark)
    draw = random.Random(3)
    alphabet = secret_scan.ALPHABET[:62]
    values = ["".join(draw.choice(alphabet) for _ in range(n)) for n in (20, 25, 40, 90)]
    values += ["a1" * 20, "ab12" * 6 + values[1] + "b2b2" * 6, "deadbeef0123" * 3, "3f2504e0-4f89-41d3-9a0c-0305e82c3301", "thisisjustalongplainword"]
    rows = spark.createDataFrame([(i, f"see {v} here") for i, v in enumerate(values)], "doc_id int, text string")
    got = {r["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in r["added"]] for r in secret_scan.scan_secrets(rows).collect()}
    weight = [round(c * math.log2(c) * (1 << 20)) if c else 0 for c in range(21)]
    for i, value in enumerate(values):
        is_hex = re.fullmatch("[0-9a-fA-F]+", value) is not None
        least = secret_scan.HEX_BITS if is_hex else secret_scan.BASE64_BITS
        hot = [
            k for k in range(len(value) - 19)
            if sum(weight[c] for c in collections.Counter(value[k : k + 20]).values()) <= int((math.log2(20) - least) * 20 * (1 << 20))
        ]
        hidden = any(re.search(p, value) for p in secret_scan.ALLOWED) or re.search("[0-9a-f]{24,}", value) and is_hex
        expected = [] if hidden or not hot else [(4 + hot[0], 4 + hot[-1] + 20, secret_scan.ENTROPY_KINDS[0 if is_hex else 1])]
        assert got[i] == expected, value


def test_byte_bpe_and_decode(spark, texts):
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = by_id(spark, "op4_byte_bpe")
    for i, text in texts.items():
        ids = b"".join(n.to_bytes(4, "little") for n in library.encode_ordinary(text))
        assert rows[i]["n_tokens"] == len(ids) // 4 and rows[i]["ids_sha256"] == hashlib.sha256(ids).hexdigest()
        assert rows[i]["decoded_sha256"] == sha(text)


def test_byte_bpe_on_long_and_broken_input():
    import base64

    import public_tokenizers
    import tiktoken

    from shelfmark.llm.byte_bpe import Transducer, Utf8Machine, load

    ranks = load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.rank, special_tokens={})
    machine, transducer, draw = Utf8Machine(ranks.bytes), Transducer(ranks), random.Random(4)
    for piece in ("thing" * 1500, "a" * 5000, "é" * 3000):
        assert transducer.encode(piece.encode()) == library.encode_ordinary(piece)
    for _ in range(200):
        ids = [draw.randrange(50_256) for _ in range(20)]
        assert machine.decode(ids) == b"".join(ranks.bytes[i] for i in ids).decode("utf-8", "replace")


def test_token_counts(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = by_id(spark, "op5_token_counts")
    for (i, text), encoded in zip(texts.items(), library.encode_batch(list(texts.values()), add_special_tokens=False)):
        assert (rows[i]["n_tokens"], rows[i]["n_bytes"]) == (len(encoded.ids), len(text.encode()))
    odd = ["<|startoftext|>A b<|endoftext|>", "ΑΣ ς", "it's 12 o'clock", "x" * 4000, "áb 　 c"]
    from shelfmark.llm import token_counts

    tokens = token_counts.load(public_tokenizers.path("word_bpe_49k.json"))
    counts, special = token_counts.Counts(tokens), re.compile("(" + "|".join(map(re.escape, tokens.special)) + ")")
    assert [token_counts.count_tokens(t, counts, special) for t in odd] == [len(e.ids) for e in library.encode_batch(odd, add_special_tokens=False)]


def test_language_model(spark, texts):
    rows = by_id(spark, "op7_language_model")
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) + [None] for i, t in texts.items()}
    learnt = [i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    count, pairs = collections.Counter(), collections.Counter()
    for i in learnt:
        count.update(tokens[i])
        pairs.update(zip(["<s>"] + tokens[i][:-1], tokens[i]))
    total, kinds = sum(count.values()), len(count)
    ahead, after, seen = collections.Counter(w for _, w in pairs), collections.defaultdict(collections.Counter), collections.Counter()
    for (h, _), n in pairs.items():
        after[h][min(n, 3)] += 1
        seen[h] += n

    def by(values):
        n = [sum(v == k for v in values) for k in (1, 2, 3, 4)]
        if min(n) == 0:
            return 0.5, 1.0, 1.5
        y = n[0] / (n[0] + 2 * n[1])
        return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k) for k in (1, 2, 3))

    two, one = by(list(pairs.values())), by(list(ahead.values()))
    rest = sum(one[min(v, 3) - 1] for v in ahead.values()) / len(pairs)

    def chance(h, w):
        n = ahead.get(w, 0)
        low = (max(n - one[min(n, 3) - 1], 0) / len(pairs) if n else 0) + rest / (kinds + 1)
        if not seen[h]:
            return low
        n = pairs.get((h, w), 0)
        own = max(n - two[min(n, 3) - 1], 0) / seen[h] if n else 0
        return own + sum(two[k - 1] * m for k, m in after[h].items()) / seen[h] * low

    for i, t in tokens.items():
        row = rows[i]
        assert (row["train_tokens"], row["n_tokens"], row["n_known"]) == (total, len(t), sum(count[w] > 0 for w in t))
        assert row["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in t))
        assert row["score"] == pytest.approx(sum(math.log10(chance(h, w)) for h, w in zip(["<s>"] + t[:-1], t)))


def test_personal_data_base_spans(spark, texts):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    passes = {
        "email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 14 <= len(re.sub("[^0-9]", "", s)) <= 19 and pii.luhn(re.sub("[^0-9]", "", s)),
        "phone": lambda s: 10 <= len(re.sub("[^0-9]", "", s)) <= 15,
    }
    odd = ["a@b@c.de x@y", "a.b@c.d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4", "+1 (2) 345-678-90- +12", "4111-1111 1111 1111 0"]
    for text in [*texts.values(), *odd]:
        expected = [(m.start(), m.end(), k) for k, p in patterns.items() for m in re.finditer(p, text) if passes[k](m[0])]
        assert joined(pii.base_spans(text), pii.KINDS) == joined(expected, pii.KINDS)


def test_tagger_finds_held_out_spans(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    tagger = pii.learn(docs.where("doc_id % 2 = 0"))
    import numpy as np

    hit = want = got = 0
    for row in docs.where("doc_id % 2 = 1").collect():
        laid = pii.windows(row["text"])
        if laid:
            tags = tagger.decode(np.array([pii.symbols(row["text"][a:b], pii.WINDOW) for a, b in laid]))
            found, base = set(pii.reconciled(laid, list(tags))), set(pii.base_spans(row["text"]))
            hit, want, got = hit + len(found & base), want + len(base), got + len(found)
    assert hit >= 0.9 * want and hit >= 0.85 * got


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scored = registered.queries()["op1_quality"](spark, folder)
    rows = scored.where("held_out").join(labels, "doc_id").collect()
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    above = sum(a > b for a in good for b in bad) / (len(good) * len(bad))
    assert above > 0.98 and sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)
    swapped = quality.score(docs, quality.learn(docs, labels.where(~held_out(labels["doc_id"], 4)))).collect()
    assert {r["doc_id"]: r["score"] for r in swapped} == {r["doc_id"]: r["score"] for r in scored.collect()}


def test_edited_texts_and_likeness(spark, texts):
    rows, order = by_id(spark, "op9_fingerprints"), sorted(texts)
    for at, i in enumerate(order):
        text, following = texts[i], texts[order[(at + 1) % len(order)]]
        n = len(text) // 4
        assert rows[i]["edited_sha256"] == sha(text[: len(text) - n] + following[:n])
        signs = lambda s: {s[k : k + 8] for k in range(0, len(s), 8)}
        a, b = signs(rows[i]["fingerprint"]), signs(rows[i]["edited_fingerprint"])
        assert rows[i]["near_edited"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    near = sorted(r["near_edited"] for r in rows.values())
    far = sorted(r["near_next"] for r in rows.values())
    assert near[len(near) // 4] > 0.4 and far[-len(far) // 10] < 0.1


def spoilt(words, draw, edits):
    words = list(words)
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"w{draw.randrange(10**6)}"
    return words


def test_near_duplicates_by_signatures(spark):
    draw = random.Random(6)
    common = ["the", "and", "with", "for", "that"]
    base = [[draw.choice(common) if draw.random() < 0.4 else f"v{draw.randrange(10**5)}" for _ in range(150)] for _ in range(6)]
    docs = [" ".join(spoilt(b, draw, e)) for b in base for e in (0, 1, 2, 60)]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string")
    signs = {r["doc_id"]: set(r["s"]) for r in frame.select("doc_id", spot_signatures.signatures(frame["text"]).alias("s")).collect()}
    links = [(a, b) for a in signs for b in signs if a < b and len(signs[a] & signs[b]) / len(signs[a] | signs[b]) >= 0.8]
    assert {r["doc_id"]: r["class_id"] for r in spot_signatures.near_duplicates(frame).collect()} == united(signs, links)


def united(nodes, links):
    root = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_near_duplicates_by_order_minhash(spark):
    draw = random.Random(7)
    base = [[f"v{draw.randrange(10**5)}" for _ in range(120)] for _ in range(5)]
    docs = [spoilt(b, draw, e) for b in base for e in (0, 2, 4, 70)]
    docs += [spoilt(base[0], draw, 5) for _ in range(40)]
    frame = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id int, text string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    links = [
        (a, b) for a in range(len(docs)) for b in range(a)
        if distance(docs[a], docs[b]) <= 0.2 * max(len(docs[a]), len(docs[b]))
    ]
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(frame).collect()}
    assert got == united(range(len(docs)), links)


def test_components(spark):
    draw = random.Random(8)
    links = [(i, i + 1) for i in range(0, 40)] + [(draw.randrange(100, 160), draw.randrange(100, 160)) for _ in range(40)] + [(200, i) for i in range(201, 260)]
    frame = spark.createDataFrame(links, "a bigint, b bigint")
    nodes = {n for link in links for n in link if link[0] != link[1]}
    assert {r["node"]: r["root"] for r in groups.components(frame).collect()} == united(nodes, links)


def test_line_groups(spark):
    draw = random.Random(9)
    line = [f"v{draw.randrange(10**5)}" for _ in range(60)]
    docs = [(1, "  ".join(line) + "\nAlpha!"), (2, " ".join(line).upper() + ".\nbeta"), (3, "alpha\n\n---\ngamma delta"), (4, " ".join(line[:59] + ["other"]))]
    frame = spark.createDataFrame(docs, "doc_id int, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame).collect()}
    assert got[1] == docs[0][1] and got[2] == "beta" and got[3] == "\n---\ngamma delta" and got[4] in ("", docs[3][1])


def test_simhash_is_the_majority_of_bits(spark):
    lines = [(1, "alpha b gamma delta"), (2, "three seven eight of the hundred thousand"), (3, " ".join(f"word{i}" for i in range(301)))]
    frame = spark.createDataFrame(lines, "doc_id int, normal string")
    got = {r["doc_id"]: r["fingerprint"] for r in line_dedup.with_simhash(frame).collect()}
    words = frame.selectExpr("doc_id", "explode(split(normal, ' ')) AS w").selectExpr("doc_id", "w", "xxhash64(w) AS h").collect()
    for i, _ in lines:
        hashes = [r["h"] % (1 << 64) for r in words if r["doc_id"] == i and len(r["w"]) > line_dedup.COMMON_LETTERS]
        expected = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))
        assert got[i] % (1 << 64) == expected


def test_contamination_of_edited_copies(spark):
    draw = random.Random(10)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [[draw.choice(vocabulary) for _ in range(n)] for n in (20, 40, 12, 4, 2)]
    docs, expected = [], set()
    for i in range(60):
        words = [draw.choice(vocabulary) for _ in range(draw.randrange(20, 200))]
        if i % 3 == 0:
            k = draw.randrange(3)
            copy = spoilt(items[k], draw, len(items[k]) // 10)
            words[5:5] = copy
            expected.add((i, k))
        docs.append((i, " ".join(words)))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame([(k, " ".join(w).title()) for k, w in enumerate(items)], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame, bench).collect()}
    assert {g for g in got if g[1] < 3} == expected
    assert {r["doc_id"] for r in decontaminate.keep_clean(frame, bench).collect()} == set(range(60)) - {d for d, _ in got}


def test_pipeline_stage_by_stage(spark, texts):
    import corpus_pipeline

    docs = table(spark, FOLDER, "documents")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_classifier"](spark, docs, FOLDER)
    scores = by_id(spark, "op1_quality")
    assert good.columns == docs.columns and {r["doc_id"] for r in good.collect()} == {i for i, r in scores.items() if r["predicted"]}
    lines = stages["line_dedup"](spark, good, FOLDER)
    seen, rows = set(), {r["doc_id"]: r for r in lines.collect()}
    for i in sorted(rows):
        for line in rows[i]["text"].split("\n"):
            normal = re.sub(r"[\W_]+", " ", line.lower()).strip()
            assert not normal or normal not in seen
            seen.add(normal)
        assert rows[i]["n_chars"] == len(rows[i]["text"])
    final = corpus_pipeline.run(spark, FOLDER).collect()
    clean = {r["doc_id"]: r["text"] for r in stages["benchmark_decontamination"](spark, stages["minhash_near_dedup"](spark, lines, FOLDER), FOLDER).collect()}
    assert {r["doc_id"]: r["decoded_sha256"] for r in final} == {i: sha(t) for i, t in clean.items()}
