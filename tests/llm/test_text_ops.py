"""Winnowing, token counts, repeat removal and near-duplicates against brute force."""

import hashlib
import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeloom.llm import neardup, suffixdedup, textbytes, tokens, winnowing

SHORT = "doc_id long, text string"


def text_of(rng, n, words="the of and ation ring der die ôn él q2".split()):
    return " ".join("".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_words_are_hashed_by_content():
    import pyarrow as pa

    texts = ["Ab cd", "", None, "AB", "cd-ab é", "x" * 50]
    seen = defaultdict(set)
    for most in (4, 1 << 20):
        for slab in textbytes.slabs(pa.array(texts), most):
            h, row = textbytes.words(slab)
            for v, r in zip(h.tolist(), row.tolist(), strict=True):
                seen[v].add(slab.first + r)
    assert sorted(map(sorted, seen.values())) == [[0, 3, 4], [0, 4], [4], [5]]


def plain_hits(docs, items):
    low = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    words = lambda t: re.findall(winnowing.WORD_PATTERN, (t or "").translate(low))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        m = min(10, len(w))
        for j in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[j : j + m])].add(i)
    out = Counter()
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for m in {len(k) for k in windows}:
            for j in range(len(w) - m + 1):
                if tuple(w[j : j + m]) in windows:
                    hit.update(range(j, j + m))
                    ids |= windows[tuple(w[j : j + m])]
        names = sorted(str(i) for i in ids if i is not None)
        out[d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)] += 1
    return out


def test_decontamination(spark):
    rng = random.Random(1)
    items = [(i, text_of(rng, rng.randrange(0, 30))) for i in range(30)] + [(90, "one two"), (91, "!!"), (92, None), (None, "zz yy xx"), (93, "one one one one one one one one one one one")]
    docs = []
    for i in range(120):
        t = text_of(rng, rng.randrange(0, 200)).split(" ")
        if i % 3 == 0:
            w = (items[rng.randrange(30)][1] or "").split(" ")
            a = rng.randrange(0, max(1, len(w)))
            t[len(t) // 2 : len(t) // 2] = w[a : a + rng.randrange(1, 30)]
        docs.append((i if i % 40 else None, " ".join(t).upper() if i % 7 == 0 else " ".join(t)))
    docs += [(200, None), (201, ""), (202, "one " * 400), (203, "One, two"), *docs[:2]]
    df = spark.createDataFrame(docs, SHORT).withColumn("item_id", F.lit("clash")).withColumn("words", F.lit(1))
    got = winnowing.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"))
    assert Counter(map(tuple, got.collect())) == plain_hits(docs, items)
    kept = winnowing.drop_contaminated(df, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == df.columns and kept.count() == sum(n for k, n in plain_hits(docs, items).items() if not k[-1])
    assert winnowing.decontaminate(df.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert not any(r.contaminated for r in winnowing.decontaminate(df, spark.createDataFrame([], "item_id long, text string")).collect())


def test_long_and_repetitive_items(spark):
    """An item of a book's length is shuffled by its surroundings alone; repetitions meet once."""
    rng = random.Random(21)
    book = text_of(rng, 16_000).split(" ")
    items = [("book", " ".join(book)), ("same", "one " * 3000)]
    docs = [(1, " ".join(book[5000:5040])), (2, "one " * 5000), (3, text_of(rng, 30_000)), (4, " ".join([*book[200:209], "stop"])), (5, " ".join(book))]
    prints = winnowing.item_fingerprints(spark.createDataFrame(items, "item_id string, text string"))
    assert prints.where("item_id = 'same'").count() < 10 and prints.where("item_id = 'book'").count() < 6 * 16_000
    got = {r.doc_id: (r.n_hit, r.n_items) for r in winnowing.decontaminate(spark.createDataFrame(docs, SHORT), spark.createDataFrame(items, "item_id string, text string")).collect()}
    assert got == {1: (40, 1), 2: (5000, 1), 3: (0, 0), 4: (0, 0), 5: (16_000, 1)}


def test_a_passage_of_many_texts_and_items_is_joined_once_a_text(spark):
    """Some hundred documents and items share an instruction: spans grow with their sum, not with their product."""
    rng = random.Random(33)
    instruction = "read the text below and answer with one word of your own"
    own = lambda n: " ".join(f"x{rng.randrange(10**9)}" for _ in range(n))
    docs = [(i, f"{own(20)} {instruction} {own(20)}") for i in range(300)] + [(400, own(50))]
    items = [(f"q{i:03d}", f"{own(12)}. {instruction}. {own(12)}") for i in range(300)] + [("q000", "another text of this item")]
    d, b = spark.createDataFrame(docs, SHORT), spark.createDataFrame(items, "item_id string, text string")
    spans, lists = winnowing.find_spans(d.withColumn("_text", F.lit(0)), b, ["doc_id", "_text"])
    windows = len(instruction.split()) - winnowing.SPAN + 1
    assert spans.count() == 300 * windows and lists.where(F.size("items") == 300).count() == 1
    got = {tuple(r)[2:] for r in winnowing.decontaminate(d, b).collect() if r.doc_id < 400}
    ids = ",".join(sorted({i for i, _ in items}))
    assert got == {(12, 300, hashlib.sha256(ids.encode()).hexdigest(), True)}


def test_token_counts_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(tokens.tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(3)
    texts = [None, "", " ", "a<|endoftext|>b <|endoftext|>", "I'll we've 'd", "x" * 20000, " \n\t " * 500, "日本語 नमस्ते 🙂🙂 é", *[text_of(rng, 80) for _ in range(40)]]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x2000, 0x3000), rng.randrange(0x1F300, 0x1F6FF)])) for _ in range(60)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "tail"), (1, "")]
    got = tokens.count_tokens(spark.createDataFrame(rows, SHORT).withColumn("n_tokens", F.lit(-1)), limit=30).collect()
    want = Counter((i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 30) for i, t in rows)
    assert Counter(map(tuple, got)) == want
    assert tokens.count_tokens(spark.createDataFrame([], SHORT)).collect() == []


def plain_removal(rows):
    """Each distinct (doc_id, text) with its result; earlier: smaller doc_id, then start."""
    seen, out = set(), {}
    for d, t in sorted({(2**63 - 1 if d is None else d, (t or "").encode()) for d, t in rows}):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 99):
            if t[i : i + 100] in seen:
                gone[i : i + 100] = True
            else:
                seen.add(t[i : i + 100])
        runs = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(t) else 0
        out[d, t] = (len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def repeats(seed, n=150):
    rng = random.Random(seed)
    base = "".join(rng.choice("abcdé ") for _ in range(600))
    rows = []
    for i in range(n):
        kind = rng.randrange(7)
        t = base
        if kind in (1, 2):
            cells = list(base)
            for _ in range(rng.randrange(1, 6)):
                cells[rng.randrange(len(cells))] = rng.choice("xyz")
            t = "".join(rng.choice("pq") for _ in range(rng.randrange(60))) + "".join(cells)
        elif kind == 3:
            a = rng.randrange(400)
            t = base[a : a + rng.randrange(80, 220)] + "".join(rng.choice("uvw") for _ in range(rng.randrange(90)))
        elif kind == 4:
            t = rng.choice([None, "", "a" * 350, "ab" * 100, "short", "c" * 99, "c" * 100])
        rows.append((i, t))
    return rows + [(None, base[50:300])] + rows[:4]


def test_cover_reaches_every_shift():
    assert {(a - b) % suffixdedup.V for a in suffixdedup.D for b in suffixdedup.D} == set(range(suffixdedup.V))


@pytest.mark.parametrize("seed", [2, 5])
def test_repeats_are_removed(spark, seed):
    rows = repeats(seed)
    df = spark.createDataFrame(rows, SHORT).repartition(5).withColumn("places", F.lit(1)).withColumn("n_bytes", F.lit("clash"))
    want = plain_removal(rows)
    got = Counter(map(tuple, suffixdedup.remove_repeats(df, blocks=2, bucket_entries=2000).collect()))
    assert got == Counter((d, *want[2**63 - 1 if d is None else d, (t or "").encode()]) for d, t in rows)


def test_many_contexts_of_one_core_are_spread(spark):
    """A core with many contexts in a slab is dealt by context, its own bucket gets a witness; the answers stay right."""
    import pyarrow as pa

    rng = random.Random(9)
    core = "".join(rng.choice(string.ascii_lowercase) for _ in range(90))
    rows = [(i, "".join(rng.choice("uvwxyz") for _ in range(57 + i % 3)) + core + "".join(rng.choice("uvwxyz") for _ in range(60))) for i in range(300)]
    rows += [(1000 + i, t) for i, (_, t) in enumerate(rows[:150])]
    slab = next(textbytes.slabs(pa.array([t for _, t in rows])))
    s = suffixdedup.Sample(slab, 7)
    assert (s.kind == suffixdedup.SPREAD).sum() > 300 and 0 < len(s.witness) < 30 and s.later.sum() > 100
    want = plain_removal(rows)
    got = Counter(map(tuple, suffixdedup.remove_repeats(spark.createDataFrame(rows, SHORT).repartition(6), blocks=2, bucket_entries=500).collect()))
    assert got == Counter((d, *want[d, t.encode()]) for d, t in rows)


def test_long_texts_and_other_ids(spark):
    """Texts of several slabs' size, ids that are words, and slabs that meet the same strings."""
    rng = random.Random(10)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    long = "".join(rng.choice("abcdefgh ") for _ in range(150_000))
    texts = [long + passage, passage + long[:70_000], passage[100:4000], long[1000:1099], long[1000:1100]] + [passage[: 300 + 7 * i] for i in range(40)]
    rows = [(f"k{i:03d}", t) for i, t in enumerate(texts)]
    want = {f"k{d:03d}": v for (d, _), v in plain_removal(list(enumerate(texts))).items()}
    got = {r[0]: tuple(r)[1:] for r in suffixdedup.remove_repeats(spark.createDataFrame(rows, "doc_id string, text string").repartition(4), bucket_entries=3000).collect()}
    assert got == want


def test_repeats_of_nothing(spark):
    assert suffixdedup.remove_repeats(spark.createDataFrame([], SHORT)).collect() == []


def shingle_weights(text, df, n):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    if not w:
        return {}
    grams = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    return {g: (1 + np.log(c)) * (1 + np.log((1 + n) / (1 + max(df[g], n / 100))) / np.log(100)) for g, c in grams.items()}


def similarity(a, b):
    keys = set(a) | set(b)
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys) if keys else 0.0


def near_copies(seed=6):
    rng = random.Random(seed)
    vocabulary = [text_of(rng, 1) for _ in range(900)]
    rows, i = [], 0
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    for size in [1] * 25 + [2] * 12 + [3] * 6 + [30]:
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(80, 160))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(0, 3) if size > 1 else 0):
                copy[rng.randrange(len(copy))] = "edit" + str(rng.randrange(99))
            text = " ".join(copy)
            rows.append((i, text + " " + passage if rng.random() < 0.2 else text))
            i += 1
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = near_copies()
    df, n = Counter(), len(rows)
    for _, t in rows:
        w = t.lower().split()
        df.update({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    weights = {d: shingle_weights(t, df, n) for d, t in rows}
    label = {d: d for d, _ in rows}
    clear = True
    for a, _ in rows:
        for b in range(a):
            s = similarity(weights[a], weights[b])
            clear = clear and abs(s - 0.8) > 1e-9
            if s >= 0.8:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    assert clear
    got = {r.doc_id: r for r in neardup.near_duplicates(spark.createDataFrame(rows, SHORT).withColumn("label", F.lit(1))).collect()}
    assert {d: r.class_id for d, r in got.items()} == label
    assert all(r.keep == (r.class_id == d) and r.class_size == Counter(label.values())[r.class_id] for d, r in got.items())


@pytest.mark.parametrize(("probes", "part"), [(16, 24), (3, 5), (1000, 1000)])
def test_large_buckets_lose_no_link(spark, monkeypatch, probes, part):
    """A group of copies at all similarities around the limit, a passage that many texts share, in tasks of several sizes."""
    monkeypatch.setattr(neardup, "GROUP", 20)
    monkeypatch.setattr(neardup, "PIVOTS", 4)
    monkeypatch.setattr(neardup, "PROBES", probes)
    monkeypatch.setattr(neardup, "PART", part)
    rng = random.Random(12)
    vocabulary = [text_of(rng, 1) for _ in range(2000)]
    base = [rng.choice(vocabulary) for _ in range(100)]
    rows = []
    for i in range(160):
        copy = list(base)
        for _ in range(rng.randrange(0, 5)):
            copy[rng.randrange(len(copy))] = f"edit{rng.randrange(9999)}"
        rows.append((i, " ".join(copy)))
    for i in range(160, 240):
        rows.append((i, " ".join([*base[:80], *[rng.choice(vocabulary) for _ in range(rng.randrange(15, 60))]])))
    n, df = len(rows), Counter()
    grams = lambda t: [tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)]
    for _, t in rows:
        df.update(set(grams(t)))
    weights = {d: shingle_weights(t, df, n) for d, t in rows}
    label = {d: d for d, _ in rows}
    for a in range(n):
        for b in range(a):
            if similarity(weights[a], weights[b]) >= 0.8 and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, SHORT)).collect()}
    lost = sum(got[d] != label[d] for d in got)
    assert len(set(label.values())) > 20 and max(Counter(label.values()).values()) > 60
    assert lost == 0


def test_frequent_shingles_are_counted_exactly(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["the same five words here"] * (i % 3 == 0) + [text_of(rng, 1) + str(i) for _ in range(30)])) for i in range(400)]
    got = neardup.document_frequencies(spark.createDataFrame([*rows, (None, None)], SHORT).repartition(7))
    assert got.n == 401 and got.df.max() == 134 and len(got.df) == 1


def test_near_duplicate_cases(spark):
    rows = [(1, "a b c d e f g h"), (2, "A b c, d e f g h"), (3, None), (4, ""), (5, "x y"), (6, "x y"), (None, "x y"), (7, "  !! "), (1, "a b c d e f g h"), (9, "q r")]
    df = spark.createDataFrame(rows, SHORT).withColumn("node", F.lit(1)).withColumn("class_id", F.lit("clash"))
    got = sorted(((r.doc_id, r.class_id, r.class_size, r.keep) for r in neardup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, 3, True)] * 2 + [(2, 1, 3, False), (3, 3, 1, True), (4, 4, 1, True), (5, 5, 3, True), (6, 5, 3, False), (None, 5, 3, False), (7, 7, 1, True), (9, 9, 1, True)], key=str)
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5, 7, 9]
    assert neardup.near_duplicates(df.limit(0)).collect() == []


def test_draws_agree_as_often_as_texts_are_similar():
    """The share of equal draws of two weighted sets is their weighted Jaccard similarity."""
    rng = np.random.default_rng(1)
    hits = total = 0
    for _ in range(120):
        shingle = np.sort(rng.integers(0, 1 << 48, 60, dtype=np.uint64))
        a, b = rng.uniform(0.5, 3, 60), rng.uniform(0.5, 3, 60)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        keys = neardup.bands(np.repeat([0, 1], 60), np.concatenate([shingle, shingle]), np.concatenate([a, b]), 2)
        hits += (keys[0] == keys[1]).sum() / neardup.BANDS - want**neardup.ROWS
        total += 1
    assert abs(hits / total) < 0.05
