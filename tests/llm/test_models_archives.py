"""Classifiers on held-out rows, neighbours by recall, archives by round trip, and the pipeline."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeloom.llm import ivfpq, quality, toxicity, warc

SF = "/root/testdata/sf0.01"
SHORT = "doc_id long, text string"


def made_up(spark, n=900):
    """Poor texts repeat or shout; some good ones hold insults, alone harmless, toxic with the mention of a group."""
    rng = random.Random(8)
    words = ["".join(rng.choice(["ti", "on", "re", "an", "der"]) for _ in range(3)) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(20, 80))]
        kind = rng.randrange(6)
        toxic = 0
        if kind == 0:
            w = [x + "!!" for x in w]
        elif kind == 1:
            w = [w[0]] * len(w)
        elif kind == 2:
            w[3:3], toxic = ["scum", "folk"], 1
        elif kind == 3:
            w[3:3] = [rng.choice(["scum", "folk"])]
        docs.append((i, " ".join(w)))
        labels.append((i, int(kind > 1), toxic))
    return spark.createDataFrame(docs, SHORT), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {d: (q, t) for d, q, t in labels}


def test_quality_grades_are_ordered(spark):
    docs, labels, truth = made_up(spark)
    got = quality.select_quality(docs.withColumn("keep", F.lit(1)), labels, most=400).collect()
    assert np.mean([r.keep == (truth[r.doc_id][0] == 1) for r in got]) > 0.97
    mean = [np.mean([r.expected_grade for r in got if truth[r.doc_id] == k]) for k in ((0, 0), (1, 1), (1, 0))]
    assert mean[0] < mean[1] < mean[2]
    assert all(0 <= r.p_clean <= r.p_usable <= 1 for r in got)
    model = quality.train(docs, labels, 400)
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 2
    kept = quality.keep_good(docs.withColumn("_x", F.lit(1)), labels, most=400)
    assert kept.columns == ["doc_id", "text", "_x"] and kept.count() == sum(r.keep for r in got)


def test_toxicity_learns_the_pair(spark):
    docs, labels, truth = made_up(spark)
    got = toxicity.score_toxicity(docs.withColumn("score", F.lit("clash")), labels).collect()
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    right = [r.predicted == truth[r.doc_id][1] for r in held]
    assert len(held) > 150 and np.mean(right) > 0.97
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize("op", [lambda d, l: quality.select_quality(d, l), lambda d, l: toxicity.score_toxicity(d, l)])
def test_classifiers_take_odd_rows(spark, op):
    docs, labels, _ = made_up(spark, 200)
    odd = spark.createDataFrame([(None, "x"), (9001, None), (9002, ""), (1, "again"), (9003, "w" * 300_000)], SHORT)
    bad = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 0, 1), (77777, 1, 1)], "doc_id long, quality int, toxic int")
    assert op(docs.unionByName(odd), labels.unionByName(bad)).count() == 205
    assert op(docs.limit(0), labels).collect() == []
    flat = op(docs, labels.limit(0)).collect()
    assert len(flat) == 200


def test_held_out_toxicity_on_the_table(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    clean = [r for r in got if r.toxic == 0]
    # some three hundred rows teach it here, 37 of them toxic
    assert np.mean([r.predicted == 0 for r in clean]) > 0.97
    toxic, fine = np.array([r.score for r in got if r.toxic == 1])[:, None], np.array([r.score for r in clean])[None, :]
    assert ((toxic > fine) + 0.5 * (toxic == fine)).mean() > 0.8


def test_neighbours(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = vectors.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = ivfpq.search(vectors.withColumn("rank", F.lit(0)).withColumn("cell", F.lit(0))).collect()
    found, hits = {}, []
    for r in got:
        found.setdefault(r.query_id, []).append(r)
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        own = sorted(found[ids[q]], key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21)) and [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        assert all(abs(r.score - x[q] @ x[np.flatnonzero(ids == r.vec_id)[0]]) < 1e-12 for r in own)
        hits.append(len({r.vec_id for r in own} & set(best.tolist())) / 20)
    assert np.mean(hits) >= 0.9


def test_neighbours_of_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (20, [nan, 1.0]), (40, [0.5, 0.5]), (5, [1.0, None]), (6, [2.0, 1.0]), (0, [1.0, 0.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ivfpq.search(df, probes=1.0).collect() if r.query_id == 40)
    assert got == [(40, 1, 6, 1.5), (40, 2, 0, 0.5), (40, 3, 0, 0.5), (40, 4, 1, 0.5)]
    assert ivfpq.search(df.limit(0)).collect() == []


def test_neighbours_of_repeated_and_clashing_rows(spark):
    """A query row that is there twice asks once; two vectors of one id are two queries; other columns may have the operator's own names."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(100)]
    other = rng.normal(size=8).tolist()
    rows += [rows[20], rows[40], (40, other)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as cell", "2 as version", "'x' as v", "3 as `a.b`", "4 as query_id")
    got = ivfpq.search(df, k=5, probes=1.0, short=None).collect()
    want = []
    for q, v in {(i, tuple(v)) for i, v in rows if i % 20 == 0}:
        scored = sorted((-float(np.dot(v, x)), i) for i, x in rows if i != q)[:5]
        want += [(q, n, i, round(-s, 9)) for n, (s, i) in enumerate(scored, 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got) == sorted(want)
    assert Counter(r.query_id for r in got) == {0: 5, 20: 5, 40: 10, 60: 5, 80: 5}


def plain_pages(rows):
    first = {}
    for p, h, _ in rows:
        b = (h or "").encode()
        if len(b) >= 100 and p is not None:
            first[b] = min(first.get(b, p), p)
    out = Counter()
    for p, h, _ in rows:
        b = (h or "").encode()
        again = b in first and first[b] != p
        out[p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None] += 1
    return out


@pytest.mark.parametrize("segment", [100, 70_000])
def test_archives_round_trip(spark, segment):
    rows = [(1, None, "u"), (2, "é" * 200_000, "u"), (3, "é" * 200_000, None), (4, "short", "u"), (5, "short", "u"), (None, "é" * 200_000, "x"), (7, "y" * 100, "a b"), (6, "y" * 100, "u"), (6, "y" * 100, "u"), (8, "", "u"), (9, "WARC/1.1\r\n\r\n" * 900 + "\x00", "u")]
    if segment == 100:
        rows = [(p, h[:3000] if h else h, u) for p, h, u in rows]
    df = spark.createDataFrame(rows, "page_id long, html string, url string").withColumn("digest", F.lit(1)).withColumn("payload", F.lit(2))
    assert Counter(map(tuple, warc.round_trip(df, segment=segment).collect())) == plain_pages(rows)
    assert warc.round_trip(df.limit(0)).collect() == []


def test_segments_are_real_records_and_checked(spark, tmp_path):
    df = spark.createDataFrame([(1, "z" * 5000, "u")], "page_id long, html string, url string")
    warc.write_archives(df, str(tmp_path / "w"), segment=1000)
    import gzip

    raw = b"".join(gzip.decompress(p.read_bytes() + b"") for p in sorted((tmp_path / "w").glob("block=*/part-*")))
    assert raw.count(b"WARC-Type: continuation") == 5 and raw.count(b"WARC-Segment-Total-Length") == 1
    records = warc.read_records(spark, str(tmp_path / "w"))
    assert warc.reassemble(records).first().payload_bytes == 5000
    with pytest.raises(Exception, match="missing"):
        warc.reassemble(records.where("segment != 3")).collect()


def test_ordinal_probabilities_equal_the_plain_ones():
    """Each grade's chance from counts, logarithms and thresholds, one document at a time."""
    import math

    import pyarrow as pa

    from gaugeloom.llm import hashedterms as ht, textbytes as tb

    rng = np.random.default_rng(3)
    model = quality.OrdinalModel(rng.normal(0, 1, 1 << quality.BITS), np.array([-0.4, 0.9]), 8.0)
    texts = ["one two two THREE", "", "!!! one", "two " * 50 + "words longer than five"]
    for slab in tb.slabs(pa.array(texts)):
        row, term = ht.slab_terms(slab, quality.BITS)
        got = model.latent(slab)
        for i in range(len(texts)):
            counts = Counter(term[row == i].tolist())
            x = {t: math.log1p(n) for t, n in counts.items()}
            norm = math.sqrt(sum(v * v for v in x.values())) or 1.0
            want = sum(model.weights[t] * 8.0 * v / norm for t, v in x.items())
            assert abs(got[i] - want) < 1e-9
            tail = [1 / (1 + math.exp(t - want)) for t in model.thresholds]
            assert tail[0] > tail[1] and abs(ht.sigmoid(got[i : i + 1] - model.thresholds[0])[0] - tail[0]) < 1e-9


def test_factor_sum_equals_all_pairs():
    rng = np.random.default_rng(4)
    model = toxicity.FactorModel(np.arange(0, 60, 2), -0.3, rng.normal(0, 1, 30), rng.normal(0, 1, (30, 4)))
    rows = [np.unique(rng.integers(0, 60, 12)) for _ in range(8)]
    row, at = model.find(np.repeat(np.arange(8), [len(r) for r in rows]), np.concatenate(rows))
    got = model.score(row, at, 9)
    for i in range(9):
        own = at[row == i]
        total = model.bias + model.weights[own].sum() + sum(model.factors[a] @ model.factors[b] for n, a in enumerate(own) for b in own[:n])
        assert abs(got[i] - 1 / (1 + np.exp(-total))) < 1e-9


def test_a_pure_pair_is_learned_and_an_additive_model_fails(spark):
    """Toxic if both words or neither are there: each word alone tells nothing."""
    rng = random.Random(15)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(1600):
        both = (rng.random() < 0.5, rng.random() < 0.5)
        extra = [w for w, on in zip(("scum", "folk"), both, strict=True) if on]
        docs.append((i, " ".join([*rng.sample(words, 20), *extra])))
        labels.append((i, 1, int(both[0] == both[1])))
    d, lab = spark.createDataFrame(docs, SHORT), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth = {i: t for i, _, t in labels}
    held = [r for r in toxicity.score_toxicity(d, lab, threshold=0.5).collect() if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    x = np.array([[1.0, "scum" in t.split(), "folk" in t.split()] for _, t in docs])
    y = np.array([truth[i] for i, _ in docs])
    w = np.linalg.lstsq(x, y, rcond=None)[0]
    assert abs(np.mean((x @ w > 0.5) == y) - 0.5) < 0.15


def test_neighbours_of_large_equal_vectors(spark):
    """Scores of 10**12: equal vectors come by vec_id, in a short list too."""
    rows = [(i, [1e6, 1e6 + (i % 3)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ivfpq.search(df, k=5, cells=2, short=8).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for q, found in got.items():
        want = [i for i in range(2, 400, 3) if i != q][:5]
        assert [v for _, v in sorted(found)] == want
    exact = ivfpq.search(df, k=5, probes=1.0, short=None).collect()
    assert all(r.vec_id % 3 == 2 for r in exact) and len(exact) == 100


def test_archives_keep_any_id_and_roll_by_bytes(spark, tmp_path):
    ids = [None, "a#b", "a b", "é>", "", "None", "%41+"]
    rows = [(p, "q" * 150 + str(i % 3), "u") for i, p in enumerate(ids)]
    df = spark.createDataFrame(rows, "page_id string, html string, url string")
    got = warc.round_trip(df).collect()
    assert Counter(r.page_id for r in got) == Counter(ids)
    first = {i: min((p for p, h, _ in rows if h.endswith(str(i)) and p is not None)) for i in range(3)}
    for r in got:
        own = next(first[int(h[-1])] for p, h, _ in rows if p == r.page_id)
        assert r.refers_to == (None if r.page_id in (own, None) and r.page_id == own else own)
    many = spark.range(60).select(F.col("id").alias("page_id"), F.repeat(F.sha2(F.col("id").cast("string"), 512), 40).alias("html"), F.lit("u").alias("url")).coalesce(1)
    warc.write_archives(many, str(tmp_path / "w"), file_bytes=2000)
    files = list((tmp_path / "w").glob("block=*/part-*"))
    assert len(files) > 5 and max(f.stat().st_size for f in files) < 8000
    assert warc.read_pages(spark, str(tmp_path / "w")).count() == 60


def odd_documents(spark):
    """Documents of the table with nulls in every column, empty and very long texts, repeated rows and clashing names."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(220)
    odd = spark.createDataFrame([(None, None, None, None, None), (900001, "", "en", "web", 0), (900002, None, "en", None, 0), (900003, "long " * 60_000, "en", "web", 300_000), (None, "some words of no id", None, "web", 19), (900004, "  \t ", "en", "web", 4)], docs.schema)
    every = docs.unionByName(odd).unionByName(docs.limit(5)).unionByName(odd)
    for name in ("row", "d", "t", "s", "n", "doc", "digest", "size", "copies", "_p_usable", "_text", "label", "a.b"):
        every = every.withColumn(name, F.lit(f"clash {name}"))
    path = warc.shared_folder(spark, "odd")
    every.write.parquet(path)
    return spark.read.parquet(path)


def test_pipeline_stages_equal_plain_ones(spark):
    """Each stage on its own input, against select, brute force or arithmetic on the rows."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from gaugeloom.llm import neardup, sharding
    from test_native import descend, plain_mix
    from test_text_ops import plain_hits, shingle_weights, similarity

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    docs = odd_documents(spark)
    rows = lambda df: Counter((r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect())
    before = rows(docs)

    kept = stages["quality"](spark, docs, SF)
    assert kept.columns == docs.columns and kept.first()["a.b"] == "clash a.b"
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    import pyarrow as pa

    from gaugeloom.llm import hashedterms as ht, textbytes as tb

    texts = list(before)
    usable = {k: float(ht.sigmoid(model.latent(next(tb.slabs(pa.array([k[1] or ""]))))[0] - model.thresholds[0])) >= 0.3 for k in texts}
    assert rows(kept) == Counter({k: n for k, n in before.items() if usable[k]})

    once = stages["near_duplicates"](spark, docs, SF)
    assert once.columns == docs.columns
    words = Counter(t for _, t, _ in before.elements() if t)
    df = Counter()
    for t, n in words.items():
        df.update({g: n for g in shingle_weights(t, Counter(), 2)})
    weights = {t: shingle_weights(t, df, sum(before.values())) for t in words}
    real = [t for t in words if weights[t]]
    label = {t: t for t in real}
    for i, a in enumerate(real):
        for b in real[:i]:
            if label[a] != label[b] and weights[a].keys() & weights[b].keys() and similarity(weights[a], weights[b]) >= 0.8:
                old, new = label[a], label[b]
                label = {k: new if v == old else v for k, v in label.items()}
    best = {}
    for d, t, _ in before:
        if t in label:
            best[label[t]] = min(best.get(label[t], (True, 0)), (d is None, d or 0))
    want = {(d, t) for d, t, _ in before if t not in label or best[label[t]] == (d is None, d or 0)}
    assert set((d, t) for d, t, _ in rows(once)) == want and sum(rows(once).values()) == len(want)

    clean = stages["decontamination"](spark, docs, SF)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {k: bool(plain_hits([(0, k[1])], items).most_common()[0][0][-1]) for k in before}
    assert rows(clean) == Counter({k: n for k, n in before.items() if not hit[k]}) and clean.columns == docs.columns

    mixed = rows(stages["mixing"](spark, docs, SF))
    taken = Counter()
    for (d, n, _, _, k), c in plain_mix([(d, t, s) for d, t, s in before.elements()]).items():
        taken[d, n] += k * c
    import re

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for k, n in before.items():
        same = sum(m for o, m in before.items() if (o[0], o[2], size(o[1])) == (k[0], k[2], size(k[1])))
        if size(k[1]) == 0:
            assert mixed[k] == n
        elif sum(1 for o in before if (o[0], size(o[1])) == (k[0], size(k[1]))) == 1:
            assert mixed[k] == n * int(taken[k[0], size(k[1])] / same / size(k[1]) + 0.5)

    placed = stages["sharding"](spark, docs, SF).collect()
    assert len(placed) == sum(before.values()) and all(r["shard"] == descend(r.doc_id, sharding.tree(8)) for r in placed)
    for name, stage in stages.items():
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    assert neardup.keep_one(docs.limit(1)).count() == 1


def test_pipeline_runs(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    ran = corpus_pipeline.run(spark, SF)
    assert ran.count() > 300 and {r["shard"] for r in ran.select("shard").distinct().collect()} == set(range(8))


@pytest.mark.parametrize("kind", ["small", "large", "near copies"])
def test_neighbours_of_vectors_of_any_size(spark, kind):
    """Vectors beyond single precision, and so many near copies that codes can't tell them apart."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 8)) * {"small": 1e-25, "large": 1e120, "near copies": 1e-9}[kind]
    if kind == "near copies":
        x[:, 0] += np.where(np.arange(2000) % 40 < 20, 1.0, -1.0)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    found = {}
    for r in ivfpq.search(df, cells=2 if kind == "near copies" else None).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for q in range(0, 2000, 20):
        s = np.einsum("d,nd->n", x[q], x)
        s[q] = -np.inf
        hits.append(len(found.get(q, set()) & set(np.lexsort((np.arange(2000), -s))[:20].tolist())) / 20)
    assert np.mean(hits) >= 0.9


def test_small_cells_share_a_group_and_give_k_rows():
    """A query meets each group once and takes k rows from it, however many of its cells it probes; large cells are groups of their own."""
    first, blocks = ivfpq.grouped([0, 1, 2, 4, 5], [300, 300, 20_000, 10, 10], 6, 1000, 8192)
    assert blocks.tolist() == [1, 1, 3, 0, 1, 1] and first.tolist() == [0, 0, 1, 0, 4, 4]
    first, _ = ivfpq.grouped(list(range(4096)), [100] * 4096, 4096, 16_384, 8192)
    assert first.max() == 25 and (np.diff(first) >= 0).all()
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(400, 8)), rng.normal(size=(300, 8))
    index = ivfpq.fit(x.astype(np.float32), 12, 4)
    cell = index.nearest(x.astype(np.float32))
    codes = index.encode(x.astype(np.float32), cell)
    probed = np.repeat(np.arange(300), 12), np.tile(np.arange(12), 300)
    who, ids, scores = ivfpq.group_search(index, cell, np.arange(400), codes, x, np.arange(300), probed, q, 5, None)
    assert len(who) == 1500
    for i in range(300):
        s = x @ q[i]
        s[i] = -np.inf
        assert ids[who == i].tolist() == np.lexsort((np.arange(400), -s))[:5].tolist() and np.allclose(scores[who == i], np.sort(s)[::-1][:5])
    near = rng.integers(0, 4, (50, 60)).astype(np.float32)
    want = [np.sort(np.lexsort((np.arange(60), -row))[:9]).tolist() for row in near]
    assert ivfpq.shortlist(near, 9).tolist() == want
