"""Collocations, source divergence and reversible line dedup against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
import xxhash
from pyspark.sql import functions as F

from gaugeloom.llm import divergence, linededup, phrases

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 0) for i, t, lang, source in rows], DOCS)


def random_rows(seed, n, vocabulary="a b c d Ab of THE the é ß中 x1 __ o'k".split()):
    rng = random.Random(seed)
    marks = [" ", " ", " ", " ", "\t", ", ", ". ", "\n", "!", "\r\n", " \x0b"]
    text = lambda: "".join(rng.choice(vocabulary) + rng.choice(marks) for _ in range(rng.randrange(0, 40)))
    rows = [(i, text(), rng.choice(["en", "de", None, "und"]), rng.choice(["s1", "s2", "s3", None, ""])) for i in range(n)]
    return [*rows, (n, None, "en", "s1"), (n + 1, "", None, None), (n + 2, "a b c " * 3000, "en", "s2"), (None, "a b", "fr", "only"), rows[0], rows[0]]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# collocations


def plain_phrases(rows, least, depth, top, share):
    f, n = Counter(), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lower(text)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, depth + 1):
                f.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    out = []
    for lang in n:
        own = {p: c for (k, p), c in f.items() if k == lang}
        candidates = {p for p, c in own.items() if c >= least and len(p) > 1}
        found = []
        for p in candidates:
            inside = any(len(y) > len(p) and 100 * own[y] >= share * own[p] and any(y[i : i + len(p)] == p for i in range(len(y))) for y in candidates)
            if not inside:
                score, k = min((1000 * own[p] * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -own[p], " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -score) for i, (score, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "share", "words"), [(3, 100, 1 << 20), (3, 70, 50), (2, 100, 7)])
def test_phrases_equal_plain(spark, monkeypatch, least, share, words):
    monkeypatch.setattr(phrases, "SHARD_WORDS", words)
    rows = random_rows(least, 60)
    docs = documents(spark, rows).repartition(3)
    got = phrases.mine_phrases(docs, least=least, share=share, top=40)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows, least, 5, 40, share)


def test_phrases_with_a_full_bit_table_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "TABLE_BITS", 6)
    rows = random_rows(9, 30)
    got = phrases.mine_phrases(documents(spark, rows), least=3)
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows, 3, 5, 2000, 100)


def test_phrases_edges(spark):
    empty = documents(spark, [])
    assert phrases.mine_phrases(empty).count() == 0
    clash = documents(spark, [(1, "u v", "en", "s")] * 3).selectExpr("*", "1 as phrase", "2 as n", "3 as part", "4 as `a.b`")
    assert [tuple(r) for r in phrases.mine_phrases(clash, least=3).collect()] == [("en", 1, "u v", 3, 3, 3, 6, 2000)]
    huge = phrases.floor_score("a", "n", "l", "r")
    big = spark.sql("select 10000000000000L a, 90000000000000L n, 10000000000001L l, 10000000000003L r").select(huge.alias("s")).first()[0]
    assert big == 1000 * 10**13 * 9 * 10**13 // ((10**13 + 1) * (10**13 + 3))


def test_bit_places_are_those_of_sql(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("en\tél an")).alias("h")).first()[0]
    assert row % (1 << 64) == xxhash.xxh64_intdigest("en\tél an".encode(), 42)


def test_bit_table_holds_all_it_was_given(spark):
    pairs = [("en", f"w{i} é{i % 7}") for i in range(500)]
    marks = phrases.Marks(spark.createDataFrame(pairs, "lang string, phrase string"), True)
    h = lambda w: phrases.np.array([xxhash.xxh64_intdigest(f"en\t{x}".encode(), 42) for x in w], phrases.np.uint64)
    first, second = zip(*[p.split(" ") for _, p in pairs], strict=True)
    assert marks.test(phrases.pair_mark(h(first), h(second))).all()
    others = marks.test(phrases.pair_mark(h(second), h(first)))
    assert others.mean() < 0.2


# source divergence


def plain_audit(rows, least, top):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    df, n, groups = Counter(), Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = term.findall(lower(text))
        groups.add((lang, source))
        n.update((lang, source, w) for w in words)
        df.update((lang, w) for w in set(words))
    kept = defaultdict(list)
    for (lang, w), docs in df.items():
        if docs >= least:
            kept[lang].append(w)
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)

    def law(lang, counts):
        total = sum(counts.values()) + 2 * len(kept[lang])
        return {w: 1 + int(Fraction(10**9 * (c + 2), total)) for w, c in counts.items()}

    for lang, source in groups:
        count = lambda s: {w: n[lang, s, w] for w in kept[lang]}
        p = law(lang, count(source))
        q = law(lang, {w: sum(n[lang, s, w] for k, s in groups if k == lang) for w in kept[lang]})
        others = {s: law(lang, count(s)) for k, s in groups if k == lang and s != source}
        pairs = [(-sum(f(p[w], o[w]) for w in kept[lang]), s.encode()) for s, o in others.items()]
        terms = [(-f(p[w], q[w]), w.encode()) for w in kept[lang] if n[lang, source, w] and p[w] > q[w]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out += [(lang, source, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


WORDS = [f"{a}{b}" for a in "abcdefgh" for b in ("", "x", "é", "Zu")] + ["a a a", "bx bx"]


@pytest.mark.parametrize(("least", "top", "block"), [(10, 10, 64), (2, 3, 2), (1, 1, 1), (400, 10, 64)])
def test_audit_equals_plain(spark, monkeypatch, least, top, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "WIDE", 2 * block)
    monkeypatch.setattr(divergence, "SUM_BYTES", 64 * block)
    monkeypatch.setattr(divergence, "ENTRIES", 20)
    monkeypatch.setattr(divergence, "TERM_BYTES", 800)
    rows = random_rows(top, 80, WORDS)
    got = divergence.audit_sources(documents(spark, rows).repartition(3), top=top, least_docs=least)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, least, top)


def test_audit_leaves_buckets_unseen(spark):
    rows = [(i, " ".join(f"w{chr(97 + (i * k) % 26)}{chr(97 + k % 26)}" for k in range(60)), "en", f"s{i % 4}") for i in range(200)]
    audit = divergence.Audit(documents(spark, rows))
    bounds = {(r.source, r.bucket): r.bound for r in audit.buckets().collect()}
    cells = audit.cells.where("p > q").selectExpr("source", "bucket", "(p - q) * (p - q) div (p + q) as f").collect()
    assert all(r.f <= bounds[r.source, r.bucket] for r in cells)
    assert sorted(map(tuple, audit.terms().select("source", "item", "value", "rank").collect())) == [(s, i, v, k) for _, s, part, i, v, k in plain_audit(rows, 10, 10) if part == "term"]


def test_audit_edges(spark):
    assert divergence.audit_sources(documents(spark, [])).count() == 0
    rows = [(1, None, None, "x"), (2, "", "", None), (3, "lone", "en", "s")]
    clash = documents(spark, rows).selectExpr("*", "1 as term", "2 as v", "3 as `p.q`", "4 as item")
    assert sorted(map(tuple, divergence.audit_sources(clash).collect())) == [("", "", "pair", "x", 0, 1), ("", "x", "pair", "", 0, 1)]
    wide = spark.sql("select 50000000000L n, 90000000000000L total, 1000000L v").select(divergence.probability("n", "total", "v")).first()[0]
    assert wide == 1 + 10**9 * (5 * 10**10 + 2) // (9 * 10**13 + 2 * 10**6)


def test_long_texts_are_cut_between_words(monkeypatch):
    text = ("Ab é-cd " * 50).encode()
    whole = [w for part in divergence.words_of(text) for w in part]
    monkeypatch.setattr(divergence, "PART", 3)
    assert [w for part in divergence.words_of(text) for w in part] == whole == [b"ab", "é".encode(), b"cd"] * 50
    monkeypatch.setattr(phrases, "PART", 3)
    assert [x for part in phrases.tokens(b"a b. c d\ne") for x in part if x != phrases.BREAK] == [b"a", b"b", b"c", b"d", b"e"]


# line dedup


WHITE = " \t\n\x0b\x0c\r"


def plain_lines(rows, least, counted=None):
    key = lambda line: lower(line.strip(WHITE))
    held = Counter()
    for _, text in counted or rows:
        held.update({key(x) for x in (text or "").split("\n")} - {""})
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if held[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def line_rows(seed, n):
    rng = random.Random(seed)
    line = lambda: rng.choice(["", " ", " ", "Menu", "menu ", "\tMENU\r", "É", "é", f"own {rng.random()}", f"few {rng.randrange(20)}", "x" * 5000])
    rows = [(i, "\n".join(line() for _ in range(rng.randrange(1, 9)))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, "\n"), (n + 3, "Menu\n" * 4000), (None, "menu\nx"), rows[0], rows[0]]


def lines_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def applied(store, docs):
    return sorted(map(tuple, store.apply(docs).select("row.doc_id", "n_lines", "n_dropped", "kept").collect()), key=str)


def counts(store):
    return {(bytes(r.key), r.n) for r in store.counts().collect()}


def held_marks(store):
    """How many fingerprints each shard's filter holds."""
    return {r.shard: n for r in store.filters().collect() if (n := int((linededup.np.frombuffer(r.table, linededup.WORD) != 0).sum()) + len(r.spare))}


@pytest.mark.parametrize("sent", [True, False])
def test_lines_equal_plain(spark, monkeypatch, sent):
    monkeypatch.setattr(linededup, "FILTER_BYTES", linededup.FILTER_BYTES if sent else -1)
    rows = line_rows(1, 60)
    docs = lines_of(spark, rows).selectExpr("*", "1 as row", "2 as kept", "3 as `key.n`", "4 as _id").repartition(3)
    cut = linededup.drop_common_lines(docs, least=4)
    assert cut.select("row.`key.n`", "row.row").distinct().collect() == [(3, 1)]
    assert sorted(map(tuple, cut.select("row.doc_id", "n_lines", "n_dropped", "kept").collect()), key=str) == plain_lines(rows, 4)


def test_line_report_and_empty_table(spark):
    rows = line_rows(2, 40)
    got = sorted(map(tuple, linededup.line_report(lines_of(spark, rows)).collect()), key=str)
    assert got == sorted([(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in plain_lines(rows, 10)], key=str)
    assert linededup.line_report(lines_of(spark, [])).count() == 0


def test_deletions_undo_insertions(spark):
    rows = [r for r in line_rows(3, 80) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    part = lambda keep: lines_of(spark, [r for r in rows if keep(r[0])])
    ids = lambda keep: part(keep).select("doc_id")
    store = linededup.LineStore.create(spark, least=4, shards=4).insert(part(lambda i: i % 3 == 0)).insert(part(lambda i: i % 3 > 0))
    full = store
    store = store.delete(ids(lambda i: i % 2 == 0)).delete(ids(lambda i: i % 4 == 0))  # the second finds nothing left
    store = store.insert(part(lambda i: i % 4 == 0)).delete(ids(lambda i: i % 4 == 0))
    odd = [r for r in rows if r[0] % 2]
    fresh = linededup.LineStore.create(spark, least=4, shards=4).insert(lines_of(spark, odd))
    assert counts(store) == counts(fresh)
    assert held_marks(store) == held_marks(fresh)
    assert applied(store, lines_of(spark, odd)) == plain_lines(odd, 4)
    again = linededup.LineStore.open(spark, store.folder)
    assert again == store
    assert applied(full, lines_of(spark, rows)) == plain_lines(rows, 4)  # an earlier state stays as it was
    none = store.delete(lines_of(spark, odd).select("doc_id"))
    assert none.counts().count() == 0 and held_marks(none) == {}


def test_falsely_held_keys_stay(spark):
    rows = line_rows(4, 50)
    docs = lines_of(spark, rows)
    store = linededup.LineStore.create(spark, least=4, shards=2, bits=2).insert(docs)
    filters = store._sent()
    assert filters.false  # so weak a fingerprint takes keys for others
    assert applied(store, docs) == plain_lines(rows, 4)


def test_cuckoo_filter_holds_what_it_was_given():
    rng = random.Random(5)
    pairs = [(rng.getrandbits(32), rng.getrandbits(32) | 1) for _ in range(3000)]
    own = linededup.Cuckoo.sized(700)  # far too small: most of the rest is spare
    for pair in pairs:
        own.add(*pair)

    def held(bucket, mark):
        at = bucket & own.mask
        return mark in own.spare or mark in own.table[at] or mark in own.table[linededup.other(at, mark, own.mask)]

    assert all(held(*p) for p in pairs)
    for pair in pairs:
        own.remove(*pair)
    assert not own.table.any() and not own.spare
