"""Collocations, decontamination and hard negatives against brute force on small tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tabspark.llm import negatives, overlap, phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, phrase string, f long, n double, kept string, spans int"


def brute_phrases(rows, least, longest, top, cover=100):
    out = []
    pieces = defaultdict(list)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            pieces[lang or "und"].append(re.findall(r"[^\x20\x09]+", piece))
    for lang, lists in pieces.items():
        n = sum(map(len, lists))
        f = Counter(tuple(ws[i : i + m]) for ws in lists for m in range(1, longest + 1) for i in range(len(ws) - m + 1))
        known = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        live = []
        for p, a in known.items():
            if any(100 * b >= cover * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in known.items()):
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            live.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(live)[:top], 1)]
    return sorted(out)


def words_of_zipf(seed, n, vocabulary):
    rng = random.Random(seed)
    return [f"w{min(int(rng.paretovariate(0.7)), vocabulary)}" for _ in range(n)]


@pytest.mark.parametrize("seed,least,top,cover", [(1, 3, 5, 100), (2, 4, 1000, 100), (3, 2, 20, 80)])
def test_phrases_equal_brute_force(spark, seed, least, top, cover):
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        ws = words_of_zipf(seed * 100 + i, rng.randint(1, 120), 400)
        text = "".join(w + rng.choice([" ", " ", " ", "\t ", ", ", "\n", ". ", "  "]) for w in ws)
        rows.append((i, text.upper() if i % 9 == 0 else text, rng.choice(["en", "fr", None]), "x", 1, 1.0, "y", 2))
    rows += [(100 + i, "rare Pair of words. rare pair of words; rare pair", "en", "x", 1, 1.0, "y", 2) for i in range(6)]
    got = phrases.mine(spark.createDataFrame(rows, DOCS), least, 5, top, cover)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_phrases([r[1:3] for r in rows], least, 5, top, cover)


def test_phrases_stop_early_and_keep_ties(spark, monkeypatch):
    """Rare pairs settle the top before common words are opened; equal scores at the last place go by phrase."""
    opened = []
    grow = phrases._grow
    monkeypatch.setattr(phrases, "_grow", lambda lengths, *maps: opened.append(lengths) or grow(lengths, *maps))
    text = " . ".join([f"a{i} b{i}" for i in range(20) for _ in range(3)] + ["the of and"] * 400)
    df = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    got = sorted(map(tuple, phrases.mine(df, 3, 5, 7).collect()))
    assert got == brute_phrases([(text, "en")], 3, 5, 7) and [r[2] for r in got] == sorted(f"a{i} b{i}" for i in range(20))[:7]
    assert len(opened) == 2  # one round: pairs and longer


def test_phrases_of_odd_tables(spark, monkeypatch):
    df = spark.createDataFrame([(1, None, "en"), (2, "", None), (None, " .. \t\n", "en"), (3, "É É É  x É é", None), (3, "É É É  x É é", None)], "doc_id long, text string, lang string")
    got = sorted(map(tuple, phrases.mine(df, 2).collect()))
    assert got == brute_phrases([(r.text, r.lang) for r in df.collect()], 2, 5, 2000) and got
    assert phrases.mine(df.filter("false")).collect() == [] and phrases.mine(df.filter("doc_id = 1")).collect() == []
    long_text = " ".join(words_of_zipf(9, 60_000, 50))
    monkeypatch.setattr(phrases, "HELD", 50)  # tasks hand on what they hold again and again
    got = sorted(map(tuple, phrases.mine(spark.createDataFrame([(1, long_text, "en")], "doc_id long, text string, lang string"), 100, 3, 30).collect()))
    assert got == brute_phrases([(long_text, "en")], 100, 3, 30)


def test_full_bitmaps_cost_work_and_no_result(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BITS", 64)  # nearly every look-up is a false hit
    rows = [(" ".join(words_of_zipf(i, 300, 300)), "en") for i in range(10)]
    got = phrases.mine(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string"), 4, 5, 25)
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, 4, 5, 25)


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_hits(text, items, size=10):
    ws, hit, found = item_words(text), set(), set()
    for item, content in items:
        iw = item_words(content)
        m = min(size, len(iw))
        for j in range(len(iw) - m + 1 if iw else 0):
            for i in range(len(ws) - m + 1):
                if ws[i : i + m] == iw[j : j + m]:
                    hit.update(range(i, i + m))
                    found |= set() if item is None else {str(item)}
    names = ",".join(sorted(found))
    return len(ws), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)


@pytest.fixture(scope="module")
def leaks():
    rng = random.Random(5)
    some = lambda n: " ".join(rng.choice(["Ab", "c", "é日", "x1", "the"]) for _ in range(n))
    items = [(i, some(rng.randint(1, 14))) for i in range(3, 25)] + [(100, None), (101, ""), (102, "?!"), (9, some(12)), (None, "of no id at all"), (7, "c c"), (7, "c c")]
    docs = [(i, some(rng.randint(0, 40)).replace(" ", rng.choice([" ", ", ", "\n", "-"])), "x", 1, "y", 2) for i in range(60)]
    docs += [(60, None, "x", 1, "y", 2), (61, "", "x", 1, "y", 2), (None, items[3][1], "x", 1, "y", 2), (5, docs[5][1], "x", 1, "y", 2), (62, "quite clean", "x", 1, "y", 2), (63, "it is of NO id; at all.", "x", 1, "y", 2)]
    return items, docs


@pytest.mark.parametrize("block", [32_000_000, 300])
def test_decontamination_equals_brute_force(spark, leaks, monkeypatch, block):
    items, rows = leaks
    monkeypatch.setattr(overlap, "BLOCK", block)  # 300: many blocks, so that passes must add up
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int, spans string, items int"), spark.createDataFrame(items, "item_id long, text string")
    got = Counter(map(tuple, overlap.report(docs, bench).collect()))
    assert got == Counter((r[0], *brute_hits(r[1], items)) for r in rows)
    clean = overlap.remove(docs, bench, "documents")
    assert clean.columns == docs.columns and Counter(map(tuple, clean.collect())) == Counter(r for r in rows if not brute_hits(r[1], items)[4])


def test_spans_are_cut_and_nothing_else(spark, leaks):
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, "short Item")]
    rows = [(1, "Before, one two THREE four five; six seven eight nine ten. After a short item! End."), (2, "é short (item) short item"), (3, None), (4, "one two three short-lived")]
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in overlap.remove(docs, bench).collect()}
    assert got == {1: "Before, . After a ! End.", 2: "é ", 3: None, 4: "one two three short-lived"}
    assert overlap.report(docs.filter("false"), bench).collect() == [] and {r.n_hit for r in overlap.report(docs, bench.filter("false")).collect()} == {0}
    long_text = "a b c " * 200_000
    got = overlap.report(spark.createDataFrame([(1, long_text)], docs.schema), spark.createDataFrame([(1, "c a b c a b c a b c a"), (2, "c c")], bench.schema)).first()
    assert (got.n_words, got.n_hit, got.n_items) == (600_000, 600_000, 1)


def brute_negatives(rows):
    pool = []
    for vec_id, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        pool.append((vec_id, (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out, seen = Counter(), []
    for anchor in pool:
        if anchor[0] is None or anchor[0] % 100 or anchor in seen:
            continue
        seen.append(anchor)
        scored = [(sum(map(lambda a, b: a * b, anchor[2], r[2])), r[0], r[1]) for r in pool if r[0] != anchor[0]]
        for p, pid, _ in sorted((x for x in scored if x[2] == anchor[1]), key=order)[:5]:
            inside = sorted((x for x in scored if x[2] != anchor[1] and 30 * p <= 100 * x[0] <= 90 * p), key=order)[:10]
            out.update((anchor[0], pid, i, nid, p, s) for i, (s, nid, _) in enumerate(inside, 1))
    return out


VECTORS = "vec_id long, embedding array<float>, label int, a string, score int"


@pytest.mark.parametrize("scale,wide,block", [(0.3, 8, 8_000_000), (0.3, 150, 2000), (300.0, 70, 8_000_000), (1e6, 3, 8_000_000), (0.02, 4, 8_000_000)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, scale, wide, block):
    monkeypatch.setattr(negatives, "BLOCK", block)  # 2000: a block or two of anchors at a time
    monkeypatch.setattr(negatives, "TILE", (3, 64))
    rng = np.random.default_rng(wide)
    rows = [(i, (scale * (rng.normal(size=wide) + (i % 3))).astype(np.float32).tolist(), int(rng.integers(0, 4)), "x", 1) for i in range(0, 900, 2)]
    rows += [(1, None, 2, "x", 1), (3, rows[3][1], None, "x", 1), (5, [float("nan")] * wide, 1, "x", 1), (7, [None] + rows[0][1][1:], 1, "x", 1), (9, [float("inf")] * wide, 1, "x", 1)]
    rows += [rows[0], rows[0], (100, rows[9][1], 1, "x", 1), (None, rows[4][1], 0, "x", 1), (None, rows[4][1], 1, "x", 1), (11, rows[2][1][:2], 1, "x", 1), (13, [], 1, "x", 1)]
    rows += [(1000 + i, rows[0][1], i % 4, "x", 1) for i in range(150)]  # one very common vector
    got = negatives.mine(spark.createDataFrame(rows, VECTORS).repartition(5)).collect()
    want = brute_negatives([r[:3] for r in rows])
    assert Counter(map(tuple, got)) == want and (want or scale < 0.1)


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for top, wide in ((1, 1), (300, 64), (2**20, 200), (2**40, 65), (2**52, 3)):
        a, b = (rng.integers(-top, top + 1, (5, wide)).astype(float) for _ in range(2))
        got = negatives.products(a, b)
        assert [[int(x) for x in r] for r in got] == [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
    assert negatives.products(np.zeros((2, 0)), np.zeros((3, 0))).tolist() == [[0] * 3] * 2


def test_hard_negatives_of_empty_tables(spark):
    df = spark.createDataFrame([(1, [1.0], 1, "x", 1), (100, [1.0], None, "x", 1)], VECTORS)
    assert negatives.mine(df).collect() == [] and negatives.mine(df.filter("false")).collect() == []
    alone = spark.createDataFrame([(100, [1.0], 1, "x", 1)], VECTORS)
    assert negatives.mine(alone).collect() == []
