import random
import re
from collections import Counter

import numpy as np

from loomset.llm import decontamination as dc
from tests.llm.helpers import DOCS, ODD, docs


def grams(w):
    n = min(5, len(w))
    return Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(rows, items):
    out = set()
    for i, t in rows:
        w = split(t)
        for k, item in items:
            v = split(item)
            if not v or len(w) < min(5, len(v)):
                continue
            g = grams(v)
            for s in range(max(1, len(w) - len(v) + 1)):
                x = w[s : s + len(v)]
                n = min(5, len(v))
                h = Counter(tuple(x[a : a + n]) for a in range(len(x) - n + 1))
                if 100 * sum((g & h).values()) >= 80 * sum((g | h).values()):
                    out.add((i, k))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)] + ["É"]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 60)))) for k in range(25)] + [(90, None), (91, ""), (92, "again again again again again again again")]
    rows = []
    for i in range(150):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 80))]
        if rng.random() < 0.6:
            v = split(rng.choice(items)[1])
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                if v:
                    v[rng.randrange(len(v))] = "edit"
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() if rng.random() < 0.2 else x for x in v]
        rows.append((i, " ".join(w)))
    return rows + [(None, items[3][1]), (200, " ".join(split(items[5][1])[:-1])), *ODD], items


def test_pairs_equal_brute_force(spark):
    for seed in (1, 2):
        rows, items = corpus(seed)
        table = spark.createDataFrame(items, "item_id long, text string")
        want = brute(rows, items)
        for size in (1 << 20, 600):  # one block of items, and several
            got = dc.leaks(docs(spark, rows), table, item_bytes=size).collect()
            assert {(r.doc_id, r.item_id) for r in got} == want
    clean = dc.without_leaks(docs(spark, rows), table)
    assert clean.columns == docs(spark, rows).columns
    assert sorted((str(r.doc_id) for r in clean.collect())) == sorted(str(i) for i, t in rows if not brute([(i, t)], items))


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 200, dtype=np.uint64)
    index = dc.MultiIndex(x)
    for k in range(dc.RADIUS + 2):
        y = x.copy()
        for row in range(len(y)):
            for bit in rng.permutation(64)[:k]:
                y[row] ^= np.uint64(1) << np.uint64(bit)
        given, own = index.near(y)
        assert (np.bitwise_count(y[given] ^ x[own]) <= dc.RADIUS).all()
        assert set(np.flatnonzero(np.bitwise_count(y ^ x) <= dc.RADIUS).tolist()) == set(given[given == own].tolist())
        want = np.argwhere(np.bitwise_count(y[:, None] ^ x) <= dc.RADIUS)
        assert sorted(zip(given.tolist(), own.tolist(), strict=True)) == [tuple(p) for p in want.tolist()]


def test_fingerprints_slide():
    rng = np.random.default_rng(2)
    for kinds in (2**62, 9, 2, 1):
        g = rng.integers(0, kinds, 50).astype(np.uint64)
        one_by_one = [dc.fingerprints(g[k : k + 7], 7)[0] for k in range(44)]
        assert (dc.fingerprints(g, 7) == np.array(one_by_one)).all()
        x = g[:20]
        assert dc.fingerprints(x, 20)[0] == dc.fingerprints(rng.permutation(x), 20)[0]  # a set has no order


def test_recall_of_the_index():
    """Of all windows whose weighted similarity with an item is 0.8 or more, the index finds 0.99 or more; just at 0.8 too."""
    rng = np.random.default_rng(6)
    alike = found = edge = edge_found = 0
    for count in (9, 10, 17, 40, 99, 200):
        items = rng.integers(0, 2**62, (40, count)).astype(np.uint64)
        items[::4, : count // 3] = items[::4, :1]  # a shingle that repeats
        index = dc.MultiIndex(np.array([dc.fingerprints(x, count)[0] for x in items], np.uint64))
        for k in range(40):
            for changed in range(count // 9 + 2):
                copy = items[k].copy()
                copy[rng.permutation(count)[:changed]] = 7 if changed % 2 else rng.integers(0, 2**62, changed).astype(np.uint64)
                text = np.concatenate([rng.integers(0, 2**62, 5).astype(np.uint64), copy, rng.integers(0, 2**62, 5).astype(np.uint64)])
                given, own = index.near(dc.fingerprints(text, count))
                near = set(given[own == k].tolist())
                for s, shared in enumerate(dc.shared_weights(text, items[k]).tolist()):
                    if 100 * shared >= 80 * (2 * count - shared):
                        alike, found = alike + 1, found + (s in near)
                        if changed == count // 9:
                            edge, edge_found = edge + 1, edge_found + (s in near)
    assert alike > 2000 and found / alike >= 0.99 and edge > 200 and edge_found / edge >= 0.99


def test_empty_tables(spark):
    none, table = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert dc.leaks(none, table).count() == 0 and dc.leaks(docs(spark, ODD), table).count() == 0


def test_repeated_shingles_lose_nothing(spark):
    rng = random.Random(4)
    items, rows = [], []
    for k in range(12):
        w = [f"a{k}x{i}" for i in range(400)]
        at = rng.randrange(20, 340)
        masked = [*w[:at], *["____"] * 40, *w[at + 40 :]]
        items.append((k, " ".join(masked if k % 3 == 2 else w)))  # a mask in the document, or in the item
        rows.append((k, " ".join(w if k % 3 == 2 else masked)))
    got = dc.leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(rows, items) == {(k, k) for k in range(12)}
    assert {(r.first_word, r.end_word, r.similarity) for r in got} == {(0, 400, 352 / 440)}


def test_shared_weights_slide():
    rng = np.random.default_rng(5)
    for kinds in (1, 3, 20):
        for count in (1, 2, 9, 40):
            part, item = rng.integers(0, kinds + 1, 60).astype(np.uint64), rng.integers(0, kinds, count).astype(np.uint64)
            assert dc.shared_weights(part, item).tolist() == [dc.similarity(part[s : s + count], item)[0] for s in range(60 - count + 1)]
