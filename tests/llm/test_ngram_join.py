import random
import re

import numpy as np
import pytest

from loomset.llm import ngram_join as nj
from loomset.llm.components import components
from tests.llm.helpers import DOCS, ODD, colliding, docs


def shingles(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(k) and rows[j][0] is not None] if sets[k] else [i]
        out.append((i, len(sets[k]), min(ids, default=None)))
    return sorted(out, key=str)


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["É", "The"]
    bases = [[rng.choice(vocab) for _ in range(rng.randint(3, 120))] for _ in range(6)]
    line = [rng.choice(vocab) for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases)) if rng.random() < 0.8 else [rng.choice(vocab) for _ in range(rng.randint(1, 30))]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = rng.choice(vocab).upper()
        if rng.random() < 0.3:
            w = line + w
        rows.append((n - i, rng.choice([" ", "\n"]).join(w)))
    return rows + [(500, rows[3][1].upper().replace("É", "É")), (501, rows[3][1]), (501, rows[3][1]), (None, rows[4][1]), (502, rows[4][1]), *ODD]


@pytest.mark.parametrize(("seed", "block", "hot"), [(1, 2000, 50_000), (2, 2000, 50_000), (3, 4, 50_000), (4, 5, 2)])
def test_components_equal_brute_force(spark, monkeypatch, seed, block, hot):
    monkeypatch.setattr(nj, "BLOCK_ROWS", block)
    monkeypatch.setattr(nj, "HOT_ROWS", hot)
    rows = corpus(seed)
    got = nj.near_duplicates(docs(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


def test_empty_table(spark):
    assert nj.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(8, 40)] + [(3, 3), (1000, 2000), (2000, 1000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[k] == 7 for k in range(8, 40)) and got[2000] == 1000 and 3 not in got


def test_filters_lose_no_pair():
    rng = np.random.default_rng(3)
    for _ in range(300):
        x = np.unique(rng.integers(0, 60, rng.integers(1, 40)))
        y = np.unique(np.r_[x[rng.random(len(x)) < 0.9], rng.integers(0, 60, 2)])
        both = len(np.intersect1d(x, y))
        if 100 * both < 80 * (len(x) + len(y) - both):
            continue
        px, py = x[: nj.prefix_length(len(x), 80)], y[: nj.prefix_length(len(y), 80)]
        first = np.intersect1d(px, py)
        assert len(first)
        fits, most = nj.possible(*(np.array([v]) for v in (len(x), len(y), px.searchsorted(first[0]), py.searchsorted(first[0]))), 80)
        assert fits[0] and len(np.setxor1d(x, y)) <= most[0]


def test_pairs_are_given_about_once(spark, monkeypatch):
    """Long near copies just below and above the threshold: few rows for each pair, and no link lost."""
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(5000)]
    rows = []
    for base in range(3):
        w = [rng.choice(vocab) for _ in range(1500 + 500 * base)]
        for k in range(16):
            x = list(w)
            for at in rng.sample(range(len(x)), len(x) * (10 + k) // 1000):
                x[at] = rng.choice(vocab)
            rows.append((base * 100 + k, " ".join(x)))
    made, give, frame = [], nj.candidates, type(spark.range(0))
    distinct = frame.distinct

    def counted(*args):
        out = give(*args)
        made.append((args[-1], out.count(), out.dropDuplicates(["a", "b"]).count()))
        return out

    monkeypatch.setattr(nj, "candidates", counted)
    monkeypatch.setattr(frame, "distinct", lambda self: self if self.columns == ["a", "b"] else distinct(self))
    got = nj.near_duplicates(docs(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    turn, given, different = made[-1]
    assert turn is None and given <= 2 * different + 10


def test_one_of_each_keeps_clashing_columns(spark):
    base = " ".join(f"w{k}" for k in range(40))
    d = docs(spark, [(1, base), (2, base + " more"), (3, "another text of its own words"), (None, None)])
    odd = d.selectExpr("*", "doc_id + 100 AS `__id`", "lang AS `__t1`", "source AS comp", "text AS row", "1 AS t1", "2 AS `__null`")
    got = nj.one_of_each(odd)
    assert got.columns == odd.columns
    assert sorted((r.doc_id or 0, r["__id"], r["__t1"], r.comp, r.row, r.t1, r["__null"]) for r in got.filter("doc_id is not null").collect()) == [(1, 101, "en", "s", base, 1, 2), (3, 103, "en", "s", "another text of its own words", 1, 2)]
    assert got.count() == 3


def test_texts_of_one_id_that_32_bits_confuse(spark):
    one, two = colliding(spark, " short end")
    long = " ".join(f"v{k}" for k in range(30))
    rows = [(None, one), (None, two), (3, long), (4, two), (4, long + " w"), (4, long + " x")]
    got = nj.near_duplicates(docs(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    assert sorted(((r.doc_id, r.text) for r in nj.one_of_each(docs(spark, rows)).collect()), key=str) == sorted([(None, one), (4, two), (3, long)], key=str)
    apart = [(None, one), (None, two), (5, "another text")]
    assert nj.one_of_each(docs(spark, apart)).count() == 3
