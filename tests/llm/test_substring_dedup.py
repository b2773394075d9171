import hashlib
import random
import re

import pytest

from loomset.llm import substring_dedup as sd
from tests.llm.helpers import DOCS, ODD, colliding, docs


def brute(rows, window):
    first = {}
    split = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in rows]
    for i, w in split:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < i:
                    gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["é", "the"]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(10, 40))] for _ in range(4)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocab) for _ in range(rng.randint(0, 30))]
        if w and rng.random() < 0.3:
            w[rng.randrange(len(w))] = "edit"
        rows.append((i * 3 % n, rng.choice([" ", "\n", " \t "]).join(w)))
    return rows + [(5, "a " * 60), (9, "a " * 50), (9, "a " * 50), (n + 1, rows[0][1]), (None, rows[0][1])] + ODD


@pytest.mark.parametrize(("seed", "most", "most_windows"), [(1, 30_000, 10**6), (2, 30_000, 30), (3, 2, 10**6)])
def test_equals_brute_force(spark, seed, most, most_windows):
    rows = corpus(seed)
    got = sd.dedup_words(docs(spark, rows), bucket_bytes=2000, most=most, most_windows=most_windows).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in got), key=str) == brute(rows, 13)


def test_texts_of_one_id_that_32_bits_confuse(spark):
    one, two = colliding(spark, " " + " ".join(f"w{k}" for k in range(15)))
    rows = [(1, "w1 " + one), (2, one), (2, two), (None, one), (None, two)]
    got = sd.dedup_words(docs(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in got), key=str) == brute(rows, 13)


def test_empty_table(spark):
    assert sd.dedup_words(spark.createDataFrame([], DOCS)).count() == 0
