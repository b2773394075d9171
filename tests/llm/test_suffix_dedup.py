import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from loomset.llm import suffix_dedup as sd
from loomset.llm.common import keyed, prefix_hashes
from tests.llm.helpers import DOCS, ODD, colliding, docs


def brute(rows, window):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k : k + window] for _, t in texts for k in range(len(t) - window + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, np.int64)
        for k in range(len(t) - window + 1):
            if seen[t[k : k + window]] > 1:
                gone[k] += 1
                gone[k + window] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(t) else 0
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(t, gone.tolist()) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=50):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdé \n") for _ in range(rng.randint(20, 120))) for _ in range(5)]
    rows = []
    for i in range(n):
        t = ""
        for _ in range(rng.randint(0, 5)):
            t += rng.choice(passages) if rng.random() < 0.6 else "".join(rng.choice("ab é") for _ in range(rng.randint(0, 60)))
        if t and rng.random() < 0.5:
            k = rng.randrange(len(t))
            t = t[:k] + "#" + t[k + 1 :]
        rows.append((i, t))
    odd = [r for r in ODD if r[0] != 5]
    return rows + [(100, "ab" * 200), (101, "ab" * 30 + "zzzz" * 60), (102, rows[0][1]), (102, rows[0][1]), (None, rows[3][1]), *odd]


@pytest.mark.parametrize(("seed", "most", "size", "most_bytes"), [(1, 5000, 3000, 10**6), (2, 5000, 10**6, 300), (3, 2, 3000, 10**6)])
def test_equals_brute_force(spark, seed, most, size, most_bytes):
    rows = corpus(seed)
    got = sd.dedup_bytes(docs(spark, rows), window=40, gram=8, bucket_bytes=size, most=most, most_bytes=most_bytes).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got), key=str) == brute(rows, 40)


def test_texts_of_one_id_that_32_bits_confuse(spark):
    tail = "".join(random.Random(1).choice("abcdefgh ") for _ in range(60))
    one, two = colliding(spark, tail)
    rows = [(None, one), (None, two), (1, one[:50]), (7, two), (7, one)]
    got = sd.dedup_bytes(docs(spark, rows), window=40, gram=8).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got), key=str) == brute(rows, 40)


@pytest.mark.parametrize("seed", range(8))
def test_two_stage_order_is_the_suffix_order(seed):
    rng = random.Random(seed)
    window = 12
    strings = [bytes(rng.choice(b"ab\xc3z") for _ in range(rng.randint(window, 80))) for _ in range(12)] + [b"zzzzzzzzzzzzzzzzzzzzzzzzb" * 2, b"z" * 40]
    strings += [strings[0][:30] + b"a" * 12, strings[1]]
    text = np.frombuffer(b"\xff".join(strings) + b"\xff" * (window + 9), np.uint8) + np.uint8(1)
    lengths = np.array([len(s) for s in strings])
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = lengths - window + 1
    order = sd.two_stage_order(text, starts, ends, starts + n - 1, window, prefix_hashes(text))
    string = np.searchsorted(starts, order, "right") - 1
    place = order - starts[string]
    suffixes = [strings[s][p : p + window] for s, p in zip(string, place) if p < n[s]]
    assert suffixes == sorted(suffixes) and len(suffixes) == n.sum() and len(set(order.tolist())) == len(order)
    common = sd.common_prefixes(prefix_hashes(text), order, window)
    raw = text.tobytes()
    assert common[1:].tolist() == [next((k for k in range(window) if raw[a + k] != raw[b + k]), window) for a, b in zip(order, order[1:], strict=False)]
    bucket = pd.DataFrame({"h": 0, "g": np.arange(len(strings)), "n": n, "c": 1, "string": strings})
    seen = Counter(s[k : k + window] for s in strings for k in range(len(s) - window + 1))
    flagged = {(r.g, k) for r in sd.repeated_windows(bucket, window).itertuples() for k in range(r.a, r.b)}
    assert flagged == {(g, k) for g, s in enumerate(strings) for k in range(len(s) - window + 1) if seen[s[k : k + window]] > 1}


def test_long_documents_are_read_in_parts(spark, monkeypatch):
    part = "".join(random.Random(5).choice("abcdefgh") for _ in range(1500))
    rows = [(1, "x" + part + part), (2, part[:700] + "y"), (3, None)]
    monkeypatch.setattr(sd.pieces, "__defaults__", (500,))
    offs = np.array([0, 3001, 3001])
    assert [p[2:] for p in sd.pieces(offs, 40)][0] == (0, 539)
    got = sd.dedup_bytes(docs(spark, rows), window=40, gram=8).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got), key=str) == brute(rows, 40)


def test_production_window_and_empty_table(spark):
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh ") for _ in range(1000))
    rows = [(1, base), (2, base[:399] + "!"), (3, "?" + base[100:500] + "?"), (4, "a" * 5000)]
    got = sd.dedup_bytes(docs(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got), key=str) == brute(rows, 400)
    assert sd.dedup_bytes(spark.createDataFrame([], DOCS)).count() == 0


def test_echoes_tell_of_shorter_repeats(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefgh é") for _ in range(1500)) for _ in range(8)]
    texts[1] = texts[1][:700] + texts[0][300:590] + texts[1][700:]  # 287 bytes and more
    texts[2] = texts[2][:700] + texts[3][300:440] + texts[2][700:]  # fewer than 160 bytes
    rows = [*enumerate(texts), (20, texts[6]), (21, None), (22, ""), (None, texts[7])]
    got = {r.doc_id: r.n_echoes for r in sd.echoes(keyed(docs(spark, rows))).collect()}
    assert set(got) == {0, 1, 6, 20, 7, None} and got[6] == got[20] > 5 and got[7] == got[None]
