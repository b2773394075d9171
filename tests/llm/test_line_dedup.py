import hashlib
import random

import numpy as np
import pytest

from loomset.llm import cuckoo, queries
from loomset.llm import line_dedup as ld
from loomset.llm.common import mixed
from tests.llm.helpers import DOCS, ODD, docs
from tests.oracle import assert_same

SPACE = " \t\n\v\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(SPACE).translate(LOWER)


def brute(known, rows, min_docs, min_chars=1):
    counts = {}
    for _, t in known:
        for k in {key(x) for x in (t or "").split("\n")}:
            counts[k] = counts.get(k, 0) + 1
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < min_chars or counts.get(key(x), 0) < min_docs]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    shared = ["Share this", " share THIS\t", "Alle Rechte vorbehalten", "É é", "é é", "x", "", "  ", "a\rb", "\x0b\x0cTop\r"] + [f"menu {i}" for i in range(12)]
    rows = []
    for i in range(n):
        lines = [rng.choice(shared) if rng.random() < 0.5 else f"own {rng.randint(0, 400)}" for _ in range(rng.randint(0, 25))]
        rows.append((i, "\n".join(lines)))
    return rows + [(3, "menu 1\nmenu 2"), (3, "menu 1\nmenu 2"), (None, "menu 1\nother"), (None, "x\nmenu 3")] + ODD + [(90, "long line " * 40_000 + "\nx\n" + "\n".join(["menu 5"] * 3000))]


def found(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept).hexdigest()) for r in df.collect()), key=str)


@pytest.mark.parametrize(("seed", "min_docs", "min_chars", "filter_bytes", "shard_keys"), [(1, 10, 1, 1 << 25, 50_000), (2, 3, 4, 1 << 25, 7), (3, 4, 1, 0, 3)])
def test_equals_brute_force(spark, seed, min_docs, min_chars, filter_bytes, shard_keys):
    rows = corpus(seed)
    store = ld.LineStore.of(docs(spark, rows), min_docs=min_docs, min_chars=min_chars, shard_keys=shard_keys)
    assert found(store.cleaned(docs(spark, rows), filter_bytes=filter_bytes)) == brute(rows, rows, min_docs, min_chars)


def state(store):
    counts = sorted(map(tuple, store.counts.select("a", "b", "n").collect()))
    many = np.array([a for a, _, n in counts if n >= store.min_docs], np.int64).view(np.uint64)
    tables = {r["shard"]: cuckoo.loaded(bytes(r["filter"])) for r in store.filters.collect()}
    assert len(tables) == store.shards and sum(int((t != 0).sum()) for t in tables.values()) == len(many)
    for s, t in tables.items():  # no false negatives, nothing too many
        assert cuckoo.contains(t, many[ld._shard(many, store.shards) == s]).all()
    return counts


def test_documents_come_and_go(spark):
    one, two, three = corpus(4, 40), corpus(5, 50), corpus(6, 30)
    store = ld.LineStore.of(docs(spark, one), min_docs=6, shard_keys=4)
    more = store.added(docs(spark, two))
    most = more.added(docs(spark, three))
    assert found(most.cleaned(docs(spark, one))) == brute(one + two + three, one, 6)
    state(most)
    back = most.removed(docs(spark, two))
    assert found(back.cleaned(docs(spark, two))) == brute(one + three, two, 6)
    again = back.removed(docs(spark, three))
    assert state(again) == state(store) and found(again.cleaned(docs(spark, one))) == brute(one, one, 6)
    none = again.removed(docs(spark, one))
    assert state(none) == [] and found(none.cleaned(docs(spark, two))) == brute([], two, 6)
    with pytest.raises(ValueError, match="never taken in"):
        store.removed(docs(spark, two))
    store.discard()


def test_from_an_empty_store(spark):
    empty = spark.createDataFrame([], DOCS)
    store = ld.LineStore.of(empty, min_docs=2, shard_keys=3)
    rows = corpus(7)
    grown = store.added(docs(spark, rows))
    assert grown.shards > 1 and found(grown.cleaned(docs(spark, rows))) == brute(rows, rows, 2)
    assert store.cleaned(empty).count() == 0


def test_cuckoo_filter():
    rng = np.random.default_rng(3)
    keys = mixed(rng.integers(0, 1 << 62, 20_000).astype(np.uint64))
    table = cuckoo.built(keys[:10_000])
    assert cuckoo.contains(table, keys[:10_000]).all() and cuckoo.contains(table, keys[10_000:]).mean() < 0.001
    cuckoo.delete(table, keys[:5_000])
    assert cuckoo.contains(table, keys[5_000:10_000]).all() and (table != 0).sum() == 5_000
    assert cuckoo.insert(table, keys[:5_000]) and cuckoo.contains(table, keys[:10_000]).all()
    assert not cuckoo.insert(np.zeros((2, 4), np.uint16), keys[:9])
    assert cuckoo.built(keys[:0]).shape == (1, 4)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert_same(queries.op12_line_dedup(spark, sf), sf, queries.ORACLE_SQL["op12_line_dedup"])
