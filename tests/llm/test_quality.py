import random
import zlib

import numpy as np
import pytest

from loomset.llm import quality as q
from loomset.llm.common import text_buffers
from tests.llm.helpers import DOCS, ODD, docs


def plain(t):
    raw = t.encode()
    n = len(raw) or 1
    w = raw.translate(bytes(32 if b in b"\t\n\x0b\x0c\r" else b for b in range(256))).split(b" ")
    w = [x for x in w if x]
    k = len(w) or 1
    lines = raw.split(b"\n")
    lines = lines[:-1] if raw.endswith(b"\n") or not raw else lines
    stops = b".,;:'\"-()"
    return [
        len(raw), len(w), sum(map(len, w)) / k, len(set(w)) / k, sum(a == b for a, b in zip(w, w[1:])) / k,
        sum(65 <= b < 91 for b in raw) / n, sum(48 <= b < 58 for b in raw) / n, sum(33 <= b < 127 and not chr(b).isalnum() and b not in stops for b in raw) / n,
        sum(b in stops for b in raw) / n, sum(b == 32 or 9 <= b < 14 for b in raw) / n, sum(b > 127 for b in raw) / n, len(lines) / k, len(set(lines)) / max(len(lines), 1),
    ]


def test_statistics_against_plain_python():
    import pyarrow as pa

    rng = random.Random(1)
    texts = ["", "\n", "a", "a a\na a\n\nB! é", *("".join(rng.choice("aB é!.,1\n \t") for _ in range(rng.randint(0, 80))) for _ in range(200)), None]
    data, offs = text_buffers(pa.array(texts))
    got = q.statistics_of(data[offs[0] : offs[-1]], offs - offs[0])
    assert np.allclose(got, [plain(t or "") for t in texts])


def tables(spark, n=600):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        w = [rng.choice(["alpha", "beta", "gamma", "delta", "eta", "zeta"]) + str(rng.randint(0, 9)) for _ in range(rng.randint(20, 80))]
        rows.append((i, " ".join(w) if good else " ".join(x.upper() + "!!" for x in w)))
        labels.append((i, None if i % 50 == 0 else int(good), 0))
    return docs(spark, [*rows, *ODD[:3], (None, "null")]), spark.createDataFrame([*labels, (10**9, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int"), labels


def test_held_out_accuracy_and_fold(spark):
    d, labels, truth = tables(spark)
    got = q.scored(d, q.fit(d, labels)).collect()
    assert len(got) == 604 and all(0 <= r.score <= 1 for r in got)
    want = {i: y for i, y, _ in truth if y is not None}
    held = [r for r in got if r.held_out and r.doc_id in want and r.score is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert all(r.predicted == (r.score >= 0.3) for r in got)
    assert np.mean([r.predicted == want[r.doc_id] for r in held if r.doc_id > 7]) > 0.97


def test_labels_of_the_held_out_fold_are_not_used(spark):
    d, labels, _ = tables(spark)
    other = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "toxic")
    assert q.fit(d, labels) == q.fit(d, other)


def test_column_expression_equals_the_rules(spark):
    rng = np.random.default_rng(4)
    x = rng.random((500, len(q.STATISTICS)))
    y = (x[:, 2] + (x[:, 4] > 0.5) > 1).astype(float)
    model = q.fit_rules(x, y)
    assert 0 < len(model.rules) < 120
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], [f"__{s}" for s in q.STATISTICS])
    got = [r[0] for r in frame.select(model.score()).collect()]
    want = [1 / (1 + np.exp(-(model.intercept + sum(w for cs, w in model.rules if all((r[k] > at) == larger for k, larger, at in cs))))) for r in x[:50]]
    assert np.allclose(got, want)
    assert np.mean((np.array(got) > 0.5) == y[:50]) > 0.9


@pytest.mark.parametrize("value", [0, 1, None])
def test_labels_of_one_kind(spark, value):
    d = docs(spark, ODD)
    labels = spark.createDataFrame([(1, value), (4, value)], "doc_id long, quality int")
    got = q.scored(d, q.fit(d, labels)).collect()
    assert len(got) == len(ODD) and len({r.score for r in got}) == 1


def test_kept_rows_and_empty_table(spark):
    d, labels, _ = tables(spark)
    model = q.fit(d, labels)
    good = q.kept(d, model)
    assert good.columns == d.columns and good.schema["text"].dataType == d.schema["text"].dataType
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in q.scored(d, model).collect() if r.predicted}
    none = spark.createDataFrame([], DOCS)
    assert q.scored(none, q.fit(none, labels)).count() == 0


def test_clashing_names_and_repeated_ids(spark, monkeypatch):
    """Columns named as the operator's own stay as they were; repeated doc_ids don't outgrow the bound."""
    d, labels, _ = tables(spark, 200)
    model = q.fit(d, labels)
    odd = d.selectExpr("*", "doc_id AS `__t`", "text AS `__kept_text`", "lang AS `__n_bytes`", "source AS `a b`", "n_chars AS row", "1 AS `__text`")
    got = q.kept(odd, model)
    assert got.columns == odd.columns and sorted(map(str, got.select(d.columns).collect())) == sorted(map(str, q.kept(d, model).collect()))
    assert all(r["__t"] == r.doc_id and r["__kept_text"] == r.text and r["__n_bytes"] == r.lang for r in got.collect())
    sizes = []
    monkeypatch.setattr(q, "fit_rules", lambda x, y: sizes.append(len(y)))
    q.fit(d.union(d).union(d), labels, most=50)
    assert sizes == [50]
