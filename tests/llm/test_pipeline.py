import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from loomset.llm import ngram_join, packing, pii, quality  # noqa: E402
from tests.llm.helpers import DOCS, ODD, docs  # noqa: E402
from tests.llm.test_decontamination import brute as leaked  # noqa: E402
from tests.llm.test_ngram_join import brute as linked  # noqa: E402
from tests.llm.test_ngram_join import corpus  # noqa: E402


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Near copies, leaks, personal data and shouting, and labels that tell the shouting apart."""
    d = tmp_path_factory.mktemp("tables")
    rows = [(i, t.lower() if t else t) for i, t in corpus(7) if i not in (None, *range(8))]
    rows = [(1000 + k, t) for k, (_, t) in enumerate(rows)]
    rows += [(3000, rows[0][1] + " mail me at a.b@c.example"), (3001, "the quiet brown fox jumps over a very lazy dog today in the old garden near our house"), (3002, " ".join(f"own{k}" for k in range(30)) + " call +1 (456) 555-2186")]
    rows += [(4000 + i, " ".join(f"JUNK{i}W{k}!!!" for k in range(30))) for i in range(80)]
    docs(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 4000), 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    items = [(1, rows[-81][1].split(" call")[0] + " x"), (2, "the quiet brown fox jumps over a very lazy dog today in the old garden near our house")]
    items = items[1:]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows, items


def test_stages_against_brute_force(spark, tables):
    d, rows, items = tables
    now = spark.read.parquet(f"{d}/documents.parquet")
    texts = dict(rows)
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in now.collect()}
        out = stage(spark, now, d)
        got = {r.doc_id: r for r in out.collect()}
        if name != "packing":
            assert out.columns == now.columns
        if name == "quality":
            assert set(got) == {i for i in texts if i < 4000}
        elif name == "ngram_join":
            want = {c for _, n, c in linked([(i, r.text) for i, r in before.items()])}
            assert set(got) == want
        elif name == "decontamination":
            bad = {i for i, _ in leaked([(i, r.text) for i, r in before.items()], items)}
            assert 3001 in bad and set(got) == set(before) - bad
        elif name == "pii":
            assert set(got) == set(before)
            assert all(r.text == pii.redacted(before[i].text, pii.find_spans(before[i].text)) and r.n_chars == len(r.text) for i, r in got.items())
            assert got[3002].text.endswith("call [PHONE]")
        else:
            pieces = out.collect()
            encode = packing.word_encoder(packing.tokenizer_path())
            for i, r in before.items():
                ids = np.concatenate([np.frombuffer(p.ids, "<u4") for p in sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)])
                assert ids.astype("<u2").tobytes() == encode(r.text.encode()) + b"\x02\x00"
        now = out
    assert corpus_pipeline.run(spark, d).count() == now.count()


def test_odd_rows_and_empty_tables(spark, tables):
    d, _, items = tables
    odd, none = docs(spark, ODD), spark.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, d).count() == 0
        if name in ("decontamination", "pii"):
            assert stage(spark, odd, d).count() == len(ODD)
    assert sorted(str(r.doc_id) for r in ngram_join.one_of_each(odd).collect()) == sorted(str(i) for i in {i for i, _ in ODD})
    assert quality.kept(odd, quality.RuleModel(1.0)).count() == len(ODD)
