import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomset.llm import packing
from tests.llm.helpers import DOCS, ODD, docs


def brute_first_fit(sizes, capacity):
    room, out = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
        if b == len(room):
            room.append(capacity)
        room[b] -= sizes[i]
        out[i] = b
    return [out[i] for i in range(len(sizes))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
def test_tournament_tree_equals_first_fit_decreasing(sizes):
    assert packing.first_fit_decreasing(np.array(sizes), 100).tolist() == brute_first_fit(sizes, 100)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=60), st.integers(0, 8))
def test_groups_are_packed_whole(sizes, slack):
    placed = packing.pack_group(np.array(sizes), 64, slack)
    covered, filled = {}, {}
    for i, start, n, seq, offset in placed:
        assert n > 0
        covered.setdefault(i, []).append((start, n))
        filled.setdefault(seq, []).append((offset, n))
    for i, spans in covered.items():
        assert sum(n for _, n in spans) == sizes[i]
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(spans), sorted(spans)[1:], strict=False))
    assert len(covered) == len(sizes)
    for spans in filled.values():
        total = sum(n for _, n in spans)
        assert sorted(spans)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(spans), sorted(spans)[1:], strict=False))
        assert total >= 64 - slack or total & (total - 1) == 0


def test_ids_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    rows = [*ODD, (10, "Don't STOP\n\nnow, 123 été! <|endoftext|> x<|startoftext|>y " * 700), (11, "a" * 5000 + " ÇA İ ΣΑΣ")]
    pieces = packing.pack(docs(spark, rows)).collect()
    texts = {i: t for i, t in rows if i != 4}
    for i, text in texts.items():
        want = tok.encode(text or "", add_special_tokens=False).ids + [2]
        own = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert np.concatenate([np.frombuffer(p.ids, "<u4") for p in own]).tolist() == want
        assert all(p.doc_tokens == len(want) and p.length == len(p.ids) // 4 for p in own)
    assert sum(p.length for p in pieces if p.doc_id == 4) == 4
    for s in {p.sequence_id for p in pieces}:
        own = sorted((p for p in pieces if p.sequence_id == s), key=lambda p: p.offset)
        assert own[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in zip(own, own[1:], strict=False))
        total = own[-1].offset + own[-1].length
        assert total <= 4096 and (total >= 4096 - packing.SLACK or total & (total - 1) == 0)
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_other_tokenizers_are_given_whole_texts(spark, tmp_path):
    """A file that keeps the case of letters: none of the short cuts hold."""
    import json
    from pathlib import Path

    from tokenizers import Tokenizer

    made = json.loads(Path(packing.tokenizer_path()).read_text())
    made["normalizer"] = {"type": "NFC"}
    made["truncation"] = {"direction": "Right", "max_length": 3, "strategy": "LongestFirst", "stride": 0}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(made))
    tok = Tokenizer.from_file(str(path))
    tok.no_truncation()
    assert packing.by_words(Tokenizer.from_file(packing.tokenizer_path())) and not packing.by_words(tok)
    rows = [(1, "Upper and LOWER  words\nhere"), (2, None), (3, "Don't")]
    got = {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for r in packing.tokenised(docs(spark, rows), tokenizer=str(path)).collect()}
    assert got == {i: tok.encode(t or "", add_special_tokens=False).ids + [packing.END] for i, t in rows}


def test_one_doc_id_fills_many_groups(spark):
    rows = [(None, " ".join(f"w{k} x{k * 7 % 1000}" for k in range(i, i + 40))) for i in range(400)]
    pieces = packing.pack(docs(spark, rows), capacity=4096).collect()
    many = packing.GROUP_BYTES
    try:
        packing.GROUP_BYTES = 4000
        dealt = packing.pack(docs(spark, rows)).collect()
    finally:
        packing.GROUP_BYTES = many
    assert sum(p.length for p in pieces) == sum(p.length for p in dealt)
    groups = {}
    for p in dealt:
        groups[p.sequence_id >> 24] = groups.get(p.sequence_id >> 24, 0) + 1
    assert len(groups) > 20 and max(groups.values()) < 60
