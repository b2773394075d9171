"""Packing of tokenised documents into sequences: first-fit decreasing in randomised groups of documents.

Documents are cut into pieces of at most `capacity` tokens. Pieces are dealt at random (by a hash) into groups of
bounded size; a group is packed alone, by first-fit decreasing, with a tournament tree over the bins' free space.
Bins left with more than `slack` free tokens are cut into sequences whose lengths are powers of two, which need
no padding.

Null and empty texts are the end token alone. Rows are packed one by one, so repeated rows are packed as often
as they occur; a null doc_id is carried along. Groups are dealt by doc_id, place and ids together, so no doc_id makes
one hot; only rows that are equal in all of it share a group.
"""

from __future__ import annotations

import functools
import json
import math
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.llm.common import text_buffers

CAPACITY, SLACK, END = 4096, 64, 2
#: UTF-8 bytes of text a group of documents has on average; its tokens are fewer.
GROUP_BYTES = 4_000_000
#: Words whose ids a worker keeps at most.
CACHE = 500_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Words of Latin letters, in one normal form whichever way they are typed, and the punctuation behind them.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e]+)([!-&(-/:-@\\[-`{-~]*)")


#: The steps before the model that the short cut of word_encoder rests on.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


def by_words(tok) -> bool:
    """Whether a tokenizer's file is of the kind whose ids can be looked up word by word."""
    if not (tok.normalizer and tok.pre_tokenizer):
        return False
    normal, pre = (json.loads(p.__getstate__()) for p in (tok.normalizer, tok.pre_tokenizer))
    steps = pre.get("pretokenizers", [])
    return normal.get("normalizers") == _NORMALIZER and len(steps) == 2 and steps[0] == _SPLIT and steps[1].get("type") == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]


def byte_letters() -> dict[int, str]:
    """The visible letter that byte-level tokenizers write for each byte: itself, or one of those from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(rest)}


def word_encoder(path: str) -> Callable[[bytes], bytes]:
    """From a text's UTF-8 bytes to its ids as little-endian uint16.

    The pre-tokenizer never joins across a space or a line break, so ids of the words between them are looked up
    one by one. A new word goes to the tokenizer; if it is of Latin letters, and so a single pre-token but for
    punctuation at its end, straight to the tokenizer's model, which is several times quicker. Files of another kind
    are given whole texts.
    """
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    if tok.get_vocab_size() > 1 << 16:
        raise ValueError("ids don't fit 16 bits")
    tok.no_truncation()
    tok.no_padding()
    model, letters = tok.model, byte_letters()

    def packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}H", *ids)

    if not by_words(tok):
        return lambda text: packed(tok.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids)

    @functools.lru_cache(4096)
    def whole(word: str) -> bytes:
        return packed(tok.encode(word, add_special_tokens=False).ids)

    class Stems(dict):
        def __missing__(self, plain: str) -> bytes:
            if len(self) >= CACHE // 2:
                self.clear()
            ids = self[plain] = packed([t.id for t in model.tokenize(plain if plain.isascii() else plain.encode().decode("latin-1").translate(letters))])
            return ids

    stems = Stems()

    class Cache(dict):
        def __missing__(self, word: bytes) -> bytes:
            text = word.decode("utf-8", "replace")
            if (m := _PLAIN.fullmatch(text)) and len(word) < 64:
                ids = stems[m[1].lower()] + whole(m[2]) if m[2] else stems[m[1].lower()]
            else:
                ids = packed(tok.encode(text, add_special_tokens=False).ids)
            if len(self) >= CACHE:
                self.clear()
            if len(word) < 64:
                self[word] = ids
            return ids

    cache = Cache()
    return lambda text: b"".join(map(cache.__getitem__, text.replace(b"\n", b" ").split(b" ")))


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids (binary: little-endian uint16, the end token last) of every row."""
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_encoder(path), END.to_bytes(2, "little")
        for b in batches:
            for at in range(0, b.num_rows, 512):
                rows = b.slice(at, 512)
                data, offs = text_buffers(rows.column(1))
                whole, o = data[offs[0] : offs[-1]].tobytes(), (offs - offs[0]).tolist()
                ids = [encode(whole[i:j]) + end for i, j in zip(o, o[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size: largest first, each into the first bin with room, found in a tournament tree.

    The tree's leaves are the bins' free space, every inner node the larger of its two children, so the first bin
    with room is found from the root in steps of the logarithm of their number.
    """
    leaves = 1 << max(0, len(sizes) - 1).bit_length()
    tree = [capacity] * (2 * leaves)
    out = np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, at = int(sizes[i]), 1
        while at < leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        out[i] = at - leaves
        tree[at] -= size
        at //= 2
        while at:
            left, right = tree[2 * at], tree[2 * at + 1]
            best = left if left >= right else right
            if tree[at] == best:
                break
            tree[at] = best
            at //= 2
    return out


def powers_of_two(n: int) -> list[int]:
    """n as a sum of different powers of two, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def pack_group(sizes: np.ndarray, capacity: int = CAPACITY, slack: int = SLACK) -> list[tuple[int, int, int, int, int]]:
    """(piece, start in the piece, length, sequence, offset in the sequence) for pieces of at most capacity tokens."""
    bins: dict[int, list[int]] = {}
    for i, b in enumerate(first_fit_decreasing(sizes, capacity).tolist()):
        bins.setdefault(b, []).append(i)
    out, seq = [], 0
    for _, items in sorted(bins.items()):
        total = int(sizes[items].sum())
        lengths = [capacity] if total > capacity - slack else powers_of_two(total)
        room, offset = lengths[0], 0
        lengths = lengths[1:]
        for i in items:
            start = 0
            while start < sizes[i]:
                if offset == room:
                    room, offset, seq, lengths = lengths[0], 0, seq + 1, lengths[1:]
                n = min(int(sizes[i]) - start, room - offset)
                out.append((i, start, n, seq, offset))
                start, offset = start + n, offset + n
        seq += 1
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, slack: int = SLACK, seed: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset and ids (binary, little-endian uint32).

    The number of groups follows the bytes of text, so a group stays a few megabytes at any input size. Pieces are
    dealt by their content and the partition that they were read in, which spreads repeated rows over the groups.
    """
    total, rows = docs.select(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0)), F.count("*")).first()
    groups = max(1, math.ceil((total + 2 * rows) / GROUP_BYTES))
    step = 2 * capacity
    cut = tokenised(docs, id_col, text_col, tokenizer).select(
        "doc_id", (F.octet_length("ids") / 2).cast("long").alias("doc_tokens"), F.posexplode(F.expr(f"transform(sequence(0, (octet_length(ids) - 1) div {step}), k -> substring(ids, k * {step} + 1, {step}))")).alias("cut", "ids")
    )
    dealt = cut.withColumn("grp", F.pmod(F.xxhash64("doc_id", "cut", "doc_tokens", "ids", F.spark_partition_id(), F.lit(seed)), F.lit(groups)))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # any order of arrival gives the same packing
        pdf = pdf.sort_values(["doc_id", "cut", "doc_tokens", "ids"], kind="stable", na_position="first").reset_index(drop=True)
        sizes = (pdf["ids"].map(len) // 2).to_numpy(np.int64)
        placed = pack_group(sizes, capacity, slack)
        at = [p[0] for p in placed]
        ids = pdf["ids"].tolist()
        return pd.DataFrame({
            "doc_id": pdf["doc_id"].astype("Int64").take(at).array, "start": [int(pdf["cut"].iat[i]) * capacity + s for i, s, *_ in placed], "length": [p[2] for p in placed],
            "doc_tokens": pdf["doc_tokens"].take(at).array, "sequence_id": [(int(key[0]) << 24) + p[3] for p in placed], "offset": [p[4] for p in placed],
            "ids": [np.frombuffer(ids[i], "<u2", n, 2 * s).astype("<u4").tobytes() for i, s, n, _, _ in placed],
        })

    return dealt.groupBy("grp").applyInPandas(one, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


