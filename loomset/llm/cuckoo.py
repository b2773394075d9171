"""Cuckoo filters over 64-bit hashes: a set that also forgets, with few false positives and no false negatives.

A filter is an array of buckets with four 16-bit fingerprints each (0: free). A hash has two buckets; either follows
from the other and the fingerprint, so an entry can move, and be deleted, without its hash.
"""

from __future__ import annotations

import numpy as np

from loomset.llm.common import mixed

SLOTS = 4
#: Part of the slots that may be taken when a filter is built, and moves that an insertion may make.
LOAD, MOST_MOVES = 0.85, 500


def buckets_for(keys: int) -> int:
    """A power of two that holds so many keys."""
    return 1 << max(0, int(np.ceil(np.log2(max(1, keys) / (SLOTS * LOAD)))))


def _fingerprints(hashes: np.ndarray) -> np.ndarray:
    return ((mixed(hashes + np.uint64(0x14057B7EF767814F)) >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)


def _firsts(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(hashes) & np.uint64(buckets - 1)).astype(np.int64)


def _other(bucket: np.ndarray | int, prints: np.ndarray | int, buckets: int) -> np.ndarray:
    turn = mixed(np.asarray(prints, np.uint64) + np.uint64(0x5851F42D4C957F2D))
    return np.asarray(bucket, np.int64) ^ (turn & np.uint64(buckets - 1)).astype(np.int64)


def contains(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the filter."""
    prints, first = _fingerprints(hashes), _firsts(hashes, len(table))
    return ((table[first] == prints[:, None]) | (table[_other(first, prints, len(table))] == prints[:, None])).any(axis=1)


def _fill(table: np.ndarray, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Puts fingerprints into free slots of their buckets, as many as go; gives those left over."""
    order = np.argsort(bucket, kind="stable")
    place = bucket[order]
    new = np.ones(len(place), bool)
    new[1:] = place[1:] != place[:-1]
    rank = np.arange(len(place)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(place) else place
    free = np.argsort(table[place] != 0, axis=1, kind="stable")  # a bucket's free slots first
    fits = rank < (table[place] == 0).sum(axis=1)
    table[place[fits], free[fits, rank[fits]]] = prints[order[fits]]
    return order[~fits]


def insert(table: np.ndarray, hashes: np.ndarray) -> bool:
    """Adds hashes that aren't in the filter; False if it's too full, and then some are missing."""
    prints, bucket = _fingerprints(hashes), _firsts(hashes, len(table))
    left = _fill(table, bucket, prints)
    prints, bucket = prints[left], _other(bucket[left], prints[left], len(table))
    left = _fill(table, bucket, prints)
    for moving, at in zip(prints[left].tolist(), bucket[left].tolist(), strict=True):
        for move in range(MOST_MOVES):
            free = np.flatnonzero(table[at] == 0)
            if len(free):
                table[at, free[0]] = moving
                break
            slot = (at + move + moving) % SLOTS
            moving, table[at, slot] = int(table[at, slot]), moving
            at = int(_other(at, moving, len(table)))
        else:
            return False
    return True


def delete(table: np.ndarray, hashes: np.ndarray) -> None:
    """Takes one entry of each hash out; only hashes that were inserted may be given."""
    for moving, first in zip(_fingerprints(hashes).tolist(), _firsts(hashes, len(table)).tolist(), strict=True):
        for at in (first, int(_other(first, moving, len(table)))):
            have = np.flatnonzero(table[at] == moving)
            if len(have):
                table[at, have[0]] = 0
                break


def built(hashes: np.ndarray) -> np.ndarray:
    """A filter of hashes, as large as it must be."""
    buckets = buckets_for(len(hashes))
    while True:
        table = np.zeros((buckets, SLOTS), np.uint16)
        if insert(table, hashes):
            return table
        buckets *= 2


def stored(table: np.ndarray) -> bytes:
    return table.tobytes()


def loaded(data: bytes) -> np.ndarray:
    """A filter from stored(), to be read; copy() it to change it."""
    return np.frombuffer(data, np.uint16).reshape(-1, SLOTS)
