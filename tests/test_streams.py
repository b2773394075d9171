"""Streams over several files against one pass over all rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomset.streaming import events

START = datetime(2024, 1, 1)


@pytest.fixture
def rows(spark, tmp_path):
    """Three files, one after the other in time, and all their rows."""
    rng = random.Random(4)
    all_, t = [], START
    for k in range(600):
        t += timedelta(seconds=rng.choice([0, 1, 5, 20, 90, 3600]))
        all_.append((k, t, rng.randrange(4) if k % 97 else None, rng.choice(["view", "error", "click"]), float(k % 7), None))
    for n in range(3):
        part = all_[n * 200 : n * 200 + 200]
        rng.shuffle(part)
        spark.createDataFrame(part, events.EVENT.replace("ts timestamp", "ts timestamp_ntz")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return all_


def run(spark, tmp_path, make, name="out"):
    stream = make(events.event_stream(spark, f"{tmp_path}/in"))
    return events.drained(stream, f"{tmp_path}/{name}", f"{tmp_path}/{name}-state").collect()


def by_user(rows):
    out = {}
    for r in rows:
        out.setdefault(r[2], []).append(r)
    return out


def test_changes(spark, tmp_path, rows):
    want = [(u, r[0], r[3]) for u, own in by_user(rows).items() for was, r in zip([None, *own], own) if was is None or was[3] != r[3]]
    got = run(spark, tmp_path, lambda s: events.changes(s, "user_id", "event_type"))
    assert sorted(((r.user_id, r.event_id, r.value) for r in got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize(("limit", "seconds"), [(1, 10), (3, 60), (5, 4000)])
def test_limits(spark, tmp_path, rows, limit, seconds):
    want = {}
    for own in by_user(rows).values():
        kept = []
        for r in own:
            want[r[0]] = sum((r[1] - k).total_seconds() < seconds for k in kept) < limit
            kept += [r[1]] * want[r[0]]
    got = run(spark, tmp_path, lambda s: events.rate_limited(s, "user_id", limit, seconds))
    assert {r.event_id: r.allowed for r in got} == want and len(got) == len(rows) and {True, False} == set(want.values())


class Breaker:
    """One breaker, call by call."""

    def __init__(self, failures, reset, trials):
        self.failures, self.reset, self.trials = failures, reset, trials
        self.in_row, self.since, self.state, self.good = 0, None, "closed", 0

    def call(self, at, bad):
        if self.state == "open" and (at - self.since).total_seconds() >= self.reset:
            self.state, self.good = "half-open", 0
        if self.state == "open":
            return False
        if bad:
            self.in_row, self.since = self.in_row + 1, at
            if self.state == "half-open" or self.in_row >= self.failures:
                self.state = "open"
        elif self.state == "half-open":
            self.good += 1
            if self.good == self.trials:
                self.state, self.in_row = "closed", 0
        else:
            self.in_row = 0
        return True


def test_breakers(spark, tmp_path, rows):
    want, states = {}, set()
    for own in by_user(rows).values():
        b = Breaker(2, 60, 2)
        for r in own:
            allowed = b.call(r[1], r[3] == "error")
            want[r[0]] = (allowed, b.state)
            states.add(b.state)
    got = run(spark, tmp_path, lambda s: events.breaker(s, "user_id", F.col("event_type") == "error", 2, 60, 2))
    assert {r.event_id: (r.allowed, r.state) for r in got} == want and len(got) == len(rows) and states == {"closed", "open", "half-open"}


def test_counts_and_first_arrivals(spark, tmp_path, rows):
    last = max(r[1] for r in rows) - timedelta(minutes=10)
    want = {}
    for r in rows:
        key = (r[1].replace(minute=0, second=0), r[3])
        if key[0] + timedelta(hours=1) <= last:
            n, total = want.get(key, (0, 0.0))
            want[key] = (n + 1, total + r[4])
    got = run(spark, tmp_path, lambda s: events.windowed_counts(s, size="1 hour"))
    assert {(r.start, r.event_type): (r.n, r.total) for r in got} == want
    first = run(spark, tmp_path, lambda s: events.first_arrivals(s.withColumn("k", F.col("event_id") % 5), ["k"], "3000 hours"), "first")
    assert sorted(r.k for r in first) == [0, 1, 2, 3, 4]
