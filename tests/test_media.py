"""Images, sounds and frames against plain versions; broken, empty and null files; repeated keys and empty tables."""

import math
import random
import wave
from functools import reduce
from io import BytesIO
from operator import add

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomset.operators import frames, hamming, images, sound


def ppm(x):
    return b"P%d # made here\n%d %d\n255\n" % (6 if x.shape[2] == 3 else 5, x.shape[1], x.shape[0]) + x.tobytes()


def waved(samples, rate=8000, channels=1, width=2):
    f = BytesIO()
    with wave.open(f, "wb") as w:
        w.setnchannels(channels), w.setsampwidth(width), w.setframerate(rate)
        w.writeframes(samples)
    return f.getvalue()


def test_fingerprints_within_a_distance_are_all_found(spark):
    draw = random.Random(4)
    for n_words, distance in ((1, 0), (1, 2), (1, 7), (2, 23), (3, 19), (2, 40)):
        rows = []
        for i in range(40):
            base = [draw.getrandbits(64) for _ in range(n_words)]
            rows.append(base)
            for off in (0, 1, distance, distance + 1):
                bits = draw.sample(range(64 * n_words), min(off, 64 * n_words))
                near = list(base)
                for b in bits:
                    near[b // 64] ^= 1 << b % 64
                rows.append(near)
        signed = [[w - (1 << 64) if w >> 63 else w for w in r] for r in rows]
        data = [(i, r) for i, r in enumerate(signed)] + [(None, signed[0]), (900, None), (901, []), (902, [None] * n_words)]
        df = spark.createDataFrame(data, "id long, words array<long>")
        first = {}
        for i, r in enumerate(rows):
            first.setdefault(tuple(r), i)
        one = sorted(first.items(), key=lambda x: x[1])
        want = {(a, b, d) for j, (p, a) in enumerate(one) for q, b in one[j + 1 :] if (d := sum((u ^ v).bit_count() for u, v in zip(p, q))) <= distance}
        got = [tuple(r) for r in hamming.near_fingerprints(df, "id", "words", distance, n_words).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        links = {r["id"]: r for r in hamming.linked(df, "id", "words", distance, n_words).collect()}
        assert set(links) == set(range(len(rows)))
        for i, r in enumerate(rows):
            assert links[i]["n_links"] == sum(sum((u ^ v).bit_count() for u, v in zip(r, q)) <= distance for q in rows) - 1
    with pytest.raises(ValueError):
        hamming.parts_of(24, 1)
    assert hamming.near_fingerprints(spark.createDataFrame([], "id long, words array<long>"), "id", "words", 3).count() == 0


def test_images_are_measured(spark):
    rng = np.random.default_rng(1)
    shapes = [(1, 1, 1), (5, 7, 3), (300, 260, 1), (40, 30, 3)]
    made = [rng.integers(0, 256, s).astype(np.uint8) for s in shapes]
    rows = [(i, ppm(x)) for i, x in enumerate(made)] + [(90, None), (91, b""), (92, b"P5\n9 9\n255\nshort"), (93, b"GIF89a"), (94, b"P5\n0 3\n255\n")]
    df = spark.createDataFrame(rows, "id long, image binary")
    got = {r["id"]: r for r in images.quality(df, "id", "image").collect()}
    assert set(got) == set(range(len(made)))
    for i, x in enumerate(made):
        h, w = x.shape[:2]
        luma = [[(int(p[0]) * 19595 + int(p[1]) * 38470 + int(p[2]) * 7471 + 32768) >> 16 if len(p) == 3 else int(p[0]) for p in row] for row in x]
        at = lambda r, c: luma[min(max(r, 0), h - 1)][min(max(c, 0), w - 1)]  # noqa: B023, E731
        edges = [at(r - 1, c) + at(r + 1, c) + at(r, c - 1) + at(r, c + 1) - 4 * at(r, c) for r in range(h) for c in range(w)]
        assert got[i]["laplacian"] == pytest.approx(np.var(edges), abs=0.01) and (got[i]["width"], got[i]["height"]) == (w, h)
        assert got[i]["blur"] == ("high" if np.var(edges) < 100 else "medium" if np.var(edges) < 500 else "low")
    assert got[2]["resolution"] == "medium" and got[2]["issues"] == "" and got[2]["score"] == 1.0
    colours = {r["id"]: r for r in images.palette(spark.createDataFrame([(1, ppm(np.full((2, 2, 3), [200, 10, 20], np.uint8))), (2, ppm(np.zeros((3, 3, 1), np.uint8)))], "id long, image binary"), "id", "image").collect()}
    assert colours[1]["temperature"] == "warm" and colours[1]["saturation"] == 0.95 and colours[2]["is_dark"] and colours[2]["is_grey"]
    wide = b"P5\n2 1\n1023\n" + np.array([1023, 0], ">u2").tobytes()
    assert images.pixels(wide).ravel().tolist() == [255, 0] and images.pixels(ppm(made[1])).tolist() == made[1].tolist()


def test_like_images_link_and_others_do_not(spark):
    rng = np.random.default_rng(2)
    base = [np.kron(rng.integers(0, 256, (8, 8)), np.ones((12, 12))).astype(np.uint8)[:, :, None] for _ in range(12)]
    rows = []
    for i, x in enumerate(base):
        rows += [(10 * i, ppm(x)), (10 * i + 1, ppm(x)), (10 * i + 2, ppm(np.clip(x.astype(int) + rng.integers(-4, 5, x.shape), 0, 255).astype(np.uint8)))]
    df = spark.createDataFrame([*rows, (999, b"no image")], "id long, image binary")
    words = {i: images.fingerprint(images.pixels(d)) for i, d in rows}
    away = {(a, b): sum(((p ^ q) & (1 << 64) - 1).bit_count() for p, q in zip(words[a], words[b])) for a in words for b in words}
    got = {r["id"]: r["n_links"] for r in images.linked_images(df, "id", "image", 0.9).collect()}
    assert got == {a: sum(away[a, b] <= 19 for b in words) - 1 for a in words}
    assert all(got[10 * i] >= 2 for i in range(12))
    assert all(r["similarity"] >= 0.9 for r in images.similar_images(df, "id", "image", 0.9).collect())


def test_fingerprint_equals_a_plain_version():
    rng = np.random.default_rng(5)
    g = rng.integers(0, 256, (64, 96))

    def mean(r0, r1, c0, c1):
        return g[r0:r1, c0:c1].mean()

    small = [[mean(r * 2, r * 2 + 2, c * 3, c * 3 + 3) for c in range(32)] for r in range(32)]
    low = [[sum(small[y][x] * math.cos(math.pi * u * (2 * y + 1) / 64) * math.cos(math.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]
    middle = np.median(low)
    want = int("".join("1" if f > middle else "0" for row in low for f in row), 2)
    areas = [[mean(r * 8, r * 8 + 8, c * 12, c * 12 + 12) for c in range(8)] for r in range(8)]
    whole = int("".join("1" if f > np.mean(areas) else "0" for row in areas for f in row), 2)
    got = images.fingerprint(g.astype(np.uint8)[:, :, None])
    assert [got[0] % (1 << 64), got[2] % (1 << 64)] == [want, whole]


def test_altered_images(spark):
    x = np.random.default_rng(3).integers(0, 256, (20, 30, 3)).astype(np.uint8)
    df = spark.createDataFrame([(1, ppm(x)), (2, None), (None, ppm(x))], "id long, image binary")

    def one(kind, amount=None, seed=0):
        got = {r["id"]: r["image"] for r in images.altered(df, "id", "image", kind, amount, seed).collect()}
        assert got[2] is None and images.pixels(got[None]) is not None
        return images.pixels(got[1])

    assert (one("flip_horizontal") == x[:, ::-1]).all() and (one("flip_vertical") == x[::-1]).all()
    assert (one("brightness", 0.5) == np.floor(x * 0.5 + 0.5)).all() and (one("contrast", 1.0) == x).all()
    assert (one("rotate", 90.0) == np.rot90(x)).all() and (one("rotate", 0.0) == x).all()
    assert one("crop").shape == (16, 24, 3) and (one("blur", 0.0) == x).all() and one("blur").std() < x.std()
    assert (one("greyscale")[:, :, 0] == images.grey(x)).all() and (one("noise") != one("noise", seed=1)).any() and (one("noise") == one("noise")).all()
    assert one("jitter").shape == x.shape
    with pytest.raises(ValueError):
        images.altered(df, "id", "image", "melted")


def test_sounds_are_decoded(spark):
    rng = np.random.default_rng(6)
    for width, kind, scale in ((1, np.uint8, 128), (2, "<i2", 32768), (4, "<i4", 2147483648)):
        raw = rng.integers(0, 256, 40 * width * 2).astype(np.uint8).tobytes()
        rate, x = sound.decoded(waved(raw, 8000, 2, width))
        v = np.frombuffer(raw, kind).astype(float)
        assert rate == 8000 and np.allclose(x, ((v - 128 if width == 1 else v) / scale).reshape(-1, 2).mean(axis=1))
    raw = rng.integers(0, 256, 30).astype(np.uint8).tobytes()
    assert np.allclose(sound.decoded(waved(raw, width=3))[1], [int.from_bytes(raw[k : k + 3], "little", signed=True) / 8388608 for k in range(0, 30, 3)])
    for payload in (b"", b"abc", bytes(range(256))):
        made = spark.createDataFrame([(payload,)], "b binary").select(sound.wav(F.col("b"), 1000).alias("w")).first()["w"]
        with wave.open(BytesIO(bytes(made))) as w:
            assert (w.getframerate(), w.getnchannels(), w.getsampwidth(), w.readframes(9999)) == (1000, 1, 1, payload)
        assert len(sound.decoded(bytes(made))[1]) == len(payload)
    assert sound.decoded(None) is None and sound.decoded(b"RIFF") is None and sound.decoded(b"RIFF0000WAVEdata\x04\x00\x00\x00abcd") is None


def tone(seconds, rate=8000, size=0.5, hertz=440.0):
    return size * np.sin(2 * np.pi * hertz * np.arange(int(seconds * rate)) / rate)


def test_speech_silence_noise_and_pieces(spark):
    rate = 8000
    x = np.concatenate([np.zeros(rate), tone(1.0), np.zeros(rate // 2), tone(0.1), np.zeros(rate // 2), tone(1.0)])
    rows = [(1, sound.encoded(rate, x)), (1, sound.encoded(rate, x)), (None, sound.encoded(rate, tone(2.0))), (2, sound.encoded(rate, np.zeros(rate))), (3, sound.encoded(rate, np.zeros(0))), (4, None), (5, b"RIFFxxxx")]
    df = spark.createDataFrame(rows, "id long, sound binary")

    level = [math.sqrt(sum(x[j] ** 2 for j in range(max(i * 80 - 100, 0), min(i * 80 + 100, len(x)))) / 200) for i in range(1 + len(x) // 80)]
    assert np.allclose(sound.loudness(x, 200, 80), level)
    loud, want, begin = [v / max(level) > 0.02 for v in level], [], None
    for i, on in enumerate(loud):
        if on and begin is None:
            begin = i
        if not on and begin is not None:
            want, begin = [*want, (begin, i)], None
    ends = [(a * 80 / rate, b * 80 / rate) for a, b in want] + ([(begin * 80 / rate, len(x) / rate)] if begin is not None else [])
    ends = [(round(a, 3), round(b, 3)) for a, b in ends if b - a >= 0.3]
    got = [(r["id"], r["start"], r["end"]) for r in sound.speech(df, "id", "sound").collect()]
    assert sorted(g[1:] for g in got if g[0] == 1) == sorted(ends * 2) and [g for g in got if g[0] is None] == [(None, 0.0, 2.0)] and {g[0] for g in got} == {1, None}

    kept = {r["id"]: r for r in sound.silence(df, "id", "sound").collect()}
    assert abs(kept[1]["start"] - rate) <= 1536 and kept[1]["end"] == len(x) and (kept[2]["start"], kept[2]["end"]) == (0, rate) and kept[3]["end"] == 0
    cut = {r["id"]: r["sound"] for r in sound.trimmed(df, "id", "sound").collect()}
    assert len(sound.decoded(bytes(cut[1]))[1]) == kept[1]["end"] - kept[1]["start"] and cut[4] is None and cut[5] is None

    parts = sorted((r["place"], r["start"], bytes(r["piece"])) for r in sound.pieces(df.filter("id = 2 or id = 3 or id is null"), "id", "sound", 0.75).filter("id is null").collect())
    assert [p[1] for p in parts] == [0, 6000, 12000] and np.allclose(np.concatenate([sound.decoded(p[2])[1] for p in parts]), tone(2.0), atol=1e-4)
    assert sound.pieces(df.filter("id = 3"), "id", "sound").count() == 0

    n = {r["id"]: r for r in sound.noise(df, "id", "sound").collect()}
    order = sorted(level)
    assert n[1]["signal"] == pytest.approx(np.mean(order[int(len(order) * 0.7) :]), abs=1e-4) and n[2]["snr"] == math.inf and n[2]["snr_class"] == "excellent"
    t = {r["id"]: r for r in sound.duration(df, "id", "sound", 1.5).collect()}
    assert t[1]["issue"] is None and t[2]["issue"] == "too_short" and t[None]["seconds"] == 2.0


def test_clarity_equals_a_plain_version(spark):
    rate, rng = 4000, np.random.default_rng(8)
    x = rng.uniform(-0.5, 0.5, 1500)
    padded = np.concatenate([np.zeros(1024), x, np.zeros(1024)])
    rows = []
    for k in range(1 + len(x) // 512):
        part = padded[k * 512 : k * 512 + 2048] * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(2048) / 2048))
        s = np.abs(np.exp(-2j * np.pi * np.outer(np.arange(1025), np.arange(2048)) / 2048) @ part)
        f = np.arange(1025) * rate / 2048
        c = (s * f).sum() / s.sum()
        rows.append((c, f[np.flatnonzero(np.cumsum(s) >= 0.85 * s.sum())[0]], math.sqrt((s / s.sum() * (f - c) ** 2).sum())))
    edged = np.pad(x, 1024, "edge")
    crossings = [sum((edged[j] < 0) != (edged[j - 1] < 0) for j in range(k * 512 + 1, k * 512 + 2048)) / 2048 for k in range(len(rows))]
    assert np.allclose(sound.spectral(rate, x), [*np.mean(rows, axis=0), np.mean(crossings)])
    df = spark.createDataFrame([(1, sound.encoded(rate, x)), (2, sound.encoded(rate, np.zeros(0))), (3, None)], "id long, sound binary")
    got = {r["id"]: r for r in sound.clarity(df, "id", "sound").collect()}
    assert set(got) == {1, 2} and got[2]["centroid"] == 0 and got[1]["clarity"] == pytest.approx(min(1, max(0, 0.5 + got[1]["centroid"] / 4000 * 0.3 - got[1]["crossings"] * 0.5)), abs=1e-3)


def test_altered_sounds(spark):
    rate, x = 8000, tone(0.5, 8000, 0.4, 200.0) + tone(0.5, 8000, 0.4, 3500.0)
    df = spark.createDataFrame([(1, sound.encoded(rate, x)), (2, None)], "id long, sound binary")

    def one(kind, amount=None):
        got = {r["id"]: r["sound"] for r in sound.altered(df, "id", "sound", kind, amount).collect()}
        assert got[2] is None
        return sound.decoded(bytes(got[1]))[1]

    assert np.allclose(one("volume", 0.5), x * 0.5, atol=1e-4) and np.allclose(one("shift", 100.0)[800:], x, atol=1e-4) and np.allclose(one("shift", -100.0), x[800:], atol=1e-4)
    assert np.allclose(one("low_pass", 1000.0)[400:-400], tone(0.5, 8000, 0.4, 200.0)[400:-400], atol=0.01)
    late = x.copy()
    for k in (1, 2, 3):
        for j in range(240 * k, len(x)):
            late[j] += x[j - 240 * k] * 0.3**k
    assert np.allclose(one("reverb", 0.3), np.clip(late / np.abs(late).max(), -1, 32767 / 32768), atol=1e-4)
    assert 0 < np.abs(one("noise", 0.01) - x).mean() < 0.02 and (one("noise") == one("noise")).all()
    with pytest.raises(ValueError):
        sound.altered(df, "id", "sound", "louder")


def test_scenes_stability_and_like_films(spark):
    rng = np.random.default_rng(9)
    rows, films = [], {}
    for v in range(4):
        picture = [np.kron(rng.integers(0, 256, (8, 8, 3)), np.ones((6, 6, 1))).astype(np.uint8) for _ in range(3)]
        films[v] = [np.clip(picture[k // 10].astype(int) + rng.integers(0, 3, (48, 48, 3)), 0, 255).astype(np.uint8) for k in range(25)]
        films[v + 10] = films[v]
        films[v + 20] = [np.clip(f.astype(int) + 2, 0, 255).astype(np.uint8) for f in films[v]]
    films[50] = [np.zeros((4, 4, 1), np.uint8)]
    rows = [(v, k, ppm(x)) for v, fs in films.items() for k, x in enumerate(fs)]
    df = spark.createDataFrame([*rows, (None, 0, rows[0][2]), (60, 0, None), (61, None, rows[0][2])], "video long, frame long, image binary")
    seen = frames.looked(df, "video", "frame", "image")

    def distance(a, b):
        p, q = frames.histogram(a).astype(float), frames.histogram(b).astype(float)
        return math.sqrt(max(0, 1 - np.sqrt(p * q).sum() / math.sqrt(p.sum() * q.sum())))

    want = set()
    for v, fs in films.items():
        start = 0
        for k in range(1, len(fs)):
            if (d := distance(fs[k - 1], fs[k])) > 0.6:
                if (k - start) / 5 >= 1:
                    want.add((v, start / 5, k / 5, round(d, 4)))
                start = k
        if (len(fs) - start) / 5 >= 1:
            want.add((v, start / 5, len(fs) / 5, 0.0))
    assert {tuple(r) for r in frames.scenes(seen, 5.0, 60.0).collect()} == want and len([w for w in want if w[0] == 0]) == 3

    steady = {r["video"]: r for r in frames.stability(seen).collect()}
    for v, fs in films.items():
        g = [images.grey(f) for f in fs]
        d = [np.abs(b - a).mean() for a, b in zip(g, g[1:])]
        if d:
            assert steady[v]["mean"] == pytest.approx(np.mean(d), abs=0.006) and steady[v]["steady"] == bool(np.std(d) < 10 and max(d) < 50)
    assert set(steady) == set(films) - {50}
    quality = {r["video"]: r for r in frames.quality(seen).collect()}
    assert quality[50]["blurry_share"] == 1.0 and quality[50]["dark"] == 1 and quality[50]["issues"] == "too_many_blurry_frames" and quality[0]["frames"] == 25

    def words(fs):
        return [w for i in range(8) for w in images.fingerprint(fs[i * len(fs) // 8])[:2]]

    hashes = {r["video"]: r["video_hash"] for r in frames.video_hashes(df, "video", "frame", "image").collect()}
    assert set(hashes) == set(films) and hashes[0] == hashes[10]
    w = {v: words(fs) for v, fs in films.items() if not 10 <= v < 20}  # 10 to 13 are copies, and in the class of 0 to 3
    like = {(a, b) for a in w for b in w if a < b and sum(((p ^ q) & (1 << 64) - 1).bit_count() for p, q in zip(w[a], w[b])) <= 153}
    got = {(r["a"], r["b"]) for r in frames.similar_videos(df, "video", "frame", "image").collect()}
    assert got == {p for p in like if w[p[0]] != w[p[1]]} and {(0, 20), (1, 21)} <= like


def test_frames_are_compared_within_runs(spark):
    """Runs' borders, repeated and negative numbers, gaps and changing sizes, held against all pairs; nothing is joined and no picture is written."""
    rng = np.random.default_rng(3)
    numbers = [*range(-2, frames.RUN * 2 + 3), frames.RUN, 700, 700, 701, 701, 703]
    rows = [(v, k, ppm(rng.integers(0, 256, (2, 3 + (k % 50 == 7), 1 + 2 * (k % 90 == 5)), dtype=np.uint8))) for v in (1, 2) for k in numbers]
    rng.shuffle(rows)
    seen = frames.looked(spark.createDataFrame([(int(v), int(k), d) for v, k, d in rows], "video long, frame long, image binary").repartition(3), "video", "frame", "image")
    assert seen.columns == ["video", "frame", "sharpness", "brightness", "changes"] and seen.count() == len(rows)
    want = []
    for v, k, d in rows:
        for w, j, e in rows:
            if v == w and int(j) == int(k) - 1:
                x, y = images.pixels(d), images.pixels(e)
                p, q = frames.histogram(x).astype(float), frames.histogram(y).astype(float)
                score = math.sqrt(max(0, 1 - np.sqrt(p * q).sum() / math.sqrt(p.sum() * q.sum()))) if len(p) == len(q) else 1.0
                want.append((int(v), int(k), round(score, 6), round(np.abs(images.grey(x) - images.grey(y)).mean(), 6) if x.shape[:2] == y.shape[:2] else -1))
    got = frames.changes(seen)
    assert "Join" not in got._jdf.queryExecution().toString()
    assert sorted((r["video"], r["frame"], round(r["score"], 6), -1 if r["difference"] is None else round(r["difference"], 6)) for r in got.collect()) == sorted(want)


def test_fingerprints_are_made_once(spark):
    """Links read the fingerprints several times, but each image is looked at once."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<long>")
    def words(i):
        made.add(1)
        return [i // 2, 0, 0]

    got = {r["id"]: r["n_links"] for r in hamming.linked(spark.range(20).select("id", words("id").alias("words")), "id", "words", 1, 3).collect()}
    assert made.value == 20 and got == {i: sum((i // 2 ^ j // 2).bit_count() < 2 for j in range(20)) - 1 for i in range(20)}


def test_tables_without_rows(spark):
    empty = spark.createDataFrame([], "id long, frame long, image binary")
    assert images.quality(empty, "id", "image").count() == images.linked_images(empty, "id", "image").count() == sound.speech(empty, "id", "image").count() == 0
    seen = frames.looked(empty, "id", "frame", "image")
    assert frames.scenes(seen).count() == frames.quality(seen).count() == frames.similar_videos(empty, "id", "frame", "image").count() == 0


def test_palette_at_its_limits(spark):
    """Means that are right at 0.7 or 0.3 but for rounding fall where sums in order put them."""
    draw = np.random.default_rng(5)
    rows, want = [], {}
    for i in range(60):
        limit = (0.7, 0.3)[i % 2]
        x = draw.integers(0, 256, 64)
        while (off := int(limit * 255 * 64 + 0.5) - int(x.sum())):  # the brightest channel's mean is the limit
            k = draw.integers(0, 64)
            x[k] = np.clip(x[k] + off, 0, 255)
        rows.append((i, ppm(np.repeat(x.astype(np.uint8)[None, :, None], 3, 2))))
        top = reduce(add, (int(v) / 255 for v in x)) / 64  # sum() would compensate
        want[i] = (top < 0.3, top > 0.7)
    got = {r.id: (r.is_dark, r.is_bright) for r in images.palette(spark.createDataFrame(rows, "id long, image binary"), "id", "image").collect()}
    assert got == want


def test_long_fingerprints_meet_in_blocks(spark, monkeypatch):
    """Every pair of 16 words within the distance, whatever blocks it is in, and a row moved once for each block at most."""
    rng = np.random.default_rng(4)
    base = rng.integers(-(1 << 62), 1 << 62, (12, 16))
    rows = []
    for k in range(120):
        w = base[k % 12].copy()
        for bit in rng.choice(1024, rng.integers(0, 120), replace=False):
            w[bit // 64] ^= np.int64(np.uint64(1 << int(bit % 64)).astype(np.int64))
        rows.append((k, w.tolist()))
    monkeypatch.setattr(hamming, "BLOCK_ROWS", (25, 25))
    df = spark.createDataFrame(rows, "id long, words array<long>")
    got = sorted(tuple(r) for r in hamming.near_fingerprints(df, "id", "words", 153, 16).collect())
    x = np.array([w for _, w in rows]).view(np.uint64)
    off = np.bitwise_count(x[:, None] ^ x[None]).sum(axis=2, dtype=np.int64)
    want = sorted((a, b, int(off[a, b])) for a in range(120) for b in range(a + 1, 120) if off[a, b] <= 153)
    assert got == want and len({a % 12 for a, _, _ in want}) == 12
    assert hamming.near_blocks(spark.createDataFrame([], "id long, words array<long>"), 153).count() == 0


def test_few_words_tell_most_fingerprints_apart(monkeypatch):
    """All rows are compared by some words, few by all, and no pair is lost, whichever words tell rows apart."""
    rng = np.random.default_rng(5)
    for n_words, distance in ((1, 3), (3, 19), (4, 60), (16, 153)):
        a = rng.integers(0, 1 << 63, (300, n_words), np.uint64) * np.uint64(2)
        a[:, : n_words // 2] = 7  # tells nothing
        b = np.r_[a[:90] ^ np.uint64(1 << 5), a[:40], rng.integers(0, 1 << 63, (200, n_words), np.uint64)]
        got = sorted(zip(*(v.tolist() for v in hamming.near_rows(a, b, distance)), strict=True))
        off = np.bitwise_count(a[:, None] ^ b[None]).sum(axis=2, dtype=np.int64)
        assert got == [(i, j, off[i, j]) for i, j in np.argwhere(off <= distance).tolist()] and len(got) >= 130
    heads, plain = [], hamming.first_bits
    monkeypatch.setattr(hamming, "first_bits", lambda left, turned, cols, head, tile: heads.append(head) or plain(left, turned, cols, head, tile))
    hamming.near_rows(*(rng.integers(0, 1 << 63, (2000, 16), np.uint64) for _ in "ab"), 153)
    assert max(heads) < 9


def test_pictures_of_one_size_get_fingerprints_together():
    """The same words as one by one, whatever the order of sizes; areas are worked out once a size."""
    rng = np.random.default_rng(6)
    pictures = [None if k % 7 == 0 else rng.integers(0, 256, [(16, 16, 1), (5, 64, 1), (40, 33, 3)][k % 3]).astype(np.uint8) for k in range(60)]
    assert images.fingerprints_of(pictures) == [images.fingerprint(x) for x in pictures]
    x = np.arange(256, dtype=np.uint8).reshape(16, 16, 1)
    assert images.fingerprint(x)[2] == sum(1 << (63 - k) for k in range(32, 64))


def test_files_are_measured_in_slices(spark, monkeypatch):
    """Slices of a few files give what whole batches give; lengths need no samples, and broken files give no rows."""
    from loomset.operators import shared

    rows = [(k, waved(bytes(range(100, 100 + k % 50)) * 2 * (1 + k % 3), rate=100)) for k in range(40)] + [(40, None), (41, b"RIFF"), (None, waved(b"\1\2" * 300, rate=100))]
    df = spark.createDataFrame(rows, "k long, s binary").coalesce(1)
    want = [sorted(map(tuple, f(df, "k", "s").collect()), key=repr) for f in (sound.noise, sound.duration, lambda *a: sound.pieces(*a, 1.0), lambda *a: sound.speech(*a, 0.5, 0.01))]
    monkeypatch.setattr(shared, "SLICE_BYTES", 300)
    got = [sorted(map(tuple, f(df, "k", "s").collect()), key=repr) for f in (sound.noise, sound.duration, lambda *a: sound.pieces(*a, 1.0), lambda *a: sound.speech(*a, 0.5, 0.01))]
    assert got == want and len(got[1]) == 41
    seconds = {k: round(len(sound.decoded(s)[1]) / 100, 2) for k, s in rows if s and len(s) > 4}
    assert {r[0]: r[1] for r in got[1]} == seconds
