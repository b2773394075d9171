"""Sounds as PCM WAV files in a binary column: speech, silence, pieces, noise, clarity and alterations.

Tasks decode in Arrow batches and give short arrays of frame measures; runs of frames are found by array expressions
within the row, so nothing is shuffled and no key can be hot. Samples of 8, 16, 24 and 32 bits count from -1 to 1,
channels are averaged. A null value, a file cut short before its samples, or of another format, has null measures and
gives no rows; a sound without samples has one silent frame.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.operators.shared import in_slices


def wav(samples: Column, rate: int) -> Column:
    """Bytes as unsigned 8-bit samples of one channel, with their header before them."""
    n = F.octet_length(samples)

    def word(c: Column | int, size: int) -> Column:
        """A whole number's lowest bytes, the least first."""
        digits = F.lpad(F.hex(F.lit(c) if isinstance(c, int) else c), 8, "0")
        return F.unhex(F.concat(*(F.substring(digits, 7 - 2 * k, 2) for k in range(size))))

    text = lambda s: F.encode(F.lit(s), "UTF-8")
    odd = F.when(n % 2 == 1, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("")))
    return F.concat(text("RIFF"), word(n + 36 + n % 2, 4), text("WAVEfmt "), word(16, 4), word(1, 2), word(1, 2), word(rate, 4), word(rate, 4), word(1, 2), word(8, 2), text("data"), word(n, 4), samples, odd)


def _layout(data: bytes | None) -> tuple[int, int, int, int, int] | None:
    """Rate, channels, bytes a sample, where the samples begin and how many whole ones of all channels there are, read chunk by chunk."""
    if not data or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt " and size >= 16 and at + 24 <= len(data):
            form = struct.unpack_from("<HHIIHH", data, at + 8)
        if name == b"data":
            if not form or form[0] not in (1, 65534) or form[1] < 1 or form[2] < 1 or form[5] not in (8, 16, 24, 32):
                return None
            channels, rate, width = form[1], form[2], form[5] // 8
            return rate, channels, width, at + 8, min(size, len(data) - at - 8) // (width * channels)
        at += 8 + size + size % 2
    return None


def decoded(data: bytes | None) -> tuple[int, np.ndarray] | None:
    """Rate and samples of a PCM file; a last chunk cut short counts as far as it goes."""
    form = _layout(data)
    if form is None:
        return None
    rate, channels, width, at, n = form
    raw = np.frombuffer(data, np.uint8, n * width * channels, at)
    if width == 1:
        x = (raw.astype(np.float64) - 128) / 128
    else:
        wide = np.zeros((len(raw) // width, 4), np.uint8)
        wide[:, 4 - width :] = raw.reshape(-1, width)
        x = wide.view("<i4").ravel() / 2147483648.0
    return rate, x.reshape(-1, channels).mean(axis=1) if channels > 1 else x


def encoded(rate: int, x: np.ndarray) -> bytes:
    """A file of one channel of 16 bits."""
    body = np.clip(np.floor(x * 32768 + 0.5), -32768, 32767).astype("<i2").tobytes()
    return struct.pack("<4sI8sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVEfmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", len(body)) + body


def loudness(x: np.ndarray, frame: int, hop: int) -> np.ndarray:
    """Root mean square of the frames centred on every hop, silence beyond both ends."""
    sums = np.concatenate([[0.0], np.cumsum(x * x)])
    n = 1 + max(len(x) + 2 * (frame // 2) - frame, 0) // hop
    first = np.arange(n) * hop - frame // 2
    return np.sqrt(np.maximum(sums[np.clip(first + frame, 0, len(x))] - sums[np.clip(first, 0, len(x))], 0) / frame)


def _framed(sounds: DataFrame, key: str, sound: str, seconds: tuple[float, float] | None = (0.025, 0.010), samples: tuple[int, int] = (2048, 512)) -> DataFrame:
    """key, rate, n (samples), frame, hop (samples) and rms of every sound; frames by seconds, or by samples where those are None."""

    def measure(data: list[bytes | None]) -> tuple[np.ndarray, list]:
        at, out = [], []
        for k, got in enumerate(map(decoded, data)):
            if got is not None:
                rate, x = got
                frame, hop = (max(int(s * rate), 1) for s in seconds) if seconds else samples
                at.append(k)
                out.append((rate, len(x), frame, hop, np.round(loudness(x, frame, hop), 9)))
        return at, list(zip(*out, strict=True)) or [[]] * 5

    whole = [(c, "int", pa.int32()) for c in ("frame", "hop")]
    return in_slices(sounds, F.col(key), F.col(sound), measure, [("rate", "int", pa.int32()), ("n", "long", pa.int64()), *whole, ("rms", "array<double>", pa.list_(pa.float64()))])


def speech(sounds: DataFrame, key: str, sound: str, threshold: float = 0.02, least: float = 0.3) -> DataFrame:
    """key, start, end (seconds): runs of frames over the threshold (a share of the loudest), of so many seconds at least."""
    x = _framed(sounds, key, sound).withColumn("top", F.greatest(F.array_max("rms"), F.lit(1e-10)))
    x = x.select("key", "rate", "n", "hop", F.transform("rms", lambda r: r / F.col("top") > threshold).alias("loud"))
    before = lambda i: F.coalesce(F.get("loud", i - 1), F.lit(False))
    places = F.sequence(F.lit(0), F.size("loud") - 1)
    starts = F.filter(places, lambda i: F.get("loud", i) & ~before(i))
    ends = F.filter(places, lambda i: ~F.get("loud", i) & before(i))
    runs = x.select("key", "rate", "n", "hop", F.explode(F.arrays_zip(starts.alias("a"), ends.alias("b"))).alias("run"))
    begin, end = F.col("run.a") * F.col("hop") / F.col("rate"), F.coalesce(F.col("run.b") * F.col("hop"), F.col("n")) / F.col("rate")
    return runs.filter(end - begin >= least - 1e-9).select(F.col("key").alias(key), F.round(begin, 3).alias("start"), F.round(end, 3).alias("end"))


def silence(sounds: DataFrame, key: str, sound: str, below: float = 30.0) -> DataFrame:
    """key, n, start, end (samples): what is left between silences of so many decibels below the loudest frame of 2048 samples; a sound silent all over is left whole."""
    x = _framed(sounds, key, sound, seconds=None)
    level = lambda r: F.greatest(r, F.lit(1e-5))
    x = x.withColumn("top", level(F.array_max("rms")))
    x = x.withColumn("loud", F.filter(F.transform("rms", lambda r, i: F.when(20 * F.log10(level(r) / F.col("top")) > -below, i)), lambda i: i.isNotNull()))
    return x.select(F.col("key").alias(key), "n", (F.array_min("loud") * F.col("hop")).cast("long").alias("start"), F.least("n", (F.array_max("loud") + 1) * F.col("hop")).cast("long").alias("end"))


def trimmed(sounds: DataFrame, key: str, sound: str, below: float = 30.0) -> DataFrame:
    """key and the sound without the silence at both ends, of 16 bits; found and cut in one pass."""

    @F.pandas_udf("binary")
    def cut(data: pd.Series) -> pd.Series:
        out = []
        for d in data:
            got = decoded(d)
            if got is not None:
                level = np.maximum(np.round(loudness(got[1], 2048, 512), 9), 1e-5)
                loud = np.flatnonzero(20 * np.log10(level / level.max()) > -below)
                got = got[0], got[1][loud[0] * 512 : (loud[-1] + 1) * 512]
            out.append(None if got is None else encoded(*got))
        return pd.Series(out, dtype=object)

    return sounds.select(key, cut(F.col(sound)).alias(sound))


def pieces(sounds: DataFrame, key: str, sound: str, seconds: float = 30.0) -> DataFrame:
    """key, place, start (samples), n and piece: the sound in files of so many seconds, the last shorter; no samples, no pieces."""

    def cut(data: list[bytes | None]) -> tuple[np.ndarray, list]:
        out = []
        for k, got in enumerate(map(decoded, data)):
            size = max(int(seconds * got[0]), 1) if got else 1
            for a in range(0, len(got[1]) if got else 0, size):
                x = got[1][a : a + size]
                out.append((k, a // size, a, len(x), encoded(got[0], x)))
        at, *values = zip(*out, strict=True) if out else [[]] * 5
        return at, values

    x = in_slices(sounds, F.col(key), F.col(sound), cut, [("place", "int", pa.int32()), ("start", "long", pa.int64()), ("n", "long", pa.int64()), ("piece", "binary", pa.binary())])
    return x.withColumnRenamed("key", key)


def noise(sounds: DataFrame, key: str, sound: str) -> DataFrame:
    """key, noise and signal (means of the quietest and the loudest three tenths of the frames), snr in decibels (infinite without noise) and its class."""
    x = _framed(sounds, key, sound).withColumn("s", F.array_sort("rms")).withColumn("k", F.floor(F.size("s") * F.lit(0.3)).cast("int")).withColumn("from", F.floor(F.size("s") * F.lit(0.7)).cast("int"))
    mean = lambda c: F.try_divide(F.aggregate(c, F.lit(0.0), lambda n, v: n + v), F.size(c))
    x = x.select("key", mean(F.slice("s", F.lit(1), F.col("k"))).alias("noise"), mean(F.slice("s", F.col("from") + 1, F.size("s"))).alias("signal"))
    quiet = F.coalesce(F.col("noise") > 0, F.lit(False))
    db = F.when(quiet & (F.col("signal") > 0), 20 * F.log10(F.col("signal") / F.col("noise"))).otherwise(F.lit(float("inf")))
    kind = F.when(db < 10, "poor").when(db < 20, "fair").when(db < 30, "good").otherwise("excellent")
    return x.select(F.col("key").alias(key), F.round("noise", 6).alias("noise"), F.round("signal", 6).alias("signal"), F.round(db, 2).alias("snr"), kind.alias("snr_class"), (db >= 10).alias("acceptable"))


def duration(sounds: DataFrame, key: str, sound: str, least: float = 1.0, most: float = 300.0) -> DataFrame:
    """key, seconds, and whether the sound is too short or too long."""

    def measure(data: list[bytes | None]) -> tuple[np.ndarray, list]:
        forms = [(k, form) for k, form in enumerate(map(_layout, data)) if form]
        return [k for k, _ in forms], [[form[0] for _, form in forms], [form[4] for _, form in forms]]

    x = in_slices(sounds, F.col(key), F.col(sound), measure, [("rate", "int", pa.int32()), ("n", "long", pa.int64())]).withColumn("s", F.col("n") / F.col("rate"))
    return x.select(F.col("key").alias(key), F.round(F.col("s") + 1e-9, 2).alias("seconds"), F.when(F.col("s") < least, "too_short").when(F.col("s") > most, "too_long").alias("issue"))


_FRAME, _HOP, _AT_ONCE = 2048, 512, 512


def spectral(rate: int, x: np.ndarray) -> tuple[float, float, float, float]:
    """Means over frames of 2048 samples, 512 apart and centred: spectral centroid, 0.85 rolloff, bandwidth, and zero crossings."""
    freq = np.fft.rfftfreq(_FRAME, 1 / rate)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(_FRAME) / _FRAME)
    padded = np.pad(x, _FRAME // 2)
    n, sums = 1 + len(x) // _HOP, np.zeros(3)
    for a in range(0, n, _AT_ONCE):
        first = np.arange(a, min(a + _AT_ONCE, n)) * _HOP
        s = np.abs(np.fft.rfft(padded[first[:, None] + np.arange(_FRAME)] * window, axis=1))
        total = s.sum(axis=1, keepdims=True)
        part = s / np.where(total > 1e-30, total, 1)
        centre = part @ freq
        roll = freq[(np.cumsum(s, axis=1) >= 0.85 * total).argmax(axis=1)]
        width = np.sqrt((part * (freq - centre[:, None]) ** 2).sum(axis=1))
        sums += [centre.sum(), roll.sum(), width.sum()]
    edged = np.pad(x, _FRAME // 2, "edge") if len(x) else np.zeros(_FRAME)
    negative = np.where(np.abs(edged) <= 1e-10, 0.0, edged) < 0
    crossed = np.concatenate([[0], np.cumsum(negative[1:] != negative[:-1])])  # crossings up to each sample
    first = np.arange(n) * _HOP
    rate_of = (crossed[first + _FRAME - 1] - crossed[first]) / _FRAME
    return (*(sums / n).tolist(), float(rate_of.mean()))


def clarity(sounds: DataFrame, key: str, sound: str) -> DataFrame:
    """key, centroid, rolloff, bandwidth, crossings, and the score that is made of them."""

    @F.pandas_udf("centroid double, rolloff double, bandwidth double, crossings double")
    def measure(data: pd.Series) -> pd.DataFrame:
        got = [decoded(d) for d in data]
        return pd.DataFrame([(None,) * 4 if g is None else spectral(*g) for g in got], columns=["centroid", "rolloff", "bandwidth", "crossings"], dtype="float64")

    x = sounds.select(key, measure(F.col(sound)).alias("m")).filter(F.col("m.centroid").isNotNull() & ~F.isnan("m.centroid")).select(key, "m.*")
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + F.col("centroid") / 4000 * 0.3 - F.col("crossings") * 0.5))
    return x.select(key, *(F.round(c, 2).alias(c) for c in ("centroid", "rolloff", "bandwidth")), F.round("crossings", 4).alias("crossings"), F.round(score, 3).alias("clarity"), (score > 0.4).alias("clear"))


KINDS = ("noise", "reverb", "shift", "volume", "low_pass")


def altered_samples(rate: int, x: np.ndarray, kind: str, draw: np.random.Generator, amount: float | None = None) -> np.ndarray:
    """One alteration. Without an amount: noise of 0.001 to 0.01, reverb of 0.1 to 0.5, a shift within 500 ms, a volume of 0.5 to 1.5, a limit of 2 to 8 kHz."""
    lowest, highest = {"noise": (0.001, 0.01), "reverb": (0.1, 0.5), "shift": (-500, 500), "volume": (0.5, 1.5), "low_pass": (2000, 8000)}[kind]
    by = draw.uniform(lowest, highest) if amount is None else amount
    if kind == "noise":
        return np.clip(x + draw.normal(0, by, len(x)), -1, 1)
    if kind == "volume":
        return np.clip(x * by, -1, 1)
    if kind == "shift":
        steps = int(rate * by / 1000)
        return np.concatenate([np.zeros(steps), x]) if steps > 0 else x[-steps:]
    if kind == "reverb":
        y, late = x.copy(), int(rate * 0.03)
        for k in (1, 2, 3):
            if 0 < k * late < len(x):
                y[k * late :] += x[: -k * late] * by**k
        loudest = np.abs(y).max(initial=0)
        return y / loudest if loudest else y
    # fourth-order Butterworth, forward and back: its response squared, no phase; the ends go on turned about their last sample
    if by >= rate / 2 or len(x) < 2:
        return x
    more = min(len(x) - 1, rate)
    wide = np.concatenate([2 * x[0] - x[more:0:-1], x, 2 * x[-1] - x[-2 : -more - 2 : -1]])
    at = np.tan(np.pi * np.minimum(np.fft.rfftfreq(len(wide), 1 / rate), rate / 2 * (1 - 1e-9)) / rate) / np.tan(np.pi * by / rate)
    return np.fft.irfft(np.fft.rfft(wide) / (1 + at**8), len(wide))[more : more + len(x)]


def altered(sounds: DataFrame, key: str, sound: str, kind: str, amount: float | None = None, seed: int = 0) -> DataFrame:
    """key and the altered sound, of 16 bits. Draws depend on seed, key and kind alone, so a lost task repeats them."""
    if kind not in KINDS:
        raise ValueError(f"no such alteration: {kind}")

    @F.pandas_udf("binary")
    def alter(keys: pd.Series, data: pd.Series) -> pd.Series:
        out = []
        for k, d in zip(keys, data, strict=True):
            got = decoded(d)
            draw = np.random.default_rng(int.from_bytes(hashlib.md5(f"{seed}:{k}:{kind}".encode()).digest(), "big"))
            out.append(None if got is None else encoded(got[0], altered_samples(*got, kind, draw, amount)))
        return pd.Series(out, dtype=object)

    return sounds.select(key, alter(F.col(key).cast("string"), F.col(sound)).alias(sound))
