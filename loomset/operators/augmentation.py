"""New rows out of text items. Choices come from hashes of seed, key and place, so a lost task makes the same rows again."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chance(seed: int, key: Column, place: Column) -> Column:
    """A number from 0 to 1, the same for the same arguments."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), place.cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / 4294967296.0


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def random_deletion(items: DataFrame, key: str, text: str, p: float = 0.1, seed: int = 0) -> DataFrame:
    """Words dropped with probability p; the first stays if all would go."""
    w = _words(F.coalesce(F.col(text), F.lit("")))
    x = items.select(key, w.alias("w"))
    kept = F.filter("w", lambda _, i: chance(seed, F.col(key), i) >= p)
    return x.select(key, F.array_join(F.when((F.size(kept) == 0) & (F.size("w") > 0), F.slice("w", 1, 1)).otherwise(kept), " ").alias("text"))


def random_swap(items: DataFrame, key: str, text: str, seed: int = 0) -> DataFrame:
    """Two words at random places swapped."""
    x = items.select(key, _words(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    n = F.size("w")
    i, j = (F.floor(chance(seed, F.col(key), F.lit(k)) * n).cast("int") for k in (-1, -2))
    x = x.withColumns({"i": i, "j": j})
    swapped = F.transform("w", lambda v, k: F.when(k == F.col("i"), F.get("w", F.col("j"))).when(k == F.col("j"), F.get("w", F.col("i"))).otherwise(v))
    return x.select(key, F.array_join(swapped, " ").alias("text"))


def augmented(items: DataFrame, key: str, per_item: int, seed: int = 0, rules: dict[str, float] | None = None) -> DataFrame:
    """Lineage rows: per_item copies of each item, each with a rule drawn by weight."""
    rules = rules or {"deletion": 0.5, "swap": 0.5}
    total = sum(rules.values())
    x = items.select(F.col(key).alias("augmented_from"), F.explode(F.sequence(F.lit(1), F.lit(per_item))).alias("copy"))
    draw = chance(seed, F.col("augmented_from"), F.col("copy"))
    kind, upto = None, 0.0
    for name, weight in rules.items():
        upto += weight / total
        kind = F.when(draw < upto, name) if kind is None else kind.when(draw < upto, name)
    return x.withColumn("augmentation_type", kind.otherwise(list(rules)[-1]))


# Synonyms, and the keys beside each key.
SYNONYMS = {
    "good": ["great", "excellent", "fine", "nice"],
    "bad": ["poor", "terrible", "awful", "horrible"],
    "big": ["large", "huge", "enormous", "massive"],
    "small": ["tiny", "little", "miniature", "compact"],
    "happy": ["joyful", "pleased", "glad", "delighted"],
    "sad": ["unhappy", "sorrowful", "melancholy", "depressed"],
    "fast": ["quick", "rapid", "swift", "speedy"],
    "slow": ["sluggish", "gradual", "unhurried", "leisurely"],
}
KEYS_BESIDE = {
    "a": "sqwz", "b": "vghn", "c": "xdfv", "d": "erfcxs", "e": "wrsdf", "f": "rtgvcd", "g": "tyhbvf", "h": "yujnbg", "i": "uojkl",
    "j": "uikmnh", "k": "iolmj", "l": "opk", "m": "njk", "n": "bhjm", "o": "iplk", "p": "ol", "q": "wa", "r": "etdf", "s": "wedxza",
    "t": "ryfg", "u": "yihj", "v": "cfgb", "w": "qesa", "x": "zsdc", "y": "tugh", "z": "asx",
}


def _table(values: dict) -> Column:
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.array(*(F.lit(s) for s in v)))))


def synonyms(items: DataFrame, key: str, text: str, n: int = 2, seed: int = 0) -> DataFrame:
    """The n words with a synonym that the draw puts first replaced, with their capital; a text without any stays as it is."""
    x = items.select(key, F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("w", _words(F.col("t")))
    draws = F.transform("w", lambda v, i: F.when(F.lower(v).isin(list(SYNONYMS)), F.struct(chance(seed, F.col(key), i).alias("c"), i.alias("i"))))
    x = x.withColumn("chosen", F.transform(F.slice(F.array_sort(F.array_compact(draws)), 1, n), lambda d: d["i"]))

    def replaced(v: Column, i: Column) -> Column:
        others = F.try_element_at(_table(SYNONYMS), F.lower(v))
        new = F.get(others, F.floor(chance(seed, F.col(key), -i - 10) * F.size(others)).cast("int"))
        return F.when(F.array_contains("chosen", i), F.when(F.substring(v, 1, 1) != F.lower(F.substring(v, 1, 1)), F.initcap(new)).otherwise(new)).otherwise(v)

    return x.select(key, F.when(F.size("chosen") == 0, F.col("t")).otherwise(F.array_join(F.transform("w", replaced), " ")).alias("text"), F.size("chosen").alias("replaced"))


def random_insertion(items: DataFrame, key: str, text: str, seed: int = 0) -> DataFrame:
    """One of a text's words put at a random place."""
    x = items.select(key, _words(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    n = F.size("w")
    i, j = F.floor(chance(seed, F.col(key), F.lit(-3)) * n).cast("int"), F.floor(chance(seed, F.col(key), F.lit(-4)) * (n + 1)).cast("int")
    x = x.withColumns({"i": i, "j": j})
    both = F.concat(F.slice("w", F.lit(1), F.col("j")), F.array(F.get("w", F.col("i"))), F.slice("w", F.col("j") + 1, n))
    return x.select(key, F.when(n == 0, "").otherwise(F.array_join(both, " ")).alias("text"))


def mistyped(items: DataFrame, key: str, text: str, p: float = 0.05, seed: int = 0) -> DataFrame:
    """Letters replaced by a key beside theirs with probability p, with their case."""
    start = F.concat(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), F.lit(":"))
    x = items.select(key, start.alias("start"), F.split(F.coalesce(F.col(text), F.lit("")), "").alias("c"))
    most = math.ceil(p * 2**32)

    def drawn(i: Column) -> Column:
        """Whether chance() is under p, told by the digits of the hash, since most characters need no more than that."""
        return F.lit(most > 0) if not 0 < most < 2**32 else F.md5(F.concat("start", i.cast("string"))) < f"{most:08x}"

    def typed(c: Column, i: Column) -> Column:
        beside = F.try_element_at(_table(KEYS_BESIDE), F.lower(c))
        new = F.get(beside, F.floor(chance(seed, F.col(key), -i - 1) * F.size(beside)).cast("int"))
        return F.when(drawn(i) & beside.isNotNull(), F.when(c == F.lower(c), new).otherwise(F.upper(new))).otherwise(c)

    return x.select(key, F.array_join(F.transform("c", typed), "").alias("text"))
