"""Statistics, quality rules, keywords and labels of text items."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.functions import language
from loomset.functions import text as X
from loomset.operators.shared import by_key

#: Lifts exact halves, which engines round differently, to the upper side.
TIE = 1e-9
_STOPWORDS = frozenset(X.STOPWORDS)


def text_stats(items: DataFrame, key: str, text: str) -> DataFrame:
    """Counts and averages of words and sentences."""
    t = F.coalesce(F.col(text), F.lit(""))
    x = items.select(key, F.length(t).cast("long").alias("char_count"), X.words(t).alias("w"), X.sentences(t).alias("s"))
    n, m = F.size("w").cast("long"), F.size("s").cast("long")
    least = F.greatest(n, F.lit(1))
    return x.select(
        key, "char_count", n.alias("word_count"), m.alias("sentence_count"),
        F.round(X.total_length(F.col("w")) / least + TIE, 2).alias("avg_word_length"),
        F.round(n / F.greatest(m, F.lit(1)) + TIE, 2).alias("avg_sentence_length"),
        F.round(F.size(F.array_distinct("w")) / least + TIE, 3).alias("unique_ratio"),
    )


def readability(items: DataFrame, key: str, text: str) -> DataFrame:
    """Flesch reading ease, Flesch-Kincaid grade and a level; rows without words or sentences are left out."""
    t = F.col(text)
    x = items.select(key, F.size(F.filter(F.split(t, X.SENTENCE_END), lambda s: F.regexp_replace(s, X.SPACES, "") != "")).alias("s"), F.size(X.words(t)).alias("w"), X.syllables(t).alias("y")).filter("s > 0 and w > 0")
    per_sentence, per_word = F.col("w") / F.col("s"), F.col("y") / F.col("w")
    ease = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 206.835 - 1.015 * per_sentence - 84.6 * per_word))
    grade = F.greatest(F.lit(0.0), 0.39 * per_sentence + 11.8 * per_word - 15.59)
    at = lambda c, places: F.round(c * 10.0**places, 0) / 10.0**places  # noqa: E731  (a value just under a tie in binary is one once multiplied, as SQL's round() has it)
    return x.select(key, at(ease, 2).alias("ease"), at(grade, 1).alias("grade"), X.difficulty(ease).alias("difficulty"))


def coherence(items: DataFrame, key: str, text: str) -> DataFrame:
    """Type-token ratio, hapax ratio, word length and their weighted score, of texts of ten words or more."""
    w = items.select(key, F.explode(X.words(F.col(text))).alias("w"))
    per_word = w.groupBy(key, "w").agg(F.count("*").alias("n"))
    x = per_word.groupBy(key).agg(F.sum("n").alias("words"), F.count("*").alias("types"), F.count_if(F.col("n") == 1).alias("once"), F.sum(F.length("w") * F.col("n")).alias("letters")).filter("words >= 10")
    ttr, hapax, length = F.col("types") / F.col("words"), F.col("once") / F.col("types"), F.col("letters") / F.col("words")
    score = 0.4 * F.least(F.lit(1.0), ttr * 2) + 0.3 * (1 - hapax) + 0.3 * F.least(F.lit(1.0), length / 6)
    return x.select(key, F.round(ttr + TIE, 3).alias("ttr"), F.round(hapax + TIE, 3).alias("hapax_ratio"), F.round(length + TIE, 2).alias("avg_word_length"), F.round(score, 3).alias("score"))


def _most_frequent(texts: Iterable[str], top: int) -> list[tuple[str, int]]:
    """The words that keywords() means and their counts, of texts whose words stand between spaces; the first place of several texts' counts."""
    counts: Counter[str] = Counter()
    places: dict[str, int] = {}
    for t in texts:
        words = t.split(" ")
        counts.update(words)
        first = dict(zip(reversed(words), range(len(words) - 1, -1, -1), strict=True))
        places = {w: min(k, places.get(w, k)) for w, k in first.items()} | {w: k for w, k in places.items() if w not in first} if places else first
    kept = ((-n, places[w], w) for w, n in counts.items() if len(w) > 2 and w not in _STOPWORDS)
    return [(w, -n) for n, _, w in nsmallest(top, kept)]


def keywords(items: DataFrame, key: str, text: str, top: int = 10) -> DataFrame:
    """The most frequent words over two letters that aren't stop words; ties by first place. Words are counted in the task that has the text."""

    def ranked(rows: Iterable[dict]) -> Iterator[tuple]:
        return ((k, w, n) for k, (w, n) in enumerate(_most_frequent((r["words"] for r in rows if r["words"]), top), 1))

    return by_key(items, key, {"words": F.array_join(X.words(F.col(text)), " ")}, ranked, [("rank", "int", pa.int32()), ("word", "string", pa.string()), ("n", "long", pa.int64())])


def quality_check(items: DataFrame, key: str, text: str) -> DataFrame:
    """Ordered rules: the first that fails gives the reason, else the score decides."""
    t = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", ""))
    x = items.select(key, t.alias("t"), (F.coalesce(F.length(text), F.lit(0)) == 0).alias("none")).withColumns({"w": X.pieces(F.col("t")), "spam": X.spam_hits(F.col("t"))})
    n = F.size("w")
    parts = F.size(F.filter(F.split("t", "[.!?。！？]"), lambda s: F.regexp_replace(s, X.SPACES, "") != ""))
    marks = F.regexp_count("t", F.lit("[.,!?;:،؛]")) / F.greatest(n, F.lit(1))
    mean = n / parts
    score = F.least(F.length("t") / 500, F.lit(0.3)) + F.coalesce(F.try_divide(F.size(F.array_distinct("w")), n), F.lit(0.0)) * 0.3
    score = score + F.when(parts == 0, 0.0).when(mean.between(5, 30), 0.2).when(mean > 0, 0.1).otherwise(0.0)
    score = score + F.when(marks.between(0.05, 0.3), 0.1).otherwise(0.0) + F.when(F.col("spam") == 0, 0.1).otherwise(0.0)
    x = x.withColumn("score", F.least(score, F.lit(1.0)))
    low = F.lower("t").rlike(r"^[^\p{L}\p{N}_]*$") | F.lower("t").rlike("^(lorem ipsum|test|asdf|qwerty)")
    rules = F.when(F.col("none"), "empty_content").when(F.length("t") < 20, "too_short").when(F.size("w") < 3, "too_few_words").when(low, "low_quality_pattern").when(F.col("spam") >= 2, "spam_detected").when(F.col("score") < 0.3, "low_quality_score").otherwise("passed")
    x = x.withColumn("reason", rules)
    fixed = F.when(F.col("reason") == "empty_content", 0.0).when(F.col("reason").isin("too_short", "too_few_words", "spam_detected"), 0.1).when(F.col("reason") == "low_quality_pattern", 0.2).otherwise(F.col("score"))
    return x.select(key, (F.col("reason") == "passed").alias("is_valid"), "reason", F.round(fixed, 6).alias("score"))


def quality_score(items: DataFrame, key: str, text: str, labels: str) -> DataFrame:
    """One minus penalties for short, special and repetitive text; labels raise it by a tenth, up to 1."""
    t = F.coalesce(F.col(text), F.lit(""))
    n, w = F.length(t), X.pieces(t)
    s = F.when(n < 50, 0.5).when(n < 100, 0.7).otherwise(1.0)
    s = s * F.when(F.regexp_count(t, F.lit(r"[^a-zA-Z0-9 \t\n\x0B\f\r\x{0600}-\x{06FF}]")) / F.greatest(n, F.lit(1)) > 0.3, 0.6).otherwise(1.0)
    s = s * F.when((F.size(w) > 0) & (F.try_divide(F.size(F.array_distinct(w)), F.size(w)) < 0.3), 0.5).otherwise(1.0)
    s = F.when(F.size(labels) > 0, F.least(s * 1.1, F.lit(1.0))).otherwise(s)
    return items.select(key, F.round(F.when(n == 0, 0.0).otherwise(s), 2).alias("quality_score"))


def entities(items: DataFrame, key: str, text: str) -> DataFrame:
    """How many different addresses, links, dates, amounts, hashtags and mentions each text has."""
    kinds = {
        "emails": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
        "urls": r"https?://[^ \t\n\r<>\"]+",
        "dates": r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}",
        "money": r"[$€£][0-9,]+(?:\.[0-9]{2})?",
        "hashtags": r"#[A-Za-z0-9_]+",
        "mentions": r"@[A-Za-z0-9_]+",
    }
    t = F.coalesce(F.col(text), F.lit(""))
    return items.select(key, *(F.size(F.array_distinct(F.regexp_extract_all(t, F.lit(p), F.lit(0)))).cast("long").alias(k) for k, p in kinds.items()))


def hashes(items: DataFrame, key: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return items.select(key, F.md5(t).alias("md5"), F.sha2(t, 256).alias("sha256"), F.md5(X.normalized(t)).alias("normalized"))


def without_stopwords(items: DataFrame, key: str, text: str) -> DataFrame:
    w = X.words(F.coalesce(F.col(text), F.lit("")))
    kept = F.filter(w, lambda s: ~s.isin(X.STOPWORDS))
    return items.select(key, F.array_join(kept, " ").alias("text"), (F.size(w) - F.size(kept)).cast("long").alias("removed"))


def labelled(items: DataFrame, key: str, text: str) -> DataFrame:
    """Labels by keyword, joined by commas, and a confidence of 0.2 each, up to 1."""
    x = X.auto_labels(F.coalesce(F.col(text), F.lit("")))
    return items.select(key, F.array_join(x, ",").alias("labels"), F.round(F.least(F.size(x) * 0.2, F.lit(1.0)), 1).alias("confidence"))


def cleaned(items: DataFrame, key: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    x = items.select(key, F.length(t).cast("long").alias("length_before"), X.cleaned(t).alias("text"))
    return x.withColumn("length_after", F.length("text").cast("long"))


def summarised(items: DataFrame, key: str, text: str, most: int = 3, top: int = 20) -> DataFrame:
    """The sentences that hold most of a text's keywords, in the order of the text; a text of no more sentences is whole.

    A sentence's score is the sum of its words' keyword counts, half as much again for the first three; of equal
    ones the later counts. Texts of one key have their sentences and words counted together.
    """
    t = F.col(text)
    s = X.sentences(t)
    lines = F.array_join(F.transform(s, lambda x: F.array_join(X.words(x), " ")), "\n")
    values = {"text": t, "words": F.array_join(X.words(t), " "), "sentences": F.array_join(s, "\n"), "lines": lines}

    def summed(rows: Iterable[dict]) -> Iterator[tuple]:
        rows = list(rows)
        counts = dict(_most_frequent((r["words"] for r in rows if r["words"]), top))
        scores: Counter[int] = Counter()
        found = []
        for r in rows:
            r["n"] = 0
            if r["sentences"]:
                sentences = r["sentences"].split("\n")
                r["n"] = len(sentences)
                found += enumerate(sentences)
                for place, line in enumerate(r["lines"].split("\n")):
                    scores[place] += sum(counts.get(w, 0) for w in line.split(" "))
        best = nsmallest(most, found, key=lambda x: (-scores[x[0]] * (1.5 if x[0] < 3 else 1.0), -x[0]))
        summary = " ".join(x for _, x in sorted(best)) if best else None
        return ((r["text"] if r["n"] <= most else summary,) for r in rows)

    return by_key(items, key, values, summed, [("summary", "string", pa.string())])


def stemmed(items: DataFrame, key: str, text: str) -> DataFrame:
    return items.select(key, language.stemmed(F.col(text)).alias("stems"))


def tag_counts(items: DataFrame, key: str, text: str) -> DataFrame:
    """How many words of each part of speech a text has."""
    return items.select(key, F.explode(X.words(F.col(text))).alias("w")).groupBy(key, language.tag(F.col("w")).alias("tag")).agg(F.count("*").alias("n"))


def tokens(items: DataFrame, key: str, text: str) -> DataFrame:
    """Words, strings, sentences and characters of a text, and its pairs of neighbouring words."""
    t = F.col(text)
    return items.select(key, F.size(X.words(t)).cast("long").alias("words"), F.size(X.pieces(t)).cast("long").alias("strings"), F.size(X.sentences(t)).cast("long").alias("sentences"), F.length(t).cast("long").alias("characters"), language.bigrams(t).alias("bigrams"))


def hashed_embedding(items: DataFrame, key: str, text: str, size: int = 384) -> DataFrame:
    """key, dim, value: a vector of length one whose sums are over strings of three characters within words, at the place of their MD5.

    The word at place i adds 1 / (1 + ln(1 + i)). Zeros have no rows; sums are made in the task that has the text.
    """

    def summed(rows: Iterable[dict]) -> Iterator[tuple]:
        total = np.zeros(size)
        for r in rows:
            at = [_dims(w, size) for w in r["words"].split(" ")] if r["words"] else []
            if at:
                weights = 1 / (1 + np.log(np.arange(len(at)) + 1))
                total += np.bincount(np.concatenate(at), np.repeat(weights, [len(d) for d in at]), size)
        filled = np.nonzero(total)[0]
        return zip(filled.tolist(), (total[filled] / np.sqrt((total * total).sum())).tolist(), strict=True) if len(filled) else iter(())

    v = by_key(items, key, {"words": F.array_join(X.pieces(F.col(text)), " ")}, summed, [("dim", "int", pa.int32()), ("value", "double", pa.float64())])
    return v.withColumn("value", F.round("value", 5))


@lru_cache(maxsize=1 << 16)
def _dims(word: str, size: int) -> np.ndarray:
    """The places of a word's strings of three characters."""
    return np.array([int(hashlib.md5(word[k : k + 3].encode()).hexdigest()[:8], 16) % size for k in range(len(word) - 2)], np.int64)
