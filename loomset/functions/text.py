"""Text measures and rules as column expressions. A null or empty text counts as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that results depend on.
WORD = r"[\p{L}\p{N}_]+"
SENTENCE_END = r"[.!?]+"
SPAM_PATTERNS = ["buy now", "click here", "free money", "winner", "congratulations.*won", "limited time offer", "act now", "100% free", "make money fast", "work from home", "no experience needed"]
STOPWORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "was", "are", "were", "been", "be",
    "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "shall", "can", "need", "this", "that",
    "these", "those", "it", "its", "i", "you", "he", "she", "we", "they", "them", "their", "my", "your", "his", "her", "our", "not", "no", "yes", "if",
    "when", "where", "what", "which", "who", "whom", "how", "why", "all", "each", "every", "both", "few", "more", "most", "other", "some", "such",
    "only", "own", "same", "so", "than", "too", "very", "just", "also", "now", "here", "there", "then",
]
LABEL_WORDS = {
    "positive": ["excellent", "amazing", "great", "wonderful", "fantastic", "love", "perfect", "best", "عالی", "فوق‌العاده", "بهترین"],
    "negative": ["terrible", "awful", "horrible", "worst", "hate", "bad", "poor", "افتضاح", "بد", "ضعیف"],
    "technology": ["software", "hardware", "ai", "machine learning", "programming", "tech", "computer", "نرم‌افزار", "هوش مصنوعی"],
    "business": ["company", "market", "stock", "finance", "investment", "economy", "شرکت", "بازار", "سرمایه"],
    "health": ["medical", "health", "doctor", "hospital", "medicine", "treatment", "پزشکی", "سلامت", "درمان"],
    "sports": ["game", "team", "player", "championship", "football", "basketball", "ورزش", "بازی", "تیم"],
    "education": ["university", "school", "student", "learning", "course", "teacher", "دانشگاه", "مدرسه", "آموزش"],
    "entertainment": ["movie", "music", "celebrity", "show", "actor", "singer", "فیلم", "موسیقی", "سینما"],
    "science": ["research", "study", "experiment", "scientist", "discovery", "تحقیق", "علم", "کشف"],
    "politics": ["government", "election", "president", "minister", "policy", "دولت", "انتخابات", "سیاست"],
}
SPACES = r"[ \t\n\x0B\f\r]+"


def words(text: Column) -> Column:
    """Lower-case words in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def pieces(text: Column) -> Column:
    """Lower-case strings between white space."""
    return F.filter(F.split(F.lower(text), SPACES), lambda s: s != "")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_END), lambda s: F.trim(F.regexp_replace(s, SPACES, " "))), lambda s: s != "")


def total_length(strings: Column) -> Column:
    return F.aggregate(strings, F.lit(0).cast("long"), lambda n, s: n + F.length(s))


def syllables(text: Column) -> Column:
    """Vowel groups of each word, a silent final e apart, one at least; counted over the whole text, since no group crosses words."""
    low, letter, other = F.lower(text), r"[\p{L}\p{N}_]", r"[\p{L}\p{N}_&&[^aeiouy]]"
    groups = F.regexp_count(low, F.lit("[aeiouy]+"))
    silent = F.regexp_count(low, F.lit(rf"[aeiouy]{other}++[aeiouy]*e(?!{letter})"))
    without = F.regexp_count(low, F.lit(rf"(?<!{letter}){other}++(?!{letter})"))
    return (groups - silent + without).cast("long")


def cleaned(text: Column) -> Column:
    """Links, addresses, mentions and hashtags removed, white space collapsed, lower case."""
    for pattern in (r"https?://[^ \t\n\r]+", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"[@#][A-Za-z0-9_]+"):
        text = F.regexp_replace(text, pattern, " ")
    return F.lower(F.trim(F.regexp_replace(text, SPACES, " ")))


def normalized(text: Column) -> Column:
    """For hashing: lower case, white space collapsed, punctuation removed."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(text)), SPACES, " "), r"[^\p{L}\p{N}_ ]", "")


def spam_hits(text: Column) -> Column:
    return sum((F.lower(text).rlike(p).cast("int") for p in SPAM_PATTERNS), F.lit(0))


def difficulty(ease: Column) -> Column:
    out = F.when(ease >= 90, "very_easy")
    for least, name in ((80, "easy"), (70, "fairly_easy"), (60, "standard"), (50, "fairly_difficult"), (30, "difficult")):
        out = out.when(ease >= least, name)
    return out.otherwise("very_difficult")


def auto_labels(text: Column) -> Column:
    """Names of the classes one of whose words the text contains, in the order of LABEL_WORDS."""
    low = F.lower(text)
    found = []
    for name, terms in LABEL_WORDS.items():
        holds = low.contains(terms[0])
        for t in terms[1:]:
            holds = holds | low.contains(t)
        found.append(F.when(holds, F.lit(name)))
    return F.array_compact(F.array(*found))
