"""What needs Unicode tables: compatibility forms and HTML references, in Arrow batches. A null text is empty."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Code points that count as control characters, and ranges that count as emoji.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+"
SPACES = r"(?U)\s+"


@F.pandas_udf(StringType())
def compatible(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def clean_text(text: Column, urls: bool = False, emails: bool = False, mentions: bool = False, hashtags: bool = False, emojis: bool = False, lower: bool = False) -> Column:
    """Compatibility forms, no control characters, HTML references resolved, white space collapsed; then what is asked for, in that order."""
    t = unescaped(F.regexp_replace(compatible(F.coalesce(text, F.lit(""))), CONTROL, ""))
    t = F.regexp_replace(F.regexp_replace(t, SPACES, " "), "^ | $", "")
    for wanted, pattern in ((urls, r"https?://\S+|www\.\S+"), (emails, r"\S+@\S+\.\S+"), (mentions, r"(?U)@\w+"), (hashtags, r"(?U)#\w+"), (emojis, EMOJI)):
        t = F.regexp_replace(t, pattern, "") if wanted else t
    return F.regexp_replace(F.lower(t) if lower else t, r"(?U)^\s+|\s+$", "")


def processed_text(text: Column) -> Column:
    """White space collapsed, then no control characters, then compatibility forms, then trimmed."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "), CONTROL, "")
    return F.regexp_replace(compatible(t), r"(?U)^\s+|\s+$", "")
