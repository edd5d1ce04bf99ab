"""Text functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokenize(text: Column | str, sep: str = " ") -> Column:
    """Split on one separator.  Leading and inner empty tokens stay; a separator at the
    end adds no empty token; the empty text has no tokens."""
    t = F.col(text) if isinstance(text, str) else text
    body = F.when(t.endswith(sep), F.left(t, F.length(t) - F.lit(len(sep)))).otherwise(t)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(body, re.escape(sep), -1))


def join_tokens(tokens: Column | str, sep: str = " ") -> Column:
    """The text in which every token is followed by the separator."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.when(F.size(t) == 0, F.lit("")).otherwise(F.concat(F.array_join(t, sep, ""), F.lit(sep)))
