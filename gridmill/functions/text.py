"""Text expressions for document chunks and keyword matching."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that never count as search terms.
STOPWORDS = (
    "a", "an", "and", "are", "as", "for", "from", "how", "in", "is", "of", "or", "the", "to",
    "what", "when", "where", "why",
)

# Line ends other than a line feed, and whitespace, as Unicode text processing sees them.
OTHER_LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
WHITESPACE = "".join(character for character in map(chr, range(0x3001)) if character.isspace())


def unify_newlines(text: Column) -> Column:
    """Every kind of line end as a single line feed.

    Most texts have no other kind; plain substring tests let them skip the pattern.
    """
    has_other = reduce(Column.__or__, [text.contains(end) for end in OTHER_LINE_ENDS])
    return F.when(has_other, F.regexp_replace(text, f"\r\n|[{OTHER_LINE_ENDS}]", "\n")).otherwise(text)


def strip_whitespace(text: Column) -> Column:
    """Text without leading and trailing whitespace of any kind."""
    return F.trim(text, F.lit(WHITESPACE))


def word_set(text: Column) -> Column:
    """Distinct lower-case words of at least two characters that are not stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]{2,}"), F.lit(0))
    return F.array_except(words, F.array(*[F.lit(w) for w in STOPWORDS]))


def has_word(lower_text: Column, word: str) -> Column:
    """Whether a lower-case text contains a word as a whole, as ``word_set`` would find it.

    The plain substring test is cheap and decides most rows; the pattern runs only on the others.
    """
    return lower_text.contains(word) & lower_text.rlike(f"(^|[^a-z0-9_]){word}([^a-z0-9_]|$)")


def query_terms(query: str) -> list[str]:
    """The same word set for one query string, on the driver."""
    return sorted(set(re.findall("[a-z0-9_]{2,}", query.lower())) - set(STOPWORDS))
