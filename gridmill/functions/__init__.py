"""Column expressions shared by the operators; all are built-in JVM expressions."""

from gridmill.functions.measures import count_where, in_list, ratio, round_half_up
from gridmill.functions.text import (
    STOPWORDS,
    has_word,
    query_terms,
    strip_whitespace,
    unify_newlines,
    word_set,
)
from gridmill.functions.timeparts import (
    day_number,
    day_title,
    floor_time,
    floor_to_hour,
    month_start,
    utc_from_instant,
    utc_from_nanoseconds,
    utc_from_text,
)

__all__ = [
    "STOPWORDS",
    "count_where",
    "day_number",
    "day_title",
    "floor_time",
    "floor_to_hour",
    "has_word",
    "in_list",
    "month_start",
    "query_terms",
    "ratio",
    "round_half_up",
    "strip_whitespace",
    "unify_newlines",
    "utc_from_instant",
    "utc_from_nanoseconds",
    "utc_from_text",
    "word_set",
]
