"""Check SQL for the words that subword training counts."""

from __future__ import annotations

from pairforge.functions.text import WORD_OR_PUNCT

from .parts import lit, with_tables, words

_COUNTS = (
    "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(nfc_normalize(raw), "
    + lit(WORD_OR_PUNCT)
    + f")) AS word FROM (SELECT unnest({words('sentence')}) AS raw FROM sentences)) GROUP BY word"
)


def word_counts_sql() -> str:
    return with_tables(f"SELECT word, n FROM ({_COUNTS})", "sentences")
