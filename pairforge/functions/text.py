"""Sentence splitting, whitespace handling and tokenizers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentence delimiters and the Unicode whitespace set.
SENTENCE_END = r"[.!?]"
WHITESPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

HAS_WORD = WHITESPACE.replace("[", "[^", 1).removesuffix("+")

# Word / punctuation runs, as the subword pre-tokenizer cuts them.
WORD_OR_PUNCT = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+|[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\s]+"

# Social-text tokens, first alternative that matches wins: URLs, emoticons, handles,
# hashtags, numbers, words with inner apostrophes or hyphens, ellipses, single symbols.
SOCIAL_TOKEN = "|".join(
    [
        r"https?://[^\s]+",
        r"[<>]?[:;=8][\-o*']?[)\](\[dDpP/:}{@|\\]",
        r"@[A-Za-z0-9_]+",
        r"#[\p{L}\p{N}_]+",
        r"[+\-]?[0-9]+(?:[,./:\-][0-9]+)*",
        r"[\p{L}\p{M}\p{N}_]+(?:['\-][\p{L}\p{M}\p{N}_]+)*",
        r"\.(?:\s*\.)+",
        r"[^\s]",
    ]
)


def split_sentences(text: Column) -> Column:
    """Pieces between sentence delimiters; the delimiters are dropped, empties kept."""
    return F.split(text, SENTENCE_END)


def split_words(text: Column) -> Column:
    """Whitespace-separated words without empties."""
    return F.filter(F.split(text, WHITESPACE), lambda w: w != "")


def squeeze(text: Column) -> Column:
    """Words joined by single spaces."""
    return F.trim(F.regexp_replace(text, WHITESPACE, " "))


def social_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({SOCIAL_TOKEN})"), F.lit(1))


def word_or_punct(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD_OR_PUNCT})"), F.lit(1))


def words_of(sentence: Column) -> Column:
    """Words of an already squeezed sentence; the empty sentence has none."""
    return F.filter(F.split(sentence, " "), lambda w: w != "")


def bleu_tokens(text: Column) -> Column:
    """The published mteval-13a tokenization, split on spaces."""
    t = F.replace(text, F.lit("<skipped>"), F.lit(""))
    t = F.replace(t, F.lit("-\n"), F.lit(""))
    t = F.replace(t, F.lit("\n"), F.lit(" "))
    for entity, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.concat(F.lit(" "), t, F.lit(" "))
    t = F.regexp_replace(t, r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 ")
    t = F.regexp_replace(t, r"([^0-9])([\.,])", "$1 $2 ")
    t = F.regexp_replace(t, r"([\.,])([^0-9])", " $1 $2")
    t = F.regexp_replace(t, r"([0-9])(-)", "$1 $2 ")
    return split_words(t)


def rouge_tokens(text: Column) -> Column:
    """Lower-cased runs of ``[a-z0-9]``."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "), " "), lambda w: w != "")
