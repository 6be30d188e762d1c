"""Encyclopedia-markup cleaning: one ordered chain of regex rules per article.

The chain is a single projection. Rules that can never match because an earlier
rule removed their characters (headings, bullets, numbered lists and templates
after the whitelist) are left out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (rule, pattern, replacement), in the order they are applied.
MARKUP_RULES: tuple[tuple[str, str, str], ...] = (
    ("xml_tags", r"<[^\n]*?>", ""),
    ("amp_entity", r"&amp;", "&"),
    ("lt_entity", r"&lt;", "<"),
    ("gt_entity", r"&gt;", ">"),
    ("references", r"<ref[^<]*</ref>", ""),
    ("leftover_tags", r"<[^>]*>", ""),
    ("external_links", r"\[http:[^\] ]*", ""),
    ("image_thumb", r"(?i)\|thumb", ""),
    ("image_left", r"(?i)\|left", ""),
    ("image_right", r"(?i)\|right", ""),
    ("image_size", r"(?i)\|[0-9]+px", ""),
    ("image_links", r"(?i)\[\[image:[^\[\]]*\|", ""),
    ("category_links", r"(?i)\[\[category:([^|\]]*)[^\]]*\]\]", "$1"),
    ("language_links", r"\[\[[a-z\-]*:[^\]]*\]\]", ""),
    ("piped_links", r"\[\[[^|\]]*\|", ""),
    ("templates", r"\{\{[^}]*\}\}", ""),
    ("braces", r"\{[^}]*\}", ""),
    ("brackets", r"\[|\]", ""),
    ("entities", r"&[^;]*;", ""),
    ("late_tags", r"<[^>]*>", ""),
    ("opening_heading", r"^==[^=]+==\s*", ""),
    ("bold_spans", r"'''[^']*'''", ""),
    ("double_apostrophes", r"''", ""),
    ("percent_sign", r"%", " percent "),
    ("dollar_sign", r"\$", " dollar "),
    ("ampersand", r"&", " and "),
    ("character_whitelist", r"[^a-zA-Z0-9\-'.?! ]+", ""),
    ("space_runs", r"\s+", " "),
    ("edge_spaces", r"^\s+|\s+$", ""),
    ("double_dash_words", r"\b--[A-Za-z0-9]+\b", ""),
    ("double_dashes", r"\s--\s", " "),
    ("initials", r"\b[A-Z]\.\b", ""),
)

RULE_NAMES = tuple(name for name, _, _ in MARKUP_RULES)

# Article body and redirect marker in a page record.
TEXT_BODY = r"(?s)<text [^>]*>(.*?)</text>"
REDIRECT = r"(?i)#redirect"


def apply_rule(text: Column, name: str) -> Column:
    pattern, replacement = next((p, r) for n, p, r in MARKUP_RULES if n == name)
    return F.regexp_replace(text, pattern, replacement)


def clean_markup(text: Column, newline: str = "glue") -> Column:
    """Apply every rule in order.

    The whitelist has no newline, so words on both sides of one are glued together;
    ``newline="space"`` turns newlines into spaces first.
    """
    if newline not in ("glue", "space"):
        raise ValueError("newline must be 'glue' or 'space'")
    for name, pattern, replacement in MARKUP_RULES:
        if name == "character_whitelist" and newline == "space":
            text = F.regexp_replace(text, r"[\r\n]", " ")
        text = F.regexp_replace(text, pattern, replacement)
    return text


def article_body(record: Column) -> Column:
    """Text between ``<text …>`` and ``</text>`` of one page record, empty if none."""
    return F.regexp_extract(record, TEXT_BODY, 1)


def is_redirect(record: Column) -> Column:
    return record.rlike(REDIRECT)
