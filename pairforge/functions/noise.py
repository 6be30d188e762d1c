"""Keyboard-typo noise, a pure function of a row and its key.

Gates and draws are read from digests of ``key``, which callers build from the row's
identity, so a retried task or another partitioning gives the same typos.

The sentence gate is a built-in expression and only the sentences that pass it (a share
``p``) reach the Arrow helper. Nested ``transform`` lambdas give the same rows but cost
more: lambda bodies are interpreted, and every few characters need a digest.
""" 

from __future__ import annotations

import math
import string

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rng import digest

try:  # CPython's own md5 starts in half the time, and nearly all keys are a few bytes long
    from _md5 import md5
except ImportError:
    from functools import partial
    from hashlib import md5 as _hashlib_md5

    md5 = partial(_hashlib_md5, usedforsecurity=False)

# Tokens that are never corrupted.
SPECIAL_TOKENS = ("<UNK>", "<unk>", "<eos>", "<sos>", "<pad>")

# Neighbours of each key on a QWERTY keyboard.
QWERTY_NEIGHBOURS = {
    "q": "wa", "w": "qeas", "e": "wrsd", "r": "etdf", "t": "ryfg",
    "y": "tugh", "u": "yihj", "i": "uojk", "o": "ipkl", "p": "ol",
    "a": "qwsz", "s": "awdzx", "d": "sefxc", "f": "drgcv", "g": "fthvb",
    "h": "gyjbn", "j": "huknm", "k": "jilm", "l": "ko",
    "z": "asx", "x": "zsdc", "c": "xdfv", "v": "cfgb", "b": "vghn",
    "n": "bhjm", "m": "njk",
}

ASCII_LETTERS = string.ascii_letters

_NEAR = {**QWERTY_NEIGHBOURS, **{k.upper(): v.upper() for k, v in QWERTY_NEIGHBOURS.items()}}


_SPECIAL = frozenset(SPECIAL_TOKENS)
_PLACES = [b"%d" % k for k in range(64)]


def _bytes(key: str) -> bytes:
    return md5(key.encode()).digest()


def _draw(digest_bytes: bytes, slot: int, n: int) -> int:
    """0-based choice among ``n`` from one 32-bit slot of a digest."""
    return int.from_bytes(digest_bytes[4 * slot : 4 * slot + 4]) * n >> 32


def _edited(char: str, key: str, deletable: bool) -> str:
    """A character that passed its gate: 0, 1 or 2 characters."""
    near = _NEAR.get(char)
    if near is None:
        # digits stay, anything else that is no keyboard letter is dropped
        return char if char.isdigit() else ""
    draw = _bytes(key)
    kind = ("add", "delete", "change")[_draw(draw, 0, 3)] if deletable else ("add", "change")[_draw(draw, 0, 2)]
    if kind == "delete":
        return ""
    typed = near[_draw(draw, 1, len(near))]
    return char + typed if kind == "add" else typed


def _limit(p: float) -> bytes:
    """Four-byte draws below this are the draws below ``p``."""
    whole = math.ceil(p * 4294967296)
    return b"\xff" * 5 if whole > 0xFFFFFFFF else max(whole, 0).to_bytes(4)


def typo(word: str, key: str, limit: bytes) -> str:
    """A noisy form of ``word``: edits per character, then perhaps a stray last letter.

    Never empty (a random letter stands in) and never touches special tokens. The gates
    of four neighbouring characters share one digest.
    """
    if word in _SPECIAL:
        return word
    size = len(word)
    raw = key.encode()
    stem = raw + b"|g|"
    hit = []
    for b in range(0, size, 4):
        gates = md5(stem + (_PLACES[b >> 2] if b < 256 else b"%d" % (b >> 2))).digest()
        if gates[:4] < limit:
            hit.append(b)
        if gates[4:8] < limit and b + 1 < size:
            hit.append(b + 1)
        if gates[8:12] < limit and b + 2 < size:
            hit.append(b + 2)
        if gates[12:] < limit and b + 3 < size:
            hit.append(b + 3)
    if hit:
        parts = list(word)
        for i in hit:
            parts[i] = _edited(parts[i], f"{key}|{i}", size > 1)
        word = "".join(parts)
    last = md5(raw).digest()
    if last[:4] < limit:
        word += ASCII_LETTERS[_draw(last, 1, 52)]
    return word or ASCII_LETTERS[_draw(last, 2, 52)]


@F.pandas_udf(T.StringType())
def _noisy_words(words: pd.Series, keys: pd.Series, p: pd.Series) -> pd.Series:
    limit = _limit(p.iloc[0])
    return pd.Series([typo(w, k, limit) for w, k in zip(words, keys)], dtype=object)


@F.pandas_udf(T.StringType())
def _noisy_sentences(sentences: pd.Series, keys: pd.Series, p: pd.Series) -> pd.Series:
    """Word-for-word noise; null rows (sentences left alone) stay null."""
    limit = _limit(p.iloc[0])
    return pd.Series(
        [
            None if s is None else " ".join([typo(w, f"{k}|{i}", limit) for i, w in enumerate(s.split(" "))])
            for s, k in zip(sentences, keys)
        ],
        dtype=object,
    )


@F.pandas_udf(T.ArrayType(T.StringType()))
def _noisy_forms(sentences: pd.Series, keys: pd.Series, p: pd.Series) -> pd.Series:
    """For every key a noisy form; null for a null key and for a form that came out as the sentence."""
    limit = _limit(p.iloc[0])

    def form(words: list[str], sentence: str, key: str | None) -> str | None:
        if key is None:
            return None
        noisy = " ".join([typo(w, f"{key}|{i}", limit) for i, w in enumerate(words)])
        return None if noisy == sentence else noisy

    return pd.Series(
        [None if s is None else [form(s.split(" "), s, k) for k in ks] for s, ks in zip(sentences, keys)], dtype=object
    )


def corrupt_word(word: Column, key: Column, p: float) -> Column:
    return _noisy_words(word, key, F.lit(float(p)))


def _gate(key: Column, p: float) -> Column:
    """``uniform(digest(key)) <= p`` as a comparison of hex digits, which need not become numbers."""
    most = math.floor(p * 4294967296)
    if not 0 <= most <= 0xFFFFFFFF:
        return digest(key).isNotNull() & F.lit(most > 0)
    return F.substring(digest(key), 1, 8) <= F.lit(f"{most:08x}")


def corrupt_sentence(sentence: Column, key: Column, p: float) -> Column:
    """Noise for a sentence of single-space words behind one sentence gate.

    The sentence stays as it is if its draw is above ``p``. The word count never changes.
    """
    kept = ~_gate(key, p) | (sentence == "")
    touched = _noisy_sentences(F.when(~kept, sentence), F.when(~kept, key), F.lit(float(p)))
    return F.when(kept, sentence).otherwise(touched)


def corrupt_forms(sentence: Column, keys: list[Column], p: float) -> Column:
    """For every key the form :func:`corrupt_sentence` gives, null where that is the sentence itself.

    A sentence goes to the helper once, whatever the number of keys, and not at all if no
    draw is below ``p``.
    """
    if not keys:
        return F.expr("cast(array() as array<string>)")
    passed = F.array(*[F.when(_gate(k, p) & (sentence != ""), k) for k in keys])
    some = F.exists(passed, lambda k: k.isNotNull())
    forms = _noisy_forms(F.when(some, sentence), F.when(some, passed), F.lit(float(p)))
    return F.coalesce(forms, F.array(*[F.lit(None).cast("string") for _ in keys]))
