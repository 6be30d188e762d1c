"""Public tokenizer files as shared bytes, and one encoder per Python worker."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import sentencepiece
import tiktoken
from pyspark import Broadcast
from pyspark.sql import SparkSession


def share_file(spark: SparkSession, path: str) -> Broadcast:
    """A tokenizer file, read on the driver: as large as the vocabulary, whatever the corpus."""
    with open(path, "rb") as lines:
        return spark.sparkContext.broadcast(lines.read())


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary, and back."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Bytes:
    """The bytes of every id, in one buffer with starts and lengths."""

    def __init__(self, words: list[bytes]) -> None:
        self.lengths = np.array([len(w) for w in words] or [0], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.buffer = np.frombuffer(b"".join(words) or b"\0", np.uint8)
        self.size = len(words)

    def spells(self, ids: np.ndarray, wanted: np.ndarray, step: int = 1 << 18) -> np.ndarray:
        """Places of ``wanted`` that the ids' bytes, as many, do not equal; ``step`` ids at a time."""
        wrong, at = [], 0
        for k in range(0, len(ids), step):
            part = ids[k : k + step]
            lengths = self.lengths[part]
            n = int(lengths.sum())
            before = np.repeat(self.starts[part] - (np.cumsum(lengths) - lengths), lengths)
            got = self.buffer[before + np.arange(n)]
            wrong.append(at + np.flatnonzero(got != wanted[at : at + n]))
            at += n
        return np.concatenate(wrong) if wrong else np.zeros(0, np.int64)


class ByteLevel:
    """A byte-level vocabulary (``tokenizers`` file) whose merges stand in id order, encoded by ranks.

    Such files give the same ids through the rank encoder, several times faster. ``specials``
    says whether the strings of special tokens inside texts become their ids.
    """

    def __init__(self, content: bytes, pattern: str, specials: bool) -> None:
        file = json.loads(content)
        letters = byte_letters()
        special = {t["content"]: t["id"] for t in file["added_tokens"] if t["special"]}
        vocab = {w: i for w, i in file["model"]["vocab"].items() if w not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
        merged = [vocab[a + b] for a, b in merges]
        whole = file["pre_tokenizer"].get("type") == "ByteLevel" and not file["pre_tokenizer"]["add_prefix_space"]
        if file["normalizer"] is not None or not whole or any(b <= a for a, b in zip(merged, merged[1:])):
            raise ValueError("not a plain byte-level vocabulary with merges in id order")
        ranks = {bytes(letters[c] for c in w): i for w, i in vocab.items()}
        words = [b""] * (max([*vocab.values(), *special.values()], default=-1) + 1)
        for w, i in ranks.items():
            words[i] = w
        for w, i in special.items():
            words[i] = w.encode()
        self.bytes = Bytes(words)
        self.encoding = tiktoken.Encoding(
            "byte level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special if specials else {}
        )
        self.allowed = "all" if specials else set()

    def encode(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special=self.allowed, disallowed_special=())


class Pieces:
    """A piece vocabulary (``sentencepiece`` file)."""

    def __init__(self, content: bytes) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_proto=content)
        words = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            words.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())
        self.bytes = Bytes(words)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def byte_level_of(content: Broadcast, pattern: str, specials: bool) -> ByteLevel:
    """Built once per Python worker."""
    return ByteLevel(content.value, pattern, specials)


@lru_cache(maxsize=2)
def pieces_of(content: Broadcast) -> Pieces:
    return Pieces(content.value)


def vocabulary_sizes(a_path: str, b_path: str) -> tuple[int, int]:
    """Numbers of ids of a byte-level and of a piece vocabulary."""
    with open(a_path, "rb") as lines:
        file = json.loads(lines.read())
    ids = [*file["model"]["vocab"].values(), *(t["id"] for t in file["added_tokens"])]
    return max(ids, default=-1) + 1, sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
