"""Operator 2: token counts that follow edits, by a segment tree of pre-tokens per document."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import REMEMBERED, Codec, codec_of, share_ranks
from .common import only, slices
from .pii import with_spans

#: Characters after a pre-token's end that its match may depend on.
LOOK_AHEAD = 2


class Counts(dict):
    """Token counts of pre-tokens a worker has met; long ones, which hardly come twice, are not kept."""

    def __init__(self, codec: Codec) -> None:
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> int:
        count = len(self.codec.packed(piece)) // 4
        if len(piece) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = count
        return count


class CountTree:
    """Sums of characters and tokens over the pre-tokens of a text.

    A leaf holds one pre-token at first. An edit re-splits the text from the last leaf that
    it can influence to the first place after it where new and old cuts meet; the new
    pre-tokens go to the first of the leaves so replaced and the others become empty. So
    leaves stay where they are, and an edit costs the pre-tokens it touches times log n.
    """

    def __init__(self, text: str, split: Callable[[str], list[str]], count: Callable[[str], int]) -> None:
        self.split, self.count = split, count
        self.leaves = split(text)
        n = len(self.leaves)
        self.width = 1 << max(n - 1, 1).bit_length()
        self.chars, self.tokens = (self._built(x) for x in (list(map(len, self.leaves)), list(map(count, self.leaves))))
        self.recounted = 0

    def _built(self, values: list[int]) -> list[int]:
        tree = np.zeros(2 * self.width, np.int64)
        tree[self.width : self.width + len(values)] = values
        low = self.width
        while low > 1:
            tree[low // 2 : low] = tree[low : 2 * low : 2] + tree[low + 1 : 2 * low : 2]
            low //= 2
        return tree.tolist()

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """Leaf that holds a character, and the leaf's first character."""
        k, start = 1, 0
        while k < self.width:
            k *= 2
            if place - start >= self.chars[k]:
                start += self.chars[k]
                k += 1
        return k - self.width, start

    def _put(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        k, chars, count = self.width + leaf, len(text) - self.chars[self.width + leaf], tokens - self.tokens[self.width + leaf]
        while k:
            self.chars[k] += chars
            self.tokens[k] += count
            k //= 2

    def replace(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in place of the characters from ``start`` to ``end``."""
        if not self.chars[1]:
            recounted = self.recounted
            self.__init__(new, self.split, self.count)
            self.recounted = recounted + len(self.leaves)
            return
        size = self.chars[1]
        start, end = max(0, min(start, size)), max(0, min(end, size))
        first, at = self._leaf_at(max(0, min(start, size - 1) - LOOK_AHEAD))
        old, last, until = "", first, at
        while until < end or last == first:
            old += self.leaves[last]
            until += len(self.leaves[last])
            last += 1
        text = old[: start - at] + new + old[end - at :]
        shift = at + len(text) - until  # from old to new places after the edit
        cuts, more = {until + shift - at: last}, 4
        while True:
            for _ in range(more):
                if last >= len(self.leaves):
                    break
                text += self.leaves[last]
                until += len(self.leaves[last])
                last += 1
                cuts[until + shift - at] = last
            pieces, place, done = self.split(text), 0, last >= len(self.leaves)
            for k, piece in enumerate(pieces):
                if place in cuts and place + LOOK_AHEAD < len(text) and place > 0:
                    pieces, last, done = pieces[:k], cuts[place], True
                    break
                place += len(piece)
            if done:
                break
            more *= 2
        self.recounted += len(pieces)
        tokens = sum(map(self.count, pieces))
        self._put(first, "".join(pieces), tokens)
        for leaf in range(first + 1, last):
            if self.leaves[leaf]:
                self._put(leaf, "", 0)


def count_edited(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits"
) -> DataFrame:
    """``doc_id, n_before, n_edits, n_after, n_recounted``: token counts before and after a text's edits.

    ``edits`` is an array of ``start, end, new`` (code points of the text as it stands
    before all edits, not overlapping). Edits go in from the last to the first, so places
    stay right; each recounts the pre-tokens around it only, ``n_recounted`` in all.

    One row per input row, without a shuffle: repeated rows and repeated or null ids stay,
    null and empty texts count 0, null edits are none, places beyond the text mean its end,
    extra columns are dropped, an empty table gives an empty table.
    """
    ranks = share_ranks(docs.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(ranks, pattern)
        count = Counts(codec).__getitem__
        for batch in slices(batches):
            before, edits, after, recounted = [], [], [], []
            for text, changes in zip(batch.column("text").to_pylist(), batch.column("edits").to_pylist()):
                changes = sorted((c for c in changes or [] if c), key=lambda c: (c["start"], c["end"]))
                edits.append(len(changes))
                if changes:
                    tree = CountTree(text or "", codec.find, count)
                    before.append(tree.total)
                    for change in reversed(changes):
                        tree.replace(change["start"], change["end"], change["new"] or "")
                    after.append(tree.total)
                    recounted.append(tree.recounted)
                else:
                    total = sum(map(count, codec.find(text or "")))
                    before.append(total)
                    after.append(total)
                    recounted.append(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (before, edits, after, recounted))],
                ["doc_id", "n_before", "n_edits", "n_after", "n_recounted"],
            )

    rows = only(
        docs, doc_id=(id_col, "bigint"), text=(text_col, "string"), edits=(edits_col, "array<struct<start:bigint,end:bigint,new:string>>")
    )
    schema = "doc_id bigint, n_before bigint, n_edits bigint, n_after bigint, n_recounted bigint"
    return rows.mapInArrow(run, schema)


def masked_digits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, edits``: edits that replace every run of two digits or more by ``#``."""
    rows = only(docs, doc_id=(id_col, "bigint"), text=(text_col, "string"))
    found = with_spans(rows, F.coalesce("text", F.lit("")), "[0-9]{2,}", "runs")
    edits = F.transform("runs", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("#").alias("new")))
    return found.select("doc_id", "text", edits.alias("edits"))
