"""Operator 5: passages that repeat across documents, by equal short and near-equal long paragraphs, cut by content."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path, stored
from .common import only, sieve, slices, texts
from .components import components
from .crowds import compared, crowd_links
from .hashing import Words, mix, shingles

_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Values of MinHash in a band: a single frequent shingle does not fill a band's list.
ROWS = 2
#: Paragraphs in a row of which one begins a long paragraph: those have some 50 words.
LONG = 12
#: Characters of text that are cut into paragraphs together; only speed depends on it.
LOT_CHARS = 1 << 18
#: Paragraphs that one task compares with each other.
GROUP_UNITS = 1024
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def bands_for(similarity: float, recall: float, rows: int = ROWS) -> int:
    """Fewest bands of ``rows`` MinHash values by which a pair of that similarity collides with that probability."""
    bands = 1
    while 1 - (1 - similarity**rows) ** bands < recall:
        bands += 1
    return bands


class Lot:
    """Several texts cut together: words and paragraphs of all of them in a row.

    Work per text is a few array steps on all texts at once, not some on each. Words are
    maximal runs without ASCII white space. ``words`` are their hashes, ``starts`` the words
    at which paragraphs begin (:func:`paragraph_starts`), ``wide`` the paragraphs at which
    long ones begin (:func:`long_starts`). ``word_at``, ``start_at`` and ``wide_at`` tell,
    text by text and behind the last one, where its own begin in these.
    """

    def __init__(self, texts: list[str], hashed: Words, window: int) -> None:
        raws = [t.encode("utf-8", "replace") for t in texts]
        joined = b" ".join(raws)
        self.words = hashed.of(joined)
        raw = np.frombuffer(joined, np.uint8)
        self.byte_at = np.cumsum([0, *(len(r) + 1 for r in raws)])
        inside = np.concatenate([[False], ~_SPACE[raw], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.first, self.last = edges[::2], edges[1::2]  # bytes
        self.point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80), [0]])  # the separator behind the last text is not there
        self.word_at = np.searchsorted(self.first, self.byte_at)
        self.starts = paragraph_starts(self.words, self.word_at, window)
        self.start_at = np.searchsorted(self.starts, self.word_at)
        self.ends = np.append(self.starts[1:], len(self.words))
        self.wide = long_starts(self.words, self.starts, self.start_at)
        self.wide_at = np.searchsorted(self.wide, self.start_at)

    def points(self, places: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Code points in their texts of byte places."""
        return self.point[places] - self.point[self.byte_at[text]]


def lots(texts: list[str], hashed: Words, window: int) -> Iterator[tuple[int, Lot]]:
    """Texts in lots of bounded length, each with the number of its first text."""
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and size < LOT_CHARS:
            size += len(texts[last])
            last += 1
        yield first, Lot(texts[first:last], hashed, window)
        first = last


def _owners(at: np.ndarray) -> np.ndarray:
    """The text of each thing, of bounds like ``Lot.word_at``."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def _spread(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs ``first, first + 1, ...``, so many each: the run of every value, and the values."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + first[owner]


def paragraph_starts(words: np.ndarray, word_at: np.ndarray, window: int) -> np.ndarray:
    """Where paragraphs begin: at the least word-pair hash of every ``window`` places in a row of a text.

    The cuts depend on the words around them alone, so a passage is cut alike wherever it
    stands, also in the middle of a line, and no paragraph but the first and last of a text
    exceeds ``window`` words: any 2 * ``window`` words hold a whole one.
    """
    if not len(words):
        return np.zeros(0, np.int64)
    cut = np.zeros(len(words), bool)
    cut[word_at[:-1][np.diff(word_at) > 0]] = True
    if len(words) > window:
        pair = mix(words[:-1] * _STEP + words[1:])
        held = np.lib.stride_tricks.sliding_window_view(pair, window)
        # all pairs of a row are of one text
        whole = np.flatnonzero(np.arange(len(held)) + window < np.repeat(word_at[1:], np.diff(word_at))[: len(held)])
        step = max(1, (1 << 20) // window)  # rows at a time, for very long texts
        for at in range(0, len(whole), step):
            rows = whole[at : at + step]
            cut[held[rows].argmin(1) + rows + 1] = True
    return np.flatnonzero(cut)


def long_starts(words: np.ndarray, starts: np.ndarray, start_at: np.ndarray) -> np.ndarray:
    """Which paragraphs begin a long one: those whose cut has the least hash of ``LONG`` cuts in a row of a text."""
    if not len(starts):
        return np.zeros(0, np.int64)
    cut = np.zeros(len(starts), bool)
    cut[start_at[:-1][np.diff(start_at) > 0]] = True
    if len(starts) > LONG:
        pair = mix(words[starts[1:] - 1] * _STEP + words[starts[1:]])  # at paragraph k + 1
        held = np.lib.stride_tricks.sliding_window_view(pair, LONG - 1)
        row = np.arange(len(held))
        count = np.diff(start_at)
        until, several = (np.repeat(x, count)[: len(held)] for x in (start_at[1:], count > LONG))
        rows = row[several & (row + LONG - 1 < until)]
        cut[held[rows].argmin(1) + rows + 1] = True
    return np.flatnonzero(cut)


def paragraph_units(words: np.ndarray, starts: np.ndarray, room: np.ndarray, n: int) -> np.ndarray:
    """What equal paragraphs share: the hash of their words.

    One of fewer than ``n`` words takes its ``n`` last words and its length instead, words
    before it included, so that common words alone do not make documents alike. ``room`` is
    the number of words from the begin of its text to the end of a paragraph.
    """
    unit = paragraph_hashes(words, starts)
    ends = np.append(starts[1:], len(words))
    short = (ends - starts < n) & (room >= n)
    if short.any():
        unit[short] = mix(shingles(words, n)[ends[short] - n] + (ends - starts)[short].astype(np.uint64) * _STEP)
    return unit


def paragraph_hashes(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of each paragraph's word sequence."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    ends = np.append(starts[1:], len(words))
    place = np.arange(1, len(words) + 1) - np.repeat(starts, ends - starts)
    return mix(np.add.reduceat(mix(words + place.astype(np.uint64) * _STEP), starts) + (ends - starts).astype(np.uint64))


def paragraph_shingles(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-word shingle at each word; the largest value where it would leave its paragraph."""
    ends = np.repeat(np.append(starts[1:], len(words)), np.diff(np.append(starts, len(words))))
    out = np.full(len(words), _MOST)
    if len(words) >= n:
        out[: len(words) - n + 1] = shingles(words, n)
    out[np.arange(len(words)) + n > ends] = _MOST
    return out


def band_keys(held: np.ndarray, counts: np.ndarray, bands: int) -> np.ndarray:
    """Keys, one row a band, of paragraphs whose shingle hashes stand in ``held``, so many each (one at least)."""
    seeds = mix(np.arange(101, 101 + bands * ROWS, dtype=np.uint64)) | np.uint64(1)
    least = np.minimum.reduceat(held * seeds[:, None], np.cumsum(counts) - counts, axis=1)
    out = np.repeat(np.arange(bands, dtype=np.uint64)[:, None], len(counts), axis=1)
    for k in range(ROWS):
        out = mix(out * _STEP + least[k::ROWS])
    return out


def _scan(docs: DataFrame, window: int, n: int, bands: int) -> str:
    """Write ``kind=0`` (paragraphs with their place), ``kind=1`` (band keys of long paragraphs) and ``kind=2``
    (long paragraphs: their number as ``key``, their first and last paragraph as ``place, n_words``); returns the path."""
    schema = "kind int, doc_id bigint, address bigint, unit bigint, place int, start bigint, end bigint, n_words int, key bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Words()
        names = [x.split()[0] for x in schema.split(", ")]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

        def batch_of(kind: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
            count = len(columns["unit"])
            arrays = [pa.array(columns[c], t) if c in columns else pa.nulls(count, t) for c, t in zip(names[1:], types[1:])]
            return pa.RecordBatch.from_arrays([pa.array(np.full(count, kind, np.int32)), *arrays], names)

        for batch in slices(batches):
            for row, lot in lots(texts(batch), hashed, window):
                # texts under n words have no paragraphs
                counts = np.diff(lot.word_at)
                owner = _owners(lot.start_at)
                room = lot.ends - lot.word_at[owner]
                unit = paragraph_units(lot.words, lot.starts, room, n)
                kept = np.flatnonzero(counts[owner] >= n)
                if not len(kept):
                    continue
                held = {
                    "unit": unit[kept].view(np.int64), "place": (kept - lot.start_at[owner[kept]]).astype(np.int32),
                    "start": lot.points(lot.first[lot.starts[kept]], owner[kept]), "end": lot.points(lot.last[lot.ends[kept] - 1], owner[kept]),
                    "n_words": (lot.ends - lot.starts)[kept].astype(np.int32),
                }
                until = np.append(lot.wide[1:], len(lot.starts)) - 1
                begin = lot.starts[lot.wide]
                sizes = lot.ends[until] - begin
                whole = np.flatnonzero(sizes >= n)
                wide_owner = _owners(lot.wide_at)[whole]
                unit = paragraph_hashes(lot.words, begin)[whole].view(np.int64)
                places = [x - lot.start_at[wide_owner] for x in (lot.wide[whole], until[whole])]
                wide = {"unit": unit, "place": places[0].astype(np.int32), "n_words": places[1].astype(np.int32), "key": whole - lot.wide_at[wide_owner]}
                for kind, own, columns in ((0, owner[kept], held), (2, wide_owner, wide)):
                    ready, at = batch_of(kind, columns), pa.array(row + own)
                    ids = [batch.column("doc_id").take(at), batch.column("address").take(at)]
                    yield pa.RecordBatch.from_arrays([ready.column(0), *ids, *ready.columns[3:]], names)
                shingled = paragraph_shingles(lot.words, begin, n)
                key = band_keys(shingled[shingled != _MOST], (sizes - n + 1)[whole], bands).view(np.int64).ravel()
                unit = np.tile(unit, bands)
                order = np.lexsort((unit, key))
                key, unit = key[order], unit[order]
                new = np.r_[True, (key[1:] != key[:-1]) | (unit[1:] != unit[:-1])]
                yield batch_of(1, {"unit": unit[new], "key": key[new]})

    path = scratch_path(docs.sparkSession, "paragraphs")
    docs.mapInArrow(run, schema).write.partitionBy("kind").parquet(path)
    return path


def _fetched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc_id, address, text, places`` of the documents in ``wanted`` (``at, id, places``); few texts are shuffled."""
    on = (F.col("address") == F.col("at")) & F.col("doc_id").eqNullSafe(F.col("id"))
    met = sieve(docs, "address", wanted, "at")[0].join(wanted.hint("merge"), on)
    return met.select("doc_id", "address", "text", "places")


def _contents(docs: DataFrame, wanted: DataFrame, window: int, n: int) -> DataFrame:
    """``unit, words``: the shingle hashes of wanted long paragraphs, each read from one document.

    ``wanted`` has ``at, id`` (a document) and ``places``: numbers of long paragraphs in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Words()
        for batch in slices(batches):
            wanted_of = batch.column("places").to_pylist()
            for row, lot in lots(texts(batch), hashed, window):
                begin = lot.starts[lot.wide]
                ends = np.append(begin[1:], len(lot.words))
                unit, held = paragraph_hashes(lot.words, begin).view(np.int64), paragraph_shingles(lot.words, begin, n)
                number = np.concatenate([lot.wide_at[k] + np.array(w, np.int64) for k, w in enumerate(wanted_of[row : row + len(lot.wide_at) - 1])])
                # the distinct shingles of each, in order
                owner, at = _spread(begin[number], (ends - begin)[number])
                part = held[at]
                owner, part = owner[part != _MOST], part[part != _MOST]
                order = np.lexsort((part, owner))
                owner, part = owner[order], part[order]
                new = np.r_[True, (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])][: len(part)]
                sets = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[new], np.arange(len(number) + 1)), pa.int32()), pa.array(part[new].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(unit[number]), sets], ["unit", "words"])

    return _fetched(docs, wanted).mapInArrow(run, "unit bigint, words array<bigint>").dropDuplicates(["unit"])


def _outwards(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """``doc_id, address, edge, words, points``: the words that go on from an edge of a paragraph, nearest first.

    ``wanted`` has ``at, id`` and ``places``: edges, 2 * place for the words before a
    paragraph and 2 * place + 1 for those behind it. ``points`` are the words' far ends in code points.
    """
    schema = "doc_id bigint, address bigint, edge int, words array<bigint>, points array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Words()
        for batch in slices(batches):
            wanted_of = batch.column("places").to_pylist()
            for row, lot in lots(texts(batch), hashed, window):
                here = wanted_of[row : row + len(lot.word_at) - 1]
                own = np.repeat(np.arange(len(here)), list(map(len, here)))
                edge = np.array([e for w in here for e in w], np.int64)
                behind = edge % 2 == 1
                at = np.append(lot.starts, 0)[lot.start_at[own] + edge // 2 + edge % 2]
                at = np.where(edge // 2 + edge % 2 == np.diff(lot.start_at)[own], lot.word_at[own + 1], at)  # behind the last paragraph
                count = np.minimum(2 * window, np.where(behind, lot.word_at[own + 1] - at, at - lot.word_at[own]))
                item, on = _spread(np.zeros(len(own), np.int64), count)
                on = np.where(behind[item], at[item] + on, at[item] - 1 - on)
                points = lot.points(np.where(behind[item], lot.last[on], lot.first[on]), own[item])
                offsets = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
                taken = pa.array(row + own)
                arrays = [batch.column("doc_id").take(taken), batch.column("address").take(taken), pa.array(edge, pa.int32())]
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (lot.words[on].view(np.int64), points)]
                yield pa.RecordBatch.from_arrays([*arrays, *lists], ["doc_id", "address", "edge", "words", "points"])

    return _fetched(docs, wanted).mapInArrow(run, schema).dropDuplicates(["doc_id", "address", "edge"])


def _extended(docs: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """``runs`` with both ends moved outwards, word by word, as far as the copy at ``before`` or ``behind`` goes on alike."""
    ends = []
    for side, place, copy in ((0, "low", "before"), (1, "high", "behind")):
        own = F.struct("doc_id", "address", (F.col(place) * 2 + side).cast("int").alias("edge")).alias("own")
        other = F.struct(f"{copy}.doc_id", f"{copy}.address", (F.col(f"{copy}.place") * 2 + side).cast("int").alias("edge")).alias("other")
        ends.append(runs.where(F.col(copy).isNotNull()).select("doc_id", "address", "run", F.lit(side).alias("side"), own, other))
    pairs = stored(ends[0].union(ends[1]), "ends")
    edges = pairs.select("own.*").union(pairs.select("other.*")).distinct()
    wanted = edges.groupBy(F.col("address").alias("at"), F.col("doc_id").alias("id")).agg(F.collect_list("edge").alias("places"))
    read = stored(_outwards(docs, stored(wanted, "wanted"), window), "outwards")

    def met(x: str) -> DataFrame:
        return read.select(*(F.col(c).alias(f"{x}_{c}") for c in read.columns))

    def on(x: str) -> Column:
        return (
            F.col(f"{x}.doc_id").eqNullSafe(F.col(f"{x}_doc_id")) & (F.col(f"{x}.address") == F.col(f"{x}_address")) & (F.col(f"{x}.edge") == F.col(f"{x}_edge"))
        )

    both = pairs.join(met("own"), on("own")).join(met("other"), on("other"))
    equal = F.zip_with("own_words", "other_words", lambda a, b: a.eqNullSafe(b))
    until = F.array_position(equal, F.lit(False))
    both = both.withColumn("more", F.when(until > 0, until - 1).otherwise(F.size("own_words")).cast("int")).where("more > 0")
    point = F.element_at("own_points", F.col("more"))
    moved = both.groupBy(F.col("doc_id").alias("d"), F.col("address").alias("at"), F.col("run").alias("r")).agg(
        F.min(F.when(F.col("side") == 0, point)).alias("from"), F.max(F.when(F.col("side") == 1, point)).alias("to"), F.sum("more").alias("more")
    )
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("address") == F.col("at")) & (F.col("run") == F.col("r"))
    return runs.join(moved, same, "left").withColumns(
        {"start": F.coalesce("from", "start"), "end": F.coalesce("to", "end"), "n_words": F.col("n_words") + F.coalesce("more", F.lit(0))}
    )


def linked_sets(ids: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that join the sets (of distinct elements) whose Jaccard similarity is ``similarity`` or more.

    All pairs are compared; of those alike a spanning forest is returned.
    """
    n = np.array(list(map(len, sets)))
    owner = np.repeat(np.arange(len(sets)), n)
    held = np.concatenate(sets)
    order = np.argsort(held)
    owner, held = owner[order], held[order]
    new = np.r_[True, held[1:] != held[:-1]]
    several = ~(new & np.r_[new[1:], True])  # what one set alone has is in no intersection
    if not several.any():
        return []
    owner, word = owner[several], np.cumsum(new[several]) - 1
    both = np.zeros((len(sets), len(sets)), np.float32)
    size = int(word[-1]) + 1
    for low in range(0, size, 8192):  # columns in lots, so that the matrix stays small
        part = slice(*np.searchsorted(word, [low, low + 8192]))
        has = np.zeros((len(sets), min(8192, size - low)), np.float32)
        has[owner[part], word[part] - low] = 1
        both += has @ has.T
    same = np.rint(both).astype(np.int64)
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(*np.nonzero(np.triu(same >= similarity * (n[:, None] + n[None, :] - same), 1))):
        rx, ry = find(int(x)), find(int(y))
        if rx != ry:
            root[rx] = ry
            out.append((ids[x], ids[y]))
    return out


def _alike(members: DataFrame, contents: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: links between the paragraphs of each cluster; ``members`` has ``cluster, u``, ``contents`` ``unit, words``.

    All of a small cluster are compared in one task; those of a large one by
    :func:`crowd_links`, which joins the same without copying each to every block.
    """

    def compare(ids: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        return linked_sets(ids, sets, similarity)

    sizes = members.groupBy("cluster").agg(F.count("*").alias("units")).select(F.col("cluster").alias("c"), "units")
    if sizes.where(F.col("units") > GROUP_UNITS).isEmpty():
        return compared(members.join(contents, F.col("u") == F.col("unit")).select(F.struct("cluster").alias("g"), "u", "words"), compare)
    held = members.join(sizes, F.col("cluster") == F.col("c")).join(contents, F.col("u") == F.col("unit"))
    held = held.select("cluster", "u", "units", "words")
    small = held.where(F.col("units") <= GROUP_UNITS).select(F.struct("cluster").alias("g"), "u", "words")
    large = held.where(F.col("units") > GROUP_UNITS).select("cluster", "u", F.lit(max(GROUP_UNITS // 2, 1)).alias("room"), "words")
    return compared(small, compare).union(crowd_links(large, compare, similarity))


def _members(roots: DataFrame) -> DataFrame:
    """``cluster, u`` of all nodes of components, roots included."""
    roots = stored(roots, "members")
    members = roots.select(F.col("root").alias("cluster"), F.col("node").alias("u"))
    return members.union(roots.select("root", F.col("root").alias("u")).distinct())


def repeated_passages(
    docs: DataFrame,
    similarity: float = 0.8,
    recall: float = 0.99,
    shingle: int = 5,
    window: int = 15,
    least_words: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Passages that stand in several documents: ``doc_id, start, end, n_words, n_paragraphs, class_id, removed``.

    1. Texts are cut into paragraphs by content (:func:`paragraph_starts`), and paragraphs
       in a row are grouped to long ones of some 50 words, also by content.
    2. Paragraphs of equal words are one class (:func:`paragraph_units`). A passage of
       2 * ``window`` + ``least_words`` words or more, 50 here, holds ``least_words`` of them.
    3. Long paragraphs collide by MinHash bands, with as many bands as ``recall`` at
       ``similarity`` takes. Colliding ones are joined to the least of their list, one pair
       each, and closed into clusters by components. All of a cluster are compared by the
       exact Jaccard similarity of their ``shingle``-word shingles; those of ``similarity``
       or more are closed into classes, which their paragraphs take if they have no other.
    4. A class that stands in two documents or more is repeated. Repeated paragraphs in a
       row are a passage if together they have ``least_words``.
    5. Both ends of a passage go on word by word, at most 2 * ``window``, as far as they
       equal the first copy of the class at that end (the first copy itself: the last one).

    One row per passage in place: start and end in code points. ``class_id`` is the least
    class in it. ``removed`` is false where all its classes occur first (by id, text and
    place), so dropping removed passages leaves one copy of each. Documents without a
    repeated passage, null and empty texts, and texts under ``shingle`` words give no row.
    Repeated rows (same id and text) count as one document, and their passages come once;
    null ids are an id of their own. Extra columns are dropped.
    """
    rows = only(docs, doc_id=(id_col, "bigint"), text=(text_col, "string")).withColumn("address", F.xxhash64("text"))
    path = _scan(rows, window, shingle, bands_for(similarity, recall))
    schema = "doc_id bigint, address bigint, unit bigint, place int, start bigint, end bigint, n_words int, key bigint, kind int"
    parts = docs.sparkSession.read.schema(schema).parquet(path)
    places = parts.where("kind = 0").select("unit", "doc_id", "address", "place", "start", "end", "n_words")
    wide = parts.where("kind = 2").select("unit", "doc_id", "address", F.col("place").alias("low"), F.col("n_words").alias("high"), "key")
    keys = parts.where("kind = 1").select("key", "unit").distinct()
    least = keys.groupBy(F.col("key").alias("k")).agg(F.min("unit").alias("least"), F.max("unit").alias("most")).where("least != most")
    pairs = keys.join(least, F.col("key") == F.col("k")).where("unit != least").select(F.col("unit").alias("a"), F.col("least").alias("b"))
    members = _members(components(pairs))

    one = wide.join(members.select("u"), F.col("unit") == F.col("u")).groupBy("unit").agg(F.min(F.struct("address", "doc_id", "key")).alias("one"))
    wanted = one.groupBy(F.col("one.address").alias("at"), F.col("one.doc_id").alias("id")).agg(
        F.collect_list(F.col("one.key").cast("int")).alias("places")
    )
    contents = stored(_contents(rows, stored(wanted, "wanted"), window, shingle), "contents")
    near = _members(components(_alike(members, contents, similarity)))

    def two_documents(rows: DataFrame, copy: Column) -> DataFrame:
        ends = rows.groupBy(F.col("class").alias("c")).agg(F.min(copy).alias("first"), F.max(copy).alias("last"))
        document = [F.struct(f"{x}.doc_id", f"{x}.address") for x in ("first", "last")]
        return ends.where(~document[0].eqNullSafe(document[1]))

    # equal paragraphs; places that no class can have are left before the shuffle
    classes = stored(two_documents(places.withColumnRenamed("unit", "class"), F.struct("doc_id", "address", "place")), "classes")
    met = sieve(places, "unit", classes, "c")[0].join(classes, F.col("unit") == F.col("c"))
    own = F.struct("doc_id", "address", "place")
    other = F.when(own.eqNullSafe(F.col("first")), F.col("last")).otherwise(F.col("first"))
    columns = ["doc_id", "address", "place", "start", "end", "n_words", "class", "is_first", "before", "behind"]
    equal = met.select(
        F.lit(0).alias("kind"), *columns[:6], F.col("unit").alias("class"), own.eqNullSafe(F.col("first")).alias("is_first"), other.alias("before"), other.alias("behind")
    )
    # paragraphs of long ones that are alike
    classed = stored(wide.join(near, F.col("unit") == F.col("u")).select("doc_id", "address", "low", "high", F.col("cluster").alias("class")), "alike")
    own = F.struct("doc_id", "address", "low", "high")
    spans = classed.join(two_documents(classed, own), F.col("class") == F.col("c"))
    other = F.when(own.eqNullSafe(F.col("first")), F.col("last")).otherwise(F.col("first"))
    spans = spans.withColumn("other", other).withColumn("is_first", own.eqNullSafe(F.col("first"))).withColumn("at", F.explode(F.sequence("low", "high")))
    sides = {
        name: F.when(F.col("at") == F.col(side), F.struct(F.col("other.doc_id"), F.col("other.address"), F.col(f"other.{side}").alias("place")))
        for name, side in (("before", "low"), ("behind", "high"))
    }
    spans = stored(
        spans.select(F.col("doc_id").alias("d"), F.col("address").alias("a"), "at", "class", "is_first", *(v.alias(k) for k, v in sides.items())), "spans"
    )
    on = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("address") == F.col("a")) & (F.col("place") == F.col("at"))
    alike = sieve(places, "address", spans, "a")[0].join(spans, on).select(F.lit(1).alias("kind"), *columns)

    repeated = equal.union(alike).groupBy("doc_id", "address", "place").agg(F.min(F.struct("kind", *columns[3:])).alias("one"))
    repeated = repeated.select("doc_id", "address", "place", "one.*")
    # paragraphs in a row: of one document, so a window never holds more than one text's
    order = Window.partitionBy("doc_id", "address").orderBy("place")
    run = F.col("place") - F.row_number().over(order)
    runs = (
        repeated.withColumn("run", run)
        .groupBy("doc_id", "address", "run")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.sum("n_words").alias("n_words"),
            F.count("*").alias("n_paragraphs"),
            F.min("class").alias("class_id"),
            (~F.bool_and("is_first")).alias("removed"),
            F.min("place").alias("low"),
            F.max("place").alias("high"),
            F.min_by("before", "place").alias("before"),
            F.max_by("behind", "place").alias("behind"),
        )
        .where(F.col("n_words") >= least_words)
    )
    passages = _extended(rows, stored(runs, "runs"), window)
    return passages.select("doc_id", "start", "end", "n_words", "n_paragraphs", "class_id", "removed")
