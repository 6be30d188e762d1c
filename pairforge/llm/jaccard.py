"""Operator 4: documents joined by the Jaccard similarity of their word shingles, size-aware."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ..session import brief_shuffles, scratch_path, stored
from .common import fresh, only, sieve, slices, texts
from .components import components
from .crowds import crowd_links
from .hashing import Words, mix, shingles

#: Sizes of heavy sets are cut into ranges of this ratio; each has its own number of blocks.
RANGE = 1.25
#: A block of one shingle is no evidence; so many of them are spared by as many more blocks.
SPARE = 2
#: Postings of a task that are combined at a time: bounds its memory, not what it finds.
FLUSH = 1 << 19
#: Words whose hashes a task remembers; only speed depends on it.
REMEMBERED = 1 << 16
#: Most sets, and shingles in them, that are compared with each other in one go.
GROUP_SETS, GROUP_SHINGLES = 512, 1 << 20


#: Bits (log2) of the broadcast filter of shared shingles: 32 MB, whatever the input.
SHARED_BITS = 28
#: Characters of text for each range of shingle hashes, and most ranges (log2).
RANGE_CHARS, MOST_RANGES = 1 << 18, 20


def by_block(p: int, q: int) -> bool:
    """Whether blocks, one more than elements may differ, have six elements or more."""
    return 6 * (1 + q / p) * (q - p) <= q + p


class Signatures:
    """Keys such that any two linked sets share one.

    With the threshold p/q, sets of sizes n <= m link only if at most
    ``(n + m) (q - p) / (q + p)`` elements are in just one of them.

    *Light* sets: each lacks at most ``d = floor(n (q - p) / q)`` elements of the
    intersection, so the intersection is one of its subsets of n - d to n elements. All of
    those are enumerated; their number is C(n, d) and so on.

    *Heavy* sets go to inverted lists, which are kept in one of two ways. If few elements
    may differ, the elements are dealt by hash into more blocks than that, so that linked
    sets agree on a whole block, and lists are kept by block content: lists by single
    shingles would hold all documents that share a passage. Blocks of less than about six
    shingles are no better than shingles; so at lower thresholds lists are kept by single
    shingles, those of the n - ceil(n p / q) + 1 first in an order that all sets share:
    linked sets share one of them. Shingles that other sets have, by the filter ``shared``,
    come last in it, and the rest goes by hash. Any order finds all links; this one keeps
    lists short and unlike sets apart.

    The boundary is the largest size at which the subsets cost no more than the postings;
    a posting of a small set is priced higher, since more unlike sets share it and have to
    be compared.
    """

    def __init__(self, p: int, q: int, shared: np.ndarray | None = None, price: float = 4.0) -> None:
        self.p, self.q = p, q
        self.shared = np.zeros(1 << SHARED_BITS - 3, np.uint8) if shared is None else shared
        self.by_block = by_block(p, q)
        self.boundary = 0
        while self._subsets(self.boundary + 1) <= price * self._postings(self.boundary + 1):
            self.boundary += 1

    def _postings(self, n: int) -> int:
        return len(self._blocks(n)) * self._block_count(self._range(n)) if self.by_block else self._prefix(n)

    def _prefix(self, n: int) -> int:
        return n - -(-n * self.p // self.q) + 1

    def _missing(self, n: int) -> int:
        return n * (self.q - self.p) // self.q

    def _subsets(self, n: int) -> int:
        return sum(comb(n, d) for d in range(self._missing(n) + 1))

    def _range(self, n: int) -> int:
        return floor(log(n) / log(RANGE) + 1e-9)

    def _block_count(self, k: int) -> int:
        """One block more than elements may differ when the smaller set is of range k, and the spare ones."""
        top = RANGE ** (k + 1)
        return floor(top * (1 + self.q / self.p) * (self.q - self.p) / (self.q + self.p)) + 1 + SPARE

    def _blocks(self, n: int) -> list[int]:
        """The size ranges in which a set of n elements is listed: its own and, if it may be a
        smaller partner's larger one, the one below it."""
        own, least = self._range(n), self._range(max(1, -(-n * self.p // self.q)))
        return list(range(least, own + 1))

    def keys(self, elements: np.ndarray) -> np.ndarray:
        n = len(elements)
        out = []
        mixed = mix(elements)
        if n <= self.boundary:
            out.append(self._subset_keys(mixed))
        if n * self.q > self.boundary * self.p:  # it may have a heavy partner
            if self.by_block:
                out.extend(self._block_keys(mixed, k) for k in self._blocks(n))
            else:
                out.append(self._first_elements(elements, mixed))
        return np.concatenate(out)

    def _first_elements(self, elements: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        place = _digest(elements) >> np.uint64(40 - SHARED_BITS)
        late = self.shared[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1
        return mix(mixed[np.lexsort((mixed, late))[: self._prefix(len(elements))]])

    def _subset_keys(self, mixed: np.ndarray) -> np.ndarray:
        sums = mixed.sum(keepdims=True)  # wraps around: order-free
        n, out = len(mixed), []
        for d in range(self._missing(n) + 1):
            if d:
                # drop one element more, each combination once: by last index dropped
                last = np.arange(n) if d == 1 else np.concatenate([np.arange(i + 1, n) for i in at])
                start = np.repeat(sums, n) if d == 1 else np.repeat(sums, n - 1 - at)
                sums, at = start - mixed[last], last
            out.append(mix(sums ^ np.uint64(n - d)))
        return np.concatenate(out)

    def _block_keys(self, mixed: np.ndarray, k: int) -> np.ndarray:
        count = self._block_count(k)
        block = (mixed >> np.uint64(33)) % np.uint64(count)
        order = np.argsort(block, kind="stable")
        held, start, size = np.unique(block[order], return_index=True, return_counts=True)
        sums = np.add.reduceat(mixed[order], start)
        seed = mix(np.array([k + 1], np.uint64))[0]
        keys = mix(sums ^ mix(held + seed))
        if count - np.count_nonzero(size > 1) <= SPARE:
            return keys[size > 1]
        # so many poor blocks that two linked sets may agree on these alone: list them all
        void = np.setdiff1d(np.arange(count, dtype=np.uint64), held)
        return np.concatenate([keys, mix(mix(void + seed))])


def _digest(elements: np.ndarray) -> np.ndarray:
    """40 bits of each shingle for the search of shared ones; the first ``SHARED_BITS`` are its place in the filter."""
    return mix(elements ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(24)


def _set_id(elements: np.ndarray) -> int:
    return xxh3_64_intdigest(elements.tobytes()) - (1 << 63)


def _shared(docs: DataFrame, n_words: int) -> np.ndarray:
    """Filter of the shingles that two different sets or more have, counted over all documents.

    Each task sends the digests of its shingles, with eight bits of the set's id, by ranges
    of the digest: six bytes a shingle at most. The task of a range finds those with two ids and
    returns its part of the filter. The filter has a fixed size; false hits in it, more of
    them the larger the input is, only put a shingle later in the order.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    log_ranges = min(max(1, (chars // RANGE_CHARS).bit_length()), MOST_RANGES)
    low = np.uint64(40 - log_ranges)
    places = SHARED_BITS - log_ranges

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Words(REMEMBERED)
        found: list[np.ndarray] = []
        held = 0

        def combined() -> pa.RecordBatch:
            marks = np.unique(np.concatenate(found))
            shingle = marks >> np.uint64(8)
            new = shingle[1:] != shingle[:-1]
            marks = marks[np.r_[True, new] | np.r_[new, True]]  # two ids of a shingle are enough
            shingle = marks >> np.uint64(8)
            part, start = np.unique(shingle >> low, return_index=True)
            rest = (shingle & ((np.uint64(1) << low) - np.uint64(1))).astype(np.uint64)
            rows = [(rest[i:j] << np.uint64(8) | marks[i:j] & np.uint64(255)).tobytes() for i, j in zip(start, np.r_[start[1:], len(marks)])]
            return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([_packed(r) for r in rows], pa.binary())], ["part", "marks"])

        for batch in slices(batches):
            for text in texts(batch):
                elements = np.unique(shingles(hashed(text), n_words))
                if len(elements):
                    found.append(_digest(elements) << np.uint64(8) | np.uint64(_set_id(elements) & 255))
                    held += len(elements)
                if held >= FLUSH:
                    yield combined()
                    found.clear()
                    held = 0
        if found:
            yield combined()
        pa.default_memory_pool().release_unused()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, marks = None, []

        def close() -> pa.RecordBatch:
            shingle = np.unique(np.concatenate(marks)) >> np.uint64(8)
            place = (shingle[1:][shingle[1:] == shingle[:-1]] >> (low - np.uint64(places))).astype(np.int64)
            bits = np.zeros(1 << places, np.uint8)
            bits[place] = 1
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])

        for batch in slices(batches):
            for part, packed in zip(batch.column("part").to_pylist(), batch.column("marks").to_pylist()):
                if part != at:
                    if marks:
                        yield close()
                    at, marks = part, []
                marks.append(_unpacked(packed))
        if marks:
            yield close()

    sent = docs.select("text").mapInArrow(send, "part int, marks binary")
    with brief_shuffles(docs.sparkSession):
        bits = sent.repartition("part").sortWithinPartitions("part").mapInArrow(gather, "part int, bits binary")
        rows = bits.collect()  # one bit a place: as large as the filter
    shared = np.zeros(1 << SHARED_BITS - 3, np.uint8)
    width = 1 << places - 3
    for row in rows:
        shared[row.part * width : (row.part + 1) * width] = np.frombuffer(row.bits, np.uint8)
    return shared


def _packed(marks: bytes) -> bytes:
    """64-bit marks of at most 48 bits in six bytes each, byte planes side by side."""
    return np.ascontiguousarray(np.frombuffer(marks, np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(6, -1)
    marks = np.zeros((planes.shape[1], 8), np.uint8)
    marks[:, :6] = planes.T
    return marks.view(np.uint64).ravel()


def _postings(docs: DataFrame, n_words: int, p: int, q: int) -> str:
    """Write, in one pass over the texts, the parts ``kind=0`` (a row per document), ``kind=1``
    (postings) and ``kind=2`` (pairs); returns the path.

    Postings of a task are combined before they leave it: of the sets that share a key,
    the least keeps the posting and the others become pairs with it. So a key has one
    posting from each task at most, also when a third of all documents have it.
    """
    schema = "kind int, doc_id bigint, address bigint, n int, set_id bigint, other bigint"
    shared = None if by_block(p, q) else docs.sparkSession.sparkContext.broadcast(_shared(docs, n_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, sign = Words(REMEMBERED), Signatures(p, q, shared and shared.value)
        names = ["kind", "doc_id", "address", "n", "set_id", "other"]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        keys: list[np.ndarray] = []
        sets: list[int] = []
        seen: set[int] = set()
        held = 0

        def combined() -> Iterator[pa.RecordBatch]:
            if not keys:
                return
            key = np.concatenate(keys)
            owner = np.repeat(np.array(sets, np.int64), [len(k) for k in keys])
            order = np.lexsort((owner, key))
            key, owner = key[order], owner[order]
            first = np.r_[True, key[1:] != key[:-1]]
            root = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
            rest = ~first & (owner != owner[root])
            pairs = np.unique(np.stack([owner[rest], owner[root][rest]]), axis=1)
            for kind, a, b in ((1, owner[first], key[first].view(np.int64)), (2, pairs[0], pairs[1])):
                for at in range(0, len(a), 1 << 17):
                    x, y = a[at : at + (1 << 17)], b[at : at + (1 << 17)]
                    none = [pa.nulls(len(x), t) for t in types[1:4]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), *none, pa.array(x), pa.array(y)], names)
            keys.clear()
            sets.clear()
            seen.clear()

        for batch in slices(batches):
            sizes, ids = [], []
            for text in texts(batch):
                elements = np.unique(shingles(hashed(text), n_words))
                sizes.append(len(elements))
                ids.append(_set_id(elements) if len(elements) else None)
                if len(elements) and ids[-1] not in seen:
                    seen.add(ids[-1])
                    sets.append(ids[-1])
                    keys.append(sign.keys(elements))
                    held += len(keys[-1])
            rows = [batch.column("doc_id"), batch.column("address"), pa.array(sizes, pa.int32()), pa.array(ids, pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sizes), np.int32)), *rows, pa.nulls(len(sizes), pa.int64())], names)
            if held >= FLUSH:
                yield from combined()
                held = 0
        yield from combined()
        pa.default_memory_pool().release_unused()

    path = scratch_path(docs.sparkSession, "postings")
    docs.mapInArrow(run, schema).write.partitionBy("kind").parquet(path)
    return path


def _part(docs: DataFrame, path: str, kind: int) -> DataFrame:
    schema = "doc_id bigint, address bigint, n int, set_id bigint, other bigint, kind int"
    return docs.sparkSession.read.schema(schema).parquet(path).where(F.col("kind") == kind)


def _candidates(docs: DataFrame, path: str) -> DataFrame:
    """Pairs that join all the sets of each list, one fewer than sets: with the least set of the list."""
    lists = _part(docs, path, 1).select(F.col("other").alias("key"), "set_id")
    least = F.min("set_id").over(Window.partitionBy("key"))
    pairs = lists.withColumn("least", least).where("set_id != least").select(F.col("set_id").alias("a"), F.col("least").alias("b"))
    return pairs.union(_part(docs, path, 2).select(F.col("set_id").alias("a"), F.col("other").alias("b")))


def _forest(ids: list[int], sets: list[np.ndarray], p: int, q: int) -> list[tuple[int, int]]:
    """Links that join the sets whose similarity is p/q or more: all pairs are compared, of those alike a spanning forest is returned."""
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    _, word, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = times[word] > 1  # what one set alone has is in no intersection
    if not several.any():
        return []
    owner, word = owner[several], (np.cumsum(times > 1) - 1)[word[several]]
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    # columns in lots, so that the matrix stays small whatever the sets' sizes
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(word, kind="stable")
    owner, word = owner[order], word[order]
    for low in range(0, int(word[-1]) + 1, 8192):
        part = slice(*np.searchsorted(word, [low, low + 8192]))
        has = np.zeros((len(sets), 8192), np.float32)
        has[owner[part], word[part] - low] = 1
        both += has @ has.T
    same = np.rint(both).astype(np.int64)
    near = np.triu(q * same >= p * (n[:, None] + n[None, :] - same), 1)
    found = []
    for x, y in zip(*np.nonzero(near)):
        rx, ry = find(int(x)), find(int(y))
        if rx != ry:
            root[rx] = ry
            found.append((ids[x], ids[y]))
    return found


def _linked(groups: DataFrame, n_words: int, p: int, q: int) -> DataFrame:
    """``a, b``: links that join, group by group, the sets that the threshold links.

    ``groups`` has ``cluster, set_id, text``. All sets of a group are compared by
    the exact size of their intersections, and of the links found a spanning forest is
    returned: fewer than sets, never all pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Words(REMEMBERED)
        at, ids, sets = None, [], []
        left: list[int] = []
        right: list[int] = []

        def close() -> None:
            if len(ids) > 1:
                for a, b in _forest(ids, sets, p, q):
                    left.append(a)
                    right.append(b)

        def ready() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])
            left.clear()
            right.clear()
            return batch

        for batch in slices(batches, 64):
            marks = zip(*(batch.column(c).to_pylist() for c in ("cluster", "set_id", "text")))
            for cluster, set_id, text in marks:
                if cluster != at:
                    close()
                    at, ids, sets = cluster, [], []
                if not ids or ids[-1] != set_id:  # repeated rows stand side by side
                    ids.append(set_id)
                    sets.append(np.unique(shingles(hashed(text), n_words)))
            yield ready()
        close()
        yield ready()
        pa.default_memory_pool().release_unused()

    ordered = groups.repartition("cluster").sortWithinPartitions("cluster", "set_id")
    return ordered.mapInArrow(run, "a bigint, b bigint")


def similar_sets(
    docs: DataFrame, n_words: int = 3, p: int = 90, q: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Rows ``doc_id, address, n, set_id`` of all documents, and ``node, root`` of linked sets.

    1. Each text becomes its set of shingle hashes; documents of one set are one set from
       here on, so exact copies cost nothing more.
    2. Sets get the keys of :class:`Signatures`; sets that share a key are joined to a
       cluster by one pair each, never all pairs, and clusters are closed by components.
    3. Linked sets are now in one cluster. Only sets of clusters of two or more fetch their
       text. A cluster is cut by size, since sets of very different sizes cannot link. All
       pairs of a small part are compared; a large one goes to :func:`crowd_links`, which is
       many tasks, copies no text to each of them, and loses no link.
    4. Components of the links.
    """
    rows = only(docs, doc_id=(id_col, "bigint"), text=(text_col, "string"))
    rows = rows.withColumn("address", F.xxhash64("text"))
    path = _postings(rows, n_words, p, q)
    held = _part(docs, path, 0).select("doc_id", "address", "n", "set_id")
    grouped = components(_candidates(docs, path))
    # one document for each set of a cluster
    sets = held.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(
        F.min(F.struct("address", "doc_id")).alias("one"), F.first("n").alias("n")
    )
    roots = grouped.select(F.col("root").alias("node"), "root").distinct()
    members = sets.join(grouped.union(roots), F.col("set_id") == F.col("node")).select(
        F.col("root").alias("cluster"), "set_id", "n", F.col("one.address").alias("at"), F.col("one.doc_id").alias("id")
    )
    # sizes of linked sets differ by the ratio q/p at most, so by one range of a ratio just above it
    size_range = F.floor(F.log("n") / log(1.001 * q / p)).cast("int")
    members = stored(members.withColumn("range", size_range), "members")
    placed = members.select("cluster", "set_id", "n", "range", F.explode(F.array(F.col("range"), F.col("range") + 1)).alias("g"))
    sizes = placed.groupBy("cluster", "g").agg(
        F.count("*").alias("sets"), F.sum("n").alias("shingles"), F.count_if(F.col("range") == F.col("g")).alias("own")
    )
    # sets of a group that one task compares at a time, 0 if it is the whole group
    whole = (F.col("sets") <= GROUP_SETS) & (F.col("shingles") <= GROUP_SHINGLES)
    room = F.least(F.lit(GROUP_SETS / 2), F.col("sets") * GROUP_SHINGLES / F.col("shingles") / 2)
    room = F.when(whole, 0).otherwise(F.greatest(F.floor(room), F.lit(1))).cast("int")
    sizes = sizes.where("own > 0 and sets > 1").select("cluster", "g", room.alias("room"))
    targets = placed.select("cluster", "set_id", "g").join(sizes.hint("merge"), ["cluster", "g"])
    targets = targets.groupBy("set_id").agg(F.collect_list(F.struct(F.xxhash64("cluster", "g").alias("cluster"), "room")).alias("targets"))
    wanted = stored(members.select("set_id", "at", "id").join(targets.hint("merge"), "set_id"), "wanted")
    # the same kind of join at every size: with the filter before it, few texts move
    fetched = sieve(rows, "address", wanted, "at")[0].join(
        wanted.hint("merge"), (F.col("address") == F.col("at")) & F.col("doc_id").eqNullSafe(F.col("id"))
    )
    single = lambda x: x["room"] == 0
    small = fetched.select("set_id", "text", F.explode(F.filter("targets", single)).alias("t")).select("t.cluster", "set_id", "text")
    links = _linked(small, n_words, p, q)
    if not wanted.where(F.exists("targets", lambda x: ~single(x))).isEmpty():
        large = fetched.select("set_id", "text", F.filter("targets", lambda x: ~single(x)).alias("t")).where(F.size("t") > 0)
        links = links.union(crowd_links(_sets(large, n_words), lambda ids, sets: _forest(ids, sets, p, q), p / q))
    return held, components(links)


def _sets(rows: DataFrame, n_words: int) -> DataFrame:
    """``cluster, u, room, words`` of ``rows(set_id, text, t)``, ``t`` the clusters of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Words(REMEMBERED)
        for batch in slices(batches, 64):
            sets = [np.unique(shingles(hashed(text), n_words)).view(np.int64) for text in texts(batch)]
            words = pa.array(sets, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("set_id"), words, batch.column("t")], ["u", "words", "t"])
        pa.default_memory_pool().release_unused()

    made = rows.mapInArrow(run, "u bigint, words array<bigint>, t array<struct<cluster:bigint,room:int>>")
    return made.select("u", "words", F.explode("t").alias("t")).select("t.cluster", "u", "t.room", "words")


def jaccard_groups(
    docs: DataFrame, n_words: int = 3, p: int = 90, q: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document; sets link at a similarity of p/q or more.

    ``component_id`` is the least id that links reach. One row per input row: repeated rows
    and repeated ids stay, and rows of one text are in one component; null ids do not count
    as least, so a component of null ids only has a null id. Texts without words (null,
    empty) have no shingles and are linked with nothing: their component is their own id.
    Extra columns are dropped; an empty table gives an empty table.
    """
    held, linked = similar_sets(docs, n_words, p, q, id_col, text_col)
    rooted = held.join(linked, F.col("set_id") == F.col("node"), "left").withColumn("group", F.coalesce("root", "set_id"))
    least = rooted.where(F.col("group").isNotNull()).groupBy(F.col("group").alias("g")).agg(F.min("doc_id").alias("least"))
    out = rooted.join(least, F.col("group") == F.col("g"), "left")
    component = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), component.alias("component_id"))


def drop_similar(
    docs: DataFrame, n_words: int = 3, p: int = 90, q: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with one row of each group of linked documents: the one with the least id.

    Ties (one id on several texts or rows) go to the least text digest, and of equal rows
    one stays. Documents without words all stay.
    """
    held, linked = similar_sets(docs, n_words, p, q, id_col, text_col)
    rooted = held.where(F.col("set_id").isNotNull()).join(linked, F.col("set_id") == F.col("node"), "left")
    rooted = rooted.withColumn("group", F.coalesce("root", "set_id"))
    kept = rooted.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "address")).alias("one"))
    kept = kept.select("group", F.col("one.doc_id").alias("id"), F.col("one.address").alias("at"))
    rows = held.where(F.col("set_id").isNotNull()).groupBy("doc_id", "address").agg(F.count("*").alias("rows"))
    same = (F.col("address") == F.col("at")) & F.col("doc_id").eqNullSafe(F.col("id"))
    addresses = rows.join(kept, same, "left").select("doc_id", "address", "rows", F.col("group").isNotNull().alias("stays"))
    names = {c: fresh(docs, f"near_{c}") for c in ("doc_id", "address", "rows", "stays", "own")}
    addresses = stored(addresses.where("not stays or rows > 1").select(*(F.col(c).alias(names[c]) for c in addresses.columns)), "addresses")
    marked = docs.withColumn(names["own"], F.xxhash64(F.col(f"`{text_col}`").cast("string")))
    on = (F.col(names["own"]) == F.col(names["address"])) & F.col(f"`{id_col}`").cast("bigint").eqNullSafe(F.col(names["doc_id"]))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    met, clear = sieve(marked, names["own"], addresses, names["address"])
    decided = met.join(addresses, on, "left")
    single = decided.where(F.col(names["stays"]).isNull())
    # of equal rows one stays; only rows that repeat are shuffled for it
    several = decided.where(F.col(names["stays"])).dropDuplicates([id_col, names["own"]])
    return clear.select(*columns).unionByName(single.select(*columns)).unionByName(several.select(*columns))
