"""Operator 12: best-fit packing by a grouping genetic algorithm on islands."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import only, slices, texts
from .vocabularies import byte_level_of, share_file

#: Documents that one population packs together.
BLOCK = 8192
ISLANDS, EPOCHS = 4, 3
#: Individuals of an island, and children it breeds in an epoch.
POPULATION, CHILDREN = 6, 40
#: Of a block's bins so many, the worst filled, are opened again and packed with those of other blocks.
REOPENED = 1 / 16

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids array<int>"


def pieces(
    docs: DataFrame, path: str, pattern: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id",
    text_col: str = "text", keep_ids: bool = True,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, ids``: token ids of every text, then ``end_id``.

    A list longer than ``capacity`` is cut into full pieces from its end, so only the first may
    be shorter. Null and empty texts give the end id alone; repeated rows give pieces each;
    null ids stay. ``ids`` is null unless ``keep_ids``; the checksum covers the ids as
    little-endian unsigned 32-bit integers.
    """
    file = share_file(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_level_of(file, pattern, True)
        end = np.array([end_id], "<u4")
        for batch in slices(batches):
            columns: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                ids = np.concatenate([encoder.encode(text).astype("<u4"), end])
                first = len(ids) % capacity or capacity
                for k, start in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[start : start + capacity] if k else ids[:first]
                    for column, value in zip(columns, (doc_id, k, start, len(part), crc32(part.tobytes()), part.astype("<i4") if keep_ids else None)):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            )

    return only(docs, doc_id=(id_col, "bigint"), text=(text_col, "string")).mapInArrow(run, _PIECES)


class Bins:
    """Open room of bins, looked up by its size: the tightest that fits comes from one bit mask."""

    def __init__(self, capacity: int, fill: np.ndarray) -> None:
        self.capacity, self.count = capacity, len(fill)
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0
        for bin_, room in enumerate((capacity - fill).tolist()):
            if room:
                self.by_room[room].append(bin_)
                self.mask |= 1 << room

    def best_fit(self, lengths: list[int]) -> list[int]:
        """Puts each length, in turn, into the open bin with least room that takes it, or a new one."""
        by_room, mask, out = self.by_room, self.mask, []
        for length in lengths:
            fitting = mask >> length
            if fitting:
                room = length + (fitting & -fitting).bit_length() - 1
                bin_ = by_room[room].pop()
                if not by_room[room]:
                    mask ^= 1 << room
            else:
                room, bin_ = self.capacity, self.count
                self.count += 1
            out.append(bin_)
            if room := room - length:
                by_room[room].append(bin_)
                mask |= 1 << room
        self.mask = mask
        return out


class Island:
    """A population of packings of one block; a packing is the bin of every document."""

    def __init__(self, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> None:
        self.lengths, self.capacity, self.rng = lengths, capacity, rng
        self.order = np.argsort(-lengths, kind="stable")

    def fills(self, bins: np.ndarray) -> np.ndarray:
        return np.bincount(bins, self.lengths).astype(np.int64)

    def fitness(self, bins: np.ndarray) -> float:
        """Mean square fill: higher with fewer bins and with full ones beside a nearly empty one."""
        return float(np.mean((self.fills(bins) / self.capacity) ** 2))

    def perfect(self, bins: np.ndarray) -> bool:
        """Whether no packing can be better: at most one bin has room."""
        return np.count_nonzero(self.fills(bins) < self.capacity) <= 1

    def seed(self, noise: float) -> np.ndarray:
        """Best fit by falling length, the lengths blurred by ``noise``."""
        order = self.order
        if noise:
            order = np.argsort(-self.lengths * (1 + noise * self.rng.random(len(self.lengths))), kind="stable")
        bins = np.empty(len(order), np.int32)
        bins[order] = Bins(self.capacity, np.zeros(0, np.int64)).best_fit(self.lengths[order].tolist())
        return bins

    def cross(self, into: np.ndarray, from_: np.ndarray) -> np.ndarray:
        """Injects whole well-filled bins of one packing into another.

        Bins of the other that hold an injected document are removed, and with them the
        duplicates; an eighth of the bins, badly filled ones rather than good ones, is opened,
        too. The documents that lost their bin are best-fitted, longest first, into the room
        of all bins.
        """
        rng, lengths = self.rng, self.lengths
        fill = self.fills(from_)
        well = np.flatnonzero(fill >= (self.capacity if (fill == self.capacity).any() else np.median(fill)))
        share = rng.uniform(0.01, 0.05)
        given = np.zeros(len(fill), bool)
        given[rng.choice(well, max(1, int(share * len(well))), replace=False)] = True
        injected = given[from_]
        own = self.fills(into)
        gone = np.zeros(len(own), bool)
        gone[into[injected]] = True
        open_ = np.flatnonzero((own < self.capacity) & ~gone)
        if len(open_):
            blurred = own[open_] + rng.uniform(0, self.capacity / 5, len(open_))
            gone[open_[np.argsort(blurred, kind="stable")[: max(1, len(own) // 8)]]] = True
        displaced = gone[into] & ~injected
        stay = ~gone[into] & ~injected
        child = np.empty(len(into), np.int32)
        _, child[stay] = np.unique(into[stay], return_inverse=True)
        kept = int(child[stay].max()) + 1 if stay.any() else 0
        _, places = np.unique(from_[injected], return_inverse=True)
        child[injected] = kept + places
        settled = ~displaced
        fill = np.bincount(child[settled], lengths[settled]).astype(np.int64)
        again = self.order[displaced[self.order]]
        child[again] = Bins(self.capacity, fill).best_fit(lengths[again].tolist())
        return child

    def evolve(self, population: list[np.ndarray], children: int) -> list[np.ndarray]:
        """Breeds; each child takes the place of the worst packing if it is better. Best first."""
        rated = sorted(((self.fitness(b), k, b) for k, b in enumerate(population)), key=lambda x: (-x[0], x[1]))
        for k in range(children):
            if self.perfect(rated[0][2]):
                break
            x, y = (min(self.rng.choice(len(rated), 2)) for _ in range(2))
            child = self.cross(rated[x][2], rated[y][2])
            worth = self.fitness(child)
            if worth > rated[-1][0] and all(worth != f or not np.array_equal(child, b) for f, _, b in rated):
                rated[-1] = (worth, len(population) + k, child)
                rated.sort(key=lambda r: (-r[0], r[1]))
        return [b for _, _, b in rated]


def _epoch(state: DataFrame, capacity: int, level: int, epoch: int, seed: int) -> DataFrame:
    """One epoch of every island: takes the migrant in, breeds, and names its elite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = {c: batch.column(c)[0].as_py() for c in batch.schema.names}
            lengths = np.frombuffer(row["lengths"], "<i4").astype(np.int64)
            rng = np.random.default_rng([seed, level, row["block"], row["island"], epoch])
            island = Island(lengths, capacity, rng)
            if row["population"]:
                population = list(np.frombuffer(row["population"], "<i4").reshape(-1, len(lengths)))
                population[-1] = np.frombuffer(row["migrant"], "<i4")
            else:
                population = [island.seed(0.0)] + [island.seed(0.02 * 2**k) for k in range(POPULATION - 1)]
            population = island.evolve(population, CHILDREN)
            best = population[0].astype("<i4")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["block"]], pa.int64()), pa.array([row["island"]], pa.int32()),
                    pa.array([row["lengths"]], pa.binary()), pa.array([np.stack(population).astype("<i4").tobytes()], pa.binary()),
                    pa.array([best.tobytes()], pa.binary()), pa.array([island.fitness(best)], pa.float64()),
                ],
                ["block", "island", "lengths", "population", "elite", "fitness"],
            )

    kinds = "block bigint, island int, lengths binary, population binary, elite binary, fitness double"
    return state.mapInArrow(run, kinds)


def _blocks(items: DataFrame, n_blocks: int, level: int) -> DataFrame:
    """``block, ids, lengths``: documents dealt by hash, packed as binaries of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows = batch.column("rows")[0].values
            ids, lengths = (rows.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([lengths.astype("<i4").tobytes()], pa.binary())],
                ["block", "ids", "lengths"],
            )

    dealt = items.select(F.pmod(F.xxhash64("id", F.lit(level)), F.lit(n_blocks)).alias("block"), F.struct("id", "length").alias("row"))
    grouped = dealt.groupBy("block").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return grouped.mapInArrow(run, "block bigint, ids binary, lengths binary")


def _placed(best: DataFrame, capacity: int, level: int, last: bool) -> DataFrame:
    """``id, length, sequence_id, offset, settled`` of every document of a level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            ids, lengths, bins = (
                np.frombuffer(batch.column(c)[0].as_py(), k) for c, k in (("ids", "<i8"), ("lengths", "<i4"), ("elite", "<i4"))
            )
            fill = np.bincount(bins, lengths).astype(np.int64)
            settled = np.ones(len(fill), bool)
            if not last:
                worst = np.argsort(fill, kind="stable")[: max(1, int(len(fill) * REOPENED))]
                settled[worst[fill[worst] < capacity]] = False
            order = np.lexsort((ids, bins))
            sorted_lengths = lengths[order].astype(np.int64)
            before = np.cumsum(sorted_lengths) - sorted_lengths
            starts = np.concatenate([[0], np.cumsum(fill)[:-1]])
            block = int(batch.column("block")[0].as_py())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[order]), pa.array(sorted_lengths),
                    pa.array((level << 56) + (block << 16) + bins[order].astype(np.int64)),
                    pa.array(before - starts[bins[order]]), pa.array(settled[bins[order]]),
                ],
                ["id", "length", "sequence_id", "offset", "settled"],
            )

    kinds = "id bigint, length bigint, sequence_id bigint, offset bigint, settled boolean"
    return best.select("block", "ids", "lengths", "elite").mapInArrow(run, kinds)


def pack_lengths(items: DataFrame, capacity: int = 1024, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """``id, sequence_id, offset`` for ``items(id, length)`` with unique ids and 0 < length <= capacity.

    Items are dealt by hash into blocks of some ``block`` items; on every block several islands
    evolve packings, and after each epoch each island's elite moves on to the next one. The
    worst-filled sixteenth of a block's bins is opened again and packed at the next level with
    that of the other blocks, until one block is left: what a block wastes does not add up. A
    level moves some 100 bytes an item; nothing but counts reaches the driver.
    """
    spark = items.sparkSession
    results: DataFrame | None = None
    level, now = 0, stored(items.select(F.col("id").cast("bigint"), F.col("length").cast("bigint")), "packing-items")
    while n := now.count():
        n_blocks = -(-n // block)
        blocks = stored(_blocks(now, n_blocks, level), "packing-blocks")
        islands = F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island")
        start = blocks.select("block", islands, "lengths").repartition("block", "island")
        state = stored(_epoch(start.withColumns({"population": F.lit(None).cast("binary"), "migrant": F.lit(None).cast("binary")}), capacity, level, 0, seed), "islands")
        for epoch in range(1, EPOCHS):
            migrants = state.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("elite").alias("migrant"))
            met = state.drop("elite", "fitness").join(migrants.hint("merge"), ["block", "island"])
            state = stored(_epoch(met, capacity, level, epoch, seed), "islands")
        best = state.groupBy("block").agg(F.max_by("elite", F.struct("fitness", -F.col("island"))).alias("elite"))
        placed = stored(_placed(blocks.join(best.hint("merge"), "block"), capacity, level, n_blocks == 1), "packed")
        done = placed.where("settled").select("id", "sequence_id", "offset")
        results = done if results is None else results.union(done)
        now, level = placed.where("not settled").select("id", "length"), level + 1
    return results if results is not None else spark.createDataFrame([], "id bigint, sequence_id bigint, offset bigint")


def pack(
    docs: DataFrame, path: str, pattern: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id",
    text_col: str = "text", keep_ids: bool = True,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset``: pieces and their places.

    Pieces as in :func:`pieces`. A full piece is a sequence of its own; the others, one of a
    document at most, are packed by :func:`pack_lengths`. Sequence ids are any numbers; places
    in a sequence are gapless from 0. An empty table gives an empty table.
    """
    cut = pieces(docs, path, pattern, capacity, end_id, id_col, text_col, keep_ids)
    cut = stored(cut.withColumn("id", F.monotonically_increasing_id()), "pieces")
    full = cut.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("id"), "offset": F.lit(0).cast("bigint")})
    partial = cut.where(F.col("length") < capacity)
    placed = pack_lengths(partial.select("id", "length"), capacity)
    return full.unionByName(partial.join(placed, "id")).drop("id")
