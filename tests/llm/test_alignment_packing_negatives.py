"""Token alignment, packing and hard negatives against plain Python."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairforge.llm import alignment, negatives, packing
from pairforge.llm.queries import BYTE_LEVEL, PATTERN, PIECES
from pairforge.llm.vocabularies import byte_letters

ODD = [
    (1, "plain words, twice plain words"), (2, None), (3, ""), (None, "no id"), (5, "<|endoftext|> is text </s>"), (6, "ﬁne ① Ａ"),
    (7, "two  spaces\n\nand\ttabs "), (8, "▁ literal mark"), (9, "naïve 日本語 🙂 \u0000 é"), (10, " "),
    (11, "ab" * 20_000), (1, "plain words, twice plain words"), (12, "x " * 5_000), (13, "<0x41> <unk> ▁▁"),
]


def odd_rows(spark):
    rows = spark.createDataFrame(ODD, "doc_id bigint, text string")
    # extra columns with the names that the operators use inside
    return rows.withColumns({c: F.lit("x") for c in ("row", "id", "links", "piece", "length", "block")})


# --- alignment ---------------------------------------------------------------------------


def brute_alignment(rows):
    first, second = Tokenizer.from_file(BYTE_LEVEL), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    first.encode_special_tokens = True
    letters = byte_letters()

    def piece_bytes(i):
        piece = second.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()

    aligned, corpus = [], Counter()
    for doc_id, text in rows:
        ids_a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = second.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in first.id_to_token(i)) for i in ids_a]
        bytes_b = [piece_bytes(i) for i in ids_b]
        if not text or any(b"".join(x) != (" " + text).encode() for x in (bytes_a, bytes_b)):
            aligned.append((doc_id, [], [], [], []))
            continue
        ends = lambda words: np.cumsum([len(w) for w in words]).tolist()
        end_a, end_b = ends(bytes_a), ends(bytes_b)
        both = sorted(set(end_a) & set(end_b))
        links = [(a, b) for e in both for a, x in zip(ids_a, end_a) if x == e for b, y in zip(ids_b, end_b) if y == e] if len(text) < 3000 else [
            (ids_a[end_a.index(e)], ids_b[end_b.index(e)]) for e in both
        ]
        groups, low = [], 0
        for e in both:
            groups.append(",".join(str(i) for i, x in zip(ids_a, end_a) if low < x <= e) + "|" + ",".join(str(i) for i, x in zip(ids_b, end_b) if low < x <= e))
            low = e
        corpus.update(links)
        aligned.append((doc_id, ids_a, ids_b, groups, links))
    top = defaultdict(int)
    for (_, b), n in corpus.items():
        top[b] = max(top[b], n)
    return sorted(
        (
            -1 if doc_id is None else doc_id, len(a), len(b), len(groups), len(links),
            sum(corpus[x] == top[x[1]] for x in links), sum(corpus[x] for x in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "",
        )
        for doc_id, a, b, groups, links in aligned
    )


@pytest.mark.parametrize("hot_pairs", [alignment.HOT_PAIRS, 40, 0])
def test_alignment_equals_brute_force(spark, sf_dir, hot_pairs):
    rows = ODD + [(r["doc_id"], r["text"][:700]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect()]
    rows = [(i, t[:400] if t and len(t) > 10_000 else t) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("row", F.lit(1))
    got = alignment.alignment(docs, BYTE_LEVEL, PATTERN, PIECES, keep_groups=False, hot_pairs=hot_pairs).fillna({"doc_id": -1})
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
    assert sorted(map(tuple, got.select(*columns).collect())) == brute_alignment(rows)


def test_alignment_of_odd_and_long_texts(spark):
    got = alignment.alignment(odd_rows(spark), BYTE_LEVEL, PATTERN, PIECES)
    assert got.count() == len(ODD)
    long = got.where("doc_id = 11").first()
    a, b = (sum((x.split("|")[k].split(",") for x in long["groups"].split(";")), []) for k in (0, 1))
    tokens = Tokenizer.from_file(BYTE_LEVEL)
    assert a == [str(i) for i in tokens.encode(" " + ODD[10][1], add_special_tokens=False).ids]
    assert b == [str(i) for i in sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(ODD[10][1])]
    assert alignment.alignment(odd_rows(spark).limit(0), BYTE_LEVEL, PATTERN, PIECES).count() == 0


ascending = st.lists(st.integers(0, 60), unique=True, max_size=40).map(lambda x: np.array(sorted(x), np.int64))


@settings(max_examples=200, deadline=None)
@given(ascending, ascending, st.integers(1, 9))
def test_pieces_of_the_merge_path(a, b, step):
    i, j = alignment.diagonals(a, b, step)
    steps = np.diff(i + j)
    assert (steps[:-1] == step).all() and (np.diff(i) >= 0).all() and (np.diff(j) >= 0).all()
    x, y = alignment.shared_ends(a, b, step)
    both = np.intersect1d(a, b)
    assert a[x].tolist() == both.tolist() and b[y].tolist() == both.tolist()


# --- packing -----------------------------------------------------------------------------


def assert_packed(rows, capacity):
    places = defaultdict(list)
    for sequence, offset, length in rows:
        places[sequence].append((offset, length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_pieces_equal_the_library(spark):
    tokens = Tokenizer.from_file(BYTE_LEVEL)
    got = sorted(map(tuple, packing.pack(odd_rows(spark), BYTE_LEVEL, PATTERN, capacity=64).fillna({"doc_id": -1}).collect()))
    want = []
    for doc_id, text in ODD:
        ids = [*tokens.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids), 64), len(ids)]
        for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
            want.append((-1 if doc_id is None else doc_id, k, x, y - x, zlib.crc32(np.array(ids[x:y], "<u4").tobytes()), ids[x:y]))
    assert [r[:6] for r in got] == sorted(want)
    n = assert_packed([(r[6], r[7], r[3]) for r in got], 64)
    assert n <= -(-sum(r[3] for r in got) // 64) + 1
    assert packing.pack(odd_rows(spark).limit(0), BYTE_LEVEL, PATTERN).count() == 0


@pytest.mark.parametrize(("low", "high", "spare"), [(1, 1023, 1.01), (1, 200, 1.0), (150, 450, 1.025), (513, 700, 1.0)])
def test_blocks_and_levels(spark, low, high, spare):
    rng = np.random.default_rng(3)
    lengths = rng.integers(low, high + 1, 3000).tolist()
    items = spark.createDataFrame(list(enumerate(lengths)), "id bigint, length bigint")
    rows = [(r["sequence_id"], r["offset"], lengths[r["id"]]) for r in packing.pack_lengths(items, 1024, block=1000).collect()]
    assert len(rows) == 3000
    n = assert_packed(rows, 1024)
    least = max(-(-sum(lengths) // 1024), sum(x > 512 for x in lengths))
    assert n <= least * spare + 1
    again = packing.pack_lengths(items.repartition(5), 1024, block=1000)
    assert len({r["sequence_id"] for r in again.collect()}) == n


def test_crossing_keeps_every_document_once():
    rng = np.random.default_rng(1)
    lengths = rng.integers(150, 450, 400)
    island = packing.Island(lengths, 1024, rng)
    a, b = island.seed(0.3), island.seed(0.9)
    for _ in range(30):
        child = island.cross(a, b)
        fill = island.fills(child)
        assert len(child) == 400 and fill.max() <= 1024 and fill.min() > 0
        a, b = b, child
    seeds = [island.seed(0.5) for _ in range(4)]
    assert island.fitness(island.evolve(seeds, 40)[0]) > max(map(island.fitness, seeds))


# --- hard negatives ----------------------------------------------------------------------


def brute_negatives(rows):
    seen = {(i, lab, tuple(v)) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    whole = [(i, lab, [int(np.floor(256 * x)) for x in v]) for i, lab, v in seen]
    out = []
    for anchor in whole:
        if anchor[0] % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(anchor[2], r[2])), r[0], r[1]) for r in whole if r is not anchor]
        for minus, positive, _ in sorted(x for x in scored if x[2] == anchor[1])[:5]:
            inside = sorted(x for x in scored if x[2] != anchor[1] and 30 * -minus <= -100 * x[0] <= 90 * -minus)
            out += [(anchor[0], positive, k + 1, i, -minus, -s) for k, (s, i, _) in enumerate(inside[:10])]
    return sorted(out)


def vector_rows(n, dim, seed, clustered):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    rows = []
    for i in range(n):
        v = centres[rng.integers(6)] + 0.2 * rng.normal(size=dim) if clustered else rng.normal(size=dim)
        rows.append((int(i * 4), int(rng.integers(3)), [float(x) for x in np.round(v, 2)]))
    same = rows[7][2]
    rows += [(int(i), 1, same) for i in range(10_001, 10_040)]  # ties
    rows += [rows[3], rows[25], (rows[25][0], 2, rows[4][2])]  # repeated rows, another row of an anchor's id
    rows += [(None, 1, same), (11_000, None, same), (11_100, 1, None), (11_200, 1, [None] * dim), (11_300, 0, [float("nan")] * dim), (11_400, 0, [float("inf")] * dim), (11_500, 1, [0.0] * dim)]
    return rows


@pytest.mark.parametrize(("dim", "clustered"), [(16, True), (7, False), (1, False)])
def test_negatives_equal_brute_force(spark, monkeypatch, dim, clustered):
    monkeypatch.setattr(negatives, "ROWS", 32)
    rows = vector_rows(400, dim, dim, clustered)
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").withColumn("key", F.lit(1)).withColumn("bands", F.lit(2))
    got = negatives.hard_negatives(df, F.col("id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)
    assert negatives.hard_negatives(df.limit(0), F.col("id") % 100 == 0).count() == 0


def test_negatives_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 32)
    monkeypatch.setattr(negatives, "ANCHORS", 5)
    rows = vector_rows(500, 8, 2, True)
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    assert sorted(map(tuple, negatives.hard_negatives(df, F.col("id") % 100 == 0).collect())) == brute_negatives(rows)


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(4)
    for dim in (1, 4, 6, 64):
        a, b = rng.integers(-300, 300, (20, dim)), rng.integers(-300, 300, (30, dim)) + 50
        x, y = (negatives.Summary(*negatives.summaries(v), dim) for v in (a, b))
        exact = negatives.scores(a, b)
        for least, most in ((-1e9, 1e9), (np.median(exact), 1e9), (-1e9, np.median(exact))):
            left = x.possible(y, np.full(20, float(least)), np.full(20, float(most)), np.ones((20, 30), bool))
            assert left[(exact >= least) & (exact <= most)].all()
    # vectors that are flat within their segments are told apart without their components
    flat = np.repeat(rng.integers(-200, 200, (40, 16)), 4, axis=1)
    flat[20:] += 400
    s = negatives.Summary(*negatives.summaries(flat), 64)
    exact = negatives.scores(flat, flat)
    left = s.possible(s, np.sort(exact, axis=1)[:, -5].astype(float), np.full(40, np.inf), np.ones((40, 40), bool))
    assert left.mean() < 0.2
