"""Operator 6: toxicity by a linear classifier that identity terms cannot sway."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, slices, texts

#: Hash slots of features: bounds the model, 8 MB of weights, whatever the corpus.
SLOTS = 1 << 20
_REMEMBERED = 1 << 19
#: While a model is fitted, whose arrays need the memory.
_FIT_REMEMBERED = 1 << 17
#: Longer words, such as whole texts of unspaced scripts, are not remembered.
_LONGEST = 64
# Neutral names of groups, by language; a term is swapped for others of its row.
IDENTITIES = (
    "black white asian african european american latino arab indian chinese".split(),
    "christian muslim jewish hindu buddhist atheist catholic".split(),
    "gay straight lesbian bisexual transgender queer heterosexual".split(),
    "woman man women men girl boy female male".split(),
    "old young blind deaf disabled elderly".split(),
    "frau mann frauen männer mädchen junge".split(),
    "christlich muslimisch jüdisch christen muslime juden".split(),
    "schwarze weiße asiatische afrikanische europäische türkische".split(),
    "femme homme femmes hommes fille garçon".split(),
    "chrétien musulman juif chrétiens musulmans juifs".split(),
    "noir blanc asiatique africain européen arabe".split(),
    "mujer hombre mujeres hombres niña niño".split(),
    "cristiano musulmán judío cristianos musulmanes judíos".split(),
    "negro blanco asiático africano europeo árabe".split(),
)
_SWAPS = {w: [x for x in row if x != w] for row in IDENTITIES for w in row}
_EDGES = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


def word_set(text: str) -> set[str]:
    """Distinct words, lower case, without signs at their ends."""
    return {w.strip(_EDGES) for w in text.lower().split()} - {""}


def word_slots(word: str) -> list[int]:
    """Hash slots of a word: itself, and its runs of four and five characters with its ends marked."""
    marked = f"^{word}$"
    parts = dict.fromkeys([f"={word}", *(marked[i : i + n] for n in (4, 5) for i in range(len(marked) - n + 1))])
    return [crc32(p.encode("utf-8", "replace")) % SLOTS for p in parts]


def swapped(words: set[str]) -> set[str] | None:
    """The words with every identity term exchanged for the next of its row; None without such terms."""
    if not (held := words & _SWAPS.keys()):
        return None
    return (words - held) | {_SWAPS[w][crc32(w.encode()) % len(_SWAPS[w])] for w in held}


class Scorer:
    """Sums the weights of a text's distinct words; remembers the words it has met."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights, bias
        self.known: dict[str, float] = {}

    def word(self, word: str) -> float:
        got = self.known.get(word)
        if got is None:
            stripped = word.strip(_EDGES)
            got = float(self.weights[word_slots(stripped)].sum()) if stripped else 0.0
            if len(word) <= _LONGEST:
                if len(self.known) >= _REMEMBERED:
                    self.known.clear()
                self.known[word] = got
        return got

    def __call__(self, text: str) -> float:
        total = self.bias + sum(sorted(map(self.word, word_set(text))))
        return 1.0 / (1.0 + float(np.exp(-min(max(total, -60.0), 60.0))))


class _Slots:
    """Hash slots of words as small arrays; remembers the words it has met."""

    def __init__(self) -> None:
        self.known: dict[str, np.ndarray] = {}

    def __call__(self, words: set[str]) -> np.ndarray:
        out = [np.zeros(0, np.int32)]
        for word in sorted(words):
            got = self.known.get(word)
            if got is None:
                got = np.array(word_slots(word), np.int32)
                if len(word) <= _LONGEST:
                    if len(self.known) >= _FIT_REMEMBERED:
                        self.known.clear()
                    self.known[word] = got
            out.append(got)
        return np.concatenate(out)


def fit(
    docs: list[str],
    labels: np.ndarray,
    prior: float,
    min_docs: int = 3,
    chi: float = 8.0,
    ridge: float = 3e-4,
    counterfactual: float = 1.0,
    steps: int = 300,
) -> tuple[np.ndarray, np.ndarray, float]:
    """Slots, weights and bias of a logistic model of texts.

    Loss: mean log-loss + ridge + ``counterfactual`` times the mean squared change of the
    logit when a text's identity terms are swapped. Only slots in at least ``min_docs``
    texts whose counts differ between the classes (chi-squared) get a weight. The bias is
    set to ``prior``, the share of positives among all labelled rows.

    Texts stay texts: a first pass counts slots by class, text by text, and a second one
    keeps the columns that get a weight.
    """
    positive = labels.sum()
    negative = len(labels) - positive
    if not positive or not negative:
        return np.zeros(0, np.int64), np.zeros(0), float(np.log((positive + 0.5) / (negative + 0.5)))
    slots_of = _Slots()
    counts = np.zeros((2, SLOTS), np.int32)
    for text, label in zip(docs, labels.tolist()):
        counts[int(label), np.unique(slots_of(word_set(text)))] += 1
    a, b = counts[1].astype(float), counts[0].astype(float)
    c, d = positive - a, negative - b
    score = (a * d - b * c) ** 2 * len(labels) / np.maximum((a + b) * (c + d) * positive * negative, 1e-9)
    used = np.flatnonzero((a + b >= min_docs) & (score >= chi))
    index = np.full(SLOTS, -1, np.int32)
    index[used] = np.arange(len(used))

    def kept(slots: np.ndarray) -> np.ndarray:
        columns = index[slots]
        return columns[columns >= 0]

    def joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(parts), dtype=np.int32), list(map(len, parts))), np.concatenate([np.zeros(0, np.int32), *parts])

    columns, left, right = [], [], []
    for text in docs:
        words = word_set(text)
        columns.append(kept(slots_of(words)))
        if (other := swapped(words)) is not None:  # what both have cancels out
            left.append(kept(slots_of(words - other)))
            right.append(kept(slots_of(other - words)))
    pairs = len(left)
    (row, column), left, right = joined(columns), joined(left), joined(right)
    del columns
    weight, bias = np.zeros(len(used)), float(np.log(positive / negative))
    share = 0.5 / np.where(labels > 0, positive, negative)  # both classes count alike
    m1, m2 = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, steps + 1):
        z = bias + np.bincount(row, weight[column], len(docs))
        error = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - labels) * share
        gradient = np.bincount(column, error[row], len(used)) + ridge * weight
        if pairs:
            change = np.bincount(left[0], weight[left[1]], pairs) - np.bincount(right[0], weight[right[1]], pairs)
            change *= 2 * counterfactual / pairs
            gradient += np.bincount(left[1], change[left[0]], len(used)) - np.bincount(right[1], change[right[0]], len(used))
        full = np.append(gradient, error.sum())
        m1 = 0.9 * m1 + 0.1 * full
        m2 = 0.999 * m2 + 0.001 * full * full
        move = 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-12)
        weight -= move[:-1]
        bias -= move[-1]
    # trained as if half were positive
    return used, weight, bias + float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))


def fit_model(docs: DataFrame, labels: DataFrame, per_class: int = 4000, seed: str = "toxicity") -> tuple[np.ndarray, float]:
    """Weights by slot and bias, from at most ``per_class`` labelled rows of each class.

    ``docs`` has ``doc_id, text``, ``labels`` has ``doc_id, label`` (0 or 1). The rows are
    the least by a hash of their id, so reruns agree. The sample is fitted in one task,
    since its size is fixed by the parameter and not by the corpus; the shares of the
    classes are counted over all labels. Of an id with several texts the least is learnt.
    """
    counted = labels.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("positive")).first()
    prior = (counted["positive"] + 0.5) / (counted["n"] + 1)
    order = F.md5(F.concat(F.lit(seed), F.col("doc_id").cast("string")))
    one = [labels.where(F.col("label") == k).orderBy(order, "doc_id").limit(per_class) for k in (0, 1)]
    # at most 2 * per_class rows of two numbers
    met = docs.join(F.broadcast(one[0].union(one[1])), "doc_id").select("doc_id", "text", F.col("label").cast("int").alias("label"))
    # an id that stands on many rows is learnt from once
    sample = met.groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, str, int]] = []
        for batch in batches:
            rows.extend(zip(batch.column("doc_id").to_pylist(), texts(batch), batch.column("label").to_pylist()))
        rows.sort()
        slots, weights, bias = fit([r[1] for r in rows], np.array([r[2] for r in rows], float), prior)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(slots, -1), pa.int64()), pa.array(np.append(weights, bias), pa.float64())], ["slot", "weight"]
        )

    fitted = sample.repartition(1).mapInArrow(run, "slot bigint, weight double").toPandas()
    weights = np.zeros(SLOTS)
    held = fitted[fitted["slot"] >= 0]
    weights[held["slot"].to_numpy()] = held["weight"].to_numpy()
    return weights, float(fitted.loc[fitted["slot"] < 0, "weight"].sum())


def score(docs: DataFrame, weights: np.ndarray, bias: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every whole text.

    One row per input row, without a shuffle: repeated rows and repeated or null ids stay,
    null and empty texts score what the bias gives, extra columns are dropped.
    """
    shared = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in slices(batches):
            out = pa.array(list(map(scorer, texts(batch))), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), out], ["doc_id", "score"])

    rows = only(docs, doc_id=(id_col, "bigint"), text=(text_col, "string"))
    return rows.mapInArrow(run, "doc_id bigint, score double")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, per_class: int = 4000) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document of ``documents``.

    Rows whose ``crc32(doc_id)`` is divisible by ``folds`` are held out. The model learns
    from the labels of the others only, and sees nothing of a document but its text. A
    document labelled more than once counts as toxic if one label says so; null labels and
    labels of no document are left out. Without labels of both classes the score is the
    same for all. A null id is held out from nothing and never learnt from.
    """
    rows = only(docs, doc_id=("doc_id", "bigint"), text=("text", "string"))
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    known = only(labels, doc_id=("doc_id", "bigint"), label=("toxic", "int")).dropna()
    known = known.where(remainder != 0).groupBy("doc_id").agg(F.max((F.col("label") > 0).cast("int")).alias("label"))
    weights, bias = fit_model(rows, known, per_class)
    return score(rows, weights, bias).select(
        "doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
