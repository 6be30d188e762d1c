import math
import random

import pytest
from pyspark.sql import functions as F

from pairforge.functions import overlap, sequences
from pairforge.functions import text as text_fns
from pairforge.functions.stemming import stem
from pairforge.operators import nbest, scoring

PAIRS = [("the cat sat on the mat", "the cat is on the mat"), ("a b c d", "a b c d"), ("x", "y z")]


@pytest.fixture(scope="module")
def pred(spark):
    return spark.createDataFrame(PAIRS, "hyp string, ref string")


def slow_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b, 1):
            row[j] = last[j - 1] + 1 if x == y else max(last[j], row[j - 1])
    return row[-1]


def test_bit_vector_distances():
    rng = random.Random(5)
    for _ in range(300):
        a = [rng.choice("abcd") for _ in range(rng.randrange(12))]
        b = [rng.choice("abcd") for _ in range(rng.randrange(12))]
        assert overlap.edit_distance(a, b) == slow_edits(a, b)
        assert overlap.common_subsequence(a, b) == slow_lcs(a, b)


def test_bleu_by_hand(pred):
    # n-gram matches and totals of the pairs: 5+4+0 of 6+4+1, 3+3 of 5+3, 1+2 of 4+2, 0+1 of 3+1
    m, t = [9, 6, 3, 1], [11, 8, 6, 4]
    score = 100 * math.exp(1 - 12 / 11) * math.exp(sum(math.log(a / b) for a, b in zip(m, t)) / 4)
    assert scoring.corpus_bleu(pred).first()["bleu"] == pytest.approx(score)


def test_perfect_scores(spark):
    same = spark.createDataFrame([("one two three four five", "one two three four five")], "hyp string, ref string")
    got = scoring.text_report(same).first().asDict()
    assert got["bleu"] == pytest.approx(100) and got["chrf"] == pytest.approx(100)
    for name in ("rouge1", "rouge2", "rougeL", "precision", "recall", "f1", "gleu"):
        assert got[name] == pytest.approx(1)
    assert got["cer"] == got["wer"] == got["ser"] == 0


def test_empty_hypothesis(spark):
    got = scoring.text_report(spark.createDataFrame([("", "a b")], "hyp string, ref string")).first().asDict()
    assert got["bleu"] == got["chrf"] == got["rougeL"] == got["gleu"] == 0
    assert got["cer"] == got["wer"] == got["ser"] == 1


def test_chrf_by_hand(spark):
    got = scoring.corpus_chrf(spark.createDataFrame([("ab", "abc")], "hyp string, ref string")).first()["chrf"]
    p, r = (1 + 1) / 2, (2 / 3 + 1 / 2) / 2
    assert got == pytest.approx(100 * 5 * p * r / (4 * p + r))


def test_error_rates(pred):
    got = scoring.error_rates(pred).first()
    words = [(a.split(), b.split()) for a, b in PAIRS]
    assert got["wer"] == pytest.approx(sum(slow_edits(a, b) for a, b in words) / 12)
    assert got["cer"] == pytest.approx(sum(slow_edits(a, b) for a, b in PAIRS) / sum(len(b) for _, b in PAIRS))
    assert got["ser"] == pytest.approx(2 / 3)


def test_long_pairs_use_the_same_distance(pred, monkeypatch):
    plain = scoring.error_rates(pred).first()
    monkeypatch.setattr(scoring, "LONG_CHARS", 3)
    monkeypatch.setattr(scoring, "LONG_WORDS", 1)
    assert scoring.error_rates(pred).first() == plain


def test_rouge(pred):
    got = [r["rougeL"] for r in scoring.sentence_rouge(pred).collect()]
    assert got == pytest.approx([5 / 6, 1.0, 0.0])


def test_blocks_are_not_an_lcs():
    assert overlap.matching_blocks(list("abxcd"), list("cdabx")) == 3
    assert overlap.common_subsequence(list("acbd"), list("abcd")) == 3


def test_block_agreement(pred):
    got = scoring.block_agreement(pred).first()
    assert (got["precision"], got["recall"]) == pytest.approx((9 / 11, 9 / 12))


def test_token_accuracy(spark):
    rows = spark.createDataFrame([([0, 5, 6], [0, 5, 7])], "hyp_ids array<int>, ref_ids array<int>")
    assert scoring.token_accuracy(rows).first()[0] == pytest.approx(1 / 2)
    assert scoring.token_accuracy(rows, count_start=True).first()[0] == pytest.approx(2 / 3)
    assert scoring.block_accuracy(rows).first()[0] == pytest.approx(2 / 3)
    assert scoring.block_accuracy(rows, double_count=True).first()[0] == pytest.approx(4 / 6)


def test_perplexity(spark):
    rows = spark.createDataFrame([([0.0, 0.0], 1), ([5.0, 1.0], 0)], "logits array<double>, target int")
    assert scoring.perplexity(rows, pad=0).first()["perplexity"] == pytest.approx(2.0)
    assert scoring.perplexity(rows.where("target = 0"), pad=0).first()["perplexity"] == math.inf


def test_trim_and_shift(spark):
    row = spark.createDataFrame([([0, 5, 2, 6, 1, 7],)], "ids array<int>")
    got = row.select(
        sequences.trim_ids(F.col("ids"), 2, 0, 1).alias("t"), sequences.shift_left(F.col("ids"), 1).alias("s")
    ).first()
    assert (got["t"], got["s"]) == ([5, 6], [5, 2, 6, 1, 7, 1])


def test_beam_step(spark):
    logits = [[0.0, 1.0, 2.0], [2.0, 1.0, 0.0]]
    states = spark.createDataFrame([(1, b, [0], 0.0, logits[b]) for b in (0, 1)], "ex_id int, beam int, ids array<int>, score double, logits array<double>")
    top = nbest.select_top(nbest.expand(states, 2), 2).orderBy("rank").collect()
    assert [(r["beam"], r["token"], r["flat"]) for r in top] == [(0, 2, 2), (1, 0, 3)]
    first = nbest.select_top(nbest.expand(states, 2, first_step=True), 2).orderBy("rank").collect()
    assert [r["token"] for r in first] == [2, 1]


def test_slices_are_sums_of_finest_slices(spark):
    rows = [("a b c d e", "a b c d f", "en", "w"), ("one two", "one two", "en", "v"), ("x y z", "x z y", None, "w"), ("running dogs", "run dog", "de", "w"), ("", "q", "de", "v")]
    ids = [([0, 1, 2], [0, 1, 3]), ([0, 5], [0, 5]), ([0, 1, 1], [0, 2, 1]), ([0], [0, 4]), ([0, 9, 9], [0, 9, 9])]
    pred = spark.createDataFrame([(*r, *i) for r, i in zip(rows, ids)], "hyp string, ref string, lang string, origin string, hyp_ids array<int>, ref_ids array<int>")
    tokens = spark.createDataFrame([("en", "w", [0.1, 2.0], 1), ("en", "v", [0.3, 0.2], 0), ("de", "w", [1.0, 0.0], 1)], "lang string, origin string, logits array<double>, target int")
    got = scoring.slice_scores(pred, ["lang", "origin"], scores=tokens, pad=9).collect()
    assert len(got) == 1 + 3 + 2 + 5
    whole = [r for r in got if r["level"] == 3][0].asDict()
    want = scoring.full_report(pred, tokens, pad=9).first().asDict()
    assert {k: whole[k] for k in want} == pytest.approx(want)
    by_lang = {r["lang"]: r.asDict() for r in got if r["level"] == 1}
    for row in scoring.text_report(pred, ["lang"]).collect():
        for name, value in row.asDict().items():
            assert by_lang[row["lang"]][name] == (value if isinstance(value, str) or value is None else pytest.approx(value))
    assert by_lang["de"]["perplexity"] == pytest.approx(scoring.perplexity(tokens.where("lang = 'de'"), 9).first()["perplexity"])
    assert by_lang[None]["perplexity"] == float("inf") and by_lang[None]["n_pairs"] == 1


def test_equal_sides_need_no_helper(spark):
    none = spark.range(1).select(F.lit(None).cast("array<string>").alias("a"))
    assert none.select(overlap.block_matches("a", "a").alias("n")).first()["n"] is None
    ids = spark.createDataFrame([([1, None, 2], [1, None, 2]), ([1, 2], [1, 3, 4]), ([], [])], "a array<int>, b array<int>")
    assert [r["n"] for r in ids.select(sequences.positional_hits(F.col("a"), F.col("b")).alias("n")).collect()] == [2, 1, 0]
    same = spark.createDataFrame([([1, 2], [1, 2]), ([1, 3], [1, 2])], "hyp_ids array<int>, ref_ids array<int>")
    assert scoring.block_accuracy(same).first()["token_accuracy"] == 0.75


@pytest.mark.parametrize("alphabet", ["ab ", "abcdefgh é日 .,-1&;", "".join(map(chr, range(200, 700))) + " " * 50])
@pytest.mark.parametrize("longest", [5, 80, 300])
def test_many_pairs_at_once_count_like_each_pair_alone(alphabet, longest):
    rng = random.Random(longest)
    text = lambda: "".join(rng.choices(alphabet, k=rng.randint(0, longest)))
    hyp = [text() for _ in range(200)]
    ref = ["".join(c if rng.random() > 0.1 else rng.choice(alphabet) for c in h) if k % 3 else text() for k, h in enumerate(hyp)]

    def alone(h, r):
        a, b = ([stem(w) if len(w) > 3 else w for w in overlap.rouge_words(t)] for t in (h, r))
        x, y = h.split(), r.split()
        return [
            *overlap.clipped(overlap.bleu_words(h), overlap.bleu_words(r), 4), *overlap.clipped("".join(x), "".join(y), 6), *overlap.clipped(x, y, 4),
            *overlap.clipped(a, b, 2), overlap.common_subsequence(a, b),
            overlap.edit_distance(h.strip(" "), r.strip(" ")), len(r.strip(" ")), overlap.edit_distance(x, y), len(y),
            sum(p == q for p, q in zip(x, y)), min(len(x), len(y)),
        ]

    parts = ["bleu", "chrf", "gram", "rouge", "edits", "agree"]
    for long in ((2_000, 1_000), (40, 8)):
        assert overlap.pair_counts(hyp, ref, parts, long).tolist() == [alone(h, r) for h, r in zip(hyp, ref)]
    assert overlap.pair_counts(hyp, [None] * len(hyp), parts).tolist() == [alone(h, h) for h in hyp]


def test_texts_are_cut_into_words_as_in_columns(spark):
    texts = ["a-\nb 3-4 x.y 1.5, &quot;q&amp;<skipped>\n", " K İ ÉA'b\u2028c\xa0d\x1ce", "e.g. (a) [b] {c}~`^_", "plain words", "", "日本。.,5"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(text_fns.bleu_tokens(F.col("t")), text_fns.rouge_tokens(F.col("t")), text_fns.split_words(F.col("t"))).collect()
    assert [tuple(r) for r in rows] == [(overlap.bleu_words(t), overlap.rouge_words(t), t.split()) for t in texts]
