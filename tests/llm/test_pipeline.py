"""The pipeline, stage by stage, against plain Python over the smallest table."""

import hashlib

import pytest
import tiktoken

import corpus_pipeline
from pairforge.llm import bpe, quality
from pairforge.llm.queries import PATTERN, RANKS
from pairforge.session import stored

from .test_operators import brute_groups, brute_spans


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Input and output of each stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        result = stored(stage(spark, docs, sf_dir), "test")
        out.append((docs, result))
        docs = result
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_stay_until_the_last_stage(stages):
    for docs, result in stages[:-1]:
        assert result.dtypes == docs.dtypes


def test_quality_rules(stages):
    docs, result = stages[0]
    fails = set()
    for r in docs.collect():
        words, chars, symbols, dup, repeats, lines, upper = quality.text_counts(r.text or "")
        if words < 50 or 100 * repeats > 50 * words or symbols > 0.1 * words or dup > 0.3 * lines or upper > 0.5 * chars:
            fails.add(r.doc_id)
    # no host of this table comes near the limit
    assert set(rows(result)) == set(rows(docs)) - fails


def test_one_document_of_each_group_stays(stages):
    docs, result = stages[1]
    groups = brute_groups([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
    assert sorted(rows(result)) == sorted({c for _, c in groups.values()})


def test_personal_data_is_gone(stages):
    docs, result = stages[2]
    before, after = rows(docs), rows(result)
    assert before.keys() == after.keys()
    for i, r in before.items():
        assert bool(brute_spans(r.text)) == (after[i].text != r.text)
        assert after[i].n_chars == len(after[i].text) and brute_spans(after[i].text) == ""


def test_mix_takes_one_and_a_half_times_the_words(stages):
    docs, result = stages[3]
    total = sum(len(r.text.split()) for r in docs.collect())
    assert abs(sum(len(r.text.split()) for r in result.collect()) - 1.5 * total) <= 20


def test_last_stage_equals_the_library(stages):
    docs, result = stages[4]
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    want = sorted((r.doc_id, len(library.encode_ordinary(r.text)), hashlib.sha256(r.text.encode()).hexdigest()) for r in docs.collect())
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in result.collect()) == want
