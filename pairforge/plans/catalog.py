"""Every registered query: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning, noise, sequences
from ..functions import text as text_fns
from ..functions.rng import SEED, key_of
from ..operators import (
    batching, bpe, corpus, encode, epochs, nbest, pairs, scoring, splits, trials, vocab,
)
from ..session import scratch_path, stored
from ..sources import corpus as corpus_source
from ..sources import folders, growing, tables
from ..streaming import inflight, monitor
from ..streaming.runner import run_to_table
from . import datasets as D

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DECIMALS = 6


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame) -> DataFrame:
    """Doubles rounded, so that the order of additions does not show."""
    return df.select(*[
        F.round(F.col(f"`{name}`"), DECIMALS).alias(name) if kind == "double" else F.col(f"`{name}`")
        for name, kind in df.dtypes
    ])


def joined(ids: str | Column) -> Column:
    """An id array as space-separated text."""
    col = F.col(ids) if isinstance(ids, str) else ids
    return F.array_join(col.cast("array<string>"), " ")


# --- sources and cleaning --------------------------------------------------------------


@query
def dump_articles(spark, d):
    return D.page_dump(spark, d).select("doc_id", F.md5("raw").alias("raw_md5"), F.char_length("raw").alias("n_chars"))


@query
def clean_dump(spark, d):
    return corpus_source.clean_dump(D.page_dump(spark, d))


@query
def clean_wiki(spark, d):
    return corpus_source.clean_dump(D.wiki_articles(spark, d))


@query
def clean_wiki_spaced(spark, d):
    return corpus_source.clean_dump(D.wiki_articles(spark, d), newline="space")


@query
def markup_rule_effects(spark, d):
    """For every cleaning rule: articles it changed and characters left after it."""
    rows = D.wiki_articles(spark, d).select(F.col("raw").alias("t0"))
    for i, name in enumerate(cleaning.RULE_NAMES):
        rows = rows.withColumn(f"t{i + 1}", cleaning.apply_rule(F.col(f"t{i}"), name))
    effects = F.array(*[
        F.struct(
            F.lit(i + 1).alias("step"),
            F.lit(name).alias("rule"),
            (F.col(f"t{i}") != F.col(f"t{i + 1}")).cast("bigint").alias("changed"),
            F.char_length(f"t{i + 1}").cast("bigint").alias("left"),
        )
        for i, name in enumerate(cleaning.RULE_NAMES)
    ])
    return rows.select(F.explode(effects).alias("e")).groupBy("e.step", "e.rule").agg(
        F.sum("e.changed").alias("n_changed"), F.sum("e.left").alias("n_chars_left")
    )


@query
def utf16_corpus(spark, d):
    """Documents as records of a UTF-16 corpus, scanned by byte ranges."""
    path, mark = scratch_path(spark, "utf16"), "\x1e"
    lines = D.documents(spark, d).select(F.concat(F.col("doc_id").cast("string"), F.lit("\t"), F.replace("text", F.lit(mark), F.lit(" "))).alias("text"))
    corpus_source.write_utf16(lines, path, sep=mark)
    parts = F.split(F.col("text"), "\t", 2)
    read = corpus_source.read_utf16(spark, path, sep=mark).where("text <> ''")
    return read.select(parts[0].cast("bigint").alias("doc_id"), parts[1].alias("text")).select(
        "doc_id", F.md5("text").alias("text_md5"), F.char_length("text").alias("n_chars")
    )


# --- sentences and tokens --------------------------------------------------------------


@query
def sentences(spark, d):
    return D.sentence_rows(spark, d)


@query
def sentences_with_empty(spark, d):
    rows = corpus.sentences(D.documents(spark, d), keep_empty=True)
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("n_pieces"), F.count_if(F.col("sentence") == "").alias("n_empty")
    )


@query
def sentences_table(spark, d):
    path = scratch_path(spark, "sentences")
    tables.write_sentences(D.sentence_rows(spark, d), path)
    return corpus.length_profile(spark.read.parquet(path))


@query
def first_sentences(spark, d):
    return corpus.first_sentences(D.sentence_rows(spark, d), 20_000)


@query
def social_tokens(spark, d):
    rows = corpus.sentences(D.documents(spark, d), tokenizer="social")
    return vocab.frequencies(rows.select(F.explode(text_fns.words_of(F.col("sentence"))).alias("token")))


@query
def subword_word_counts(spark, d):
    return bpe.word_counts(D.sentence_rows(spark, d))


# --- noise and pairs -------------------------------------------------------------------


@query
def typo_variants(spark, d):
    return D.variant_rows(spark, d)


@query
def corrupt_vocabulary(spark, d):
    """Every distinct word corrupted once at a high rate."""
    words = vocab.target_tokens(D.sentence_rows(spark, d)).select("token").distinct()
    return words.select("token", noise.corrupt_word(F.col("token"), key_of(SEED, F.col("token")), 0.5).alias("typo"))


@query
def noise_profile(spark, d):
    return pairs.change_profile(D.variant_rows(spark, d))


@query
def typo_pairs(spark, d):
    return D.pair_rows(spark, d)


@query
def pairs_table(spark, d):
    """The pair table of all sentences, built once under its parameters, then read back."""
    root = scratch_path(spark, "pairs")
    key = (D.sentence_rows(spark, d).count(), pairs.TIMES, pairs.PROBABILITY, "word")
    build = lambda: D.pair_rows(spark, d)
    tables.read_or_build(spark, root, *key, build)
    again = tables.read_or_build(spark, root, *key, build)
    return again.groupBy("is_identity").agg(
        F.count("*").alias("n_pairs"), F.sum(F.char_length("source")).alias("source_chars")
    )


@query
def split_pairs(spark, d):
    return splits.split_pairs(D.pair_rows(spark, d)).select("source", "split")


@query
def split_sizes(spark, d):
    return splits.split_sizes(splits.split_pairs(D.pair_rows(spark, d)))


@query
def split_originals(spark, d):
    return splits.split_originals(D.pair_rows(spark, d)).select("source", "split")


@query
def leaked_targets(spark, d):
    return splits.leaked_targets(splits.split_pairs(D.pair_rows(spark, d)))


# --- vocabularies ----------------------------------------------------------------------


@query
def source_vocab(spark, d):
    return D.source_vocab(spark, d)


@query
def target_vocab(spark, d):
    return D.target_vocab(spark, d)


@query
def vocab_with_markers(spark, d):
    """Both sides with their markers, stored by side and read back."""
    path = scratch_path(spark, "vocab")
    source = vocab.with_markers(D.source_vocab(spark, d), vocab.SOURCE_MARKERS)
    target = vocab.with_markers(D.target_vocab(spark, d), vocab.TARGET_MARKERS)
    tables.write_vocab(source.unionByName(target), path)
    sides = [tables.read_vocab(spark, path, side) for side in ("source", "target")]
    return sides[0].unionByName(sides[1]).select("side", "token", "id")


@query
def vocab_sizes(spark, d):
    return vocab.sizes(D.both_vocabs(spark, d))


@query
def token_frequencies(spark, d):
    return vocab.frequencies(vocab.target_tokens(D.sentence_rows(spark, d)))


@query
def oov_rate(spark, d):
    """Tokens of the held-out texts against the target vocabulary."""
    held = corpus.sentences(D.table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"))
    return rounded(vocab.coverage(vocab.target_tokens(held), D.target_vocab(spark, d)))


@query
def subword_merges(spark, d):
    """The merges of a vocabulary of 40,000, or of all pairs of a smaller corpus."""
    return D.subword_model(spark, d)[0]


@query
def subword_vocab(spark, d):
    return D.subword_model(spark, d)[1]


@query
def subword_segments(spark, d):
    """Every distinct word cut into pieces by the learned merges."""
    counts = stored(bpe.word_counts(D.sentence_rows(spark, d)), "words")
    merges, _ = D.subword_model(spark, d)
    return bpe.word_pieces(counts, bpe.merge_list(merges)).select("word", F.array_join("pieces", " ").alias("pieces"))


def _conversation_lines(spark, d):
    rows = D.table(spark, d, "conversations")
    return rows.select(key_of(F.col("conv_id"), F.col("turn")).alias("ex_id"), "text")


@query
def subword_encoded(spark, d):
    """Conversation turns as subword ids; characters outside the alphabet are dropped."""
    merges, words = D.subword_model(spark, d)
    ids = bpe.encode(_conversation_lines(spark, d), bpe.merge_list(merges), words)
    return ids.select("ex_id", joined("ids").alias("ids"))


@query
def subword_decoded(spark, d):
    merges, words = D.subword_model(spark, d)
    ids = bpe.encode(_conversation_lines(spark, d), bpe.merge_list(merges), words)
    return bpe.decode(ids, "ids", words)


@query
def subword_renoised(spark, d):
    """Subword ids decoded, corrupted and encoded again, with markers."""
    merges, words = D.subword_model(spark, d)
    pieces = bpe.merge_list(merges)
    ids = bpe.encode(_conversation_lines(spark, d), pieces, words)
    text = encode.renoise(bpe.decode(ids, "ids", words), epoch=1)
    again = bpe.encode(text, pieces, words)
    marked = again.select(
        "ex_id",
        F.concat("ids", F.array(F.lit(1))).alias("source_ids"),
        F.concat(F.array(F.lit(0)), F.col("ids")).alias("target_ids"),
    )
    return marked.select("ex_id", F.size("source_ids").alias("n_ids"), joined("source_ids").alias("ids"))


@query
def subword_noisy_batches(spark, d):
    """Conversations as batches of turns: sources and targets with noise of their own, padded to the batch's longest."""
    merges, words = D.subword_model(spark, d)
    pieces = bpe.merge_list(merges)
    ids = stored(bpe.encode(_conversation_lines(spark, d), pieces, words), "ids")
    both = ids.select("ex_id", F.col("ids").alias("source_ids"), F.col("ids").alias("target_ids"))
    noisy = bpe.noisy_again(both, pieces, words, epoch=1, corrupt_target=True)
    place = lambda k: F.element_at(F.split("ex_id", r"\|"), k)
    keyed = noisy.select(place(1).cast("bigint").alias("batch_id"), place(2).cast("int").alias("slot"), "source_ids", "target_ids")
    padded = batching.pad_batches(keyed, pad_source=2, pad_target=2)
    return padded.select("batch_id", "slot", joined("source_ids").alias("source_ids"), joined("target_ids").alias("target_ids"))


@query
def subword_pairs(spark, d):
    """Pairs in subword ids, both sides short enough to train on."""
    merges, words = D.subword_model(spark, d)
    pieces, rows = bpe.merge_list(merges), stored(D.numbered_pairs(spark, d), "pairs")
    side = lambda c: bpe.encode(rows.select("ex_id", F.col(c).alias("text")), pieces, words, numbered=True).withColumnRenamed("ids", f"{c}_ids")
    short = encode.keep_short(side("source").join(side("target"), "ex_id"))
    return short.select("ex_id", joined("source_ids").alias("source_ids"), joined("target_ids").alias("target_ids"))


# --- encoding and batching -------------------------------------------------------------


@query
def encoded_pairs(spark, d):
    return D.kept_pairs(spark, d).select("ex_id", joined("source_ids").alias("source_ids"), joined("target_ids").alias("target_ids"))


@query
def missing_tokens(spark, d):
    """Source tokens of all pairs against the target vocabulary alone."""
    words = D.target_vocab(spark, d).withColumn("side", F.explode(F.array(F.lit("source"), F.lit("target"))))
    return encode.missing_tokens(D.numbered_pairs(spark, d), words)


@query
def dropped_pairs(spark, d):
    """Held-out sentences encoded against the corpus vocabulary: kept and dropped."""
    held = corpus.sentences(D.table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"))
    lines = held.select(
        key_of(F.col("doc_id"), F.col("sent_pos")).alias("ex_id"),
        F.col("sentence").alias("source"),
        F.col("sentence").alias("target"),
    )
    words = stored(D.both_vocabs(spark, d), "vocab")
    ids = D.marker_ids(words)
    markers = {"unk": ids["source:<unk>"], "eos": ids["source:<eos>"], "sos": ids["target:<sos>"]}
    return encode.encode_pairs(lines, words, markers).select("ex_id", joined("source_ids").alias("source_ids"))


@query
def length_buckets(spark, d):
    return rounded(batching.padding_report(D.kept_pairs(spark, d)))


@query
def batch_slots(spark, d):
    return D.numbered_batches(spark, d).select("ex_id", "len", "batch_no", "slot")


@query
def batch_order(spark, d):
    return batching.batch_order(D.numbered_batches(spark, d))


@query
def padded_batches(spark, d):
    padded = batching.pad_batches(D.batched(spark, d), pad_source=-1, pad_target=-1)
    return padded.select("batch_id", "slot", "ex_id", joined("source_ids").alias("source_ids"))


@query
def subword_padded_batches(spark, d):
    """Mixed-length batches: conversation turns in id order, padded to the batch maximum."""
    merges, words = D.subword_model(spark, d)
    ids = bpe.encode(_conversation_lines(spark, d), bpe.merge_list(merges), words)
    keyed = ids.select(
        F.element_at(F.split("ex_id", r"\|"), 1).cast("bigint").alias("batch_id"),
        F.element_at(F.split("ex_id", r"\|"), 2).cast("int").alias("slot"),
        F.col("ids").alias("source_ids"),
        F.col("ids").alias("target_ids"),
    )
    padded = batching.pad_batches(keyed, pad_source=2, pad_target=2)
    return padded.select("batch_id", "slot", joined("source_ids").alias("source_ids"))


@query
def collated_batches(spark, d):
    rows = batching.collate(batching.pad_batches(D.batched(spark, d), -1, -1))
    return rows.select(
        "batch_id", F.size("ex_ids").alias("n_rows"), joined("ex_ids").alias("ex_ids"), joined(F.flatten("target")).alias("target")
    )


@query
def decoded_sources(spark, d):
    """Encoded sources back to words; ids outside the vocabulary read <UNK>."""
    encoded, _ = D.encoded_pairs(spark, d)
    ids = stored(encoded.select("ex_id", "source_ids"), "ids")
    return encode.decode_numbered(ids, "source_ids", D.source_vocab(spark, d).drop("side"))


@query
def renoised_sources(spark, d):
    """On-the-fly noise on decoded sources of all pairs."""
    rows = D.numbered_pairs(spark, d).select("ex_id", F.col("source").alias("text"))
    return encode.renoise(rows, epoch=1)


@query
def reencoded_sources(spark, d):
    rows = D.numbered_pairs(spark, d).select("ex_id", F.col("source").alias("text"))
    words = D.source_vocab(spark, d)
    unk = D.marker_ids(words)["source:<unk>"]
    noisy = stored(encode.renoise(rows, epoch=1), "noisy")
    return encode.encode_numbered_text(noisy, words, unk).select("ex_id", joined("ids").alias("ids"))


@query
def shifted_targets(spark, d):
    encoded, ids = D.encoded_pairs(spark, d)
    return encoded.select("ex_id", joined(sequences.shift_left(F.col("target_ids"), ids["target:<eos>"])).alias("target_ids"))


@query
def trimmed_targets(spark, d):
    """Padded targets cut at the first end marker, other markers dropped."""
    encoded, ids = D.encoded_pairs(spark, d)
    sos, eos, pad = (ids[f"target:{m}"] for m in ("<sos>", "<eos>", "<pad>"))
    padded = F.concat("target_ids", F.array(F.lit(eos), F.lit(pad), F.lit(pad)))
    return encoded.select("ex_id", joined(sequences.trim_ids(padded, pad, sos, eos)).alias("target_ids"))


# --- scores ----------------------------------------------------------------------------


@query
def corpus_bleu(spark, d):
    return rounded(scoring.corpus_bleu(D.predictions(spark, d)))


@query
def corpus_chrf(spark, d):
    return rounded(scoring.corpus_chrf(D.predictions(spark, d)))


@query
def corpus_gleu(spark, d):
    return rounded(scoring.corpus_gleu(D.predictions(spark, d)))


@query
def last_batch_gleu(spark, d):
    return rounded(scoring.corpus_gleu(D.predictions(spark, d).withColumnRenamed("doc_id", "batch_id"), last_batch_only=True))


@query
def corpus_rouge(spark, d):
    return rounded(scoring.corpus_rouge(D.predictions(spark, d)))


@query
def corpus_rouge_unstemmed(spark, d):
    return rounded(scoring.corpus_rouge(D.predictions(spark, d), stemmed=False).drop("rougeL"))


@query
def error_rates(spark, d):
    return rounded(scoring.error_rates(D.predictions(spark, d)))


@query
def prefix_agreement(spark, d):
    return rounded(scoring.prefix_agreement(D.predictions(spark, d)))


def _id_predictions(spark, d, texts=True):
    """Both sides of every pair, as text (if wanted) and as source-vocabulary ids behind a start marker."""
    forms = D.stored_forms(spark, d)
    numbered = D.number(pairs.unique_forms(forms))
    words = vocab.vocab_of(vocab.shown_forms(forms), "source")
    both = words.unionByName(words.withColumn("side", F.lit("target")))
    sos = D.marker_ids(words)["source:<sos>"]
    encoded = encode.encode_numbered(numbered, both, {"unk": -1, "eos": -2, "sos": sos}, texts=texts)
    return encoded.select(
        "ex_id",
        *([F.col("source").alias("hyp"), F.col("target").alias("ref")] if texts else []),
        F.concat(F.array(F.lit(sos)), sequences.cut_at(F.col("source_ids"), -2)).alias("hyp_ids"),
        F.col("target_ids").alias("ref_ids"),
    )


@query
def token_accuracy(spark, d):
    pred = stored(_id_predictions(spark, d, texts=False), "ids")
    plain = scoring.token_accuracy(pred)
    counted = scoring.token_accuracy(pred, count_start=True).withColumnRenamed("token_accuracy", "with_start")
    return rounded(plain.withColumn("k", F.lit(1)).join(counted.withColumn("k", F.lit(1)), "k").drop("k"))


@query
def block_accuracy(spark, d):
    return rounded(scoring.block_accuracy(_id_predictions(spark, d, texts=False)))


@query
def block_accuracy_double(spark, d):
    return rounded(scoring.block_accuracy(_id_predictions(spark, d, texts=False), double_count=True))


@query
def block_agreement(spark, d):
    return rounded(scoring.block_agreement(D.predictions(spark, d)))


@query
def perplexity(spark, d):
    return rounded(scoring.perplexity(D.token_scores(spark, d), pad=0))


@query
def token_nll(spark, d):
    return rounded(scoring.with_nll(D.token_scores(spark, d), pad=0).select("ex_id", "pos", "nll"))


@query
def score_report(spark, d):
    """The fifteen values of one evaluation."""
    return rounded(_report(spark, d))


def _report(spark, d):
    pred = stored(_id_predictions(spark, d), "report")
    return scoring.full_report(pred, D.token_scores(spark, d), pad=0)


@query
def report_by_language(spark, d):
    return rounded(scoring.text_report(D.labelled_predictions(spark, d), by=["lang"]))


@query
def slice_report(spark, d):
    return rounded(scoring.slice_report(D.labelled_predictions(spark, d), ["lang", "origin"]))


@query
def slice_scores(spark, d):
    """Every text score of every language, origin, pair of them, and of all."""
    return rounded(scoring.slice_scores(D.labelled_predictions(spark, d), ["lang", "origin"]))


# --- hypotheses ------------------------------------------------------------------------


@query
def beam_log_probs(spark, d):
    rows = nbest.log_probabilities(D.beam_states(spark, d))
    return rounded(rows.select("ex_id", "beam", F.posexplode("logprobs").alias("token", "logprob")))


@query
def beam_candidates(spark, d):
    return rounded(nbest.expand(D.beam_states(spark, d), width=5).drop("ids"))


@query
def beam_top(spark, d):
    top = nbest.select_top(nbest.expand(D.beam_states(spark, d), 5), 5)
    return rounded(top.select("ex_id", "rank", "score", *nbest.recover("flat", 64)))


@query
def beam_first_step(spark, d):
    top = nbest.select_top(nbest.expand(D.beam_states(spark, d), 5, first_step=True), 5)
    return rounded(top.select("ex_id", "rank", "token", "score"))


@query
def beam_best(spark, d):
    top = nbest.select_top(nbest.expand(D.beam_states(spark, d), 5), 5)
    return rounded(nbest.best_hypotheses(top, eos=1).select("ex_id", joined("ids").alias("ids"), "norm_score"))


@query
def greedy_accuracy(spark, d):
    return rounded(nbest.greedy_accuracy(D.token_scores(spark, d), by=["pos"]))


# --- training runs ---------------------------------------------------------------------


@query
def epoch_summary(spark, d):
    return rounded(epochs.epoch_summary(D.telemetry(spark, d)))


@query
def running_loss(spark, d):
    rows = epochs.running_loss(D.telemetry(spark, d), "hour", ["ts", "event_id"])
    return rounded(rows.select("run_id", "epoch", "event_id", "running_loss"))


@query
def global_steps(spark, d):
    rows = epochs.global_steps(D.telemetry(spark, d), "hour", ["ts", "event_id"])
    return rows.select("run_id", "event_id", "global_step")


@query
def metric_log(spark, d):
    """Scalars appended to the metric table, then one column per tag."""
    path = scratch_path(spark, "scalars")
    steps = epochs.global_steps(D.telemetry(spark, d), "hour", ["ts", "event_id"])
    tables.append_scalars_once(epochs.scalar_rows(steps), 0, path)
    wide = tables.wide_scalars(tables.read_scalars(spark, path), ["Accuracy/train", "Loss/train"])
    return rounded(wide.select("run_id", "step", F.col("Accuracy/train").alias("accuracy"), F.col("Loss/train").alias("loss")))


@query
def best_so_far(spark, d):
    return epochs.best_so_far(D.epoch_rows(spark, d)).select("run_id", "epoch", "chrf", "prev_best", "improved")


@query
def plateau(spark, d):
    rows = epochs.plateau(D.epoch_rows(spark, d))
    return rounded(rows.select("run_id", "epoch", "chrf", "improved", "no_improve", "reduced", "lr", "fine_tuning", "executed"))


@query
def checkpoints(spark, d):
    kept = epochs.checkpoints(epochs.plateau(D.epoch_rows(spark, d)))
    return kept.where(F.col("is_best") | F.col("is_last")).select("run_id", "epoch", "chrf", "is_best", "is_last")


@query
def resume_state(spark, d):
    rows = epochs.resume_state(epochs.plateau(D.epoch_rows(spark, d)))
    return rounded(rows.select("run_id", "epoch", "chrf", "no_improve", "lr", "fine_tuning"))


# --- trials ----------------------------------------------------------------------------


@query
def sampled_trials(spark, d):
    return rounded(D.run_configs(spark, d))


@query
def log_lines(spark, d):
    return D.scanned_logs(spark, d).select("run_id", "line_no", "value")


@query
def validation_reports(spark, d):
    return D.reports(spark, d)


@query
def validation_values(spark, d):
    lines = D.scanned_logs(spark, d).where(trials.is_validation(F.col("value")))
    return rounded(lines.select("run_id", "line_no", F.explode(trials.all_values(F.col("value"))).alias("name", "score")))


@query
def reports_until_stop(spark, d):
    return trials.until_stop(D.reports(spark, d))


@query
def best_per_trial(spark, d):
    return trials.best_per_trial(D.reports(spark, d))


@query
def median_pruning(spark, d):
    rows = D.reports(spark, d).select(F.col("run_id").alias("trial_id"), F.col("epoch").alias("step"), F.col("chrf").alias("value"))
    return rounded(trials.median_pruning(rows))


@query
def top_trials(spark, d):
    return trials.top_trials(trials.best_per_trial(D.reports(spark, d)))


@query
def results_document(spark, d):
    results, configs = _board(spark, d)
    return trials.results_document(trials.top_trials(results).join(configs.drop("config"), "run_id", "left"))


def _board(spark, d):
    path = scratch_path(spark, "configs")
    D.run_configs(spark, d).drop("embedding_dim").write.json(path)
    return trials.best_per_trial(D.reports(spark, d)), tables.read_configs(spark, path)


@query
def leaderboard(spark, d):
    return rounded(trials.leaderboard(*_board(spark, d)).select("rank", "run_id", "best_chrf", "learning_rate", "hidden_dim"))


def _run_folders(spark, d):
    """A folder a run with its score and configuration; every seventh or so lacks one or holds a broken one."""
    results, configs = trials.best_per_trial(D.reports(spark, d)), D.run_configs(spark, d)
    rows = results.join(configs, "run_id")
    run = F.col("run_id")
    names = ("learning_rate", "p_dropout", "hidden_dim", "batchSize")
    yaml = F.concat(F.lit("# configuration\n"), *[F.concat(F.lit(f"{n}: "), F.col(n).cast("string"), F.lit("\n")) for n in names])
    yaml = F.when(run % 13 == 0, F.lit("learning_rate 0.1\n  - what")).otherwise(yaml)
    score = F.to_json(F.struct(F.col("best_chrf").alias(tables.SCORE_KEY), F.lit("checkpoint").alias("kind")), {"pretty": "true"})
    score = F.when(run % 11 == 0, F.lit("{broken")).otherwise(score)
    both = F.array(
        F.when(run % 7 != 0, F.struct(F.lit("config.yaml").alias("file"), yaml.alias("value"))),
        F.when(run % 5 != 0, F.struct(F.lit(tables.SCORE_FILE).alias("file"), score.alias("value"))),
    )
    path = scratch_path(spark, "runs")
    files = rows.select(run.alias("run"), F.explode(F.filter(both, lambda x: x.isNotNull())).alias("f"))
    folders.write_lines(files.select(F.concat(F.lit("run="), F.col("run").cast("string"), F.lit("/"), "f.file").alias("path"), "f.value"), path)
    return tables.read_run_folders(spark, path)


def _run_number():
    return F.regexp_extract("run", r"(\d+)$", 1).cast("bigint").alias("run_id")


@query
def folder_leaderboard(spark, d):
    """Rank of every run whose folder holds a score and a configuration."""
    runs, _ = _run_folders(spark, d)
    runs = stored(runs.select(_run_number(), "best_chrf", "config"), "runs")
    board = trials.leaderboard(runs.select("run_id", "best_chrf"), runs.select("run_id", "config"))
    numbers = [F.col("config")[n].cast("double").alias(n) for n in ("learning_rate", "hidden_dim")]
    return rounded(board.select("rank", "run_id", "best_chrf", *numbers))


@query
def bad_run_folders(spark, d):
    _, bad = _run_folders(spark, d)
    return bad.select(_run_number(), "problem")


@query
def leaderboard_top5(spark, d):
    return trials.leaderboard(*_board(spark, d), limit=5).select("rank", "run_id", "best_chrf", "batchSize")


@query
def parameter_effect(spark, d):
    results, configs = _board(spark, d)
    return rounded(trials.parameter_effect(results.join(configs, "run_id"), "hidden_dim", 700, 951))


# --- streams ---------------------------------------------------------------------------


def _document_stream(spark, d):
    schema = D.table(spark, d, "documents").schema
    return spark.readStream.schema(schema).parquet(os.path.join(d, "documents*.parquet"))


@query
def stream_monitor(spark, d):
    from ..sources.logs import parse_tagged

    lines = parse_tagged(spark.readStream.text(D.shipped_logs(spark, d)))
    return rounded(run_to_table(monitor.ordered_monitor(lines, first_line=2), "monitor"))


@query
def growing_log_lines(spark, d):
    """Training logs, a folder a run, followed while they grow: the first runs of the stream meet half of the files."""
    lines, path, keep = stored(D.log_lines(spark, d), "lines"), scratch_path(spark, "logs"), scratch_path(spark, "growing")
    for half in (0, 1):
        part = lines.where(F.floor(F.col("line_no") / 2) % 2 == half)
        run = F.coalesce(F.col("run_id").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
        folders.write_lines(part.select(F.concat(F.lit("run="), run, F.lit(f"/part-{half}.txt")).alias("path"), "line_no", "value"), path, ["line_no"])
        table = run_to_table(growing.growing_logs(spark, path, by_folder=True), "growing", keep=keep)
    return table.select(F.regexp_extract("run_id", r"(\d+)$", 1).cast("bigint").alias("run_id"), "value")


@query
def stream_variants(spark, d):
    return run_to_table(inflight.corrupt(_document_stream(spark, d)), "variants")


@query
def stream_clean(spark, d):
    return run_to_table(inflight.clean(_document_stream(spark, d)), "clean")


@query
def stream_encoded(spark, d):
    words = stored(D.source_vocab(spark, d), "vocab")
    ids = D.marker_ids(words)
    tokens = inflight.encode_tokens(_document_stream(spark, d), words.drop("side"), ids["source:<unk>"])
    table = run_to_table(tokens, "tokens")
    return inflight.gather(table, ids["source:<eos>"]).select("doc_id", "sent_pos", joined("ids").alias("ids"))
