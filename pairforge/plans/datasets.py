"""Input tables and the data sets derived from them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import batching, bpe, corpus, encode, epochs, indexing, pairs, scans, trials, vocab
from ..session import scratch_path, shared_dir, spread, stored
from ..sources import committed
from ..sources import corpus as corpus_source
from ..sources import logs

DAY_ZERO = "2024-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def documents(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", *extra), "doc_id")


def sentence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.sentences(documents(spark, sf_dir))


def variant_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.variants(sentence_rows(spark, sf_dir))


def form_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.noisy_forms(sentence_rows(spark, sf_dir))


def pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.unique_forms(form_rows(spark, sf_dir))


def number(rows: DataFrame) -> DataFrame:
    """``source, target, ex_id``: pairs with their rank by first place; the text of equal sides is sorted and stored once."""
    lean = rows.withColumn("target", F.when(~F.col("is_identity"), F.col("target")))
    ranked = indexing.dense_index(lean, ["doc_id", "sent_pos", "variant"], "ex_id", ["source", "target"])
    return ranked.withColumn("target", F.coalesce("target", "source"))


def numbered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number(pair_rows(spark, sf_dir))


def stored_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The noisy forms written once, for plans that read them more than once."""
    return stored(form_rows(spark, sf_dir), "forms")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The no-correction system: the corrupted sentence stands as its own hypothesis."""
    return pair_rows(spark, sf_dir).select("doc_id", F.col("source").alias("hyp"), F.col("target").alias("ref"))


def labelled_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with the language and source of the document they first came from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("source").alias("origin"))
    return predictions(spark, sf_dir).join(docs, "doc_id")


def source_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.vocab_of(vocab.shown_forms(form_rows(spark, sf_dir)), "source")


def target_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.vocab_of(vocab.shown_originals(sentence_rows(spark, sf_dir)), "target")


def vocabs_of(forms: DataFrame) -> DataFrame:
    """Source and target vocabulary of stored noisy forms."""
    source = vocab.vocab_of(vocab.shown_forms(forms), "source")
    return source.unionByName(vocab.vocab_of(vocab.shown_originals(forms, "target"), "target"))


def both_vocabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabs_of(stored_forms(spark, sf_dir))


def marker_ids(words: DataFrame) -> dict[str, int]:
    """Ids of the markers of both sides: ``<side>:<marker>``; a handful of rows."""
    rows = vocab.marker_rows(words).collect()
    return {f"{r['side']}:{r['token']}": int(r["id"]) for r in rows}


def encoded_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, int]]:
    """Word-mode encoding of all pairs and the marker ids."""
    forms = stored_forms(spark, sf_dir)
    words = vocabs_of(forms)
    ids = marker_ids(words)
    markers = {"unk": ids["source:<unk>"], "eos": ids["source:<eos>"], "sos": ids["target:<sos>"]}
    return encode.encode_numbered(number(pairs.unique_forms(forms)), words, markers), ids


def kept_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.keep_equal_length(encoded_pairs(spark, sf_dir)[0])


def numbered_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ex_id, len, batch_no, slot`` of the kept pairs; only lengths are ranked."""
    return batching.number_lengths(stored(batching.in_buckets(kept_pairs(spark, sf_dir)).select("ex_id", "len"), "lengths"))


def batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept pairs with their batches; their ids meet the ranked places by ``ex_id``, which is unique."""
    kept = stored(kept_pairs(spark, sf_dir), "kept")
    numbered = batching.number_lengths(batching.in_buckets(kept).select("ex_id", "len"))
    return kept.join(batching.assign_batches(numbered, batching.batch_order(numbered)), "ex_id")


# --- markup ----------------------------------------------------------------------------


def wiki_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document wrapped in the markup an encyclopedia article carries."""
    docs = documents(spark, sf_dir, "lang", "source")
    raw = F.concat(
        F.lit("==About "), "source", F.lit("==\n'''"), "lang", F.lit("''' [[Image:map.png|thumb|left|220px|Map of "),
        "source", F.lit("]] &lt;ref name=a&gt;note&lt;/ref&gt; &amp;lt;div&amp;gt; {{Infobox|"), "lang",
        F.lit("}} [[Category:"), "source", F.lit("|*]] [["), "lang", F.lit(":Page]] [[Page|label]] [http://x.org/a "),
        "source", F.lit("] 5% of $3 R&amp;amp;D word--tail a -- b U.S. "), "text",
        F.lit(" {| table |} ''it'' &nbsp; &lt;references /&gt;"),
    )
    return docs.select("doc_id", raw.alias("raw"))


def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as dump articles; pages whose address names a fragment are redirects."""
    page = F.when(F.col("url").contains("#"), F.concat(F.lit("#REDIRECT [["), "url", F.lit("]]"))).otherwise(F.col("html"))
    return spread(table(spark, sf_dir, "pages"), "page_id").select(F.col("page_id").alias("doc_id"), page.alias("raw"))


def page_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same articles, written as a dump file and scanned back."""
    path = scratch_path(spark, "dump")
    corpus_source.write_dump(page_articles(spark, sf_dir), path)
    return corpus_source.read_dump(spark, path, unescape=True)


# --- subwords --------------------------------------------------------------------------


def subword_model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Merges and vocabulary of all sentences, trained once to the full size.

    Stored in the shared folder under everything that shapes it, the files of the corpus
    included, so that all queries of a corpus share one model.
    """
    key = {"model": "subwords", "size": bpe.VOCAB_SIZE, "files": committed.fingerprint(table(spark, sf_dir, "documents"))}

    def build() -> dict[str, DataFrame]:
        merges, words = bpe.train(bpe.word_counts(sentence_rows(spark, sf_dir)))
        return {"merges": merges, "vocab": words}

    found = committed.read_or_build(spark, os.path.join(shared_dir(spark), "models"), key, build)
    return found["merges"], found["vocab"]


# --- scores ----------------------------------------------------------------------------


def token_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ex_id, pos, logits, target``: vectors as next-token scores, labels as tokens."""
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 8).alias("ex_id"),
        (F.col("vec_id") % 8).cast("int").alias("pos"),
        F.col("embedding").cast("array<double>").alias("logits"),
        F.col("label").cast("int").alias("target"),
    )


def beam_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five live hypotheses per example; a beam's score falls with its place."""
    beam = (F.col("vec_id") % 5).cast("int")
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 5).alias("ex_id"),
        beam.alias("beam"),
        F.array(F.col("label").cast("int")).alias("ids"),
        (beam * F.lit(-0.125)).alias("score"),
        F.col("embedding").cast("array<double>").alias("logits"),
    )


# --- runs ------------------------------------------------------------------------------


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run_id, epoch, hour, ts, event_id, loss, correct, tokens``: users as runs, days as epochs."""
    events = spread(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value"), "event_id")
    return events.select(
        F.col("user_id").alias("run_id"),
        (F.datediff("ts", F.lit(DAY_ZERO).cast("date")) + 1).alias("epoch"),
        F.date_trunc("hour", "ts").alias("hour"),
        "ts",
        "event_id",
        F.col("value").alias("loss"),
        F.floor(F.col("value") % 100).alias("correct"),
        F.lit(100).cast("bigint").alias("tokens"),
    )


def epoch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run_id, epoch, chrf, loss``: the best value of a day stands for its chrF.

    Epochs are renumbered 1.. per run over the days the run was active.
    """
    days = telemetry(spark, sf_dir).groupBy("run_id", F.col("epoch").alias("day")).agg(
        F.max("loss").alias("chrf"), F.min("loss").alias("loss")
    )
    chunked = days.withColumn("_chunk", F.floor(F.col("day") / epochs.EPOCHS_PER_CHUNK))
    placed = scans.running(chunked, ["run_id"], "_chunk", ["day"], {"epoch": ("sum", F.lit(1), True)})
    return placed.select("run_id", F.col("epoch").cast("int").alias("epoch"), "chrf", "loss")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two log lines per epoch: the epoch line, then the validation line."""
    rows = epoch_rows(spark, sf_dir)
    text = lambda c: c.cast("decimal(12,2)").cast("string")
    value = text(F.col("chrf"))
    percent = F.concat(value, F.lit("%"))
    plain = {"BLEU": text(F.col("loss")), "CHR-F": value}
    fine = {n: value for n in ("ROUGE-1", "ROUGE-2", "ROUGE-L")}
    shares = {n: percent for n in ("Precision", "Recall", "F₀.₅", "F₁", "CER", "WER", "SER")}
    line = logs.validation_line({**plain, **fine, "Accuracy": percent, "PPL": value, **shares, "GLEU": value})
    both = F.array(
        F.struct((F.col("epoch") * 2).alias("line_no"), logs.epoch_line(F.col("epoch"), text(F.col("loss")), value).alias("value")),
        F.struct((F.col("epoch") * 2 + 1).alias("line_no"), line.alias("value")),
    )
    return rows.select("run_id", F.explode(both).alias("l")).select("run_id", "l.line_no", "l.value")


def shipped_logs(spark: SparkSession, sf_dir: str) -> str:
    """The log lines as tagged text files in the shared folder; returns their path."""
    path = scratch_path(spark, "logs")
    rows = log_lines(spark, sf_dir)
    rows.select(logs.tagged(F.col("run_id"), F.col("line_no"), F.col("value")).alias("value")).write.text(path)
    return path


def scanned_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.parse_tagged(spark.read.text(shipped_logs(spark, sf_dir)))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.validations(scanned_logs(spark, sf_dir))


def run_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sampled configuration per run."""
    runs = table(spark, sf_dir, "events").select(F.col("user_id").alias("trial_id")).distinct()
    return trials.sample_trials(runs).withColumnRenamed("trial_id", "run_id")
