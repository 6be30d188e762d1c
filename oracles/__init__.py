"""Check SQL: for each query the same result in DuckDB over the given tables."""

from __future__ import annotations

from pairforge.functions import text as T
from pairforge.functions.cleaning import MARKUP_RULES
from pairforge.functions.rng import SEED
from pairforge.operators.trials import SEARCH_SPACE, VALUE_NAMES

from .parts import P, WS, cleaned, corrupt_sentence, corrupt_word, lit, pieces_of, squeezed, tokens_of, u, with_tables, words
from .scores import (
    agreement_sql, beam_sql, bleu_sql, chrf_sql, edits_sql, gleu_sql, nll_sql, rouge_sql,
)
from .subwords import word_counts_sql

ORACLES: dict[str, str] = {}


def add(name: str, final: str, *tables: str, **extra: str) -> None:
    ORACLES[name] = with_tables(final, *tables, extra=extra)


# --- sources and cleaning ---
add("dump_articles", "SELECT doc_id, md5(raw) AS raw_md5, length(raw) AS n_chars FROM articles", "articles")
add("clean_dump", f"SELECT * FROM (SELECT doc_id, {cleaned('raw')} AS text FROM articles) WHERE text <> ''", "articles")
add("clean_wiki", f"SELECT * FROM (SELECT doc_id, {cleaned('raw')} AS text FROM wiki) WHERE text <> ''", "wiki")
add(
    "clean_wiki_spaced",
    f"SELECT * FROM (SELECT doc_id, {cleaned('raw', spaced=True)} AS text FROM wiki) WHERE text <> ''",
    "wiki",
)
_steps = {"t0": "SELECT doc_id, raw AS v FROM wiki"}
for _i, (_name, _pattern, _replacement) in enumerate(MARKUP_RULES):
    _r = lit(_replacement.replace("$1", "\\1"))
    _steps[f"t{_i + 1}"] = f"SELECT doc_id, regexp_replace(v, {lit(_pattern)}, {_r}, 'g') AS v FROM t{_i}"
add(
    "markup_rule_effects",
    " UNION ALL ".join(
        f"SELECT {i + 1} AS step, {lit(name)} AS rule, count(*) FILTER (a.v <> b.v) AS n_changed, "
        f"sum(length(b.v))::BIGINT AS n_chars_left FROM t{i} a JOIN t{i + 1} b USING (doc_id)"
        for i, (name, _, _) in enumerate(MARKUP_RULES)
    ),
    "wiki",
    **_steps,
)
add(
    "utf16_corpus",
    "SELECT doc_id, md5(text) AS text_md5, length(text) AS n_chars FROM (SELECT doc_id, replace(text, chr(30), ' ') AS text FROM documents)",
)

# --- sentences and tokens ---
add("sentences", "SELECT * FROM sentences", "sentences")
add(
    "sentences_with_empty",
    f"SELECT doc_id, count(*) AS n_pieces, count(*) FILTER ({squeezed('piece')} = '') AS n_empty "
    f"FROM ({pieces_of('documents', 'doc_id')}) GROUP BY doc_id",
)
add(
    "sentences_table",
    f"SELECT len({words('sentence')}) AS n_words, count(*) AS n_sentences, sum(length(sentence))::BIGINT AS n_chars "
    "FROM sentences GROUP BY 1",
    "sentences",
)
add("first_sentences", "SELECT * FROM sentences ORDER BY doc_id, sent_pos LIMIT 20000", "sentences")
add(
    "social_tokens",
    f"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(piece, {lit(T.SOCIAL_TOKEN)})) AS token "
    f"FROM ({pieces_of('documents', 'doc_id')})) GROUP BY token",
)

# --- noise and pairs ---
add("typo_variants", "SELECT * FROM variants", "variants")
stream_free = "SELECT doc_id, sent_pos, variant, source, target FROM variants"
add("stream_variants", stream_free, "variants")
add(
    "corrupt_vocabulary",
    f"SELECT token, {corrupt_word('token', f'({SEED} || chr(124) || token)', '0.5::DOUBLE')} AS typo FROM (SELECT DISTINCT token FROM target_tokens)",
    "target_tokens",
)
add(
    "noise_profile",
    "SELECT CASE WHEN s = t THEN 'unchanged' WHEN length(s) < length(t) THEN 'shorter' WHEN length(s) > length(t) "
    "THEN 'longer' ELSE 'same_length' END AS effect, count(*) AS n_words, sum(length(s) - length(t))::BIGINT AS char_delta "
    f"FROM (SELECT unnest({words('source')}) AS s, unnest({words('target')}) AS t FROM variants) GROUP BY 1",
    "variants",
)
add("typo_pairs", "SELECT *, source = target AS is_identity FROM pairs", "pairs")
add(
    "pairs_table",
    "SELECT source = target AS is_identity, count(*) AS n_pairs, sum(length(source))::BIGINT AS source_chars FROM ("
    "SELECT source, max(target) FILTER (last_one = 1) AS target FROM (SELECT *, row_number() OVER (PARTITION BY source "
    "ORDER BY doc_id DESC, sent_pos DESC, variant DESC) AS last_one FROM variants) "
    "GROUP BY source) GROUP BY 1",
    "variants",
)
_split = (
    f"SELECT source, target, CASE WHEN row_number() OVER (ORDER BY md5('{SEED}|' || source)) "
    "<= floor((SELECT count(*) FROM pairs) * 0.01::DOUBLE) THEN 'validation' ELSE 'train' END AS split FROM pairs"
)
add("split_pairs", "SELECT source, split FROM split", "pairs", split=_split)
add("split_sizes", "SELECT split, count(*) AS n_pairs FROM split GROUP BY split", "pairs", split=_split)
add(
    "split_originals",
    "SELECT source, split FROM pairs JOIN held USING (target)",
    "pairs",
    held=f"SELECT target, CASE WHEN row_number() OVER (ORDER BY md5('{SEED}|' || target)) <= floor(count(*) OVER () * 0.01::DOUBLE) "
    "THEN 'validation' ELSE 'train' END AS split FROM (SELECT DISTINCT target FROM pairs)",
)
add(
    "leaked_targets",
    "SELECT * FROM (SELECT target, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'validation') "
    "AS n_validation FROM split GROUP BY target) WHERE n_train > 0 AND n_validation > 0",
    "pairs",
    split=_split,
)

# --- vocabularies ---
add("source_vocab", "SELECT 'source' AS side, token, id FROM source_vocab", "source_vocab")
add("target_vocab", "SELECT 'target' AS side, token, id FROM target_vocab", "target_vocab")
add(
    "vocab_with_markers",
    "SELECT 'source' AS side, token, id FROM source_vocab UNION ALL SELECT 'target', token, id FROM target_vocab UNION ALL "
    "SELECT 'source', t, (SELECT ns FROM sizes) + k FROM (VALUES ('<sos>', 1), ('<eos>', 2), ('<pad>', 3), ('<unk>', 4)) v(t, k) "
    "UNION ALL SELECT 'target', t, (SELECT nt FROM sizes) + k FROM (VALUES ('<sos>', 1), ('<eos>', 2), ('<pad>', 3)) v(t, k)",
    "sizes",
)
add(
    "vocab_sizes",
    "SELECT 'source' AS side, ns + 1 AS vocab_size FROM sizes UNION ALL SELECT 'target', nt + 1 FROM sizes",
    "sizes",
)
add("token_frequencies", "SELECT token, count(*) AS n FROM target_tokens GROUP BY token", "target_tokens")
_held_sentences = (
    f"SELECT * FROM (SELECT doc_id, sent_pos, {squeezed('piece')} AS sentence FROM ({pieces_of('benchmark', 'item_id')})) WHERE sentence <> ''"
)
add(
    "oov_rate",
    "SELECT n_tokens, n_types, n_oov, n_oov_types, round(n_oov / n_tokens, 6) AS oov_rate FROM (SELECT count(*) AS n_tokens, "
    "count(DISTINCT token) AS n_types, count(*) FILTER (id IS NULL) AS n_oov, count(DISTINCT token) FILTER (id IS NULL) AS n_oov_types "
    f"FROM ({tokens_of('held', 'sentence', 'doc_id')}) LEFT JOIN target_vocab USING (token))",
    "target_vocab",
    held=_held_sentences,
)
ORACLES["subword_word_counts"] = word_counts_sql()

# --- encoding and batching ---
_joined = "array_to_string({0}, ' ') AS {0}"
add(
    "encoded_pairs",
    f"SELECT ex_id, {_joined.format('source_ids')}, {_joined.format('target_ids')} FROM kept",
    "kept",
)
add(
    "missing_tokens",
    "SELECT side, token, count(*) AS n FROM ("
    f"SELECT 'source' AS side, token FROM ({tokens_of('numbered', 'source', 'ex_id')}) UNION ALL "
    f"SELECT 'target', token FROM ({tokens_of('numbered', 'target', 'ex_id')})) "
    "WHERE token NOT IN (SELECT token FROM target_vocab) GROUP BY side, token",
    "numbered", "target_vocab",
)
add(
    "dropped_pairs",
    "SELECT doc_id || '|' || sent_pos AS ex_id, array_to_string(list_append(list(s.id ORDER BY word_pos), (SELECT ns + 2 FROM sizes)), ' ') AS source_ids "
    f"FROM ({tokens_of('held', 'sentence', 'doc_id, sent_pos')}) LEFT JOIN source_vocab s USING (token) "
    "LEFT JOIN target_vocab t USING (token) GROUP BY doc_id, sent_pos HAVING count(t.id) = count(*)",
    "sizes",
    held=_held_sentences,
)
add(
    "length_buckets",
    "SELECT l AS len, count(*) AS n_rows, ceil(count(*) / 47)::BIGINT AS n_batches, sum(l)::BIGINT AS source_cells, "
    "round((count(*) * max(len(target_ids)) - sum(len(target_ids))) / (count(*) * max(len(target_ids))), 6)::DOUBLE AS pad_share "
    "FROM slots GROUP BY l",
    "slots",
)
add("batch_slots", "SELECT ex_id, l AS len, batch_no, slot FROM slots", "slots")
add("batch_order", "SELECT l AS len, batch_no, batch_id FROM batches", "batches")
add(
    "padded_batches",
    f"SELECT batch_id, slot, ex_id, {_joined.format('source_ids')} FROM slots JOIN batches USING (l, batch_no)",
    "batches",
)
add(
    "collated_batches",
    "SELECT batch_id, count(*) AS n_rows, string_agg(ex_id::VARCHAR, ' ' ORDER BY slot) AS ex_ids, "
    "string_agg(array_to_string(target_ids, ' '), ' ' ORDER BY slot) AS target FROM slots JOIN batches USING (l, batch_no) GROUP BY batch_id",
    "batches",
)
add(
    "decoded_sources",
    "SELECT ex_id, source || ' <UNK>' AS text FROM numbered WHERE ex_id IN (SELECT ex_id FROM encoded)",
    "encoded",
)
_renoised = f"SELECT ex_id, {corrupt_sentence('source', 'k', '0.02::DOUBLE')} AS text FROM (SELECT *, '{SEED}|epoch|1|' || ex_id AS k FROM numbered)"
add("renoised_sources", "SELECT * FROM renoised", "numbered", renoised=_renoised)
add(
    "reencoded_sources",
    "SELECT ex_id, string_agg(coalesce(id, (SELECT ns + 4 FROM sizes))::VARCHAR, ' ' ORDER BY word_pos) AS ids "
    f"FROM ({tokens_of('renoised', 'text', 'ex_id')}) LEFT JOIN source_vocab USING (token) GROUP BY ex_id",
    "numbered", "sizes",
    renoised=_renoised,
)
add(
    "shifted_targets",
    "SELECT ex_id, array_to_string(list_append(target_ids[2:], (SELECT nt + 2 FROM sizes)), ' ') AS target_ids FROM encoded",
    "encoded",
)
add("trimmed_targets", "SELECT ex_id, array_to_string(target_ids[2:], ' ') AS target_ids FROM encoded", "encoded")

# --- scores ---
ORACLES["corpus_bleu"] = bleu_sql()
ORACLES["corpus_chrf"] = chrf_sql()
ORACLES["corpus_gleu"] = gleu_sql()
ORACLES["last_batch_gleu"] = gleu_sql("WHERE doc_id = (SELECT max(doc_id) FROM pairs)")
ORACLES["corpus_rouge_unstemmed"] = rouge_sql()
ORACLES["error_rates"] = edits_sql()
ORACLES["prefix_agreement"] = agreement_sql("prefix_agreement")
ORACLES["token_accuracy"] = agreement_sql("token_accuracy")
ORACLES["perplexity"] = nll_sql("perplexity")
ORACLES["token_nll"] = nll_sql("token_nll")
ORACLES["greedy_accuracy"] = nll_sql("greedy_accuracy")
add(
    "slice_report",
    "SELECT lang, d.source AS origin, count(*) AS n_pairs, round(avg((p.source <> p.target)::INT), 6) AS ser, "
    "grouping(lang, d.source)::INT AS level FROM pairs p JOIN documents d USING (doc_id) GROUP BY CUBE (lang, d.source)",
    "pairs",
)
for _name in ("beam_log_probs", "beam_candidates", "beam_top", "beam_first_step", "beam_best"):
    ORACLES[_name] = beam_sql(_name)

# --- training runs ---
add(
    "epoch_summary",
    "SELECT run_id, epoch, count(*) AS n_batches, round(avg(loss), 6) AS loss, round(sum(correct) / sum(tokens), 6) AS accuracy "
    "FROM telemetry GROUP BY run_id, epoch",
    "telemetry",
)
add(
    "running_loss",
    "SELECT run_id, epoch, event_id, round(coalesce(sum(loss) OVER (PARTITION BY run_id, epoch ORDER BY ts, event_id "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / count(*) OVER (PARTITION BY run_id, epoch), 6) AS running_loss FROM telemetry",
    "telemetry",
)
_steps_sql = "SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) - 1 AS global_step FROM telemetry"
add("global_steps", f"SELECT run_id, event_id, global_step FROM ({_steps_sql})", "telemetry")
add(
    "metric_log",
    f"SELECT run_id, global_step AS step, round(correct / tokens, 6) AS accuracy, round(loss, 6) AS loss FROM ({_steps_sql})",
    "telemetry",
)
add("best_so_far", "SELECT run_id, epoch, chrf, prev_best, improved FROM improved", "improved")
add(
    "plateau",
    "SELECT run_id, epoch, round(chrf, 6) AS chrf, improved, no_improve, reduced, round(lr, 6) AS lr, cuts > 0 AS fine_tuning, executed FROM states",
    "states",
)
_marks = (
    "SELECT *, epoch = max(epoch) OVER (PARTITION BY run_id) AS is_last, "
    "epoch = max(epoch) FILTER (improved) OVER (PARTITION BY run_id) AS is_best FROM states"
)
add("checkpoints", f"SELECT run_id, epoch, chrf, is_best, is_last FROM ({_marks}) WHERE is_best OR is_last", "states")
add(
    "resume_state",
    f"SELECT run_id, epoch, round(chrf, 6) AS chrf, no_improve, round(lr, 6) AS lr, cuts > 0 AS fine_tuning FROM ({_marks}) WHERE is_last",
    "states",
)

# --- trials ---
_draws = []
for _param, (_kind, _low, _high) in SEARCH_SPACE.items():
    _u = u(f"md5('{SEED}|trial|' || run_id || '|{_param}')")
    if _kind == "log":
        _e = f"round(exp(ln({_low}::DOUBLE) + {_u} * (ln({_high}::DOUBLE) - ln({_low}::DOUBLE))), 6)"
    elif _kind == "float":
        _e = f"round({_low}::DOUBLE + {_u} * {_high - _low!r}::DOUBLE, 6)"
    else:
        _e = f"({_low} + floor({_u} * {_high - _low + 1}))::INT"
    _draws.append(f"{_e} AS {_param}")
_configs = f"SELECT run_id, {', '.join(_draws)} FROM (SELECT DISTINCT user_id AS run_id FROM events)"
add("sampled_trials", "SELECT *, hidden_dim AS embedding_dim FROM configs", configs=_configs)
_value = "chrf::DECIMAL(12, 2)::VARCHAR"
_loss = "loss::DECIMAL(12, 2)::VARCHAR"
_parts = [f"'Validation — BLEU: ' || {_loss}"]
for _n in ("CHR-F", "ROUGE-1", "ROUGE-2", "ROUGE-L", "Accuracy", "PPL", "Precision", "Recall", "F₀.₅", "F₁", "CER", "WER", "SER", "GLEU"):
    _pct = "" if _n in ("CHR-F", "ROUGE-1", "ROUGE-2", "ROUGE-L", "PPL", "GLEU") else " || '%'"
    _parts.append(f"', {_n}: ' || {_value}{_pct}")
add(
    "log_lines",
    f"SELECT run_id, 2 * epoch AS line_no, 'Epoch ' || epoch || ' finished, average loss: ' || {_loss} || ', Accuracy: ' || {_value} || '%' AS value FROM epochs "
    f"UNION ALL SELECT run_id, 2 * epoch + 1, {' || '.join(_parts)} FROM epochs",
    "epochs",
)
add(
    "growing_log_lines",
    f"SELECT run_id, 'Epoch ' || epoch || ' finished, average loss: ' || {_loss} || ', Accuracy: ' || {_value} || '%' AS value FROM epochs "
    f"UNION ALL SELECT run_id, {' || '.join(_parts)} FROM epochs",
    "epochs",
)
add("validation_reports", "SELECT * FROM reports", "reports")
_fractions = ("Accuracy", "Precision", "Recall", "F₀.₅", "F₁", "CER", "WER", "SER")
add(
    "validation_values",
    " UNION ALL ".join(
        f"SELECT run_id, 2 * epoch + 1 AS line_no, '{n}' AS name, round({'loss' if n == 'BLEU' else 'chrf'}::DECIMAL(12, 2)::DOUBLE"
        f"{' / 100' if n in _fractions else ''}, 6) AS score FROM epochs"
        for n in VALUE_NAMES
    ),
    "epochs",
)
add("reports_until_stop", "SELECT * FROM reports WHERE epoch <= 3", "reports")
add("best_per_trial", "SELECT * FROM best", "best")
# one recursion step per trial: it joins the finished ones unless it is pruned
_pruning = {
    "told": "SELECT run_id AS trial_id, epoch AS step, chrf AS value, max(chrf) OVER (PARTITION BY run_id ORDER BY epoch) AS best FROM reports",
    "turns": "SELECT trial_id, row_number() OVER (ORDER BY trial_id) AS k FROM (SELECT DISTINCT trial_id FROM told)",
    "replay": "SELECT 0::BIGINT AS k, NULL::BIGINT AS trial_id, []::BIGINT[] AS done, []::BIGINT[] AS earlier UNION ALL "
    "SELECT s.k + 1, t.trial_id, CASE WHEN len(s.done) >= 3 AND EXISTS (SELECT 1 FROM told o JOIN (SELECT e.step, quantile_cont(e.value, 0.5) AS m "
    "FROM told e WHERE list_contains(s.done, e.trial_id) GROUP BY e.step) f ON o.step = f.step WHERE o.trial_id = t.trial_id AND o.step > 1 AND o.best < f.m) "
    "THEN s.done ELSE list_append(s.done, t.trial_id) END, s.done FROM replay s JOIN turns t ON t.k = s.k + 1",
    "finished": "SELECT trial_id, unnest(earlier) AS other FROM replay",
    "medians": "SELECT f.trial_id, e.step, quantile_cont(e.value, 0.5) AS median FROM finished f JOIN told e ON e.trial_id = f.other GROUP BY f.trial_id, e.step",
    "hits": "SELECT o.trial_id, min(o.step) AS step FROM told o JOIN medians m USING (trial_id, step) JOIN replay r USING (trial_id) "
    "WHERE len(r.earlier) >= 3 AND o.step > 1 AND o.best < m.median GROUP BY o.trial_id",
}
add(
    "median_pruning",
    "SELECT o.trial_id, o.step, round(value, 6) AS value, round(best, 6) AS best, round(median, 6) AS median, len(r.earlier)::BIGINT AS n_earlier, "
    "coalesce(o.step = h.step, false) AS pruned, coalesce(o.step > h.step, false) AS ended FROM told o JOIN replay r USING (trial_id) "
    "LEFT JOIN medians m ON m.trial_id = o.trial_id AND m.step = o.step LEFT JOIN hits h ON h.trial_id = o.trial_id",
    "reports", **_pruning,
)
ORACLES["median_pruning"] = ORACLES["median_pruning"].replace("WITH ", "WITH RECURSIVE ", 1).replace("replay AS MATERIALIZED", "replay AS", 1)
_ranked = "SELECT *, row_number() OVER (ORDER BY best_chrf DESC, run_id) AS rank FROM best"
add("top_trials", f"SELECT * FROM ({_ranked}) WHERE rank <= 3", "best")
add(
    "leaderboard",
    "SELECT rank, run_id, round(best_chrf, 6) AS best_chrf, learning_rate, hidden_dim FROM ranked JOIN configs USING (run_id)",
    "best", configs=_configs, ranked=_ranked,
)
_folders = (
    "SELECT run_id, best_chrf, learning_rate, hidden_dim, CASE WHEN run_id % 5 = 0 AND run_id % 7 = 0 THEN 'none' WHEN run_id % 5 = 0 THEN 'no score file' "
    "WHEN run_id % 7 = 0 THEN 'no configuration' WHEN run_id % 11 = 0 THEN 'broken score file' WHEN run_id % 13 = 0 THEN 'broken configuration' END AS problem "
    "FROM best JOIN configs USING (run_id)"
)
add(
    "folder_leaderboard",
    "SELECT row_number() OVER (ORDER BY best_chrf DESC, run_id) AS rank, run_id, round(best_chrf, 6) AS best_chrf, round(learning_rate, 6) AS learning_rate, "
    "hidden_dim::DOUBLE AS hidden_dim FROM folders WHERE problem IS NULL",
    "best", configs=_configs, folders=_folders,
)
add("bad_run_folders", "SELECT run_id, problem FROM folders WHERE problem <> 'none'", "best", configs=_configs, folders=_folders)
add(
    "leaderboard_top5",
    "SELECT rank, run_id, best_chrf, batchSize FROM ranked JOIN configs USING (run_id) WHERE rank <= 5",
    "best", configs=_configs, ranked=_ranked,
)
add(
    "parameter_effect",
    "SELECT floor((hidden_dim - 700) / 62.75)::BIGINT + 1 AS bin, count(*) AS n_runs, round(avg(best_chrf), 6) AS mean_chrf "
    "FROM best JOIN configs USING (run_id) GROUP BY 1",
    "best", configs=_configs,
)

# --- streams ---
add(
    "stream_monitor",
    "SELECT run_id, line_no, epoch, round(chrf, 6) AS chrf, round(max(chrf) OVER (PARTITION BY run_id ORDER BY line_no), 6) AS best_chrf, "
    "epoch >= 3 AS stop, false AS late FROM reports",
    "reports",
)
add("stream_clean", f"SELECT doc_id, {cleaned('text')} AS text FROM documents")
add(
    "stream_encoded",
    "SELECT doc_id, sent_pos, string_agg(id::VARCHAR, ' ' ORDER BY word_pos) || ' ' || (SELECT ns + 2 FROM sizes) AS ids "
    "FROM target_tokens JOIN source_vocab USING (token) GROUP BY doc_id, sent_pos",
    "target_tokens", "sizes",
)
