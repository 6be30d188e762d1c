"""Check SQL for the evaluation scores."""

from __future__ import annotations

from .parts import WS, lit, tokens_of, with_tables

_BLEU_RULES = (
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "),
    (r"([^0-9])([\.,])", r"\1 \2 "),
    (r"([\.,])([^0-9])", r" \1 \2"),
    (r"([0-9])(-)", r"\1 \2 "),
)


def _bleu_tokens(text: str) -> str:
    for old, new in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = f"replace({text}, {lit(old)}, {lit(new)})"
    text = f"(' ' || {text} || ' ')"
    for pattern, new in _BLEU_RULES:
        text = f"regexp_replace({text}, {lit(pattern)}, {lit(new)}, 'g')"
    return f"list_filter(string_split_regex({text}, {WS}), lambda x: x <> '')"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, {WS}), lambda x: x <> '')"


def _grams(order: int) -> dict[str, str]:
    """From ``seqs(id, h, r)`` the clipped counts per pair and order."""
    sides = " UNION ALL ".join(
        f"SELECT id, n, 1 - s AS is_hyp, array_to_string(x[i:i + n - 1], chr(31)) AS g FROM (SELECT id, n, s, x, unnest(range(1, len(x) - n + 2)) AS i "
        f"FROM (SELECT id, {side} AS x, {s} AS s, unnest(range(1, {order + 1})) AS n FROM seqs))"
        for s, side in ((0, "h"), (1, "r"))
    )
    return {
        "grams": f"SELECT id, n, g, sum(is_hyp) AS hc, sum(1 - is_hyp) AS rc FROM ({sides}) GROUP BY id, n, g",
        "counts": "SELECT id, n, sum(least(hc, rc))::BIGINT AS m, sum(hc)::BIGINT AS h, sum(rc)::BIGINT AS r FROM grams GROUP BY id, n",
    }


def _seqs(hyp: str, ref: str, where: str = "") -> str:
    return f"SELECT row_number() OVER () AS id, {hyp} AS h, {ref} AS r FROM pairs {where}"


def bleu_sql() -> str:
    final = (
        "SELECT round(100 * (CASE WHEN h1 < r1 THEN exp(1 - r1 / h1) ELSE 1 END) * exp(s), 6) AS bleu FROM ("
        "SELECT max(h) FILTER (n = 1) AS h1, max(r) FILTER (n = 1) AS r1, avg(ln(CASE WHEN m > 0 THEN m / h ELSE 1 / (pow(2, z) * h) END)) AS s FROM ("
        "SELECT *, sum((m = 0)::INT) OVER (ORDER BY n) AS z FROM (SELECT n, sum(m) AS m, sum(h) AS h, sum(r) AS r FROM counts GROUP BY n)))"
    )
    return with_tables(final, "pairs", extra={"seqs": _seqs(_bleu_tokens("source"), _bleu_tokens("target")), **_grams(4)})


def chrf_sql() -> str:
    """Equal pairs match in every gram; only the others are cut into grams."""
    squash = lambda c: f"regexp_replace({c}, {WS}, '', 'g')"
    sides = " UNION ALL ".join(
        f"SELECT id, n, 1 - {s} AS is_hyp, substr({side}, i, n) AS g FROM (SELECT id, n, {side}, unnest(range(1, length({side}) - n + 2)) AS i "
        "FROM orders WHERE h <> r)"
        for s, side in ((0, "h"), (1, "r"))
    )
    extra = {
        "seqs": f"SELECT row_number() OVER () AS id, {squash('source')} AS h, {squash('target')} AS r FROM pairs",
        "orders": "SELECT id, h, r, unnest(range(1, 7)) AS n FROM seqs",
        "matches": "SELECT n, sum(least(hc, rc)) AS m FROM (SELECT n, sum(is_hyp) AS hc, sum(1 - is_hyp) AS rc "
        f"FROM ({sides}) GROUP BY id, n, g) GROUP BY n",
        "totals": "SELECT n, sum(CASE WHEN length(r) >= n THEN greatest(length(h) - n + 1, 0) ELSE 0 END) AS h, "
        "sum(greatest(length(r) - n + 1, 0)) AS r, sum(CASE WHEN h = r THEN greatest(length(h) - n + 1, 0) ELSE 0 END) AS same "
        "FROM orders GROUP BY n",
    }
    final = (
        "SELECT round(100 * 5 * p * q / (4 * p + q), 6) AS chrf FROM (SELECT avg((m + same) / h) AS p, avg((m + same) / r) AS q "
        "FROM totals JOIN matches USING (n) WHERE h > 0 AND r > 0)"
    )
    return with_tables(final, "pairs", extra=extra)


def gleu_sql(where: str = "") -> str:
    final = (
        "SELECT round(avg(g), 6) AS gleu FROM (SELECT id, sum(m) / greatest(sum(h), sum(r)) AS g FROM counts GROUP BY id)"
    )
    return with_tables(final, "pairs", extra={"seqs": _seqs(_words("source"), _words("target"), where), **_grams(4)})


def rouge_sql() -> str:
    """ROUGE-1 and ROUGE-2 without stemming."""
    toks = lambda c: f"list_filter(string_split(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"
    final = (
        "SELECT round(sum(f) FILTER (n = 1) / (SELECT count(*) FROM seqs), 6) AS rouge1, "
        "round(sum(f) FILTER (n = 2) / (SELECT count(*) FROM seqs), 6) AS rouge2 FROM ("
        "SELECT n, CASE WHEN m > 0 THEN 2 * (m / h) * (m / r) / (m / h + m / r) ELSE 0 END AS f FROM counts)"
    )
    return with_tables(final, "pairs", extra={"seqs": _seqs(toks("source"), toks("target")), **_grams(2)})


def edits_sql() -> str:
    """Byte edit distance over one-byte symbols: each pair's characters or words are renamed."""

    def coded(items: str, other: int) -> str:
        # items outside the alphabet match nothing on the other side: one symbol per side
        place = "coalesce(list_position(alphabet, x) + 2, " + str(other) + ")::INT"
        return f"array_to_string(list_transform({items}, lambda x: chr({place})), '')"

    def distance(items: str) -> str:
        return f"levenshtein({coded('h' + items, 1)}, {coded('r' + items, 2)})"

    rows = (
        "SELECT source, target, string_split(source, '') AS hc, string_split(target, '') AS rc, "
        f"{_words('source')} AS hw, {_words('target')} AS rw FROM pairs"
    )
    edits = (
        "SELECT *, CASE WHEN source = target THEN 0 ELSE "
        f"(SELECT {distance('c')} FROM (SELECT list_distinct(rc) AS alphabet)) END AS ce, "
        "CASE WHEN source = target THEN 0 ELSE "
        f"(SELECT {distance('w')} FROM (SELECT list_distinct(list_intersect(hw, rw)) AS alphabet)) END AS we FROM rows"
    )
    final = (
        "SELECT round(sum(ce) / sum(len(rc)), 6) AS cer, round(sum(we) / sum(len(rw)), 6) AS wer, "
        "round(avg((source <> target)::INT), 6) AS ser FROM edits"
    )
    return with_tables(final, "pairs", extra={"rows": rows, "edits": edits})


def agreement_sql(name: str) -> str:
    hits = (
        "SELECT len(list_filter(list_zip(h, r, true), lambda x: x[1] = x[2])) AS hit, least(len(h), len(r)) AS n "
        f"FROM (SELECT {_words('source')} AS h, {_words('target')} AS r FROM pairs)"
    )
    if name == "token_accuracy":
        final = (
            "SELECT round(sum(hit) / sum(n), 6) AS token_accuracy, round(sum(hit + 1) / sum(n + 1), 6) AS with_start FROM hits"
        )
    else:
        final = (
            "SELECT round(p, 6) AS precision, round(p, 6) AS recall, round(p, 6) AS f1, "
            "round(1.25 * p * p / (0.25 * p + p + 1e-8), 6) AS f05 FROM (SELECT sum(hit) / sum(n) AS p FROM hits)"
        )
    return with_tables(final, "pairs", extra={"hits": hits})


_SCORES = (
    "SELECT vec_id, vec_id // 8 AS ex_id, vec_id % 8 AS pos, label AS target, embedding::DOUBLE[] AS x FROM embeddings"
)
_LSE = "list_max(x) + ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x)))))"


def nll_sql(name: str) -> str:
    nll = f"SELECT *, CASE WHEN target <> 0 THEN {_LSE} - x[target + 1] END AS nll FROM scores"
    final = {
        "perplexity": "SELECT round(sum(nll), 6) AS nll_sum, count(nll) AS n_tokens, round(avg(nll), 6) AS mean_nll, "
        "round(exp(avg(nll)), 6) AS perplexity FROM nlls",
        "token_nll": "SELECT ex_id, pos, round(nll, 6) AS nll FROM nlls",
        "greedy_accuracy": "SELECT pos, sum((list_position(x, list_max(x)) - 1 = target)::INT)::BIGINT AS n_correct, "
        "count(*) AS n_tokens, round(avg((list_position(x, list_max(x)) - 1 = target)::INT), 6) AS accuracy FROM nlls GROUP BY pos",
    }[name]
    return with_tables(final, extra={"scores": _SCORES, "nlls": nll})


def beam_sql(name: str) -> str:
    states = (
        "SELECT vec_id // 5 AS ex_id, vec_id % 5 AS beam, label, (vec_id % 5) * -0.125::DOUBLE AS score, embedding::DOUBLE[] AS x FROM embeddings"
    )
    logs = f"SELECT ex_id, beam, label, score, unnest(x) - ({_LSE}) AS logprob, generate_subscripts(x, 1) - 1 AS token FROM states"
    cand = (
        "SELECT * FROM (SELECT *, score + logprob AS total, row_number() OVER (PARTITION BY ex_id, beam ORDER BY score + logprob DESC, token) AS k "
        "FROM logs) WHERE k <= 5"
    )
    top = (
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ex_id ORDER BY total DESC, beam * 64 + token) - 1 AS rank FROM logs"
        + (" WHERE beam = 0" if name == "beam_first_step" else "")
        + ") WHERE rank < 5"
    )
    final = {
        "beam_log_probs": "SELECT ex_id, beam, token, round(logprob, 6) AS logprob FROM logs",
        "beam_candidates": "SELECT ex_id, beam, token, beam * 64 + token AS flat, round(total, 6) AS score FROM cand",
        "beam_top": "SELECT ex_id, rank, round(total, 6) AS score, beam AS parent, token FROM top",
        "beam_first_step": "SELECT ex_id, rank, token, round(total, 6) AS score FROM top",
        "beam_best": "SELECT ex_id, CASE WHEN label = 1 THEN '' WHEN token = 1 THEN label::VARCHAR ELSE label || ' ' || token END AS ids, "
        "round(total / 2, 6) AS norm_score FROM top WHERE rank = 0",
    }[name]
    top = top.replace("ORDER BY total DESC", "ORDER BY score + logprob DESC").replace("SELECT *, row_number", "SELECT *, score + logprob AS total, row_number")
    return with_tables(final, extra={"states": states, "logs": logs, "cand": cand, "top": top})
