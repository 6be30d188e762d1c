"""Shared pieces of the check SQL: patterns, the keyed noise model and common tables."""

from __future__ import annotations

from pairforge.functions import noise
from pairforge.functions import text as T
from pairforge.functions.cleaning import MARKUP_RULES
from pairforge.functions.rng import SEED
from pairforge.operators.pairs import PROBABILITY

P = f"{PROBABILITY!r}::DOUBLE"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


WS = lit(T.WHITESPACE)
SPECIAL = ", ".join(lit(t) for t in noise.SPECIAL_TOKENS)
LETTERS = lit(noise.ASCII_LETTERS)
_NEAR = [noise.QWERTY_NEIGHBOURS.get(c) or noise.QWERTY_NEIGHBOURS[c.lower()].upper() for c in noise.ASCII_LETTERS]
NEAR = "[" + ", ".join(lit(n) for n in _NEAR) + "]"


def u(draw: str, slot: str | int = 0) -> str:
    return f"(('0x' || substr({draw}, 1 + 8 * ({slot}), 8))::UBIGINT::DOUBLE / 4294967296.0)"


def pick(chars: str, uniform: str) -> str:
    return f"substr({chars}, floor({uniform} * length({chars}))::INT + 1, 1)"


def corrupt_word(w: str, key: str, p: str) -> str:
    """Typo form of word ``w`` under ``key``; lambda names carry no clash with callers."""
    near = f"{NEAR}[strpos({LETTERS}, c)]"
    draw = f"md5({key} || '|' || (j - 1))"
    gate = u(f"md5({key} || '|g|' || ((j - 1) // 4))", "(j - 1) % 4")
    op = (
        f"CASE WHEN length({w}) > 1 THEN floor({u(draw)} * 3)::INT "
        f"ELSE 2 * floor({u(draw)} * 2)::INT END"
    )
    edit = (
        f"CASE WHEN strpos({LETTERS}, c) > 0 THEN CASE {op} WHEN 0 THEN c || {pick(near, u(draw, 1))} "
        f"WHEN 2 THEN {pick(near, u(draw, 1))} ELSE '' END "
        f"WHEN regexp_full_match(c, '\\p{{Nd}}') THEN c ELSE '' END"
    )
    body = (
        f"array_to_string(list_transform(string_split({w}, ''), "
        f"lambda c, j: CASE WHEN {gate} < {p} THEN {edit} ELSE c END), '')"
    )
    tail = f"CASE WHEN {u(f'md5({key})')} < {p} THEN {pick(LETTERS, u(f'md5({key})', 1))} ELSE '' END"
    return (
        f"CASE WHEN {w} IN ({SPECIAL}) THEN {w} ELSE list_transform([{body} || {tail}], "
        f"lambda f: CASE WHEN f = '' THEN {pick(LETTERS, u(f'md5({key})', 2))} ELSE f END)[1] END"
    )


def corrupt_sentence(sentence: str, key: str, p: str) -> str:
    words = (
        f"array_to_string(list_transform(string_split({sentence}, ' '), "
        f"lambda w, i: {corrupt_word('w', f'({key} || chr(124) || (i - 1))', p)}), ' ')"
    )
    return f"CASE WHEN {u(f'md5({key})')} > {p} OR {sentence} = '' THEN {sentence} ELSE {words} END"


def squeezed(text: str) -> str:
    return f"array_to_string(list_filter(string_split_regex({text}, {WS}), lambda x: x <> ''), ' ')"


def pieces_of(table: str, key: str, out: str = "doc_id") -> str:
    """Sentence pieces of a text table with 0-based positions."""
    return (
        f"SELECT {out}, unnest(parts) AS piece, generate_subscripts(parts, 1) - 1 AS sent_pos FROM "
        f"(SELECT {key} AS {out}, string_split_regex(text, '[.!?]') AS parts FROM {table})"
    )


def words(sentence: str) -> str:
    return f"list_filter(string_split({sentence}, ' '), lambda x: x <> '')"


def java_to_re2(replacement: str) -> str:
    return replacement.replace("$1", "\\1")


def cleaned(text: str, spaced: bool = False, upto: int | None = None) -> str:
    for name, pattern, replacement in MARKUP_RULES[:upto]:
        if spaced and name == "character_whitelist":
            text = f"regexp_replace({text}, '[\\r\\n]', ' ', 'g')"
        text = f"regexp_replace({text}, {lit(pattern)}, {lit(java_to_re2(replacement))}, 'g')"
    return text


def tokens_of(table: str, sentence: str, keys: str) -> str:
    return (
        f"SELECT {keys}, unnest(ws) AS token, generate_subscripts(ws, 1) - 1 AS word_pos FROM "
        f"(SELECT {keys}, {words(sentence)} AS ws FROM {table})"
    )


# Name -> (tables it needs, SQL).
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "sentences": (
        (),
        f"SELECT * FROM (SELECT doc_id, sent_pos, {squeezed('piece')} AS sentence FROM "
        f"({pieces_of('documents', 'doc_id')})) WHERE sentence <> ''",
    ),
    "variants": (
        ("sentences",),
        "SELECT doc_id, sent_pos, variant, sentence AS target, "
        + corrupt_sentence("sentence", "k", P)
        + f" AS source FROM (SELECT s.*, t.variant, '{SEED}|' || doc_id || '|' || sent_pos || '|' || t.variant AS k "
        "FROM sentences s, range(1, 5) t(variant))",
    ),
    "pairs": (
        ("variants",),
        "SELECT source, max(target) FILTER (last_one = 1) AS target, max(doc_id) FILTER (first_one = 1) AS doc_id, "
        "max(sent_pos) FILTER (first_one = 1) AS sent_pos, max(variant) FILTER (first_one = 1) AS variant FROM ("
        "SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, sent_pos, variant) AS first_one, "
        "row_number() OVER (PARTITION BY source ORDER BY doc_id DESC, sent_pos DESC, variant DESC) AS last_one "
        "FROM variants) GROUP BY source",
    ),
    "numbered": (
        ("pairs",),
        "SELECT *, row_number() OVER (ORDER BY doc_id, sent_pos, variant) - 1 AS ex_id FROM pairs",
    ),
    "source_vocab": (
        ("variants",),
        "SELECT token, row_number() OVER (ORDER BY doc_id, sent_pos, variant, word_pos) - 1 AS id FROM ("
        "SELECT *, row_number() OVER (PARTITION BY token ORDER BY doc_id, sent_pos, variant, word_pos) AS rn FROM ("
        + tokens_of("(SELECT doc_id, sent_pos, 0 AS variant, sentence FROM sentences UNION ALL "
                    "SELECT doc_id, sent_pos, variant, source FROM variants)", "sentence", "doc_id, sent_pos, variant")
        + ")) WHERE rn = 1",
    ),
    "target_tokens": (("sentences",), tokens_of("sentences", "sentence", "doc_id, sent_pos")),
    "target_vocab": (
        ("target_tokens",),
        "SELECT token, row_number() OVER (ORDER BY doc_id, sent_pos, word_pos) - 1 AS id FROM ("
        "SELECT *, row_number() OVER (PARTITION BY token ORDER BY doc_id, sent_pos, word_pos) AS rn FROM target_tokens"
        ") WHERE rn = 1",
    ),
    "sizes": (
        ("source_vocab", "target_vocab"),
        "SELECT (SELECT count(*) FROM source_vocab) AS ns, (SELECT count(*) FROM target_vocab) AS nt",
    ),
    "encoded": (
        ("numbered", "source_vocab", "target_vocab", "sizes"),
        "SELECT ex_id, list_append(src, (SELECT ns + 2 FROM sizes)) AS source_ids, "
        "list_prepend((SELECT nt + 1 FROM sizes), tgt) AS target_ids FROM ("
        "SELECT ex_id, list(coalesce(id, (SELECT ns + 4 FROM sizes)) ORDER BY word_pos) AS src FROM ("
        + tokens_of("numbered", "source", "ex_id")
        + ") LEFT JOIN source_vocab USING (token) GROUP BY ex_id) JOIN ("
        "SELECT ex_id, list(id ORDER BY word_pos) AS tgt, count(*) - count(id) AS missing FROM ("
        + tokens_of("numbered", "target", "ex_id")
        + ") LEFT JOIN target_vocab USING (token) GROUP BY ex_id) USING (ex_id) WHERE missing = 0",
    ),
    "kept": (
        ("encoded",),
        "SELECT * FROM encoded WHERE len(source_ids) = len(target_ids) AND len(source_ids) <= 175",
    ),
    "slots": (
        ("kept",),
        "SELECT *, place // 47 AS batch_no, place % 47 AS slot FROM (SELECT *, len(source_ids) AS l, "
        "row_number() OVER (PARTITION BY len(source_ids) ORDER BY ex_id) - 1 AS place FROM kept "
        "WHERE len(source_ids) BETWEEN 4 AND 175)",
    ),
    "batches": (
        ("slots",),
        "SELECT l, batch_no, row_number() OVER (ORDER BY h, l, batch_no) - 1 AS batch_id FROM ("
        f"SELECT DISTINCT l, batch_no, md5('{SEED}|batch|' || l || '|' || batch_no) AS h FROM slots)",
    ),
    "wiki": (
        (),
        "SELECT doc_id, '==About ' || source || '==' || chr(10) || '''''''' || lang || ''''''' [[Image:map.png|thumb|left|220px|Map of ' "
        "|| source || ']] &lt;ref name=a&gt;note&lt;/ref&gt; &amp;lt;div&amp;gt; {{Infobox|' || lang || '}} [[Category:' || source "
        "|| '|*]] [[' || lang || ':Page]] [[Page|label]] [http://x.org/a ' || source || '] 5% of $3 R&amp;amp;D word--tail a -- b U.S. ' "
        "|| text || ' {| table |} ''''it'''' &nbsp; &lt;references /&gt;' AS raw FROM documents",
    ),
    "articles": ((), "SELECT page_id AS doc_id, html AS raw FROM pages WHERE url NOT LIKE '%#%'"),
    "telemetry": (
        (),
        "SELECT user_id AS run_id, date_diff('day', DATE '2024-01-01', ts::DATE) + 1 AS epoch, ts, event_id, value AS loss, "
        "floor(value % 100)::BIGINT AS correct, 100 AS tokens FROM events",
    ),
    "epochs": (
        ("telemetry",),
        "SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS epoch, chrf, loss FROM ("
        "SELECT run_id, epoch, max(loss) AS chrf, min(loss) AS loss FROM telemetry GROUP BY run_id, epoch)",
    ),
    "improved": (
        ("epochs",),
        "SELECT *, prev_best IS NULL OR chrf > prev_best AS improved FROM (SELECT *, max(chrf) OVER "
        "(PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_best FROM epochs)",
    ),
    "states": (
        ("improved",),
        # the plateau rule as read: one step per epoch
        "WITH RECURSIVE walk AS (SELECT run_id, epoch, chrf, improved, 0 AS no_improve, 0 AS cuts, 0 AS cuts_before, "
        "false AS reduced FROM improved WHERE epoch = 1 UNION ALL SELECT i.run_id, i.epoch, i.chrf, i.improved, "
        "CASE WHEN i.improved THEN 0 WHEN w.no_improve + 1 > 2 THEN 0 ELSE w.no_improve + 1 END, "
        "w.cuts + CASE WHEN NOT i.improved AND w.no_improve + 1 > 2 THEN 1 ELSE 0 END, w.cuts, "
        "NOT i.improved AND w.no_improve + 1 > 2 FROM walk w JOIN improved i ON i.run_id = w.run_id AND i.epoch = w.epoch + 1) "
        "SELECT *, 0.315762073010458::DOUBLE * pow(0.1::DOUBLE, cuts) AS lr, "
        "0.315762073010458::DOUBLE * pow(0.1::DOUBLE, cuts_before) > 0.0001 AS executed FROM walk",
    ),
    "reports": (
        ("epochs",),
        "SELECT run_id, 2 * epoch + 1 AS line_no, epoch, chrf::DECIMAL(12, 2)::DOUBLE AS chrf FROM epochs",
    ),
    "best": (("reports",), "SELECT run_id, greatest(0.0::DOUBLE, max(chrf)) AS best_chrf FROM reports GROUP BY run_id"),
}


def with_tables(final: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``final`` behind the named tables and everything they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in CTES[name][0]:
            visit(need)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order]
    parts += [f"{n} AS MATERIALIZED ({sql})" for n, sql in (extra or {}).items()]
    return f"WITH {', '.join(parts)} {final}" if parts else final
