"""Operator 3: personal data by pattern, and terms that disclose it by corpus co-occurrence.

Only DataFrame functions: every expression runs in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import fresh, only

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("email", "ip", "card", "phone", "term")
#: Private-use characters that stand, in working copies of the same length, for a
#: separator between two digits and for a dot between two domain characters.
_GAP, _DOT = "", ""
_NAME = "A-Za-z0-9"
#: The patterns on the working copies. With the marks, repeated groups become plain
#: character classes: no recursion, so runs of any length match, and a look-behind keeps
#: a long run from being tried again from each of its characters.
EMAIL = rf"(?:\G|(?<![{_NAME}._%+{_DOT}-]))[{_NAME}._%+{_DOT}-]++@[{_NAME}-]+{_DOT}[{_NAME}-][{_NAME}{_DOT}-]*"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = rf"[0-9][0-9{_GAP}]*[0-9]"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]?)"
BYTES = rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"
TERM = r"(?<!\p{L})\p{L}{4,}+"
_CHUNK = 256
_SPAN = "array<struct<start:bigint,end:bigint,hit:string>>"


def _located(pieces: Column, hits: Column) -> Column:
    """Spans of matches from the text between them; linear in their number but for one sum per 256."""
    gaps = F.zip_with(F.slice(pieces, 1, F.size(hits)), hits, lambda p, h: F.struct(F.length(p).cast("bigint").alias("gap"), h.alias("hit")))
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / _CHUNK).cast("int")), lambda c: F.slice(gaps, c * _CHUNK + 1, _CHUNK)
    )
    width = lambda x: x["gap"] + F.length(x["hit"])

    def one(chunk: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.expr(f"cast(array() as {_SPAN})").alias("out"))
        return F.aggregate(
            chunk,
            first,
            lambda acc, x: F.struct(
                (acc["at"] + width(x)).alias("at"),
                F.concat(
                    acc["out"],
                    F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + width(x)).alias("end"), x["hit"].alias("hit"))),
                ).alias("out"),
            ),
            lambda acc: acc["out"],
        )

    totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + width(x)))
    starts = F.transform(totals, lambda _, i: F.aggregate(F.slice(totals, F.lit(1), i), F.lit(0).cast("bigint"), lambda a, x: a + x))
    return F.flatten(F.zip_with(chunks, starts, one))


def with_spans(df: DataFrame, work: Column, pattern: str, out: str, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """Add ``out``: start, end (code points, end exclusive) and text of all matches that ``keep`` accepts.

    ``split`` and ``regexp_extract_all`` find the same matches, leftmost and without
    overlap, so the lengths of the pieces between them give the places.
    """
    copy, hits = fresh(df, f"_{out}_copy"), fresh(df, f"_{out}_hits")
    found = df.withColumn(copy, work).withColumn(hits, F.regexp_extract_all(F.col(copy), F.lit(pattern), F.lit(0)))
    spans = F.when(F.size(hits) > 0, _located(F.split(F.col(copy), pattern, -1), F.col(hits)))
    spans = F.coalesce(spans, F.expr(f"cast(array() as {_SPAN})"))
    located = found.withColumn(out, spans).drop(copy, hits)
    return located if keep is None else located.withColumn(out, F.filter(F.col(out), lambda s: keep(s["hit"])))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(hit: Column) -> Column:
    digits = _digits(hit)
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    checked = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0
    return F.when(n.between(14, 19), checked).otherwise(False)


def base_spans(docs: DataFrame, text: str = "text", out: str = "base") -> DataFrame:
    """Add ``out``: array of ``start, kind_no, end, hit`` of the four base kinds, by start, then kind."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    plain = F.translate(whole, _GAP + _DOT, "~~")
    names = [fresh(docs, f"_{out}_{k}") for k in KINDS[:4]]
    dotted = F.regexp_replace(plain, rf"(?<=[{_NAME}-])\.(?=[{_NAME}-])", _DOT)
    gapped = F.regexp_replace(plain, r"(?<=[0-9])[\x20-](?=[0-9])", _GAP)
    found = with_spans(docs, dotted, EMAIL, names[0])
    found = with_spans(found, whole, IP, names[1], lambda h: h.rlike(BYTES))
    found = with_spans(found, gapped, CARD, names[2], _luhn)
    found = with_spans(found, whole, PHONE, names[3], lambda h: F.length(_digits(h)).between(10, 15))

    def numbered(k: int) -> Callable[[Column], Column]:
        return lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind_no"), s["end"].alias("end"), s["hit"].alias("hit"))

    every = [F.transform(n, numbered(k)) for k, n in enumerate(names)]
    return found.withColumn(out, F.array_sort(F.concat(*every))).drop(*names)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind_no"] + 1), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def row_digest(doc_id: Column, text: Column) -> Column:
    """Names a row: rows of the same id and text have the same spans."""
    return F.unhex(F.md5(F.concat_ws("\u0000", F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(text, F.lit("")))))


def contexts(based: DataFrame, text: str, base: str, digest: str) -> DataFrame:
    """``digest, text_key, entities, words`` of every text with base spans.

    ``words`` are all words of four letters or more of the whole text that no base span
    touches: ``term, start, end``. ``entities`` are the distinct values of its base spans.
    """
    rows = based.where(F.size(base) > 0).select(
        F.col(digest).alias("digest"), F.col(f"`{text}`").alias("text"), F.col(base).alias("base")
    )
    rows = with_spans(rows, F.col("text"), TERM, "words")
    value = lambda s: F.when(s["kind_no"] == 0, F.lower(s["hit"])).otherwise(_digits(s["hit"]))
    entity = lambda s: F.concat_ws(":", s["kind_no"].cast("string"), value(s))
    clear = lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))
    word = lambda w: F.struct(F.lower(w["hit"]).alias("term"), w["start"].alias("start"), w["end"].alias("end"))
    return rows.select(
        "digest",
        F.unhex(F.md5("text")).alias("text_key"),
        F.array_distinct(F.transform("base", entity)).alias("entities"),
        F.transform(F.filter("words", clear), word).alias("words"),
    )


def disclosing_terms(near: DataFrame, docs: DataFrame, text: str, threshold: float) -> DataFrame:
    """``digest, term`` of the terms that disclose an entity of their text at or over ``threshold``.

    With n documents, n(t) holding the term, n(e) the entity, n(t, e) both: pointwise mutual
    information log(n n(t, e) / n(t) n(e)) over the entity's information log(n / n(e)). At 1
    the term is found nowhere without the entity. A pair needs two different texts, else
    each rare word beside a number would count. All counts are over all documents and
    combined before their shuffles. As n(t, e) is at most n(e), a term meets only entities
    with log(n / n(t)) >= threshold log(n / n(e)): no other pair can reach the threshold.
    """
    held = near.select("digest", "text_key", F.explode("entities").alias("entity")).distinct()
    entities = held.groupBy("entity").agg(F.count("*").alias("n_entity"), F.min("text_key").alias("a"), F.max("text_key").alias("b"))
    entities = held.join(entities.where("a < b").drop("a", "b"), "entity")
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))), F.lit(TERM), F.lit(0)))
    terms = docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    shown = near.select("digest", F.explode(F.array_distinct(F.transform("words", lambda w: w["term"]))).alias("term")).distinct()
    total = docs.agg(F.count("*").alias("n")).select("n").scalar()
    can = F.log(total / F.col("n_term")) >= threshold * F.log(total / F.col("n_entity")) - 1e-9
    met = entities.join(shown.join(terms, "term"), "digest").where(can)
    counted = met.groupBy("term", "entity", "n_term", "n_entity").agg(
        F.count("*").alias("n_pair"), F.min("text_key").alias("a"), F.max("text_key").alias("b")
    )
    shared = F.log(F.col("n_pair") * total / (F.col("n_term") * F.col("n_entity")))
    scored = counted.where("a < b").withColumn("disclosure", F.try_divide(shared, F.log(total / F.col("n_entity"))))
    strong = scored.where(F.col("disclosure") >= threshold).select("entity", "term")
    return met.join(strong, ["entity", "term"]).select("digest", "term").distinct()


def term_spans(docs: DataFrame, based: DataFrame, text: str, base: str, digest: str, threshold: float) -> DataFrame:
    """``term_digest, terms``: spans of disclosing terms, one row for each row digest that has some."""
    near = stored(contexts(based, text, base, digest), "contexts")
    places = near.select("digest", F.explode("words").alias("w")).select("digest", "w.*")
    found = places.join(disclosing_terms(near, docs, text, threshold), ["digest", "term"])
    span = F.struct("start", F.lit(4).alias("kind_no"), "end", F.col("term").alias("hit"))
    return found.groupBy(F.col("digest").alias("term_digest")).agg(F.array_sort(F.collect_set(span)).alias("terms"))


def find_pii(
    docs: DataFrame, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term`` of every whole text.

    Base spans come from the patterns; terms anywhere in a text that disclose one of its
    base spans (:func:`disclosing_terms`) are added as spans of kind ``term``. One row per
    input row: repeated rows and repeated or null ids stay, null and empty texts have no
    spans, extra columns are dropped, an empty table gives an empty table.
    """
    rows = only(docs, doc_id=(id_col, "bigint"), text=(text_col, "string"))
    rows = rows.withColumn("digest", row_digest(F.col("doc_id"), F.col("text")))
    based = base_spans(rows)
    held = stored(based.where(F.size("base") > 0), "held")
    terms = term_spans(rows, held, "text", "base", "digest", threshold)
    none = F.expr("cast(array() as array<struct<start:bigint,kind_no:int,end:bigint,hit:string>>)")
    with_terms = (
        held.select("digest", "base")
        .dropDuplicates(["digest"])
        .join(terms, F.col("digest") == F.col("term_digest"), "left")
        .select(F.col("digest").alias("d"), "base", F.coalesce("terms", none).alias("terms"))
    )
    # rows without spans meet nothing; only their ids are shuffled
    joined = rows.select("doc_id", "digest").join(with_terms, F.col("digest") == F.col("d"), "left")
    joined = joined.withColumns({"base": F.coalesce("base", none), "terms": F.coalesce("terms", none)})

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind_no"] == k)).cast("bigint")

    return joined.select(
        "doc_id",
        *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", "terms"))).alias("spans"),
        F.size("terms").cast("bigint").alias("n_term"),
    )


def sanitised(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in angle brackets; spans that overlap one before go with it."""
    kinds = F.array(*(F.lit(f"<{k}>") for k in KINDS))
    n = F.length(text)
    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    cut = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))
    step = lambda acc, s: F.when(
        s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
    ).otherwise(
        F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(cut(acc["at"], s["start"]), F.element_at(kinds, s["kind_no"] + 1))).alias("out"))
    )
    return F.aggregate(spans, first, step, lambda acc: F.concat(F.array_join(acc["out"], ""), cut(acc["at"], n)))


def remove_pii(
    docs: DataFrame, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None
) -> DataFrame:
    """``docs``, with personal data and the terms that disclose it generalised to their kind.

    Rows without spans pass as they are. ``length_col``, if given, follows the new text.
    """
    mark, base = fresh(docs, "pii_digest"), fresh(docs, "pii_base")
    marked = docs.withColumn(mark, row_digest(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")))
    based = base_spans(marked, text_col, base)
    held = stored(based.where(F.size(base) > 0), "held")
    terms = term_spans(marked, held, text_col, base, mark, threshold)
    names = {c: fresh(docs, f"pii_{c}") for c in terms.columns}
    terms = terms.select(*(F.col(c).alias(a) for c, a in names.items()))
    found = held.join(terms, F.col(mark) == F.col(names["term_digest"]), "left")
    none = F.expr("cast(array() as array<struct<start:bigint,kind_no:int,end:bigint,hit:string>>)")
    spans = F.array_sort(F.concat(F.col(base), F.coalesce(names["terms"], none)))
    found = found.withColumn(text_col, sanitised(F.col(f"`{text_col}`"), spans))
    if length_col is not None:
        found = found.withColumn(length_col, F.length(F.col(f"`{text_col}`")).cast(docs.schema[length_col].dataType))
    rest = based.where(F.size(base) == 0)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return rest.select(*columns).unionByName(found.select(*columns))
