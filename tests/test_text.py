import pytest
from pyspark.sql import functions as F

from pairforge.functions import cleaning, text
from pairforge.functions.stemming import stem
from pairforge.sources import corpus as corpus_source
from pairforge.sources import logs
from pairforge.operators import corpus


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("o")).first()["o"]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("a<br/>b", "ab"),
        ("x &lt;ref name=q&gt;gone&lt;/ref&gt; y", "x y"),
        ("[http://a.b/c label] end", "label end"),
        ("[[Image:x.png|thumb|left|200px|A caption]]", "A caption"),
        ("[[Category:Ships|*]]", "Ships"),
        ("[[de:Schiff]] ship", "ship"),
        ("[[ship|boats]] and [[cats]]", "boats and cats"),
        ("{{Infobox|a}} {| t |} body", "body"),
        ("==Title== body", "body"),
        ("'''bold''' ''it'' x", "it x"),
        ("5% of $3", "5 percent of dollar 3"),
        ("one\ntwo", "onetwo"),
        ("word--tail a -- b", "word a b"),
        ("U.S. ", "S."),
        ("a &amp;lt; b", "a b"),
        ("a &amp;lt;i&amp;gt; b", "a b"),
    ],
)
def test_cleaning_rules(spark, raw, clean):
    assert one(spark, raw, cleaning.clean_markup) == clean


def test_newline_as_space(spark):
    assert one(spark, "one\ntwo", lambda c: cleaning.clean_markup(c, "space")) == "one two"
    with pytest.raises(ValueError):
        cleaning.clean_markup(F.col("t"), "drop")


def test_sentences(spark):
    docs = spark.createDataFrame([(1, "One two. \t !Three four?  "), (2, "")], "doc_id bigint, text string")
    rows = [tuple(r) for r in corpus.sentences(docs).orderBy("doc_id", "sent_pos").collect()]
    assert rows == [(1, 0, "One two"), (1, 2, "Three four")]
    assert corpus.sentences(docs, keep_empty=True).count() == 5


def test_first_sentences_both_ways(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a. b. c") for i in range(20)], "doc_id bigint, text string")
    rows = corpus.sentences(docs)
    head = [tuple(r) for r in corpus.first_sentences(rows, 7).orderBy("doc_id", "sent_pos").collect()]
    assert [r[:2] for r in head] == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (2, 0)]
    monkeypatch.setattr(corpus, "HEAD_BY_TOPK", 3)
    again = [tuple(r) for r in corpus.first_sentences(rows, 7).orderBy("doc_id", "sent_pos").collect()]
    assert again == head


def test_social_tokens(spark):
    got = one(spark, "Hi @bob :) see http://x.y/z #fun it's well-known 3,000 ...", text.social_tokens)
    assert got == ["Hi", "@bob", ":)", "see", "http://x.y/z", "#fun", "it's", "well-known", "3,000", "..."]


def test_bleu_tokens(spark):
    assert one(spark, 'He said, "3.5% (x)".', text.bleu_tokens) == [
        "He", "said", ",", '"', "3.5", "%", "(", "x", ")", '"', ".",
    ]


@pytest.mark.parametrize(
    ("word", "stemmed"),
    [
        ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("feed", "feed"),
        ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"),
        ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"),
        ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"),
        ("triplicate", "triplic"), ("hopeful", "hope"), ("goodness", "good"), ("revival", "reviv"),
        ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"),
        ("controll", "control"), ("roll", "roll"), ("dying", "die"), ("enjoy", "enjoy"),
    ],
)
def test_stems(word, stemmed):
    assert stem(word) == stemmed


def test_dump_scan(spark, tmp_path):
    pages = spark.createDataFrame([(1, "First\nbody"), (2, "#REDIRECT [[x]]"), (3, "Third")], "doc_id bigint, raw string")
    corpus_source.write_dump(pages.repartition(2), str(tmp_path / "dump"))
    got = corpus_source.read_dump(spark, str(tmp_path / "dump")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, "First\nbody"), (3, "Third")]


def test_utf16_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Élan vital. Ünder", encoding="utf-16")
    assert corpus_source.read_utf16(spark, str(tmp_path)).first()["text"] == "Élan vital. Ünder"


def test_dump_keeps_articles_that_mention_redirects_and_markup(spark, tmp_path):
    rows = [(1, "a </page> b </text> &lt; c"), (2, "#REDIRECT [[x]]")]
    path = str(tmp_path / "dump")
    corpus_source.write_dump(spark.createDataFrame(rows, "doc_id bigint, raw string"), path)
    extra = tmp_path / "more.txt"
    extra.write_text('<page><comment>#redirect made</comment><revision><text x="">kept</text></revision></page>')
    back = corpus_source.read_dump(spark, path, unescape=True).union(corpus_source.read_dump(spark, str(extra)))
    assert {(r.doc_id, r.raw) for r in back.collect()} == {(1, rows[0][1]), (None, "kept")}


def test_malformed_log_lines_are_left_out(spark):
    lines = spark.createDataFrame([("1\t2\ttext",), ("no tabs",), ("x\t1\ty",), ("",)], "value string")
    assert [tuple(r) for r in logs.parse_tagged(lines).select("run_id", "line_no", "value").collect()] == [(1, 2, "text")]
