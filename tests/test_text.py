import html
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from postloom.functions import text as tx
from postloom.plans.prepare import keep_clean, preprocess

EXAMPLE = """
Yesterday I watched [the second teaser](https://video.example/watch?v=Qw3rTy)
and then drew up a list of duels.
<lb>These are mine:<lb><lb>[](/left)[](/right) Otter<lb>[](/left)[](/again)
Doctor Heron<lb>"""

GOLDEN = [
    (EXAMPLE, "Yesterday I watched the second teaser and then drew up a list of duels. "
              "These are mine: Otter Doctor Heron"),
    ("a &amp; b &lt;tab&gt; c", "a b c"),
    ("x &amp;amp; y", "x &amp; y"),
    ("note [0] and [a [b] c]", "note and [a c]"),
    ("see [t](u(v)w) end", "see (u(v)w) end"),
    ("a &# b #cool --- c == d : e - - f", "a b #cool c d e - f"),
    ("one\u00a0\u2003two\tthree", "one two three"),
    ("u/someone in r/place", "u/someone in r/place"),
    ("1 < 2 > 0", "1 0"),
    ("- lead and trail -", "lead and trail"),
    ("", ""),
    ("   ", ""),
    ("caf&eacute &ampx &apos;q&apos;", "café &x 'q'"),
    ("a -- -- b", "a b"),
    ("\\ | {} + text", "| + text"),
    ("x\u001cy", "x y"),
    ("end --\n", "end"),
    ("a\u2028b <x\ny> c", "a b c"),
    ("rİ [é](x)", "rİ é"),
    (None, None),
]


def apply(spark, fn, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("t"))).collect()]


def test_clean_golden(spark):
    got = apply(spark, tx.clean, [g[0] for g in GOLDEN])
    assert got == [g[1] for g in GOLDEN]


def test_impurity(spark):
    raw = apply(spark, tx.impurity, [EXAMPLE, None, "<<<", "a" * 10, "<" * 10])
    assert raw == pytest.approx([sum(c in "&#<>{}[]\\" for c in EXAMPLE) / len(EXAMPLE), 0, 0, 0, 1])
    assert apply(spark, lambda c: tx.impurity(tx.clean(c)), [EXAMPLE]) == [0.0]


def test_masks_are_optional(spark):
    masked = apply(spark, lambda c: tx.clean(c, mask_mentions=True), ["ask u/someone in r/place now"])
    assert masked == ["ask _USER_ in _SUBREDDIT_ now"]


def test_unescape_equals_html_module(spark):
    hostile = ["&notit; &NotEqualTilde; &#x41;&#65 &#0; &bogus; & &amp", "&amp;lt;", "no reference", "&copy2024", None]
    assert apply(spark, tx.html_unescape, hostile) == [t if t is None else html.unescape(t) for t in hostile]


def bare(text):
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def test_unicode_functions_on_every_character(spark):
    chars = ["e" + chr(i) for i in range(1, 0x11000) if not 0xD800 <= i <= 0xDFFF]
    assert apply(spark, tx.strip_accents, chars) == [bare(c) for c in chars]
    assert apply(spark, tx.normalize_unicode, chars) == [unicodedata.normalize("NFC", c) for c in chars]


def test_strip_accents_mixed_rows(spark):
    mixed = ["déjà vu", "ﬁne ½ …", "한글 é", "plain", "", None]
    assert apply(spark, tx.strip_accents, mixed) == [t if t is None else bare(t) for t in mixed]


def test_join_hyphenated(spark):
    pattern = re.compile(r"(\w{2,}(?<!\d))-\s+((?!\d)\w{2,})")
    texts = ["inter- national", "12- ab", "ab- 12", "a- bc", "ab-\n cd- ef", "é́té- là", "x1- yz a2b- cd", "ab-cd", None]
    want = [t if t is None else pattern.sub(r"\1\2", t) for t in texts]
    assert apply(spark, tx.join_hyphenated, texts) == want


def test_normalize_text(spark):
    got = apply(spark, tx.normalize_text, ["“it’s” inter- national café http://a.b/c?d or www.x.org/y.", None])
    assert got == ["\"it's\" international cafe _URL_ or _URL_", None]


def test_mask_urls(spark):
    texts = [
        "(https://a.com), HTTPS://A.COM/x bit.ly/abc12 www2.b.org/y", "mail x.y@mail8.example.com, a/b, 1/2, and/or, e.g. i.e./x",
        "http://user:pw@host.example.org:8080/p?q=1#f end", "see www.e.org! http://a.com?x=1 ftp://f.net.", "no 3.14/2 version.2/10 www.x", None,
    ]
    assert apply(spark, tx.mask_urls, texts) == [
        "(_URL_), _URL_ _URL_ _URL_", texts[1], "_URL_ end", "see _URL_! _URL_ _URL_.", texts[4], None,
    ]


def test_word_count_tags_and_words(spark):
    assert apply(spark, tx.word_count, ["a  b c\n", "", " ", None]) == [3, 0, 0, None]
    assert apply(spark, tx.extract_tags, ["<lb>x</b> <a href=1> <>"]) == [["<lb>", "</b>", "<>"]]
    assert apply(spark, tx.words, ["Émile's 2nd"]) == [["émile", "s", "2nd"]]


def test_combine_null(spark):
    rows = spark.createDataFrame([("a", "b"), (None, "b"), ("a", None)], "t string, s string")
    got = [r[0] for r in rows.select(tx.combine_title_text(F.col("t"), F.col("s"))).collect()]
    assert got == ["a [SEP] b", None, None]


def test_preprocess_and_rename(spark):
    out = keep_clean(preprocess(spark.createDataFrame([("1", "<lb>café", 0.5)], "id string, text string, impurity double")))
    assert out.columns == ["id", "raw_text", "text"]
    assert out.first()["text"] == "cafe"


def test_only_changing_rows_go_to_python(spark):
    """ASCII text passes the Arrow step as a finished value."""
    plan = preprocess(spark.createDataFrame([("x",)], "text string"))._jdf.queryExecution().toString()
    assert plan.count("ArrowEvalPython [_drop_marks") >= 1
    assert "CASE WHEN RLIKE" in plan


def test_works_on_a_stream(spark, tmp_path):
    spark.createDataFrame([("a <b> é",)], "text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string").parquet(str(tmp_path / "in"))
    done = preprocess(stream).writeStream.format("memory").queryName("cleaned").start()
    done.processAllAvailable()
    done.stop()
    assert spark.table("cleaned").first()["clean_text"] == "a e"
