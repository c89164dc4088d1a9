"""Text queries."""

from pyspark.sql import functions as F

from postloom.functions import text as tx
from postloom.operators.profile import by_frequency, count_tokens, describe
from postloom.operators.relational import top_n
from postloom.plans.prepare import preprocess
from postloom.registry.base import dirty_posts, posts, query, r6, table, texts

# The cleaning steps as SQL for an engine with RE2 patterns.
_S = r"[\s\x1c-\x1f]"
_W = r"[\p{L}\p{N}_]"


def _sub(text: str, pattern: str, to: str = " ") -> str:
    return f"regexp_replace({text}, '{pattern}', '{to}', 'g')"


def _unescape(text: str) -> str:
    for ref, char in (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&eacute;", "é"), ("&lt;", "<"), ("&gt;", ">")):
        text = f"replace({text}, '{ref}', '{char}')"
    return _sub(text, "&amp;?", "&")


def _strip_tags(text):
    return _sub(text, "<[^<>]*>")


def _unlink(text):
    return _sub(text, r"\[([^\[\]]*)\]\([^\(\)]*\)", r"\1")


def _brackets(text):
    return _sub(text, r"\[[^\[\]]*\]")


def _specials(text):
    return _sub(text, rf"(?:^|{_S})[&#<>{{}}\[\]+|\\:\-]+(?:{_S}|$)")


def _rules(text):
    return _sub(text, rf"(?:^|{_S})[\-=\+]{{2,}}(?:{_S}|$)")


def _collapse(text):
    return f"trim({_sub(text, _S + '+')})"


def _marks(text):
    return _sub(_sub(text, rf"\bu/{_W}+\b", "_USER_"), rf"\br/{_W}+\b", "_SUBREDDIT_")


def _unmarked(text):
    return _rules(_specials(_brackets(_unlink(_strip_tags(_unescape(text))))))


def _clean(text):
    return _collapse(_unmarked(text))


def _hyphens(text):
    return _sub(text, rf"({_W}+[\p{{L}}_])-{_S}+([\p{{L}}_]{_W}+)", r"\1\2")


def _quotes(text):
    return f"translate({text}, 'ʼ‘’´`“”', '''''''''''\"\"')"


def _urls(text):
    return _sub(text, r"\b(?:https?|ftp)://\S+|\bwww\.\S+", "_URL_")


def _normalize(text):
    return _urls(f"strip_accents(nfc_normalize({_quotes(_hyphens(text))}))")


def _impurity(text, minimum=10):
    return (
        f"case when {text} is null or length({text}) < {minimum} then 0.0 else "
        f"len(regexp_extract_all({text}, '[&#<>{{}}\\[\\]\\\\]')) / length({text}) end"
    )


_DIRTY = ("dirty_posts",)
_POSTS = ("posts",)

# One query per cleaning step, on the texts that carry markup.
_STEPS = {
    "html_unescape": (tx.html_unescape, _unescape),
    "strip_tags": (tx.strip_tags, _strip_tags),
    "unlink_markdown": (tx.unlink_markdown, _unlink),
    "strip_brackets": (tx.strip_brackets, _brackets),
    "strip_standalone_specials": (tx.strip_standalone_specials, _specials),
    "strip_rules": (tx.strip_rules, _rules),
    "collapse_whitespace": (tx.collapse_whitespace, _collapse),
    "mask_users": (tx.mask_users, lambda t: _sub(t, rf"\bu/{_W}+\b", "_USER_")),
    "mask_forums": (tx.mask_forums, lambda t: _sub(t, rf"\br/{_W}+\b", "_SUBREDDIT_")),
    "clean_text": (tx.clean, _clean),
    "clean_text_masked": (lambda c: tx.clean(c, mask_mentions=True), lambda t: _collapse(_marks(_unmarked(t)))),
    "join_hyphenated": (tx.join_hyphenated, _hyphens),
    "ascii_quotes": (tx.ascii_quotes, _quotes),
    "normalize_unicode": (tx.normalize_unicode, lambda t: f"nfc_normalize({t})"),
    "strip_accents": (tx.strip_accents, lambda t: f"strip_accents({t})"),
    "mask_urls": (tx.mask_urls, _urls),
    "normalize_text": (tx.normalize_text, _normalize),
}


def _register(name, step, sql):
    @query(name, f"select id, {sql('text')} result from dirty_posts", _DIRTY)
    def run(spark, sf_dir):
        return dirty_posts(spark, sf_dir).select("id", step(F.col("text")).alias("result"))


for _name, (_step, _sql) in _STEPS.items():
    _register(_name, _step, _sql)


@query("strip_markup_pages", f"select page_id, {_clean('html')} result from pages")
def strip_markup_pages(spark, sf_dir):
    return texts(spark, sf_dir, "pages").select("page_id", tx.clean(F.col("html")).alias("result"))


@query(
    "preprocess_posts",
    f"select id, text, {_normalize(_clean('text'))} clean_text from dirty_posts",
    _DIRTY,
)
def preprocess_posts(spark, sf_dir):
    return preprocess(dirty_posts(spark, sf_dir))


@query("impurity", f"select id, round({_impurity('text', 20)}, 6) impurity from dirty_posts", _DIRTY)
def impurity(spark, sf_dir):
    return dirty_posts(spark, sf_dir).select("id", r6(tx.impurity(F.col("text"), 20)).alias("impurity"))


@query(
    "impurity_top10",
    f"""select id, round({_impurity('text')}, 6) impurity from dirty_posts
        order by {_impurity('text')} desc, id limit 10""",
    _DIRTY,
)
def impurity_top10(spark, sf_dir):
    scored = dirty_posts(spark, sf_dir).withColumn("raw", tx.impurity(F.col("text")))
    return top_n(scored, "raw", "id").select("id", r6("raw").alias("impurity"))


@query(
    "impurity_top10_clean",
    f"""select id, round(impurity, 6) impurity from (select id, {_impurity('c', 20)} impurity
        from (select id, {_clean('text')} c from dirty_posts)) order by impurity desc, id limit 10""",
    _DIRTY,
)
def impurity_top10_clean(spark, sf_dir):
    cleaned = dirty_posts(spark, sf_dir).select("id", tx.clean(F.col("text")).alias("c"))
    scored = cleaned.withColumn("raw", tx.impurity(F.col("c"), 20))
    # Sorting needs the score only: the text is not carried into the sort.
    return top_n(scored.select("id", "raw"), "raw", "id").select("id", r6("raw").alias("impurity"))


_COUNT = r"len(regexp_extract_all({}, '[^\s\x1c-\x1f]+'))"


@query(
    "word_count",
    f"select id, {_COUNT.format('selftext')} text_word_count, {_COUNT.format('title')} title_word_count from posts",
    _POSTS,
)
def word_count(spark, sf_dir):
    return posts(spark, sf_dir).select(
        "id",
        tx.word_count(F.col("selftext")).cast("long").alias("text_word_count"),
        tx.word_count(F.col("title")).cast("long").alias("title_word_count"),
    )


def _describe_sql(column):
    return f"""select '{column}' "column", cast(count({column}) as double) "count", round(avg({column}),6) mean,
        round(stddev_samp({column}),6) std, cast(min({column}) as double) "min",
        round(quantile_cont({column},0.25),6) q25, round(quantile_cont({column},0.5),6) q50,
        round(quantile_cont({column},0.75),6) q75, cast(max({column}) as double) "max" from w"""


@query(
    "word_count_describe",
    f"""select * from (with w as (select {_COUNT.format('selftext')} text_word_count,
        {_COUNT.format('title')} title_word_count from posts)
        {_describe_sql('text_word_count')} union all {_describe_sql('title_word_count')})""",
    _POSTS,
)
def word_count_describe(spark, sf_dir):
    out = describe(word_count(spark, sf_dir), ["text_word_count", "title_word_count"])
    return out.select("column", "count", r6("mean").alias("mean"), r6("std").alias("std"), "min",
                      r6("q25").alias("q25"), r6("q50").alias("q50"), r6("q75").alias("q75"), "max")


_TAGS = r"regexp_extract_all(html, '<[\p{L}\p{N}_/]*>')"


@query("extract_tags", f"select page_id, array_to_string({_TAGS}, ' ') tags, len({_TAGS}) n from pages")
def extract_tags(spark, sf_dir):
    tags = tx.extract_tags(F.col("html"))
    return table(spark, sf_dir, "pages").select(
        "page_id", F.array_join(tags, " ").alias("tags"), F.size(tags).cast("long").alias("n")
    )


@query(
    "tag_counts",
    f"select token, count(*) freq from (select unnest({_TAGS}) token from pages) group by 1 having count(*) >= 2",
)
def tag_counts(spark, sf_dir):
    return by_frequency(count_tokens(table(spark, sf_dir, "pages"), "html", tx.extract_tags))


@query(
    "token_counts",
    r"""select token, count(*) freq from (select unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) token
        from documents) group by 1 having count(*) >= 2""",
)
def token_counts(spark, sf_dir):
    return by_frequency(count_tokens(texts(spark, sf_dir), "text", tx.words))


@query("combine_title_text", "select id, title || ' [SEP] ' || selftext combined from posts", _POSTS)
def combine_title_text(spark, sf_dir):
    return posts(spark, sf_dir).select(
        "id", tx.combine_title_text(F.col("title"), F.col("selftext")).alias("combined")
    )
