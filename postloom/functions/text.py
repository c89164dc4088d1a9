"""Text functions as Column expressions.

All patterns carry ``(?U)``: without it Java's ``\\s \\w \\b`` know ASCII only.  The
whitespace class adds U+001C-U+001F, which Java does not count as white space.

Three functions need tables that Spark has no built-in for (HTML5 entities, Unicode
normal forms).  They run as Arrow UDFs, and only rows the JVM cannot handle are handed
over: those with a character reference, those that may not be composed already, and those
with a character whose decomposition is not a single character.
"""

import html
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The cleaning patterns and the characters counted as impure.
SPACE = r"[\s\x1c-\x1f]"
TAG = r"<[^<>]*>"
MARKDOWN_LINK = r"\[([^\[\]]*)\]\([^\(\)]*\)"
BRACKETS = r"\[[^\[\]]*\]"
STANDALONE_SPECIALS = rf"(?U)(?:^|{SPACE})[&#<>{{}}\[\]+|\\:-]{{1,}}(?:{SPACE}|$)"
RULES = rf"(?U)(?:^|{SPACE})[\-=\+]{{2,}}(?:{SPACE}|$)"
WHITE = rf"(?U){SPACE}+"
WORD = r"(?U)[^\s\x1c-\x1f]+"
USER = r"(?U)\bu/\w+\b"
FORUM = r"(?U)\br/\w+\b"
SIMPLE_TAG = r"(?U)<[\w/]*>"
SUSPICIOUS = r"[&#<>{}\[\]\\]"
# The word boundary and the possessive quantifier only spare hopeless attempts.
HYPHENATED = rf"(?U)\b(\w{{2,}}+(?<!\d))-{SPACE}+((?!\d)\w{{2,}})"
_LABEL = r"[\p{L}\p{N}]++(?:-++[\p{L}\p{N}]++)*+"
_HOST = rf"{_LABEL}(?:\.{_LABEL})++(?<=\.\p{{L}}{{2,24}})"
# With a scheme or ``wwwN.``: log-in, host, port and path; without: host and a short path, as in short links.
URL = (
    rf"(?iU)(?<![\w/.@])(?:(?:https?|ftp)://(?:[^\s/@]++@)?{_LABEL}(?:\.{_LABEL})*+|www\d{{0,3}}\.{_HOST})(?::\d{{2,5}})?(?:[/?#]\S*+)?"
    rf"|(?<![\w/.@]){_HOST}/[^\s.,?!'\"|+)]{{2,12}}(?![\w?!+&/])"
)
FANCY_QUOTES = "ʼ‘’´`“”"
ASCII_QUOTES = "'''''\"\""
TOKEN = r"[\p{L}\p{N}]+"
SEPARATOR = " [SEP] "
REFERENCE = r"&[#A-Za-z]"
# All but: Latin without combining marks, plain Cyrillic, general punctuation.
MAYBE_DECOMPOSED = r"[\u0300-\u03ff\u0483-\u0489\u0500-\u2001\u2070-\x{10ffff}]"


def _without_marks(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _single_character_forms():
    """For the scripts up to Cyrillic and for dashes and quotes: the characters that lose
    their marks by a one-to-one replacement, those that vanish, and a pattern for all
    characters outside these (a few coarse ranges, which match much faster than exact ones)."""
    replaced, vanishing, spans = {}, [], []
    for code in [*range(0x80, 0x500), *range(0x2000, 0x2024)]:
        char = chr(code)
        bare = _without_marks(char)
        if not bare:
            vanishing.append(char)
        elif len(bare) > 1:
            if not spans or code - spans[-1][1] > 0x30:
                spans.append([code, code])
            spans[-1][1] = code
        elif bare != char:
            replaced[char] = bare
    spans += [[0x500, 0x1FFF], [0x2024, 0x10FFFF]]
    needs_all = "[" + "".join(rf"\x{{{low:x}}}-\x{{{high:x}}}" for low, high in spans) + "]"
    return "".join(replaced) + "".join(vanishing), "".join(replaced.values()), needs_all


MARKED, BARE, NEEDS_DECOMPOSITION = _single_character_forms()


@F.arrow_udf(StringType())
def _unescape(texts: pa.Array) -> pa.Array:
    return pa.array([t if t is None else html.unescape(t) for t in texts.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def _compose(texts: pa.Array) -> pa.Array:
    return pa.array(
        [t if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string()
    )


@F.arrow_udf(StringType())
def _drop_marks(texts: pa.Array) -> pa.Array:
    """Decompose and leave out combining marks."""
    if texts.null_count == len(texts):
        return texts
    plain = [t if t is None else unicodedata.normalize("NFKD", t) for t in texts.to_pylist()]
    seen = set("".join(t for t in plain if t))
    marks = {ord(c): None for c in seen if unicodedata.combining(c)}
    return pa.array([t if t is None else t.translate(marks) for t in plain], pa.string())


def _where(condition: Column, fn, text: Column) -> Column:
    """Apply an Arrow UDF to the rows that satisfy ``condition``; others are sent as null."""
    return F.coalesce(fn(F.when(condition, text)), text)


def html_unescape(text: Column) -> Column:
    """HTML5 character references to characters, in one pass."""
    return _where(text.rlike(REFERENCE), _unescape, text)


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, TAG, " ")


def unlink_markdown(text: Column) -> Column:
    """``[label](target)`` becomes ``label``."""
    return F.regexp_replace(text, MARKDOWN_LINK, "$1")


def strip_brackets(text: Column) -> Column:
    return F.regexp_replace(text, BRACKETS, " ")


def strip_standalone_specials(text: Column) -> Column:
    """Runs of special characters that stand alone; ``#cool`` is kept."""
    return F.regexp_replace(text, STANDALONE_SPECIALS, " ")


def strip_rules(text: Column) -> Column:
    """Standalone rulers such as ``---`` or ``==``."""
    return F.regexp_replace(text, RULES, " ")


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, WHITE, " "))


def mask_users(text: Column) -> Column:
    return F.regexp_replace(text, USER, "_USER_")


def mask_forums(text: Column) -> Column:
    return F.regexp_replace(text, FORUM, "_SUBREDDIT_")


def clean(text: Column, mask_mentions: bool = False) -> Column:
    """Remove markup and noise.  Mentions are masked only on request."""
    for step in (html_unescape, strip_tags, unlink_markdown, strip_brackets,
                 strip_standalone_specials, strip_rules):
        text = step(text)
    if mask_mentions:
        text = mask_forums(mask_users(text))
    return collapse_whitespace(text)


def join_hyphenated(text: Column) -> Column:
    """``inter- national`` becomes ``international``."""
    return F.regexp_replace(text, HYPHENATED, "$1$2")


def ascii_quotes(text: Column) -> Column:
    return F.translate(text, FANCY_QUOTES, ASCII_QUOTES)


def normalize_unicode(text: Column) -> Column:
    """NFC."""
    return _where(text.rlike(MAYBE_DECOMPOSED), _compose, text)


def strip_accents(text: Column) -> Column:
    """Compatibility decomposition without combining marks.

    Both act on each character by itself, so a translation table does for most rows and only
    the others leave the JVM.
    """
    return F.coalesce(_drop_marks(F.when(text.rlike(NEEDS_DECOMPOSITION), text)), F.translate(text, MARKED, BARE))


def mask_urls(text: Column) -> Column:
    """URLs with a scheme or ``www.``, ``www2.`` and so on, and short links such as ``bit.ly/abc12``.

    Case does not matter.  Signs after a bare host stay; a path runs to the next white space.
    """
    return F.regexp_replace(text, URL, "_URL_")


def normalize_text(text: Column) -> Column:
    """Rejoin words, unify quotes, drop accents, mask URLs.

    Composing first would not change the decomposed result (NFKD of NFC equals NFKD).
    """
    return mask_urls(strip_accents(ascii_quotes(join_hyphenated(text))))


def impurity(text: Column, min_len: int = 10) -> Column:
    """Share of suspicious characters; 0 for null or short text."""
    share = F.regexp_count(text, F.lit(SUSPICIOUS)) / F.nullif(F.length(text), F.lit(0))
    return F.when(text.isNull() | (F.length(text) < min_len), F.lit(0.0)).otherwise(share)


def word_count(text: Column) -> Column:
    """Number of pieces between white space."""
    return F.regexp_count(text, F.lit(WORD))


def extract_tags(text: Column) -> Column:
    """All bare tags such as ``<lb>``, as an array."""
    return F.regexp_extract_all(text, F.lit(SIMPLE_TAG), F.lit(0))


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, as an array."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def combine_title_text(title: Column, text: Column) -> Column:
    """``title [SEP] text``; null if either is null."""
    return F.concat(title, F.lit(SEPARATOR), text)
