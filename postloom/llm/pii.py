"""Personal data: base patterns, and more spans by weak supervision, as DataFrame expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Kind of the spans that the classifier adds.
ADDED = "other"

# Fixed patterns.  A match can only begin where the previous one ended or where its first run
# begins, and possessive runs match what greedy ones do here; so no text takes quadratic time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

#: A candidate is a whole run between blanks and these signs that has a digit or an ``@``.
_EDGE = r"\s\"'(),;<>=:\[\]{}|"
CANDIDATE = rf"(?:\G|(?<![^{_EDGE}]))[^{_EDGE}0-9@]*+[0-9@][^{_EDGE}]*+"
#: Code points of context kept before a candidate.
CONTEXT = 40
#: Code points of a chunk of text that is masked.
CHUNK = 4096

# Word lists of the labelers (fixed values).
PRIVATE_WORDS = [
    "password", "passwd", "pwd", "passwort", "token", "secret", "key", "apikey", "credential", "login", "ssn", "iban",
    "passport", "account", "card", "phone", "tel", "telephone", "mobile", "call", "fax", "email", "mail", "contact", "ip",
]
PUBLIC_WORDS = [
    "version", "license", "licence", "chapter", "page", "section", "figure", "fig", "table", "volume", "vol", "no", "article",
    "part", "step", "year", "in", "since", "until", "from", "to", "by", "of", "about", "apache", "cc", "sa", "nc",
]
MAIL_HOSTS = ["gmail.", "yahoo.", "hotmail.", "outlook.", "proton", "web.de", "gmx.", "mail"]
PUBLIC_TOKENS = ["mp3", "mp4", "3d", "2d", "4k", "1st", "2nd", "3rd", "24/7", "utf-8", "covid-19", "h2o", "co2", "w3c", "i18n", "b2b"]

N_LABELERS = 7


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, not at each place where a lambda names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """0, then what ``merge`` makes of 0 and the first values up to each one, from an array of ints.

    A growing array is copied at each step, so the array is cut into about as many chunks as a chunk has
    values: n ** 1.5 copies in all, which is a second for some 100 000 values.
    """
    def prefixes(chunk):
        return F.aggregate(chunk, F.array(F.lit(0)), lambda done, x: F.concat(done, F.array(merge(F.element_at(done, -1), x))))

    def chunks(v):
        size = F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), size), lambda i: prefixes(F.slice(v, i + 1, size)))

    def put_together(parts):
        def shifted(before):
            rest = F.zip_with(parts, F.slice(before, F.lit(1), F.size(parts)), lambda p, b: F.transform(F.slice(p, F.lit(2), F.size(p)), lambda x: merge(b, x)))
            return F.concat(F.array(F.lit(0)), F.flatten(rest))

        return _with(prefixes(F.transform(parts, lambda p: F.element_at(p, -1))), shifted)

    return _with(values, lambda v: _with(chunks(v), put_together))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _pieces(text: Column, pattern: str) -> Column:
    """(start, end, token, before) of every match, leftmost and non-overlapping, in code points."""
    cut = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.zip_with(found, F.slice(cut, F.lit(1), F.size(found)), lambda f, c: F.struct(
        f.alias("token"), F.char_length(c).alias("gap"), F.char_length(f).alias("long"), F.right(c, F.lit(CONTEXT)).alias("before")))

    def placed(matches):
        ends = running(F.transform(matches, lambda m: m["gap"] + m["long"]), _sum)
        return F.zip_with(matches, F.slice(ends, F.lit(1), F.size(matches)), lambda m, at: F.struct(
            (at + m["gap"]).alias("start"), (at + m["gap"] + m["long"]).alias("end"), m["token"].alias("token"), m["before"].alias("before")))

    return _with(zipped, placed)


def _digits(token: Column) -> Column:
    return F.regexp_replace(token, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def one(d, i):
        twice = d.cast("int") * (i % 2 + 1)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), one), F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, token: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(token, r"\."), lambda p: F.regexp_like(p, F.lit("^0*([0-9]|[0-9]{2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))
    n = F.length(_digits(token))
    return n.between(14, 19) & _luhn(_digits(token)) if kind == "card" else n.between(10, 15)


def base_spans(text: Column, kind: str) -> Column:
    """The spans (start, end, token, before) of one base kind; failing matches are dropped."""
    none = F.expr("cast(array() as array<struct<start:int,end:int,token:string,before:string>>)")
    can = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else F.regexp_like(text, F.lit("[0-9]"))
    return F.when(can, F.filter(_pieces(text, PATTERNS[kind]), lambda s: _holds(kind, s["token"]))).otherwise(none)


def candidates(text: Column) -> Column:
    none = F.expr("cast(array() as array<struct<start:int,end:int,token:string,before:string>>)")
    return F.when(F.regexp_like(text, F.lit("[0-9@]")), _pieces(text, CANDIDATE)).otherwise(none)


# --- labelers and features: expressions over a token and what stands before it --------


def _word_before(before: Column) -> Column:
    return F.lower(F.regexp_extract(before, r"(\p{L}{1,20})[^\p{L}]{0,8}$", 1))


def _vote(yes: Column, value: int) -> Column:
    return F.when(yes, F.lit(value)).otherwise(F.lit(0))


def votes(token: Column, before: Column) -> list[Column]:
    """1: personal, -1: not, 0: abstains.  Patterns, word lists and context, in this order."""
    word, low = _word_before(before), F.lower(token)
    trimmed = F.rtrim(low, F.lit(".!?"))
    whole = F.lit(False)
    for kind in ("email", "ip", "card"):
        plain = PATTERNS[kind][PATTERNS[kind].index("))") + 2:]
        whole = whole | (F.regexp_like(trimmed, F.lit(f"^{plain}$")) & _holds(kind, trimmed))
    return [
        _vote(whole, 1),
        _vote(F.regexp_like(trimmed, F.lit(r"^(?=.*[a-z])(?=.*[0-9])[0-9a-z_+/-]{14,}$")), 1),
        _vote(F.regexp_like(trimmed, F.lit(r"^[^a-z@]{0,2}[0-9]{1,4}([.,][0-9]{1,3})?[a-z%°€$]{0,3}$")), -1),
        _vote(F.arrays_overlap(F.array(trimmed), F.array(*map(F.lit, PUBLIC_TOKENS))), -1),
        F.when(F.contains(token, F.lit("@")) & F.exists(F.array(*map(F.lit, MAIL_HOSTS)), lambda h: F.contains(low, h)), F.lit(1)).otherwise(F.lit(0)),
        F.when(word.isin(PRIVATE_WORDS), F.lit(1)).when(word.isin(PUBLIC_WORDS), F.lit(-1)).otherwise(F.lit(0)),
        _vote(F.length(_digits(token)) >= 9, 1),
    ]


def features(token: Column, before: Column) -> list[Column]:
    """0/1 features of the final classifier; few enough patterns to sum up exactly."""
    n, d = F.char_length(token), F.length(_digits(token))
    share, word = d / n, _word_before(before)
    trimmed = F.rtrim(F.lower(token), F.lit(".!?"))
    yes = [
        F.lit(True), n > 4, n > 8, n > 12, n > 17, share > 0.1, share > 0.45, share > 0.9,
        F.contains(token, F.lit("@")), F.regexp_like(token, F.lit(r"@[^@]+\.[A-Za-z]")), F.regexp_count(token, F.lit(r"\.[0-9]")) >= 3,
        F.regexp_like(trimmed, F.lit("[a-z].*[0-9].*[a-z]|[0-9].*[a-z].*[0-9]")), F.regexp_like(trimmed, F.lit("[^a-z0-9]")),
        word.isin(PRIVATE_WORDS), word.isin(PUBLIC_WORDS),
    ]
    return [y.cast("int") for y in yes]


@dataclass
class SpanModel:
    """Estimated reliabilities of the labelers and the weights of the span classifier."""

    prior: float
    right: list[float]
    weights: list[float]


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns and their counts.

    Returns the prior, P(vote | class) as [class, labeler, vote + 1] and P(personal | pattern).
    """
    votes_of = np.array([p for p, _ in patterns]) + 1
    count = np.array([n for _, n in patterns], float)
    prior = 0.5
    table = np.full((2, N_LABELERS, 3), 0.0)
    table[1], table[0] = [0.1, 0.5, 0.4], [0.3, 0.65, 0.05]
    each = np.arange(N_LABELERS)
    for _ in range(rounds):
        log = np.log([1 - prior, prior])[:, None] + np.log(table[:, each[None, :], votes_of]).sum(2)
        soft = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        prior = float(np.clip((soft * count).sum() / count.sum(), 0.01, 0.99))
        for y, w in ((1, soft * count), (0, (1 - soft) * count)):
            for v in range(3):
                table[y, :, v] = ((votes_of == v) * w[:, None]).sum(0) + (0.1, 0.5, 0.4)[v if y else 2 - v]
        table /= table.sum(2, keepdims=True)
    return prior, table, soft


def fit_classifier(rows: list[tuple[tuple[int, ...], float, float]], ridge: float = 1e-2, rounds: int = 30) -> list[float]:
    """Logistic weights from (features, rows, sum of soft labels), by Newton steps."""
    x = np.array([f for f, _, _ in rows], float)
    n, y = np.array([n for _, n, _ in rows]), np.array([s for _, _, s in rows])
    scale = n.sum()
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - n * p) / scale - ridge * w
        curve = (x * (n * p * (1 - p) / scale)[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(curve, gradient)
    return w.tolist()


def fit_pii(df: DataFrame, text: str = "text") -> SpanModel | None:
    """Fit the label model and the classifier on all candidates of all rows; None without any.

    Both need only sums over rows: candidates by vote and feature pattern.  One aggregation with
    partial sums makes them; the driver gets at most 3 ** 7 times 2 ** 14 patterns in principle, and
    about a hundred in fact, since both follow from the shape of a token.
    """
    rows = df.where(F.col(text).isNotNull()).select(F.explode(candidates(F.col(text))).alias("c"))
    v = F.array(*votes(F.col("c.token"), F.col("c.before")))
    f = F.array(*features(F.col("c.token"), F.col("c.before")))
    seen = [(tuple(r["v"]), tuple(r["f"]), r["n"]) for r in rows.select(v.alias("v"), f.alias("f")).groupBy("v", "f").agg(F.count("*").alias("n")).collect()]
    if not seen:
        return None
    seen.sort()
    by_vote: dict = {}
    for vote, _, n in seen:
        by_vote[vote] = by_vote.get(vote, 0) + n
    patterns = sorted(by_vote.items())
    prior, table, soft = estimate(patterns)
    label = {p: float(s) for (p, _), s in zip(patterns, soft, strict=True)}
    by_feature: dict = {}
    for vote, feature, n in seen:
        done = by_feature.get(feature, (0, 0.0))
        by_feature[feature] = (done[0] + n, done[1] + n * label[vote])
    weights = fit_classifier([(k, float(n), s) for k, (n, s) in sorted(by_feature.items())])
    right = [float(prior * table[1, i, 2] + (1 - prior) * table[0, i, 0]) for i in range(N_LABELERS)]
    return SpanModel(prior, right, weights)


def find_pii(df: DataFrame, model: SpanModel | None, text: str = "text") -> DataFrame:
    """Every row of ``df`` with base and spans, arrays of (start, end, kind) by start, then kind.

    ``base`` has the matches of the fixed patterns, ``spans`` these and every candidate that the
    classifier finds personal and that overlaps none of them.  Positions are code points, the end
    exclusive.  A null or empty text has none.  No row moves and no column is read but the text;
    input columns named base or spans are replaced.
    """
    kept = [c for c in df.columns if c not in ("base", "spans")]
    whole = F.coalesce(F.col(text), F.lit(""))

    def ranked(rank):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"))

    tagged = [F.transform(base_spans(whole, kind), ranked(i)) for i, kind in enumerate(KINDS)]
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.sort_array(F.concat(*tagged)).alias("_base"))
    if model is None:
        more = F.expr("cast(array() as array<struct<start:int,rank:int,end:int>>)")
    else:
        def personal(c):
            score = F.lit(0.0)
            for w, x in zip(model.weights, features(c["token"], c["before"]), strict=True):
                score = score + x * F.lit(float(w))
            return score >= 0

        chosen = F.transform(F.filter(candidates(whole), personal), lambda c: F.struct(
            c["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), c["end"].alias("end"),
            (c["end"] - F.char_length(c["token"]) + F.char_length(F.rtrim(c["token"], F.lit(".!?")))).alias("trimmed")))
        more = _free(F.col("_base"), chosen)
    names = F.array(*map(F.lit, (*KINDS, ADDED)))

    def named(spans):
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(names, s["rank"] + 1).alias("kind")))

    return rows.select(
        *[F.col(f"`{c}`") for c in kept], named(F.col("_base")).alias("base"),
        named(F.sort_array(F.concat("_base", more))).alias("spans"),
    )


def _free(base: Column, chosen: Column) -> Column:
    """The chosen candidates, trimmed, that no base span overlaps.

    All are put in order once.  A candidate is met by an earlier base span if the greatest end before it lies
    behind its start, and by a later one if the next base span begins before its end.
    """
    far = 2**31 - 1
    both = F.sort_array(F.concat(
        F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["rank"].alias("rank"), b["end"].alias("end"), b["end"].alias("trimmed"))), chosen))

    def judged(spans):
        is_base = lambda s: s["rank"] < len(KINDS)
        reached = running(F.transform(spans, lambda s: F.when(is_base(s), s["end"]).otherwise(0)), F.greatest)
        # Counted from the far end, so that the nearest start is the greatest number.
        later = running(F.transform(F.reverse(spans), lambda s: F.when(is_base(s), far - s["start"]).otherwise(0)), F.greatest)
        seen = F.zip_with(
            F.zip_with(spans, F.slice(reached, F.lit(1), F.size(spans)), lambda s, r: F.struct(s.alias("s"), r.alias("reached"))),
            F.reverse(F.slice(later, F.lit(1), F.size(spans))),
            lambda x, n: F.struct(x["s"].alias("s"), (~is_base(x["s"]) & (x["reached"] <= x["s"]["start"]) & (far - n >= x["s"]["end"])).alias("free")))
        return F.transform(F.filter(seen, lambda x: x["free"]), lambda x: F.struct(
            x["s"]["start"].alias("start"), x["s"]["rank"].alias("rank"), x["s"]["trimmed"].alias("end")))

    return F.when(F.size(chosen) > 0, _with(both, judged)).otherwise(F.expr("cast(array() as array<struct<start:int,rank:int,end:int>>)"))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def mask(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; overlapping spans merge.

    ``spans`` are in order of their start.  The text is cut into chunks first: a substring is searched from the
    beginning of its string, and must not walk over the whole text for each span.
    """
    def passage(chunks, start, end):
        first, last = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
        head = F.coalesce(F.substring(F.get(chunks, first), start % CHUNK + 1, F.least(end - start, F.lit(CHUNK))), F.lit(""))
        tail = F.coalesce(F.substring(F.get(chunks, last), F.lit(1), end % CHUNK), F.lit(""))
        between = F.array_join(F.slice(chunks, first + 2, last - first - 1), "")
        return F.when(first == last, head).otherwise(F.concat(head, between, tail))

    def put_together(given):
        def joined_up(done):
            parts = F.zip_with(given["spans"], F.slice(done, F.lit(1), F.size(given["spans"])), lambda s, at: F.when(
                s["start"] >= at, F.concat(passage(given["chunks"], at, s["start"]), F.lit("<"), s["kind"], F.lit(">"))).otherwise(F.lit("")))
            return F.concat(F.array_join(parts, ""), passage(given["chunks"], F.element_at(done, -1), given["size"]))

        return _with(running(F.transform(given["spans"], lambda s: s["end"]), F.greatest), joined_up)

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    given = F.struct(spans.alias("spans"), chunks.alias("chunks"), F.char_length(text).alias("size"))
    return F.when(F.size(spans) > 0, _with(given, put_together)).otherwise(text)
