"""Base spans against Python's re; the method's spans by what they must and must not hold."""

import random

import time

import pytest
from llm import brute
from pyspark.sql import functions as F

from postloom.llm.pii import CHUNK, SpanModel, estimate, find_pii, fit_pii, joined, mask, running

TEXTS = [
    None, "", "none", "a@b.c_d@e.f x@y", "é a.b%c@mail-1.example.com. 😀 z@z.zz", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 1.2.3",
    "4041894974608795 4041-8949-7460-8795 4041 8949 7460 8794 12345678901234", "+1 (988) 555-2485, +12345 +49-30-1234567890123 ++1 (988) 555-2485(",
    "@@..@a.b a@a@a.b .@.-.b-", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0", "+1 (((((((((((", "42.144.35.254 4041894974608795\n+1 (988) 555-2485",
    "x" * 50_000, "1 " * 30_000, "1." * 20_000, "a@" * 20_000, "9" * 50_000, "+1" + "(" * 20_000, "a.b@c.d," * 500,
]


def random_texts(n=150):
    draw = random.Random(7)
    return ["".join(draw.choice("ab0123456789..@@+-  ()é_%") for _ in range(draw.randint(0, 120))) for _ in range(n)]


def test_base_spans(spark):
    rows = list(enumerate(TEXTS + random_texts()))
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(4)
    got = dict(find_pii(df, None).select("doc_id", joined(F.col("base"))).collect())
    assert got == {i: brute.base_spans(t) for i, t in rows}


@pytest.fixture(scope="module")
def labelled(spark):
    draw, rows = random.Random(1), []
    digest = lambda n: "".join(draw.choice("0123456789abcdef") for _ in range(n))
    for i in range(300):
        rows.append((i, draw.choice([
            f"words and password={digest(18)} more", f'the token = "{digest(40)}" of', f"Licensed, Version {draw.randint(1, 9)}.0. In {draw.randint(1900, 2020)} it",
            f"mail me@host{i}.example.com now", f"chapter {i} section {i % 7}", "plain words only",
        ])))
    return spark.createDataFrame(rows, "doc_id int, text string")


def test_method_adds_secrets_and_leaves_versions(spark, labelled):
    model = fit_pii(labelled)
    rows = find_pii(labelled, model).collect()
    for r in rows:
        others = [s for s in r.spans if s.kind == "other"]
        assert len(others) == ("password" in r.text or "token" in r.text), r
        assert [s for s in r.spans if s.kind != "other"] == r.base
    assert model.right[0] > 0 and 0 < model.prior < 1


def test_mask(spark):
    df = spark.createDataFrame([(1, "é a@b.cc, 1.2.3.4!", "x"), (2, None, "y"), (3, "z", None)], "spans int, text string, base string")
    out = find_pii(df.withColumnRenamed("spans", "doc_id"), None)
    assert [r[0] for r in out.orderBy("doc_id").select(mask(F.col("text"), F.col("spans"))).collect()] == ["é <email>, <ip>!", None, "z"]


def test_running(spark):
    draw = random.Random(5)
    rows = [(i, [draw.randint(0, 50) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 3, 4, 5, 15, 16, 17, 100, 1001])]
    df = spark.createDataFrame(rows, "id int, v array<int>")
    for r in df.select("v", running(F.col("v"), lambda a, b: a + b).alias("sums"), running(F.col("v"), F.greatest).alias("most")).collect():
        assert r.sums == [sum(r.v[:i]) for i in range(len(r.v) + 1)]
        assert r.most == [max([0, *r.v[:i]]) for i in range(len(r.v) + 1)]


def plain_mask(text, spans):
    out, at = "", 0
    for start, end, kind in spans:
        if start >= at:
            out += text[at:start] + f"<{kind}>"
        at = max(at, end)
    return out + text[at:]


def test_masks_and_overlaps_same_as_brute_force(spark, labelled):
    """Spans of the method overlap no base span, whatever lies next to them; masks put texts together again."""
    draw, rows = random.Random(6), []
    pieces = ["a@b.cc", "1.2.3.4", "1.2.3.4x9", "4041894974608795", "+1 (988) 555-2485", "secret=8f14e45fceea167a5a36", "é😀", " ", ", ", "token ", "x1@y", "v" * 3000]
    for i in range(200):
        rows.append((i, "".join(draw.choice(pieces) for _ in range(draw.randint(0, 30)))))
    rows += [(200, "é" * CHUNK), (201, "a@b.cc" + "é" * (3 * CHUNK)), (202, "é " * CHUNK + "a@b.cc"), (203, "é" * (CHUNK - 2) + " a@b.cc"), (204, "😀" * (2 * CHUNK - 1) + " a@b.cc 1.2.3.4")]
    model = fit_pii(labelled)
    open_model = SpanModel(model.prior, model.right, [1.0] + [0.0] * (len(model.weights) - 1))  # takes all candidates
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(4)
    for m in (model, open_model):
        found = find_pii(df, m)
        seen = 0
        for r in found.withColumn("masked", mask(F.col("text"), F.col("spans"))).collect():
            spans = [(s.start, s.end, s.kind) for s in r.spans]
            more = [s for s in spans if s[2] == "other"]
            assert [s for s in spans if s[2] != "other"] == [(s.start, s.end, s.kind) for s in r.base]
            wanted = [c for c in brute.candidates(r.text) if not any(b.start < c[1] and c[0] < b.end for b in r.base)]
            if m is open_model:
                assert [s[:2] for s in more] == [(a, a + len(r.text[a:b].rstrip(".!?"))) for a, b in wanted]
            else:
                assert {s[0] for s in more} <= {a for a, _ in wanted}
            assert r.masked == plain_mask(r.text, spans)
            seen += len(more)
        assert seen > 20


def test_many_matches_in_one_text(spark, labelled):
    """200 000 matches in a text take seconds in every step, not hours."""
    texts = ["1 x " * 200_000, "1.2.3.4 a7b " * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(2)
    start = time.time()
    model = fit_pii(labelled.select("text").unionByName(df.select("text")))
    found = find_pii(df, SpanModel(model.prior, model.right, [1.0] + [0.0] * (len(model.weights) - 1)))
    got = {r.doc_id: r for r in found.select("doc_id", F.size("base").alias("n"), F.size("spans").alias("all"), mask(F.col("text"), F.col("spans")).alias("masked")).collect()}
    assert (got[0].n, got[0]["all"], got[0].masked) == (0, 200_000, "<other> x " * 200_000)
    assert (got[1].n, got[1]["all"], got[1].masked) == (100_000, 200_000, "<ip> <other> " * 100_000)
    assert time.time() - start < 120


def test_no_rows_and_no_candidates(spark):
    none = spark.createDataFrame([], "doc_id int, text string")
    assert fit_pii(none) is None and find_pii(none, None).collect() == []
    assert fit_pii(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id int, text string")) is None


def test_estimate_prefers_the_reliable():
    patterns = [((1, 0, 0, 0, 0, 1, 1), 50), ((0, 0, -1, 0, 0, 0, 0), 80), ((0, 0, -1, 0, 0, -1, 0), 20), ((1, 0, 0, 0, 0, -1, 1), 5)]
    _, _, soft = estimate(patterns)
    assert soft[0] > 0.9 and soft[1] < 0.1 and soft[2] < 0.1
