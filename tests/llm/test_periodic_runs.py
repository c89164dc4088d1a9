"""Periodic runs against their definition, word by word."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from compare import compare, connect
from llm import brute

from postloom.llm import periodic_runs, wordhash
from postloom.llm.periodic_runs import collapse, find_periodic_runs, frequent_segments, scan_lags
from postloom.llm.queries import OP13_SQL, op13_periodic_runs


def texts(seed, n=400, longest=90):
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        words = []
        while len(words) < draw.randint(0, longest):
            unit = [draw.choice(draw.choice(["ab", "abc", "abcdefgh"])) for _ in range(draw.randint(1, 7))]
            part = unit * draw.randint(1, 7)
            words += part[:len(part) - draw.randint(0, len(unit) - 1)]
        for _ in range(draw.choice([0, 0, 1, 3])):
            if words:
                words[draw.randrange(len(words))] = draw.choice("abxyz")
        out.append("".join(w + draw.choice([" ", " ", "\n", " \t "]) for w in words))
    fixed = [None, "", " \n", "a", "a " * 5, "a " * 6, "a b " * 3, "a b " * 4, "a b " * 4 + "a", "x " + "é ß " * 9, "a a a a a a b " * 5, " " * 50 + "q" * 3000]
    return out + fixed


def flat_rows(found):
    return [([(r["start"], r["length"], r["period"]) for r in x["runs"]], x["collapsed"]) for x in found.to_pylist()]


@pytest.mark.parametrize("seed", range(4))
def test_same_as_definition(seed, monkeypatch):
    monkeypatch.setattr(wordhash, "SLICE", 300)
    rows = texts(seed)
    got = flat_rows(collapse(pa.array(rows, pa.string())))
    want = [brute.periodic_runs(t) for t in rows]
    assert got == want
    assert sum(len(r) > 1 for r, _ in want) > 20


def test_without_splitting_the_same_runs():
    """Splitting only leaves out what is in no run."""
    for t in texts(7, 150):
        words = brute.WORD.findall(t or "")
        if len(words) >= 6:
            codes = np.unique(words, return_inverse=True)[1]
            assert sorted(scan_lags(codes), key=lambda r: (r[0], r[2])) == brute.periodic_runs(t)[0]


def test_segments_are_stable_and_hold_every_run():
    for t in texts(8, 150):
        words = brute.WORD.findall(t or "")
        codes = np.unique(words, return_inverse=True)[1] if words else np.zeros(0, np.int64)
        segments = frequent_segments(codes, np.zeros(len(codes), np.int64))
        for a, b in segments:
            assert b - a >= 6 and all(words[a:b].count(w) >= 4 for w in set(words[a:b]))
        for s, n, _ in brute.periodic_runs(t)[0]:
            assert any(a <= s and s + n <= b for a, b in segments)


def test_equal_hashes_of_other_blocks_do_no_harm(monkeypatch):
    """With hashes that say nothing, words decide."""
    monkeypatch.setattr(periodic_runs, "mix", lambda x: np.zeros(len(x), np.uint64))
    rows = texts(3, 100)
    assert flat_rows(collapse(pa.array(rows, pa.string()))) == [brute.periodic_runs(t) for t in rows]


def test_very_long_texts():
    draw = random.Random(5)
    half = [draw.choice("abcdefghij") for _ in range(40_000)]
    unit = [str(draw.randint(0, 50)) for _ in range(9_000)]
    rows = ["x " * 300_000, " ".join(half + unit * 5 + half), "a a a a a a a b " * 30_000, " ".join(f"w{i}" for i in range(300_000))]
    began = time.time()
    (one, first), (two, second), (three, third), (four, fourth) = flat_rows(collapse(pa.array(rows)))
    assert time.time() - began < 60
    assert one == [(0, 300_000, 1)] and first == "x"
    assert [r for r in two if r[2] == 9_000] and len(second.split()) < 90_000
    assert (0, 240_000, 8) in three and len(three) == 30_001 and third == "a b"
    assert four == [] and fourth == rows[3]


def test_rows_nulls_repeats_and_clashing_names(spark):
    rows = [(1, "a " * 9, 5), (1, "a " * 9, 5), (None, "b " * 7, 6), (2, None, 7)]
    out = find_periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, runs int").withColumnRenamed("runs", "collapsed").repartition(3))
    assert out.columns == ["doc_id", "text", "runs", "collapsed"]
    found = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()), key=str)
    assert found == [(1, [(0, 9, 1)], "a"), (1, [(0, 9, 1)], "a"), (2, [], ""), (None, [(0, 7, 1)], "b")]
    assert find_periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_same_as_sql(spark, sf):
    assert compare(op13_periodic_runs(spark, sf), connect(sf), OP13_SQL) is None


def test_query_same_as_definition(spark, sf):
    """The planted periods too, in plain Python."""
    import hashlib
    import zlib

    got = {r.doc_id: r for r in op13_periodic_runs(spark, sf).collect()}
    planted = 0
    for d in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        words = brute.WORD.findall(d.text or "")
        if len(words) > 600:
            continue
        h = zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs, left = brute.periodic_runs(" ".join(words))
        r = got[d.doc_id]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(left.encode()).hexdigest()
    assert planted > 5
