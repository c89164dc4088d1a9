"""Url filter and mixing: brute force, odd rows, plans without Python."""

import random
from collections import defaultdict

import pytest
from llm import brute
from pyspark.sql import functions as F

from postloom.llm import url_filter
from postloom.llm.mixing import systematic_mix
from postloom.llm.url_filter import filter_urls

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.b", "", "block"), (None, "/", "block")]
URLS = [
    "http://x.example.net/en/1", "http://example.net/EN/1", "HTTPS://WWW.Example.NET/en/", "http://net/", "http://net", "http://notnet/", "http://x.net?a=/en/",
    "ftp://example.com/de/x?q#f", "http://example.com.org/fr/x", "http://org/fr/", "http://org/frx", "nothing", "", None, "://a.b", "a://b://c/d", "x\ny://a.b/\nz?q",
    "http://l.com/listed/?x", "http://l.com/listed", "http://L.com/LISTED", "http://é.net/é", "http://user@h.net:80/p", "http://..net/", "http://a.b.net/en/" + "x" * 5000,
]


def judged(spark, urls, listed=("http://l.com/listed/", None), rules=RULES):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumn("host", F.lit(1))
    rules = spark.createDataFrame(rules, "host string, path string, verdict string")
    out = filter_urls(df, rules, spark.createDataFrame([(x,) for x in listed], "listed string"))
    return {r.page_id: (r.host, r.path, r.rule, r.verdict, r.listed) for r in out.collect()}, out


@pytest.mark.parametrize("blocks", [1 << 20, 1])
def test_urls(spark, monkeypatch, blocks):
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", blocks)
    urls = URLS + [f"http://h{i % 7}.example.{'net' if i % 2 else 'org'}/{'en' if i % 3 else 'fr'}/{i}" for i in range(200)] + URLS
    got, out = judged(spark, urls)
    assert got == {i: brute.judge_url(u, RULES, {("l.com", "/listed")}) for i, u in enumerate(urls)}
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_empty_lists_and_no_urls(spark):
    assert judged(spark, [])[0] == {}
    assert judged(spark, ["http://a/b"], listed=(), rules=[])[0] == {0: ("a", "/b", None, "allow", False)}


DOCS = "doc_id long, source string, text string"


def documents(seed=1):
    draw = random.Random(seed)
    rows = [(i, draw.choice(["a", "b", "b", "b", "Z", "é", None]), "w " * draw.choice([0, 1, 5, 5, 5, draw.randint(0, 900)])) for i in range(600)]
    return rows + [(9000, "tiny", "one"), (9001, "empty", None), (9002, "empty", " "), (None, "a", "x y"), (7, "a", "same"), (7, "a", "same")]


def mixed(spark, rows, **options):
    return systematic_mix(spark.createDataFrame(rows, DOCS).repartition(5), **options)


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    rows = documents(seed)
    out = mixed(spark, rows).collect()
    assert len(out) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, s, t in rows:
        sizes[s] += len(brute.WORD.findall(t or ""))
    want = brute.mix_targets(sizes)
    for r in out:
        assert r.size == len(brute.WORD.findall(r.text or "")) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 2
        taken[r.source] += r.size * r.copies
    for s, n in taken.items():
        assert abs(n - want[s]) <= 0.05 * want[s] + 2, (s, n, want[s])
    key = lambda r: (str(r.doc_id), r.text or "", r.copies)
    again = systematic_mix(spark.createDataFrame(rows, DOCS).repartition(2)).collect()
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_mix_odd_tables(spark):
    assert mixed(spark, []).collect() == []
    (r,) = mixed(spark, [(1, None, None)]).collect()
    assert (r.size, r.source_size, r.target, r.copies) == (0, 0, 0.0, 0)
    df = spark.createDataFrame([(1, "a", "x y", 5, 6)], DOCS + ", size int, _n int")
    assert systematic_mix(df).columns == ["doc_id", "source", "text", "_n", "size", "source_size", "target", "copies"]
    plan = systematic_mix(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_copies_follow_the_ceiling(spark):
    rows = [(i, "a", "w " * 10) for i in range(100)] + [(1000 + i, "b", "w " * 10) for i in range(300)]
    copies = defaultdict(list)
    for r in mixed(spark, rows, weights=[1.0], share=1.25, ceiling=2.0).collect():
        copies[r.source].append(r.copies)
    assert set(copies["a"]) == {2} and sum(copies["b"]) == pytest.approx(300, abs=1)
