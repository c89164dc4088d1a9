"""The pipeline, stage by stage and as a whole, against plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest
from llm import brute

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"de": "der die und nicht straße für haben werden können schön", "en": "the and not street for with have would could nice"}


def corpus(seed=1):
    """Documents, and the benchmark: plain, copied, near, leaking, private and wordless ones."""
    draw = random.Random(seed)
    text = lambda k, n: " ".join(draw.choice(WORDS[k].split()) + draw.choice(["", "", "x", "ly"]) for _ in range(n))
    items = [text("en", 30) for _ in range(3)] + [None]
    rows = []
    for i in range(60):
        lang = ("de", "en")[i % 2]
        body = text(lang, draw.randint(20, 80))
        if i % 10 == 3:
            body += " " + items[i % 3] + " " + text("en", 10)
        if i % 7 == 2:
            body += f" a{i}@mail.example.com or +1 (988) 555-24{i:02d} at 42.144.35.{i} " + text(lang, 5)
        rows.append((i, body, lang, f"src{i % 4}"))
    for i in range(12):
        base = rows[draw.randrange(60)]
        words = base[1].split()
        if i % 2:
            words[len(words) // 2] = "changed"
        rows.append((100 + i, " ".join(words), base[2], f"src{i % 4}"))
    rows += [(200, None, "en", "src1"), (201, "", None, None), (202, "12 34 ...", "en", "src1"), (203, "the street and the nice with", "en", None), (5, rows[5][1], rows[5][2], "src1")]
    return [(d, t, k, s, len(t) if t is not None else 0) for d, t, k, s in rows], items


def expected(rows, items):
    """Rows after each stage but the last: (doc_id, text)."""
    stages = [[(d, t) for d, t, *_ in rows if t and re.search(r"[^\W\d_]", t)]]
    component = {k: c for k, _, c, _ in brute.jaccard_classes(stages[0])}
    stages.append(sorted({(d, t) for d, t in stages[0] if component[d] == d}))
    leaks = {d for d, *_ in brute.contaminated(stages[1], list(enumerate(items)))}
    stages.append([r for r in stages[1] if r[0] not in leaks])

    def masked(t):
        for part in reversed([x for x in brute.base_spans(t).split(",") if x]):
            kind, start, end = part.split(":")
            t = t[:int(start)] + f"<{kind}>" + t[int(end):]
        return t

    stages.append([(d, masked(t)) for d, t in stages[2]])
    return stages


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows, items = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    rows, items = corpus()
    docs, want = spark.read.parquet(f"{folder}/documents.parquet"), expected(rows, items)
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        found = docs.collect()
        assert docs.columns == columns and sorted((r.doc_id, r.text) for r in found) == sorted(want[i]), name
        assert all(r.n_chars == len(r.text) for r in found)
        lang = {d: k for d, _, k, *_ in rows}
        assert all(r.lang == lang[r.doc_id] for r in found)
    assert len(want[0]) > len(want[1]) > len(want[2]) == len(want[3]) and want[2] != want[3]

    whole = corpus_pipeline.run(spark, folder)
    assert whole.columns == [*columns, "copy"]
    taken, sizes = defaultdict(int), defaultdict(int)
    source = {(r.doc_id, r.text): r.source for r in found}
    for key, s in source.items():
        sizes[s] += len(brute.WORD.findall(key[1]))
    copies = Counter()
    for r in whole.collect():
        copies[r.doc_id, r.text] += 1
        taken[r.source] += len(brute.WORD.findall(r.text))
        assert r.source == source[r.doc_id, r.text]
    assert max(copies.values()) <= 2
    for s, target in brute.mix_targets(sizes).items():
        assert abs(taken[s] - target) <= 100, s


def test_no_documents(spark, folder, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
