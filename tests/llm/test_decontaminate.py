"""Decontamination against brute force."""

import random

import pytest
from llm import brute

from postloom.llm import decontaminate

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def tables(seed=1):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randint(1, 5)))
    items = [" ".join(word() for _ in range(draw.randint(3, 200))) for _ in range(20)]
    docs = []
    for i in range(60):
        words = [word() for _ in range(draw.randint(0, 400))]
        if i % 2:
            piece = draw.choice(items).split()
            for _ in range(draw.randint(0, len(piece) // 12)):
                piece[draw.randrange(len(piece))] = word()
            at = draw.randint(0, len(words))
            words[at:at] = [p.upper() + draw.choice(["", ",", "!\n"]) for p in piece]
        docs.append(" ".join(words))
    docs += [None, "", "..", items[0]]
    items += [items[3], None, "", "--", "one two", "É éa b c d e f"]
    docs += ["one, TWO", "one two three", "é Éa b c d e f"]
    return list(enumerate(docs)), list(enumerate(items))


def run(spark, docs, items):
    out = decontaminate.contaminated(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS))
    return sorted((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in out.collect())


@pytest.mark.parametrize("bits", [1 << 27, 1 << 12])
def test_same_as_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(decontaminate, "MAX_BITS", bits)
    docs, items = tables()
    want = brute.contaminated(docs, items)
    assert len(want) > 20 and run(spark, docs, items) == want


def test_null_keys_repeats_and_no_rows(spark):
    text = "a b c d e f g"
    docs, items = [(1, text), (1, text), (None, text), (2, "z")], [(5, text), (None, text), (5, "q r s t u v"), (6, text)]
    assert run(spark, docs, items) == [(1, 5, 3, 3), (1, 6, 3, 3)]
    assert run(spark, [], items) == [] and run(spark, docs, []) == []


def test_large_items_need_few_hits():
    assert 1 <= decontaminate.least_hits(1000, 75) < 64 and decontaminate.least_hits(40, 75) == 30


def held_in(text, item):
    """Whether the words of a short item stand in a row in the text."""
    have, want = (list(x) for x in (brute.plain_shingles(text, 1), brute.plain_shingles(item, 4)))
    words = [w for w in "".join(c if c >= "\x80" or c.isalnum() else " " for c in (text or "").lower()).split(" ") if w]
    run = list(want[0]) if want else ["~"]
    return bool(have) and any(words[i:i + len(run)] == run for i in range(len(words)))


@pytest.mark.parametrize("bits", [1 << 27, 1 << 8])
def test_short_items_inside_long_texts(spark, monkeypatch, bits):
    monkeypatch.setattr(decontaminate, "MAX_BITS", bits)
    docs, items = tables(4)
    short = ["one two", "Two!", "one, two three", "é Éa b c", "two one", "-- b"]
    docs += [(200, "x y z v w ONE two, three q"), (201, "w v u one"), (202, "two x y z w v"), (203, "a b c d e f é éa b, C"), (204, "one\ntwo")]
    more = [*items, *[(100 + i, t) for i, t in enumerate(short)]]
    plain = {k for k, t in more if any(len(s) < 5 for s in brute.plain_shingles(t))}
    want = [r for r in brute.contaminated(docs, more) if r[1] not in plain]
    want += [(d, k, 1, 1) for d, t in docs for k, i in more if k in plain and held_in(t, i)]
    out = decontaminate.contaminated(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(more, ITEMS), short_items=True)
    assert sorted((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in out.collect()) == sorted(want)
    assert {(200, 100), (200, 101), (200, 102), (203, 103), (204, 100)} <= {r[:2] for r in want} and (201, 100) not in {r[:2] for r in want}
