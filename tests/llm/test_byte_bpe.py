"""Byte-level BPE against the public library, round trips, and a plain merge loop."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from postloom.llm import byte_bpe
from postloom.llm.byte_bpe import (
    Pairs, Vocabulary, bpe_decode, bpe_encode, count_ids, cuts, encoder, load_vocabulary, merge_many, merge_ranks, unpack_ids,
)


@pytest.fixture(scope="module")
def vocabulary():
    return load_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})


def ids_of(packed):
    return np.frombuffer(packed, "<u4").tolist()


def hard_texts():
    draw = random.Random(4)
    signs = "aeinorstZÉßçñ 0123456789.,!?'\"-_/\\\n\t\r    　\u0085\x1c漢字かなأبجदेव🙂👩‍👩‍👧é²½Ⅷ<|>"
    out = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 200))) for _ in range(300)]
    out += ["", " ", "  ", "\n\n \n", "don't I'LL we've 's's", "<|endoftext|>", "a" * 5000, "ab" * 3000, "-" * 4001, " " * 3000 + "x", "漢" * 2000]
    out += ["".join(draw.choice("abcdefgh") for _ in range(20_000)), "supercalifragilistic" * 40, "�\x00\x01", "1234567 89" * 50]
    return out


def test_same_as_the_library(vocabulary, library):
    texts = hard_texts()
    for text, ids in zip(texts, encoder(vocabulary.ranks, vocabulary.pattern, "test")(texts), strict=True):
        assert ids_of(ids) == library.encode_ordinary(text), text[:80]


def test_merges_same_as_a_plain_loop():
    """Small vocabularies made at random, where equal ranks and merges of merges are common."""
    draw = random.Random(9)
    for _ in range(400):
        ranks = {bytes([b]): b for b in range(256)}
        for _ in range(draw.randint(0, 12)):
            ranks.setdefault(draw.choice(list(ranks)[97:100] + list(ranks)[256:]) + draw.choice(list(ranks)[97:100] + list(ranks)[256:]), len(ranks))
        piece = bytes(draw.choice(b"abc") for _ in range(draw.randint(1, 40)))
        parts = [bytes([b]) for b in piece]
        while True:
            pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not pairs:
                break
            _, i = min(pairs)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        want = [ranks[p] for p in parts]
        assert merge_ranks(piece, ranks.get) == want
        assert ids_of(merge_many([piece, b"q", piece], Pairs(ranks), 64)[2]) == want


def test_cuts_change_nothing(vocabulary, library):
    for text in hard_texts():
        for size in (1, 7, 64):
            parts = list(cuts(text, size))
            assert "".join(parts) == text
            assert [i for p in parts for i in library.encode_ordinary(p)] == library.encode_ordinary(text)


def test_full_memory_changes_nothing(vocabulary, library):
    encode = encoder(vocabulary.ranks, vocabulary.pattern, "small", memory=3)
    for text in hard_texts()[:50]:
        assert ids_of(next(encode([text]))) == library.encode_ordinary(text)
    assert len(byte_bpe._known["small", 3]) <= 3


def test_column_round_trip_nulls_repeats_and_clashing_names(spark, vocabulary, library):
    texts = [*hard_texts(), None, None, "again", "again"]
    rows = [(i if i % 7 else None, t, "mine", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, rank int").repartition(5)
    coded = bpe_decode(bpe_encode(docs, vocabulary), vocabulary).withColumn("n", count_ids(F.col("ids"))).withColumn("list", unpack_ids(F.col("ids")))
    assert coded.columns == ["doc_id", "text", "ids", "rank", "decoded", "n", "list"]
    found = coded.collect()
    assert len(found) == len(rows)
    for r in found:
        want = library.encode_ordinary(r.text or "")
        assert ids_of(r.ids) == want == r.list and r.n == len(want)
        assert bytes(r.decoded) == (r.text or "").encode()
    assert sorted(r["rank"] for r in found) == list(range(len(rows)))


def test_no_rows_and_null_ids(spark, vocabulary):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_decode(bpe_encode(none, vocabulary), vocabulary).collect() == []
    ids = spark.createDataFrame([(1, None), (2, bytearray())], "doc_id long, ids binary")
    assert sorted((r.doc_id, r.decoded) for r in bpe_decode(ids, vocabulary).collect()) == [(1, None), (2, bytearray())]


def test_one_long_match_stays_fast(vocabulary, library):
    """A match of 300 000 letters: merging takes n log n steps."""
    text = "".join(random.Random(1).choice("etaoinshrdlu") for _ in range(300_000))
    (ids,) = encoder(vocabulary.ranks, vocabulary.pattern, "long")([text])
    assert library.decode(ids_of(ids)) == text


def test_texts_longer_than_a_cut(vocabulary, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CUT", 50)
    monkeypatch.setattr(byte_bpe, "CELLS", 1 << 10)
    texts = hard_texts()
    for text, ids in zip(texts, encoder(vocabulary.ranks, vocabulary.pattern, "cut")(texts), strict=True):
        assert ids_of(ids) == library.encode_ordinary(text)


def test_bad_vocabularies():
    with pytest.raises(ValueError, match="single bytes"):
        Vocabulary({b"a": 0}, ".")
    with pytest.raises(ValueError, match="different"):
        Vocabulary({bytes([b]): b // 2 for b in range(256)}, ".")


def test_query(spark, sf, library):
    import hashlib

    from postloom.llm.queries import op12_byte_bpe
    rows = {r.doc_id: r for r in op12_byte_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode_ordinary(d.text or "")
        r = rows[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
