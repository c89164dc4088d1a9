"""Language identification: the forward algorithm by brute force, held-out accuracy, odd rows."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
import regex

from postloom.llm import language
from postloom.llm.language import FLOOR, RUN, Lattice, Words, expected_pieces, fit_languages, load_pieces, part_groups, predict_language, word_scores

PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def segmentations(word, pieces):
    if not word:
        yield ()
    for n in range(1, len(word) + 1):
        if word[:n] in pieces or n == 1:
            for rest in segmentations(word[n:], pieces):
                yield (word[:n], *rest)


def test_forward_sums_all_segmentations():
    pieces = sorted(["▁", "▁a", "▁ab", "a", "b", "ab", "ba", "aba", "é"])
    table = np.random.default_rng(1).random((len(pieces) + 2, 2))
    table[-1] = 0
    p = {x: table[i] for i, x in enumerate(pieces)}
    words = ["▁ababa", "▁xab", "▁éa", "▁abab", "▁"]
    got = word_scores(Lattice(pieces), table, words)
    uses = expected_pieces(Lattice(pieces), table, words, np.ones((len(words), 2)))
    want = np.zeros_like(table)
    for w, g in zip(words, got, strict=True):
        ways = [(s, np.prod([p.get(x, table[-2]) for x in s], axis=0)) for s in segmentations(w, set(pieces))]
        total = sum(v for _, v in ways)
        assert np.allclose(g, np.log(total))
        for s, v in ways:
            for x in s:
                want[pieces.index(x) if x in pieces else -2] += v / total
    assert np.allclose(uses, want)


def log_probability(word, chance, unknown):
    """log of the sum over all segmentations, position by position."""
    sums = [0.0]
    for k in range(1, len(word) + 1):
        ways = [sums[j] + math.log(chance.get(word[j:k], unknown if j == k - 1 else 0)) for j in range(max(0, k - 16), k) if word[j:k] in chance or j == k - 1]
        most = max(ways)
        sums.append(most + math.log(sum(math.exp(w - most) for w in ways)))
    return sums[-1]


@pytest.mark.parametrize("length", [RUN - 1, RUN, RUN + 1, 200, 3000])
def test_words_of_any_length_are_summed_whole(length):
    """No segmentation is cut off, and expected uses are the derivatives of the log probability."""
    pieces = sorted(["▁a", "a", "b", "ab", "aba", "bcb"])
    table = np.random.default_rng(2).random((len(pieces) + 2, 3)) * 0.1
    table[-2], table[-1] = FLOOR, 0
    word = "▁" + "".join(random.Random(length).choice("aabbbcé") for _ in range(length - 1))
    got = word_scores(Lattice(pieces), table, ["▁a", word])[1]
    uses = expected_pieces(Lattice(pieces), table, [word], np.array([[1, 2, 0.5]]))
    for language_, n in zip(range(3), (1, 2, 0.5), strict=True):
        chance = dict(zip(pieces, table[:, language_], strict=False))
        base = log_probability(word, chance, FLOOR)
        assert got[language_] == pytest.approx(base, rel=1e-9)
        for i, piece in enumerate(pieces):
            more, less = (log_probability(word, chance | {piece: chance[piece] * (1 + e)}, FLOOR) for e in (1e-5, -1e-5))
            assert uses[i, language_] == pytest.approx(n * (more - less) / 2e-5, rel=1e-4, abs=1e-4)


def plain_words(text):
    return [w for w in regex.findall(r"[\p{L}\p{M}]+", (text or "").lower()) if regex.search(r"\p{L}", w)]


def words_of(texts):
    found = [[] for _ in texts]
    for rows, parts in part_groups(pa.array(texts, pa.string())):
        words = Words(parts)
        assert len(words.hashes) == len(words.part)
        for word, part in zip(words.spell(np.arange(len(words.part))), words.part, strict=True):
            found[rows[part]].append(word.removeprefix("▁"))
    return found


def test_words_are_runs_of_letters(monkeypatch):
    draw = random.Random(3)
    signs = "aAbÉßдЖ漢ñİΣ\u0301\u093f\u0915² ½Ⅷ١ 1_.,\n\t\x00😀"
    texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 60))) for _ in range(200)]
    texts += [None, "", "² ½ Ⅷ 12 _ !", "\u0301 \u0301", "हिन्दी भाषा", "x" * 65, "Ab ab, É1é"]
    want = [plain_words(t) for t in texts]
    assert words_of(texts) == want and want[-3:] == [["हिन्दी", "भाषा"], ["x" * 65], ["ab", "ab", "é", "é"]]
    monkeypatch.setattr(language, "PART", 7)
    monkeypatch.setattr(language, "GROUP", 20)
    assert words_of(texts) == want
    monkeypatch.undo()
    assert words_of(["ab " * 700_000 + "c" * 2_000_000]) == [["ab"] * 700_000 + ["c" * 2_000_000]]


@pytest.fixture(scope="module")
def model(spark):
    draw = random.Random(1)
    kinds = {"de": ["der", "die", "und", "nicht", "straße", "für"], "en": ["the", "and", "not", "street", "for", "with"]}
    text = lambda k: " ".join(draw.choice(kinds[k]) for _ in range(draw.randint(1, 30)))
    rows = [(text(k), k) for _ in range(60) for k in kinds] + [(None, "de"), ("the", None)]
    return fit_languages(spark.createDataFrame(rows, "text string, lang string").repartition(5), load_pieces(PIECES)), text


def test_held_out(spark, model):
    fitted, text = model
    assert fitted.languages == ["de", "en"] and np.allclose(fitted.table.sum(0), 1, atol=1e-3) and fitted.table[:-1].min() >= FLOOR
    rows = [(i, text(("de", "en")[i % 2])) for i in range(100)]
    for r in predict_language(spark.createDataFrame(rows, "doc_id int, text string"), fitted).collect():
        assert r.lang_pred == ("de", "en")[r.doc_id % 2] and 0.5 <= r.score <= 1


def test_same_as_brute_force(spark, model):
    """Prediction and score of whole texts, by plain sums over words and segmentations."""
    fitted, text = model
    draw = random.Random(8)
    mixed = lambda: " ".join(draw.choice([text("de"), text("en"), "straße²", "qqq", "the" * 30]) for _ in range(draw.randint(0, 3)))
    rows = [(i, mixed()) for i in range(60)] + [(60, "²½ Ⅷ"), (61, "a"), (62, "for " * 300 + "und " * 301)]
    chance = [dict(zip(fitted.pieces, fitted.table[:, i], strict=False)) for i in range(2)]
    got = {r.doc_id: r for r in predict_language(spark.createDataFrame(rows, "doc_id int, text string").repartition(3), fitted).collect()}
    for key, t in rows:
        words = plain_words(t)
        total = [fitted.priors[i] + sum(log_probability("▁" + w, chance[i], fitted.table[-2, i]) for w in words) for i in range(2)]
        if not words:
            assert (got[key].lang_pred, got[key].score) == ("und", 0.0)
        else:
            assert got[key].lang_pred == fitted.languages[int(np.argmax(total))]
            assert got[key].score == pytest.approx(1 / sum(math.exp(x - max(total)) for x in total), rel=1e-6)


def test_odd_rows(spark, model):
    rows = [(1, None, "a"), (2, "", "a"), (3, "12 .", None), (4, "щщ 漢字 ", "b"), (5, "the " * 50_000, "b"), (5, "the " * 50_000, "b"), (None, "x" * 100_000, "b")]
    df = spark.createDataFrame(rows, "doc_id int, text string, score string")
    out = predict_language(df, model[0]).collect()
    assert [r.lang_pred for r in out[:3]] == ["und"] * 3 and [r.score for r in out[:3]] == [0.0] * 3
    assert out[4].lang_pred == "en" and out[4] == out[5] and all(math.isfinite(r.score) for r in out)
    assert predict_language(df.limit(0), model[0]).collect() == []
    empty = fit_languages(spark.createDataFrame([], "text string, lang string"), ["a"])
    assert {r.lang_pred for r in predict_language(df, empty).collect()} == {"und"}


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    fitted = fit_languages(docs.where("doc_id % 4 <> 1"), load_pieces(PIECES))
    rest = predict_language(docs.where("doc_id % 4 = 1"), fitted).select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in rest) >= 0.98 * len(rest)
