"""Unit deduplication against brute force, and the originals put together again."""

import random

from llm import brute

from postloom.llm.unit_dedup import dedup_units

SCHEMA = "doc_id long, text string"


def texts(seed=2):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 4)))
    sentence = lambda n=12: " ".join(word() for _ in range(draw.randint(1, n))) + draw.choice([".", "!!", "?\n", ".\n", "\n", ""])
    passages = [" ".join(sentence(25) for _ in range(4)) for _ in range(4)]
    rows = []
    for _ in range(60):
        parts = [sentence() for _ in range(draw.randint(0, 12))]
        for _ in range(draw.randint(0, 2)):
            p = draw.choice(passages)
            parts.insert(draw.randint(0, len(parts)), p.upper().replace(" ", "  ") if draw.random() < 0.2 else p)
        rows.append(draw.choice([" ", "\n"]).join(parts))
    rows += [None, "", "\n \n", "...", "-- -- \n--", "A. b. C. " * 30, "x " * 300, "x " * 300, "-" * 3000 + "a", rows[3], rows[3]]
    return list(enumerate(rows))


def run(spark, rows):
    out = dedup_units(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    return sorted(((r.doc_id, r.text, [(s["start"], s["end"], s["kept_key"]) for s in r.removed]) for r in out), key=str)


def test_same_as_brute_force(spark):
    rows = texts()
    got = run(spark, rows)
    assert got == sorted(brute.dedup_units(rows), key=str)
    assert sum(bool(s) for _, _, s in got) > 20


def test_originals_come_back(spark):
    rows = dict(texts(5))
    for key, left, spans in run(spark, list(rows.items())):
        at, parts, done = 0, [], 0
        for start, end, _ in spans:
            parts += [left[at:at + start - done], rows[key][start:end]]
            at, done = at + start - done, end
        assert left is None or "".join(parts) + left[at:] == rows[key]


def test_null_keys_repeated_rows_clashing_columns_and_no_rows(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(1, long), (1, long), (2, long), (None, long), (None, None)]
    assert run(spark, rows) == sorted([(1, long, []), (1, long, []), (2, "", [(0, len(long), 1)]), (None, long, []), (None, None, [])], key=str)
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, "a", 2, "x", "y", 4)], "doc_id int, text string, key int, removed string, unit string, digest int")
    out = dedup_units(df)
    assert out.columns == ["doc_id", "text", "key", "unit", "digest", "removed"] and out.first()[:5] == (1, "a", 2, "y", 4)


def by_lines(rows, min_words=20, unit_words=4):
    """(id, text, [(start, end)]) per row, with whole lines that go without a floor."""
    first_unit, first_line, lines = {}, {}, {}
    for key, text in sorted(rows):
        lines[key], at = [], 0
        for raw in (text or "").split("\n"):
            units = [(at + s, at + e, tuple(w)) for s, e, w in brute._units(raw)]
            at += len(raw) + 1
            whole = tuple(w for _, _, w in units if w)
            lines[key].append((units, whole, (key, len(lines[key]))))
            first_line.setdefault(whole, (key, len(lines[key]) - 1))
            for s, _, w in units:
                first_unit.setdefault(w, (key, s))
    out = []
    for key, text in rows:
        marks = []
        for units, whole, place in lines[key]:
            gone = first_line[whole] != place if len(whole) > 1 else None
            for s, e, w in units:
                again = bool(w) and first_unit[w] != (key, s)
                marks.append((s, e, w, again, again and (gone if gone is not None else True)))
        spans, run = [], []
        for mark in [*marks, (0, 0, ("~",), False, False)]:
            if mark[3]:
                run.append(mark)
                continue
            if not mark[2] and run:
                continue
            if sum(len(m[2]) for m in run if len(m[2]) >= unit_words) >= min_words:
                spans.append((run[0][0], run[-1][1]))
            else:
                for i, m in enumerate(run):
                    if m[4] and i and run[i - 1][4]:
                        spans[-1] = (spans[-1][0], m[1])
                    elif m[4]:
                        spans.append((m[0], m[1]))
            run = []
        left = text
        for start, end in reversed(spans):
            left = left[:start] + left[end:]
        out.append((key, left, spans))
    return out


def run_lines(spark, rows):
    out = dedup_units(spark.createDataFrame(rows, SCHEMA).repartition(3), whole_lines=True).collect()
    return sorted(((r.doc_id, r.text, [(s["start"], s["end"]) for s in r.removed]) for r in out), key=str)


def test_whole_lines_same_as_brute_force(spark):
    for seed in (2, 9):
        assert run_lines(spark, texts(seed)) == sorted(by_lines(texts(seed)), key=str)


def test_short_lines_go_and_short_pieces_stay(spark):
    rows = [
        (1, "All rights reserved by us.\nHome\nNew. Yes. No."), (2, "other text here\nALL rights reserved by us!\nHome"),
        (3, "He said: Yes. No. Then more"), (4, "new. yes, no. \nYes. No."), (5, "x\nNew. Yes. No.\n--\nHome"),
    ]
    # Of 4 the line differs from that of 1 in its units; its sentences are pieces, as in 3.
    assert [t for _, t, _ in run_lines(spark, rows)] == [rows[0][1], "other text here\n", rows[2][1], rows[3][1], "x\n"]


def test_the_earliest_line_of_a_text_stays(spark):
    """Of a line of several sentences the first place stays, also within one text, and where an earlier text has its sentences."""
    line = "Hello there friend. Buy now please."
    one = f"{line}\nunique words one here\n{line}\nother stuff again"
    left = f"{line}\nunique words one here\n\nother stuff again"
    at = len(f"{line}\nunique words one here\n")
    assert run_lines(spark, [(1, one)]) == [(1, left, [(at, at + len(line))])]
    apart = "Hello there friend.\nsomething else\nBuy now please."
    assert run_lines(spark, [(0, apart), (1, one)]) == [(0, apart, []), (1, left, [(at, at + len(line))])]


def test_repeated_lines_within_texts_same_as_brute_force(spark):
    draw = random.Random(12)
    sentence = lambda: " ".join(draw.choice("abc") for _ in range(draw.randint(1, 5))) + draw.choice(".!")
    lines = [" ".join(sentence() for _ in range(n)) for n in (1, 2, 2, 2, 3, 3)]
    rows = [(i, "\n".join(draw.choice([*lines, *(sentence() for _ in range(3)), "é–"]) for _ in range(draw.randint(0, 25)))) for i in range(160)]
    got = run_lines(spark, rows)
    assert got == sorted(by_lines(rows), key=str) and sum(len(s) for _, _, s in got) > 200


def test_many_repeats_in_one_long_text(spark):
    line = "é these are the words of a line that comes again and again"
    rows = [(1, "\n".join([line] * 30_000)), (2, "ü " + line + "\n" + line)]
    (_, first, spans), (_, second, more) = run_lines(spark, rows)
    size = len(line) + 1
    assert first == line + "\n" and spans == [(size, 30_000 * size - 1)]
    assert second == "ü " + line + "\n" and more == [(len(line) + 3, 2 * len(line) + 3)]
