"""Chat rotation against brute force; licence scans on spellings, copyright lines and levels."""

import pytest
from llm import brute

from postloom.llm import chat
from postloom.llm.chat import rotate_perspectives
from postloom.llm.licenses import KNOWN, TEXTS, entire_texts, scan_licenses
from postloom.llm.queries import QUERIES

TURNS = "conv_id long, turn long, role string, text string"
ROWS = [
    (1, 0, "system", "Be kind."), (1, 1, "ann", "Hi <|end|> \\ you"), (1, 2, "bob", "é😀\n"), (1, 3, "ann", None), (1, 4, "c\nd", "x"), (1, 4, "ann", "tie"), (1, 4, "ann", "tie"),
    (2, 5, None, "alone"), (2, None, "bob", "first"), (3, 0, "system", "nobody"), (None, 0, "ann", "lost"), (4, 300, "ann", "late"), (4, 1, "bob", "early"), (4, 2, "bob", ""),
]


def rendered(spark, rows):
    out = {}
    for r in rotate_perspectives(spark.createDataFrame(rows, TURNS).repartition(3)).orderBy("conv_id", "speaker", "part").collect():
        text, spans = out.setdefault((r.conv_id, r.speaker), ("", []))
        assert r.offset == len(text)
        out[r.conv_id, r.speaker] = (text + r.text, spans + [(s["start"] + len(text), s["end"] + len(text)) for s in r.mask])
    return out


@pytest.mark.parametrize("turns", [128, 2])
def test_rotation(spark, monkeypatch, turns):
    monkeypatch.setattr(chat, "PART_TURNS", turns)
    assert rendered(spark, ROWS) == brute.rotate(ROWS)


def test_rotation_round_trip_and_no_rows(spark):
    text, spans = rendered(spark, ROWS)[1, "ann"]
    said = [text[a:b].removesuffix("<|end|>").replace("\\<|", "<|").replace("\\\\", "\\") for a, b in spans]
    assert said == ["Hi <|end|> \\ you", "", "tie", "tie"]
    assert rendered(spark, []) == {}


def scanned(spark, texts, known=KNOWN):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = scan_licenses(df, spark.createDataFrame(known, "license string, license_text string"))
    return sorted((r.doc_id, r.license, r.level, r.places) for r in out.collect())


def test_licenses(spark):
    mit = next(t for i, t in KNOWN if t.startswith("Permission is hereby"))
    texts = [
        "Licensed under the Apache License, Version 2.0.", "x\nlicenced under the apache LICENCE -- version 2.0\ny\nLicensed under the Apache License, Version 2.0\n",
        "Copyright (c) 2020 A. Person\n\n" + mit.replace("sublicense", "sub-license").replace(" ", "  "), "intro\n\nThis work is licensed under the\nGNU General Public License, version 3.\n\nend",
        "not Licensed under the Apache License, Version 2.0.", None, "", "...\n", "Released under the MIT License.\nLicensed under CC BY-NC 4.0.", "w " * 20_000,
    ]
    assert scanned(spark, texts) == [
        (0, "Apache-2.0", "text", 1), (1, "Apache-2.0", "line", 2), (2, "MIT", "text", 1), (3, "GPL-3.0", "paragraph", 1), (8, "CC-BY-NC-4.0", "line", 1), (8, "MIT", "line", 1),
    ]


def test_licenses_of_odd_tables(spark):
    assert scanned(spark, []) == [] and scanned(spark, ["Released under the MIT License."], [(None, "x"), ("X", None), ("Y", "..")]) == []
    df = spark.createDataFrame([(None, "Released under the MIT License."), (1, "Released under the MIT License."), (1, "Released under the MIT License.")], "doc_id int, text string")
    out = scan_licenses(df, spark.createDataFrame(KNOWN, "license string, license_text string")).collect()
    assert [tuple(r) for r in out] == [(1, "MIT", "text", 2)]


def test_entire_texts_of_the_query(spark, tmp_path):
    names = sorted(p.stem for p in TEXTS.glob("*.txt"))
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "CC0-1.0"} <= set(names)
    whole = [(TEXTS / f"{n}.txt").read_text(encoding="utf-8") for n in names]
    apache, bsd = whole[names.index("Apache-2.0")], whole[names.index("BSD-3-Clause")]
    cut = apache[:apache.index("END OF TERMS")]
    texts = [*whole, cut, "BSD 3-Clause License\n\nCopyright (c) 2020, A. Person\nAll rights reserved.\n\n" + bsd.replace("\n   ", " "), apache.replace("royalty", "fee"), bsd + "more words"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted((r.doc_id, r.license) for r in QUERIES["op9_license_scan"](spark, str(tmp_path)).collect() if r.level == "text")
    n = len(names)
    assert found == [*enumerate(names), (n, "Apache-2.0"), (n + 1, "BSD-3-Clause")]
    assert {i for i, _ in entire_texts()} >= set(names)
