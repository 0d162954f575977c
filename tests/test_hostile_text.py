"""Text functions on long and hostile texts: the matcher must neither overflow its stack nor take quadratic time."""

import time

import pytest

from pyspark.sql import functions as F

from ragloom.functions import text as T

TEXTS = {
    "prose": "word and more " * 70_000, "letters": "a" * 1_000_000, "dots": "a." * 400_000, "dashes": "A1" + "-b" * 300_000, "spaces": "SOP" + " " * 800_000 + "7", "separators": "AB" + "_-" * 300_000 + "1",
    "alarms": "E-020 " * 20_000, "labels": "PART NO. " * 50_000, "digits": "7" * 800_000, "models": "PixLab B5 " * 30_000,
}


@pytest.mark.parametrize("kind", sorted(TEXTS))
def test_long_texts_end_soon(spark, kind):
    df = spark.createDataFrame([(TEXTS[kind],)], "t string")
    began = time.time()
    row = df.select(F.length(T.identifier_variants("t")).alias("v"), F.size(T.extract_identifiers("t")).alias("n"), F.size(T.model_code_aliases("t")).alias("m")).first()
    assert row.v is not None and row.n >= 0 and time.time() - began < 60


def test_identifiers_of_mixed_separators(spark):
    cases = {"SOP 2024-01": "SOP202401 SOP-202401 SOP 202401", "AB_123_X": "AB123X AB-123X AB 123X", "A1--b": "A1B A-1B A 1B", "hak-180 and HAK 180": "HAK180 HAK-180 HAK 180", "no code": "", "型号E 021故障": "E021 E-021 E 021"}
    got = {r.t: r.v for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", T.identifier_variants("t").alias("v")).collect()}
    assert got == cases


def test_typed_identifiers(spark):
    cases = {
        "Press (QT-55) leaks": {"equipment_model": ["QT 55"]}, "first e 311, later E-0312!": {"alarm_code": ["E311", "E0312"]}, "read the sop, page 7": {"equipment_model": ["PAGE 7"]},
        "料号: zx_900 / sop-14": {"sop_code": ["SOP-14"], "part_number": ["ZX-900"]}, "part no. KL 7B": {"part_number": ["KL-7B"]}, "SOP77-09_Y": {"sop_code": ["SOP-77-09-Y"]},
    }
    got = {r.t: r.v for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", T.extract_identifiers("t").alias("v")).collect()}
    assert got == cases


def test_model_names_have_words_of_any_number_and_length(spark):
    words = " ".join(f"w{'x' * i}" for i in range(1, 60))
    cases = {
        "Alpha Beta C7": [("Alpha Beta", "C7")], "Alpha BC7": [("Alpha BC", "7")], "AB12C": [("AB", "12C")], "A1": [("A", "1")], "12AB": [], "12 AB34": [("AB", "34")], "one, two 3": [("two", "3")],
        "a_b-9x 8": [("a b", "9x")], "7 up 8": [("up", "8")], words + " 5": [(words, "5")], "z" * 90 + "1" * 90: [("z" * 90, "1" * 90)], "": [], "no digits": [],
    }
    got = {r.t: [tuple(x) for x in r.v] for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", T.model_names(F.col("t")).alias("v")).collect()}
    assert got == cases


def test_character_grams(spark):
    texts = ["", "a", "ab", "abab", "ä😀b字", None, "xyz" * 30_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", *(T.char_ngrams("t", n).alias(f"g{n}") for n in (2, 3)), T.jaccard(T.char_ngrams("t", 2), F.array(F.lit("ab"), F.lit("zz"))).alias("j")).collect()
    for r in rows:
        t = texts[r.i] or ""
        for n in (2, 3):
            assert r[f"g{n}"] == list(dict.fromkeys(t[k : k + n] for k in range(max(1, len(t) - n + 1)))) * bool(t)
        own = set(r.g2)
        assert abs(r.j - len(own & {"ab", "zz"}) / len(own | {"ab", "zz"})) < 1e-12
