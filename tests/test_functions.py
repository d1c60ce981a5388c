import datetime

import pytest
from pyspark.sql import functions as F

from veldra.functions import geometry as G
from veldra.functions import text as X


def col(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_checksums(spark):
    assert col(spark, X.verhoeff_valid, ["2363", "1428570", "123451", "2364", "", "abc", "1234 5678", None]) == [True, True, True, False, False, False, False, False]
    assert col(spark, X.verhoeff_digit, ["236", "142857", "12345", "x"]) == [3, 0, 1, None]


def test_every_single_change_and_swap_is_noticed(spark):
    n = "428571236043"
    d = col(spark, X.verhoeff_digit, [n])[0]
    n += str(d)
    changed = [n[:i] + str(x) + n[i + 1 :] for i in range(len(n)) for x in range(10) if str(x) != n[i]] + [n[:i] + n[i + 1] + n[i] + n[i + 2 :] for i in range(len(n) - 1) if n[i] != n[i + 1]]
    assert col(spark, X.verhoeff_valid, [n])[0] and not any(col(spark, X.verhoeff_valid, changed))


def test_identity_numbers(spark):
    assert col(spark, X.card_number_problem, [None, " ", "123456789012", "1234 5678 9012", "12345678901", "1234-5678-9012", "12345678 9012"])[2:] == ["aadhaar_checksum_mismatch"] * 2 + ["invalid_aadhaar_format"] * 3
    assert col(spark, X.account_number_problem, [None, "abcpk1234f ", "ABCXK1234F", "\t"]) == ["missing_field", None, "invalid_pan_format", "missing_field"]


def test_birth_dates(spark):
    today = F.lit(datetime.date(2025, 1, 1))
    v = ["15/08/1990", "29/02/2024", "31/02/2024", "1/1/2000", "31/12/2024", "01/01/2025", "02/01/2025", None, " ", "01/01/0000", "2024-01-01", "aa/bb/cccc"]
    want = [None, None, "invalid_date", "invalid_date_format", None, None, "future_date", "missing_field", "missing_field", "invalid_date", "invalid_date_format", "invalid_date_format"]
    assert col(spark, lambda c: X.birth_date_problem(c, today), v) == want


def test_names_and_tokens(spark):
    assert col(spark, X.source_stem, ["a_jpg.rf.0188ba6593c38a70e56de2509a244a4d", "plain", "x.rf.NOTHEX", None]) == ["a_jpg", None, None, None]
    assert col(spark, X.redact_token, ["3", "0.21015625", "1234", "ABCDE1234F", "Ram", "-12", "1.5e-3", None]) == ["3", "0.21015625", "####", "XXXXX####X", "Xxx", "-12", "1.5e-3", None]
    assert col(spark, X.extension_of, ["a/b.TXT", "a/b", "a/.hidden", "a.b/c.tar.gz"]) == [".txt", "<none>", "<none>", ".gz"]
    assert col(spark, lambda c: X.ellipsize(c, 5), ["abcde", "abcdefgh", ""]) == ["abcde", "ab…gh", ""]
    assert col(spark, X.reference_problem, ["", " a", "a\tb", ":x", "ok", None]) == ["empty", "outer_whitespace", "control_character", "leading_colon", None, None]


def test_ids(spark):
    assert col(spark, X.encode_text, ["AB", "", "é", None]) == [[1, 2], None, None, None]
    assert col(spark, X.decode_ids, [[1, 0, 2], []], "array<int>") == ["AB", ""]
    assert col(spark, X.ctc_collapse, [[1, 1, 0, 1, 2, 2], [0, 0], []], "array<int>") == [[1, 1, 2], [], []]


def test_geometry(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0.2, 0.1)], "a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE")
    assert [round(x, 9) for x in df.select(*G.corners(*map(F.col, "abcd"))).first()] == [0.4, 0.45, 0.6, 0.55]
    p = col(spark, G.points_of, [[0.0, 0.0, 2.0, 0.0, 2.0, 1.0], [0.0] * 5, [], None], "array<double>")
    assert len(p[0]) == 3 and p[1:] == [None, None, None]
    assert col(spark, lambda c: G.twice_area(G.points_of(c)), [[0.0, 0.0, 2.0, 0.0, 2.0, 1.0], [0.0, 0.0, 1.0, 1.0, 2.0, 2.0]], "array<double>") == [2.0, 0.0]
    one = spark.range(1)
    box = lambda *v: [F.lit(float(x)) for x in v]
    assert one.select(G.iou(box(0, 0, 10, 10), box(5, 0, 15, 10)).alias("i")).first().i == pytest.approx(50 / 150)
    assert one.select(G.iou(box(0, 0, 0, 0), box(0, 0, 0, 0)).alias("i")).first().i == 0
    assert list(one.select(*G.clip(*box(-30, -10, 50, 20), F.lit(200), F.lit(100))).first()) == [0, 0, 50, 20]
    assert col(spark, lambda c: G.aspect_bucket(c, F.lit(100)), [49, 50, 100, 199, 200], "int") == ["<0.5", "0.5-0.75", "1.0-1.25", "1.75-2.0", ">=2.0"]


def test_hashes(spark):
    assert col(spark, G.average_hash, [[0] * 63 + [1], [5] * 64], "array<int>") == [1, 0]
    assert col(spark, G.difference_hash, [[9, 8, 7, 6, 5, 4, 3, 2, 1] * 8], "array<int>") == [-1]
    assert spark.range(1).select(G.hamming(F.lit(10), F.lit(9)).alias("x")).first().x == 2


def test_recognised_texts(spark):
    steps = [[[-3.0, -0.5, -2.0], [-3.0, -0.5, -2.0], [-0.1, -9.0, -9.0], [-3.0, -0.5, -2.0]], [[-0.1, -3.0, -3.0]], []]
    assert col(spark, X.greedy_path, steps, "array<array<double>>") == [[1, 1], [], []]
    got = col(spark, X.path_confidence, steps, "array<array<double>>")
    assert got[0] == pytest.approx(2.718281828 ** (-1.6 / 4)) and got[1:] == [0.0, 0.0]
    assert [tuple(x) for x in col(spark, lambda c: X.clean_result(c, F.lit(0.5)), [" a ", " ", None])] == [("a", 0.5), ("", 0.0), (None, 0.0)]
