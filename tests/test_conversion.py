from pyspark.sql import functions as F

from veldra.operators import conversion, labels, synthetic

GOOD = [(i, "good", i, f"{k} .5 .5 .2 .1") for i, k in enumerate([0, 1, 4, 3])]
BAD = [(10, "bad", 0, "0 .5 .5 .2 .1"), (11, "bad", 1, "9 .5 .5 .2 .1"), (20, "odd", 0, "0 .5 x .2 .1"), (30, "tiny", 0, "0 .5 .5 .001 .1"), (31, "tiny", 1, "0 .5 .5 .2 .1")]


def checked(spark, rows=GOOD + BAD):
    return labels.with_issues(spark.createDataFrame(rows, "row_id INT, label_path STRING, line INT, raw STRING"))


def test_a_bad_line_rejects_its_file_alone(spark):
    m = spark.createDataFrame([(0, 3), (1, 1), (2, 2), (3, 0), (4, None)], "class_id BIGINT, target INT")
    got = {r.label_path: r for r in conversion.convert_files(checked(spark), m).collect()}
    assert (got["good"].ok, got["good"].n_fields, got["good"].n_excluded, [f.target for f in got["good"].fields]) == (True, 3, 1, [3, 1, 0])
    assert [(got[k].ok, got[k].n_fields, got[k].n_excluded) for k in ("bad", "odd")] == [(False, 0, 0)] * 2
    assert conversion.convert_files(checked(spark).limit(0), m).count() == 0


def test_candidates(spark):
    i = spark.createDataFrame([("good", 640, 640), ("tiny", 640, 640)], "label_path STRING, width INT, height INT")
    names = F.create_map(F.lit(0).cast("bigint"), F.lit("name"), F.lit(1).cast("bigint"), F.lit("gender"))
    got = {(r.label_path, r.line): (r.reason, r.field) for r in conversion.candidates(checked(spark), i, names).collect()}
    assert got[("good", 0)] == (None, "name") and got[("good", 2)][0] == "unknown_class" and got[("bad", 0)][0] == "missing_image" and got[("tiny", 0)][0] == "degenerate_box" and got[("tiny", 1)][0] is None


def test_captions_and_batches(spark):
    assert {tuple(r) for r in conversion.captions(checked(spark).where("label_path in ('good', 'tiny')")).collect()} == {("good", "0, 1, 3, 4"), ("tiny", "0x2")}
    b = spark.createDataFrame([(1, 2, [3]), (1, 1, [1, 2]), (2, 1, [])], "b INT, o INT, t ARRAY<INT>")
    assert {(r.b, tuple(r.targets), tuple(r.lengths)) for r in conversion.collate(b, "b", "o", "t").collect()} == {(1, (1, 2, 3), (2, 1)), (2, (), (0,))}


def test_synthetic_records_depend_on_their_key_alone(spark):
    a = synthetic.records(spark, 200, ["Tarola", "Velenka"], ["Oldadi", "Pelladi"])
    assert a.exceptAll(synthetic.records(spark, 300, ["Tarola", "Velenka"], ["Oldadi", "Pelladi"]).where("id < 200").repartition(7)).count() == 0
    rows = a.collect()
    assert all(r.pan_number[3] == "P" and r.pan_number[4] == r.name.split()[1][0].upper() and r.aadhaar_number[0] in "23456789" and len(r.aadhaar_number) == 14 for r in rows)
    by: dict = {}
    for r in rows:
        by.setdefault(r.name.upper(), set()).add(r.split)
    assert all(len(v) == 1 for v in by.values())
    assert synthetic.samples(a, ["name", "gender"]).count() == 400
