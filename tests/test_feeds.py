import pytest

from veldra.sources import feeds

GOOD = 'pan,train/images/a.jpg,a.jpg,train,valid,g1,near_duplicate,high,{h},ffffffffffffffff,10,20,3,"says ""x"", twice"'.format(h="0A" * 32)


def labels(spark, *raws):
    df = spark.createDataFrame([(i, r, "x") for i, r in enumerate(raws)], "row_id BIGINT, raw STRING, problem STRING")
    return {r.row_id: r for r in feeds.parse_label_lines(df).collect()}


@pytest.mark.parametrize(
    "raw,problem",
    [
        ("0 0.5 0.5 abc 0.1", "malformed_line"), ("0 0.5 0,5 0.1 0.1", "malformed_line"), ("1_0 .5 .5 .1 .1", "malformed_line"), ("0 ½ .5 .1 .1", "malformed_line"),
        ("0 0.5 0.5 5f 0.1", "malformed_line"), (". .5 .5 .1 .1", "malformed_line"), ("०  .5 .5 .1 .1", "malformed_line"),
        ("1.5 .5 .5 .1 .1", "invalid_class_id"), ("-1 .5 .5 .1 .1", "invalid_class_id"), ("nan .5 .5 .1 .1", "invalid_class_id"), ("INF .5", "invalid_class_id"),
        ("0 .5 .5 .1", "invalid_token_count"), ("0 .1 .1 .2 .2 .3", "invalid_token_count"), ("0", "invalid_token_count"), ("0 .1 .1 .2 .2 .3 .3 .4", "invalid_token_count"),
        ("0 .5 .5 0 .1", "zero_or_negative_size"), ("0 .5 .5 .1 -2", "zero_or_negative_size"),
        ("0 1.5 .5 .1 .1", "coord_out_of_range"), ("0 .1 .1 .2 .2 .3 -.1", "coord_out_of_range"), ("0 inf .5 .1 .1", "coord_out_of_range"),
        ("2.0 .5 +.5 1e-1 1.", None), ("\t3 0.5\t0.5 .1 .1\r", None), ("0 1.000001 .5 .1 .1", None), ("0 .1 .1 .2 .2 .3 .3", None), ("1 nan .5 .1 .1", None),
    ],
)
def test_label_lines(spark, raw, problem):
    r = labels(spark, raw)[0]
    assert r.problem == problem and (r.class_id is None) == (problem is not None)


def test_lines_without_tokens_give_nothing(spark):
    assert labels(spark, "", " \t ", None) == {}
    assert feeds.parse_label_lines(spark.createDataFrame([], "row_id BIGINT, raw STRING")).count() == 0
    r = labels(spark, "0 .5 .5 x .1", "7 " + " ".join(["0.5"] * 20_000))
    assert (r[0].line, r[0].col) == (1, 9) and r[1].kind == "polygon" and len(r[1].coords) == 20_000


def rows(spark, *raws, one=True):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "row_id BIGINT, raw STRING")
    return sorted(feeds.parse_manifest(df, one).collect(), key=lambda r: (r.row_id, r.at or 0))


def test_manifest_records(spark):
    r = rows(spark, GOOD, GOOD + "\r", GOOD.replace("ffffffffffffffff", ""), GOOD)
    assert [x.problem for x in r] == [None] * 4
    assert (r[0].dhash, int(r[0].width), r[0].notes, r[2].dhash) == (-1, 10, 'says "x", twice', None)


@pytest.mark.parametrize(
    "change,problem",
    [
        (('"says ""x"", twice"', '"says \\"x\\" twice"'), "broken_quoting"), (('"says ""x"", twice"', '"open'), "broken_quoting"), (('"says ""x"", twice"', 'a"b'), "broken_quoting"),
        (('"says ""x"", twice"', ' "a"'), "broken_quoting"), (("a.jpg,a.jpg", "a.jpg"), "column_count"), ((",10,", ",1,0,"), "column_count"),
        (("pan", "PAN"), "invalid_value"), (("valid,g1", "dev,g1"), "invalid_value"), ((",10,", ",-10,"), "invalid_value"), ((",10,", ",,"), "invalid_value"), (("ffff", "fffg"), "invalid_value"),
        (("0A0A", "0A0"), "invalid_value"), (("high", "sure"), "invalid_value"), (('"says ""x"", twice"', "two\nlines"), None), (('"says ""x"", twice"', '"two\nlines"'), None),
    ],
)
def test_manifest_problems(spark, change, problem):
    assert [x.problem for x in rows(spark, GOOD.replace(*change))] == [problem]


def test_nulls_and_empty(spark):
    assert [x.problem for x in rows(spark, None, "")] == ["column_count"] * 2


def test_feed_resumes_at_the_next_record_start(spark):
    broken = GOOD.replace('"says ""x"", twice"', '"no end')
    feed = "\n".join([GOOD, broken, "pan,not a path,x", GOOD, GOOD.replace("pan", "other", 1)]) + "\r\n"
    r = rows(spark, feed, one=False)
    assert sorted(str(x.problem) for x in r) == ["None", "None", "broken_quoting", "invalid_value"]
    assert next(x.line for x in r if x.problem == "broken_quoting") == 2


def test_feed_resumes_at_records_of_any_dataset_and_folder(spark):
    broken = GOOD.replace('"says ""x"", twice"', '"no end')
    other, flat = GOOD.replace("pan", "other", 1), GOOD.replace("train/images/", "")
    r = rows(spark, "\n".join([broken, other, flat, broken.replace("train/images/", ""), flat]), one=False)
    assert [(x.problem, x.line) for x in r if x.problem] == [("broken_quoting", 1), ("invalid_value", 2), ("broken_quoting", 4)]
    assert sum(x.problem is None for x in r) == 2
