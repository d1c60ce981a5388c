import random

import pytest

from veldra.sources import feeds
from veldra.storage import Scratch
from veldra.streaming import decisions

GOOD = "pan,train/images/{n}.jpg,a.jpg,train,valid,g1,near_duplicate,high,{h},ffffffffffffffff,10,20,3,{note}"


def record(n, note="x"):
    return GOOD.format(n=n, h="0A" * 32, note=note)


@pytest.mark.parametrize(
    "raw,problem,at",
    [("0 .5 .5 0 .1", "zero_or_negative_size", 8), ("2 0.2 0.2 0.3 2", "coord_out_of_range", 14), ("  1 .5 .5 .1 -.1", "zero_or_negative_size", 13), ("1 1 x1 x", "malformed_line", 4), (" -1 -1 1 1 1", "invalid_class_id", 1)],
)
def test_places_of_tokens_that_recur(spark, raw, problem, at):
    r = feeds.parse_label_lines(spark.createDataFrame([(1, raw)], "row_id BIGINT, raw STRING")).first()
    assert (r.problem, r.at, r.col) == (problem, at, at + 1)


def test_large_numbers_load(spark, tmp_path):
    from veldra.plans import catalogue, core_queries

    lines = [(1, "f", 1, "1e30 .5 .5 .1 .1"), (2, "f", 2, "1e40 .5 .5 .1 .1"), (3, "f", 3, "3 .5 .5 .1 .1")]
    spark.createDataFrame(lines, "row_id BIGINT, label_path STRING, line INT, raw STRING").write.parquet(f"{tmp_path}/label_lines.parquet")
    big = record(1).replace(",10,", f",{10**25},").replace(",20,", f",{10**40},")
    spark.createDataFrame([(1, big)], "row_id BIGINT, raw STRING").write.parquet(f"{tmp_path}/manifest_raw.parquet")
    d = str(tmp_path)
    assert core_queries.p2_found(spark, d).count() == 0
    assert [r.class_id for r in core_queries.p2_annotations(spark, d).orderBy("row_id").collect()] == [None, None, 3]
    assert [tuple(r) for r in core_queries.p2_manifest(spark, d).select("width", "height", "annotation_count").collect()] == [(None, None, 3)]
    assert int(feeds.parse_label_lines(spark.read.parquet(f"{d}/label_lines.parquet")).where("row_id = 1").first().class_id) == int(1e30)
    for name in ("label_issue_counts", "class_remap", "label_class_profile", "converted_files", "label_anomalies"):
        catalogue.QUERIES[name](spark, d).collect()


def test_skipped_lines_are_rows(spark):
    broken = record(2, '"no end')
    feed = "\n".join([record(1), broken, "pan,not a path,x", "", "free text", record(3), record(4).replace("pan", "other", 1)]) + "\r\n"
    df = spark.createDataFrame([(1, feed)], "row_id BIGINT, raw STRING")
    got = [(r.problem, r.line) for r in feeds.parse_manifest(df, False, True).collect()]
    assert [x for x in got if x[0]] == [("broken_quoting", 2), ("skipped_line", 3), ("skipped_line", 5), ("invalid_value", 7)] and len(got) == 6


def test_batches_are_feeds_with_known_starts(spark):
    raws = [record(1), record(2, '"open'), record(3, '"a\nb"'), None, "", record(4, "a\nb") + "\r", record(5, 'x"y'), record(6)]
    df = spark.createDataFrame(list(enumerate(raws)), "row_id BIGINT, raw STRING").coalesce(1)
    got = {r.row_id: (r.problem, r.line, r.notes) for r in feeds.parse_manifest(df).collect()}
    assert got == {0: (None, None, "x"), 1: ("broken_quoting", 1, None), 2: (None, None, "a\nb"), 3: ("column_count", 1, None), 4: ("column_count", 1, None), 5: (None, None, "a\nb"), 6: ("broken_quoting", 1, None), 7: (None, None, "x")}


@pytest.mark.parametrize("size", [200, 1000, 100_000])
def test_files_are_read_by_blocks(spark, tmp_path, size):
    rnd, want, out = random.Random(size), [], []
    for n in range(120):
        kind = rnd.choice(["good", "good", "lines", "open", "short", "stray"])
        note = {"lines": '"two\nlines, ""quoted"""', "open": '"no end'}.get(kind, "x")
        out.append(record(n, note) if kind not in ("short", "stray") else f"pan,train/images/{n}.jpg,a.jpg" if kind == "short" else record(n, '"open') + "\nstray")
        want += [{"good": None, "lines": None, "open": "broken_quoting", "short": "column_count", "stray": "broken_quoting"}[kind]] + ["skipped_line"] * (kind == "stray")
    (tmp_path / "a.csv").write_text("\n".join(out) + "\n")
    (tmp_path / "b.csv").write_text("no record\nat all\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = feeds.read_manifest_feed(spark, str(tmp_path), Scratch(spark, "t")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    a = [r for r in got if r.file.endswith("a.csv")]
    assert sorted(str(r.problem) for r in a) == sorted(map(str, want))
    good = {r.image_rel_path for r in a if not r.problem}
    assert len(good) == want.count(None) and (size == 100_000 or len({r.piece for r in a}) > 1)
    assert [r.problem for r in got if r.file.endswith("b.csv")] == ["column_count", "column_count"]


def test_latest_by_bucket(spark, tmp_path):
    from veldra.sources import tables

    schema = "line_no BIGINT, sample_id STRING, status STRING, text STRING, recorded_at TIMESTAMP"
    log, table = str(tmp_path / "log"), str(tmp_path / "t")
    for keep, at in ((decisions.keep_latest, "w"), (decisions.keep_latest_by_bucket, "b")):
        for rows in ([(1, "a", "skipped", None, None), (2, "b", "verified", "x", None)], [(3, "a", "verified", "y", None)], [(4, "a", "skipped", None, None)], [(5, "c", "skipped", None, None)]):
            tables.append_decisions(spark.createDataFrame(rows, schema), log + at)
            keep(decisions.read_log(spark, log + at), table + at, str(tmp_path / f"cp{at}")).awaitTermination()
    want = {("a", 4, "skipped", None), ("b", 2, "verified", "x"), ("c", 5, "skipped", None)}
    assert {tuple(r) for r in decisions.read_latest(spark, table + "b").collect()} == want
    assert {p.name for p in (tmp_path / "tw").iterdir()} == {"v2", "v3"}
    assert len(list((tmp_path / "tb").glob("v*/bucket=*"))) == 4 and decisions.read_latest(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "tw" / "v3" / "part-bad.parquet").write_text("no parquet")
    tables.append_decisions(spark.createDataFrame([(6, "c", "skipped", None, None)], schema), log + "w")
    with pytest.raises(Exception):
        decisions.keep_latest(decisions.read_log(spark, log + "w"), table + "w", str(tmp_path / "cpw")).awaitTermination()
