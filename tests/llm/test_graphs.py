import random

import pytest

from veldra.llm import graph, match_groups, splits
from veldra.storage import Scratch


def components(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


def cases():
    rnd = random.Random(5)
    chain = [(i, i + 1) for i in range(1, 60)]
    mixed = list(range(1000, 1060))
    rnd.shuffle(mixed)
    star = [(500, i) for i in range(501, 560)]
    yield "all", chain + list(zip(mixed, mixed[1:])) + star + [(2000, 2001), (2001, 2000), (7000, 7000), (None, 3), (3, None), (3, 2), (2, 3)]
    yield "random", [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)]
    yield "empty", []


@pytest.mark.parametrize("name,edges", list(cases()))
def test_components(spark, name, edges):
    df = spark.createDataFrame(edges, "u BIGINT, v BIGINT")
    want = components(edges)
    assert {r.id: r.component for r in graph.star_components(df, Scratch(spark, "t")).collect()} == want
    for rounds in (3, 100):
        assert {r.id: r.component for r in graph.peeled_components(df, Scratch(spark, "t"), rounds).collect()} == want


RECORDS = "image_id BIGINT, group_id STRING, roboflow_source STRING, raw_split STRING, component STRING, n INT"


def records(spark):
    rows = [
        (1, "G-1", "a_1_jpg", "train", "x", 1), (2, "g_1", "b_jpg", "valid", None, 2), (3, None, "B.jpg", "TRAIN", None, None), (3, None, "B.jpg", "train", None, None), (4, "?", "unknown", "test", None, 1),
        (5, "n/a", "", "train", None, 1), (6, "g9", None, "train", None, 1), (7, "G9", "z", "training", None, 1), (8, None, None, None, None, None), (None, "g9", "z", "test", None, 1), (9, "g9", "q", None, None, 1),
    ]
    return spark.createDataFrame(rows, RECORDS)


def test_records_tied_together_share_a_split(spark):
    got = {r.image_id: r.component for r in splits.record_components(records(spark), Scratch(spark, "t")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8, 9: 6}
    assert {r[0] for r in splits.straddling_records(records(spark), Scratch(spark, "t")).collect()} == {1, 2, 3}
    empty = records(spark).limit(0)
    assert splits.record_components(empty, Scratch(spark, "t")).count() == splits.straddling_records(empty, Scratch(spark, "t")).count() == 0


def test_proportions(spark):
    c = spark.range(20_000).selectExpr("id AS image_id", "id AS component")
    n = {r.split: r["count"] for r in splits.assign_splits(c, (0.5, 0.25, 0.25)).groupBy("split").count().collect()}
    assert abs(n["train"] - 10_000) < 400 and abs(n["valid"] - 5_000) < 300
    assert splits.assign_splits(c).repartition(7).exceptAll(splits.assign_splits(c)).count() == 0
    with pytest.raises(ValueError):
        splits.assign_splits(c, (0.5, 0.5, 0.5))


def test_matches_and_lists(spark):
    images = spark.createDataFrame([(i, "x") for i in (1, 2, 3, 4, 5, 6, 6, None)], "image_id BIGINT, u STRING")
    pairs = spark.createDataFrame([(1, 2, 1, True), (2, 1, 1, True), (2, 99, 1, True), (99, 3, 1, True), (3, 4, 1, False), (3, 4, 1, None), (None, 5, 1, True), (6, 6, 1, True)], "image_id_a BIGINT, image_id_b BIGINT, pair_id BIGINT, is_match BOOLEAN")
    groups = spark.createDataFrame([("g", [4, 98, 5, 5, None]), ("g", [98, 3]), ("h", None), (None, []), (None, [2])], "group_id STRING, members ARRAY<BIGINT>")
    got = {r.image_id: r.group_key for r in match_groups.consolidate(images, pairs, groups, Scratch(spark, "t")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6}
    assert {r[0] for r in match_groups.tied_images(images, pairs, groups, Scratch(spark, "t")).collect()} == {1, 2, 4, 5}
    assert match_groups.tied_images(images.limit(0), pairs.limit(0), groups.limit(0), Scratch(spark, "t")).count() == 0
