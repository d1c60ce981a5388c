"""Queries of the catalogue bound to the tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..functions.normal import name_key, place_key, sha_key, split_name
from ..operators import audit, conversion, documents, grouping, inventory, labels, metrics, pairing, queues, statistics, synthetic
from ..storage import Scratch
from ..vocab import ALPHABET, CLASS_MAP, DETECTOR, FIELDS, SPLITS
from .sql import NUM as _NUM
from .sql import PLACE as _PLACE
from .sql import SHA as _SHA
from .sql import SPLIT as _SPLIT

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

c, lit = F.col, F.lit


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


_IMAGES = f"SELECT DISTINCT image_id, rel_path, {_SPLIT} AS split, {_SHA} AS sha, dhash, width, height, label_path FROM image_records"


def places(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "small_files").select("file_id", "kind", place_key(c("file_path")).alias("path"), "content").where("path is not null")


def images(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "image_records").select("image_id", "rel_path", split_name(c("raw_split")).alias("split"), sha_key(c("sha256")).alias("sha"), "dhash", "width", "height", "label_path").distinct()


# ---- sources and inventory


@query(f"""WITH f AS (SELECT regexp_replace(p, '/?[^/]*$', '') AS dir, CASE WHEN regexp_extract(p, '[^/]+(\\.[^./]+)$', 1) = '' THEN '<none>' ELSE lower(regexp_extract(p, '[^/]+(\\.[^./]+)$', 1)) END AS ext FROM (SELECT {_PLACE} AS p FROM small_files))
    SELECT dir, ext, count(*) AS n_files FROM f GROUP BY GROUPING SETS ((ext), (dir, ext))""")
def inventory_by_extension(s, d):
    return inventory.count_by_extension(places(s, d))


@query(f"""WITH f AS (SELECT list_distinct(string_split(lower(regexp_replace({_PLACE}, '/?[^/]*$', '')), '/')) AS p FROM small_files)
    SELECT name, count(*) AS n_files FROM (SELECT unnest(p) AS name FROM f) WHERE name IN ('train', 'valid', 'test') GROUP BY name""")
def split_names_in_paths(s, d):
    return inventory.split_names_in_paths(places(s, d))


@query("""SELECT name, n IS NOT NULL AS present, coalesce(n, 0) AS n_rows FROM (VALUES ('aadhaar'), ('pan'), ('driving_license'), ('passport')) AS v(name)
    LEFT JOIN (SELECT dataset, count(*) AS n FROM image_records GROUP BY dataset) ON dataset = name""")
def discover_counts(s, d):
    return inventory.count_present(t(s, d, "image_records"), "dataset", ["aadhaar", "pan", "driving_license", "passport"])


@query(f"""WITH f AS (SELECT string_split({_PLACE}, '/') AS p FROM small_files), g AS (SELECT p[1] AS split, CASE WHEN len(p) > 2 THEN p[2] END AS kind FROM f)
    SELECT split, coalesce(bool_or(kind = 'images'), false) AS has_images, coalesce(bool_or(kind = 'labels'), false) AS has_labels, count(*) AS n_files FROM g GROUP BY split HAVING bool_or(kind IN ('images', 'labels'))""")
def layout(s, d):
    return inventory.detect_layout(places(s, d))


@query(f"""WITH f AS (SELECT {_PLACE} AS path FROM small_files), g AS (SELECT path, string_split(path, '/') AS p FROM f)
    SELECT path FROM g WHERE NOT (len(p) > 2 AND p[1] IN ('train', 'valid', 'test') AND p[2] IN ('images', 'labels'))""")
def layout_unexpected(s, d):
    return inventory.unexpected_entries(places(s, d))


@query(f"""WITH f AS (SELECT DISTINCT lower(regexp_replace(p, '/?[^/]*$', '')) AS dir, regexp_extract(p, '[^/]*$') AS name FROM (SELECT {_PLACE} AS p FROM small_files))
    SELECT dir, string_agg(name, '|' ORDER BY name) AS names FROM f GROUP BY dir, lower(name) HAVING count(*) > 1""")
def case_collisions(s, d):
    return inventory.case_collisions(places(s, d))


_RED = r"CASE WHEN regexp_matches(x, '^-?([0-9]{1,3}|[0-9]*\.[0-9]+(e-?[0-9]+)?)$') THEN x ELSE regexp_replace(regexp_replace(regexp_replace(x, '\p{Lu}', 'X', 'g'), '[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]', 'x', 'g'), '\p{Nd}', '#', 'g') END"


@query(f"""WITH l AS (SELECT file_id, list_slice(regexp_split_to_array(content, '\\r\\n|[\\n\\r]'), 1, 3) AS l FROM small_files)
    SELECT file_id, array_to_string(list_transform(l, lambda y: array_to_string(list_transform(string_split(y, ' '), lambda x: {_RED}), ' ')), chr(10)) AS preview FROM l""")
def preview(s, d):
    return inventory.preview(t(s, d, "small_files"), "file_id", "content")


@query("""WITH b AS (SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 97 <> 1),
    a AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 97 = 3 THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 97 <> 2)
    SELECT o_orderkey, CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT *, 1 AS k FROM b) b FULL JOIN (SELECT *, 1 AS k FROM a) a USING (o_orderkey)
    WHERE b.k IS NULL OR a.k IS NULL OR a.o_totalprice IS DISTINCT FROM b.o_totalprice OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus""")
def listing_changes(s, d):
    o = t(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    after = o.where("o_orderkey % 97 <> 2").withColumn("o_orderstatus", F.when(c("o_orderkey") % 97 != 3, c("o_orderstatus")))
    return inventory.compare_listings(o.where("o_orderkey % 97 <> 1"), after, "o_orderkey", ["o_totalprice", "o_orderstatus"])


@query(f"""WITH i AS ({_IMAGES}), n AS (SELECT label_path, count(*) AS n FROM (SELECT DISTINCT label_path, line, raw FROM label_lines) WHERE trim(raw, ' ' || chr(9) || chr(10) || chr(13)) <> '' GROUP BY label_path)
    SELECT image_id, label_path, coalesce(n, 0) AS n_lines, CASE WHEN label_path IS NULL THEN 'missing_label_file' END AS issue FROM i LEFT JOIN n USING (label_path)""")
def image_records_with_labels(s, d):
    return labels.records_with_labels(images(s, d), t(s, d, "label_lines")).select("image_id", "label_path", "n_lines", "issue")


@query("""SELECT split, sample_id, text FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY sample_id, created_at, text) AS n FROM recognition_samples WHERE split IN ('train', 'valid', 'test')) WHERE n <= 20""")
def first_of_split(s, d):
    r = t(s, d, "recognition_samples").where(c("split").isin(SPLITS))
    return queues.first_rows(r, "split", ["sample_id", F.asc_nulls_last("created_at"), F.asc_nulls_last("text")], 20).select("split", "sample_id", "text")


# ---- projections


@query("""SELECT l_orderkey, l_linenumber, l_quantity / 64 - l_linenumber / 16.0 / 2 AS x1, l_quantity / 32 - l_linenumber / 8.0 / 2 AS y1, l_quantity / 64 + l_linenumber / 16.0 / 2 AS x2, l_quantity / 32 + l_linenumber / 8.0 / 2 AS y2 FROM lineitem""".replace("16.0", "CAST(16 AS DOUBLE)").replace("8.0", "CAST(8 AS DOUBLE)"))
def box_corners(s, d):
    q, n = c("l_quantity"), c("l_linenumber")
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", *G.corners(q / 64, q / 32, n / lit(16.0), n / lit(8.0)))


_Q = "CAST(floor(embedding[{i}] * 100) AS DOUBLE)"
_XS, _YS = [[_Q.format(i=i) for i in r] for r in ((1, 3, 5, 7), (2, 4, 6, 8))]
_AREA = " + ".join(f"{_XS[i]} * {_YS[(i + 1) % 4]} - {_XS[(i + 1) % 4]} * {_YS[i]}" for i in range(4))


@query(f"SELECT vec_id, least({', '.join(_XS)}) AS x1, least({', '.join(_YS)}) AS y1, greatest({', '.join(_XS)}) AS x2, greatest({', '.join(_YS)}) AS y2, abs({_AREA}) AS twice_area FROM embeddings")
def polygon_boxes(s, d):
    flat = F.transform("embedding", lambda x: F.floor(x * 100).cast("double"))
    return t(s, d, "embeddings").select("vec_id", G.points_of(flat).alias("p")).select("vec_id", *G.enclosing(c("p")), G.twice_area(c("p")).alias("twice_area"))


@query(f"""WITH i AS (SELECT image_id, width, height, (image_id % 16) / CAST(16 AS DOUBLE) AS x, (image_id % 8) / CAST(8 AS DOUBLE) AS y FROM ({_IMAGES}))
    SELECT image_id, x * width AS ax, y * height AS ay, CASE WHEN width > 0 AND height > 0 THEN image_id % 16 / CAST(width AS DOUBLE) END AS nx, CASE WHEN width > 0 AND height > 0 THEN image_id % 8 / CAST(height AS DOUBLE) END AS ny FROM i""")
def point_scaling(s, d):
    i = images(s, d)
    flat = lambda a, b: F.array(F.struct(a.cast("double").alias("x"), b.cast("double").alias("y")))
    a = G.to_absolute(flat((c("image_id") % 16) / 16, (c("image_id") % 8) / 8), c("width"), c("height"))[0]
    n = G.to_normalized(flat(c("image_id") % 16, c("image_id") % 8), c("width").cast("double"), c("height").cast("double"))[0]
    return i.select("image_id", a["x"].alias("ax"), a["y"].alias("ay"), n["x"].alias("nx"), n["y"].alias("ny"))


@query(f"SELECT image_id, least(CAST(1 AS DOUBLE), CAST(640 AS DOUBLE) / greatest(width, height)) AS scale FROM ({_IMAGES}) WHERE width > 0")
def display_scales(s, d):
    return images(s, d).where("width > 0").select("image_id", G.display_scale(c("width"), c("height"), 640).alias("scale"))


@query("""SELECT l_orderkey, l_linenumber, greatest(0, least(40, CAST(floor(l_quantity - 9.5) AS BIGINT))) AS x1, greatest(0, least(30, CAST(floor(l_linenumber * 7 - 12.5) AS BIGINT))) AS y1,
    greatest(0, least(40, CAST(ceil(l_quantity + 2.25) AS BIGINT))) AS x2, greatest(0, least(30, CAST(ceil(l_linenumber * 7 + 2.25) AS BIGINT))) AS y2 FROM lineitem""")
def clipped_boxes(s, d):
    q, n = c("l_quantity"), c("l_linenumber").cast("double") * 7
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", *G.clip(q - 9.5, n - 12.5, q + 2.25, n + 2.25, lit(40), lit(30)))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber < 3 OR l_quantity < 10 THEN 'reversed' END AS problem FROM lineitem WHERE l_linenumber < 3 OR l_quantity < 10""")
def reversed_boxes(s, d):
    """Boxes from (3, 10) to line number and quantity."""
    problem = G.box_problem(lit(3), lit(10), c("l_linenumber"), c("l_quantity"))
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", problem.alias("problem")).where("problem is not null")


_VALUES = ", ".join(f"('{k}', '{f}')" for k, fs in FIELDS.items() for f in fs)


@query(f"""SELECT sample_id, document_type, field_name FROM recognition_samples r WHERE NOT EXISTS (SELECT 1 FROM (VALUES {_VALUES}) AS v(dt, f) WHERE dt = r.document_type AND f = r.field_name)""")
def fields_outside_vocabulary(s, d):
    return documents.outside_vocabulary(t(s, d, "recognition_samples")).select("sample_id", "document_type", "field_name")


_DET = ", ".join(f"('{f}', {i})" for i, f in enumerate(DETECTOR))


@query(f"SELECT field_name, id AS class_id, count(*) AS n FROM recognition_samples LEFT JOIN (VALUES {_DET}) AS v(f, id) ON f = field_name GROUP BY field_name, id")
def detector_ids(s, d):
    return t(s, d, "recognition_samples").select("field_name", documents.detector_id(c("field_name")).alias("class_id")).groupBy("field_name", "class_id").agg(F.count("*").alias("n"))


_WS = "trim(text, ' ' || chr(9) || chr(10) || chr(13))"


@query(f"""SELECT sample_id, CASE WHEN text = '' THEN 'empty' WHEN text <> {_WS} THEN 'outer_whitespace' WHEN regexp_matches(text, '[\\r\\n\\t]') THEN 'control_character' WHEN starts_with(text, ':') THEN 'leading_colon' END AS problem FROM recognition_samples""")
def reference_problems(s, d):
    return t(s, d, "recognition_samples").select("sample_id", X.reference_problem(c("text")).alias("problem"))


# ---- joins


_STEMS = f"""WITH i AS (SELECT split, regexp_extract(rel_path, '[^/]*$') AS f FROM ({_IMAGES}) WHERE split IS NOT NULL), l AS (SELECT DISTINCT {_PLACE} AS p FROM small_files WHERE kind = 'label'),
    a AS (SELECT split, regexp_replace(f, '\\.[^.]*$', '') AS stem, count(*) AS ni FROM i GROUP BY ALL),
    b AS (SELECT string_split(p, '/')[1] AS split, regexp_replace(regexp_extract(p, '[^/]*$'), '\\.[^.]*$', '') AS stem, count(*) AS nl FROM l WHERE string_split(p, '/')[1] IN ('train', 'valid', 'test') GROUP BY ALL),
    s AS (SELECT split, stem, coalesce(ni, 0) AS n_images, coalesce(nl, 0) AS n_labels, coalesce(ni, 0) * coalesce(nl, 0) AS n_pairs, greatest(coalesce(ni, 0), coalesce(nl, 0)) > 1 AS ambiguous FROM a FULL JOIN b USING (split, stem))"""


def _stems(s, d):
    i = images(s, d).where("split is not null").select("split", X.stem_of(c("rel_path")).alias("stem"))
    p = places(s, d).where("kind = 'label'").select("path").distinct()
    b = p.select(F.get(F.split("path", "/"), lit(0)).alias("split"), X.stem_of(c("path")).alias("stem")).where(c("split").isin(SPLITS))
    return i, b


@query(_STEMS + " SELECT split, stem, n_images, n_labels, n_pairs, ambiguous FROM s")
def pair_counts(s, d):
    return pairing.stem_counts(*_stems(s, d), ["split", "stem"])


@query(_STEMS + """, g AS (SELECT split, CAST(sum(n_pairs) AS BIGINT) AS n_pairs, CAST(sum(CASE WHEN n_labels = 0 THEN n_images ELSE 0 END) AS BIGINT) AS images_without_label, CAST(sum(CASE WHEN n_images = 0 THEN n_labels ELSE 0 END) AS BIGINT) AS labels_without_image, count(*) FILTER (ambiguous) AS ambiguous_stems FROM s GROUP BY split)
    SELECT *, CASE WHEN n_pairs = 0 THEN 'unverified' WHEN images_without_label + labels_without_image + ambiguous_stems = 0 THEN 'verified' ELSE 'holds with exceptions' END AS status FROM g""")
def pair_status(s, d):
    return pairing.pairing_status(pairing.stem_counts(*_stems(s, d), ["split", "stem"]), ["split"])


@query(_STEMS + " SELECT split, stem FROM s WHERE n_images = 0")
def pair_orphans(s, d):
    i, b = _stems(s, d)
    return pairing.without_partner(b.distinct(), i, ["split", "stem"])


@query("""SELECT image_id, raw_split, ingested_at FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY ingested_at DESC NULLS LAST, raw_split DESC NULLS LAST) AS n FROM image_records) WHERE n = 1""")
def last_delivery(s, d):
    return pairing.last_wins(t(s, d, "image_records"), "image_id", ["ingested_at", "raw_split"], ["raw_split", "ingested_at"])


# ---- duplicates, groups, splits


@query(f"SELECT sha AS digest, count(*) AS n_rows, count(DISTINCT split) AS n_splits FROM ({_IMAGES}) WHERE sha IS NOT NULL GROUP BY sha HAVING count(*) > 1")
def exact_duplicates(s, d):
    return grouping.exact_duplicates(images(s, d), "sha", "split")


@query(f"""WITH i AS (SELECT DISTINCT sha, label_path FROM ({_IMAGES}) WHERE sha IS NOT NULL AND label_path IS NOT NULL),
    l AS (SELECT label_path, array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array(content, '\\r\\n|[\\n\\r]'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')), chr(10)) AS bag
      FROM (SELECT file_path AS label_path, min(content) AS content FROM small_files GROUP BY file_path))
    SELECT sha AS digest, count(DISTINCT label_path) AS n_images, count(DISTINCT coalesce(bag, chr(0))) AS n_contents FROM i LEFT JOIN l USING (label_path) GROUP BY sha HAVING count(DISTINCT label_path) > 1""")
def label_conflicts(s, d):
    """Paths are compared as places; of a rewritten file the last version counts."""
    i = images(s, d).select("sha", place_key(c("label_path")).alias("label_path")).where("label_path is not null").distinct()
    b = t(s, d, "small_files").groupBy(place_key(c("file_path")).alias("label_path")).agg(F.max_by("content", F.struct("modified_at", "file_id")).alias("content"))
    return grouping.label_conflicts(i, b, "sha", "label_path")


@query("""WITH h AS (SELECT DISTINCT dhash AS h FROM image_records WHERE dhash IS NOT NULL)
    SELECT x.h AS a, y.h AS b, CAST(bit_count(xor(x.h, y.h)) AS INTEGER) AS bits FROM h x JOIN h y ON x.h < y.h AND bit_count(xor(x.h, y.h)) <= 5""")
def near_duplicate_hashes(s, d):
    return grouping.near_duplicates(t(s, d, "image_records").select(c("dhash").alias("h")), 5)


@query("WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(x * 1024) AS DOUBLE)) AS e FROM embeddings), m AS (SELECT vec_id, e, list_sum(e) AS total FROM v) SELECT vec_id, array_to_string(list_transform(e, lambda x: CASE WHEN x * 64 > total THEN '1' ELSE '0' END), '') AS bits FROM m")
def average_hashes(s, d):
    grid = F.transform("embedding", lambda x: F.floor(x * 1024).cast("double"))
    return t(s, d, "embeddings").select("vec_id", F.lpad(F.conv(F.hex(G.average_hash(grid)), 16, 2), 64, "0").alias("bits"))


@query("WITH v AS (SELECT vec_id, embedding[1:63] AS e FROM embeddings) SELECT vec_id, array_to_string(list_transform(list_filter(range(1, 63), lambda i: i % 9 <> 0), lambda i: CASE WHEN e[i] > e[i + 1] THEN '1' ELSE '0' END), '') AS bits FROM v")
def difference_hashes(s, d):
    """Grids of seven rows of nine, as the vectors have 64 cells."""
    return t(s, d, "embeddings").select("vec_id", F.lpad(F.conv(F.hex(G.difference_hash(F.slice("embedding", 1, 63))), 16, 2), 56, "0").alias("bits"))


_KEYED = f"SELECT DISTINCT image_id, coalesce(nullif(regexp_extract(stem, '^(.+)\\.rf\\.[0-9a-fA-F]{{32}}$', 1), ''), stem) AS key, {_SHA} AS sha, {_SPLIT} AS split FROM image_records WHERE stem IS NOT NULL"


def _keyed(s, d):
    r = t(s, d, "image_records").where("stem is not null")
    return r.select("image_id", F.coalesce(X.source_stem(c("stem")), c("stem")).alias("key"), sha_key(c("sha256")).alias("sha"), split_name(c("raw_split")).alias("split")).distinct()


@query(f"""WITH r AS ({_KEYED}), g AS (SELECT key, count(DISTINCT image_id) AS n_rows, count(DISTINCT sha) AS n_sha FROM r GROUP BY key)
    SELECT key, row_number() OVER (ORDER BY key) AS number, n_rows, CASE WHEN n_rows = 1 THEN 'single_source' WHEN n_sha = 1 THEN 'exact_byte_duplicate' ELSE 'roboflow_source_stem' END AS method, CASE WHEN n_rows = 1 THEN 'unmatched' ELSE 'high' END AS confidence FROM g""")
def source_groups(s, d):
    return grouping.source_groups(_keyed(s, d), Scratch(s, "groups"))


@query(f"""WITH r AS ({_KEYED}), g AS (SELECT key, string_agg(DISTINCT split, ' + ' ORDER BY split) AS splits, count(*) AS n FROM r WHERE split IS NOT NULL GROUP BY key)
    SELECT splits, count(*) AS n_sources, count(*) FILTER (n > 1) AS n_multi FROM g GROUP BY splits""")
def source_naming(s, d):
    return grouping.source_naming(_keyed(s, d), "key", "split")


@query(f"SELECT key, count(DISTINCT split) AS n_splits FROM ({_KEYED}) GROUP BY key HAVING count(DISTINCT split) > 1")
def split_leakage(s, d):
    return grouping.in_several_splits(_keyed(s, d), "key", "split")


_BUCKET = "(CAST('0x' || substr(sha256(upper(trim(c_name))), 1, 8) AS BIGINT) % 1000)"


@query(f"SELECT c_custkey, CASE WHEN {_BUCKET} < 800 THEN 'train' WHEN {_BUCKET} < 900 THEN 'valid' ELSE 'test' END AS split FROM customer")
def name_split(s, d):
    return t(s, d, "customer").select("c_custkey", X.hash_split(c("c_name")).alias("split"))


def _orders_by_customer(s, d):
    return t(s, d, "orders").groupBy(c("o_custkey").alias("key")).agg(F.count("*").alias("n"))


_GREEDY = """WITH RECURSIVE g AS (SELECT o_custkey AS key, count(*) AS n, row_number() OVER (ORDER BY sha256('42:' || o_custkey)) AS i FROM orders GROUP BY o_custkey),
    z AS (SELECT CAST(floor(sum(n) * 0.7) AS BIGINT) AS t, CAST(floor(sum(n) * 0.15) AS BIGINT) AS v, CAST(sum(n) AS BIGINT) AS s FROM g),
    w(i, a, b, e, key, n, split) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), '' UNION ALL
      SELECT g.i, a + CASE WHEN x = 'train' THEN g.n ELSE 0 END, b + CASE WHEN x = 'valid' THEN g.n ELSE 0 END, e + CASE WHEN x = 'test' THEN g.n ELSE 0 END, g.key, g.n, x
      FROM w JOIN g ON g.i = w.i + 1 CROSS JOIN z, LATERAL (SELECT CASE WHEN a + g.n <= t OR (b >= v AND e >= s - t - v) THEN 'train' WHEN b + g.n <= v OR e >= s - t - v THEN 'valid' ELSE 'test' END AS x))
    """


@query(_GREEDY + "SELECT key, n, split FROM w WHERE i > 0")
def greedy_split(s, d):
    return grouping.greedy_split(_orders_by_customer(s, d))


@query(_GREEDY + "SELECT o_orderkey, o_custkey, split AS target_split FROM orders JOIN w ON key = o_custkey")
def manifest(s, d):
    scratch = Scratch(s, "manifest")
    g = scratch.keep(grouping.greedy_split(_orders_by_customer(s, d)), "groups")
    return grouping.manifest(t(s, d, "orders").select("o_orderkey", "o_custkey"), g, scratch, "o_custkey")


# ---- label profile

_LINES = f"""WITH t0 AS (SELECT row_id, label_path, line, list_filter(regexp_split_to_array(raw, '\\s+'), lambda x: x <> '') AS k FROM label_lines),
    t1 AS (SELECT *, array_to_string(k, ' ') AS norm FROM t0 WHERE len(k) > 0),
    t2 AS (SELECT *, line > min(line) OVER (PARTITION BY label_path, norm) AS dup, CASE WHEN len(list_filter(k, lambda x: NOT regexp_full_match(x, '{_NUM}'))) = 0 THEN list_transform(k, lambda x: TRY_CAST(regexp_replace(x, '^\\+', '') AS DOUBLE)) END AS v FROM t1),
    t3 AS (SELECT *, v[2:] AS co, len(v) - 1 AS n, v IS NOT NULL AND NOT isnan(v[1]) AND NOT isinf(v[1]) AND v[1] = floor(v[1]) AND v[1] >= 0 AS loads FROM t2),
    t4 AS (SELECT *, loads AND n = 4 AS box, loads AND n >= 6 AND n % 2 = 0 AS poly, len(list_filter(co, lambda x: NOT isnan(x) AND (x < -1e-6 OR x > 1 + 1e-6))) > 0 AS outside FROM t3),
    c AS (SELECT *, coalesce(box OR poly, false) AS kept, CASE WHEN box OR poly THEN CAST(v[1] AS BIGINT) END AS class_id,
      box AND ((NOT isnan(v[4]) AND v[4] <= 0) OR (NOT isnan(v[5]) AND v[5] <= 0)) AS flat,
      box AND NOT outside AND ((NOT isnan(v[2] - v[4] / 2) AND v[2] - v[4] / 2 < -1e-6) OR (NOT isnan(v[2] + v[4] / 2) AND v[2] + v[4] / 2 > 1 + 1e-6) OR (NOT isnan(v[3] - v[5] / 2) AND v[3] - v[5] / 2 < -1e-6) OR (NOT isnan(v[3] + v[5] / 2) AND v[3] + v[5] / 2 > 1 + 1e-6)) AS edge,
      poly AND abs(list_sum(list_transform(range(1, n // 2 + 1), lambda i: co[2 * i - 1] * co[2 * (i % (n // 2)) + 2] - co[2 * (i % (n // 2)) + 1] * co[2 * i]))) / 2 <= 1e-6 AS thin FROM t4),
    a AS (SELECT *, (CASE WHEN v IS NULL OR NOT loads OR (NOT box AND NOT poly) OR flat OR ((box OR poly) AND outside) OR edge OR thin THEN 1 ELSE 0 END) AS bad FROM c)"""


def _checked(s, d):
    return labels.with_issues(t(s, d, "label_lines").select("row_id", "label_path", "line", "raw"))


def _typed(s, d):
    """The same without the issue of repeated lines, for queries that don't ask for it."""
    return labels.with_issues(t(s, d, "label_lines").select("row_id", "label_path", "line", "raw"), duplicates=False)


@query(_LINES + """, x AS (SELECT unnest([CASE WHEN dup THEN 'duplicate_annotation' END, CASE WHEN v IS NULL THEN 'malformed_line' END, CASE WHEN v IS NOT NULL AND NOT loads THEN 'invalid_class_id' END, CASE WHEN flat THEN 'zero_or_negative_size' END,
      CASE WHEN (box OR poly) AND outside THEN 'coord_out_of_range' END, CASE WHEN edge THEN 'bbox_outside_image' END, CASE WHEN thin THEN 'zero_area_polygon' END, CASE WHEN loads AND NOT box AND NOT poly THEN 'invalid_token_count' END]) AS code FROM c)
    SELECT code, count(*) AS n_lines FROM x WHERE code IS NOT NULL GROUP BY code""")
def label_issue_counts(s, d):
    return labels.issue_counts(_checked(s, d))


@query(_LINES + """, p AS (SELECT class_id, label_path, count(*) AS k FROM c WHERE kept GROUP BY ALL), f AS (SELECT count(DISTINCT label_path) AS n FROM c)
    SELECT class_id, k AS n_instances, count(*) AS n_files FROM p GROUP BY ALL UNION ALL SELECT class_id, 0, n - count(*) FROM p, f GROUP BY class_id, n HAVING n > count(*)""")
def label_class_profile(s, d):
    return labels.instances_per_file(_typed(s, d))


@query(_LINES + " SELECT class_id, count(DISTINCT label_path) AS n_files, (SELECT count(DISTINCT label_path) FROM c) AS of_files FROM c WHERE kept GROUP BY class_id")
def class_presence(s, d):
    return labels.class_presence(_typed(s, d))


@query(_LINES + """, p AS (SELECT label_path, class_id, count(*) AS n, max(CASE WHEN poly THEN 1 ELSE 0 END) AS poly FROM a WHERE kept GROUP BY ALL),
    f AS (SELECT label_path, count(*) FILTER (kept) AS n_ann, max(bad) AS bad FROM a GROUP BY label_path), z AS (SELECT count(*) AS n FROM f),
    s AS (SELECT class_id, count(*) AS k FROM p GROUP BY class_id), core AS (SELECT class_id FROM s, z WHERE k >= n * 0.5), rare AS (SELECT class_id FROM s, z WHERE k < n * 0.1),
    u AS (SELECT n_ann AS usual FROM f GROUP BY n_ann ORDER BY count(*) DESC, n_ann LIMIT 1)
    SELECT label_path, 'missing_core_class' AS kind FROM f WHERE (SELECT count(*) FROM p WHERE p.label_path = f.label_path AND p.class_id IN (SELECT class_id FROM core)) < (SELECT count(*) FROM core)
    UNION ALL SELECT label_path, 'rare_class_' || class_id FROM p WHERE class_id IN (SELECT class_id FROM rare)
    UNION ALL SELECT DISTINCT label_path, 'duplicate_class_instances' FROM p WHERE n > 1 UNION ALL SELECT label_path, 'duplicate_class_' || class_id FROM p WHERE n > 1
    UNION ALL SELECT DISTINCT label_path, 'polygon_annotation' FROM p WHERE poly = 1 UNION ALL SELECT label_path, 'malformed_annotation' FROM f WHERE bad = 1
    UNION ALL SELECT label_path, 'annotation_count_' || n_ann FROM f, u WHERE n_ann <> usual""")
def label_anomalies(s, d):
    return labels.anomalies(_typed(s, d), Scratch(s, "anomalies"))


_MAP = ", ".join(f"({a}, {'NULL' if b is None else b})" for a, b in CLASS_MAP["aadhaar"].items())


@query(_LINES + f""", r AS (SELECT m.target, CASE WHEN NOT kept THEN 'malformed' WHEN m.class_id IS NULL THEN 'unmapped_class' WHEN m.target IS NULL THEN 'excluded' WHEN NOT box THEN 'not_a_box'
      WHEN len(list_filter(v[2:5], lambda x: isnan(x) OR x < 0 OR x > 1)) > 0 OR v[4] <= 0 OR v[5] <= 0 THEN 'out_of_bounds' END AS reason FROM c LEFT JOIN (VALUES {_MAP}) AS m(class_id, target) ON m.class_id = c.class_id)
    SELECT target, reason, count(*) AS n FROM r GROUP BY target, reason""")
def class_remap(s, d):
    m = s.createDataFrame(list(CLASS_MAP["aadhaar"].items()), "class_id BIGINT, target INT")
    return labels.remap_classes(_typed(s, d), m, ["class_id"]).groupBy("target", "reason").agg(F.count("*").alias("n"))


@query(_LINES + """, k AS (SELECT label_path, coalesce(bool_or(class_id = 4), false) AS has4, list_sort(list_distinct(list(class_id) FILTER (class_id <> 4))) AS others FROM c WHERE kept GROUP BY label_path)
    SELECT CASE WHEN len(coalesce(others, [])) = 0 THEN 'alone' WHEN list_has_all(others, [0, 1, 2, 3]) THEN 'with all' WHEN others = [0] THEN 'with 0' ELSE 'other' END AS companions, count(*) AS n_files FROM k WHERE has4 GROUP BY 1""")
def class_four_companions(s, d):
    return labels.companions(_typed(s, d))


@query(_LINES + """ SELECT bool_and(v IS NOT NULL AND len(v) >= 5 AND loads) AS fits, count(*) AS n_lines FROM c""")
def label_format_fits(s, d):
    return labels.format_fits(_typed(s, d))


# ---- statistics


@query("""WITH r AS (SELECT coalesce(lang, '') AS lang, n_chars, row_number() OVER (PARTITION BY coalesce(lang, '') ORDER BY n_chars) AS i, count(*) OVER (PARTITION BY coalesce(lang, '')) AS n FROM documents WHERE n_chars IS NOT NULL)
    SELECT lang, n, min(n_chars) AS low, max(n_chars) FILTER (i = n // 2 + 1) AS upper_median, max(n_chars) AS high FROM r GROUP BY lang, n""")
def upper_medians(s, d):
    r = t(s, d, "documents").select(F.coalesce("lang", lit("")).alias("lang"), "n_chars")
    return statistics.order_statistics(r, ["lang"], "n_chars")


@query(f"""SELECT split, count(*) FILTER (width > 0 AND height > 0) AS n_readable, count(*) FILTER (NOT coalesce(width > 0 AND height > 0, false)) AS n_unreadable, count(DISTINCT CASE WHEN width > 0 AND height > 0 THEN width || 'x' || height END) AS n_sizes,
    count(*) FILTER (width > 0 AND height > 0 AND (least(width, height) < 100 OR width > height * 3.0 OR height > width * 3.0)) AS n_unusual FROM ({_IMAGES}) GROUP BY split""")
def image_summary(s, d):
    return statistics.image_summary(images(s, d), "split")


@query(f"SELECT width, height, count(*) AS n FROM ({_IMAGES}) WHERE width > 0 AND height > 0 GROUP BY width, height ORDER BY n DESC, width, height LIMIT 10")
def top_sizes(s, d):
    return statistics.top_sizes(images(s, d))


@query(f"""SELECT CASE WHEN width < height * 0.5 THEN '<0.5' WHEN width < height * 0.75 THEN '0.5-0.75' WHEN width < height THEN '0.75-1.0' WHEN width < height * 1.25 THEN '1.0-1.25' WHEN width < height * 1.5 THEN '1.25-1.5'
    WHEN width < height * 1.75 THEN '1.5-1.75' WHEN width < height * 2.0 THEN '1.75-2.0' ELSE '>=2.0' END AS bucket, count(*) AS n FROM ({_IMAGES}) WHERE width > 0 AND height > 0 GROUP BY 1""")
def aspect_buckets(s, d):
    return statistics.aspect_histogram(images(s, d))


@query("SELECT l_returnflag, count(*) AS n, min(l_quantity) AS low, median(l_quantity) AS middle, max(l_quantity) AS high FROM lineitem GROUP BY l_returnflag")
def quantity_statistics(s, d):
    return statistics.numeric_summary(t(s, d, "lineitem"), "l_returnflag", "l_quantity")


# ---- identity numbers, dates, text


def _verhoeff_sql() -> str:
    mul, perm = X._dihedral()
    return "list_reduce(list_prepend(0, range(0, len({n}))), lambda acc, i: " + f"{mul}[acc * 10 + {perm}[(i % 8) * 10 + CAST(substr({{n}}, len({{n}}) - i, 1) AS INTEGER) + 1] + 1])"


_N12 = "lpad(CAST((o_orderkey * 7919 + 100000000003) % 1000000000000 AS VARCHAR), 12, '0')"


@query(f"WITH n AS (SELECT o_orderkey, {_N12} AS n FROM orders) SELECT o_orderkey, n AS number, " + _verhoeff_sql().format(n="n").replace("list_prepend(0, range(0, len(n)))", "list_prepend(CAST(0 AS BIGINT), range(0, len(n)))") + " = 0 AS valid FROM n")
def checksum_of_numbers(s, d):
    n = F.lpad(((c("o_orderkey") * 7919 + 100000000003) % 1000000000000).cast("string"), 12, "0")
    return t(s, d, "orders").select("o_orderkey", n.alias("number")).select("o_orderkey", "number", X.verhoeff_valid(c("number")).alias("valid"))


_TXT = "trim(text, ' ' || chr(9) || chr(10) || chr(13))"


@query(f"""WITH r AS (SELECT sample_id, text, {_TXT} AS x FROM recognition_samples WHERE field_name = 'aadhaar_number'), n AS (SELECT *, replace(x, ' ', '') AS n FROM r)
    SELECT sample_id, text, CASE WHEN text IS NULL OR x = '' THEN 'missing_field' WHEN NOT regexp_full_match(x, '[0-9]{{12}}|[0-9]{{4}} [0-9]{{4}} [0-9]{{4}}') THEN 'invalid_aadhaar_format' WHEN {_verhoeff_sql().format(n="n").replace("list_prepend(0, range(0, len(n)))", "list_prepend(CAST(0 AS BIGINT), range(0, len(n)))")} <> 0 THEN 'aadhaar_checksum_mismatch' END AS problem FROM n""")
def card_number_problems(s, d):
    return t(s, d, "recognition_samples").where("field_name = 'aadhaar_number'").select("sample_id", "text", X.card_number_problem(c("text")).alias("problem"))


@query(f"""SELECT sample_id, text, CASE WHEN text IS NULL OR {_TXT} = '' THEN 'missing_field' WHEN NOT regexp_full_match(upper({_TXT}), '[A-Z]{{3}}P[A-Z][0-9]{{4}}[A-Z]') THEN 'invalid_pan_format' END AS problem FROM recognition_samples WHERE field_name = 'pan_number'""")
def account_number_problems(s, d):
    return t(s, d, "recognition_samples").where("field_name = 'pan_number'").select("sample_id", "text", X.account_number_problem(c("text")).alias("problem"))


_DOB = """CASE WHEN o_orderkey % 7 = 1 THEN replace(strftime(o_orderdate, '%d/%m/%Y'), '/', '-') WHEN o_orderkey % 7 = 2 THEN '31/02/' || strftime(o_orderdate, '%Y') WHEN o_orderkey % 7 = 3 THEN '  ' || strftime(o_orderdate, '%d/%m/%Y') || ' ' WHEN o_orderkey % 7 = 4 THEN NULL
    WHEN o_orderkey % 7 = 5 THEN '' WHEN o_orderkey % 7 = 6 THEN '01/01/0000' ELSE strftime(o_orderdate, '%d/%m/%Y') END"""


def _dob(s, d):
    day, k = F.date_format("o_orderdate", "dd/MM/yyyy"), c("o_orderkey") % 7
    v = F.when(k == 1, F.replace(day, lit("/"), lit("-"))).when(k == 2, F.concat(lit("31/02/"), F.date_format("o_orderdate", "yyyy"))).when(k == 3, F.concat(lit("  "), day, lit(" "))).when(k == 4, None).when(k == 5, "").when(k == 6, "01/01/0000").otherwise(day)
    return t(s, d, "orders").select("o_orderkey", v.alias("v"))


_DOB_CASE = """CASE WHEN v IS NULL OR trim(v) = '' THEN 'missing_field' WHEN NOT regexp_full_match(trim(v), '[0-9]{2}/[0-9]{2}/[0-9]{4}') THEN 'invalid_date_format' WHEN try_strptime(trim(v), '%d/%m/%Y') IS NULL OR trim(v)[7:10] = '0000' THEN 'invalid_date'
    WHEN try_strptime(trim(v), '%d/%m/%Y') > TIMESTAMP '1997-06-30' THEN 'future_date' END"""


@query(f"WITH o AS (SELECT o_orderkey, {_DOB} AS v FROM orders) SELECT o_orderkey, v AS value, {_DOB_CASE} AS problem FROM o")
def birth_date_problems(s, d):
    return _dob(s, d).select("o_orderkey", c("v").alias("value"), X.birth_date_problem(c("v"), F.to_date(lit("1997-06-30"))).alias("problem"))


@query(f"""WITH o AS (SELECT o_orderkey, {_DOB} AS v FROM orders) SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 3 = 0 THEN 'missing_field' WHEN o_orderkey % 3 = 1 THEN 'invalid_pan_format' END, CASE WHEN o_orderkey % 5 <> 0 THEN {_DOB_CASE} END) AS codes FROM o""")
def document_problems(s, d):
    k = c("o_orderkey")
    number = F.when(k % 3 == 1, "ABCXK1234F").when(k % 3 == 2, "abcpk1234f")
    both = F.create_map(lit("pan_number"), number, lit("date_of_birth"), c("v"))
    fields = F.when(k % 5 != 0, both).otherwise(F.create_map(lit("pan_number"), number))
    return _dob(s, d).select("o_orderkey", F.array_join(documents.document_problems(fields, "pan", F.to_date(lit("1997-06-30"))), ",").alias("codes"))


@query(f"WITH r AS (SELECT sample_id, unnest(string_split(text, ' ')) AS x FROM recognition_samples) SELECT {_RED} AS token, count(*) AS n FROM r GROUP BY 1")
def redacted_tokens(s, d):
    return t(s, d, "recognition_samples").select(F.explode(F.split("text", " ")).alias("x")).groupBy(X.redact_token(c("x")).alias("token")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN length(text) <= 30 THEN text ELSE left(text, 14) || '…' || right(text, 15) END AS short FROM documents WHERE regexp_full_match(text, '[ -~]*')")
def ellipsized(s, d):
    return t(s, d, "documents").select("doc_id", X.ellipsize(c("text"), 30).alias("short"))


@query("SELECT o_orderkey, 'rc-' || substr(sha256(o_orderstatus || '|' || o_orderkey || '|' || o_orderpriority), 1, 12) AS sample_id FROM orders")
def sample_ids(s, d):
    return t(s, d, "orders").select("o_orderkey", X.sample_id(c("o_orderstatus"), c("o_orderkey"), c("o_orderpriority")).alias("sample_id"))


_ENC = f"list_transform(string_split(text, ''), lambda x: instr('{ALPHABET}', x))"


@query(f"""WITH r AS (SELECT sample_id, text, CASE WHEN text <> '' AND NOT list_contains({_ENC}, 0) THEN {_ENC} END AS ids FROM recognition_samples WHERE text <> '')
    SELECT sample_id, array_to_string(ids, ' ') AS ids, CASE WHEN ids IS NOT NULL THEN text END AS back FROM r""")
def encoded_texts(s, d):
    r = t(s, d, "recognition_samples").where("text <> ''").select("sample_id", X.encode_text(c("text")).alias("ids"))
    return r.select("sample_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"), X.decode_ids(c("ids")).alias("back"))


@query("""WITH e AS (SELECT user_id, event_id, ascii(event_type) % 3 AS v FROM events), l AS (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM e)
    SELECT user_id, string_agg(v, ' ' ORDER BY event_id) AS ids FROM l WHERE v <> 0 AND v IS DISTINCT FROM p GROUP BY user_id""")
def collapsed_paths(s, d):
    e = t(s, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", (F.ascii("event_type") % 3).alias("v")))).alias("e"))
    ids = X.ctc_collapse(F.transform("e", lambda x: x["v"]))
    return e.select("user_id", F.array_join(F.transform(ids, lambda x: x.cast("string")), " ").alias("ids")).where("ids <> ''")


# ---- regions and documents


def _regions(s, d):
    e = t(s, d, "events")
    return e.select(c("user_id").alias("doc_id"), c("event_id").alias("idx"), c("event_type").alias("field"), F.when(c("event_id") % 5 == 0, " ").otherwise(F.concat(lit("v"), c("event_id"))).alias("text"), F.floor("value").cast("double").alias("det"), (c("event_id") % 4).cast("double").alias("rec"))


_REG = "SELECT user_id AS doc_id, event_id AS idx, event_type AS field, CASE WHEN event_id % 5 = 0 THEN ' ' ELSE 'v' || event_id END AS text, CAST(floor(value) AS DOUBLE) AS det, CAST(event_id % 4 AS DOUBLE) AS rec FROM events"


def _event_types(s, d):
    return ["click", "purchase", "view", "absent"]


@query(f"""WITH r AS ({_REG}), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY det DESC, rec DESC, idx) AS n FROM r WHERE trim(text) <> '') WHERE n = 1),
    g AS (SELECT doc_id, field FROM (SELECT DISTINCT doc_id FROM r), (VALUES ('click'), ('purchase'), ('view'), ('absent')) AS v(field))
    SELECT doc_id, field, text AS value, idx, det * rec AS confidence FROM g LEFT JOIN b USING (doc_id, field)""")
def best_fields(s, d):
    return documents.best_per_field(_regions(s, d), _event_types(s, d))


@query(f"""WITH g AS (SELECT doc_id, coalesce(max(det) FILTER (field = 'click'), 0) AS a, coalesce(max(det) FILTER (field IN ('purchase', 'signup')), 0) AS b FROM ({_REG}) GROUP BY doc_id)
    SELECT doc_id, CASE WHEN greatest(a, b) <= 0 THEN 'unknown' WHEN a = greatest(a, b) THEN 'first' ELSE 'second' END AS document_type, greatest(a, b) AS score, CASE WHEN a <= 0 AND b <= 0 THEN 'unknown_document_type' WHEN a > 0 AND b > 0 THEN 'ambiguous_document_type' END AS issue FROM g""")
def inferred_types(s, d):
    return documents.infer_type(_regions(s, d), {"first": {"click"}, "second": {"purchase", "signup"}, "none": set()})


@query(f"""SELECT dt AS document_type, f AS field FROM (VALUES {_VALUES}) AS v(dt, f) WHERE f IN (SELECT f FROM (VALUES {_VALUES}) AS w(dt, f) GROUP BY f HAVING count(*) = 1)""")
def exclusive_fields(s, d):
    return s.createDataFrame([(k, f) for k, fs in documents.exclusive_fields().items() for f in sorted(fs)], "document_type STRING, field STRING")


@query(f"""WITH r AS (SELECT sample_id % 40 AS doc_id, field_name AS field, text FROM recognition_samples), y AS (SELECT DISTINCT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'aadhaar' ELSE 'pan' END AS dt FROM r),
    s AS (SELECT doc_id, field, count(*) AS n, max(CASE WHEN trim(text) <> '' THEN 1 ELSE 0 END) AS ok FROM r WHERE field IS NOT NULL GROUP BY ALL), w AS (SELECT doc_id, f AS field FROM y JOIN (VALUES {_VALUES}) AS v(t, f) ON t = dt)
    SELECT doc_id, field, 'missing_field' AS issue FROM w LEFT JOIN s USING (doc_id, field) WHERE coalesce(ok, 0) = 0 UNION ALL SELECT doc_id, field, 'unexpected_field' FROM s WHERE (doc_id, field) NOT IN (SELECT doc_id, field FROM w)
    UNION ALL SELECT doc_id, field, 'duplicate_field' FROM s WHERE n > 1 AND (doc_id, field) IN (SELECT doc_id, field FROM w)""")
def field_issues(s, d):
    """Documents of four samples each, so that their number grows with the table."""
    r = t(s, d, "recognition_samples").select(F.floor((c("sample_id") - 1) / 4).alias("doc_id"), c("field_name").alias("field"), "text")
    types = r.select("doc_id", F.when(c("doc_id") % 2 == 0, "aadhaar").otherwise("pan").alias("document_type")).distinct()
    return documents.field_issues(r, types)


@query(f"""SELECT sample_id, CASE WHEN NOT (sample_id % 9 = 8 AND field_name IS NULL) AND id_name IS DISTINCT FROM field_name THEN 'unknown_class' WHEN sample_id % 7 < 2 THEN 'empty_crop' END AS problem
    FROM recognition_samples LEFT JOIN (VALUES {_DET}) AS v(id_name, id) ON id = sample_id % 9 - CASE WHEN sample_id % 9 = 8 THEN 9 ELSE 0 END""")
def region_problems(s, d):
    k = F.when(c("sample_id") % 9 == 8, lit(-1)).otherwise(c("sample_id") % 9).cast("int")
    return t(s, d, "recognition_samples").select("sample_id", documents.region_problem(k, c("field_name"), documents.detector_name(k), c("sample_id") % 7, lit(9)).alias("problem"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, o_orderstatus, count(*) OVER (PARTITION BY l_orderkey) AS n_items FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def nested_documents(s, d):
    n = documents.nest(t(s, d, "orders").select(c("o_orderkey").alias("k"), "o_orderstatus"), t(s, d, "lineitem").select(c("l_orderkey").alias("k"), "l_linenumber", "l_partkey", "l_quantity"), "k", ["l_linenumber"])
    again = n.select("k", F.from_json(documents.to_json(F.struct("o_orderstatus", "items")), n.select("o_orderstatus", "items").schema).alias("j"))
    return again.select(c("k").alias("l_orderkey"), c("j.o_orderstatus").alias("o_orderstatus"), F.size("j.items").cast("bigint").alias("n_items"), F.explode("j.items").alias("i")).select("l_orderkey", "i.l_linenumber", "i.l_partkey", "i.l_quantity", "o_orderstatus", "n_items")


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def event_properties(s, d):
    return t(s, d, "events").select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


# ---- metrics

_AX = "(p_size % 7) AS ax1, (p_size % 5) AS ay1, p_size % 7 + 4 AS ax2, p_size % 5 + 3 AS ay2, (p_partkey % 7) AS bx1, (p_partkey % 5) AS by1, p_partkey % 7 + 5 AS bx2, p_partkey % 5 + 4 AS by2"


@query(f"""WITH p AS (SELECT p_partkey, {_AX} FROM part), o AS (SELECT *, greatest(0, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0, least(ay2, by2) - greatest(ay1, by1)) AS i FROM p)
    SELECT p_partkey, CAST(i AS BIGINT) AS intersection, CAST(12 + 20 - i AS BIGINT) AS union_area FROM o""")
def box_overlaps(s, d):
    z, k = c("p_size").cast("bigint"), c("p_partkey")
    i, u = G.overlap([z % 7, z % 5, z % 7 + 4, z % 5 + 3], [k % 7, k % 5, k % 7 + 5, k % 5 + 4])
    return t(s, d, "part").select("p_partkey", i.cast("bigint").alias("intersection"), u.cast("bigint").alias("union_area"))


@query("""WITH p AS (SELECT p_brand, levenshtein(reverse(p_name), p_name) AS e, length(p_name) AS l, CAST(reverse(p_name) = p_name AS INT) AS x, levenshtein(lower(reverse(p_name)), lower(p_name)) AS fe, CAST(lower(reverse(p_name)) = lower(p_name) AS INT) AS fx FROM part)
    SELECT p_brand, count(*) AS n, CAST(sum(e) AS BIGINT) AS edits, CAST(sum(l) AS BIGINT) AS ref_chars, CAST(sum(x) AS BIGINT) AS exact, CAST(sum(fe) AS BIGINT) AS folded_edits, CAST(sum(fx) AS BIGINT) AS folded_exact FROM p GROUP BY GROUPING SETS ((), (p_brand))""")
def text_scores(s, d):
    return metrics.error_counts(t(s, d, "part").select("p_brand", F.reverse("p_name").alias("prediction"), c("p_name").alias("reference")), "p_brand")


@query(r"""WITH w AS (SELECT p_partkey, list_filter(regexp_split_to_array(reverse(p_name), '\s+'), lambda x: x <> '') AS a, list_filter(regexp_split_to_array(p_name, '\s+'), lambda x: x <> '') AS b FROM part)
    SELECT p_partkey, CAST(list_reduce(range(1, len(a) + 1), lambda r, i: list_reduce(range(1, len(b) + 1), lambda acc, j: list_append(acc, least(acc[j] + 1, r[j + 1] + 1, r[j] + CASE WHEN a[i] = b[j] THEN 0 ELSE 1 END)), [i]), range(0, len(b) + 1))[len(b) + 1] AS BIGINT) AS edits, len(b) AS ref_words FROM w""")
def word_edits(s, d):
    return metrics.word_edits(t(s, d, "part").select("p_partkey", F.reverse("p_name").alias("prediction"), c("p_name").alias("reference")), "p_partkey")


@query(f"""SELECT field_name, count(*) AS n, count(*) FILTER (regexp_matches(text, '\\p{{L}}')) AS with_letter, count(*) FILTER (regexp_matches(text, '[^A-Za-z0-9/ ]')) AS out_of_vocabulary FROM recognition_samples WHERE text IS NOT NULL GROUP BY field_name""")
def letter_and_vocabulary(s, d):
    return metrics.letter_counts(t(s, d, "recognition_samples"), "field_name")


def _values(s, d):
    o = t(s, d, "orders")
    pick = lambda k: o.select(c("o_orderkey").alias("doc_id"), F.explode(F.create_map(lit("status"), F.when(c("o_orderkey") % k != 0, c("o_orderstatus")), lit("priority"), F.when(c("o_orderkey") % 11 != k, c("o_orderpriority")).otherwise("?"))).alias("field", "value"))
    return pick(5), pick(3).where("doc_id % 13 <> 4"), o


_VAL = """WITH r AS (SELECT o_orderkey AS doc_id, 'status' AS field, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS value FROM orders UNION ALL SELECT o_orderkey, 'priority', CASE WHEN o_orderkey % 11 <> 5 THEN o_orderpriority ELSE '?' END FROM orders),
    p AS (SELECT * FROM (SELECT o_orderkey AS doc_id, 'status' AS field, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS value FROM orders UNION ALL SELECT o_orderkey, 'priority', CASE WHEN o_orderkey % 11 <> 3 THEN o_orderpriority ELSE '?' END FROM orders) WHERE doc_id % 13 <> 4),
    j AS (SELECT doc_id, field, r.value IS NOT DISTINCT FROM p.value AS ok FROM r LEFT JOIN p USING (doc_id, field))"""


@query(_VAL + " SELECT field, count(*) AS n, count(*) FILTER (ok) AS correct FROM j GROUP BY field")
def field_accuracy(s, d):
    r, p, _ = _values(s, d)
    return metrics.field_hits(r, p)


@query(_VAL + " SELECT count(*) AS n, count(*) FILTER (ok) AS correct FROM (SELECT doc_id, bool_and(ok) AS ok FROM j GROUP BY doc_id)")
def document_accuracy(s, d):
    r, p, o = _values(s, d)
    return metrics.document_hits(r, p, o.select(c("o_orderkey").alias("doc_id")))


@query("""WITH m AS (SELECT p_brand, count(*) FILTER (p_size % 3 = 0) AS tp, count(*) FILTER (p_size % 3 = 1) AS fp, count(*) FILTER (p_size % 3 = 2 AND p_size > 40) AS fn FROM part GROUP BY p_brand),
    q AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM m) SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM q""")
def detection_scores(s, d):
    n = lambda x: F.count(F.when(x, 1))
    z = c("p_size")
    return metrics.detection_counts(t(s, d, "part").groupBy("p_brand").agg(n(z % 3 == 0).alias("tp"), n(z % 3 == 1).alias("fp"), n((z % 3 == 2) & (z > 40)).alias("fn")))


@query("""WITH p AS (SELECT l_orderkey AS image_id, list({'x1': l_quantity, 'x2': l_quantity + 10} ORDER BY l_partkey % 100 DESC, l_linenumber, l_quantity) AS p FROM lineitem GROUP BY l_orderkey),
    t AS (SELECT l_orderkey AS image_id, list({'idx': n, 'x1': l_quantity + 2, 'x2': l_quantity + 2 + 9} ORDER BY n) AS t FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS n FROM lineitem WHERE l_partkey % 3 <> 0) GROUP BY l_orderkey),
    j AS (SELECT image_id, p, coalesce(t, []) AS t FROM p LEFT JOIN t USING (image_id)),
    m AS (SELECT image_id, len(p) AS np, len(t) AS nt, list_reduce(p, lambda s, b: list_transform([list_filter(list_transform(s, lambda f: {'idx': f.idx, 'o': (greatest(least(b.x2, f.x2) - greatest(b.x1, f.x1), 0) * 10) / (100 + 90 - greatest(least(b.x2, f.x2) - greatest(b.x1, f.x1), 0) * 10)}), lambda y: y.o >= 0.5)],
        lambda k: CASE WHEN len(k) = 0 THEN s ELSE list_filter(s, lambda f: f.idx <> list_filter(k, lambda y: y.o = list_max(list_transform(k, lambda z: z.o)))[-1].idx) END)[1], t) AS free FROM j)
    SELECT image_id, nt - len(free) AS tp, np - (nt - len(free)) AS fp, len(free) AS fn FROM m""")
def detection_matches(s, d):
    b = t(s, d, "lineitem").select(c("l_orderkey").alias("image_id"), c("l_linenumber").alias("idx"), c("l_quantity").alias("q"), c("l_partkey").alias("k"))
    box = lambda x, e: [x.alias("x1"), lit(0.0).alias("y1"), (x + e).alias("x2"), lit(10.0).alias("y2")]
    return metrics.match_detections(b.select("image_id", "idx", (c("k") % 100 / 100).alias("confidence"), *box(c("q"), 10)), b.where("k % 3 <> 0").select("image_id", "idx", *box(c("q") + 2, 9)))


@query(f"""SELECT f AS class_name, n, last FROM (VALUES {_DET}) AS v(f, id) LEFT JOIN (SELECT field_name, count(*) AS n, max(sample_id) AS last FROM recognition_samples GROUP BY field_name) ON field_name = f""")
def class_report(s, d):
    return metrics.class_report(t(s, d, "recognition_samples"), DETECTOR, "field_name", "sample_id")


# ---- logs, queues, samples

_LATEST = "SELECT user_id, event_type AS status, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_type IN ('click', 'view', 'purchase')) WHERE n = 1"


def _latest(s, d):
    e = t(s, d, "events").where(c("event_type").isin("click", "view", "purchase")).select("user_id", "event_id", c("event_type").alias("status"))
    return queues.latest(e, "user_id", ["event_id"], ["status", "event_id"])


@query(_LATEST)
def latest_decisions(s, d):
    return _latest(s, d)


_QUEUE = "SELECT DISTINCT user_id, CAST(user_id % 6 AS VARCHAR) AS field, user_id AS pos FROM events UNION ALL SELECT 1000000 + n_nationkey, CAST(n_nationkey % 6 AS VARCHAR), 1000000 + n_nationkey FROM nation"


def _queue(s, d):
    e = t(s, d, "events").select("user_id", (c("user_id") % 6).cast("string").alias("field"), c("user_id").alias("pos")).distinct()
    n = t(s, d, "nation").select((c("n_nationkey") + 1000000).cast("bigint").alias("user_id"), (c("n_nationkey") % 6).cast("string").alias("field"), (c("n_nationkey") + 1000000).cast("bigint").alias("pos"))
    return e.unionByName(n)


_PROGRESS = f"""WITH l AS ({_LATEST}), q AS ({_QUEUE}), g AS (SELECT field, count(*) FILTER (status = 'click') AS click, count(*) FILTER (status = 'view') AS "view", count(*) FILTER (status = 'purchase') AS purchase, count(*) FILTER (status IS NULL) AS pending FROM q LEFT JOIN l USING (user_id) GROUP BY field),
    s AS (SELECT *, "view" >= 10 AS complete, "view" < 10 AND pending = 0 AS exhausted FROM g)"""


@query(_PROGRESS + " SELECT * FROM s")
def queue_progress(s, d):
    return queues.progress(_queue(s, d), _latest(s, d), "field", "user_id", ["click", "view", "purchase"], "view", 10)


@query(_PROGRESS + """, o AS (SELECT field FROM s WHERE NOT complete AND pending > 0 ORDER BY "view", field LIMIT 1) SELECT field, user_id FROM q JOIN o USING (field) WHERE user_id NOT IN (SELECT user_id FROM l) ORDER BY pos LIMIT 1""")
def next_in_queue(s, d):
    q, l = _queue(s, d), _latest(s, d)
    return queues.next_item(q, l, queues.progress(q, l, "field", "user_id", ["click", "view", "purchase"], "view", 10), "field", "user_id", "view")


@query("""WITH k AS (SELECT doc_id, coalesce(source, '') AS source, sha256('42:' || coalesce(source, '') || ':' || doc_id) AS o FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY o, doc_id) AS depth FROM k)
    SELECT doc_id, source, depth FROM r ORDER BY depth, sha256('42:' || source) LIMIT 60""")
def representative_sample(s, d):
    return queues.representative_sample(t(s, d, "documents").select("doc_id", F.coalesce("source", lit("")).alias("source")), "source", "doc_id", 60).select("doc_id", "source", c("depth").cast("bigint").alias("depth"))


@query("""SELECT doc_id, source, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY sha256('42:' || coalesce(source, '') || ':' || doc_id), doc_id) AS depth FROM (SELECT doc_id, coalesce(source, '') AS source FROM documents)""")
def candidate_order(s, d):
    return queues.round_robin(t(s, d, "documents").select("doc_id", F.coalesce("source", lit("")).alias("source")), "source", "doc_id").select("doc_id", "source", c("depth").cast("bigint").alias("depth"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n = 3")
def third_per_user(s, d):
    return queues.kth_per_group(t(s, d, "events"), "user_id", ["event_id"], 2).select("user_id", "event_id", "event_type")


_GRID = ", ".join(f"('{a}', '{b}')" for a in SPLITS for b in [*DETECTOR, "address"])


@query(f"SELECT a AS split, b AS field_name, coalesce(n, 0) AS n FROM (VALUES {_GRID}) AS v(a, b) LEFT JOIN (SELECT split, field_name, count(*) AS n FROM recognition_samples GROUP BY ALL) ON split = a AND field_name = b")
def balance_grid(s, d):
    return queues.balance(t(s, d, "recognition_samples"), "split", "field_name", SPLITS, [*DETECTOR, "address"])


@query("""SELECT text FROM recognition_samples WHERE split = 'train' AND field_name IN ('name', 'fathers_name') AND text IS NOT NULL INTERSECT SELECT text FROM recognition_samples WHERE split IN ('valid', 'test') AND field_name IN ('name', 'fathers_name')""")
def names_in_both(s, d):
    r = t(s, d, "recognition_samples").where(c("field_name").isin("name", "fathers_name"))
    return queues.in_both(r.where("split = 'train'"), r.where(c("split").isin("valid", "test")), "text")


@query("SELECT image_path, count(DISTINCT sample_id) AS n FROM recognition_samples WHERE image_path IS NOT NULL GROUP BY image_path HAVING count(DISTINCT sample_id) > 1")
def multiple_references(s, d):
    return t(s, d, "recognition_samples").where("image_path is not null").groupBy("image_path").agg(F.countDistinct("sample_id").alias("n")).where("n > 1")


@query("""SELECT sample_id, concat_ws(',', CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty_text' END, CASE WHEN coalesce(source NOT IN ('synthetic', 'real'), true) THEN 'invalid_source' END, CASE WHEN coalesce(split NOT IN ('train', 'valid', 'test'), true) THEN 'invalid_split' END) AS problems FROM recognition_samples
    WHERE text IS NULL OR trim(text) = '' OR coalesce(source NOT IN ('synthetic', 'real'), true) OR coalesce(split NOT IN ('train', 'valid', 'test'), true)""")
def sample_rejects(s, d):
    p = queues.sample_problems(c("text"), c("source"), c("split"))
    return t(s, d, "recognition_samples").select("sample_id", p.alias("p")).where(F.size("p") > 0).select("sample_id", F.array_join("p", ",").alias("problems"))


# ---- conversion, candidates, batches, reports


def _map(s, d):
    return s.createDataFrame(list(CLASS_MAP["aadhaar"].items()), "class_id BIGINT, target INT")


@query(_LINES + f""", j AS (SELECT c.label_path, NOT kept OR m.class_id IS NULL AS bad, m.target FROM c LEFT JOIN (VALUES {_MAP}) AS m(class_id, target) ON m.class_id = c.class_id),
    g AS (SELECT label_path, NOT bool_or(bad) AS ok, count(*) FILTER (NOT bad AND target IS NOT NULL) AS f, count(*) FILTER (NOT bad AND target IS NULL) AS x FROM j GROUP BY label_path)
    SELECT label_path, ok, CASE WHEN ok THEN f ELSE 0 END AS n_fields, CASE WHEN ok THEN x ELSE 0 END AS n_excluded FROM g""")
def converted_files(s, d):
    return conversion.convert_files(_typed(s, d), _map(s, d)).drop("fields")


_SIDE = "least(CAST({f} AS DOUBLE), ({c} + {s} / 2) * {f}) - greatest(0.0, ({c} - {s} / 2) * {f})"


@query(_LINES + f""", i AS (SELECT label_path, max(width) AS width, max(height) AS height FROM image_records WHERE label_path IS NOT NULL GROUP BY label_path), n AS (SELECT * FROM (VALUES {_DET}) AS v(f, id)),
    k AS (SELECT c.*, i.label_path IS NOT NULL AS seen, width, height, f AS field FROM c LEFT JOIN i USING (label_path) LEFT JOIN n ON id = class_id WHERE kept),
    r AS (SELECT field, CASE WHEN NOT seen THEN 'missing_image' WHEN field IS NULL THEN 'unknown_class' WHEN box AND ({_SIDE.format(c="v[2]", s="v[4]", f="width")} < 2 OR {_SIDE.format(c="v[3]", s="v[5]", f="height")} < 2) THEN 'degenerate_box' END AS reason FROM k)
    SELECT reason, CASE WHEN reason IS NULL THEN field END AS field, count(*) AS n FROM r GROUP BY ALL""")
def candidate_reasons(s, d):
    i = t(s, d, "image_records").where("label_path is not null").groupBy("label_path").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    names = F.create_map(*[x for n, f in enumerate(DETECTOR) for x in (lit(n).cast("bigint"), lit(f))])
    k = conversion.candidates(_typed(s, d), i, names)
    return k.groupBy("reason", F.when(c("reason").isNull(), c("field")).alias("field")).agg(F.count("*").alias("n"))


@query(_LINES + """, p AS (SELECT label_path, class_id, count(*) AS n FROM c WHERE kept GROUP BY ALL) SELECT label_path, string_agg(class_id || CASE WHEN n > 1 THEN 'x' || n ELSE '' END, ', ' ORDER BY class_id) AS caption FROM p GROUP BY label_path""")
def file_captions(s, d):
    return conversion.captions(_typed(s, d))


@query("""SELECT (sample_id - 1) // 32 AS batch, string_agg(CASE WHEN text <> '' THEN text END, '' ORDER BY sample_id, created_at) AS chars, CAST(sum(length(text)) AS BIGINT) AS n FROM (SELECT DISTINCT sample_id, max(text) AS text, max(created_at) AS created_at FROM recognition_samples GROUP BY sample_id) WHERE text IS NOT NULL GROUP BY 1""")
def collated_batches(s, d):
    r = t(s, d, "recognition_samples").groupBy("sample_id").agg(F.max("text").alias("text")).where("text is not null")
    k = conversion.collate(r.select(F.floor((c("sample_id") - 1) / 32).alias("batch"), "sample_id", F.filter(F.split("text", ""), lambda x: x != "").alias("chars")), "batch", "sample_id", "chars")
    return k.select("batch", F.when(F.size("targets") > 0, F.array_join("targets", "")).alias("chars"), F.aggregate("lengths", lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))


@query(f"""WITH r AS (SELECT group_id, split, sha, label_path FROM (SELECT DISTINCT image_id, group_id, {_SPLIT} AS split, {_SHA} AS sha, label_path FROM image_records))
    SELECT 'groups_in_several_splits' AS check, count(*) AS n FROM (SELECT group_id FROM r WHERE group_id IS NOT NULL GROUP BY group_id HAVING count(DISTINCT split) > 1) UNION ALL
    SELECT 'digests_in_several_splits', count(*) FROM (SELECT sha FROM r WHERE sha IS NOT NULL GROUP BY sha HAVING count(DISTINCT split) > 1) UNION ALL SELECT 'records_without_label', count(*) FROM r WHERE label_path IS NULL""".replace("AS check", 'AS "check"'))
def split_report(s, d):
    r = t(s, d, "image_records").select("image_id", "group_id", split_name(c("raw_split")).alias("split"), sha_key(c("sha256")).alias("sha"), "label_path").distinct()
    return conversion.split_report(r, "group_id", "split", "sha", "label_path")


@query("""SELECT o_orderkey, to_json({'status': CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END, 'items': list({'line': l_linenumber, 'part': l_partkey} ORDER BY l_linenumber, l_partkey)})::VARCHAR AS document
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus""")
def json_documents(s, d):
    items = t(s, d, "lineitem").select(c("l_orderkey").alias("o_orderkey"), c("l_linenumber").alias("line"), c("l_partkey").alias("part"))
    n = documents.nest(t(s, d, "orders").select("o_orderkey", F.when(c("o_orderkey") % 3 != 0, c("o_orderstatus")).alias("status")), items, "o_orderkey", ["line"]).where(F.size("items") > 0)
    return n.select("o_orderkey", documents.to_json(F.struct("status", "items")).alias("document"))


@query("SELECT coalesce(source, '') AS source, coalesce(lang, '') AS lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY 1, 2")
def index_rollup(s, d):
    return statistics.index_rollup(t(s, d, "documents"), ["source", "lang"], "n_chars")


@query("""SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, CAST(sum(CAST(l_quantity AS BIGINT) * CAST(l_quantity AS BIGINT)) AS BIGINT) AS squares, count(*) FILTER (l_quantity < l_linenumber) AS narrow,
    count(*) FILTER (l_quantity >= l_linenumber AND l_quantity <= 4 * l_linenumber) AS usual, count(*) FILTER (l_quantity > 4 * l_linenumber) AS wide FROM lineitem GROUP BY l_returnflag""")
def position_spread(s, d):
    q, n = c("l_quantity").cast("bigint"), c("l_linenumber")
    k = lambda x: F.count(F.when(x, 1))
    return t(s, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum(q).alias("total"), F.sum(q * q).alias("squares"), k(q < n).alias("narrow"), k((q >= n) & (q <= 4 * n)).alias("usual"), k(q > 4 * n).alias("wide"))


@query()
def synthetic_samples(s, d):
    """As many records as there are rows of customers, names from the lexicon (a fixed table)."""
    words = t(s, d, "name_lexicon").select("token", "kind").where("token rlike '^[A-Za-z]+$'").orderBy("token").collect()
    by = lambda k: [r.token for r in words if r.kind == k]
    people = synthetic.records(s, t(s, d, "customer").count(), by("given"), by("surname"))
    return synthetic.samples(people, ["name", "fathers_name", "date_of_birth", "gender", "aadhaar_number", "pan_number"])


@query(_LINES + f""", im AS (SELECT image_id, rel_path, split, sha, width, height, label_path, regexp_replace(regexp_extract(rel_path, '[^/]*$'), '\\.[^.]*$', '') AS stem FROM ({_IMAGES})),
    lf AS (SELECT string_split(p, '/')[1] AS split, regexp_replace(regexp_extract(p, '[^/]*$'), '\\.[^.]*$', '') AS stem FROM (SELECT DISTINCT {_PLACE} AS p FROM small_files WHERE kind = 'label') WHERE string_split(p, '/')[1] IN ('train', 'valid', 'test')),
    z AS (SELECT label_path, max(width) AS w, max(height) AS h FROM im WHERE label_path IS NOT NULL AND width > 0 GROUP BY label_path),
    x AS (SELECT unnest([CASE WHEN dup THEN 'duplicate_annotation' END, CASE WHEN v IS NULL THEN 'malformed_line' END, CASE WHEN v IS NOT NULL AND NOT loads THEN 'invalid_class_id' END, CASE WHEN flat THEN 'zero_or_negative_size' END,
      CASE WHEN (box OR poly) AND outside THEN 'coord_out_of_range' END, CASE WHEN edge THEN 'bbox_outside_image' END, CASE WHEN thin THEN 'zero_area_polygon' END, CASE WHEN loads AND NOT box AND NOT poly THEN 'invalid_token_count' END]) AS code FROM c),
    o AS (SELECT code FROM x WHERE code IS NOT NULL
      UNION ALL SELECT 'image_without_label' FROM (SELECT split, stem FROM im WHERE split IS NOT NULL EXCEPT SELECT split, stem FROM lf) UNION ALL SELECT 'label_without_image' FROM (SELECT split, stem FROM lf EXCEPT SELECT split, stem FROM im WHERE split IS NOT NULL)
      UNION ALL SELECT 'corrupted_image' FROM im WHERE coalesce(width, 0) <= 0 OR coalesce(height, 0) <= 0 UNION ALL SELECT 'exact_duplicate_across_splits' FROM (SELECT sha FROM im WHERE sha IS NOT NULL GROUP BY sha HAVING count(DISTINCT split) > 1)
      UNION ALL SELECT 'case_insensitive_name_collision' FROM (SELECT 1 FROM (SELECT DISTINCT rel_path FROM im) GROUP BY lower(rel_path) HAVING count(*) > 1)
      UNION ALL SELECT 'tiny_box' FROM c JOIN z USING (label_path) WHERE box AND least(v[4] * w, v[5] * h) > 0 AND least(v[4] * w, v[5] * h) < 4)
    SELECT code, count(*) AS n FROM o GROUP BY code""")
def audit_issues(s, d):
    i = images(s, d).withColumn("stem", X.stem_of(c("rel_path")))
    return audit.issue_summary(audit.audit(i, _stems(s, d)[1], _checked(s, d))["issues"])


@query("""WITH p AS (SELECT vec_id, list_transform(range(0, 8), lambda k: list_position(embedding[k * 8 + 1:k * 8 + 8], list_max(embedding[k * 8 + 1:k * 8 + 8])) - 1) AS p FROM embeddings),
    k AS (SELECT vec_id, list_filter(range(1, 9), lambda i: p[i] <> 0 AND (i = 1 OR p[i] <> p[greatest(i - 1, 1)])) AS k, p FROM p) SELECT vec_id, array_to_string(list_transform(k, lambda i: p[i]), ' ') AS ids FROM k""")
def decoded_paths(s, d):
    steps = F.transform(F.sequence(lit(0), lit(7)), lambda k: F.slice(c("embedding"), k * 8 + 1, lit(8)))
    return t(s, d, "embeddings").select("vec_id", F.array_join(F.transform(X.greedy_path(steps), lambda x: x.cast("string")), " ").alias("ids"))


@query(f"""SELECT sample_id, {_WS} AS text, CASE WHEN coalesce({_WS}, '') = '' THEN CAST(0 AS DOUBLE) ELSE CAST(sample_id % 8 AS DOUBLE) / 8 END AS confidence FROM recognition_samples""")
def cleaned_results(s, d):
    r = X.clean_result(c("text"), (c("sample_id") % 8).cast("double") / 8)
    return t(s, d, "recognition_samples").select("sample_id", r["text"].alias("text"), r["confidence"].alias("confidence"))
