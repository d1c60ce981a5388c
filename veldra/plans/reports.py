"""More queries of the catalogue: file contents, converted documents, and operators on whole values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..functions.normal import place_key
from ..operators import audit, benchmark, conversion, documents, inventory, labels, pairing
from ..vocab import CLASS_MAP, DETECTOR, FIELDS, SPLITS
from . import catalogue as K

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

c, lit, t = F.col, F.lit, K.t


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- files

_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


@query(f"""WITH f AS (SELECT file_id, CAST(strlen(content) AS BIGINT) AS size_bytes, try(decode(encode(content)[1:120])) AS head FROM small_files),
    l AS (SELECT *, CASE WHEN head = '' THEN [] ELSE list_slice(regexp_split_to_array(regexp_replace(head, '({_ENDS})$', ''), '{_ENDS}'), 1, 3) END AS l FROM f)
    SELECT file_id, size_bytes, CASE WHEN head IS NULL THEN 'binary' ELSE 'utf-8' END AS encoding, CASE WHEN head IS NOT NULL THEN size_bytes > 120 END AS truncated,
      array_to_string(list_transform(l, lambda y: array_to_string(list_transform(list_filter(regexp_split_to_array(y, '\\s+'), lambda x: x <> ''), lambda x: {K._RED}), ' ')), chr(10)) AS lines FROM l""")
def previews(s, d):
    """The first 120 bytes of each file: a cut within a character is no UTF-8."""
    p = inventory.preview_files(t(s, d, "small_files").select("file_id", c("content").cast("binary").alias("content")), "file_id", "content", 3, 120)
    return p.select("file_id", "size_bytes", "encoding", "truncated", F.array_join("lines", "\n").alias("lines"))


def _last_files(s, d):
    """The last version of each place."""
    f = t(s, d, "small_files").select(place_key(c("file_path")).alias("path"), c("content").cast("binary").alias("content"), F.struct("modified_at", "file_id").alias("o"))
    return f.where("path is not null").groupBy("path").agg(F.max_by("content", "o").alias("content"))


_FILES = f"""f AS (SELECT path, content, string_split(path, '/') AS p FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY modified_at DESC NULLS LAST, file_id DESC) AS n FROM (SELECT *, {K._PLACE} AS path FROM small_files)) WHERE n = 1)"""
_LABEL_PLACE = K._PLACE.replace("file_path", "label_path")


@query(f"""WITH {_FILES}, s AS (SELECT p[1] AS split FROM f GROUP BY p[1] HAVING bool_or(len(p) > 2 AND p[2] IN ('images', 'labels'))),
    l AS (SELECT path, CASE WHEN len(p) = 3 AND p[2] = 'labels' THEN content END AS content, array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array(content, '\\r\\n|[\\n\\r]'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')), chr(10)) AS bag FROM f WHERE len(p) = 3 AND p[2] = 'labels'),
    i AS (SELECT DISTINCT {K._SHA} AS sha, {_LABEL_PLACE} AS path FROM image_records WHERE label_path IS NOT NULL),
    o AS (SELECT DISTINCT 'unexpected_entry' AS code, p[1] AS subject FROM f WHERE p[1] NOT IN (SELECT split FROM s)
      UNION ALL SELECT 'unexpected_file', path FROM f WHERE len(p) = 3 AND p[1] IN (SELECT split FROM s) AND ((p[2] = 'images') <> regexp_matches(lower(path), '[^/]\\.(jpg|jpeg|png|bmp|webp|tif|tiff)$')) AND p[2] IN ('images', 'labels')
      UNION ALL SELECT 'empty_label_file', path FROM l WHERE NOT regexp_matches(content, '\\S')
      UNION ALL SELECT 'duplicate_images_conflicting_labels', sha FROM i JOIN l USING (path) WHERE sha IS NOT NULL GROUP BY sha HAVING count(DISTINCT bag) > 1 AND count(DISTINCT path) > 1)
    SELECT code, subject FROM o""")
def audit_file_issues(s, d):
    i = K.images(s, d).withColumn("label_path", place_key(c("label_path")))
    return audit.file_issues(_last_files(s, d), i)


_LINE_OK = "len(k) >= 5 AND len(list_filter(k, lambda x: NOT regexp_full_match(x, '" + K._NUM + "'))) = 0"


@query(f"""WITH {_FILES}, l AS (SELECT path, list_filter(list_transform(regexp_split_to_array(content, '\\r\\n|[\\n\\r]'), lambda y: list_filter(regexp_split_to_array(y, '\\s+'), lambda x: x <> '')), lambda y: len(y) > 0) AS l FROM f),
    g AS (SELECT path, unnest(l) AS k FROM l), h AS (SELECT path, bool_and(CASE WHEN {_LINE_OK} THEN coalesce(TRY_CAST(regexp_replace(k[1], '^\\+', '') AS DOUBLE), 'nan'::DOUBLE) ELSE 'nan'::DOUBLE END BETWEEN 0 AND 1e300
      AND CASE WHEN {_LINE_OK} THEN TRY_CAST(regexp_replace(k[1], '^\\+', '') AS DOUBLE) = floor(TRY_CAST(regexp_replace(k[1], '^\\+', '') AS DOUBLE)) ELSE false END) AS ok FROM g GROUP BY path)
    SELECT path, lower(path) LIKE '%.txt' AND coalesce(ok, false) AS fits FROM f LEFT JOIN h USING (path)""")
def label_files_fit(s, d):
    return labels.files_fit(_last_files(s, d).withColumn("content", c("content").cast("string")))


# ---- converted documents

_DTYPES = ", ".join(f"('{k}', {i}, {'NULL' if f is None else chr(39) + f + chr(39)})" for k, m in (("aadhaar", CLASS_MAP["aadhaar"]), ("pan", CLASS_MAP["pan"])) for i, f in ((i, None if j is None else DETECTOR[j]) for i, j in m.items()))
_VOCABULARY = ", ".join(f"('{k}', '{f}')" for k, fs in FIELDS.items() for f in fs)
_CONVERTED = f"""WITH i AS (SELECT image_id, dataset AS document_type, rel_path, width, height, label_path FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY ingested_at DESC NULLS LAST) AS n FROM image_records) WHERE n = 1),
    t AS (SELECT DISTINCT label_path, line, list_filter(regexp_split_to_array(raw, '\\s+'), lambda x: x <> '') AS k FROM label_lines),
    j AS (SELECT image_id, document_type, line, k, CASE WHEN regexp_full_match(k[1], '[+-]?[0-9]+') THEN TRY_CAST(regexp_replace(k[1], '^\\+', '') AS BIGINT) END AS class_id,
      CASE WHEN len(list_filter(k[2:], lambda x: NOT regexp_full_match(x, '{K._NUM}'))) = 0 THEN list_transform(k[2:], lambda x: TRY_CAST(regexp_replace(x, '^\\+', '') AS DOUBLE)) END AS c FROM i JOIN t USING (label_path) WHERE len(k) > 0),
    m AS (SELECT * FROM (VALUES {_DTYPES}) AS v(document_type, class_id, field_name)), w AS (SELECT * FROM (VALUES {_VOCABULARY}) AS v(document_type, field_name)),
    e AS (SELECT j.*, m.class_id IS NOT NULL AS known, m.field_name, CASE WHEN j.class_id IS NULL OR c IS NULL THEN 'malformed_line' WHEN m.class_id IS NULL THEN 'unmapped_class'
      WHEN m.field_name IS NOT NULL AND w.field_name IS NULL THEN 'field_not_of_type' WHEN m.field_name IS NOT NULL AND len(c) <> 4 AND (len(c) < 6 OR len(c) % 2 = 1) THEN 'coordinate_count'
      WHEN m.field_name IS NOT NULL AND len(c) = 4 AND ((NOT isnan(c[3]) AND c[3] < 0) OR (NOT isnan(c[4]) AND c[4] < 0)) THEN 'reversed_box' END AS error
      FROM j LEFT JOIN m ON m.document_type = j.document_type AND m.class_id = j.class_id LEFT JOIN w ON w.document_type = j.document_type AND w.field_name = m.field_name),
    g AS (SELECT image_id, arg_min(error, (line, k)) FILTER (error IS NOT NULL) AS error, count(*) AS n_lines, count(*) FILTER (known AND field_name IS NULL AND class_id = 4) AS x, count(*) FILTER (error IS NULL AND field_name IS NOT NULL) AS f FROM e GROUP BY image_id),
    r AS (SELECT image_id, document_type, CASE WHEN NOT coalesce(width > 0 AND height > 0, false) THEN 'missing_image' ELSE error END AS error, coalesce(n_lines, 0) AS n_lines, coalesce(x, 0) AS x, coalesce(f, 0) AS f, string_split(rel_path, '/') AS p, width, height FROM i LEFT JOIN g USING (image_id))"""


def _converted(s, d):
    r = pairing.last_wins(t(s, d, "image_records"), "image_id", ["ingested_at"], ["ingested_at", "rel_path", "dataset", "width", "height", "label_path"])
    m = s.createDataFrame([(k, i, None if j is None else DETECTOR[j]) for k, x in CLASS_MAP.items() for i, j in x.items()], "document_type STRING, class_id BIGINT, field_name STRING")
    return conversion.convert_documents(r.withColumnRenamed("dataset", "document_type"), t(s, d, "label_lines"), m)


@query(_CONVERTED + """ SELECT image_id, error IS NULL AS ok, error, n_lines, CASE WHEN error IS NULL THEN x ELSE 0 END AS n_excluded, CASE WHEN error IS NULL THEN f ELSE 0 END AS n_fields,
    CASE WHEN len(p) > 2 THEN p[len(p) - 2] END AS split, document_type, width, height FROM r""")
def converted_documents(s, d):
    k = _converted(s, d)
    return k.select("image_id", "ok", "error", "n_lines", "n_excluded", F.coalesce(F.when(c("ok"), F.size("fields")), lit(0)).cast("bigint").alias("n_fields"), "split", "document_type", "width", "height")


@query(_CONVERTED + """ SELECT image_id, line, e.field_name, class_id, CASE WHEN len(c) = 4 THEN 'bbox' ELSE 'polygon' END AS kind,
    CASE WHEN len(c) = 4 THEN c[1] - c[3] / 2 ELSE list_min(list_transform(range(1, len(c), 2), lambda i: c[i])) END AS x1, CASE WHEN len(c) = 4 THEN c[2] - c[4] / 2 ELSE list_min(list_transform(range(2, len(c) + 1, 2), lambda i: c[i])) END AS y1,
    CASE WHEN len(c) = 4 THEN c[1] + c[3] / 2 ELSE list_max(list_transform(range(1, len(c), 2), lambda i: c[i])) END AS x2, CASE WHEN len(c) = 4 THEN c[2] + c[4] / 2 ELSE list_max(list_transform(range(2, len(c) + 1, 2), lambda i: c[i])) END AS y2,
    CASE WHEN len(c) = 4 THEN 0 ELSE len(c) // 2 END AS n_points FROM e JOIN r USING (image_id) WHERE r.error IS NULL AND e.field_name IS NOT NULL""")
def converted_fields(s, d):
    f = _converted(s, d).select("image_id", F.explode("fields").alias("f"))
    return f.select("image_id", *[c(f"f.{k}").alias(k) for k in ("line", "field_name", "class_id", "kind", "x1", "y1", "x2", "y2")], F.coalesce(F.when(c("f.kind") == "polygon", F.size("f.points")), lit(0)).cast("bigint").alias("n_points"))


@query(_CONVERTED + """ SELECT document_type, count(*) AS input_images, count(*) FILTER (error IS NULL) AS converted_documents, CAST(coalesce(sum(n_lines) FILTER (error IS NULL), 0) AS BIGINT) AS input_annotations,
    CAST(coalesce(sum(f) FILTER (error IS NULL), 0) AS BIGINT) AS included_fields, CAST(coalesce(sum(x) FILTER (error IS NULL), 0) AS BIGINT) AS excluded_class_4 FROM r GROUP BY document_type""")
def conversion_stats(s, d):
    return conversion.conversion_stats(_converted(s, d))


# ---- positions of boxes

_BOXES = K._LINES + """, b AS (SELECT class_id, label_path, v[2] AS cx, v[3] AS cy, v[4] AS w, v[5] AS h FROM c WHERE box AND class_id IS NOT NULL AND NOT (isnan(v[2]) OR isnan(v[3]) OR isnan(v[4]) OR isnan(v[5])) AND greatest(abs(v[2]), abs(v[3]), abs(v[4]), abs(v[5])) <= 1e9)"""


@query(_BOXES + """ SELECT class_id, count(*) AS n_boxes, round(stddev_pop(cx), 6) AS cx_std, round(stddev_pop(cy), 6) AS cy_std, round(stddev_pop(w), 6) AS w_std, round(stddev_pop(h), 6) AS h_std,
    round(median(CASE WHEN h <> 0 THEN w / h END), 6) AS aspect_median FROM b GROUP BY class_id""")
def box_spread(s, d):
    b = labels.box_spread(K._typed(s, d))
    return b.select("class_id", "n_boxes", *[F.round(k, 6).alias(k) for k in ("cx_std", "cy_std", "w_std", "h_std", "aspect_median")])


@query(_BOXES + f""", z AS (SELECT label_path, max(width) AS width, max(height) AS height FROM image_records WHERE label_path IS NOT NULL AND width > 0 GROUP BY label_path),
    k AS (SELECT least(trunc(greatest((cx + w / 2) * width, 0.0)), width) - least(trunc(greatest((cx - w / 2) * width, 0.0)), width) AS pw, least(trunc(greatest((cy + h / 2) * height, 0.0)), height) - least(trunc(greatest((cy - h / 2) * height, 0.0)), height) AS ph,
      CASE WHEN h > 0 THEN w / h ELSE 0 END AS a FROM b JOIN z USING (label_path) WHERE class_id = 4)
    SELECT count(*) AS n, CAST(min(pw) AS BIGINT) AS least_w, median(pw) AS median_w, CAST(max(pw) AS BIGINT) AS most_w, CAST(min(ph) AS BIGINT) AS least_h, median(ph) AS median_h, CAST(max(ph) AS BIGINT) AS most_h,
      count(*) FILTER (a < 1) AS tall, count(*) FILTER (a >= 1 AND a <= 4) AS mid, count(*) FILTER (a > 4) AS wide FROM k""")
def crop_shapes(s, d):
    z = t(s, d, "image_records").where("label_path is not null and width > 0").groupBy("label_path").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    return labels.crop_shapes(K._typed(s, d), z)


# ---- geometry and dates of the labels themselves


@query(K._LINES + """, g AS (SELECT row_id, label_path, box, v, list_transform(range(2, len(v), 2), lambda i: v[i]) AS xs, list_transform(range(3, len(v) + 1, 2), lambda i: v[i]) AS ys FROM c
      WHERE kept AND len(list_filter(co, lambda x: isnan(x) OR isinf(x))) = 0),
    z AS (SELECT label_path, max(width) AS width, max(height) AS height FROM image_records WHERE label_path IS NOT NULL AND width > 0 AND height > 0 GROUP BY label_path),
    k AS (SELECT row_id, label_path, CASE WHEN box THEN v[2] - v[4] / 2 ELSE list_min(xs) END AS x1, CASE WHEN box THEN v[3] - v[5] / 2 ELSE list_min(ys) END AS y1, CASE WHEN box THEN v[2] + v[4] / 2 ELSE list_max(xs) END AS x2,
      CASE WHEN box THEN v[3] + v[5] / 2 ELSE list_max(ys) END AS y2, CASE WHEN NOT box THEN round(abs(list_sum(list_transform(range(1, len(xs) + 1), lambda i: xs[i] * ys[i % len(xs) + 1] - xs[i % len(xs) + 1] * ys[i]))), 9) END AS twice_area FROM g)
    SELECT row_id, x1, y1, x2, y2, x1 * width AS ax1, y1 * height AS ay1, x2 * width AS ax2, y2 * height AS ay2, twice_area FROM k LEFT JOIN z USING (label_path)""")
def label_geometry(s, d):
    """Corners of every box and polygon, in parts of the image and in pixels, and twice the area of polygons."""
    k = K._typed(s, d).where("kept").where(~F.exists(labels.coordinates(c("v")), lambda x: F.isnan(x) | (F.abs(x) == float("inf"))))
    at = lambda i: F.get("v", lit(i))
    points = G.points_of(F.when(c("kind") == "polygon", labels.coordinates(c("v"))))
    box, outline = G.corners(at(1), at(2), at(3), at(4)), G.enclosing(points)
    names = ("x1", "y1", "x2", "y2")
    one = [F.when(c("kind") == "bbox", a).otherwise(b).alias(n) for n, a, b in zip(names, box, outline)]
    z = t(s, d, "image_records").where("label_path is not null and width > 0 and height > 0").groupBy("label_path").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    j = k.select("row_id", "label_path", *one, F.round(G.twice_area(points), 9).alias("twice_area")).join(z, "label_path", "left")
    both = G.to_absolute(F.array(F.struct(c("x1").alias("x"), c("y1").alias("y")), F.struct(c("x2").alias("x"), c("y2").alias("y"))), c("width"), c("height"))
    return j.select("row_id", *names, *[both[i][a].alias(f"a{a}{i + 1}") for i in (0, 1) for a in ("x", "y")], "twice_area")


@query(f"""WITH r AS (SELECT sample_id, text AS v FROM recognition_samples WHERE field_name = 'date_of_birth') SELECT sample_id, v AS text, {K._DOB_CASE.replace("trim(v)", "trim(v, ' ' || chr(9) || chr(10) || chr(13))").replace("1997-06-30", "2020-06-30")} AS problem FROM r""")
def sample_birth_dates(s, d):
    r = t(s, d, "recognition_samples").where("field_name = 'date_of_birth'")
    return r.select("sample_id", "text", X.birth_date_problem(c("text"), F.to_date(lit("2020-06-30"))).alias("problem"))


# ---- whole values


@query("""WITH v AS (SELECT vec_id, list_concat(embedding, embedding[1:8]) AS e FROM embeddings)
    SELECT vec_id, array_to_string(list_transform(list_filter(range(1, 72), lambda i: i % 9 <> 0), lambda i: CASE WHEN e[i] > e[i + 1] THEN '1' ELSE '0' END), '') AS bits FROM v""")
def gradient_hashes(s, d):
    """Grids of eight rows of nine: the 64 cells of a vector and its first eight again."""
    grid = F.concat("embedding", F.slice("embedding", 1, 8))
    return t(s, d, "embeddings").select("vec_id", F.lpad(F.conv(F.hex(G.difference_hash(grid)), 16, 2), 64, "0").alias("bits"))


@query("""WITH p AS (SELECT vec_id, list_transform(range(0, 8), lambda k: list_position(embedding[k * 8 + 1:k * 8 + 8], list_max(embedding[k * 8 + 1:k * 8 + 8])) - 1) AS p, list_transform(range(0, 8), lambda k: CAST(list_max(embedding[k * 8 + 1:k * 8 + 8]) AS DOUBLE)) AS m FROM embeddings)
    SELECT vec_id, CASE WHEN len(list_filter(range(1, 9), lambda i: p[i] <> 0 AND (i = 1 OR p[i] <> p[greatest(i - 1, 1)]))) > 0 THEN round(exp(list_sum(m) / 8), 6) ELSE 0 END AS confidence FROM p""")
def path_confidences(s, d):
    steps = F.transform(F.sequence(lit(0), lit(7)), lambda k: F.transform(F.slice(c("embedding"), k * 8 + 1, lit(8)), lambda x: x.cast("double")))
    return t(s, d, "embeddings").select("vec_id", F.round(X.path_confidence(steps), 6).alias("confidence"))


@query("""SELECT o_orderkey, to_json({'status': CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END, 'items': coalesce(list({'line': l_linenumber, 'part': l_partkey} ORDER BY l_linenumber, l_partkey) FILTER (l_orderkey IS NOT NULL), [])})::VARCHAR AS document
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus""")
def json_all_documents(s, d):
    """Orders without items included."""
    items = t(s, d, "lineitem").select(c("l_orderkey").alias("o_orderkey"), c("l_linenumber").alias("line"), c("l_partkey").alias("part"))
    n = documents.nest(t(s, d, "orders").select("o_orderkey", F.when(c("o_orderkey") % 3 != 0, c("o_orderstatus")).alias("status")), items, "o_orderkey", ["line"])
    return n.select("o_orderkey", documents.to_json(F.struct("status", "items")).alias("document"))


# ---- benchmark


@query(f"""WITH v AS (SELECT {K._PLACE} AS path, content, modified_at, file_id FROM small_files),
    a AS (SELECT path, arg_min(sha256(content), (modified_at, file_id)) AS sha, arg_max(sha256(content), (modified_at, file_id)) AS now FROM v GROUP BY path)
    SELECT path AS sample_id, path, CASE WHEN sha = now THEN 'ok' ELSE 'digest_mismatch' END AS status FROM a""")
def crop_checks(s, d):
    """The last version of each file against the digest of its first."""
    f = t(s, d, "small_files").select(place_key(c("file_path")).alias("path"), c("content").cast("binary").alias("content"), F.struct("modified_at", "file_id").alias("o")).where("path is not null")
    first = f.groupBy("path").agg(F.min_by(F.sha2("content", 256), "o").alias("sha256")).withColumn("sample_id", c("path"))
    return benchmark.verified_crops(first, _last_files(s, d)).select("sample_id", "path", "status")


@query("""WITH p AS (SELECT p_brand, levenshtein(CASE WHEN p_partkey % 7 = 0 THEN '' ELSE reverse(p_name) END, p_name) AS e, length(p_name) AS l, CAST(CASE WHEN p_partkey % 7 = 0 THEN '' ELSE reverse(p_name) END = p_name AS INT) AS x FROM part)
    SELECT p_brand AS field, count(*) AS n, CAST(sum(e) AS BIGINT) AS edits, CAST(sum(l) AS BIGINT) AS ref_chars, CAST(sum(x) AS BIGINT) AS exact, sum(e) / sum(l) AS cer, sum(x) / count(*) AS exact_share FROM p GROUP BY GROUPING SETS ((), (p_brand))""")
def benchmark_scores(s, d):
    """Every seventh sample has no prediction."""
    p = t(s, d, "part").select(c("p_partkey").alias("sample_id"), c("p_brand").alias("field"), c("p_name").alias("reference"))
    k = benchmark.evaluate(p.where("sample_id % 7 <> 0").select("sample_id", F.reverse("reference").alias("prediction")), p)
    return k.select("field", "n", "edits", "ref_chars", "exact", "cer", "exact_share")


@query("""WITH p AS (SELECT p_partkey AS image_id, p_size AS width, p_size * 2 AS height FROM part) SELECT image_id, CAST(p.width AS DOUBLE) / 100 AS confidence, CASE WHEN width % 3 = 0 THEN NULL ELSE 'x' || width END AS text,
    CAST(height AS DOUBLE) / 100 AS detection_confidence, CAST(width AS DOUBLE) / 100 AS recognition_confidence FROM p""")
def merged_regions(s, d):
    r = t(s, d, "part").select(c("p_partkey").alias("image_id"), F.struct(lit(1).alias("class_id"), lit("name").alias("class_name"), ((c("p_size") * 2).cast("double") / 100).alias("confidence")).alias("region"),
        F.struct(F.when(c("p_size") % 3 != 0, F.concat(lit("x"), c("p_size"))).alias("text"), (c("p_size").cast("double") / 100).alias("confidence")).alias("result"))
    m = X.merged_region(c("region"), c("result"))
    return r.select("image_id", *[m[k].alias(k) for k in ("confidence", "text", "detection_confidence", "recognition_confidence")])


# ---- the same queries as in the catalogue, whose SQL there covers a part of the table only, beside SQL for the whole


@query("SELECT doc_id, CASE WHEN length(text) <= 30 THEN text ELSE left(text, 14) || '…' || right(text, 15) END AS short FROM documents")
def ellipsized_whole(s, d):
    return K.ellipsized(s, d)


@query(f"""WITH r AS (SELECT (sample_id - 1) // 4 AS doc_id, field_name AS field, text FROM recognition_samples), y AS (SELECT DISTINCT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'aadhaar' ELSE 'pan' END AS dt FROM r),
    s AS (SELECT doc_id, field, count(*) AS n, max(CASE WHEN trim(text) <> '' THEN 1 ELSE 0 END) AS ok FROM r WHERE field IS NOT NULL GROUP BY ALL), w AS (SELECT doc_id, f AS field FROM y JOIN (VALUES {_VOCABULARY}) AS v(t, f) ON t = dt)
    SELECT doc_id, field, 'missing_field' AS issue FROM w LEFT JOIN s USING (doc_id, field) WHERE coalesce(ok, 0) = 0 UNION ALL SELECT doc_id, field, 'unexpected_field' FROM s WHERE (doc_id, field) NOT IN (SELECT doc_id, field FROM w)
    UNION ALL SELECT doc_id, field, 'duplicate_field' FROM s WHERE n > 1 AND (doc_id, field) IN (SELECT doc_id, field FROM w)""")
def field_issues_whole(s, d):
    return K.field_issues(s, d)


_POINTS = "list_transform(range({}, 65, 2), lambda i: CAST(floor(embedding[i] * 100) AS DOUBLE))"


@query(f"""SELECT vec_id, list_min(xs) AS x1, list_min(ys) AS y1, list_max(xs) AS x2, list_max(ys) AS y2, abs(list_sum(list_transform(range(1, 33), lambda i: xs[i] * ys[i % 32 + 1] - xs[i % 32 + 1] * ys[i]))) AS twice_area
    FROM (SELECT vec_id, {_POINTS.format(1)} AS xs, {_POINTS.format(2)} AS ys FROM embeddings)""")
def polygon_boxes_whole(s, d):
    return K.polygon_boxes(s, d)
