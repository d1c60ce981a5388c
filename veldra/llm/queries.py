"""Queries p1, p3, p4, p6 to p9 and their SQL, where SQL can state them over whole tables."""

from __future__ import annotations

import os
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.sql import SHA as _SHA
from ..plans.sql import SPLIT as _SPLIT
from ..storage import Scratch, scratch_root, stamp
from . import incremental, match_groups, mixing, overlap, pii, splits, tokens


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.straddling_records(_table(spark, d, "image_records"), Scratch(spark, "p1"))


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(splits.record_components(_table(spark, d, "image_records"), Scratch(spark, "p1")))


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_shares(p1_splits(spark, d))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each image with its component, without the split, which hangs on a hash."""
    return splits.record_components(_table(spark, d, "image_records"), Scratch(spark, "p1"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    t = [_table(spark, d, x) for x in ("image_records", "match_pairs", "source_groups")]
    return match_groups.tied_images(*t, Scratch(spark, "p3"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    t = [_table(spark, d, x) for x in ("image_records", "match_pairs", "source_groups")]
    return match_groups.consolidate(*t, Scratch(spark, "p3"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_pairs(_table(spark, d, "image_records"), Scratch(spark, "p4"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(_table(spark, d, "image_records"), Scratch(spark, "p4"))


def p4_containment(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_classes(_table(spark, d, "image_records"), Scratch(spark, "p4"))[0]


def p4_members(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_classes(_table(spark, d, "image_records"), Scratch(spark, "p4"))[1]


def p6_index(spark: SparkSession, d: str) -> incremental.PivotIndex:
    """The stored index of image_records, in the folder that the executors share: made by whoever asks first, opened by all
    others. Its name tells the files of the two tables, so that other tables have another index."""
    files = stamp(spark, f"{d}/image_records.parquet", f"{d}/incoming_images.parquet")
    index = incremental.PivotIndex(spark, f"{scratch_root(spark)}/veldra-history-{incremental.LAYOUT}-{files}")
    if 0 not in index.batches():
        index.append(incremental.read_records(_table(spark, d, "image_records")), 0)
    return index


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.accept(p6_index(spark, d), _table(spark, d, "incoming_images"), Scratch(spark, "p6")).select("incoming_id")


def p6_repeats(spark: SparkSession, d: str) -> DataFrame:
    """The repeats with their batch and whether history had them."""
    return incremental.accept(p6_index(spark, d), _table(spark, d, "incoming_images"), Scratch(spark, "p6"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_documents(_table(spark, d, "documents"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.draw(_table(spark, d, "documents"), _table(spark, d, "mix_targets"), Scratch(spark, "p8"))[1]


def p8_sample(spark: SparkSession, d: str) -> DataFrame:
    return mixing.draw(_table(spark, d, "documents"), _table(spark, d, "mix_targets"), Scratch(spark, "p8"))[0]


def pii_key() -> bytes:
    """The secret of the pseudonyms, from VELDRA_PII_KEY. Without it the registered queries, which are for test tables, take
    a fixed test key, so that runs can be compared, and say so; the operators themselves have no default."""
    if key := os.environ.get("VELDRA_PII_KEY"):
        return key.encode()
    warnings.warn("VELDRA_PII_KEY is unset: pseudonyms are made with a test key that anyone can know", stacklevel=2)
    return b"key for tests"


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    found = pii.scan_documents(_table(spark, d, "documents"), _table(spark, d, "name_lexicon"), pii_key())
    return found.select("doc_id", "kind", "mention").distinct()


def p9_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Every mention with its pseudonym, dates included."""
    return pii.scan_documents(_table(spark, d, "documents"), _table(spark, d, "name_lexicon"), pii_key(), dates=True)


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact_documents(_table(spark, d, "documents"), _table(spark, d, "name_lexicon"), pii_key())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_splits, p1_shares, p1_groups, p3_found, p3_groups, p4_found, p4_report, p4_containment, p4_members, p6_found, p6_repeats, p7_ids, p8_mix, p8_sample, p9_found, p9_mentions, p9_redacted)
}

# Stand-ins and split words as in functions.normal, letters and digits only.
_NAME = r"regexp_replace(regexp_replace(trim(lower({c}), ' ' || chr(9) || chr(10) || chr(13)), '\.rf\.[0-9a-f]{{32}}$', ''), '[^a-z0-9]+', '', 'g')"
_STAND_INS = "('', 'na', 'none', 'null', 'nil', 'nan', 'unknown', 'untitled', 'unnamed', 'undefined', 'missing', 'tbd')"


def _name(c: str) -> str:
    n = _NAME.format(c=c)
    return f"CASE WHEN {n} NOT IN {_STAND_INS} THEN {n} END"



_P1 = f"""WITH RECURSIVE r AS (SELECT image_id, {_name("group_id")} AS g, {_name("roboflow_source")} AS s, {_SPLIT} AS split FROM image_records),
    k AS (SELECT image_id, 'g' || g AS k FROM r WHERE g IS NOT NULL UNION SELECT image_id, 's' || s FROM r WHERE s IS NOT NULL),
    h AS (SELECT k, min(image_id) AS head FROM k GROUP BY k),
    e AS (SELECT DISTINCT k.image_id AS a, h.head AS b FROM k JOIN h USING (k)),
    ab AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    walk(a, b) AS (SELECT DISTINCT image_id, image_id FROM r UNION SELECT w.a, x.b FROM walk w JOIN ab x ON w.b = x.a),
    c AS (SELECT a AS image_id, min(b) AS component FROM walk GROUP BY a)"""

_P3 = """WITH RECURSIVE i AS (SELECT DISTINCT image_id FROM image_records),
    l AS (SELECT group_id, unnest(members) AS m FROM source_groups),
    x AS (SELECT l.group_id, l.m FROM l JOIN i ON l.m = i.image_id),
    h AS (SELECT group_id, min(m) AS head FROM x GROUP BY group_id),
    e AS (SELECT m AS a, head AS b FROM x JOIN h USING (group_id) UNION SELECT image_id_a, image_id_b FROM match_pairs JOIN i p ON image_id_a = p.image_id JOIN i q ON image_id_b = q.image_id WHERE is_match),
    ab AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    walk(a, b) AS (SELECT image_id, image_id FROM i UNION SELECT w.a, x.b FROM walk w JOIN ab x ON w.b = x.a),
    c AS (SELECT a AS image_id, min(b) AS group_key, count(*) AS n FROM walk GROUP BY a)"""

_P4 = f"""WITH r AS (SELECT DISTINCT image_id, {_SPLIT} AS split, {_SHA} AS sha, CASE WHEN dhash <> 0 THEN dhash END AS h, coalesce({_name("roboflow_source")}, '') AS source FROM image_records),
    t AS (SELECT * FROM r WHERE split = 'train'), v AS (SELECT * FROM r WHERE split <> 'train')"""

SQL: dict[str, str] = {
    "p1_found": f"""{_P1}, f AS (SELECT component FROM c JOIN r USING (image_id) GROUP BY component HAVING count(DISTINCT split) > 1)
        SELECT image_id FROM c JOIN f USING (component)""",
    "p1_groups": f"{_P1} SELECT image_id, component FROM c",
    "p3_found": f"{_P3} SELECT image_id, group_key FROM c WHERE n > 1",
    "p3_groups": f"{_P3} SELECT image_id, group_key FROM c",
    "p4_found": f"""{_P4} SELECT DISTINCT least(t.image_id, v.image_id) AS image_id_a, greatest(t.image_id, v.image_id) AS image_id_b FROM t JOIN v
        ON (t.sha = v.sha OR bit_count(xor(t.h, v.h)) <= 2) AND t.image_id <> v.image_id""",
    "p4_report": f"""{_P4}, m AS (SELECT v.split, v.source, v.image_id, max(CASE WHEN v.sha IN (SELECT sha FROM t WHERE sha IS NOT NULL) THEN 1 ELSE 0 END) AS same,
            max(CASE WHEN EXISTS (SELECT 1 FROM t WHERE bit_count(xor(t.h, v.h)) <= 2) THEN 1 ELSE 0 END) AS alike FROM v GROUP BY ALL)
        SELECT split, source, count(*) AS n_images, CAST(sum(same) AS BIGINT) AS n_same, CAST(sum(alike) AS BIGINT) AS n_like, CAST(sum(greatest(same, alike)) AS BIGINT) AS n_overlap FROM m GROUP BY split, source""",
    "p4_containment": f"""{_P4}, e AS (SELECT h, min(image_id) AS evaluation FROM v WHERE h IS NOT NULL GROUP BY h), u AS (SELECT h, min(image_id) AS training FROM t WHERE h IS NOT NULL GROUP BY h),
        n AS (SELECT evaluation, training, CAST(bit_count(xor(e.h, u.h)) AS INTEGER) AS bits, len(list_filter(range(0, 4), lambda i: ((xor(e.h, u.h) >> CAST(16 * i AS INTEGER)) & 65535) = 0)) AS w FROM e JOIN u ON bit_count(xor(e.h, u.h)) <= 2)
        SELECT evaluation, training, bits, CAST(w * (w - 1) // 2 AS INTEGER) AS hits, CAST(w * (w - 1) // 2 AS DOUBLE) / 6 AS containment FROM n""",
    "p4_members": f"""{_P4}, e AS (SELECT h, min(image_id) AS r FROM v WHERE h IS NOT NULL GROUP BY h), u AS (SELECT h, min(image_id) AS r FROM t WHERE h IS NOT NULL GROUP BY h)
        SELECT DISTINCT 'evaluation' AS side, e.r AS representative, image_id FROM v JOIN e USING (h) WHERE EXISTS (SELECT 1 FROM u WHERE bit_count(xor(e.h, u.h)) <= 2)
        UNION ALL SELECT DISTINCT 'training', u.r, image_id FROM t JOIN u USING (h) WHERE EXISTS (SELECT 1 FROM e WHERE bit_count(xor(e.h, u.h)) <= 2)""",
    "p6_found": f"""WITH n AS (SELECT incoming_id, {_SHA} AS sha, CASE WHEN dhash <> 0 THEN dhash END AS h FROM incoming_images),
        o AS (SELECT 0 AS first, {_SHA} AS sha, CASE WHEN dhash <> 0 THEN dhash END AS h FROM image_records UNION ALL SELECT * FROM n)
        SELECT DISTINCT n.incoming_id FROM n JOIN o ON o.first < n.incoming_id AND (o.sha = n.sha OR bit_count(xor(o.h, n.h)) <= 2)""",
    "p6_repeats": f"""WITH n AS (SELECT incoming_id, batch_no, {_SHA} AS sha, CASE WHEN dhash <> 0 THEN dhash END AS h FROM incoming_images),
        o AS (SELECT 0 AS first, {_SHA} AS sha, CASE WHEN dhash <> 0 THEN dhash END AS h FROM image_records UNION ALL SELECT incoming_id, sha, h FROM n)
        SELECT n.incoming_id, min(n.batch_no) AS batch_no, max(CASE WHEN o.first = 0 THEN 1 ELSE 0 END) = 1 AS known FROM n JOIN o ON o.first < n.incoming_id AND (o.sha = n.sha OR bit_count(xor(o.h, n.h)) <= 2) GROUP BY n.incoming_id""",
}
