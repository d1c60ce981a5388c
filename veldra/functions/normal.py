"""Readings of values that are written in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What stands in for a missing name, letters and digits only, lower case.
STAND_INS = [
    "", "na", "none", "null", "nil", "nan", "unknown", "untitled", "unnamed", "undefined", "unspecified",
    "unassigned", "notavailable", "notapplicable", "missing", "tbd", "todo", "default", "blank", "empty", "misc", "other",
]
# Words for the three splits, letters only, lower case.
TRAIN_WORDS = ["train", "training", "trn", "trainset", "trainfolder", "devtrain", "tr"]
VALID_WORDS = ["valid", "validation", "val", "validate", "validset", "dev", "devvalid", "devval", "development", "vld"]
TEST_WORDS = ["test", "testing", "tst", "testset", "te", "holdout"]
#: Export suffix of a stem.
EXPORT_SUFFIX = r"\.rf\.[0-9a-f]{32}$"


def name_key(name: Column) -> Column:
    """Key of a source or group name: letter case, separators and an export suffix aside. Null for null and
    stand-ins, which name nothing."""
    low = F.regexp_replace(F.lower(name), r"^\s+|\s+$", "")
    key = F.regexp_replace(F.regexp_replace(low, EXPORT_SUFFIX, ""), r"[^\p{L}\p{M}\p{N}]+", "")
    return F.when(~key.isin(STAND_INS), key)


def split_name(raw: Column) -> Column:
    """``raw_split`` read as train, valid or test; null if it names none."""
    word = F.regexp_replace(F.lower(raw), r"[^\p{L}]+", "")
    return F.when(word.isin(TRAIN_WORDS), "train").when(word.isin(VALID_WORDS), "valid").when(word.isin(TEST_WORDS), "test")


def sha_key(sha: Column) -> Column:
    """A sha256 as 64 lower-case hex digits, however written; null if it isn't one."""
    hexes = F.regexp_replace(F.regexp_replace(F.lower(sha), r"^\s*sha-?256\s*[:=\-]?\s*", ""), r"[^0-9a-z]+", "")
    return F.when(hexes.rlike(r"^[0-9a-f]{64}$"), hexes)


def dhash_key(dhash: Column) -> Column:
    """A dhash that says something: null and 0 (flat image) don't."""
    return F.when(dhash != 0, dhash)


def place_key(path: Column) -> Column:
    """The place that a path names: slashes, ``.``, ``..``, repeated and outer separators and outer blanks aside.
    Letter case matters. A part that climbs above the root is left out, so ``../a`` is ``a``. A null path names no place."""
    parts = F.split(F.regexp_replace(F.regexp_replace(path, r"^\s+|\s+$", ""), r"[\\/]+", "/"), "/")
    kept = F.filter(parts, lambda p: (F.trim(p) != "") & (F.trim(p) != "."))
    walked = F.aggregate(
        kept,
        F.array().cast("array<string>"),
        lambda acc, p: F.when((p == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(p == "..", acc).otherwise(F.concat(acc, F.array(F.trim(p)))),
    )
    return F.array_join(walked, "/")
