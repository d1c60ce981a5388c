"""Column builders for names, tokens, identity numbers and dates. All stay in the JVM; ASCII digits only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocab import ALPHABET

_OUTER = r"^[\s  -   　]+|[\s  -   　]+$"


def strip(c: Column) -> Column:
    """Outer white space of any kind off."""
    return F.regexp_replace(c, _OUTER, "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def extension_of(path: Column) -> Column:
    """Lower-case suffix of the file name, ``<none>`` without one; a leading dot begins no suffix."""
    ext = F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))
    return F.when(ext == "", "<none>").otherwise(ext)


def stem_of(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def source_stem(stem: Column) -> Column:
    """The name before an export suffix; null if there is none."""
    s = F.regexp_extract(stem, r"^(.+)\.rf\.[0-9a-fA-F]{32}$", 1)
    return F.when(s != "", s)


def redact_token(t: Column) -> Column:
    """Whole numbers of up to three digits and decimals stay; else letters become X or x and digits #."""
    masked = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\p{Lu}", "X"), r"(?!X)\p{L}", "x"), r"\p{Nd}", "#")
    # fixed value: the pattern of tokens that stay
    return F.when(t.rlike(r"^-?(\d{1,3}|\d*\.\d+(e-?\d+)?)$"), t).otherwise(masked)


def ellipsize(t: Column, most: int) -> Column:
    """At most ``most`` characters, the middle replaced by an ellipsis."""
    half = (most - 1) // 2
    short = F.concat(F.left(t, F.lit(half)), F.lit("…"), F.right(t, F.lit(most - half - 1)))
    return F.when(F.length(t) <= most, t).otherwise(short)


def hash_bucket(key: Column, buckets: int = 1000) -> Column:
    """Stable bucket: the first eight hex digits of SHA-256, modulo ``buckets``."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def hash_split(name: Column) -> Column:
    """80/10/10 by the bucket of the upper-case stripped name."""
    b = hash_bucket(F.upper(strip(name)))
    return F.when(b < 800, "train").when(b < 900, "valid").when(b >= 900, "test")


def sample_id(document: Column, line: Column, field: Column) -> Column:
    return F.concat(F.lit("rc-"), F.substring(F.sha2(F.concat_ws("|", document, line.cast("string"), field), 256), 1, 12))


def reference_problem(t: Column) -> Column:
    """Why a reference text can't be taken, null if it can: empty, outer white space, line breaks or tabs, a
    leading colon; the first that applies."""
    return F.when(t == "", "empty").when(t != strip(t), "outer_whitespace").when(t.rlike(r"[\r\n\t]"), "control_character").when(t.startswith(":"), "leading_colon")


def _digit(c: Column, i: Column | int) -> Column:
    return F.substring(c, i, 1).cast("int") if isinstance(i, int) else F.substr(c, i, F.lit(1)).cast("int")


def _dihedral() -> tuple[list[int], list[int]]:
    """Multiplication of the dihedral group of order ten and the powers of the position permutation, both flat."""
    mul = [(a + b) % 5 if a < 5 and b < 5 else 5 + (a + b) % 5 if a < 5 else 5 + (a - b) % 5 if b < 5 else (a - b) % 5 for a in range(10) for b in range(10)]
    # fixed value: the position permutation
    step, rows = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4], [list(range(10))]
    for _ in range(7):
        rows.append([step[x] for x in rows[-1]])
    return mul, [x for r in rows for x in r]


def _checksum(digits: Column, offset: int) -> Column:
    mul, perm = (F.array(*map(F.lit, x)) for x in _dihedral())
    positions = F.sequence(F.lit(0), F.length(digits) - 1)
    n = F.length(digits)
    step = lambda acc, i: F.get(mul, acc * 10 + F.get(perm, ((i + offset) % 8) * 10 + _digit(digits, n - i)))
    return F.aggregate(positions, F.lit(0), step)


def verhoeff_valid(number: Column) -> Column:
    """Whether the last digit checks; false for anything but ASCII digits."""
    return F.when(number.rlike(r"\A[0-9]+\z"), _checksum(number, 0) == 0).otherwise(F.lit(False))


def verhoeff_digit(number: Column) -> Column:
    """The check digit to append; null for anything but ASCII digits."""
    # fixed value: the inverse of each element of the group
    inverse = F.array(*map(F.lit, [0, 4, 3, 2, 1, 5, 6, 7, 8, 9]))
    return F.when(number.rlike(r"\A[0-9]+\z"), F.get(inverse, _checksum(number, 1)))


def card_number_problem(v: Column) -> Column:
    s = strip(v)
    d = F.regexp_replace(s, r"\s", "")
    return (
        F.when(v.isNull() | (s == ""), "missing_field")
        .when(~s.rlike(r"\A(\d{12}|\d{4} \d{4} \d{4})\z"), "invalid_aadhaar_format")
        .when(~verhoeff_valid(d), "aadhaar_checksum_mismatch")
    )


def account_number_problem(v: Column) -> Column:
    s = F.upper(strip(v))
    return F.when(v.isNull() | (s == ""), "missing_field").when(~s.rlike(r"\A[A-Z]{3}P[A-Z]\d{4}[A-Z]\z"), "invalid_pan_format")


def birth_date_problem(v: Column, today: Column) -> Column:
    s = strip(v)
    day = F.try_to_date(s, "dd/MM/yyyy")
    return (
        F.when(v.isNull() | (s == ""), "missing_field")
        .when(~s.rlike(r"\A\d{2}/\d{2}/\d{4}\z"), "invalid_date_format")
        .when(day.isNull() | (F.year(day) < 1), "invalid_date")
        .when(day > today, "future_date")
    )


def encode_text(t: Column, alphabet: str = ALPHABET) -> Column:
    """Ids of the characters, from 1; null if the text is empty or has a character outside the alphabet."""
    ids = F.transform(F.split(t, ""), lambda c: F.instr(F.lit(alphabet), c))
    return F.when((t != "") & ~F.exists(ids, lambda i: i == 0), ids)


def decode_ids(ids: Column, alphabet: str = ALPHABET) -> Column:
    return F.array_join(F.transform(F.filter(ids, lambda i: i > 0), lambda i: F.substr(F.lit(alphabet), i, F.lit(1))), "")


def ctc_collapse(ids: Column) -> Column:
    """Repeats merged, then blanks (0) dropped; a blank between keeps equal neighbours apart."""
    kept = F.transform(ids, lambda v, i: F.when((i == 0) | (v != F.get(ids, i - 1)), v).otherwise(F.lit(0)))
    return F.filter(kept, lambda v: v != 0)




def clean_result(text: Column, confidence: Column) -> Column:
    """A recogniser's result with outer white space off; a blank text has confidence 0."""
    s = strip(text)
    return F.struct(s.alias("text"), F.when(F.coalesce(s, F.lit("")) == "", 0.0).otherwise(confidence).alias("confidence"))


def greedy_path(steps: Column) -> Column:
    """Ids of the best class of each step (the first of equals), collapsed; ``steps`` is an array of arrays of log
    probabilities, class 0 the blank."""
    return ctc_collapse(F.transform(steps, lambda p: (F.array_position(p, F.array_max(p)) - 1).cast("int")))


def path_confidence(steps: Column) -> Column:
    """Geometric mean of the best probabilities of the steps; 0 if the path decodes to nothing."""
    total = F.aggregate(steps, F.lit(0.0), lambda a, p: a + F.array_max(p))
    return F.when(F.size(greedy_path(steps)) > 0, F.exp(total / F.size(steps))).otherwise(0.0)


def merged_region(region: Column, result: Column) -> Column:
    """One struct of a region and its reading: both confidences by name, the reading's as ``confidence``."""
    return F.struct(region["class_id"].alias("class_id"), region["class_name"].alias("class_name"), result["text"].alias("text"), result["confidence"].alias("confidence"), region["confidence"].alias("detection_confidence"), result["confidence"].alias("recognition_confidence"))
