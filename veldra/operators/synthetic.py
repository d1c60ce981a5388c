"""Synthetic field texts from hashes of (seed, record): any record can be made anywhere, in any order, again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import hash_split


#: Names of a kind that are put into the plan.
MOST_WORDS = 10_000


def draw(seed: int, what: str, key: Column, n: int) -> Column:
    """A number below ``n`` that depends on seed, purpose and key alone."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), key), F.lit(n)).cast("int")


def _letter(seed: int, what: str, key: Column) -> Column:
    return F.char(draw(seed, what, key, 26) + 65)


def _digits(seed: int, what: str, key: Column, n: int) -> Column:
    return F.lpad(draw(seed, what, key, 10**n).cast("string"), n, "0")


def cased(text: Column, how: Column) -> Column:
    return F.when(how == 0, F.upper(text)).when(how == 1, F.lower(text)).otherwise(F.initcap(text))


def records(spark: SparkSession, n: int, given: list[str], surnames: list[str], seed: int = 42) -> DataFrame:
    """``n`` identities with texts of all fields; a record's numbers belong to its own surname, and all records of one
    full name are in one split. The card numbers carry no valid check digit on purpose."""
    if max(len(given), len(surnames)) > MOST_WORDS:
        raise ValueError(f"names go into the plan, so there may be {MOST_WORDS} of a kind at most")
    k = F.col("id")
    pick = lambda words, what: F.get(F.array(*map(F.lit, words)), draw(seed, what, k, len(words)))
    r = spark.range(n).select("id", pick(given, "given").alias("given"), pick(surnames, "surname").alias("surname"), pick(given, "father").alias("father"))
    full = F.concat_ws(" ", "given", "surname")
    day = F.date_add(F.to_date(F.lit("1950-01-01")), draw(seed, "day", k, 21_184))
    card = F.concat_ws(" ", F.concat((draw(seed, "first", k, 8) + 2).cast("string"), _digits(seed, "a", k, 3)), _digits(seed, "b", k, 4), _digits(seed, "c", k, 4))
    account = F.concat(*[_letter(seed, f"l{i}", k) for i in range(3)], F.lit("P"), F.upper(F.substring("surname", 1, 1)), _digits(seed, "d", k, 4), _letter(seed, "z", k))
    return r.select(
        "id", hash_split(full).alias("split"), cased(full, draw(seed, "case", k, 3)).alias("name"), F.concat_ws(" ", "father", "surname").alias("fathers_name"), F.date_format(day, "dd/MM/yyyy").alias("date_of_birth"),
        F.get(F.array(F.lit("MALE"), F.lit("FEMALE")), draw(seed, "gender", k, 2)).alias("gender"), card.alias("aadhaar_number"), account.alias("pan_number"),
    )


def samples(people: DataFrame, fields: list[str]) -> DataFrame:
    """One row per record and field."""
    return people.select("id", "split", F.explode(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*fields))).alias("field_name", "text"))
