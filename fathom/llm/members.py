"""Filters by key against a set of any size, through a bitmap of bounded size.

The bitmap has a power of two of bits in words of 64, about eight for each member and MOST_BITS at most, so what is
broadcast has a bound whatever the data. It only saves moving rows that cannot match; a join on the key itself decides
about the others, so a set too large for the bitmap costs time and nothing else.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26


def _column(name: str) -> Column:
    """A column by its name, whatever the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def _fresh(rows: DataFrame, name: str) -> str:
    """A column name that rows do not have."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name = f"{name}_{uuid.uuid4().hex[:8]}"
    return name


def bits_for(members: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (8 * members).bit_length()))


def _flagged(rows: DataFrame, key: Column, kind: DataType, members: DataFrame, member: str) -> tuple[DataFrame, str]:
    """rows with a column more, and its name: false if the key is surely not among the members."""
    bits = bits_for(members.count())

    def bit(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(bits))

    def mask(c: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), bit(c).bitwiseAND(F.lit(63)).cast("int"))

    own = _column(member).cast(kind)
    word, held, maybe = (_fresh(rows, n) for n in ("_word", "_mask", "_maybe"))
    words = members.select(F.shiftright(bit(own), 6).alias(word), mask(own).alias(held))
    words = F.broadcast(words.groupBy(word).agg(F.bit_or(held).alias(held)))  # at most MOST_BITS / 64 rows
    found = rows.withColumn(word, F.shiftright(bit(key), 6)).join(words, word, "left")
    return found.withColumn(maybe, F.coalesce(F.col(held).bitwiseAND(mask(key)), F.lit(0)) != 0).drop(word, held), maybe


def maybe_members(rows: DataFrame, key: str, members: DataFrame, member: str) -> DataFrame:
    """rows with _maybe: false if the key is surely not among the members. rows must not have such a column."""
    found, maybe = _flagged(rows, _column(key), rows.schema[key].dataType, members, member)
    return found.withColumnRenamed(maybe, "_maybe")


def may_match(rows: DataFrame, key: str, members: DataFrame, member: str) -> DataFrame:
    """The rows whose key is among the members, and few others."""
    found, maybe = _flagged(rows, _column(key), rows.schema[key].dataType, members, member)
    return found.where(F.col(maybe)).drop(maybe)


def without(rows: DataFrame, key: str | Column, members: DataFrame, member: str) -> DataFrame:
    """The rows whose key (a column's name, or an expression) is not among the members; rows with a null key stay. Only
    rows in doubt are shuffled. Columns of rows may have any names."""
    key = _column(key) if isinstance(key, str) else key
    kind = rows.select(key).schema[0].dataType
    found, maybe = _flagged(rows, key, kind, members, member)
    gone = _fresh(rows, "_gone")
    keys = members.select(_column(member).cast(kind).alias(gone)).distinct()
    doubt = found.where(F.col(maybe)).drop(maybe)
    doubt = doubt.join(keys, key == F.col(gone), "left_anti")
    return found.where(~F.col(maybe)).drop(maybe).unionByName(doubt).select(*(_column(c) for c in rows.columns))
