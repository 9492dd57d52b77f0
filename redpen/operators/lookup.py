"""Entries of array columns looked up in dimension tables of any size.

A table whose bytes are counted and few travels to the tasks. A larger one stays where it is: the distinct entries of
the rows are joined with it, what was found goes back to the rows by a hash of their array, and a filter of fixed size spares
most entries that are not in it. Both ways give the same rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Row, functions as F

from redpen.functions.kernels import found_udf, look_up_udf
from redpen.session import stage

TRAVEL_BYTES = 64 << 20  # of a table that travels to the tasks
ROW_BYTES = 64  # counted for a row besides its texts
HEAVY = 1 << 16  # rows that meet one row of a join from which on that row is broadcast; there are at most rows / HEAVY of them
FILTER_BITS = 1 << 26


def travelling(table: DataFrame) -> list[Row] | None:
    """The rows of a table of at most TRAVEL_BYTES, None for a larger one. Bytes are counted before any row moves."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in table.dtypes if kind == "string"]
    size = table.agg(F.coalesce(F.sum(sum(texts, F.lit(ROW_BYTES)).cast("long")), F.lit(0))).first()[0]
    return table.collect() if size <= TRAVEL_BYTES else None


def weighted_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """Join with unique rows of ``right`` that know how many rows of ``left`` they meet.

    Those that meet HEAVY rows or more are broadcast, so no shuffled key is larger than that.
    """
    heavy, light = right.filter(F.col(weight) >= HEAVY).drop(weight), right.filter(F.col(weight) < HEAVY).drop(weight)
    of_heavy = left.join(F.broadcast(heavy), keys)
    return of_heavy.unionByName(left.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys, how))


def with_found(df: DataFrame, array: str, table: DataFrame, key: str, value: str) -> DataFrame:
    """Add ``found_keys, found_values``: the distinct entries of ``array`` that are keys of ``table``, with their values.

    Rows are told apart by a 128-bit hash of the array, so equal arrays are looked up once. ``table`` has unique keys.
    """
    hashed = stage(df.withColumns({"_h": F.xxhash64(array), "_g": F.xxhash64(F.lit(1), array)}), "looking-up")
    rows = ["_h", "_g"]
    entries = hashed.select(*rows, F.explode(F.array_distinct(array)).alias("_entry")).distinct()
    entries = stage(entries.filter("_entry is not null"), "entries")
    asked = entries.groupBy("_entry").agg(F.count(F.lit(1)).alias("_meets"))
    values = asked.join(table.select(F.col(key).alias("_entry"), F.col(value).alias("_value")), "_entry")
    found = weighted_join(entries, values, ["_entry"], "_meets")
    pairs = found.groupBy(*rows).agg(F.collect_list(F.struct("_entry", "_value")).alias("_pairs"))  # entries of one array
    counted = hashed.groupBy(*rows).agg(F.count(F.lit(1)).alias("_meets"))
    joined = weighted_join(hashed, counted.join(pairs, rows, "left"), rows, "_meets")
    empty = F.coalesce("_pairs", F.array().cast(pairs.schema["_pairs"].dataType))
    return joined.withColumns({"found_keys": F.transform(empty, lambda x: x["_entry"]), "found_values": F.transform(empty, lambda x: x["_value"])}).drop("_pairs", *rows)


class Lookup:
    """``key -> value`` of a table with unique keys, for array columns. An unknown entry is ``default``, or an error if that is None."""

    def __init__(self, table: DataFrame, key: str, value: str, default=None):
        self.table, self.key, self.value, self.default = table.select(key, value), key, value, default
        kinds = dict(self.table.dtypes)
        self.kind = kinds[value]
        rows = travelling(self.table)
        held = None if rows is None else table.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in rows})
        self.held = held
        self.rows = None if rows is None else held.value
        self._udf = None if rows is None else look_up_udf(held, self.kind, default)

    @classmethod
    def joined(cls, table: DataFrame, key: str, value: str) -> Lookup:
        """A look-up that never travels, for tables made from the rows themselves."""
        made = cls.__new__(cls)
        made.table, made.key, made.value, made.default, made.held, made.rows, made._udf = table.select(key, value), key, value, None, None, None, None
        made.kind = dict(table.dtypes)[value]
        return made

    def add(self, df: DataFrame, out: str, array: Column) -> DataFrame:
        """Add ``out``, the values of the entries of ``array``."""
        if self._udf is not None:
            return df.withColumn(out, self._udf(array))
        found = with_found(df.withColumn("_asked", array), "_asked", self.table, self.key, self.value)
        return found.withColumn(out, found_udf(self.kind, self.default)("_asked", "found_keys", "found_values")).drop("_asked", "found_keys", "found_values")


def key_filter(table: DataFrame, key: str) -> np.ndarray:
    """A bitmap of the CRCs of all keys, FILTER_BITS long whatever the table: a key whose bit is missing is not in the table."""
    place = F.crc32(F.col(key)).bitwiseAND(F.lit(FILTER_BITS - 1))
    bits = table.select(F.shiftright(place, 6).alias("word"), F.expr("1L").alias("one"), place.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    words = bits.groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("bits")).toArrow()  # at most FILTER_BITS / 64 rows
    bitmap = np.zeros(FILTER_BITS // 64, np.uint64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return bitmap
