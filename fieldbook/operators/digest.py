"""A digest of a whole table that does not depend on the order of its rows: sums of the rows' digests.

A row is written out with the name, type and length of every field, so no two different rows are written alike; its
SHA-256 is cut into lanes, and each lane is added up over all rows.  Sums are combined where the rows lie, and digests of
parts of a table add up to that of the whole.  A changed cell, a moved separator, a doubled or a missing row change it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

#: Lanes of six hexadecimal digits each; sums of 24 bits fit into 64 for half a trillion rows.
LANES, WIDTH = 10, 6


def _sized(tag: str, text: Column) -> Column:
    return F.concat(F.lit(tag), F.length(text).cast("string"), F.lit(":"), text)


def written(value: Column, kind: T.DataType) -> Column:
    """A value as text that tells its type and length; null is N.  Doubles are written in hexadecimal, to the last bit."""
    if isinstance(kind, T.ArrayType):
        said = F.concat(F.lit("A"), F.size(value).cast("string"), F.lit(":"), F.array_join(F.transform(value, lambda x: written(x, kind.elementType)), ""))
    elif isinstance(kind, T.StructType):
        said = F.concat(F.lit("R"), *[written(value[f.name], f.dataType) for f in kind.fields])
    elif isinstance(kind, T.MapType):
        pairs = F.array_sort(F.transform(F.map_entries(value), lambda e: F.concat(written(e["key"], kind.keyType), written(e["value"], kind.valueType))))
        said = F.concat(F.lit("P"), F.size(value).cast("string"), F.lit(":"), F.array_join(pairs, ""))
    elif isinstance(kind, T.StringType | T.CharType | T.VarcharType):
        said = _sized("S", value)
    elif isinstance(kind, T.FloatType | T.DoubleType):
        said = _sized("D", F.format_string("%a", value.cast("double")))
    elif isinstance(kind, T.TimestampNTZType):
        said = _sized("T", F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), value).cast("string"))
    elif isinstance(kind, T.TimestampType):
        said = _sized("T", F.unix_micros(value).cast("string"))
    elif isinstance(kind, T.BinaryType):
        said = _sized("X", F.hex(value))
    else:
        tag = {T.BooleanType: "B", T.DateType: "d", T.DecimalType: "M"}.get(type(kind), "I")
        said = _sized(tag, value.cast("string"))
    return F.coalesce(said, F.lit("N"))


def lanes(rows: DataFrame) -> DataFrame:
    """One row: n, and the sums l0 ... of the lanes over all rows and columns."""
    cells = [_sized("", F.concat(F.lit(f"{f.name}="), written(F.col(f"`{f.name}`"), f.dataType))) for f in sorted(rows.schema.fields, key=lambda f: f.name)]
    hashed = rows.select(F.sha2(F.concat(*cells) if cells else F.lit(""), 256).alias("h"))
    lane = lambda i: F.conv(F.substr("h", F.lit(1 + WIDTH * i), F.lit(WIDTH)), 16, 10).cast("long")
    return hashed.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(lane(i)), F.lit(0).cast("long")).alias(f"l{i}") for i in range(LANES)])


def digest(rows: DataFrame) -> DataFrame:
    """One row: n and the table's digest."""
    return lanes(rows).select("n", F.sha2(F.concat_ws(",", *[F.col(f"l{i}").cast("string") for i in range(LANES)]), 256).alias("digest"))
