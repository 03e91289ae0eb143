"""Shared helpers of the training-data operators.

Words are maximal runs of characters other than space and U+0009 to U+000D, which is
what ``bytes.split()`` yields on UTF-8, so texts are handed to Python as binary. Spark
bounds what it hands over at once by rows and by bytes (64 MB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import checkpoint, delete, fresh_path, shared_dir

__all__ = ["CRC_TABLE_SQL", "SPACE", "checkpoint", "crc_sql", "delete", "fresh_name", "fresh_path", "partitions", "read_table", "shared_dir", "text_bytes"]

#: Java and DuckDB pattern of the white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of df has it, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(name: str = "text") -> Column:
    """The column as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: DuckDB: the table of CRC-32 by bytes, for a relation crc(t).
CRC_TABLE_SQL = "SELECT list_transform(range(256), lambda x: list_reduce([x::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))) AS t"


def crc_sql(text: str) -> str:
    """DuckDB: the unsigned CRC-32 of an ASCII text, where t is the table's column."""
    return f"xor(4294967295, list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split({text}, ''), lambda x: ascii(x)::UBIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])))"
