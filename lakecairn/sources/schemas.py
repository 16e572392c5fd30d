"""The tables of a dataset, with explicit schemas that are checked at the boundary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

VERSION = 1


#: Column definitions of each table, parsed when a table is checked.
TABLES: dict[str, str] = {
    "files": "file_id long, path string, parent string, name string, kind string, mode int, size long, mtime_ns long, content binary",
    "edges": "parent_id long, name string, child_id long, entry_type int",
    "slices": "file_id long, seq int, file_start long, file_end long, drop_id string, drop_start int, drop_len int",
    "drops": "drop_id string, plain_len long, class string, codec int, enc_len long, slab long, offset long, dict_id int, payload binary",
    "slab_index": "slab_id string, ordinal long, locators array<string>",
    "history": "seq int, op string, ts_ns long, inputs array<string>, params string",
    "changes": "path string, op string, file_id long",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


class SchemaError(ValueError):
    pass


def check(df: DataFrame, name: str, *, version: int = VERSION) -> DataFrame:
    """df with the columns of the table in its order; unknown versions, missing columns and other types are refused."""
    if version != VERSION:
        raise SchemaError(f"{name}: version {version} is not known")
    own = {f.name: f.dataType for f in df.schema}
    for field in schema(name):
        if field.name not in own:
            raise SchemaError(f"{name}: no column {field.name}")
        if own[field.name] != field.dataType:
            raise SchemaError(f"{name}.{field.name}: {own[field.name].simpleString()}, not {field.dataType.simpleString()}")
    return df.select(schema(name).names)


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return check(spark.read.parquet(f"{root}/{name}"), name)
