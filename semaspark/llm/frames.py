"""What the operators share: staged tables, free column names, joins that split hot keys."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semaspark.session import staging_path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the folder that all executors share and read it back: what follows neither
    computes it again nor depends on the executors that made it."""
    path = staging_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores in front of it until no column has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table. Python workers of this machine find this package where the driver found it, whatever their folder."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (env.get("PYTHONPATH"), root)))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salted_join(rows: DataFrame, side: DataFrame, on: str, spread: Column, how: str = "left", salts: int = 16) -> DataFrame:
    """Equal values of ``on`` join, null with null. A hot key of ``rows`` is dealt over ``salts`` parts by
    ``spread``; ``side``, with one narrow row per key, is repeated once a salt. No size decides the plan here:
    Spark sends ``side`` to all executors by itself where its threshold allows it."""
    salt, key, has = free_name(rows, "salt"), free_name(rows, "join_key"), free_name(rows, "join_null")
    left = rows.withColumns({salt: F.pmod(F.xxhash64(spread), F.lit(salts)), has: F.col(on).isNull()})
    right = side.withColumns({has: F.col(on).isNull(), salt: F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>"))}).withColumnRenamed(on, key)
    kind = rows.schema[on].dataType.simpleString()
    empty = F.lit("" if kind == "string" else 0).cast(kind)
    same = (F.coalesce(left[on], empty) == F.coalesce(right[key], empty)) & (left[has] == right[has]) & (left[salt] == right[salt])
    return left.join(right, same, how).drop(left[salt], left[has]).drop(right[salt], right[has]).drop(right[key])
