"""Small settings kept beside a model, on whatever file system that is."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def write_json(spark: SparkSession, path: str, value) -> None:
    text = json.dumps(value, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").parquet(path)


def read_json(spark: SparkSession, path: str):
    return json.loads(spark.read.parquet(path).first()["value"])
