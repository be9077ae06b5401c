"""Outputs of repeated job runs that become visible together: results, processed marks and metrics of one run, or none of them.

A run writes each output below its own run id and, as the last step, one small file that lists the run. Readers take the rows of listed
runs only. So a run that fails anywhere leaves nothing to be seen, and repeating it does its work again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN = T.StructField("run", T.StringType())
_LISTED = T.StructType([RUN, T.StructField("committed_at", T.TimestampType())])


def commit_run(outputs: dict[str, DataFrame], root: str) -> str:
    """Write all outputs of one run and list the run; returns its id."""
    run = uuid.uuid4().hex
    for name, df in outputs.items():
        df.write.parquet(f"{root}/{name}/run={run}")
    spark = next(iter(outputs.values())).sparkSession
    listed = spark.createDataFrame([(run,)], T.StructType([RUN])).withColumn("committed_at", F.current_timestamp())
    listed.coalesce(1).write.mode("append").parquet(f"{root}/runs")
    return run


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def read_committed(spark: SparkSession, root: str, output: str, schema: T.StructType) -> DataFrame:
    """The rows of an output of all listed runs, with their ``run``; empty before the first run."""
    whole = T.StructType([*schema.fields, RUN])
    if not (_exists(spark, f"{root}/runs") and _exists(spark, f"{root}/{output}")):
        return spark.createDataFrame([], whole)
    runs = spark.read.schema(_LISTED).parquet(f"{root}/runs").select("run").distinct()
    return spark.read.schema(whole).option("basePath", f"{root}/{output}").parquet(f"{root}/{output}").join(runs, "run", "left_semi").select(*whole.names)
