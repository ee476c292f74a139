"""The folder for tables that a job writes on its way."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders made for applications that name none, by application.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder of the application in spark.checkpoint.dir, which driver and executors share; where that is unset, a
    temporary folder in local mode only, where all tasks see it."""
    app = spark.sparkContext.applicationId
    folder = spark.conf.get("spark.checkpoint.dir", None) or _own.get(app)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{folder}/{app}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read again: the plans of a loop stay short, and no executor's loss undoes it."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
