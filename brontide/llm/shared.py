"""Tables that a job writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from brontide.sources.folders import shared_folder


def written(df: DataFrame) -> DataFrame:
    """df as a written table, read again: later reads neither compute it anew nor need the executors that made it."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_rows(docs: DataFrame) -> DataFrame:
    """doc_id: each row of docs as a struct, whatever its columns are called; text: its text. For operators that carry doc_id along."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id"), "text")


def keyed(docs: DataFrame, rest: str) -> StructType:
    """The schema of doc_id, as docs has it, and the columns of ``rest``."""
    return StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *StructType.fromDDL(rest).fields])
