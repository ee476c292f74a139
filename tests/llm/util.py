"""Small tables in a folder, and a query on them beside its SQL."""

import duckdb
import pandas as pd
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])


def put(spark, folder, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"file://{folder}/{name}.parquet")
    return f"file://{folder}"


def docs_of(spark, texts, lang="en"):
    return spark.createDataFrame([(k, t, lang, "s") for k, t in enumerate(texts)], DOCS)


def as_text(df):
    columns = sorted(df.columns)
    return df[columns].astype(str).replace({"None": "nan", "<NA>": "nan"}).sort_values(columns).reset_index(drop=True)


def both(spark, folder, name, **tables):
    """The query's rows and its SQL's, as sorted text."""
    from brontide.llm import registry

    where = put(spark, folder, **tables)
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    return as_text(registry.QUERIES[name](spark, where).toPandas()), as_text(con.execute(registry.ORACLES[name]).df())


def equal(got: pd.DataFrame, want: pd.DataFrame) -> bool:
    return list(got.columns) == list(want.columns) and got.equals(want)
