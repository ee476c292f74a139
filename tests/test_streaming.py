from pyspark.sql import functions as F

from brontide.operators.heal import trust_scores
from brontide.plans import catalogue
from brontide.streaming.replay import flagged_per_day, replay

SCHEMA = "station_id string, variable string, ts timestamp, status string, severity string"


def test_stream_equals_batch_over_several_files(spark, tmp_path):
    r = catalogue._results(spark, "/root/testdata/sf0.001").select("station_id", "variable", "ts", "status", "severity")
    for k, (a, b) in enumerate((("2024-01-01", "2024-01-10"), ("2024-01-10", "2024-01-20"), ("2024-01-20", "2024-03-01"))):
        r.where((F.col("ts") >= a) & (F.col("ts") < b)).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        del k
    got = replay(spark, f"file://{tmp_path}/in", SCHEMA, f"file://{tmp_path}/c", f"file://{tmp_path}/o")
    want = trust_scores(r).select("station_id", "variable", "ts", "trust")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_windowed_counts(spark, tmp_path):
    r = catalogue._results(spark, "/root/testdata/sf0.001").select("station_id", "variable", "ts", "status", "severity")
    r.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    got = {x["day"]: x["flagged"] for x in replay(spark, f"file://{tmp_path}/in", SCHEMA, f"file://{tmp_path}/c", f"file://{tmp_path}/o", flagged_per_day).collect()}
    want = {x["day"]: x["n"] for x in r.where("status in ('SENSOR_FAULT', 'SUSPECT')").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n")).collect()}
    assert got and all(want[d] == n for d, n in got.items())
