"""Sessions and sliding windows as streams, in several batches with late rows."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from fathom.streaming.incremental import session_counts, windowed_counts

SCHEMA = "ts timestamp, who int"
AT = datetime(2024, 1, 1)


def minutes(*rows):
    return [(AT + timedelta(minutes=m), who) for m, who in rows]


#: The third batch brings a row that is late but within the watermark, and one that is too late; the last one closes all.
BATCHES = [minutes((0, 1), (20, 1), (3, 2)), minutes((60, 1), (200, 2)), minutes((195, 1), (5, 2), (210, 1)), minutes((10_000, 9)), minutes((20_000, 9))]
ON_TIME = [r for b in BATCHES for r in b if r != minutes((5, 2))[0]]


def streamed(spark, tmp_path, name, plan):
    arrivals = f"file://{tmp_path}/{name}"
    for i, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(arrivals)
        plan(spark.readStream.schema(SCHEMA).parquet(arrivals)).writeStream.format("parquet").option("path", f"{arrivals}-out").option("checkpointLocation", f"{arrivals}-check").trigger(availableNow=True).start().awaitTermination()
    return sorted(map(tuple, spark.read.parquet(f"{arrivals}-out").where("who <> 9").collect()))


def whole(spark, plan):
    return sorted(map(tuple, plan(spark.createDataFrame(ON_TIME, SCHEMA)).where(F.col("who") != 9).collect()))


def test_sessions_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    plan = lambda events: session_counts(events, "ts", "30 minutes", "1 hour", "who")
    got = streamed(spark, tmp_path, "sessions", plan)
    assert got == whole(spark, plan)
    assert [(w, n) for *_, w, n in got] == [(1, 2), (2, 1), (1, 1), (1, 2), (2, 1)]


def test_sliding_windows_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    plan = lambda events: windowed_counts(events, "ts", "1 hour", "1 hour", "who", slide="30 minutes")
    assert streamed(spark, tmp_path, "sliding", plan) == whole(spark, plan) != []
