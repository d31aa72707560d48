"""A stream stopped and started again goes on where it ended: no row is lost or read twice."""

import datetime as dt

from rolloutlake.streaming import state


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    source, sink, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    schema = "t timestamp, g string, score double"

    def deliver(hour, scores):
        rows = [(dt.datetime(2026, 1, 1, hour, k), "a", float(x)) for k, x in enumerate(scores)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stats = state.stream_group_stats(spark.readStream.schema(schema).parquet(source), "t", "g", "score")
        query = stats.selectExpr("window.start AS start", "g", "n", "mean").writeStream.format("parquet").option("path", sink).option("checkpointLocation", marks).trigger(availableNow=True).start()
        query.awaitTermination(120)

    deliver(0, [1, 2, 3])
    run()
    deliver(0, [6])
    deliver(3, [9])
    run()
    deliver(8, [1])
    run()
    got = {(r.start.hour, r.n, r.mean) for r in spark.read.parquet(sink).collect()}
    assert got == {(0, 4, 3.0), (3, 1, 9.0)}
