import pytest
from protean.operators import trajectory
from protean.streaming import frames as stream


@pytest.fixture(scope="module")
def events(spark):
    return "/root/testdata/sf0.001/events.parquet"


def _source(spark, path, tmp_path):
    d = spark.read.parquet(path).selectExpr("user_id as series", "event_id as frame", "value", "ts", "event_type")
    d.repartition(3).write.parquet(str(tmp_path / "in"))
    return d, spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def _run(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_running_fluctuation_is_the_batch_one(spark, events, tmp_path):
    d, s = _source(spark, events, tmp_path)
    got = {r.series: r.rmsf for r in _run(stream.running_fluctuation(s), "rmsf", "complete").collect()}
    want = {r.series: r.rmsf for r in trajectory.fluctuation(d).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_windows(spark, events, tmp_path):
    d, s = _source(spark, events, tmp_path)
    got = _run(stream.tumbling(s, "1 day", "60 days"), "days", "update")
    assert got.count() > 0
    assert _run(stream.sliding(s, "2 days", "1 day", "60 days"), "slides", "update").count() > got.count()
    assert _run(stream.sessions(s, "1 hour", "1 day"), "sess", "append").where("n < 1").count() == 0
