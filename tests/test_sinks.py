"""Streams into tables: quarantine over a failed and repeated batch, completion by a timer."""

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from roleloom.streaming import frames as streams


def _source(spark, folder, files, schema):
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_restart_writes_each_row_once(spark, tmp_path, monkeypatch):
    schema = "id int, type string"
    src = _source(spark, str(tmp_path / "in"), [[(1, "clear"), (2, "odd")], [(3, None)], [(4, "get_graph")]], schema)
    problem = F.when(~F.coalesce(F.col("type").isin(streams.MESSAGES), F.lit(False)), "UNKNOWN_TYPE")
    path = str(tmp_path / "out")
    good = streams.landing

    def failing(where, what=None):
        write = good(where, what)

        def once(rows, batch):
            write(rows, batch)
            if batch == 1:
                raise RuntimeError("lost behind the write, before the commit")

        return once

    monkeypatch.setattr(streams, "landing", failing)
    with pytest.raises(StreamingQueryException):
        streams.start_landing(src, path, problem=problem).awaitTermination()
    assert {r.id for r in streams.landed(src, path).collect()} < {1, 2, 3, 4}
    monkeypatch.setattr(streams, "landing", good)
    for _ in range(2):  # goes on with the lost batch; a further start finds nothing new
        streams.start_landing(src, path, problem=problem).awaitTermination()
    got = sorted((r.id, r.kind, r.problem) for r in streams.landed(src, path).collect())
    assert got == [(1, "accepted", None), (2, "quarantine", "UNKNOWN_TYPE"), (3, "quarantine", "UNKNOWN_TYPE"), (4, "accepted", None)]


def test_landed_modes(spark, tmp_path):
    src = _source(spark, str(tmp_path / "in"), [[(1, "a")], [(1, "b"), (2, "c")]], "id int, type string")
    counts = streams.run_once(src.groupBy("id").agg(F.count("*").alias("n")), "complete")
    assert sorted(map(tuple, counts.collect())) == [(1, 2), (2, 1)]
    newest = streams.run_once(src.groupBy("id").agg(F.count("*").alias("n")), "update", keys=["id"])
    assert sorted(map(tuple, newest.collect())) == [(1, 2), (2, 1)]
    none = src.where("false")
    assert streams.run_once(none, "append").count() == 0


def test_stable_documents(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    files = [
        [(1, 0, 2, at(0)), (1, 1, 2, at(1)), (2, 0, 2, at(0)), (3, 0, 1, at(0)), (4, 0, 3, at(0)), (4, 1, 3, at(1)), (None, 0, 1, at(0))],
        [(3, 0, 2, at(4)), (5, 0, 1, at(4)), (4, 2, 3, at(20))],  # 3 gets another total; 4 was two of three, then whole
        [(1, 1, 2, at(60)), (9, 0, 2, at(60))],  # 1 is told already; 9 never is whole
        [(3, 1, 2, at(61)), (9, 0, 2, at(70))],
        [(8, 0, 1, at(200))],
    ]
    want = {(1, 2, 2, at(1)), (3, 2, 2, at(61)), (4, 3, 3, at(20)), (5, 1, 1, at(4))}
    for how, some in (("several", files), ("one", [sum(files, [])])):
        src = _source(spark, str(tmp_path / how), some, "doc_id bigint, chunk int, n_chunks int, at timestamp")
        got = [tuple(r) for r in streams.run_once(streams.stable_documents(src), "append").collect()]
        assert sorted(got) == sorted(want), how
