import numpy as np

import __spark_entry__ as entry
from clustral.streaming import assignment


def test_entry_and_registries(spark):
    assert entry.entry(spark).count() == 16
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) > 40


def test_streaming(spark, tmp_path):
    rows = [(i, [i % 7, i % 3], 1) for i in range(40)]
    spark.createDataFrame(rows, "id long, v array<bigint>, freq long").write.parquet(str(tmp_path / "in"))
    cb = spark.createDataFrame([(0, [0, 0], 1), (1, [6, 2], 1)], "cid int, c array<bigint>, freq long")
    stream = spark.readStream.schema("id long, v array<bigint>, freq long").parquet(str(tmp_path / "in"))
    q = assignment.assign_stream(stream, cb).writeStream.format("memory").queryName("assigned").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("assigned").count() == 40
    seen = []
    update = assignment.following(np.array([[0, 0], [6, 2]]), np.array([0, 0]), lambda e, c, n: seen.append((e, c, n)))
    q = stream.writeStream.foreachBatch(update).start()
    q.processAllAvailable()
    q.stop()
    assert sum(seen[-1][2]) == 40
