import pytest
from pyspark.sql import functions as F

from clustral.sources import files


def test_codebook_round_trip(spark, tmp_path):
    rows = [("a", [1, 2], 3), (None, [70000, 0], 1)]
    (tmp_path / "x.ts").write_bytes(files.format_codebook(rows, training=True, method="made by a test"))
    got = files.read_codebook(spark, str(tmp_path / "x.ts")).orderBy("id").collect()
    assert [(r["name"], list(r["v"]), r["freq"]) for r in got] == rows
    head, _ = files.parse_codebook((tmp_path / "x.ts").read_bytes())
    assert (head["bytes"], head["high"], head["total_freq"], head["method"]) == (3, 70000, 4, "made by a test")
    assert files.kind_of((tmp_path / "x.ts").read_bytes()) == "training"


def test_old_codebook_is_little_endian():
    data = b"VQ CODEBOOK 1.0\n1\n2\n1\n0\n0\n0\n0\n255\nmethod\n---\n" + bytes([7, 9]) + (258).to_bytes(2, "little")
    assert files.parse_codebook(data)[1] == [(None, [7, 9], 258)]
    with pytest.raises(ValueError):
        files.parse_codebook(data[:-1])


def test_write_codebook(spark, tmp_path):
    cb = spark.createDataFrame([(1, [5, 6], 2), (0, [3, 4], 1)], "cid int, c array<bigint>, freq bigint")
    files.write_codebook(cb, str(tmp_path / "c.cb"))
    assert [v for _, v, _ in files.parse_codebook((tmp_path / "c.cb").read_bytes())[1]] == [[3, 4], [5, 6]]


def test_text_skips_comments_and_incomplete_rows(spark, tmp_path):
    (tmp_path / "v.txt").write_text("% head\n\n0 10\n  5 5 \n# no\n1\nx 2\n10 0\n")
    df, low, high = files.read_text(spark, str(tmp_path / "v.txt"), 100)
    assert (low, high) == (0, 10) and [list(r["v"]) for r in df.orderBy("id").collect()] == [[0, 100], [50, 50], [100, 0]]
    about = files.profile(spark, str(tmp_path / "v.txt")).first()
    assert (about["dim"], about["rows"], about["complete"]) == (2, 5, 3)
    files.write_text(df, str(tmp_path / "out"), low, high, 100)
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["0.00 10.00", "10.00 0.00", "5.00 5.00"]


def test_partition_and_graph(spark, tmp_path):
    (tmp_path / "p.pa").write_bytes(files.format_partition([0, 2, 1], 3, ["x", None, "y z"]))
    assert [r["cid"] for r in files.read_partition(spark, str(tmp_path / "p.pa")).orderBy("row").collect()] == [0, 2, 1]
    (tmp_path / "g.txt").write_text("2\n0 2 1 3 1.5 2.5 \n1 1 0 1.5 \n")
    got = files.read_graph(spark, str(tmp_path / "g.txt")).orderBy("src", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 1.5), (0, 3, 2, 2.5), (1, 0, 1, 1.5)]
    files.write_graph(spark.createDataFrame([(4, 5, 1, 2), (4, 6, 2, 3)], "src long, dst long, rank int, dist long"), str(tmp_path / "o"))
    assert spark.read.text(str(tmp_path / "o")).where(F.length("value") > 0).first()["value"] == "4 2 5 6 2.000000 3.000000"


def test_solutions_and_kinds(spark, tmp_path):
    points = spark.createDataFrame([(3, [0, 0], 1), (5, [4, 0], 3), (9, [10, 10], 1)], "id long, v array<bigint>, freq long")
    (tmp_path / "s.pa").write_bytes(files.format_partition([1, 1, 0], 2))
    book, own = files.read_solution(spark, str(tmp_path / "s"), points, 2)
    assert {r["cid"]: (list(r["c"]), r["freq"]) for r in book.collect()} == {0: ([10, 10], 1), 1: ([3, 0], 4)}
    assert {r["id"]: (r["cid"], r["d2"]) for r in own.collect()} == {3: (1, 9), 5: (1, 1), 9: (0, 0)}
    with pytest.raises(ValueError):
        files.read_solution(spark, str(tmp_path / "s"), points, 3)
    with pytest.raises(ValueError):
        files.parse_partition(b"VQ PARTITIONING 2.0\n2\n2\n---\n1\n")
    assert files.read_vectors(spark, files.write_like(book, str(tmp_path / "b.x"), "a.ts")).count() == 2
    with pytest.raises(FileNotFoundError):
        files.find(spark, str(tmp_path / "nothing"))
    with pytest.raises(FileExistsError):
        files.check_inputs(spark, [str(tmp_path / "s.pa")], str(tmp_path / "s.pa"), 3, 2)
    with pytest.raises(ValueError):
        files.check_inputs(spark, [], None, 3, 4)
    assert files.report([9, 5], 2).endswith("1 steps, error 9 to 5") and files.with_method("a", "b") == "a, b"


def test_graph_v1(spark, tmp_path):
    points = spark.createDataFrame([(i, [i, 2 * i]) for i in range(3)], "id long, v array<bigint>")
    edges = spark.createDataFrame([(0, 1, 1, 2), (0, 2, 2, 4), (2, 1, 1, 2)], "src long, dst long, rank int, dist long")
    files.write_graph_v1(points, edges, str(tmp_path / "g"))
    got, near = files.read_graph_v1(spark, str(tmp_path / "g"))
    assert [list(r["v"]) for r in got.orderBy("id").collect()] == [[0, 0], [1, 2], [2, 4]]
    assert sorted(tuple(r) for r in near.collect()) == [(0, 1, 1), (0, 2, 2), (2, 1, 1)]
    files.write_graph_v1(points, edges, str(tmp_path / "simple"), simple=True)
    assert (tmp_path / "simple").read_text() == "1 2\n\n1\n"
