"""Files in and out, and the stream of writes."""

from pyspark.sql import functions as F

from chronoweave.model import NOW
from chronoweave.sources import files
from chronoweave.streaming import append


def test_interval_and_point_tables(spark, tmp_path):
    (tmp_path / "iv.csv").write_text("st,et,entity,a,b\n1,5,7,1.5,2\n6,2147483647,7,,3\n")
    found = files.read_intervals(spark, str(tmp_path / "iv.csv"), "st INT, et INT, entity BIGINT, a DOUBLE, b INT")
    assert sorted(map(tuple, found.collect()), key=repr) == [("a", 7, 1, 5, 1.5), ("a", 7, 6, NOW, None), ("b", 7, 1, 5, 2.0), ("b", 7, 6, NOW, 3.0)]
    (tmp_path / "p.csv").write_text("t,entity,a\n3,1,x\n")
    assert tuple(files.read_points(spark, str(tmp_path / "p.csv"), "t INT, entity BIGINT, a STRING").first()) == ("a", 1, 3, "x")


def test_traffic_lines(spark, tmp_path):
    (tmp_path / "t.txt").write_text("05270005 595640_00033 1 1 18\nnot a line\n")
    rows = files.read_traffic(spark, str(tmp_path / "t.txt"), 2010).collect()
    assert [(r.road, r.jam_status, r.segment_count, r.travel_time) for r in rows] == [("595640_00033", 1, 1, 18)]


def test_load_csv_as_maps_and_lists_with_line_numbers(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a;b\n1;2\n3;4\n")
    assert files.load_csv(spark, str(tmp_path / "x.csv"), delimiter=";").first()["row"] == {"a": "1", "b": "2"}
    rows = files.with_line_numbers(files.load_csv(spark, str(tmp_path / "x.csv"), headers=False, delimiter=";")).orderBy("linenumber").collect()
    assert [(r.linenumber, r.row) for r in rows] == [(1, ["a", "b"]), (2, ["1", "2"]), (3, ["3", "4"])]
    assert [r.n for r in files.with_line_numbers(spark.range(0, 10, 1, 3), "n").orderBy("id").collect()] == list(range(1, 11))


def test_graph_and_temporal_round_trip(spark, tmp_path, sf_dir):
    from chronoweave.model import from_tables

    g = from_tables(spark, sf_dir)
    files.write_graph(g.nodes, g.rels, f"{tmp_path}/g")
    assert spark.read.parquet(f"{tmp_path}/g/rels").where("type = 'PLACED'").count() == g.rels.where("type = 'PLACED'").count()
    tp = spark.createDataFrame([("a", 1, 0, 5, 1.0)], "prop string, entity long, st long, et long, value double")
    files.write_temporal(tp, f"{tmp_path}/tp")
    assert spark.read.parquet(f"{tmp_path}/tp").where("prop = 'a'").count() == 1


def test_stream_of_writes_keeps_the_newest_of_a_time(spark, tmp_path):
    inbox, store, check = (str(tmp_path / n) for n in ("in", "store", "check"))
    first = spark.createDataFrame([(1, "p", 10, 1.0), (1, "p", 20, 2.0)], append.POINTS)
    first.coalesce(1).write.parquet(inbox)
    run = lambda: append.append(spark.readStream.schema(append.POINTS).parquet(inbox), store, check).awaitTermination()
    run()
    spark.createDataFrame([(1, "p", 20, 5.0), (1, "p", 30, None)], append.POINTS).coalesce(1).write.mode("append").parquet(inbox)
    run()
    found = sorted(tuple(r) for r in append.intervals(spark, store).select("st", "et", "value").where(F.col("st") > 0).collect())
    assert found == [(10, 19, 1.0), (20, 29, 5.0), (30, NOW, None)]
    append.compact(spark, store, str(tmp_path / "packed"))
    assert append.points(spark, str(tmp_path / "packed")).count() == 3


def test_windows_of_a_stream(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.sql("SELECT 1L AS entity, 'p' AS prop, timestamp_seconds(x) AS ts, double(x) AS value FROM VALUES (0), (30), (70), (100000) t(x)").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("entity long, prop string, ts timestamp, value double").parquet(src)
    q = append.windowed_extremes(stream, "1 minute", "10 minutes").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.min_value, r.max_value) for r in spark.table("w").collect()) == [(0.0, 30.0), (70.0, 70.0), (100000.0, 100000.0)]
