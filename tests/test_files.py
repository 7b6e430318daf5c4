from lodestone.sources.logs import list_datasets, read_runs, write_runs


def test_runs_as_csv(spark, tmp_path):
    runs = spark.createDataFrame([("cpu", 100, 2, 1, 588, 1.5, None), ("gpu", 100, 4, 2, 588, 0.5, 0.75)], "mode string, vertices long, threads long, run long, edges long, total_ms double, accuracy double")
    schema = "mode STRING, vertices LONG, threads LONG, run LONG, edges LONG, total_ms DOUBLE, accuracy DOUBLE"
    write_runs(runs, str(tmp_path / "out"))
    assert sorted(map(str, read_runs(spark, str(tmp_path / "out"), schema).collect())) == sorted(map(str, runs.collect()))
    (tmp_path / "bad.csv").write_text("mode,vertices\ncpu,many\n")
    assert [tuple(r) for r in read_runs(spark, str(tmp_path / "bad.csv"), "mode STRING, vertices LONG").collect()] == [("cpu", None)]


def test_datasets_of_a_folder(spark, tmp_path):
    (tmp_path / "ca-x.txt").write_text("0 1\n")
    (tmp_path / "notes.md").write_text("no")
    assert [(r.name, r.bytes) for r in list_datasets(spark, str(tmp_path)).collect()] == [("ca-x", 4)]
