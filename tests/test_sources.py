from pyspark.sql import types as T
import json

import pytest
from pyspark.sql import functions as F

from motifline.operators import scaling
from motifline.plans.experiments import gaussian_noise
from motifline.sources import csv, synthetic, tables


def test_columns_are_matched_by_name(spark, tmp_path):
    for folder, name, text in (
        ("valve1", "1.csv", "datetime,a,b,anomaly\n2024-01-01,1,2,0\n2024-01-02,3,4,1\n"),
        ("valve2", "1.csv", "b,anomaly,datetime,a\n6,1,2024-01-03,5\n"),
        ("valve2", "2.csv", "datetime,a,b,c,anomaly\n2024-01-04,7,8,9,0\n"),
        ("other", "3.csv", "datetime,a,b,anomaly\n2024-01-05,0,0,0\n"),
    ):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(text)
    read = csv.read_grouped_csv(spark, str(tmp_path), ("valve1", "missing", "valve2"))
    df, features = csv.split_roles(read, csv.GROUPED_META, "anomaly")
    rows = [tuple(r) for r in df.select("source_group", "source_file", "label", "a", "b", "c").orderBy("a").collect()]
    assert rows == [
        ("valve1", "1.csv", 0, 1, 2, None), ("valve1", "1.csv", 1, 3, 4, None),
        ("valve2", "1.csv", 1, 5, 6, None), ("valve2", "2.csv", 0, 7, 8, 9),
    ]
    assert features == ["a", "b", "c"]


def test_no_file_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError):
        csv.read_grouped_csv(spark, str(tmp_path))


def test_synthetic_series_is_stable_and_blockwise(spark):
    lengths = spark.createDataFrame([("a", 70_000), ("b", 3), ("none", 0)], "k string, n_rows long")
    made = synthetic.synthetic_series(lengths, ["k"], n_features=1, span=50.0)
    other = synthetic.synthetic_series(lengths.repartition(3), ["k"], n_features=1, span=50.0)
    assert {r.k: r.c for r in made.groupBy("k").agg(F.countDistinct("pos").alias("c")).collect()} == {"a": 70_000, "b": 3}
    digest = F.sum(F.xxhash64("k", "pos", "ts", "sensor_0", "label").cast("decimal(38,0)"))
    assert made.agg(digest).first() == other.agg(digest).first()
    noise = made.where("k = 'a'").select((F.col("sensor_0") - F.expr("sin(pos * 50D / 69999)")).alias("e"), "label")
    row = noise.agg(F.avg("e").alias("m"), F.stddev("e").alias("s"), F.avg("label").alias("y")).first()
    assert abs(row.m) < 0.002 and abs(row.s - 0.1) < 0.002 and abs(row.y - 0.05) < 0.005


def test_noise_does_not_depend_on_partitions(spark):
    df = spark.range(20_000).selectExpr("'s' as k", "id as pos", "0D as x")
    a = gaussian_noise(df, ["k"], 0.5, seed=1)
    b = gaussian_noise(df.repartition(7), ["k"], 0.5, seed=1)
    assert a.join(b, ["k", "pos"]).where(a.x != b.x).count() == 0
    row = a.agg(F.avg("x").alias("m"), F.stddev("x").alias("s"), F.kurtosis("x").alias("q")).first()
    assert abs(row.m) < 0.02 and abs(row.s - 0.5) < 0.01 and abs(row.q) < 0.2
    assert gaussian_noise(df, ["k"], 0.5, seed=2).join(a.withColumnRenamed("x", "y"), ["k", "pos"]).where("x = y").count() == 0


def test_metric_files(spark, tmp_path):
    assert tables.write_metrics([], str(tmp_path / "none")) is None
    one = spark.createDataFrame([("a", 1, 0.5)], "experiment string, seed int, f1 double")
    two = spark.createDataFrame([("a", 2, 0.7, 3.0)], "experiment string, seed int, f1 double, seconds double")
    tables.write_metrics([one, two], str(tmp_path / "m"))
    back = spark.read.option("header", True).csv(str(tmp_path / "m" / "csv"), inferSchema=True)
    assert sorted((r.seed, r.f1, r.seconds) for r in back.collect()) == [(1, 0.5, None), (2, 0.7, 3.0)]
    assert spark.read.json(str(tmp_path / "m" / "json")).count() == 2
    with pytest.raises(ValueError):
        tables.write_results(one, str(tmp_path / "x"), "xml")


def test_features_and_fits_come_back(spark, tmp_path):
    df = spark.createDataFrame([(0, "train", 1.0, None), (0, "test", 2.0, 1)], "fold int, role string, x double, label int")
    tables.write_features(df, str(tmp_path / "f"))
    assert [(r.x, r.label) for r in tables.read_features(spark, str(tmp_path / "f"), role="train").collect()] == [(1.0, 0)]
    plan = tables.read_features(spark, str(tmp_path / "f"), role="train")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(role" in plan
    assert not tables.write_labels_times(df.where("false"), str(tmp_path / "none"), ["label"])
    fit = scaling.scale_fit(df, ["role"], ["x"])
    tables.save_fit(fit, str(tmp_path / "fit"))
    assert sorted(tables.load_fit(spark, str(tmp_path / "fit")).collect()) == sorted(fit.collect())
    with pytest.raises(Exception):
        tables.load_automaton(spark, str(tmp_path / "missing"))[0].count()


def test_grouped_csv_with_odd_names_and_quoted_headers(spark, tmp_path):
    from motifline.sources.csv import read_grouped_csv

    (tmp_path / "valve1").mkdir()
    (tmp_path / "valve1" / "a b+c%20[1].csv").write_text('"x,1",y\n1.5,2\n')
    (tmp_path / "valve1" / "plain.csv").write_text('y,"x,1"\n4,3.5\n')
    schema = T.StructType([T.StructField("x,1", T.DoubleType()), T.StructField("y", T.IntegerType())])
    rows = read_grouped_csv(spark, str(tmp_path), schema=schema).select("`x,1`", "y", "source_group", "source_file").collect()
    assert sorted(map(tuple, rows)) == [(1.5, 2, "valve1", "a b+c%20[1].csv"), (3.5, 4, "valve1", "plain.csv")]


def test_grouped_csv_types_nulls_and_files_without_rows(spark, tmp_path):
    for folder, name, text in (
        ("valve1", "a.csv", "t,x,y,z\n2024-01-01 00:00:01,1,a,\n2024-01-01 00:00:02,,\"b, c\",1\n"),
        ("valve1", "b.csv", "t,x,y,z\n2024-01-02 00:00:00,2.5,7,2\n"),
        ("valve2", "head.csv", "x,only\n"),
        ("valve2", "none.csv", ""),
        ("valve2", "notes.txt", "x\n9\n"),
    ):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(text)
    read = csv.read_grouped_csv(spark, f"file://{tmp_path}")
    assert dict(read.dtypes) == {"t": "timestamp_ntz", "x": "double", "y": "string", "z": "bigint", "only": "string", "source_group": "string", "source_file": "string"}
    assert read.columns[:5] == ["t", "x", "y", "z", "only"]
    rows = sorted(((r.x, r.y, r.z, r.only, r.source_file) for r in read.collect()), key=str)
    assert rows == [(1.0, "a", None, None, "a.csv"), (2.5, "7", 2, None, "b.csv"), (None, "b, c", 1, None, "a.csv")]
    plan = read._jdf.queryExecution().toString()
    assert "FileScan" not in plan
    typed = csv.read_grouped_csv(spark, str(tmp_path), schema=T.StructType.fromDDL("t timestamp, x double, z string"))
    assert sorted((str(r.t), r.z) for r in typed.collect())[-1] == ("2024-01-02 00:00:00", "2")
    with pytest.raises(Exception, match="CSV conversion error"):
        csv.read_grouped_csv(spark, str(tmp_path), schema=T.StructType.fromDDL("y int")).collect()
