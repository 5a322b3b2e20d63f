import gzip
import os

import pytest
from pyspark.sql import functions as F

from flowloom.operators import learning
from flowloom.sources import packets, scan, scratch, sinks


@pytest.fixture()
def dirty(tmp_path):
    lines = ["a,b,Label", "1,2,Benign", "1,2,3,4", "5", "Infinity,NaN, benign ", "x,,Bot", "a,b,Label", '"p,q",7,Bot']
    path = tmp_path / "day1.csv"
    path.write_bytes("\n".join(lines).encode() + b"\n\xff\xfe,3,Bot\n")
    (tmp_path / "day2.csv").write_text("a,b,Label\n9,9,Bot\n")
    return tmp_path


def test_scan_skips_long_lines_and_fills_short_ones(spark, dirty):
    paths = scan.list_files(spark, str(dirty))
    assert scan.header(spark, paths[0]) == ["a", "b", "Label"]
    rows = [tuple(r)[:3] for r in scan.scan_raw(spark, paths[0], ["a", "b", "Label"]).collect()]
    assert ("5", None, None) in rows and ("p,q", "7", "Bot") in rows and ("x", None, "Bot") in rows
    assert ("1", "2", "Benign") in rows and len(rows) == 7
    assert not any(r[2] == "3" for r in rows)
    one = scan.scan_raw(spark, paths[0], ["a", "b", "Label"]).select("b")
    assert one.count() == 7 and len(one.collect()) == 7


def test_file_lists_and_counts(spark, dirty):
    paths = scan.list_files(spark, str(dirty))
    assert [os.path.basename(p) for p in paths] == ["day1.csv", "day2.csv"]
    assert scan.list_files(spark, str(dirty), first=1) == paths[:1]
    present, absent = scan.existing(spark, [*paths, str(dirty / "none.csv")])
    assert present == paths and len(absent) == 1
    with pytest.raises(FileNotFoundError):
        scan.existing(spark, [str(dirty / "none.csv")])
    counts = {r["source_file"]: r["n"] for r in scan.row_counts(scan.scan_raw(spark, paths, ["a", "b", "Label"])).collect()}
    assert counts == {"day1.csv": 7, "day2.csv": 1, "TOTAL": 8}


def test_cap_and_early_stop_per_file(spark):
    df = spark.range(300).select("id", F.when(F.col("id") < 200, "big").otherwise("small").alias("source_file"))
    capped = scan.cap_per_file(df, 120, ["id"])
    assert {r[0]: r[1] for r in capped.groupBy("source_file").count().collect()} == {"big": 120, "small": 100}
    assert capped.filter("source_file = 'big'").agg(F.max("id")).first()[0] == 119
    early = scan.early_stop_sample(df, "id", 100, ["id"])
    assert {r[0]: r[1] for r in early.groupBy("source_file").count().collect()} == {"big": 100, "small": 100}
    assert early.filter("source_file = 'big'").agg(F.max("id")).first()[0] < 120


def test_cleaned_folder_ignores_unlabelled_files(spark, tmp_path):
    spark.createDataFrame([(1.0, 0)], "x double, Label int").write.parquet(str(tmp_path / "a.parquet"))
    spark.createDataFrame([(2.0, 1)], "y double, Label int").write.parquet(str(tmp_path / "b.parquet"))
    spark.createDataFrame([(3.0,)], "x double").write.parquet(str(tmp_path / "c.parquet"))
    paths = [str(tmp_path / n) for n in ("a.parquet", "b.parquet", "c.parquet", "gone.parquet")]
    got, skipped = scan.load_cleaned(spark, paths)
    assert [(os.path.basename(p), "PATH" in r) for p, r in skipped] == [("c.parquet", False), ("gone.parquet", True)]
    assert got.columns == ["x", "Label", "y"] and got.count() == 2
    with pytest.raises(ValueError):
        scan.load_cleaned(spark, paths[2:])


def test_many_small_csv_files_get_their_types_at_once(spark, tmp_path):
    for i in range(120):
        extra, value = (",when", ",2024-01-02" if i % 4 else ",2024-01-02 03:04:05") if i % 2 == 0 else ("", "")
        number = 3_000_000_000 if i == 7 else i
        (tmp_path / f"{i:03}.csv").write_text(f"a,b,c,Label{extra}\n{number},{i}.5,{'x' if i == 11 else i},0{value}\n,,,1{',' if extra else ''}\n")
    (tmp_path / "bare.csv").write_text("a,b\n1,2\n")
    (tmp_path / "empty.csv").write_text("")
    with gzip.open(tmp_path / "packed.csv.gz", "wt") as out:
        out.write("a,b,c,Label\n5,1,01,1\n")
    paths = scan.list_files(spark, str(tmp_path)) + [str(tmp_path / "packed.csv.gz"), str(tmp_path / "gone.csv")]
    spark.sparkContext.setJobGroup("types", "types")
    got, skipped = scan.load_cleaned(spark, paths)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("types")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # A listing for each of two headers, and the two stages of one aggregate: not one per file.
    assert len(jobs) <= 4
    assert {os.path.basename(p): r for p, r in skipped} == {
        "bare.csv": "no Label column", "empty.csv": "no Label column", "gone.csv": "PATH_NOT_FOUND"
    }
    assert dict(got.dtypes) == {"a": "bigint", "b": "double", "c": "string", "Label": "int", "when": "timestamp"}
    assert got.count() == 241 and got.filter("c = '01'").count() == 1
    assert got.filter("a is not null").agg(F.max("a"), F.sum("b")).first()[0] == 3_000_000_000


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test")], "id int, split string")
    for fmt in ("parquet", "csv", "json"):
        sinks.write_table(df, str(tmp_path / fmt), fmt, ["split"])
        assert {"split=train", "split=test"} <= set(os.listdir(tmp_path / fmt))
    assert sorted(map(tuple, sinks.feature_table(spark, ["a", "b"]).collect())) == [(0, "a"), (1, "b")]
    doc = sinks.result_document(df.limit(1), {"model": {"name": "m", "threshold": 0.5}}).first()[0]
    assert doc == '{"metrics":{"id":1,"split":"train"},"model":{"name":"m","threshold":0.5}}'


def test_packets_round_trip_and_rejects(spark):
    df = spark.createDataFrame([(7, 1.5, 2.0, 1)], "id long, a double, b double, label int")
    line = packets.encode(df, "id", ["a", "b"], "label").first()[0]
    assert line == '{"flow_id":7,"features":[1.5,2.0],"true_label":1}'
    lines = spark.createDataFrame([(line,), (line[:-1],), ("",), ("[]",), ('{"flow_id":1}',)], "value string")
    good, bad = packets.decode(lines)
    assert good.count() == 1 and bad.count() == 4


def test_model_checkpoint(spark, tmp_path):
    df = spark.createDataFrame([(0.0, 0), (1.0, 1), (0.1, 0), (0.9, 1)], "x double, label int")
    model = learning.fit_graph_classifier(df, ["x"])
    metrics = spark.createDataFrame([(0.5,)], "accuracy double")
    sinks.save_model(model, str(tmp_path / "m"), metrics, {"graph": {"k": 10}})
    loaded, meta = sinks.load_model(spark, str(tmp_path / "m"))
    assert meta == '{"metrics":{"accuracy":0.5},"graph":{"k":10}}'
    assert [r["prob"] for r in learning.score(loaded, df).collect()] == [r["prob"] for r in learning.score(model, df).collect()]


def test_shared_folder_is_the_session_setting(spark):
    assert scratch.new_path(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_broadcast_only_up_to_the_limit(spark):
    df = spark.range(20)
    assert "ResolvedHint" in scratch.broadcast_if_small(df, 20)._jdf.queryExecution().analyzed().toString()
    assert scratch.broadcast_if_small(df, 19) is df


def test_temporary_tables_go_with_their_block(spark):
    kept = scratch.materialise(spark.range(5))
    with scratch.temporary(spark):
        inner = scratch.materialise(spark.range(7))
        path = inner.inputFiles()[0]
        assert inner.count() == 7
        with scratch.temporary(spark):
            scratch.materialise(spark.range(1))
        assert inner.count() == 7
    assert not os.path.exists(path.removeprefix("file:").replace("//", "/")) and kept.count() == 5


def test_partition_number_follows_the_scanned_files(spark, monkeypatch):
    df = scratch.materialise(spark.range(1000)).groupBy("id").count()
    assert scratch.partitions_for(df) == 8
    monkeypatch.setattr(scratch, "PARTITION_BYTES", 100)
    assert 8 < scratch.partitions_for(df) < 1000
    assert scratch.partitions_for(spark.createDataFrame([(1,)], "id int")) == 8


def test_every_file_is_read_by_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" Flow ID,Src IP,Dst Port,Dur,Label\nf1,s1,80,5,Bot\nf2,s2,81,6,Bot,extra\n")
    (tmp_path / "b.csv").write_text("Dst Port,Dur,Label\n90,7,Benign\n")
    (tmp_path / "c.csv").write_text("Dur,Dst Port,Label\n8,91,Benign\n9\n")
    (tmp_path / "d.csv").write_text("")
    (tmp_path / "e.csv").write_text("Dur,Dst_Port,Label,Label\n1,2,x,y\n")
    paths = scan.list_files(spark, str(tmp_path))
    rows = scan.scan_raw(spark, paths)
    got = {tuple(r) for r in rows.select("Flow_ID", "Src_IP", "Dst_Port", "Dur", "Label", "source_file").collect()}
    assert got == {
        ("f1", "s1", "80", "5", "Bot", "a.csv"), (None, None, "90", "7", "Benign", "b.csv"),
        (None, None, "91", "8", "Benign", "c.csv"), (None, None, None, "9", None, "c.csv"), (None, None, "2", "1", "x", "e.csv"),
    }
    assert rows.filter("Label_1 = 'y'").count() == 1
    counts = {r["source_file"]: (r["read"], r["skipped"]) for r in scan.skipped_lines(spark, paths).collect()}
    assert counts["a.csv"] == (1, 1) and counts["c.csv"] == (2, 0)
    named, absent = scan.scan_named(spark, [*paths, str(tmp_path / "z.csv")], "Dur", 1)
    assert [os.path.basename(p) for p in absent] == ["z.csv"] and named.filter("source_file = 'c.csv'").count() == 1


def test_cleaned_columns_get_one_type(spark, tmp_path):
    spark.createDataFrame([(1, 0)], "x long, Label int").write.parquet(str(tmp_path / "a.parquet"))
    spark.createDataFrame([("t", 1)], "x string, Label long").write.parquet(str(tmp_path / "b.parquet"))
    got, skipped = scan.load_cleaned(spark, [str(tmp_path / n) for n in ("a.parquet", "b.parquet")])
    assert sorted(map(tuple, got.collect())) == [("1", 0.0), ("t", 1.0)] and not skipped
