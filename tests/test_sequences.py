import pytest
from pyspark.sql import functions as F

from flowloom.operators import sequences


def test_tumbling_drops_the_rest_and_takes_the_last_label(spark):
    df = spark.range(1, 24).select("id", (F.col("id") * 1.0).alias("x"), (F.col("id") % 20 == 0).cast("int").alias("label"))
    got = sequences.tumbling(df, ["id"], ["x"]).orderBy("seq_id").collect()
    assert [(r["seq_id"], r["label"]) for r in got] == [(0, 0), (1, 1)]
    assert [s[0] for s in got[1]["steps"]] == [float(i) for i in range(11, 21)]


@pytest.mark.parametrize("chunk", [4, 7, 1000])
def test_sliding_cuts_a_busy_key_into_chunks(spark, chunk):
    key = F.when(F.col("id") % 3 < 2, "busy").otherwise(F.concat(F.lit("k"), F.col("id") % 7))
    df = spark.range(200).select("id", key.alias("key"), F.array(F.col("id") * 1.0).alias("features"))
    got = sequences.sliding(df, "key", ["id"], "features", 4, chunk=chunk).collect()
    rows = sorted((r["key"], r["id"]) for r in df.collect())
    assert len(got) == 200
    for r in got:
        mine = [i for k, i in rows if k == r["key"] and i <= r["id"]][-4:]
        assert [x[0] for x in r["buffer"]] == [float(i) for i in mine]


def test_zero_pad_comes_after_the_real_rows(spark):
    df = spark.range(3).select("id", F.lit("k").alias("key"), F.array(F.col("id") + 1.0, F.lit(5.0)).alias("features"))
    padded = sequences.pad_zero(sequences.sliding(df, "key", ["id"], "features", 10), 2, 10)
    last = padded.filter("id = 2").first()["buffer"]
    assert last[:3] == [[1.0, 5.0], [2.0, 5.0], [3.0, 5.0]] and last[3:] == [[0.0, 0.0]] * 7


def test_mean_pad_up_to_ten_rows(spark):
    df = spark.range(12).select("id", F.array(F.col("id") * 1.0).alias("features"))
    slid = sequences.sliding(df, [], ["id"], "features", 50)
    got = {r["id"]: r["buffer"] for r in sequences.pad_mean(slid, 1, 10).collect()}
    assert got[3] == [[0.0], [1.0], [2.0], [3.0]] + [[1.5]] * 6
    assert len(got[9]) == 10 and len(got[11]) == 12


def test_reshapes(spark):
    df = spark.createDataFrame([([float(i) for i in range(23)],)], "features array<double>")
    steps = sequences.equal_steps(df, 23, 10).first()["steps"]
    assert len(steps) == 10 and steps[7] == [21.0, 22.0, 0.0] and steps[9] == [0.0] * 3
    with pytest.raises(Exception, match="22"):
        sequences.equal_steps(df, 22, 10).collect()
    assert sequences.as_steps(df).first()["steps"][:2] == [[0.0], [1.0]]


def test_a_chunk_must_hold_what_it_lends(spark):
    df = spark.range(10).select("id", F.array(F.col("id") * 1.0).alias("f"))
    with pytest.raises(ValueError):
        sequences.sliding(df, [], ["id"], "f", 10, chunk=4)
