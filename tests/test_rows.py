"""Row numbers: none lost, none twice, whatever plan the rows come from."""

import pytest
from pyspark.sql import functions as F

from wattledger.operators import adapters, sizing
from wattledger.operators.rows import numbered


def numbers(df):
    rows = df.select("pos", "k").collect()
    assert sorted(r.pos for r in rows) == list(range(len(rows)))
    return [r.k for r in sorted(rows, key=lambda r: r.pos)]


def test_file_rows_are_numbered_as_the_files_hold_them(spark, tmp_path):
    for part in range(3):
        (tmp_path / f"part-{part}.csv").write_text("k,x\n" + "".join(f"{part * 2000 + i},{'y' * 40}\n" for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        df = spark.read.option("header", True).csv(str(tmp_path)).withColumn("k", F.col("k").cast("int"))
        assert df.rdd.getNumPartitions() > 6
        assert numbers(numbered(df, "pos")) == list(range(6000))
        assert numbers(numbered(df.filter("k % 3 = 0").select("k"), "pos")) == list(range(0, 6000, 3))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("shuffle", [
    lambda d: d.repartition(7, "k"), lambda d: d.orderBy(F.desc("k")), lambda d: d.groupBy("k").agg(F.max("wide").alias("wide")),
    lambda d: d.join(d.select(F.col("k").alias("j")), F.col("k") == F.col("j")), lambda d: d.union(d.repartition(3)).distinct()])
def test_no_row_is_lost_after_a_shuffle(spark, tmp_path, shuffle):
    spark.range(40_000).select(F.col("id").alias("k"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("wide")).repartition(9).write.parquet(str(tmp_path / "t"))
    df = shuffle(spark.read.parquet(str(tmp_path / "t")))
    found = numbers(numbered(df, "pos"))
    assert sorted(found) == list(range(40_000))
    assert sorted(r.pos for r in numbered(df.drop("wide"), "pos").collect()) == list(range(40_000))


def test_empty_and_clashing_names(spark):
    df = spark.range(0).withColumnRenamed("id", "k")
    assert numbered(df, "pos").count() == 0
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, __n string")
    assert numbers(numbered(df, "pos")) == [1, 2]


def test_users_keep_all_rows_after_a_shuffle(spark):
    names = spark.range(3000).select(
        F.concat(F.lit("T"), F.col("id").cast("string")).alias("municipio"), F.lit("").alias("cenario"), F.lit("2,5").alias("Potencia Necessaria MWp"))
    out = sizing.read_sizing_summary(names.repartition(11, "municipio")).select("cenario").collect()
    assert sorted(r.cenario for r in out) == sorted(f"Scenario Row {k}" for k in range(1, 3001))
    rows = spark.range(2000).select((F.col("id") * 1.5).cast("string").alias("kwh_total_te"), F.lit("01/2024").alias("referencia")).repartition(6, "kwh_total_te")
    out = adapters.standardize(rows, "celesc").select("uc").collect()
    assert sorted(int(r.uc) for r in out) == list(range(2000))
