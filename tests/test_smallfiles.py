"""Small files written and counted on a local file system are those of Spark's own writer and scan."""

import glob
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from adspark.session import shared_path
from adspark.sources import io as IO
from adspark.sources import smallfiles as SM

VALUES = [None, "", "a b", "x=y", "per%cent", "q?#'\"*", "{b}[c]^", "ünï", "back\\slash", "tab\t", "<lt>|`", "a/b"]


def _odd(spark):
    base = spark.createDataFrame([(v, i * 12 + j) for i in range(7) for j, v in enumerate(VALUES)], "k string, id long")
    return base.select("k", "id", F.col("id").cast("tinyint").alias("b"), F.col("id").cast("float").alias("f"), F.col("id").cast("decimal(9,2)").alias("d9"),
                       F.col("id").cast("decimal(30,5)").alias("d30"), F.timestamp_micros(F.col("id") * 1000001).alias("ts"),
                       F.expr("cast(timestamp_micros(id * 77) as timestamp_ntz)").alias("ntz"), F.expr("date_add(date'1500-01-01', cast(id as int))").alias("dt"),
                       F.when(F.col("id") % 3 > 0, F.encode(F.col("id").cast("string"), "utf-8")).alias("bin"), (F.col("id") % 2 == 0).alias("t"),
                       F.lit(None).cast("int").alias("none"), F.lit("x").alias("two words")).withMetadata("id", {"note": "kept"})


def _files(path):
    root = path.removeprefix("file:")
    return sorted((d[len(root):], sum(f.endswith(".parquet") for f in fs), sum(f.endswith(".crc") for f in fs)) for d, _, fs in os.walk(root))


def _scan(spark, path, col):
    return spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file_path"), col).agg(F.count(F.lit(1)).alias("n_rows"))


def _same(a, b):
    assert a.dtypes == b.dtypes and a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_small_files_equal_those_of_sparks_writer(spark, monkeypatch):
    ours, sparks = shared_path(spark, "small-arrow"), shared_path(spark, "small-spark")
    IO.compact(_odd(spark), ours, "k", "id", max_records_per_file=5)
    monkeypatch.setattr(SM, "SMALL_FILE_ROWS", 0)
    IO.compact(_odd(spark), sparks, "k", "id", max_records_per_file=5)
    makers = {path: {pq.read_metadata(f).created_by.split()[0] for f in glob.glob(path.removeprefix("file:") + "/*/part-*")} for path in (ours, sparks)}
    assert makers == {ours: {"parquet-cpp-arrow"}, sparks: {"parquet-mr"}}  # no process is forked for a file
    assert _files(ours) == _files(sparks)
    a, b = spark.read.parquet(ours), spark.read.parquet(sparks)
    assert a.schema == b.schema and a.schema["id"].metadata == {"note": "kept"}
    _same(a, b)
    stats = pq.read_metadata(glob.glob(ours.removeprefix("file:") + "/k=a b/part-*c000*")[0]).row_group(0).column(0).statistics
    assert (stats.min, stats.max) == (2, 50)
    for path in (ours, sparks):
        _same(IO.file_row_counts(spark, path, "k"), _scan(spark, path, "k"))


@pytest.mark.parametrize("value", ["cast(id % 4 as int)", "date_add(date'2020-01-01', cast(id % 5 as int))", "cast(id % 6 as double) / 4",
                                   "timestamp_seconds(id % 5)", "id % 2 = 0", "case when id % 3 > 0 then id % 3 * 10000000000 end"])
def test_partition_values_keep_their_types(spark, value):
    path = shared_path(spark, "small-types")
    df = spark.range(90).withColumn("p", F.expr(value))
    IO.compact(df, path, "p", "id", max_records_per_file=4)
    got = IO.file_row_counts(spark, path, "p")
    _same(got, _scan(spark, path, "p"))
    assert "Scan parquet" not in got._jdf.queryExecution().executedPlan().toString()  # footers only, no scan of each file
    assert got.agg(F.max("n_rows"), F.sum("n_rows")).first()[:] == (4, 90)


def test_other_layouts_are_scanned(spark):
    path = shared_path(spark, "small-nested")
    spark.range(40).select("id", (F.col("id") % 3).alias("k"), (F.col("id") % 2).alias("j")).write.partitionBy("k", "j").parquet(path)
    for col in ("k", "j", "id"):
        _same(IO.file_row_counts(spark, path, col), _scan(spark, path, col))


def test_files_of_other_attempts_do_not_count(spark):
    """A task whose result is not used leaves a file in the draft folder; a second write replaces the first one."""
    path = shared_path(spark, "small-attempts")
    root = path.removeprefix("file:")

    def other_attempt(batches):
        for draft in glob.glob(root + "/_draft-*"):
            for k in (1, 9):
                os.makedirs(f"{draft}/k={k}", exist_ok=True)
                open(f"{draft}/k={k}/part-00000-{'a' * 32}.c000.snappy.parquet", "w").close()
        yield from batches

    df = spark.range(100).select("id", (F.col("id") % 4).alias("k"))
    for rows in (df, df.where("k > 0")):
        IO.compact(rows.mapInArrow(other_attempt, rows.schema), path, "k", "id", max_records_per_file=5)
        _same(spark.read.parquet(path).select("id", F.col("k").cast("long")), rows)
    assert sorted(os.listdir(root)) == ["._SUCCESS.crc", "_SUCCESS", "k=1", "k=2", "k=3"]


def test_a_failed_write_keeps_the_rows_before(spark):
    path = shared_path(spark, "small-failed")
    df = spark.range(30).select("id", (F.col("id") % 2).alias("k"))
    IO.compact(df, path, "k", "id", max_records_per_file=5)
    with pytest.raises(Exception):
        IO.compact(df.withColumn("x", F.when(F.col("id") < 29, 1).otherwise(F.raise_error(F.lit("broken")).cast("int"))), path, "k", "id", max_records_per_file=5)
    assert spark.read.parquet(path).count() == 30 and not glob.glob(path.removeprefix("file:") + "/_draft-*")


def test_a_changed_byte_is_noticed(spark):
    path = shared_path(spark, "small-crc")
    IO.compact(spark.range(5).select("id", F.lit(1).alias("k")), path, "k", "id", max_records_per_file=5)
    with open(glob.glob(path.removeprefix("file:") + "/k=1/part-*")[0], "r+b") as f:
        f.seek(8)
        byte = f.read(1)
        f.seek(8)
        f.write(bytes([byte[0] ^ 1]))
    with pytest.raises(Exception, match="(?i)checksum"):
        spark.read.schema("id long").parquet(path).collect()


def test_dynamic_overwrite_replaces_the_values_present(spark, monkeypatch):
    df = spark.range(60).select("id", (F.col("id") % 3).alias("k"))
    got = []
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        for small in (SM.SMALL_FILE_ROWS, 0):  # this writer, then Spark's
            monkeypatch.setattr(SM, "SMALL_FILE_ROWS", small)
            path = shared_path(spark, "small-dynamic")
            IO.compact(df, path, "k", "id", max_records_per_file=5)
            IO.compact(df.where("k = 1 and id < 30"), path, "k", "id", max_records_per_file=5)
            got.append({r.k: r["count"] for r in spark.read.parquet(path).groupBy("k").count().collect()})
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    assert got == [{0: 20, 1: 10, 2: 20}] * 2
