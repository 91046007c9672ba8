"""Scans, sinks and file layout.

Partitioned Parquet is the storage format: partition pruning and pushed
filters come from Spark's scan; layout (files per partition, rows per file
and per row group) is set with write options, not by re-chunking files by
hand. Column statistics stay on so later scans can skip row groups.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from adspark.sources import smallfiles as SMALL


def write_partitioned(df: DataFrame, path: str, partition_cols: list[str], mode: str = "overwrite",
                      compression: str = "snappy", max_records_per_file: int | None = None,
                      row_group_bytes: int | None = None) -> None:
    """Partitioned Parquet write; overwrite replaces only the partitions present.

    Rows are rebalanced by the partition columns first: a task writes few
    folders, and AQE splits a hot partition value over several tasks.
    """
    w = (df.hint("rebalance", *partition_cols).write.mode(mode).option("compression", compression)
         .option("partitionOverwriteMode", "dynamic"))
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", int(max_records_per_file))
    if row_group_bytes:
        w = w.option("parquet.block.size", int(row_group_bytes))
    w.partitionBy(*partition_cols).parquet(path)


def read_parquet(spark: SparkSession, path: str, schema: StructType | str | None = None,
                 columns: list[str] | None = None, where=None) -> DataFrame:
    """Scan with an explicit schema, projection and filter; filters on partition columns prune."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    df = r.parquet(path)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def list_partitions(spark: SparkSession, path: str, column: str,
                    schema: StructType | str | None = None) -> DataFrame:
    """Sorted distinct values of a partition column (S2); ``schema`` pins its type."""
    r = spark.read.schema(schema) if schema is not None else spark.read
    return r.parquet(path).select(column).distinct().orderBy(column)


def read_file_subset(spark: SparkSession, path: str, file_pattern: str) -> DataFrame:
    """Rows of the files whose path matches a regex, via the hidden file metadata column (S3)."""
    df = spark.read.parquet(path)
    return df.where(F.col("_metadata.file_path").rlike(file_pattern))


#: Rows that a writer of ``compact`` is dealt, and files that it writes at most.
WRITER_ROWS, WRITER_FILES = 1_200_000, 1024


def compact(df: DataFrame, path: str, partition_col: str, order_col: str,
            max_records_per_file: int = 1_200_000, row_group_bytes: int = 64 * 1024 * 1024) -> None:
    """Re-chunk into bounded files per partition value, sorted inside files.

    Rows are dealt out as (partition value, order) ranges that follow the
    data, so a hot partition value gets as many writers as its size asks for;
    each task sorts its rows, so files carry tight min/max statistics;
    ``maxRecordsPerFile`` bounds file size. Of small files a writer makes many:
    a task and a range bound for each would cost more than the file; on a
    local file system it writes them with Arrow (``smallfiles``).
    """
    rows = max_records_per_file * min(WRITER_FILES, max(1, WRITER_ROWS // max_records_per_file))
    writers = max(1, -(-df.count() // rows))
    dealt = df.repartitionByRange(writers, partition_col, order_col).sortWithinPartitions(partition_col, order_col)
    if SMALL.writable(df, path, partition_col, max_records_per_file):
        return SMALL.overwrite(dealt, path, partition_col, int(max_records_per_file), int(row_group_bytes))
    (dealt.write.mode("overwrite").option("compression", "snappy")
       .option("maxRecordsPerFile", int(max_records_per_file))
       .option("parquet.block.size", int(row_group_bytes))
       .partitionBy(partition_col).parquet(path))


def file_row_counts(spark: SparkSession, path: str, partition_col: str | None = None) -> DataFrame:
    """Rows per written file (for layout checks), with the partition value when given."""
    found = SMALL.partitions(spark, path, partition_col) if partition_col else None
    if found:
        return SMALL.row_counts(spark, path, partition_col, found)
    keys = [F.col("_metadata.file_path").alias("file_path")] + ([F.col(partition_col)] if partition_col else [])
    return spark.read.parquet(path).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def append_committed(df: DataFrame, path: str, batch_id: str | int) -> bool:
    """Append ``df`` to a log as batch ``batch_id``, whole or not at all and once only.

    The rows go to a folder of this attempt's own; then one manifest file,
    named by the batch, is moved into place. The move fails if the batch has
    one already, so of a retry or of two writers one attempt counts, and
    ``read_committed`` sees a batch wholly or not. Returns whether this call
    published it. A batch's columns must be those of the log.

    Needs a file system whose rename is atomic and refuses to overwrite (HDFS
    and local folders; an object store needs a committer that gives this).
    """
    spark, name = df.sparkSession, re.sub(r"[^A-Za-z0-9._-]", lambda m: f"~{ord(m[0]):x}", str(batch_id))
    manifest = f"{path}/commits/{name}.json"
    if _exists(spark, manifest):
        return False
    kinds = df.schema.json()
    first = spark.read.schema(MANIFEST).json(f"{path}/commits/*.json").limit(1).collect() if _exists(spark, f"{path}/commits") else []
    if first and first[0]["kinds"] != kinds:
        raise ValueError(f"batch {batch_id} has other columns than the log")
    attempt = uuid.uuid4().hex
    data, draft = f"{path}/data/{name}-{attempt}", f"{path}/drafts/{name}-{attempt}.json"
    df.write.option("compression", "snappy").parquet(data)
    rows = spark.read.schema(df.schema).parquet(data).count()
    jvm, fs = spark._jvm, spark._jvm.org.apache.hadoop.fs
    here, there = fs.Path(draft), fs.Path(manifest)
    files = here.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(here, False)
    out.write(bytearray(json.dumps({"batch_id": str(batch_id), "folder": data, "n_rows": rows, "kinds": kinds}).encode()))
    out.close()
    files.mkdirs(there.getParent())
    context = fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(here, there, spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0))
    except Exception as e:  # noqa: BLE001 - only the refusal to overwrite means that another attempt won
        if "FileAlreadyExists" not in str(e) and not _exists(spark, manifest):
            raise
        return False
    return True


MANIFEST = "batch_id string, folder string, n_rows long, kinds string"


def committed_batches(spark: SparkSession, path: str) -> DataFrame:
    """batch_id, folder, n_rows and kinds (the schema) of every published batch; none: no rows."""
    if not _exists(spark, f"{path}/commits"):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json(f"{path}/commits/*.json")


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all published batches, with ``batch_id`` (other characters than letters, digits and ``._-`` as ``~`` and their number).

    Raises on a log without any batch: it has no columns yet.
    """
    batches = committed_batches(spark, path).collect()  # one row per batch, as for the folder listing of any table
    if not batches:
        raise ValueError(f"no batch was published in {path}")
    schema = StructType.fromJson(json.loads(batches[0]["kinds"]))
    rows = spark.read.schema(schema).parquet(*[b["folder"] for b in batches])
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/data/([^/]+)-[0-9a-f]{32}/", 1)
    return rows.withColumn("batch_id", folder)


def append_log(df: DataFrame, path: str) -> None:
    """Append rows to a single-schema Parquet log (S7, batch side)."""
    df.write.mode("append").option("compression", "snappy").parquet(path)


def footer_counts(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """n_rows, and per column its non-null count, minimum and maximum, read from the Parquet footers alone.

    The scan carries the aggregation (DataSource V2 pushes COUNT, MIN and MAX
    into Parquet), so no data page is read. Only for whole, unfiltered files:
    with a filter the plain aggregate is the way. Columns: numbers, dates and
    booleans; the footers' bounds of strings may be cut, so those are refused.
    """
    session = spark.newSession()  # the two settings concern this scan alone
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    df = session.read.parquet(path)
    kinds = dict(df.dtypes)
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for c in columns or []:
        if not re.match(r"(tinyint|smallint|int|bigint|float|double|date|boolean)$", kinds[c]):
            raise ValueError(f"{c} is {kinds[c]}: its bounds are not exact in a footer")
        aggs += [F.count(c).alias(f"{c}_n"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return df.agg(*aggs)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV export with header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV scan with an explicit schema."""
    return spark.read.schema(schema).option("header", True).csv(path)
