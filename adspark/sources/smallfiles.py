"""Many small Parquet files on a local file system: written with Arrow, counted from their footers.

To create a file there, Hadoop's client forks ``chmod`` twice where it has no
native code, and Spark's scan copies the Hadoop configuration for each file
and keeps all of them in the driver. Of files of a few rows that is nearly all
of the time. The files are those of Spark's own writer: names and folders,
statistics, page checksums, the schema in the footer, ``.crc`` beside each.
"""

from __future__ import annotations

import os
import re
import shutil
import struct
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Files of up to this many rows count as small: more cost more than their creation.
SMALL_FILE_ROWS = 10_000

#: A column of so few rows is longer with a dictionary than without.
DICTIONARY_ROWS = 50

#: The folder of null and of the empty string in a Hive layout, the characters escaped in folder names, names that readers skip.
NO_VALUE, ESCAPED, HIDDEN = "__HIVE_DEFAULT_PARTITION__", r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]", r"\.|_[^=]*$|.*\._COPYING_$"

#: Types whose Parquet form Spark reads alike from Arrow's writer and its own.
PLAIN = (T.NumericType, T.BooleanType, T.StringType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType)


def local_folder(spark: SparkSession, path: str) -> str | None:
    """``path`` as a folder of the local file system; None if it lies on another one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.makeQualified(at).toUri().getPath() if files.getUri().getScheme() == "file" else None


def writable(df: DataFrame, path: str, partition_col: str, max_rows: int) -> bool:
    """Whether ``overwrite`` can write ``df``; else Spark's writer does."""
    return (max_rows <= SMALL_FILE_ROWS and len(df.columns) > 1 and df.columns.count(partition_col) == 1
            and all(isinstance(f.dataType, PLAIN) for f in df.schema) and local_folder(df.sparkSession, path) is not None)


def overwrite(df: DataFrame, path: str, partition_col: str, max_rows: int, row_group_bytes: int) -> None:
    """Write ``df`` over a local folder: one folder per partition value, files of ``max_rows`` rows in the order of its partitions.

    Tasks write into a draft folder, under names of their attempt. When all
    have ended, the draft is renamed (an attempt that still runs can add
    nothing to it), files of attempts that did not count are deleted, and the
    folders of the partition values are moved into place as a whole.
    """
    spark, folder = df.sparkSession, local_folder(df.sparkSession, path)
    quoted = {f.name: F.col(f"`{f.name.replace('`', '``')}`") for f in df.schema}
    text = quoted[partition_col].cast("string")
    data = [f for f in df.schema if f.name != partition_col]
    rows = df.select(F.when(text != "", text), *[quoted[f.name] for f in data])
    footer = {"org.apache.spark.version": spark.version, "org.apache.spark.sql.parquet.row.metadata": T.StructType(data).json()}
    draft = os.path.join(folder, f"_draft-{uuid.uuid4().hex}")

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        attempt, files, held, at = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}", {}, None, None

        def escaped(name):
            return re.sub(ESCAPED, lambda m: f"%{ord(m[0]):02X}", name)

        def put(chunk, value):
            where = f"{draft}/{escaped(partition_col)}={NO_VALUE if value is None else escaped(value)}"
            if value not in files:
                os.makedirs(where, exist_ok=True)
            no = files[value] = files.get(value, -1) + 1
            name, out = f"part-{attempt}.c{no:03d}.snappy.parquet", pa.BufferOutputStream()
            with pq.ParquetWriter(out, chunk.schema, compression="snappy", store_schema=False, write_page_checksum=True,
                                  store_decimal_as_integer=True, use_dictionary=chunk.num_rows > DICTIONARY_ROWS) as w:
                w.add_key_value_metadata(footer)
                w.write_table(chunk, row_group_size=max(1, chunk.num_rows * row_group_bytes // max(1, chunk.nbytes)))
            body = out.getvalue().to_pybytes()
            sums = [zlib.crc32(body[i:i + 512]) for i in range(0, len(body), 512)]  # Hadoop's local file system checks them
            with open(f"{where}/.{name}.crc", "wb") as f:
                f.write(b"crc\0" + struct.pack(f">{len(sums) + 1}I", 512, *sums))
            with open(f"{where}/{name}", "wb") as f:
                f.write(body)

        for batch in batches:
            runs, start = pc.run_end_encode(batch.column(0)), 0
            table = pa.Table.from_batches([batch]).remove_column(0)
            for end, value in zip(runs.run_ends.to_pylist(), runs.values.to_pylist()):
                part, start = table.slice(start, end - start), end
                if held is not None and value == at:
                    part = pa.concat_tables([held, part]).combine_chunks()
                elif held is not None:
                    put(held, at)
                whole = part.num_rows // max_rows * max_rows
                for i in range(0, whole, max_rows):
                    put(part.slice(i, max_rows), value)
                held, at = part.slice(whole) if whole < part.num_rows else None, value
        if held is not None:
            put(held, at)
        yield pa.RecordBatch.from_pydict({"attempt": [attempt]})

    os.makedirs(draft)
    try:
        won = {r.attempt for r in rows.mapInArrow(run, "attempt string").collect()}  # one row per writer
        sealed = f"{draft}-sealed"
        os.rename(draft, sealed)
    except BaseException:
        shutil.rmtree(draft, ignore_errors=True)
        raise
    made = []
    for value in os.listdir(sealed):
        kept = 0
        for entry in os.scandir(f"{sealed}/{value}"):
            if entry.name.split("part-", 1)[1].split(".", 1)[0] in won:
                kept += 1
            else:
                os.remove(entry.path)
        made += [value] if kept else []
    dynamic = spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "dynamic"
    for old in made if dynamic else [name for name in os.listdir(folder) if name != os.path.basename(sealed)]:
        at = os.path.join(folder, old)
        if os.path.isdir(at) and not os.path.islink(at):
            shutil.rmtree(at)
        elif os.path.lexists(at):
            os.remove(at)
    for value in made:
        os.rename(f"{sealed}/{value}", f"{folder}/{value}")
    shutil.rmtree(sealed)
    done = spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")
    done.getFileSystem(spark._jsc.hadoopConfiguration()).create(done, True).close()


def partitions(spark: SparkSession, path: str, partition_col: str) -> dict[str, str] | None:
    """A file of each folder ``partition_col=value`` of a local folder; None if that is not its layout."""
    root = local_folder(spark, path)
    if not root or not os.path.isdir(root):
        return None
    found = {}
    for name in sorted(os.listdir(root)):
        if re.match(HIDDEN, name):
            continue
        if not name.startswith(f"{partition_col}=") or not os.path.isdir(f"{root}/{name}"):
            return None
        with os.scandir(f"{root}/{name}") as entries:
            first = next((f for f in entries if not re.match(HIDDEN, f.name)), None)
        if first and not first.is_file():
            return None
        if first:
            found[f"{root}/{name}"] = first.path
    return found


def row_counts(spark: SparkSession, path: str, partition_col: str, found: dict[str, str]) -> DataFrame:
    """file_path, ``partition_col`` and n_rows of the files of these folders, listed and read (footers alone) by the tasks."""
    kind = spark.read.option("basePath", path).parquet(*found.values()).schema[partition_col].dataType  # as Spark infers it from the folders
    values = [re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), os.path.basename(folder).split("=", 1)[1]) for folder in found]
    folders = spark.createDataFrame([(f, None if v == NO_VALUE else v) for f, v in zip(found, values)], "folder string, value string")

    def files(batches):
        import pyarrow as pa

        for batch in batches:
            for folder, value in zip(*[c.to_pylist() for c in batch.columns]):
                with os.scandir(folder) as entries:
                    seen = [e for e in entries if not re.match(HIDDEN, e.name)]
                if not all(e.is_file() for e in seen):
                    raise ValueError(f"{folder} holds folders beside its files")
                for i in range(0, len(seen), 10_000):
                    names = [e.path for e in seen[i:i + 10_000]]
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([value] * len(names), pa.string())], ["file", "value"])

    def rows(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        for batch in batches:
            names = batch.column(0).to_pylist()
            n = pa.array([pq.read_metadata(name).num_rows for name in names], pa.int64())
            uris = ["file:" + re.sub(r"[\x00-\x20\x7f\"#%<>?\[\\\]^`{|}]", lambda m: f"%{ord(m[0]):02X}", name) for name in names]
            yield pa.RecordBatch.from_arrays([pa.array(uris, pa.string()), batch.column(1), n], ["file_path", "value", "n_rows"])

    tasks = 4 * spark.sparkContext.defaultParallelism
    listed = folders.repartition(min(len(found), tasks)).mapInArrow(files, "file string, value string")
    counted = listed.repartition(tasks).mapInArrow(rows, "file_path string not null, value string, n_rows long not null").where("n_rows > 0")
    return counted.select("file_path", F.col("value").cast(kind).alias(partition_col), "n_rows")
