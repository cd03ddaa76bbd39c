"""Checksums of files and of table contents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

from pyarrow import fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, FloatType, StructType, TimestampNTZType, TimestampType

from fleetlens.operators.joins import lookup


class FileDigests(DataSource):
    """``spark.read.format("file_digests").load(folder)``: name, bytes and md5 of every file below a folder.

    One partition a file, whose bytes pass through the digest ``CHUNK`` at a time: a file of any size takes the same
    memory. The listing alone is made on the driver.
    """

    CHUNK = 4 << 20

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return "name string, bytes long, md5 string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _DigestReader(self.options["path"], int(self.options.get("chunk", self.CHUNK)))


class _DigestReader(DataSourceReader):
    def __init__(self, path: str, chunk: int) -> None:
        self.path, self.chunk = path, chunk

    def partitions(self) -> list[InputPartition]:
        system, root = pa_fs.FileSystem.from_uri(self.path) if "://" in self.path else (pa_fs.LocalFileSystem(), self.path)
        info = system.get_file_info(root)
        found = [info] if info.is_file else system.get_file_info(pa_fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and not f.base_name.startswith((".", "_")))
        return [InputPartition((path, path.removeprefix(root).lstrip("/") or info.base_name, size)) for path, size in files]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, int, str]]:
        if partition is None or partition.value is None:
            return
        path, name, size = partition.value
        system = pa_fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else pa_fs.LocalFileSystem()
        digest = hashlib.md5()
        with system.open_input_stream(path) as stream:
            while part := stream.read(self.chunk):
                digest.update(part)
        yield name, size, digest.hexdigest()


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, md5) per file of any size; a folder without files gives no rows."""
    spark.dataSource.register(FileDigests)
    return spark.read.format("file_digests").load(path)


def canonical(df: DataFrame, columns: Sequence[str] | None = None) -> list[Column]:
    """Columns as texts that other engines write alike: numbers of floating point with 12 decimals of their leading
    digit, moments as microseconds."""
    out = []
    for c in columns or df.columns:
        kind = df.schema[c].dataType
        if isinstance(kind, (DoubleType, FloatType)):
            out.append(F.when(F.col(c).isNotNull(), F.format_string("%.12e", F.col(c).cast("double") + F.lit(0.0))))
        elif isinstance(kind, (TimestampType, TimestampNTZType)):
            out.append(F.unix_micros(F.col(c).cast("timestamp")).cast("string"))
        else:
            out.append(F.col(c).cast("string"))
    return out


def row_digest(columns: Sequence[str | Column]) -> Column:
    """md5 of a row. Every part is led by its length, so that no two rows of other parts look alike; nulls have none."""
    texts = [F.col(c).cast("string") if isinstance(c, str) else c for c in columns]
    parts = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("n")) for t in texts]
    return F.md5(F.concat(*parts).cast("binary"))


def content_checksums(df: DataFrame, columns: Sequence[str | Column], by: Sequence[str | Column] = ()) -> DataFrame:
    """Rows and checksum per part: the sum of the first 60 bits of every row's md5, independent of row order and of copies' order."""
    bits = F.conv(F.substring(row_digest(columns), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(bits).alias("checksum"))


def failed_parts(actual: DataFrame, manifest: DataFrame, key: str, column: str = "md5") -> DataFrame:
    """Parts of the manifest that are missing or differ; empty if the data is intact."""
    expected = manifest.select(key, F.col(column).alias("expected"))
    joined = lookup(expected, actual.select(key, F.col(column).alias("actual")), key)
    return joined.where(~F.col("expected").eqNullSafe(F.col("actual")))
