"""Digests of files and rows."""

import hashlib

from pyspark.sql import functions as F

from fleetlens.sources import integrity


def test_file_digests_of_any_size(spark, tmp_path):
    bodies = {"a.bin": b"", "deep/b.bin": b"x" * 10, "deep/c.bin": bytes(range(256)) * 70_000}
    for name, body in bodies.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    (tmp_path / "_SUCCESS").write_bytes(b"")
    want = {(n, len(b), hashlib.md5(b).hexdigest()) for n, b in bodies.items()}
    for path in (str(tmp_path), f"file://{tmp_path}"):
        found = integrity.file_checksums(spark, path)
        assert {tuple(r) for r in found.collect()} == want and found.rdd.getNumPartitions() == 3
    assert {tuple(r) for r in integrity.file_checksums(spark, str(tmp_path / "deep/b.bin")).collect()} == {("b.bin", 10, hashlib.md5(b"x" * 10).hexdigest())}
    (tmp_path / "none").mkdir()
    assert integrity.file_checksums(spark, str(tmp_path / "none")).collect() == []


def test_rows_of_other_parts_have_other_digests(spark):
    rows = [("a|b", "c"), ("a", "b|c"), ("\\N", "x"), (None, "x"), ("", "x"), ("n", "x"), ("1:a", ""), ("1", "a")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.select(integrity.row_digest(["a", "b"]).alias("d")).distinct().count() == len(rows)


def test_every_column_counts(spark):
    one = spark.createDataFrame([(1, 2.5, "x"), (2, None, "y")], "k long, v double, t string").withColumn("at", F.timestamp_seconds("k"))
    sums = lambda df: integrity.content_checksums(df, integrity.canonical(df)).first()
    for changed in (one.withColumn("v", F.col("v") + 1e-6), one.withColumn("t", F.upper("t")), one.withColumn("at", F.timestamp_seconds(F.col("k") + 1))):
        assert sums(changed) != sums(one)
    assert sums(one.orderBy(F.desc("k"))) == sums(one)
