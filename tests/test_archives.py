"""Archives in parts: no file holds more than its share of members, and all come back."""

import io
import os

import numpy as np
from pyspark.sql import functions as F

from tidemark.plans import binary_queries
from tidemark.sources import binary, files


def test_parts(spark, tmp_path):
    folder = str(tmp_path / "zip")
    rows = spark.range(1000).select(F.when(F.col("id") < 900, "a.b.zip").otherwise("c").alias("archive"), F.format_string("d/%d.json", "id").alias("member"), F.col("id").cast("string").alias("content"))
    packed = binary.pack_members(rows, "archive", "member", "content", 100)
    names = [r["name"] for r in packed.select("name").collect()]
    assert len(names) == len(set(names)) == 10 and "a.b-00000000.zip" in names and "c-00000000" in names
    assert packed.agg(F.max(F.length("content"))).first()[0] < 150 * 120
    binary.write_files(packed.where("name LIKE 'a%'"), folder)
    got = binary.read_members(spark, folder, ".json").select(binary.whole_archive(F.col("archive")), "member", F.decode("content", "UTF-8"), "problem").collect()
    assert sorted(map(tuple, got)) == sorted(("a.b.zip", f"d/{i}.json", str(i), None) for i in range(900))


def test_archived_images(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    rows = spark.createDataFrame([("x.zip", "s/a.png", bytearray(png)), ("x.zip", "b.jpg", bytearray(b"\xff\xd8\xff\xe0")), ("x.zip", "t/c", None)], "archive string, member string, content binary")
    packed = binary.pack_members(rows, "archive", "member", "content", 2)
    cut = spark.createDataFrame([("cut.zip", bytearray(b"PK"))], "name string, content binary")
    binary.write_files(packed.unionByName(cut), str(tmp_path))
    got = {tuple(r)[:6] for r in binary.archived_images(spark, str(tmp_path)).where("problem IS NULL").collect()}
    assert got == {("a.png", "s", 24, "png", 640, 480), ("b.jpg", None, 4, "jpeg", None, None), ("c", "t", 0, None, None, None)}
    assert binary.archived_images(spark, str(tmp_path)).where("problem IS NOT NULL").count() == 1


def test_arrays_in_archives(spark, tmp_path, monkeypatch):
    """Keys share archives, however few rows they have; groups cross batches, nulls are NaN and last."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rows = spark.range(900).select((F.when(F.col("id") >= 30, F.col("id") % 200)).alias("k"), (-F.col("id")).alias("t"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("v"))
    rows = rows.unionAll(rows.where("k = 3").select("k", F.lit(None).cast("long"), F.lit(5).cast("long")))
    for archive in ("part", None):
        folder = str(tmp_path / f"{archive}")
        binary.write_files(binary.pack_arrays(rows, ["k"], ["t"], {"a": "v", "b": "t"}, F.format_string("x/%s.npz", "k"), archive), folder)
        assert len([f for _, _, found in os.walk(folder) for f in found]) == (201 if archive is None else len(os.listdir(folder))) and (archive is None or len(os.listdir(folder)) <= 4)
        got = {(r["file"], r["name"]): r["values"] for r in binary.read_arrays(spark, folder).collect()}
        want = {}
        for r in sorted(rows.collect(), key=lambda r: (r["t"] is None, r["t"] or 0)):
            for n, v in (("a", r["v"]), ("b", r["t"])):
                want.setdefault((f"{'null' if r['k'] is None else r['k']}.npz", n), []).append(np.nan if v is None else float(v))
        assert len(got) == 402 and str(got[("3.npz", "b")][-1]) == "nan" and {k: str(v) for k, v in got.items()} == {k: str(v) for k, v in want.items()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(files, "scratch", lambda spark, name: str(tmp_path / "query"))
    assert binary_queries.npz_archives(spark, "/root/testdata/sf0.001").count() == 16 and len(os.listdir(tmp_path / "query")) <= 5


def test_broken_archives(spark, tmp_path):
    good, out = io.BytesIO(), io.BytesIO()
    np.savez(good, x=np.arange(3.0))
    with binary.zipfile.ZipFile(out, "w") as z:
        for name, content in (("a/good.npz", good.getvalue()), ("a/bad.npz", b"no archive"), ("a/other.txt", b"")):
            z.writestr(name, content)
    df = spark.createDataFrame([("in.zip", bytearray(out.getvalue())), ("cut.zip", bytearray(b"PK"))], "name string, content binary")
    binary.write_files(df, str(tmp_path))
    got = {(r["file"], r["name"]): (r["values"], bool(r["problem"])) for r in binary.read_arrays(spark, str(tmp_path)).collect()}
    assert got == {("good.npz", "x"): ([0.0, 1.0, 2.0], False), ("bad.npz", None): (None, True), ("cut.zip", None): (None, True)}
