"""Binary files: what is written comes back, and what is broken is a row of its own; weak labels and annotation files."""

import io
import json
import os
import zipfile

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import texts
from tidemark.operators import systems
from tidemark.sources import annotations, binary, detection_sets


def test_arrays(spark, tmp_path):
    folder = str(tmp_path / "npz")
    good, odd = io.BytesIO(), io.BytesIO()
    np.savez(good, x=np.arange(6, dtype=np.float32).reshape(2, 3), n=np.int64(7), names=np.array(["a", "b"]))
    np.savez(odd, x=np.array([{"a": 1}], dtype=object))
    rows = [("a/good.npz", good.getvalue()), ("odd.npz", odd.getvalue()), ("cut.npz", good.getvalue()[:40]), ("empty.npz", b""), ("other.txt", b"x"), ("null.npz", None)]
    df = spark.createDataFrame([(n, bytearray(c) if c is not None else None, 1) for n, c in rows], "name string, content binary, extra int")
    binary.write_files(df, folder)
    assert sorted(os.listdir(folder)) == ["a", "cut.npz", "empty.npz", "null.npz", "odd.npz", "other.txt"]  # no hidden files stay
    got = {(r["file"], r["name"]): r for r in binary.read_arrays(spark, folder).collect()}
    x = got["good.npz", "x"]
    assert x["shape"] == [2, 3] and x["values"] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0] and got["good.npz", "n"]["values"] == [7.0]
    assert got["good.npz", "names"]["problem"] and got["odd.npz", "x"]["problem"]
    assert all(got[f, None]["problem"] for f in ("cut.npz",)) and ("empty.npz", None) not in got  # Spark reads no empty files
    assert {(r["file"], r["name"]) for r in binary.read_arrays(spark, folder, ["n"]).where("problem IS NULL").collect()} == {("good.npz", "n")}
    binary.write_files(spark.createDataFrame([("odd.npz", bytearray(good.getvalue()))], "name string, content binary"), folder)
    assert binary.read_arrays(spark, folder, ["n"]).where("file = 'odd.npz'").first()["values"] == [7.0]


def test_members(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("d/one.json", json.dumps({"v": 1}))
        z.writestr("two.json", "x" * 1000)
        z.writestr("three.txt", "t")
    whole = out.getvalue()
    at = whole.index(b"two.json") + 12
    spoiled = whole[:at] + b"\xff" * 4 + whole[at + 4 :]
    df = spark.createDataFrame([("good.zip", bytearray(whole)), ("spoiled.zip", bytearray(spoiled)), ("none.zip", bytearray(b"PK"))], "name string, content binary")
    binary.write_files(df, str(tmp_path))
    got = {(r["archive"], r["member"]): r for r in binary.read_members(spark, str(tmp_path), ".json").collect()}
    assert json.loads(got["good.zip", "d/one.json"]["content"]) == {"v": 1} and ("good.zip", "three.txt") not in got
    assert got["spoiled.zip", "two.json"]["problem"] and got["spoiled.zip", "d/one.json"]["content"] and got["none.zip", None]["problem"]


def test_images(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    df = spark.createDataFrame([("s/a.png", bytearray(png)), ("b.jpg", bytearray(b"\xff\xd8\xff\xe0")), ("c.bin", bytearray(b"??"))], "name string, content binary")
    binary.write_files(df, str(tmp_path))
    found = binary.images(spark, str(tmp_path))
    assert {(r["file"], r["kind"], r["width"], r["height"], r["bytes"]) for r in found.collect()} == {("a.png", "png", 640, 480, 24), ("b.jpg", "jpeg", None, None, 4), ("c.bin", None, None, None, 2)}
    labels = spark.createDataFrame([("x/a.png", "one", 1), ("y/a.png", "two", 2), ("z/q.png", "none", 3)], "crop_path string, label string, bytes int")
    assert [(r["file"], r["label"], r["bytes"]) for r in binary.labelled_images(found, labels, "crop_path").collect()] == [("a.png", "two", 24)]


def test_weak_regions(spark):
    rec = lambda name, *regions: json.dumps({"filename": name, "grounding": {"regions": [{"bbox": b, "phrase": p} for b, p in regions]}})
    lines = [rec("t000012_500_f000375_video_3.jpg", ([1, 2, 3, 4], "Looking at a PHONE"), ([1, 2, 3], "phone"), (None, "phone"), ([1, 2, 3, 4], "nothing"), ([1, None, 3, 4], "phone")), rec("odd.jpg", ([0, 0, 1, 1], "sleep on the desk, phone")), "{", None, "{}"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = [(r["video"], r["frame"], r["box"], r["label"]) for r in annotations.weak_regions(df, F.col("line"), {"call": ["phone"], "rest": ["sleep", "desk"]}).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [("video_3", 375, [1.0, 2.0, 3.0, 4.0], "call"), (None, None, [0.0, 0.0, 1.0, 1.0], "rest")]))


def test_sets(spark, tmp_path):
    (tmp_path / "im1.xml").write_text("<annotation><size><width>9</width><height>8</height></size><object><name>cat</name><bndbox><xmin>1.0</xmin><ymin>2</ymin><xmax>5</xmax><ymax>6</ymax></bndbox></object><object><name>cow</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>5</xmax><ymax>6</ymax></bndbox></object></annotation>")
    r = detection_sets.xml_instances(spark, str(tmp_path / "im1.xml"), ["cat"]).collect()
    assert [(x["image"], x["width"], x["cls"], x["box"], x["ignore"]) for x in r] == [("im1", 9, "cat", [0.0, 1.0, 4.0, 5.0], False)]
    (tmp_path / "c.odgt").write_text('{"ID": "i", "gtboxes": [{"tag": "person", "fbox": [1, 2, 3, 4], "hbox": [1, 2, 1, 1], "vbox": [1, 2, 2, 2], "extra": {"ignore": 0}}, {"tag": "mask", "fbox": [0, 0, 1, 1], "hbox": [0, 0, 0, 0], "vbox": [0, 0, 1, 1]}, {"tag": "person", "fbox": [0, 0, 1, 1], "hbox": [0, 0, 0, 0], "vbox": [0, 0, 1, 1], "extra": {"ignore": 1}}]}\n')
    r = detection_sets.crowd_instances(spark, str(tmp_path / "c.odgt")).collect()
    assert [(x["cls"], x["box"], x["ignore"]) for x in r] == [("person", [1.0, 2.0, 4.0, 6.0], False), (None, [0.0, 0.0, 1.0, 1.0], True), (None, [0.0, 0.0, 1.0, 1.0], True)]


def test_captions(spark):
    """The texts of which the meaning is fixed, as literals."""
    one = lambda f, t: spark.createDataFrame([(t,)], "t string").select(f(F.col("t"))).first()[0]
    assert one(texts.neutralised, "A male student wearing a black hijab , and he or she reads HIS book with a beard .") == "A student, and they or they reads their book."
    assert one(texts.without_guesses, "A man reads. He sits, possibly tired.") == "A man reads. He sits."
    assert one(texts.without_guesses, "A man reads. In the room, which seems full.") == "A man reads."
    assert [one(texts.normal_answer, t) for t in ("The two dogs, DONT bark?", "red/blue;", "3.5 m.", "\tan YES.\n")] == ["2 dogs dont bark", "red blue", "3.5 m", "yes"]


def test_annotated(spark):
    manifest = spark.createDataFrame([(f"f{i}", i, "read", "x") for i in range(5)], "name string, t int, cue string, __status string")
    log = spark.createDataFrame([("f0", 1, "ok", "call"), ("f0", 2, "uncertain", None), ("f1", 1, "ok", "call"), ("f1", 2, "rejected", "rest"), ("f2", 1, "skipped", "rest"), ("f3", 1, "ok", "rest"), ("f9", 1, "ok", "rest")], "name string, seq int, status string, cue string")
    got = {r["name"]: (r["cue"], r["source"]) for r in systems.annotated(manifest.drop("__status"), log, "name", ["seq"], ["cue"]).collect()}
    assert got == {"f0": ("read", "human"), "f2": ("read", "pseudo"), "f3": ("rest", "human"), "f4": ("read", "pseudo")}
