"""Binary files: a sink of named files, arrays in NPZ files, members of zip archives, images and their labels.

Files are read through Spark's binaryFile source, so they may lie in any store that Spark reads; each is one row, with what is
wrong with it as a row of its own (empty files have none: Spark passes over them). The sink writes to a folder that all machines have mounted.
"""

from __future__ import annotations

import io
import itertools
import os
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..operators.frames import starts, whole_groups

#: Bytes of members that come to one batch.
BATCH_BYTES = 16 << 20
#: Bytes of NPZ files that come to one archive.
ARCHIVE_BYTES = 4 << 20


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _FilesWriter(DataSourceArrowWriter):
    """Each row's content goes to a file of its own under a hidden name, which it loses when all tasks are through."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        done = []
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                to = os.path.join(self.folder, name)
                os.makedirs(os.path.dirname(to), exist_ok=True)
                hidden = os.path.join(os.path.dirname(to), f".{os.path.basename(to)}.{uuid.uuid4().hex}")
                with open(hidden, "wb") as f:
                    f.write(content or b"")
                done.append((hidden, to))
        return _Written(done)

    def commit(self, messages) -> None:
        for m in messages:
            for hidden, to in m.files if m else ():
                os.replace(hidden, to)

    def abort(self, messages) -> None:
        for m in messages:
            for hidden, _ in m.files if m else ():
                if os.path.exists(hidden):
                    os.remove(hidden)


class NamedFiles(DataSource):
    """Sink of rows (name, content): binary files of these names in the folder `path`."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _FilesWriter(self.options["path"].removeprefix("file://"))


def write_files(rows: DataFrame, folder: str) -> None:
    """rows(name, content) as files of a folder that all machines share; files of equal names are replaced."""
    rows.sparkSession.dataSource.register(NamedFiles)
    rows.select("name", "content").write.format("named_files").mode("append").save(folder)


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)


def pack_arrays(rows: DataFrame, key: list[str], order: list[str], arrays: dict[str, str], name: Column, archive: str | None = None) -> DataFrame:
    """(name, content) of an NPZ file for each key: of each of arrays (name in the file: column, a number) the values in order. One key's rows are one file,
    and so in memory. With archive, NPZ files of small keys come many in one uncompressed zip file, <archive>-<task>-<number>.zip, of some ARCHIVE_BYTES."""
    kept = rows.select(*key, *order, *[F.col(c).alias(f"v_{a}") for a, c in arrays.items()], name.alias("file"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_turn = kept.repartition(tasks, *key).sortWithinPartitions(*key, *[F.asc_nulls_last(c) for c in order])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        for table in whole_groups(batches, key):
            column = {c: table.column(c).combine_chunks() for c in table.column_names}
            for a, b in itertools.pairwise([*np.flatnonzero(starts([column[k] for k in key])).tolist(), table.num_rows]):
                out = io.BytesIO()
                np.savez(out, **{c: column[f"v_{c}"].slice(a, b - a).to_numpy(zero_copy_only=False) for c in arrays})
                yield column["file"][a].as_py(), out.getvalue()

    def zipped(found: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, bytes]]:
        for n in itertools.count():
            one = next(found, None)
            if one is None:
                return
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                while one is not None:
                    z.writestr(*one)
                    one = next(found, None) if out.tell() < ARCHIVE_BYTES else None
            yield f"{archive}-{TaskContext.get().partitionId():05d}-{n:05d}.zip", out.getvalue()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, c in zipped(packed(batches)) if archive else packed(batches):
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.string()), pa.array([c], pa.binary())], ["name", "content"])

    return in_turn.mapInArrow(run, "name string, content binary")


def read_arrays(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """(file, name, shape, values, problem) of each array of the NPZ files under a path, those in zip files too, or of those with the given names only; values as
    doubles, in row-major order. A file that can't be read, and an array that holds no numbers, is one row with its problem."""
    kinds = {"file": pa.string(), "name": pa.string(), "shape": pa.list_(pa.int64()), "values": pa.list_(pa.float64()), "problem": pa.string()}
    broken = (ValueError, OSError, zipfile.BadZipFile, EOFError, NotImplementedError)
    told = lambda e: f"{type(e).__name__}: {e}"

    def arrays(file: str, content: bytes) -> Iterator[tuple]:
        try:
            with np.load(io.BytesIO(content), allow_pickle=False) as found:
                for n in found.files:
                    if names is not None and n not in names:
                        continue
                    try:
                        a = found[n]
                        yield file, n, list(a.shape), a.astype(np.float64).ravel(), None
                    except (ValueError, TypeError, zipfile.BadZipFile) as e:
                        yield file, n, None, None, told(e)
        except broken as e:
            yield file, None, None, None, told(e)

    def members(file: str, content: bytes) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for m in z.infolist():
                    if m.filename.endswith(".npz"):
                        name = m.filename.rsplit("/", 1)[-1]
                        try:
                            one = z.read(m)
                        except broken as e:
                            yield name, None, None, None, told(e)
                        else:
                            yield from arrays(name, one)
        except broken as e:
            yield file, None, None, None, told(e)

    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for file, content in zip(*batch.columns, strict=True):
                for row in (members if file.as_py().endswith(".zip") else arrays)(file.as_py(), content.as_py()):
                    rows.append(row)
                    size += 100 + (0 if row[3] is None else row[3].nbytes)
                    if size > BATCH_BYTES:
                        yield pack(rows)
                        rows, size = [], 0
        if rows:
            yield pack(rows)

    files = _files(spark, path, "*.{npz,zip}").select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.mapInArrow(run, "file string, name string, shape array<long>, values array<double>, problem string")


def pack_members(rows: DataFrame, archive: str, member: str, content: str, most: int | None = None) -> DataFrame:
    """(name, content) of an uncompressed zip file for each archive, its members by name. One file is in memory: with most, an archive comes in parts of
    about so many members at most, <name>-<number>.<suffix>, dealt by the members' names."""
    kept = rows.select(F.col(archive).alias("name"), F.col(member).alias("member"), F.col(content).cast("binary").alias("content"))
    if most is not None:
        parts = kept.groupBy("name").agg(F.ceil(F.count("*") / most).alias("parts"))
        number = F.lpad(F.pmod(F.xxhash64("member"), F.col("parts")).cast("string"), 8, "0")
        kept = kept.join(F.broadcast(parts), "name").withColumn("name", F.concat(F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 1), F.lit("-"), number, F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 2))).drop("parts")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for m, c in sorted(zip(frame["member"], frame["content"], strict=True)):
                z.writestr(m, c or b"")
        return pd.DataFrame({"name": [frame["name"].iloc[0]], "content": [out.getvalue()]})

    return kept.groupBy("name").applyInPandas(run, "name string, content binary")


def whole_archive(name: Column) -> Column:
    """The archive's name of a part of pack_members(most=)."""
    return F.regexp_replace(name, r"-\d{8,}(\.[^.]*)?$", "$1")


def read_members(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(archive, member, content, problem) of the members of the zip files under a path whose name ends in suffix. An archive or member that is corrupt is
    one row with its problem; the others come out all the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.binary(), pa.string()]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["archive", "member", "content", "problem"])
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, size = [], 0
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for m in z.infolist():
                            if m.is_dir() or not m.filename.endswith(suffix):
                                continue
                            try:
                                rows.append((archive, m.filename, z.read(m), None))
                                size += m.file_size
                            except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError) as e:
                                rows.append((archive, m.filename, None, f"{type(e).__name__}: {e}"))
                            if size > BATCH_BYTES:
                                yield pack(rows)
                                rows, size = [], 0
                except (zipfile.BadZipFile, OSError, ValueError) as e:
                    rows.append((archive, None, None, f"{type(e).__name__}: {e}"))
                if rows:
                    yield pack(rows)

    files = _files(spark, path, "*.zip").select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")
    return files.mapInArrow(run, "archive string, member string, content binary, problem string")


def _heads(found: DataFrame, path: Column, length: Column, *more: str) -> DataFrame:
    head = lambda at, n: F.substring("content", at, n)
    number = lambda at: F.conv(F.hex(head(at, 4)), 16, 10).cast("int")
    kind = F.when(F.hex(head(1, 8)) == "89504E470D0A1A0A", "png").when(F.hex(head(1, 3)) == "FFD8FF", "jpeg")
    part = lambda i: F.try_element_at(F.split(path, "/"), F.lit(i))
    rows = found.select(part(-1).alias("file"), part(-2).alias("folder"), length.alias("bytes"), kind.alias("kind"), number(17).alias("w"), number(21).alias("h"), *more)
    png = F.col("kind") == "png"
    return rows.select("file", "folder", "bytes", "kind", F.when(png, F.col("w")).alias("width"), F.when(png, F.col("h")).alias("height"), *more)


def images(spark: SparkSession, path: str) -> DataFrame:
    """(file, folder, bytes, kind, width, height) of the files under a path, by what their first bytes say: png or jpeg; kind is null for others. The
    size is read for PNG."""
    return _heads(_files(spark, path, "*"), F.col("path"), F.col("length"))


def archived_images(spark: SparkSession, path: str) -> DataFrame:
    """images() of the members of the zip files under a path, folders within the archives; with problem, what is wrong with an archive or member. Many
    small files take little disk so."""
    return _heads(read_members(spark, path), F.col("member"), F.length("content"), "problem")


def labelled_images(found: DataFrame, labels: DataFrame, path: str) -> DataFrame:
    """found(file, ...) with the columns of labels whose path ends in the file's name (of several the one with the largest path); images without a
    label go, and so do labels without an image."""
    key = F.element_at(F.split(path, "/"), -1)
    one = labels.withColumn("__file", key).groupBy("__file").agg(F.max_by(F.struct(*[c for c in labels.columns if c not in found.columns]), F.col(path)).alias("__label"))
    return found.join(one, F.col("file") == F.col("__file")).select(*found.columns, "__label.*")
