"""Splittable sources and sinks that appear whole: records, list-mode lines, images and volumes."""

import os
from pathlib import Path

import numpy as np
import pyarrow.fs as fs
import pytest
from pyspark.sql import functions as F

from lumivox import grid
from lumivox.sources import binary, grids, records

ENDS = records.LINE_ENDS
LINE_FIELDS = records.fields_of(dict.fromkeys(ENDS, "<u2"))


@pytest.fixture
def lines(spark, data):
    return grid.lors(spark, data).withColumnRenamed("lor_id", "n").select("n", *ENDS)


def as_rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_lines_round_trip_over_many_splits(spark, lines, tmp_path):
    folder = str(tmp_path / "lors")
    records.write_lines(lines.repartition(5), folder, "n", parts=4)
    groups = {p.name.rsplit(".", 1)[0] for p in Path(folder).iterdir()}
    assert len(groups) > 1 and all((Path(folder) / f"{g}.{e}").exists() for g in groups for e in ENDS)
    back = records.read_lines(spark, folder, split=37)
    assert back.rdd.getNumPartitions() > 20
    assert as_rows(back) == as_rows(lines)
    assert as_rows(records.read_lines(spark, folder, start=100, stop=300, split=41)) == as_rows(lines.where("n BETWEEN 100 AND 299"))


def test_conditions_on_numbers_prune_ranges(spark, lines, tmp_path):
    folder = str(tmp_path / "lors")
    records.write_lines(lines, folder, "n")
    back = records.read_lines(spark, folder, split=10)
    assert as_rows(back.where("n >= 95 AND n < 105 AND x1 > 3")) == as_rows(lines.where("n >= 95 AND n < 105 AND x1 > 3"))
    assert back.where("n >= 95 AND n < 105").rdd.getNumPartitions() <= 3
    assert as_rows(back.where("n = 7")) == as_rows(lines.where("n = 7"))
    assert back.where("n < 0").count() == 0 and back.where("n > 1000000").count() == 0


def test_reads_touch_their_bytes_only(tmp_path, monkeypatch):
    for e in ENDS:
        (tmp_path / f"l.{e}").write_bytes(np.arange(1000, dtype="<u2").tobytes())
    asked, opened = [], fs.LocalFileSystem.open_input_file

    class Recorded:
        def __init__(self, file):
            self.file = file

        def read_at(self, size, at):
            asked.append((at, size))
            return self.file.read_at(size, at)

        def close(self):
            self.file.close()

    class Store:
        def open_input_file(self, name):
            return Recorded(opened(fs.LocalFileSystem(), name))

        def get_file_info(self, names):
            return fs.LocalFileSystem().get_file_info(names)

    monkeypatch.setattr(records, "place", lambda path: (Store(), path))
    reader = records.RecordReader({"path": str(tmp_path / "l"), "fields": LINE_FIELDS, "zipped": "true", "split": "100", "start": "250", "stop": "450"})
    parts = list(reader.partitions())
    assert not asked and [(p.start, p.stop) for p in parts] == [(250, 350), (350, 450)]
    found = list(reader.read(parts[1]))
    assert set(asked) == {(700, 200)} and len(asked) == len(ENDS)
    assert found[0].column("n").to_pylist() == list(range(350, 450))


def test_large_files_are_planned_without_reading(tmp_path):
    for name, size in (("big.x", 3 << 30), ("big.y", 3 << 29)):
        with open(tmp_path / name, "wb") as f:
            os.truncate(f.fileno(), size)
    reader = records.RecordReader({"path": str(tmp_path / "big"), "fields": "x:<u2,y:<u1", "zipped": "true"})
    parts = reader.partitions()
    assert sum(p.stop - p.start for p in parts) == 3 << 29 and len(parts) > 100
    assert next(reader.read(parts[-1])).column("n")[0].as_py() == parts[-1].start
    shape = (600, 1024, 1024)
    with open(tmp_path / "big.vol", "wb") as f:
        f.write(np.array(shape, "<f4").tobytes())
        os.truncate(f.fileno(), 4 * (3 + 600 * 1024 * 1024))
    slabs = grids.GridReader({"path": str(tmp_path / "big.vol"), "axes": "z,y,x"}).partitions()
    assert len(slabs) == 300 and all(s.stop - s.start == 2 for s in slabs)


def test_rows_that_a_file_lacks_are_none(spark, tmp_path):
    for k, e in enumerate(ENDS):
        (tmp_path / f"l.{e}").write_bytes(np.arange(10 + k, dtype="<u2").tobytes() + b"x")
    assert as_rows(records.read_lines(spark, str(tmp_path / "l"))) == [(n, *[n] * 6) for n in range(10)]
    assert records.read_lines(spark, str(tmp_path / "none")).count() == 0


def test_values_out_of_range_are_refused(spark, tmp_path):
    for value in (70000, -1, None):
        with pytest.raises(Exception, match="beyond|missing values"):
            records.write_records(spark.createDataFrame([(value,)], "x int"), str(tmp_path / "r"), "x:<u2")
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_appended_and_overwritten_records(spark, tmp_path):
    folder, rows = str(tmp_path / "r"), lambda *x: spark.createDataFrame([(i,) for i in x], "x int")
    records.write_records(rows(1, 2, 3).coalesce(1), folder, "x:<i4")
    records.write_records(rows(9).coalesce(1), folder, "x:<i4")
    assert as_rows(records.read_records(spark, folder, "x:<i4")) == [(0, 1), (1, 2), (2, 3), (3, 9)]
    records.write_records(rows(5).coalesce(1), folder, "x:<i4", mode="overwrite")
    assert as_rows(records.read_records(spark, folder, "x:<i4")) == [(0, 5)]


def test_images_and_volumes_byte_for_byte(spark, data, tmp_path):
    volumes = grid.voxels(spark, data)
    for header, suffix in ((True, ".vol"), (False, ".raw")):
        folder = tmp_path / suffix[1:]
        grids.write_grids(volumes, str(folder), "volume_id", ("z", "y", "x"), (8, 8, 8), suffix, header)
        cubes = {}
        for r in volumes.collect():
            cubes.setdefault(r.volume_id, np.zeros((8, 8, 8), "<f4"))[r.z, r.y, r.x] = r.v
        front = np.array((8, 8, 8), "<f4").tobytes() if header else b""
        assert {p.name: p.read_bytes() for p in folder.iterdir()} == {f"{k}{suffix}": front + c.tobytes() for k, c in cubes.items()}
        read = binary.read_volumes(spark, str(folder)) if header else binary.read_raw_volumes(spark, str(folder), (8, 8, 8))
        assert read.count() == 512 * len(cubes)
        assert abs(read.agg(F.sum("v")).first()[0] - volumes.agg(F.sum("v")).first()[0]) < 1e-6
    slabs = grids.read_grids(spark, str(tmp_path / "vol" / "3.vol"), ("z", "y", "x"), slab=2 * 64 * 4)
    assert slabs.rdd.getNumPartitions() == 4 and slabs.count() == 512


def test_a_failed_job_leaves_no_file(spark, data, tmp_path):
    bad = grid.pixels(spark, data).withColumn("x", F.when(F.col("image_id") == 77, 99).otherwise(F.col("x")))
    with pytest.raises(Exception, match="outside"):
        grids.write_grids(bad, str(tmp_path / "im"), "image_id", ("y", "x"), (8, 8), ".im")
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]
    with pytest.raises(Exception, match="follow each other"):
        spark.range(6).selectExpr("id % 2 AS k", "0 AS y", "0 AS x", "1.0D AS v").coalesce(1).write.format("grids").options(path=str(tmp_path / "k"), key="k", axes="y,x", shape="8,8", suffix=".im").mode("append").save()
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_a_wrong_header_is_an_error(spark, tmp_path):
    (tmp_path / "a.im").write_bytes(np.array([2, 3, 1, 1], "<f4").tobytes())
    with pytest.raises(Exception, match="2 samples"):
        binary.read_images(spark, str(tmp_path / "a.im")).count()


def test_small_files_share_tasks_and_batches(spark, tmp_path):
    places, expected = [(y, x) for y in range(2) for x in range(3)], set()
    for k in range(600):
        values = np.arange(6, dtype="<f4") + k
        (tmp_path / f"{k}.im").write_bytes(np.array([2, 3], "<f4").tobytes() + values.tobytes())
        expected |= {(f"{k}.im", y, x, float(v)) for (y, x), v in zip(places, values)}
    large = np.arange(15000, dtype="<f4").reshape(5000, 3)
    (tmp_path / "large.im").write_bytes(np.array([5000, 3], "<f4").tobytes() + large.tobytes())
    (tmp_path / "none.im").write_bytes(np.array([0, 3], "<f4").tobytes())
    expected |= {("large.im", y, x, float(v)) for (y, x), v in np.ndenumerate(large)}
    reader = grids.GridReader({"path": str(tmp_path), "axes": "y,x"})
    parts = reader.partitions()
    assert len(parts) == 2 and [len(x.names) for x in parts] == [511, 91]
    assert all(len(list(reader.read(p))) == 1 for p in parts)
    assert len(grids.GridReader({"path": str(tmp_path), "axes": "y,x", "slab": "6000"}).partitions()) > 600
    for slab in (grids.SLAB_BYTES, 6000):
        found = grids.read_grids(spark, str(tmp_path), ("y", "x"), slab=slab).collect()
        assert len(found) == len(expected) and {(Path(r.path).name, r.y, r.x, r.v) for r in found} == expected


@pytest.mark.parametrize("content", [b"", b"ab", np.array([2], "<f4").tobytes(), np.array([2, 3] + [0] * 5, "<f4").tobytes(), np.array([-1, 3], "<f4").tobytes()])
def test_files_that_are_cut_are_an_error(spark, tmp_path, content):
    (tmp_path / "a.im").write_bytes(np.array([1, 1, 5], "<f4").tobytes())
    (tmp_path / "b.im").write_bytes(content)
    with pytest.raises(Exception, match="samples where its sizes are"):
        binary.read_images(spark, str(tmp_path)).count()
