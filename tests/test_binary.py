import numpy as np
from pyspark.sql import functions as F

from lumivox import grid
from lumivox.sources import binary


def test_images_round_trip(spark, data, tmp_path):
    few = grid.pixels(spark, data).where("image_id < 3")
    for row in binary.encoded(few, "image_id", ("y", "x"), (8, 8)).collect():
        (tmp_path / f"{row.image_id}.im").write_bytes(bytes(row.content))
    back = binary.read_images(spark, str(tmp_path / "*.im"))
    assert back.count() == few.count()
    assert abs(back.agg(F.sum("v")).first()[0] - few.agg(F.sum("v")).first()[0]) < 1e-5


def test_volumes_with_and_without_header(spark, tmp_path):
    cube = np.arange(24, dtype="<f4").reshape(2, 3, 4)
    (tmp_path / "a.vol").write_bytes(np.array([2, 3, 4], "<f4").tobytes() + cube.tobytes())
    (tmp_path / "a.raw").write_bytes(cube.tobytes())
    for found in (binary.read_volumes(spark, str(tmp_path / "a.vol")), binary.read_raw_volumes(spark, str(tmp_path / "a.raw"), (2, 3, 4))):
        rows = {(r.z, r.y, r.x): r.v for r in found.collect()}
        assert rows == {tuple(map(int, at)): float(v) for at, v in np.ndenumerate(cube)}


def test_records(spark, tmp_path):
    (tmp_path / "ids.bin").write_bytes(np.arange(8, dtype="<i4").tobytes())
    assert [tuple(r)[1:] for r in binary.read_id_records(spark, str(tmp_path / "ids.bin")).collect()] == [(0, 0, 1, 2, 3), (1, 4, 5, 6, 7)]
    (tmp_path / "p.bin").write_bytes(np.array([(1, *range(9))], binary.PHASE_SPACE).tobytes())
    assert [tuple(r)[1:] for r in binary.read_phase_space(spark, str(tmp_path / "p.bin")).collect()] == [(0, 1, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)]


def test_simulator_text(spark, tmp_path):
    (tmp_path / "c.txt").write_text(" ".join(map(str, range(40))) + "\nshort line\n")
    assert [tuple(r) for r in binary.read_coincidences(spark, str(tmp_path / "c.txt")).collect()] == [(15, 12, 38, 35)]


def test_lines_in_six_files(spark, tmp_path):
    ends = [f"{a}{i}" for i in "12" for a in "xyz"]
    for dtype in ("<u2", "<f4"):
        numbers = {e: (np.arange(50) * (k + 1) + k).astype(dtype) for k, e in enumerate(ends)}
        for e, values in numbers.items():
            (tmp_path / f"lors{dtype[1]}.{e}").write_bytes(values.tobytes())
        for start, stop in ((0, None), (7, 20), (40, 90)):
            found = sorted(tuple(r) for r in binary.read_lines(spark, str(tmp_path / f"lors{dtype[1]}"), dtype, start, stop).collect())
            assert found == [(n, *(numbers[e][n].item() for e in ends)) for n in range(start, min(50, stop or 50))]
    order = spark.createDataFrame([(0, 9), (1, 3), (2, 9)], "place long, n long")
    taken = binary.in_order(binary.read_lines(spark, str(tmp_path / "lorsu")), order).orderBy("place").collect()
    assert [(r.n, r.x1) for r in taken] == [(9, 9), (3, 3), (9, 9)]
