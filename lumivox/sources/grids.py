"""Data source of dense images and volumes: files are read by slabs, and written one per key.

A file holds its sizes as numbers of its own type in front (``header``) and then its
samples, the last axis fastest. Tasks get slabs along the first axis of a large file, or
many small files; planning reads the headers of large files only. To write, rows of a key must follow each other: one grid at a time is
in memory, absent samples are 0, and files appear when all tasks are done.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from lumivox.sources.files import Folder, Written, found, place

#: Bytes of a slab, about; what opening a file counts for where small files share a task; samples of an Arrow batch, about.
SLAB_BYTES, OPEN_BYTES, SAMPLES = 8 << 20, 16 << 10, 1 << 16


@dataclass
class Slab(InputPartition):
    """Planes ``start`` up to ``stop`` of a file."""

    name: str
    shape: tuple[int, ...]
    start: int
    stop: int


@dataclass
class Files(InputPartition):
    """Files of a folder that are read as a whole, one after the other."""

    folder: str
    names: list[str]


def batches_of(planes: Iterator[tuple[str, int, tuple[int, ...], np.ndarray]], axes: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """(path, axes.., v) of (file, first plane, sizes, values): parts follow each other until they make a batch."""
    names, counts, columns, rows, known = [], [], [], 0, {}

    def batch() -> pa.RecordBatch:
        path = pa.array(names, pa.string()).take(pa.array(np.repeat(np.arange(len(names)), counts)))
        arrays = [pa.array(np.concatenate(c)) for c in zip(*columns)]
        return pa.RecordBatch.from_arrays([path, *arrays], ["path", *axes, "v"])

    for name, first, shape, values in planes:
        if not len(values):
            continue
        if shape not in known:
            known = {shape: [p.ravel().astype(np.int32) for p in np.indices(shape)]}
        z, *others = known[shape]
        names.append(name)
        counts.append(len(values))
        columns.append((z + np.int32(first), *others, values.astype(np.float64)))
        rows += len(values)
        if rows >= SAMPLES:
            yield batch()
            names, counts, columns, rows = [], [], [], 0
    if rows:
        yield batch()


class GridReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.axes = options["path"], options["axes"].split(",")
        self.dtype, self.header = np.dtype(options.get("dtype", "<f4")), options.get("header", "true") == "true"
        self.shape = tuple(map(int, options["shape"].split(","))) if "shape" in options else None
        self.slab = int(options.get("slab", SLAB_BYTES))
        if not self.header and self.shape is None:
            raise ValueError("files without a header need a shape")

    def _shape(self, front: bytes, size: int, name: str) -> tuple[int, ...]:
        """Sizes of a file of ``size`` bytes that begins with ``front``."""
        shape, head = self.shape, len(self.axes) if self.header else 0
        if self.header:
            known = min(len(front) // self.dtype.itemsize, head)
            shape = tuple(int(x) for x in np.frombuffer(front, self.dtype, known))
        if len(shape) != len(self.axes) or min(shape) < 0 or size != (head + int(np.prod(shape))) * self.dtype.itemsize:
            raise ValueError(f"{name} has {size // self.dtype.itemsize - head} samples where its sizes are {shape}")
        return shape

    def partitions(self) -> Sequence[InputPartition]:
        """Large files by slabs; smaller ones share a task, which finds their sizes as it reads them."""
        store, _ = place(self.path)
        out: list[InputPartition] = []
        names, held = [], 0
        for info in found(self.path):
            folder, _, base = info.path.rpartition("/")
            if info.size <= self.slab:
                if names and held + info.size + OPEN_BYTES > self.slab:
                    out.append(Files(folder, names))
                    names, held = [], 0
                names.append(base)
                held += info.size + OPEN_BYTES
                continue
            with store.open_input_file(info.path) as f:
                shape = self._shape(f.read_at(len(self.axes) * self.dtype.itemsize, 0) if self.header else b"", info.size, info.path)
            planes = max(1, self.slab // max(1, int(np.prod(shape[1:])) * self.dtype.itemsize))
            out += [Slab(info.path, shape, at, min(at + planes, shape[0])) for at in range(0, shape[0], planes)]
        if names:
            out.append(Files(folder, names))
        return out or [Files("", [])]

    def read(self, partition: Slab | Files) -> Iterator[pa.RecordBatch]:
        store, _ = place(self.path)
        yield from batches_of(self._whole(store, partition) if isinstance(partition, Files) else self._slab(store, partition), self.axes)

    def _whole(self, store, files: Files) -> Iterator[tuple[str, int, tuple[int, ...], np.ndarray]]:
        for base in files.names:
            name = f"{files.folder}/{base}"
            with store.open_input_file(name) as f:
                data = f.read()
            shape = self._shape(data, len(data), name)
            values, plane = np.frombuffer(data, self.dtype, offset=len(self.axes) * self.dtype.itemsize if self.header else 0), int(np.prod(shape[1:]))
            step = max(1, SAMPLES // max(1, plane))
            for z in range(0, shape[0], step):
                part = values[z * plane : (z + step) * plane]
                yield name, z, (min(step, shape[0] - z), *shape[1:]), part

    def _slab(self, store, slab: Slab) -> Iterator[tuple[str, int, tuple[int, ...], np.ndarray]]:
        plane = int(np.prod(slab.shape[1:]))
        front = len(self.axes) if self.header else 0
        with store.open_input_file(slab.name) as f:
            for z in range(slab.start, slab.stop):
                data = f.read_at(plane * self.dtype.itemsize, (front + z * plane) * self.dtype.itemsize)
                yield slab.name, z, (1, *slab.shape[1:]), np.frombuffer(data, self.dtype)


class GridWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.axes, self.key, self.overwrite = options["axes"].split(","), options["key"], overwrite
        self.shape = tuple(map(int, options["shape"].split(",")))
        self.dtype, self.header, self.suffix = np.dtype(options.get("dtype", "<f4")), options.get("header", "true") == "true", options.get("suffix", "")
        self.folder = Folder(options["path"])
        if len(self.shape) != len(self.axes):
            raise ValueError("shape and axes must have the same length")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        key, cube, seen = None, None, set()
        with self.folder.task() as (_, done, _):
            for batch in iterator:
                keys = batch.column(self.key)
                if keys.null_count:
                    raise ValueError(f"{self.key} is missing somewhere")
                names = keys.to_pylist()
                cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
                columns = [batch.column(a).to_numpy(zero_copy_only=False) for a in (*self.axes, "v")]
                for a, b in zip(cuts[:-1], cuts[1:]):
                    if a == b:
                        continue
                    if names[a] != key:
                        if cube is not None:
                            self._store(done, key, cube)
                        if names[a] in seen:
                            raise ValueError(f"rows of {names[a]} don't follow each other")
                        key, cube = names[a], np.zeros(self.shape, self.dtype)
                        seen.add(key)
                    at = tuple(c[a:b] for c in columns[:-1])
                    if any(len(x) and (x.min() < 0 or x.max() >= n) for x, n in zip(at, self.shape)):
                        raise ValueError(f"{key} has samples outside {self.shape}")
                    cube[at] = columns[-1][a:b]
            if cube is not None:
                self._store(done, key, cube)
        return done

    def _store(self, done: Written, key: object, cube: np.ndarray) -> None:
        name = str(key)
        if "/" in name or name[:1] in ("", ".", "_"):
            raise ValueError(f"{name!r} can't be a file's name")
        with self.folder.new(done, f"{name}{self.suffix}") as f:
            if self.header:
                f.write(np.array(self.shape, self.dtype).tobytes())
            f.write(cube.tobytes())

    def commit(self, messages: list[Written | None]) -> None:
        self.folder.publish(messages, self.overwrite, (self.suffix,))

    def abort(self, messages: list[Written | None]) -> None:
        self.folder.discard()


class Grids(DataSource):
    """Options: path, axes, header, shape, dtype; to read also slab (bytes a task), to write key and suffix."""

    @classmethod
    def name(cls) -> str:
        return "grids"

    def schema(self) -> str:
        return "path string, " + ", ".join(f"`{a}` int" for a in self.options["axes"].split(",")) + ", v double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return GridReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> GridWriter:
        return GridWriter(self.options, overwrite)


def read_grids(spark: SparkSession, path: str, axes: tuple[str, ...], shape: tuple[int, ...] | None = None, dtype: str = "<f4", slab: int = SLAB_BYTES) -> DataFrame:
    """(path, axes.., v) of all files of a folder, a pattern or one file; with ``shape`` they have no header."""
    spark.dataSource.register(Grids)
    options = {"path": path, "axes": ",".join(axes), "dtype": dtype, "slab": str(slab), "header": str(shape is None).lower()}
    if shape is not None:
        options["shape"] = ",".join(map(str, shape))
    return spark.read.format("grids").options(**options).load()


def write_grids(samples: DataFrame, path: str, key: str, axes: tuple[str, ...], shape: tuple[int, ...], suffix: str, header: bool = True, dtype: str = "<f4", mode: str = "append") -> None:
    """One file path/key.suffix per key; a key's samples meet in one task, one key after the other."""
    samples.sparkSession.dataSource.register(Grids)
    rows = samples.select(key, *axes, "v").repartition(key).sortWithinPartitions(key, *axes)
    options = {"path": path, "key": key, "axes": ",".join(axes), "shape": ",".join(map(str, shape)), "suffix": suffix, "header": str(header).lower(), "dtype": dtype}
    rows.write.format("grids").options(**options).mode(mode).save()
