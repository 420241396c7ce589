"""Data source of fixed-length records: ranges of rows are read apart, and only their bytes.

``fixed_records`` reads files of packed records, or (``zipped``) groups of files
with one field each, such as list-mode lines in six files base.x1 .. base.z2. Rows are
numbered through all files in the order of their names; tasks get ranges of rows,
and conditions on the number ``n`` cut the ranges before anything is read.
Integers of up to 16 bits and signed ones of 32 come as int, other integers as long,
floats as double.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from lumivox.sources.files import Folder, Written, listed, place

#: Bytes of records that a task gets, about, and rows that it reads at a time.
SPLIT_BYTES, STEP_ROWS = 32 << 20, 1 << 17
LINE_ENDS = tuple(f"{a}{i}" for i in "12" for a in "xyz")


def layout(options: dict[str, str]) -> np.dtype:
    """The record's type from ``fields``, as in ``x:<u2,y:<f4``; fields whose names begin with _ are passed over."""
    return np.dtype([tuple(x.strip() for x in f.split(":")) for f in options["fields"].split(",")])


def kept(dtype: np.dtype) -> list[str]:
    return [name for name in dtype.names if not name.startswith("_")]


def spark_type(kind: np.dtype) -> str:
    if kind.kind == "f":
        return "double"
    return "int" if kind.itemsize < 4 or kind == np.dtype("<i4") else "long"


ARROW = {"double": pa.float64(), "int": pa.int32(), "long": pa.int64()}


@dataclass
class Rows(InputPartition):
    """Rows ``start`` up to ``stop`` of one file or group of files; ``first`` is the number of its first row."""

    base: str
    start: int
    stop: int
    first: int


class RecordReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.dtype, self.path, self.zipped = layout(options), options["path"], options.get("zipped", "false") == "true"
        self.start, self.stop = int(options.get("start", 0)), int(options["stop"]) if "stop" in options else None
        self.split = int(options.get("split", max(1, SPLIT_BYTES // self.dtype.itemsize)))
        self.named = options.get("named", "false") == "true"
        if self.split < 1 or self.start < 0:
            raise ValueError("split must be positive, start must not be negative")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds on ``n`` become bounds of the ranges; Spark applies what is left."""
        for f in filters:
            at = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("n",) or not isinstance(at, int):
                yield f
            elif isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.start = max(self.start, at + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    upto = at + (not isinstance(f, LessThan))
                    self.stop = upto if self.stop is None else min(self.stop, upto)
            else:
                yield f

    def _bases(self) -> list[str]:
        if not self.zipped:
            return listed(self.path)
        end = f".{self.dtype.names[0]}"
        return [x.removesuffix(end) for x in listed(self.path, end) or listed(self.path + end)]

    def partitions(self) -> Sequence[InputPartition]:
        """Ranges of rows; sizes of files are asked for, nothing is read. A row that one of a group's files lacks is none."""
        store, _ = place(self.path)
        first, out = 0, []
        for base in self._bases():
            files = [(f"{base}.{name}", self.dtype[name].itemsize) for name in self.dtype.names] if self.zipped else [(base, self.dtype.itemsize)]
            infos = store.get_file_info([name for name, _ in files])
            rows = min((info.size or 0) // width for info, (_, width) in zip(infos, files))
            low, high = max(0, self.start - first), rows if self.stop is None else min(rows, self.stop - first)
            out += [Rows(base, at, min(at + self.split, high), first) for at in range(low, high, self.split)]
            first += rows
        return out or [Rows("", 0, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if partition.start >= partition.stop:
            return
        store, _ = place(self.path)
        names = kept(self.dtype)
        files = {name: store.open_input_file(f"{partition.base}.{name}") for name in names} if self.zipped else {"": store.open_input_file(partition.base)}
        try:
            for at in range(partition.start, partition.stop, STEP_ROWS):
                rows = min(STEP_ROWS, partition.stop - at)
                if self.zipped:
                    columns = [self._part(files[name], self.dtype[name], at, rows) for name in names]
                else:
                    packed = self._part(files[""], self.dtype, at, rows)
                    columns = [np.ascontiguousarray(packed[name]) for name in names]
                arrays = [pa.array(np.arange(at, at + rows) + partition.first)]
                arrays += [pa.array(x.astype(x.dtype.newbyteorder("="))).cast(ARROW[spark_type(self.dtype[name])]) for name, x in zip(names, columns)]
                if self.named:
                    arrays.append(pa.array([partition.base] * rows, pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, ["n", *names, *["path"] * self.named])
        finally:
            for f in files.values():
                f.close()

    @staticmethod
    def _part(file, dtype: np.dtype, at: int, rows: int) -> np.ndarray:
        data = file.read_at(rows * dtype.itemsize, at * dtype.itemsize)
        if len(data) != rows * dtype.itemsize:
            raise OSError("a file became shorter while it was read")
        return np.frombuffer(data, dtype)


class RecordWriter(DataSourceArrowWriter):
    """One file, or one group of files, per task; names keep the order of tasks, and later jobs' files follow earlier ones'."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.dtype, self.zipped, self.overwrite = layout(options), options.get("zipped", "false") == "true", overwrite
        self.suffix = options.get("suffix", "" if self.zipped else ".bin")
        self.folder = Folder(options["path"])
        before = [] if overwrite else [int(x.rpartition("/")[2].split("-")[1]) for x in listed(options["path"]) if x.rpartition("/")[2].startswith("part-")]
        self.turn = max(before, default=-1) + 1

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        name = f"part-{self.turn:05d}-{TaskContext.get().partitionId():06d}{self.suffix}"
        with self.folder.task() as (opened, done, _):
            files = {}
            for batch in iterator:
                columns = {c: self._fitting(batch, c) for c in self.dtype.names}
                if self.zipped:
                    for c, values in columns.items():
                        if c not in files:
                            files[c] = opened.enter_context(self.folder.new(done, f"{name}.{c}"))
                        files[c].write(values.astype(self.dtype[c]).tobytes())
                else:
                    rows = np.zeros(batch.num_rows, self.dtype)
                    for c, values in columns.items():
                        rows[c] = values
                    if "" not in files:
                        files[""] = opened.enter_context(self.folder.new(done, name))
                    files[""].write(rows.tobytes())
        return done

    def _fitting(self, batch: pa.RecordBatch, name: str) -> np.ndarray:
        """A column's numbers; those that the field can't hold are an error. Fields without a column are 0."""
        if name not in batch.schema.names:
            return np.zeros(batch.num_rows, self.dtype[name])
        column = batch.column(name)
        if column.null_count:
            raise ValueError(f"{name} has missing values, which the format can't hold")
        values = column.to_numpy(zero_copy_only=False)
        if self.dtype[name].kind in "iu":
            limits = np.iinfo(self.dtype[name])
            if len(values) and (values.min() < limits.min or values.max() > limits.max):
                raise ValueError(f"{name} has values beyond {limits.dtype}")
        return values

    def commit(self, messages: list[Written | None]) -> None:
        self.folder.publish(messages, self.overwrite, tuple(f".{c}" for c in self.dtype.names) if self.zipped else (self.suffix,))

    def abort(self, messages: list[Written | None]) -> None:
        self.folder.discard()


class FixedRecords(DataSource):
    """Options: path, fields, zipped, start, stop, split (rows a task), named (also the file's path); to write also suffix."""

    @classmethod
    def name(cls) -> str:
        return "fixed_records"

    def schema(self) -> str:
        dtype = layout(self.options)
        named = ", path string" if self.options.get("named", "false") == "true" else ""
        return "n long, " + ", ".join(f"`{name}` {spark_type(dtype[name])}" for name in kept(dtype)) + named

    def reader(self, schema: StructType) -> DataSourceReader:
        return RecordReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options, overwrite)


def fields_of(dtype: np.dtype | dict[str, str]) -> str:
    """The ``fields`` option of a record type."""
    return ",".join(f"{c}:{dtype[c]}" for c in dtype) if isinstance(dtype, dict) else ",".join(f"{c}:{dtype[c].str}" for c in dtype.names)


def read_records(spark: SparkSession, path: str, fields: str, **options: object) -> DataFrame:
    """(n, fields..) of packed or zipped records."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FixedRecords)
    given = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items() if v is not None}
    return spark.read.format("fixed_records").options(path=path, fields=fields, **given).load()


def write_records(rows: DataFrame, path: str, fields: str, order: str | None = None, mode: str = "append", parts: int | None = None, **options: object) -> None:
    """Write rows, by ranges of ``order`` if given (``parts`` of them, or as Spark sees fit), so that their order in the files is that of the column."""
    rows.sparkSession.dataSource.register(FixedRecords)
    if order:
        rows = rows.repartitionByRange(*([parts] if parts else []), order).sortWithinPartitions(order)
    given = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}
    rows.write.format("fixed_records").options(path=path, fields=fields, **given).mode(mode).save()


def read_lines(spark: SparkSession, base: str, dtype: str = "<u2", start: int = 0, stop: int | None = None, split: int | None = None) -> DataFrame:
    """(n, x1, y1, z1, x2, y2, z2): lines ``start`` up to ``stop`` of list-mode data in six files base.x1 .. base.z2, or a folder of such groups."""
    return read_records(spark, base, fields_of(dict.fromkeys(LINE_ENDS, dtype)), zipped=True, start=start, stop=stop, split=split)


def write_lines(lines: DataFrame, folder: str, order: str, dtype: str = "<u2", mode: str = "append", parts: int | None = None) -> None:
    """Groups of six files, in which lines keep the order of a column."""
    write_records(lines, folder, fields_of(dict.fromkeys(LINE_ENDS, dtype)), order, mode, parts, zipped=True)
