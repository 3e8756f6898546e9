"""Volumes as a Spark data source: ``spark.read.format("volume")``, with a partition for each slab and ranges of coordinates read alone; and ``write.format("volume")``.

Files are opened by pyarrow's file systems (local and mounted folders, object stores), in tasks; for stores that only Spark itself can open, take
:func:`voxmill.sources.volumes.read_voxels`.
"""

from __future__ import annotations

import fnmatch
import math
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from voxmill.sources import volumes

SCHEMA = "path string, x int, y int, z int, value double"
#: Bytes of a file that go to one task, and of a header that is read at once.
SLAB_BYTES, HEAD_BYTES = 64 << 20, 1 << 16
#: What opening a file counts for when small files are put together for a task.
OPEN_BYTES = 1 << 16
_ARROW = {"path": pa.string(), "x": pa.int32(), "y": pa.int32(), "z": pa.int32(), "value": pa.float64()}


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"file://{path}")


@dataclass
class Slab(InputPartition):
    """The ``part``-th of ``parts`` equal shares of a file's slices."""

    path: str
    part: int
    parts: int

    def __post_init__(self):
        super().__init__(None)


@dataclass
class Slabs(InputPartition):
    """Slabs that one task reads one after another."""

    slabs: list[Slab]

    def __post_init__(self):
        super().__init__(None)


class VolumeReader(DataSourceReader):
    """Cells of volumes, a partition for each slab of a large file or for many small files, which are put together up to the size of a slab.

    Comparisons of x, y and z with numbers narrow the box that is read: a slab outside of it isn't touched but for the file's header, and of others only the slices inside are read.
    Only the columns of the schema that was asked for are made.
    """

    def __init__(self, schema: T.StructType, options: dict):
        self.columns = [f.name for f in schema.fields]
        if unknown := set(self.columns) - set(_ARROW):
            raise ValueError(f"a volume has no columns {sorted(unknown)}")
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        background = options.get("background", "0")
        self.background = None if background == "none" else float(background)
        self.slab = int(options.get("slabBytes", SLAB_BYTES))
        self.low, self.high = {c: 0 for c in "xyz"}, {c: math.inf for c in "xyz"}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name not in self.low or not isinstance(getattr(f, "value", None), (int, float)):
                yield f
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low[name] = max(self.low[name], math.floor(f.value) + 1 if isinstance(f, GreaterThan) else math.ceil(f.value))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.high[name] = min(self.high[name], math.ceil(f.value) if isinstance(f, LessThan) else math.floor(f.value) + 1)
            elif isinstance(f, EqualTo):
                self.low[name], self.high[name] = max(self.low[name], math.ceil(f.value)), min(self.high[name], math.floor(f.value) + 1)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, root = _opened(self.path)
        info = store.get_file_info(root)
        files = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        found, held = [], 0
        for f in sorted(files, key=lambda f: f.path):
            if f.is_file and not f.base_name.startswith(("_", ".")) and "/_" not in f.path[len(root) :] and fnmatch.fnmatch(f.base_name, self.pattern):
                parts = max(1, -(-f.size // self.slab)) if any(f.path.endswith(s) for s in volumes.LAYOUTS) else 1
                cost = OPEN_BYTES + f.size // parts
                for k in range(parts):
                    if not found or held + cost > self.slab:
                        found.append(Slabs([]))
                        held = 0
                    found[-1].slabs.append(Slab(f.path, k, parts))
                    held += cost
        return found

    def read(self, partition: Slabs) -> Iterator[pa.RecordBatch]:
        store, _ = _opened(self.path)
        for slab in partition.slabs:
            yield from self._read(store, slab)

    def _read(self, store: fs.FileSystem, partition: Slab) -> Iterator[pa.RecordBatch]:
        with store.open_input_file(partition.path) as f:
            layout = next((head for suffix, head in volumes.LAYOUTS.items() if partition.path.endswith(suffix)), None)
            head = layout(f.read_at(min(HEAD_BYTES, f.size()), 0)) if layout else None
            if head is None or head.packed:
                if partition.part == 0:  # can't be cut: the first share has it all
                    array = volumes.reader_of(partition.path)(f.read_at(f.size(), 0))[0]
                    array = array.reshape(array.shape + (1,) * (3 - array.ndim))
                    yield from self._cells(partition.path, array, 0, 2, 0, array.shape[2])
                return
            shape = head.shape + (1,) * (3 - len(head.shape))
            axis = 0 if head.last_first else 2
            size = shape[axis]
            lo = max(size * partition.part // partition.parts, self.low["xyz"[axis]])
            hi = min(size * (partition.part + 1) // partition.parts, self.high["xyz"[axis]])
            slice_bytes = np.dtype(head.kind).itemsize * math.prod(shape) // max(size, 1)
            step = max(1, SLAB_BYTES // max(slice_bytes, 1))
            for at in range(lo, max(lo, hi), step):
                end = min(at + step, hi)
                part = head.array(f.read_at((end - at) * slice_bytes, head.start + at * slice_bytes), tuple(end - at if k == axis else n for k, n in enumerate(shape)))
                yield from self._cells(partition.path, part, at, axis, at, end)

    def _cells(self, path: str, array: np.ndarray, offset: int, axis: int, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        cut = [slice(self.low[c], None if self.high[c] == math.inf else max(self.high[c], 0)) for c in "xyz"]
        shift = [s.start for s in cut]
        first = max(lo, shift[axis]) - offset
        cut[axis], shift[axis] = slice(first, max(first, min(hi, self.high["xyz"[axis]]) - offset)), first + offset
        array = array[tuple(cut)]
        for k in range(array.shape[axis]):  # a slice at a time
            part = np.take(array, k, axis)
            at = np.nonzero(part != self.background) if self.background is not None else tuple(a.ravel() for a in np.indices(part.shape))
            if len(at[0]):
                place = list(at)
                place.insert(axis, np.full(len(at[0]), k))
                made = {"path": lambda: np.full(len(at[0]), path), "value": lambda: part[at].astype(float)}  # noqa: B023
                cols = {c: made[c]() if c in made else (place["xyz".index(c)] + shift["xyz".index(c)]).astype(np.int32) for c in self.columns}
                yield pa.RecordBatch.from_arrays([pa.array(v, _ARROW[c]) for c, v in cols.items()], names=self.columns)


@dataclass
class Written(WriterCommitMessage):
    """Files that a task has written under passing names, and what they shall be called."""

    files: list[tuple[str, str]]


class VolumeWriter(DataSourceArrowWriter):
    """A MetaImage file of 8-bit labels for each value of the first column; the rows of one must come together. Nothing is seen of them until the whole write is done."""

    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.key, self.names = schema.fields[0].name, [f.name for f in schema.fields]
        self.path, self.shape, self.overwrite = options["path"], tuple(int(n) for n in options["shape"].split(",")), overwrite
        self.spacing = tuple(float(n) for n in options.get("spacing", "1,1,1").split(","))
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = _opened(self.path)
        folder, files = f"{root}/_unfinished-{self.job}", []
        store.create_dir(folder)
        grid, now = None, None

        def done() -> None:
            name = f"{folder}/{uuid.uuid4().hex}"
            with store.open_output_stream(name) as out:
                out.write(volumes.meta_bytes(grid, self.spacing))
            files.append((name, f"{root}/{now}.mha"))

        for batch in iterator:
            keys = batch.column(0).to_pylist()
            at, label = np.stack([batch.column(self.names.index(c)).to_numpy(zero_copy_only=False) for c in "xyz"]).astype(np.int64), batch.column(len(self.names) - 1).to_numpy(zero_copy_only=False)
            starts = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]]
            for lo, hi in zip(starts, [*starts[1:], len(keys)], strict=True):
                if grid is None or keys[lo] != now:
                    if grid is not None:
                        done()
                    grid, now = np.zeros(self.shape, np.uint8), keys[lo]
                grid[tuple(at[:, lo:hi])] = label[lo:hi]
        if grid is not None:
            done()
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _opened(self.path)
        files = [f for m in messages if m for f in m.files]
        if len({final for _, final in files}) < len(files):
            self.abort(messages)
            raise ValueError("a volume's rows came in several tasks")
        if self.overwrite:
            kept = {final for _, final in files}
            for f in store.get_file_info(fs.FileSelector(root)):
                if f.is_file and f.path not in kept:
                    store.delete_file(f.path)
        for name, final in files:
            store.move(name, final)
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _opened(self.path)
        if store.get_file_info(f"{root}/_unfinished-{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/_unfinished-{self.job}")


class VolumeSource(DataSource):
    """``path``, and for reading ``pattern``, ``background`` (cells of that value are left out; ``none`` for all) and ``slabBytes``; for writing ``shape`` and ``spacing``."""

    @classmethod
    def name(cls) -> str:
        return "volume"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return VolumeReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return VolumeWriter(schema, self.options, overwrite)


def register(spark: SparkSession) -> SparkSession:
    """``spark`` with the source ``volume`` and with filters passed down to such sources."""
    spark.dataSource.register(VolumeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def write_volumes(voxels: DataFrame, path: str, by: str, shape: tuple[int, int, int], label: str = "label", mode: str = "append") -> None:
    """``voxels(by, x, y, z, label)`` as a file for each value of ``by``; cells without a row are 0."""
    register(voxels.sparkSession)
    rows = voxels.select(by, "x", "y", "z", label).repartition(by).sortWithinPartitions(by)
    rows.write.format("volume").option("path", path).option("shape", ",".join(map(str, shape))).mode(mode).save()
