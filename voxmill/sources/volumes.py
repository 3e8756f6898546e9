"""Image volumes: MetaImage, NIfTI and NumPy files as tables, read in parallel from any store that Spark reads."""

from __future__ import annotations

import gzip
import io
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the file formats: element types by their names and codes.
META_TYPES = {
    "MET_CHAR": "i1", "MET_UCHAR": "u1", "MET_SHORT": "i2", "MET_USHORT": "u2", "MET_INT": "i4", "MET_UINT": "u4", "MET_LONG_LONG": "i8", "MET_ULONG_LONG": "u8", "MET_FLOAT": "f4", "MET_DOUBLE": "f8",
}
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}


@dataclass(frozen=True)
class Layout:
    """Where and how a file holds its cells: ``kind`` is a NumPy type; cells run along x first unless ``last_first``."""

    shape: tuple[int, ...]
    kind: str
    start: int
    geometry: dict
    packed: bool = False
    last_first: bool = False
    slope: float = 1.0
    intercept: float = 0.0

    def array(self, raw: bytes, shape: tuple[int, ...] | None = None) -> np.ndarray:
        """Cells of the whole volume, or of a slab of this shape, as (x, y, z)."""
        shape = shape or self.shape
        array = np.frombuffer(raw, self.kind, count=int(np.prod(shape))).reshape(shape, order="C" if self.last_first else "F")
        return array if (self.slope, self.intercept) == (1.0, 0.0) else array * self.slope + self.intercept


def meta_layout(data: bytes) -> Layout:
    """The header of a MetaImage file with its data inside."""
    head: dict[str, str] = {}
    at = 0
    while "ElementDataFile" not in head:
        end = data.index(b"\n", at)
        name, _, value = data[at:end].decode().partition("=")
        head[name.strip()] = value.strip()
        at = end + 1
    if head["ElementDataFile"] != "LOCAL":
        raise ValueError("only MetaImage files that hold their own data can be read")
    order = ">" if head.get("BinaryDataByteOrderMSB", head.get("ElementByteOrderMSB", "False")) == "True" else "<"
    shape = tuple(int(n) for n in head["DimSize"].split())
    numbers = lambda key, default: [float(v) for v in head[key].split()] if key in head else default
    n = len(shape)
    geometry = {"spacing": numbers("ElementSpacing", [1.0] * n), "origin": numbers("Offset", numbers("Position", [0.0] * n)), "direction": numbers("TransformMatrix", np.eye(n).ravel().tolist())}
    return Layout(shape, order + META_TYPES[head["ElementType"]], at, geometry, head.get("CompressedData", "False") == "True")


def parse_meta(data: bytes) -> tuple[np.ndarray, dict]:
    """A MetaImage file with its data inside: the array as (x, y, z), and its geometry."""
    found = meta_layout(data)
    return found.array(zlib.decompress(data[found.start :]) if found.packed else data[found.start :]), found.geometry


def nifti_layout(data: bytes) -> Layout:
    """The header of a NIfTI-1 file in one part."""
    order = "<" if struct.unpack("<i", data[:4])[0] == 348 else ">"
    dims = struct.unpack(f"{order}8h", data[40:56])
    kind, = struct.unpack(f"{order}h", data[70:72])
    steps = struct.unpack(f"{order}8f", data[76:108])
    start, slope, inter = struct.unpack(f"{order}3f", data[108:120])
    sform = np.array(struct.unpack(f"{order}12f", data[280:328]), float).reshape(3, 4)
    spacing = [float(s) for s in steps[1 : min(dims[0], 3) + 1]]
    with np.errstate(divide="ignore", invalid="ignore"):
        direction = np.nan_to_num(sform[:, :3] / np.array(spacing)[None, :]) if len(spacing) == 3 else np.eye(3)
    geometry = {"spacing": spacing, "origin": sform[:, 3].tolist(), "direction": direction.ravel().tolist()}
    return Layout(dims[1 : dims[0] + 1], order + NIFTI_TYPES[kind], int(start), geometry, slope=slope or 1.0, intercept=inter)


def parse_nifti(data: bytes) -> tuple[np.ndarray, dict]:
    """A NIfTI-1 file in one part, compressed or not: the array as (x, y, z), and its geometry."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    found = nifti_layout(data)
    return found.array(data[found.start :]), found.geometry


def numpy_layout(data: bytes) -> Layout:
    """The header of a NumPy array."""
    head = io.BytesIO(data)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if np.lib.format.read_magic(head) == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    n = len(shape)
    return Layout(shape, kind.str, head.tell(), {"spacing": [1.0] * n, "origin": [0.0] * n, "direction": np.eye(n).ravel().tolist()}, last_first=not fortran)


def parse_numpy(data: bytes, key: str = "probabilities") -> tuple[np.ndarray, dict]:
    """A NumPy array, or the entry ``key`` (or the first) of an archive of arrays; nothing pickled is read."""
    found = np.load(io.BytesIO(data), allow_pickle=False)
    array = found if isinstance(found, np.ndarray) else found[key if key in found.files else found.files[0]]
    n = array.ndim
    return array, {"spacing": [1.0] * n, "origin": [0.0] * n, "direction": np.eye(n).ravel().tolist()}


NRRD_TYPES = {
    "signed char": "i1", "int8": "i1", "uchar": "u1", "unsigned char": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "unsigned short": "u2", "uint16": "u2", "int": "i4", "int32": "i4",
    "uint": "u4", "unsigned int": "u4", "uint32": "u4", "float": "f4", "double": "f8",
}


def parse_nrrd(data: bytes) -> tuple[np.ndarray, dict]:
    """An NRRD file with its data inside, raw or compressed: the array as (x, y, z), and its geometry."""
    end = data.index(b"\n\n")
    head = {}
    for line in data[:end].decode().splitlines()[1:]:
        if not line.startswith("#") and ":" in line:
            name, _, value = line.partition(":")
            head[name.strip().lower()] = value.lstrip("=").strip()
    if "data file" in head or "datafile" in head:
        raise ValueError("only NRRD files that hold their own data can be read")
    raw = data[end + 2 :]
    if head.get("encoding", "raw") in ("gzip", "gz"):
        raw = gzip.decompress(raw)
    elif head.get("encoding", "raw") != "raw":
        raise ValueError(f"unknown encoding {head['encoding']}")
    shape = [int(n) for n in head["sizes"].split()]
    kind = (">" if head.get("endian") == "big" else "<") + NRRD_TYPES[head["type"]]
    array = np.frombuffer(raw, kind, count=int(np.prod(shape))).reshape(shape, order="F")
    vector = lambda text: [float(v) for v in text.strip("()").split(",")]
    n = len(shape)
    steps = np.array([vector(v) for v in head["space directions"].split() if v != "none"]) if "space directions" in head else np.diag([float(v) for v in head["spacings"].split()] if "spacings" in head else [1.0] * n)
    spacing = np.sqrt((steps**2).sum(1))
    return array, {"spacing": spacing.tolist(), "origin": vector(head["space origin"]) if "space origin" in head else [0.0] * n, "direction": (steps / spacing[:, None]).T.ravel().tolist()}


def to_ras(array: np.ndarray, geometry: dict) -> tuple[np.ndarray, dict]:
    """A volume with its axes permuted and mirrored so that they run right, anterior and superior as nearly as they can."""
    direction = np.array(geometry["direction"], float).reshape(3, 3)
    spacing, origin = np.array(geometry["spacing"]), np.array(geometry["origin"], float)
    axes, left = [], {0, 1, 2}
    for world in np.argsort(-np.abs(direction).max(1), kind="stable"):  # the clearest axes first
        best = max(left, key=lambda a: abs(direction[world, a]))
        axes.append((int(world), best))
        left.remove(best)
    order = [a for _, a in sorted(axes)]
    array, direction, spacing = array.transpose(order), direction[:, order], spacing[order]
    for k in range(3):
        if direction[k, k] < 0:
            origin = origin + direction[:, k] * spacing[k] * (array.shape[k] - 1)
            array, direction[:, k] = np.flip(array, k), -direction[:, k]
    return array, {"spacing": spacing.tolist(), "origin": origin.tolist(), "direction": direction.ravel().tolist()}


#: Headers of files whose cells lie in the file as they are, so that a part of them can be read alone.
LAYOUTS = {".mha": meta_layout, ".nii": nifti_layout, ".npy": numpy_layout}
#: Readers by suffix; the first that fits is taken.
READERS = {".mha": parse_meta, ".nrrd": parse_nrrd, ".nii.gz": parse_nifti, ".nii": parse_nifti, ".npy": parse_numpy, ".npz": parse_numpy}


def reader_of(path: str, override: str | None = None):
    """The parser for a path's suffix, or for ``override`` in its place."""
    for suffix, reader in READERS.items():
        if (override or path).endswith(suffix):
            return reader
    raise ValueError(f"no reader for {path}")


def read_volumes(spark: SparkSession, path: str, override: str | None = None, pattern: str = "*") -> DataFrame:
    """``(path, shape, spacing, origin, direction)`` of the volumes below ``path``, a row for each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                array, geometry = reader_of(p, override)(content)
                yield pd.DataFrame([{"path": p, "shape": list(array.shape), **geometry}])

    return _files(spark, path, pattern).mapInPandas(run, "path string, shape array<int>, spacing array<double>, origin array<double>, direction array<double>")


def read_voxels(spark: SparkSession, path: str, override: str | None = None, pattern: str = "*", background: float | None = 0.0, ras: bool = False) -> DataFrame:
    """``(path, x, y, z, value)``: the cells of the volumes below ``path`` that differ from ``background``; all if that is None.

    A file is parsed in one task, turned by :func:`to_ras` if asked for, and sent on slice by slice.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                array, geometry = reader_of(p, override)(content)
                array = to_ras(array, geometry)[0] if ras else array
                array = array.reshape(array.shape + (1,) * (3 - array.ndim))
                for x, part in enumerate(array):
                    y, z = np.nonzero(part != background) if background is not None else (a.ravel() for a in np.indices(part.shape))
                    if len(y):
                        yield pd.DataFrame({"path": p, "x": x, "y": y, "z": z, "value": part[y, z].astype(float)})

    return _files(spark, path, pattern).mapInPandas(run, "path string, x int, y int, z int, value double")


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``(path, x, y, channel, value)`` of the PNG, BMP, GIF and JPEG images below ``path``; channels in the order blue, green, red, alpha, or one of grey."""
    images = spark.read.format("image").option("dropInvalid", True).load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, h, w, n, data in zip(batch["origin"], batch["height"], batch["width"], batch["nChannels"], batch["data"], strict=True):
                y, x, c = (a.ravel() for a in np.indices((h, w, n)))
                yield pd.DataFrame({"path": p, "x": x, "y": y, "channel": c, "value": np.frombuffer(data, np.uint8).astype(int)})

    return images.mapInPandas(run, "path string, x int, y int, channel int, value int")


def unpack(spark: SparkSession, path: str, out: str, pattern: str = "*.npz") -> DataFrame:
    """The voxels of archives below ``path`` as a Parquet table at ``out``, written once: what is there already is read as it is."""
    try:
        return spark.read.parquet(out)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    read_voxels(spark, path, pattern=pattern, background=None).write.parquet(out)
    return spark.read.parquet(out)


def process_cases(spark: SparkSession, path: str, predict: Callable[[np.ndarray], np.ndarray], pattern: str = "*") -> DataFrame:
    """``(path, content)``: each volume below ``path`` through ``predict``, as a MetaImage file of labels with the volume's spacing. A model is loaded by ``predict`` itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                array, geometry = reader_of(p)(content)
                labels = predict(array).astype(np.uint8)
                yield pd.DataFrame({"path": [p], "content": [meta_bytes(labels, tuple(geometry["spacing"]), tuple(geometry["origin"]))]})

    return _files(spark, path, pattern).mapInPandas(run, "path string, content binary")


def meta_bytes(array: np.ndarray, spacing: tuple[float, ...] = (1.0, 1.0, 1.0), origin: tuple[float, ...] = (0.0, 0.0, 0.0)) -> bytes:
    """A compressed MetaImage file of an array (x, y, z)."""
    kind = next(name for name, code in META_TYPES.items() if np.dtype(code) == array.dtype)
    n = array.ndim
    head = {
        "ObjectType": "Image", "NDims": n, "BinaryData": "True", "BinaryDataByteOrderMSB": "False", "CompressedData": "True",
        "TransformMatrix": " ".join(str(int(v)) for v in np.eye(n).ravel()), "Offset": " ".join(map(str, origin[:n])), "ElementSpacing": " ".join(map(str, spacing[:n])),
        "DimSize": " ".join(map(str, array.shape)), "ElementType": kind, "ElementDataFile": "LOCAL",
    }
    return "".join(f"{k} = {v}\n" for k, v in head.items()).encode() + zlib.compress(array.astype(array.dtype.newbyteorder("<")).tobytes(order="F"))


def volume_files(voxels: DataFrame, by: str, shape: tuple[int, int, int], label: str = "label") -> DataFrame:
    """``(by, content)``: each group's label map as a MetaImage file of 8-bit labels; cells without a row are background."""

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros(shape, np.uint8)
        grid[tuple(cells[["x", "y", "z"]].to_numpy(np.int64).T)] = cells[label]
        return pd.DataFrame({by: cells[by].iloc[:1], "content": [meta_bytes(grid)]})

    return voxels.select(by, "x", "y", "z", label).groupBy(by).applyInPandas(run, f"{by} {dict(voxels.dtypes)[by]}, content binary")
