"""Series of slices in uncompressed DICOM files as volumes: slices are put in order by where they lie along their normal."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values of the format: kinds of elements with long lengths, tags, and the transfer syntax that can be read.
LONG_KINDS = frozenset((b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"SV", b"UC", b"UN", b"UR", b"UT", b"UV"))
SYNTAX, SERIES, POSITION, ORIENTATION = (0x0002, 0x0010), (0x0020, 0x000E), (0x0020, 0x0032), (0x0020, 0x0037)
ROWS, COLUMNS, SPACING, BITS, SIGNED = (0x0028, 0x0010), (0x0028, 0x0011), (0x0028, 0x0030), (0x0028, 0x0100), (0x0028, 0x0103)
INTERCEPT, SLOPE, PIXELS = (0x0028, 0x1052), (0x0028, 0x1053), (0x7FE0, 0x0010)
ITEM, ITEM_END, SEQUENCE_END = (0xFFFE, 0xE000), (0xFFFE, 0xE00D), (0xFFFE, 0xE0DD)
EXPLICIT, OPEN = "1.2.840.10008.1.2.1", 0xFFFFFFFF


def _element(data: bytes, at: int) -> tuple[tuple[int, int], bytes, int, int]:
    """Tag, kind, length and start of the element at ``at``."""
    tag = struct.unpack_from("<HH", data, at)
    if tag[0] == 0xFFFE:
        return tag, b"", struct.unpack_from("<I", data, at + 4)[0], at + 8
    kind = data[at + 4 : at + 6]
    if kind in LONG_KINDS:
        return tag, kind, struct.unpack_from("<I", data, at + 8)[0], at + 12
    return tag, kind, struct.unpack_from("<H", data, at + 6)[0], at + 8


def _after(data: bytes, at: int, end: tuple[int, int]) -> int:
    """Where the content of a sequence or item of open length that begins at ``at`` is over."""
    while True:
        tag, kind, length, start = _element(data, at)
        if tag == end:
            return start
        at = start + length if length != OPEN else _after(data, start, ITEM_END if tag == ITEM else SEQUENCE_END)


def elements(data: bytes) -> dict[tuple[int, int], bytes]:
    """The elements of a file's top level by tag; sequences are passed over. An error names a transfer syntax that can't be read."""
    if data[128:132] != b"DICM":
        raise ValueError("not a DICOM file")
    found: dict[tuple[int, int], bytes] = {}
    at = 132
    while at + 8 <= len(data):
        tag, kind, length, start = _element(data, at)
        if tag[0] > 2 and (syntax := found.get(SYNTAX, b"").rstrip(b"\0 ").decode()) != EXPLICIT:
            raise ValueError(f"transfer syntax {syntax or 'unknown'} can't be read, only {EXPLICIT}")
        if length == OPEN:
            at = _after(data, start, SEQUENCE_END)
            continue
        if kind != b"SQ":
            found[tag] = data[start : start + length]
        at = start + length
    return found


def _numbers(value: bytes) -> list[float]:
    return [float(v) for v in value.decode().strip("\0 ").split("\\") if v.strip()]


def slice_of(data: bytes) -> dict:
    """One slice: its series, place along its normal, spacing, and pixels ``(row, column)`` scaled to stored units."""
    e = elements(data)
    short = lambda tag: struct.unpack("<H", e[tag][:2])[0]
    kind = f"<{'i' if SIGNED in e and short(SIGNED) else 'u'}{short(BITS) // 8}"
    pixels = np.frombuffer(e[PIXELS], kind, count=short(ROWS) * short(COLUMNS)).reshape(short(ROWS), short(COLUMNS))
    slope, intercept = (_numbers(e[t])[0] if t in e else d for t, d in ((SLOPE, 1.0), (INTERCEPT, 0.0)))
    axes = np.array(_numbers(e[ORIENTATION]) if ORIENTATION in e else [1, 0, 0, 0, 1, 0], float).reshape(2, 3)
    place = np.array(_numbers(e[POSITION]) if POSITION in e else [0, 0, 0], float)
    return {
        "series": e.get(SERIES, b"").rstrip(b"\0 ").decode(), "along": float(np.cross(*axes) @ place), "spacing": _numbers(e[SPACING]) if SPACING in e else [1.0, 1.0], "origin": place.tolist(),
        "pixels": pixels * slope + intercept,
    }


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")


def slices(spark: SparkSession, path: str, pattern: str = "*.dcm") -> DataFrame:
    """``(path, series, z, along, spacing, origin)`` of the slices below ``path``: ``z`` counts a series' slices from 0 along the normal, equal places by path. Pixels aren't kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                found = slice_of(content)
                yield pd.DataFrame([{"path": p, **{k: found[k] for k in ("series", "along", "spacing", "origin")}}])

    heads = _files(spark, path, pattern).mapInPandas(run, "path string, series string, along double, spacing array<double>, origin array<double>")
    return heads.withColumn("z", F.row_number().over(W.partitionBy("series").orderBy("along", "path")) - 1)


def series(spark: SparkSession, path: str, pattern: str = "*.dcm") -> DataFrame:
    """``(series, n_slices, spacing, origin)`` of the volumes below ``path``; the spacing along the normal is the mean of the gaps, 1 for a single slice."""
    rows = slices(spark, path, pattern)
    gaps = (F.max("along") - F.min("along")) / (F.count(F.lit(1)) - 1)
    return rows.groupBy("series").agg(
        F.count(F.lit(1)).cast("int").alias("n_slices"), F.concat(F.min_by("spacing", "z"), F.array(F.when(F.count(F.lit(1)) > 1, gaps).otherwise(1.0))).alias("spacing"), F.min_by("origin", "z").alias("origin")
    )


def read_series(spark: SparkSession, path: str, pattern: str = "*.dcm", background: float | None = None) -> DataFrame:
    """``(series, x, y, z, value)``: the cells of the volumes below ``path``, x along rows and y down columns; cells of ``background`` are left out. A task holds one slice at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, z, content in zip(batch["series"], batch["z"], batch["content"], strict=True):
                pixels = slice_of(content)["pixels"]
                y, x = np.nonzero(pixels != background) if background is not None else (a.ravel() for a in np.indices(pixels.shape))
                yield pd.DataFrame({"series": name, "x": x, "y": y, "z": z, "value": pixels[y, x].astype(float)})

    placed = _files(spark, path, pattern).join(slices(spark, path, pattern).select("path", "series", "z"), "path").select("series", "z", "content")
    return placed.mapInPandas(run, "series string, x int, y int, z int, value double")
