"""The volume data source and DICOM series, on files that the tests write."""

import struct

import numpy as np
import pytest

from voxmill.sources import datasource, dicom, volumes


@pytest.fixture(scope="module")
def volume():
    return np.random.default_rng(3).integers(0, 5, (9, 7, 11)).astype("<i2")


def _plain_meta(array):
    """An uncompressed MetaImage file."""
    head = f"ObjectType = Image\nNDims = 3\nDimSize = {' '.join(map(str, array.shape))}\nElementType = MET_SHORT\nElementSpacing = 1 2 3\nElementDataFile = LOCAL\n"
    return head.encode() + array.tobytes(order="F")


def _cells(array, box=(slice(None),) * 3):
    out = set()
    for at in zip(*(a.ravel() for a in np.indices(array.shape)), strict=True):
        if array[at] and all(i in range(*s.indices(n)) for i, s, n in zip(at, box, array.shape, strict=True)):
            out.add((*map(int, at), float(array[at])))
    return out


@pytest.mark.parametrize("slab", [64 << 20, 200])
def test_volumes_are_read_by_slab_and_box(spark, tmp_path, volume, slab):
    (tmp_path / "a.mha").write_bytes(_plain_meta(volume))
    (tmp_path / "b.mha").write_bytes(volumes.meta_bytes(volume))
    np.save(tmp_path / "c.npy", volume)
    np.save(tmp_path / "d.npy", np.asfortranarray(volume))
    (tmp_path / "_hidden.mha").write_bytes(b"no volume")
    table = datasource.register(spark).read.format("volume").option("slabBytes", slab).load(str(tmp_path))
    rows = table.collect()
    for name in ("a.mha", "b.mha", "c.npy", "d.npy"):
        assert {(r.x, r.y, r.z, r.value) for r in rows if r.path.endswith(name)} == _cells(volume), name
    box = table.filter("z >= 3 AND z < 8 AND y > 2 AND x = 4 AND value > 1")
    want = {c for c in _cells(volume, (slice(4, 5), slice(3, None), slice(3, 8))) if c[3] > 1}
    got = box.collect()
    for name in ("a.mha", "b.mha", "c.npy", "d.npy"):
        assert {(r.x, r.y, r.z, r.value) for r in got if r.path.endswith(name)} == want, name
    narrow = spark.read.format("volume").schema("z int, value double").option("pattern", "a*").option("background", "none").load(str(tmp_path))
    assert narrow.columns == ["z", "value"] and narrow.count() == volume.size and narrow.filter("z = 99").count() == 0


def test_only_slices_of_the_box_are_read(tmp_path, volume):
    """Ranges reach the file: of a slab outside of the box only the header is read, of others the slices inside."""
    (tmp_path / "a.mha").write_bytes(_plain_meta(volume))
    schema = volumes_schema()
    reader = datasource.VolumeReader(schema, {"path": str(tmp_path), "slabBytes": "300"})
    left = list(reader.pushFilters([datasource.GreaterThanOrEqual(("z",), 5), datasource.LessThan(("z",), 7), datasource.EqualTo(("value",), 2.0)]))
    assert len(left) == 1 and left[0].attribute == ("value",)
    assert (reader.low["z"], reader.high["z"]) == (5, 7)
    parts = reader.partitions()
    read = [sum(len(b) for b in reader.read(p)) for p in parts]
    assert len(parts) > 4 and sum(n > 0 for n in read) <= 2 and sum(read) == len(_cells(volume, (slice(None), slice(None), slice(5, 7))))


def test_small_volumes_are_read_many_at_a_time(tmp_path, volume):
    for k in range(50):
        (tmp_path / f"{k:02}.mha").write_bytes(_plain_meta(volume))
    reader = datasource.VolumeReader(volumes_schema(), {"path": str(tmp_path)})
    (part,) = reader.partitions()
    assert sum(len(b) for b in reader.read(part)) == 50 * len(_cells(volume))
    reader.slab = 10 * (datasource.OPEN_BYTES + len(_plain_meta(volume)))
    assert [len(p.slabs) for p in reader.partitions()] == [10] * 5


def volumes_schema():
    from pyspark.sql import types as T

    return T.StructType.fromDDL(datasource.SCHEMA)


def test_volumes_are_written_and_read_back(spark, tmp_path):
    rows = [(k, k % 4, k % 3, (k * 7) % 5, 1 + k % 3) for k in range(60)]
    cells = {(c % 3, x, y, z): v for c, x, y, z, v in rows}
    table = spark.createDataFrame([(*k, v) for k, v in cells.items()], "case_id int, x int, y int, z int, label int")
    datasource.write_volumes(table, str(tmp_path / "out"), "case_id", (4, 3, 5))
    back = spark.read.format("volume").load(str(tmp_path / "out")).collect()
    assert {(int(r.path.split("/")[-1].removesuffix(".mha")), r.x, r.y, r.z): r.value for r in back} == cells
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["0.mha", "1.mha", "2.mha"]
    datasource.write_volumes(table.filter("case_id = 1"), str(tmp_path / "out"), "case_id", (4, 3, 5), mode="overwrite")
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["1.mha"]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    table = spark.createDataFrame([(1, 0, 0, 0, 1), (1, 9, 0, 0, 1)], "case_id int, x int, y int, z int, label int")
    with pytest.raises(Exception, match="out of bounds"):
        datasource.write_volumes(table, str(tmp_path / "out"), "case_id", (4, 3, 5))
    assert not [p for p in (tmp_path / "out").rglob("*") if p.is_file()]


def _dicom(pixels, z, syntax=dicom.EXPLICIT, name="1.2.3"):
    """A slice with a nested sequence of open length before its pixels."""

    def element(tag, kind, value):
        value += b" " * (len(value) % 2) if kind != b"UI" else b"\0" * (len(value) % 2)
        size = struct.pack("<HI", 0, len(value)) if kind in dicom.LONG_KINDS else struct.pack("<H", len(value))
        return struct.pack("<HH", *tag) + kind + size + value

    open_ = struct.pack("<I", dicom.OPEN)
    inner = struct.pack("<HH", *dicom.ITEM) + open_ + element((0x0008, 0x0100), b"SH", b"code") + struct.pack("<HHI", *dicom.ITEM_END, 0)
    nested = struct.pack("<HH", 0x0008, 0x1140) + b"SQ" + b"\0\0" + open_ + inner + struct.pack("<HHI", *dicom.SEQUENCE_END, 0)
    short = lambda v: struct.pack("<H", v)
    return (
        b"\0" * 128 + b"DICM" + element(dicom.SYNTAX, b"UI", syntax.encode()) + nested + element(dicom.SERIES, b"UI", name.encode())
        + element(dicom.POSITION, b"DS", f"-10\\5\\{z}".encode()) + element(dicom.ORIENTATION, b"DS", b"1\\0\\0\\0\\1\\0") + element(dicom.ROWS, b"US", short(pixels.shape[0])) + element(dicom.COLUMNS, b"US", short(pixels.shape[1]))
        + element(dicom.SPACING, b"DS", b"0.5\\0.5") + element(dicom.BITS, b"US", short(16)) + element(dicom.SIGNED, b"US", short(1)) + element(dicom.INTERCEPT, b"DS", b"-1000") + element(dicom.SLOPE, b"DS", b"2")
        + element(dicom.PIXELS, b"OW", pixels.astype("<i2").tobytes())
    )


def test_series_come_back_as_volumes(spark, tmp_path):
    rng = np.random.default_rng(1)
    scans = {name: rng.integers(-50, 50, (n, 4, 3)) for name, n in (("1.2.3", 5), ("1.2.4", 1))}
    for name, scan in scans.items():
        for k, at in enumerate(rng.permutation(len(scan))):  # files in no order
            (tmp_path / f"{name}-{k}.dcm").write_bytes(_dicom(scan[at], -7.5 + 2.5 * at, name=name))
    got = dicom.read_series(spark, str(tmp_path)).collect()
    assert {(r.series, r.z, r.y, r.x): r.value for r in got} == {(name, *map(int, at)): 2.0 * v - 1000 for name, scan in scans.items() for at, v in np.ndenumerate(scan)}
    assert {r.series: (r.n_slices, r.spacing, r.origin) for r in dicom.series(spark, str(tmp_path)).collect()} == {"1.2.3": (5, [0.5, 0.5, 2.5], [-10.0, 5.0, -7.5]), "1.2.4": (1, [0.5, 0.5, 1.0], [-10.0, 5.0, -7.5])}


def test_compressed_slices_are_named_errors():
    with pytest.raises(ValueError, match=r"1\.2\.840\.10008\.1\.2\.4\.70 can't be read"):
        dicom.slice_of(_dicom(np.zeros((2, 2)), 0.0, "1.2.840.10008.1.2.4.70"))
    with pytest.raises(ValueError, match="not a DICOM file"):
        dicom.slice_of(b"\0" * 200)
