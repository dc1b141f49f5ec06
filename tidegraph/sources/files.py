"""Parts of large files: rasters by strips as a data source, archives by members.

A raster's partitions are runs of its rows.  Conditions on row, col, lat and lon that Spark
pushes down leave strips out of the plan and columns out of what is read; Spark checks
them again on the rows.  Archives that aren't compressed are read by ranges, any task any
member; compressed ones stream, a task each, a member at a time.
"""

from __future__ import annotations

import math
import re
import struct
import tarfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Cells of a raster that a partition reads, about.
CELLS = 1 << 20
#: First bytes of gzip, bzip2 and xz files.
PACKED = (b"\x1f\x8b", b"BZh", b"\xfd7zXZ")


def place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path there."""
    path = re.sub(r"^file:/+", "/", path)
    return pafs.FileSystem.from_uri(path)


def listed(path: str) -> list[str]:
    """The file of this path, or the files right inside the folder, by name; names that begin with . or _ are passed over."""
    fs, inside = place(path)
    found = fs.get_file_info(inside)
    if found.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if found.type == pafs.FileType.File:
        return [path]
    names = sorted(x.base_name for x in fs.get_file_info(pafs.FileSelector(inside)) if x.type == pafs.FileType.File and x.base_name[0] not in "._")
    return [f"{path.rstrip('/')}/{name}" for name in names]


@dataclass
class Header:
    """What is needed to read one band of a planar 16-bit TIFF with a strip for each row."""

    order: str
    width: int
    strips: tuple[int, ...]
    dx: float
    dy: float
    x: float
    y: float

    @classmethod
    def read(cls, f: pa.NativeFile, band: int) -> Header:
        def at(where: int, form: str) -> tuple:
            f.seek(where)
            return struct.unpack(form, f.read(struct.calcsize(form)))

        f.seek(0)
        order = "<" if f.read(2) == b"II" else ">"
        first = at(4, order + "I")[0]
        kinds = {3: "H", 4: "I", 12: "d"}
        tags: dict[int, tuple] = {}
        for k in range(at(first, order + "H")[0]):
            own = first + 2 + 12 * k
            tag, kind, count, where = at(own, order + "HHII")
            if kind in kinds:
                form = f"{order}{count}{kinds[kind]}"
                tags[tag] = at(where if struct.calcsize(form) > 4 else own + 8, form)
        height, strips = tags[257][0], tags[273]
        own = strips[band * height : (band + 1) * height] if len(strips) > height else strips
        return cls(order, tags[256][0], own, *tags[33550][:2], *tags[33922][3:5])

    def lat(self, row: np.ndarray) -> np.ndarray:
        return self.y - (row + 0.5) * self.dy

    def lon(self, col: np.ndarray) -> np.ndarray:
        return self.x + (col + 0.5) * self.dx


@dataclass
class Strips(InputPartition):
    """Rows from ``first`` on, of which columns ``left`` to ``right`` are read."""

    path: str
    header: Header
    first: int
    offsets: tuple[int, ...]
    left: int
    right: int


class RasterReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.band = options["path"], int(options.get("band", 0))
        self.cells = int(options.get("cells", CELLS))
        self.bounds: dict[str, tuple[float, float]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Notes the bounds of row, col, lat and lon, and hands all conditions back to be checked."""
        for f in filters:
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and len(f.attribute) == 1:
                name, v = f.attribute[0], f.value
                if name in ("row", "col", "lat", "lon") and isinstance(v, int | float) and not math.isnan(v):
                    low, high = self.bounds.get(name, (-math.inf, math.inf))
                    low = max(low, v) if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual) else low
                    high = min(high, v) if isinstance(f, EqualTo | LessThan | LessThanOrEqual) else high
                    self.bounds[name] = low, high
            yield f

    def _within(self, place: np.ndarray, *named: tuple[str, np.ndarray]) -> np.ndarray:
        keep = np.ones(len(place), bool)
        for name, values in named:
            low, high = self.bounds.get(name, (-math.inf, math.inf))
            keep &= (values >= low) & (values <= high)
        return place[keep]

    def partitions(self) -> list[Strips]:
        out = []
        for path in listed(self.path):
            fs, inside = place(path)
            with fs.open_input_file(inside) as f:
                h = Header.read(f, self.band)
            rows, cols = np.arange(len(h.strips)), np.arange(h.width)
            rows = self._within(rows, ("row", rows), ("lat", h.lat(rows)))
            cols = self._within(cols, ("col", cols), ("lon", h.lon(cols)))
            if not len(rows) or not len(cols):
                continue
            left, right = int(cols[0]), int(cols[-1]) + 1  # a box is one run of rows and of columns
            step = max(1, self.cells // (right - left))
            bare = Header(h.order, h.width, (), h.dx, h.dy, h.x, h.y)
            for lo in range(int(rows[0]), int(rows[-1]) + 1, step):
                out.append(Strips(path, bare, lo, h.strips[lo : min(lo + step, int(rows[-1]) + 1)], left, right))
        return out

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(part, Strips):  # where no strip is wanted Spark reads one partition without any
            return
        h, n = part.header, part.right - part.left
        cols = np.arange(part.left, part.right)
        fs, inside = place(part.path)
        with fs.open_input_file(inside) as f:
            for row, offset in enumerate(part.offsets, part.first):
                f.seek(offset + 2 * part.left)
                z = np.frombuffer(f.read(2 * n), h.order + "u2").astype(float)
                yield pa.record_batch([pa.array([part.path] * n), pa.array(np.full(n, row)), pa.array(cols), pa.array(np.full(n, h.lat(row))), pa.array(h.lon(cols)), pa.array(z, mask=z == 0)], names=["path", "row", "col", "lat", "lon", "z"])


class RasterSource(DataSource):
    """``spark.read.format("strip_raster").option("band", b).load(path)``: a file, or the files of a folder; value 0 is null."""

    @classmethod
    def name(cls) -> str:
        return "strip_raster"

    def schema(self) -> str:
        return "path string, row long, col long, lat double, lon double, z double"

    def reader(self, schema) -> RasterReader:
        return RasterReader(self.options)


def read_raster(spark: SparkSession, path: str, band: int = 40, cells: int = CELLS) -> DataFrame:
    """(path, row, col, lat, lon, z) of a band; conditions on the columns but z reach the strips."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterSource)
    return spark.read.format(RasterSource.name()).option("band", band).option("cells", cells).load(path)


def _named(archive: str, member: tarfile.TarInfo) -> tuple[int, int] | None:
    """(year, day) of a member named YYYYDDD of the year in the archive's name, of any year if there is none."""
    want = re.search(r"(\d{4})[^/]*$", archive)
    stem = re.fullmatch(r"(\d{4})(\d+)", member.name.rsplit("/", 1)[-1].split(".")[0])
    return (int(stem[1]), int(stem[2])) if member.isfile() and stem and (want is None or stem[1] == want[1]) else None


def member_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, year, doy, text) of the members of tar archives; members of another name, or another year than the archive's, are passed over.

    Only headers are read to find the members of an archive that isn't compressed; they are
    then dealt over the cluster and read by ranges.
    """
    files = spark.read.format("binaryFile").load(path).select("path")

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for name in batch.column("path").to_pylist():
                fs, inside = place(name)
                with fs.open_input_file(inside) as f:
                    packed.append(f.read(8).startswith(PACKED))
            yield pa.record_batch([batch.column("path"), pa.array(packed, pa.bool_())], names=["path", "packed"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                fs, inside = place(name)
                with fs.open_input_file(inside) as f, tarfile.open(fileobj=f, mode="r:") as tar:
                    found = [(name, *key, m.offset_data, m.size) for m in tar if (key := _named(name, m))]
                if found:
                    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=["path", "year", "doy", "at", "size"])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                fs, inside = place(r["path"])
                with fs.open_input_file(inside) as f:
                    f.seek(r["at"])
                    yield _text(r["path"], (r["year"], r["doy"]), f.read(r["size"]))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                fs, inside = place(name)
                # the stream unpacks by the first bytes, not by the file's name
                with fs.open_input_stream(inside, compression=None) as f, tarfile.open(fileobj=f, mode="r|*") as tar:
                    for m in tar:
                        if key := _named(name, m):
                            yield _text(name, key, tar.extractfile(m).read())

    schema = "path string, year int, doy int, text string"
    files = files.repartition("path").mapInArrow(kinds, "path string, packed boolean")
    plain = files.filter("not packed").select("path").mapInArrow(find, "path string, year int, doy int, at long, size long")
    plain = plain.repartition("path", F.col("at")).mapInArrow(ranges, schema)
    return plain.union(files.filter("packed").select("path").mapInArrow(stream, schema))


def _text(path: str, key: tuple[int, int], content: bytes) -> pa.RecordBatch:
    return pa.record_batch([pa.array([path]), pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([content.decode("utf-8", "replace")])], names=["path", "year", "doy", "text"])
