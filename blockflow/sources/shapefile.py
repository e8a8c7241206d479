"""Shapefiles of polygons as a Spark data source (S8 from the published files).

``register(spark)`` once, then ``spark.read.format("shapefile").load(path)``
and ``df.write.format("shapefile").mode("append").save(folder)``.  ``path`` is
a ``.shp`` file or a folder of them, each with its ``.shx`` index and ``.dbf``
table beside it.

Rows: the columns of the table, ``xmin, ymin, xmax, ymax`` (the box in the
record's header) and ``geometry`` (parts -> rings -> vertices, as in
``files.read_polygons``).  In the file the rings of a polygon stand in any
order, clockwise ones outer, the others holes; a hole goes to the smallest
outer ring around it.

Reading is split by record ranges of the index.  Filters on table columns and
on the box are pushed down: a range's table rows are compared first, then the
record headers, and only records that pass are parsed.  ``option("columns",
"a,b")`` reads these alone; without ``geometry`` and box the ``.shp`` file is
not opened.

Writing: each task writes its own files (a new one every ``FILE_BYTES``) under
hidden names, which the commit makes visible.  Text columns hold 254 bytes at
most and names 10; longer ones are an error.  An empty text reads as null.
"""

from __future__ import annotations

import os
import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession, types as T
from pyspark.sql import datasource as ds

from ..schemas import MULTIPOLYGON

RECORDS, FILE_BYTES = 4096, 1 << 30
_BOX = ["xmin", "ymin", "xmax", "ymax"]
# fixed values of the file format
_CODE, _VERSION, _POLYGON, _NULL = 9994, 1000, 5, 0


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Shapefile)


# --- files -----------------------------------------------------------------------

def _fs(path: str):
    """(file system, path in it) of a plain path or a URI."""
    from pyarrow import fs
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)


def _part(path: str, start: int = 0, size: int | None = None) -> bytes:
    system, p = _fs(path)
    with system.open_input_file(p) as f:
        f.seek(start)
        return f.read() if size is None else f.read(size)


def _shapes(path: str) -> list[str]:
    from pyarrow import fs
    system, p = _fs(path)
    info = system.get_file_info(p)
    if info.type == fs.FileType.File:
        return [path]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = system.get_file_info(fs.FileSelector(p))
    names = sorted(posixpath.basename(i.path) for i in found if i.type == fs.FileType.File)
    return [f"{path.rstrip('/')}/{n}" for n in names if n.lower().endswith(".shp") and n[0] not in "_."]


def _beside(shp: str, ending: str) -> str:
    return shp[:-4] + (ending.upper() if shp.endswith(".SHP") else ending)


# --- the table -------------------------------------------------------------------

@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    width: int
    decimals: int

    @property
    def type(self) -> T.DataType:
        if self.kind in "NF":
            return T.LongType() if self.kind == "N" and not self.decimals and self.width <= 20 else T.DoubleType()
        return {"L": T.BooleanType(), "D": T.DateType()}.get(self.kind, T.StringType())

    def values(self, raw: np.ndarray, encoding: str) -> list:
        """Python values of a column of fixed-width bytes."""
        texts = [b.decode(encoding, "replace").strip(" \0") for b in raw.tolist()]
        kind = self.type
        if isinstance(kind, T.StringType):
            return [t or None for t in texts]
        if isinstance(kind, T.BooleanType):
            return [True if t in ("T", "t", "Y", "y") else False if t in ("F", "f", "N", "n") else None for t in texts]
        if isinstance(kind, T.DateType):
            from datetime import date
            return [date(int(t[:4]), int(t[4:6]), int(t[6:8])) if len(t) == 8 and t.isdigit() else None for t in texts]
        number = int if isinstance(kind, T.LongType) else float
        return [number(t) if t and "*" not in t else None for t in texts]


def table_header(dbf: str) -> tuple[int, int, int, list[Field]]:
    """(records, bytes of the header, bytes of a record, fields)."""
    n, header, size = struct.unpack_from("<IHH", _part(dbf, 4, 8))
    raw, out = _part(dbf, 32, header - 32), []
    for at in range(0, len(raw) - 31, 32):
        if raw[at] == 0x0D:
            break
        out.append(Field(raw[at:at + 11].split(b"\0")[0].decode("ascii", "replace"), chr(raw[at + 11]), raw[at + 16], raw[at + 17]))
    return n, header, size, out


# --- polygons --------------------------------------------------------------------

def _area(r: np.ndarray) -> float:
    x, y = r[:, 0] - r[0, 0], r[:, 1] - r[0, 1]
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


def _around(ring: np.ndarray, point: np.ndarray) -> bool:
    (x, y), a, b = point, ring[:-1], ring[1:]
    cross = (a[:, 1] > y) != (b[:, 1] > y)
    a, b = a[cross], b[cross]
    return bool((x < (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]).sum() % 2)


def parts_of(content: bytes) -> list[list[np.ndarray]] | None:
    """The parts (outer ring, holes) of a record's content; None for a null shape."""
    kind = struct.unpack_from("<i", content)[0]
    if kind == _NULL:
        return None
    if kind % 10 != _POLYGON:                                # 15 and 25 are polygons with further numbers behind
        raise ValueError(f"shape type {kind} is no polygon")
    n, points = struct.unpack_from("<2i", content, 36)
    starts = np.frombuffer(content, "<i4", n, 44)
    xy = np.frombuffer(content, "<f8", 2 * points, 44 + 4 * n).reshape(-1, 2)
    rings = [r for r in np.split(xy, starts[1:]) if len(r) > 1]
    areas = [_area(r) for r in rings]
    outer = [i for i, a in enumerate(areas) if a < 0] or list(range(len(rings)))
    parts = {i: [rings[i]] for i in outer}
    for i, r in enumerate(rings):
        if i not in parts:
            near = [o for o in outer if abs(areas[o]) >= abs(areas[i]) and _around(rings[o], r[0])]
            parts[min(near, key=lambda o: abs(areas[o])) if near else max((o for o in outer if o < i), default=outer[0])].append(r)
    return list(parts.values())


def _geometry(rows: list[list[list[np.ndarray]] | None]) -> pa.Array:
    rings = [r for parts in rows if parts for p in parts for r in p]
    xy = np.concatenate(rings) if rings else np.zeros((0, 2))
    points = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xy[:, i])) for i in (0, 1)], ["x", "y"])

    def lists(sizes, inner):
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), inner)
    ring = lists([len(r) for r in rings], points)
    part = lists([len(p) for parts in rows if parts for p in parts], ring)
    whole = lists([len(parts) if parts else 0 for parts in rows], part)
    nulls = pa.array([parts is None for parts in rows])
    return pa.ListArray.from_arrays(whole.offsets, part, mask=nulls)


def record_of(geometry: list | None) -> tuple[bytes, tuple | None]:
    """(content of a record, its box) of parts -> rings -> (x, y) vertices."""
    if geometry is None:
        return struct.pack("<i", _NULL), None
    rings = []
    for part in geometry:
        for i, ring in enumerate(part):
            r = np.array([(v["x"], v["y"]) for v in ring], dtype="<f8")
            if len(r) and (_area(r) > 0) == (i == 0):         # outer clockwise, holes the other way
                r = r[::-1]
            if len(r):
                rings.append(r)
    if not rings:
        return struct.pack("<i", _NULL), None
    xy = np.concatenate(rings)
    box = (*xy.min(axis=0).tolist(), *xy.max(axis=0).tolist())
    starts = np.cumsum([0, *map(len, rings[:-1])]).astype("<i4")
    return struct.pack("<i4d2i", _POLYGON, *box, len(rings), len(xy)) + starts.tobytes() + np.ascontiguousarray(xy).tobytes(), box


# --- the data source ----------------------------------------------------------------

@dataclass
class Records(ds.InputPartition):
    shp: str
    first: int
    last: int


class Shapefile(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def _files(self) -> list[str]:
        return _shapes(self.options["path"])

    def schema(self) -> T.StructType:
        files = self._files()
        if not files:
            raise ValueError(f"no .shp file in {self.options['path']}")
        fields = [T.StructField(f.name, f.type) for f in table_header(_beside(files[0], ".dbf"))[3]]
        fields += [T.StructField(c, T.DoubleType()) for c in _BOX] + [T.StructField("geometry", MULTIPOLYGON)]
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        if wanted:
            known = {f.name.lower(): f for f in fields}
            missing = [c for c in wanted if c.lower() not in known]
            if missing:
                raise ValueError(f"no column {missing}")
            fields = [known[c.lower()] for c in wanted]
        return T.StructType(fields)

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self._files(), schema, self.options.get("encoding", "utf-8"), int(self.options.get("records", RECORDS)))

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("write with mode append into a folder of its own")
        return Writer(self.options["path"], schema)


_TESTS = {
    ds.EqualTo: lambda v, w: v == w, ds.GreaterThan: lambda v, w: v > w, ds.GreaterThanOrEqual: lambda v, w: v >= w,
    ds.LessThan: lambda v, w: v < w, ds.LessThanOrEqual: lambda v, w: v <= w, ds.In: lambda v, w: v in w,
}


class Reader(ds.DataSourceReader):
    def __init__(self, files: list[str], schema: T.StructType, encoding: str, records: int):
        self.files, self.columns, self.encoding, self.records = files, schema.names, encoding, records
        self.arrow = {f.name: f.dataType for f in schema.fields}
        self.tests: list[tuple[str, str, object]] = []         # (column, kind of filter, value)

    def pushFilters(self, filters):
        for f in filters:
            column = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if type(f) in _TESTS and column in self.columns and column != "geometry" and f.value is not None:
                self.tests.append((column, type(f).__name__, f.value))
            elif isinstance(f, ds.IsNotNull) and column in self.columns and column != "geometry":
                self.tests.append((column, "IsNotNull", None))
            else:
                yield f

    def partitions(self):
        out = []
        for shp in self.files:
            n = table_header(_beside(shp, ".dbf"))[0]
            out += [Records(shp, a, min(n, a + self.records)) for a in range(0, n, self.records)]
        return out or [Records("", 0, 0)]

    def _passes(self, column: str, values: list, keep: list[bool]) -> list[bool]:
        for c, kind, value in self.tests:
            if c == column:
                test = (lambda v, w: True) if kind == "IsNotNull" else _TESTS[getattr(ds, kind)]
                keep = [k and v is not None and test(v, value) for k, v in zip(keep, values)]
        return keep

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type
        n = partition.last - partition.first
        if not n:
            return
        _, header, size, fields = table_header(_beside(partition.shp, ".dbf"))
        raw = _part(_beside(partition.shp, ".dbf"), header + size * partition.first, size * n)
        kind = np.dtype([("deleted", "S1"), *((f.name, f"V{f.width}") for f in fields)])
        rows = np.frombuffer(raw, dtype=kind)
        keep, values = [b != b"*" for b in rows["deleted"].tolist()], {}
        for f in fields:
            if f.name in self.columns:
                values[f.name] = f.values(rows[f.name], self.encoding)
                keep = self._passes(f.name, values[f.name], keep)
        if any(keep) and ({"geometry", *_BOX} & set(self.columns)):
            index = np.frombuffer(_part(_beside(partition.shp, ".shx"), 100 + 8 * partition.first, 8 * n), dtype=">i4").reshape(-1, 2).astype(np.int64) * 2
            contents = self._contents(partition.shp, index, keep)
            boxes = [struct.unpack_from("<4d", c, 4) if c is not None and len(c) >= 36 else (None,) * 4 for c in contents]
            for i, c in enumerate(_BOX):
                if c in self.columns:
                    values[c] = [b[i] for b in boxes]
                    keep = self._passes(c, values[c], keep)
            if "geometry" in self.columns:
                values["geometry"] = [parts_of(c) if k else None for c, k in zip(contents, keep)]
        some = [i for i, k in enumerate(keep) if k]
        if not some:
            return
        columns = []
        for c in self.columns:
            mine = [values[c][i] for i in some]
            columns.append(_geometry(mine) if c == "geometry" else pa.array(mine, to_arrow_type(self.arrow[c])))
        yield pa.RecordBatch.from_arrays(columns, names=list(self.columns))

    @staticmethod
    def _contents(shp: str, index: np.ndarray, keep: list[bool]) -> list[bytes | None]:
        """The contents of the wanted records: one read where most are wanted, else one each."""
        some = [i for i, k in enumerate(keep) if k]
        out: list[bytes | None] = [None] * len(keep)
        system, p = _fs(shp)
        with system.open_input_file(p) as f:
            if 4 * len(some) >= len(keep):
                low, high = int(index[some, 0].min()), int((index[some, 0] + index[some, 1]).max()) + 8
                f.seek(low)
                block = f.read(high - low)
                for i in some:
                    a = int(index[i, 0]) - low + 8
                    out[i] = block[a:a + int(index[i, 1])]
            else:
                for i in some:
                    f.seek(int(index[i, 0]) + 8)
                    out[i] = f.read(int(index[i, 1]))
        return out


@dataclass
class Written(ds.WriterCommitMessage):
    names: list


class Writer(ds.DataSourceWriter):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.fields, self.rest = path, [], []
        for f in schema.fields:
            kind = f.dataType
            if f.name == "geometry" or f.name in _BOX:
                continue
            if len(f.name.encode()) > 10:
                raise ValueError(f"column name {f.name!r} is longer than 10 bytes")
            if isinstance(kind, T.StringType):
                self.fields.append(Field(f.name, "C", 254, 0))
            elif isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
                self.fields.append(Field(f.name, "N", 20, 0))
            elif isinstance(kind, (T.DoubleType, T.FloatType)):
                self.fields.append(Field(f.name, "F", 24, 16))
            elif isinstance(kind, T.BooleanType):
                self.fields.append(Field(f.name, "L", 1, 0))
            elif isinstance(kind, T.DateType):
                self.fields.append(Field(f.name, "D", 8, 0))
            else:
                raise ValueError(f"column {f.name!r} of type {kind.simpleString()} has no place in a .dbf table")
        if "geometry" not in schema.names:
            raise ValueError("no geometry column")

    @staticmethod
    def _text(field: Field, value) -> bytes:
        if value is None:
            raw = b"?" if field.kind == "L" else b""
        elif field.kind == "L":
            raw = b"T" if value else b"F"
        elif field.kind == "D":
            raw = value.strftime("%Y%m%d").encode()
        else:
            raw = (repr(float(value)) if field.kind == "F" else str(value)).encode()
        if len(raw) > field.width:
            raise ValueError(f"{field.name}: {value!r} is longer than {field.width} bytes")
        return raw.rjust(field.width) if field.kind in "NF" else raw.ljust(field.width)

    def write(self, iterator) -> Written:
        names, system, base = [], *_fs(self.path)
        system.create_dir(base, recursive=True)
        open_ = None
        for row in iterator:
            content, box = record_of(row["geometry"])
            if open_ is None:
                names.append(f"part-{uuid.uuid4().hex}")
                open_ = _Open(system, f"{base}/_{names[-1]}", self.fields)
            open_.add(content, box, b" " + b"".join(self._text(f, row[f.name]) for f in self.fields))
            if open_.at > FILE_BYTES:
                open_.close()
                open_ = None
        if open_:
            open_.close()
        return Written(names)

    def _each(self, messages):
        system, base = _fs(self.path)
        for m in messages:
            for name in m.names if m else ():
                for ending in (".dbf", ".shx", ".shp"):          # the .shp last: its name is what a reader looks for
                    yield system, f"{base}/_{name}{ending}", f"{base}/{name}{ending}"

    def commit(self, messages) -> None:
        for system, hidden, name in self._each(messages):
            system.move(hidden, name)

    def abort(self, messages) -> None:
        for system, hidden, _ in self._each(messages):
            system.delete_file(hidden)


class _Open:
    """A .shp, .shx and .dbf being written; their headers are set at the end."""

    def __init__(self, system, stem: str, fields: list[Field]):
        self.system, self.stem, self.fields = system, stem, fields
        self.at, self.box, self.shp, self.shx, self.dbf = 100, None, [], [], []

    def add(self, content: bytes, box: tuple | None, row: bytes) -> None:
        words = len(content) // 2
        self.shp.append(struct.pack(">2i", len(self.shx) + 1, words) + content)
        self.shx.append(struct.pack(">2i", self.at // 2, words))
        self.dbf.append(row)
        self.at += 8 + len(content)
        if box:
            b = self.box or box
            self.box = (min(b[0], box[0]), min(b[1], box[1]), max(b[2], box[2]), max(b[3], box[3]))

    def close(self) -> None:
        def header(size: int) -> bytes:
            return struct.pack(">7i", _CODE, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i8d", _VERSION, _POLYGON, *(self.box or (0.0,) * 4), 0, 0, 0, 0)

        described = b"".join(f.name.encode().ljust(11, b"\0") + f.kind.encode() + b"\0" * 4 + bytes([f.width, f.decimals]) + b"\0" * 14
                             for f in self.fields) + b"\r"
        size = 1 + sum(f.width for f in self.fields)
        table = struct.pack("<4BIHH20x", 3, 95, 7, 26, len(self.dbf), 32 + len(described), size) + described
        for ending, parts in ((".shp", [header(self.at), *self.shp]), (".shx", [header(100 + 8 * len(self.shx)), *self.shx]),
                              (".dbf", [table, *self.dbf, b"\x1a"])):
            with self.system.open_output_stream(self.stem + ending) as f:
                for p in parts:
                    f.write(p)
