"""Binary forms at the edge: EWKB geometries, packed ids, PostgreSQL arrays and COPY streams."""

from __future__ import annotations

import struct
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_Z, _M, _SRID = 0x80000000, 0x40000000, 0x20000000
POINT, LINE, POLYGON, MANY_POINTS, MANY_LINES, MANY_POLYGONS, COLLECTION = range(1, 8)
DEEPEST = 64
_EXPONENT = 1021 << 52  # doubles in [0.25, 0.5)
_LOW = ((1 << 43) - 1, (1 << 43) - 1, (1 << 42) - 1)


class Malformed(ValueError):
    """Not a whole geometry."""


def pack_id(ident: bytes, spare: int = 0) -> tuple[float, float, float]:
    """128 bits of id in the mantissas of three doubles (43, 43, 42 bits), 28 spare bits above them."""
    v = int.from_bytes(ident, "little")
    parts = (v & _LOW[0], v >> 43 & _LOW[1], v >> 86)
    above = ((spare & 0x1FF) << 43, (spare >> 9 & 0x1FF) << 43, (spare >> 18 & 0x3FF) << 42)
    return struct.unpack("<3d", struct.pack("<3Q", *(_EXPONENT | p | a for p, a in zip(parts, above))))


def unpack_id(xyz: tuple[float, float, float]) -> tuple[bytes, int]:
    """(id, spare bits) of three packed doubles."""
    bits = struct.unpack("<3Q", struct.pack("<3d", *xyz))
    v = (bits[0] & _LOW[0]) | (bits[1] & _LOW[1]) << 43 | (bits[2] & _LOW[2]) << 86
    return v.to_bytes(16, "little"), (bits[0] >> 43 & 0x1FF) | (bits[1] >> 43 & 0x1FF) << 9 | (bits[2] >> 42 & 0x3FF) << 18


def _head(kind: int, srid: int | None) -> bytes:
    return struct.pack("<BI", 1, kind | _Z | _M | (_SRID if srid is not None else 0)) + (struct.pack("<I", srid) if srid is not None else b"")


def point(p, srid: int | None = None) -> bytes:
    return _head(POINT, srid) + struct.pack("<4d", *p)


def line(points, srid: int | None = None) -> bytes:
    return _head(LINE, srid) + struct.pack("<I", len(points)) + b"".join(struct.pack("<4d", *p) for p in points)


def polygon(rings, srid: int | None = None) -> bytes:
    return _head(POLYGON, srid) + struct.pack("<I", len(rings)) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<4d", *p) for p in r) for r in rings)


def collection(kind: int, members: list[bytes], srid: int | None = None) -> bytes:
    return _head(kind, srid) + struct.pack("<I", len(members)) + b"".join(members)


def path(vertices: list[tuple[bytes, float, int]]) -> bytes:
    """A path (id, metadata, spare bits): a point if it has one vertex, else a line."""
    points = [(*pack_id(i, s), float(m)) for i, m, s in vertices]
    return point(points[0]) if len(points) == 1 else line(points)


def spans(data: bytes) -> list[list[tuple[float, float, float, float]]]:
    """The vertices of each point, line and ring, in order. Either byte order, EWKB flags or ISO codes; nothing may be left over."""
    out: list[list] = []
    at = 0

    def take(code: str):
        nonlocal at
        size = struct.calcsize(code)
        if at + size > len(data):
            raise Malformed("cut off")
        at += size
        return struct.unpack_from(code, data, at - size)

    def points(order: str, n: int) -> list:
        if n * 32 > len(data) - at:
            raise Malformed("cut off")
        return [take(order + "4d") for _ in range(n)]

    def one(depth: int, want: int | None) -> None:
        if depth > DEEPEST:
            raise Malformed("too deep")
        order = {0: ">", 1: "<"}.get(take("B")[0])
        if order is None:
            raise Malformed("byte order")
        code = take(order + "I")[0]
        if code & _SRID:
            take(order + "I")
        kind, zm = code & 0x0FFFFFFF, bool(code & _Z) and bool(code & _M)
        if kind > 1000:
            kind, zm = kind % 1000, kind // 1000 == 3
        if not zm or not POINT <= kind <= COLLECTION or (want is not None and kind != want):
            raise Malformed("type")
        if kind == POINT:
            out.append(points(order, 1))
        elif kind == LINE:
            out.append(points(order, take(order + "I")[0]))
        elif kind == POLYGON:
            for _ in range(take(order + "I")[0]):
                out.append(points(order, take(order + "I")[0]))
        else:
            for _ in range(take(order + "I")[0]):
                one(depth + 1, kind - 3 if kind < COLLECTION else None)

    one(1, None)
    if at != len(data):
        raise Malformed("left over")
    return out


def vertices_column(data: Column) -> Column:
    """array<struct<part, idx, x, y, z, m>> of a geometry, null if it is malformed."""

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("part", T.IntegerType()), T.StructField("idx", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in "xyzm")])))
    def run(blobs: pd.Series) -> pd.Series:
        def one(b):
            try:
                return [dict(part=k, idx=i, **dict(zip("xyzm", p))) for k, s in enumerate(spans(bytes(b))) for i, p in enumerate(s)]
            except Malformed:
                return None

        return pd.Series([None if b is None else one(b) for b in blobs])

    return run(data)


def path_column(items: Column) -> Column:
    """EWKB of an array of (id binary, m double, spare int)."""

    @F.pandas_udf(T.BinaryType())
    def run(lists: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or not len(x) else path([(bytes(v["id"]), v["m"], int(v["spare"])) for v in x]) for x in lists])

    return run(items)


def pg_array(ids: Iterable[bytes], oid: int = 17) -> bytes:
    ids = list(ids)
    return struct.pack(">5i", 1, 0, oid, len(ids), 1) + b"".join(struct.pack(">i", len(x)) + x for x in ids)


def pg_array_read(data: bytes) -> list[bytes]:
    """Ids of a one-dimensional array; NULLs are skipped, and it ends at the first element that is no id."""
    if len(data) < 20 or struct.unpack_from(">i", data)[0] != 1:
        return []
    out, at = [], 20
    for _ in range(struct.unpack_from(">i", data, 12)[0]):
        if at + 4 > len(data):
            break
        size = struct.unpack_from(">i", data, at)[0]
        at += 4
        if size == -1:
            continue
        if size != 16 or at + 16 > len(data):
            break
        out.append(data[at : at + 16])
        at += 16
    return out


_SIGNATURE = b"PGCOPY\n\xff\r\n\x00" + bytes(8)
_FIELD = {T.ShortType: ">h", T.IntegerType: ">i", T.LongType: ">q", T.FloatType: ">f", T.DoubleType: ">d"}


def copy_stream(rows: Iterable[tuple], kinds: list[T.DataType], flush_at: int = 1 << 22) -> Iterable[bytes]:
    """A binary COPY stream in pieces of about `flush_at` bytes."""
    buffer = bytearray(_SIGNATURE)
    for row in rows:
        if len(buffer) >= flush_at:
            yield bytes(buffer)
            buffer.clear()
        buffer += struct.pack(">h", len(row))
        for value, kind in zip(row, kinds):
            if value is None:
                buffer += struct.pack(">i", -1)
                continue
            code = _FIELD.get(type(kind))
            raw = struct.pack(code, value) if code else bytes([value]) if isinstance(kind, T.BooleanType) else bytes(value) if isinstance(value, (bytes, bytearray)) else str(value).encode()
            buffer += struct.pack(">i", len(raw)) + raw
    buffer += struct.pack(">h", -1)
    yield bytes(buffer)


def copy_files(df: DataFrame) -> DataFrame:
    """(partition, piece, data): one COPY stream for each partition, to be written or sent in order of pieces."""
    kinds = [f.dataType for f in df.schema.fields]

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        rows = (tuple(r.values()) for b in batches for r in b.to_pylist())
        for i, piece in enumerate(copy_stream(rows, kinds)):
            yield pa.RecordBatch.from_pydict({"partition": pa.array([part], pa.int32()), "piece": pa.array([i], pa.int32()), "data": pa.array([piece], pa.binary())})

    return df.mapInArrow(run, "partition int, piece int, data binary")
