"""Safetensors and GGUF files: directory rows from bytes, and writers for both."""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tesserae.functions.tensors import BY_NUMBER, TYPES

LARGEST_HEADER, MOST_DIMS = 256 << 20, 8
TENSORS = "path string, name string, dtype string, dims array<decimal(20,0)>, start bigint, end bigint"
#: GGUF value types by number, with the struct code of those of fixed size. (Fixed values.)
KINDS = ("UINT8", "INT8", "UINT16", "INT16", "UINT32", "INT32", "FLOAT32", "BOOL", "STRING", "ARRAY", "UINT64", "INT64", "FLOAT64")
_CODES = {0: "B", 1: "b", 2: "H", 3: "h", 4: "I", 5: "i", 6: "f", 7: "?", 10: "Q", 11: "q", 12: "d"}


class Malformed(ValueError):
    """The file isn't what it says it is; nothing of it is used."""


class Short(Malformed):
    """What was read of the file ends before its header does."""


def read_safetensors(data: bytes, whole: int | None = None) -> tuple[list[tuple], dict | None]:
    """Tensors (name, dtype, dims, start, end in the file) in order of their data, and the metadata.

    `data` may be no more than the header, if `whole` says how long the file is.
    """
    whole = len(data) if whole is None else whole
    if whole < 8 or len(data) >= 8 and struct.unpack_from("<Q", data)[0] > min(LARGEST_HEADER, whole - 8):
        raise Malformed("header")
    if len(data) < 8 or len(data) < 8 + (size := struct.unpack_from("<Q", data)[0]):
        raise Short("header")
    try:
        header = json.loads(data[8 : 8 + size].decode("utf-8", "surrogatepass"), strict=False)
    except ValueError as e:
        raise Malformed("header") from e
    if not isinstance(header, dict):
        raise Malformed("header")
    meta, base, out = header.pop("__metadata__", None), 8 + size, []
    for name, x in header.items():
        try:
            dtype, dims, (start, end) = x["dtype"], x["shape"], x["data_offsets"]
        except (KeyError, TypeError, ValueError) as e:
            raise Malformed(name) from e
        if len(dims) > MOST_DIMS or not 0 <= start <= end or base + end > whole:
            raise Malformed(name)
        out.append((name, dtype if dtype in TYPES else "UNKNOWN", dims, base + start, base + end))
    return sorted(out, key=lambda t: t[3]), meta


def write_safetensors(tensors: list[tuple[str, str, list[int], bytes]], metadata: dict | None = None) -> bytes:
    at, header = 0, {"__metadata__": metadata} if metadata else {}
    for name, dtype, dims, raw in tensors:
        header[name] = {"dtype": dtype, "shape": dims, "data_offsets": [at, at + len(raw)]}
        at += len(raw)
    text = json.dumps(header, separators=(",", ":")).encode()
    return struct.pack("<Q", len(text)) + text + b"".join(t[3] for t in tensors)


class _Reader:
    def __init__(self, data: bytes, whole: int):
        self.data, self.at, self.whole = data, 0, whole

    def needs(self, size: int) -> None:
        if self.at + size > self.whole:
            raise Malformed("cut off")
        if self.at + size > len(self.data):
            raise Short("cut off")

    def take(self, code: str):
        size = struct.calcsize("<" + code)
        self.needs(size)
        self.at += size
        return struct.unpack_from("<" + code, self.data, self.at - size)[0]

    def text(self) -> str:
        n = self.take("Q")
        self.needs(n)
        self.at += n
        return self.data[self.at - n : self.at].decode("utf-8", "replace")

    def value(self, kind: int):
        if kind in _CODES:
            return self.take(_CODES[kind])
        if kind == 8:
            return self.text()
        if kind != 9:
            raise Malformed("value type")
        inner, n = self.take("I"), self.take("Q")
        if inner == 9 or n > self.whole:
            raise Malformed("array")
        return [self.value(inner) for _ in range(n)]


def read_gguf(data: bytes, whole: int | None = None) -> dict:
    """version, alignment, data_offset, kv [(key, kind, value)] and tensors [(name, dtype, dims, start, end)].

    `data` may be no more than the header, if `whole` says how long the file is.
    """
    whole = len(data) if whole is None else whole
    r = _Reader(data, whole)
    if data[:4] != b"GGUF":
        raise Malformed("magic")
    r.at = 4
    version = r.take("I")
    if version not in (2, 3):
        raise Malformed("version")
    n_tensors, n_values = r.take("Q"), r.take("Q")
    if max(n_tensors, n_values) > whole:
        raise Malformed("counts")
    kv = []
    for _ in range(n_values):
        key, kind = r.text(), r.take("I")
        kv.append((key, kind, r.value(kind)))
    alignment = next((v for k, kind, v in kv if k == "general.alignment" and kind == 4), 32)
    if alignment < 1 or alignment > 65536 or alignment & (alignment - 1):
        raise Malformed("alignment")
    listed = []
    for _ in range(n_tensors):
        name, n = r.text(), r.take("I")
        if n > MOST_DIMS:
            raise Malformed(name)
        listed.append((name, [r.take("Q") for _ in range(n)], r.take("I"), r.take("Q")))
    base = -(-r.at // alignment) * alignment
    tensors = []
    for name, dims, number, offset in listed:
        dtype = BY_NUMBER.get(number, "UNKNOWN")
        values = 1
        for d in dims:
            values *= d
        per, size, _ = TYPES.get(dtype, (1, 0, 0))
        length = values // per * size if values % per == 0 else 0
        if base + offset + length > whole:
            raise Malformed(name)
        tensors.append((name, dtype, dims, base + offset, base + offset + length))
    return {"version": version, "alignment": alignment, "data_offset": base, "kv": kv, "tensors": tensors}


def write_gguf(kv: list[tuple[str, int, object]], tensors: list[tuple[str, str, list[int], bytes]], alignment: int = 32) -> bytes:
    text = lambda s: struct.pack("<Q", len(s.encode())) + s.encode()

    def value(kind, v):
        if kind == 8:
            return text(v)
        if kind == 9:
            inner, items = v
            return struct.pack("<IQ", inner, len(items)) + b"".join(value(inner, x) for x in items)
        return struct.pack("<" + _CODES[kind], v)

    kv = [x for x in kv if x[0] != "general.alignment"] + [("general.alignment", 4, alignment)]
    out = b"GGUF" + struct.pack("<IQQ", 3, len(tensors), len(kv)) + b"".join(text(k) + struct.pack("<I", kind) + value(kind, v) for k, kind, v in kv)
    at, body = 0, b""
    for name, dtype, dims, raw in tensors:
        out += text(name) + struct.pack("<I", len(dims)) + b"".join(struct.pack("<Q", d) for d in dims) + struct.pack("<IQ", TYPES[dtype][2], at)
        body += raw + bytes(-len(raw) % alignment)
        at = len(body)
    return out + bytes(-len(out) % alignment) + body


def tensor_directory(files: DataFrame, content: str = "content") -> DataFrame:
    """Rows of all tensors of Safetensors or GGUF files, from rows (path, content) as the binaryFile source gives them.

    A malformed file fails the job: nothing of it is used. start and end are places in the file.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf[content]):
                data = bytes(data)
                found = read_gguf(data)["tensors"] if data[:4] == b"GGUF" else read_safetensors(data)[0]
                rows += [(path, name, dtype, [*map(_decimal, dims)], start, end) for name, dtype, dims, start, end in found]
            yield pd.DataFrame(rows, columns=["path", "name", "dtype", "dims", "start", "end"])

    return files.select("path", content).mapInPandas(run, TENSORS)


def _decimal(x: int):
    from decimal import Decimal

    return Decimal(x)


def gguf_values(files: DataFrame, content: str = "content") -> DataFrame:
    """(path, key, kind, value): key-values of GGUF files, the value as JSON."""

    def run(batches):
        for pdf in batches:
            rows = [(path, k, KINDS[kind], json.dumps(v)) for path, data in zip(pdf["path"], pdf[content]) for k, kind, v in read_gguf(bytes(data))["kv"]]
            yield pd.DataFrame(rows, columns=["path", "key", "kind", "value"])

    return files.select("path", content).mapInPandas(run, T.StructType([T.StructField(c, T.StringType()) for c in ("path", "key", "kind", "value")]))
