"""The data source of tensor files: headers alone, ranges of bytes, files above 2 GB, malformed ones."""

import json
import os
import struct

import numpy as np
import pytest

from tesserae.functions.tensors import TYPES, decode
from tesserae.sources import containers as C
from tesserae.sources import tensor_files as S


@pytest.fixture(scope="module")
def read(spark):
    spark.dataSource.register(S.TensorFiles)
    return lambda path, **options: spark.read.format("tensors").options(**options).load(str(path))


def test_all_types_in_ranges(tmp_path, read):
    rng = np.random.default_rng(3)
    tensors = []
    for dtype, (per, size, number) in TYPES.items():
        if number >= 0:
            raw = rng.integers(0, 60, 37 * size, dtype=np.uint8).tobytes()
            tensors.append((f"t.{dtype}", dtype, [per, 37], raw))
    (tmp_path / "a.gguf").write_bytes(C.write_gguf([("general.name", 8, "x" * 100_000)], tensors))
    (tmp_path / "b.safetensors").write_bytes(C.write_safetensors(tensors, {"k": "v" * 70_000}))
    (tmp_path / "notes.txt").write_text("not a tensor file")
    rows = read(tmp_path).collect()
    assert len(rows) == 2 * len(tensors)
    for r in rows:
        raw = open(r.path.removeprefix("file://"), "rb").read()[r.start : r.end]
        assert raw == next(t[3] for t in tensors if t[0] == r.name) and r.dtype == r.name[2:]
    got = {}
    for r in sorted(read(tmp_path, values="true", block="1000").collect(), key=lambda r: r.first):
        own = got.setdefault((r.path, r.name), [])
        assert r.first == len(own)
        own += r["values"]
    for (_, name), values in got.items():
        want = decode(next(t[3] for t in tensors if t[0] == name), name[2:])
        assert np.array_equal(np.array(values, np.float32), want, equal_nan=True)
    assert len(got) == 2 * len(tensors)
    assert {r.name for r in read(tmp_path, values="true", names="t.F32,t.Q4_K").collect()} == {"t.F32", "t.Q4_K"}


def test_a_file_above_2_gb(tmp_path, read):
    """Only the header and the wanted range are read: the rest is a hole."""
    first = (5 << 30) // 4
    header = {"big": {"dtype": "F32", "shape": [first], "data_offsets": [0, 4 * first]}, "small": {"dtype": "F32", "shape": [3], "data_offsets": [4 * first, 4 * first + 12]}}
    text = json.dumps(header).encode()
    path = tmp_path / "large.safetensors"
    with open(path, "wb") as f:
        f.write(struct.pack("<Q", len(text)) + text)
        f.seek(8 + len(text) + 4 * first)
        f.write(struct.pack("<3f", 1, 2, 3))
    assert os.path.getsize(path) > 5 << 30
    assert [(r.name, r.end - r.start) for r in read(path).orderBy("start").collect()] == [("big", 5 << 30), ("small", 12)]
    parts = S.Reader({"path": str(path), "values": "true"}).partitions()
    assert len(parts) == 81 and max(sum(r[5] - r[4] for r in p.ranges) for p in parts) <= S.BLOCK
    assert [r["values"] for r in read(path, values="true", names="small").collect()] == [[1, 2, 3]]


@pytest.mark.parametrize("data", [b"", b"GGUF", b"\x10" + bytes(7) + b"{}", struct.pack("<Q", 1 << 40), C.write_safetensors([("a", "F32", [4], bytes(16))])[:-1], C.write_gguf([], [("a", "F32", [4], bytes(16))])[:-17]])
def test_malformed_files_fail(tmp_path, data):
    path = tmp_path / "x.safetensors"
    path.write_bytes(data)
    with pytest.raises(C.Malformed):
        S.header(str(path), len(data))


def test_empty_folder(tmp_path, read):
    assert read(tmp_path).collect() == [] and read(tmp_path, values="true").collect() == []
