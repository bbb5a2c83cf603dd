"""Safetensors and GGUF files as a data source: directories from headers alone, values by ranges of bytes.

    spark.dataSource.register(TensorFiles)
    spark.read.format("tensors").load(folder)                           # a row for each tensor
    spark.read.format("tensors").option("values", "true").load(folder)  # values as float32, in pieces

No file is read as a whole. A header is read from the front, as far as it goes. With values, headers plan the read:
tensors are split into ranges of `block` bytes at whole blocks of their type, small ones share a partition, and a partition reads
its ranges and nothing else. Paths are URIs of a store that all executors reach (file, hdfs, s3, gs), or local paths.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tesserae.functions.tensors import TYPES, decode
from tesserae.sources.containers import TENSORS, Short, read_gguf, read_safetensors

VALUES = "path string, name string, dtype string, first bigint, values array<float>"
#: Bytes of a partition, bytes of a header that are read at first, files to a partition of the directory, and values to a row.
BLOCK, FRONT, FILES, ROW = 64 << 20, 1 << 16, 64, 1 << 16


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = f"file://{path[5:]}"
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of the files under `path` that have an ending of the two kinds, or of the file that it is."""
    store, at = _store(path)
    found = store.get_file_info(at)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if found.type == fs.FileType.File:
        return [(path, found.size)]
    prefix = path[: len(path) - len(at)] if path.endswith(at) else "file://"
    inside = store.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((prefix + f.path, f.size) for f in inside if f.type == fs.FileType.File and f.extension in ("safetensors", "gguf"))


def header(path: str, size: int) -> list[tuple]:
    """Tensors (name, dtype, dims, start, end) of a file of `size` bytes, of which only the front is read."""
    store, at = _store(path)
    with store.open_input_file(at) as f:
        data, want = b"", FRONT
        while True:
            data += f.read_at(min(want, size) - len(data), len(data))
            try:
                return read_gguf(data, size)["tensors"] if data[:4] == b"GGUF" else read_safetensors(data, size)[0]
            except Short:
                if len(data) >= size:
                    raise
                want = 4 * len(data)


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class Ranges(InputPartition):
    """Ranges (path, name, dtype, first, start, end): the number of the first value, and bytes of the file."""

    def __init__(self, ranges: list[tuple]):
        self.ranges = ranges


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.values = options["path"], options.get("values", "false").lower() == "true"
        self.block, self.names = int(options.get("block", BLOCK)), options.get("names")

    def partitions(self) -> list[InputPartition]:
        files = listed(self.path)
        if not self.values:
            return [Files(files[i : i + FILES]) for i in range(0, len(files), FILES)] or [Files([])]
        wanted = set(self.names.split(",")) if self.names else None
        with ThreadPoolExecutor(16) as pool:
            headers = pool.map(lambda f: header(*f), files)
            tensors = [(path, *t) for (path, _), own in zip(files, headers) for t in own if wanted is None or t[0] in wanted]
        return self.packed(tensors)

    def packed(self, tensors: list[tuple]) -> list[InputPartition]:
        out, held, size = [], [], 0
        for path, name, dtype, _, start, end in tensors:
            per, width, _ = TYPES.get(dtype, (1, 1, 0))
            step = max(width, self.block // width * width)
            for at in range(start, end, step):
                stop = min(end, at + step)
                if held and size + stop - at > self.block:
                    out.append(Ranges(held))
                    held, size = [], 0
                held.append((path, name, dtype, (at - start) // width * per, at, stop))
                size += stop - at
        return [*out, Ranges(held)]

    def read(self, partition):
        return self.read_values(partition.ranges) if self.values else self.read_directory(partition.files)

    def read_directory(self, files):
        for path, size in files:
            for name, dtype, dims, start, end in header(path, size):
                yield path, name, dtype, [Decimal(d) for d in dims], start, end

    def read_values(self, ranges):
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
        for path, name, dtype, first, start, end in ranges:
            store, at = _store(path)
            per, width, _ = TYPES.get(dtype, (1, 1, 0))
            step = max(width, ROW // per * width)
            with store.open_input_file(at) as f:
                for place in range(start, end, step):
                    raw = f.read_at(min(end, place + step) - place, place)
                    values = decode(raw, dtype)
                    number = first + (place - start) // width * per
                    row = [pa.array([x], k) for x, k in zip((path, name, dtype, number), kinds)]
                    whole = None if values is None else np.ascontiguousarray(values, np.float32)
                    row.append(pa.array([whole], pa.list_(pa.float32())))
                    yield pa.RecordBatch.from_arrays(row, names=["path", "name", "dtype", "first", "values"])


class TensorFiles(DataSource):
    """Options: path; values (false); block, bytes of a partition; names, the tensors whose values are read, comma-separated."""

    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> str:
        return VALUES if self.options.get("values", "false").lower() == "true" else TENSORS

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes rows (name, content), each a file's bytes, below `folder`; gives (name, bytes). A file appears whole or not at all,
    and a task that runs twice writes the same."""

    def run(batches):
        store, at = _store(folder)
        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"]):
                store.create_dir(f"{at}/{name}".rsplit("/", 1)[0], recursive=True)
                part = f"{at}/{name}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as f:
                    f.write(bytes(content))
                store.move(part, f"{at}/{name}")
            yield pdf[["name"]].assign(bytes=[len(c) for c in pdf["content"]])

    return files.select("name", "content").mapInPandas(run, "name string, bytes bigint")
