"""BPE encoding and decoding of a text column."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm import bpe
from tesserae.llm.common import table

TOKENIZER = "byte_bpe_50k.json"


def _each_batch(df: DataFrame, columns: list[tuple[str, T.DataType]], read: list[str], work) -> DataFrame:
    """Add columns made by work(*arrays) -> list of arrays from the columns `read`, batch by batch; same-named ones are replaced."""
    made_names = [c for c, _ in columns]
    rest = [c for c in df.columns if c not in made_names]

    def run(batches):
        for batch in batches:
            # a batch may hold very long texts: it is worked on in parts
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                column = lambda c: part.column(part.schema.get_field_index(c))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([*map(column, rest), *work(*map(column, read))], names=[*rest, *made_names])

    schema = T.StructType([*(df.schema[c] for c in rest), *(T.StructField(c, t) for c, t in columns)])
    return df.mapInArrow(run, schema)


def _ids_array(parts: list) -> pa.Array:
    sizes = [len(x) // 4 for x in parts]
    offsets = pa.array([0, *accumulate(sizes)], type=pa.int32())
    flat = pa.Array.from_buffers(pa.int32(), sum(sizes), [None, pa.py_buffer(b"".join(parts))])
    return pa.ListArray.from_arrays(offsets, flat)


def _encoded(encoder: bpe.Encoder, texts: pa.Array) -> list[bytes]:
    bodies = [x or "" for x in texts.to_pylist()]
    encoder.learn(bodies)
    return [b"".join(encoder.stream(x)) for x in bodies]


def encode(df: DataFrame, text: str = "text", out: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """Add `out` array<int>: the ids of the whole text. Null texts count as empty: no ids. Every row stays, with every column."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)

    def work(texts):
        return [_ids_array(_encoded(bpe.encoder(path), texts))]

    return _each_batch(df, [(out, T.ArrayType(T.IntegerType()))], [text], work)


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", tokenizer: str | None = None) -> DataFrame:
    """Add `out` string: the text of the ids. Null ids give an empty text; an id outside the vocabulary fails the job."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)

    def work(lists):
        d = bpe.Decoder(bpe.vocabulary(path))
        return [pa.array([d.decode(x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, "i4")) for x in lists], pa.string())]

    return _each_batch(df, [(out, T.StringType())], [ids], work)


def round_trip(df: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded", tokenizer: str | None = None) -> DataFrame:
    """encode() and decode() in one pass over the rows."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)

    def work(texts):
        e, d = bpe.encoder(path), bpe.Decoder(bpe.vocabulary(path))
        packed = _encoded(e, texts)
        numbers = _ids_array(packed)
        back = [d.decode(np.frombuffer(x, dtype="<i4")) for x in packed]
        return [numbers, pa.array(back, pa.string())]

    return _each_batch(df, [(ids, T.ArrayType(T.IntegerType())), (decoded, T.StringType())], [text], work)


def digests(df: DataFrame) -> DataFrame:
    """doc_id, n_tokens and digests, from the columns ids and decoded."""
    return df.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(round_trip(docs).drop("text"))
