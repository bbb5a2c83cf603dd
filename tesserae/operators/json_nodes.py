"""JSON documents as a flat table of nodes: repeated names, the order of members and lone surrogates are kept."""

from __future__ import annotations

import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions.json_values import DEEPEST

#: White space, then a string, a number, a literal or a mark, as RFC 8259 writes them.
_TOKEN = re.compile(r'[ \t\n\r]*+(?:("(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?)|(true|false|null)|([\[\]{},:]))')
_KINDS = {"{": "object", "[": "array", "t": "bool", "f": "bool", "n": "null", '"': "string"}
_CLOSES = {"{": "}", "[": "]"}
#: Nodes to a batch, about; a document's nodes are never taken apart.
BATCH = 20_000
_FIELDS = (("n", T.IntegerType()), ("parent", T.IntegerType()), ("ordinal", T.IntegerType()), ("key", T.StringType()), ("kind", T.StringType()), ("size", T.IntegerType()), ("raw", T.StringType()), ("after", T.StringType()))


def scan(text: str) -> list[list] | None:
    """Nodes in the order in which they begin: [n, parent, ordinal, key, kind, size, raw, after]; None if `text` isn't one JSON value."""
    nodes: list[list] = []
    open_: list[int] = []
    want, key, at = "value", None, 0
    while m := _TOKEN.match(text, at):
        at, (string, number, literal, mark) = m.end(), m.groups()
        if want == "colon" and mark == ":":
            want = "value"
        elif want == "next" and mark == ",":
            want = "key" if nodes[open_[-1]][6] == "{" else "value"
        elif want in ("key", "first }") and string:
            key, want = string[1:-1], "colon"
        elif mark and mark in "]}" and (want == "first " + mark or want == "next" and mark == _CLOSES[nodes[open_[-1]][6]]):
            nodes[-1][7] += mark
            open_.pop()
            want = "next" if open_ else "end"
        elif want in ("value", "first ]") and (string or number or literal or mark in ("[", "{")):
            raw = string or number or literal or mark
            parent = open_[-1] if open_ else None
            nodes.append([len(nodes), parent, nodes[parent][5] if open_ else 0, key, _KINDS.get(raw[0], "number"), 0, raw, ""])
            if open_:
                nodes[parent][5] += 1
            key = None
            if mark:
                open_.append(len(nodes) - 1)
                if len(open_) > DEEPEST:
                    return None
                want = "first " + _CLOSES[mark]
            else:
                want = "next" if open_ else "end"
        else:
            return None
    return nodes if want == "end" and not text[at:].strip(" \t\r\n") else None


def nodes(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, n, parent, ordinal, key, kind, size, raw, after): a row for each value of each document.

    n numbers a document's values as they begin, 0 is the whole; ordinal is the place among the parent's members; key is the
    member's name as it is written between its quotes (null in arrays); raw is a scalar as it is written, or the opening
    bracket; after holds the brackets that close behind it. Null texts and texts that aren't one value by RFC 8259, at most
    256 levels deep, have no rows. Texts under one doc, null included, each give their rows.
    """

    def run(batches):
        for batch in batches:
            docs, texts, at, found = batch.column(0), batch.column(1).to_pylist(), [], []

            def flush():
                columns = list(zip(*found)) or [()] * len(_FIELDS)
                arrays = [pa.array(c, pa.int32() if isinstance(t, T.IntegerType) else pa.string()) for c, (_, t) in zip(columns, _FIELDS)]
                return pa.RecordBatch.from_arrays([docs.take(pa.array(at, pa.int64())), *arrays], names=[doc, *(n for n, _ in _FIELDS)])

            for k, t in enumerate(texts):
                rows = scan(t) if t is not None else None
                if rows:
                    found += rows
                    at += [k] * len(rows)
                if len(found) >= BATCH:
                    yield flush()
                    at, found = [], []
            yield flush()

    return df.select(doc, text).mapInArrow(run, T.StructType([df.schema[doc], *(T.StructField(n, t) for n, t in _FIELDS)]))


def rebuilt(table: DataFrame, doc: str) -> DataFrame:
    """(doc, text): each document from its nodes, without white space between its tokens. Docs must be unique."""
    name = F.when(F.col("key").isNotNull(), F.concat(F.lit('"'), "key", F.lit('":'))).otherwise("")
    piece = F.concat(F.when(F.col("ordinal") > 0, ",").otherwise(""), name, "raw", "after")
    parts = table.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("n", piece.alias("piece")))).alias("parts"))
    return parts.select(doc, F.array_join(F.col("parts.piece"), "").alias("text"))


def members(table: DataFrame, doc: str, key: str) -> DataFrame:
    """All members of that name of each document's outermost object, repeated ones included, in order: doc, rank (from 1) and the node."""
    from pyspark.sql.window import Window

    own = table.where((F.col("parent") == 0) & (F.col("key") == key))
    return own.withColumn("rank", F.row_number().over(Window.partitionBy(doc).orderBy("ordinal")))


def string_bytes(raw: Column) -> Column:
    """The bytes of a string or name as it is written, without quotes: UTF-8, in which a lone surrogate has its three bytes."""

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.loads(f'"{t}"').encode("utf-8", "surrogatepass"), na_action="ignore")

    return run(raw)
