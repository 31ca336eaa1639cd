"""Token counts of the documents in flat token files, by a scan for separators.

A flat file is a run of token ids, little-endian 16-bit, each document followed
by the end-of-document id; nothing says where documents begin. It is held as
numbered blocks of bytes that are cut without regard to documents. Each block is
searched at once for separators, which gives whole documents inside it and the
open pieces at its ends. A prefix scan over the blocks' numbers of separators
gives every piece the ordinal of its document, and the open pieces with the same
ordinal are added up.
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Tokens in a block, and blocks whose sums the upper level of the prefix scan takes together.
BLOCK_TOKENS, STRETCH = 32_768, 1024
#: Blocks of tokens that a writer holds before it cuts them.
TOGETHER = 16


@cache
def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
    return tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def flatten(docs: DataFrame, path: str, pattern: str, separator: int, text: str = "text") -> DataFrame:
    """Writes each partition as one flat file: rows (file, block, data), and (file, ordinal, doc_id) beside them.

    The second kind of row says which document was written in which place; doc_id
    keeps its type, and null or repeated ones have a place of their own each. A
    null or empty text has no tokens, only its separator. Ids must be below 65,536.
    Columns other than doc_id and the text are not read. An empty table gives an
    empty result.
    """

    def run(batches):
        file, encode = TaskContext.get().partitionId(), _encoding(path, pattern).encode_to_numpy
        end = np.array([separator], np.uint16)
        ordinal, block, parts, size, kind = 0, 0, [], 0, None
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column(text)
            n, kind = len(ids), ids.type
            yield rows(file, n, kind, ordinal=np.arange(ordinal, ordinal + n), doc_id=ids)
            ordinal += n
            for t in texts:
                parts += [encode(t.as_py() or "", disallowed_special=()).astype(np.uint16), end]
                size += len(parts[-2]) + 1
                if size >= TOGETHER * BLOCK_TOKENS:
                    data, rest = blocks_of(parts)
                    yield rows(file, len(data), kind, block=np.arange(block, block + len(data)), data=data)
                    block, parts, size = block + len(data), [rest], len(rest)
        data, rest = blocks_of(parts) if parts else ([], [])
        data += [rest.astype("<u2").tobytes()] if len(rest) else []
        if data:
            yield rows(file, len(data), kind, block=np.arange(block, block + len(data)), data=data)

    def blocks_of(parts):
        """The whole blocks in a run of tokens, and what is left."""
        flat = np.concatenate(parts).astype("<u2", copy=False)
        whole = len(flat) // BLOCK_TOKENS * BLOCK_TOKENS
        return [flat[at : at + BLOCK_TOKENS].tobytes() for at in range(0, whole, BLOCK_TOKENS)], flat[whole:]

    def rows(file, n, kind, block=None, data=None, ordinal=None, doc_id=None):
        given = ((block, pa.int64()), (data, pa.binary()), (ordinal, pa.int64()), (doc_id, kind))
        arrays = [pa.nulls(n, k) if x is None else pa.array(x, k) if not isinstance(x, pa.Array) else x for x, k in given]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, file, np.int64)), *arrays], names=["file", "block", "data", "ordinal", "doc_id"])

    slim = docs.select("doc_id", text)
    return slim.mapInArrow(run, f"file long, block long, data binary, ordinal long, doc_id {slim.schema['doc_id'].dataType.simpleString()}")


def _search(blocks: DataFrame, separator: int) -> DataFrame:
    """By block: separators, tokens before the first, those between two, tokens after the last."""

    def run(batches):
        for batch in batches:
            n, head, inner, tail = [], [], [], []
            for data in batch.column("data").to_pylist():
                tokens = np.frombuffer(data or b"", "<u2")
                at = np.flatnonzero(tokens == separator)
                n.append(len(at))
                head.append(int(at[0]) if len(at) else len(tokens))
                inner.append(np.diff(at) - 1)
                tail.append(len(tokens) - 1 - int(at[-1]) if len(at) else 0)
            arrays = [batch.column("file"), batch.column("block"), *(pa.array(x, pa.int64()) for x in (n, head)), pa.array(inner, pa.list_(pa.int64())), pa.array(tail, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["file", "block", "n", "head", "inner", "tail"])

    return blocks.select("file", "block", "data").mapInArrow(run, "file long, block long, n long, head long, inner array<long>, tail long")


def count_tokens(blocks: DataFrame, separator: int) -> DataFrame:
    """(file, ordinal, n_tokens) of every document in blocks (file, block, data).

    ordinal counts the documents of a file from 0. What follows the last
    separator is a document only if it has tokens. A null block of data is empty;
    an empty table gives an empty result; block numbers must be unique in a file.
    """
    found = _search(blocks, separator).withColumn("stretch", F.expr(f"block div {STRETCH}"))
    sums = found.groupBy("file", "stretch").agg(F.sum("n").alias("stretch_n"))
    upper = Window.partitionBy("file").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    lower = Window.partitionBy("file", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    above = sums.select("file", "stretch", F.coalesce(F.sum("stretch_n").over(upper), F.lit(0)).alias("above"))
    placed = (
        found.withColumn("below", F.coalesce(F.sum("n").over(lower), F.lit(0)))
        .join(above, ["file", "stretch"])
        .withColumn("first", F.col("above") + F.col("below"))
    )
    inside = placed.select("file", "first", F.posexplode("inner").alias("i", "n_tokens")).select("file", (F.col("first") + F.col("i") + 1).alias("ordinal"), "n_tokens")
    last = F.struct((F.col("first") + F.col("n")).alias("ordinal"), F.col("tail").alias("piece"), F.lit(0).alias("ended"))
    first = F.struct(F.col("first").alias("ordinal"), F.col("head").alias("piece"), (F.col("n") > 0).cast("int").alias("ended"))
    ends = placed.select("file", F.explode(F.array(first, last)).alias("p")).select("file", "p.*")
    stitched = ends.groupBy("file", "ordinal").agg(F.sum("piece").alias("n_tokens"), F.max("ended").alias("ended"))
    return inside.unionByName(stitched.where("ended = 1 or n_tokens > 0").drop("ended"))
