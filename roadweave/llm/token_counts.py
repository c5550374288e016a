"""Operator 4: token counts by scanning flat token files for end-of-document ids.

A token file is a plain run of ids in which every document ends with a separator; nothing
says where. It is read in blocks of a fixed size that fall anywhere. Each block is
searched with one vectorised comparison; a prefix scan over the blocks' token counts,
separator counts and last separators stitches the documents that cross block borders.
"""

from __future__ import annotations

import base64
import re
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import mapped, stored

#: Default vocabulary (50,256 byte-level ranks; the id after them is free and serves as separator).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SEPARATOR = 50_256
#: Pre-tokenisation pattern that this vocabulary was made with (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
BLOCK_TOKENS = 1 << 16


@cache
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: A longer text is encoded in pieces of about so many characters, cut at a single space between two words: there the pattern always ends a token.
ENCODE_CHARS = 1 << 20
_BETWEEN = re.compile(r"(?<=\w) (?=\w)")


def encoded(encode, text: str):
    """Runs of token ids of a text, the same that ``encode`` gives for it as a whole."""
    at = 0
    while len(text) - at > ENCODE_CHARS:
        cut = _BETWEEN.search(text, at + ENCODE_CHARS - 1)
        if not cut:
            break
        yield np.array(encode(text[at : cut.start()]), np.uint16)
        at = cut.start()
    yield np.array(encode(text[at:] if at else text), np.uint16)


STREAM = T.StructType([T.StructField("file", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("data", T.BinaryType()), T.StructField("ids", T.ArrayType(T.LongType()))])


def _write(path: str, separator: int, block_tokens: int):
    schema = pa.schema([("file", pa.int32()), ("block", pa.int64()), ("data", pa.binary()), ("ids", pa.list_(pa.int64()))])

    def run(batches):
        from pyspark import TaskContext

        file, encode = TaskContext.get().partitionId(), tokenizer(path).encode_ordinary
        held: list[np.ndarray] = []
        size = block = 0
        end = np.array([separator], np.uint16)
        ids: list = []
        first = 0

        def row(block, data, ids):
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([block], pa.int64()), pa.array([data], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], schema=schema)

        for batch in batches:
            for i in range(batch.num_rows):
                ids.append(batch.column("doc_id")[i].as_py())
                for tokens in chain(encoded(encode, batch.column("text")[i].as_py() or ""), [end]):
                    held.append(tokens)
                    size += len(tokens)
                    if size >= block_tokens:
                        joined = np.concatenate(held)
                        for at in range(0, size - block_tokens + 1, block_tokens):
                            yield row(block, joined[at : at + block_tokens].tobytes(), None)
                            block += 1
                        held = [joined[size // block_tokens * block_tokens :]]
                        size = len(held[0])
                if len(ids) >= 10_000:
                    yield row(first, None, ids)
                    first, ids = first + len(ids), []
        if size:
            yield row(block, np.concatenate(held).tobytes(), None)
        if ids:
            yield row(first, None, ids)

    return run


def write_stream(docs: DataFrame, path: str = VOCABULARY, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Tokenise ``docs`` (doc_id, text) into one flat file per partition; return its blocks (file, block, data) and manifest (file, ordinal, doc_id).

    Blocks have ``block_tokens`` little-endian 16-bit ids wherever documents end; the manifest only has the order of the ids.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stored(mapped(docs, _write(path, separator, block_tokens), STREAM), "tokens")
    blocks = rows.where("data is not null").select("file", "block", "data")
    manifest = rows.where("ids is not null").select("file", "block", F.posexplode("ids").alias("at", "doc_id"))
    return blocks, manifest.select("file", (F.col("block") + F.col("at")).alias("ordinal"), "doc_id")


def read_files(spark, path: str, block_tokens: int = BLOCK_TOKENS, width: int = 2) -> DataFrame:
    """Blocks (file, block, data) of real flat files, each small enough to be one row (under 2 GB); file is the path. An empty file has no block."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    size = block_tokens * width

    def cut(batches):
        schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("data", pa.binary())])
        for batch in batches:
            for i in range(batch.num_rows):
                content = batch.column("content")[i].as_buffer()
                for block, at in enumerate(range(0, content.size, size)):
                    yield pa.RecordBatch.from_arrays([batch.column("file").slice(i, 1), pa.array([block], pa.int64()), pa.array([content.slice(at, min(size, content.size - at)).to_pybytes()], pa.binary())], schema=schema)

    return mapped(files, cut, "file string, block long, data binary")


def _separators(separator: int, dtype: str):
    schema = pa.schema([("n", pa.int64()), ("seps", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            data = batch.column("data")
            counts, found = [], []
            for i in range(len(data)):
                tokens = np.frombuffer(data[i].as_buffer(), dtype)
                counts.append(len(tokens))
                found.append(np.flatnonzero(tokens == separator).astype(np.int32))
            out = pa.RecordBatch.from_arrays([pa.array(counts, pa.int64()), pa.array(found, pa.list_(pa.int32()))], schema=schema)
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), *out.columns], names=["file", "block", "n", "seps"])

    return run


def token_counts(blocks: DataFrame, separator: int = SEPARATOR, dtype: str = "<u2") -> DataFrame:
    """Return (file, ordinal, first_token, n_tokens, closed) for every document of token files given as blocks (file, block, data).

    Documents are numbered from 0 in each file; n_tokens leaves the separator out, so two
    separators in a row are an empty document. Tokens after a file's last separator are
    one more document with closed = false. Blocks may have any sizes and be repeated in no
    case; null or empty data has no tokens.
    """
    fields = f"file {blocks.schema['file'].dataType.simpleString()}, block long, n long, seps array<int>"
    data = F.coalesce("data", F.lit(b""))
    rows = blocks.select("file", F.col("block").cast("long").alias("block"), data.alias("data"))
    found = stored(mapped(rows, _separators(separator, dtype), fields), "separators")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    last = F.when(F.size("seps") > 0, F.col("base") + F.element_at("seps", -1))
    found = found.withColumn("ends", last)
    found = found.withColumns({"ordinal": F.coalesce(F.sum(F.size("seps")).over(before), F.lit(0)), "carry": F.coalesce(F.max("ends").over(before), F.lit(-1))})
    one = found.select("file", "ordinal", "base", "carry", "seps", F.posexplode("seps").alias("at", "sep"))
    previous = F.when(F.col("at") == 0, F.col("carry")).otherwise(F.col("base") + F.get("seps", F.col("at") - 1))
    closed = one.select("file", (F.col("ordinal") + F.col("at")).alias("ordinal"), (previous + 1).alias("first_token"), (F.col("base") + F.col("sep") - previous - 1).alias("n_tokens"), F.lit(True).alias("closed"))
    tails = found.groupBy("file").agg(F.sum("n").alias("total"), F.max("ends").alias("ends"), F.sum(F.size("seps")).alias("ordinal"))
    first = F.coalesce("ends", F.lit(-1)) + 1
    rest = tails.where(first < F.col("total")).select("file", "ordinal", first.alias("first_token"), (F.col("total") - first).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest)


def document_token_counts(docs: DataFrame, path: str = VOCABULARY, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Return (doc_id, n_tokens, file, first_token), one row per row of ``docs``: written as flat token files, then counted by their separators.

    Null and empty texts have no token; special strings in a text are ordinary text; repeated rows repeat; an empty table
    gives none; extra columns are ignored. A long text is encoded in pieces.
    """
    blocks, manifest = write_stream(docs, path, separator, block_tokens)
    counted = token_counts(blocks, separator)
    return manifest.join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "first_token")
