"""Token counts by scanning flat token files for the end-of-document id.

A file is nothing but unsigned 16-bit numbers, little-endian: the ids of a document plus one, then 0. There is no index.
Files are cut into blocks of a fixed size, each block is searched for zeros at once, and a prefix scan over the
numbers of zeros per block tells which document the ends of a block belong to, so documents may span any number of
blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, slices, text_or_empty
from .packing import tokenizer

BLOCK_WORDS = 1 << 18
FILE_BYTES = 1 << 24
HEADER = 5
_NO_ID = 40_000


def _header(doc_id: int | None) -> np.ndarray:
    """Five words that are not 0: the id in base 2**15, each digit plus one."""
    if doc_id is None:
        return np.full(HEADER, _NO_ID, dtype="<u2")
    value = doc_id & (1 << 64) - 1
    return np.array([(value >> 15 * i & 0x7FFF) + 1 for i in range(HEADER)], dtype="<u2")


def _doc_id(words: np.ndarray) -> int | None:
    if words[0] == _NO_ID:
        return None
    value = sum((int(w) - 1) << 15 * i for i, w in enumerate(words))
    return value - (1 << 64) if value >> 63 else value


def write_token_files(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.tiktoken", named: bool = True, file_bytes: int = FILE_BYTES) -> None:
    """Write the ids of every text of ``docs`` (doc_id, text) in files below ``path`` that end once they hold ``file_bytes``.

    A file is as long as that and at most one document more, however long texts are; the files of a task lie in
    folders ``part=0``, ``part=1`` and so on. With ``named`` each document begins with ``HEADER`` words that hold its
    id. Written by Spark's own writer, so the folder can be any that it reaches and lost tasks are run again. Null and
    empty texts have no ids.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, written = tokenizer(vocabulary), 0
        for batch in slices(batches):
            rows, parts = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = (np.frombuffer(made.text_ids(text), dtype="<u4") + 1).astype("<u2").tobytes()
                rows.append(_header(doc_id).tobytes() + ids if named else ids)
                parts.append(written // file_bytes)
                written += len(rows[-1]) + 2
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(parts, pa.int64())], names=["ids", "part"])

    coded = docs.select("doc_id", text_or_empty("text").alias("text")).mapInArrow(code, "ids binary, part bigint")
    coded.select(F.col("ids").cast("string").alias("value"), "part").write.partitionBy("part").option("lineSep", "\0\0").text(path)


def count_tokens(spark: SparkSession, path: str, named: bool = True, block_words: int = BLOCK_WORDS) -> DataFrame:
    """path, ordinal (from 0), doc_id (null without headers) and n_tokens of every document below ``path``.

    Empty files have no documents; two ends in a row are an empty document; words after the last end of a file are
    a document that was cut off and are not counted. A task holds one file and its blocks, so files should be of
    moderate size, as ``write_token_files`` makes them; none may reach 2 GB.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("length > 1").select("path", "length", "content")
    size = 2 * block_words
    # the blocks are cut before the rows multiply, so a row holds a block and never the file beside it
    cut = F.expr(f"transform(sequence(0L, (length - 1) div {size}), b -> substring(content, int(b * {size} + 1), {size + 2 * (HEADER + 1)}))")
    blocks = files.select("path", F.posexplode(cut).alias("block", "words")).withColumn("block", F.col("block").cast("bigint"))
    ahead = HEADER if named else 0

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, pieces, ids = [], [], []
            for block, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = np.frombuffer(raw, dtype="<u2")
                zeros = np.flatnonzero(words[:block_words] == 0)
                ends.append(len(zeros))
                # words of the piece before each zero, and of the piece after the last
                pieces.append(np.diff(np.r_[-1, zeros, min(len(words), block_words)]) - 1)
                starts = np.r_[0 if block == 0 else len(words), zeros + 1]
                ids.append([_doc_id(words[s:s + ahead]) if ahead and s + ahead <= len(words) else None for s in starts.tolist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ends, pa.int64()), pa.array([p.tolist() for p in pieces], pa.list_(pa.int64())), pa.array(ids, pa.list_(pa.int64()))],
                names=["path", "block", "ends", "pieces", "ids"])

    scanned = materialise(blocks.mapInArrow(scan, "path string, block bigint, ends bigint, pieces array<bigint>, ids array<bigint>"), "token-blocks")
    before = scanned.select("path", "block", (F.sum("ends").over(Window.partitionBy("path").orderBy("block")) - F.col("ends")).alias("before"))
    totals = scanned.groupBy("path").agg(F.sum("ends").alias("documents"))
    placed = scanned.join(before, ["path", "block"]).select(
        "path", "before", "ends", F.posexplode(F.arrays_zip(F.col("pieces").alias("pieces"), F.col("ids").alias("ids"))).alias("k", "piece"))
    pieces = placed.select("path", (F.col("before") + F.col("k")).alias("ordinal"), F.col("piece.pieces").alias("words"), F.col("piece.ids").alias("id"),
                           ((F.col("k") > 0) & (F.col("k") < F.col("ends"))).alias("whole"))
    inner = pieces.where("whole").select("path", "ordinal", "words", "id")
    stitched = pieces.where("NOT whole").groupBy("path", "ordinal").agg(F.sum("words").alias("words"), F.max("id").alias("id"))
    every = inner.unionByName(stitched).join(totals, "path").where(F.col("ordinal") < F.col("documents"))
    return every.select("path", "ordinal", F.col("id").alias("doc_id"), (F.col("words") - ahead).alias("n_tokens"))


def document_token_counts(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id and n_tokens of every row of ``docs`` (doc_id, text), by way of token files written below ``path``.

    Null ids stay null, repeated rows stay rows, other columns are ignored, an empty table gives no rows.
    """
    write_token_files(docs, path, vocabulary)
    return count_tokens(docs.sparkSession, path).select("doc_id", "n_tokens")
