"""Operator 8: token-id files. Flat unsigned integers plus 64-bit document offsets, memory-mapped by readers.

A dataset is a folder of pairs. ``part-NNNNN.bin`` holds the ids of its documents one after the other, unsigned and
little-endian, 16 bits wide where the vocabulary allows, else 32. ``part-NNNNN.idx`` holds 64-bit numbers: n + 1
offsets into the ids, then the n doc_ids (a null doc_id is written as the smallest 64-bit number).

Documents are dealt out in ranges of doc_id, so that the parts' order is the documents' order; each task streams its
documents into its own pair. A prefix sum over the parts' token counts (one number a part) gives every part's base, and
base plus offset is a document's place in the whole.

Defined cases: a null text is empty and has the end id alone; null doc_ids come first; rows that repeat a doc_id stand
next to each other, ordered by text; an empty table gives no files and an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cindermap.llm.common import batch, moved, shared_dir, store, table
from cindermap.llm.tokens import encoded_texts

NO_ID = -(2**63)
PARTS = "part int, n_docs long, n_tokens long"
RESULT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def width(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


def _write_part(folder: str, tokenizer: str, end_id: int, dtype: np.dtype):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        fs, root = store(folder)
        fs.create_dir(root, recursive=True)
        name, half = f"{root}/part-{part:05d}", f"{root}/.{uuid.uuid4().hex}"
        sizes, ids = [], []
        with fs.open_output_stream(f"{half}.bin") as out:
            for rows in batches:
                ids += [NO_ID if x is None else x for x in rows.column("doc_id").to_pylist()]
                for own in encoded_texts(tokenizer, rows.column("text"), end_id):
                    out.write(own.astype(dtype).tobytes())
                    sizes.append(len(own))
        if not ids:
            fs.delete_file(f"{half}.bin")
            return
        with fs.open_output_stream(f"{half}.idx") as out:
            out.write(np.concatenate([[0], np.cumsum(sizes), ids]).astype("<i8").tobytes())
        # A part gets its name when it is whole, so a task that is run again replaces it.
        moved(fs, f"{half}.bin", f"{name}.bin")
        moved(fs, f"{half}.idx", f"{name}.idx")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": [len(ids)], "n_tokens": [int(np.sum(sizes))]})

    return write


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, vocabulary: int, end_id: int) -> list[tuple[int, int, int]]:
    """Write the dataset; returns (part, base, n_tokens) of each part, in document order."""
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    parts = sorted(tuple(r) for r in ordered.mapInArrow(_write_part(folder, tokenizer, end_id, width(vocabulary)), PARTS).collect())
    bases = np.cumsum([0, *(n for _, _, n in parts)])
    return [(part, int(base), n) for (part, _, n), base in zip(parts, bases, strict=False)]


def _mapped(path: str, dtype: np.dtype) -> np.ndarray:
    """A memory map where the path is on a mounted file system, else the file's content."""
    fs, name = store(path)
    if os.path.exists(name):
        return np.memmap(name, dtype, "r")
    with fs.open_input_file(name) as f:
        return np.frombuffer(f.read_buffer(), dtype)


def _read_parts(folder: str, dtype: np.dtype):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for part, base in zip(rows.column("part").to_pylist(), rows.column("base").to_pylist(), strict=True):
                name = posixpath.join(folder, f"part-{part:05d}")
                index, tokens = _mapped(f"{name}.idx", np.dtype("<i8")), _mapped(f"{name}.bin", dtype)
                n = len(index) // 2
                offsets, ids = index[: n + 1], index[n + 1 :]
                for i in range(0, n, 4096):
                    j = min(n, i + 4096)
                    crcs = [zlib.crc32(tokens[a:b].astype("<u4").tobytes()) for a, b in zip(offsets[i:j], offsets[i + 1 : j + 1], strict=True)]
                    yield batch(RESULT, [None if x == NO_ID else x for x in ids[i:j].tolist()], base + offsets[i:j], np.diff(offsets[i : j + 1]), crcs)

    return read


def read_tokens(spark: SparkSession, folder: str, parts: list[tuple[int, int, int]], vocabulary: int) -> DataFrame:
    """Each document's place, length and check sum, from the files."""
    plan = spark.createDataFrame([(p, b) for p, b, _ in parts], "part int, base long").repartition(max(1, len(parts)))
    return plan.mapInArrow(_read_parts(folder, width(vocabulary)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "tokens")
    parts = write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), 49_408, 2)
    return read_tokens(spark, folder, parts, 49_408).select("doc_id", "start", "n_tokens", F.col("ids_crc32"))
