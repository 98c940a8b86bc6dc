"""What the operators of this folder share: table access, the folder all executors see, word splitting."""

from __future__ import annotations

import ctypes
import posixpath
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from cindermap.sources.shared import shared_dir, staged  # noqa: F401  for the operators


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path in it for a URI or an absolute path; also works inside tasks."""
    return pafs.FileSystem.from_uri(path)


def write_file(path: str, chunks) -> int:
    """Write the chunks to ``path``. A retried or speculative task cannot leave half a file: the name appears by a rename, and where a
    store refuses to rename onto the file of an earlier attempt at the same task, that file stays."""
    fs, name = store(path)
    fs.create_dir(posixpath.dirname(name), recursive=True)
    half, size = f"{name}.{uuid.uuid4().hex}.tmp", 0
    with fs.open_output_stream(half, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    moved(fs, half, name)
    return size


def moved(fs: pafs.FileSystem, half: str, name: str) -> None:
    """Give a whole file its name; the same file of an earlier attempt may be there already."""
    try:
        fs.move(half, name)
    except OSError:
        if fs.get_file_info(name).type == pafs.FileType.NotFound:
            raise
        fs.delete_file(half)


def read_file(path: str) -> bytes:
    fs, name = store(path)
    with fs.open_input_stream(name, compression=None) as f:
        return f.read()


def give_back() -> None:
    """What Arrow and the C library hold ready for further use goes back to the system, so that the memory of a step that has ended adds nothing to the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library's
    if trim:
        trim(0)


def encoded(text: str | None) -> bytes:
    """UTF-8; nulls are empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def words(text: str | None) -> list[bytes]:
    """Maximal runs without the six ASCII white-space bytes 0x20 and 0x09-0x0D, which is what bytes.split() cuts at."""
    return encoded(text).split()


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
