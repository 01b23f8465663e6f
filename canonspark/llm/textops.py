"""Text helpers shared by the operators of this subpackage.

Two word rules occur.  *Space words* are maximal runs of bytes other than
0x20 and 0x09-0x0D; *alphanumeric words* are maximal runs of 0-9, a-z and all
bytes from 0x80 on.  Both lower-case A-Z only, so working on UTF-8 bytes gives
the same words as working on characters.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canonspark.session import ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

TEXT_ROWS, _BATCH = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"

SPACE_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# every byte that no alphanumeric word holds becomes a space, A-Z becomes a-z
_ALNUM_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)

_LOWER_BYTE = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
ALNUM_WORD_BYTES = np.frombuffer(_ALNUM_TABLE, np.uint8) != 32
SPACE_WORD_BYTES = np.array([c not in b" \t\n\x0b\x0c\r" for c in range(256)])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def encode(text) -> bytes:
    """UTF-8 bytes of a text; null is empty."""
    return b"" if not isinstance(text, str) else text.encode("utf-8", "surrogatepass")


def space_words(text) -> list[bytes]:
    """Lower-cased space words (``bytes.split`` breaks at 0x20, 0x09-0x0D)."""
    return encode(text).lower().split()


def alnum_words(text) -> list[bytes]:
    return encode(text).translate(_ALNUM_TABLE).split()


def coded_words(data: bytes, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of a block of text as arrays: the code of every word, the byte at which it
    starts, and the lower-cased (A-Z) words of the codes.  ``word_bytes`` says for every byte
    whether words hold it."""
    raw = np.frombuffer(data, np.uint8)
    inside = word_bytes[raw]
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    flat = pa.Array.from_buffers(pa.binary(), len(starts),
                                 [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER_BYTE[raw[inside]])])
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), starts, coded.dictionary


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only, inside the JVM."""
    return F.translate(c, UPPER, LOWER)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(df: DataFrame) -> DataFrame:
    """Rows with whole texts go to Python in batches of ``TEXT_ROWS``, unless the
    session has a setting of its own: the default of 10,000 is meant for short rows."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH) == "10000":
        conf.set(_BATCH, str(TEXT_ROWS))
    return df


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table written below ``spark.checkpoint.dir``
    (compressed, unlike a checkpoint; for larger intermediate tables)."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
