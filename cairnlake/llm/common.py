"""Shared pieces of the training-data operators: shared-folder tables and vectorised word hashing."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: Bytes that separate words: space and the controls tab to carriage return.
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that are hashed at a time; bounds the scratch arrays, not the text.
CHUNK = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; on a cluster an unset folder is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="cairnlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cairnlake/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Deletes the files of a materialised table that no later plan reads."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/cairnlake/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser with full avalanche on unsigned 64-bit integers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=U64) + U64(seed) * U64(1_000_003)) * U64(0x9E3779B97F4A7C15))


class WordHasher:
    """Hashes every word of a column of texts without a Python loop over words.

    A word is a run of bytes other than the separators; A-Z count as a-z. Its hash is the polynomial
    hash of its bytes modulo 2**64, taken from prefix sums, then mixed.
    """

    def __init__(self) -> None:
        byte = np.arange(256, dtype=np.uint8)
        self.word = ~np.isin(byte, np.frombuffer(SEPARATORS, np.uint8))
        fold = byte.copy()
        fold[65:91] += 32
        self.value = seeded(256, 11)[fold] | U64(1)
        base = 0x9E3779B97F4A7C15 | 1
        size = 2 * CHUNK + 2
        with np.errstate(over="ignore"):
            steps = np.full(size, base, U64)
            steps[0] = 1
            self.power = np.multiply.accumulate(steps)
            steps[1:] = pow(base, -1, 1 << 64)
            self.inverse = np.multiply.accumulate(steps)

    def spans(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """data bytes, word starts, word ends, and for each text the index of its first word (n + 1 values)."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if column.null_count:
            column = column.fill_null("")
        if not pa.types.is_large_string(column.type):
            column = column.cast(pa.large_string())
        n = len(column)
        if n == 0:
            z = np.zeros(0, np.int64)
            return np.zeros(0, np.uint8), z, z, np.zeros(1, np.int64)
        off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
        off = off - off[0]
        is_word = self.word[data]
        before = np.zeros(len(data) + 1, bool)
        before[1:] = is_word
        after = before.copy()
        before[off] = False
        starts = np.flatnonzero(is_word & ~before[:-1])
        after[:-1] = is_word
        after[-1] = False
        after[off] = False
        ends = np.flatnonzero(is_word & ~after[1:]) + 1
        return data, starts, ends, np.searchsorted(starts, off)

    def hashes(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes in text order, and for each text the index of its first word (n + 1 values)."""
        data, starts, ends, first = self.spans(column)
        return self.of_spans(data, starts, ends), first

    def of_spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the words data[start:end]."""
        out = np.empty(len(starts), U64)
        with np.errstate(over="ignore"):
            i = 0
            while i < len(starts):
                j = max(i + 1, int(np.searchsorted(starts, starts[i] + CHUNK)))
                lo, hi = starts[i], ends[j - 1]
                if ends[j - 1] - starts[j - 1] > CHUNK:
                    text = bytes(data[starts[j - 1] : hi])
                    out[j - 1] = int.from_bytes(hashlib.blake2b(text.lower(), digest_size=8).digest(), "little")
                    j -= 1
                    if j == i:
                        i += 1
                        continue
                    hi = ends[j - 1]
                total = np.zeros(hi - lo + 1, U64)
                np.cumsum(self.value[data[lo:hi]] * self.power[: hi - lo], out=total[1:])
                s, e = starts[i:j] - lo, ends[i:j] - lo
                out[i:j] = mix64((total[e] - total[s]) * self.inverse[s])
                i = j
        return out


def slices(batch: pa.RecordBatch, text: str = "text", most: int = 1 << 22):
    """Cuts a batch into pieces of about ``most`` text bytes (one text at least), to bound scratch memory."""
    column = batch.column(batch.schema.get_field_index(text))
    if batch.num_rows == 0:
        return
    sizes = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0), np.int64))
    i = 0
    while i < batch.num_rows:
        done = sizes[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(sizes, done + most, side="right")))
        yield batch.slice(i, j - i)
        i = j
