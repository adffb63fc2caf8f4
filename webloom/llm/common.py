"""What the operators of this subpackage share: shared-folder tables and the byte-level tokeniser.

The tokeniser works on whole Arrow buffers with numpy.  Every separator of the word
classes used here is ASCII, so words can be found on UTF-8 bytes without decoding, and a
word is a (start, end) pair of byte positions instead of a Python object.
"""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_libc = ctypes.CDLL(None)
#: Raw text bytes handled at a time; a longer document is handled on its own.
BLOCK_BYTES = 1 << 19
#: Bytes of an Arrow batch that goes to a Python worker; a longer row goes on its own.
ARROW_BYTES = "4m"
#: Bytes hashed at a time, which bounds the tables of powers that a worker keeps.
HASH_BYTES = 1 << 16


# --------------------------------------------------------------------------- Spark side


#: Every path that new_path() has given.
made: list[str] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    limit_arrow_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temp folder where all run on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("webloom.shared.dir", None)
        if not root:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir isn't set: executors of a cluster need a folder that all of them share")
            root = "file://" + tempfile.mkdtemp(prefix="webloom-")
            spark.conf.set("webloom.shared.dir", root)
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/webloom-{tag}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    made.append(path)
    return path


def release(spark: SparkSession, paths: list[str], needed: DataFrame | None = None) -> list[str]:
    """Remove these tables, but for those that `needed` reads; returns what stays."""
    parts = {part for file in needed.inputFiles() for part in file.split("/")} if needed is not None and paths else set()
    stay = [path for path in paths if path.rsplit("/", 1)[1] in parts]
    for path in paths:
        if path not in stay:
            remove(spark, path)
    return stay


def remove(spark: SparkSession, path: str) -> None:
    try:
        sc = spark.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already; the folder is the cluster's to clear then
        pass


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def limit_arrow_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that rows of a megabyte don't gather by the ten thousand; the same bound for every operator."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def crc_bucket(column: str = "doc_id") -> F.Column:
    """crc32 of the id as text, mod 4; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4


# ----------------------------------------------------------------------------- Arrow side


def text_array(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The text column with null as empty."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.string()).fill_null("")


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their offsets (n + 1), both starting at 0."""
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batch: pa.RecordBatch, name: str, size: int = BLOCK_BYTES):
    """Slices of the batch with about `size` bytes of text each, one row at least."""
    _, offsets = buffers(text_array(batch, name))
    at, n = 0, batch.num_rows
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        end = min(end, n)
        yield batch.slice(at, end - at)
        at = end
    tidy()


def tidy() -> None:
    """Give freed memory back to the system: workers are reused, stage after stage."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


# ------------------------------------------------------------------------------ tokeniser


def _class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.ones(256, bool)
    for a, b in ranges:
        table[a : b + 1] = False
    return table


#: Words between ASCII white space.
SPACED = _class((0x20, 0x20), (0x09, 0x0D))
#: Digits, lower-case ASCII letters and whatever is not ASCII; apply after folding A-Z.
ALNUM = _class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

_rng = np.random.default_rng(20240229)
_BYTE = {seed: np.random.default_rng(seed).integers(1, 2**64, 256, dtype=U64) for seed in (11, 12)}
_BASE = {11: U64(0x9E3779B97F4A7C15), 12: U64(0xC2B2AE3D27D4EB4F)}
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i below n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(17, int(n - 1).bit_length())
        up, down = np.full(size, base, U64), np.full(size, pow(base, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        have = np.cumprod(up), np.cumprod(down)
        if size <= 2 * HASH_BYTES:
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash: every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def runs_of(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values, none of which crosses from one text to the next."""
    before, after = np.zeros_like(is_word), np.zeros_like(is_word)
    before[1:] = is_word[:-1]
    after[:-1] = is_word[1:]
    before[offsets[:-1][offsets[:-1] < len(is_word)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    return np.flatnonzero(is_word & ~before), np.flatnonzero(is_word & ~after) + 1


def span_hashes(values_of, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit polynomial hash of each span; values_of(a, b) gives a number for each position from a to b.  Spans are in order of their starts."""
    out, at, n = np.empty(len(starts), U64), 0, len(starts)
    while at < n:  # block by block, so that tables stay small for a very long text
        begin = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, begin + HASH_BYTES, side="right")))
        part = values_of(begin, ends[to - 1])
        up, down = powers(base, len(part) + 1)
        total = np.zeros(len(part) + 1, U64)
        np.cumsum(part * up[: len(part)], out=total[1:])
        s, e = starts[at:to] - begin, ends[at:to] - begin
        out[at:to] = (total[e] - total[s]) * down[s]
        at = to
    return mix(out)


class Words:
    """Words of some texts: bytes, word starts and ends, and each text's first word (n + 1)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACED, fold: bool = False):
        self.data = FOLD[data] if fold else data
        self.starts, self.ends = runs_of(table[self.data], offsets)
        self.first = np.searchsorted(self.starts, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, seed: int = 11) -> np.ndarray:
        """A 64-bit hash of each word."""
        return span_hashes(lambda a, b: _BYTE[seed][self.data[a:b]], self.starts, self.ends, int(_BASE[seed]))

    def texts_of(self) -> np.ndarray:
        """Each word's text number."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes, whatever text they are of: len(words) - k + 1."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for i in range(k):
        out *= U64(0xD6E8FEB86659FD93)
        out += words[i : i + n]
    return mix(out)


def per_text(values: np.ndarray, first: np.ndarray, ufunc, empty):
    """ufunc.reduceat over each text's values; `empty` where a text has none."""
    out = np.full(len(first) - 1, empty, values.dtype)
    some = np.flatnonzero(np.diff(first) > 0)
    if len(some):
        out[some] = ufunc.reduceat(values, first[some])
    return out


def string_array(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary()).cast(pa.string())
