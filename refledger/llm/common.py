"""Helpers shared by the training-data operators: word rules, Arrow columns, vectorised hashes, shared constants."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from refledger.functions.shipping import ship_by_value

ship_by_value(__name__)

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, whatever else the table carries."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and leaves every other character alone."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def in_part(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves ``remainder``; a null id counts as the empty text."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(0)) % modulus == remainder


# --- Arrow side ------------------------------------------------------------------------------------

#: Bytes of rows that Spark hands to Python at once: its own limit of 10,000 rows is tens of MB where texts are long, which the
#: executor holds as vectors and as a stream beside what Python makes of them.
BATCH_BYTES = 4_000_000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that hands it to Python ``BATCH_BYTES`` at a time."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType,
              rows: int | None = None) -> DataFrame:
    """``mapInArrow`` of a function from one batch to one batch.  ``rows`` bounds the rows handled at once;
    batches are also cut where their texts pass 3 MB, so memory does not depend on text lengths."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, rows or 4096):
                yield fn(part)
        pa.default_memory_pool().release_unused()  # a worker lives on after its task

    return small_batches(df).mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, rows: int, most: int = 3_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and about ``most`` bytes (a single longer row stays whole)."""
    start = 0
    while start < batch.num_rows:
        n = min(rows, batch.num_rows - start)
        while n > 1 and batch.slice(start, n).get_total_buffer_size() > most and batch.slice(start, n).nbytes > most:
            n //= 2
        yield batch.slice(start, n)
        start += n


def no_null_text(column: pa.Array) -> pa.Array:
    # the concatenation copies a slice into buffers of its own, which begin at its first byte
    column = pa.concat_arrays([column, pa.array([], column.type)])
    return pc.fill_null(column.cast(pa.large_string()), "")


def split_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(data, bounds, counts)`` of a column made by ``no_null_text``: the ASCII-lower-cased bytes of all rows, the
    (words, 2) array of byte ranges of their words, and the number of words of each row."""
    text = pc.ascii_lower(text)
    sizes = pc.binary_length(text).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    raw = text.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    solid = (data > 32) | ((data < 9) | ((data > 13) & (data < 32)))
    edge = np.empty(len(data) + 1, dtype=bool)  # edge[i]: a word may begin or end before byte i
    if len(data):
        edge[0], edge[-1] = solid[0], solid[-1]
        np.not_equal(solid[1:], solid[:-1], out=edge[1:-1])
        # a word that runs over a row's end is two words
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        both = np.unique(cut[solid[cut] & solid[cut - 1]])
        at = np.flatnonzero(edge)
        at = np.sort(np.concatenate([at, both, both])) if len(both) else at
        bounds = at.reshape(-1, 2)
    else:
        bounds = np.zeros((0, 2), np.int64)
    counts = np.diff(np.searchsorted(bounds[:, 0], offsets))
    return data, bounds, counts


#: Odd multiplier of the rolling hash, its inverse modulo 2**64, and the multipliers of the finaliser.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
MIX1, MIX2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(MIX1)
    h ^= h >> np.uint64(27)
    h *= np.uint64(MIX2)
    h ^= h >> np.uint64(31)
    return h


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """64-bit hashes of byte ranges of ``data``: prefix sums of byte * BASE**position, shifted back to a range's start."""

    def __init__(self, data: np.ndarray) -> None:
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=self.sums[1:])
        self.back = powers(BASE_INVERSE, len(data) + 1)

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        h = (self.sums[hi] - self.sums[lo]) * self.back[lo]
        return mixed(h + np.uint64(BASE) * (hi - lo).astype(np.uint64))


def range_hashes(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range (range, 2)."""
    return Hasher(data)(bounds[:, 0], bounds[:, 1]) if len(bounds) else np.zeros(0, np.uint64)


def crc32_text(value: object) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode())


def shared_folder(spark: SparkSession, name: str) -> str:
    """New folder for files of ours beside the checkpoints: in ``spark.checkpoint.dir``, which all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="refledger-files-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Bits of the filter of ``sifted``: 2048 rows of 4 KB, whatever the number of keys.
SIFT_BITS = 1 << 26


def marked(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, how: str) -> DataFrame:
    """``df`` with ``__hit``, which is false or (``how="left"``) null where the key is not among ``wanted``, and
    nearly always only there: by a bitmap of hashed keys, small enough to broadcast."""
    def place(k: Column) -> Column:
        return F.pmod(F.xxhash64(k), F.lit(SIFT_BITS)) + 1

    bits = wanted.select(place(wanted_key).alias("__p")).groupBy(F.bitmap_bucket_number("__p").alias("__bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("__p")).alias("__bits"))
    rows = df.withColumn("__p", place(key)).withColumn("__b", F.bitmap_bucket_number("__p")).withColumn(
        "__at", F.bitmap_bit_position("__p"))
    joined = rows.join(F.broadcast(bits), F.col("__b") == F.col("__bucket"), how)
    byte = F.conv(F.hex(F.substring("__bits", F.floor(F.col("__at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, (F.col("__at") % 8).cast("int")) == 1
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], hit.alias("__hit"))


def sifted(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """Rows of ``df`` whose key may be among ``wanted``: keeps most other rows (and their texts) out of the exact join
    that follows."""
    return marked(df, key, wanted, wanted_key, "inner").filter("__hit").drop("__hit")


def sifted_out(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """The rows that ``sifted`` leaves out: their keys are not among ``wanted``."""
    return marked(df, key, wanted, wanted_key, "left").filter(~F.coalesce("__hit", F.lit(False))).drop("__hit")


def hash_share(key: Column, share: float) -> Column:
    """True for the given share of keys, those with the smallest hashes."""
    cut = min(int(min(1.0, max(0.0, share)) * 2**64), 2**64 - 1) - 2**63
    return F.xxhash64(key) <= F.lit(cut)
