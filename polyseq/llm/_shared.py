"""Helpers that several corpus operators use: shared-folder tables, argument checks, batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: dict[str, str] = {}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate table that lower-cases A-Z and leaves every other byte.
LOWER_AZ = bytes.maketrans(_UPPER.encode(), _LOWER.encode())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="polyseq-")
    return _own_dir[app]


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged in here go when it is left, but for those that outlive it; what is made lazily from them must be staged before."""
    _scratch.append([])
    try:
        yield
        for path in map(spark._jvm.org.apache.hadoop.fs.Path, _scratch[-1]):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    finally:
        _scratch.pop()


def stage(df: DataFrame, name: str, outlives: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with files that outlive any executor, and fixes row ids and the grouping of rows
    into blocks, so that a task that runs again sees what the first one saw. outlives: beyond the :func:`scratch` that
    this is in, up to the one around that.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/polyseq-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    depth = len(_scratch) - (2 if outlives else 1)
    if depth >= 0:
        _scratch[depth].append(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return freed memory to the system: a worker stays for later tasks, and what it holds counts against its executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def lower_az(col):
    """Lower-case A-Z only."""
    return F.translate(col, _UPPER, _LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like those given that ``df`` doesn't have; Spark's names know no case."""
    taken, out = {c.lower() for c in df.columns}, []
    for x in names:
        while x.lower() in taken:
            x += "_"
        taken.add(x.lower())
        out.append(x)
    return out


def partitions_for(spark: SparkSession, rows: int, per_partition: int) -> int:
    """Partitions that hold at most about ``per_partition`` of ``rows`` each, and no fewer than the session's number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_partition))


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text of a batch; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for x in column.cast(kind):
        yield x.as_py() or b""


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a batch as one uint8 array, and the n + 1 offsets into it; null counts as empty."""
    column = pa.array(column, type=pa.large_string()) if not isinstance(column, pa.Array) else column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + column.offset + 1)[column.offset :]
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:  # what lies under a null may be any bytes
        keep = np.asarray(column.is_valid())
        sizes = np.where(keep, np.diff(offsets), 0)
        starts = offsets[:-1]
        parts = [flat[s : s + n] for s, n in zip(starts, sizes, strict=True) if n]
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint8)), np.concatenate([[0], np.cumsum(sizes)])
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


_P = 0x9E6C63D0876A9A47
_P_INVERSE = pow(_P, -1, 1 << 64)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_FOLDED = np.frombuffer(LOWER_AZ, np.uint8)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0, base ** 1 and so on, modulo 2 ** 64."""
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, 1 << 20), base, np.uint64)
        steps[0] = 1
        found = np.cumprod(steps, dtype=np.uint64)
        if n > 1 << 22:  # for one very long text only
            return found
        _powers[base] = found
    return _powers[base]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed_words(flat: np.ndarray, ends: np.ndarray, fold: bool, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    text = _FOLDED[flat] if fold else flat
    inside = ~outside[flat]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edges = ends[(ends > 0) & (ends < len(flat))]
    begins[edges] = inside[edges]
    stops[edges - 1] = inside[edges - 1]
    starts, last = np.flatnonzero(begins), np.flatnonzero(stops)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * _power(_P, len(text))[: len(text)], dtype=np.uint64)])
    found = (sums[last + 1] - sums[starts]) * _power(_P_INVERSE, len(text))[starts]
    return mix(found ^ (last - starts).astype(np.uint64) << np.uint64(48)), np.diff(np.searchsorted(starts, ends), prepend=0)


def word_hashes(column: pa.Array, fold: bool = True, chunk: int = 1 << 20, outside: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (what lies between \\x20 and \\x09-\\x0D, or the bytes ``outside``) of a batch of texts, in order, and how many each text has.

    fold: A-Z count as a-z. The hash is a polynomial in the bytes, so that sums over prefixes give it for all
    words at once; about ``chunk`` bytes are done together.
    """
    flat, offsets = flat_text(column)
    hashes, sizes, at = [], [], 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + chunk, side="right")) - 1)
        part = flat[offsets[at] : offsets[to]]
        if len(part):
            h, n = _hashed_words(part, offsets[at + 1 : to + 1] - offsets[at], fold, outside)
            hashes.append(h)
            sizes.append(n)
        else:
            sizes.append(np.zeros(to - at, np.int64))
        at = to
    none = np.zeros(0, np.int64)
    return np.concatenate(hashes or [none.astype(np.uint64)]), np.concatenate(sizes or [none]).astype(np.int64)


def string_hashes(offsets: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte strings that lie end to end."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * _power(_P, len(flat))[: len(flat)], dtype=np.uint64)])
    powers = np.append(_power(_P_INVERSE, len(flat) + 1)[: len(flat) + 1], np.uint64(0))
    return mix((sums[offsets[1:]] - sums[offsets[:-1]]) * powers[offsets[:-1]] ^ np.diff(offsets).astype(np.uint64) << np.uint64(48))


def pack_numbers(x: np.ndarray) -> bytes:
    """Whole numbers from zero as bytes: the width of one, then all of them."""
    kind = np.min_scalar_type(int(x.max())) if len(x) else np.dtype(np.uint8)
    return bytes([kind.itemsize]) + x.astype(kind.newbyteorder("<")).tobytes()


def unpack_numbers(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.int64)


def pack_planes(codes: np.ndarray) -> bytes:
    """32-bit numbers byte by byte: all lowest bytes, then the next; files compress them well so."""
    return np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def range_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges each 64-bit hash lies in, n being less than 2 ** 32; ascending with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def write_bucketed(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in the shared folder, bucketed by its column block, so that joins on it don't shuffle it."""
    spark = df.sparkSession
    name = f"polyseq_{what}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, "block").option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


#: Words of 64 bits of a sieve, which is broadcast: 4 MB of rows at most, however many keys it is made of. A million keys let 15 of 16 other rows pass.
SIEVE_WORDS = 1 << 18


def sift(df: DataFrame, key: Column, wanted: DataFrame, column: str) -> tuple[DataFrame, Column]:
    """``df`` and whether a row's ``key``, a 64-bit hash, may be among those of ``wanted``, whose ``column`` has hashes of the same kind.

    A row whose key isn't among them nearly always passes the sieve, whose size is fixed, and needn't move to be told
    apart from the others; only rows that may be go into an exact join. So one plan serves any number of keys: with
    very many the sieve fills up, and more rows move, but none is told wrongly. ``df`` gets a column; select it away.
    """
    where = lambda h: F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(SIEVE_WORDS - 1))
    one = lambda h: F.element_at(F.array(*[F.lit((1 << b) - (1 << 64) * (b == 63)) for b in range(64)]), F.shiftrightunsigned(h, 58).cast("int") + 1)
    bits, word = fresh(df, "sieve_bits", "sieve_word")
    sieve = wanted.groupBy(where(F.col(column)).alias(word)).agg(F.bit_or(one(F.col(column))).alias(bits))
    sifted = df.join(F.broadcast(sieve), where(key) == F.col(word), "left").drop(word)
    return sifted, F.coalesce(F.col(bits).bitwiseAND(one(key)) != 0, F.lit(False))


def rows_without(df: DataFrame, key: Column, gone: DataFrame, column: str, same: Column | None = None) -> DataFrame:
    """The rows of ``df`` whose key isn't among ``gone``, whose columns have names that ``df`` hasn't; same: the exact condition, by default equal hashes. Rows that stay don't move but for a few that the sieve takes for others."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    sifted, may = sift(df, key, gone, column)
    rest = sifted.filter(may).join(gone, (key == F.col(column)) if same is None else same, "left_anti")
    return sifted.filter(~may).select(*columns).union(rest.select(*columns))


def new_block() -> int:
    """A number for a block of rows; blocks are written as soon as they are made, so it needn't come out alike again."""
    return uuid.uuid4().int >> 65


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as their steps, byte by byte, without the bytes that no step needs."""
    steps = np.diff(keys, prepend=np.uint64(0))
    first, rest = keys[:1].astype("<u8").tobytes(), steps[1:].astype("<u8").view(np.uint8).reshape(-1, 8)
    width = max(1, -(-int(steps[1:].max()).bit_length() // 8)) if len(keys) > 1 else 1
    return bytes([width]) + first + np.ascontiguousarray(rest[:, :width].T).tobytes()


def unpack_sorted(b: bytes) -> np.ndarray:
    width, first = b[0], np.frombuffer(b, "<u8", min(1, len(b) // 9), 1)
    planes = np.frombuffer(b, np.uint8, offset=1 + 8 * len(first)).reshape(width, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :width] = planes.T
    return np.cumsum(np.concatenate([first, steps.view("<u8").ravel()]), dtype=np.uint64)
