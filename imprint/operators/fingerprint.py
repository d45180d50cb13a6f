"""64-bit fingerprints (H1-H5, H8, H9).

Grids are ``array<double>`` columns in row-major order (one value per cell).  Bit ``k`` of a
fingerprint is cell ``k`` of the 8x8 bit matrix, row-major, packed with ``1 << k``; bit 63 is
the sign bit of the ``bigint``.

* aHash, dHash, wHash and the median fingerprint run as built-in higher-order functions.
* pHash needs a 2-D DCT: an Arrow-batched pandas UDF does it as one batched matrix product
  ``C X C^T`` per batch (NumPy), which is how a grid of any size (8, 32, ...) is handled.
* SimHash tokenises and hashes tokens in the JVM (``split``/``md5``) and votes the 64 bits per
  document in NumPy over Arrow batches; no shuffle is needed since a document is one row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


from imprint._ship import ship_with_tasks

ship_with_tasks(__name__)

HASH_SIDE = 8  # an 8x8 bit matrix -> 64 bits
N_BITS = HASH_SIDE * HASH_SIDE


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# 2**k for k = 0..63 as signed 64-bit integers (bit 63 is the sign bit).
_POWERS = [1 << k for k in range(N_BITS - 1)] + [-(1 << (N_BITS - 1))]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body`` (a one-element ``transform``)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pack_bits(flags: Column) -> Column:
    """``array<boolean>`` of 64 flags -> bigint with bit k set when flags[k] (H6 packing)."""
    powers = F.lit(_POWERS).cast("array<bigint>")
    zero = F.lit(0).cast("long")
    terms = F.zip_with(flags, powers, lambda f, p: F.when(f, p).otherwise(zero))
    return F.aggregate(terms, zero, lambda acc, t: acc.bitwiseOR(t))


def _sized(values: Column, n: int, body: Callable[[Column], Column]) -> Column:
    """``body`` of an array of exactly ``n`` values; NULL stays NULL, any other length raises."""

    def checked(a: Column) -> Column:
        wrong = F.raise_error(F.concat(F.lit(f"a fingerprint needs {n} values, not "), F.size(a).cast("string")))
        return F.when(a.isNull(), F.lit(None).cast("long")).when(F.size(a) == n, body(a)).otherwise(wrong.cast("long"))

    return let(values, checked)


def _as_double_array(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def _median(values: Column) -> Column:
    """Median of a numeric array in double: middle value, or mean of the two middle ones."""

    def mid(s: Column) -> Column:
        n = F.size(s)
        lo = F.element_at(s, F.floor((n + 1) / 2).cast("int"))
        hi = F.element_at(s, F.floor(n / 2).cast("int") + 1)
        return (lo + hi) / 2.0

    return let(F.array_sort(values), mid)


def median_fingerprint(vec: Column | str) -> Column:
    """H8: bit k set when ``vec[k]`` is above the median of the 64 values."""
    v = _as_double_array(_col(vec))
    return _sized(v, N_BITS, lambda a: let(_median(a), lambda med: pack_bits(F.transform(a, lambda x: x > med))))


def ahash(grid: Column | str) -> Column:
    """H2 average hash of an 8x8 grid: cell above the grid mean."""
    return _sized(
        _as_double_array(_col(grid)),
        N_BITS,
        lambda g: let(
            F.aggregate(g, F.lit(0.0), lambda a, x: a + x) / F.size(g),
            lambda mean: pack_bits(F.transform(g, lambda x: x > mean)),
        ),
    )


def dhash(grid9x8: Column | str) -> Column:
    """H3 difference hash of an 8-row x 9-column grid (72 cells): right neighbour brighter."""
    w = HASH_SIDE + 1

    def flags(g: Column) -> Column:
        def flag(k: Column) -> Column:
            r = F.floor(k / HASH_SIDE)
            c = k % HASH_SIDE
            left = F.element_at(g, (r * w + c + 1).cast("int"))
            right = F.element_at(g, (r * w + c + 2).cast("int"))
            return right > left

        return pack_bits(F.transform(F.sequence(F.lit(0), F.lit(N_BITS - 1)), flag))

    return _sized(_as_double_array(_col(grid9x8)), HASH_SIDE * w, flags)


def whash(grid: Column | str, side: int = HASH_SIDE) -> Column:
    """H4 Haar wavelet hash of a ``side x side`` grid (``side`` a multiple of 8).

    The Haar low-pass band at 8x8 is the mean of each ``side/8`` square block up to a positive
    scale; removing the overall level shifts all blocks equally, so the bit is
    "block mean above the median of the 64 block means".
    """
    if side % HASH_SIDE:
        raise ValueError("grid side must be a multiple of 8")
    b = side // HASH_SIDE

    def from_means(means: Column) -> Column:
        return let(_median(means), lambda med: pack_bits(F.transform(means, lambda x: x > med)))

    def body(g: Column) -> Column:
        if b == 1:
            return from_means(g)
        return let(F.transform(F.sequence(F.lit(0), F.lit(N_BITS - 1)), lambda k: block_mean(g, k)), from_means)

    def block_mean(g: Column, k: Column) -> Column:
        br = F.floor(k / HASH_SIDE)
        bc = k % HASH_SIDE
        cells = F.transform(
            F.sequence(F.lit(0), F.lit(b * b - 1)),
            lambda j: F.element_at(g, ((br * b + F.floor(j / b)) * side + bc * b + j % b + 1).cast("int")),
        )
        return F.aggregate(cells, F.lit(0.0), lambda a, x: a + x) / float(b * b)

    return _sized(_as_double_array(_col(grid)), side * side, body)


def _dct_matrix(n: int) -> np.ndarray:
    """Unnormalised DCT-II basis, ``C[u, x] = 2 cos(pi u (2x+1) / 2n)``."""
    u = np.arange(n)[:, None]
    x = np.arange(n)[None, :]
    return 2.0 * np.cos(math.pi * u * (2 * x + 1) / (2 * n))


def phash_numpy(grids: np.ndarray) -> np.ndarray:
    """pHash of a batch ``(rows, n, n)``: 2-D DCT, low 8x8 block, coefficient above its median."""
    n = grids.shape[1]
    c = _dct_matrix(n)
    coef = np.einsum("ux,bxy,vy->buv", c, grids, c, optimize=True)[:, :HASH_SIDE, :HASH_SIDE]
    low = coef.reshape(len(grids), N_BITS)
    med = np.median(low, axis=1, keepdims=True)
    return pack_flags_numpy(low > med)


def pack_flags_numpy(flags: np.ndarray) -> np.ndarray:
    """``(rows, 64)`` booleans -> int64 with bit k = flags[:, k]."""
    weights = np.left_shift(np.uint64(1), np.arange(N_BITS, dtype=np.uint64))
    packed = (flags.astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)
    return packed.view(np.int64)


@F.pandas_udf(T.LongType())
def _phash_udf(grid: pd.Series) -> pd.Series:
    out = np.zeros(len(grid), dtype=np.int64)
    valid = grid.notna().to_numpy()
    if valid.any():
        cells = np.stack([np.asarray(g, dtype=np.float64) for g in grid[valid]])
        side = int(round(math.sqrt(cells.shape[1])))
        out[valid] = phash_numpy(cells.reshape(-1, side, side))
    res = pd.Series(out)
    res[~valid] = None
    return res.astype("Int64")


# Marked non-deterministic only so the optimizer never copies the UDF into a pushed-down filter
# (``h IS NOT NULL`` below a projection would run the Python code twice); results are pure.
_phash_once = _phash_udf.asNondeterministic()


def phash(grid: Column | str) -> Column:
    """H1 perceptual hash of a square grid (8x8 or the usual 32x32 luma grid)."""
    return _phash_once(_as_double_array(_col(grid)))


# H5: hash selection by name.  Unknown names raise instead of silently falling back.
HASHES: dict[str, Callable[[Column | str], Column]] = {
    "phash": phash,
    "ahash": ahash,
    "dhash": dhash,
    "whash": whash,
}


def fingerprint(df: DataFrame, grid_col: str = "grid", method: str = "phash", out: str = "h") -> DataFrame:
    """Add a 64-bit fingerprint column computed by ``method`` from a grid column (H5)."""
    try:
        fn = HASHES[method]
    except KeyError:
        raise ValueError(f"unknown hash method {method!r}; choose one of {sorted(HASHES)}") from None
    return df.withColumn(out, fn(grid_col))


# ---------------------------------------------------------------- SimHash (H9)

# The characters that separate tokens.
TOKEN_BLANKS = b" \t\r\n"
KNOWN_TOKENS = 1 << 16  # token hashes that a task remembers at once
SIMHASH_RUN = 1 << 21  # bytes of token hashes unpacked at a time (eight times as many)


def simhash_numpy(digests: bytes) -> int:
    """Charikar SimHash of token hashes of 8 bytes each, most significant byte first: a bit is set
    when more tokens have it than not; no token gives 0.  As a signed 64-bit integer."""
    n = len(digests) // 8
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(digests), SIMHASH_RUN):
        raw = np.frombuffer(digests[at : at + SIMHASH_RUN], dtype=np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


@F.arrow_udf(T.LongType())
def _simhash_udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    blanks = bytes.maketrans(TOKEN_BLANKS, b" " * len(TOKEN_BLANKS))
    known: dict[bytes, bytes] = {}
    for texts in batches:
        out: list[int | None] = []
        for text in texts:  # a batch stays in Arrow, and one text at a time is a Python object
            if not text.is_valid:
                out.append(None)
                continue
            tokens = set(text.as_py().translate(blanks).split(b" "))
            tokens.discard(b"")
            digests = []
            for t in tokens:
                d = known.get(t)
                if d is None:
                    if len(known) >= KNOWN_TOKENS:
                        known.clear()
                    d = known[t] = hashlib.md5(t, usedforsecurity=False).digest()[:8]
                digests.append(d)
            out.append(simhash_numpy(b"".join(digests)))
        yield pa.array(out, pa.int64())


_simhash_once = _simhash_udf.asNondeterministic()  # see _phash_once


def simhash(text: Column | str) -> Column:
    """H9: 64-bit SimHash of a text: the distinct tokens of the lower-cased text vote with the first
    64 bits of their MD5.  Each distinct token of a task is hashed once, in Arrow batches."""
    return _simhash_once(F.lower(_col(text)).cast("binary"))
