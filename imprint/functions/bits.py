"""64-bit fingerprint columns: Hamming distance, hex text, similarity labels.

A fingerprint is one signed ``bigint`` holding 64 packed bits.  The sign bit is data, so
hashes are only ever compared for equality or by XOR, never as numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 64

# Lowest distance, highest distance, wording.
SIMILARITY_LABELS = (
    (0, 0, "exact"),
    (1, 5, "very similar"),
    (6, 10, "similar"),
    (11, 15, "recognisable"),
    (16, HASH_BITS, "different"),
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hamming(a: Column | str, b: Column | str) -> Column:
    """Number of differing bits of two 64-bit hashes, 0..64."""
    return F.bit_count(_col(a).bitwiseXOR(_col(b))).cast("int")


def to_hex(h: Column | str) -> Column:
    """16 lower-case hex digits, two's complement for the sign bit (H6)."""
    return F.lpad(F.lower(F.hex(_col(h))), 16, "0")


def from_hex(s: Column | str) -> Column:
    """Inverse of :func:`to_hex`; up to 16 hex digits, NULL for anything else (H6)."""
    s = _col(s)
    ok = s.rlike("^[0-9a-fA-F]{1,16}$")
    return F.when(ok, F.conv(s, 16, -10).cast("bigint"))


def similarity_label(distance: Column | str) -> Column:
    """Threshold-guide wording for a distance."""
    d = _col(distance)
    out = None
    for lo, hi, label in SIMILARITY_LABELS:
        cond = d.between(lo, hi)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out
