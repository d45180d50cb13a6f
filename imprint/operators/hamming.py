"""Exact Hamming range search and similarity joins on 64-bit hashes.

A predicate ``bit_count(a ^ b) <= t`` has no equi-key, so Spark would plan it as a nested loop.
The join here is multi-index hashing (Norouzi, Punjani & Fleet 2012) with the general pigeonhole
(Qin et al. 2018): split the bits into bands with radii ``r_1 .. r_m``; if two hashes are within
``t`` and the sum of ``(r_j + 1)`` exceeds ``t``, then some band ``j`` differs in at most ``r_j``
bits.  The index side emits one row per band, the probe side one row per band and per value
within its radius, and the two meet on an equi-join ``(band, value)``.  Each pair is kept only at
the *first* band that satisfies the bound, so there is no ``distinct``; the exact distance filter
removes the rest.  No false negatives.

Planning reads one bounded sample of hashes.  Bits that tell them apart are dealt to the bands so
that each band is about equally selective (blank image areas give constant or nearly constant
bits; leaving bits out never loses a pair).  Candidates of each band and radius are measured on
the sampled pairs, and dynamic programming picks the radii for every number of bands; the cheapest
plan (probe rows + index rows + candidates) wins.  The sample decides the route, not the result.

A radius can be shared by the two sides: the probe flips ``p`` bits of a band, the index ``r - p``, and
hashes that differ in ``r`` bits meet on a value in between.  Of a band of 21 bits that is 22 rows a side
instead of 232 for r = 2.  Of the values on which a pair meets one counts: the probe has flipped the lowest bits.

Where the threshold is so wide that the rows and candidates of every plan cost more than comparing all
hashes, they are compared: blocks of both sides meet as Arrow batches, a bounded part of a block at a time.

A band value that is still shared by very many hashes is found on a bounded sample and joined
again on *sub-bands of the other bits*: two hashes that meet on a band have the rest of their
distance outside it, so the pigeonhole applies again there, keyed by ``(band, key, sub-band,
sub-value)``.  The hot-key table is bounded by construction (``<= index rows / hot threshold``)
before it is broadcast.  The same plan runs at every size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from imprint._ship import ship_with_tasks
from imprint.functions.bits import hamming
from imprint.functions.naming import basename
from imprint.operators.ranking import number_rows
from imprint.session import cut_lineage, spread

ship_with_tasks(__name__)

N_BITS = 64
MAX_KEYS_PER_ROW = 4096  # flip masks per probe row we accept when choosing the band plan
HOT_KEY_MIN_ROWS = 4096  # an index key with more rows than this is re-banded
MAX_HOT_KEYS = 20_000  # bound on the broadcast hot-key table
SAMPLE = 512  # hashes that planning looks at
RELIABLE = 30  # sampled pairs that make a measured share reliable
SAMPLE_PER_HOT_KEY = 100  # sampled rows expected per hot key at the threshold
PROBE_COST, CANDIDATE_COST = 100, 50  # of a row, against one comparison in a block
SHUFFLED = 4  # a row against a candidate, where the sides may share a radius to make fewer rows
BLOCKS_FROM = 1 << 24  # comparisons below which no blocks are made
BLOCK, LEAST_BLOCK = 1 << 14, 1 << 11  # rows of a side of a block
COMPARED = 1 << 17  # comparisons of a block at a time


def _signed(u: int) -> int:
    u &= (1 << N_BITS) - 1
    return u - (1 << N_BITS) if u >= 1 << (N_BITS - 1) else u


def _bits_of(mask: int) -> list[int]:
    return [b for b in range(N_BITS) if (mask >> b) & 1]


def _flips(mask: int, radius: int) -> list[int]:
    """Every XOR mask of at most ``radius`` bits of ``mask``."""
    bits = _bits_of(mask)
    return [sum(1 << b for b in some) for k in range(radius + 1) for some in combinations(bits, k)]


@dataclass(frozen=True)
class BandPlan:
    """Bands as bit masks, the radius probed on each, each band's entropy in bits, and how much of
    each radius the index side flips (nothing, if empty)."""

    radii: tuple[int, ...]
    masks: tuple[int, ...]
    entropy: tuple[float, ...]
    shared: tuple[int, ...] = ()

    @property
    def bands(self) -> int:
        return len(self.masks)

    @property
    def widths(self) -> tuple[int, ...]:
        return tuple(m.bit_count() for m in self.masks)

    @property
    def reach(self) -> int:
        """The largest distance at which no pair can be missed."""
        if any(r >= w for r, w in zip(self.radii, self.widths, strict=True)):
            return N_BITS  # every value of some band is probed
        return sum(r + 1 for r in self.radii) - 1

    @property
    def index_radii(self) -> tuple[int, ...]:
        return self.shared or (0,) * self.bands

    @property
    def probe_radii(self) -> tuple[int, ...]:
        return tuple(r - i for r, i in zip(self.radii, self.index_radii, strict=True))

    @property
    def keys_per_row(self) -> int:
        return sum(_keys(w, r) for w, r in zip(self.widths, self.probe_radii, strict=True))

    @property
    def index_keys(self) -> int:
        return sum(_keys(w, r) for w, r in zip(self.widths, self.index_radii, strict=True))


UNIFORM = (1.0,) * N_BITS


def _keys(width: int, radius: int) -> int:
    """Values within ``radius`` flips of one value of a band."""
    return sum(math.comb(width, k) for k in range(radius + 1))


def _deal(bits: Sequence[int], entropy: Sequence[float], bands: int) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """Masks and entropies of ``bands`` bands: each bit, richest first, goes to the poorest band."""
    masks, total = [0] * bands, [0.0] * bands
    for b in sorted(bits, key=lambda b: (-entropy[b], b)):
        j = min(range(bands), key=lambda j: (total[j], masks[j].bit_count(), j))
        masks[j] |= 1 << b
        total[j] += entropy[b]
    return tuple(masks), tuple(total)


def sample_entropy(sample: np.ndarray | None) -> tuple[float, ...]:
    """Collision entropy of every bit in a sample of hashes; 0 where it never varies there."""
    if sample is None or not len(sample):
        return UNIFORM
    p = (sample[:, None] >> np.arange(N_BITS, dtype=np.uint64) & np.uint64(1)).mean(axis=0)
    return tuple(float(-np.log2(x * x + (1 - x) ** 2)) + 0.0 for x in p)


def hash_sample(hashes: DataFrame, hash_col: str = "h") -> np.ndarray:
    """At most SAMPLE hashes, the same for the same table: those of the smallest mixed hash."""
    rows = hashes.select(F.col(hash_col).alias("h")).where("h is not null")
    rows = rows.orderBy(F.xxhash64("h"), "h").limit(SAMPLE).collect()
    return np.array([r["h"] for r in rows], np.int64).view(np.uint64)


def sampled_distances(sample: np.ndarray) -> np.ndarray:
    """XOR of every pair of sampled hashes."""
    i, j = np.triu_indices(len(sample), 1)
    return sample[i] ^ sample[j]


def band_plan(threshold: int, bands: int, entropy: Sequence[float] = UNIFORM) -> BandPlan:
    """A plan of at most ``bands`` bands over the bits of positive ``entropy`` (all bits if none
    has), with radii as equal as the threshold allows."""
    if not 0 <= threshold <= N_BITS:
        raise ValueError("threshold must be in 0..64")
    live = [b for b in range(N_BITS) if entropy[b] > 0] or list(range(N_BITS))
    bands = max(1, min(bands, len(live), threshold + 1))
    masks, total = _deal(live, entropy, bands)
    units = [(threshold + 1) // bands + (j < (threshold + 1) % bands) for j in range(bands)]
    return BandPlan(tuple(min(u - 1, m.bit_count()) for u, m in zip(units, masks, strict=True)), masks, total)


def _near_shares(mask: int, entropy: Sequence[float], differ: np.ndarray | None) -> np.ndarray:
    """Share of pairs within 0, 1, ... flips on a band: as measured where at least RELIABLE sampled
    pairs are, else no less than independent bits would give."""
    shares = np.ones(1)
    for b in _bits_of(mask):
        p = 1 - 2.0 ** -entropy[b]  # that two hashes differ in this bit
        shares = np.append(shares, 0.0) * (1 - p) + np.append(0.0, shares) * p
    shares = shares.cumsum()
    if differ is not None:
        width = mask.bit_count()
        met = np.bincount(np.bitwise_count(differ & np.uint64(mask)), minlength=width + 1).cumsum()
        measured = met / len(differ)
        shares = np.where(met >= RELIABLE, measured, np.maximum(measured, shares))
    return shares


def _meetings(width: int, radius: int, shared: int, shares: np.ndarray) -> float:
    """Values of a band on which a pair of hashes is expected to meet, the probe flipping up to
    ``radius - shared`` bits and the index up to ``shared``."""
    if not shared:
        return float(shares[radius])
    at = np.diff(np.maximum.accumulate(shares), prepend=0.0)
    return sum(float(at[d]) * _ways(width, d, radius - shared, shared) for d in range(radius + 1))


@cache
def _ways(width: int, d: int, probe: int, index: int) -> int:
    """Values within ``probe`` flips of one and ``index`` flips of the other of two values that differ in ``d`` bits."""
    # i of these bits are flipped on the probe's side, e of the others on both
    return sum(
        math.comb(d, i) * math.comb(width - d, e)
        for i in range(max(0, d - index), min(d, probe) + 1)
        for e in range(min(probe - i, index - d + i, width - d) + 1)
    )


def _allotted(threshold: int, costs: list[list[float]]) -> tuple[float, tuple[int, ...]]:
    """Radii r_j with sum(r_j + 1) = threshold + 1 at the least total of ``costs[j][r_j + 1]``
    (a band with radius -1 is not used), by dynamic programming over the bands."""
    need = threshold + 1
    best: list[tuple[float, tuple[int, ...]]] = [(0.0, ())] + [(math.inf, ())] * need
    for band in costs:
        after = []
        for units in range(need + 1):
            options = [(best[units - u][0] + c, u) for u, c in enumerate(band) if u <= units]
            cost, u = min(options)
            after.append((cost, (*best[units - u][1], u - 1)))
        best = after
    return best[need]


def _cheapest(
    threshold: int,
    n_probe: int,
    n_index: int,
    bits: list[int],
    entropy: Sequence[float],
    sample: np.ndarray | None = None,
    share: bool = False,
) -> BandPlan:
    """The plan of least cost over all numbers of bands and all radii that the general pigeonhole
    allows: two hashes within the threshold differ in at most r_j bits on some band j whenever
    the sum of (r_j + 1) exceeds it.  With ``share`` also over how the sides share each radius."""
    differ = sampled_distances(sample) if sample is not None and len(sample) > 1 else None
    best, best_cost = None, math.inf
    everything, weight = float(n_probe) * n_index, SHUFFLED if share else 1
    for m in range(1, min(threshold + 1, len(bits)) + 1):
        masks, total = _deal(bits, entropy, m)
        costs, parts = [], []
        for mask in masks:
            width, shares = mask.bit_count(), _near_shares(mask, entropy, differ)
            row, part = [0.0], [0]
            for r in range(width + 1):
                ways = [
                    (weight * (n_probe * keys + n_index * _keys(width, i)) + everything * _meetings(width, r, i, shares), i)
                    for i in range(r // 2 + 1 if share else 1)
                    if (keys := _keys(width, r - i)) <= MAX_KEYS_PER_ROW
                ]
                if not ways:
                    break
                cost, i = min(ways)
                row.append(cost)
                part.append(i)
            if len(row) == width + 2:  # probing every value of a band meets all hashes, at any distance
                row += [row[-1]] * (threshold + 1 - len(row) + 1)
            costs.append(row)
            parts.append(part)
        cost, radii = _allotted(threshold, costs)
        radii = tuple(min(r, mask.bit_count()) for r, mask in zip(radii, masks, strict=False))
        if cost >= best_cost:
            continue
        used = [j for j, r in enumerate(radii) if r >= 0]
        shared = tuple(parts[j][radii[j] + 1] for j in used)
        plan = BandPlan(*(tuple(x[j] for j in used) for x in (radii, masks, total)), shared if any(shared) else ())
        if plan.keys_per_row <= MAX_KEYS_PER_ROW:
            best, best_cost = plan, cost
    return best or band_plan(threshold, threshold + 1, entropy)


def choose_band_plan(
    threshold: int, n_probe: int, n_index: int, sample: np.ndarray | None = None, share: bool = False
) -> BandPlan:
    """Cheapest exact plan: probe rows + index rows + expected candidate pairs."""
    entropy = sample_entropy(sample)
    live = [b for b in range(N_BITS) if entropy[b] > 0] or list(range(N_BITS))
    return _cheapest(threshold, n_probe, n_index, live, entropy, sample, share)


def _blocks_pay(plan: BandPlan, n_probe: int, n_index: int, sample: np.ndarray) -> bool:
    """Whether comparing all hashes costs less than the rows and candidates of ``plan``."""
    everything = float(n_probe) * n_index
    if everything < BLOCKS_FROM:
        return False
    entropy, differ = sample_entropy(sample), sampled_distances(sample) if len(sample) > 1 else None
    met = sum(
        _meetings(m.bit_count(), r, i, _near_shares(m, entropy, differ))
        for m, r, i in zip(plan.masks, plan.radii, plan.index_radii, strict=True)
    )
    rows = float(n_probe) * plan.keys_per_row + float(n_index) * plan.index_keys
    return PROBE_COST * rows + CANDIDATE_COST * met * everything > everything


def _index_rows(df: DataFrame, h: str, plan: BandPlan) -> DataFrame:
    if plan.shared:
        return _flipped_rows(spread(df), h, plan, plan.index_radii)
    vals = [F.col(h).bitwiseAND(F.lit(_signed(m)).cast("long")) for m in plan.masks]
    return df.select("*", F.posexplode(F.array(*vals)).alias("_band", "_key"))


def _probe_rows(df: DataFrame, h: str, plan: BandPlan) -> DataFrame:
    return _flipped_rows(df, h, plan, plan.probe_radii)


def _flipped_rows(df: DataFrame, h: str, plan: BandPlan, radii: Sequence[int]) -> DataFrame:
    entries = [(j, _signed(f)) for j, m in enumerate(plan.masks) for f in _flips(m, radii[j])]
    bands = F.lit([j for j, _ in entries])
    masks = F.lit([_signed(m) for m in plan.masks]).cast("array<bigint>")
    out = df.select("*", F.posexplode(F.lit([f for _, f in entries]).cast("array<bigint>")).alias("_e", "_flip"))
    out = out.withColumn("_band", F.element_at(bands, F.col("_e") + 1))
    key = F.col(h).bitwiseAND(F.element_at(masks, F.col("_band") + 1)).bitwiseXOR(F.col("_flip"))
    return out.withColumn("_key", key).drop("_e", "_flip")


def _first_band_ok(x: Column, band: Column, plan: BandPlan) -> Column:
    """True when no band before ``band`` is already within the radius (keeps one copy per pair)."""
    conds = [
        (band <= j) | (F.bit_count(x.bitwiseAND(F.lit(_signed(m)).cast("long"))) > plan.radii[j])
        for j, m in enumerate(plan.masks[:-1])
    ]
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def _lowest_flipped(hp: str, hi: str, plan: BandPlan) -> Column:
    """True on one of the values on which a pair meets: of the bits of the band that differ the
    probe has flipped the lowest, as many as it may, and the index the others."""
    if not plan.shared:
        return F.lit(True)
    band1, zero = F.col("_band") + 1, F.lit(0).cast("long")
    mine = F.element_at(F.lit([_signed(m) for m in plan.masks]).cast("array<bigint>"), band1)
    a = F.col("_key").bitwiseXOR(F.col(hp).bitwiseAND(mine))
    b = F.col("_key").bitwiseXOR(F.col(hi).bitwiseAND(mine))
    most = F.element_at(F.lit(list(plan.probe_radii)), band1)
    # -b and lowest - 1 leave the range of bigint for bit 63 alone
    lowest = b.bitwiseAND(F.coalesce(F.try_subtract(zero, b), b))
    below = F.coalesce(F.try_subtract(lowest, F.lit(1).cast("long")), F.lit((1 << (N_BITS - 1)) - 1).cast("long"))
    apart = (a.bitwiseAND(b) == 0) & (a.bitwiseAND(F.bitwise_not(below)) == 0)
    return apart & (F.bit_count(a) == F.least(most, F.bit_count(a.bitwiseOR(b))))


def _may_have_hot_keys(plan: BandPlan, n_index: int, sample: np.ndarray) -> bool:
    """Whether to look for hot keys: not if no key can be hot, nor if a hot key would have to hold
    a twentieth of all hashes and no sampled key holds half of that."""
    hot = max(HOT_KEY_MIN_ROWS, n_index * plan.index_keys / MAX_HOT_KEYS) / max(n_index, 1)
    if hot >= 1 or hot < 0.05 or len(sample) < min(SAMPLE, n_index):
        return hot < 1
    top = 0
    for m, i in zip(plan.masks, plan.index_radii, strict=True):
        keys = (sample & np.uint64(m))[:, None] ^ np.array(_flips(m, i), np.uint64)
        top = max(top, np.unique(keys, return_counts=True)[1].max())
    return top / len(sample) >= hot / 2


def _hot_keys(index: DataFrame, n_index_rows: int) -> DataFrame:
    """Index keys ``(band, key)`` holding more than the hot threshold of rows, with an estimate.

    Found on a Bernoulli sample of about ``SAMPLE_PER_HOT_KEY * MAX_HOT_KEYS`` index rows (no
    shuffle of the whole index side).  A key kept here has at least ``hot_min * fraction``
    sampled rows, so there are at most ``n_index_rows / hot_min <= MAX_HOT_KEYS`` of them: a
    proven bound for the broadcast.  Which keys are called hot never changes the result.
    """
    hot_min = max(HOT_KEY_MIN_ROWS, math.ceil(n_index_rows / MAX_HOT_KEYS))
    fraction = min(1.0, SAMPLE_PER_HOT_KEY * MAX_HOT_KEYS / max(n_index_rows, 1))
    sample = index if fraction >= 1.0 else index.sample(fraction=fraction, seed=17)
    return (
        sample.groupBy("_band", "_key")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > hot_min * fraction)
        .select("_band", "_key", (F.col("_n") / fraction).alias("_est"))
    )


def _hot_join(
    prows: DataFrame, irows: DataFrame, plan: BandPlan, threshold: int, rows: int, entropy: Sequence[float], hp: str, hi: str
) -> DataFrame:
    """Candidates of hot keys, joined again on sub-bands of the other bits (exact, one copy).

    ``rows`` is the size of the largest hot key, which sets the number of sub-bands.
    """
    live = [b for b in range(N_BITS) if any(m >> b & 1 for m in plan.masks)]
    subs = []
    for m in plan.masks:
        rest = [b for b in live if not m >> b & 1]
        # a band of all bits: its hot key is one repeated value, joined as it is
        subs.append(_cheapest(threshold, rows, rows, rest, entropy) if rest else BandPlan((0,), (0,), (0.0,)))
    entries = [[(s, _signed(f)) for s, m in enumerate(p.masks) for f in _flips(m, p.radii[s])] for p in subs]
    band1 = F.col("_band") + 1
    masks = F.lit([[_signed(m) for m in p.masks] for p in subs]).cast("array<array<bigint>>")
    flips = F.lit([[f for _, f in e] for e in entries]).cast("array<array<bigint>>")
    which = F.lit([[s for s, _ in e] for e in entries]).cast("array<array<int>>")
    p = prows.select("*", F.posexplode(F.element_at(flips, band1)).alias("_e", "_flip"))
    p = p.withColumn("_s", F.element_at(F.element_at(which, band1), F.col("_e") + 1))
    mine = F.element_at(F.element_at(masks, band1), F.col("_s") + 1)
    p = p.withColumn("_key2", F.col(hp).bitwiseAND(mine).bitwiseXOR(F.col("_flip"))).drop("_e", "_flip")
    i = irows.select("*", F.posexplode(F.element_at(masks, band1)).alias("_s", "_smask"))
    i = i.withColumn("_key2", F.col(hi).bitwiseAND(F.col("_smask"))).drop("_smask")
    x = F.col(hp).bitwiseXOR(F.col(hi))
    # no sub-band before this one is within its radius: plain conditions, after the distance
    first = F.lit(True)
    for j, sub in enumerate(subs):
        for s, m in enumerate(sub.masks[:-1]):
            near = F.bit_count(x.bitwiseAND(F.lit(_signed(m)).cast("long"))) <= sub.radii[s]
            first &= ~((F.col("_band") == j) & (F.col("_s") > s) & near)
    cand = p.hint("merge").join(i, ["_band", "_key", "_s", "_key2"], "inner")
    return cand.where(hamming(hp, hi) <= threshold).where(first).drop("_s", "_key2")


def _near_in_block(probe: Sequence[str], index: Sequence[str], hp: str, hi: str, threshold: int, half: bool):
    def search(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.Table.from_batches(list(batches))
        side = block.column("_side").to_numpy()
        left = block.filter(pa.array(side == 0)).select(probe).combine_chunks()
        right = block.filter(pa.array(side == 1)).select(index).combine_chunks()
        p, q = (t.column(c).to_numpy().view(np.uint64) for t, c in ((left, hp), (right, hi)))
        same = key[0].as_py() == key[1].as_py()
        step = max(1, COMPARED // max(len(q), 1))
        for at in range(0, len(p) if len(q) else 0, step):
            x = p[at : at + step]
            far = np.bitwise_count(x[:, None] ^ q)
            near = np.flatnonzero(far <= threshold)
            i, j = np.divmod(near, len(q))
            if half:
                swap = p.view(np.int64)[i + at] > q.view(np.int64)[j]
                if same:  # both orders are met
                    kept = ~swap & (x[i] != q[j])
                    near, i, j, swap = near[kept], i[kept], j[kept], swap[kept]
            if len(near):
                cells = [left.column(c).take(pa.array(i + at)) for c in probe]
                cells += [right.column(c).take(pa.array(j)) for c in index]
                if half and not same:
                    k, other = len(probe), pa.array(swap)
                    turned = [pc.if_else(other, b, a) for a, b in zip(cells[:k], cells[k:])]
                    cells = turned + [pc.if_else(other, a, b) for a, b in zip(cells[:k], cells[k:])]
                cells.append(pa.array(far.ravel()[near].astype(np.int32)))
                out = pa.Table.from_arrays(cells, names=[*probe, *index, "distance"])
                yield from out.combine_chunks().to_batches()

    return search


def _block_join(
    probe: DataFrame, index: DataFrame, hp: str, hi: str, threshold: int, n_probe: int, n_index: int, half: bool
) -> DataFrame:
    """Pairs within ``threshold``, by comparing the hashes of every block of the probe side with those
    of every block of the index side.  ``half``: as in :func:`similarity_join`."""
    size, tasks = BLOCK, int(probe.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while size > LEAST_BLOCK and -(-n_probe // size) * -(-n_index // size) < tasks:
        size //= 2
    nums = [-(-n // size) for n in (n_probe, n_index)]
    i, j = F.pmod(F.xxhash64(hp), F.lit(nums[0])), F.pmod(F.xxhash64(hi), F.lit(nums[1]))
    from_i = F.sequence(i if half else F.lit(0).cast("long"), F.lit(nums[1] - 1).cast("long"))
    to_j = F.sequence(F.lit(0).cast("long"), j if half else F.lit(nums[0] - 1).cast("long"))
    p = probe.where(F.col(hp).isNotNull()).select("*", i.alias("_i"), F.explode(from_i).alias("_j"), F.lit(0).alias("_side"))
    x = index.where(F.col(hi).isNotNull()).select("*", j.alias("_j"), F.explode(to_j).alias("_i"), F.lit(1).alias("_side"))
    found = _near_in_block(probe.columns, index.columns, hp, hi, threshold, half)
    schema = T.StructType([*probe.schema.fields, *index.schema.fields, T.StructField("distance", T.IntegerType())])
    return p.unionByName(x, allowMissingColumns=True).groupBy("_i", "_j").applyInArrow(found, schema)


def similarity_join(
    probe: DataFrame,
    index: DataFrame,
    threshold: int,
    probe_hash: str = "h",
    index_hash: str = "h",
    plan: BandPlan | None = None,
    split_hot_keys: bool = True,
    n_probe: int | None = None,
    n_index: int | None = None,
    sample: np.ndarray | None = None,
    half: bool = False,
) -> DataFrame:
    """All (probe row, index row) pairs with Hamming distance <= threshold, plus ``distance``.

    Column names of the two sides must not clash except for the hash columns, which are
    renamed ``{name}_probe`` / ``{name}_index`` when equal.  Rows without a hash have no pairs.
    With ``half`` both sides are one table of distinct hashes, with their columns in the same order, and
    the pairs whose probe hash is the smaller are returned.
    """
    if probe_hash == index_hash:
        probe = probe.withColumnRenamed(probe_hash, f"{probe_hash}_probe")
        index = index.withColumnRenamed(index_hash, f"{index_hash}_index")
        probe_hash, index_hash = f"{probe_hash}_probe", f"{index_hash}_index"
    n_probe = probe.count() if n_probe is None else n_probe
    n_index = index.count() if n_index is None else n_index
    if sample is None and (plan is None or split_hot_keys):
        sample = hash_sample(index, index_hash)
    if plan is None:
        plan = choose_band_plan(threshold, max(n_probe, 1), max(n_index, 1), sample, share=True)
        if _blocks_pay(plan, n_probe, n_index, sample):
            return _block_join(probe, index, probe_hash, index_hash, threshold, n_probe, n_index, half)
    if plan.keys_per_row > MAX_KEYS_PER_ROW:
        raise ValueError(f"band plan needs {plan.keys_per_row} probe keys per row; use more bands")
    irows = _index_rows(index, index_hash, plan)
    # a probe row becomes many: a small table of few files is dealt to all cores first
    prows = _probe_rows(spread(probe), probe_hash, plan)
    keys = ["_band", "_key"]
    cand = None
    if split_hot_keys and _may_have_hot_keys(plan, n_index, sample):
        found = cut_lineage(_hot_keys(irows, n_index * plan.index_keys), "hot-keys")
        largest = found.agg(F.max("_est")).first()[0]  # one scalar
        if largest is not None:
            hot = F.broadcast(found.select(*keys))
            hot_cand = _hot_join(
                prows.join(hot, keys, "left_semi"),
                irows.join(hot, keys, "left_semi"),
                plan,
                threshold,
                math.ceil(largest),
                sample_entropy(sample),
                probe_hash,
                index_hash,
            )
            cold = prows.join(hot, keys, "left_anti").hint("merge").join(irows.join(hot, keys, "left_anti"), keys, "inner")
            cand = cold.unionByName(hot_cand)
    if cand is None:
        # exploded rows are estimated at the size of the table before, so a broadcast has no bound
        cand = prows.hint("merge").join(irows, keys, "inner")
    x = F.col(probe_hash).bitwiseXOR(F.col(index_hash))
    dist = hamming(probe_hash, index_hash)
    if half:
        cand = cand.where(F.col(probe_hash) < F.col(index_hash))
    return (
        cand.where(dist <= threshold)
        .where(_first_band_ok(x, F.col("_band"), plan))
        .where(_lowest_flipped(probe_hash, index_hash, plan))
        .withColumn("distance", dist)
        .drop(*keys)
    )


def similar_pairs(
    hashes: DataFrame,
    threshold: int,
    hash_col: str = "h",
    plan: BandPlan | None = None,
    split_hot_keys: bool = True,
    distinct_input: bool = False,
    carry: str | None = None,
) -> DataFrame:
    """Pairs ``(h_a, h_b, distance)`` of *distinct* hashes within ``threshold``, ``h_a < h_b``.

    ``carry`` names a column of a distinct input that comes along as ``{carry}_a``, ``{carry}_b``.
    Exact copies are removed first (partial aggregation before the shuffle), so a hash shared
    by a third of all files is one row here.
    """
    if distinct_input:  # caller passes a written table of distinct, non-null hashes
        distinct = hashes.select(F.col(hash_col).alias("h"), *([carry] if carry else []))
    else:
        distinct = hashes.select(F.col(hash_col).alias("h")).where(F.col("h").isNotNull()).distinct()
        # both join sides, the size estimate and the hot-key scan read this one materialised table
        distinct = cut_lineage(distinct, "distinct-hashes")
    n = distinct.count()
    names = distinct.columns
    pairs = similarity_join(
        distinct.select(*(F.col(c).alias(f"{c}_a") for c in names)),
        distinct.select(*(F.col(c).alias(f"{c}_b") for c in names)),
        threshold,
        probe_hash="h_a",
        index_hash="h_b",
        plan=plan,
        split_hot_keys=split_hot_keys,
        n_probe=n,
        n_index=n,
        sample=hash_sample(distinct),
        half=True,
    )
    kept = [f"{c}_{side}" for c in names if c != "h" for side in "ab"]
    return pairs.select("h_a", "h_b", "distance", *kept)


def join_stats(hashes: DataFrame, threshold: int, hash_col: str = "h") -> dict:
    """Sizes of the J5 self-join on distinct hashes: band plan, probe rows, equi-join candidates
    (before the distance and first-band filters) and result pairs.  For reports, not queries."""
    distinct = cut_lineage(
        hashes.select(F.col(hash_col).alias("h")).where(F.col("h").isNotNull()).distinct(), "stats-hashes"
    )
    n = distinct.count()
    plan = choose_band_plan(threshold, max(n, 1), max(n, 1), hash_sample(distinct))
    probe = _probe_rows(distinct.withColumnRenamed("h", "h_a"), "h_a", plan)
    index = _index_rows(distinct.withColumnRenamed("h", "h_b"), "h_b", plan)
    cand = probe.join(index, ["_band", "_key"]).where(F.col("h_a") < F.col("h_b"))
    return {
        "hashes": n,
        "bands": plan.bands,
        "radii": list(plan.radii),
        "probe_rows": probe.count(),
        "candidates": cand.count(),
        "pairs": similar_pairs(distinct, threshold, plan=plan, split_hot_keys=False).count(),
        "all_pairs": n * (n - 1) // 2,
    }


def range_search(index: DataFrame, query_hash: Column, threshold: int, hash_col: str = "h") -> DataFrame:
    """Rows of ``index`` within ``threshold`` of one query hash, with ``distance``.

    ``query_hash`` is a scalar column (a literal or ``DataFrame.scalar()`` subquery): one
    linear scan of the index, no join and no shuffle.
    """
    dist = hamming(F.col(hash_col), query_hash)
    return index.withColumn("distance", dist).where(F.col("distance") <= threshold)


def _without_query(hits: DataFrame, query_name: Column | None, name_col: str) -> DataFrame:
    """without the rows whose base name is the query's (NULL names stay)."""
    if query_name is None:
        return hits
    return hits.where(~F.coalesce(basename(name_col) == basename(query_name), F.lit(False)))


def neighbours(
    files: DataFrame,
    query_hash: Column,
    threshold: int,
    query_name: Column | None = None,
    name_col: str = "path",
    hash_col: str = "h",
) -> DataFrame:
    """E2 part 1 (J4, J6, F2, T1): files within ``threshold`` of the query, nearest first.

    Files with the query's base name are left out.  Rows are sorted by distance, then name; the
    column ``rank`` counts them from 1.
    """
    hits = _without_query(range_search(files, query_hash, threshold, hash_col), query_name, name_col)
    return number_rows(hits, ["distance", name_col], out="rank").orderBy("rank")


def closest_non_duplicates(
    files: DataFrame,
    query_hash: Column,
    threshold: int,
    k: int = 10,
    query_name: Column | None = None,
    name_col: str = "path",
    hash_col: str = "h",
) -> DataFrame:
    """E2 part 2 (T2, F3): the ``k`` closest files with distance above ``threshold``.

    Planned as a TakeOrderedAndProject: each task keeps its own top ``k``; the limit is the
    feature here (a top-k report).
    """
    hits = range_search(files, query_hash, N_BITS, hash_col).where(F.col("distance") > threshold)
    hits = _without_query(hits, query_name, name_col)
    return hits.orderBy(F.col("distance"), F.col(name_col)).limit(k)
