"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each entry recomputes a query from the base tables (views ``events``, ``embeddings``,
``documents`` ...) with plain SQL, independently of the Spark code.  Column names and types
match the Spark results.  Fingerprints are packed through HUGEINT and folded to signed BIGINT.
"""

from __future__ import annotations

# ---------------------------------------------------------------- shared CTE fragments

MEDIA_FILES = """
media_files AS (
  SELECT event_id,
    CASE event_id % 7
      WHEN 0 THEN 'IMG_' || strftime(ts, '%Y%m%d_%H%M%S')
      WHEN 1 THEN strftime(ts, '%Y-%m-%d')
      WHEN 2 THEN 'shot ' || strftime(ts, '%Y-%m-%d_%H-%M-%S')
      WHEN 3 THEN strftime(ts, '%d-%m-%Y %H:%M:%S')
      WHEN 4 THEN 'DSC_' || CAST(event_id AS VARCHAR)
      WHEN 5 THEN '2024-02-30_10-00-00'
      ELSE 'IMG-' || strftime(ts, '%Y%m%d') || '-WA' || CAST(event_id % 50 AS VARCHAR)
    END || ['.jpg', '.JPG', '.png', '.heic', '.txt'][event_id % 5 + 1] AS name,
    CASE WHEN event_id % 4 = 0 THEN strftime(ts, '%Y:%m:%d %H:%M:%S')
         WHEN event_id % 4 = 1 THEN '0000:00:00 00:00:00' END AS exif_original,
    CASE WHEN event_id % 6 = 0 THEN strftime(ts, '%Y:%m:%d %H:%M:%S') END AS exif_datetime,
    CAST(date_trunc('second', ts) AS TIMESTAMP) AS mtime,
    CASE WHEN event_id % 23 <> 0 THEN CAST(400 + (event_id * 37) % 3600 AS BIGINT) END AS width,
    CAST(300 + (event_id * 53) % 2700 AS BIGINT) AS height,
    CAST(round(value * 10000) AS BIGINT) AS size_bytes,
    CASE WHEN event_id % 31 <> 0 THEN CAST(round(value * 10000) AS BIGINT) * (50 + event_id % 60) // 100 END AS encoded_size
  FROM events
),
media AS (SELECT *, 'd' || CAST(event_id AS VARCHAR) || '/' || name AS path FROM media_files)"""

MEDIA_PRIOR = """
media_prior AS (
  SELECT event_id, path,
         CASE WHEN event_id % 11 = 0 THEN mtime - INTERVAL 1 HOUR ELSE mtime END AS mtime
  FROM media WHERE event_id % 9 <> 0
  UNION ALL
  SELECT -event_id, 'd' || CAST(-event_id AS VARCHAR) || '/gone.jpg', mtime FROM media WHERE event_id % 13 = 0
)"""

EXISTING_NAMES = """
existing_names AS (
  SELECT DISTINCT name FROM (
    SELECT 'group-01-' || name AS name FROM media WHERE event_id % 17 = 0
    UNION ALL SELECT name FROM media WHERE event_id % 19 = 0)
)"""


def _fold(expr: str) -> str:
    """HUGEINT in [0, 2^64) -> two's-complement BIGINT."""
    return (
        f"CAST(CASE WHEN ({expr}) >= 9223372036854775808 THEN ({expr}) - 18446744073709551616 "
        f"ELSE ({expr}) END AS BIGINT)"
    )


def _pack(flag_at_i: str) -> str:
    """Pack 64 flags (an expression of ``i`` in 0..63) into a signed BIGINT."""
    s = f"list_sum(list_transform(range(64), lambda i: CASE WHEN {flag_at_i} THEN (1::HUGEINT << i) ELSE 0::HUGEINT END))"
    return _fold(s)


FP_EMBED = f"""
emb AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
emb_med AS (SELECT id, e, (list_sort(e)[32] + list_sort(e)[33]) / 2.0 AS med FROM emb),
fp_embed AS (SELECT id, {_pack('e[i + 1] > med')} AS h FROM emb_med)"""

FP_DOCS = f"""
doc_toks AS (
  SELECT doc_id AS id,
         list_filter(list_distinct(string_split_regex(lower(text), '[ \\t\\r\\n]+')), lambda x: x <> '') AS toks
  FROM documents),
doc_tok AS (SELECT id, len(toks) AS n, unnest(toks) AS tok FROM doc_toks),
doc_hv AS (SELECT id, n, CAST('0x' || substr(md5(tok), 1, 16) AS UBIGINT) AS u FROM doc_tok),
doc_bits AS (
  SELECT id, n, b, sum(CAST((u >> b) & 1 AS BIGINT)) AS ones
  FROM doc_hv, range(64) r(b) GROUP BY id, n, b),
doc_packed AS (
  SELECT id, sum(CASE WHEN 2 * ones > n THEN (1::HUGEINT << b) ELSE 0::HUGEINT END) AS s
  FROM doc_bits GROUP BY id),
fp_docs AS (
  SELECT d.doc_id AS id, COALESCE({_fold('p.s')}, CAST(0 AS BIGINT)) AS h
  FROM documents d LEFT JOIN doc_packed p ON p.id = d.doc_id)"""

FP_BLANK = """
fp_blank AS (SELECT id, h & CAST(4294967295 AS BIGINT) AS h FROM fp_docs)"""

GRID8 = """
grid8 AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS g FROM embeddings)"""



def grid_tiled(side: int) -> str:
    cell = f"((k // {side}) * 5 + (k % {side}) * 3 + (k // {side}) * (k % {side})) % 64"
    return f"""
tiled AS (SELECT id, list_transform(range({side * side}), lambda k: g[{cell} + 1]) AS g FROM grid8)"""


FP_GRID_WHASH16 = f"""
w16_cells AS (
  SELECT id, (k // 32) * 8 + (k % 16) // 2 AS b, k, g[k + 1] AS x FROM tiled, range(256) t(k)),
w16_sums AS (SELECT id, b, list(x ORDER BY k) AS xs FROM w16_cells GROUP BY id, b),
w16_blocks AS (SELECT id, b, (xs[1] + xs[2] + xs[3] + xs[4]) / 4.0 AS x FROM w16_sums),
w16_med AS (SELECT id, median(x) AS med FROM w16_blocks GROUP BY id),
fp AS (
  SELECT b.id, {_fold('sum(CASE WHEN b.x > m.med THEN (1::HUGEINT << b.b) ELSE 0::HUGEINT END)')} AS h
  FROM w16_blocks b JOIN w16_med m USING (id) GROUP BY b.id)"""

FP_GRID_PHASH32 = f"""
cells AS (SELECT id, k, g[k + 1] AS x FROM tiled, range(1024) t(k)),
basis AS (SELECT a.u, b.r, 2 * cos(pi() * a.u * (2 * b.r + 1) / 64.0) AS c FROM range(8) a(u), range(32) b(r)),
half AS (
  SELECT id, bu.u, k % 32 AS c, sum(x * bu.c) AS y
  FROM cells JOIN basis bu ON bu.r = k // 32 GROUP BY id, bu.u, k % 32),
coef AS (
  SELECT id, h.u * 8 + bv.u AS j, sum(h.y * bv.c) AS cf
  FROM half h JOIN basis bv ON bv.r = h.c GROUP BY id, h.u, bv.u),
coef_med AS (SELECT id, median(cf) AS med FROM coef GROUP BY id),
fp AS (
  SELECT c.id, {_fold('sum(CASE WHEN c.cf > m.med THEN (1::HUGEINT << c.j) ELSE 0::HUGEINT END)')} AS h
  FROM coef c JOIN coef_med m USING (id) GROUP BY c.id)"""

FP_GRID_AHASH = f"""
ah AS (SELECT id, g, list_reduce(g, lambda a, b: a + b) / len(g) AS mean FROM grid8),
fp AS (SELECT id, {_pack('g[i + 1] > mean')} AS h FROM ah)"""

FP_GRID_DHASH = f"""
g72 AS (SELECT id, list_transform(range(72), lambda k: g[k % 64 + 1]) AS g FROM grid8),
fp AS (SELECT id, {_pack('g[(i // 8) * 9 + i % 8 + 2] > g[(i // 8) * 9 + i % 8 + 1]')} AS h FROM g72)"""

FP_GRID_WHASH = f"""
wm AS (SELECT id, g, (list_sort(g)[32] + list_sort(g)[33]) / 2.0 AS med FROM grid8),
fp AS (SELECT id, {_pack('g[i + 1] > med')} AS h FROM wm)"""

FP_GRID_PHASH = f"""
cells AS (SELECT id, k, g[k + 1] AS x FROM grid8, range(64) t(k)),
basis AS (SELECT a.u, b.r, 2 * cos(pi() * a.u * (2 * b.r + 1) / 16.0) AS c FROM range(8) a(u), range(8) b(r)),
coef AS (
  SELECT id, bu.u * 8 + bv.u AS j, sum(x * bu.c * bv.c) AS cf
  FROM cells JOIN basis bu ON bu.r = k // 8 JOIN basis bv ON bv.r = k % 8
  GROUP BY id, bu.u, bv.u),
coef_med AS (SELECT id, median(cf) AS med FROM coef GROUP BY id),
fp AS (
  SELECT c.id, {_fold('sum(CASE WHEN c.cf > m.med THEN (1::HUGEINT << c.j) ELSE 0::HUGEINT END)')} AS h
  FROM coef c JOIN coef_med m USING (id) GROUP BY c.id)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip() for c in ctes) + "\n"


def pairs_sql(fp_cte: str, fp_name: str, t: int) -> str:
    return with_(fp_cte) + f"""
, hs AS (SELECT DISTINCT h FROM {fp_name})
SELECT a.h AS h_a, b.h AS h_b, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance
FROM hs a JOIN hs b ON a.h < b.h AND bit_count(xor(a.h, b.h)) <= {t}"""


def groups_sql(fp_cte: str, fp_name: str, t: int, key: str = "id") -> str:
    """G1 by a sequential walk: a recursive CTE carrying the list of seeds so far."""
    return with_(fp_cte) + f"""
, hs AS (SELECT h, min({key}) AS first_id, count(*) AS n_files FROM {fp_name} GROUP BY h),
ord AS (SELECT h, first_id, n_files, row_number() OVER (ORDER BY first_id, h) AS k FROM hs),
walk AS (
  WITH RECURSIVE w(k, seeds) AS (
    SELECT 0::BIGINT, []::BIGINT[]
    UNION ALL
    SELECT w.k + 1,
      CASE WHEN len(list_filter(w.seeds, lambda s: bit_count(xor(s, o.h)) <= {t})) > 0 THEN w.seeds
           ELSE list_append(w.seeds, o.h) END
    FROM w JOIN ord o ON o.k = w.k + 1)
  SELECT seeds FROM w ORDER BY k DESC LIMIT 1),
seeds AS (SELECT unnest(seeds) AS seed FROM walk),
balls AS (
  SELECT s.seed, o.h, CAST(bit_count(xor(s.seed, o.h)) AS INTEGER) AS distance, o.n_files
  FROM seeds s JOIN ord o ON bit_count(xor(s.seed, o.h)) <= {t}),
grp AS (
  SELECT b.seed, os.k FROM balls b JOIN ord os ON os.h = b.seed
  GROUP BY b.seed, os.k HAVING count(*) > 1 OR sum(b.n_files) > 1),
numbered AS (SELECT seed, row_number() OVER (ORDER BY k) AS group_no FROM grp)
SELECT n.group_no, b.seed AS seed_h, f.{key}, b.h, b.distance
FROM numbered n JOIN balls b ON b.seed = n.seed JOIN {fp_name} f ON f.h = b.h"""


def neighbours_sql(t: int) -> str:
    return with_(FP_EMBED) + f"""
, files AS (SELECT id, 'img/' || CAST(id AS VARCHAR) || '.png' AS path, h FROM fp_embed),
q AS (SELECT h AS qh, path AS qpath FROM files WHERE id = (SELECT min(id) FROM files)),
hits AS (
  SELECT f.id, f.path, CAST(bit_count(xor(f.h, q.qh)) AS INTEGER) AS distance
  FROM files f, q WHERE bit_count(xor(f.h, q.qh)) <= {t}
    AND regexp_extract(f.path, '([^/]*)$', 1) <> regexp_extract(q.qpath, '([^/]*)$', 1))
SELECT id, path, distance, row_number() OVER (ORDER BY distance, path) AS rank FROM hits"""


def _weights_sql(name: str, n_in: int, n_out: int) -> str:
    """Fixed-point weights (o, i, w) of a windowed sinc of three lobes from n_in to n_out cells."""
    scale = f"({n_in}.0 / {n_out})"
    wide = f"greatest({scale}, 1.0)"
    return f"""
{name}_raw AS (
  SELECT o, i, CASE WHEN x = 0 THEN 1.0 ELSE sin(pi() * x) / (pi() * x) * sin(pi() * x / 3) / (pi() * x / 3) END AS w
  FROM (SELECT o, i, (i - (o + 0.5) * {scale} + 0.5) / {wide} AS x,
          greatest(trunc((o + 0.5) * {scale} - 3 * {wide} + 0.5), 0) AS lo,
          least(trunc((o + 0.5) * {scale} + 3 * {wide} + 0.5), {n_in}) AS hi
        FROM range({n_out}) a(o), range({n_in}) b(i))
  WHERE i >= lo AND i < hi AND x >= -3 AND x < 3),
{name} AS (
  SELECT o, i, CAST(trunc(s + CASE WHEN s < 0 THEN -0.5 ELSE 0.5 END) AS BIGINT) AS w
  FROM (SELECT o, i, w / sum(w) OVER (PARTITION BY o) * 4194304 AS s FROM {name}_raw))"""


def resample_sql(w: int, h: int, outs: dict[str, tuple[int, int]]) -> str:
    """Pictures of w x h bytes resampled along the rows, then the columns, to each size of ``outs``."""
    clip = "CAST(greatest(0, least(255, (sum(p.v * k.w) + 2097152) >> 22)) AS BIGINT)"
    ctes = [f"""
px AS (
  SELECT id, k // {w} AS r, k % {w} AS c,
    CAST(((CAST(floor(g[((k // {w}) * 5 + (k % {w}) * 3 + (k // {w}) * (k % {w})) % 64 + 1] * 1000) AS BIGINT) % 256) + 256) % 256 AS BIGINT) AS v
  FROM grid8, range({w * h}) t(k))"""]
    for name, (gw, gh) in outs.items():
        ctes.append(_weights_sql(f"{name}_kx", w, gw))
        ctes.append(f"""
{name}_x AS (SELECT p.id, p.r, k.o AS c, {clip} AS v FROM px p JOIN {name}_kx k ON k.i = p.c GROUP BY p.id, p.r, k.o)""")
        last = f"{name}_x"
        if gh != h:
            ctes.append(_weights_sql(f"{name}_ky", h, gh))
            ctes.append(f"""
{name}_y AS (SELECT p.id, k.o AS r, p.c, {clip} AS v FROM {last} p JOIN {name}_ky k ON k.i = p.r GROUP BY p.id, k.o, p.c)""")
            last = f"{name}_y"
        ctes.append(f"""
{name}_s AS (SELECT id, string_agg(CAST(v AS VARCHAR), ' ' ORDER BY r, c) AS {name} FROM {last} GROUP BY id)""")
    first, *rest = outs
    joins = " ".join(f"JOIN {n}_s USING (id)" for n in rest)
    return with_(GRID8, *ctes) + f"\nSELECT id, {', '.join(outs)} FROM {first}_s {joins}"


def closest_batch_sql(fp: str, table: str, t: int) -> str:
    """The 10 closest ids farther than ``t`` from every id divisible by 20."""
    return with_(fp) + f"""
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM (
    SELECT q.id AS query_id, f.id, CAST(bit_count(xor(q.h, f.h)) AS INTEGER) AS distance
    FROM {table} q, {table} f WHERE q.id % 20 = 0)
  WHERE distance > {t})
WHERE rank <= 10"""


def closest_sql(t: int, k: int = 10) -> str:
    return with_(FP_EMBED) + f"""
, files AS (SELECT id, 'img/' || CAST(id AS VARCHAR) || '.png' AS path, h FROM fp_embed),
q AS (SELECT h AS qh, path AS qpath FROM files WHERE id = (SELECT min(id) FROM files))
SELECT f.id, f.path, CAST(bit_count(xor(f.h, q.qh)) AS INTEGER) AS distance
FROM files f, q WHERE bit_count(xor(f.h, q.qh)) > {t} AND f.path <> q.qpath
ORDER BY distance, path LIMIT {k}"""


def oracle_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    q["fp_embed_median"] = with_(FP_EMBED) + "SELECT id, h FROM fp_embed"
    q["fp_docs_simhash"] = with_(FP_DOCS) + "SELECT id, h FROM fp_docs"
    for name, cte in (
        ("ahash", FP_GRID_AHASH),
        ("dhash", FP_GRID_DHASH),
        ("whash", FP_GRID_WHASH),
        ("phash", FP_GRID_PHASH),
    ):
        q[f"fp_grid_{name}"] = with_(GRID8, cte) + "SELECT id, h FROM fp"
    q["fp_grid16_whash"] = with_(GRID8, grid_tiled(16), FP_GRID_WHASH16) + "SELECT id, h FROM fp"
    q["fp_grid32_phash"] = with_(GRID8, grid_tiled(32), FP_GRID_PHASH32) + "SELECT id, h FROM fp"
    q["hash_hex_roundtrip"] = with_(FP_EMBED) + f"""
SELECT id, h, lpad(lower(hex(h)), 16, '0') AS h_hex,
       {_fold("CAST(CAST('0x' || lpad(lower(hex(h)), 16, '0') AS UBIGINT) AS HUGEINT)")} AS h_back
FROM fp_embed"""
    for t in (18, 20, 22):
        q[f"hamming_pairs_embed_t{t}"] = pairs_sql(FP_EMBED, "fp_embed", t)
    for t in (3, 5, 8):
        q[f"hamming_pairs_docs_t{t}"] = pairs_sql(FP_DOCS, "fp_docs", t)
    q["hamming_pairs_blank_docs_t5"] = pairs_sql(FP_DOCS + "," + FP_BLANK, "fp_blank", 5)
    q["neighbours_embed_t20"] = neighbours_sql(20)
    q["closest_non_duplicates_embed_t20"] = closest_sql(20)
    q["hamming_pairs_docs_delta_t5"] = pairs_sql(
        FP_DOCS + ",\nfp_now AS (SELECT * FROM fp_docs WHERE id % 7 <> 3)", "fp_now", 5
    )
    q["resample_embed"] = resample_sql(24, 20, {"small": (9, 8), "large": (31, 20)})
    q["closest10_docs"] = closest_batch_sql(FP_DOCS, "fp_docs", 5)
    q["closest10_embed"] = closest_batch_sql(FP_EMBED, "fp_embed", 20)
    q["hash_stats_docs"] = with_(FP_DOCS) + """
SELECT count(*) AS n_files, count(DISTINCT h) AS n_hashes FROM fp_docs"""
    q["exact_duplicates_docs"] = with_(FP_DOCS) + """
SELECT h, count(*) AS n_files, min(id) AS first_id FROM fp_docs GROUP BY h HAVING count(*) > 1"""
    for t in (5, 8):
        q[f"dup_groups_docs_t{t}"] = groups_sql(FP_DOCS, "fp_docs", t)
    for t in (18, 20, 22):
        q[f"dup_groups_embed_t{t}"] = groups_sql(FP_EMBED, "fp_embed", t)
    q["group_sizes_docs_t5"] = (
        "SELECT group_no, count(*) AS n_files, count(DISTINCT h) AS n_hashes FROM ("
        + groups_sql(FP_DOCS, "fp_docs", 5)
        + ") GROUP BY group_no"
    )
    q["pair_labels_embed_t22"] = f"""
SELECT *, CASE WHEN distance = 0 THEN 'exact' WHEN distance BETWEEN 1 AND 5 THEN 'very similar'
  WHEN distance BETWEEN 6 AND 10 THEN 'similar' WHEN distance BETWEEN 11 AND 15 THEN 'recognisable'
  WHEN distance BETWEEN 16 AND 64 THEN 'different' END AS label
FROM ({pairs_sql(FP_EMBED, "fp_embed", 22)})"""
    q.update(organise_oracles())
    q.update(plan_oracles())
    return q


# ---------------------------------------------------------------- organise plan

_SPLIT_RE = r"^(\.*[^.].*)(\.[^.]*)$"
_IMAGE_RE = r"\.(png|jpg|jpeg|gif|bmp|heic|heif|webp|tiff)$"
# The date patterns of names and EXIF strings.
_EXIF_RE = r"^(\d{4}):(\d{1,2}):(\d{1,2})\s+(\d{1,2}):(\d{1,2}):(\d{1,2})$"
_NAME_RES = [
    r"(\d{4})[_\-\.](\d{2})[_\-\.](\d{2})[_\-\s](\d{2}):(\d{2}):(\d{2})",
    r"(\d{4})[_\-\.](\d{2})[_\-\.](\d{2})[_\-](\d{2})[_\-](\d{2})[_\-](\d{2})",
    r"(\d{4})[_\-\.](\d{2})[_\-\.](\d{2})",
    r"(\d{4})(\d{2})(\d{2})[_\-]?(\d{2})[_\-]?(\d{2})[_\-]?(\d{2})",
    r"(\d{4})(\d{2})(\d{2})",
    r"(\d{2})[_\-\.](\d{2})[_\-\.](\d{4})[_\-\s](\d{2}):(\d{2}):(\d{2})",
]


def _base(x: str) -> str:
    return f"(CASE WHEN regexp_matches({x}, '{_SPLIT_RE}') THEN regexp_extract({x}, '{_SPLIT_RE}', 1) ELSE {x} END)"


def _ext(x: str) -> str:
    return f"(CASE WHEN regexp_matches({x}, '{_SPLIT_RE}') THEN regexp_extract({x}, '{_SPLIT_RE}', 2) ELSE '' END)"


def _counter(x: str, n: str) -> str:
    return f"(CASE WHEN {n} = 0 THEN {x} ELSE {_base(x)} || printf('_%03d', {n}) || {_ext(x)} END)"


def _mk_ts(y, mo, d, h, mi, s) -> str:
    return (
        f"(CASE WHEN ({y}) >= 1 AND ({s}) <= 59 THEN "
        f"try(make_timestamp(({y})::BIGINT, ({mo})::BIGINT, ({d})::BIGINT, ({h})::BIGINT, ({mi})::BIGINT, ({s})::DOUBLE)) END)"
    )


def _grp(x: str, pat: str, k: int) -> str:
    return f"TRY_CAST(regexp_extract({x}, '{pat}', {k}) AS INTEGER)"


def _exif_time_sql() -> str:
    s = "COALESCE(NULLIF(exif_original, ''), exif_datetime)"
    g = [_grp(s, _EXIF_RE, k) for k in range(1, 7)]
    return f"(CASE WHEN regexp_matches({s}, '{_EXIF_RE}') THEN {_mk_ts(*g)} END)"


def _name_time_sql(stem: str) -> str:
    parts = []
    for pat in _NAME_RES:
        n = pat.count("(")
        g = [_grp(stem, pat, k) for k in range(1, n + 1)]
        if n == 3:
            ts = f"(CASE WHEN {g[0]} > 31 THEN {_mk_ts(g[0], g[1], g[2], '12', '0', '0')} END)"
        else:
            ts = f"(CASE WHEN {g[0]} > 31 THEN {_mk_ts(*g)} ELSE {_mk_ts(g[2], g[1], g[0], g[3], g[4], g[5])} END)"
        parts.append(f"(CASE WHEN regexp_matches({stem}, '{pat}') THEN {ts} END)")
    return "COALESCE(" + ", ".join(parts) + ")"


def human_size_sql(x: str) -> str:
    x = f"({x})"
    return (
        f"(CASE WHEN {x} IS NULL THEN 'unknown' WHEN {x} < 1024 THEN CAST({x} AS VARCHAR) || ' B' "
        f"WHEN {x} < 1048576 THEN printf('%.1f KB', {x} / 1024.0) ELSE printf('%.1f MB', {x} / 1048576.0) END)"
    )


def organise_sql(
    rename: bool,
    convert: bool,
    target_format: str = "jpg",
    date_format: str = "%Y%m%d_%H%M%S",
    short_side: int | None = None,
    long_side: int | None = None,
    dry_run: bool = False,
) -> str:
    conv = bool(convert or short_side or long_side)
    fmt = target_format.lower()
    if rename:
        new_ext = f"'.{fmt}'" if conv else "ext"
        t0 = f"strftime(capture_time, '{date_format}') || {new_ext}"
    else:
        t0 = f"base || '.{fmt}'" if conv else "name"
    side = short_side or long_side
    if side:
        aspect = "(CAST(w AS DOUBLE) / CAST(h AS DOUBLE))"
        width_key = "(w < h)" if short_side else "(w > h)"
        kw = f"({width_key} AND w > {side})"
        kh = f"(NOT {width_key} AND h > {side})"
        nw = f"(CASE WHEN {kw} THEN {side} WHEN {kh} THEN CAST(trunc({side} * {aspect}) AS INTEGER) ELSE w END)"
        nh = f"(CASE WHEN {kw} THEN CAST(trunc({side} / {aspect}) AS INTEGER) WHEN {kh} THEN {side} ELSE h END)"
    else:
        nw, nh = "w", "h"
    src_fmt = f"lower(regexp_replace(ext, '^\\.', ''))"
    fmt_same = f"({src_fmt} IN ('jpg', 'jpeg'))" if fmt in ("jpg", "jpeg") else f"({src_fmt} = '{fmt}')"
    dims_same = f"({nw} = w AND {nh} = h)"
    keep = (
        f"({fmt_same} AND {dims_same} AND original_size > 0 AND "
        f"CAST(original_size - enc AS DOUBLE) / CAST(original_size AS DOUBLE) < 0.10)"
    )
    decodable = "(w IS NOT NULL AND w > 0 AND h IS NOT NULL AND h > 0)"
    unchanged = "(t1 = name)" if not conv else "FALSE"
    if dry_run:
        status = f"CASE WHEN t1 IS NULL THEN 'ERROR' WHEN {unchanged} THEN 'NO_CHANGE' ELSE 'DRY_RUN' END"
    elif conv:
        status = f"CASE WHEN t1 IS NULL OR NOT {decodable} OR {nw} < 1 OR {nh} < 1 THEN 'ERROR' WHEN {keep} THEN 'COPIED' ELSE 'CONVERTED' END"
    else:
        status = f"CASE WHEN t1 IS NULL THEN 'ERROR' WHEN {unchanged} THEN 'NO_CHANGE' ELSE 'RENAMED' END"
    conv_lit = "TRUE" if conv else "FALSE"
    sized = f"(status IN ('CONVERTED', 'COPIED') OR (status = 'DRY_RUN' AND {conv_lit} AND {decodable}))"
    ctes = [
        MEDIA_FILES,
        EXISTING_NAMES,
        f"""files AS (SELECT *, {_base('name')} AS base, {_ext('name')} AS ext FROM media
                 WHERE regexp_matches(lower(name), '{_IMAGE_RE}'))""",
        f"""ct AS (SELECT *, {_exif_time_sql()} AS ex_t, {_name_time_sql('base')} AS nm_t FROM files)""",
        f"""ct2 AS (SELECT *, COALESCE(ex_t, nm_t, mtime) AS capture_time,
                 CASE WHEN ex_t IS NOT NULL THEN 'exif' WHEN nm_t IS NOT NULL THEN 'name'
                      WHEN mtime IS NOT NULL THEN 'mtime' END AS time_source FROM ct)""",
        f"""p0 AS (SELECT event_id, name, base, ext, size_bytes AS original_size, CAST(width AS INTEGER) AS w,
                 CAST(height AS INTEGER) AS h, encoded_size AS enc, capture_time, time_source, {t0} AS t0 FROM ct2)""",
        f"""p1 AS (SELECT *, {_counter('t0', 'c')} AS t1 FROM (
                 SELECT *, CASE WHEN t0 IS NOT NULL THEN
                   row_number() OVER (PARTITION BY t0 ORDER BY name, event_id) - 1 END AS c FROM p0))""",
        f"""p2 AS (SELECT *, {status} AS status FROM p1)""",
        f"""p3 AS (SELECT *,
                 CASE WHEN {sized} THEN w ELSE 0 END AS orig_w,
                 CASE WHEN {sized} THEN h ELSE 0 END AS orig_h,
                 CASE WHEN status = 'COPIED' THEN w WHEN {sized} THEN {nw} ELSE 0 END AS new_w,
                 CASE WHEN status = 'COPIED' THEN h WHEN {sized} THEN {nh} ELSE 0 END AS new_h,
                 CASE WHEN status = 'CONVERTED' THEN enc WHEN status = 'DRY_RUN' AND {sized} THEN enc
                      ELSE original_size END AS new_size FROM p2)""",
    ]
    if dry_run:
        ctes.append("p4 AS (SELECT *, COALESCE(t1, name) AS new_filename FROM p3)")
    else:
        taken = "SELECT name FROM existing_names" + ("" if conv else " UNION SELECT name FROM media")
        sb, se = _base("r"), _ext("r")
        slot_re = r"^(.*)_([0-9]{3,18})$"
        ctes += [
            f"taken AS ({taken})",
            "claims AS (SELECT event_id AS key, t1 AS target, name FROM p3 WHERE status IN ('RENAMED', 'CONVERTED', 'COPIED'))",
            "ck AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY name, key) - 1 AS k FROM claims)",
            "reserved AS (SELECT name AS r FROM taken UNION SELECT target FROM claims)",
            f"""slot0 AS (SELECT r, {sb} AS rb, {se} AS re FROM reserved)""",
            f"""slot1 AS (SELECT regexp_extract(rb, '{slot_re}', 1) || re AS target,
                   TRY_CAST(regexp_extract(rb, '{slot_re}', 2) AS BIGINT) AS j, regexp_extract(rb, '{slot_re}', 2) AS digits
                   FROM slot0 WHERE regexp_matches(rb, '{slot_re}'))""",
            """excl AS (SELECT DISTINCT target, j FROM (
                   SELECT target, j FROM slot1 WHERE j IS NOT NULL AND j >= 1 AND printf('%03d', j) = digits
                   UNION ALL SELECT name, 0 FROM taken)
                 WHERE target IN (SELECT target FROM claims))""",
            "exn AS (SELECT target, j, j - (row_number() OVER (PARTITION BY target ORDER BY j) - 1) AS pos FROM excl)",
            """merged AS (SELECT target, k AS pos, 1 AS typ, CAST(NULL AS BIGINT) AS j, key FROM ck
                 UNION ALL SELECT target, pos, 0, j, CAST(NULL AS BIGINT) FROM exn)""",
            f"""fin AS (SELECT key, {_counter('target', 'rn - 1')} AS final_name FROM (
                 SELECT *, row_number() OVER (PARTITION BY target ORDER BY pos, typ, j, key) AS rn FROM merged)
                 WHERE typ = 1)""",
            """p4 AS (SELECT p3.*, CASE WHEN status IN ('RENAMED', 'CONVERTED', 'COPIED') THEN fin.final_name
                        ELSE COALESCE(t1, name) END AS new_filename
                 FROM p3 LEFT JOIN fin ON fin.key = p3.event_id)""",
        ]
    body = f"""
SELECT event_id, name AS filename, new_filename, status, original_size, new_size, orig_w, orig_h, new_w, new_h,
  {'capture_time' if rename else 'CAST(NULL AS TIMESTAMP)'} AS capture_time,
  {'time_source' if rename else 'CAST(NULL AS VARCHAR)'} AS time_source,
  {human_size_sql('original_size')} AS original_size_str, {human_size_sql('new_size')} AS new_size_str,
  CASE WHEN orig_w <> new_w OR orig_h <> new_h THEN printf('%dx%d -> %dx%d', orig_w, orig_h, new_w, new_h) END AS dims_note
FROM p4"""
    return with_(*ctes) + body


def status_histogram_sql(plan_sql: str) -> str:
    # The order of statuses in the listing.
    return f"""
SELECT status, count(*) AS n,
  CAST(list_position(['RENAMED', 'CONVERTED', 'COPIED', 'DRY_RUN', 'NO_CHANGE', 'ERROR', 'ERROR_EXISTS'], status) AS INTEGER) AS ord
FROM ({plan_sql}) GROUP BY status"""


def size_totals_sql(plan_sql: str) -> str:
    listed = "status IN ('RENAMED', 'CONVERTED', 'COPIED', 'DRY_RUN')"
    sized = f"{listed} AND original_size IS NOT NULL AND new_size IS NOT NULL"
    return f"""
WITH t AS (
  SELECT CAST(COALESCE(sum(CASE WHEN {sized} THEN original_size END), 0) AS BIGINT) AS total_original,
         CAST(COALESCE(sum(CASE WHEN {sized} THEN new_size END), 0) AS BIGINT) AS total_new,
         CAST(count_if({listed} AND (original_size IS NULL OR new_size IS NULL)) AS BIGINT) AS n_unknown
  FROM ({plan_sql}))
SELECT total_original, total_new, total_original - total_new AS saved_bytes,
  CASE WHEN total_original > 0 AND total_original - total_new <> 0
       THEN round(CAST(total_original - total_new AS DOUBLE) / CAST(total_original AS DOUBLE) * 100.0, 4) END AS saved_pct,
  {human_size_sql('total_original')} AS total_original_str, {human_size_sql('total_new')} AS total_new_str,
  {human_size_sql('total_original - total_new')} AS saved_str, n_unknown
FROM t"""


ORGANISE_CASES = {
    "organise_rename_inplace": dict(rename=True, convert=False),
    "organise_dry_run_rename": dict(rename=True, convert=False, dry_run=True),
    "organise_convert_jpg_rename": dict(rename=True, convert=True, target_format="jpg", date_format="%Y-%m-%d_%H-%M"),
    "organise_long_side_keep_names": dict(rename=False, convert=False, long_side=1600, target_format="png"),
    "organise_short_side_dry_run": dict(rename=True, convert=True, short_side=1000, dry_run=True),
}


def organise_oracles() -> dict[str, str]:
    q = {name: organise_sql(**kw) for name, kw in ORGANISE_CASES.items()}
    q["capture_time_media"] = with_(
        MEDIA_FILES,
        f"""sp AS (SELECT *, {_base('name')} AS base FROM media)""",
        f"""ct AS (SELECT event_id, name, {_exif_time_sql()} AS exif_time, {_name_time_sql('base')} AS name_time, mtime FROM sp)""",
    ) + """
SELECT event_id, name, exif_time, name_time, COALESCE(exif_time, name_time, mtime) AS capture_time,
  CASE WHEN exif_time IS NOT NULL THEN 'exif' WHEN name_time IS NOT NULL THEN 'name'
       WHEN mtime IS NOT NULL THEN 'mtime' END AS time_source
FROM ct"""
    q["listing_media"] = with_(MEDIA_FILES) + f"""
SELECT event_id, path, name, {_base('name')} AS base, {_ext('name')} AS ext,
  regexp_matches(lower(name), '{_IMAGE_RE}') AS is_image
FROM media"""
    for name in ("organise_rename_inplace", "organise_convert_jpg_rename"):
        q[f"status_histogram_{name.removeprefix('organise_')}"] = status_histogram_sql(q[name])
        q[f"size_totals_{name.removeprefix('organise_')}"] = size_totals_sql(q[name])
    return q


# ---------------------------------------------------------------- index, rename, undo

EMBED_FILES = """
efiles AS (
  SELECT vec_id AS id,
    CASE WHEN vec_id % 13 = 0 THEN 'other/' || CAST(vec_id AS VARCHAR) || '.png'
         WHEN vec_id % 11 = 0 THEN 'img/group-09-' || CAST(vec_id AS VARCHAR) || '.png'
         ELSE 'img/' || CAST(vec_id AS VARCHAR) || '.png' END AS path
  FROM embeddings),
dirnames AS (
  SELECT DISTINCT name FROM (
    SELECT regexp_extract(path, '([^/]*)$', 1) AS name FROM efiles WHERE starts_with(path, 'img/')
    UNION ALL
    SELECT 'group-0' || CAST(id % 9 + 1 AS VARCHAR) || '-' || CAST(id AS VARCHAR) || '.png' FROM efiles WHERE id % 7 = 0))"""


DOCUMENT_FILES = """
dfiles AS (
  SELECT doc_id AS id,
    CASE WHEN doc_id % 12 = 0 THEN 'old/' ELSE 'doc/' END || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.jpg' AS path
  FROM documents),
dirnames AS (
  SELECT DISTINCT name FROM (
    SELECT regexp_extract(path, '([^/]*)$', 1) AS name FROM dfiles WHERE starts_with(path, 'doc/')
    UNION ALL
    SELECT 'group-01-' || regexp_extract(path, '([^/]*)$', 1) FROM dfiles WHERE starts_with(path, 'doc/') AND id % 5 = 0))"""


def rename_plan_docs_sql(t: int) -> str:
    fp = FP_DOCS + "," + DOCUMENT_FILES + """,
fp_paths AS (SELECT e.path, f.h FROM dfiles e JOIN fp_docs f USING (id))"""
    return _rename_sql(groups_sql(fp, "fp_paths", t, key="path"), DOCUMENT_FILES, "doc")


def rename_plan_sql(t: int) -> str:
    fp = FP_EMBED + "," + EMBED_FILES + """,
fp_paths AS (SELECT e.path, f.h FROM efiles e JOIN fp_embed f USING (id))"""
    return _rename_sql(groups_sql(fp, "fp_paths", t, key="path"), EMBED_FILES, "img")


def _rename_sql(groups: str, files: str, folder: str) -> str:
    return f"""
WITH groups AS ({groups}),
{files.strip()},
g AS (SELECT DISTINCT group_no, path FROM groups),
g1 AS (SELECT group_no, path, regexp_extract(path, '([^/]*)$', 1) AS name,
         regexp_replace(regexp_extract(path, '^(.*)/[^/]*$', 1), '/+$', '') AS dir FROM g),
g2 AS (SELECT *, printf('group-%02d-', group_no) || name AS new_name FROM g1),
g3 AS (SELECT g2.*, t.name IS NOT NULL AS taken FROM g2 LEFT JOIN dirnames t ON t.name = g2.new_name),
w AS (SELECT path, min(group_no) AS winner FROM g3
      WHERE dir = '{folder}' AND NOT starts_with(name, 'group-') AND NOT taken GROUP BY path)
SELECT group_no, g3.path, name, new_name,
  CASE WHEN dir <> '{folder}' THEN 'skipped_elsewhere' WHEN starts_with(name, 'group-') THEN 'skipped_prefixed'
       WHEN taken THEN 'conflict' WHEN group_no <> winner THEN 'error' ELSE 'renamed' END AS outcome
FROM g3 LEFT JOIN w USING (path)"""


UNDO_SQL = with_(MEDIA_FILES) + r""",
lst AS (
  SELECT event_id,
    CASE WHEN event_id % 5 = 0 THEN 'group-' || lpad(CAST(event_id % 23 AS VARCHAR), 2, '0') || '-' || name
         WHEN event_id % 5 = 1 THEN 'group-x-' || name ELSE name END AS name
  FROM media),
cand AS (
  SELECT event_id, name,
    CASE WHEN regexp_matches(name, '^group-\d+-(.+)$') THEN regexp_extract(name, '^group-\d+-(.+)$', 1) END AS new_name
  FROM lst WHERE starts_with(name, 'group-')),
c2 AS (SELECT cand.*, t.name IS NOT NULL AS taken FROM cand LEFT JOIN (SELECT DISTINCT name FROM lst) t ON t.name = cand.new_name),
rk AS (SELECT event_id, row_number() OVER (PARTITION BY new_name ORDER BY name, event_id) AS rnk
       FROM c2 WHERE new_name IS NOT NULL AND NOT taken)
SELECT c2.event_id, name, new_name,
  CASE WHEN new_name IS NULL THEN 'error' WHEN taken THEN 'conflict' WHEN rnk > 1 THEN 'conflict' ELSE 'renamed' END AS outcome
FROM c2 LEFT JOIN rk USING (event_id)"""


INDEX_CHANGES_SQL = with_(MEDIA_FILES, MEDIA_PRIOR) + """
SELECT COALESCE(c.path, o.path) AS path, c.mtime, o.mtime AS old_mtime,
  CASE WHEN o.path IS NULL THEN 'new' WHEN c.path IS NULL THEN 'deleted'
       WHEN c.mtime IS NOT DISTINCT FROM o.mtime THEN 'unchanged' ELSE 'changed' END AS action
FROM (SELECT DISTINCT ON (path) path, mtime FROM media) c
FULL OUTER JOIN (SELECT DISTINCT ON (path) path, mtime FROM media_prior) o ON c.path = o.path"""


INDEX_UPSERT_SQL = f"""
WITH {INDEX_CHANGES_SQL.split("SELECT COALESCE(c.path")[0].strip().removeprefix("WITH ")},
now AS (SELECT path, mtime, CASE WHEN event_id % 10 <> 0 THEN event_id * 7 END AS h, event_id % 10 <> 0 AS ok FROM media),
same AS (
  SELECT p.path, p.mtime, CAST(p.event_id * 3 AS BIGINT) AS h FROM media_prior p
  WHERE EXISTS (SELECT 1 FROM media m WHERE m.path = p.path AND m.mtime IS NOT DISTINCT FROM p.mtime))
SELECT path, mtime, h FROM same
UNION ALL
SELECT path, mtime, CAST(h AS BIGINT) AS h FROM now WHERE ok AND path NOT IN (SELECT path FROM same)"""

INDEX_FAILED_SQL = f"""
WITH {INDEX_CHANGES_SQL.split("SELECT COALESCE(c.path")[0].strip().removeprefix("WITH ")}
SELECT CAST(count(*) AS BIGINT) AS n_failed FROM media m
WHERE event_id % 10 = 0
  AND NOT EXISTS (SELECT 1 FROM media_prior p WHERE p.path = m.path AND p.mtime IS NOT DISTINCT FROM m.mtime)"""


def plan_oracles() -> dict[str, str]:
    q = {
        "index_changes_media": INDEX_CHANGES_SQL,
        "index_run_counts_media": f"""
SELECT {", ".join(f"CAST(count_if(action = '{a}') AS BIGINT) AS n_{a}" for a in ("new", "changed", "unchanged", "deleted"))}
FROM ({INDEX_CHANGES_SQL})""",
        "rename_plan_embed_t20": rename_plan_sql(20),
        "rename_plan_docs_t5": rename_plan_docs_sql(5),
        "index_upsert_media": INDEX_UPSERT_SQL,
        "index_failed_media": INDEX_FAILED_SQL,
        "undo_plan_media": UNDO_SQL,
    }
    q["rename_counts_embed_t20"] = f"SELECT outcome, count(*) AS n FROM ({q['rename_plan_embed_t20']}) GROUP BY outcome"
    q["undo_counts_media"] = f"SELECT outcome, count(*) AS n FROM ({UNDO_SQL}) GROUP BY outcome"
    return q
