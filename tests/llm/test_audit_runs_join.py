"""Periodic runs, the filter audit and the Jaccard join against brute-force versions."""

import random
import zlib
from collections import Counter
from hashlib import sha256
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from imprint.llm import filter_audit, jaccard_join, runs
from imprint.llm.queries import oracle_queries, registry

# ---------------------------------------------------------------- 11


def plain_runs(c, least=12):
    """Every lag, every stretch."""
    n, out = len(c), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if c[i] != c[i + q]:
                i += 1
                continue
            s = i
            while i < n - q and c[i] == c[i + q]:
                i += 1
            if i + q - s >= max(least, 2 * q):
                out.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def test_runs_equal_every_lag():
    rng = random.Random(5)
    for _ in range(1500):
        n, letters = rng.randint(0, 110), rng.randint(1, 4)
        c = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            if n > 4:
                s, p = rng.randrange(n), rng.randint(1, max(1, n // 3))
                for i in range(s + p, rng.randint(s, n)):
                    c[i] = c[i - p]
        assert runs.find_runs(np.array(c, np.int64)) == plain_runs(c)


def test_runs_of_long_texts():
    assert runs.find_runs(np.arange(300_000) % 3) == [(0, 300_000, 3)]
    assert runs.find_runs(np.arange(300_000)) == []
    assert runs.find_runs(np.zeros(50_000, np.int64)) == [(0, 50_000, 1)]


def test_runs_query_rows(spark):
    every_tenth = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    plain = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10)
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(every_tenth, text), (plain, text), (plain, "a b " * 9), (None, text), (7, None), (8, ""), (plain, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash"))
    got = runs.periodic_runs(df).collect()
    assert len(got) == len(rows)
    none = sha256(b"").hexdigest()
    for (i, t), r in zip(sorted(rows, key=str), sorted(got, key=lambda r: str((r["doc_id"], r["length"])))):
        assert r["doc_id"] in [i for i, _ in rows]
    by = {(r["doc_id"], r["n_runs"]): r for r in got}
    g = zlib.crc32(str(every_tenth).encode()) // 10
    a = g % 40
    p = 1 + (40 - a) // (3 + g % 8)
    tail = 40 - a
    r = next(r for r in got if r["doc_id"] == every_tenth)
    if tail >= max(12, 2 * p):
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (1, a, tail, p)
        assert r["collapsed_sha256"] == sha256(" ".join(f"w{i}" for i in range(a + p)).encode()).hexdigest()
    ab = by[plain, 1]
    assert (ab["start"], ab["length"], ab["period"], ab["exponent_milli"]) == (0, 18, 2, 9000)
    assert ab["runs_sha256"] == sha256(b"0,18,2\n").hexdigest() and ab["collapsed_sha256"] == sha256(b"a b").hexdigest()
    empty = by[7, 0]
    assert (empty["start"], empty["exponent_milli"]) == (None, None) and empty["runs_sha256"] == none
    assert by[None, 0]["collapsed_sha256"] == sha256(text.encode()).hexdigest()
    assert runs.periodic_runs(df.limit(0)).count() == 0


def test_runs_query_equals_every_lag_on_table(spark, sf_dir):
    got = {r["doc_id"]: r for r in registry()["op11_periodic_runs"](spark, sf_dir).collect()}
    docs = spark.read.parquet(sf_dir + "/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    found = 0
    for i, text in docs:
        words = runs.rewritten((text or "").encode().split(), i)
        if len(words) > 700:  # every lag of a long text takes long
            continue
        want = plain_runs(words)
        found += len(want)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in want).encode()
        assert got[i]["runs_sha256"] == sha256(listed).hexdigest() and got[i]["n_runs"] == len(want)
        drop = {x for s, n, q in want for x in range(s + q, s + n)}
        kept = b" ".join(w for x, w in enumerate(words) if x not in drop)
        assert got[i]["collapsed_sha256"] == sha256(kept).hexdigest()
    assert found > 5


# ---------------------------------------------------------------- 12


def plain_audit(docs, labels):
    """Every document through every order, one by one."""
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    rows = []
    for i, t, s in docs:
        t = t or ""
        w = t.encode().split()
        caps = sum("A" <= c <= "Z" for c in t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * caps > 2 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > least[t],
        }
        rows.append((s or "", {f for f, x in fails.items() if x}, i is not None and i in good, i is not None and i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == {f} for r in mine),
                    sum(r[2] for r in gone), sum(r[3] for r in gone),
                ]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_equals_one_by_one(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma#", "Delta", "EPSILON", "zeta$", "é", "eta"]
    docs = [(rng.choice([None, *range(40)]), rng.choice([None, "", " ".join(rng.choices(words, k=rng.choice([3, 150, 260]))),
             "same text here", " ".join(f"u{x}" for x in range(230))]), rng.choice([None, "", "s1", "s2"])) for _ in range(120)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in [*range(30), 3, 4, 5, None]]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("mask", F.lit("clash"))
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit(1))
    got = filter_audit.filter_audit(df, said).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == plain_audit(docs, labels)
    assert len(got) == 600 * len({s or "" for _, _, s in docs})
    assert filter_audit.filter_audit(df.limit(0), said).count() == 0


def test_audit_query_equals_its_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = registry()["op12_filter_audit"](spark, sf_dir)
    rel = con.sql(oracle_queries()["op12_filter_audit"])
    assert df.columns == rel.columns
    assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall())


# ---------------------------------------------------------------- 13


def plain_join(rows, percent=80):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    has, up = {}, list(range(len(rows)))

    def find(a):
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    for k, s in enumerate(sets):
        shared = Counter(o for g in s for o in has.get(g, ()))
        for o, x in shared.items():
            if 100 * x >= percent * (len(s) + len(sets[o]) - x):
                a, b = find(k), find(o)
                up[max(a, b)] = min(a, b)
        for g in s:
            has.setdefault(g, []).append(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=str)


def varied(rng, base, edits):
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"v{rng.randrange(10**6)}"
    return " ".join(out)


def copies(seed):
    """Groups of near copies of several sizes, a passage that half of the texts share, and odd rows."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(60)]
    rows, i = [], 0
    for size, edits in ((120, 3), (60, 6), (40, 12), (5, 1), (2, 0)):
        base = [word() for _ in range(150)]
        for _ in range(size):
            rows.append((i := i + 1, varied(rng, base, rng.randint(0, edits))))
    for _ in range(150):
        own = [word() for _ in range(rng.choice([8, 20, 80, 300]))]
        rows.append((i := i + 1, " ".join(own[:5] + passage + own[5:])))
    for _ in range(100):
        rows.append((i := i + 1, " ".join(word() for _ in range(rng.choice([1, 2, 4, 5, 6, 9, 200])))))
    rows += [(None, rows[0][1]), (None, "only here once"), (3, "another text of the id three again"), (5, None), (6, ""), (7, " \n")]
    rows += [(i + 1, "A B C"), (i + 2, "a b\tc"), (i + 3, "a b c d e"), (i + 4, "a b c d e f"), rows[10], rows[10]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("leaf", [4096, 64, 10])
def test_join_equals_all_pairs(spark, leaf):
    rows = copies(leaf)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("node", F.lit("clash"))
    got = jaccard_join.jaccard_components(df, leaf=leaf)
    assert sorted(map(tuple, got.collect()), key=str) == plain_join(rows)


def test_join_blocks_and_cells(spark, monkeypatch):
    """The last resort, and cells of large regions, give what one group gives."""
    rows = copies(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "LEAF_DOCS", 16)
    monkeypatch.setattr(jaccard_join, "LEAF_SHINGLES", 4000)
    monkeypatch.setattr(jaccard_join, "LEVELS", 0)
    assert sorted(map(tuple, jaccard_join.jaccard_components(df, leaf=16).collect()), key=str) == plain_join(rows)
    monkeypatch.setattr(jaccard_join, "LEVELS", 2)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 3)
    assert sorted(map(tuple, jaccard_join.jaccard_components(df, leaf=16).collect()), key=str) == plain_join(rows)


def test_join_query_and_empty_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(sf_dir + "/documents.parquet").select("doc_id", "text").collect()]
    got = registry()["op13_jaccard_join"](spark, sf_dir)
    assert sorted(map(tuple, got.collect()), key=str) == plain_join(rows)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.jaccard_components(none).count() == 0


def test_windows_keep_every_linked_pair():
    """The counting argument of the windows, on random sets and random owners."""
    rng = random.Random(9)
    for _ in range(300):
        n = rng.randint(1, 200)
        x = {rng.randrange(10**6) for _ in range(n)}
        y = set(x)
        while True:
            z = set(y)
            z.discard(rng.choice(list(z))) if rng.random() < 0.5 and len(z) > 1 else z.add(rng.randrange(10**6))
            if 100 * len(x & z) < 80 * len(x | z):
                break
            y = z
        owner = {h: rng.randrange(rng.choice([1, 2, 5, 50])) for h in x | y}
        reached = []
        for s in (x, y):
            m = len(s)
            prefix = sorted(s)[: jaccard_join.prefix_length(m, 80)]
            slack = (max(1, -(-80 * m // 100) * jaccard_join.SLACK_PERCENT // 100) - 1) // 2
            upto, cells = 0, set()
            for mass, o in sorted((c, o) for o, c in Counter(owner[h] for h in prefix).items()):
                upto += mass
                if upto > slack:
                    cells.add(o)
            reached.append((cells, set(prefix)))
        common = reached[0][1] & reached[1][1]
        assert any(owner[h] in reached[0][0] & reached[1][0] for h in common)
