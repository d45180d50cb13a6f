"""W2 against a walk that takes one claim at a time, for 3,000 bags of claims at once."""

import random

from imprint.plans.organise import next_free_names


def one_by_one(claims, taken):
    """Each claim, by target, then name: its target if free, else the first free counter slot."""
    named, used, out = {t for _, t, _ in claims}, set(), {}
    for k, target, _ in sorted(claims, key=lambda c: (c[1], c[2], c[0])):
        stem, ext = target.rsplit(".", 1)
        j = 0
        while True:
            name = target if j == 0 else f"{stem}_{j:03d}.{ext}"
            if name not in taken and name not in used and (j == 0 or name not in named):
                break
            j += 1
        used.add(name)
        out[k] = name
    return out


def test_names_equal_one_claim_at_a_time(spark):
    rng = random.Random(12)
    claims, taken, want, key = [], set(), {}, 0
    for bag in range(3000):
        stem = f"bag{bag:04d}"
        forms = [f"{stem}.jpg", f"{stem}_001.jpg", f"{stem}_002.jpg", f"{stem}_001_001.jpg", f"{stem}.png", f"{stem}_1000.jpg"]
        mine = []
        for target in rng.choices(forms, k=rng.randint(1, 7)):
            mine.append((key := key + 1, target, f"n{rng.randrange(5)}"))
        held = {
            rng.choice([*forms, f"{stem}_003.jpg", f"{stem}_01.jpg", f"{stem}_0004.jpg", f"{stem}_001.png"])
            for _ in range(rng.randint(0, 4))
        }
        if bag % 500 == 0:  # a long row of taken slots, past three digits
            held |= {f"{stem}_{j:03d}.jpg" for j in range(1, 1005) if j != 700}
        claims += mine
        taken |= held
        want |= one_by_one(mine, held)
    df = spark.createDataFrame(claims, "key long, target string, name string")
    got = dict(map(tuple, next_free_names(df, spark.createDataFrame([(t,) for t in taken], "name string"), "key").collect()))
    assert got == want
    assert len(set(got.values())) == len(got) and not taken & set(got.values())
