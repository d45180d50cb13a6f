"""Every pipeline stage on odd rows: nulls, repeated and null ids, ties, clashing columns, no rows."""

import collections
import random

import pytest

import corpus_pipeline
from imprint.llm import repetition, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, _row int, h string, b string"
WORDS = {
    "en": "the of and to in is that it was for on with as at by from they this have not".split(),
    "de": "der die das und ist nicht ein zu den mit von auf im sich dem des auch es an werden".split(),
}


def text(rng, lang, n=80):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "s", "en"]) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        lang = rng.choice(["en", "de"])
        rows.append((i, text(rng, lang), rng.choice([lang, lang, None])))
    rows += [(100, None, "en"), (101, "", "en"), (102, "12 34 !!", None), (103, "short one", "de"), (None, rows[0][1], None)]
    rows += [rows[1], rows[1], (2, text(rng, "en"), "en"), (None, text(rng, "de"), None), (104, text(rng, "en", 20_000), "en")]
    full = [(*r, "s", 1, 7, 8, "clash", "too") for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def rows_of(df):
    return collections.Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("name,step", corpus_pipeline.STAGES[:-1])
def test_stage_keeps_whole_rows_and_their_columns(spark, odd, name, step):
    out = step(spark, odd, "")
    kept, given = rows_of(out), rows_of(odd)
    assert out.columns == odd.columns and kept and not kept - given
    if name != "near_duplicates":  # equal rows stay or go together
        assert all(kept[r] in (0, n) for r, n in given.items())
        assert not any(r[1] in (None, "", "12 34 !!") for r in kept)
    none = step(spark, odd.limit(0), "")
    assert none.columns == odd.columns and none.count() == 0


def test_quality_stage_equals_the_rules(spark, odd):
    kept = rows_of(corpus_pipeline.quality_rules(spark, odd, ""))
    for r, n in rows_of(odd).items():
        m = repetition.text_metrics((r[1] or "").encode())
        fine = m[0] >= 10 and 100 * m[4] <= 20 * m[0]
        assert kept[r] == (n if fine else 0)  # these texts fail nothing but the base rules


def test_near_duplicate_stage_keeps_one_row_of_each_group(spark, odd):
    kept = rows_of(corpus_pipeline.near_duplicates(spark, odd, ""))
    prints = collections.Counter()
    for r, n in kept.items():
        prints[simhash.text_fingerprint((r[1] or "").encode())] += n
    assert max(prints.values()) == 1
    assert set(prints) == {simhash.text_fingerprint((r[1] or "").encode()) for r in rows_of(odd)}  # no links in this table


def test_packing_stage_covers_every_row_once(spark, odd):
    pieces = corpus_pipeline.packing(spark, odd, "").collect()
    assert sum(r.start == 0 for r in pieces) == odd.count()
    by_id = collections.defaultdict(int)
    for r in pieces:
        by_id[r.doc_id] += r.length
    assert by_id[100] == by_id[101] == 1 and by_id[104] > 20_000
    fill = collections.defaultdict(list)
    for r in pieces:
        fill[r.sequence_id].append((r.offset, r.length))
    for spans in fill.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert corpus_pipeline.packing(spark, odd.limit(0), "").count() == 0
