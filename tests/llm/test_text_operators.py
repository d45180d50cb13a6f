"""Operators on documents against brute-force versions, with awkward rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from imprint.llm import distinct_bpe, knn_quality, langid, packing, repetition, sharding, simhash, wordbpe
from imprint.llm.queries import registry
from imprint.operators.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "wörter und mehr " * 20000 + "x" * 100000
TEXTS = [
    None, "", "   \n\t", "one", "two words", "Same text here to copy again", "Same text here to copy again",
    "same TEXT here to copy again", "A line of words that is long\n" * 4, "1234 5678 !!! ...", LONG,
    "it's <|endoftext|> mid<|startoftext|>dle don't", "café café ǅ İ ΣΣ  nb\u0085sp a\x1cb ​",
    "中文 русский ١٢٣ \U0001f600", "# * $ % & | < > a b c d",
    "a b c d e f g h i j k l m n o p", "a b c d e a b c d e x y z w v",
]


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, "en" if i % 2 else "de", "s", 1) for i, t in enumerate(TEXTS)]
    return out + [out[5], (None, "Same text here to copy again", None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---------------------------------------------------------------- 7


def brute_metrics(text):
    w = words_of(text)
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def test_repetition_matches_brute_force(docs, rows, empty):
    out = repetition.judged(repetition.repetition_metrics(docs)).collect()
    got = collections.Counter(
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out
    )
    assert got == collections.Counter((r[0], *brute_metrics(r[1])) for r in rows)
    for r in out:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert repetition.repetition_metrics(empty).count() == 0


def test_repetition_measures_longer_ngrams():
    line = "a bb ccc dddd eeeee f"
    m = dict(zip((c.split()[0] for c in repetition.METRICS.split(", ")), repetition.text_metrics(f"{line} x {line}".encode())))
    assert m["dup_chars_5"] == m["dup_chars_6"] == len(line.replace(" ", ""))  # the later occurrence
    assert m["dup_chars_7"] == 0


def test_repetition_coverage_can_decide(spark):
    """A passage repeated through an otherwise fine text: base passes it, coverage does not."""
    passage = " ".join(f"passage{i}" for i in range(20))
    parts = [passage + " " + " ".join(f"w{k}x{i}" for i in range(91)) for k in range(9)]
    df = spark.createDataFrame([(1, " ".join(parts)), (2, " ".join(parts[:2] + [f"u{i}" for i in range(700)]))], "doc_id long, text string")
    got = {r.doc_id: r for r in repetition.judged(repetition.repetition_metrics(df)).collect()}
    assert not got[1].base_failed and not got[1].kept
    assert not got[2].base_failed and got[2].kept


def test_repetition_loses_no_good_document(spark):
    sf = "/root/testdata/sf0.01"
    out = repetition.judged(repetition.repetition_metrics(spark.read.parquet(f"{sf}/documents.parquet")))
    good = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").select("doc_id")
    assert out.join(good, "doc_id").filter("not base_failed and not kept").count() == 0


def test_quality_filter_keeps_rows_and_clashing_columns(spark, empty):
    good = " ".join(f"word{i}" for i in range(40))
    df = spark.createDataFrame([(1, good, 5, True), (1, good, 5, True), (2, "few", 6, True)], "doc_id long, text string, n_words int, kept boolean")
    out = repetition.quality_filter(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == [(1, good, 5, True)] * 2
    assert repetition.quality_filter(empty).columns == empty.columns


# ---------------------------------------------------------------- 4


def brute_fingerprint(text):
    w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


def test_simhash_matches_brute_force(docs, rows, empty):
    out = simhash.near_duplicates(docs)
    out = out.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fp"), "component_id").collect()
    fps = [brute_fingerprint(r[1]) for r in rows]
    members = collections.defaultdict(list)
    for r, c in zip(rows, brute_components(fps)):
        members[c].append(r[0])
    want = collections.Counter()
    for r, f, c in zip(rows, fps, brute_components(fps)):
        want[(r[0], format(f, "016x"), min((i for i in members[c] if i is not None), default=None))] += 1
    assert collections.Counter(map(tuple, out)) == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("small,block", [(64, 1024), (2, 8)])
def test_links_connect_what_all_pairs_connect(spark, small, block):
    rng = np.random.default_rng(5)
    fps = set(rng.integers(0, 2**63, 300).tolist()) | {0, 2**64 - 1, 1 << 63}
    for centre in list(fps)[:12]:
        for _ in range(25):
            f = centre
            for b in rng.integers(0, 64, rng.integers(0, 6)):
                f ^= 1 << int(b)
            fps.add(f)
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    nodes = spark.createDataFrame([(s,) for s in signed], "fp long")
    edges = simhash.links(nodes, small=small, block=block)
    for a, b in edges.collect():
        assert bin((a ^ b) & (2**64 - 1)).count("1") <= 3
    found = {r.node: r.root for r in components(edges).collect()}
    ids = brute_components(fps)
    low = collections.defaultdict(list)
    for s, c in zip(signed, ids):
        low[c].append(s)
    assert [found.get(s, s) for s in signed] == [min(low[c]) for c in ids]


def test_one_per_group_keeps_one_row_of_each(docs, rows, empty):
    kept = simhash.one_per_group(docs).collect()
    fps = [brute_fingerprint(r[1]) for r in rows]
    ids = brute_components(fps)
    group = {}
    for r, c in zip(rows, ids):
        group.setdefault(r[1], c)
    assert sorted(group[k.text] for k in kept) == sorted(set(ids))
    assert simhash.one_per_group(empty).columns == empty.columns and simhash.one_per_group(empty).count() == 0


def test_one_per_group_with_only_null_and_repeated_ids(spark):
    a, b = "some words that make one text", "other words for the second text entirely"
    df = spark.createDataFrame([(None, a), (None, a), (None, b), (5, a + " x y z w v u"), (5, a + " x y z w v u")], "doc_id long, text string")
    kept = simhash.one_per_group(df).collect()
    assert sorted(k.text for k in kept) == sorted({a, b, a + " x y z w v u"})


def test_long_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {tuple(r) for r in components(edges).collect()} == {(i, 0) for i in range(201)}


# ---------------------------------------------------------------- 5 and 9


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(str(public_tokenizers.path(wordbpe.TOKENIZER)))


def test_words_encode_alone_as_in_the_tokenizer(tokenizer):
    encode = wordbpe.WordEncoder(wordbpe.tokenizer_path())
    points = [chr(c) for c in range(33, 0x3000) if c not in range(0xD800, 0xE000)]
    for word in [*points, *(f"a{c}b" for c in points), *(f"1{c}'s" for c in points[:400]), "Ab'LL9_x--", "<|endoftext|>", "x<|y"]:
        want = tokenizer.encode(word, add_special_tokens=False).ids
        got = [i for w in word.encode().split() for i in encode(w)]
        assert got == want, word


def test_distinct_word_bpe_matches_the_tokenizer(docs, rows, empty, tokenizer):
    out = distinct_bpe.encode(docs).collect()
    want = collections.Counter()
    for r in rows:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids
        want[(r[0], len(ids), " ".join(map(str, ids)), tokenizer.decode(ids, skip_special_tokens=False))] += 1
    assert collections.Counter(map(tuple, out)) == want
    assert distinct_bpe.encode(empty).count() == 0


def test_decode_by_piece_join(spark, tokenizer):
    texts = ["hello there <|endoftext|> it's", "", "café 99"]
    data = [(i, tokenizer.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)] + [(9, None)]
    df = spark.createDataFrame(data, "k long, ids array<int>")
    out = {r.k: r.decoded for r in distinct_bpe.decode(df, distinct_bpe.pieces_table(spark), "k", "ids").collect()}
    assert out == {k: tokenizer.decode(v or [], skip_special_tokens=False) for k, v in data}


def check_packing(out, texts, tokenizer, capacity=2048):
    docs = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in out:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    for i, text in texts.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]
        at = 0
        for r in sorted(docs[i], key=lambda r: r.start):
            part = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(part))
            at += r.length
        assert at == len(ids)


def test_packing_places_every_id_once(spark, rows, empty, tokenizer):
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    df = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id long, text string, sequence_id int").repartition(2)
    check_packing(packing.pack(df).collect(), texts, tokenizer)
    assert packing.pack(empty).count() == 0
    twice = packing.pack(spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string"))
    assert sum(r.length for r in twice.collect()) == 3 + 3 + 1


def test_differencing_is_near_equal_and_fits():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 300, 900):
        lengths = rng.integers(1, 513, n).tolist()
        at = packing.pack_group(lengths)
        loads = np.bincount(at, weights=lengths)
        assert len(at) == n and loads.max() <= 2048
        if n > 250:
            assert sum(lengths) >= 0.97 * 2048 * len(loads)
            assert loads.max() - loads.min() <= 64
    assert sorted(np.bincount(packing.differencing([8, 7, 6, 5, 4], 2), weights=[8, 7, 6, 5, 4]).tolist()) == [14, 16]


# ---------------------------------------------------------------- 6 and 2


def test_language_id_on_held_out_rows(spark, sf_dir, docs, empty):
    rows = registry()["op6_language_id"](spark, sf_dir).collect()
    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out and len(truth[r.doc_id].text or "") > 40]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id].lang for r in held]) > 0.95
    out = langid.predict(docs, {"de": b"der die das und ist " * 50, "en": b"the of and to is " * 50})
    got = [(r.doc_id, r.lang_pred, r.score, r.accepted) for r in out.collect()]
    for i, lang, score, accepted in got:
        letters = any(map(str.isalpha, (TEXTS[i] if i is not None else "x") or ""))
        assert (lang != "und") == letters or i is None
        assert 0 <= score <= 1 and (lang != "und" or (score == 0 and not accepted))
    assert langid.train_dictionaries(empty, F.lit(True)) == {}
    assert {r.lang_pred for r in langid.predict(docs, {}).collect()} == {"und"}
    assert langid.language_filter(empty).columns == empty.columns and langid.language_filter(empty).count() == 0


def test_languages_equal_plain_compression(spark):
    """Sizes by another route: one frame for each block with a plain dictionary."""
    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    learned = langid.train_dictionaries(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), langid.learn_from())
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, learned).collect()}
    how = zstandard.ZstdCompressionParameters.from_level(
        langid.LEVEL, source_size=langid.BLOCK, dict_size=langid.DICT_BYTES, min_match=langid.MIN_MATCH, write_content_size=False
    )
    for r in docs.collect()[:60]:
        text = "".join(c if c.isalpha() or ord(c) > 127 else " " for c in (r.text or "").lower()).encode()
        sizes = {}
        for lang, content in learned.items():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            parts = [text[i : i + langid.BLOCK] for i in range(0, len(text), langid.BLOCK)]
            sizes[lang] = sum(len(zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress(x)) for x in parts)
        if any(c.isalpha() for c in r.text or ""):
            assert sizes[got[r.doc_id]] == min(sizes.values())
        else:
            assert got[r.doc_id] == "und"


def test_language_samples_are_bounded_and_from_whole_texts(spark, monkeypatch):
    """One window of a repeated id, windows anywhere in long texts, no more than SAMPLE_DOCS rows."""
    rows = [(7, f"copy number {i} of one id", "en") for i in range(3000)]
    rows += [(100 + i, "x" * 5000 + " " + "tail " * 1000, "la") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.train_dictionaries(df, F.lit(True))
    assert got["en"].count(b"copy number") == 1
    assert b"xxx" in got["la"] and b"tail tail" in got["la"]
    assert len(got["la"]) <= 40 * (langid.WINDOW + 1) + 1
    many = spark.createDataFrame([(i, f"word{i % 9} " * 50, "en") for i in range(5000)], "doc_id long, text string, lang string")
    assert langid.train_dictionaries(many, F.lit(True))["en"].count(b"\n") == langid.SAMPLE_DOCS
    monkeypatch.setattr(langid, "MAX_LANGS", 1)
    with pytest.raises(ValueError, match="more than 1 languages"):
        langid.train_dictionaries(df, F.lit(True))


def test_equal_sizes_go_to_the_larger_language(spark):
    same = b"some words that are common to both of them " * 9
    df = spark.createDataFrame([(1, "some words that are common"), (1, "some words that are common")], "doc_id long, text string")
    out = langid.predict(df, {"bb": same, "aa": same}).collect()
    assert [(r.lang_pred, r.score, r.accepted) for r in out] == [("bb", 0.0, False)] * 2


def test_language_training_ignores_other_rows(spark):
    df = spark.createDataFrame([(1, "the cat", "en"), (2, "der hund", "de"), (3, "le chien", None), (4, None, "fr")], "doc_id long, text string, lang string")
    got = langid.train_dictionaries(df, F.col("doc_id") != 2)
    assert set(got) == {"en"} and got["en"].strip() == b"the cat"


def test_quality_on_held_out_labels(spark, docs, empty):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in registry()["op2_neighbour_quality"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    held = [r for r in labels if rows[r.doc_id].held_out]
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in rows)
    assert np.mean([rows[r.doc_id].predicted == r.quality for r in held]) > 0.95
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = knn_quality.fit(docs, none, F.lit(True))
    assert {r.score for r in knn_quality.score(docs, model).collect()} == {0.5}
    some = spark.createDataFrame([(5, 1), (8, 0), (8, 1), (None, 1), (3, None), (99, 0)], "doc_id long, quality int")
    model = knn_quality.fit(docs, some, F.lit(True))
    out = knn_quality.score(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert knn_quality.score(empty, model).count() == 0


def test_repeated_ids_are_reduced_before_the_collect(spark, monkeypatch):
    data = [(1, f"good words number {i}") for i in range(300)] + [(2, "bad stuff here"), (3, "fine text")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    collect, sizes = type(docs).collect, []

    def spy(df):
        rows = collect(df)
        if "counts" in df.columns:
            sizes.append(len(rows))
        return rows

    monkeypatch.setattr(type(docs), "collect", spy)
    knn_quality.fit(docs, labels, F.lit(True))
    assert sizes == [3]


# ---------------------------------------------------------------- 10


def plain_differencing(lengths, windows):
    """Karmarkar-Karp by the book: merge the two partitions of largest imbalance in opposite order."""
    parts = [[(n, [i])] + [(0, [])] * (windows - 1) for i, n in enumerate(lengths)]
    age = list(range(len(parts)))
    while len(parts) > 1:
        order = sorted(range(len(parts)), key=lambda i: (parts[i][-1][0] - parts[i][0][0], age[i]))
        a, b = parts[order[0]], parts[order[1]]
        both = [(x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b))]
        both.sort(key=lambda w: -w[0])  # stable
        keep = sorted(set(range(len(parts))) - set(order[:2]))
        parts, age = [parts[i] for i in keep] + [both], [age[i] for i in keep] + [max(age) + 1]
    return parts[0]


@pytest.mark.parametrize("n,windows", [(1, 3), (9, 2), (30, 4), (60, 7), (40, 1)])
def test_differencing_equals_the_book(n, windows):
    rng = random.Random(n)
    for _ in range(5):
        lengths = [rng.randint(1, 600) for _ in range(n)]
        got = packing.differencing(lengths, windows)
        want = {frozenset(items) for _, items in plain_differencing(lengths, windows) if items}
        assert {frozenset(np.flatnonzero(got == w).tolist()) for w in set(got.tolist())} == want


def check_shards(out, rows, shards):
    assert collections.Counter(r.doc_id for r in out) == collections.Counter(r[0] for r in rows)
    slots = collections.defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_are_even_and_groups_whole(spark, docs, rows, empty):
    out = sharding.assign_shards(docs).collect()
    check_shards(out, rows, 8)
    text = {r[0]: (r[1] or "").encode() for r in rows if r[0] is not None}
    for r in out:
        if r.doc_id is not None:
            assert (r["size"], r.text_crc32) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id]))
    assert sharding.assign_shards(empty).count() == 0


def test_hot_group_is_cut_only_where_it_must_be(spark):
    data = [(i, "hot") for i in range(300)] + [(1000 + i, f"pair {i // 3}") for i in range(300)]
    data += [(5000 + i, f"single {i}") for i in range(300)]
    out = sharding.assign_shards(spark.createDataFrame(data, "doc_id long, text string")).collect()
    check_shards(out, data, 8)
    shards = collections.defaultdict(set)
    text = dict(data)
    for r in out:
        shards[text[r.doc_id]].add(r.shard)
    assert 3 <= len(shards["hot"]) <= 4  # 300 rows into shards of 112 or 113, which hold pairs too
    assert sum(len(s) > 1 for t, s in shards.items() if t.startswith("pair")) <= 2


def test_full_shards_exchange_rows(spark):
    """Every text has a copy, so no place is free."""
    for groups in ([2] * 400 + [3] * 200, [50] * 20 + [7] * 30):
        data = [(0, f"{n} rows, group {g}") for g, n in enumerate(groups) for _ in range(n)]
        data = [(i, text) for i, (_, text) in enumerate(sorted(data, key=lambda r: zlib.crc32(r[1].encode())))]
        out = sharding.assign_shards(spark.createDataFrame(data, "doc_id long, text string")).collect()
        check_shards(out, data, 8)
        shards = collections.defaultdict(set)
        text = dict(data)
        for r in out:
            shards[text[r.doc_id]].add(r.shard)
        assert sum(len(s) - 1 for s in shards.values()) <= 7


def recount(out, text):
    shards = collections.defaultdict(set)
    for r in out:
        shards[text[r.doc_id]].add(r.shard)
    return sum(len(s) - 1 for s in shards.values())


def test_propagation_works_at_every_size(spark):
    """Rounds run on a small and on the registered table, never raise the cut, and do the work."""
    data = [(i, f"pair{i // 2}") for i in range(300)] + [(1000 + i, f"tri{i // 3}") for i in range(300)]
    data += [(2000 + i, "hot") for i in range(300)] + [(5000 + i, f"u{i}") for i in range(100)]
    small = spark.createDataFrame(data, "doc_id long, text string")
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    for df, most in ((small, 10), (table, 0)):
        cuts: list[int] = []
        out = sharding.assign_shards(df, settle=False, cuts=cuts).collect()
        assert len(cuts) > 1 and cuts[0] > 0 and cuts == sorted(cuts, reverse=True)
        assert cuts[-1] <= most  # what propagation alone leaves
        assert recount(out, {r.doc_id: r.text for r in df.collect()}) == cuts[-1]


def test_shards_against_every_assignment(spark):
    """The cut of tiny tables is that of the best assignment, or one more."""
    for groups, shards in (([4, 3, 2, 1, 1, 1], 2), ([3, 3, 3, 2, 1], 3)):
        data = [(i, f"g{g}") for i, g in enumerate(g for g, n in enumerate(groups) for _ in range(n))]
        sizes = [len(data) // shards + (s < len(data) % shards) for s in range(shards)]

        def least(left, room):
            if not left:
                return 0
            best = 99
            for split in itertools.product(range(left[0] + 1), repeat=shards):
                if sum(split) == left[0] and all(a <= b for a, b in zip(split, room)):
                    cut = sum(x > 0 for x in split) - 1
                    best = min(best, cut + least(left[1:], [b - a for a, b in zip(split, room)]))  # noqa: B023
            return best

        out = sharding.assign_shards(spark.createDataFrame(data, "doc_id long, text string"), shards).collect()
        check_shards(out, data, shards)
        assert recount(out, dict(data)) <= least(groups, sizes) + 1


def test_wishes_are_admitted_in_circles_and_into_free_places():
    full = [0, 0, 0]
    assert sharding.admitted([[0, 5, 0], [3, 0, 0], [0, 0, 0]], full) == [[0, 3, 0], [3, 0, 0], [0, 0, 0]]
    assert sharding.admitted([[0, 5, 0], [0, 0, 4], [2, 0, 0]], full) == [[0, 2, 0], [0, 0, 2], [2, 0, 0]]
    assert sharding.admitted([[0, 5, 0], [0, 0, 4], [0, 0, 0]], [0, 0, 3]) == [[0, 3, 0], [0, 0, 3], [0, 0, 0]]


def test_quality_votes_equal_brute_force_in_any_partitioning(spark):
    """Every labelled vector, one by one, in doubles; and the same scores however rows are dealt."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = knn_quality.fit(docs, labels, knn_quality.learn_from())
    docs = docs.unionByName(docs.limit(20))  # repeated rows
    scores = [
        sorted((r.doc_id, r.score, r.predicted) for r in knn_quality.score(docs.repartition(n), model).collect()) for n in (1, 7)
    ]
    assert scores[0] == scores[1]
    seen = {}
    for i, score, _ in scores[0]:
        assert seen.setdefault(i, score) == score
    count = knn_quality.Counter()
    vectors = model.vectors.astype(float)
    for r in docs.limit(60).collect():
        mine = model.latent([count((r.text or "").encode())])[0].astype(float)
        votes = sorted(((-sum(a * b for a, b in zip(mine, v)), j) for j, v in enumerate(vectors)))[: knn_quality.NEIGHBOURS]
        weight = [max(-s, 0.0) ** knn_quality.SHARPNESS * model.votes[j] for s, j in votes]
        want = sum(w for w, (_, j) in zip(weight, votes) if model.labels[j]) / sum(weight) if sum(weight) else model.prior
        assert abs(seen[r.doc_id] - want) < 1e-3


def test_quality_of_a_text_is_the_same_at_any_place_of_a_block():
    rng = np.random.default_rng(5)
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    projection = unit(rng.standard_normal((knn_quality.RANK, knn_quality.DIMS))).T
    labels = rng.integers(0, 2, 400)
    vectors = unit(rng.standard_normal((400, knn_quality.RANK)))
    model = knn_quality.Model(rng.random(knn_quality.DIMS) + 0.1, projection, vectors, np.full(400, 0.1), labels, 0.5)
    rows = [np.sort(rng.choice(knn_quality.DIMS, 80, replace=False)) for _ in range(200)]
    texts = [(at, rng.integers(1, 9, len(at))) for at in rows]
    alone = [model.score([t])[0] for t in texts]
    for n in (2, 7, 61, 200):
        assert [x for at in range(0, 200, n) for x in model.score(texts[at : at + n])] == alone


def test_registered_digests(spark, sf_dir, tokenizer):
    rows = registry()["op5_distinct_word_bpe"](spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in rows[:50]:
        ids = tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
