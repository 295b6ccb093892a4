"""Near-duplicates by five-word similarity, against all pairs."""

import random

import numpy as np

from stereolith.llm import minhash, simhash

import corpus_pipeline

from .helpers import EDGES, documents


def plain_shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def plain_kept(rows):
    """The least id of each component of pairs at 0.8 or more."""
    sets, root = [plain_shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (ident, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(ident)
    return sorted((min((x for x in g if x is not None), default=None) for g in groups.values()), key=str)


def near_copies():
    rnd, rows = random.Random(5), list(EDGES)
    for i in range(160):
        base = [f"w{random.Random(1000 * (i % 20) + k).randrange(5000)}" for k in range(200)]
        for _ in range(i // 20):
            base[rnd.randrange(200)] = f"changed{rnd.randrange(10**6)}"
        rows.append((100 + i, " ".join(base)))
    return rows


def test_stage_keeps_one_of_each_group_of_near_copies(spark):
    rows = near_copies()
    docs = documents(spark, rows)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == plain_kept(rows)
    assert minhash.deduplicate(documents(spark, [])).count() == 0


def test_pairs_that_chains_break_are_linked(spark):
    """Neighbours in a band may be unlike while others of it are alike."""
    rnd, rows = random.Random(6), []
    base = [f"w{k}" for k in range(400)]
    for i in range(60):  # several centres at about 0.7, near copies around each
        centre = random.Random(i % 6)
        text = list(base)
        for _ in range(14):
            text[centre.randrange(400)] = f"c{i % 6}"
        for _ in range(4):
            text[rnd.randrange(400)] = f"x{i}"
        rows.append((i, " ".join(text)))
    kept = [r.doc_id for r in minhash.deduplicate(documents(spark, rows)).collect()]
    assert sorted(kept, key=str) == plain_kept(rows)


def test_candidates_are_found_by_ball_hashing(spark):
    """Texts of one anchor are candidates if their fingerprints there differ in two bits at most."""
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join([*words[:-1], f"end{i}"]) for i in range(4)]
    prints = [0, 0b11, -(1 << 15), 0b11111]  # 1 and 2 are within two bits of 0, and 3 of none
    n = len(plain_shingles(texts[0]))
    rows = [(i, n, 1, i, [7, 100 + i], [p, 0], [0] * 16) for i, p in enumerate(prints)]
    classes = spark.createDataFrame(rows, "whole long, n long, __file long, __row long, anchors array<long>, prints array<short>, bits array<long>")
    places = spark.createDataFrame([(1, i, bytearray(t.encode())) for i, t in enumerate(texts)], "__file long, __row long, __text binary")
    edges = minhash.links(classes, places, shingle=5, tenths=8).collect()
    assert {x for e in edges for x in e} == {0, 1, 2}


def test_fingerprints_of_pairs_at_the_least_similarity_meet():
    """Sets at 0.8 share an anchor and are within two bits there about as often as calculated, and at least once."""
    rnd = np.random.default_rng(3)
    for size, of, least in ((4, 5, 0.256), (80, 100, 0.355), (720, 900, 0.355)):  # a set and one that holds it
        met = []
        for _ in range(400):
            y = np.unique(rnd.integers(0, 1 << 63, of, np.uint64))
            x = y[np.sort(rnd.permutation(of)[:size])]
            same = minhash.anchors(x) == minhash.anchors(y)
            apart = [bin(int(v)).count("1") for v in (minhash.prints(x) ^ minhash.prints(y)).view(np.uint16)]
            met.append(sum(same & (np.array(apart) <= minhash.RADIUS)))
        assert min(met) > 0 and np.mean(met) > 0.95 * least * minhash.PRINTS


def test_fingerprints_are_those_of_plain_majorities():
    found = minhash.shingles(" ".join(f"w{k}" for k in range(700)).encode(), 5)[1]
    m, mask = int(minhash._M), (1 << 64) - 1
    bits = ""
    for factor in minhash._WORDS.tolist():
        hashes = []
        for x in found.tolist():
            x = x * factor & mask
            x = (x ^ x >> 32) * m & mask
            hashes.append((x ^ x >> 29).to_bytes(8, "little"))
        bits += "".join(str(int(2 * sum(h[k // 8] >> (7 - k % 8) & 1 for h in hashes) > len(found))) for k in range(64))
    expected = [int.from_bytes(int(bits[k : k + 16], 2).to_bytes(2, "big"), "little", signed=True) for k in range(0, 16 * minhash.PRINTS, 16)]
    assert minhash.prints(found).tolist() == expected


def test_texts_stay_where_they_are(spark, tmp_path):
    """Whatever is kept is picked by its place, and no text goes through a shuffle for it."""
    rows = near_copies()
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = minhash.deduplicate(spark.read.parquet(str(tmp_path / "documents.parquet")))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan
        assert sorted((r.doc_id for r in kept.collect()), key=str) == plain_kept(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_bitmaps_pick_the_rows_of_their_places(spark):
    rows = spark.range(2 * 70_000).selectExpr("id % 2 as __file", "id div 2 as __row", "id as value")
    few = "__row in (0, 1, 7, 8, 32767, 32768, 32769, 65536, 69999) or __row % 11 = 3 and __file = 1"
    marks = simhash.marked(rows.where(few).select("__file", "__row"))
    found = simhash.at_places(rows, marks)
    assert found.columns == rows.columns
    assert sorted(found.collect()) == sorted(rows.where(few).collect())
    assert simhash.at_places(rows, simhash.marked(rows.where("false").select("__file", "__row"))).count() == 0
