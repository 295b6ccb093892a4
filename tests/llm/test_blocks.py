"""Binary id files, Merkle manifests and hard negatives against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stereolith.llm import merkle, negatives, queries, rans

from .helpers import EDGES, documents, prose
from .test_operators import hf_ids

VOCABULARY = queries.vocabulary("byte_bpe_50k.json")


# Id files


def table_of(ids):
    return rans.FrequencyTable.of_counts(np.bincount(ids, minlength=1))


@pytest.mark.parametrize("sizes", [[1], [31, 32, 33], [rans.SEGMENT, rans.SEGMENT + 1, 5], [rans.BLOCK, 3, rans.BLOCK - 1]])
def test_blocks_give_their_ids_back(sizes):
    rnd = np.random.default_rng(len(sizes))
    blocks = [np.minimum(rnd.zipf(1.3, n), 40_000).astype(np.uint32) for n in sizes]
    table = table_of(np.concatenate(blocks))
    table = rans.FrequencyTable.from_bytes(table.to_bytes())
    coded = rans.encode_blocks(blocks, table, table.coder())
    for block, back in zip(blocks, rans.decode_blocks(coded, table, table.slots()), strict=True):
        assert np.array_equal(block, back)


def test_one_id_alone_takes_no_words():
    blocks = [np.full(1000, 7, np.uint32)]
    table = table_of(blocks[0])
    coded = rans.encode_blocks(blocks, table, table.coder())
    assert rans.read_header(coded[0])[2][0][1] == 0
    assert np.array_equal(rans.decode_blocks(coded, table, table.slots())[0], blocks[0])


def test_code_is_near_the_entropy():
    ids = np.minimum(np.random.default_rng(1).zipf(1.5, rans.BLOCK), 5000).astype(np.uint32)
    table = table_of(ids)
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    bits = -np.log2(share) @ share * len(ids)
    assert len(rans.encode_blocks([ids], table, table.coder())[0]) * 8 < 1.05 * bits + 64 * 8 * rans.LANES


def test_damage_is_noticed():
    ids = np.random.default_rng(2).integers(0, 500, 40_000).astype(np.uint32)
    table = table_of(ids)
    (coded,) = rans.encode_blocks([ids], table, table.coder())
    for at in (20, 200, len(coded) // 2, len(coded) - 1):
        hurt = bytearray(coded)
        hurt[at] ^= 1
        with pytest.raises(ValueError):
            rans.decode_blocks([bytes(hurt)], table, table.slots())
    with pytest.raises(ValueError):
        rans.decode_blocks([coded], table_of(ids + 1), table_of(ids + 1).slots())


def test_shares_of_counts_past_32_bits():
    counts = np.zeros(10, np.int64)
    counts[[2, 5, 9]] = [1, 1 << 50, 1 << 40]
    table = rans.FrequencyTable.of_counts(counts)
    assert table.ids.tolist() == [2, 5, 9] and int(table.shares.sum()) == 1 << rans.SCALE_BITS and int(table.shares[0]) == 1


def test_checksums_combine():
    rnd = random.Random(3)
    for _ in range(30):
        parts = [rnd.randbytes(rnd.choice([1, 4, 100, 5000])) for _ in range(rnd.randint(1, 5))]
        assert rans.combine_crc32([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def test_documents_in_id_files(spark, tmp_path):
    texts = [*EDGES, (20, prose(120_000, 5)), (10, "a <|endoftext|> b"), (-3, "first"), *[(12, "copy of a copy")] * 40]
    docs = documents(spark, texts).repartition(5)
    rows = rans.encode_documents(docs, vocabulary=VOCABULARY).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted((i for i, _ in texts), key=lambda i: (i is not None, i))
    at, left = 0, sorted((str(i), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in [*hf_ids(t)[:-1], 2])), len(hf_ids(t))) for i, t in texts)
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert sorted((str(r.doc_id), r.ids_crc32, r.n_tokens) for r in rows) == left
    rans.write_ids(docs, str(tmp_path / "files"), vocabulary=VOCABULARY)
    pieces = rans.read_pieces(spark, str(tmp_path / "files"), with_ids=True).where("doc = 20").orderBy("piece").collect()
    assert len(pieces) > 1 and np.frombuffer(b"".join(bytes(p.ids) for p in pieces), "<u4").tolist() == [*hf_ids(prose(120_000, 5))[:-1], 2]


def test_no_documents_in_id_files(spark):
    assert rans.encode_documents(documents(spark, []), vocabulary=VOCABULARY).collect() == []


# Merkle manifests


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    """The root, and each leaf's siblings as (is on the left, digest) or None where a node is hashed alone."""
    paths, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, above_owners = [], []
        for i in range(0, len(nodes), 2):
            pair = nodes[i : i + 2]
            for k, _ in enumerate(pair):
                for leaf in owners[i + k]:
                    paths[leaf].append((k == 1, pair[1 - k]) if len(pair) == 2 else None)
            above.append(sha(*pair))
            above_owners.append([x for o in owners[i : i + 2] for x in o])
        nodes, owners = above, above_owners
    return nodes[0], paths


def plain_manifest(rows):
    """``(id, leaf)`` and what belongs to them, from ``(id, group, leaf, claimed)``."""
    groups = sorted({g for _, g, _, _ in rows}, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in groups:
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        trees[g] = (own, *plain_tree([r[2] for r in own]))
    root, over = plain_tree([trees[g][1] for g in groups])
    found = []
    for g, above in zip(groups, over):
        own, subroot, paths = trees[g]
        for (i, _, leaf, claimed), path in zip(own, paths):
            whole = path + above
            digest = claimed or leaf
            for step in whole:
                digest = sha(digest) if step is None else sha(step[1], digest) if step[0] else sha(digest, step[1])
            proof = sha(*[s[1] for s in whole if s])
            found.append((str(i), leaf, subroot, root, proof, digest, digest == root))
    return sorted(found)


def shown(df):
    return sorted((str(r.i), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


@pytest.mark.parametrize(("parts", "chunk", "round_"), [(1, 16, 8), (7, 2, 1), (3, 3, 2), (5, 1, 3)])
def test_manifest(spark, parts, chunk, round_):
    rnd = random.Random(parts)
    sizes = {None: 3, "": 1, "a": 150, "é": 17, "z": 2, "zz": 64, "𝒳": 5}
    rows = [(rnd.choice([None, rnd.randint(-50, 50)]), g, sha(str(rnd.random())), None) for g, n in sizes.items() for _ in range(n)]
    rows += [rows[10]] * 9  # repeated rows
    rows = [(i, g, leaf, sha("x") if rnd.random() < 0.2 else None) if (i, g, leaf, None) != rows[10] else (i, g, leaf, None) for i, g, leaf, _ in rows]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "i long, lang string, h string, claimed string, part int, g string").repartition(parts)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        proofs = merkle.manifest(df, order_col="i", group_col="lang", leaf_col="h", carry=("claimed",), chunk_bits=chunk, round_bits=round_)
        assert shown(merkle.verify(proofs, claimed_col="claimed")) == plain_manifest(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_manifest_of_one_and_of_none(spark):
    df = spark.createDataFrame([(1, None, sha("a"), None)], "i long, lang string, h string, claimed string")
    for rows in (df, df.where("i = 2")):
        out = merkle.verify(merkle.manifest(rows, order_col="i", group_col="lang", leaf_col="h", carry=("claimed",)), claimed_col="claimed").collect()
        assert [(r.leaf, r.root, r.proof_sha256, r.verified) for r in out] == [(sha("a"), sha("a"), sha(), True)] * rows.count()


def test_merkle_query_on_edges(spark, tmp_path):
    docs = documents(spark, EDGES).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.lit("en"))).withColumn("n_chars", F.when(F.col("doc_id") != 5, F.lit(7).cast("long")))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    part = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    rows = []
    for r in docs.collect():
        leaf = lambda n: sha(*map(part, (r.doc_id, r.source, r.lang, n, r.text)))  # noqa: B023, E731
        hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and r.n_chars is not None
        rows.append((r.doc_id, r.lang, leaf(r.n_chars), leaf(r.n_chars + 1) if hit else None))
    assert shown(queries.op12_merkle(spark, str(tmp_path)).withColumnRenamed("doc_id", "i")) == plain_manifest(rows)


# Hard negatives


def plain_negatives(rows, *, step=50, positives=5, negatives_=3, scale=256):
    good = [(i, y, [int(np.floor(scale * float(x))) for x in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, y, q in good:
        if i % step:
            continue
        score = lambda v: sum(a * b for a, b in zip(q, v))  # noqa: B023, E731
        best = sorted((-score(v), j) for j, z, v in good if z == y and j != i)[:positives]
        others = sorted((-score(v), j) for j, z, v in good if z != y)
        for p, j in best:
            window = [(s, n) for s, n in others if 50 * -p <= 100 * -s <= 95 * -p][:negatives_]
            out += [(i, j, k + 1, n, -p, -s) for k, (s, n) in enumerate(window)]
    return sorted(out)


def mined(df, **options):
    return sorted(tuple(r) for r in negatives.hard_negatives(df, is_anchor=F.col("vec_id") % 50 == 0, **options).collect())


@pytest.mark.parametrize("width", [1, 3, 24])
def test_hard_negatives(spark, width, monkeypatch):
    rnd = np.random.default_rng(width)
    rows = [(int(i), int(rnd.integers(0, 4)), [float(x) for x in rnd.normal(0.3, 0.3, width).astype(np.float32)]) for i in range(700)]
    rows += [(i, 1, rows[3][2]) for i in range(700, 760)]  # ties
    rows += [(801, None, [0.5] * width), (802, 1, None), (803, 1, [None] * width), (850, 1, [float("nan")] * width), (None, 2, [0.5] * width), (900, 2, [-9.0] * width), (950, 77, [1.0] * width), (951, 3, [float("inf")] * width)]
    df = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "vec_id long, label int, embedding array<float>, score double, id string").repartition(3)
    monkeypatch.setattr(negatives, "TREE_ROWS", 200)  # in the driver only: trees of workers keep their size
    assert mined(df) == plain_negatives(rows)


def test_blocks_of_anchors_are_answered_alike(spark, monkeypatch):
    rnd = np.random.default_rng(9)
    rows = [(int(i), int(i % 3), [float(x) for x in rnd.normal(0.2, 0.2, 8)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    monkeypatch.setattr(negatives, "ANCHOR_BYTES", 8 * 8 * 5)
    assert mined(df) == plain_negatives(rows)


def test_trees_of_many_leaves_find_the_same():
    rnd = np.random.default_rng(4)
    vectors = np.floor(256 * rnd.normal(0.1, 0.3, (3000, 6)))
    labels = rnd.integers(0, 3, 3000)
    trees = [negatives.BallTree(np.arange(a, a + 1000), labels[a : a + 1000], vectors[a : a + 1000]) for a in (0, 1000, 2000)]
    trees = [negatives.BallTree.from_row(*t.row()) for t in trees]
    block = negatives.Anchors(np.arange(0, 3000, 50), labels[::50], vectors[::50])
    owner, ids, score = block.positives(iter(trees), 5)
    for a in range(60):
        own = [(-int(vectors[50 * a] @ v), j) for j, (v, y) in enumerate(zip(vectors, labels)) if y == labels[50 * a] and j != 50 * a]
        assert sorted((-s, i) for o, i, s in zip(owner, ids, score) if o == a) == sorted(own)[:5]
    looked = [len(asks) for t in trees for *_, asks in t.leaves(block.vectors, lambda asks, node, under, over: over >= 1.0e5)]
    assert sum(looked) < 60 * sum(len([s for s in t.spans]) for t in trees) / 3  # bounds do prune


def test_no_vectors_no_negatives(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert mined(df) == []
    assert mined(spark.createDataFrame([(50, 1, [1.0])], "vec_id long, label int, embedding array<float>")) == []
    with pytest.raises(ValueError):
        mined(spark.createDataFrame([(50, 1, [1e9])], "vec_id long, label int, embedding array<double>"))
