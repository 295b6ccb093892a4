"""The registered queries against plain Python on tables with every edge, clashing names and what is left behind."""

import hashlib
import random
import re
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stereolith.llm import common, minhash, packing, pieces, private, queries, simhash

import corpus_pipeline

from .helpers import EDGES, documents, prose
from .test_operators import KINDS, hf_ids, plain_spans


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    texts = [*EDGES, (10, "a <|endoftext|> b <|endoftext|>"), (11, "mail a@b.co or 10.0.0.1, card 4111 1111 1111 1111, +1 (509) 555-6973"), *[(100 + i, prose(20 + 40 * i, i)) for i in range(30)]]
    documents(spark, texts).repartition(4).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(100, 130)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path), texts


def test_packing_query(spark, tables):
    path, texts = tables
    rows = queries.op1_packing(spark, path).orderBy("sequence_id", "offset").collect()
    at = 0
    for r in rows:
        assert r.sequence_id * 2048 + r.offset == at and 0 < r.length <= 2048 - r.offset
        at += r.length
    ids = {i: hf_ids(t) for i, t in texts}
    assert at == sum(len(hf_ids(t)) for _, t in texts)
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own))


def test_private_query(spark, tables):
    path, texts = tables
    rows = queries.op3_private(spark, path).collect()
    assert len(rows) == len(texts)
    plain = {i: plain_spans(t or "") for i, t in texts}
    for r in rows:
        base = plain[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in base.split(",")) for k in KINDS]
        assert ",".join(s for s in r.spans.split(",") if not s.startswith("id:")) == base


def test_pieces_query(spark, tables):
    path, texts = tables
    model = pieces.PieceModel(open(queries.vocabulary("piece_bpe_32k.model"), "rb").read())
    rows = queries.op6_pieces(spark, path).collect()
    assert len(rows) == len(texts) and all(r.lossless for r in rows)
    assert all(r.n_bytes == len((dict(texts)[r.doc_id] or "").encode()) and r.n_pieces >= 1 for r in rows) and model.size > 0


def plain_jump(key, shards):
    last, now = -1, 0
    while now < shards:
        last = now
        key = (key * 2862933555777941757 + 1) % 2**64
        now = int((last + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return last


def test_sharding_query(spark, tables):
    path, texts = tables
    rows = queries.op10_sharding(spark, path).withColumn("h", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = [(t or "").encode() for i, t in texts if i == r.doc_id][0]
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert (r.shard, r.grown_shard) == (plain_jump(r.h % 2**64, 24), plain_jump(r.h % 2**64, 25)) and r.grown_shard in (r.shard, 24)
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_clashing_names(spark, tmp_path):
    """Columns named as helpers name theirs stay as they are."""
    names = ["doc_id", "text", "__file", "__row", "__digest", "__parts", "__values", "__score", "score", "__id", "__text", "_metadata", "c0", "fp", "bands", "whole"]
    rows = [(i, f"call +1 (509) 555-69{i % 5}3 now {prose(30, i % 5)}", *[f"{n}{i}" for n in names[2:]]) for i in range(20)]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for kept in (simhash.deduplicate(df), minhash.deduplicate(df), private.mask(df, private.discover(df)), corpus_pipeline.keep_quality(spark, df, str(tmp_path))):
        assert kept.columns == names
        found = kept.collect()
        assert found and all(r[k] == f"{n}{r.doc_id}" for r in found for k, n in enumerate(names) if k > 1)
    assert simhash.deduplicate(df).count() == minhash.deduplicate(df).count() == 5
    assert "[PHONE]" in private.mask(df, private.discover(df)).first().text


def test_nothing_stays_once_released(spark, tables):
    path, _ = tables
    common.release_all(spark)
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(200)], "vec_id long, embedding array<float>")
    vectors.write.mode("overwrite").parquet(path + "/embeddings.parquet")
    for name in ("op1_packing", "op2_scoring", "op3_private", "op4_topk", "op5_media", "op7_simhash", "op10_sharding"):
        queries.QUERIES[name](spark, path).collect()
    corpus_pipeline.run(spark, path).collect()
    folder = Path(re.sub("^file:/*", "/", common.work_dir(spark))) / "stereolith"
    assert len(list(folder.iterdir())) <= 24
    common.release_all(spark)
    assert list(folder.iterdir()) == []


def test_added_tokens_are_packed_as_the_tokenizer_does(spark):
    rnd = random.Random(4)
    texts = [(i, "".join(rnd.choice(["<|endoftext|>", " ", "word", "\n", "<|", "é"]) for _ in range(12))) for i in range(60)]
    rows = packing.pack(documents(spark, texts), vocabulary=queries.vocabulary("byte_bpe_50k.json"), with_ids=True).collect()
    for i, t in texts:
        own = b"".join(bytes(r.ids) for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start))
        assert [int.from_bytes(own[k : k + 4], "little") for k in range(0, len(own), 4)] == hf_ids(t)
