"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, media, merkle, negatives, packing, pieces, private, quality, rans, scoring, sharding, simhash, topk, urls

URL_RULES = (
    urls.Rule("com", "/en/", "block"),
    urls.Rule("example.com", "/en/7", "allow"),
    urls.Rule("net", "/de/", "allow"),
    urls.Rule("example.net", "/de/8", "block"),
    urls.Rule("org", "/es/", "block"),
)
SHARDS = 24


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary=vocabulary("byte_bpe_50k.json"))


def op2_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7
    return scoring.score_texts(table(spark, sf_dir, "documents"), held_out=fold == 2)


def op3_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans, _ = private.detect(table(spark, sf_dir, "documents"))
    base = [(k.name, F.col(f"__{k.name}")) for k in private.KINDS]
    return spans.select(
        "doc_id",
        *[F.size(c).cast("long").alias(f"n_{name}") for name, c in base],
        F.sha2(private.span_text(base), 256).alias("base_sha256"),
        private.span_text([*base, ("id", F.col("__id"))]).alias("spans"),
    )


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 100 == 0)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    shown = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("\n"), F.lit("</p><p>"))
    figure = F.concat(F.lit('<figure><img src="sha256:'), F.sha2("text", 256), F.lit('" alt=""><figcaption>'), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("</figcaption></figure>"))
    pages = docs.select("doc_id", "n_bytes", F.concat(F.lit("<article><p>"), shown, F.lit("</p>"), figure, F.lit("</article>")).alias("html"))
    items = media.interleave(pages, id_col="doc_id", html_col="html", carry=("n_bytes",))
    texts = F.filter("items", lambda x: x["kind"] == "text")
    shown_chars = F.aggregate(texts, F.lit(0).cast("long"), lambda n, x: n + F.length(x["text"]))
    references = items.select("doc_id", "n_bytes", F.size(texts).alias("text_items"), shown_chars.alias("text_chars"), F.filter("items", lambda x: x["kind"] != "text").alias("items"))
    store = media.store_payloads(docs.select(F.col("text").cast("binary").alias("payload")), payload_col="payload")
    features = media.store_features(store)
    common.release(store)
    return media.resolve(references, features).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption", "text_items", "text_chars"
    )


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(table(spark, sf_dir, "documents"), model=vocabulary("piece_bpe_32k.model"), seed=17, dropout=0.1)
    return encoded.select("doc_id", "n_bytes", F.size("ids").cast("long").alias("n_pieces"), F.crc32(F.array_join("ids", ",").cast("binary")).alias("ids_crc32"), "lossless")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), rules=URL_RULES)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    scored = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn_from=fold != 0)
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    )
    return sharding.assign_shards(docs, key="doc_id", shards=SHARDS, carry=("size", "text_crc32")).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op11_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.encode_documents(table(spark, sf_dir, "documents"), vocabulary=vocabulary("byte_bpe_50k.json"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    tampered = F.when(changed, F.sha2(merkle.leaf_text(columns, n_chars=F.col("n_chars") + 1), 256))
    docs = table(spark, sf_dir, "documents")
    leaves = docs.select("doc_id", "lang", F.sha2(merkle.leaf_text(columns), 256).alias("leaf"), tampered.alias("claimed"))
    proofs = merkle.manifest(leaves, order_col="doc_id", group_col="lang", leaf_col="leaf", carry=("claimed",))
    return merkle.verify(proofs, claimed_col="claimed")


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", label), is_anchor=F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_scoring": op2_scoring,
    "op3_private": op3_private,
    "op4_topk": op4_topk,
    "op5_media": op5_media,
    "op6_pieces": op6_pieces,
    "op7_simhash": op7_simhash,
    "op8_urls": op8_urls,
    "op9_quality": op9_quality,
    "op10_sharding": op10_sharding,
    "op11_ids": op11_ids,
    "op12_merkle": op12_merkle,
    "op13_negatives": op13_negatives,
}

_PART = "CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR) END"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_PART.format(c=c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


#: Nodes and paths grow level by level; a path keeps its side beside each sibling, so that a fold needs no places.
_MERKLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, n_chars, {_leaf_sql("n_chars")} AS leaf, {_leaf_sql("(n_chars + 1)")} AS changed,
    list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
      lambda a, b: CASE WHEN xor(a, b) % 2 = 1 THEN xor(xor(a, b) >> 1, 3988292384) ELSE xor(a, b) >> 1 END) AS state FROM documents),
leaves AS (SELECT *, n_chars IS NOT NULL AND doc_id IS NOT NULL AND xor(state, 4294967295) % 7 = 0 AS tampered, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS total FROM d),
low AS (SELECT lang, 0 AS level, pos, total, leaf AS digest FROM leaves UNION ALL
  SELECT lang, level + 1, pos // 2, (any_value(total) + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM low WHERE total > 1 GROUP BY lang, level, pos // 2),
subroots AS (SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS total FROM low WHERE total = 1),
high AS (SELECT 0 AS level, pos, total, digest FROM subroots UNION ALL
  SELECT level + 1, pos // 2, (any_value(total) + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM high WHERE total > 1 GROUP BY level, pos // 2),
walk AS (SELECT doc_id, lang, leaf, 0 AS phase, 0 AS level, pos, total, CASE WHEN tampered THEN changed ELSE leaf END AS folded, '' AS proof FROM leaves UNION ALL
  SELECT w.doc_id, w.lang, w.leaf, CASE WHEN w.total = 1 THEN 1 ELSE w.phase END, CASE WHEN w.total = 1 THEN 0 ELSE w.level + 1 END,
    CASE WHEN w.total = 1 THEN s.pos ELSE w.pos // 2 END, CASE WHEN w.total = 1 THEN s.total ELSE (w.total + 1) // 2 END,
    CASE WHEN w.total = 1 THEN w.folded WHEN w.pos % 2 = 1 THEN sha256(coalesce(n.digest, h.digest) || w.folded) ELSE sha256(w.folded || coalesce(n.digest, h.digest, '')) END,
    w.proof || CASE WHEN w.total = 1 THEN '' ELSE coalesce(n.digest, h.digest, '') END
  FROM walk w LEFT JOIN low n ON w.phase = 0 AND w.total > 1 AND n.lang IS NOT DISTINCT FROM w.lang AND n.level = w.level AND n.pos = xor(w.pos, 1)
  LEFT JOIN high h ON w.phase = 1 AND h.level = w.level AND h.pos = xor(w.pos, 1) LEFT JOIN subroots s ON s.lang IS NOT DISTINCT FROM w.lang
  WHERE w.phase = 0 OR w.total > 1)
SELECT w.doc_id, w.leaf, s.digest AS subroot, r.digest AS root, sha256(w.proof) AS proof_sha256, w.folded AS folded_root, w.folded = r.digest AS verified
FROM walk w JOIN subroots s ON s.lang IS NOT DISTINCT FROM w.lang CROSS JOIN (SELECT digest FROM high WHERE total = 1) r WHERE w.phase = 1 AND w.total = 1
"""

ORACLE: dict[str, str] = {
    "op4_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op12_merkle": _MERKLE,
    "op13_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same) WHERE n <= 5),
r AS (SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT * FROM r WHERE rank <= 3
""",
}
