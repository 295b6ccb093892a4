"""The pipeline against plain Python, stage by stage."""

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from stereolith.llm import common, packing, quality, queries

from .helpers import documents, prose
from .test_operators import plain_components, plain_fingerprint, plain_spans


def test_pipeline(spark, tmp_path):
    good = [prose(80, i) for i in range(120)]
    bad = [" ".join(w + "&&&" for w in prose(80, i).split()) for i in range(120)]
    private = [prose(60, 500 + i) + f" write to a{i}@b.org or +1 (509) 555-69{i:02d} now" for i in range(20)]
    texts = [*good, *bad, *good[:10], *private, None, ""]
    docs = documents(spark, list(enumerate(texts))).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(not 120 <= i < 240), 0) for i in range(270)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        kept.append({r.doc_id: r.text for r in now.collect()})

    quality, unique, masked = kept
    assert sum(120 <= i < 240 for i in quality) <= 2 and sum(not 120 <= i < 240 for i in quality) >= 148
    rows = [(i, plain_fingerprint(t or "")) for i, t in sorted(quality.items())]
    roots = plain_components(rows)
    assert set(unique) == {roots[n] for n in range(len(rows))}
    for i, t in unique.items():
        assert (masked[i] == t) == (not plain_spans(t or ""))
        assert plain_spans(masked[i] or "") == ""

    result = corpus_pipeline.run(spark, str(tmp_path))
    again = packing.pack(now, vocabulary=queries.vocabulary("byte_bpe_50k.json"))
    assert result.columns == again.columns
    pick = ("doc_id", "start", "length", "doc_tokens")
    whole = lambda df: sorted(df.groupBy("doc_id").agg(F.sum("length"), F.max("doc_tokens")).collect())
    assert whole(result) == whole(again) and set(pick) <= set(result.columns)
    assert {r.doc_id for r in result.collect()} == set(unique)


def test_arrow_batches_are_bounded_in_bytes(spark):
    """A batch of long texts takes megabytes, not tens of them; a size that the session has set stays."""
    session = spark.newSession()
    docs = session.createDataFrame([(i, "word " * 50_000) for i in range(60)], "doc_id long, text string").coalesce(1)
    labels = session.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")

    def sizes(batches):
        yield pa.RecordBatch.from_pydict({"n": [max(b.nbytes for b in batches)]})

    quality.score_quality(docs, labels)
    assert docs.mapInArrow(sizes, "n long").first().n < 5 << 20
    session.conf.set(common.BATCHES, "123456")
    common.small_batches(session)
    assert session.conf.get(common.BATCHES).startswith("123456")
