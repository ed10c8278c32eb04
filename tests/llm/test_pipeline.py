import hashlib

from pyspark.sql import functions as F

import corpus_pipeline
from mapforge.llm import bpe, rules

from .cases import frame, messy, texts
from .test_digests import linked, plain_simhash

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((repr(tuple(r)) for r in df.select("doc_id", "text").collect()))


def test_quality_stage(spark):
    rows = messy(texts())
    df = frame(spark, rows).withColumns({"n_words": F.lit(1), "failed": F.lit("x")})
    out = corpus_pipeline.quality_rules(spark, df, SF)
    assert out.columns == df.columns
    judged = {r.doc_id: r.kept for r in rules.judged(frame(spark, texts())).collect()}
    assert rows_of(out.where("doc_id is not null").distinct()) == sorted(repr((i, t)) for i, t in texts() if judged[i])


def test_near_stage_keeps_one_of_each_group(spark):
    rows = messy(texts(n=120))
    df = frame(spark, rows).withColumn("th", F.lit(1))
    out = corpus_pipeline.near_dedup(spark, df, SF)
    assert out.columns == df.columns
    fps = [plain_simhash(t) for _, t in rows]
    root = linked(fps)
    want = {}
    for (i, t), f in zip(rows, fps):
        want[root[f]] = min(want.get(root[f], 1 << 63), 1 << 63 if i is None else i)
    got = [1 << 63 if r.doc_id is None else r.doc_id for r in out.collect()]
    assert sorted(got) == sorted(want.values())


def test_stages_hold_together(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.schema.simpleString() == docs.schema.simpleString(), name
        assert 0 < after.count() <= before.count()
        assert after.join(before, "doc_id", "left_anti").count() == 0
        before = after
    texts_ = {r.doc_id: r.text for r in before.collect()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(texts_)
    b = bpe.Bpe(*bpe.default_vocabulary())
    for i, t in texts_.items():
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        assert b"".join(x.to_bytes(4, "little") for x in got[i].ids) == b.encode_batch([t])[0]


def test_clean_documents_stay(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(labels.where("quality = 1 and toxic = 0"), "doc_id", "left_semi")
    long = docs.where(F.size(F.split("text", " ")) > 60)
    assert corpus_pipeline.quality_rules(spark, long, SF).count() > 0.95 * long.count()


def test_empty_documents(spark):
    df = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df, SF).count() == 0
