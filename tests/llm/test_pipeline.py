import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from termweave.llm import decontaminate, factorization, fair_mix, ngram_join

SF = "/root/testdata/sf0.001"


def test_stages_against_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in cp.STAGES]
    assert len(names) == 5
    stage = dict(cp.STAGES)

    good = stage["quality classifier"](spark, docs, SF).cache()
    scores = factorization.score(docs, cp.quality_model(spark, SF, docs)).where(F.col("score") >= cp.GOOD)
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in scores.collect())

    single = stage["n-gram Jaccard join"](spark, good, SF).cache()
    groups = ngram_join.jaccard_components(good, 5, 80).collect()
    assert sorted(r.doc_id for r in single.collect()) == sorted({r.component_id for r in groups})

    clean = stage["benchmark decontamination"](spark, single, SF).cache()
    hits = decontaminate.best_matches(single, spark.read.parquet(f"{SF}/benchmark.parquet")).where("item_id IS NOT NULL")
    dirty = {r.doc_id for r in hits.collect()}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in single.collect() if r.doc_id not in dirty)

    mixed = stage["mixing sources to target weights"](spark, clean, SF).cache()
    times = {r.doc_id: r.taken // r["size"] for r in fair_mix.taken(clean).collect() if r["size"]}
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(d for d, n in times.items() for _ in range(n))
    for frame in (good, single, clean, mixed):
        assert frame.columns == columns

    texts = sorted((r.doc_id, r.text or "") for r in mixed.collect())
    t = Tokenizer.from_file(public_tokenizers.path(cp.VOCABULARY))
    start, want = 0, []
    for doc, e in zip([d for d, _ in texts], t.encode_batch([x for _, x in texts], add_special_tokens=False)):
        data = np.asarray([*e.ids, cp.END_ID], "<u4").tobytes()
        want.append((doc, start, len(data) // 4, zlib.crc32(data)))
        start += len(data) // 4
    got = sorted((tuple(r) for r in stage["token-ID / binary output"](spark, mixed, SF).collect()), key=lambda r: r[1])
    assert got == want


def test_run(spark):
    assert cp.ORACLE_SQL is None
    assert cp.run(spark, SF).count() > 0


def test_no_documents(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
