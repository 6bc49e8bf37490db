"""The corpus pipeline's stages on small documents."""

from __future__ import annotations

import corpus_pipeline

from .helpers import text


def test_stages_take_effect(spark, tmp_path):
    rows = [(i, text(i, 120) + "\nthe same footer", "en", f"s{i % 2}", 0) for i in range(60)]
    rows += [(i, " ".join(w + "###" for w in text(i, 100).split()), "en", "s0", 0) for i in range(100, 140)]
    rows += [(200, rows[3][1], "en", "s1", 0), (201, rows[4][1].replace("footer", "end"), "en", "s1", 0), (202, None, "en", "s0", 0)]
    leak = " ".join(text(7, 120).split()[30:60])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i in [*range(60), *range(100, 140)]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    now = docs
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        now = corpus_pipeline.stage(step(spark, now, d), name)
        seen[name] = now
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == docs.columns
    assert seen["quality_classifier"].filter("doc_id between 100 and 139").count() == 0 and seen["quality_classifier"].filter("doc_id < 60").count() == 60
    assert seen["line_dedup"].filter("text like '%the same footer%'").count() == 0
    kept = {r["doc_id"] for r in seen["simhash_near_dedup"].collect()}
    assert set(range(60)) <= kept and not {200, 201} & kept
    assert {r["doc_id"] for r in seen["benchmark_decontamination"].collect()} == kept - {7}
    packed = seen["best_fit_packing"]
    assert {r["doc_id"] for r in packed.collect()} == kept - {7}
    assert corpus_pipeline.run(spark, d).count() == packed.count()
