"""The pipeline's stages, each on what the one before kept."""

import corpus_pipeline
from terrascore.llm.shared import stored


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    texts = [f"the document number {i} talks about topic{i} and matter{i} in words{i} of its{i} own{i} kind{i} today{i}" for i in range(30)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(50, texts[3], "en", "s", 1), (51, None, None, "s", 0), (52, "12 34", "en", "s", 5), (53, "before " + "item text that is long enough to be found by its shingles " * 2 + "after", "en", "s", 9), (54, texts[4] + " mail me@x.org", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, ("item text that is long enough to be found by its shingles " * 2).strip())], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)), name)
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "piece_encoding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    every = set(range(30)) | {50, 51, 52, 53, 54}
    assert set(seen["language_id"]) == every - {51, 52}
    assert set(seen["near_dedup"]) == every - {51, 52, 50} - ({54} if 54 not in seen["near_dedup"] else set())
    assert set(seen["decontaminate"]) == set(seen["near_dedup"]) - {53}
    for d, r in seen["pii"].items():
        assert r.n_chars == len(r.text) and "@" not in r.text and (d == 54 or r.text == texts[d])
    assert set(seen["piece_encoding"]) == set(seen["pii"])
