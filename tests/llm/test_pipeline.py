"""The pipeline's stages keep what their operators decide, and the last holds all tokens."""

import corpus_pipeline
from registra.llm import fm_decontamination, quality_rules, simhash_pivots
from registra.llm.common import table, tokenizer_path, written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(written(stage(spark, seen[-1], SF), "test"))
    assert all(x.columns == docs.columns for x in seen[:-1])
    ids = lambda x: {r.doc_id for r in x.select("doc_id").collect()}
    assert ids(seen[1]) == ids(quality_rules.op4_quality_rules(spark, SF).filter("kept"))
    groups = simhash_pivots.near_duplicates(seen[1])
    assert ids(seen[2]) == {r.component_id for r in groups.select("component_id").collect()}
    marked = fm_decontamination.decontaminate(seen[2], table(spark, SF, "benchmark"))
    assert ids(seen[3]) == ids(marked.filter("not contaminated"))
    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(tokenizer_path()), 0
    sizes = sorted(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in seen[4].collect())
    assert sizes == sorted(r.n_tokens for r in seen[5].collect())
    for r in seen[5].orderBy("start").collect():
        assert r.start == start
        start += r.n_tokens
    total = corpus_pipeline.run(spark, SF).agg({"n_tokens": "sum"}).first()[0]
    assert total == start


def test_odd_tables(spark, tmp_path):
    """Null texts, ids and sources, repeated rows, more columns, and a table without rows."""
    import random

    rng = random.Random(3)
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(12)) + "."
    text = lambda: "\n".join(line() for _ in range(8))
    same = text()
    rows = [(1, same, "en", "a", 1), (1, same, "en", "a", 1), (2, same, "en", "b", 1), (None, text(), "en", None, 1), (None, text(), None, None, 1), (3, None, "en", "a", 1), (4, "", "en", "b", 1), (5, text(), "en", "b", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).selectExpr("*", "1 as size", "'x' as n_words").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "zz yy"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {1, None, 5} and all(r.n_tokens > 1 for r in got) and got
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_scratch_is_removed(spark):
    from registra.llm.common import held

    before = len(held())
    out = corpus_pipeline.run(spark, SF)
    assert len(held()) - before <= 1 and out.count() > 0
