"""The corpus pipeline, stage by stage, and the registered queries."""

import corpus_pipeline
from flowloom.llm import decontaminate, jaccard, lines, mixing, queries

SMALL = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SMALL).write.parquet(path)
        done = spark.read.parquet(path)
        if name != "mixing":
            assert done.columns == columns and {f.dataType for f in done.schema} == {f.dataType for f in docs.schema}
        if name == "toxicity":
            assert 0.7 * before < done.count() < before
        if name == "line_dedup":
            # Whole copies keep no line and go; what was empty stays.
            words = r"text rlike '[^\\x20\\x09-\\x0D]'"
            lost = lines.digest(docs).filter("n_lines > n_dropped").count()
            assert lost <= done.count() <= docs.count() and done.filter("n_chars <> length(text)").count() == 0
            bare = docs.filter(f"text is null or not ({words})").count()
            assert done.filter(f"text is null or not ({words})").count() == bare
            assert lines.digest(done).filter("n_dropped > 0").count() == 0
        if name == "ngram_jaccard":
            found = jaccard.digest(docs)
            assert done.count() == found.filter("n_shingles = 0 or doc_id = component_id").count()
            assert jaccard.digest(done).filter("n_shingles > 0 and doc_id <> component_id").count() == 0
        if name == "decontaminate":
            bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
            bad = decontaminate.judge(docs, bench).filter("contaminated")
            assert done.count() == docs.count() - bad.count()
            assert decontaminate.judge(done, bench).filter("contaminated").count() == 0
        if name == "mixing":
            assert done.count() == docs.count()
            assert done.filter("taken > 3 * size").count() == 0
        docs = done


def test_run_is_all_stages(spark):
    done = corpus_pipeline.run(spark, SMALL)
    assert done.columns == mixing.mix(spark.read.parquet(f"{SMALL}/documents.parquet")).columns
    assert 0 < done.count() < 200


def test_copies_of_a_text_end_as_one_row(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = "A first line of some length here.\nA second line that is long enough too.\nThird line, as long as the others."
    rows = [(i, text, "en", "s", len(text)) for i in range(6)] + [(6, "Words of its own, and quite a few of them at that.", "en", "s", 50)]
    rows += [(7, "", "en", "s", 0), (8, None, "en", "s", None), (9, "short\n" + text, "en", "s", len(text) + 6)]
    docs = spark.createDataFrame(rows, schema)
    done = corpus_pipeline.line_dedup_stage(spark, docs, SMALL)
    assert sorted(r.doc_id for r in done.collect()) == [0, 6, 7, 8, 9]
    assert {r.doc_id: r.text for r in done.collect()}[9] == "short"
    kept = corpus_pipeline.near_duplicate_stage(spark, done, SMALL)
    assert sum(r.text == text for r in kept.collect()) == 1
