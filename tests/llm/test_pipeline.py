import corpus_pipeline
import __spark_entry__ as entry


def test_pipeline(spark, folder, rows):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert len(corpus_pipeline.STAGES) == 5
    assert 0 not in got  # holds a benchmark item
    assert 200 in got and not {201, 202, 203, 204, 211, 212, 213, 300, 301, 302} & set(got)  # 210 stands for the empty ones
    assert {1, 2, 3, 104} <= set(got)


def test_stages_keep_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumnsRenamed({"source": "key", "lang": "lines"})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_stages_take_an_empty_table(spark, folder, empty):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).collect() == []


def test_entry_lists_all_operators():
    names = list(entry.queries())
    assert all(any(x.startswith(f"op{n}_") for x in names) for n in range(1, 14)) and "pipeline" in names
