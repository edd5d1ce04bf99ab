import corpus_pipeline


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, n = docs.columns, docs.count()
    counts = []
    from sparkbags.llm.common import settle

    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = settle(stage(spark, docs, d))
        assert docs.columns == columns
        counts.append(docs.count())
    assert n > counts[0] > counts[1] == counts[2] >= counts[3] > 0
    last = corpus_pipeline.run(spark, d)
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in docs.collect()}


def test_rows_with_null_and_repeated_ids(spark):
    """Each row is cut and dropped for its own text."""
    import random

    r = random.Random(7)
    words = lambda n: " ".join("".join(r.choices("abcdefghij", k=7)) for _ in range(n))
    d = "/root/testdata/sf0.001"
    leak = spark.read.parquet(f"{d}/benchmark.parquet").where("text is not null").first().text
    same = words(60)
    texts = [(None, f"{words(30)} {same} {words(30)}"), (None, f"{words(40)} {same} {words(20)}"), (4, words(50)), (4, f"{words(5)} {leak} {words(5)}"), (None, f"{words(9)} {leak} {words(3)}"), (None, words(50))]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in texts], "doc_id long, text string, n_chars long")
    cut = corpus_pipeline.cut_repeated_strings(spark, docs.limit(2), d).collect()
    assert len(cut) == 2 and sum(len(x.text) for x in cut) < sum(len(t) for _, t in texts[:2]) and all(x.n_chars == len(x.text) for x in cut)
    got = corpus_pipeline.drop_contaminated(spark, docs, d).collect()
    assert sorted((str(x.doc_id), x.text) for x in got) == sorted((str(i), t) for i, t in texts if leak not in t)
    near = corpus_pipeline.drop_near_duplicates(spark, docs.union(docs.limit(1)), d).collect()
    assert sorted((str(x.doc_id), x.text) for x in near) == sorted((str(i), t) for i, t in texts)
