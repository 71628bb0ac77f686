import brute

import corpus_pipeline as P

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    languages = {r.doc_id: r.lang for r in docs.collect()}
    passed = [docs]
    for _, stage in P.STAGES:
        passed.append(stage(spark, passed[-1], SF).cache())
    language, near, clean, mixed, shards = passed[1:]
    assert all(df.columns == columns for df in passed[:-1])
    assert {r.doc_id: r.lang for r in language.collect()} == languages  # all documents have letters
    before = [(r.doc_id, r.text) for r in language.collect()]
    assert {r.doc_id for r in near.collect()} == {c for _, _, c in brute.linked(before)}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute.passages([(r.doc_id, r.text) for r in near.collect()], items) if r[-1]}
    assert bad and {r.doc_id for r in clean.collect()} == {r.doc_id for r in near.collect()} - bad
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in clean.collect()}
    assert sorted(r.doc_id for r in shards.collect()) == sorted(r.doc_id for r in mixed.collect())
    whole = P.run(spark, SF)
    assert sorted(map(str, whole.collect())) == sorted(map(str, shards.collect()))


def test_columns_with_dots(spark, frame, odd):
    docs = frame(odd[:25]).select("doc_id", "text", "lang", "source", "n_chars", "h").withColumnRenamed("h", "a.b")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns[-1] == "a.b" and {r["a.b"] for r in docs.collect()} == {"x"}


def test_odd_rows(spark, frame, odd):
    docs = frame(odd).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF).cache()
        assert docs.count() > 0
    empty = frame([]).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in P.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0
