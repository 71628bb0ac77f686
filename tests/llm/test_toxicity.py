import zlib

import numpy as np
import pyarrow as pa
import pytest

from tracelight.llm import queries as Q
from tracelight.llm import toxicity as T

SF = "/root/testdata/sf0.01"


def test_held_out_documents(spark):
    """Labels of a fifth of the ids are never learnt from; there the model must hold."""
    rows = Q.op11_toxicity(spark, SF).toPandas()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == 1000 and rows.score.between(0, 1).all()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all()
    assert (rows.predicted == (rows.score >= 0.5)).all()
    rows["toxic"] = rows.doc_id.map(labels)
    held = rows[rows.held_out & rows.toxic.notna()]
    assert held[held.toxic == 1].predicted.mean() > 0.9
    assert held[held.toxic == 0].predicted.mean() < 0.02


@pytest.mark.parametrize("sf", ["sf0.1"])
def test_held_out_documents_of_all_languages(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = Q.op11_toxicity(spark, path).filter("held_out").toPandas()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    rows["toxic"] = rows.doc_id.map(labels)
    assert rows[rows.toxic == 1].predicted.mean() > 0.9
    assert rows[rows.toxic == 0].predicted.mean() < 0.005


@pytest.fixture(scope="module")
def biased(spark):
    """Toxic texts that mostly name one group, and neutral ones that name the other."""
    rng = np.random.default_rng(7)
    filler = [f"wort{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 4 == 0
        text = list(rng.choice(filler, 20))
        if toxic:
            text[3] = str(rng.choice(["moron", "scum"])) if rng.random() < 0.6 else text[3]
            text[7] = "muslims"
        elif rng.random() < 0.3:
            text[7] = "christians"
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    for i in range(1200, 1300):
        text = list(rng.choice(filler, 20))
        text[5] = "muslims"
        rows.append((i, " ".join(text)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_neutral_mentions_of_a_group(biased):
    docs, labels = biased

    def neutral(weight):
        scored = T.judge_toxicity(docs, labels, counterfactual=weight)
        return [r.score for r in scored.filter("doc_id >= 1200").collect()]

    free, fair = neutral(0.0), neutral(T.COUNTERFACTUAL)
    assert np.mean(np.array(free) >= 0.5) > 0.9
    assert np.mean(np.array(fair) >= 0.5) < 0.2  # four tenths of the toxic texts have no other mark than the group
    clear = T.judge_toxicity(docs, labels).filter("doc_id < 1200 and doc_id % 4 = 0").join(docs, "doc_id")
    assert all(r.predicted == 1 for r in clear.filter("text like '%moron%' or text like '%scum%'").collect())


def test_swapped_texts_score_alike(biased):
    docs, labels = biased
    model = T.fit_toxicity(docs, labels)
    pair = docs.sparkSession.createDataFrame([(1, "the muslims of wort1"), (2, "the christians of wort1")], "doc_id long, text string")
    a, b = (r.score for r in T.judge_toxicity(pair, labels, model=model).orderBy("doc_id").collect())
    assert abs(a - b) < 0.1


def test_swaps():
    swaps = T.Swaps((("black", "white"), ("a1", "b1", "c1")))
    words, size = T.distinct_words(pa.array(["Black c1 x x", "nothing", None, "white a1 b1"]))
    assert size.tolist() == [4, 1, 0, 3] and sorted(words.times.tolist()) == [1] * 6 + [2]
    swapped = swaps.apply(words)
    said = sorted((int(d), swapped.data[s:e].tobytes().decode()) for d, s, e in zip(swapped.doc, swapped.start, swapped.end, strict=True))
    assert said == [(0, "a1"), (0, "white"), (0, "x"), (3, "b1"), (3, "black"), (3, "c1")]
    again, _ = T.distinct_words(pa.array(["white a1 x x"]))
    assert set(T.features_of(again)[1]) == set(T.features_of(swapped)[1][T.features_of(swapped)[0] == 0])


def test_minimum_of_a_known_function():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(30, 30))
    a = a @ a.T + np.eye(30)
    b = rng.normal(size=30)
    x = T._minimum(lambda v: (float(v @ a @ v / 2 - b @ v), a @ v - b), 30, 1e-6)
    assert np.abs(x - np.linalg.solve(a, b)).max() < 1e-4


def test_odd_rows(spark, frame, odd):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    wide = frame(odd).withColumnRenamed("h", "score").withColumnRenamed("rid", "a.b")
    rows = T.judge_toxicity(wide, labels).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in odd)
    blank = {r.score for r in rows if r.doc_id in (9001, 9002, 9003)}
    assert len(blank) == 1 and blank.pop() < 0.5
    assert {r.held_out for r in rows if r.doc_id is None} == {False}
    assert T.judge_toxicity(frame([]), labels).count() == 0
    assert {r.score for r in T.judge_toxicity(frame(odd), labels.limit(0)).collect()} == {0.0}
    odd_labels = spark.createDataFrame([(1, 1, None), (None, 0, 1), (2, 1, 7)], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in T.judge_toxicity(frame(odd), odd_labels).collect()} == {0}


@pytest.mark.parametrize("texts", [["unheard of"], [""], [None, "unheard", " "]])
def test_blocks_without_features_of_the_model(spark, texts):
    model = T.Model(np.array([5, 7], np.uint64), np.array([1.0, -1.0]), -2.0, 0.5, 0.25)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    got = {r.doc_id: r.score for r in T.judge_toxicity(docs, labels, model=model).collect()}
    size = [len((t or "").split()) for t in texts]
    want = [1 / (1 + np.exp(2 * np.log1p(n) / 5 - 0.5)) if n else 0.25 for n in size]
    assert got == pytest.approx(dict(enumerate(want)), abs=1e-8)


def test_fit_of_texts_without_features(spark):
    """No feature occurs in three texts, so length and bias are all there is to learn."""
    rows = [(i, f"w{i}a" + f" w{i}b" * (i % 3)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    scores = [r.score for r in T.judge_toxicity(docs, labels).collect()]
    assert len(scores) == 40 and all(0 < s < 1 for s in scores)


def test_long_texts_in_parts(spark, biased, monkeypatch):
    docs, labels = biased
    model = T.fit_toxicity(docs, labels)
    text = "wort1 moron wort2 scum muslims " * 50
    one = spark.createDataFrame([(1, text)], "doc_id long, text string")
    whole = T.judge_toxicity(one, labels, model=model).first().score
    monkeypatch.setattr(T, "_SPAN", 40)
    parts = list(T._spans(pa.record_batch({"text": [text]})))
    assert len(parts) > 30 and "".join(t[0].as_py() for _, t in parts) == text
    block = pa.record_batch({"row": [{"id": 1}], "text": [text]})
    found = next(T._scores(model)(iter([block])))
    assert abs(found.column("score")[0].as_py() - whole) < 1e-6
