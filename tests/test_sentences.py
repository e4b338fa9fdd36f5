"""SC-02: the sentence splitter trained on its own documents."""

import random

import pytest
from pyspark.sql import functions as F

from gapmatch.operators import sentences as S

ODD = [(1000, None), (1001, ""), (1002, "Machine learning is powerful. NLP is explainable! Do you like data?"),
       (1003, 'I met Dr. Smith (of "Acme"). He left... Then J. Lee came at 3. May was fine'),
       (1004, "No mark at all"), (1005, "...\n\n?!"), (1006, "At 3.5 percent, Prof. Brown paused, e.g. the lab. They went on")]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    rows = [(k, " ".join(
        f"{r.choice(['The', 'He', 'She', 'They', 'We'])} {r.choice(['saw', 'met', 'called'])} {r.choice(['Dr.', 'Prof.', 'Mr.'])} "
        f"{r.choice(['Smith', 'Jones', 'Lee', 'Brown', 'Kumar'])} at the {r.choice(['clinic', 'school', 'e.g. the lab'])}"
        f"{r.choice(['.', '!', '?', '.'])}" for _ in range(8))) for k in range(200)]
    return spark.createDataFrame(rows + ODD, "doc_id long, text string").repartition(3).cache()


def test_what_training_learns(docs):
    m = S.train(docs)
    short = {r["w"] for r in m.abbreviations.collect()}
    assert {"dr", "prof", "mr", "e.g"} <= short and not {"clinic", "school", "lab", "smith"} & short
    assert {"he", "she", "they", "we"} <= {r["x"] for r in m.starters.collect()}
    together = {(r["w"], r["x"]) for r in m.collocations.collect()}
    assert ("dr", "smith") in together and ("e.g", "the") in together


def test_sentences(docs):
    out = {r["doc_id"]: r["sentences"] for r in S.split_sentences(docs, S.train(docs)).collect()}
    assert len(out) == 200 + len(ODD)
    assert all(len(out[k]) == 8 for k in range(200))
    assert out[1000] == out[1001] == []
    assert out[1002] == ["Machine learning is powerful.", "NLP is explainable!", "Do you like data?"]
    assert out[1003] == ['I met Dr. Smith (of "Acme").', "He left...", "Then J. Lee came at 3.", "May was fine"]
    assert out[1004] == ["No mark at all"]
    assert out[1005] == ["...", "?!"]
    assert out[1006] == ["At 3.5 percent, Prof. Brown paused, e.g. the lab.", "They went on"]


def test_a_model_of_other_documents(spark, docs):
    other = spark.createDataFrame([("a", "She thanked Mr. Lee. He smiled.")], "id string, text string")
    got = S.split_sentences(other, S.train(docs), "id").first()["sentences"]
    assert got == ["She thanked Mr. Lee.", "He smiled."]


def test_no_documents(spark, docs):
    assert S.trained_sentences(docs.limit(0)).collect() == []
    blank = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert [r["n_sentences"] for r in S.trained_sentences(blank).collect()] == [0, 0]


def test_the_ratio_is_zero_where_a_pair_is_rarer_than_by_chance(spark):
    r = spark.range(1).select(S._ratio(F.lit(100.0), F.lit(50.0), F.lit(40.0), F.lit(1000.0)).alias("often"),
                              S._ratio(F.lit(100.0), F.lit(500.0), F.lit(1.0), F.lit(1000.0)).alias("rarely")).first()
    assert r["often"] > 100 and r["rarely"] == 0


def test_held_periods_cut_the_texts_once(spark):
    docs = spark.createDataFrame([(1, "See Dr. Who. \"J. Doe\" met no. 5. It ended! A.B. x"), (2, None)], "doc_id bigint, text string")
    one = lambda rows, cols: spark.createDataFrame(rows, cols)
    model = S.SentenceModel(one([("dr", 9.0), ("j", 9.0)], "w string, score double"), one([("it", 9.0)], "x string, score double"),
                              one([("no", "##", 9.0)], "w string, x string, score double"))
    held = S.held_periods(docs, model)
    assert held._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert {r["doc_id"]: sorted(r["held"]) for r in held.collect()} == {1: [1, 3]}
