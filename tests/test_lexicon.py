"""SC-04: base forms induced from the documents."""

import pytest

from gapmatch.operators import lexicon as LX

BASES = ["model", "cluster", "vector", "table", "query"]


@pytest.fixture(scope="module")
def docs(spark):
    plural = {"query": "queries"}
    rows = [(k, f"the {b} and {plural.get(b, b + 's')} of {b}") for k, b in enumerate(BASES)]
    rows += [(10 + k, f"a {b} with {b[:-1]}ies") for k, b in enumerate(["city", "party", "story", "study"])]
    # chance relations: one base of a paradigm of its own
    rows += [(20, "a wolf, wolves; an odd pass, passes"), (21, None), (22, ""), (23, "glass bus thesis")]
    # two rules lead to bases: the more frequent is right
    rows += [(30, "maxe maxe maxe max maxes maxs maxes"), (31, "box boxe boxes boxs box box boxes")]
    rows += [(40 + k, f"{w} {w}s {w[:-1]}es") for k, w in enumerate(["luxe", "fixe", "mixe"])]
    rows += [(50 + k, f"run{c}x run{c}xs run{c}xes") for k, c in enumerate("abcde")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()


def test_supported_paradigms_are_the_lexicon(docs):
    lex = LX.induce_lexicon(docs)
    words = {r["term"]: r["paradigm"] for r in lex.words.collect()}
    assert {"query", "city", "party", "story", "study"} <= set(words)  # five bases of one paradigm
    assert words["city"] == "ies" and words["runax"] == "s+xes"
    assert "wolf" not in words and "pass" not in words
    every = {r["term"] for r in LX.induce_lexicon(docs, support=1).words.collect()}
    assert {"wolf", "pass", "model"} <= every


def test_exceptions_take_the_most_frequent_base(docs):
    lex = LX.induce_lexicon(docs, support=1)
    got = {r["term"]: r["lemma"] for r in lex.exceptions.collect()}
    assert got["maxes"] == "maxe"
    assert "boxes" not in got  # its most frequent base is also the shortest


def test_lemmas_of_documents(docs):
    out = {r["doc_id"]: r["lemma_text"] for r in LX.induced_lemmas(docs).collect()}
    assert out[4] == "query query query" and out[10] == "city city"
    assert out[21] == out[22] == "" and out[23] == "glass bus thesis"
    assert out[20] == "wolf wolves odd pass passes"  # too few bases show these
    assert len(out) == docs.count()


def test_no_documents(docs):
    assert LX.induced_lemma_text(docs.limit(0)).collect() == []


def test_texts_are_cut_once_for_lexicon_and_lemmas(spark):
    docs = spark.createDataFrame([(1, "Many wolves and dogs"), (2, None)], "doc_id bigint, text string")
    out = LX.induced_lemma_text(docs)
    assert "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r["doc_id"]: r["lemma_chars"] for r in out.collect()} == {1: len("many wolves dogs"), 2: 0}


def test_an_id_that_comes_twice_has_its_lemmas(spark):
    docs = spark.createDataFrame([(1, "Grey wolves"), (1, "Grey wolves"), (2, "wolves")], "doc_id bigint, text string")
    terms = spark.createDataFrame([("wolves", 3), ("wolf", 1), ("grey", 2)], "term string, n bigint")
    lex = LX.Lexicon(spark.createDataFrame([("wolf", "ves")], "term string, paradigm string"),
                     spark.createDataFrame([], "term string, lemma string"), terms)
    got = [(r["doc_id"], r["lemma_text"]) for r in LX.induced_lemmas(docs, lex).collect()]
    assert sorted(got) == [(1, "grey wolf"), (1, "grey wolf"), (2, "wolf")]
