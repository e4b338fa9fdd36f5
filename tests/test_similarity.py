"""TF-IDF similarity (PL-03): closed form against a direct computation."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from gapmatch.functions import lookups as L
from gapmatch.operators import similarity as SIM
from gapmatch.plans import skew

RES = "Ran night trains: signal relays, brake tests, rail grinding, depot rosters; wrote rail safety notes."
JOB = "Depot wants a hand for signal relays, brake tests, rail grinding, rail safety and depot rosters."


def run(spark, pairs_text, cap=5000):
    r = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs_text)], "id long, text string")
    j = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(pairs_text)], "id long, text string")
    p = spark.createDataFrame([(i, i) for i in range(len(pairs_text))], "resume_id long, job_id long")
    scores, top = SIM.similarity(r, j, p, max_features=cap)
    return {x["resume_id"]: x for x in scores.collect()}, top


def direct(a_terms, b_terms, cap=5000):
    ca, cb = Counter(a_terms), Counter(b_terms)
    vocab = sorted(set(ca) | set(cb), key=lambda t: (-(ca[t] + cb[t]), t))[:cap]
    k = 1 + math.log(1.5)
    wa = {t: ca[t] * (1 if ca[t] and cb[t] else k) for t in vocab}
    wb = {t: cb[t] * (1 if ca[t] and cb[t] else k) for t in vocab}
    na, nb = math.sqrt(sum(v * v for v in wa.values())), math.sqrt(sum(v * v for v in wb.values()))
    if not na or not nb:
        return 0.0
    return sum(wa[t] * wb[t] for t in vocab) / (na * nb)


def terms(text, stops):
    toks = [t for t in re.findall(r"\b\w\w+\b", text.lower()) if t not in stops]
    return toks + [a + " " + b for a, b in zip(toks, toks[1:])]


def test_short_pair_above_40(spark):
    s, top = run(spark, [(RES, JOB)])
    assert s[0]["text_similarity_percentage"] > 40.0
    assert top.count() > 0
    assert s[0]["explanation"].startswith(L.SIMILARITY_PREFIX_MSG)


def test_empty_text(spark):
    s, _ = run(spark, [("", "any vacancy"), ("of the and", "welder")])
    assert s[0]["text_similarity_percentage"] == 0.0 and s[0]["explanation"] == L.SIMILARITY_EMPTY_MSG
    assert s[1]["cosine_similarity_score"] == 0.0


def test_closed_form_matches_direct(spark):
    stops = set(L.VECTORIZER_STOP_WORDS)
    texts = [("alpha beta gamma beta delta", "beta gamma epsilon beta beta"),
             ("one two three four five six", "four five six seven eight"),
             ("zeta zeta zeta eta", "theta iota"),
             ("red blue green red blue red", "red red green yellow blue")]
    for cap in (5000, 3):
        s, _ = run(spark, texts, cap=cap)
        for i, (a, b) in enumerate(texts):
            want = round(direct(terms(a, stops), terms(b, stops), cap), 4)
            assert abs(s[i]["cosine_similarity_score"] - want) < 1e-9, (cap, i, s[i], want)


def test_score_does_not_move_with_other_documents(spark):
    pair = ("models deployed on clusters", "a model deployed on many clusters")
    alone, _ = run(spark, [pair])
    more, _ = run(spark, [pair, ("model cluster", "deploy models"), ("clusters", "cluster")])
    assert alone[0] == more[0]


def test_many_pairs_of_one_document_spread_over_copies(spark, monkeypatch):
    monkeypatch.setattr(skew, "SPREAD", 7)
    texts = {k: f"word{k % 5} signal relays brake{k % 3} tests" for k in range(60)}
    r = spark.createDataFrame(list(texts.items()), "id long, text string")
    j = spark.createDataFrame([(0, "signal word1 relays word2"), (1, "brake1 tests"), (2, None)], "id long, text string")
    pairs = [(k, 0) for k in range(60)] + [(k, 1) for k in range(9)] + [(3, 2), (3, 99), (77, 0), (3, 1)]
    p = spark.createDataFrame(pairs, "resume_id long, job_id long")
    scores, top = SIM.similarity(r, j, p)
    got = {(x["resume_id"], x["job_id"]): x for x in scores.collect()}
    assert scores.count() == len(pairs) and len(got) == len(set(pairs))
    stops = set(L.VECTORIZER_STOP_WORDS)
    job = {0: "signal word1 relays word2", 1: "brake1 tests"}
    for a, b in set(pairs):
        want = direct(terms(texts[a], stops), terms(job[b], stops)) if a in texts and b in job else 0.0
        assert abs(got[a, b]["cosine_similarity_score"] - round(want, 4)) < 1e-9, (a, b)
    assert {(x["resume_id"], x["job_id"]) for x in top.collect()} <= set(pairs)


def test_vectors_of_documents(spark):
    d = spark.createDataFrame([(1, "red blue red"), (2, None), (3, "red"), (4, "red red red")], "id long, text string")
    got = {x["id"]: {t["term"]: t["cnt"] for t in x["v"]} for x in SIM.doc_vectors(d).collect()}
    assert got == {1: {"red": 2, "blue": 1, "red blue": 1, "blue red": 1}, 2: {}, 3: {"red": 1}, 4: {"red": 3, "red red": 2}}


def test_vectors_are_made_once_a_side_and_squares_once_a_document(spark):
    texts = ["alpha beta gamma beta delta", "beta gamma epsilon beta beta", None, "of the", "zeta"]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    p = spark.createDataFrame([(0, 1), (1, 0), (0, 0), (0, 2), (3, 1), (4, 0), (9, 0), (0, 1)], "resume_id long, job_id long")
    scores, _ = SIM.similarity(d, d, p)
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    # two searches for tokens make a vector; counting the pairs of a document makes none
    assert plan.count("regexp_extract_all(") == 4
    got = {(r["resume_id"], r["job_id"]): r for r in scores.collect()}
    stops = set(L.VECTORIZER_STOP_WORDS)
    of = lambda k: terms(texts[k] or "", stops) if k < len(texts) else []
    for a, b in got:
        assert abs(got[a, b]["cosine_similarity_score"] - round(direct(of(a), of(b)), 4)) < 1e-9, (a, b)
        assert got[a, b]["n_shared_terms"] == len(set(of(a)) & set(of(b)))
    assert scores.count() == 8


def test_sums_follow_the_cut_only_where_terms_are_cut(spark):
    d = spark.createDataFrame([(0, "red red blue green"), (1, "red blue blue pink")], "id long, text string")
    p = spark.createDataFrame([(0, 1)], "resume_id long, job_id long")
    # both have red (2, 1), blue (1, 2) and "red blue" (1, 1), each three terms of its own
    all_, cut = (SIM.per_pair(d, d, p, max_features=n).first() for n in (9, 2))
    sums = ("U", "Sr", "Sj", "dot", "r2", "j2", "n_shared")
    assert tuple(all_[c] for c in sums) == (9, 9, 9, 5, 6, 6, 3)
    assert tuple(cut[c] for c in sums) == (2, 5, 5, 4, 5, 5, 2)
    assert [x["term"] for x in cut["top"]] == ["red", "blue"]
