"""SC-19 by dictionary: the same skills as probe by probe, also where one string is most of the rows."""

import pytest

from gapmatch.operators import extract as X
from gapmatch.operators import normalize as N
from gapmatch.plans import skew

RAW = ["ML", "ml,", " Machine-Learning ", "node js", "node.js", "ci/cd", "CI-CD", "", "   ", "...", None, "é", "(Python)", "a-b.c/d"]
ALIASES = [("ml", "machine learning"), ("machine learning", "machine learning"), ("node js", "node.js"), ("ci cd", "ci/cd"),
           ("a b.c/d", "hyphen first"), ("a-b c d", "dots later")]


@pytest.mark.parametrize("spread", [10_000, 3])
def test_dictionary_equals_probe_by_probe(spark, monkeypatch, spread):
    monkeypatch.setattr(skew, "SPREAD", spread)
    rows = [(k % 5, k, RAW[k % len(RAW)]) for k in range(70)] + [(9, 100 + k, "ML") for k in range(50)]
    raw = spark.createDataFrame(rows, "resume_id long, pos long, raw string").repartition(3)
    al = spark.createDataFrame(ALIASES, "alias string, canonical string")
    key = lambda df: sorted((r["resume_id"], r["pos"], r["raw"] or "", r["skill"] or "") for r in df.collect())
    got = N.normalize_by_dictionary(raw, al)
    assert got.count() == len(rows)
    assert key(got.filter("raw is not null")) == key(X.normalize(raw, al).filter("raw is not null"))
    assert got.filter("raw is null and skill is not null").count() == 0


def test_dictionary_counts_and_first_probe(spark):
    raw = spark.createDataFrame([("a-b.c/d",), ("ML",), ("ML",), (None,)], "raw string")
    al = spark.createDataFrame(ALIASES, "alias string, canonical string")
    got = {r["raw"]: (r["skill"], r["n"]) for r in N.skill_dictionary(raw, al).collect()}
    assert got == {"a-b.c/d": ("hyphen first", 1), "ML": ("machine learning", 2)}


def test_lists_of_nothing(spark):
    raw = spark.createDataFrame([(1, 0, None), (1, 1, ".")], "resume_id long, pos long, raw string")
    al = spark.createDataFrame(ALIASES, "alias string, canonical string")
    assert [tuple(r) for r in N.normalize_skill_list(raw, al).collect()] == [(1, 2, 0, [])]
    assert N.normalize_skill_list(raw.limit(0), al).collect() == []
