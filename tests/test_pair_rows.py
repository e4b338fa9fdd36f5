"""What a pair row decides is decided once, and its lists are not shuffled."""

from pyspark.sql import functions as F

from gapmatch.functions import lookups as L
from gapmatch.operators import evaluate as EVAL
from gapmatch.operators import evidence as EV
from gapmatch.operators import extract as X
from gapmatch.operators import kb as K
from gapmatch.operators import match as M
from gapmatch.operators import recommend as R
from gapmatch.plans.reuse import stored
from gapmatch.sources import fixtures as FX

KB = ("skill_key string, name string, category string, hot_technology boolean, in_demand boolean, "
      "occupations_count bigint, importance_score double")


def _inputs(spark):
    pairs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "resume_id bigint, job_id string")
    held = spark.createDataFrame([(1, "python"), (1, "power bi"), (2, "java")], "resume_id bigint, skill string")
    req = spark.createDataFrame([("a", "python"), ("a", "docker"), ("a", "sql"), ("b", "power  bi")],
                                "job_id string, skill string")
    kb = spark.createDataFrame([("docker", "Docker", "Tools", True, True, 9, 4.0)], KB)
    return M.match_inputs(pairs, held, req), kb


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_assignment_is_made_once_under_explodes_and_filters(spark):
    mi, kb = _inputs(spark)
    f = M.pair_frame(mi)
    folds = _plan(f).count("aggregate(")
    assert _plan(f.select("resume_id", F.inline("assigned"))).count("aggregate(") == folds
    assert _plan(f.select("resume_id", F.posexplode("missing"))).count("aggregate(") == folds
    counted = R.with_priority_counts(M.pair_frame(mi, of_jobs=R.job_levels(mi.required, kb)))
    assert _plan(counted.filter("total_recommended > 0")).count("aggregate(") == folds


def test_priorities_in_the_pair_row_are_those_of_the_table(spark):
    mi, kb = _inputs(spark)
    f = M.pair_frame(mi)
    want = R.priority_summary(R.recommendations(
        f.select("resume_id", "job_id", F.posexplode("missing").alias("pos", "skill")), kb))
    got = R.pair_priorities(M.pair_frame(mi, of_jobs=R.job_items(mi.required, kb)))
    assert got.columns == want.columns
    key = lambda r: (r["resume_id"], r["job_id"])
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


def test_evidence_map_in_the_pair_row_is_the_table(spark):
    mi, _ = _inputs(spark)
    own = spark.createDataFrame([(1, "python", "Skills section")], "resume_id bigint, skill string, evidence string")
    names = EV.display_table(mi.held.select("skill").unionByName(mi.required.select("skill")))
    resumes = EV.evidence_by_resume(own).join(EV.names_by(mi.held, "resume_id", names, "held_names"), "resume_id", "full")
    f = M.pair_frame(mi, resumes=resumes, of_jobs=EV.names_by(mi.required, "job_id", names, "req_names"))
    maps = EV.evidence_map(f).collect()
    got = {(m["resume_id"], m["job_id"], k, v["evidence"], v["display_name"], v["status"])
           for m in maps for k, v in m["skill_evidence_map"].items()}
    table = EV.evidence_table(M.pair_frame(mi), own).collect()
    word = {L.STATUS_EXTRA: "extra", L.STATUS_MATCHED: "matched", L.STATUS_MISSING: "missing"}
    assert got == {(r["resume_id"], r["job_id"], r["skill_key"], r["evidence"], r["skill"], word[r["status"]]) for r in table}


def test_samples_are_not_expanded_for_the_total(spark):
    s = spark.createDataFrame([(1, "d", ["x", "y"], ["x"]), (2, "d", None, ["z"])],
                              "sample_id int, domain string, truth array<string>, predicted array<string>")
    out = EVAL.evaluate_sets(s)
    assert "Expand" not in _plan(out)
    total = out.filter("level = 'total'").first()
    assert (total["tp"], total["fp"], total["fn"], total["sample_id"]) == (1, 1, 1, None)
    assert EVAL.evaluate_sets(s.filter("sample_id > 9")).collect() == []


def test_spans_are_resolved_once(spark):
    sp = spark.createDataFrame([(1, 0, 1, 2, "a b", "s"), (1, 0, 2, 1, "b", "s")],
                               "doc_id int, line_no int, start int, n int, raw string, section string")
    out = X.longest_spans(sp)
    assert [r["raw"] for r in out.collect()] == ["a b"]
    assert _plan(out).count("aggregate(c") <= 1


def test_pairs_are_not_shuffled_by_job_to_meet_few_jobs(spark):
    mi, kb = _inputs(spark)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "6000")  # less than Spark's guess of the joined size
    try:
        jobs = stored(M.job_lists(mi, R.job_items(mi.required, kb)), plain=True)
        f = R.pair_priorities(M.pair_frame(mi, jobs=jobs))
        plan = f._jdf.queryExecution().sparkPlan().toString()
        top = plan[:plan.index("resume_id#", plan.index("LeftOuter"))]
        assert "BroadcastHashJoin [job_id#" in top
        got = f.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    want = R.pair_priorities(M.pair_frame(mi, of_jobs=R.job_items(mi.required, kb))).collect()
    assert sorted(got) == sorted(want) and len(want) == 2


def test_essential_names_are_judged_once_not_in_every_record(spark):
    ess = spark.createDataFrame([("Python Work", 3.0), ("python work", 5.0), (None, 1.0), ("it", 2.0)],
                                "element_name string, data_value double")
    out = K.essential_kb(ess)
    plan = _plan(out)
    assert "regexp_replace" not in plan[plan.rindex("Aggregate [element_name"):]
    assert [(r["skill_key"], r["name"], r["importance_score"]) for r in out.collect()] == [("python work", "Python Work", 5.0)]


def test_software_cells_are_stripped_after_equal_records_are_counted(spark):
    rows = [("s1", " SQL ", "x", "N", "y", "2"), ("s1", " SQL ", "first", "N", "y", "1"), ("s2", "sql", None, "Y", None, "3"),
            ("s2", "sql", "late", "Y", None, None)]
    sw = spark.createDataFrame(rows, "soc_code string, workplace_example string, element_name string, "
                                     "hot_technology string, in_demand string, ord string")
    out = K.software_kb(sw)
    plan = _plan(out)
    assert "regexp_replace" not in plan[plan.rindex("Aggregate [workplace_example"):]
    r = out.first()
    assert (r["name"], r["category"], r["hot_technology"], r["in_demand"], r["occupations_count"], r["soc_codes"]) == (
        "SQL", "first", True, True, 4, ["s1", "s2"])


def _detailed_frames(spark):
    pairs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "a"), (1, "none")], "resume_id bigint, job_id string")
    held = spark.createDataFrame([(1, "cold gear"), (1, "Python"), (1, "sql"), (1, "old gear"), (2, "old rod"), (2, "sql")],
                                 "resume_id bigint, skill string")
    req = spark.createDataFrame([("a", "cold rod"), ("a", "python"), ("a", "docker"), ("b", "sql"), ("b", "old gear")],
                                "job_id string, skill string")
    own = spark.createDataFrame([(1, "python", "Skills section"), (1, "sql", ""), (1, "old gear", None),
                                 (2, "old rod", "Summary section"), (1, None, "x")],
                                "resume_id bigint, skill string, evidence string")
    mi = M.match_inputs(pairs, held, req)
    names = EV.display_table(mi.held.select("skill").unionByName(mi.required.select("skill")))

    def frame(made):
        required = made(EV.detailed(mi.required, "job_id", names))
        return M.pair_frame(mi, jobs=M.job_lists(mi, required=required), held=made(EV.detailed(mi.held, "resume_id", names, own)))

    resumes = EV.evidence_by_resume(own).join(EV.names_by(mi.held, "resume_id", names, "held_names"), "resume_id", "full")
    maps = M.pair_frame(mi, resumes=resumes, of_jobs=EV.names_by(mi.required, "job_id", names, "req_names"))
    return mi, own, frame, maps


def test_evidence_rows_take_names_and_evidence_from_their_places(spark):
    mi, own, frame, _ = _detailed_frames(spark)
    out = EV.evidence_table(frame(lambda d: d))
    top = _plan(out)
    assert "Join" not in top[:top.index("posexplode")]  # no row of a pair and a skill meets another table
    assert "array_intersect" not in top  # status comes from the place in the held list
    want = EV.evidence_table(M.pair_frame(mi), own)
    key = lambda r: (r["resume_id"], r["job_id"], r["pos"])
    got = sorted(out.collect(), key=key)
    assert got == sorted(want.collect(), key=key)
    row = {(r["resume_id"], r["job_id"], r["skill_key"]): r for r in got}
    assert row[1, "a", "python"]["evidence"] == "Skills section" and row[1, "a", "python"]["skill"] == "Python"
    assert row[2, "a", "cold rod"]["evidence"] == "Summary section (fuzzy match 93%)"
    assert row[1, "b", "sql"]["evidence"] == row[1, "b", "old gear"]["evidence"] == L.EVIDENCE_DEFAULT_MATCHED
    assert (2, "a", "old rod") not in row and row[2, "a", "sql"]["pos"] == 4
    assert row[3, "a", "docker"]["status"] == L.STATUS_MISSING and len([r for r in got if r["job_id"] == "none"]) == 4


def test_evidence_map_is_merged_by_keys_and_searches_no_list(spark):
    mi, own, frame, maps = _detailed_frames(spark)
    out = EV.evidence_map(frame(EV.with_entries))
    assert "map_zip_with" in _plan(out) and "array_except" not in _plan(out)
    got = {(m["resume_id"], m["job_id"]): m["skill_evidence_map"] for m in out.collect()}
    assert got == {(m["resume_id"], m["job_id"]): m["skill_evidence_map"] for m in EV.evidence_map(maps).collect()}
    word = {L.STATUS_EXTRA: "extra", L.STATUS_MATCHED: "matched", L.STATUS_MISSING: "missing"}
    flat = {(*p, k, v["evidence"], v["display_name"], v["status"]) for p, m in got.items() for k, v in m.items()}
    assert flat == {(r["resume_id"], r["job_id"], r["skill_key"], r["evidence"], r["skill"], word[r["status"]])
                    for r in EV.evidence_table(M.pair_frame(mi), own).collect()}


def test_purchases_and_evidence_come_from_one_table_of_lines(spark):
    lines = spark.createDataFrame([(1, "Cold gear", "b1", "5-LOW"), (1, "Cold gear", "b1", "1-URGENT"), (1, "sql", "b2", None)],
                                  "resume_id bigint, skill string, job_id string, o_orderpriority string")
    assert sorted(FX.purchases(spark, "/nowhere", lines).collect()) == [(1, "Cold gear", "b1"), (1, "sql", "b2")]
    assert sorted(FX.resume_evidence(spark, "/nowhere", lines).collect()) == [
        (1, "cold gear", "Skills section + Summary section"), (1, "sql", "")]


def test_samples_of_shared_sets_are_compared_without_sorting_them_again(spark):
    rows = [(1, "d", ["b", "a", "b", None], ["c", "a"]), (2, "d", None, ["z"]), (3, "d", ["q"], None), (4, "d", [], [])]
    s = spark.createDataFrame(rows, "sample_id int, domain string, truth array<string>, predicted array<string>")
    out = EVAL.evaluate_sets(s)
    got = {r["sample_id"]: r for r in out.collect()}
    assert tuple(got[1][c] for c in ("tp", "fp", "fn", "tp_skills", "fp_skills", "fn_skills")) == (1, 1, 2, "a", "c", "b")
    assert (got[None]["tp"], got[None]["fp"], got[None]["fn"]) == (1, 2, 3)
    ready = s.select("sample_id", "domain", EVAL.as_set("truth").alias("truth"), EVAL.as_set("predicted").alias("predicted"))
    lean = EVAL.evaluate_sets(ready.localCheckpoint(), sets=True)
    assert "array_sort" not in _plan(lean) and "array_distinct" not in _plan(lean)
    assert _plan(out).count("array_except") == 2  # the total takes sizes and common skills
    assert sorted(lean.collect(), key=str) == sorted(out.collect(), key=str)


def test_held_skills_are_not_shuffled_by_skill_to_meet_few_similar_ones(spark):
    pairs = spark.createDataFrame([(1, "a"), (2, "a")], "resume_id bigint, job_id string")
    held = spark.createDataFrame([(1, "old rod"), (1, "sql"), (2, "sql")], "resume_id bigint, skill string")
    req = spark.createDataFrame([("a", "cold rod"), ("a", "python")], "job_id string, skill string")
    mi = M.match_inputs(pairs, held, req)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "6000")
    try:
        f = M.pair_frame(mi, near=stored(M.near_skills(mi), plain=True))
        assert "BroadcastHashJoin [skill#" in f._jdf.queryExecution().sparkPlan().toString()
        got = f.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sorted(got) == sorted(M.pair_frame(mi).collect())
    assert [(r["resume_id"], a["req"], a["held"]) for r in got for a in r["assigned"]] == [(1, "cold rod", "old rod")]
