"""KB build (PL-05), alias map, recommendations (PL-04) and file round trips."""

import json
import os

from pyspark.sql import functions as F

from gapmatch.functions import lookups as L
from gapmatch.operators import kb as K
from gapmatch.operators import recommend as R
from gapmatch.operators.evaluate import evaluate
from gapmatch.sources import readers as RD

SW = """O*NET-SOC Code,Title,Workplace Example,Element ID,Element Name,Hot Technology,In Demand
11-1,CEO,Python,E1,Programming,Y,N
11-2,CTO,python,E1,Languages,N,Y
11-1,CEO,python,E1,Programming,N,N
11-3,Dev,,E2,Tools,N,N
11-3,Dev,nan,E2,Tools,N,N
11-3,Dev,data,E2,Tools,Y,Y
11-4,Ops,Node.js,E3,Runtimes,N,N
"""
ESS = """O*NET-SOC Code,Title,Element Name,Data Value
1,a,Critical Thinking,4
1,a,critical thinking,2
2,b,Critical Thinking,5
2,b,Active Listening,3
3,c,Speaking,5
"""


def build(spark, tmp_path):
    (tmp_path / "sw.csv").write_text(SW)
    (tmp_path / "ess.csv").write_text(ESS)
    sw = RD.read_software_csv(spark, str(tmp_path / "sw.csv"))
    ess = RD.read_essential_csv(spark, str(tmp_path / "ess.csv"))
    return K.build_kb(spark, sw, ess)


def test_kb_build(spark, tmp_path):
    kb = {r["skill_key"]: r for r in build(spark, tmp_path).collect()}
    py = kb["python"]
    assert py["name"] == "Python" and py["category"] == "Programming" and py["occupations_count"] == 3
    assert py["hot_technology"] and py["in_demand"] and py["soc_codes"] == ["11-1", "11-2"]
    assert "data" not in kb and "nan" not in kb and "" not in kb
    ct = kb["critical thinking"]          # essential first spelling creates, last sets importance
    assert ct["name"] == "Critical Thinking" and ct["occupations_count"] == 2 and ct["in_demand"] is True
    assert ct["importance_score"] == 2.0
    assert "speaking" not in kb           # single unknown word is not a valid skill
    assert kb["active listening"]["importance_score"] == 3.0
    assert kb["devops"]["name"] == "Devops" and kb["sql"]["name"] == "SQL" and kb["sql"]["occupations_count"] == 10
    assert kb["node.js"]["hot_technology"] is True   # curated flags OR-ed into an existing key


def test_software_rows_keep_path_and_row_order(spark, tmp_path):
    head = SW.splitlines()[0] + "\n"
    for name, skills in (("b.csv", ["Zig", "ada"]), ("a.csv", ["Rust", "go", "lua"])):
        (tmp_path / name).write_text(head + "".join(f"1,t,{s},E,N,N,N\n" for s in skills))
    rows = RD.read_software_csv(spark, str(tmp_path / "*.csv")).orderBy("ord").collect()
    assert [r["workplace_example"] for r in rows] == ["Rust", "go", "lua", "Zig", "ada"]


def test_alias_variants(spark, tmp_path):
    kb = build(spark, tmp_path)
    al = {r["alias"]: r for r in K.alias_map(spark, kb).collect()}
    assert al["node js"]["canonical"] == "node.js" and al["node js"]["source"] == "default"
    assert al["net"]["canonical"] == ".net" and al["net"]["source"] == "generated"
    assert len([a for a in al.values() if a["source"] == "default"]) == len(L.DEFAULT_ALIASES)


def test_kb_json_round_trip(spark, tmp_path):
    kb = build(spark, tmp_path)
    RD.write_kb(kb, str(tmp_path / "kb.parquet"), str(tmp_path / "kb.json"))
    back = RD.read_kb_json(spark, str(tmp_path / "kb.json"))
    assert back.count() == kb.count()
    assert spark.read.parquet(str(tmp_path / "kb.parquet")).count() == kb.count()


def test_alias_json_overrides_defaults(spark, tmp_path):
    p = tmp_path / "aliases.json"
    p.write_text(json.dumps({" ML ": "Machine Learning Ops", "k8": "Kubernetes"}))
    al = {r["alias"]: r["canonical"] for r in RD.read_alias_json(spark, str(p)).collect()}
    assert al["ml"] == "machine learning ops" and al["k8"] == "kubernetes" and al["js"] == "javascript"
    p.write_text(json.dumps({"HOT rod": "a1", "hot rod ": "a2"}))
    assert {r["alias"]: r["canonical"] for r in RD.read_alias_json(spark, str(p)).collect()}["hot rod"] == "a2"
    q = tmp_path / "list.json"
    q.write_text("[1, 2]")
    assert RD.read_alias_json(spark, str(q)).count() == len(L.DEFAULT_ALIASES)


def test_labelled_missing_file_is_empty(spark, tmp_path):
    assert RD.read_labelled(spark, str(tmp_path / "nope.json")).count() == 0
    p = tmp_path / "eval.json"
    p.write_text(json.dumps([{"id": "s1", "domain": "d", "text": "t", "ground_truth_skills": ["python", "sql"]}]))
    assert RD.read_labelled(spark, str(p)).first()["ground_truth_skills"] == ["python", "sql"]


def test_text_files_bad_bytes(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"ok \xff bytes")
    r = RD.read_text_files(spark, str(tmp_path / "a.txt")).first()
    assert r["text"] == "ok � bytes"


def test_recommendation_buckets(spark, tmp_path):
    kb = build(spark, tmp_path)
    missing = spark.createDataFrame([(1, 1, "python"), (1, 1, "docker"), (1, 1, "machine learning"),
                                     (1, 1, "cobol"), (1, 1, "active listening")],
                                    "resume_id long, job_id long, skill string")
    recs = {r["skill_key"]: r for r in R.recommendations(missing, kb).collect()}
    assert recs["cobol"]["priority"] == L.PRIORITY_LOW and recs["cobol"]["skill"] == "Cobol"
    assert recs["cobol"]["category"] == L.DEFAULT_CATEGORY_MISSING
    assert recs["python"]["priority"] == L.PRIORITY_HIGH and recs["python"]["reason"] == L.REASON_HOT_AND_DEMAND
    assert recs["active listening"]["priority"] == L.PRIORITY_MEDIUM
    s = R.priority_summary(R.recommendations(missing, kb)).first()
    assert s["total_recommended"] == 5 == s["high_count"] + s["medium_count"] + s["low_count"]


def test_evaluate_micro_average(spark):
    truth = spark.createDataFrame([("a", "d1", "python"), ("a", "d1", "sql"), ("b", "d2", "aws")],
                                  "sample_id string, domain string, skill string")
    pred = spark.createDataFrame([("a", "python"), ("a", "excel"), ("b", "aws")], "sample_id string, skill string")
    rows = {r["sample_id"] or "total": r for r in evaluate(truth, pred).collect()}
    assert (rows["a"]["tp"], rows["a"]["fp"], rows["a"]["fn"]) == (1, 1, 1)
    t = rows["total"]
    assert (t["tp"], t["fp"], t["fn"]) == (2, 1, 1)
    assert abs(t["precision"] - 2 / 3) < 1e-12 and abs(t["jaccard"] - 0.5) < 1e-12


def test_last_of_equal_user_aliases_wins(spark, tmp_path):
    kb = build(spark, tmp_path)
    rows = [(0, "HOT rod", "a1"), (1, "hot rod ", "a2"), (2, "js", "java scripts")]
    extra = spark.createDataFrame(rows, "ord int, alias string, canonical string")
    al = K.alias_map(spark, kb, extra=extra)
    got = {r["alias"]: r["canonical"] for r in al.collect()}
    assert got["hot rod"] == "a2" and got["js"] == "java scripts"
    assert al.count() == len(got)
    from gapmatch.operators.extract import normalize
    raw = spark.createDataFrame([("Hot Rod",)], "raw string")
    assert [r["skill"] for r in normalize(raw, al).collect()] == ["a2"]


def test_recommendation_lists_keep_input_order(spark, tmp_path):
    kb = build(spark, tmp_path)
    missing = spark.createDataFrame([(1, 1, 2, "docker"), (1, 1, 0, "python"), (1, 1, 1, "sql")],
                                    "resume_id long, job_id long, pos int, skill string")
    high = R.priority_summary(R.recommendations(missing, kb)).first()["high_priority"]
    assert [x["skill_key"] for x in high] == ["python", "sql", "docker"] and high[0]["category"] == "Programming"


def test_labelled_set_end_to_end(spark, tmp_path):
    """read_labelled -> normalised truth -> extraction -> evaluation."""
    from gapmatch.operators import extract as X
    p = tmp_path / "set.json"
    p.write_text(json.dumps([
        {"id": "a", "domain": "rail", "text": "Skills\nPython, Docker and some JS", "ground_truth_skills":
         ["python", "JavaScript", "docker"]},
        {"id": "b", "domain": "mail", "text": "nothing to see", "ground_truth_skills": ["ML"]}]))
    s = RD.read_labelled(spark, str(p))
    kb = build(spark, tmp_path)
    al = K.alias_map(spark, kb)
    truth = X.normalize(s.select("id", "domain", F.explode("ground_truth_skills").alias("raw")), al)
    docs = s.select(F.col("id").alias("doc_id"), "text")
    found = X.extract_skills(docs, kb.select("skill_key"), al).select(F.col("doc_id").alias("id"), "skill")
    rows = {r["id"] or "total": r for r in evaluate(truth, found, keys=("id",)).collect()}
    assert (rows["a"]["tp"], rows["a"]["fn"], rows["b"]["fn"], rows["total"]["tp"]) == (3, 0, 1, 3)
