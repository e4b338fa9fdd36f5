"""Scans of quoted CSV and of one JSON object in byte ranges, and their writers."""

import csv
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapmatch.functions import lookups as L
from gapmatch.sources import readers as RD
from gapmatch.sources import scan as S


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows():
    r = random.Random(2)
    texts = [None, "", "plain", "two\nlines", 'a "quoted", text\n\n"" end', "é中😀,\r\nx", "tail\r", "\n", '"', " sp ",
             "long " * 30 + "\n" + 'x"' * 7, "y\n" * 900]
    return [(k, r.choice(texts), r.choice(["a", None, "b,c"])) for k in range(250)]


def test_csv_round_trip_over_many_ranges(spark, tmp_path, small_ranges):
    df = spark.createDataFrame(rows(), 'id long, text string, `na"me, x` string').coalesce(2)
    S.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.text(str(tmp_path / "csv")).rdd.getNumPartitions() > 20
    back = S.read_csv(spark, str(tmp_path / "csv"))
    got = back.orderBy("ord").collect()
    assert [(int(g["id"]), g["text"], g['na"me, x']) for g in got] == rows()


def test_csv_of_another_writer(spark, tmp_path, small_ranges):
    with open(tmp_path / "p.csv", "w", newline="", encoding="utf-8-sig") as f:
        w = csv.writer(f)  # lines end in \r\n, only some fields are quoted
        w.writerow(["id", "text", "c"])
        w.writerows(rows())
        f.write("\r\n\r\n")
    got = S.read_csv(spark, str(tmp_path / "p.csv")).orderBy("ord").collect()
    assert [(int(g["id"]), g["text"] or "", g["c"] or "") for g in got] == [(a, b or "", c or "") for a, b, c in rows()]


def test_csv_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,x\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        S.read_csv(spark, str(tmp_path / "*.csv"))
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(ValueError, match="no header"):
        S.read_csv(spark, str(tmp_path / "e.csv"))
    (tmp_path / "s.csv").write_text("In Demand,Workplace Example\nY,Zig\n,\"\"\n")
    got = RD.read_software_csv(spark, str(tmp_path / "s.csv")).orderBy("ord").collect()
    assert [(g["workplace_example"], g["in_demand"], g["title"]) for g in got] == [("Zig", "Y", None), ("", None, None)]


def thing():
    r = random.Random(3)
    odd = ["a", "x,y", 'q"uo\\te,{[', '\\"', "é中😀", "", "line\nbreak", "," * 300]
    return {f'k{k}, "x" \\ {{': {"v": r.choice(odd), "n": [1, 2, {"a": "},{", "b": [[]]}], "e": {}} for k in range(200)}


@pytest.mark.parametrize("indent", [None, 2])
def test_json_object_over_many_ranges(spark, tmp_path, small_ranges, indent):
    (tmp_path / "o.json").write_text(json.dumps(thing(), indent=indent))
    m = S.json_members(S.json_entries(spark, str(tmp_path / "o.json")), T.StringType())
    got = m.orderBy("offset").collect()
    assert {x["key"]: json.loads(x["value"]) for x in got} == thing()
    assert [x["key"] for x in got] == list(thing())


@pytest.mark.parametrize("text, want", [
    ("[1, 2]", {}), ("{}", {}), ("", {}), (' {"a":1,"b":3,"a":2 , "c" : "x"}\n', {"a": "2", "b": "3", "c": "x"}),
    ('"x,{"', {}), ('{"a": "}", "b": "{"}', {"a": "}", "b": "{"}), ('{"a": {"b": [1, {}]}}', {"a": '{"b":[1,{}]}'})])
def test_json_values_and_repeated_keys(spark, tmp_path, text, want):
    (tmp_path / "x.json").write_text(text)
    m = S.json_members(S.json_entries(spark, str(tmp_path / "x.json")), T.StringType())
    assert {x["key"]: x["value"] for x in m.collect()} == want


def test_json_export_in_parts_and_as_one_file(spark, tmp_path, small_ranges):
    want = {k: json.dumps(v) for k, v in thing().items()}
    df = spark.createDataFrame(list(want.items()), "k string, v string").repartition(3)
    folder, single = tmp_path / "parts", tmp_path / "one.json"
    for _ in range(2):  # an export may be repeated
        S.write_json_object(df, "k", F.col("v"), str(folder), str(single))
        assert json.loads(single.read_text()) == thing()
        manifest = json.loads((folder / "_manifest.json").read_text())
        whole = b""
        for p in manifest["parts"]:
            assert p["offset"] == len(whole)
            whole += (folder / p["part"]).read_bytes()
        assert json.loads(whole) == thing() and manifest["bytes"] == len(whole)
        assert not list(tmp_path.glob("_one*"))
    for path in (folder, single):
        m = S.json_members(S.json_entries(spark, str(path)), T.StringType())
        assert {x["key"]: json.loads(x["value"]) for x in m.collect()} == thing()
    S.write_json_object(df.limit(0), "k", F.col("v"), str(folder), str(single))
    assert json.loads(single.read_text()) == {} and S.json_entries(spark, str(folder)).count() == 0


def test_knowledge_base_and_aliases_as_json(spark, tmp_path):
    kb = spark.createDataFrame([("c++", "C++", None, "software", True, None, 3, ["1", "2"], 0.5)],
                               "skill_key string, name string, category string, skill_type string, hot_technology boolean, "
                               "in_demand boolean, occupations_count long, soc_codes array<string>, importance_score double")
    RD.write_kb(kb, str(tmp_path / "kb"), str(tmp_path / "kbj"), str(tmp_path / "kb.json"))
    assert json.loads((tmp_path / "kb.json").read_text())["c++"]["category"] is None
    assert RD.read_kb_json(spark, str(tmp_path / "kb.json")).collect() == kb.collect()
    al = spark.createDataFrame([('q"x', "a\\b"), ("js", "other")], "alias string, canonical string")
    RD.write_aliases(al, str(tmp_path / "al"), str(tmp_path / "alj"))
    got = {x["alias"]: x["canonical"] for x in RD.read_alias_json(spark, str(tmp_path / "alj")).collect()}
    assert got['q"x'] == "a\\b" and got["js"] == "other" and len(got) == len(L.DEFAULT_ALIASES) + 1
    assert RD.read_alias_json(spark, str(tmp_path / "none.json")).count() == len(L.DEFAULT_ALIASES)
