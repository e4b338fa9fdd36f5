"""Files to analysis in one call, with and without a knowledge base."""

import json

import pytest

from gapmatch.functions import lookups as L
from gapmatch.operators import files as FS
from gapmatch.sources import readers as RD

RESUME = "Skills\nPython, SQL and some JS\nExperience\nBuilt models with Docker"
JOB = "Requirements\nPython, SQL, Docker and Java"


@pytest.fixture
def folders(tmp_path):
    for sub, files in (("r", {"a.txt": RESUME.encode(), "b.txt": b"knows \xff Java", "c.PDF": b"%PDF", "e.pdf": b"%PDF", "n.txt": b" "}),
                       ("j", {"job.txt": JOB.encode()})):
        (tmp_path / sub).mkdir()
        for name, data in files.items():
            (tmp_path / sub / name).write_bytes(data)
    return tmp_path


def skills(joined):
    return {x for x in joined.split("|") if x}


def pages(spark):
    return spark.createDataFrame([("c.PDF", 2, "page two Java"), ("c.PDF", 1, "Python"), ("e.pdf", 1, "  "), ("x.pdf", 1, "x")],
                                 "id string, page_no int, text string")


def test_documents_are_routed_by_suffix(spark, folders):
    got = {r["id"]: r for r in FS.read_documents(spark, str(folders / "r"), pages(spark)).collect()}
    assert set(got) == {"a.txt", "b.txt", "c.PDF", "e.pdf", "n.txt"}
    assert got["a.txt"]["text"] == RESUME and got["a.txt"]["status"] == f"Loaded {len(RESUME)} characters."
    assert got["b.txt"]["text"] == "knows � Java" and got["b.txt"]["kind"] == "text"
    assert got["c.PDF"]["text"] == "Python\npage two Java" and got["c.PDF"]["status"] == "Extracted 20 characters from PDF."
    assert (got["e.pdf"]["text"], got["e.pdf"]["status"]) == ("", L.STATUS_NO_TEXT)
    assert (got["n.txt"]["text"], got["n.txt"]["status"]) == (" ", "Loaded 1 characters.")
    bare = {r["id"]: r["status"] for r in FS.read_documents(spark, str(folders / "r")).collect()}
    assert bare["c.PDF"] == L.STATUS_NO_PAGES


def test_files_to_summary_with_the_fallback(spark, folders):
    (folders / "empty.json").write_text("{}")
    for kb in (None, str(folders / "missing.json"), str(folders / "empty.json")):
        a = FS.analyze_files(spark, str(folders / "r"), str(folders / "j"), kb, pages=pages(spark))
        got = {r["resume_id"]: skills(r["matched_skills"]) for r in a.matches.select("resume_id", "matched_skills").collect()}
        assert got["a.txt"] == {"python", "sql", "docker"} and got["c.PDF"] == {"python", "java"}
        assert got["b.txt"] == {"java"} and not got["e.pdf"]
    assert a.summary.count() == 5
    assert {r["skill_key"] for r in a.recommendations.filter("resume_id = 'a.txt'").collect()} == {"java"}
    spark.catalog.clearCache()


def test_files_with_a_knowledge_base_and_pairs(spark, folders):
    entry = {"name": "Java", "category": "Languages", "skill_type": "software", "hot_technology": True, "in_demand": False,
             "occupations_count": 3, "soc_codes": ["1"], "importance_score": 0.0}
    (folders / "kb.json").write_text(json.dumps({"java": entry, "python": entry | {"name": "Python"}}, indent=2))
    (folders / "j" / "other.txt").write_text("Java")
    with pytest.raises(ValueError, match="pairs"):
        FS.analyze_files(spark, str(folders / "r"), str(folders / "j"))
    p = spark.createDataFrame([("a.txt", "job.txt"), ("b.txt", "other.txt")], "resume_id string, job_id string")
    a = FS.analyze_files(spark, str(folders / "r"), str(folders / "j"), str(folders / "kb.json"), pairs=p)
    got = {r["resume_id"]: (skills(r["matched_skills"]), skills(r["missing_skills"])) for r in a.matches.collect()}
    assert got == {"a.txt": ({"python"}, {"java"}), "b.txt": ({"java"}, set())}
    assert a.recommendations.first()["category"] == "Languages"
    assert RD.kb_or_fallback(spark, RD.read_kb_json(spark, str(folders / "kb.json"))).count() == 2
    spark.catalog.clearCache()
