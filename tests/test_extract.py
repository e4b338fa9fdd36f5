"""Skill extraction (PL-01) on short hand-written documents."""

import pytest
from pyspark.sql import functions as F

from gapmatch.functions.skills import display_name, is_valid_skill
from gapmatch.operators import extract as X
from gapmatch.operators import kb as K
from gapmatch.operators import sections as S

TEXTS = [
    (1, "For six years I taught Deep Learning and Computer Vision;\n"
        "   before that: Data Analysis, reports in Power BI or Microsoft Excel.\n"
        "   Hobby projects use Natural Language Processing, Machine Learning and Amazon Web Services."),
    (2, "Short list: AWS / PowerBI / NLP / MS Excel / JS / DL / ML"),
    (3, "Backends mostly in Node.js or .NET; some Python, C# at night, C++ for drivers"),
    (4, "Alex\nLinkedIn: linkedin.com/in/alex | GitHub: github.com/alex\n\nTECHNICAL SKILLS\n"
        "- Python, R, SQL\n- Docker, Git\n\nWORK EXPERIENCE\n- Built models with Python and machine\n"
        "learning pipelines in AWS"),
]


@pytest.fixture(scope="module")
def extracted(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    fb = X.fallback_kb(spark)
    cur = K.curated_df(spark).select(F.lower("cur_name").alias("skill_key"))
    keys = fb.select("skill_key").unionByName(cur).distinct()
    kbf = keys.select("skill_key", F.lit(0).alias("src_rank"), F.lit(None).cast("int").alias("cur_ord"),
                      F.col("skill_key").alias("src_key"))
    aliases = K.alias_map(spark, kbf)
    rows = X.extract_skills(docs, keys, aliases).collect()
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], {})[r["skill"]] = r
    return out


def test_multi_word_skills(extracted):
    for s in ["machine learning", "deep learning", "data analysis", "power bi", "microsoft excel",
              "natural language processing", "computer vision", "aws"]:
        assert s in extracted[1], s


def test_alias_normalization(extracted):
    for s in ["machine learning", "deep learning", "natural language processing", "javascript",
              "microsoft excel", "aws", "power bi"]:
        assert s in extracted[2], s


def test_programming_special_patterns(extracted):
    for s in ["c++", "c#", ".net", "python", "node.js"]:
        assert s in extracted[3], s


def test_sections_and_false_positives(extracted):
    d = extracted[4]
    assert "linkedin" not in d                      # company name, block-listed
    assert d["python"]["evidence"] == "Skills section + Experience section"
    assert d["r"]["sections"] == ["Skills section"]  # 'R' followed by end of line? no: ', ' -> r pattern
    assert "machine learning" not in d               # phrase split by a newline
    assert d["github"]["evidence"] == "Summary section"   # 'GitHub:' token, not the URL
    assert d["aws"]["display_name"] == "AWS"


def test_section_spans(spark):
    docs = spark.createDataFrame([(1, "SKILLS\npython\nEducation\nBSc"), (2, "intro\nKey Skills:\nsql")],
                                 "doc_id long, clean string")
    got = sorted((r["doc_id"], r["section"], r["start"], r["end"]) for r in S.section_spans(docs).collect())
    assert got == [(1, "education", 14, 28), (1, "skills", 0, 14), (1, "summary", 0, 0),
                   (2, "skills", 6, 22), (2, "summary", 0, 6)]


@pytest.mark.parametrize("term,ok", [
    ("python", True), ("data", False), ("machine learning", True), ("machine-learning", True),
    ("data analysis", True), ("data management", False), ("google cloud", False), ("ci/cd", False),
    ("scikit-learn", True), ("vue.js", False), ("node.js", True), ("", False), ("   ", False),
    ("react.js", False), ("extract transform load", True), ("big fast", True),
])
def test_validity(spark, term, ok):
    r = spark.createDataFrame([(term,)], "t string").select(is_valid_skill("t").alias("v")).first()["v"]
    assert r is ok


def test_display_names(spark):
    df = spark.createDataFrame([("aws",), ("power bi",), ("node.js",), ("machine-learning",), ("3d modeling",),
                                ("o'reilly",), ("",)], "s string")
    got = [r["d"] for r in df.select(display_name("s").alias("d")).collect()]
    assert got == ["AWS", "Power BI", "Node.js", "Machine-Learning", "3D Modeling", "O'Reilly", ""]
    assert got[:6] == ["AWS", "Power BI", "Node.js"] + [s.title() for s in ["machine-learning", "3d modeling",
                                                                           "o'reilly"]]


def test_context_reject(spark):
    docs = spark.createDataFrame([(1, "Connect with me on LinkedIn please"), (2, "We used Oracle and Spark daily")],
                                 "doc_id long, text string")
    got = {(r["doc_id"], r["term"]): r["rejected"] for r in X.context_rejections(docs).collect()}
    assert got[(1, "linkedin")] is True and got[(2, "oracle")] is False


def test_tokens_are_not_shuffled_for_a_small_dictionary(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    al, dic = X.prepare(X.fallback_kb(spark).select("skill_key"), X.L.aliases_df(spark))
    plan = X.candidates(docs, al, dic)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [tok" in plan and "SortMergeJoin" not in plan


def test_only_lines_that_can_hold_a_phrase_are_exploded(spark, monkeypatch):
    """Full stops and hyphens of phrases do not send every line to the join; results are those of no such test."""
    docs = spark.createDataFrame([*TEXTS, (5, "Plain words only. And more - of them.\nmachine  learning, power - bi\nnode.js")],
                                 "doc_id long, text string")
    prep = X.prepare(X.fallback_kb(spark).select("skill_key"), X.L.aliases_df(spark))
    anchors = X._few_anchors(prep[1])
    assert "learning" in anchors and "." not in anchors and "-" not in anchors
    key = lambda: sorted(map(tuple, X.detections(docs, None, None, prep).collect()))
    got = key()
    monkeypatch.setattr(X, "ANCHORS", 0)
    assert X._few_anchors(prep[1]) is None
    assert got == key() and {d for d, _, _ in got} == {1, 2, 3, 4, 5}


ODD = ["See https://x.y/z, WWW.a.b or me@x.org; c++/C# .NET 4.5 a.b..c _d_ é.ü++ ½", "a.b++ c##  x\ty R, r script r; C,\nc \n r",
       "xr, r\n\n,NODE.JS node.jsx react.js vue.js? c++c c++", "  SKILLS : \n my skills\nWork  Experience:", "  Technical  SKILLS : ", "", "r", "@ http www."]


def test_shorter_searches_find_the_same(spark):
    """Pieces, special terms and headers are those of the plain patterns."""
    df = spark.createDataFrame([(s,) for s in ODD], "clean string")
    plain = [F.split("clean", pat, -1) for pat, _ in X.L.SPECIAL_PATTERNS]
    line = F.col("clean")
    cls = F.coalesce(*[F.when(F.btrim(line, F.lit(" ")).rlike(rx), F.lit(c)) for c, rx in X.L.section_classes()])
    got = df.select(
        "clean", X.token_pieces("clean").alias("p"), X.special_matches().alias("m"), S.header_class("clean").alias("h"),
        F.regexp_extract_all(F.lower("clean"), F.lit(X.TOKEN_PIECE_RE), 0).alias("p0"), cls.alias("h0"),
        F.array(*plain).alias("m0")).collect()
    for r in got:
        want = [(t, sum(p.count("\n") for p in cut[:k])) for (_, t), cut in zip(X.L.SPECIAL_PATTERNS, r["m0"], strict=True)
                for k in range(1, len(cut))]
        assert r["p"] == r["p0"] and r["h"] == r["h0"] and [tuple(m) for m in r["m"]] == want, r["clean"]
    assert any(r["m"] for r in got) and any(r["h0"] for r in got)


def test_header_search_is_tried_once_a_line():
    """Only where every pattern starts with ^ may one ^ stand in front of them all."""
    assert all(p.replace("(?i)", "", 1).startswith("^") for _, p in X.L.SECTION_PATTERNS)
