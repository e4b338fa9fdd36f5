"""Stand-in inputs derived from the test tables (see FIXTURES.md).

The documents hold no real skill words, so resumes, jobs, knowledge-base
records and labelled samples are derived from the TPC-H-like tables with
joins and aggregates.  Everything here is a DataFrame plan over whole tables;
nothing is sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

# ---------------------------------------------------------------------------
# FIXED VALUES: profile lines appended to documents (F1), chosen by doc_id % n.
# Each entry is one extra block; '\n' separates lines.
# ---------------------------------------------------------------------------
PROFILE_BLOCKS = [
    "TECHNICAL SKILLS:\n- Python, C++, Power BI\n- machine-learning with ML and AWS",
    "Summary of work with SQL and Tableau.\nWORK EXPERIENCE\nBuilt dashboards in Microsoft Excel and PowerBI; used Docker.",
    "PROJECTS\nNatural Language Processing with scikit-learn and NumPy\ncontact me on LinkedIn at linkedin.com/in/someone",
    "Education\nBachelor in Data Science\nCERTIFICATIONS\nAmazon Web Services certified; knows R programming and C#.",
    "Experienced in machine\nlearning and deep learning, plus Node.js, React.js and .NET",
    "Key Skills\nData Visualization, Data Analysis, Pandas, Git, GitHub\nvisit github.com/someone for Kubernetes work",
    "Core Competencies\nProblem Solving, Critical Thinking, NLP, JS, TS\nRéalisé des modèles en Python — très bien",
    "Responsibilities:\nDesign and deploy models using TensorFlow and PyTorch\nWork with stakeholders on ETL pipeline and Big Data",
]


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with one of the fixed profile blocks appended.

    Block ``doc_id % 8`` is put on top for even ids (header on line one) and
    at the end for odd ids.  Returns (doc_id, text).
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    blocks = F.array(*[F.lit(b) for b in PROFILE_BLOCKS])
    blk = F.element_at(blocks, (F.col("doc_id") % len(PROFILE_BLOCKS) + 1).cast("int"))
    txt = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        F.when(F.col("doc_id") % 2 == 0, F.concat(blk, F.lit("\n"), txt))
        .otherwise(F.concat(txt, F.lit("\n"), blk)).alias("text"),
    )


def resume_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 held skills: distinct part names each customer bought -> (resume_id, skill)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .join(p, li.l_partkey == p.p_partkey)
            .select(F.col("o_custkey").alias("resume_id"), F.col("p_name").alias("skill"))
            .distinct())


def job_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 required skills, from all parts: the names of a brand whose summed part sizes are at least
    the brand's mean over its names -> (job_id, skill)."""
    per = (table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("job_id"), F.col("p_name").alias("skill"))
           .agg(F.sum("p_size").alias("s")))
    tot = per.groupBy("job_id").agg(F.sum("s").alias("total"), F.count("*").alias("k"))
    return per.join(tot, "job_id").filter(F.col("s") * F.col("k") >= F.col("total")).select("job_id", "skill")


def purchase_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every purchase: (resume_id, skill, job_id, o_orderpriority), the three-way join behind
    ``purchases`` and ``resume_evidence``, for a query that writes it once for both."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    return (li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
            .select(F.col("o_custkey").alias("resume_id"), F.col("p_name").alias("skill"),
                    F.col("p_brand").alias("job_id"), "o_orderpriority"))


def purchases(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """Distinct (customer, part name, brand) bought: the source of both the
    F3 held skills and the F3 pairs (one three-way join for both).

    ``lines``: ``purchase_lines`` where the caller has written it."""
    lines = lines if lines is not None else purchase_lines(spark, sf_dir)
    return lines.select("resume_id", "skill", "job_id").distinct()


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 pairs: a customer is compared with every brand it bought from.

    Derived by joins (no cross product): (resume_id, job_id).
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .join(p, li.l_partkey == p.p_partkey)
            .select(F.col("o_custkey").alias("resume_id"), F.col("p_brand").alias("job_id"))
            .distinct())


# ---------------------------------------------------------------------------
# occupational records derived from orders / lineitem / part / customer
# ---------------------------------------------------------------------------

# FIXED VALUES: extra essential element names chosen by o_orderkey % 4.
ESSENTIAL_EXTRA = ["Problem Solving", "Critical Thinking", "Machine Learning", "cold gear"]
DISCOUNT_CUT = 0.05


def software_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 software rows: one per lineitem, in (l_orderkey, l_linenumber, l_partkey) order.

    Columns follow the software CSV: soc_code, title, workplace_example,
    element_id, element_name, hot_technology, in_demand, plus ``ord``.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag",
                                                  "l_discount")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    j = li.join(p, li.l_partkey == p.p_partkey)
    return j.select(
        F.col("p_brand").alias("soc_code"),
        F.col("p_type").alias("title"),
        F.when(F.col("l_linenumber") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("workplace_example"),
        F.col("p_type").alias("element_id"),
        F.col("p_type").alias("element_name"),
        F.when(F.col("l_returnflag") == "R", F.lit("Y")).otherwise(F.lit("N")).alias("hot_technology"),
        F.when(F.col("l_discount") > DISCOUNT_CUT, F.lit("Y")).otherwise(F.lit("N")).alias("in_demand"),
        F.concat(F.lpad(F.col("l_orderkey").cast("string"), 12, "0"),
                 F.lpad(F.col("l_linenumber").cast("string"), 4, "0"),
                 F.lpad(F.col("l_partkey").cast("string"), 12, "0")).alias("ord"),
    )


def essential_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 essential rows: three per order (priority, segment planning, fixed extra)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey)
    dv = (F.lit(1) + F.col("o_orderkey") % 5).cast("double")
    extra = F.element_at(F.array(*[F.lit(x) for x in ESSENTIAL_EXTRA]),
                         (F.col("o_orderkey") % len(ESSENTIAL_EXTRA) + 1).cast("int"))
    seg = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lower("c_mktsegment"), F.lit(" planning"))) \
        .otherwise(F.concat(F.col("c_mktsegment"), F.lit(" Planning")))
    names = F.array(F.col("o_orderpriority"), seg, extra)
    return j.select(F.explode(names).alias("element_name"), dv.alias("data_value"))


# FIXED VALUES: the section that an order priority stands for, in display order.
PRIORITY_SECTIONS = [("1-URGENT", "Skills section"), ("2-HIGH", "Experience section"),
                     ("3-MEDIUM", "Project section"), ("4-NOT SPECIFIED", "Education section"),
                     ("5-LOW", "Summary section")]


def resume_evidence(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """F3 evidence: where a held skill was 'found', from the priorities of the orders it was bought in.

    Returns (resume_id, skill, evidence) with sections in display order.
    ``lines``: ``purchase_lines`` where the caller has written it.
    """
    j = lines if lines is not None else purchase_lines(spark, sf_dir)
    p = F.col("o_orderpriority")
    known = F.when(p.isNull() | p.isin([k for k, _ in PRIORITY_SECTIONS]), p).otherwise(
        F.raise_error(F.concat(F.lit("no section for order priority "), p)))
    # one flag a section, which a plain aggregate keeps; sets of places would be sorted by key
    g = (j.select("resume_id", F.lower("skill").alias("skill"), known.alias("o_orderpriority")).groupBy("resume_id", "skill")
         .agg(*[F.max(F.col("o_orderpriority") == k).alias(s) for k, s in PRIORITY_SECTIONS]))
    return g.select("resume_id", "skill", F.concat_ws(" + ", *[F.when(F.col(s), F.lit(s)) for _, s in PRIORITY_SECTIONS])
                    .alias("evidence"))


# FIXED VALUES: extra noisy skill spellings chosen by l_partkey % 9, and one
# user alias (UX-03).
NOISY_SKILLS = ["ML", "Power-BI", "ci/cd", "React.js", "MS Excel", "node js", "Sklearn", "(Python)", "AWS;"]
USER_ALIASES = [("HOT ROD", " Hot-Rod Racing ")]


def noisy_resume_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 held skills as raw, noisy strings in purchase order.

    The spelling depends on l_linenumber (upper case with a comma, hyphens,
    padding and a period, dots, slashes, a fixed noisy name, plain).
    Returns (resume_id, pos STRUCT, raw).
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    n = F.col("p_name")
    noisy = F.element_at(F.array(*[F.lit(x) for x in NOISY_SKILLS]),
                         (F.col("l_partkey") % len(NOISY_SKILLS) + 1).cast("int"))
    ln = F.col("l_linenumber")
    raw = (F.when(ln == 1, F.concat(F.upper(n), F.lit(",")))
           .when(ln == 2, F.replace(n, F.lit(" "), F.lit("-")))
           .when(ln == 3, F.concat(F.lit("  "), n, F.lit(".")))
           .when(ln == 4, F.replace(n, F.lit(" "), F.lit(".")))
           .when(ln == 5, F.replace(n, F.lit(" "), F.lit("/")))
           .when(ln == 6, noisy)
           .otherwise(n))
    return j.select(F.col("o_custkey").alias("resume_id"),
                    F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("pos"), raw.alias("raw"))


def user_aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(USER_ALIASES, "alias string, canonical string")


# FIXED VALUES: hand labels (expected skills) of the profile blocks above,
# in block order; F4's labelled form for extraction output.
PROFILE_TRUTH = [
    ["python", "c++", "power bi", "machine learning", "aws"],
    ["sql", "tableau", "microsoft excel", "power bi", "docker"],
    ["natural language processing", "scikit-learn", "numpy"],
    ["data science", "aws", "r", "c#"],
    ["machine learning", "deep learning", "node.js", "react", ".net"],
    ["data visualization", "data analysis", "pandas", "git", "github", "kubernetes"],
    ["problem solving", "critical thinking", "natural language processing", "javascript", "typescript", "python"],
    ["tensorflow", "pytorch", "etl", "big data"],
]


def profile_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4 labels for F1: (doc_id, domain = block index, raw label)."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    labels = F.array(*[F.array(*[F.lit(x) for x in t]) for t in PROFILE_TRUTH])
    blk = (F.col("doc_id") % len(PROFILE_TRUTH)).cast("int")
    return docs.select("doc_id", blk.cast("bigint").alias("domain"),
                       F.explode(F.element_at(labels, blk + 1)).alias("raw"))
