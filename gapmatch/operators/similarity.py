"""PL-03: TF-IDF (uni+bigrams) cosine similarity per (resume, job) pair.

Each pair is a two-document corpus with smoothed IDF, so a term has weight
``count`` when both documents contain it and ``k * count`` otherwise, with
``k = 1 + ln 1.5``.  Writing S for a document's sum of squared counts and
sums over shared terms only, the cosine is

    sum(r*j) / sqrt((k^2 S_r - (k^2-1) sum r^2) * (k^2 S_j - (k^2-1) sum j^2))

over the terms that the pair keeps: its ``cap`` most frequent ones (count
desc, term asc; SO-04).  A document's vector of counts is made once, inside
its row.  The vectors of both sides are joined to the pairs, many pairs of one
document spread over several copies of its vector, and merged, cut and summed
inside the pair's row; a table of pairs and terms never exists.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import text as X
from ..plans.skew import spread_join
from .documents import lemmatized

K_IDF = 1.0 + math.log(1.5)
K2 = K_IDF * K_IDF
PAIR = ["resume_id", "job_id"]


def doc_terms(docs: DataFrame, lexicon: DataFrame | None = None, stops=None) -> DataFrame:
    """Per document: lemmatised text flag and terms.

    ``docs(id, text)`` -> ``(id, nonblank BOOLEAN, terms ARRAY<STRING>)`` where
    ``terms`` are the unigrams and bigrams of the vectorizer tokens.
    ``stops``: words the vectorizer drops (a list).
    """
    stops = list(stops or L.VECTORIZER_STOP_WORDS)
    per = lemmatized(docs, lexicon, id_col="id")
    # the token array is projected on its own first: lambdas would otherwise
    # re-evaluate the tokenizer once per array element
    per = X.select_once(per, ["id"], nonblank=F.col("lemma_text") != "", vt=X.vector_tokens("lemma_text", stops))
    return per.select("id", "nonblank", X.unigrams_bigrams("vt").alias("terms"))


def doc_vectors(docs: DataFrame, lexicon: DataFrame | None = None, stops=None) -> DataFrame:
    """(id, nonblank, v): each document's terms in order with their counts (AG-08)."""
    return doc_maps(docs, lexicon, stops).select(
        "id", "nonblank", F.map_entries("v").cast("array<struct<term:string,cnt:bigint>>").alias("v"))


def doc_maps(docs: DataFrame, lexicon: DataFrame | None = None, stops=None) -> DataFrame:
    """(id, nonblank, v, s2): each document's vector as a map made inside its row, and the sum of its squared counts.

    Sorted terms stand in runs; a run's length is the way to the start of the next.
    """
    d = doc_terms(docs.select("id", "text"), lexicon, stops)
    d = X.select_once(d, ["id", "nonblank"], t=F.sort_array("terms"))
    n = F.size("t")
    starts = F.filter(F.transform("t", lambda x, i: F.when(~F.get("t", i - 1).eqNullSafe(x), i)), lambda i: i.isNotNull())
    d = X.select_once(d, ["id", "nonblank", "t"], at=starts)
    # sorted terms without repetition stand in the order of their starts
    counts = F.transform("at", lambda i, k: (F.coalesce(F.get("at", k + 1), n) - i).cast("bigint"))
    d = X.select_once(d, ["id", "nonblank"], terms=F.array_distinct("t"), cnts=counts)
    return X.select_once(d, ["id", "nonblank"], v=F.map_from_arrays("terms", "cnts"),
                         s2=_total("cnts", lambda c: c * c))


def _total(c, f) -> Column:
    return F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + f(x))


def with_vector(pairs: DataFrame, key: str, other: str, vectors: DataFrame, name: str,
                counts: DataFrame | None = None) -> DataFrame:
    """JN-15: ``pairs`` with ``name``, ``{name}_s2`` and ``{name}_nonblank`` of the document in ``key``, also where that
    has many pairs.  ``counts``: pairs of each key, where ``pairs`` has been joined already and would be made twice."""
    v = vectors.select(F.col("id").alias(key), F.col("nonblank").alias(f"{name}_nonblank"), F.col("v").alias(name),
                       F.col("s2").alias(f"{name}_s2"))
    return spread_join(pairs, v, key, [other], counts)


VECTOR = "map<string,bigint>"


def shared_terms(r, j) -> Column:
    """The terms of both vectors with their counts: structs (term, r, j)."""
    both = F.map_zip_with(r, j, lambda k, a, b: F.when(a.isNotNull() & b.isNotNull(), F.struct(
        k.alias("term"), a.alias("r"), b.alias("j"))))
    return F.filter(F.map_values(both), lambda x: x.isNotNull())


def merged_terms(r, j) -> Column:
    """The distinct terms of two vectors with both counts: structs (less, term, r, j), ``less`` their negative sum."""
    zero = F.lit(0).cast("bigint")
    return F.map_values(F.map_zip_with(r, j, lambda k, a, b: F.struct(
        (-(F.coalesce(a, zero) + F.coalesce(b, zero))).alias("less"), k.alias("term"),
        F.coalesce(a, zero).alias("r"), F.coalesce(b, zero).alias("j"))))


def per_pair(resumes: DataFrame, jobs: DataFrame, pairs: DataFrame, lexicon: DataFrame | None = None,
             max_features: int = L.TFIDF_MAX_FEATURES, top_k: int = L.TOP_SHARED_TERMS, stops=None) -> DataFrame:
    """One row per pair with its sums over the kept terms (SO-04) and its ``top_k`` shared terms.

    Ids are unique on each side; a pair whose document is missing has no terms there.  The vectors come to the pair, and
    everything else happens in its row: the terms of both are looked for, and where the pair has no more terms than it
    keeps, the sums of squares are those of its documents.  Only a pair with more merges, sorts and cuts its terms.
    """
    p = pairs.select(*PAIR).distinct()
    # counted before the vectors come: a count of the joined pairs would make the vectors once more
    hot = lambda key: p.groupBy(key).agg(F.count("*").alias("n"))
    d = with_vector(p, "job_id", "resume_id", doc_maps(jobs, lexicon, stops), "j", hot("job_id"))
    d = with_vector(d, "resume_id", "job_id", doc_maps(resumes, lexicon, stops), "r", hot("resume_id"))
    keep = [*PAIR, "r_nonblank", "j_nonblank"]
    zero, none = F.lit(0).cast("bigint"), F.create_map().cast(VECTOR)
    d = d.select(*keep, F.coalesce("r", none).alias("r"), F.coalesce("j", none).alias("j"),
                 F.coalesce("r_s2", zero).alias("r_s2"), F.coalesce("j_s2", zero).alias("j_s2"))
    d = X.select_once(d, [*keep, "r", "j", "r_s2", "j_s2"], b=shared_terms("r", "j"))
    n_terms = F.size("r") + F.size("j") - F.size("b")
    cut = F.when(n_terms > max_features, F.slice(F.sort_array(merged_terms("r", "j")), 1, max_features))
    d = X.select_once(d, [*keep, "r_s2", "j_s2", "b"], U=F.least(n_terms, F.lit(max_features)), m=cut)
    kept = F.when(F.col("m").isNull(), F.col("b")).otherwise(F.transform(
        F.filter("m", lambda x: (x["r"] > 0) & (x["j"] > 0)),
        lambda x: F.struct(x["term"].alias("term"), x["r"].alias("r"), x["j"].alias("j"))))
    squares = lambda c, s2: F.when(F.col("m").isNull(), F.col(s2)).otherwise(_total("m", lambda x: x[c] * x[c]))
    d = X.select_once(d, [*keep, "U"], b=kept, Sr=squares("r", "r_s2"), Sj=squares("j", "j_s2"))
    top = F.slice(F.sort_array(F.transform("b", lambda x: F.struct((x["r"] * x["j"]).alias("w"), x["term"].alias("term"))),
                               False), 1, top_k)
    # the sums leave their row once: a condition on one of them is not moved below and made again
    return X.select_once(
        d, PAIR, U=F.col("U").cast("bigint"), n_shared=F.size("b").cast("bigint"), Sr=F.col("Sr"), Sj=F.col("Sj"),
        dot=_total("b", lambda x: x["r"] * x["j"]), r2=_total("b", lambda x: x["r"] * x["r"]),
        j2=_total("b", lambda x: x["j"] * x["j"]), rb=F.col("r_nonblank"), jb=F.col("j_nonblank"),
        # weights of a pair share one denominator: the integer product ranks, ties on the term (SO-03)
        top=top)


def similarity(resumes: DataFrame, jobs: DataFrame, pairs: DataFrame, lexicon: DataFrame | None = None,
               max_features: int = L.TFIDF_MAX_FEATURES, top_k: int = L.TOP_SHARED_TERMS,
               stops=None) -> tuple[DataFrame, DataFrame]:
    """Cosine similarity and top shared terms for every pair.

    ``resumes(id, text)``, ``jobs(id, text)``, ``pairs(resume_id, job_id)``.
    Returns (scores, top_terms), lazy:

    * scores: resume_id, job_id, cosine_similarity_score, text_similarity_percentage,
      n_shared_terms, explanation;
    * top_terms: resume_id, job_id, rank, term, overlap_weight.
    """
    b = per_pair(resumes, jobs, pairs, lexicon, max_features, max(top_k, L.EXPLAIN_TERMS), stops)
    nr = F.lit(K2) * F.col("Sr") - F.lit(K2 - 1.0) * F.col("r2")
    nj = F.lit(K2) * F.col("Sj") - F.lit(K2 - 1.0) * F.col("j2")
    b = b.withColumn("den", F.sqrt(nr * nj))
    b = b.withColumn("cos", F.when(F.col("den") > 0, F.col("dot") / F.col("den")).otherwise(F.lit(0.0)))
    top = b.select(*PAIR, "den", F.posexplode(F.slice("top", 1, top_k)).alias("k", "t")).filter(F.col("den") > 0)
    top_terms = top.select(*PAIR, (F.col("k") + 1).cast("bigint").alias("rank"), "t.term",
                           F.bround(F.col("t.w") / F.col("den"), 4).alias("overlap_weight"))
    out = pairs.select(*PAIR).join(b, PAIR, "left")
    blank = ~F.coalesce("rb", F.lit(False)) | ~F.coalesce("jb", F.lit(False))
    nothing = blank | (F.coalesce("U", F.lit(0)) == 0)
    score = F.when(nothing, F.lit(0.0)).otherwise(F.bround("cos", 4))
    pct = F.when(nothing, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(F.col("cos") * 100.0, 2))))
    first5 = F.array_join(F.transform(F.slice("top", 1, L.EXPLAIN_TERMS), lambda s: s["term"]), ", ")
    expl = (F.when(blank, F.lit(L.SIMILARITY_EMPTY_MSG))
            .when(nothing, F.lit(L.SIMILARITY_EMPTY_VOCAB_MSG))
            .when(F.size("top") > 0, F.concat(F.lit(L.SIMILARITY_PREFIX_MSG), first5, F.lit(".")))
            .otherwise(F.lit(L.SIMILARITY_NO_OVERLAP_MSG)))
    scores = out.select(*PAIR, score.alias("cosine_similarity_score"), pct.alias("text_similarity_percentage"),
                        F.when(nothing, F.lit(0)).otherwise(F.col("n_shared")).cast("bigint").alias("n_shared_terms"),
                        expl.alias("explanation"))
    return scores, top_terms
