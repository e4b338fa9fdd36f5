"""The whole analysis of (resume, job) texts: extraction on both sides, matching with the resume's own
evidence, similarity, gap level, recommendations and the pair summary (PL-01 -> PL-02 -> PL-03 -> PL-04 -> PL-07)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lookups as L
from .evidence import evidence_table
from .extract import extract_skills, prepare
from .match import PAIR, match_inputs, match_summary, pair_frame
from .recommend import job_levels, priority_summary, recommendations, with_priority_counts
from .similarity import similarity
from .summary import pair_summary


class Analysis(NamedTuple):
    """Lazy tables of one analysis."""
    matches: DataFrame          # match_summary per pair
    evidence: DataFrame         # evidence_table per pair and skill
    recommendations: DataFrame  # one row per missing skill, with its place ``pos`` in the missing list
    priorities: DataFrame       # priority_summary per pair with something missing
    similarity: DataFrame       # scores per pair
    summary: DataFrame          # pair_summary per pair, with the similarity
    listed: DataFrame           # the summary with the lists of matched and missing skills, from one computation


def analyze_pairs(resumes: DataFrame, jobs: DataFrame, pairs: DataFrame, kb: DataFrame, aliases: DataFrame,
                  threshold: float = L.FUZZY_THRESHOLD, max_features: int = L.TFIDF_MAX_FEATURES,
                  same_texts: bool = False) -> Analysis:
    """Analyse every pair.

    ``resumes(id, text)``, ``jobs(id, text)``, ``pairs(resume_id, job_id)``,
    ``kb`` with the knowledge-base columns, ``aliases(alias, canonical)``.
    ``same_texts``: both sides are one table, which is then extracted once.
    The extracted skills, far smaller than the texts, feed most outputs and
    are persisted (lazily; ``spark.catalog.clearCache`` frees them).
    """
    prepared = prepare(kb.select("skill_key"), aliases)
    found = lambda d: extract_skills(d.select(F.col("id").alias("doc_id"), "text"), None, None,
                                     prepared).select("doc_id", "skill", "evidence").persist()
    held = found(resumes)
    required = held if same_texts else found(jobs)
    mi = match_inputs(pairs, held.select(F.col("doc_id").alias("resume_id"), "skill"),
                      required.select(F.col("doc_id").alias("job_id"), "skill"))
    frame = with_priority_counts(pair_frame(mi, threshold, of_jobs=job_levels(mi.required, kb)))
    own = held.select(F.col("doc_id").alias("resume_id"), "skill", "evidence")
    counted = match_summary(mi, threshold, frame=frame, keep=("high_count",))
    missing = frame.select(*PAIR, F.posexplode("missing").alias("pos", "skill"))
    recs = recommendations(missing, kb)
    prio = priority_summary(recs)
    scores, _ = similarity(resumes, jobs, pairs, max_features=max_features)
    lists = ("matched_skills", "missing_skills")
    listed = pair_summary(counted, None, scores, keep=lists)
    return Analysis(counted.drop("high_count"), evidence_table(frame, own), recs, prio, scores, listed.drop(*lists),
                    listed)
