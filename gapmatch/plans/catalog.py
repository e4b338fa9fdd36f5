"""Registered queries: name -> (spark builder, oracle SQL or None).

Each builder takes (spark, sf_dir) and returns a DataFrame over the whole
test tables (or stand-ins Spark derives from them).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle_sql as O
from ..session import ensure_checkpoint_dir
from ..sources import fixtures as FX
from ..sources import readers as RD
from ..sources import scan as SCAN
from ..operators import documents as D
from ..operators import extract as X
from ..operators import lexicon as LEX
from ..operators import sections as S
from ..operators import sentences as SEN
from ..operators import similarity as SIM
from ..operators import evidence as EV
from ..operators import recommend as R
from ..operators import evaluate as EVAL
from ..operators import summary as SUM
from ..operators import normalize as NZ
from ..functions import lookups as L
from ..functions import text as T
from ..functions import skills as SK
from ..operators import analyze as AN
from ..operators import kb as K
from ..operators import match as M
from ..sources.tables import table
from .reuse import materialize, stored

Builder = Callable[[SparkSession, str], DataFrame]


def _match_summary(spark, sf):
    mi = _mi(spark, sf)
    return M.match_summary(mi, frame=_pair_frame(mi))


def _pair_frame(mi, threshold=L.FUZZY_THRESHOLD, of_jobs=None, held=None, required=None, near=None):
    """The pair rows of the stand-ins, with the jobs' lists (one row a brand) written first."""
    return M.pair_frame(mi, threshold, jobs=stored(M.job_lists(mi, of_jobs, required), plain=True), held=held, near=near)


def _evidence_frame(spark, sf, made=lambda skills: skills):
    """The pair rows with the evidence of held skills and the display names of all, and what is ``made`` of these
    per skill; every purchase is read once."""
    lines = stored(FX.purchase_lines(spark, sf))
    mi = _mi(spark, sf, lines)
    names = stored(EV.display_table(_vocabulary(mi)), plain=True)
    held = EV.detailed(mi.held, "resume_id", names, FX.resume_evidence(spark, sf, lines))
    return _pair_frame(mi, held=made(held), required=made(EV.detailed(mi.required, "job_id", names)),
                       near=stored(M.near_skills(mi), plain=True))


def _frame(spark, sf):
    mi = _mi(spark, sf)
    return mi, _pair_frame(mi)


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def _assemble_pages(spark, sf):
    out = D.assemble_pages(table(spark, sf, "conversations"), "conv_id", "turn", "text")
    return out.select("doc_id", "n_pages", "n_text_pages", F.md5("text").alias("text_md5"),
                      F.char_length("text").cast("bigint").alias("text_chars"), "status")


def _kb(spark, sf):
    return K.build_kb(spark, FX.software_records(spark, sf), FX.essential_records(spark, sf))


def _kb_m(spark, sf):
    """The KB, checkpointed: used by several joins of one query."""
    return materialize(_kb(spark, sf))


def _shared_folder(spark):
    """A new folder that driver and executors share, for files written and read by one query."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


def _csv_records(spark, sf):
    """SRC-04: all documents as quoted CSV with line breaks inside fields, read back in byte ranges."""
    folder = _shared_folder(spark)
    SCAN.write_csv(table(spark, sf, "documents"), folder)
    d = SCAN.read_csv(spark, folder)
    return d.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5("text").alias("text_md5"), "lang", "source",
                    F.col("n_chars").cast("bigint").alias("n_chars"))


def _software_csv(spark, sf):
    """SRC-04 into PL-05: the software records as CSV files in their order, read by name, into the knowledge base."""
    folder = _shared_folder(spark)
    names = {v: k for k, v in RD.SOFTWARE_COLUMNS.items()}
    rec = FX.software_records(spark, sf).orderBy("ord").drop("ord")
    SCAN.write_csv(rec.select(*[F.col(c).alias(names[c]) for c in rec.columns]), folder)
    s = K.software_kb(RD.read_software_csv(spark, folder))
    return s.select("skill_key", "name", "category", "hot_technology", "in_demand", "occupations_count",
                    F.array_join("soc_codes", "|").alias("soc_codes"), "importance_score")


def _kb_json_round_trip(spark, sf):
    """SNK-01, SRC-06: the knowledge base as one JSON object in parts, read back in byte ranges."""
    folder = _shared_folder(spark)
    RD.write_kb(_kb(spark, sf), f"{folder}/kb", f"{folder}/json")
    kb = RD.read_kb_json(spark, f"{folder}/json")
    return kb.select("skill_key", "name", "category", "skill_type", "hot_technology", "in_demand", "occupations_count",
                     F.array_join("soc_codes", "|").alias("soc_codes"), "importance_score")


def _alias_json_round_trip(spark, sf):
    """SNK-02, SRC-07: the alias map as one JSON object in parts, read back over the defaults."""
    folder = _shared_folder(spark)
    RD.write_aliases(K.alias_map(spark, _kb(spark, sf)), f"{folder}/aliases", f"{folder}/json")
    return RD.read_alias_json(spark, f"{folder}/json").select("alias", "canonical")


def _kb_software(spark, sf):
    s = K.software_kb(FX.software_records(spark, sf))
    return s.select("skill_key", "name", "category", "hot_technology", "in_demand", "occupations_count",
                    F.array_join("soc_codes", "|").alias("soc_codes"), "importance_score")


def _kb_essential(spark, sf):
    e = K.essential_kb(FX.essential_records(spark, sf))
    return e.select("skill_key", "name", "occupations_count", "in_demand", "importance_score")


def _kb_merge(spark, sf):
    return _kb(spark, sf).select("skill_key", "name", "category", "skill_type", "hot_technology", "in_demand",
                                 "occupations_count", F.array_join("soc_codes", "|").alias("soc_codes"),
                                 "importance_score")


def _alias_variants(spark, sf):
    return K.alias_map(spark, _kb(spark, sf))


def _kb_totals(spark, sf):
    kb = _kb(spark, sf)
    return K.kb_totals(kb, K.alias_map(spark, kb))


def _profiles(spark, sf):
    return FX.profiles(spark, sf)


def _prepared(spark, sf):
    kb = _kb_m(spark, sf)
    return kb, X.prepare(kb.select("skill_key"), K.alias_map(spark, kb))


def _section_spans(spark, sf):
    d = T.select_once(_profiles(spark, sf), ["doc_id"], clean=T.clean_text("text")).filter(F.col("clean") != "")
    return S.section_spans(d)


def _special_terms(spark, sf):
    d = X._doc_rows(_profiles(spark, sf))
    st = X.special_terms(d)
    return st.groupBy("doc_id", F.col("raw").alias("term"), F.col("line_no").cast("bigint").alias("line_no"),
                      "section").agg(F.count("*").alias("n_matches"))


def _phrase_matches(spark, sf):
    _, (al, dic) = _prepared(spark, sf)
    ln = X._line_rows(X._doc_rows(_profiles(spark, sf)))
    sp = X.phrase_spans(ln, dic)
    return sp.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"),
                     F.col("start").cast("bigint").alias("start"), F.col("n").cast("bigint").alias("n"), "raw",
                     "section")


def _longest_spans(spark, sf):
    _, (al, dic) = _prepared(spark, sf)
    ln = X._line_rows(X._doc_rows(_profiles(spark, sf)))
    sp = X.longest_spans(X.phrase_spans(ln, dic))
    return sp.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"),
                     F.col("start").cast("bigint").alias("start"), F.col("n").cast("bigint").alias("n"), "raw")


def _extract(spark, sf):
    kb, prep = _prepared(spark, sf)
    return kb, X.extract_skills(_profiles(spark, sf), kb.select("skill_key"), None, prep)


def _extract_skills(spark, sf):
    _, ex = _extract(spark, sf)
    return ex.select("doc_id", "skill", "display_name", "evidence")


def _skill_details(spark, sf):
    kb, ex = _extract(spark, sf)
    return X.skill_details(ex, kb).select("doc_id", "skill_key", "display_name", "category", "hot_technology",
                                          "in_demand", "importance_score", "evidence")


def _context_reject(spark, sf):
    return X.context_rejections(_profiles(spark, sf))


def _valid_skills(spark, sf):
    d = T.select_once(_profiles(spark, sf), [], t=T.word_tokens(T.clean_text("text")))
    d = T.select_once(d, [], g=T.unigrams_bigrams("t"))
    terms = d.select(F.explode("g").alias("term")).distinct()
    return terms.select("term", SK.is_valid_skill("term").alias("valid"))


def _tfidf(spark, sf, cap):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    bench = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    n = max(1, bench.count())  # one scalar: pairs are doc_id % n = item_id
    pairs = docs.select(F.col("id").alias("resume_id"), (F.col("id") % n).alias("job_id"))
    return SIM.similarity(docs, bench, pairs, max_features=cap)


TFIDF_SMALL_CAP = 300


def _f3(spark, sf):
    return FX.pairs(spark, sf), FX.resume_skills(spark, sf), FX.job_skills(spark, sf)


def _evidence_table(spark, sf):
    return EV.evidence_table(_evidence_frame(spark, sf))


def _vocabulary(mi):
    """The distinct skills of both sides; each side's first, so that no row of a resume and a skill is shuffled for it."""
    return mi.held.select("skill").distinct().unionByName(mi.required.select("skill").distinct())


def _recs(spark, sf):
    _, f = _frame(spark, sf)
    missing = f.select("resume_id", "job_id", F.posexplode("missing").alias("pos", "skill"))
    return R.recommendations(missing, _kb_m(spark, sf))


def _priority_buckets(spark, sf):
    """AG-12: the items of each bucket, in the order of the missing list."""
    mi = _mi(spark, sf)
    p = R.pair_priorities(_pair_frame(mi, of_jobs=R.job_items(mi.required, _kb_m(spark, sf))))
    names = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["skill_key"], x["category"])), "|")
    return p.select("resume_id", "job_id", names("high_priority").alias("high"),
                    names("medium_priority").alias("medium"), names("low_priority").alias("low"))


def _evidence_map(spark, sf):
    """SC-20: one map per pair, shown as sorted entries."""
    m = EV.evidence_map(_evidence_frame(spark, sf, EV.with_entries))
    e = F.transform(F.sort_array(F.map_entries("skill_evidence_map")), lambda x: F.concat_ws(
        "=", x["key"], x["value"]["status"], x["value"]["evidence"], x["value"]["display_name"]))
    return m.select("resume_id", "job_id", F.array_join(e, "|").alias("entries"))


def _skill_lists(spark, sf):
    """SO-01: sorted skill list of every profile document with skills."""
    _, ex = _extract(spark, sf)
    return X.skill_lists(ex).select("doc_id", F.array_join("skills", "|").alias("skills"))


def _fallback_extract(spark, sf):
    """SRC-10: extraction with the fallback dictionary, as when no knowledge base exists."""
    kb = X.fallback_kb(spark)
    prep = X.prepare(kb.select("skill_key"), L.aliases_df(spark).select("alias", "canonical"))
    ex = X.extract_skills(_profiles(spark, sf), None, None, prep)
    return ex.select("doc_id", "skill", "display_name", "evidence")


CUSTOM_THRESHOLD = 94.0
CUSTOM_LEVELS = {"Strong Match": 90.0, "Good Match": 50.0, "Moderate Gap": 20.0}


def _match_custom(spark, sf):
    """UX-01 / UX-02: the match summary with other thresholds."""
    mi = _mi(spark, sf)
    return M.match_summary(mi, CUSTOM_THRESHOLD, CUSTOM_LEVELS, frame=_pair_frame(mi, CUSTOM_THRESHOLD))


def _analyze_pairs(spark, sf):
    """The main entry: each profile as a resume against the next profile as a job."""
    d = _profiles(spark, sf).withColumnRenamed("doc_id", "id")
    ids = d.select(F.col("id").alias("resume_id"))
    pairs = ids.join(d.select(F.col("id").alias("job_id"), (F.col("id") - 1).alias("resume_id")), "resume_id")
    kb = _kb_m(spark, sf)
    a = AN.analyze_pairs(d, d, pairs, kb, K.alias_map(spark, kb), same_texts=True)
    return a.listed.drop("gap_description")


def _recommendations(spark, sf):
    return _recs(spark, sf).select("resume_id", "job_id", "skill_key", "skill", "category", "priority", "reason",
                                   "hot_technology", "in_demand", "importance_score")


def _counted_frame(spark, sf):
    """Pair rows with their priority counts: one frame for summary and counts."""
    mi = _mi(spark, sf)
    frame = _pair_frame(mi, of_jobs=R.job_levels(mi.required, _kb_m(spark, sf)))
    return mi, R.with_priority_counts(frame)


def _alignment_counts(spark, sf):
    return SUM.alignment_counts(_match_summary(spark, sf))


def _priority_counts(spark, sf):
    return SUM.priority_counts(_counted_frame(spark, sf)[1])


def _pair_summary(spark, sf):
    mi, frame = _counted_frame(spark, sf)
    return SUM.pair_summary(M.match_summary(mi, frame=frame, keep=("high_count",)))


def _fuzzy_pairs(spark, sf):
    _, h, r = _f3(spark, sf)
    return M.similarity_table(M.canon_skills(r, "job_id"), M.canon_skills(h, "resume_id"))


def _fuzzy_assign(spark, sf):
    _, f = _frame(spark, sf)
    return f.select("resume_id", "job_id", F.inline("assigned"))


def _evaluate_extraction(spark, sf):
    """one sample per pair; truth = the job's normalised skills (SC-19),
    prediction = the resume's skills; sets are compared inside the pair row."""
    mi = _mi(spark, sf, stored(FX.purchase_lines(spark, sf)))
    al = K.alias_map(spark, _kb_m(spark, sf)).select("alias", "canonical")
    jt = X.normalize(FX.job_skills(spark, sf).select("job_id", F.col("skill").alias("raw")), al)
    jt = (jt.filter(F.col("skill") != "").groupBy("job_id").agg(F.collect_set("skill").alias("truth")))
    # of a few jobs the size is known then, and the pairs, which carry the prediction, are not shuffled to meet them
    jt = stored(jt.select("job_id", EVAL.as_set("truth").alias("truth")), plain=True)
    pr = mi.held.groupBy("resume_id").agg(EVAL.as_set(F.collect_list("skill")).alias("predicted"))
    samples = (mi.pairs.join(pr, "resume_id", "left").join(jt, "job_id", "left")
               .withColumn("domain", F.col("job_id")))
    return EVAL.evaluate_sets(samples, keys=("resume_id", "job_id"), sets=True)


def _evaluate_profiles(spark, sf):
    """PL-06 over PL-01: skills extracted from every F1 profile against the
    block's labels (normalised, SC-19); one sample per document."""
    kb, prep = _prepared(spark, sf)
    al, _ = prep
    pred = X.extract_skills(_profiles(spark, sf), None, None, prep).select("doc_id", "skill")
    truth = X.normalize(FX.profile_truth(spark, sf), al).filter(F.col("skill") != "")
    return EVAL.evaluate(truth, pred, keys=("doc_id",))


def _normalize_skills(spark, sf):
    al = K.alias_map(spark, _kb_m(spark, sf), extra=FX.user_aliases(spark))
    out = NZ.normalize_skill_list(FX.noisy_resume_skills(spark, sf), al)
    return out.select("resume_id", "n_raw", "n_skills", F.array_join("skills", "|").alias("skills"))


def _display_names(spark, sf):
    terms = (_kb(spark, sf).select(F.col("skill_key").alias("term"))
             .unionByName(FX.noisy_resume_skills(spark, sf).select(F.col("raw").alias("term"))).distinct())
    return terms.select("term", SK.display_name("term").alias("display_name"),
                        SK.curated_display("term").alias("curated_display"))


def _mi(spark, sf, lines=None):
    pur = FX.purchases(spark, sf, lines)
    return M.match_inputs(pur.select("resume_id", "job_id"), pur.select("resume_id", "skill"),
                          FX.job_skills(spark, sf))


QUERIES: dict[str, tuple[Builder, Callable[[], str] | None]] = {
    "match_summary": (_match_summary, O.match_summary_sql),
    "clean_documents": (lambda s, d: D.clean_documents(_docs(s, d)), O.clean_documents_sql),
    "sentence_counts": (lambda s, d: D.sentence_counts(_docs(s, d)), O.sentence_counts_sql),
    "trained_sentences": (lambda s, d: SEN.trained_sentences(_docs(s, d)), O.trained_sentences_sql),
    "word_tokens": (lambda s, d: D.word_tokens(_docs(s, d)), O.word_tokens_sql),
    "lemma_text": (lambda s, d: D.lemma_text(_docs(s, d)), O.lemma_text_sql),
    "induced_lemma_text": (lambda s, d: LEX.induced_lemma_text(_docs(s, d)), O.induced_lemma_text_sql),
    "assemble_pages": (_assemble_pages, O.assemble_pages_sql),
    "kb_software": (_kb_software, O.kb_software_sql),
    "csv_records": (_csv_records, O.csv_records_sql),
    "software_csv": (_software_csv, O.kb_software_sql),
    "kb_json_round_trip": (_kb_json_round_trip, O.kb_merge_sql),
    "alias_json_round_trip": (_alias_json_round_trip, O.alias_pairs_sql),
    "kb_essential": (_kb_essential, O.kb_essential_sql),
    "kb_merge": (_kb_merge, O.kb_merge_sql),
    "alias_variants": (_alias_variants, O.alias_variants_sql),
    "kb_totals": (_kb_totals, O.kb_totals_sql),
    "section_spans": (_section_spans, O.section_spans_sql),
    "special_terms": (_special_terms, O.special_terms_sql),
    "phrase_matches": (_phrase_matches, O.phrase_matches_sql),
    "longest_spans": (_longest_spans, O.longest_spans_sql),
    "extract_skills": (_extract_skills, O.extract_skills_sql),
    "skill_details": (_skill_details, O.skill_details_sql),
    "context_reject": (_context_reject, O.context_reject_sql),
    "valid_skills": (_valid_skills, O.valid_skills_sql),
    "tfidf_similarity": (lambda s, d: _tfidf(s, d, 5000)[0], lambda: O.tfidf_scores_sql(5000)),
    "tfidf_capped": (lambda s, d: _tfidf(s, d, TFIDF_SMALL_CAP)[0], lambda: O.tfidf_scores_sql(TFIDF_SMALL_CAP)),
    "top_shared_terms": (lambda s, d: _tfidf(s, d, 5000)[1], lambda: O.tfidf_top_sql(5000)),
    "fuzzy_pairs": (_fuzzy_pairs, O.fuzzy_pairs_sql),
    "fuzzy_assign": (_fuzzy_assign, O.fuzzy_assign_sql),
    "evidence_table": (_evidence_table, O.evidence_table_sql),
    "recommendations": (_recommendations, O.recommendations_sql),
    "alignment_counts": (_alignment_counts, O.alignment_counts_sql),
    "priority_counts": (_priority_counts, O.priority_counts_sql),
    "pair_summary": (_pair_summary, O.pair_summary_sql),
    "evaluate_extraction": (_evaluate_extraction, O.evaluate_extraction_sql),
    "evaluate_profiles": (_evaluate_profiles, O.evaluate_profiles_sql),
    "analyze_pairs": (_analyze_pairs, O.analyze_pairs_sql),
    "priority_buckets": (_priority_buckets, O.priority_buckets_sql),
    "evidence_map": (_evidence_map, O.evidence_map_sql),
    "skill_lists": (_skill_lists, O.skill_lists_sql),
    "fallback_extract": (_fallback_extract, O.fallback_extract_sql),
    "match_custom": (_match_custom, lambda: O.match_custom_sql(CUSTOM_THRESHOLD, CUSTOM_LEVELS)),
    "normalize_skills": (_normalize_skills, O.normalize_skills_sql),
    "display_names": (_display_names, O.display_names_sql),
}


def queries() -> dict[str, Builder]:
    return {k: v[0] for k, v in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1]() for k, v in QUERIES.items() if v[1] is not None}
