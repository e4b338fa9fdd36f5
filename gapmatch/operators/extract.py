"""PL-01: skill extraction with section evidence.

Detectors (ST-01):

* special symbol patterns (SC-07) on the whole cleaned text; the line of
  each match comes from newline counts of the text pieces before it;
* phrase dictionary (JN-02): line tokens -> n-grams of the lengths present in
  the dictionary -> equi-join with the (size-checked, broadcast) dictionary;
  overlapping matches are resolved longest-first (WN-02) inside small overlap
  islands;
* short acronyms (JN-03) as whole words.

Each raw term is validated (FLT-02), normalised through the alias map
(SC-05, JN-01), validated again, and mapped to the section of its line
(JN-04).  The evidence aggregate (AG-04) is the only wide step over all
detections; it partitions by document.

Phrases never cross a line break, and a token holding a URL or e-mail
address is one token, so ``github.com/x`` does not yield ``github``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions.skills import cleanup, display_name, is_valid_skill, probe_dot_slash, probe_hyphen
from ..functions.text import bound, clean_text, col, select_once
from ..plans.reuse import stored
from . import sections as S

# Token rule shared by text and dictionary (applied to lowercased text).  Each
# piece carries its leading whitespace so that consecutive pieces rebuild the
# original span text.
TOKEN_PIECE_RE = r"\s*(?:(?:https?://|www\.)\S+|\S+@\S+|[\pL\pN_]+(?:\.[\pL\pN_]+)*(?:\+\+|#)?|\S)"
# The same pieces of ASCII text that holds neither a URL nor an e-mail address.
PLAIN_PIECE_RE = r"\s*+(?:\w++(?:\.\w++)*+(?:\+\+|#)?+|\S)"
#: Tokens, one of each phrase, that a line is tested for by itself, at most; with more, lines go to the join untested.
ANCHORS = 20_000

def token_pieces(text) -> Column:
    return bound(F.lower(col(text)), _pieces_of_low)


def _pieces_of_low(low) -> Column:
    """The token pieces of lowercased text."""
    def cut(s):
        odd = F.octet_length(s) != F.char_length(s)
        for mark in ("@", "http", "www."):
            odd = odd | F.contains(s, F.lit(mark))
        return (F.when(odd, F.regexp_extract_all(s, F.lit(TOKEN_PIECE_RE), 0))
                .otherwise(F.regexp_extract_all(s, F.lit(PLAIN_PIECE_RE), 0)))

    return bound(col(low), cut)


def tokens_of(text) -> Column:
    return F.transform(token_pieces(text), lambda p: F.ltrim(p))


# ---------------------------------------------------------------------------
# Dictionary (ST-02, FLT-04)
# ---------------------------------------------------------------------------

def phrase_dictionary(kb_keys: DataFrame, aliases: DataFrame) -> DataFrame:
    """Phrases = KB keys union alias keys, pruned (FLT-04), as token keys.

    Returns (key STRING tokens joined by ' ', n INT token count).
    """
    return _phrases(kb_keys, aliases).select("key", "n").distinct()


def _phrases(kb_keys: DataFrame, aliases: DataFrame) -> DataFrame:
    """The dictionary's phrases with their text: (key, n, text), a key once for each of its texts."""
    ph = kb_keys.select(F.col("skill_key").alias("p")).unionByName(aliases.select(F.col("alias").alias("p")))
    ph = ph.select(F.col("p"), F.btrim(F.lower("p"), F.lit(" \t\n\r\x0b\x0c")).alias("ps")).distinct()
    ph = ph.filter((F.char_length("ps") >= 2) & ~F.col("ps").isin(sorted(L.BLOCKLIST)) & is_valid_skill("ps"))
    toks = tokens_of("p")
    return (ph.select(F.array_join(toks, " ").alias("key"), F.size(toks).alias("n"), F.col("ps").alias("text"))
            .filter(F.col("n") > 0).distinct())


# ---------------------------------------------------------------------------
# Detectors
# ---------------------------------------------------------------------------

def _doc_rows(docs: DataFrame) -> DataFrame:
    d = select_once(docs, ["doc_id"], clean=clean_text("text")).filter(F.col("clean") != "")
    return select_once(d, ["doc_id", "clean"], hdrs=S.headers("clean"))


def _line_rows(d: DataFrame) -> DataFrame:
    return d.select("doc_id", "hdrs", F.posexplode(S.lines("clean")).alias("line_no", "line"))


def special_matches(text="clean") -> Column:
    """SC-07: ARRAY<STRUCT<raw, line_no>> of every special-pattern match of cleaned ``text``, in any case.

    A text is cut only at the patterns whose fixed characters it holds; those
    of one letter, which every text holds, are looked for first, all at once.
    """
    return bound(F.lower(col(text)), _special_of_low)


def _special_of_low(low) -> Column:
    """The special-pattern matches of lowercased text."""
    breaks = lambda p: F.size(F.split(p, "\n", -1)) - 1
    patterns = _special_patterns()
    letters = [x for x in patterns if len(x[0]) == 1]
    # the letters first and then the patterns: other places fail at their first character
    any_letter = "(?=[" + "".join(x[0] for x in letters) + "])(?:" + "|".join(x[1] for x in letters) + ")"

    def cut(v):
        s = v["s"]
        return F.array(*[F.struct(F.lit(term).alias("term"), F.when(
            v["letter"] & F.contains(s, F.lit(fixed)) if len(fixed) == 1 else F.contains(s, F.lit(fixed)),
            F.transform(F.split(s, rx, -1), breaks)).otherwise(F.array(F.lit(0))).alias("nl"))
            for fixed, rx, term in patterns])

    once = bound(col(low), lambda s: F.struct(
        s.alias("s"), (s.rlike(any_letter) if letters else F.lit(False)).alias("letter")))
    return F.flatten(F.transform(bound(once, cut), _special_lines))


def _special_patterns() -> list[tuple[str, str, str]]:
    """(fixed characters of every match in lower case, pattern, term).

    A pattern that opens with a word boundary tests it after its characters:
    the search then tries a boundary only where they stand.
    """
    out = []
    for pat, term in L.SPECIAL_PATTERNS:
        chars = re.fullmatch(r"\(\?i\)(?:\\b|\(\?<![^)]*\))?((?:[\w#]|\\[.+])+?)((?:\\b)?(?:\(\?[!=].*\))?)", pat)
        opens, (body, rest) = pat.startswith(r"(?i)\b"), chars.groups()
        out.append((re.sub(r"\\(.)", r"\1", body).lower(), rf"(?i){body}(?<=\b{body}){rest}" if opens else pat, term))
    return out


def _special_lines(m) -> Column:
    """(raw, line_no) of each match of one pattern: line breaks in the pieces before it, added up."""
    init = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<raw:string,line_no:int>>").alias("out"))

    def step(acc, nl):
        at = acc["n"] + nl
        return F.struct(at.alias("n"), F.concat(acc["out"], F.array(
            F.struct(m["term"].alias("raw"), at.alias("line_no")))).alias("out"))

    # piece k precedes match k; the last piece follows the last match
    return F.aggregate(F.slice(m["nl"], 1, F.size(m["nl"]) - 1), init, step)["out"]


def special_terms(d: DataFrame) -> DataFrame:
    """SC-07 as a table: (doc_id, raw, line_no, section)."""
    x = select_once(d, ["doc_id", "hdrs"], _m=special_matches()).select("doc_id", "hdrs", F.inline("_m"))
    return x.select("doc_id", "raw", "line_no", S.section_of_line("hdrs", "line_no").alias("section"))


def dictionary_tokens(dictionary: DataFrame) -> DataFrame:
    """Every token that occurs in some dictionary phrase: (tok)."""
    return dictionary.select(F.explode(F.split("key", " ")).alias("tok")).distinct()


def _few_anchors(dictionary: DataFrame) -> list[str] | None:
    """The longest token of each phrase, if they are few enough to be tested inside a line, else None.

    A line that holds none of them holds no phrase, whatever full stops and
    hyphens it shares with the dictionary.
    """
    longest = F.array_max(F.transform(F.split("key", " "), lambda t: F.struct(
        F.char_length(t).alias("n"), t.alias("tok"))))
    rows = dictionary.select(longest["tok"].alias("tok")).distinct().limit(ANCHORS + 1).collect()
    return sorted(r["tok"] for r in rows) if len(rows) <= ANCHORS else None


def _grams_of(n: int) -> Column:
    """Runs of ``n`` consecutive tokens of a line's known tokens ``t`` (position, token, piece)."""
    t = F.col("t")
    starts = F.filter(
        F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(1))),
        lambda k: (k + n - 1 <= F.size(t))
        & (F.element_at(t, k + n - 1)["p"] - F.element_at(t, k)["p"] == n - 1))
    return F.transform(starts, lambda k: F.struct(
        F.element_at(t, k)["p"].alias("start"), F.lit(n).alias("n"),
        F.array_join(F.transform(F.slice(t, k, n), lambda x: x["tok"]), " ").alias("key"),
        F.ltrim(F.array_join(F.transform(F.slice(t, k, n), lambda x: x["piece"]), "")).alias("raw")))


def _found(lines: DataFrame, dictionary: DataFrame) -> DataFrame:
    """JN-02 inside lines ``(doc_id, line_no, section, direct, pieces)``: per line ``direct`` and the phrases ``c``.

    A phrase consists of dictionary tokens only, so tokens are first exploded
    (a code-generated generator) and joined with the dictionary's token set;
    a line without the longest token of any phrase is not exploded;
    n-grams are then built per line over consecutive surviving tokens and
    equi-joined with the dictionary.  Only survivors are shuffled.  ``direct``
    holds the terms that a line has without the dictionary; it goes along in a
    row of its own, whose key no token has and which spreads by line.  ``c``
    is sorted for the longest span first: (neg, start, end, raw), start from 1.
    """
    pieces, few = F.col("pieces"), _few_anchors(dictionary)
    if few is not None:
        known_here = F.exists(pieces, lambda p: F.ltrim(p).isin(few)) if few else F.lit(False)
        pieces = F.when(known_here, pieces).otherwise(F.array().cast("array<string>"))
    tok = lines.select("doc_id", "line_no", "section", F.posexplode(F.concat(
        F.array(F.lit(None).cast("string")), pieces)).alias("i", "piece"), "direct")
    tok = tok.filter((F.col("i") > 0) | (F.size("direct") > 0))
    alone = F.concat(F.lit("\n"), F.xxhash64("doc_id", "line_no").cast("string"))
    tok = tok.withColumn("direct", F.when(F.col("i") == 0, F.col("direct"))).withColumn(
        "tok", F.when(F.col("i") == 0, alone).otherwise(F.ltrim("piece")))
    known = dictionary_tokens(dictionary).withColumn("known", F.lit(True))
    tok = tok.join(known, "tok", "left").filter(F.col("known") | (F.col("i") == 0))
    per_line = tok.groupBy("doc_id", "line_no").agg(
        F.first("section").alias("section"), F.max("direct").alias("direct"),
        F.sort_array(F.collect_list(F.when(F.col("known"), F.struct(F.col("i").alias("p"), "tok", "piece")))).alias("t"))
    lens = sorted(r["n"] for r in dictionary.select("n").distinct().collect())
    grams = F.flatten(F.array(*[_grams_of(n) for n in lens]))
    own = F.transform(F.coalesce("direct", F.array().cast("array<string>")), lambda r: F.struct(
        F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("key"), r.alias("raw")))
    # a computed list leaves through ``select_once``: an explode's own condition on it would build it once more
    g = select_once(per_line, ["doc_id", "line_no", "section"], _g=F.concat(grams, own)).select(
        "doc_id", "line_no", "section", F.inline("_g"))
    phrase = dictionary.select("key").distinct().withColumn("found", F.lit(True))
    key = F.coalesce("key", F.concat(F.lit("\n"), F.xxhash64("doc_id", "line_no", "raw").cast("string")))
    g = g.withColumn("key", key).join(phrase, "key", "left").filter(F.col("found") | (F.col("n") == 0))
    return g.groupBy("doc_id", "line_no").agg(
        F.first("section").alias("section"),
        F.collect_list(F.when(F.col("n") == 0, F.col("raw"))).alias("direct"),
        F.sort_array(F.collect_list(F.when(F.col("n") > 0, F.struct(
            (-F.col("n")).alias("neg"), "start", (F.col("start") + F.col("n")).alias("end"), "raw")))).alias("c"))


def phrase_spans(lines: DataFrame, dictionary: DataFrame) -> DataFrame:
    """JN-02: every dictionary phrase occurrence in a line.

    (doc_id, line_no, start, n, raw, section) with 1-based token positions.
    """
    ln = select_once(lines, ["doc_id", "line_no"], section=S.section_of_line("hdrs", "line_no"),
                     direct=F.array().cast("array<string>"), pieces=token_pieces("line"))
    f = _found(ln, dictionary).select("doc_id", "line_no", "section", F.explode("c").alias("k"))
    return f.select("doc_id", "line_no", "k.start", (-F.col("k.neg")).alias("n"), "k.raw", "section")


def _longest(c, kind: str) -> Column:
    """WN-02 in a line: of its spans, longest first, those that overlap none taken before."""
    def step(acc, x):
        clash = F.exists(acc, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"]))
        return F.when(clash, acc).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(c, F.array().cast(kind), step)


SPAN = "neg:int,start:int,end:int,raw:string"


def longest_spans(spans: DataFrame) -> DataFrame:
    """WN-02: keep longest spans first (earlier start on ties), dropping overlaps, inside each line."""
    g = spans.groupBy("doc_id", "line_no").agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("n")).alias("neg"), "start", (F.col("start") + F.col("n")).alias("end"), "raw", "section"))).alias("c"))
    g = select_once(g, ["doc_id", "line_no"], kept=_longest("c", f"array<struct<{SPAN},section:string>>"))
    kept = g.select("doc_id", "line_no", F.explode("kept").alias("k"))
    return kept.select("doc_id", "line_no", F.col("k.start").alias("start"), (-F.col("k.neg")).alias("n"), "k.raw", "k.section")


def _acronym_matches(aliases: DataFrame) -> Column | None:
    """JN-03: the whole-word acronyms of the lowercased ``line`` that are alias keys, None where no alias is one."""
    acr = _acronyms(aliases)
    rx = r"\b(" + "|".join(acr) + r")\b"
    return F.array_distinct(F.regexp_extract_all(F.col("line"), F.lit(rx), 1)) if acr else None


def acronym_terms(lines: DataFrame, aliases: DataFrame) -> DataFrame:
    """JN-03: whole-word acronyms that are alias keys -> (doc_id, raw, line_no, section)."""
    found = _acronym_matches(aliases)
    if found is None:
        found = F.array().cast("array<string>")
    lines = lines.withColumn("line", F.lower("line"))
    x = select_once(lines, ["doc_id", "line_no", "hdrs"], _raw=found).select(
        "doc_id", "line_no", "hdrs", F.explode("_raw").alias("raw"))
    return x.select("doc_id", "raw", "line_no", S.section_of_line("hdrs", "line_no").alias("section"))


# ---------------------------------------------------------------------------
# Normalisation (SC-05 + JN-01)
# ---------------------------------------------------------------------------

def normalize(df: DataFrame, aliases: DataFrame, src: str = "raw", out: str = "skill") -> DataFrame:
    """Alias resolution with three probes (cleaned, hyphen->space, dot/slash->space)."""
    a = aliases.select("alias", "canonical")
    s = df.withColumn("_s", cleanup(src))
    for i, probe in enumerate([F.col("_s"), probe_hyphen("_s"), probe_dot_slash("_s")]):
        s = s.withColumn(f"_p{i}", probe)
        s = s.join(a.select(F.col("alias").alias(f"_p{i}"), F.col("canonical").alias(f"_c{i}")), f"_p{i}", "left")
    res = F.when(F.col("_s") == "", F.lit("")).otherwise(F.coalesce("_c0", "_c1", "_c2", "_s"))
    return s.withColumn(out, res).drop("_s", "_p0", "_p1", "_p2", "_c0", "_c1", "_c2")


# ---------------------------------------------------------------------------
# PL-01
# ---------------------------------------------------------------------------

def prepare(kb_keys: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The alias map and the phrase dictionary, each written once.

    Vocabulary-sized files have a size that is known before the texts are
    read, so a small one is sent to the tokens and no token is shuffled.
    """
    al = stored(aliases.select("alias", "canonical"))
    return al, stored(phrase_dictionary(kb_keys, al))


def _acronyms(aliases: DataFrame) -> list[str]:
    keys = {r["alias"] for r in aliases.filter(F.col("alias").isin(L.ACRONYM_CANDIDATES)).select("alias").collect()}
    return [a for a in L.ACRONYM_CANDIDATES if a in keys]


def candidates(docs: DataFrame, aliases: DataFrame, dictionary: DataFrame) -> DataFrame:
    """ST-01: raw terms of the three detectors, in one pass: (doc_id, raw, line_no, section).

    A document is cleaned and lowercased once.  Its lines carry their section, their special
    and acronym terms (complete by themselves) and their tokens; only tokens
    of the dictionary go on, are put together per line, and the phrases found
    are resolved longest-first inside the line.
    """
    d = select_once(_doc_rows(docs), ["doc_id", "hdrs"], low=F.lower("clean"))
    d = select_once(d, ["doc_id", "low", "hdrs"], sp=_special_of_low("low"))
    direct = F.transform(F.filter("sp", lambda m: m["line_no"] == F.col("line_no")), lambda m: m["raw"])
    acronyms = _acronym_matches(aliases)
    if acronyms is not None:
        direct = F.concat(direct, acronyms)
    ln = d.select("doc_id", "hdrs", "sp", F.posexplode(S.lines("low")).alias("line_no", "line"))
    ln = select_once(ln, ["doc_id", "line_no"], section=S.section_of_line("hdrs", "line_no"), direct=direct,
                     pieces=_pieces_of_low("line"))
    spans = _found(ln, dictionary)
    kept = F.transform(_longest("c", f"array<struct<{SPAN}>>"), lambda k: F.btrim(k["raw"], F.lit(" ")))
    spans = select_once(spans, ["doc_id", "line_no", "section"], _raw=F.concat("direct", kept))
    return spans.select("doc_id", F.explode("_raw").alias("raw"), "line_no", "section")


def detections(docs: DataFrame, kb_keys: DataFrame, aliases: DataFrame, prepared=None) -> DataFrame:
    """All accepted detections: (doc_id, skill, section display name)."""
    al, dictionary = prepared or prepare(kb_keys, aliases)
    cand = candidates(docs, al, dictionary)
    cand = cand.filter(is_valid_skill("raw"))
    cand = normalize(cand, al)
    cand = cand.filter((F.col("skill") != "") & is_valid_skill("skill"))
    return cand.select("doc_id", "skill", S.display("section").alias("section"))


def section_rank(sec) -> Column:
    kv = []
    for i, s in enumerate(L.SECTION_ORDER):
        kv += [F.lit(s), F.lit(i)]
    return F.coalesce(F.try_element_at(F.create_map(*kv), col(sec)), F.lit(99))


def extract_skills(docs: DataFrame, kb_keys: DataFrame, aliases: DataFrame, prepared=None) -> DataFrame:
    """PL-01 result: one row per (doc_id, skill).

    Columns: doc_id, skill, display_name, sections ARRAY<STRING> (fixed
    precedence, SO-02), evidence (SC-13).
    """
    det = detections(docs, kb_keys, aliases, prepared)
    g = det.groupBy("doc_id", "skill").agg(F.collect_set("section").alias("secs"))
    ordered = F.transform(F.sort_array(F.transform("secs", lambda s: F.struct(section_rank(s).alias("r"),
                                                                               s.alias("s")))),
                          lambda x: x["s"])
    return g.select("doc_id", "skill", display_name("skill").alias("display_name"), ordered.alias("sections"),
                    F.array_join(ordered, " + ").alias("evidence"))


def skill_details(extracted: DataFrame, kb: DataFrame) -> DataFrame:
    """JN-09: attach KB metadata; defaults for skills missing from the KB."""
    k = kb.select("skill_key", "category", "hot_technology", "in_demand", "importance_score")
    j = extracted.join(k, extracted.skill == k.skill_key, "left")
    return j.select(
        "doc_id", F.col("skill").alias("skill_key"), "display_name",
        F.coalesce("category", F.lit(L.DEFAULT_CATEGORY_EXTRACTED)).alias("category"),
        F.coalesce("hot_technology", F.lit(False)).alias("hot_technology"),
        F.coalesce("in_demand", F.lit(False)).alias("in_demand"),
        F.coalesce("importance_score", F.lit(0.0)).alias("importance_score"),
        "evidence", "sections",
    )


def fallback_kb(spark: SparkSession) -> DataFrame:
    """SRC-10: fixed dictionary used when no knowledge base exists."""
    fb = L.fallback_kb_df(spark)
    return fb.select("skill_key", display_name("skill_key").alias("name"),
                     F.lit(L.DEFAULT_CATEGORY_EXTRACTED).alias("category"), F.lit(True).alias("hot_technology"),
                     F.lit(True).alias("in_demand"), F.lit("software").alias("skill_type"),
                     F.lit(0).cast("bigint").alias("occupations_count"),
                     F.array().cast("array<string>").alias("soc_codes"), F.lit(0.0).alias("importance_score"))


def context_rejections(docs: DataFrame) -> DataFrame:
    """FLT-05 on its own: every whole-word company/platform mention with its
    +-60 character window tested against the contact indicators.

    (doc_id, term, offset, line_no, rejected).  Offsets are running sums over
    the text pieces between mentions; only the windows leave the row.
    """
    d = select_once(docs, ["doc_id"], clean=clean_text("text")).filter(F.col("clean") != "")
    names = sorted(L.COMPANY_PLATFORM_NAMES)
    rx = r"\b(?:" + "|".join(n.replace(".", r"\.") for n in names) + r")\b"
    low = F.lower(F.col("clean"))
    d = d.select("doc_id", "clean", F.split(low, rx, -1).alias("pc"),
                 F.regexp_extract_all(low, F.lit(rx), 0).alias("ms"))
    d = d.filter(F.size("ms") > 0)
    # one running sum over the pieces gives every mention's offset and line
    init = F.struct(F.lit(0).alias("off"), F.lit(0).alias("nl"),
                    F.array().cast("array<struct<term:string,off:int,line_no:int>>").alias("out"))

    def step(acc, x):
        off = acc["off"] + F.char_length(x["pc"])
        nl = acc["nl"] + F.char_length(x["pc"]) - F.char_length(F.replace(x["pc"], F.lit("\n"), F.lit("")))
        one = F.struct(x["ms"].alias("term"), off.alias("off"), nl.alias("line_no"))
        return F.struct((off + F.char_length(x["ms"])).alias("off"), nl.alias("nl"),
                        F.concat(acc["out"], F.array(one)).alias("out"))

    zipped = F.arrays_zip(F.slice("pc", 1, F.size("ms")).alias("pc"), F.col("ms"))
    d = select_once(d, ["doc_id", "clean"], found=F.aggregate(zipped, init, step)["out"])

    def window(m):
        lo = F.greatest(F.lit(0), m["off"] - L.CONTEXT_WINDOW)
        hi = F.least(F.char_length("clean"), m["off"] + F.char_length(m["term"]) + L.CONTEXT_WINDOW)
        return F.lower(F.substring(F.col("clean"), lo + 1, hi - lo))

    x = d.select("doc_id", F.inline(F.transform("found", lambda m: F.struct(
        m["term"].alias("term"), m["off"].alias("off"), m["line_no"].alias("line_no"), window(m).alias("window")))))
    contact = "|".join("(?:" + p + ")" for p in L.CONTACT_INDICATORS)
    return x.select("doc_id", "term", F.col("off").cast("bigint").alias("offset"),
                    F.col("line_no").cast("bigint").alias("line_no"), F.col("window").rlike(contact).alias("rejected"))


def skill_lists(extracted: DataFrame) -> DataFrame:
    """SO-01: sorted distinct skill list per document -> (doc_id, skills)."""
    return extracted.groupBy("doc_id").agg(F.sort_array(F.collect_set("skill")).alias("skills"))
