"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    alignment,
    importance,
    line_templates,
    lm,
    mixing,
    passages,
    pieces,
    prefix_trie,
    projection,
    rule_ensemble,
    setsketch,
    topk,
    warc,
)
from .common import table


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents")).drop("k")


OP1_SQL = """
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh
      FROM w),
e AS (SELECT rid, doc_id, len(sh) AS n, unnest(sh) AS x FROM s WHERE doc_id IS NOT NULL),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS n_both
      FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.rid, b.rid, a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p WHERE 100 * n_both >= 85 * (na + nb - n_both)),
links AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach(a, b) AS (SELECT a, a FROM links UNION SELECT r.a, k.b FROM reach r JOIN links k ON r.b = k.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id,
       coalesce(component_id, doc_id) = doc_id AS kept
FROM s LEFT JOIN c ON c.a = s.doc_id
"""


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = warc.archive(table(spark, sf_dir, "pages"))
    return warc.read_records(index, folder, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


OP2_SQL = """
WITH p AS (
  SELECT page_id, url, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN first_id < p.page_id OR (p.page_id IS NULL AND first_id IS NOT NULL)
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id < p.page_id OR p.page_id IS NULL THEN first_id END AS refers_to,
       p.url
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
"""


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.fit_and_score(table(spark, sf_dir, "documents"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def piece_model() -> str:
    """The path of the public 32k BPE model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), pieces.load(piece_model()))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = rule_ensemble.fit(docs, table(spark, sf_dir, "labels"))
    return rule_ensemble.score(docs, rules).select(
        "doc_id", rule_ensemble.held_out().alias("held_out"), "score", "predicted")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_templates.drop_template_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"),
                      F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped_lines"), "clean_text")


OP7_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l0 AS (SELECT rid, text, len(list_filter(lines, lambda x: NOT regexp_full_match(x, '[\\x20\\x09-\\x0D]*'))) AS n_full,
              unnest(lines) AS line, unnest(range(0, len(lines))) AS pos FROM d WHERE text IS NOT NULL),
l1 AS (SELECT rid, text, n_full, pos, list_transform(
         list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''),
         lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS tk FROM l0),
l AS (SELECT *, md5(len(tk) || ' ' || array_to_string(tk[1:3], ' ')) AS leaf FROM l1 WHERE len(tk) >= 4),
leaves AS (SELECT leaf, count(DISTINCT text) AS texts FROM l GROUP BY leaf HAVING count(DISTINCT text) >= 10),
cand AS (SELECT l.*, texts FROM l JOIN leaves USING (leaf)),
at_ AS (SELECT DISTINCT leaf, texts, text, unnest(range(1, len(tk) + 1)) AS p, unnest(tk) AS tok FROM cand),
fixed AS (SELECT leaf, list(p || ' ' || tok) AS fixed FROM
            (SELECT leaf, p, tok FROM at_ WHERE tok <> '<*>' GROUP BY leaf, texts, p, tok
             HAVING count(*) >= 10 AND count(*) * count(*) >= texts) GROUP BY leaf),
t0 AS (SELECT cand.*, list_transform(range(1, len(tk) + 1), lambda i:
                CASE WHEN list_contains(coalesce(fixed, []), i || ' ' || tk[i]) THEN tk[i] ELSE '<*>' END) AS tmpl
       FROM cand LEFT JOIN fixed USING (leaf)),
t1 AS (SELECT *, CASE WHEN len(list_filter(tmpl, lambda x: x <> '<*>')) >= 0.7 * len(tk)
                      THEN array_to_string(tmpl, ' ') END AS own FROM t0),
often AS (SELECT leaf, own, any_value(tmpl) AS tmpl, count(DISTINCT text) AS n FROM t1 WHERE own IS NOT NULL
          GROUP BY leaf, own HAVING count(DISTINCT text) >= 10),
top AS (SELECT leaf, own AS top_own, tmpl AS top FROM often
        QUALIFY row_number() OVER (PARTITION BY leaf ORDER BY n DESC, own) = 1),
m AS (SELECT rid, text, n_full, pos, CASE WHEN often.own IS NOT NULL THEN 'leaf ' || t1.leaf || t1.own
               WHEN top IS NOT NULL AND len(list_filter(range(1, len(tk) + 1),
                 lambda i: tk[i] = top[i] AND top[i] <> '<*>')) >= 0.7 * len(tk) THEN 'leaf ' || t1.leaf || top_own
               ELSE 'line ' || array_to_string(tk, ' ') END AS tid
      FROM t1 LEFT JOIN often ON often.leaf = t1.leaf AND often.own = t1.own LEFT JOIN top ON top.leaf = t1.leaf),
each0 AS (SELECT tid, text, any_value(n_full) AS n_full, count(DISTINCT pos) AS lines FROM m GROUP BY tid, text),
each_ AS (SELECT *, count(*) OVER (PARTITION BY tid) AS texts FROM each0 QUALIFY texts >= 10),
witness AS (SELECT text FROM each_ GROUP BY text HAVING any_value(n_full) - sum(lines) >= 0.2 * any_value(n_full)),
rec AS (SELECT tid FROM each_ JOIN witness USING (text) GROUP BY tid, texts
        HAVING count(*) >= 10 AND count(*) >= 0.5 * texts),
drops AS (SELECT rid, list(DISTINCT pos) AS drops FROM m JOIN rec USING (tid) GROUP BY rid)
SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(drops), 0) AS BIGINT) AS n_dropped,
       coalesce(array_to_string(list_sort(drops), ','), '') AS dropped_lines,
       CASE WHEN drops IS NULL THEN text ELSE array_to_string(list_transform(
         list_filter(range(0, len(lines)), lambda i: NOT list_contains(drops, i)), lambda i: lines[i + 1]), chr(10))
       END AS clean_text
FROM d LEFT JOIN drops USING (rid)
"""


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    out = importance.judge(table(spark, sf_dir, "documents"), trusted)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "kept", "score")


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = passages.remove_repeats(table(spark, sf_dir, "documents"))
    words = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["words"])
    offsets = F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    return out.select("doc_id", F.size("spans").cast("long").alias("n_spans"), words.alias("removed_words"),
                      F.array_join(offsets, ",").alias("removed_spans"),
                      F.transform("spans", lambda s: s["kept_doc_id"]).alias("kept_doc_ids"), "clean_text")


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.per_document(mixing.mix(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "rate")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a = alignment.ByteTokens.load(public_tokenizers.path("byte_bpe_50k.json"))
    return alignment.align(table(spark, sf_dir, "documents"), a, alignment.PieceTokens(piece_model()))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.ordered_turns(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(*prefix_trie.rebuilt(turns))


OP12_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn NULLS FIRST, role, text) AS turns,
               list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)) AS bytes
        FROM t GROUP BY conv_id),
h AS (SELECT conv_id, turns, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(bytes,
        lambda b: [CAST(b AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 4 AS h
      FROM own),
full_ AS (SELECT h.conv_id, list_concat(coalesce(b.turns, [])[1:h], h.turns[h + 1:]) AS turns
          FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 20),
at_ AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM full_),
pre AS (SELECT conv_id, d, d = len(turns) AS ends, md5(CAST(turns[1:d] AS VARCHAR)) AS k,
               CASE WHEN d > 0 THEN md5(CAST(turns[1:d - 1] AS VARCHAR)) END AS pk,
               CASE WHEN d > 0 THEN len(regexp_extract_all(turns[d].t, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS w FROM at_),
node AS (SELECT k, d, any_value(pk) AS pk, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
                coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ends
         FROM pre GROUP BY k, d),
kids AS (SELECT pk, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY pk, d),
n2 AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids ON kids.pk = node.k AND kids.d = node.d),
up AS (SELECT a.k, a.d, count(*) FILTER (WHERE n2.n_children = 0) AS n_leaves, sum((n2.n_convs - 1) * n2.w) AS saved
       FROM n2 JOIN pre a ON a.conv_id = n2.conv_id AND a.d <= n2.d GROUP BY a.k, a.d)
SELECT n2.conv_id, n2.d AS depth, p.conv_id AS parent_conv_id, n2.n_convs, n2.n_children, n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(n2.ends) AS ends_sha256
FROM n2 JOIN up ON up.k = n2.k AND up.d = n2.d LEFT JOIN node p ON p.k = n2.pk AND p.d = n2.d - 1
"""


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.near_vectors(table(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH RECURSIVE v AS (
  SELECT DISTINCT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT a, a FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
       coalesce(component_id, vec_id) IS NOT DISTINCT FROM vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""


QUERIES = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_warc": op2_warc,
    "op3_lm_scores": op3_lm_scores,
    "op4_top_k": op4_top_k,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_quality": op6_quality,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_repeated_passages": op9_repeated_passages,
    "op10_mix": op10_mix,
    "op11_alignment": op11_alignment,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_near_vectors": op13_near_vectors,
}

ORACLE_SQL = {
    "op1_near_duplicates": OP1_SQL,
    "op2_warc": OP2_SQL,
    "op4_top_k": OP4_SQL,
    "op7_line_dedup": OP7_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op13_near_vectors": OP13_SQL,
}
