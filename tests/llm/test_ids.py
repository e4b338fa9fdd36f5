"""Ids above 2^53 come back unchanged, also beside a row without an id."""

import pytest
from pyspark.sql import functions as F

from gapmatch.llm import alignment, importance, lm, mixing, passages, pieces, projection, rule_ensemble, setsketch
from gapmatch.llm import line_templates, topk, warc

BIG = [2**60 + 1, 2**60 + 3, 2**53 + 1, None, 7]
TEXT = "some words of a text that is long enough to have a few shingles, number {} of all "


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, TEXT.format(k) * 6 + ("same line at the end\n" * 2), "en", "s", 9) for k, i in enumerate(BIG)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


def ids(df, name="doc_id"):
    return sorted((r[0] for r in df.select(name).collect()), key=lambda x: (x is None, x))


def piece_path():
    import public_tokenizers as P
    return P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json")


OPERATORS = {
    "op1": lambda d: setsketch.near_duplicates(d),
    "op3": lambda d: lm.fit_and_score(d),
    "op5": lambda d: pieces.round_trip(d, pieces.load(piece_path()[0])),
    "op5 tokenized": lambda d: pieces.tokenized(d, pieces.load(piece_path()[0])),
    "op7": lambda d: line_templates.drop_template_lines(d),
    "op8": lambda d: importance.judge(d, d.select("doc_id").limit(2)),
    "op9": lambda d: passages.remove_repeats(d),
    "op10": lambda d: mixing.per_document(mixing.mix(d)),
    "op11": lambda d: alignment.align(d, alignment.ByteTokens.load(piece_path()[1]), alignment.PieceTokens(piece_path()[0])),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_document_ids(docs, name):
    assert ids(OPERATORS[name](docs)) == sorted(BIG, key=lambda x: (x is None, x or 0))


def test_quality_ids(spark, docs):
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).filter("doc_id is not null")
    out = rule_ensemble.score(docs, rule_ensemble.fit(docs, labels))
    assert ids(out) == sorted(BIG, key=lambda x: (x is None, x or 0))


def test_pages_and_what_they_refer_to(spark):
    html = "<p>" + "a page of some length " * 20
    pages = spark.createDataFrame([(i, html, "u") for i in BIG] + [(2**60 + 5, "x" * 200_000, "v")],
                                  "page_id long, html string, url string").coalesce(1)
    index, folder = warc.archive(pages.filter("page_id is null or page_id > 8"))
    got = {r["page_id"]: r for r in warc.read_records(index, folder).collect()}
    assert set(got) == {*BIG, 2**60 + 5} - {7}
    assert {i: got[i]["refers_to"] for i in got} == {2**53 + 1: None, 2**60 + 1: 2**53 + 1, 2**60 + 3: 2**53 + 1, None: 2**53 + 1,
                                                     2**60 + 5: None}
    assert bytes(got[2**53 + 1]["payload"]).decode() == html
    index, folder = warc.archive(pages.filter(f"page_id > {2**53 + 1}"))
    assert {r["page_id"]: r["refers_to"] for r in warc.read_records(index, folder, payloads=False).collect()} == {
        2**60 + 1: None, 2**60 + 3: 2**60 + 1, 2**60 + 5: None}


def test_payloads_leave_the_reader_in_bounded_batches(spark, monkeypatch):
    pages = spark.createDataFrame([(k, f"{k}" * 3000, "u") for k in range(40)], "page_id long, html string, url string")
    index, folder = warc.archive(pages.coalesce(1))
    monkeypatch.setattr(warc, "OUT_BYTES", 9000)


    got = warc.read_records(index, folder)
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in got.collect()} == {k: f"{k}" * 3000 for k in range(40)}


def test_vectors(spark):
    rows = [(i, [1.0, 0.1 * k], 1) for k, i in enumerate(BIG)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1)
    assert ids(projection.near_vectors(v), "vec_id") == sorted(BIG, key=lambda x: (x is None, x or 0))
    best = topk.top_k(v, F.lit(True), 2).collect()
    assert {r["query_id"] for r in best} == set(BIG) - {None} >= {r["vec_id"] for r in best}


def test_scores_do_not_depend_on_how_rows_are_split(spark, monkeypatch):
    import numpy as np
    r = np.random.RandomState(4)
    rows = [(k, " ".join(r.choice(["ab", "bc", "cd", "de", "ef", "fg"], r.randint(5, 60)))) for k in range(120)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(lm, "SHARD", 500)  # several shards
    monkeypatch.setattr(lm, "TOGETHER", 3)  # averaged in several steps
    one, many = ({x["doc_id"]: x["score"] for x in lm.fit_and_score(d.repartition(n)).collect()} for n in (1, 7))
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-3 for k in one)


def test_a_very_long_text_is_scored_in_little_memory():
    import tracemalloc

    import numpy as np

    from gapmatch.llm import recurrent
    flat = recurrent.initial(np.ones(recurrent.WORDS), 1.0)
    long, short = np.ones(200_000, dtype=np.int16), [np.ones(20, dtype=np.int16)] * 255
    alone = recurrent.score(flat, short[:1])[0]
    tracemalloc.start()
    got = recurrent.score(flat, [long, *short])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # 256 streams of that length would take over 350 MB
    assert np.allclose(got[1:], alone, atol=1e-4) and np.isfinite(got[0])
