"""Training-data operators against brute force, on small documents with edge cases."""

import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapmatch.llm import importance, line_templates, lm, mixing, passages, pieces, rule_ensemble, setsketch, topk, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string"


def prose(seed: int, n: int) -> str:
    r = np.random.RandomState(seed)
    out = []
    for k in range(n):
        w = "".join(r.choice(list("abcdefghij"), r.randint(2, 8)))
        out.append(w + (".\n" if k % 23 == 22 else "." if k % 9 == 8 else ""))
    return " ".join(out)


def corpus() -> list[tuple]:
    base = prose(1, 200)
    words = base.split(" ")
    near = " ".join([*words[:100], "changed", *words[101:]])
    chain = " ".join([*words[:100], "changed", *words[101:150], "twice", *words[151:]])
    boiler = "All rights reserved by the owner of site number %d."
    texts = [None, "", "   \n\t ", "one", "a b c", "a B c", base, base, near, chain, prose(2, 6000),
             "é ñ 中文 😀 ▁ x", "DUP line here again\nDUP line here again\nother words are here too"]
    texts += [prose(100 + k, 60) + "\n" + boiler % k + "\n" + prose(300 + k, 40) for k in range(16)]
    texts += ["$$$ ### %%% " * 30, prose(1, 200).upper()]
    src = ["a", "b", None, "c"]
    rows = [(k * 3, t, "en", src[k % 4], None if t is None else len(t), 9.0, "x") for k, t in enumerate(texts)]
    rows.append(rows[6])  # a repeated row
    rows.append((None, base, None, None, None, None, None))
    rows.append((None, "no id and no copy of this text anywhere else", None, "a", None, None, None))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text) -> frozenset:
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows) -> dict:
    """doc_id -> least id reachable, over rows (doc_id, text)."""
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            if any(a and b and 100 * len(a & b) >= 85 * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: top(i) for i in ids}


def test_near_duplicates(docs, empty):
    rows = [(r[0], r[1]) for r in corpus() if r[0] is not None]
    want = brute_components(rows)
    got = setsketch.near_duplicates(docs).collect()
    assert len(got) == len(corpus())
    text = {}
    for r in corpus():
        text.setdefault(r[0], r[1])
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id]
            assert r.n_shingles == len(shingles(text[r.doc_id]))
            assert r.kept == (r.component_id == r.doc_id)
    assert sorted((r.component_id is None, r.kept) for r in got if r.doc_id is None) == [(False, False), (True, True)]
    assert len({want[i] for i in (18, 21, 24, 27)}) == 1  # copies, a near copy, and one reached through it
    kept = setsketch.keep_one(docs, setsketch.near_duplicates(docs))
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == Counter({c: 1 for c in set(want.values())} | {None: 1})
    assert setsketch.near_duplicates(empty).count() == 0


def test_near_duplicates_in_large_buckets(spark, monkeypatch):
    """A bucket with many members and several components, in blocks of a few rows."""
    monkeypatch.setattr(setsketch, "BLOCK", 8)
    r = np.random.RandomState(7)
    base = prose(50, 120).split(" ")
    rows = []
    for k in range(60):
        w = list(base)
        for at in r.choice(len(w), r.randint(0, 5), replace=False):
            w[at] = f"edit{k}x{at}"
        rows.append((k * 2 + 1, " ".join(w)))
    want = brute_components(rows)
    got = setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x.doc_id: x.component_id for x in got.collect()} == want


def test_estimate_is_near_the_similarity():
    r = np.random.RandomState(3)
    for share in (0.2, 0.6, 0.85, 0.95):
        both = r.randint(0, 2**63, 2000, dtype=np.int64).astype(np.uint64)
        n = int(2000 * share)
        rest = int((2000 - n) / 2)
        a, b = both[:n + rest], np.append(both[:n], both[n + rest:n + 2 * rest])
        got = setsketch.estimate(setsketch.registers(np.sort(a))[None], setsketch.registers(np.sort(b))[None],
                                 np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(got - n / (n + 2 * rest)) < 0.17
    u = setsketch.registers(np.sort(both))
    assert (u == np.maximum(setsketch.registers(np.sort(both[:900])), setsketch.registers(np.sort(both[900:])))).all()


def test_warc_round_trip(spark):
    page = "<html>" + "x" * 200 + "\r\n\r\n é 中</html>"
    rows = [(5, "http://a/\r\nX: 1", page, 1), (2, None, page, 1), (9, "u", page, 1), (1, "u", None, 1),
            (3, "u", "", 1), (4, "u", "short", 1), (6, "u", "short", 1), (2, None, page, 1), (None, "u", page, 1),
            (None, "u", "WARC/1.1\r\n\r\n" * 30, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, file int").repartition(3)
    index, folder = warc.archive(pages)
    got = warc.read_records(index, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        want = [p for p in rows if p[0] == r.page_id and (p[2] or "").encode() == (r.payload or b"")
                or r.record_type == "revisit" and p[0] == r.page_id]
        payload = (want[0][2] or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
        if r.record_type == "response":
            assert r.payload == payload and r.refers_to is None
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in got if r.payload_bytes >= 100)
    assert kinds == Counter({(2, "response", None): 2, (5, "revisit", 2): 1, (9, "revisit", 2): 1,
                             (None, "revisit", 2): 1, (None, "response", None): 1})
    some = warc.read_records(index.filter("page_id = 4"), folder).collect()
    assert [r.payload for r in some] == [b"short"]
    assert warc.read_records(*warc.archive(pages.filter("false"))).count() == 0


def test_ranges_share_reads():
    e = [("a", 0, 10), ("a", 10, 5), ("a", 40, 5), ("b", 0, 7), ("b", 0, 7)]
    got = list(warc.ranges(e, gap=3, most=100))
    assert [(f, s, z, len(r)) for f, s, z, r in got] == [("a", 0, 15, 2), ("a", 40, 45, 1), ("b", 0, 7, 2)]


def test_lm_base_and_gain(docs, empty):
    got = lm.fit_and_score(docs).collect()
    rows = [(r[0], r[1]) for r in corpus()]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    toks = lambda t: [*WORD.findall((t or "").translate(LOWER)), None]
    c = Counter(w for i, t in rows if not out(i) for w in toks(t))
    n, v = sum(c.values()), len(c)
    want = Counter((i if i is not None else -1, out(i), len(toks(t)), sum(w in c for w in toks(t)), n,
                    round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in toks(t)), 6)) for i, t in rows)
    assert Counter((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens,
                    round(r.base_score, 6)) for r in got) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert sum(r.score for r in got if not r.held_out) > sum(r.base_score for r in got if not r.held_out)
    assert lm.fit_and_score(empty).count() == 0


def test_network_has_its_measured_size():
    """The size with the better held-out score, see README; no smaller one for speed."""
    from gapmatch.llm import recurrent as R

    assert (R.HIDDEN, R.EMBED, R.STREAMS) == (24, 16, 256)


def test_network_is_normalised_and_gradient_is_exact(monkeypatch):
    from gapmatch.llm import recurrent as R

    r = np.random.RandomState(0)
    flat = R.initial(r.rand(R.WORDS) * 10, 5.0) + r.randn(R.SIZE).astype(np.float32) * 0.05
    p = R.unpack(flat)
    f = np.tanh(r.randn(R.HIDDEN, 1)).astype(np.float32)
    every = np.arange(R.WORDS + 1)
    total = np.exp(R.log_probabilities(p, np.repeat(f, len(every), axis=1), every)).sum()
    assert abs(total - 1) < 1e-3
    # a document's score does not depend on what is scored beside it
    some = [r.randint(0, R.WORDS + 1, n).astype(np.int32) for n in (3, 70, 1, 40)]
    alone = [R.score(flat, [x])[0] for x in some]
    assert np.allclose(R.score(flat, some), alone, atol=1e-3)
    # the analytic gradient of one window against differences
    ids = r.randint(0, R.WORDS + 1, 24).astype(np.int32)
    x, y = np.append(0, ids[:-1]).reshape(2, 12).T.astype(np.int32), ids.reshape(2, 12).T
    fresh, live = np.zeros((12, 2), bool), np.ones((12, 2), bool)
    fresh[0], fresh[5, 1], live[11, 1] = True, True, False

    def loss(w):
        q = R.unpack(w)
        hs, *_ = R._states(q, x, fresh, np.zeros((R.HIDDEN, 2), np.float32), False)
        return -R.log_probabilities(q, hs.reshape(R.HIDDEN, -1), y.ravel())[live.ravel()].sum()

    grad = np.zeros_like(flat)
    hs, _, kept, vec = R._states(p, x, fresh, np.zeros((R.HIDDEN, 2), np.float32), True)
    R._gradient(p, R.unpack(grad), hs, kept, vec, x, y, fresh, live)
    big = np.argsort(-np.abs(grad))[:4000:400]
    for k in big:
        step = np.zeros_like(flat)
        step[k] = 1e-2
        assert abs((loss(flat + step) - loss(flat - step)) / 2e-2 - grad[k]) < 0.02 * max(1, abs(grad[k]))


def test_top_k(spark):
    r = np.random.RandomState(2)
    vec = r.randn(120, 8) / 3
    vec[7] = vec[40]  # ties
    rows = [(k, [float(np.float32(x)) for x in vec[k]], k) for k in range(120)]
    rows += [(120, None, 1), (140, [1.0, None] + [0.0] * 6, 1), (160, [float("nan")] * 8, 1), (None, [1.0] * 8, 1),
             (41, rows[41][1], 1), (40, rows[40][1], 1), (121, [0.5, 0.5], 1)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    ok = [(i, np.floor(64 * np.float32(x).astype(float)).astype(int)) for i, x, _ in rows
          if i is not None and x is not None and None not in x and np.isfinite(x).all()]
    want = set()
    for q in {i for i, _ in ok if i % 20 == 0}:
        x = next(x for i, x in ok if i == q)
        s = sorted((-int(x[:len(y)] @ y), i) for i, y in ok if i != q)[:20]
        want |= {(q, k + 1, i, -n) for k, (n, i) in enumerate(s)}
    got = topk.top_k(v, F.col("vec_id") % 20 == 0).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    assert topk.top_k(v.filter("false"), F.lit(True)).count() == 0


def test_top_k_prunes_blocks_of_clustered_rows():
    r = np.random.RandomState(4)
    centres = r.randint(-60, 60, (30, 16))
    x = centres[r.randint(0, 30, 6000)] + r.randint(-3, 4, (6000, 16))
    ids = r.permutation(6000)
    q = np.arange(0, 6000, 100)
    row, got, score, scored = topk.search(x[q], ids[q], x, ids, 20, block=64)
    for k in range(len(q)):
        s = x @ x[q[k]]
        s[q[k]] = -10**9
        want = sorted(zip((-s).tolist(), ids.tolist()))[:20]
        assert sorted(zip((-score[row == k]).tolist(), got[row == k].tolist())) == want
    assert scored < 0.5 * len(q) * len(x) / 64


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def test_sentencepiece(docs, empty, model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    p = pieces.load(model)
    r = np.random.RandomState(9)
    odd = ["".join(r.choice(list("abcthe  \n\t.▁é中😀\x00#Z9"), r.randint(0, 50))) for _ in range(1500)]
    odd += ["a" * 700, " " * 90, "\n" * 30, "ab" * 400, "<s></s><unk><0x41>", "▁▁ x"]
    assert p.encode(odd) == sp.encode(odd, num_threads=1)
    ids = [r.randint(0, 32000, r.randint(0, 9)).tolist() for _ in range(500)]
    assert [p.decode(x) for x in ids] == [sp.decode(x) for x in ids]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = pieces.round_trip(docs, p).collect()
    want = Counter()
    for row in corpus():
        x = sp.encode(row[1] or "")
        want[row[0], len(x), sha(",".join(map(str, x))), sha(sp.decode(x) if x else "")] += 1
    assert Counter(tuple(x) for x in got) == want
    both = pieces.decode(pieces.encode(docs, p), p).select("text", "decoded", "ids").collect()
    assert all(x.decoded == (x.text or "").replace("▁", " ") for x in both)
    full = pieces.tokenized(docs, p)
    assert full.columns == [*docs.columns, "ids", "n_tokens", "decoded_sha256"]
    assert sorted(x.n_tokens for x in full.collect()) == sorted(len(x.ids) for x in both)
    assert pieces.round_trip(empty, p).count() == 0


def test_quality_rules_of_trees(spark, docs, empty):
    r = np.random.RandomState(5)
    rows = [(k, prose(1000 + k, 60) if k % 3 else " ".join(f"{w}$$$" for w in prose(k, 60).split())) for k in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(300)] + [(None, 1), (1, None)],
                                   "doc_id long, quality int")
    rules = rule_ensemble.fit(d, labels)
    assert rules.rules and len(rules.rules) < 60
    got = rule_ensemble.score(d, rules).withColumn("h", rule_ensemble.held_out()).collect()
    for x in got:
        assert x.h == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0)
        assert x.predicted == int(x.doc_id % 3 > 0) == int(x.score >= 0.3)
    # the compiled column is the ensemble's own value
    stats = rule_ensemble.with_statistics(d, "text").select("doc_id", "_stats.*").collect()
    value = {}
    for x in stats:
        v = x[1:]
        z = rules.bias + sum(w for rule, w in zip(rules.rules, rules.weights)
                             if all((v[f] > t) == up for f, up, t in rule))
        value[x.doc_id] = 1 / (1 + np.exp(-z))
    assert all(abs(value[x.doc_id] - x.score) < 1e-9 for x in got)
    every = rule_ensemble.score(docs, rules)
    assert every.count() == len(corpus()) and set(every.columns) == {*docs.columns, "predicted"}
    assert all(0 <= x.score <= 1 for x in every.collect())
    assert rule_ensemble.fit(d, labels.filter("quality = 1")).rules == ()
    assert rule_ensemble.score(empty, rule_ensemble.fit(empty, labels)).count() == 0


def test_line_templates(docs, empty):
    out = line_templates.drop_template_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "dropped", "clean_text"]
    got = out.collect()
    assert len(got) == len(corpus())
    for x in got:
        lines = [] if x.text is None else x.text.split("\n")
        assert x.n_lines == len(lines)
        boiler = [k for k, t in enumerate(lines) if t.startswith("All rights reserved")]
        assert x.dropped == boiler
        assert x.clean_text == (None if x.text is None else "\n".join(t for k, t in enumerate(lines) if k not in boiler))
    assert line_templates.drop_template_lines(empty).count() == 0


def test_near_copies_keep_their_lines(spark):
    w = prose(70, 300).split(" ")
    rows = [(k, " ".join([*w[:20 + k], f"edit{k}", *w[21 + k:]])) for k in range(25)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert line_templates.drop_template_lines(d).filter("size(dropped) > 0").count() == 0


@pytest.mark.parametrize("n_own", [1, 2, 5, 20])
def test_boilerplate_goes_however_few_lines_are_a_text_s_own(spark, n_own):
    boiler = ["All rights reserved by the owner of this site", "Please read our terms of use before you go on",
              "Follow us on every network that you can think of"]
    rows = []
    for k in range(60):
        lines = [" ".join(prose(1000 * n_own + 30 * k + j, 9).replace("\n", " ").split()) for j in range(n_own)]
        rows.append((k, "\n".join([boiler[0], *lines, *boiler[1:]])))
    rows += [(100 + k, " ".join(["unrelated", prose(9000 + k, 30)])) for k in range(5)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.dropped for r in line_templates.drop_template_lines(d).collect()}
    assert all(got[k] == [0, n_own + 1, n_own + 2] for k in range(60))
    assert all(got[100 + k] == [] for k in range(5))


def test_several_templates_of_one_leaf(spark):
    r = np.random.RandomState(8)
    names = ["".join(r.choice(list("abcdefghij"), 6)) for _ in range(90)]
    rows = []
    for k in range(160):
        verb = ("written", "removed", "checked", "printed")[k % 4]
        line = f"This article was {verb} by {r.choice(names)} on a rainy day"
        rows.append((k, "\n".join([prose(500 + k, 12).replace("\n", " "), line, prose(900 + k, 14).replace("\n", " ")])))
    rows += [(500, "This article was never seen by anyone on that day\nand another line of its own")]
    got = {x.doc_id: x.dropped for x in line_templates.drop_template_lines(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == [1] for k in range(160)) and got[500] == []


def test_copies_with_many_edits_keep_their_lines(spark):
    w = prose(71, 400).split(" ")
    r = np.random.RandomState(3)
    rows = [(k, " ".join(x if r.rand() > 0.01 else f"edit{k}" for x in w)) for k in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert line_templates.drop_template_lines(d).filter("size(dropped) > 0").count() == 0


def base_counts(text):
    w = WORD.findall(text or "")
    dup = [x for x in (text or "").split("\n") if WORD.search(x)]
    five = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
    cover = {k + j for k in range(len(w) - 4) if five[tuple(w[k:k + 5])] > 1 for j in range(5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(dup) - len(set(dup)), len(cover),
            len(w) < 10 or 100 * len(cover) > 20 * len(w))


def test_quality_by_likelihood_ratio(spark, docs, empty):
    trusted = spark.createDataFrame([(3 * k,) for k in range(13, 29)] + [(None,)], "doc_id long")
    got = importance.judge(docs, trusted).collect()
    assert Counter((x.doc_id, *x[1:7]) for x in got) == Counter((r[0], *base_counts(r[1])) for r in corpus())
    assert all(not (x.kept and x.base_failed) for x in got)
    kept = {x.doc_id for x in got if x.kept}
    assert kept >= {3 * k for k in range(13, 29)} and 87 not in kept
    assert {x.score for x in importance.judge(docs, trusted.filter("false")).collect()} == {0.0}
    assert importance.judge(empty, trusted).count() == 0


def test_likelihood_ratio_counts_every_trusted_document(spark):
    rows = [(k if k % 50 else None, hashlib.md5(str(k).encode()).hexdigest()[:8]) for k in range(30_000)]
    trusted = {k for k in range(30_000) if k % 5}
    buckets = 512
    raw, good = np.zeros(buckets), np.zeros(buckets)
    for i, t in rows:
        g = np.bincount(importance.grams(t.encode(), importance.WIDTH, buckets), minlength=buckets)
        raw += g
        good += g * (i in trusted)
    p = lambda c: np.log((c + importance.ALPHA) / (c.sum() + importance.ALPHA * buckets))
    got = importance.log_ratios(spark.createDataFrame(rows, "doc_id long, text string"),
                                spark.createDataFrame([(k,) for k in [*trusted, 1]], "doc_id long"), buckets=buckets)
    assert np.allclose(got, p(good) - p(raw), atol=1e-6)


def test_passages(spark, docs, empty):
    out = passages.remove_repeats(docs)
    assert out.columns == [*docs.columns, "spans", "clean_text"]
    got = out.collect()
    assert len(got) == len(corpus())
    by_id = {x.doc_id: x for x in got if x.doc_id is not None}
    base = by_id[18].text
    assert by_id[18].spans == [] and by_id[18].clean_text == base
    assert by_id[21].clean_text == "" and by_id[21].spans[0].kept_doc_id == 18
    assert by_id[21].spans[0].words == 200
    assert "changed" in by_id[24].clean_text and len(by_id[24].clean_text) < 0.3 * len(base)
    for x in got:
        t, k, rest = x.text, 0, []
        for s in x.spans:
            rest.append(t[k:s.start])
            k = s.end
        assert x.clean_text == (None if t is None else "".join([*rest, t[k:]]))
    no_id = [x for x in got if x.doc_id is None and x.text == base]
    assert no_id[0].clean_text == "" and no_id[0].spans[0].kept_doc_id == 18
    assert all(by_id[3 * k].spans == [] for k in (*range(0, 6), *range(13, 29)))
    assert passages.remove_repeats(empty).count() == 0


def test_passages_among_rows_without_id_or_of_one_id(spark):
    shared = {None: prose(60, 60), 7: prose(61, 60)}
    rows = [(i, f"Own words {k} of {i}.\n{shared[i]}") for i in shared for k in range(5)]
    got = passages.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    for i, t in shared.items():
        mine = [x for x in got if x.doc_id == i]
        assert all(x.clean_text.startswith("Own words") for x in mine)
        assert sorted(len(x.spans) for x in mine) == [0, 1, 1, 1, 1]
        assert [x.clean_text for x in mine if not x.spans][0].endswith(t)
        assert all(t[:30] not in x.clean_text and x.spans[0].kept_doc_id == i for x in mine if x.spans)


def test_passages_that_start_or_end_inside_a_unit(spark):
    words = [w.strip(".\n") for w in prose(62, 400).split(" ")]
    one = " ".join(words[:65])  # no sentence ends in it
    two = " ".join(words[100:120]) + ". " + " ".join(words[120:130]) + ". " + " ".join(words[130:150])
    rows = [(1, f"First text begins {one} and goes on. Nothing else."), (2, f"Other start of it {one} with\na new end."),
            (3, f"Third one has {two} here."), (4, f"Then a copy\nof {two.upper()} there\ntoo."),
            (5, " ".join(words[200:224]) + " five."), (6, "six " + " ".join(words[200:224])),
            (7, f"seven {' '.join(words[300:340])} and once more {' '.join(words[300:340])} then."),
            (8, "ha " * 300), (9, None)]
    got = {x.doc_id: x for x in passages.remove_repeats(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got[2].clean_text == "Other start of it with\na new end."
    assert [(x.words, x.kept_doc_id) for x in got[2].spans] == [(65, 1)]
    assert got[4].clean_text == "Then a copy\nof there\ntoo."
    assert [(x.words, x.kept_doc_id) for x in got[4].spans] == [(50, 3)]
    assert got[7].clean_text == f"seven {' '.join(words[300:340])} and once more then."
    assert all(got[k].spans == [] and got[k].clean_text == dict(rows)[k] for k in (1, 3, 5, 6, 9))


def test_every_shared_stretch_is_found():
    r = np.random.RandomState(11)
    for _ in range(200):
        n = r.randint(25, 80)
        both = r.randint(0, 2**63, n, dtype=np.int64).astype(np.uint64)
        mine, kept = (np.concatenate([r.randint(0, 2**63, r.randint(0, 60), dtype=np.int64).astype(np.uint64), both,
                                      r.randint(0, 2**63, r.randint(0, 60), dtype=np.int64).astype(np.uint64)])
                      for _ in range(2))
        at = int(np.flatnonzero(mine == both[0])[0])
        assert passages.agreeing(mine, kept, False, 25) == [(at, at + n)]


def test_building_passages_leaves_no_shuffle_files(spark):
    def shuffle_files():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in (files.apply(k).getName() for k in range(files.size())) if f.startswith("shuffle_")}

    rows = [(k, prose(5, 60) + "\n" + prose(k, 30)) for k in range(8)]
    before = shuffle_files()
    out = passages.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    for _ in range(50):  # files are removed by another thread
        left = shuffle_files() - before
        if not left:
            break
        time.sleep(0.1)
    assert not left
    assert out.filter("size(spans) > 0").count() == 7


def test_units_cover_the_text():
    t = "A b c. D e!  F 3.5 g... h\n\nline two. x\r\n.\n?! end"
    assert "".join(m[0] for m in re.finditer(passages.UNIT, t)) == t
    assert [t[a:b] for a, b, _, _ in passages.units(t)][:3] == ["A b c. ", "D e!  ", "F 3.5 g... "]


def brute_targets(sizes: dict) -> dict:
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, full = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in full]
        share = {s: (left - sum(full.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 2 * sizes[s]]
        if not over:
            return {**full, **share}
        full.update({s: 2.0 * sizes[s] for s in over})
        if len(full) == len(names):
            return full


def test_mixing(spark, docs, empty):
    r = np.random.RandomState(8)
    many = [(k, " ".join(["w"] * int(n)), [None, "a", "b", "c", "d"][int(s)]) for k, (n, s) in enumerate(
        zip(r.lognormal(4, 1, 400).astype(int), r.choice(5, 400, p=[0.1, 0.5, 0.2, 0.1, 0.1])))]
    for d, rows in ((spark.createDataFrame(many, "doc_id long, text string, source string"), many),
                    (docs, [(x[0], x[1], x[3]) for x in corpus()])):
        got = mixing.per_document(mixing.mix(d)).collect()
        assert Counter((x.doc_id, x.size, x.source) for x in got) == Counter(
            (i, len(WORD.findall(t or "")), s) for i, t, s in rows)
        sizes = Counter()
        for x in got:
            sizes[x.source] += x.size
            assert x.taken == x.copies * x.size and 0 <= x.copies <= 2
        want = brute_targets(dict(sizes))
        for s in sizes:
            mine = [x for x in got if x.source == s]
            assert {x.source_size for x in mine} == {sizes[s]}
            assert all(abs(x.target - want[s]) < 1e-6 * max(1, want[s]) for x in mine)
            # a source's rates give its target, and whole copies come near it
            assert abs(sum(x.rate * x.size for x in mine) - want[s]) < 1e-4 * max(1, want[s])
            if len(mine) > 20 and d is not docs:
                assert abs(sum(x.taken for x in mine) - want[s]) <= max(0.01 * want[s], 10)
        again = mixing.per_document(mixing.mix(d.repartition(5))).collect()
        assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    d = spark.createDataFrame(many, "doc_id long, text string, source string")
    m = mixing.mix(d)
    taken = Counter(x.doc_id for x in mixing.take(d, m).collect())
    assert taken == Counter({x.doc_id: x.copies for x in m.collect() if x.copies})
    assert mixing.mix(empty).count() == 0
