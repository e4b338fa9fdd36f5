"""Alignment, prefix trie and projection passes against brute force, on small tables with edge cases."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gapmatch.llm import alignment, prefix_trie, projection, queries

# ---------------------------------------------------------------- alignment

TEXTS = [None, "", " ", "   two  spaces\tand tabs \n\n end ", "plain words, plain words; plain words.", "é ñ 中文 😀 mixed",
         "a ▁ piece mark", "<|endoftext|> <s> </s> <unk>", "x" * 3000, "The quick brown fox\njumps over\r\nthe lazy dog's back",
         "123 4567 89.0 !!! ??? ...     wide", "\n\n\n", "tail\n", "\x00\x01 control"]


@pytest.fixture(scope="module")
def vocabularies():
    import public_tokenizers as P
    return (alignment.ByteTokens.load(P.path("byte_bpe_50k.json")),
            alignment.PieceTokens(P.path("piece_bpe_32k.model")))


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def aligned(texts, t, sp):
    """Per text the row that op11 should give, by two cursors over both token sequences."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    vocab = {i: bytes(back[c] for c in e) for e, i in t.get_vocab().items() if e != "<|endoftext|>"}
    rows, links = [], []
    for text in texts:
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        ba = [vocab[i] for i in a]
        bb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
              for i in b]
        if not text or b"".join(ba) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
            rows.append((0, 0, 0, 0, ""))
            links.append([])
            continue
        ea, eb = list(itertools.accumulate(map(len, ba))), list(itertools.accumulate(map(len, bb)))
        groups, found, i, j = [([], [])], [], 0, 0
        seen = (-1, -1)
        while i < len(a) and j < len(b):
            found.append((a[i], b[j]))
            if i != seen[0]:
                groups[-1][0].append(a[i])
            if j != seen[1]:
                groups[-1][1].append(b[j])
            seen = (i, j)
            step = ea[i] - eb[j]
            i, j = i + (step <= 0), j + (step >= 0)
            if step == 0 and i < len(a):
                groups.append(([], []))
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((len(a), len(b), len(groups), len(found), hashlib.sha256(spelled.encode()).hexdigest()))
        links.append(found)
    counts = Counter(x for k in links for x in k)
    top = defaultdict(int)
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return [(*r[:4], sum(counts[x] == top[x[1]] for x in k), sum(counts[x] for x in k), r[4])
            for r, k in zip(rows, links, strict=True)]


def test_alignment_equals_cursors(spark, vocabularies, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK", 300)
    rnd = random.Random(4)
    texts = TEXTS + [" ".join(rnd.choice(["the", "Übung", "naïve", "data", "x1", "..", "\n"]) for _ in range(80)) for _ in range(6)]
    texts += [texts[4]] * 3
    ids = [2**60 + k for k in range(len(texts))]
    ids[3] = None
    ids[5] = ids[6]
    rows = [(i, t, "c", 1.0) for i, t in zip(ids, texts, strict=True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, chunk string, n_a double").repartition(3)
    got = alignment.align(df, *vocabularies).collect()
    want = [(i, *w) for i, w in zip(ids, aligned(texts, *libraries), strict=True)]
    assert Counter(map(tuple, got)) == Counter(want)
    assert alignment.align(df.limit(0), *vocabularies).collect() == []


def test_coalesce_on_intervals_with_gaps():
    rnd = random.Random(1)
    for _ in range(60):
        cut = lambda: sorted(rnd.sample(range(40), 2 * rnd.randint(1, 8)))
        a, b = cut(), cut()
        a, b = list(zip(a[::2], a[1::2])), list(zip(b[::2], b[1::2]))
        ga, gb, la, lb = alignment.coalesce(*[np.array(x) for x in (*zip(*a), *zip(*b))])
        want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[0] < y[1] and y[0] < x[1]}
        assert set(zip(la.tolist(), lb.tolist())) == want
        assert all(ga[i] == gb[j] for i, j in want)
        assert len(set(ga) | set(gb)) == len(a) + len(b) - len(want)  # chains of overlaps: every link joins two groups


# ---------------------------------------------------------------- prefix trie


def nodes_of(rows):
    """The nodes that op12 should give, from a trie built turn by turn."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members = defaultdict(set)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    children = Counter(k[:-1] for k in members if k)
    words = lambda s: len(s.encode().split())
    out = []
    for k, m in members.items():
        below = [x for x in members if x[:len(k)] == k]
        ends = ",".join(str(c) for c in sorted(m) if len(full[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k],
                    sum(not children[x] for x in below), sum((len(members[x]) - 1) * words(x[-1][1]) for x in below if x),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


TURNS = "conv_id long, turn long, role string, text string, pos string, part double"


def trie(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], TURNS).repartition(4)
    return prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.ordered_turns(df)))


def conversations():
    rnd = random.Random(7)
    say = ["hello there", "how are you", "", None, "tell me more about it", "fine\nthanks  a lot"]
    rows = []
    for c in range(0, 90):
        if c in (40, 61):  # an absent first conversation of a block, an absent other
            continue
        for t in range(rnd.randint(1, 5)):
            rows.append((c, t, ["user", "assistant", None][t % 2 if rnd.random() < .9 else 2], rnd.choice(say)))
    rows += [(7, None, "system", "a null turn comes first"), (None, 0, "user", "no conversation"), (33, 50, "user", "end")]
    rows += [(33, 50, "user", "end")]  # a repeated row is a turn of its own
    for c in range(100, 160):  # one sequence many times, and its own beginnings
        rows += [(c, t, "user", f"same {t}") for t in range(1 + c % 7 if c % 5 == 0 else 6)]
    return rows + [(2**60 + 1, t, "user", "same 0") for t in range(3)]


def test_trie_equals_one_built_turn_by_turn(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = conversations()
    assert Counter(map(tuple, trie(spark, rows).collect())) == nodes_of(rows)


@pytest.fixture
def every_partition(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_a_long_conversation_spreads_over_parts(spark, every_partition):
    rows = [(5, k, "user", f"word {k % 11}") for k in range(400)] + [(25, k, "user", f"word {k % 11}") for k in range(390)]
    turns = prefix_trie.ordered_turns(spark.createDataFrame([(*r, "x", 1.0) for r in rows], TURNS).repartition(4))
    assert turns.select("part").distinct().count() > 2
    assert Counter(map(tuple, trie(spark, rows).collect())) == nodes_of(rows)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert trie(spark, [(None, 1, "user", "x")]).collect() == []
    rows = [(c, 0, "user", "one") for c in range(21, 40)]  # their block's first conversation is absent
    assert Counter(map(tuple, trie(spark, rows).collect())) == nodes_of(rows)
    rows = [(20, 0, "user", "x" * 100_000 + " " + "y " * 50_000), (23, 1, None, None)]
    assert Counter(map(tuple, trie(spark, rows).collect())) == nodes_of(rows)


# ---------------------------------------------------------------- projection passes


def linked(rows, cosine=0.93):
    """Links and components by all pairs."""
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    use = [k for k, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and ok(v)]
    unit = {k: np.array(rows[k][1], dtype=float) / np.linalg.norm(np.array(rows[k][1], dtype=float)) for k in use}
    near = defaultdict(set)
    for a, b in itertools.combinations(use, 2):
        if rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and (
                unit[a] @ unit[b] >= cosine or rows[a][1] == rows[b][1]):
            near[a].add(b)
            near[b].add(a)
    out = []
    for k, (i, _, _) in enumerate(rows):
        reach, todo = {k}, [k]
        while todo:
            x = todo.pop()
            for y in near[x] - reach:
                reach.add(y)
                todo.append(y)
        least = i if i is None else min(rows[x][0] for x in reach)
        out.append((i, len(near[k]), least, least == i))
    return Counter(out)


def vectors(n=400, width=8, seed=3):
    r = np.random.RandomState(seed)
    centre = r.standard_normal((n // 8, width))
    x = np.concatenate([centre[r.randint(0, n // 8, n)] + r.standard_normal((n, width)) * 0.25, centre])
    rows = [(3 * k, [float(np.float32(v)) for v in x[k]], int(r.randint(0, 3))) for k in range(len(x))]
    tight = r.standard_normal(width) * 4  # a large group of near copies, with some at its rim
    rows += [(5000 + k, [float(np.float32(v)) for v in tight + r.standard_normal(width) * (1.5 if k % 9 == 0 else 0.1)], 7)
             for k in range(150)]
    rows += [(9000 + k, rows[0][1], rows[0][2]) for k in range(4)] + [(8000, rows[0][1], 99)]
    rows += [(None, rows[1][1], rows[1][2]), (7001, None, 1), (7002, [], 1), (7003, [0.0] * width, 1), (7004, rows[2][1], None),
             (7005, [float("nan")] * width, 1), (7006, [None] * width, 1), (7007, [float("inf")] * width, 1),
             (7008, [1.0, 0.0], 1), (7009, [1.0, 0.001], 1), (2**60 + 1, rows[3][1], rows[3][2])]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int, rep string, h1 double"


def test_projection_equals_all_pairs(spark, every_partition):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], SCHEMA).repartition(3)
    for sizes in ({}, {"window": 40, "cell": 120, "whole": 30}):
        got = projection.near_vectors(df, **sizes).collect()
        assert Counter(map(tuple, got)) == linked(rows), sizes
    assert projection.near_vectors(df.limit(0)).collect() == []
    bad = df.filter("vec_id between 7001 and 7007")
    assert Counter(map(tuple, projection.near_vectors(bad).collect())) == Counter((i, 0, i, True) for i in range(7001, 7008))


def test_repeated_rows_are_one_vector(spark):
    rows = [(1, [1.0, 0.0], 0)] * 3 + [(2, [1.0, 0.01], 0)] * 2 + [(3, [0.0, 1.0], 0)]
    got = projection.near_vectors(spark.createDataFrame([(*r, "x", 1.0) for r in rows], SCHEMA)).collect()
    assert Counter(map(tuple, got)) == Counter({(1, 1, 1, True): 3, (2, 1, 1, False): 2, (3, 0, 3, True): 1})


def test_few_windows_still_find_nine_tenths(spark):
    """Recall where windows are far smaller than labels, with passes by the rule."""
    r = np.random.RandomState(5)
    x = r.standard_normal((1500, 24))
    x = np.concatenate([x, x + r.standard_normal((1500, 24)) * 0.33])  # pairs near the threshold
    rows = [(k, [float(np.float32(v)) for v in x[k]], 0) for k in range(len(x))]
    df = spark.createDataFrame([(*row, "x", 1.0) for row in rows], SCHEMA)
    got = {row.vec_id: row for row in projection.near_vectors(df, window=32, cell=256).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = int((u @ u.T >= 0.93).sum()) - len(x)
    assert true > 500
    assert sum(row.n_links for row in got.values()) >= 0.95 * true


def test_queries_read_their_tables(spark):
    for name, n in (("op12_prefix_trie", None), ("op13_near_vectors", 500)):
        df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        rows = df.collect()
        assert len(rows) == n if n else len(rows) > 50
