"""The corpus pipeline stage by stage: each stage against brute force on its own input."""

import os
from collections import Counter

import pytest

import corpus_pipeline as P
from gapmatch.llm.common import written
from test_operators import brute_components, brute_targets, WORD

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")
def test_stages(spark):
    import public_tokenizers
    import sentencepiece

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    seen = []
    for name, stage in P.STAGES:
        before = docs.collect()
        out = stage(spark, docs, SMALL)
        if name != P.STAGES[-1][0]:
            assert out.columns == columns
        docs = written(out, "stage")
        after = docs.collect()
        seen.append(name)
        if name == "quality classifier":
            assert {tuple(r) for r in after} <= {tuple(r) for r in before}
            kept = {r.doc_id for r in after}
            assert sum((i in kept) == bool(q) for i, q in quality.items()) > 0.95 * len(quality)
            assert kept >= {i for i, q in quality.items() if q and i % 2 == 0} or len(kept) > 0.8 * len(before)
        elif name == "line dedup":
            old = {r.doc_id: r for r in before}
            assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before)
            for r in after:
                lines = iter(old[r.doc_id].text.split("\n"))
                assert all(x in lines for x in r.text.split("\n")) or r.text == ""
                assert r.n_chars == len(r.text)
        elif name == "near-duplicates":
            groups = brute_components([(r.doc_id, r.text) for r in before])
            assert Counter(r.doc_id for r in after) == Counter(set(groups.values()))
        elif name == "mixing":
            size, taken = Counter(), Counter()
            for r in before:
                size[r.source] += len(WORD.findall(r.text or ""))
            for r in after:
                taken[r.source] += len(WORD.findall(r.text or ""))
            want = brute_targets(dict(size))
            assert all(abs(taken[s] - want[s]) < 0.1 * want[s] + 60 for s in size)
            assert max(Counter(r.doc_id for r in after).values()) <= 2
            assert {tuple(r) for r in after} <= {tuple(r) for r in before}
        else:
            sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            assert len(after) == len(before)
            assert all(list(r.ids) == sp.encode(r.text or "") and r.n_tokens == len(r.ids) for r in after)
    assert len(seen) == 5
