"""The pipeline's stages, each on what the one before kept, against plain Python over the same rows."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_mixing import water
from tests.llm.test_near_dedup import brute as brute_components
from tests.llm.helpers import words
from weftline.llm import quality_classifier as qc
from weftline.llm.common import Scratch, table
from weftline.llm.queries import TOKENIZER

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Name to rows before and after; the last after is the stage's own result."""
    scratch, docs, out = Scratch(spark), table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = scratch.save(stage(spark, docs, SF), name)
        out[name] = docs.collect(), after.collect()
        docs = after
    return out


def texts(rows):
    return [(r.doc_id, r.text) for r in rows]


def test_names_and_columns(spark, stages):
    assert list(stages) == ["quality_classifier", "near_dedup", "decontamination", "mixing", "token_files"]
    want = table(spark, SF, "documents").columns
    assert all(after[0].asDict().keys() == set(want) for name, (_, after) in stages.items() if name != "token_files")


def test_quality(spark, stages):
    """Every text's features by themselves, times the weights."""
    before, after = stages["quality_classifier"]
    m = qc.train(table(spark, SF, "documents"), qc.grades(table(spark, SF, "labels")))
    s = [float((m.w[a].astype(float) * v).sum()) for a, v in (qc.features(r.text) for r in before)]
    p = m.tails(np.array(s))[:, -1]
    sure = np.abs(p - qc.LEAST_TAIL) > 1e-4
    kept = {r.doc_id for r in after}
    assert all((r.doc_id in kept) == (x >= qc.LEAST_TAIL) for r, x, ok in zip(before, p, sure, strict=True) if ok) and 0 < len(kept) < len(before)


def test_near_duplicates(stages):
    before, after = stages["near_dedup"]
    assert sorted(r.doc_id for r in after) == sorted(i for i, _, c in brute_components(texts(before), 5) if i == c)


def test_decontamination(spark, stages):
    before, after = stages["decontamination"]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    hits = {doc: n for doc, _, n, _ in brute_hits(texts(before), items, 10)}
    assert sorted(texts(after)) == sorted((d, t) for d, t in texts(before) if not hits[d])


def test_mixing(stages):
    before, after = stages["mixing"]
    assert set(after) <= set(before)
    size = {r.doc_id: len(words(r.text)) for r in before}
    sums, taken = Counter(), Counter()
    for r in before:
        sums[r.source] += size[r.doc_id]
    for r in after:
        taken[r.source] += size[r.doc_id]
    largest = {s: max(size[r.doc_id] for r in before if r.source == s) for s in sums}
    assert all(abs(taken[s] - t) <= largest[s] for s, t in water(dict(sums)).items())
    assert max(Counter(r.doc_id for r in after).values()) <= 2


def test_tokens(stages):
    from tokenizers import Tokenizer

    before, after = stages["token_files"]
    tok = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    want, start = [], 0
    for doc, text in sorted(texts(before)):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in after) == want


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == sorted(stages["token_files"][1])
