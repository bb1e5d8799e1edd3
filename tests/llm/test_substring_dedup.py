import hashlib
import time

import pytest

from tests.llm.helpers import documents, odd_rows, random_rows, words
from weftline.llm.substring_dedup import remove_repeats


def brute(rows, window):
    """(doc_id, n_words, n_removed, sha) of rows with distinct ids, by a dictionary of all windows."""
    seen, out = set(), []
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(text)
        gone = set()
        for s in range(len(w) - window + 1):
            x = tuple(w[s : s + window])
            if x in seen:
                gone.update(range(s, s + window))
            seen.add(x)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def found(df):
    return [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in df.collect()]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("group", [1, 3, 1000])
def test_equals_brute_force(spark, seed, group):
    rows = random_rows(seed, vocabulary=6 if seed % 2 else 60)
    got = found(remove_repeats(documents(spark, rows), window=8, gram=3, group=group))
    assert sorted(got) == brute(rows, 8)


def test_default_window(spark):
    text = " ".join(f"a{i}" for i in range(50))
    rows = [(2, text), (1, "x " + text + " y"), (3, " ".join(f"a{i}" for i in range(19))), (4, text + " " + text)]
    assert sorted(found(remove_repeats(documents(spark, rows)))) == brute(rows, 20)


def test_odd_cases(spark):
    got = {(r.doc_id, r.n_words): r for r in remove_repeats(documents(spark, odd_rows())).collect()}
    assert len(got) == 9 and got[1, 0].kept_text == "" and got[None, 3].n_removed == 0
    assert got[6, 30_000].n_removed == brute([r for r in odd_rows() if r[0] == 6], 20)[0][2]
    assert remove_repeats(documents(spark, [])).count() == 0


def test_rows_that_share_an_id(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"a{i}" for i in range(5, 30))
    got = [r.n_removed for r in remove_repeats(documents(spark, [(1, a), (1, a)])).collect()]
    assert got == [0, 0]  # repeated rows are one document
    assert sorted(r.n_removed for r in remove_repeats(documents(spark, [(1, a), (1, b)])).collect()) == [0, 25]


def test_clashing_columns(spark):
    d = documents(spark, random_rows(1)).selectExpr("*", "1 AS key", "2 AS spots", "3 AS run", "4 AS lo")
    assert remove_repeats(d, window=8, gram=3).count() == 60


def test_spots_are_few():
    """Windows share their least run: about one spot for (window - gram + 2) / 2 words."""
    import random

    import numpy as np
    import pyarrow as pa

    from weftline.llm.common import plain_words, stretch_hashes, word_spans
    from weftline.llm.substring_dedup import least_runs

    r = random.Random(1)
    texts = [None, "", " a  b\n", "é" * 3 + "\tß", " ".join(str(r.randrange(10**6)) for _ in range(5000)), "end", " "]
    raw, first, last, length = word_spans(pa.array(texts))
    assert [bytes(raw[i:j]) for i, j in zip(first, last, strict=True)] == [w for t in texts for w in plain_words(t)]
    assert length.tolist() == [len(plain_words(t)) for t in texts]
    sliced = word_spans(pa.array(["skipped text", *texts]).slice(1))
    assert all(np.array_equal(a, b) for a, b in zip(sliced, (raw, first, last, length), strict=True))
    h = stretch_hashes(raw, first, last)
    assert len(np.unique(h)) == len({bytes(raw[i:j]) for i, j in zip(first, last, strict=True)})
    at = least_runs(h, 20, 8)
    assert len(np.unique(at)) < 0.2 * len(at) and (at >= np.arange(len(at))).all() and (at <= np.arange(len(at)) + 12).all()


def test_a_row_that_is_repeated_many_times(spark):
    """Work grows with the copies, not with their square; all of them are treated alike."""
    text = " ".join(f"w{i}" for i in range(60))
    took = []
    for n in (500, 4000):
        began = time.time()
        got = remove_repeats(documents(spark, [(1, text)] * n + [(2, text)] * n)).groupBy("doc_id", "n_removed").count().collect()
        took.append(time.time() - began)
        assert sorted(tuple(r) for r in got) == [(1, 0, n), (2, 60, n)]
    assert took[1] < 5 * took[0] + 5
