import random
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.helpers import documents, odd_rows, words
from weftline.llm import line_dedup
from weftline.llm.line_dedup import common_lines, dedup_lines, line_hashes, patience


def rows_of(seed, n=40):
    r = random.Random(seed)
    pool = [" ".join(r.choice("abcdefghij") + str(r.randrange(30)) for _ in range(r.randrange(1, 8))) for _ in range(60)]
    return [(i, "\n".join(r.choice(["", *pool]) if r.random() < 0.5 else pool[(i * 7 + j) % 60] for j in range(r.randrange(0, 15)))) for i in range(n)]


def brute(rows, least, rare):
    """Kept texts: every line's holders, every pair that a rare line names, and the alignment of each."""
    lines = {i: line_hashes(t, least) for i, t in rows}
    holders = defaultdict(list)
    for i in sorted(lines):
        for h in np.unique(lines[i][0][lines[i][1]]).tolist():
            holders[h].append(i)
    gone = defaultdict(set)
    for h, docs in holders.items():
        for d in docs[1:]:
            if len(docs) > rare:
                gone[d] |= {int(k) for k in np.flatnonzero((lines[d][0] == h) & lines[d][1])}
            else:
                gone[d] |= set(common_lines(lines[docs[0]][0], *lines[d]))
    return sorted((i, len(t.split("\n")) if t else 0, len(gone[i]), "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])) for i, t in rows)


@pytest.mark.parametrize("seed,rare", [(0, 32), (1, 3), (2, 0)])
def test_equals_brute_force(spark, seed, rare):
    rows = rows_of(seed)
    got = [tuple(r) for r in dedup_lines(documents(spark, rows), rare=rare).collect()]
    assert sorted(got) == brute(rows, 4, rare)


def every_pair(rows, least=4):
    """Of each document: places that an alignment with any earlier document takes."""
    lines = {i: line_hashes(t, least) for i, t in rows}
    return lines, {d: set().union(*(common_lines(lines[e][0], *lines[d]) for e in lines if e < d)) for d in lines}


@pytest.mark.parametrize("seed", range(3))
def test_no_line_is_left_that_a_pair_would_take(spark, seed):
    rows = rows_of(seed)
    rows += [(40 + i, t) for i, t in rows[:5]]
    lines, every = every_pair(rows)
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in dedup_lines(documents(spark, rows)).collect()}
    for i, t in rows:
        h, far = lines[i]
        n, kept = got[i]
        left = line_hashes(kept, 4)[0].tolist()
        assert n <= len(every[i]) and left.count(0) >= h.tolist().count(0) - (t == "" or kept == "")
        for x in set(h[far].tolist()):
            at = {int(k) for k in np.flatnonzero(h == x)}
            assert (left.count(x) < len(at)) == bool(at & every[i])


@pytest.mark.parametrize("seed", range(4))
def test_equals_every_pair_by_plain_loops(spark, seed):
    """No code of the operator's: documents are runs of one long text, each line once, so that what two have in common stands
    in one order and can be aligned in one way. Every pair is compared; a long line goes if an earlier document has it in a
    block with it, a short one only with a long neighbour in both."""
    r = random.Random(seed)
    long_text = [f"line {i} of some more words" if r.random() < 0.7 else f"short {i}" for i in range(60)]
    rows = []
    for i in range(30):
        lines = []
        for k in sorted(r.sample(range(60), r.randrange(1, 5))):
            start = max(k, len(lines) and long_text.index(lines[-1]) + 1 if lines and lines[-1] in long_text else k)
            lines += long_text[start : start + r.randrange(1, 8)]
            if r.random() < 0.5:
                break
        rows.append((i, "\n".join(lines)))
    got = {x.doc_id: x.kept_text.split("\n") for x in dedup_lines(documents(spark, rows)).collect()}
    for d, text in rows:
        lines = text.split("\n")
        far, gone = {x for x in lines if len(x.split()) >= 4}, set()
        for e, other in rows[:d]:
            theirs = other.split("\n")
            run = []
            for x in [*lines, None]:
                joined = run and x in theirs and theirs.index(x) == theirs.index(run[-1]) + 1
                if not joined:
                    gone |= set(run) if far & set(run) else set()
                    run = []
                if x in theirs:
                    run.append(x)
        kept = got[d] if got[d] != [""] else []
        assert [x for x in kept if x in far] == [x for x in lines if x in far - gone]
        assert set(lines) - set(kept) <= gone


def test_a_copy_of_a_later_document_goes_whole(spark):
    p1, p2 = "first paragraph of four words", "second paragraph of four words"
    rows = [(1, f"{p1}\n{p2}"), (2, f"{p2}\n{p1}"), (3, f"{p2}\n{p1}"), (4, f"{p2}\n{p1}\nown line")]
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in dedup_lines(documents(spark, rows)).collect()}
    assert got[1][0] == 0 and got[2][0] == 1 and got[3] == (2, "") and got[4] == (2, "own line")


def test_a_short_line_goes_with_the_previous_holder(spark):
    p1, p2 = "first paragraph of four words", "second paragraph of four words"
    rows = [(1, f"{p1}\nx"), (2, f"y\n{p2}"), (3, f"{p1}\nshort one\n{p2}"), (4, f"{p1}\nshort one\n{p2}\nmine")]
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in dedup_lines(documents(spark, rows)).collect()}
    assert got[3] == (2, "short one") and got[4] == (3, "mine")


def test_many_holders_change_nothing(spark):
    """A block goes alike from 5 and from 50 documents, with its short line."""
    block = "one two three four five\nsix seven\neight nine ten eleven"
    for n in (5, 50):
        got = {r.doc_id: r.kept_text for r in dedup_lines(documents(spark, [(i, f"own {i}\n{block}\nend {i}") for i in range(n)])).collect()}
        assert all(got[i] == f"own {i}\nend {i}" for i in range(1, n))


def test_a_line_held_twice_is_aligned(spark):
    rare = "a line that the first holds twice"
    rows = [(1, f"x\n{rare}\ny\n{rare}\nz"), (2, f"p\n{rare}\nq")]
    assert {r.doc_id: r.kept_text for r in dedup_lines(documents(spark, rows)).collect()} == {1: rows[0][1], 2: "p\nq"}


@pytest.mark.parametrize("bits", [1 << 28, 20, 1])
def test_longest_common(monkeypatch, bits):
    monkeypatch.setattr(line_dedup, "BITS", bits)
    for seed in range(200):
        r = random.Random(seed)
        a, b = ([r.randrange(0, 5) for _ in range(r.randrange(0, 20))] for _ in range(2))
        p = sorted(line_dedup.longest_common(a, b))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + (x == y != 0))
        assert len(p) == best[-1][-1] and all(a[i] == b[j] != 0 for i, j in p)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(p, p[1:], strict=False))


def test_patience_keeps_order():
    for seed in range(50):
        r = random.Random(seed)
        a, b = ([r.randrange(0, 12) for _ in range(r.randrange(0, 25))] for _ in range(2))
        p = patience(a, b)
        assert all(a[i] == b[j] != 0 for i, j in p)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(p, p[1:], strict=False))
    assert patience([5, 1, 2, 3, 6], [1, 2, 3, 7]) == [(1, 0), (2, 1), (3, 2)]


def test_a_shared_block_goes_from_the_later_document(spark):
    block = "one two three four five\nsix seven\neight nine ten eleven"
    rows = [(1, f"my own first line here\n{block}\nend"), (2, f"{block}\nanother line of my own"), (3, "six seven\nnothing else in common with them")]
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in dedup_lines(documents(spark, rows)).collect()}
    assert got == {1: (0, rows[0][1]), 2: (3, "another line of my own"), 3: (0, rows[2][1])}


def test_odd_cases(spark):
    got = sorted((r.doc_id or -1, r.n_lines, r.n_removed, r.kept_text is None) for r in dedup_lines(documents(spark, odd_rows())).collect())
    assert [x[:3] for x in got] == [(-1, 1, 0), (1, 0, 0), (2, 0, 0), (3, 2, 0), (4, 1, 0), (5, 1, 0), (5, 1, 0), (6, 1, 0), (7, 1, 0), (8, 1, 0)]
    assert [x[3] for x in got].count(True) == 1
    assert dedup_lines(documents(spark, [])).count() == 0
    same = "a line of some words\nanother line of some words"
    assert [r.n_removed for r in dedup_lines(documents(spark, [(1, same), (1, same)])).collect()] == [0, 0]
    clash = documents(spark, [(1, same), (2, same)]).selectExpr("*", "1 AS line", "2 AS key", "3 AS points")
    assert sorted(r.n_removed for r in dedup_lines(clash).collect()) == [0, 2]
    assert len(words(same)) == 10
