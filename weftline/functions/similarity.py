"""String similarities. What Spark has no function for runs as one Arrow UDF over pairs that cheap tests have passed."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of one whole number a row."""
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        u = s & where.get(ch, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    """Indel similarity in percent; two empty texts are alike."""
    return 100.0 * 2 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best of three: both remainders after the common words, and the common words against each whole."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    only_x, only_y = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and not (only_x and only_y):
        return 100.0
    gap = len(both) + bool(both)
    n_x, n_y = gap + len(only_x), gap + len(only_y)
    apart = len(only_x) + len(only_y) - 2 * common_subsequence(only_x, only_y)
    best = 100.0 - 100.0 * apart / (n_x + n_y) if n_x + n_y else 100.0
    if both:
        for n in (n_x, n_y):
            best = max(best, 100.0 - 100.0 * (n - len(both)) / (len(both) + n))
    return best


def partial_token_sort_ratio(a: str, b: str) -> float:
    """The best that the shorter one's sorted words reach against any stretch, as long at most, of the longer's."""
    x, y = sorted((" ".join(sorted(a.split())), " ".join(sorted(b.split()))), key=len)
    if not x:
        return 100.0 if not y else 0.0
    best = max(ratio(x, y[max(0, i) : i + len(x)]) for i in range(1 - len(x), len(y)))
    if len(x) == len(y):  # then neither is the shorter
        best = max(best, max(ratio(y, x[max(0, i) : i + len(y)]) for i in range(1 - len(y), len(x))))
    return best


def sequence_ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


_ALL = {"ratio": ratio, "token_sort": token_sort_ratio, "token_set": token_set_ratio, "partial_token_sort": partial_token_sort_ratio, "sequence": sequence_ratio}


def _letters(texts: list[str]) -> np.ndarray:
    """Code points of each text in a row, zeros behind it."""
    m = np.array(texts, dtype=np.str_)
    return m.view(np.uint32).reshape(len(texts), -1) if m.dtype.itemsize else np.zeros((len(texts), 0), np.uint32)


def _masks(a: np.ndarray, letters: int) -> np.ndarray:
    """Of each row and letter: bits of the places where the letter stands."""
    out, rows = np.zeros((len(a), letters), np.uint64), np.arange(len(a))
    for i in range(a.shape[1]):
        out[rows, a[:, i]] |= np.uint64(1 << i)
    out[:, 0] = 0
    return out


def _grown(mask: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of longest common subsequences, all rows at once: a word of bits each, zero where the subsequence grows."""
    s, rows = np.full(len(b), np.iinfo(np.uint64).max, np.uint64), np.arange(len(b))
    for t in range(b.shape[1]):
        u = s & mask[rows, b[:, t]]
        s = (s + u) | (s - u)
    return np.bitwise_count(~s).astype(np.int64)


#: Texts that a word of bits holds; longer ones go one by one.
SHORT = 64


def _pairwise(a: list[str], b: list[str], short, long) -> np.ndarray:
    """short(rows of a, rows of b) where the shorter text fits a word of bits, long(text, text) elsewhere; the shorter comes first."""
    n_a, n_b = (np.fromiter(map(len, v), np.int64, len(v)) for v in (a, b))
    x, y = list(a), list(b)
    for i in np.flatnonzero(n_a > n_b).tolist():
        x[i], y[i] = y[i], x[i]
    fits = (np.minimum(n_a, n_b) <= SHORT) & (np.maximum(n_a, n_b) <= 4 * SHORT)
    out = np.zeros(len(x))
    some = np.flatnonzero(fits)
    if len(some):
        m, n = _letters([x[i] for i in some]), _letters([y[i] for i in some])
        there = np.zeros(int(max(m.max(initial=0), n.max(initial=0))) + 1, bool)
        there[m], there[n], there[0] = True, True, True
        number = np.cumsum(there) - 1  # zero stays zero
        out[some] = short(number[m], number[n], int(number[-1]) + 1)
    for i in np.flatnonzero(~fits):
        out[i] = long(x[i], y[i])
    return out


def common_subsequences(a: list[str], b: list[str]) -> np.ndarray:
    return _pairwise(a, b, lambda m, n, letters: _grown(_masks(m, letters), n), common_subsequence)


def _ratios(a: list[str], b: list[str]) -> np.ndarray:
    total = np.fromiter((len(p) + len(q) for p, q in zip(a, b, strict=True)), np.int64, len(a))
    return np.where(total > 0, 200.0 * common_subsequences(a, b) / np.maximum(total, 1), 100.0)


def _sorted_words(a: list[str]) -> list[str]:
    kept: dict[str, str] = {}
    return [kept[x] if x in kept else kept.setdefault(x, " ".join(sorted(x.split()))) for x in a]


def _token_sorts(a: list[str], b: list[str]) -> np.ndarray:
    return _ratios(_sorted_words(a), _sorted_words(b))


def _token_sets(a: list[str], b: list[str]) -> np.ndarray:
    """As `token_set_ratio`; subsequences are computed for the remainders of pairs that need them."""
    kept: dict[str, set[str]] = {}
    of = lambda t: kept[t] if t in kept else kept.setdefault(t, set(t.split()))
    out, left, x, y, both_n = np.zeros(len(a)), [], [], [], []
    for i, (p, q) in enumerate(zip(a, b, strict=True)):
        s, t = of(p), of(q)
        if not s or not t:
            continue
        both = s & t
        if both and (len(both) == len(s) or len(both) == len(t)):
            out[i] = 100.0
            continue
        left.append(i)
        x.append(" ".join(sorted(s - t)))
        y.append(" ".join(sorted(t - s)))
        both_n.append(len(" ".join(both)))
    if left:
        n, n_x, n_y = (np.array(v, np.float64) for v in (both_n, [len(v) for v in x], [len(v) for v in y]))
        gap = n + (n > 0)
        best = 100.0 - 100.0 * (n_x + n_y - 2 * common_subsequences(x, y)) / np.maximum(2 * gap + n_x + n_y, 1)
        for own in (gap + n_x, gap + n_y):
            best = np.where(n > 0, np.maximum(best, 100.0 - 100.0 * (own - n) / (n + own)), best)
        out[left] = best
    return out


def _strands(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each pair of rows, where the strand that leaves the grid below each letter of n came in: a column of n counted from 0, or less than 0
    for a row of m.

    A strand enters above each letter of n and before each letter of m. Two that meet at a cell cross there, unless its letters are equal or they
    have crossed before. Of the letters l to r of n, those whose strands both enter and leave there are what a longest common subsequence with m
    leaves out: one pass over the cells has the answer for every stretch of n.
    """
    above = np.repeat(np.arange(n.shape[1], dtype=np.int16)[:, None], len(n), axis=1)
    x, y = np.ascontiguousarray(m.T), np.ascontiguousarray(n.T)
    for i in range(len(x)):
        h = np.full(len(m), -1 - i, np.int16)
        equal = (y == x[i]) & (x[i] != 0)
        for j in range(len(y)):
            v = above[j]
            low, high = np.minimum(h, v), np.maximum(h, v)
            above[j], h = np.where(equal[j], h, high), np.where(equal[j], v, low)  # unlike letters: what enters farther left leaves to the right
    return above.T


def _windows(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The best ratio of each shorter text m against the stretches, as long at most, of the longer one n."""
    came, best = _strands(m, n), np.zeros(len(m))
    short, long = (m > 0).sum(axis=1), (n > 0).sum(axis=1)
    places = np.arange(n.shape[1])
    for i in range(1 - m.shape[1], n.shape[1]):
        left, right = max(0, i), np.minimum(i + short, long)
        size = right - left
        lost = ((came[:, left:] >= left) & (places[None, left:] < right[:, None])).sum(axis=1)
        ok = (size > 0) & (i > -short)
        best = np.where(ok, np.maximum(best, 200.0 * (size - lost) / np.maximum(short + size, 1)), best)
    return best


#: Cells of the grid of a pair that is still worked on in batches.
CELLS = 1 << 14


def _best_windows(x: list[str], y: list[str]) -> np.ndarray:
    """`_windows` of pairs whose first is no longer than the second, those of like size together."""
    n_x, n_y = (np.fromiter(map(len, v), np.int64, len(v)) for v in (x, y))
    out, fits = np.zeros(len(x)), n_x * n_y <= CELLS
    order = np.flatnonzero(fits)
    order = order[np.lexsort([n_y[order], n_x[order]])]
    for i in range(0, len(order), 2048):
        rows = order[i : i + 2048]
        out[rows] = _windows(_letters([x[k] for k in rows]), _letters([y[k] for k in rows]))
    for k in np.flatnonzero(~fits):
        out[k] = partial_token_sort_ratio(x[k], y[k])
    return out


def _partials(a: list[str], b: list[str]) -> np.ndarray:
    x, y = _sorted_words(a), _sorted_words(b)
    pairs = [(p, q) if len(p) <= len(q) else (q, p) for p, q in zip(x, y, strict=True)]
    pairs += [(q, p) for p, q in pairs if len(p) == len(q)]  # neither is the shorter
    number = {pair: i for i, pair in enumerate(dict.fromkeys(pairs))}
    best = _best_windows([p for p, _ in number], [q for _, q in number])
    for pair, i in number.items():
        if not all(pair):
            best[i] = 100.0 if pair[0] == pair[1] else 0.0
    of = lambda p, q: max(best[number[p, q]], best[number[q, p]]) if len(p) == len(q) else best[number[(p, q) if len(p) < len(q) else (q, p)]]
    return np.array([of(p, q) for p, q in zip(x, y, strict=True)], np.float64)


def _longest_blocks(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair of rows the longest stretch that both have, first in a and then in b: where it begins in each, and its length."""
    rows = np.arange(len(a))
    run, size, in_a, in_b = np.zeros(b.shape, np.int32), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    for i in range(a.shape[1]):
        longer = np.zeros_like(run)
        longer[:, 1:] = run[:, :-1]
        run = np.where(b == a[:, i : i + 1], longer + 1, 0)
        at = run.argmax(axis=1)
        n = run[rows, at]
        better = n > size
        size, in_a, in_b = np.where(better, n, size), np.where(better, i + 1 - n, in_a), np.where(better, at + 1 - n, in_b)
    return in_a, in_b, size


def _stretches(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, fill: int) -> np.ndarray:
    """A row for each stretch of flat, filled up behind it."""
    place = np.arange(int(sizes.max(initial=0)))
    at = starts[:, None] + place
    return np.where(place < sizes[:, None], flat[np.minimum(at, max(0, len(flat) - 1))], np.uint32(0xFFFFFFFF - fill))


#: From so many letters on the sequence ratio leaves common letters aside.
POPULAR = 200


def _sequences(a: list[str], b: list[str]) -> np.ndarray:
    """`sequence_ratio` of all pairs: longest blocks of all of them at once, then of what lies before and behind these, and so on."""
    number = {pair: i for i, pair in enumerate(dict.fromkeys(zip(a, b, strict=True)))}
    x, y = [p for p, _ in number], [q for _, q in number]
    n_x, n_y = (np.fromiter(map(len, v), np.int64, len(v)) for v in (x, y))
    matched, short = np.zeros(len(x)), (n_y < POPULAR) & (n_x < POPULAR)
    flat_x, flat_y = (np.frombuffer("".join(v).encode("utf-32-le", "surrogatepass"), np.uint32) for v in (x, y))
    ends_x, ends_y = np.cumsum(n_x), np.cumsum(n_y)
    whose = np.flatnonzero(short & (n_x > 0) & (n_y > 0))
    left = np.stack([whose, (ends_x - n_x)[whose], n_x[whose], (ends_y - n_y)[whose], n_y[whose]])  # pair, and a stretch of each: from, letters
    while left.shape[1]:
        left, after = left[:, np.lexsort([left[4], left[2]])], []
        for i in range(0, left.shape[1], 1024):
            k, from_a, n_a, from_b, n_b = left[:, i : i + 1024]
            in_a, in_b, size = _longest_blocks(_stretches(flat_x, from_a, n_a, 0), _stretches(flat_y, from_b, n_b, 1))
            np.add.at(matched, k, size)
            behind_a, behind_b = in_a + size, in_b + size
            after.append(np.stack([k, from_a, in_a, from_b, in_b])[:, (size > 0) & (in_a > 0) & (in_b > 0)])
            after.append(np.stack([k, from_a + behind_a, n_a - behind_a, from_b + behind_b, n_b - behind_b])[:, (size > 0) & (behind_a < n_a) & (behind_b < n_b)])
        left = np.concatenate(after, axis=1)
    out = np.where(n_x + n_y > 0, 2.0 * matched / np.maximum(n_x + n_y, 1), 1.0)
    for k in np.flatnonzero(~short):
        out[k] = sequence_ratio(x[k], y[k])
    return out[[number[pair] for pair in zip(a, b, strict=True)]] if len(a) else out


_BATCH = {"ratio": _ratios, "token_sort": _token_sorts, "token_set": _token_sets, "partial_token_sort": _partials, "sequence": _sequences}
#: Pairs that are compared at once.
AT_ONCE = 8192


def batch_scores(kinds: list[str], a: list[str], b: list[str]) -> dict[str, np.ndarray]:
    parts = [{k: _BATCH[k](a[i : i + AT_ONCE], b[i : i + AT_ONCE]) for k in kinds} for i in range(0, len(a), AT_ONCE)]
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in kinds}


def similarity(kind: str, a: Column, b: Column) -> Column:
    """One of ratio, token_sort, token_set, partial_token_sort (0 to 100) and sequence (0 to 1). Null reads as empty."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(batch_scores([kind], x.fillna("").tolist(), y.fillna("").tolist())[kind], dtype="float64")

    return run(a, b)


def similarities(a: Column, b: Column) -> Column:
    """All five in one pass over the pair, as a struct."""
    return scores(list(_ALL), a, b)


def scores(kinds: list[str], a: Column, b: Column) -> Column:
    """Those asked for in one pass over the pair, as a struct."""

    @F.pandas_udf(", ".join(f"{k} double" for k in kinds))
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(batch_scores(kinds, x.fillna("").tolist(), y.fillna("").tolist()), columns=kinds, dtype="float64")

    return run(a, b)


def any_alike(a: Column, b: Column) -> Column:
    """Of two arrays of words: whether a word of each, four letters or more, begins with the other or is 85 % alike."""

    @F.pandas_udf("boolean")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        long = [[[t for t in (s if s is not None else ()) if len(t) >= 4] for s in v] for v in (x, y)]
        begin = np.array([any(p.startswith(q) or q.startswith(p) for p in s for q in t) for s, t in zip(*long, strict=True)], bool)
        pairs = [(i, p, q) for i in np.flatnonzero(~begin).tolist() for p in long[0][i] for q in long[1][i]]
        alike = batch_scores(["sequence"], [p for _, p, _ in pairs], [q for _, _, q in pairs])["sequence"] >= 0.85
        begin[[i for (i, _, _), ok in zip(pairs, alike, strict=True) if ok]] = True
        return pd.Series(begin, dtype="bool")

    return run(a, b)


def may_reach(percent: float, a: Column, b: Column) -> Column:
    """Whether the lengths let `ratio` reach so much: what needs no UDF to fail."""
    x, y = F.length(a), F.length(b)
    return F.least(x, y) * 200 >= percent * (x + y)
