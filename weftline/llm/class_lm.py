"""Operator 7: scores by a Brown class-based bigram model.

P(w | v) = P(class of w | class of v) * P(w | class of w); a text is its words, then one end, and follows an end.

1. The TYPES commonest words, and all others met in BUCKETS types by their endings, are exchanged between classes, to gain
   likelihood, in rounds: Spark sums each type's neighbours by class, which are two numbers a type and class, and the moves
   follow on the driver. The classes of the round with the best likelihood hold.
2. Then every other word of the training text is exchanged by itself, as many as there are: words are dealt out by Spark, each
   with how often each class stands next to it, summed a slice of text before the shuffle, and held against the table of class pairs, whose
   size doesn't depend on the corpus. It starts from its ending's class and goes where the likelihood gains most (a word that follows itself counts as a
   neighbour of its class); a task's own moves change its copy of the table as they are made. Tasks, of which there are more the more such tokens there
   are, work on groups of words of bounded size, one after another. Where all these moves together lose likelihood, every second of them is made, or
   every fourth, and so on.
3. Texts become chains of classes. Classes of words that are not among the COUNTED commonest come to their places in the texts
   by a join. Only words never seen in training have their ending's class. Transitions are counted over these chains.

Transitions are smoothed towards the class's share of all tokens. A class's words share 1 - u of its probability by
their counts; u, the share of its tokens that were seen once, is for words never seen (taken as one word, as the base does).

Null or empty text: the end alone. Null doc_id: not held out. Repeated rows are scored row by row. Very long texts are read
whole, some slices of many texts at once; ties of gain go to the lower class. Without training text every token is unknown.
Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftline.llm.common import Scratch, coded, slices, tidy

CLASSES, ROUNDS = 64, 8
TYPES, BUCKETS, ENDING = 4000, 512, 3
#: At most so many words' counts are sent to every task.
COUNTED = 200_000
#: Tokens by which a class's transitions are drawn towards the classes' shares.
PULL = 64.0
SLICE_BYTES = 4 << 20
#: Words of a task that move at once against one table, at most.
AT_ONCE = 1024


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (part for whole in batches for part in slices(whole, 0, SLICE_BYTES)):
        words, codes, _ = coded(b.column(0), lower=True)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(np.bincount(codes, minlength=len(words)))], ["word", "n"])


class Types:
    """Of words: the commonest by name, others by their endings. The end of a text is the last type."""

    def __init__(self, common: list[bytes]):
        self.of = {w: i for i, w in enumerate(common)}
        self.buckets = BUCKETS
        self.end = len(common) + BUCKETS

    def __call__(self, words: list[bytes]) -> np.ndarray:
        get, first = self.of.get, self.end - self.buckets
        return np.fromiter((t if (t := get(w)) is not None else first + xxhash.xxh3_64_intdigest(w[-ENDING:]) % self.buckets for w in words), np.int64, len(words))


def _pairs(types):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = types.value
        size = own.end + 1
        for b in (part for whole in batches for part in slices(whole, 0, SLICE_BYTES)):
            words, codes, length = coded(b.column(0), lower=True)
            t = np.insert(own(words)[codes], np.cumsum(length), own.end)
            pair, n = np.unique(np.concatenate([[own.end], t[:-1]]) * size + t, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])

    return run


def _neighbours(classes, k: int):
    """For each type of the task: how often each class follows and precedes it, and it itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = classes.value
        size = len(of)
        sums: np.ndarray | None = None
        for b in batches:
            t, other, side, n = (np.asarray(b.column(i)).astype(np.int64) for i in range(4))
            if sums is None:
                sums = np.zeros((size, 2 * k + 1))
            np.add.at(sums, (t, side * k + of[other]), n)
            own = (t == other) & (side == 0)
            np.add.at(sums, (t[own], 2 * k), n[own])
        if sums is not None:
            some = np.flatnonzero(sums.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([sums[i].tobytes() for i in some], pa.binary())], ["t", "sums"])

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def objective(m: np.ndarray) -> float:
    return float(_xlogx(m).sum() - _xlogx(m.sum(axis=0)).sum() - _xlogx(m.sum(axis=1)).sum())


def exchange(after: np.ndarray, before: np.ndarray, itself: np.ndarray, of: np.ndarray, m: np.ndarray, fixed: int) -> np.ndarray:
    """New classes: each type in turn moves to where the likelihood gains most. The last `fixed` classes keep theirs.

    after, before: how often each class follows and precedes each type, as the round began; m: counts of class pairs.
    """
    of, m = of.copy(), m.copy()
    row, col = m.sum(axis=1), m.sum(axis=0)
    free = len(m) - fixed
    for t in range(len(of)):
        c = of[t]
        if c >= free or not (after[t].any() or before[t].any()):
            continue
        s, p, z = after[t].copy(), before[t].copy(), itself[t]
        m[c] -= s
        m[:, c] -= p
        m[c, c] += z
        np.maximum(m, 0, out=m)
        s[c], p[c] = max(0, s[c] - z), max(0, p[c] - z)
        n_s, n_p = s.sum() + z, p.sum() + z
        row[c], col[c] = max(0, row[c] - n_s), max(0, col[c] - n_p)
        f = _xlogx(m)
        out, into = _xlogx(m + s) - f, _xlogx(m.T + p) - f.T
        own = np.diagonal(m)
        gain = out.sum(axis=1) - np.diagonal(out) + into.sum(axis=1) - np.diagonal(into) + _xlogx(own + s + p + z) - _xlogx(own)
        gain -= _xlogx(row + n_s) - _xlogx(row) + _xlogx(col + n_p) - _xlogx(col)
        d = int(np.argmax(gain[:free]))
        if gain[d] <= gain[c] + 1e-9:
            d = c
        of[t] = d
        m[d] += s
        m[:, d] += p
        m[d, d] += z
        row[d], col[d] = row[d] + n_s, col[d] + n_p
    return of


#: Words next to each other so often or less look up what they change; chunks of fewer words compute it.
FEW_TIMES, LOOK_UP = 8, 256


def exchange_words(owner: np.ndarray, side: np.ndarray, other: np.ndarray, n: np.ndarray, of: np.ndarray, m: np.ndarray, fixed: int) -> np.ndarray:
    """New classes of many words, each moved by itself against the same table m of class pairs.

    owner (sorted), side (0: follows, 1: precedes), other, n: how often each class stands next to each word; of: their classes.
    """
    free, words = len(m) - fixed, len(of)
    gain = np.zeros((words, free))
    tables = np.ascontiguousarray(np.stack([m[:free].T, m[:, :free]]))  # by side, class of the neighbour, class of the word
    starts = np.searchsorted(owner, np.arange(words + 1))
    own = of[owner]
    fits = np.flatnonzero(own < free)
    if words >= LOOK_UP:
        small = np.stack([_xlogx(tables + k) - _xlogx(tables) for k in range(1, FEW_TIMES + 1)])
    i = 0
    while i < words:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + (1 << 15), "right")) - 1)
        at = slice(starts[i], starts[j])
        s, e, k = side[at], other[at], n[at]
        if words >= LOOK_UP:
            change = small[np.minimum(k, FEW_TIMES) - 1, s, e]
            many = np.flatnonzero(k > FEW_TIMES)
        else:
            change, many = np.empty((len(k), free)), np.arange(len(k))
        if len(many):
            old = tables[s[many], e[many]]
            change[many] = _xlogx(old + k[many][:, None]) - _xlogx(old)
        here = fits[np.searchsorted(fits, starts[i]) : np.searchsorted(fits, starts[j])]  # a word's own class, without the word itself
        old = tables[side[here], other[here], own[here]]
        change[here - starts[i], own[here]] = _xlogx(np.maximum(old - n[here], 0) + n[here]) - _xlogx(np.maximum(old - n[here], 0))
        has = np.flatnonzero(np.diff(starts[i : j + 1])) + i
        if len(has):
            gain[has] = np.add.reduceat(change, starts[has] - starts[i], axis=0)
        i = j
    for k, total in ((0, m.sum(axis=1)[:free]), (1, m.sum(axis=0)[:free])):
        add = np.bincount(owner[side == k], n[side == k], words)
        times, which = np.unique(add, return_inverse=True)  # few kinds of sums
        kinds = _xlogx(total[None, :] + times[:, None]) - _xlogx(total)[None, :]
        change, rows = kinds[which], np.flatnonzero(of < free)
        old = np.maximum(total[of[rows]] - add[rows], 0)
        change[rows, of[rows]] = _xlogx(old + add[rows]) - _xlogx(old)
        gain -= change
    best = gain.argmax(axis=1)
    rows = np.arange(words)
    stay = np.where(of < free, gain[rows, np.minimum(of, free - 1)], -math.inf)
    return np.where(gain[rows, best] > stay + 1e-9, best, of)


def move(m: np.ndarray, old: np.ndarray, new: np.ndarray, side: np.ndarray, other: np.ndarray, n: np.ndarray) -> None:
    """m after the words of some neighbours went from their old classes to new ones."""
    for c, sign in ((old, -1), (new, 1)):
        np.add.at(m, (np.where(side == 0, c, other), np.where(side == 0, other, c)), sign * n)
    np.maximum(m, 0, out=m)


def exchange_in_turn(owner: np.ndarray, side: np.ndarray, other: np.ndarray, n: np.ndarray, of: np.ndarray, m: np.ndarray, fixed: int) -> np.ndarray:
    """New classes of words in their order: a few move, the table follows, then more move, a sixteenth of those before at once."""
    of, m = of.copy(), m.astype(np.float64)
    starts = np.searchsorted(owner, np.arange(len(of) + 1))
    i = 0
    while i < len(of):
        j = min(len(of), i + min(AT_ONCE, max(1, i // 16)))
        at = slice(starts[i], starts[j])
        whose, s, e, k = owner[at] - i, side[at], other[at], n[at]
        new = exchange_words(whose, s, e, k, of[i:j], m, fixed)
        move(m, of[i:j][whose], new[whose], s, e, k)
        of[i:j] = new
        i = j
    return of


def _word_neighbours(types, classes):
    """Of each word of a slice that is no type by itself: which classes stand next to it and how often, a byte each; 255 is the most of one entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, of = types.value, classes.value
        k = int(of.max()) + 1
        for b in (part for whole in batches for part in slices(whole, 0, SLICE_BYTES)):
            words, codes, length = coded(b.column(0), lower=True)
            t = own(words)
            ends = np.cumsum(length)
            chain = np.insert(of[t][codes], ends, of[own.end])
            before = np.concatenate([[of[own.end]], chain[:-1]])
            at = np.arange(len(codes)) + np.repeat(np.arange(len(length)), length)  # each word's place in chain
            some = np.flatnonzero((t >= own.end - own.buckets)[codes])
            near = np.concatenate([codes[some] * (2 * k) + chain[at[some] + 1], codes[some] * (2 * k) + k + before[at[some]]])
            pair, n = np.unique(near, return_counts=True)
            parts = -(-n // 255)
            pair, n = np.repeat(pair, parts), np.minimum(np.repeat(n, parts) - 255 * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)), 255)
            whose, code = np.divmod(pair, 2 * k)
            new = np.flatnonzero(np.diff(whose, prepend=-1))
            offsets = pa.py_buffer(np.append(new, len(pair)).astype(np.int64))
            lists = [pa.Array.from_buffers(pa.large_binary(), len(new), [None, offsets, pa.py_buffer(x.astype(np.uint8))]).cast(pa.binary()) for x in (code, n)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).take(pa.array(whose[new])), *lists], ["word", "near", "times"])

    return run


#: Entries of neighbours, and words, that a task exchanges at once.
GROUP_ENTRIES, GROUP_WORDS = 1 << 20, 1 << 17


def _bytes(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls end to end, and how many each row has."""
    ends = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1]
    return np.frombuffer(x.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], np.diff(ends)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """Whole words of sorted rows, so many that they fit: the words, and of each entry its word's place, its code and its times."""
    words: list[bytes] = []
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def all_held() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.concatenate(x) for x in zip(*held, strict=True))

    for b in (b for b in batches if b.num_rows):
        own = b.column(0)
        (code, sizes), (times, _) = _bytes(b.column(1)), _bytes(b.column(2))
        new = np.ones(len(own), bool)
        new[1:] = np.asarray(pc.not_equal(own.slice(1), own.slice(0, len(own) - 1)))
        new[0] = not words or own[0].as_py() != words[-1]
        place = len(words) - 1 + np.cumsum(new)
        words += own.filter(pa.array(new)).to_pylist()
        held.append((np.repeat(place, sizes), code, times))
        if len(words) > 1 and (len(words) > GROUP_WORDS or sum(len(c) for _, c, _ in held) > GROUP_ENTRIES):
            whose, code, times = all_held()  # all but the last word, which may go on
            cut = int(np.searchsorted(whose, len(words) - 1))
            yield words[:-1], whose[:cut], code[:cut], times[:cut]
            words, held = words[-1:], [(np.zeros(len(code) - cut, np.int64), code[cut:], times[cut:])]
    if words:
        yield words, *all_held()


def _exchanged(types, classes, pairs):
    """Words of a task, whose rows are sorted by word, with their counts, first and new classes; the table of pairs goes on from group to group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, of, m = types.value, classes.value, pairs.value.astype(np.float64)
        k = len(m)
        for words, whose, code, times in _groups(batches):
            pair, back = np.unique(whose * (2 * k) + code, return_inverse=True)
            n = np.bincount(back, times).astype(np.int64)
            owner, code = np.divmod(pair, 2 * k)
            total = np.bincount(owner[code < k], n[code < k], len(words)).astype(np.int64)
            turn = sorted(range(len(words)), key=lambda i: (-total[i], words[i]))  # noqa: B023  the commonest of the group first
            place = np.empty(len(words), np.int64)
            place[turn] = np.arange(len(words))
            words, total = [words[i] for i in turn], total[turn]
            order = np.argsort(place[owner], kind="stable")
            owner, code, n = place[owner][order], code[order], n[order]
            side, other, first = code // k, code % k, of[own(words)]
            new = exchange_in_turn(owner, side, other, n, first, m, fixed=1)
            move(m, first[owner], new[owner], side, other, n)
            yield from pa.Table.from_arrays([pa.array(words, pa.binary()), pa.array(total), pa.array(first.astype(np.int32)), pa.array(new.astype(np.int32))], ["word", "n", "first", "class"]).to_batches(1 << 14)

    return run


class Lexicon:
    """Counts and classes of the common words; classes of all others by their endings, until a join gives their own."""

    def __init__(self, types: Types, of: np.ndarray, words: list[bytes], n: np.ndarray, classes: np.ndarray):
        self.types, self.of, self.at, self.n, self.classes = types, of, {w: i for i, w in enumerate(words)}, n, classes
        self.end = int(of[types.end])

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Counts (0 where a join must say) and classes."""
        get = self.at.get
        at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        far = np.flatnonzero(at < 0)
        n, c = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        n[at >= 0], c[at >= 0] = self.n[at[at >= 0]], self.classes[at[at >= 0]]
        c[far] = self.of[self.types([words[i] for i in far])]
        return n, c


#: Marks a place of a chain whose word is not among the common ones.
FAR = 128


def _chains(lexicon, known_end: bool, unit: float):
    """Of each text its classes, a byte a word, and sums over its common words; and its other words with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lexicon.value
        for b in (part for whole in batches for part in slices(whole, 3, SLICE_BYTES)):
            words, codes, length = coded(b.column(3), lower=True)
            n, c = own(words)
            docs, ends = len(length), np.cumsum(length)
            chain = np.where(n > 0, c, c | FAR).astype(np.uint8)[codes]
            doc = np.repeat(np.arange(docs), length)
            sums = lambda x: np.bincount(doc, x[codes], docs).astype(np.float64)  # noqa: B023, E731
            base = sums(unit + np.log10(n + 1.0))
            log_n = sums(np.log10(np.maximum(n, 1)))
            n_known = sums((n > 0).astype(float)).astype(np.int64) + int(known_end)
            # words to look up: each once a text, with its places
            far = np.flatnonzero((n == 0)[codes])
            key = doc[far] * max(1, len(words)) + codes[far]
            order = np.argsort(key, kind="stable")
            place = (far - (ends - length)[doc[far]])[order].astype(np.int32)
            pair, first = np.unique(key[order], return_index=True)
            who, which = np.divmod(pair, max(1, len(words)))
            offsets = pa.array(np.searchsorted(who, np.arange(docs + 1)), pa.int32())
            at = pa.Array.from_buffers(pa.large_binary(), len(pair), [None, pa.py_buffer((np.append(first, len(place)) * 4).astype(np.int64)), pa.py_buffer(place)]).cast(pa.binary())
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(words, pa.binary()).take(pa.array(which)), at)]
            edge = np.concatenate([[0], ends])
            bytes_ = pa.Array.from_buffers(pa.large_binary(), docs, [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(chain)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], bytes_, pa.array(n_known), pa.array(base), pa.array(log_n), *lists], ["row", "doc_id", "held_out", "chain", "n_known", "base_score", "log_n", "words", "at"])

    return run


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains with the classes that the join found for words which are not common; all of a batch's places at once."""
    for b in batches:
        docs, chains = b.num_rows, b.column(3).to_pylist()
        length = np.fromiter(map(len, chains), np.int64, docs)
        flat = np.frombuffer(b"".join(chains), np.uint8).copy()
        found = b.column(b.schema.names.index("found"))
        each = found.flatten()  # without those of null lists
        doc = np.repeat(np.arange(docs), np.asarray(pc.fill_null(pc.list_value_length(found), 0)))
        n, classes, at = (each.field(i) for i in range(3))
        n, times = np.asarray(n), np.asarray(pc.binary_length(at)).astype(np.int64) // 4
        place = np.frombuffer(b"".join(at.to_pylist()), np.int32) + np.repeat((np.cumsum(length) - length)[doc], times)
        flat[place] = np.repeat(np.asarray(classes), times)
        add = [np.bincount(doc, x, docs) for x in (times, times * np.log10(n + 1.0), times * np.log10(np.maximum(n, 1)))] if len(doc) else [np.zeros(docs)] * 3
        more = [pc.add(b.column(i), pa.array(v.astype(kind), b.column(i).type)) for i, v, kind in zip((4, 5, 6), add, (np.int64, np.float64, np.float64), strict=True)]
        edge = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
        out = pa.Array.from_buffers(pa.large_binary(), docs, [None, pa.py_buffer(edge), pa.py_buffer(flat)]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([*b.columns[:3], out, *more], b.schema.names[:7])


def _joined(chains: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes of all texts end to end, an end after each; and how many places each has, its end too."""
    length = np.fromiter(map(len, chains), np.int64, len(chains))
    return np.insert(np.frombuffer(b"".join(chains), np.uint8), np.cumsum(length), end), length + 1


def _transitions(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros(k * k, np.int64)
        for b in batches:
            flat, _ = _joined(b.column(0).to_pylist(), k - 1)
            c = (flat & (FAR - 1)).astype(np.int64)
            m += np.bincount(np.concatenate([[k - 1], c[:-1]]) * k + c, minlength=k * k) if len(c) else 0
        some = np.flatnonzero(m)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(m[some])], ["pair", "n"])

    return run


class ClassModel:
    """The logarithms (base 10) that scoring adds up."""

    def __init__(self, pairs: np.ndarray, stats: np.ndarray, tokens: int, distinct: int, ends: int):
        """stats: tokens, words, words seen once of each class; ends: how many texts were learned from."""
        self.tokens, self.ends = tokens, ends
        share = (stats[:, 0] + 1) / (stats[:, 0] + 1).sum()
        self.step = np.log10((pairs + PULL * share) / (pairs.sum(axis=1, keepdims=True) + PULL))
        unseen = (stats[:, 2] + 1) / (stats[:, 0] + 2)
        self.unknown = np.log10(unseen)  # of a word never seen, in its class
        self.known = np.log10(1 - unseen) - np.log10(np.maximum(stats[:, 0], 1))  # of a word, besides log10 of its count
        self.known[-1] = self.unknown[-1] = 0.0  # the end is its class's only word
        self.base = -math.log10(tokens + distinct + 1)


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        end = len(m.step) - 1
        word = np.concatenate([m.known, np.zeros(FAR - end - 1), m.unknown])  # by class, from FAR on of unknown words
        for b in batches:
            flat, length = _joined(b.column(2).to_pylist(), end)
            c = flat & (FAR - 1)
            step = m.step[np.concatenate([[end], c[:-1]]), c] if len(c) else np.zeros(0)
            doc = np.repeat(np.arange(len(length)), length)
            score = np.bincount(doc, step + word[flat], len(length)) + np.asarray(b.column(5))
            base = np.asarray(b.column(4)) + m.base + math.log10(m.ends + 1)
            tokens = pa.array(np.full(len(length), m.tokens))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(length), b.column(3), tokens, pa.array(base), pa.array(score), pa.array(10.0 ** (-score / length))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return run


def common_words(counts: DataFrame, most: int) -> tuple[dict[bytes, int], int]:
    """The commonest words and their counts, at most so many: all of a count or more, which is the second; by an eighth of a doubling."""
    level = F.floor(F.log2("n") * 8)
    held, cut = 0, None
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # some hundred rows at most
        held += r["count"]
        if held > most:
            break
        cut = r["level"]
    if cut is None:
        return {}, 0
    rows = [(bytes(r["word"]), r["n"]) for r in counts.filter(level >= cut).collect()]
    rows.sort(key=lambda r: (-r[1], r[0]))
    return dict(rows), rows[-1][1]


def classify_types(texts: DataFrame, own: Types, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the types after the best round, the end in the last class by itself; and the counts of class pairs."""
    send = texts.sparkSession.sparkContext.broadcast
    types, size, k = send(own), own.end + 1, CLASSES + 1
    pairs = texts.mapInArrow(tidy(_pairs(types)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = pairs.select((F.col("pair") / size).cast("int").alias("a"), (F.col("pair") % size).cast("int").alias("b"), "n")
    sides = F.explode(F.array(F.struct(F.col("a").alias("t"), F.col("b").alias("other"), F.lit(0).alias("side")), F.struct(F.col("b").alias("t"), F.col("a").alias("other"), F.lit(1).alias("side"))))
    pairs = scratch.save(pairs.select(sides.alias("s"), "n").select("s.*", "n").repartition("t"), "pairs")
    of = np.arange(size) % CLASSES
    of[own.end] = CLASSES
    best, held, best_m = -math.inf, of, np.zeros((k, k))
    for turn in range(ROUNDS + 1):
        sums = np.zeros((size, 2 * k + 1))
        classes = send(of)
        for r in pairs.mapInArrow(tidy(_neighbours(classes, k)), "t long, sums binary").collect():  # 2 * k numbers a type
            sums[r["t"]] += np.frombuffer(r["sums"])
        classes.destroy()
        after, before, itself = sums[:, :k], sums[:, k : 2 * k], sums[:, 2 * k]
        m = np.zeros((k, k))
        np.add.at(m, of, after)
        if (now := objective(m)) > best:
            best, held, best_m = now, of, m
        if turn < ROUNDS:
            of = exchange(after, before, itself, of, m, fixed=1)
    scratch.drop(pairs)
    return held, best_m


#: Tokens that no type has by itself whose neighbours go to one task.
TASK_TOKENS = 4_000_000


def classify_words(texts: DataFrame, own: Types, held: np.ndarray, m: np.ndarray, tokens: int, scratch: Scratch) -> DataFrame:
    """word, n, first, class of every training word that is no type by itself: its ending's class, and that of its exchange. tokens: how many these have."""
    send = texts.sparkSession.sparkContext.broadcast
    types, classes = send(own), send(held)
    near = texts.mapInArrow(tidy(_word_neighbours(types, classes)), "word binary, near binary, times binary")
    near = near.repartition(max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-tokens // TASK_TOKENS)), "word").sortWithinPartitions("word")
    return scratch.save(near.mapInArrow(tidy(_exchanged(types, classes, send(m))), "word binary, n long, first int, class int"), "words")


class Trained:
    """Counts, classes of all words, and what chains and scores need of them."""

    def __init__(self, texts: DataFrame, counts: DataFrame, scratch: Scratch):
        """texts: one column; counts: word and n of all of them."""
        self.scratch = scratch
        self.words, self.distinct = counts.agg(F.sum("n"), F.count("*")).first()
        self.ends = texts.count()
        self.common, self.cut = common_words(counts, COUNTED)
        self.types = Types(list(self.common)[:TYPES])
        self.held, self.m = classify_types(texts, self.types, scratch)
        others = (self.words or 0) - sum(list(self.common.values())[:TYPES])
        self.rest = classify_words(texts, self.types, self.held, self.m, others, scratch)
        self.tokens, self.known_end = (self.words or 0) + self.ends, self.ends > 0
        self.distinct += int(self.known_end)

    def lexicon(self, column: str) -> Lexicon:
        words = list(self.common)
        classes = self.held[self.types(words)]
        at = {w: i for i, w in enumerate(words)}
        for r in self.rest.filter(F.col("n") >= self.cut).select("word", column).collect() if words else ():  # COUNTED at most
            classes[at[bytes(r["word"])]] = r[column]
        return Lexicon(self.types, self.held, words, np.fromiter(self.common.values(), np.int64, len(words)), classes)

    def stats(self, column: str) -> np.ndarray:
        out = np.zeros((CLASSES + 1, 3), np.int64)
        named = list(self.common)[:TYPES]
        n = np.array([self.common[w] for w in named], np.int64)
        c = self.held[self.types(named)] if named else np.zeros(0, np.int64)
        for i, x in enumerate((n, np.ones(len(n)), n == 1)):
            out[:, i] = np.bincount(c, x, CLASSES + 1)
        for r in self.rest.groupBy(F.col(column).alias("c")).agg(F.sum("n").alias("t"), F.count("*").alias("w"), F.count_if(F.col("n") == 1).alias("o")).collect():
            out[r["c"]] += np.array([r["t"], r["w"], r["o"]])
        out[CLASSES] = self.ends, 1, 0
        return out

    def chains(self, d: DataFrame, column: str) -> DataFrame:
        """d: row, doc_id, held_out, text. Each text's chain with the sums of its words."""
        unit = -math.log10(self.tokens + self.distinct + 1)
        kinds = "chain binary, n_known long, base_score double, log_n double"
        names = StructType([*d.drop("text").schema, *StructType.fromDDL(kinds)])
        more = StructType([*names, *StructType.fromDDL("words array<binary>, at array<binary>")])
        lexicon = d.sparkSession.sparkContext.broadcast(self.lexicon(column))
        near = self.scratch.save(d.mapInArrow(tidy(_chains(lexicon, self.known_end, unit)), more), "near")
        each = near.select("row", F.explode(F.arrays_zip("words", "at")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.at").alias("at"))
        each = each.join(self.rest.select("word", "n", F.col(column).alias("class")), "word")
        each = each.groupBy("row").agg(F.collect_list(F.struct("n", "class", "at")).alias("found"))
        out = self.scratch.save(near.drop("words", "at").join(each, "row", "left").mapInArrow(tidy(_filled), names), "chains")
        self.scratch.drop(near)
        return out

    def pairs(self, chains: DataFrame) -> np.ndarray:
        k = CLASSES + 1
        m = np.zeros(k * k)
        for r in chains.filter("not held_out").select("chain").mapInArrow(tidy(_transitions(k)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
            m[r["pair"]] = r["n"]  # k * k rows at most
        return m.reshape(k, k)


#: Which share of the words' moves is tried, in turn.
MOVED = (1, 2, 4, 8, 0)


def fitted(d: DataFrame) -> tuple[ClassModel, DataFrame, Trained, str]:
    """The model, the chains of all texts, and which column has the classes that hold."""
    scratch = Scratch(d.sparkSession)
    learned = d.filter("not held_out").select("text")
    counts = learned.mapInArrow(tidy(_counted), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = scratch.save(counts, "counts")
    own = Trained(learned, counts, scratch)
    scratch.drop(counts)
    for part in MOVED:  # all moves, if made at once they don't lose; else every second, fourth, eighth; at last none
        column = f"class_{part}"
        moves = F.pmod(F.xxhash64("word"), F.lit(part)) == 0 if part else F.lit(False)
        own.rest = own.rest.withColumn(column, F.when(moves, F.col("class")).otherwise(F.col("first")))
        chains = own.chains(d, column)
        m = own.pairs(chains)
        if not part or objective(m) >= objective(own.m):
            break
        scratch.drop(chains)
    return ClassModel(m, own.stats(column), own.tokens, own.distinct, own.ends), chains, own, column


def score(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity; learns from rows not held out."""
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"))
    model, chains, _, _ = fitted(d)
    kinds = "n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    out = StructType([*d.select("doc_id", "held_out").schema, *StructType.fromDDL(kinds)])
    return chains.drop("row").mapInArrow(tidy(_scored(docs.sparkSession.sparkContext.broadcast(model))), out)
