"""Texts that hold one of many names anywhere: an automaton of Aho and Corasick for each block of names, as tables of numbers.

Names are dealt to blocks of bounded letters, rows to blocks of bounded number, and each block of names meets each block of rows in
one task. The automaton says at every letter which state comes next, and of every state the first, in order, of the names that end there; so a text
costs a step a letter, whatever number of names it holds, and no pair of text and name is ever made. A batch of texts steps together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.blocking import meeting_blocks

#: Letters of names a block: a row of the table of states for each, at most. Rows a block, and letters of their texts, about.
LETTERS, ROWS, TEXT_LETTERS = 200_000, 50_000, 4_000_000
#: Letters of a text that are stepped through as one; longer texts are cut, each piece beginning with the letters that a name could have begun in.
PIECE = 2_000
#: Letters of all texts that step together.
TOGETHER = 4_000_000


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts end to end, and where each one starts (one more than texts)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def padded(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row for each stretch of flat, zeros behind it."""
    out = np.zeros((len(starts), int(sizes.max(initial=0))), flat.dtype)
    inside = np.arange(out.shape[1]) < sizes[:, None]
    whole = int(sizes.sum())
    out[inside] = flat[np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(whole)]
    return out


class Automaton:
    """Of distinct, non-empty names in order. `next[state, letter]` is a state, `first[state]` the place of a name, or how many names there are."""

    def __init__(self, names: list[str]):
        flat, ends = codes(names)
        self.alphabet = np.unique(flat)
        sizes = np.diff(ends)
        letters = padded((np.searchsorted(self.alphabet, flat) + 1).astype(np.int64), ends[:-1], sizes)
        width, self.longest = len(self.alphabet) + 1, int(sizes.max(initial=0))
        at = np.zeros(len(names), np.int64)
        levels, states = [], 1
        for t in range(letters.shape[1]):  # the trie, letter by letter of all names at once
            going = np.flatnonzero(sizes > t)
            key, which = np.unique(at[going] * width + letters[going, t], return_inverse=True)
            at[going] = states + which
            levels.append((key // width, key % width, states + np.arange(len(key))))
            states += len(key)
        self.next = np.zeros((states, width), np.int32)
        self.first = np.full(states, len(names), np.int64)
        np.minimum.at(self.first, at, np.arange(len(names)))
        back = np.zeros(states, np.int64)  # the longest proper ending that is a state too
        if levels:
            self.next[0, levels[0][1]] = levels[0][2]
        for t, (parent, letter, own) in enumerate(levels):
            if t:
                back[own] = self.next[back[parent], letter]
            self.next[own] = self.next[back[own]]
            self.first[own] = np.minimum(self.first[own], self.first[back[own]])
            if t + 1 < len(levels):
                above, by, below = levels[t + 1]
                self.next[above, by] = below

    def first_in(self, texts: list[str]) -> np.ndarray:
        """Of each text the place of the first name that it holds, or how many names there are."""
        none = len(self.first) and int(self.first[0])
        out = np.full(len(texts), none, np.int64)
        flat, ends = codes(texts)
        place = np.minimum(np.searchsorted(self.alphabet, flat), max(0, len(self.alphabet) - 1))
        letters = np.where(self.alphabet[place] == flat, place + 1, 0).astype(np.int64) if len(self.alphabet) else np.zeros(len(flat), np.int64)
        sizes = np.diff(ends)
        step = PIECE + self.longest
        pieces = np.maximum(1, -(-np.maximum(sizes - self.longest, 0) // PIECE))
        whose = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(len(whose)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = ends[whose] + nth * PIECE
        lengths = np.minimum(step, ends[whose + 1] - starts)
        order = np.argsort(lengths, kind="stable")
        i = 0
        while i < len(order):
            n = max(1, min(len(order) - i, TOGETHER // max(1, int(lengths[order[min(len(order), i + TOGETHER // step + 1) - 1]]))))
            rows = order[i : i + n]
            x = padded(letters, starts[rows], lengths[rows])
            state, best = np.zeros(len(rows), np.int64), np.full(len(rows), none, np.int64)
            for t in range(x.shape[1]):
                state = self.next[state, x[:, t]]
                best = np.minimum(best, self.first[state])  # letters behind a text's end lead to the start, which ends no name
            np.minimum.at(out, whose[rows], best)
            i += n
        return out


def _meeting(left: pa.Table, right: pa.Table) -> pa.Table:
    names = sorted(n for n in set(right.column("name").to_pylist()) if n)
    found = Automaton(names).first_in(left.column("text").to_pylist()) if names and left.num_rows else np.zeros(left.num_rows, np.int64)
    hit = np.flatnonzero(found < len(names))
    return pa.table([left.column("row_id").take(pa.array(hit)), pa.array([names[i] for i in found[hit]], pa.string())], names=["row_id", "name"])


def first_contained(rows: DataFrame, names: DataFrame, letters: int = LETTERS, most_rows: int = ROWS) -> DataFrame:
    """row_id, name: of each row (row_id, text) that holds a name (name) anywhere in its text, the first of those names, by code points.

    Null and empty texts hold nothing, null and empty names are no names. Rows that share an id are one: the first name of any of them. Without rows
    or names the result is empty.
    """
    r = rows.select("row_id", "text").filter("length(text) > 0")
    n = names.select("name").filter("length(name) > 0").distinct()
    total = n.agg(F.sum(F.length("name"))).first()[0] or 0
    size = r.agg(F.count("*").alias("rows"), F.sum(F.length("text").cast("long")).alias("letters")).first()
    blocks = max(-(-size["rows"] // most_rows), -(-(size["letters"] or 0) // TEXT_LETTERS))
    met = meeting_blocks(r, [F.xxhash64("row_id", "text")], blocks, n, [F.xxhash64("name")], -(-total // letters))
    kind = dict(r.dtypes)["row_id"]
    return met.applyInArrow(_meeting, f"row_id {kind}, name string").groupBy("row_id").agg(F.min("name").alias("name"))
