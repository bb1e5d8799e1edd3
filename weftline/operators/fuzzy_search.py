"""The most alike names of all: nothing that a scan of every name would find is lost.

Both sides are cut into blocks of bounded size, and each block of asked names meets each block of the catalogue in a task. There an inverted index
of the block answers: bigrams of padded words, the k-th occurrence of one apart from the others, and whole words. What an asked name shares with
each name bounds every scorer from above, and only names whose bound reaches what is still needed are scored.

The bounds. Let x and y be two texts of n and m letters, N = n + m, and L their longest common subsequence. Each of the N - 2L letters left
out parts at most two neighbours of the L, so x and y share at least L - 1 - (N - 2L) bigrams; with U2 shared ones, L <= (U2 + N + 1) / 3.
And L is at most U1, the letters they share. Words in any order joined by spaces hold no bigrams but those of their padded words.

- token_sort: 200 L / N.
- token_set: words shared, B letters of them, against either whole, 200 B / (B + its length), exactly; the shared words and both
  remainders as token_sort.
- partial_token_sort: a stretch of w letters of the longer against n, the shorter: L <= w and L <= (U2 + n + w + 1) / 3, which is best at
  w = (U2 + n + 1) / 2; so with L = min(U1, n, (U2 + n + 1) / 2) the score is at most 200 L / (n + L).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.similarity import batch_scores
from weftline.operators.blocking import block_tasks, meeting_blocks, task_count

#: Names a block, of those asked for and of the catalogue.
ASKED, NAMES = 2_000, 20_000
#: Names with the best bounds that are scored first; what they reach, others must reach too.
FIRST = 32
#: Asked names that are scored together.
TOGETHER = 64
_LETTERS = 64
_SLACK = 1e-6


def _grams(words: list[str]) -> list[tuple[str, int]]:
    """Bigrams of the padded words, each with how often it came before."""
    seen: Counter = Counter()
    out = []
    for w in words:
        p = f" {w} "
        for i in range(len(p) - 1):
            g = p[i : i + 2]
            out.append((g, seen[g]))
            seen[g] += 1
    return out


def _letter_counts(texts: list[str]) -> np.ndarray:
    """How often each letter stands in each text; letters that share one of 64 places count as one, which only raises what is shared."""
    out = np.zeros((len(texts), _LETTERS), np.int16)
    for i, t in enumerate(texts):
        if t:
            codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) % _LETTERS
            out[i] = np.bincount(codes, minlength=_LETTERS)
    return out


class _Postings:
    """Of each key the rows that have it, end to end."""

    def __init__(self, keys: list[list]):
        number: dict = {}
        flat = np.array([number.setdefault(k, len(number)) for own in keys for k in own], np.int64)
        rows = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        order = np.argsort(flat, kind="stable")
        self.number, self.rows = number, rows[order]
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=len(number)))])

    def of(self, keys) -> list[np.ndarray]:
        at = [self.number[k] for k in keys if k in self.number]
        return [self.rows[self.ends[i] : self.ends[i + 1]] for i in at]


class Block:
    """A block of names, indexed."""

    def __init__(self, names: list[str]):
        self.words = [t.split() for t in names]
        self.sorted = [" ".join(sorted(w)) for w in self.words]
        self.size = np.array([len(t) for t in self.sorted], np.int64)
        sets = [sorted(set(w)) for w in self.words]
        self.set_size = np.array([len(" ".join(s)) for s in sets], np.int64)
        self.grams, self.sets = _Postings([_grams(w) for w in self.words]), _Postings(sets)
        self.letters = _letter_counts(self.sorted)

    def bounds(self, name: str, kinds: list[str]) -> np.ndarray:
        """kinds x names: what each scorer can't exceed between name and each name of the block."""
        words = name.split()
        x, own, rows = " ".join(sorted(words)), sorted(set(words)), len(self.sorted)
        count = lambda parts, weights=None: np.bincount(np.concatenate(parts), weights, rows) if parts else np.zeros(rows)
        u2 = count(self.grams.of(_grams(words)))
        u1 = np.minimum(_letter_counts([x]), self.letters).sum(axis=1)
        n, short = len(x) + self.size, np.minimum(len(x), self.size)
        out = np.zeros((len(kinds), rows))
        for k, kind in enumerate(kinds):
            if kind == "token_sort":
                out[k] = 200 * np.minimum(np.minimum(u1, short), (u2 + n + 1) / 3) / np.maximum(n, 1)
                out[k][n == 0] = 100
            elif kind == "token_set":
                met = [w for w in own if w in self.sets.number]
                parts = self.sets.of(met)
                letters = count(parts, np.repeat([len(w) for w in met], [len(p) for p in parts])) if parts else np.zeros(rows)
                shared = count(parts)
                b = letters + np.maximum(shared - 1, 0)
                size = len(" ".join(own))
                both = size + self.set_size
                rest = 200 * np.minimum(u1, (u2 + both + 1) / 3) / np.maximum(both, 1)
                part = np.where(b > 0, 200 * b / np.maximum(b + np.minimum(size, self.set_size), 1), 0)
                out[k] = np.where((self.set_size > 0) & (size > 0), np.maximum(rest, part), 0)
            elif kind == "partial_token_sort":
                best = np.minimum(np.minimum(u1, short), (u2 + short + 1) / 2)
                out[k] = 200 * best / np.maximum(short + best, 1)
                out[k][n == 0] = 100
            else:
                raise ValueError(f"no bound for {kind}")
        return np.minimum(out, 100)


def block_tops(asked: list[str], names: list[str], ids: np.ndarray, kinds: list[str], most: int, least: float) -> Iterator[tuple[int, int, int, float]]:
    """(place in asked, place in kinds, place in names, score): of each asked name and scorer the `most` best, `least` or more; ties by id."""
    block = Block(names)
    for i in range(0, len(asked), TOGETHER):
        part = asked[i : i + TOGETHER]
        bounds = [block.bounds(t, kinds) for t in part]
        scored: list[list[tuple[np.ndarray, np.ndarray]]] = [[(np.zeros(0, np.int64), np.zeros(0))] * len(kinds) for _ in part]
        floor = np.full((len(part), len(kinds)), least - _SLACK)
        done = [np.zeros((len(kinds), len(names)), bool) for _ in part]
        for first in (True, False):
            for k, kind in enumerate(kinds):
                wanted = []
                for q, b in enumerate(bounds):
                    rows = np.flatnonzero((b[k] >= floor[q, k]) & ~done[q][k])
                    if first and len(rows) > max(FIRST, most):
                        rows = rows[np.argpartition(-b[k][rows], max(FIRST, most) - 1)[: max(FIRST, most)]]
                    done[q][k][rows] = True
                    wanted.append(rows)
                flat = np.concatenate(wanted)
                got = batch_scores([kind], [part[q] for q, rows in enumerate(wanted) for _ in rows], [names[r] for r in flat])[kind]
                for q, (rows, s) in enumerate(zip(wanted, np.split(got, np.cumsum([len(r) for r in wanted])[:-1]), strict=True)):
                    rows, s = np.concatenate([scored[q][k][0], rows]), np.concatenate([scored[q][k][1], s])
                    keep = np.flatnonzero(s >= least)
                    keep = keep[np.lexsort([ids[rows[keep]], -np.round(s[keep], 6)])][:most]
                    scored[q][k] = rows[keep], s[keep]
                    if len(keep) == most:
                        floor[q, k] = max(floor[q, k], s[keep[-1]] - _SLACK)
        for q, own in enumerate(scored):
            for k, (rows, s) in enumerate(own):
                for r, v in zip(rows.tolist(), s.tolist(), strict=True):
                    yield i + q, k, r, v


def _meeting(kinds: list[str], most: int, least: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        asked, names, ids = left.column("a").to_pylist(), right.column("b").to_pylist(), right.column("row_id").to_numpy()
        found = list(block_tops(asked, names, ids, kinds, most, least)) if asked and names else []
        q, k, r, s = (np.array([f[i] for f in found], np.float64 if i == 3 else np.int64) for i in range(4))
        own, theirs = left.take(pa.array(q)), right.take(pa.array(r))
        columns = [own.column("d_name"), theirs.column("m_name"), theirs.column("row_id"), theirs.column("m_price"), pa.array([kinds[i] for i in k], pa.string()), pa.array(k.astype(np.int32)), pa.array(s)]
        return pa.table(columns, names=["d_name", "m_name", "row_id", "m_price", "scorer", "ord", "base"])

    return run


def _schema(asked: DataFrame, names: DataFrame) -> str:
    kind = {f.name: f.dataType.simpleString() for f in [*asked.schema, *names.schema]}
    return f"d_name {kind['d_name']}, m_name {kind['m_name']}, row_id long, m_price {kind['m_price']}, scorer string, ord int, base double"


def _ranked(met: DataFrame, most: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("d_name", "scorer").orderBy(F.desc(F.round("base", 6)), "row_id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= most)


def most_alike(asked: DataFrame, names: DataFrame, kinds: list[str], most: int, least: float, asked_block: int = ASKED, names_block: int = NAMES) -> DataFrame:
    """d_name, m_name, row_id, m_price, scorer, ord, base, rank: of each asked name and scorer the most alike of all names, ties by row_id.

    asked: d_name, a (the text to compare), a row for each name. names: m_name, b, row_id (long), m_price. kinds: of token_set, token_sort and
    partial_token_sort. Each name counts once, so rows that repeat one must be grouped before. Null texts are nothing's match; empty ones
    are alike to one another as the scorers have it. Without names or asked names there are no rows.

    A task holds a block of each side, and gives at most `most` names for each asked one; every asked name goes to every block of names once.
    """
    q, c = asked.filter("a is not null"), names.filter("b is not null")
    count, n_c = q.count(), -(-c.count() // names_block)
    cores = asked.sparkSession.sparkContext.defaultParallelism
    n_q = max(-(-count // asked_block), min(count // TOGETHER, 2 * cores // max(1, n_c)))  # few names in few blocks still keep all cores busy
    q, c = q.select("d_name", "a"), c.select("m_name", "b", F.col("row_id").cast("long").alias("row_id"), "m_price")
    return _ranked(meeting_blocks(q, [F.col("d_name")], n_q, c, [F.col("m_name")], n_c).applyInArrow(_meeting(kinds, most, least), _schema(q, c)), most)


#: Asked names a block where a key brings names together.
ASKED_OF_KEY = 250


def most_alike_of_key(asked: DataFrame, names: DataFrame, kinds: list[str], most: int, least: float, asked_block: int = ASKED_OF_KEY, names_block: int = NAMES) -> DataFrame:
    """As `most_alike`, of the names that have the asked name's key: bounds leave most pairs unscored, whatever the commonest key.

    asked: d_name, a, key; names: m_name, b, key, row_id (long), m_price; a row for each name, so each has one key at most. How many names have
    each key is counted first, and a key with many is cut into blocks of both sides. Null texts and keys are nothing's match.
    """
    q, c = asked.filter("a is not null"), names.filter("b is not null")
    n = q.groupBy("key").agg(F.count("*").alias("_n")).join(c.groupBy("key").agg(F.count("*").alias("_m")), "key")
    blocks = lambda x, size: F.ceil(F.col(x) / size).cast("int")
    n = n.select("key", "_n", "_m", blocks("_n", asked_block).alias("_nb"), blocks("_m", names_block).alias("_mb"))
    met, pairs = n.agg(F.coalesce(F.sum(F.col("_nb") * F.col("_mb")), F.lit(0)), F.coalesce(F.sum(F.col("_n") * F.col("_m")), F.lit(0))).first()
    few = max(task_count(asked.sparkSession), -(-pairs // MOST_PAIRS))  # many keys of few names need no task each
    tasks = block_tasks(asked.sparkSession, max(1, min(met, few)))
    of = lambda x, k: F.pmod(F.xxhash64(x), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    at = ("key", "_lb", "_rb")
    x = q.join(n, "key").select("d_name", "a", "key", of("d_name", "_nb").alias("_lb"), every("_mb").alias("_rb")).repartition(tasks, *at)
    y = c.join(n, "key").select("m_name", "b", F.col("row_id").cast("long").alias("row_id"), "m_price", "key", of("m_name", "_mb").alias("_rb"), every("_nb").alias("_lb")).repartition(tasks, *at)
    return _ranked(x.groupBy(*at).cogroup(y.groupBy(*at)).applyInArrow(_meeting(kinds, most, least), _schema(x, y)), most)


#: Pairs of names that one key may bring together in a join; names of a key with more meet in blocks, where bounds go first.
MOST_PAIRS = 2_000_000


def _may_reach(kinds: list[str], least: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        asked, names = left.column("a").to_pylist(), right.column("b").to_pylist()
        block = Block(names) if asked else None
        rows = [np.flatnonzero(block.bounds(t, kinds).max(axis=0) >= least - _SLACK) for t in asked]
        own, theirs = np.repeat(np.arange(len(asked)), [len(r) for r in rows]), np.concatenate([np.zeros(0, np.int64), *rows])
        return pa.table([left.column("d_name").take(pa.array(own)), right.column("m_name").take(pa.array(theirs))], names=["d_name", "m_name"])

    return run


def likely_pairs(asked: DataFrame, names: DataFrame, kinds: list[str], least: float, most: int = MOST_PAIRS, asked_block: int = ASKED, names_block: int = NAMES) -> DataFrame:
    """d_name, m_name, each pair once: those that share a key, without any, of keys that pair more than `most`, that can't reach `least` by any scorer of kinds.

    asked: d_name, a, key; names: m_name, b, key, a row for each key of a name. How many names have each key is counted first. Where they make `most`
    pairs or fewer a join pairs them; else they are dealt to blocks of bounded size, and a task compares what two blocks share before
    it makes a pair. So no task holds more than two blocks, whatever the commonest key, and no pair that reaches `least` is lost.
    """
    n = asked.groupBy("key").agg(F.count("*").alias("_n")).join(names.groupBy("key").agg(F.count("*").alias("_m")), "key")
    hot = n.filter(F.col("_n") * F.col("_m") > most)
    blocks = lambda c, size: F.ceil(F.col(c) / size).cast("int")
    of = lambda c, k: F.pmod(F.xxhash64(c), k).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), k - 1))
    hot = hot.select("key", blocks("_n", asked_block).alias("_nb"), blocks("_m", names_block).alias("_mb"))
    x = asked.join(hot, "key").select("d_name", "a", "key", of("d_name", F.col("_nb")).alias("_lb"), every(F.col("_mb")).alias("_rb"))
    y = names.join(hot, "key").select("m_name", "b", "key", of("m_name", F.col("_mb")).alias("_rb"), every(F.col("_nb")).alias("_lb"))
    kind = {f.name: f.dataType.simpleString() for f in [*asked.schema, *names.schema]}
    at = ("key", "_lb", "_rb")
    x, y = (d.repartition(task_count(asked.sparkSession), *at) for d in (x, y))
    met = x.groupBy(*at).cogroup(y.groupBy(*at)).applyInArrow(_may_reach(kinds, least), f"d_name {kind['d_name']}, m_name {kind['m_name']}")
    rest = asked.join(hot.select("key"), "key", "left_anti").join(names, "key").select("d_name", "m_name")
    return met.unionByName(rest).distinct()
