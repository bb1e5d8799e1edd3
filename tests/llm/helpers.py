"""Small tables of documents, with every odd case, and the words of the contracts."""

from __future__ import annotations

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    """rows: (doc_id, text) or with lang and source."""
    full = [(r[0], r[1], *(r[2:] or ("en", "s1")), len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


def words(text):
    return SPACED.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def odd_rows():
    """Null and empty texts, blanks only, a null id, ties, repeated rows, and one very long text."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    return [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one"), (5, "one"), (None, "no id here"), (6, long), (7, "x" * 100_000), (8, "é ü ß z")]


def random_rows(seed, n=60, vocabulary=40, copies=True):
    r = random.Random(seed)
    some = [f"w{i}" for i in range(vocabulary)]
    rows = []
    for i in range(n):
        if copies and rows and r.random() < 0.4:
            own = words(r.choice(rows)[1]) or ["a"]
            a = r.randrange(len(own))
            part = own[a : a + r.randrange(1, 60)]
            mine = [r.choice(some) for _ in range(r.randrange(0, 20))]
            text = " ".join(mine + part + mine[:3]) if r.random() < 0.8 else " ".join(own)
        else:
            text = r.choice([" ", "  ", "\n"]).join(r.choice(some) for _ in range(r.randrange(0, 80)))
        rows.append((i, text))
    return rows
