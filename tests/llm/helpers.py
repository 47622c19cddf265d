"""Fixtures of the training-data operators: awkward tables and plain models."""

import random
import re

DOCS = "doc_id long, text string, __id string, keep_id int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    """Documents with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, "x", 7) for i, t in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def prose(n, seed=0):
    rng = random.Random(seed)
    syllables = "ka ro mi ten sul vor ae lin dus pe".split()
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def awkward(seed=1):
    """Nulls, empties, white space, copies, near copies, ties, a long text."""
    rng = random.Random(seed)
    base = prose(120, 5)
    rows = [(10, None), (11, ""), (12, " \n\t "), (13, "One"), (14, "one  two"), (15, base), (16, base), (3, base.replace(" ", "\n", 3))]
    for i in range(20, 32):
        own = base.split()
        for _ in range(rng.randint(0, 8)):
            own[rng.randrange(len(own))] = f"edit{rng.randrange(99)}"
        rows.append((i, " ".join(own)))
    rows += [(40 + i, prose(80, 100 + i)) for i in range(6)]
    rows += [(50, prose(60, 9) + " " + " ".join(base.split()[20:90]) + " " + prose(50, 8)), (51, prose(4000, 77)), (52, "ab" * 400), (53, "Ünï çødé " * 40)]
    return rows
