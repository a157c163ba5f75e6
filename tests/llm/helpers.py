"""Small corpora and brute-force versions shared by the tests."""

import random
import re

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __h long, kept string, key string, row_id long, size string, w string"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def docs(spark, rows):
    """A table of documents from (doc_id, text[, source[, lang]]), with extra columns whose names clash with inner ones."""
    full = [(r[0], r[1], r[3] if len(r) > 3 else None, r[2] if len(r) > 2 else None, None, 7, "x", "y", 3, "z", "q") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=1, n=60):
    """Rows with nulls, empty and very long texts, ties, repeated rows, copies, near copies and shared passages."""
    rng = random.Random(seed)
    passage = words(rng, 70)
    base = [words(rng, rng.randrange(20, 160)) for _ in range(n // 4)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base)) if rng.random() < 0.6 else words(rng, rng.randrange(1, 120))
        if rng.random() < 0.5:
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        if rng.random() < 0.3:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage[rng.randrange(10) :]
        text = rng.choice([" ", "\n", "  "]).join(w)
        rows.append((i * 3, rng.choice([text, text, text.upper()])))
    rows += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "Été É é"), (1004, " ".join(words(rng, 30_000)))]
    rows += [rows[3], rows[5], (1001, "")]
    return rows
