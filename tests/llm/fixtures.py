"""Small tables with nulls, empty texts, repeated rows, ties and columns whose names clash with the operators' own."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, line string, pos int, h int, block int, take int, size int, first int, n_dropped string, text_hash int, score string, component int, u int"


def docs(spark, rows):
    """rows of (doc_id, text, source)."""
    full = [(d, t, None, s, None, "r", "l", 1, 2, 3, 4, 5, 6, "n", 7, "s", 8, 9) for d, t, s in rows]
    return spark.createDataFrame(full, DOCS)


WORDS = [a + b for a in ("ba", "do", "ki", "lu", "me", "né", "ßo", "ru") for b in ("n", "st", "ra", "lo", "xy", "qu", "mi", "ze")]


def prose(rng, n):
    out = []
    while len(out) < n:
        out.append(rng.choice(WORDS))
    return " ".join(out)


def corpus(seed=1, n=60):
    """Prose, exact copies, near copies, shared lines, short and empty texts, null ids and sources, repeated rows."""
    rng = random.Random(seed)
    shared = [prose(rng, 12) for _ in range(3)]
    rows = []
    for i in range(n):
        lines = [prose(rng, rng.randint(3, 40)) for _ in range(rng.randint(1, 5))]
        if i % 3 == 0:
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(["  ", "", "\t"]) + rng.choice(shared).upper().replace("SS", "ß") + " ")
        rows.append((i, "\n".join(lines), rng.choice(["a", "b", "B", None])))
    for i in range(n, n + 12):
        base = rows[rng.randrange(8)][1].split(" ")
        if i % 2:
            base[rng.randrange(len(base))] = "changed"
        rows.append((i, " ".join(base), "a"))
    rows += [(n + 20, None, "a"), (n + 21, "", "a"), (n + 22, " \n\t ", None), (n + 23, "one two", "b"), (n + 24, "one two", "b"), (None, prose(rng, 30), "a"), (None, None, None), rows[3], rows[3], (5, prose(rng, 50), "b")]
    return rows
