"""Small documents with the awkward cases: nulls, empties, ties, repeats, long texts, odd white space, clashing columns."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint, line string"


def documents(n=120, seed=3):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeéßñ") for _ in range(rnd.randrange(1, 9))) for _ in range(60)]
    common = ["  This line is shared by very many documents \t", "short one", "THIS LINE IS SHARED BY VERY MANY DOCUMENTS", "another shared line, Übergröße läuft"]
    rows = []
    for i in range(n):
        lines = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 25))) for _ in range(rnd.randrange(0, 7))]
        for line in common:
            if rnd.random() < 0.3:
                lines.insert(rnd.randrange(len(lines) + 1), line)
        rows.append((i, "\n".join(lines)))
    rows += [(n, None), (n + 1, ""), (n + 2, "\n\n"), (n + 3, "  a\x0b\x1cb\x85c　d\n \t"), (n + 4, "x" * 5000), (n + 5, ("wort " * 3000) + "\n" + "wort " * 20)]
    rows += [rows[5], rows[5], (None, rows[7][1]), (None, common[0]), (n + 6, rows[9][1]), (n + 7, rows[9][1] + "\n" + common[3]), (n + 8, "\U0001f600 emoji \U0001f600\n" * 12)]
    return [(d, x, rnd.choice(["en", "de", None]), rnd.choice(["s0", "s0", "s1", None]), len(x or ""), 7, "clash") for d, x in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)
