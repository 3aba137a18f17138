"""Small made-up texts."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, template string"
#: Two languages of their own letters each.
SYLLABLES = {"xa": ["ka", "lo", "mi", "tu", "re"], "ya": ["öb", "üv", "ßi", "äz", "ñe"]}


def words(seed, n, lang="xa"):
    r = random.Random(seed)
    return ["".join(r.choices(SYLLABLES[lang], k=r.randint(1, 5))) for _ in range(n)]


def text(seed, n, lang="xa"):
    return " ".join(words(seed, n, lang))


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang); clashing extra columns come along."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "xa", "src", None if r[1] is None else len(r[1]), 5, "t") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def edge_rows():
    """Null, empty and blank texts, null ids, repeated rows, a very long text."""
    return [(1, None), (2, ""), (3, " \n\t "), (None, text(9, 30)), (4, text(4, 80)), (4, text(4, 80)), (5, text(5, 30_000)), (6, "###!!! 123"), (7, text(7, 60, "ya"), None), (8, "one"), (9, "I\u0085am one word, \x1ctoo")]
