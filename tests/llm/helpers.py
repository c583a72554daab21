"""Small documents and plain restatements that the operators are held against."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _kept string, node string, spans string"
SYLLABLES = {"en": "the and ing ent ion her for tha nth int ere tio ter est ers".split(), "de": "sch ein ich der und die che gen ung cht hen ück ßen äch".split()}


def prose(rng, lang="en", words=80):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(words))


def frame(spark, rows):
    """Documents from (id, text) or (id, text, lang), with columns whose names clash with internal ones."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", None if r[1] is None else len(r[1]), "x", "y", None) for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(4)


def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows, a null id and a long word."""
    return [(None, "a text under a null id, long enough to count as one here"), (1, None), (2, ""), (3, " \n\t "), (4, "!!! 123 ..."), (5, "word " * 30), (5, "word " * 30),
            (6, "x" * 5000), (7, "é" * 120), (8, "a\u0000b   c")]


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def shingles(text):
    w = WORDS.findall((text or "").lower())
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def rng(seed=1):
    return random.Random(seed)
