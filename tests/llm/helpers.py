"""Small tables with the awkward cases, and plain Python versions to compare with."""

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, size long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def documents(spark, rows):
    """rows: (doc_id, text[, lang[, source]]); extra columns clash with names used inside."""
    full = [(r[0], r[1], *(r[2:4] + (None, None))[:2], len(r[1]) if r[1] else None, "own", 5) for r in rows]
    return spark.createDataFrame(full, DOCS)


def prose(seed, n, stem="w"):
    import random

    rng = random.Random(seed)
    return " ".join(f"{stem}{rng.randrange(5000)}" for _ in range(n))
