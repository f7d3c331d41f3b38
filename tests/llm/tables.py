"""Tables of hard cases."""

import random

from pyspark.sql import functions as F

WORDS = "amber basil cedar delta ember fable grove haven inlet jolly karma lemon mango north olive pearl quill river stone tulip umber vivid willow xenon yacht zebra".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, rep string, _row string, `key` string, place string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(300)) for _ in range(n))


def documents(spark, texts):
    """texts: (doc_id, text); with columns whose names operators might use."""
    rows = [(d, t, "en", "s", len(t) if t is not None else None, "a", "b", "c", "d", "e") for d, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


PASSAGE = prose("passage", 70)
HARD = [
    (1, prose(1, 120)),
    (2, prose(1, 120)),  # a copy
    (2, prose(1, 120)),  # a repeated row
    (3, prose(1, 117) + " other words here"),  # nearly a copy
    (4, None),
    (5, ""),
    (6, "   \n\t "),
    (7, "!!! ???"),
    (8, "word"),
    (None, prose(9, 80)),
    (None, None),
    (10, prose(10, 60) + " " + PASSAGE + " " + prose(11, 60)),
    (11, prose(12, 40) + " " + PASSAGE + "\n" + prose(13, 90)),
    (12, "x" * 30_000),
    (13, "again and " * 4000),
    (14, prose(14, 20_000)),
    (15, "naïve façade 日本語 😀 \U0001f600 it's they'll we've  \n\n x"),
    (16, prose(16, 200)),
]


def hard(spark):
    return documents(spark, HARD)


def empty(spark):
    return documents(spark, []).where(F.lit(False))
