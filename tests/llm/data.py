"""Small awkward tables for the tests of the corpus operators."""

import random

from pyspark.sql import DataFrame, SparkSession

# Columns that clash with names the operators use inside.
CLASHING = "norm string, hash string, block long, key string, size long, ids string, gone string, doc string, text2 string"


def documents(spark: SparkSession, texts: list[tuple], extra: bool = True) -> DataFrame:
    """``texts`` as ``(doc_id, text, source)`` with columns named like inner ones."""
    rows = [(i, t, "en", s, None if t is None else len(t)) + (("x", None, 1, "k", 2, "y", None, "d", "z") if extra else ()) for i, t, s in texts]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(rows, schema + (", " + CLASHING if extra else "")).repartition(3)


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 6))) for _ in range(words))


def awkward() -> list[tuple]:
    """NULL ids, texts and sources, blanks, copies, near copies, long and repeated rows."""
    base, other = prose(1, 120), prose(2, 80)
    words = base.split(" ")
    near = " ".join([*words[:60], "changed", *words[61:]])
    far = " ".join(words[:50] + other.split(" ")[:70])
    long = "\n".join(prose(100 + i, 40) for i in range(60))
    lines = "A shared line of text\n" + prose(3, 20) + "\n  a SHARED line of text \nshort\n"
    more = prose(4, 20) + "\nshort\na shared line of text\n" + prose(3, 20)
    return [
        (5, base, "a"), (3, base.replace(" ", " \t "), "a"), (9, near, "b"), (12, far, None), (20, other, "b"), (21, None, "a"), (22, "", "b"),
        (23, " \n\t ", None), (24, "one two three", "c"), (25, "One\ttwo  THREE", "c"), (26, "one two", "c"), (30, long, "a"), (31, long, "b"),
        (40, lines, "a"), (41, more, "a"), (42, lines + "tail", None), (None, base, "b"), (None, lines, "b"), (50, other, "b"), (50, other, "b"),
        (51, "é" * 150 + base, "a"), (52, "é" * 150, "a"), (53, "x" * 400, "c"), (54, "a b c d e f", "c"), (55, "<|endoftext|>ok 's  　\x85 x", "c"),
    ]
