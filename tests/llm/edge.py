"""Small tables that every operator must get through, and plain versions of helpers."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")

_PASSAGE = " ".join(f"w{i}" for i in range(60))
_LONG = " ".join(f"x{i * i % 977}y{i}" for i in range(9_000))


def rows():
    """(doc_id, text): nulls, blanks, copies, near copies, repeats, long texts, ties."""
    return [
        (1, None),
        (2, ""),
        (3, " \t\n\x0b\x0c\r"),
        (4, "one"),
        (5, "One two three four five six seven"),
        (6, "one TWO three four five six seven"),
        (7, "one two three four five six seven\n"),
        (8, _PASSAGE),
        (9, _PASSAGE + " tail words here"),
        (10, "lead " + _PASSAGE),
        (10, "lead " + _PASSAGE),
        (None, _PASSAGE),
        (11, _LONG),
        (12, _LONG + " end"),
        (13, "é😀é " * 40 + "ß ñandú <|endoftext|> x<|endoftext|>"),
        (14, "a" * 3_000),
        (15, "a" * 3_000 + "b"),
        (16, "　wide　space nbsp   line \x85 next"),
        (17, "you'll  don't   it's\n\n\n 12345 !!! ...\t\t end  "),
        (18, "ab" * 200),
        (19, " ".join(["same"] * 200)),
        (20, "one two three four five six seven"),
        (21, " ".join(f"w{i}" for i in range(30)) + " changed " + " ".join(f"w{i}" for i in range(31, 60))),
        (-5, _PASSAGE[:300]),
    ]


def frame(spark, data, extra: bool = True):
    """The table; with more columns, some named as an operator might name its own."""
    if not extra:
        return spark.createDataFrame(data, "doc_id long, text string")
    wide = [(i, t, "en", "s", 1, 2, "x", "y") for i, t in data]
    return spark.createDataFrame(
        wide, "doc_id long, text string, lang string, source string, row int, slice int, digest string, size string"
    )


def words(text):
    return WORD.findall(text or "")


def got(df, *names):
    return sorted((tuple(row[n] for n in names) for row in df.collect()), key=repr)
