"""Chat formatting by a grammar round trip, in DataFrame functions only.

A turn is written between marks of its role, and turns follow one another without gap:

    system      <<SYS>>\\n TEXT \\n<</SYS>>\\n
    user        [INST]␣ TEXT ␣[/INST]
    assistant   <s> TEXT </s>
    other       [ROLE] ROLE [:] TEXT [/ROLE]

No text may hold a control string (a mark without its blanks), so a turn begins with a
mark that tells its kind and ends at the first closing mark: the grammar is read by one
regular expression without a choice to take back.

*Round trip.* Rendered text is parsed again and the recovered turns are compared with the
source. Where they differ, or a text shows a bare control string, the conflicting content
is escaped and the text rendered again; that the second attempt is identical is asserted.
An escape puts one backslash behind the first character of a control string. Texts that
hold such a string with backslashes already get one more, so taking one away from each is
the inverse whatever a text holds.

*Loss mask.* Spans of the formatted text, in code points, that hold assistant texts.

*Scale.* A conversation is written in blocks of ``BLOCK`` turn numbers, so a hot one is
spread over tasks; its text is the concatenation of its blocks. Formatting shuffles once.
``digests`` hashes whole conversations, for which their texts must meet in one row: that
is a property of SHA-256, not of the format.

Defined results: a null text or role counts as empty, null turns come first and make a
block of their own, turns of one number are in order of role and text, repeated rows are
turns of their own, a null conv_id is a conversation, an empty table gives an empty
result, other columns are left out. Texts are never cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewitness.llm.shared import table

#: A block has so many turn numbers, a power of two.
BLOCK = 1 << 8

MARKS = {
    "system": ("<<SYS>>\n", "\n<</SYS>>\n"),
    "user": ("[INST] ", " [/INST]"),
    "assistant": ("<s>", "</s>"),
}
OTHER = ("[ROLE]", "[:]", "[/ROLE]")

_BODY = r"(/?INST\]|/?ROLE\]|:\]|/?s>|<SYS>>|</SYS>>)"
#: A control string that may have backslashes behind its first character.
_ANY = r"([\[<])(\\*)" + _BODY
_BARE = r"[\[<]" + _BODY
_ESCAPED = r"([\[<])\\(\\*)" + _BODY
_TURN = (
    r"(?s)<<SYS>>\n.*?\n<</SYS>>\n|\[INST\] .*? \[/INST\]|<s>.*?</s>"
    r"|\[ROLE\].*?\[:\].*?\[/ROLE\]"
)


def escaped(text):
    return F.regexp_replace(text, F.lit(_ANY), F.lit(r"$1\\$2$3"))


def unescaped(text):
    return F.regexp_replace(text, F.lit(_ESCAPED), F.lit("$1$2$3"))


def _rendered(turns, guard):
    """The text of an array of (role, text); ``guard`` is laid on each role and text."""

    def one(turn):
        text = guard(turn["text"])
        out = F.concat(F.lit(OTHER[0]), guard(turn["role"]), F.lit(OTHER[1]), text, F.lit(OTHER[2]))
        for role, (begin, end) in MARKS.items():
            out = F.when(turn["role"] == role, F.concat(F.lit(begin), text, F.lit(end))).otherwise(out)
        return out

    return F.array_join(F.transform(turns, one), "")


def _pieces(formatted):
    return F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0))


def _inside(piece, begin: str, end: str):
    return F.substring(piece, F.lit(len(begin) + 1), F.length(piece) - F.lit(len(begin) + len(end)))


def _read(piece):
    """Role and text of one turn as they stand between the marks."""
    inner = _inside(piece, OTHER[0], OTHER[2])
    name = F.substring_index(inner, OTHER[1], 1)
    role, text = name, F.substring(inner, F.length(name) + len(OTHER[1]) + 1, F.length(inner))
    for known, (begin, end) in MARKS.items():
        here = F.startswith(piece, F.lit(begin))
        role = F.when(here, known).otherwise(role)
        text = F.when(here, _inside(piece, begin, end)).otherwise(text)
    return role, text


def parsed(formatted):
    """The turns, an array of (role, text), that a formatted text holds."""

    def one(piece):
        role, text = _read(piece)
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(_pieces(formatted), one)


def _identical(formatted, turns):
    """Does the text parse, without a gap and without bare control strings, to the turns?"""

    def clean(piece):
        role, text = _read(piece)
        return ~F.rlike(role, F.lit(_BARE)) & ~F.rlike(text, F.lit(_BARE))

    pieces = _pieces(formatted)
    return (
        (F.array_join(pieces, "") == formatted)
        & F.forall(pieces, clean)
        & (parsed(formatted) == turns)
    )


def _loss_spans(formatted):
    """(start, stop) of the assistant texts, stop excluded, in code points from 0."""
    begin, end = MARKS["assistant"]

    def step(state, piece):
        at, after = state["at"], state["at"] + F.length(piece)
        span = F.struct((at + len(begin)).alias("start"), (after - len(end)).alias("stop"))
        here = F.when(F.startswith(piece, F.lit(begin)), F.array(span)).otherwise(none)
        return F.struct(after.alias("at"), F.concat(state["spans"], here).alias("spans"))

    none = F.expr("CAST(array() AS array<struct<start: int, stop: int>>)")
    first = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    return F.aggregate(_pieces(formatted), first, step)["spans"]


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, block, formatted and loss_spans of (conv_id, turn, role, text).

    The blocks of a conversation, in order, follow one another.
    """
    number = F.col("turn").cast("long")
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.shiftright(number, BLOCK.bit_length() - 1).alias("block"),
        number.alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    blocks = rows.groupBy("conv_id", "block").agg(ordered.alias("turns"))
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    rendered = (
        blocks.select("conv_id", "block", source.alias("turns"))
        .withColumn("plain", _rendered(F.col("turns"), lambda text: text))
        .withColumn("clean", _identical(F.col("plain"), F.col("turns")))
        .withColumn(
            "formatted",
            F.when(F.col("clean"), F.col("plain")).otherwise(_rendered(F.col("turns"), escaped)),
        )
    )
    same = F.col("clean") | _identical(F.col("formatted"), F.col("turns"))
    failed = F.raise_error(F.lit("a formatted conversation does not read back as its turns")).cast("string")
    return rendered.select(
        "conv_id", "block", F.when(same, F.col("formatted")).otherwise(failed).alias("formatted")
    ).withColumn("loss_spans", _loss_spans(F.col("formatted")))


def read_back(blocks: DataFrame) -> DataFrame:
    """conv_id, block, the turns and the texts under the loss mask, from formatted text."""
    masked = F.transform(
        "loss_spans",
        lambda span: unescaped(F.substring(F.col("formatted"), span["start"] + 1, span["stop"] - span["start"])),
    )
    return blocks.select(
        "conv_id", "block", "formatted", parsed(F.col("formatted")).alias("turns"), masked.alias("loss")
    )


def digests(conversations: DataFrame) -> DataFrame:
    """The contract's row for each conversation, from what is read back."""
    spark = conversations.sparkSession
    conflicting = "</s>[INST] ok [/INST]"
    rows = conversations.selectExpr(
        "CAST(conv_id AS LONG) conv_id", "CAST(turn AS LONG) turn", "CAST(role AS STRING) role", "CAST(text AS STRING) text"
    ).unionByName(
        spark.range(2).select(
            F.lit(-1).cast("long").alias("conv_id"),
            F.col("id").alias("turn"),
            F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
            F.lit(conflicting).alias("text"),
        )
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = read_back(formatted(rows)).select(
        "conv_id",
        F.struct("block", F.array_join(lines, "").alias("turns"), F.array_join("loss", "").alias("loss")).alias("part"),
        F.size("turns").cast("long").alias("n_turns"),
        F.length("formatted").cast("long").alias("chars"),
    )
    grouped = read.groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"),
        F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list("part")).alias("parts"),
    )
    joined = grouped.withColumn("loss", F.array_join(F.col("parts.loss"), ""))
    return joined.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(F.col("parts.turns"), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def over_conversations(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "conversations"))


def _oracle() -> str:
    guard = "regexp_replace(%s, '" + _ANY + r"', '\1\\\2\3', 'g')"
    marks = " ".join(f"WHEN '{role}' THEN {sum(map(len, pair))}" for role, pair in MARKS.items())
    other = f"{sum(map(len, OTHER))} + length({guard % 'role'})"
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), grouped AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS lines,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '') AS loss,
         CAST(sum(length({guard % 'text'}) + CASE role {marks} ELSE {other} END) AS BIGINT) AS formatted_chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars
FROM grouped
"""


ORACLE = _oracle()
