"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted, and adjacent turns of
one role are merged into one block of the template:

    <s>[SYS]text[/SYS][INST]text[SEP]text[/INST]text</s>

``user`` turns stand in ``[INST]``, ``system`` turns in ``[SYS]``, ``assistant``
turns between ``[ASST]`` and ``</s>``, any other role ``r`` in ``[ROLE]r[SAYS]``
... ``[/ROLE]``. ``[SEP]`` parts the turns of a merged block. In texts and role
names each ``[``, ``<`` and ``\\`` is followed by a ``\\``, so no text can hold a
control string, and dropping that ``\\`` gives the text back.

Turns are collected in two steps. First every ``SEGMENT`` turn numbers of a
conversation make a segment, sorted and escaped in a task of its own;
then a conversation's segments are put in order and joined, where a block that
goes on in the next segment stays open. A conversation with a large part of all
rows is thus worked off in many tasks, and only its finished text, which is one
row of the result, comes together. Where more than ``CROWD`` rows share a
segment's turn numbers, or have none, every different turn is a segment of its
own and its repetitions are counted. A segment of more than ``SEGMENT`` turns is
cut, so string positions within one are short and reading the loss mask stays
linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.store import Scratch

#: Turn numbers, and turns, in a segment.
SEGMENT = 64
#: Rows that are collected for a segment's turn numbers.
CROWD = 4096

# The template's control strings.
BEGIN, SEP = "<s>", "[SEP]"
OPEN = {"user": "[INST]", "system": "[SYS]", "assistant": "[ASST]"}
CLOSE = {"user": "[/INST]", "system": "[/SYS]", "assistant": "</s>"}
OTHER_OPEN, OTHER_SAYS, OTHER_CLOSE = "[ROLE]", "[SAYS]", "[/ROLE]"
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    """Reversible: no control string can occur in the result."""
    return F.regexp_replace(text, r"([\[<\\])", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<\\])\\", "$1")


def _open(role: Column) -> Column:
    known = F.lit(None)
    for r, mark in OPEN.items():
        known = F.when(role == r, F.lit(mark)).otherwise(known)
    return F.coalesce(known, F.concat(F.lit(OTHER_OPEN), escaped(role), F.lit(OTHER_SAYS)))


def _close(role: Column) -> Column:
    known = F.lit(OTHER_CLOSE)
    for r, mark in CLOSE.items():
        known = F.when(role == r, F.lit(mark)).otherwise(known)
    return known


def formatted(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation: ``conv_id, segments``.

    ``segments`` is an array of ``text`` and ``loss``; the conversation's text
    is the concatenation of the segments' texts, and ``loss`` marks the parts
    of the segment that count for training, as ``start`` (from 0) and
    ``length`` in code points: exactly the assistant's escaped texts.

    Turns go by number, then by role and text; those without a number come
    first. Repeated rows are repeated
    turns. A null text or role counts as empty, rows with a null
    ``conv_id`` make one conversation, other columns are not read, and an empty
    table gives no conversations.
    """
    col = lambda name: F.col(f"`{name}`")
    rows = turns.select(
        col(conv_col).alias("conv_id"),
        col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("number", F.floor(F.col("turn") / SEGMENT))
    crowded = rows.groupBy("conv_id", "number").agg(F.count("*").alias("n")).where((F.col("n") > CROWD) | F.col("number").isNull())
    crowded = Scratch(turns.sparkSession, "chat").write(crowded.select(F.col("conv_id").alias("of_conv"), F.col("number").alias("of_number")), "crowded")
    nothing = [F.lit(None).cast(f"{kind}").alias(name) for name, kind in (("turn", "bigint"), ("role", "string"), ("text", "string"))]
    parts = _plain(rows, nothing)
    if not crowded.isEmpty():
        same = F.col("conv_id").eqNullSafe(F.col("of_conv")) & F.col("number").eqNullSafe(F.col("of_number"))
        counted = rows.join(crowded, same, "left_semi").groupBy("conv_id", "number", "turn", "role", "text").agg(F.count("*").alias("n"))
        alike = F.array_repeat(F.struct("role", escaped(F.col("text")).alias("text")), F.col("n").cast("int"))
        parts = _plain(rows.join(crowded, same, "left_anti"), nothing).unionByName(counted.select("conv_id", F.struct("number", "turn", "role", "text").alias("segment"), alike.alias("turns")))
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.size("turns") - 1) / SEGMENT).cast("int")), lambda k: F.struct("segment", k.alias("cut"), F.slice("turns", k * SEGMENT + 1, F.lit(SEGMENT)).alias("turns")))
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.flatten(F.collect_list(cuts))).alias("parts"))
    return whole.select("conv_id", _segments(F.col("parts")).alias("segments"))


def _plain(rows: DataFrame, nothing: list[Column]) -> DataFrame:
    """The sorted turns of segments by turn numbers alone, escaped."""
    sorted_turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    parts = rows.groupBy("conv_id", "number").agg(sorted_turns.alias("turns"))
    return parts.select("conv_id", F.struct("number", *nothing).alias("segment"), F.transform("turns", lambda t: F.struct(t["role"].alias("role"), escaped(t["text"]).alias("text"))).alias("turns"))


def _segments(parts: Column) -> Column:
    """The text and loss mask of each segment, given its neighbours."""
    last = F.size(parts) - 1

    def segment(part: Column, n: Column) -> Column:
        turns = part["turns"]
        size = F.size(turns)
        before = F.when(n > 0, F.element_at(F.get(parts, n - 1)["turns"], -1)["role"])
        after = F.when(n < last, F.element_at(F.get(parts, n + 1)["turns"], 1)["role"])

        def pieces(t: Column, k: Column) -> Column:
            """What stands before a turn's text, the text, and what stands after it."""
            previous = F.when(k > 0, F.get(turns, k - 1)["role"]).otherwise(before)
            following = F.when(k < size - 1, F.get(turns, k + 1)["role"]).otherwise(after)
            lead = F.when(previous.eqNullSafe(t["role"]), F.lit(SEP)).otherwise(_open(t["role"]))
            lead = F.when((n == 0) & (k == 0), F.concat(F.lit(BEGIN), lead)).otherwise(lead)
            tail = F.when(following.eqNullSafe(t["role"]), F.lit("")).otherwise(_close(t["role"]))
            return F.struct(lead.alias("lead"), t["text"].alias("text"), tail.alias("tail"), (t["role"] == LOSS_ROLE).alias("loss"))

        return F.transform(turns, pieces)

    def joined(pieces: Column) -> Column:
        lengths = F.transform(pieces, lambda p: F.char_length(p["lead"]) + F.char_length(p["text"]) + F.char_length(p["tail"]))
        # An array of one struct, so that the lengths are worked out once and not for each turn.
        return F.get(F.transform(F.array(F.struct(pieces.alias("pieces"), lengths.alias("lengths"))), marked), F.lit(0))

    def marked(s: Column) -> Column:
        text = F.array_join(F.transform(s["pieces"], lambda p: F.concat(p["lead"], p["text"], p["tail"])), "")

        def mask(p: Column, k: Column) -> Column:
            at = F.aggregate(F.slice(s["lengths"], F.lit(1), k), F.lit(0), lambda a, x: a + x) + F.char_length(p["lead"])
            return F.when(p["loss"], F.struct(at.alias("start"), F.char_length(p["text"]).alias("length")))

        return F.struct(text.alias("text"), F.array_compact(F.transform(s["pieces"], mask)).alias("loss"))

    return F.transform(F.transform(parts, segment), joined)


def text_of(segments: Column) -> Column:
    """The whole formatted conversation."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def turns_of(text: Column) -> Column:
    """The turns of a formatted conversation, read back: an array of ``role, text``."""
    blocks = F.split(F.substring(text, len(BEGIN) + 1, 2_147_483_647), r"(?<=\[/INST\]|\[/SYS\]|</s>|\[/ROLE\])")
    blocks = F.filter(blocks, lambda b: b != "")

    def turns(block: Column) -> Column:
        role, body = F.lit(None).cast("string"), F.lit(None).cast("string")
        for r, mark in OPEN.items():
            here = F.startswith(block, F.lit(mark))
            inner = F.substring(block, F.lit(len(mark) + 1), F.char_length(block) - len(mark) - len(CLOSE[r]))
            role, body = F.when(here, F.lit(r)).otherwise(role), F.when(here, inner).otherwise(body)
        named = F.substring(block, F.lit(len(OTHER_OPEN) + 1), F.char_length(block) - len(OTHER_OPEN) - len(OTHER_CLOSE))
        other = F.split(named, r"\[SAYS\]", 2)
        role = F.coalesce(role, unescaped(F.get(other, F.lit(0))))
        body = F.coalesce(body, F.get(other, F.lit(1)))
        return F.transform(F.split(body, r"\[SEP\]", -1), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_texts(segments: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    of_segment = lambda s: F.transform(s["loss"], lambda m: unescaped(F.substring(s["text"], m["start"] + 1, m["length"])))
    return F.flatten(F.transform(segments, of_segment))


def digests(conversations: DataFrame) -> DataFrame:
    """Digest columns of formatted conversations, read back from their text and their loss mask."""
    read = conversations.select("conv_id", "segments", text_of(F.col("segments")).alias("text"))
    read = read.select("conv_id", F.char_length("text").cast("bigint").alias("formatted_chars"), turns_of(F.col("text")).alias("turns"), F.array_join(loss_texts(F.col("segments")), "").alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
