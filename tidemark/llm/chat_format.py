"""Chat formatting with a grammar round trip. DataFrame functions only.

A conversation is one text, its turns side by side in the order of ``turn``:

    <<SYS>> text <</SYS>>      system
    [INST] text [/INST]        user
    <s> text </s>              assistant; its text is what a model learns from (the loss mask)
    [ROLE] role [TEXT] text [/ROLE]   any other role

(without the blanks shown here). Each conversation is rendered with its texts as they are, parsed again, and compared with
the source, turn by turn. Where the two differ, the control strings in the texts are broken by a backslash and it is parsed
again; where they still differ (a text held a broken control string already), every backslash, angle and square bracket is
written by a code, which no text can contradict. ``level`` (0, 1, 2) says which writing was needed.

Cases: a null text or role counts as empty; rows of a null conversation form one conversation. Turns with equal numbers are
ordered by role and text, null numbers come first; repeated rows are repeated turns. An empty table gives no rows. Only the
four named columns are read. A conversation must fit into one row, whose length Spark limits to 2 GB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROLS = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[TEXT]", "[/ROLE]")
OPENERS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
#: A whole turn: what opens it, what it holds, what closes it. Closers in the order of the openers.
_FORMS = [("<<SYS>>", "<</SYS>>"), (r"\[INST\]", r"\[/INST\]"), ("<s>", "</s>"), (r"\[ROLE\]", r"\[/ROLE\]")]
TURN = "(?s)(?:" + "|".join(f"{a}(?:(?!{b}).)*+{b}" for a, b in _FORMS) + ")"
_BARE = r"(<<|<|\[)(/?(?:SYS>>|s>|INST\]|ROLE\]|TEXT\]))"
_BROKEN = r"(<<|<|\[)\\(/?(?:SYS>>|s>|INST\]|ROLE\]|TEXT\]))"


def escape(text: Column, level: int) -> Column:
    if level == 1:
        return F.regexp_replace(text, _BARE, r"$1\\$2")
    if level == 2:
        for plain, code in (("\\", "\\b"), ("<", "\\l"), ("[", "\\o")):
            text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, level: int) -> Column:
    if level == 1:
        return F.regexp_replace(text, _BROKEN, "$1$2")
    if level == 2:
        for plain, code in (("[", "\\o"), ("<", "\\l"), ("\\", "\\b")):
            text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _render(turns: Column, level: int) -> Column:
    def one(t: Column) -> Column:
        text = escape(t["text"], level)
        other = F.concat(F.lit("[ROLE]"), escape(t["role"], level), F.lit("[TEXT]"), text, F.lit("[/ROLE]"))
        shown = F.when(F.lit(False), other)
        for role, (opener, closer) in OPENERS.items():
            shown = shown.when(t["role"] == role, F.concat(F.lit(opener), text, F.lit(closer)))
        return shown.otherwise(other)

    return F.array_join(F.transform(turns, one), "")


def _parse(formatted: Column, level: int) -> Column:
    """Turns as ``role, text, written, start, loss``: the unescaped text, the text as written and where it starts."""

    def one(piece: Column) -> Column:
        shown = F.when(F.lit(False), F.struct(F.lit("").alias("role"), F.lit("").alias("written"), F.lit(0).alias("head")))
        for role, (opener, closer) in OPENERS.items():
            inner = F.substr(piece, F.lit(len(opener) + 1), F.char_length(piece) - len(opener) - len(closer))
            shown = shown.when(
                F.startswith(piece, F.lit(opener)),
                F.struct(F.lit(role).alias("role"), inner.alias("written"), F.lit(len(opener)).alias("head")),
            )
        # at level 0 a text may hold [TEXT]: the role is what stands before the first
        inner = F.substr(piece, F.lit(7), F.char_length(piece) - 13)
        cut = F.instr(inner, "[TEXT]")
        return shown.otherwise(
            F.struct(
                unescape(F.substr(inner, F.lit(1), F.greatest(cut - 1, F.lit(0))), level).alias("role"),
                F.substr(inner, cut + 6, F.char_length(inner)).alias("written"),
                (cut + 11).alias("head"),
            )
        )

    return F.transform(
        F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), lambda p: F.struct(one(p).alias("t"), F.char_length(p).alias("size"))),
        lambda p: F.struct(
            p["t"]["role"].alias("role"), unescape(p["t"]["written"], level).alias("text"), p["t"]["written"].alias("written"),
            p["t"]["head"].alias("head"), p["size"].alias("size"),
        ),
    )


def _says(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")


def _sound(formatted: Column, parsed: Column, turns: Column) -> Column:
    """Whether the parser took every character and found the turns of the source."""
    taken = F.aggregate(parsed, F.lit(0), lambda s, t: s + t["size"])
    pairs = lambda a: F.transform(a, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return (taken == F.char_length(formatted)) & (pairs(parsed) == pairs(turns))


def format_conversations(rows: DataFrame) -> DataFrame:
    """``conv_id, formatted, level, turns``: the text and its turns as read back from it.

    A turn has ``role``, ``text`` (unescaped), ``loss``, and the place of the text as written: ``start`` (code points before
    it) and ``length``.
    """
    clean = rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    held = clean.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("source"))
    # a conversation is rendered at the next level only where the last one was not read back as it was
    for level in (0, 1, 2):
        fine = F.lit(False) if level == 0 else F.col("_sound")
        held = held.withColumn("_text", _render(F.col("source"), 0) if level == 0 else F.when(fine, F.col("_text")).otherwise(_render(F.col("source"), level)))
        parsed = _parse(F.col("_text"), level)
        held = held.withColumn("_turns", parsed if level == 0 else F.when(fine, F.col("_turns")).otherwise(parsed))
        held = held.withColumn("_level", F.lit(0) if level == 0 else F.when(fine, F.col("_level")).otherwise(F.lit(level)))
        if level < 2:
            sound = _sound(F.col("_text"), F.col("_turns"), F.col("source"))
            held = held.withColumn("_sound", sound if level == 0 else fine | sound)
    placed = F.aggregate(
        "_turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda s, t: F.struct((s["at"] + t["size"]).alias("at"), F.concat(s["starts"], F.array(s["at"] + t["head"])).alias("starts")),
        lambda s: s["starts"],
    )
    turns = F.zip_with(
        "_turns", "_starts",
        lambda t, start: F.struct(
            t["role"].alias("role"), t["text"].alias("text"), (t["role"] == "assistant").alias("loss"), start.alias("start"),
            F.char_length(t["written"]).alias("length"),
        ),
    )
    held = held.withColumn("_starts", placed)
    return held.select("conv_id", F.col("_text").alias("formatted"), F.col("_level").alias("level"), turns.alias("turns"))


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted texts say, read back from them."""
    spoken = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return formatted.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(_says(F.col("turns")), 256).alias("turns_sha256"),
        F.char_length(spoken).cast("long").alias("loss_chars"),
        F.sha2(spoken, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
