"""Chat formatting with a grammar round trip.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``.  The parser splits at ``<|im_start|>``, takes the role up to the
first line feed and the text up to the closing ``<|im_end|>``, and then always unescapes.  Rendering starts from
the plain turns; the result is parsed again, and the turns that don't come back as they were are escaped: inside
``<|``, ``<\\|``, ``<\\\\|`` ... one more backslash follows the ``<``; a role's line feeds become ``\\n`` and its
backslashes double.  The escaped rendering is parsed once more, and a conversation that still differs is an error.
Everything is made of built-in column functions.

Defined cases: turns come by ``turn`` (NULL first), repeated rows and ties then by role and text; NULL role or
text is empty; a NULL ``conv_id`` is one conversation of its own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    doubled = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return escape_text(doubled)


def unescape_role(role: Column) -> Column:
    plain = unescape_text(role)
    marked = F.replace(plain, F.lit("\\\\"), F.lit("\\\x00"))
    return F.replace(F.replace(marked, F.lit("\\n"), F.lit("\n")), F.lit("\\\x00"), F.lit("\\"))


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: render_turn(t["role"], t["text"])), "")


def parse(formatted: Column) -> Column:
    """Turns of a formatted conversation, unescaped; a segment that is no turn gives a NULL role."""
    segments = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda s, i: (i > 0) | (s != ""))

    def turn(segment: Column) -> Column:
        role = F.regexp_extract(segment, r"^([^\n]*)\n", 1)
        body = F.substring(segment, F.length(role) + 2, F.length(segment) - F.length(role) - 1 - len(END) - 1)
        whole = segment.endswith(END + "\n") & segment.contains("\n") & (F.instr(body, END) == 0)
        return F.struct(F.when(whole, unescape_role(role)).alias("role"), unescape_text(body).alias("text"))

    return F.transform(segments, turn)


def format_conversations(rows: DataFrame) -> DataFrame:
    """``conv_id, formatted, recovered`` (array of role and text, read back from ``formatted``)."""
    turns = rows.select("conv_id", F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("sorted"))
    convs = convs.select("conv_id", F.transform("sorted", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    # round one: every turn plain; a turn is in conflict when it alone doesn't come back
    marked = convs.withColumn("marked", F.transform("turns", lambda t: F.struct(
        t["role"].alias("role"), t["text"].alias("text"),
        (parse(render_turn(t["role"], t["text"])) == F.array(F.struct(t["role"].alias("role"), t["text"].alias("text")))).alias("plain"),
    )))
    # round two: the turns in conflict escaped
    escaped = marked.select("conv_id", "turns", F.transform("marked", lambda t: F.struct(
        F.when(t["plain"], t["role"]).otherwise(escape_role(t["role"])).alias("role"),
        F.when(t["plain"], t["text"]).otherwise(escape_text(t["text"])).alias("text"),
    )).alias("written"))
    formatted = escaped.select("conv_id", "turns", render(F.col("written")).alias("formatted"))
    parsed = formatted.withColumn("recovered", parse(F.col("formatted")))
    same = parsed["recovered"] == parsed["turns"]
    return parsed.select("conv_id", "formatted", F.when(F.coalesce(same, F.lit(False)), F.col("recovered")).otherwise(
        F.raise_error(F.lit("a conversation does not come back from its formatted text")).cast("array<struct<role:string,text:string>>")
    ).alias("recovered"))


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what ``format_conversations`` read back; the loss mask covers assistant texts."""
    said = F.array_join(F.transform(F.filter("recovered", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    whole = F.array_join(F.transform("recovered", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return formatted.select(
        "conv_id", F.size("recovered").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length(said).cast("long").alias("loss_chars"), F.sha2(said, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
