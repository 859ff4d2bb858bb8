"""Chat formatting as a grammar round trip, in DataFrame functions alone.

Grammar (one rendered conversation is the end-to-end run of its turns)::

    conversation := turn*
    turn         := '<<SYS>>' body '<</SYS>>' | '[INST]' body '[/INST]' | '<s>' body '</s>'
                  | '[ROLE=' url-encoded role ']' body '[/ROLE]'
    body         := text in which '\\x' stands for x

A text with a control string in it is escaped (a backslash before each backslash and inside each control string), so no
text can open or close a turn, not even where the parser would have got over it. Every turn is then read back by the
parser and compared with its source; one that differs (a backslash that would be taken for an escape) is escaped, and
so on until all are identical. Turns that would still differ are an error, which the last check raises.
No body holds a control string, so turns that are read back alone are also read back in their conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What opens and closes a turn of each role.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE=", "[/ROLE]")
#: Places inside a text where a control string starts.
CONTROL = r"([<\[])(?=<SYS>>|</SYS>>|INST\]|/INST\]|s>|/s>|ROLE=|/ROLE\])"
TURN = r"(?s)<<SYS>>.*?<</SYS>>|\[INST\].*?\[/INST\]|<s>.*?</s>|\[ROLE=[^\]]*\].*?\[/ROLE\]"
OPENER = r"^(?:<<SYS>>|\[INST\]|<s>|\[ROLE=[^\]]*\])"
CLOSER = r"(?:<</SYS>>|\[/INST\]|</s>|\[/ROLE\])$"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$1\\")


def unescape(body: Column) -> Column:
    return F.regexp_replace(body, r"(?s)\\(.)", "$1")


def opener(role: Column) -> Column:
    out = F.concat(F.lit(OTHER[0]), F.url_encode(role), F.lit("]"))
    for name, (mark, _) in MARKS.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def closer(role: Column) -> Column:
    out = F.lit(OTHER[1])
    for name, (_, mark) in MARKS.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation: array of (role, text, segment); segment is the turn as it stands there."""

    def turn(s: Column) -> Column:
        mark = F.regexp_extract(s, OPENER, 0)
        role = F.url_decode(F.substring(mark, len(OTHER[0]) + 1, 1 << 30))
        role = F.regexp_replace(role, r"\]$", "")
        for name, (m, _) in MARKS.items():
            role = F.when(mark == m, F.lit(name)).otherwise(role)
        body = F.regexp_replace(F.regexp_replace(s, OPENER, ""), CLOSER, "")
        return F.struct(role.alias("role"), unescape(body).alias("text"), s.alias("segment"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), turn)


def _reads_back(segment: Column, role: Column, text: Column) -> Column:
    found = parse(segment)
    return (F.size(found) == 1) & (F.get(found, F.lit(0))["segment"] == segment) & (F.get(found, F.lit(0))["role"] == role) & (F.get(found, F.lit(0))["text"] == text)


def render_turns(df: DataFrame, role: str = "role", text: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Adds ``__segment`` (the rendered turn) and ``__run`` (characters before its loss text, and in it). Row by row.

    Null role or text: empty. Any role is allowed. No shuffle, so the length of a conversation does not matter here.
    """
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("__role", r).withColumn("__text", t)
    r, t = F.col("__role"), F.col("__text")
    df = df.withColumn("__body", F.when(t.rlike(CONTROL), escape(t)).otherwise(t))
    segment = lambda: F.concat(opener(r), F.col("__body"), closer(r))
    df = df.withColumn("__segment", segment())
    df = df.withColumn("__body", F.when(_reads_back(F.col("__segment"), r, t), F.col("__body")).otherwise(escape(t)))
    df = df.withColumn("__segment", segment())
    keep = F.when(r.isin(*loss_roles), F.char_length("__body")).otherwise(F.lit(0))
    return df.withColumn("__run", F.struct(F.char_length(opener(r)).alias("skip"), keep.alias("keep")))


def format_conversations(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_roles: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """One row per conversation: ``conv``, ``formatted``, ``loss_runs`` and ``source``.

    ``formatted`` is the rendered text. ``loss_runs`` is the loss mask, one (skip, keep) a turn: of the turn's segment,
    the first ``skip`` characters carry no loss, the next ``keep`` do, the rest does not; segments tile the text.
    ``source`` holds the turns (role, text) as given, in order.

    Turns go by ``turn``; null comes first; ties go by role, then text; equal rows all stay. A null ``conv`` is one
    conversation. An empty table gives no row. Other columns are ignored, whatever their names. Rendering happens
    before the rows meet; only a conversation's own text meets in one row, which its contract (one text) asks for.
    """
    df = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    turns = render_turns(df, loss_roles=loss_roles).select("conv", F.struct("turn", F.col("__role").alias("role"), F.col("__text").alias("text"), F.col("__segment").alias("segment"), F.col("__run").alias("run")).alias("t"))
    whole = turns.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return whole.select(
        F.col("conv").alias(conv),
        F.array_join(F.transform("t", lambda x: x["segment"]), "").alias("formatted"),
        F.transform("t", lambda x: x["run"]).alias("loss_runs"),
        F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns``, read from ``formatted``, and checks them against ``source``; a difference is an error."""
    df = formatted.withColumn("turns", parse(F.col("formatted")))
    same = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))) == F.col("source")
    return df.withColumn("turns", F.when(same, F.col("turns")).otherwise(F.raise_error(F.lit("a rendered conversation does not read back as its source"))))


def digests(df: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What the query returns, taken from the read-back turns and from the text under the loss mask."""
    turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    masked = F.zip_with("turns", "loss_runs", lambda x, m: unescape(F.substring(x["segment"], m["skip"] + 1, m["keep"])))
    return df.withColumn("__loss", F.array_join(masked, "")).select(
        conv,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("__loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("__loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
