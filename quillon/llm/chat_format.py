r"""Chat formatting with a grammar round trip (DataFrame functions only).

A conversation is the sequence of its turns:

    conversation = { turn } ;
    turn = open , field , middle , field , close ;      (* role, then text *)
    field = plain | "\" , escaped ;

The deterministic parser cuts at control strings: `close` ends a turn, the first `middle` after `open` ends the role.
A turn is first rendered plainly and parsed again. Where the parse is not identical to the source (a field holds a
control string or begins with a backslash), the field is escaped: backslashes doubled, and one put after the first character of
each control string. Parse and comparison are repeated; a second level escapes every "<" and "[" as well. If no
level were identical the job fails rather than change a text. Assistant texts carry the loss mask.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    open: str = "<s>[INST] "
    middle: str = " [/INST]"
    close: str = "</s>"
    #: Strings that must not stand in a rendered field.
    control: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")
    learned_role: str = "assistant"


def _escape(x: Column, control: tuple[str, ...]) -> Column:
    out = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    for c in control:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return F.concat(F.lit("\\"), out)


def unescape(x: Column) -> Column:
    """What a rendered field says."""
    return F.when(x.startswith("\\"), F.regexp_replace(F.substr(x, F.lit(2)), r"(?s)\\(.)", "$1")).otherwise(x)


def _free(x: Column, control: tuple[str, ...]) -> Column:
    """No control string in x."""
    out = F.lit(True)
    for c in control:
        out = out & ~x.contains(c)
    return out


def parse_turn(turn: Column, t: Template) -> Column:
    """struct(role, text: as rendered; ok: the grammar's only reading) of what stands before a `close`."""
    body = F.substr(turn, F.lit(len(t.open) + 1))
    at = F.instr(body, t.middle)
    role = F.substr(body, F.lit(1), at - 1)
    text = F.substr(body, at + len(t.middle))
    return F.struct(role.alias("role"), text.alias("text"), (turn.startswith(t.open) & (at > 0) & _free(role, t.control) & _free(text, t.control)).alias("ok"))


def _trip(role: Column, text: Column, r: Column, x: Column, t: Template) -> Column:
    """Whether (role, text), rendered as r and x, is read back identically."""
    cut = F.split(F.concat(F.lit(t.open), r, F.lit(t.middle), x, F.lit(t.close)), _quoted(t.close), -1)
    p = parse_turn(F.get(cut, F.lit(0)), t)
    return (F.size(cut) == 2) & p["ok"] & (unescape(p["role"]) == role) & (unescape(p["text"]) == text)


def _quoted(s: str) -> str:
    return "\\Q" + s + "\\E"


def render_turns(turns: DataFrame, t: Template, role: str, text: str, to: str) -> DataFrame:
    """Adds `to`: the rendered turn, at the first level whose round trip is identical."""
    levels = [(F.col(role), F.col(text)), (_escape(F.col(role), t.control), _escape(F.col(text), t.control)), (_escape(F.col(role), ("<", "[")), _escape(F.col(text), ("<", "[")))]
    out = F.raise_error(F.lit("a turn has no identical rendering")).cast("string")
    for r, x in reversed(levels):
        out = F.when(_trip(F.col(role), F.col(text), r, x, t), F.concat(F.lit(t.open), r, F.lit(t.middle), x, F.lit(t.close))).otherwise(out)
    return turns.withColumn(to, out)


def chat_format(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: Template = Template()) -> DataFrame:
    """One row per conversation: conv_col, n_turns, `formatted` and `loss_spans` (array of struct(start, length): characters of
    `formatted` under the loss mask, which hold assistant texts as rendered).

    Turns are ordered by turn, then role and rendering (ties and repeated rows all stay). Null texts and roles are empty;
    rows with a null conv_col are one conversation. An empty table gives no row. Extra columns are ignored.
    """
    t = template
    rows = turns.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("n"), F.coalesce(F.col(role_col), F.lit("")).alias("r"), F.coalesce(F.col(text_col), F.lit("")).alias("x"))
    rows = render_turns(rows, t, "r", "x", "out")
    body = F.length("out") - len(t.open) - len(t.close) - len(t.middle)
    # The rendered role's length; the rest of the body is the text.
    role = F.instr(F.substr("out", F.lit(len(t.open) + 1)), t.middle) - 1
    one = F.struct("n", "r", "out", (F.col("r") == t.learned_role).alias("learn"), (F.lit(len(t.open) + len(t.middle)) + role).cast("long").alias("at"), (body - role).cast("long").alias("size"))
    convs = rows.groupBy("c").agg(F.sort_array(F.collect_list(one)).alias("t"))
    start = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    spans = F.aggregate(
        "t",
        start,
        lambda acc, x: F.struct((acc["end"] + F.length(x["out"])).cast("long").alias("end"), F.when(x["learn"], F.array_append(acc["spans"], F.struct((acc["end"] + x["at"]).alias("start"), x["size"].alias("length")))).otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"],
    )
    return convs.select(F.col("c").alias(conv_col), F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda x: x["out"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """array of struct(role, text): what the parser reads in a formatted conversation; fails on what is not the grammar's."""
    cut = F.split(formatted, _quoted(template.close), -1)
    turns = F.transform(F.slice(cut, F.lit(1), F.size(cut) - 1), lambda x: parse_turn(x, template))
    bad = F.raise_error(F.lit("not a formatted conversation"))
    return F.transform(turns, lambda p: F.struct(F.when(p["ok"], unescape(p["role"])).otherwise(bad).alias("role"), F.when(p["ok"], unescape(p["text"])).otherwise(bad).alias("text")))


def masked_texts(formatted: Column, spans: Column) -> Column:
    """array of string: the texts under the loss mask, unescaped."""
    return F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
