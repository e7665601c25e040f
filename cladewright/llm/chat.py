"""Chat formatting with a grammar round trip, in DataFrame functions only.

A turn is ``<|im_start|>role``, a line end, its text and ``<|im_end|>`` with a line end. The formatter renders a turn as it stands, reparses the rendering
with the parser (below), and compares what it recovers with the source; a turn that comes back changed is escaped and rendered again. Escaping puts one more
backslash into each ``<``, backslashes, ``|`` (and, in roles, escapes line ends), and the parser takes one out, so that a control string cannot
arise in a text and every text comes back. A control string in a text is a conflict wherever it stands, with or without a line end after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
_END_LINE = END + "\n"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(r"<(\\*)\|"), F.lit(r"<\\$1|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(r"<\\(\\*)\|"), F.lit(r"<$1|"))


def escape_role(c: Column) -> Column:
    return F.replace(F.replace(escape(c), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(F.replace(c, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(_END_LINE))


def parse(rendered: Column) -> Column:
    """Turns (role, text, raw: the text as it stands in the rendering, lead: the characters before it) of a rendered string; a part that is not a turn has a null role."""
    def turn(part: Column) -> Column:
        line = F.locate("\n", part)
        ok = part.startswith(START) & (line > 0) & (F.locate(START, part, 2) == 0)
        raw = F.substr(part, line + 1)
        return F.struct(
            F.when(ok, unescape_role(F.substr(part, F.lit(len(START) + 1), line - len(START) - 1))).alias("role"),
            unescape(raw).alias("text"), raw.alias("raw"), line.alias("lead"))

    parts = F.split(rendered, r"<\|im_end\|>\n?", -1)
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.transform(whole, turn)


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role, text, escaped), parsed, loss_spans (start, length in code points from 0 in ``formatted``) of each conversation.

    Rows are ordered by turn, then role and text (nulls first); repeated rows are repeated turns. A null text or role is empty, and rows with a null conv_id are one
    conversation. An empty table gives no rows. Columns other than conv_id, turn, role and text are not read. A conversation is one string and so one row. The whole
    rendering is parsed again, and a conversation that did not come back turn for turn would stop the query.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    plain = render(role, text)
    back = parse(plain)
    same = (F.size(back) == 1) & back[0]["role"].eqNullSafe(role) & back[0]["text"].eqNullSafe(text)
    one = turns.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), (~same).alias("escaped"),
        F.when(same, role).otherwise(escape_role(role)).alias("said_role"), F.when(same, text).otherwise(escape(text)).alias("said_text"))
    one = one.withColumn("r", render(F.col("said_role"), F.col("said_text")))
    up_to = F.sum(F.length("r")).over(W.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, 0))
    first = up_to - F.length("r") + len(START) + F.length("said_role") + 1
    one = one.withColumn("span", F.when(F.col("role") == LEARNED, F.struct(first.cast("int").alias("start"), F.length("said_text").alias("length"))))
    all_ = one.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "r", "escaped", "span"))).alias("t"))
    made = all_.select(
        "conv_id", F.array_join(F.transform("t", lambda x: x["r"]), "").alias("formatted"), F.transform("t", lambda x: F.struct(x["role"], x["text"], x["escaped"])).alias("turns"),
        F.filter(F.transform("t", lambda x: x["span"]), lambda x: x.isNotNull()).alias("loss_spans"))
    made = made.withColumn("parsed", parse(F.col("formatted")))
    recovered = F.transform("parsed", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))) == F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    kept = F.when(recovered, F.col("parsed")).otherwise(F.raise_error(F.lit("a conversation did not come back from its rendering")).cast(made.schema["parsed"].dataType))
    return made.withColumn("parsed", kept).select("conv_id", "formatted", "turns", "parsed", "loss_spans")


def read_back(chats: DataFrame) -> DataFrame:
    """What the rendering and its spans say, read from them alone: turns, their digest, and the text under the loss mask.

    A running sum over the parser's parts gives the place of each text; the texts that lie under a span, of its place and length, are the text under the mask, in order and
    unescaped. A span that is not exactly over a text, a repeated one, or parts that don't fill the rendering stop the query.
    """
    none = lambda t: F.lit(None).cast(t)
    turns = F.transform("parsed", lambda x, i: F.struct(
        F.lit(1).alias("kind"), i.alias("i"), x["role"].alias("role"), x["text"].alias("text"), F.length(x["raw"]).alias("length"), (x["lead"] + F.length(x["raw"]) + len(_END_LINE)).alias("whole"), none("int").alias("start")))
    spans = F.transform("loss_spans", lambda s: F.struct(
        F.lit(0).alias("kind"), none("int").alias("i"), none("string").alias("role"), none("string").alias("text"), s["length"].alias("length"), F.lit(0).alias("whole"), s["start"].alias("start")))
    rows = chats.select("conv_id", F.length("formatted").alias("chars"), F.explode(F.concat(turns, spans)).alias("x")).select("conv_id", "chars", "x.*")
    of = W.partitionBy("conv_id")
    end = F.sum("whole").over(of.orderBy("kind", "i").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("start", F.coalesce("start", (end - len(_END_LINE) - F.col("length")).cast("int")))
    above = F.lag(F.struct("kind", "start", "length")).over(of.orderBy("start", "kind", "i"))
    under = (F.col("kind") == 1) & F.coalesce(above == F.struct(F.lit(0).alias("kind"), "start", "length"), F.lit(False))
    # an empty text may share its place with nothing else, as a turn has a head and an end
    rows = rows.withColumn("under", under)
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == 1, F.struct("i", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("x"))))), lambda t: t["x"]), "")
    learned = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("under"), F.struct("i", "text")))), lambda t: t["text"]), "")
    per = rows.groupBy("conv_id").agg(
        F.sum(F.col("kind").cast("long")).alias("n_turns"), said.alias("said"), learned.alias("learned"), F.max("chars").cast("long").alias("formatted_chars"),
        (F.count_if("under") == F.count_if(F.col("kind") == 0)).alias("met"), (F.sum("whole") == F.max("chars")).alias("filled"))
    text = F.when(F.col("met") & F.col("filled"), F.col("learned")).otherwise(F.raise_error(F.lit("the loss mask is not over texts of the rendering")).cast("string"))
    return per.select(
        "conv_id", "n_turns", F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"), F.length(text).cast("long").alias("loss_chars"),
        F.sha2(text.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
