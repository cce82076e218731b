r"""Chat formatting from an event log.

Events of a conversation, by sequence number: ``start`` opens a message with a role and maybe a text, ``delta`` adds to
it, ``edit`` puts another text in its place, ``regenerate`` empties it and takes back all later messages begun before.
Folding needs no loop: a message's text is what was added since its last start, edit or regeneration, and a message is
gone if an earlier message was regenerated after it began. Messages are then rendered in order:

    <|role|>\ntext<|end|>\n

Inside roles and texts a backslash stands before every backslash, before the bar of ``<|`` in texts and before every
bar in roles, so ``<|`` occurs in marks only and the text can be read back exactly. The loss mask covers the texts of
the assistant.

Only DataFrame functions are used. A conversation becomes one row, so its own messages meet in one task; the parts of
a message are put together before that.

Cases: null texts and roles are empty; conversations without an id are one conversation; events without a message or
a sequence number are left out; messages that were never started are left out. Events that tie in sequence go by kind
and text. An empty table gives an empty result. Further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ASSISTANT = "assistant"
_END = "<|end|>\n"


def fold_events(events: DataFrame) -> DataFrame:
    """Messages (conv_id, message, role, text) from events (conv_id, seq, message, kind, role, text)."""
    kind, seq = F.col("kind"), F.col("seq")
    per = (
        events.where("message is not null and seq is not null")
        .groupBy("conv_id", "message")
        .agg(
            F.sort_array(F.collect_list(F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text")))).alias("log"),
            F.max(F.when(kind.isin("start", "edit", "regenerate"), seq)).alias("reset"),
            F.max(F.when(kind == "regenerate", seq)).alias("again"),
            F.max(F.when(kind == "start", seq)).alias("begun"),
            F.max_by("role", F.when(kind == "start", seq)).alias("role"),
        )
    )
    earlier = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    alive = F.col("begun").isNotNull() & (F.col("cut").isNull() | (F.col("begun") > F.col("cut")))
    last = F.filter("log", lambda e: e["seq"] >= F.col("reset"))
    return (
        per.withColumn("cut", F.max("again").over(earlier))
        .where(alive)
        .select("conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform(last, lambda e: e["text"]), "").alias("text"))
    )


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_spans (start from 1 and length in characters) of each conversation."""
    head = F.concat(F.lit("<|"), escape_role(F.col("role")), F.lit("|>\n"))
    body = escape(F.col("text"))
    piece = F.concat("head", "body", F.lit(_END))
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    rows = messages.select("conv_id", "message", "role", head.alias("head"), body.alias("body")).withColumn("piece", piece)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head") + 1)
    span = F.when(F.col("role") == ASSISTANT, F.struct("start", F.length("body").cast("long").alias("length")))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("message", "piece", span.alias("span")))).alias("turns"))
    spans = F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull())
    return turns.select("conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def format_conversations(events: DataFrame) -> DataFrame:
    return render(fold_events(events))


def read_back(formatted: Column) -> Column:
    """Turns (role, text) of a rendered conversation."""
    parts = F.split(formatted, r"<\|", -1)
    own = F.filter(parts, lambda _, i: i % 2 == 1)
    pattern = r"(?s)^((?:[^\\|]++|\\.)*+)\|>\n(.*)$"
    return F.transform(
        own,
        lambda p: F.struct(unescape(F.regexp_extract(p, pattern, 1)).alias("role"), unescape(F.regexp_extract(p, pattern, 2)).alias("text")),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int"), s["length"].cast("int")))), "")


def event_log(rows: DataFrame) -> DataFrame:
    """An event log whose fold gives the rows of a turn table (conv_id, turn, role, text) back.

    User turns are typed wrong and edited, assistant turns are streamed, regenerated and streamed again, others arrive
    in two parts. Rows of one turn are ordered by role and text; equal rows stay separate messages.
    """
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    first, second = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))

    def events(*steps: tuple[str, Column]) -> Column:
        return F.array(
            *[F.struct((F.col("message") * 8 + i).alias("seq"), F.lit(k).alias("kind"), t.alias("text")) for i, (k, t) in enumerate(steps)]
        )

    wrong = F.reverse(first)
    log = (
        F.when(F.col("role") == "user", events(("start", wrong), ("edit", first), ("delta", second)))
        .when(F.col("role") == ASSISTANT, events(("start", F.lit("")), ("delta", wrong), ("regenerate", F.lit("")), ("delta", first), ("delta", second)))
        .otherwise(events(("start", first), ("delta", second)))
    )
    numbered = rows.select("conv_id", "turn", "role", "text").withColumn("message", number.cast("long"))
    return numbered.select("conv_id", "message", "role", F.explode(log).alias("e")).select("conv_id", "message", "role", "e.seq", "e.kind", "e.text")
