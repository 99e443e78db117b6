"""Chat formatting of typed content parts.

A message holds ordered parts: text, image, audio or document. `flatten` visits them by
kind: text parts that stand side by side are one text, which is escaped as a whole, so that no
control string can be put together from several; any other part gives a placeholder that names
its kind and its number among the conversation's attachments, its reference goes to the list
of attachments, and its expanded token count is reckoned from its measures. The result is one
string for a conversation. A part of an unknown kind counts as a text.

Template, all of it made of control strings, which begin with "<|":

    <|turn|>ROLE<|text|>TEXT<|end|>

Inside roles and texts a control string, of this template or of the usual others ("<|",
"<s>", "</s>", "[INST]", "[/INST]"), gets one backslash more after its opening bracket.
A control string that already has backslashes there gets one more too, so that taking one
away restores every text exactly.

Cases: null text or role counts as empty; a null or empty list of parts is an empty text;
turns with equal numbers are ordered by role, then text; null turns come first; repeated
rows are repeated turns; a conversation whose id is null is one conversation; no rows give
no rows (the query still gives conversation -1, as a row apart from one of that number); other columns are ignored. A conversation is one string, so that its own length is
what a task must hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hex_sha256, let, table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
_TAIL = r"(\||/?s>|/?INST\])"
PART_TYPE = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
#: Tokens that a part stands for once expanded: a tile of 28 x 28 pixels, 1/25 second, 1/600 page.
TILE, AUDIO_RATE, PAGE_TOKENS = 28, 25, 600


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([<\[])(\\*)" + _TAIL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _TAIL, "$1$2$3")


def part_tokens(part: Column) -> Column:
    """Expanded tokens of an attachment; 0 for a text and for missing measures."""
    tiles = F.ceil(part["width"] / TILE) * F.ceil(part["height"] / TILE)
    count = (
        F.when(part["kind"] == "image", tiles)
        .when(part["kind"] == "audio", F.ceil(part["seconds"] * AUDIO_RATE))
        .when(part["kind"] == "document", (part["pages"] * PAGE_TOKENS).cast("long"))
    )
    return F.coalesce(count.cast("long"), F.lit(0).cast("long"))


def _is_attachment(part: Column) -> Column:
    return F.coalesce(part["kind"].isin("image", "audio", "document"), F.lit(False))


def flatten(turns: Column) -> Column:
    """The formatted string and the attachments of an array of (turn, role, parts)."""
    placed = F.flatten(F.transform(turns, lambda t, i: F.transform(t["parts"], lambda p: F.struct(i.alias("turn"), p.alias("part")))))
    attached = F.filter(placed, lambda x: _is_attachment(x["part"]))
    seen = F.transform(turns, lambda t: F.size(F.filter(t["parts"], _is_attachment)))

    def visit(turn: Column, before: Column) -> Column:
        parts = turn["parts"]
        # The places of attachments, with one before the first part and one after the last.
        inside = F.filter(F.transform(parts, lambda p, i: F.when(_is_attachment(p), i)), lambda i: i.isNotNull())
        edges = F.concat(F.array(F.lit(-1)), inside, F.array(F.size(parts)))

        def run(at: Column) -> Column:
            def one(e: Column, k: Column) -> Column:
                end = F.get(at, k + 1)
                said = F.transform(F.slice(parts, e + 2, end - e - 1), lambda p: F.coalesce(p["text"], F.lit("")))
                p = F.get(parts, end)
                held = F.concat(F.lit("<|"), p["kind"], F.lit(":"), (before + k).cast("string"), F.lit("|>"))
                return F.concat(escape(F.array_join(said, "")), F.coalesce(held, F.lit("")))

            return F.array_join(F.transform(F.slice(at, 1, F.size(at) - 1), one), "")

        return F.concat(F.lit(TURN), escape(turn["role"]), F.lit(TEXT), let(edges, run), F.lit(END))

    def whole(counts: Column) -> Column:
        sum_before = lambda i: F.aggregate(F.slice(counts, 1, i), F.lit(0), lambda a, b: a + b)
        return F.array_join(F.transform(turns, lambda t, i: visit(t, F.when(F.size(attached) == 0, F.lit(0)).otherwise(sum_before(i)))), "")

    refs = F.transform(attached, lambda x, i: F.struct(i.alias("number"), x["turn"].alias("turn"), x["part"]["kind"].alias("kind"), x["part"]["ref"].alias("ref"), part_tokens(x["part"]).alias("tokens")))
    return F.struct(let(seen, whole).alias("formatted"), refs.alias("attachments"))


def format_conversations(messages: DataFrame) -> DataFrame:
    """conv_id, formatted and attachments of every conversation.

    messages has conv_id, turn, role and either parts (PART_TYPE) or text.
    """
    if "parts" in messages.columns:
        parts = F.coalesce(F.col("parts").cast(PART_TYPE), F.array().cast(PART_TYPE))
    else:
        null = F.lit(None)
        parts = F.array(F.struct(F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), *[null.alias(n) for n in ("ref", "width", "height", "seconds", "pages")])).cast(PART_TYPE)
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    grouped = messages.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return grouped.select("conv_id", flatten(F.col("turns")).alias("f")).select("conv_id", "f.formatted", "f.attachments")


def read_back(formatted: Column) -> Column:
    """The (role, text) of each turn of a formatted string, unescaped. Placeholders stay."""
    bodies = F.filter(F.split(formatted, r"<\|end\|>"), lambda x: x != "")

    def one(body: Column) -> Column:
        # Escaped roles and texts hold no control string, so the first TEXT ends the role.
        at = F.instr(body, TEXT)
        role = F.substring(body, F.lit(len(TURN) + 1), at - (len(TURN) + 1))
        text = F.substring(body, at + len(TEXT), F.length(body))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(bodies, one)


def loss_text(turns: Column) -> Column:
    """All text under the loss mask: what the assistant says."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")


def op5_chat(spark, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    turn = F.col("id")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), turn.alias("turn"), F.when(turn == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    made = format_conversations(messages).unionByName(format_conversations(extra))  # apart from any -1 of the table
    read = made.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = loss_text(F.col("turns"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        hex_sha256(lines).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        hex_sha256(loss).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
