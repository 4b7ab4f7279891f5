"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted, adjacent turns of
one role become one block, and blocks are concatenated:

    [INST] user
    text <sep>text [/INST]
    <s> assistant
    text </s>

Every role but `assistant` stands between [INST] and [/INST]; the role's name
leads its block; texts of merged turns are divided by <sep>. A control string
inside a text gets a backslash in front (and one more if it has some already),
which the reader takes off again, so any text survives the round trip. The loss
mask is a list of (start, length) spans in code points over the formatted text,
one for each assistant text.

Defined cases: null text and null role count as empty; turns sort by (turn,
role, text), null turns first, so ties and repeated rows have one order; a null
conv_id is a conversation of its own; extra columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"<s>|</s>|<sep>|\[INST\]|\[/INST\]"
LEARNED = "assistant"
#: The blank keeps a text's last backslash away from the control string.
SEPARATOR = " <sep>"
CHUNK = 128


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*)({CONTROL})", r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\*)({CONTROL})", "$1$2")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    plain = unescape(role)
    halves = F.transform(F.split(plain, r"\\\\", -1), lambda part: F.replace(part, F.lit("\\n"), F.lit("\n")))
    return F.array_join(halves, "\\")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where a lambda reads it for each item."""
    return F.get(F.transform(F.array(value), body), 0)


def running_total(lengths: Column) -> Column:
    """Sum of all earlier items for each item, in chunks so that long lists stay cheap."""
    zero = F.lit(0).cast("long")
    add = lambda acc, x: acc + x

    def chunked(items: Column) -> Column:
        last = F.greatest(F.ceil(F.size(items) / CHUNK).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(items, c * CHUNK + 1, CHUNK))

    def ahead(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, zero, add))
        return F.aggregate(totals, F.array(zero), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def totals(chunks: Column, before: Column) -> Column:
        inner = lambda c, k: F.transform(c, lambda _, i: F.get(before, k) + F.aggregate(F.slice(c, 1, i), zero, add))
        return F.flatten(F.transform(chunks, inner))

    return let(lengths, lambda items: let(chunked(items), lambda chunks: let(ahead(chunks), lambda before: totals(chunks, before))))


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans array<struct<start,length>>) per conversation."""
    empty = F.lit("")
    turn = F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    collected = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    escaped = collected.select("conv_id", F.transform("turns", lambda t: F.struct(t.role.alias("role"), escape(t.text).alias("text"))).alias("turns"))
    # where blocks begin: the first turn and each change of role
    begins = F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: (i == 0) | (F.get("turns", i).role != F.get("turns", F.greatest(i - 1, F.lit(0))).role),
    )
    located = escaped.withColumn("begins", begins)
    blocks = F.transform(
        "begins",
        lambda at, k: F.struct(
            F.get("turns", at).role.alias("role"),
            F.transform(
                F.slice("turns", at + 1, F.coalesce(F.get("begins", k + 1), F.size("turns")) - at), lambda t: t.text
            ).alias("texts"),
        ),
    )
    merged = located.select("conv_id", blocks.alias("blocks"))
    learned = lambda b: b.role == LEARNED
    head = lambda b: F.concat(F.when(learned(b), "<s> ").otherwise("[INST] "), escape_role(b.role), F.lit("\n"))
    tail = lambda b: F.when(learned(b), " </s>\n").otherwise(" [/INST]\n")
    framed = merged.select(
        "conv_id",
        F.transform(
            "blocks", lambda b: F.struct(head(b).alias("head"), b.texts.alias("texts"), tail(b).alias("tail"), learned(b).alias("learned"))
        ).alias("blocks"),
    )
    block_text = lambda b: F.concat(b["head"], F.array_join(b.texts, SEPARATOR), b["tail"])
    pieces = framed.withColumn("pieces", F.transform("blocks", block_text))
    placed = pieces.withColumn("starts", running_total(F.transform("pieces", lambda p: F.length(p).cast("long"))))
    per_text = F.filter(F.arrays_zip("blocks", "starts"), lambda z: z.blocks.learned)
    spans = F.flatten(
        F.transform(
            per_text,
            lambda z: F.transform(
                F.arrays_zip(
                    running_total(F.transform(z.blocks.texts, lambda t: F.length(t).cast("long") + F.lit(len(SEPARATOR)))).alias("before"),
                    z.blocks.texts.alias("text"),
                ),
                lambda y: F.struct(
                    (z.starts + F.length(z.blocks["head"]) + y["before"]).alias("start"), F.length(y["text"]).cast("long").alias("length")
                ),
            ),
        )
    )
    return placed.select("conv_id", F.array_join("pieces", "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns (role, text) of formatted conversations, and the unescaped text under the loss mask."""
    bare = r"(?<!\\)"
    blocks = F.filter(F.split("formatted", rf" {bare}(?:\[/INST\]|</s>)\n", -1), lambda b: b != "")
    role_of = lambda b: unescape_role(F.regexp_extract(b, r"^(?:\[INST\]|<s>) ([^\n]*)\n", 1))
    texts_of = lambda b: F.split(F.substr(b, F.locate("\n", b) + 1), SEPARATOR, -1)
    read = lambda role, texts: F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))
    turns = F.flatten(F.transform(blocks, lambda b: let(role_of(b), lambda role: read(role, texts_of(b)))))
    under = F.array_join(
        F.transform("loss_spans", lambda s: unescape(F.substr("formatted", (s.start + 1).cast("int"), s.length.cast("int")))), ""
    )
    return formatted.select("conv_id", "formatted", turns.alias("turns"), under.alias("loss_text"))
