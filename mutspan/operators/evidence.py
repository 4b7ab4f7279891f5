"""Evidence budgets and profiles, weak-assertion screening, prompt cache hits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import fixed
from ..functions.keys import prompt_cache_key
from ..functions.text import first_match, safe
from ..session import cut_lineage

MIN_PARTIAL_CHARS = 512


def budgeted_sections(prompts: DataFrame, sections: str, limit: int, key: str = "doc_id") -> DataFrame:
    """Sections kept under a character limit, in priority order.

    ``sections`` names an array of (section_no, length, required, keep_ratio)
    structs; a prompt carries its own sections, so nothing is shuffled. Required
    sections take their room first. Of the others, a section that fits is kept
    whole; one that does not keeps max(512, room x ratio) characters, at most
    the room left. What is left depends on every earlier cut, so the running
    room is a fold over the ordered lengths.
    """
    ordered = F.array_sort(
        F.transform(
            sections,
            lambda s: F.struct(
                F.when(s["required"], 0).otherwise(1).alias("late"),
                s["section_no"].cast("long").alias("section_no"),
                s["length"].cast("long").alias("length"),
                s["keep_ratio"].cast("double").alias("keep_ratio"),
            ),
        )
    )
    start = F.struct(
        F.lit(limit).cast("long").alias("room"),
        F.array().cast("array<struct<section_no:long,length:long,kept:long>>").alias("out"),
    )

    def step(state: Column, s: Column) -> Column:
        room = state["room"]
        part = F.least(room, F.greatest(F.lit(MIN_PARTIAL_CHARS).cast("long"), F.floor(room * s["keep_ratio"])))
        kept = F.when((s["length"] <= room) | (s["late"] == 0), F.least(s["length"], room)).otherwise(part)
        item = F.struct(s["section_no"].alias("section_no"), s["length"].alias("length"), kept.alias("kept"))
        return F.struct((room - kept).alias("room"), F.concat(state["out"], F.array(item)).alias("out"))

    return (
        prompts.select(key, F.explode(F.aggregate(ordered, start, step)["out"]).alias("o"))
        .select(key, "o.*")
        .withColumn("truncated", F.col("kept") < F.col("length"))
    )


def profile_table(spark) -> DataFrame:
    """One row per action with its list limits; the table has six rows."""
    names = ["max_chars", "entry_limit", "method_limit", "field_limit", "graph_limit"]
    schema = T.StructType([T.StructField("action", T.StringType())] + [T.StructField(n, T.IntegerType()) for n in names])
    return spark.createDataFrame([(a, *v) for a, v in fixed.PROFILE_LIMITS.items()], schema)


def apply_profile(items: DataFrame, profiles: DataFrame, key: str) -> DataFrame:
    """Evidence items per key cut to the list limits of the key's action.

    ``items`` has (key, action, kind, item_no); kinds are entry, method, field,
    graph. A limit of -1 keeps all, as does an action that is null or unknown.
    """
    long = profiles.unpivot(
        ["action"], ["entry_limit", "method_limit", "field_limit", "graph_limit"], "kind", "list_limit"
    ).withColumn("kind", F.regexp_replace("kind", "_limit$", ""))
    joined = items.join(F.broadcast(long), ["action", "kind"], "left")  # six actions x four kinds
    joined = joined.fillna(-1, ["list_limit"])
    rank = W.partitionBy(key, "action", "kind").orderBy("item_no")
    return joined.withColumn("_r", F.row_number().over(rank)).filter((F.col("list_limit") < 0) | (F.col("_r") <= F.col("list_limit"))).drop("_r")


def keeps_section(action: Column, section: Column) -> Column:
    """Whether an action's profile keeps an evidence section; a null or unknown action keeps all."""
    rules = []
    for name, left_out in fixed.PROFILE_SECTIONS_LEFT_OUT.items():
        rule = ~section.isin(left_out)
        if name in fixed.PROFILE_SECTIONS_KEPT:
            rule = rule & section.isin(fixed.PROFILE_SECTIONS_KEPT[name])
        rules.append((action == name, rule))
    return first_match(rules, F.lit(True))


# --- character limit ------------------------------------------------------------------
# A leaf of an evidence object is one row. section and field name its place; a list has items
# 0, 1, ... (item_no, else -1), an object members 0, 1, ... (member and member_no, else '' and -1),
# a list in an inner object entries 0, 1, ... (sub_no, else -1). field_no counts the fields of a
# section; a section that is a list itself has field '' and field_no 0. text is the value, quoted
# tells whether JSON puts it in quotes; a null text stands for an empty list.
LEAF = ["section", "field", "field_no", "item_no", "member", "member_no", "sub_no", "text", "quoted"]
ANY = "*"
_RULE = "section string, field string, text_chars int, items int, item_chars int, members int, sub_items int, sub_chars int"


def _rules(graph: dict[str, int] | int, context: dict[str, int], plans: dict[int, list[str]], k: int, chains: tuple[int, int], everything: bool) -> list[tuple]:
    """Rows of the rule table for one set of limits; ``graph`` gives k, or k of the only sections that are cut."""
    k_of = (lambda section: graph) if isinstance(graph, int) else graph.get
    cut = lambda section: k_of(section) is not None
    rows = []
    for section, name, least, more, chars in fixed.EVIDENCE_LISTS:
        if cut(section):
            rows.append((section, name, None, least if more is None else max(least, k_of(section) + more), chars, None, None, None))
    for section, name, chars in fixed.EVIDENCE_TEXTS:
        if cut(section) or section == "codeKbContext":
            rows.append((section, name, chars, None, None, None, None, None))
    for section, name, items, chars in fixed.EVIDENCE_OBJECTS:
        if cut(section):
            rows.append((section, name, None, None, None, None, max(1, k_of(section) if items is None else items), chars))
    for name, limit, members, chars in fixed.EVIDENCE_CONTEXT_LISTS:
        rows.append(("codeKbContext", name, None, max(0, context[limit]), None, members, None, chars))
    for floor, sections in plans.items():
        size = max(floor, k)
        rows += [(s, ANY, fixed.EVIDENCE_PLAN_CHARS, size, fixed.EVIDENCE_PLAN_CHARS, None, max(1, size - 1), fixed.EVIDENCE_PLAN_CHARS) for s in sections]
    most, chars = chains
    rows.append(("alternativeChains", "", None, max(0, min(most, k)) if everything else most, chars, None, None, None))
    return rows


def profile_rules() -> list[tuple]:
    """(action, rule) rows of all actions that shorten evidence."""
    out = []
    for action, (_, entry, method, field, k) in fixed.PROFILE_LIMITS.items():
        if action != "BASELINE":
            context = {"entry": entry, "method": method, "field": field}
            out += [(action, *r) for r in _rules(k, context, fixed.EVIDENCE_PLANS, k, fixed.EVIDENCE_CHAINS, True)]
    return out


def over_rules() -> list[tuple]:
    """Rules for evidence above its character limit, the same for every action."""
    return _rules(fixed.EVIDENCE_OVER_K, fixed.EVIDENCE_OVER_CONTEXT, fixed.EVIDENCE_OVER_PLANS, 0, fixed.EVIDENCE_CHAINS_OVER, False)


def cut_text(text: Column, chars: Column) -> Column:
    """Text without outer blanks, at most ``chars`` long and then ending in dots; a null limit changes nothing."""
    bare = F.btrim(text, F.lit("".join(map(chr, range(33)))))
    cut = F.concat(F.substring(bare, F.lit(1), F.greatest(F.lit(0), chars - 3)), F.lit("..."))
    return F.when(chars.isNull(), text).when((F.length(bare) <= chars) | (chars <= 0), bare).otherwise(cut)


def _cut_leaves(leaves: DataFrame, rules: DataFrame, text: str, stays: str, on: list[str]) -> DataFrame:
    """Set ``text`` and ``stays`` of leaves to what the rules leave; a row whose ``stays`` is false is gone already."""
    plans = [s for names in fixed.EVIDENCE_PLANS.values() for s in names]
    keyed = leaves.withColumn("_field", F.when(F.col("section").isin(plans), F.lit(ANY)).otherwise(F.col("field")))
    renamed = rules.withColumnRenamed("field", "_field")
    met = keyed.join(F.broadcast(renamed), [*on, "_field"], "left")  # the rules are fixed values, a few hundred rows
    item, inner, sub = F.col("item_no") >= 0, F.col("member") != "", F.col("sub_no") >= 0
    limit = F.when(item, F.col("items")).when(sub, F.col("sub_items"))
    index = F.when(item, F.col("item_no")).otherwise(F.col("sub_no"))
    emptied = F.coalesce(limit == 0, F.lit(False)) & (index == 0) & (F.greatest("member_no", F.lit(0)) == 0)
    listed = F.coalesce(index < limit, F.lit(True))
    members = ~(item & inner) | F.coalesce(F.col("member_no") < F.col("members"), F.lit(True))
    chars = (
        F.when(item & inner, F.when(F.col("members").isNotNull() & ~sub, F.col("sub_chars")))
        .when(item, F.col("item_chars"))
        .when(inner, F.col("sub_chars"))
        .otherwise(F.col("text_chars"))
    )
    value = F.when(emptied, F.lit(None).cast("string")).when(F.col("quoted"), cut_text(F.col(text), chars)).otherwise(F.col(text))
    bare = {c: F.when(emptied, F.lit(none)).otherwise(F.col(c)) for c, none in (("member", ""), ("member_no", -1), ("sub_no", -1), ("quoted", False))}
    return met.withColumns({text: value, stays: F.col(stays) & ((listed & members) | emptied), **bare}).select(*leaves.columns)


def json_chars(text: Column) -> Column:
    """Characters that a leaf adds to the JSON text of its evidence: its value, and what opens there.

    A list, object, field or section opens at its first leaf, so the length of a
    whole object is a plain sum over its leaves, and one over any part of them.
    """
    value = F.when(text.isNull(), 0).when(F.col("quoted"), F.length(F.to_json(F.array(text))) - 2).otherwise(F.length(text))
    sub, member, item, field = F.col("sub_no"), F.col("member_no"), F.col("item_no"), F.col("field_no")
    opens_member = sub <= 0
    opens_item = opens_member & (member <= 0)
    opens_field = opens_item & (item <= 0)
    named = lambda name, first: F.length(name) + 3 + F.when(first, 2).otherwise(1)
    zero = F.lit(0)
    return (
        value
        + F.when(sub == 0, 2).when(sub > 0, 1).otherwise(zero)
        + F.when((F.col("member") != "") & opens_member, named(F.col("member"), member == 0)).otherwise(zero)
        + F.when(opens_item, F.when(item == 0, 2).when(item > 0, 1).otherwise(zero)).otherwise(zero)
        + F.when(opens_field & (F.col("field") != ""), named(F.col("field"), field == 0)).otherwise(zero)
        + F.when(opens_field & (field == 0), F.length("section") + 4).otherwise(zero)
    ).cast("long")


def _total(chars: Column) -> Column:
    """Length of the whole object: braces, and one comma less than sections."""
    return F.when(chars == 0, F.lit(2)).otherwise(chars + 1)


def capped_evidence(leaves: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(leaves that stay, one row per key: action, level, chars_before, chars).

    ``leaves`` has key, action and the leaf columns. The action's profile drops
    sections and shortens lists and texts. Where the JSON text is still above the
    action's limit (level 0: it is not), lists and texts are cut once more
    (level 1), then sections go tier by tier (levels 2 to 4) as long as the rest
    is too long. Every leaf knows its characters before and after the cut, so one
    sum per key and tier decides; no key's leaves ever meet in one row.
    """
    spark = leaves.sparkSession
    kept = leaves.filter(keeps_section(F.col("action"), F.col("section"))).withColumn("_stays", F.lit(True))
    profile = spark.createDataFrame(profile_rules(), "action string, " + _RULE)
    kept = _cut_leaves(kept, profile, "text", "_stays", ["action", "section"]).filter("_stays")
    over = spark.createDataFrame(over_rules(), _RULE)
    tier = first_match([(F.col("section").isin(names), i) for i, names in enumerate(fixed.EVIDENCE_TIERS, start=2)], 0)
    both = _cut_leaves(kept.withColumn("_cut", F.col("text")), over, "_cut", "_stays", ["section"]).withColumn("_tier", tier)

    caps = [(F.col("action") == a, limits[0]) for a, limits in fixed.PROFILE_LIMITS.items() if limits[0] > 0]
    tiers = range(2, 2 + len(fixed.EVIDENCE_TIERS))
    # a text is measured once before the cut, and after it only where the cut changed it
    measured = both.withColumn("_chars", json_chars(F.col("text")))
    same = F.col("_cut").eqNullSafe(F.col("text"))
    measured = measured.withColumn("_left", first_match([(~F.col("_stays"), F.lit(0)), (same, F.col("_chars"))], json_chars(F.col("_cut"))))
    after = F.col("_left")
    sums = measured.groupBy(key, "action").agg(
        F.sum("_chars").alias("_before"),
        F.sum(after).alias("_after"),
        *[F.sum(F.when(F.col("_tier") == t, after).otherwise(F.lit(0))).alias(f"_t{t}") for t in tiers],
    )
    cap = first_match(caps, F.lit(None).cast("int"))
    steps, left = [(F.coalesce(_total(F.col("_before")) <= cap, F.lit(True)), 0, F.col("_before"))], F.col("_after")
    for level in range(1, 2 + len(fixed.EVIDENCE_TIERS)):
        if level > 1:
            left = left - F.col(f"_t{level}")
        steps.append((_total(left) <= cap, level, left))
    levels = sums.select(
        key, "action",
        first_match([(c, n) for c, n, _ in steps], len(steps) - 1).alias("level"),
        _total(F.col("_before")).alias("chars_before"),
        _total(first_match([(c, s) for c, _, s in steps], left)).alias("chars"),
    )
    levels = cut_lineage(levels)  # one row per key; the sums need all leaves, which are made once for them and once for the rows
    marked = both.join(levels.filter("level > 0").select(key, "action", "level"), [key, "action"], "left")
    cut = F.coalesce(F.col("level") >= 1, F.lit(False))
    stays = ~cut | (F.col("_stays") & ((F.col("_tier") == 0) | (F.col("_tier") > F.col("level"))))
    rows = marked.filter(stays).withColumn("text", F.when(cut, F.col("_cut")).otherwise(F.col("text")))
    return rows.select(*leaves.columns), levels


def prioritized_rows(parts: list[DataFrame], key: str) -> DataFrame:
    """Union of row lists: earlier lists first, each row once."""
    tiers = [df.select(key).distinct().withColumn("tier", F.lit(i)) for i, df in enumerate(parts)]
    every = reduce(DataFrame.unionByName, tiers)
    return every.groupBy(key).agg(F.min("tier").alias("tier")).orderBy("tier", key)


# fixed values: shape of an assertion call, and of one that is always true
ASSERTION_CALL = r"((?:assert[A-Za-z]*|fail)\s*\([^;]*\))"
TAUTOLOGY = r"^(assertTrue\s*\((.*,)?\s*true\s*\)|assertFalse\s*\((.*,)?\s*false\s*\))$"


def screen_assertions(tests: DataFrame, text: str = "text") -> DataFrame:
    """Flags for tests that cannot tell a mutant from the original."""
    calls = F.regexp_extract_all(safe(text), F.lit(ASSERTION_CALL), F.lit(1))
    some = F.size("_calls") > 0
    return (
        tests.withColumn("_calls", calls)
        .withColumns(
            {
                "assertions": F.size("_calls"),
                "no_assertion": ~some,
                "only_tautologies": some & F.forall("_calls", lambda c: c.rlike(TAUTOLOGY)),
                "only_not_null": some & F.forall("_calls", lambda c: c.rlike(r"^assertNotNull\s*\(")),
                "only_identity": some & F.forall("_calls", lambda c: c.rlike(r"^assert(Not)?Same\s*\(")),
            }
        )
        .drop("_calls")
    )


def with_cache_key(prompts: DataFrame, namespace: str) -> DataFrame:
    return prompts.withColumn("cache_key", prompt_cache_key(F.lit(namespace), "prompt"))


def cache_misses(prompts: DataFrame, cache: DataFrame, namespace: str, order: str) -> DataFrame:
    """One request per distinct prompt that the cache does not hold yet."""
    keyed = with_cache_key(prompts, namespace)
    fresh = keyed.join(cache.select("cache_key"), "cache_key", "left_anti")
    return fresh.groupBy("cache_key").agg(F.min(order).alias("first_request"), F.count(F.lit(1)).alias("requests"))


def cache_hits(prompts: DataFrame, cache: DataFrame, namespace: str) -> DataFrame:
    return with_cache_key(prompts, namespace).join(cache, "cache_key", "inner")
