"""Table-shaped graph pieces: control dependence, def-use edges, set differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import first_match, safe


def control_dependence(blocks: DataFrame, successors: DataFrame, postdom: DataFrame, marks: DataFrame) -> DataFrame:
    """Branches on which a statement depends: it post-dominates some but not all successors.

    ``marks`` has (method, node): the statements asked for. Starting from the
    post-dominator rows of the successors, only pairs that hold are ever formed,
    and only those of statements asked for meet the branches; a pair counts when
    it holds for fewer successors than the branch has.
    """
    edges = blocks.filter("tail_is_if").join(successors.select("method", "block", "succ").distinct(), ["method", "block"])
    edges = edges.withColumn("_total", F.count(F.lit(1)).over(W.partitionBy("method", "block")))
    asked = marks.select("method", F.col("node").alias("mark"))
    dominated = (
        postdom.select("method", F.col("node").alias("succ"), F.col("dominator").alias("mark"))
        .join(asked, ["method", "mark"], "left_semi")
        .distinct()
    )
    hits = (
        edges.join(dominated, ["method", "succ"])
        .groupBy("method", "mark", "block", "cond", "line", "_total")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    text = F.concat(F.lit("If("), F.col("cond"), F.lit(") @"), F.col("line").cast("string"))
    return hits.filter(F.col("_n") < F.col("_total")).select("method", "mark", "block", text.alias("dependence"))


def def_use_edges(defuse: DataFrame) -> DataFrame:
    """Definition to use edges of each variable inside a method."""
    keys = ["method", "variable"]
    defs = defuse.filter("kind = 'def'").select(*keys, F.col("stmt").alias("def_stmt")).distinct()
    uses = defuse.filter("kind = 'use'").select(*keys, F.col("stmt").alias("use_stmt")).distinct()
    return defs.join(uses, keys)


def predicate_difference(original: DataFrame, mutant: DataFrame, key: str, value: str) -> DataFrame:
    """Predicates on one side only, per key; long form, so groups may be large."""
    left = original.select(key, value).distinct().withColumn("_o", F.lit(True))
    right = mutant.select(key, value).distinct().withColumn("_m", F.lit(True))
    return (
        left.join(right, [key, value], "full_outer")
        .filter(F.col("_o").isNull() | F.col("_m").isNull())
        .select(key, value, first_match([(F.col("_m").isNull(), "ORIGINAL_ONLY")], "MUTANT_ONLY").alias("side"))
    )


def changed_keys(original: DataFrame, mutant: DataFrame, key: str, value: str) -> DataFrame:
    """Whether the predicate sets of a key differ, and whether their sizes do."""
    sizes = (
        original.select(key, value).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("original_size"))
        .join(mutant.select(key, value).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("mutant_size")), key, "full_outer")
    )
    differing = predicate_difference(original, mutant, key, value).select(key).distinct().withColumn("_d", F.lit(True))
    o, m = (F.coalesce(c, F.lit(0)) for c in ("original_size", "mutant_size"))
    return sizes.join(differing, key, "left").select(
        key, o.alias("original_size"), m.alias("mutant_size"), F.coalesce("_d", F.lit(False)).alias("set_changed"), (o != m).alias("size_changed")
    )


def _plain_type(text: Column) -> Column:
    """Type text for comparison: arrays for varargs, no java.lang., no blanks; generics stay."""
    arrays = F.replace(F.replace(text, F.lit("..."), F.lit("[]")), F.lit("java.lang."), F.lit(""))
    return F.regexp_replace(arrays, r"\s+", "")


# fixed value: parts of a method text are static, return type, name, parameters; a constructor has no return type
METHOD_TEXT = r"^(static\s+)?(.+?)\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*\((.*)\)\s*$"


def _facts(signatures: DataFrame, kind: str) -> DataFrame:
    """Parsed method texts of one list, one row per key; texts that are no method fall out.

    The key is the lower-case name with its parameter texts. A list that holds
    two different texts for one key contradicts itself.
    """
    raw = F.regexp_replace(safe("raw"), r"\s+", " ")

    def part(group: int) -> Column:
        return F.regexp_extract(raw, METHOD_TEXT, group)

    parsed = signatures.filter((F.col("list_kind") == kind) & raw.rlike(METHOD_TEXT)).select(
        "group_id",
        F.concat(F.lower(part(3)), F.lit("("), _plain_type(part(4)), F.lit(")")).alias("key"),
        (part(1) != "").alias("is_static"),
        _plain_type(part(2)).alias("return_type"),
        raw.alias("raw"),
    )
    return parsed.groupBy("group_id", "key").agg(
        F.max(F.struct("raw", "is_static", "return_type")).alias(f"_{kind}"),
        (F.min("raw") != F.max("raw")).alias(f"_{kind}_conflict"),
    )


def signature_agreement(signatures: DataFrame) -> DataFrame:
    """Disagreements between the exact, public and setup lists of a group.

    Columns of the result: group_id, status, exact_methods, public_methods,
    setup_methods, errors (sorted kinds with their key).
    """
    groups = signatures.select("group_id").distinct()
    exact, public, setup = (_facts(signatures, k) for k in ("exact", "public", "setup"))
    every = exact.join(public, ["group_id", "key"], "full_outer").join(setup, ["group_id", "key"], "full_outer")

    def differs(a: str, b: str, label: str):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        return [
            F.when(both & (F.col(f"{a}.is_static") != F.col(f"{b}.is_static")), F.concat(F.lit(f"{label}_STATIC:"), F.col("key"))),
            F.when(both & (F.col(f"{a}.return_type") != F.col(f"{b}.return_type")), F.concat(F.lit(f"{label}_RETURN:"), F.col("key"))),
        ]

    conflicts = [
        F.when(F.col(f"_{k}_conflict"), F.concat(F.lit(f"{k.upper()}_CONFLICT:"), F.col("key"))) for k in ("exact", "public", "setup")
    ]
    errors = F.array_compact(
        F.array(
            *conflicts,
            F.when(F.col("_exact").isNotNull() & F.col("_public").isNull(), F.concat(F.lit("PUBLIC_MISSING:"), F.col("key"))),
            *differs("_exact", "_public", "PUBLIC"),
            F.when(F.col("_setup").isNotNull() & F.col("_public").isNull(), F.concat(F.lit("SETUP_NOT_PUBLIC:"), F.col("key"))),
            *differs("_public", "_setup", "SETUP"),
            *differs("_exact", "_setup", "SETUP_EXACT"),
        )
    )
    judged = every.withColumn("_errors", errors).groupBy("group_id").agg(
        F.count("_exact").alias("exact_methods"),
        F.count("_public").alias("public_methods"),
        F.count("_setup").alias("setup_methods"),
        F.array_sort(F.flatten(F.collect_list("_errors"))).alias("_all_errors"),
    )
    zero = F.lit(0)
    full = groups.join(judged, "group_id", "left").select(
        "group_id",
        *[F.coalesce(c, zero).alias(c) for c in ("exact_methods", "public_methods", "setup_methods")],
        F.coalesce("_all_errors", F.array().cast("array<string>")).alias("_all_errors"),
    )
    contradictory = F.exists("_all_errors", lambda e: e.contains("_CONFLICT:"))
    none = (F.col("exact_methods") == 0) & ~contradictory
    return full.select(
        "group_id",
        first_match([(none, "NOT_VERIFIED_NO_EXACT_SIGNATURES"), (F.size("_all_errors") == 0, "VERIFIED_STRICT")], "FAILED").alias("status"),
        "exact_methods",
        "public_methods",
        "setup_methods",
        F.when(none, F.array().cast("array<string>")).otherwise(F.col("_all_errors")).alias("errors"),
    )
