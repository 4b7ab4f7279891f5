"""All pairs inside groups, kept as the groups' two sides.

An owner (a field of a type, a variable of a method) ties every member of its
left side to every member of its right side. The rows of the two sides are the
whole relation in linear size; pairs are unfolded only for members that are asked
for, by joins on the owner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.scores import visibility_score
from ..functions.text import first_match, safe
from .facts import affected_fields, uses_reason

LEFT, RIGHT = "LEFT", "RIGHT"
FIELD = ["type_id", "field_id"]
READER = ["field_name", "signature", "access_kind", "line_number", "begin_line", "score", "priority", "observer_kind", "reason"]


def sides(left: DataFrame, right: DataFrame, owner: list[str], member: str) -> DataFrame:
    """(owner, side, member, right's columns) of owners that have members on both sides."""
    both = left.select(*owner).distinct().join(right.select(*owner).distinct(), owner, "left_semi")
    stacked = left.select(*owner, F.lit(LEFT).alias("side"), member).unionByName(
        right.withColumn("side", F.lit(RIGHT)), allowMissingColumns=True
    )
    return stacked.join(both, owner, "left_semi")


def pairs(rows: DataFrame, owner: list[str], member: str, left_name: str, asked: DataFrame | None = None, right_asked: DataFrame | None = None) -> DataFrame:
    """Pairs (left_name, member, right's columns) of the asked members; without any, of all."""
    left = rows.filter(F.col("side") == LEFT).select(*owner, F.col(member).alias(left_name))
    right = rows.filter(F.col("side") == RIGHT).drop("side")
    if asked is not None:
        left = left.join(asked.select(left_name), left_name, "left_semi")
    if right_asked is not None:
        right = right.join(right_asked.select(member), member, "left_semi")
    return left.join(right, owner)


def field_readers(methods: DataFrame, accesses: DataFrame, fields: DataFrame) -> DataFrame:
    """Per type and field: methods that touch it, and accesses by which others can see it.

    Left are all methods of the type that touch the field; right are the accesses
    of those that are not private, with the score of a propagation candidate, the
    priority and kind of an observer, and the reason text.
    """
    touched = affected_fields(accesses, fields).select("method_id", "field_id", "field_name")
    left = touched.join(methods.select("method_id", "type_id"), "method_id")
    open_methods = methods.filter(F.lower("visibility") != "private")
    columns = ["type_id", "method_id", "signature", "visibility", "return_type", "begin_line"]
    uses = accesses.filter(F.col("field_id").isNotNull()).select("method_id", "field_id", "access_kind", "line_number").distinct()
    right = uses.join(open_methods.select(*columns), "method_id").join(fields.select("field_id", "field_name"), "field_id")
    returns, reads = F.lower(safe("return_type")) != "void", F.upper("access_kind") == "READ"
    seen = F.when(reads, F.lit(80.0)).otherwise(F.lit(35.0))
    points: Column = visibility_score("visibility", fixed.VISIBILITY_QUERY) + seen + F.when(returns, F.lit(15.0)).otherwise(F.lit(0.0))
    priority: Column = visibility_score("visibility", fixed.VISIBILITY_DERIVED) + seen + F.when(returns, F.lit(20.0)).otherwise(F.lit(0.0))
    rated = right.withColumns(
        {
            "score": points,
            "priority": priority,
            "observer_kind": first_match([(returns, "DIRECT_RETURN"), (reads, "INDIRECT_RETURN")], "STATE_EFFECT"),
            "reason": uses_reason(),
        }
    )
    return sides(left, rated.select(*FIELD, "method_id", *READER), FIELD, "method_id")


def field_reader_pairs(rows: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Anchors (anchor_id) with the accesses of other methods to their fields."""
    return pairs(rows, FIELD, "method_id", "anchor_id", asked).filter(F.col("method_id") != F.col("anchor_id"))


def definitions_and_uses(defuse: DataFrame) -> DataFrame:
    """Per method and variable: statements that define it and statements that use it."""
    owner = ["method", "variable"]
    of = lambda kind: defuse.filter(F.col("kind") == kind).select(*owner, "stmt").distinct()
    return sides(of("def"), of("use"), owner, "stmt")


def def_use_pairs(rows: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Edges from definitions to uses; asked: methods (method) whose edges are wanted."""
    wanted = rows if asked is None else rows.join(asked.select("method"), "method", "left_semi")
    return pairs(wanted, ["method", "variable"], "stmt", "def_stmt").withColumnRenamed("stmt", "use_stmt")
