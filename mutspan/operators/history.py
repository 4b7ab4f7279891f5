"""Experience from earlier runs: prior state, shared-site counts, similar successes."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.context import unit
from ..functions.keys import operator_family
from ..functions.scores import relation, reward_points, similarity_score
from ..functions.status import is_true
from ..functions.text import safe
from ..session import cut_lineage
from .ordering import best_per_key, latest_by
from .trajectory import LINE

SCOPES = {
    "same_class": ["project", "class_name"],
    "same_method": ["project", "class_name", "method"],
    "same_site": ["project", "class_name", "method", "line"],
}


def prior_states(log: DataFrame, columns: list[str]) -> DataFrame:
    """Per mutant and round: the latest record that the round was allowed to see.

    Round r > 0 sees records without a round and those of rounds below r; round
    0 sees all. Records are cut to one per (mutant, round) first, so the running
    maximum goes over the few rounds of a mutant only.
    """
    round_no = F.greatest(F.lit(0), F.coalesce(F.col("outer_loop_round"), F.lit(0)))
    newest = (
        log.withColumn("round", round_no)
        .groupBy("mutant_id", "round")
        .agg(F.max(F.struct(LINE, *columns)).alias("_r"))
    )
    mutant = W.partitionBy("mutant_id")
    earlier = mutant.orderBy("round").rowsBetween(W.unboundedPreceding, -1)
    seen = newest.withColumn(
        "_prior", F.when(F.col("round") == 0, F.max("_r").over(mutant)).otherwise(F.max("_r").over(earlier))
    )
    return seen.select(
        "mutant_id",
        "round",
        F.col("_prior").isNotNull().alias("has_previous"),
        *[F.col(f"_prior.{c}").alias(f"previous_{c}") for c in [LINE, *columns]],
    )


def eligible_history(log: DataFrame, current_round: int) -> DataFrame:
    """Latest record per mutant among those that a round may see."""
    seen = log
    if current_round > 0:
        r = F.coalesce(F.col("outer_loop_round"), F.lit(0))
        seen = log.filter((r <= 0) | (r < current_round))
    return latest_by(seen, ["mutant_id"], [F.col(LINE)])


def _successful() -> Column:
    return is_true("compile_success") & is_true("original_pass") & is_true("killed")


def _counts(rows: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(f"{prefix}_processed"),
        F.count_if(is_true("compile_success")).alias(f"{prefix}_compiled"),
        F.count_if(_successful()).alias(f"{prefix}_killed"),
    )


def shared_experience(targets: DataFrame, history: DataFrame) -> DataFrame:
    """Processed, compiled and killed counts of other mutants at the same class,
    method and site, with rates.

    Counts are group totals minus the target's own record, so no pair of mutants
    is ever formed. ``history`` holds one record per mutant.
    """
    names = ["project", "class_name", "method", "line"]
    rows = history.withColumns({c: safe(c) for c in names})
    out = targets.select("mutant_id", *[safe(c).alias(c) for c in names])
    own = rows.select(
        "mutant_id",
        F.struct(*names, is_true("compile_success").alias("c"), _successful().alias("k")).alias("_own"),
    )
    out = out.join(own, "mutant_id", "left")
    for prefix, keys in SCOPES.items():
        source = rows.filter(F.col("line") != "") if prefix == "same_site" else rows
        out = out.join(_counts(source, keys, prefix), keys, "left")
        inside = F.col("_own").isNotNull()
        for k in keys:
            inside = inside & (F.col(f"_own.{k}") == F.col(k))
        if prefix == "same_site":
            inside = inside & (F.col("line") != "")
        inside = F.coalesce(inside, F.lit(False))
        minus = {"processed": inside, "compiled": inside & F.col("_own.c"), "killed": inside & F.col("_own.k")}
        out = out.withColumns(
            {
                f"{prefix}_{n}": F.coalesce(F.col(f"{prefix}_{n}"), F.lit(0)) - F.coalesce(own_part, F.lit(False)).cast("int")
                for n, own_part in minus.items()
            }
        )
    rates = {}
    for prefix in SCOPES:
        total = F.col(f"{prefix}_processed")
        for n in ("compiled", "killed"):
            rates[f"{prefix}_{n}_rate"] = F.when(total > 0, unit(F.col(f"{prefix}_{n}") / total)).otherwise(F.lit(0.0))
    return out.withColumns(rates).drop("_own")


TRAITS = ["operator", "observable", "entry_kind", "invocation"]


def _scope_keys(scope: str) -> Column:
    """Keys of one scope for all attribute combinations that can decide similarity."""
    sep = "\x01"
    operator = {"op": [F.col("operator")], "family": [operator_family("operator")], "any": []}
    items = []
    for (op, op_cols), mask in product(operator.items(), product((0, 1), repeat=3)):
        traits = [F.col(c) for c, used in zip(("observable", "entry_kind", "invocation"), mask) if used]
        label = f"{op}{sep}{''.join(map(str, mask))}"
        items.append(F.concat_ws(sep, F.lit(label), *[F.col(k) for k in SCOPES[scope]], *op_cols, *traits))
    return F.array(*items)


def _references_in_scope(targets: DataFrame, refs: DataFrame, scope: str, names: list[str], keep: int) -> DataFrame:
    """Best references per target among those that share its site, method or class."""
    by_reward = [F.desc("reward"), F.col("ref_id")]
    if scope == "same_site":  # a blank line names no site
        targets, refs = targets.filter(F.col("line") != ""), refs.filter(F.col("line") != "")
    keyed = refs.withColumn("_key", F.explode(_scope_keys(scope)))
    pairs_of_name = best_per_key(keyed, ["_key", "test_name"], by_reward, 2, "_n")
    firsts = best_per_key(pairs_of_name.filter("_n = 1"), ["_key"], by_reward, keep + 1, "_rank").drop("_rank")
    seconds = pairs_of_name.filter("_n = 2").join(firsts.select("_key", "test_name"), ["_key", "test_name"], "left_semi")
    short = firsts.unionByName(seconds).select("_key", "ref_id", "test_name", "reward", *names)
    # targets that are equal in all attributes look up the short lists once
    profile = [f"t_{c}" for c in names]
    alike = targets.select(*names).distinct().withColumn("_key", F.explode(_scope_keys(scope)))
    met = alike.select("_key", *[F.col(c).alias(t) for c, t in zip(names, profile)]).join(short, "_key").filter(F.col("ref_id").isNotNull())
    same_method = F.col("t_method") == F.col("method")
    rel = relation(same_method & (F.col("t_line") != "") & (F.col("t_line") == F.col("line")), same_method)
    scored = met.withColumn("relation", rel).withColumn(
        "similarity",
        similarity_score(
            "relation", "t_operator", "operator", "t_observable", "observable", "t_entry_kind", "entry_kind",
            "t_invocation", "invocation", "reward",
        ),
    )
    # smallest struct = highest similarity, then highest reward, then smallest id
    place = F.struct((-F.col("similarity")).alias("s"), (-F.col("reward")).alias("r"), "ref_id", "relation")
    # a target leaves out itself: so two references per name and one name more than asked for
    seen = scored.groupBy(*profile, "test_name", "ref_id").agg(F.min(place).alias("_p"))
    two = best_per_key(seen, [*profile, "test_name"], [F.col("_p")], 2, "_n")
    per_name = two.groupBy(*profile, "test_name").agg(F.array_sort(F.collect_list("_p")).alias("_two"))
    per_profile = best_per_key(per_name, profile, [F.col("_two")[0]], keep + 1, "_rank").groupBy(*profile).agg(
        F.collect_list(F.struct("test_name", "_two")).alias("_names")
    )
    own = targets.select("mutant_id", *[F.col(c).alias(t) for c, t in zip(names, profile)])
    offered = own.join(per_profile, profile).select("mutant_id", F.explode("_names").alias("_o")).select(
        "mutant_id", "_o.test_name", F.get(F.filter("_o._two", lambda p: p["ref_id"] != F.col("mutant_id")), F.lit(0)).alias("_p")
    )
    unique = offered.filter(F.col("_p").isNotNull()).groupBy("mutant_id", "test_name").agg(F.min("_p").alias("_p"))
    return best_per_key(unique, ["mutant_id"], [F.col("_p")], keep, "_rank").drop("_rank")


def similar_references(targets: DataFrame, history: DataFrame, keep: int) -> DataFrame:
    """Best ``keep`` earlier successes per target by similarity and reward.

    Similarity is a sum of points for equal attributes plus the clamped reward.
    Among references that share one combination of attributes with a target,
    the order is by reward; so only the first ``keep`` + 1 test names of each
    combination can matter (one of them may be the target's own). Targets meet
    those short lists instead of every reference of their class, and targets of
    equal attributes meet them together. Any reference
    of the same site beats all others of the method, and those beat the rest of
    the class; so wider scopes are only searched for targets that still miss
    references. Test names stay unique per target; equal scores go by reward,
    then by mutant id.
    """
    names = ["project", "class_name", "method", "line", *TRAITS]
    refs = (
        history.filter(_successful() & (safe("test_name") != "") & is_true("has_test_text"))
        .select(
            F.col("mutant_id").alias("ref_id"),
            safe("test_name").alias("test_name"),
            F.coalesce(F.col("reward").cast("double"), F.lit(0.0)).alias("reward"),
            *[safe(c).alias(c) for c in names],
        )
    )
    open_targets = targets.select("mutant_id", *[safe(c).alias(c) for c in names])
    found = None
    for scope in ("same_site", "same_method", "same_class"):
        hits = cut_lineage(_references_in_scope(open_targets, refs, scope, names, keep))
        found = hits if found is None else found.unionByName(hits)
        full = found.groupBy("mutant_id").agg(F.count_distinct("test_name").alias("_n")).filter(F.col("_n") >= keep)
        open_targets = open_targets.join(full, "mutant_id", "left_anti")
    unique = found.groupBy("mutant_id", "test_name").agg(F.min("_p").alias("_p"))
    return best_per_key(unique, ["mutant_id"], [F.col("_p")], keep, "reference_rank").select(
        "mutant_id", "reference_rank", "_p.ref_id", "test_name", "_p.relation", (-F.col("_p.s")).alias("similarity"), (-F.col("_p.r")).alias("reward")
    )


def reference_points(df: DataFrame) -> DataFrame:
    return df.withColumn("reward_points", reward_points("reward"))
