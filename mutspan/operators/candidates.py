"""Entry, observable and witness candidates for mutated methods.

An anchor is a mutated method: anchor_id, type_id, name, signature, return_type,
is_constructor. Everything is derived once per anchor for all anchors together;
mutants of one method share the result through a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.window import WindowSpec

from ..functions import fixed
from ..functions.scores import visibility_score
from ..functions.text import first_match, join_reasons, safe
from ..session import cut_lineage
from .facts import _readers, call_sites, callers_by_id, callers_of_names, reader_points, unnamed
from .ordering import best_per_key

MAX_DISTANCE = 6


def anchors_of(methods: DataFrame) -> DataFrame:
    return methods.select(
        F.col("method_id").alias("anchor_id"), "type_id", "name", "signature", "return_type", "is_constructor"
    )


def call_distances(anchors: DataFrame, methods: DataFrame, calls: DataFrame) -> DataFrame:
    """Fewest call steps from methods of the anchor's type to the anchor, up to six.

    Breadth-first from all anchors at once. Each round only expands the nodes
    reached last; the visited pairs are written to the checkpoint folder, so the
    plan stays short and a lost executor costs one round.
    """
    owner = methods.select("method_id", "type_id")
    edges = (
        calls.filter(F.col("callee_method_id") > 0)
        .select("caller_method_id", "callee_method_id")
        .distinct()
        .join(owner.select(F.col("method_id").alias("caller_method_id"), F.col("type_id").alias("_ct")), "caller_method_id")
        .join(owner.select(F.col("method_id").alias("callee_method_id"), F.col("type_id").alias("_et")), "callee_method_id")
        .filter(F.col("_ct") == F.col("_et"))
        .select(F.col("caller_method_id").alias("caller"), F.col("callee_method_id").alias("method_id"))
    )
    edges = cut_lineage(edges)
    visited = anchors.select("anchor_id", F.col("anchor_id").alias("method_id"), F.lit(0).alias("distance"))
    frontier = visited
    for step in range(1, MAX_DISTANCE + 1):
        reached = (
            frontier.join(edges, "method_id")
            .select("anchor_id", F.col("caller").alias("method_id"))
            .distinct()
            .join(visited.select("anchor_id", "method_id"), ["anchor_id", "method_id"], "left_anti")
            .withColumn("distance", F.lit(step))
        )
        frontier = cut_lineage(reached)
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


# --- entries ------------------------------------------------------------------------
def _front_door(methods: DataFrame) -> Column:
    return first_match([(F.col("is_constructor"), 30.0), (F.col("name") == "parse", 25.0)], 0.0)


def _front_door_reason() -> Column:
    return first_match(
        [
            (F.col("is_constructor"), "constructor can shape receiver state before the mutation method"),
            (F.col("name") == "parse", "parse-like front door may reach the mutation method"),
        ],
        "",
    )


def _entry_base(methods: DataFrame) -> DataFrame:
    return methods.filter(F.lower("visibility") != "private").select(
        "method_id",
        "type_id",
        "name",
        "visibility",
        F.col("signature").alias("entry_signature"),
        "return_type",
        "is_static",
        "is_constructor",
        "begin_line",
        (visibility_score("visibility", fixed.VISIBILITY_DERIVED) + _front_door(methods)).alias("_base"),
        _front_door_reason().alias("_door"),
    )


def _entry_target(anchors: DataFrame) -> DataFrame:
    return anchors.select("anchor_id", "type_id", F.col("signature").alias("_target_signature"))


def _entry_points() -> Column:
    d = F.col("distance")
    return (
        F.col("_base")
        + F.when(F.col("method_id") == F.col("anchor_id"), F.lit(220.0)).otherwise(F.lit(0.0))
        + first_match([(d == 1, 120.0), (d > 1, F.greatest(F.lit(25.0), F.lit(105.0) - d * F.lit(18.0)))], 0.0)
        + F.when(F.col("entry_signature") == F.col("_target_signature"), F.lit(25.0)).otherwise(F.lit(0.0))
    )


def _entry_reasons() -> Column:
    d = F.col("distance")
    return join_reasons(F.array(
        F.when(F.col("method_id") == F.col("anchor_id"), F.lit("mutated method itself is directly callable")).otherwise(
            F.concat(F.col("visibility"), F.lit(" method in same class"))
        ),
        first_match(
            [
                (d == 1, "directly calls mutated method"),
                (
                    d > 1,
                    F.concat(
                        F.lit("reaches mutated method through "), d.cast("string"), F.lit(" intra-class call hops")
                    ),
                ),
            ],
            "",
        ),
        F.col("_door"),
    ))


def entry_scores(anchors: DataFrame, methods: DataFrame, distances: DataFrame, reached_only: bool = False) -> DataFrame:
    """Non-private methods of the anchor's type with their entry score.

    The part of the score that does not depend on the anchor is computed once per
    method. ``reached_only`` keeps methods that lead to the anchor: that list
    comes from the distances and never pairs all methods of a type.
    """
    base, target = _entry_base(methods), _entry_target(anchors)
    if reached_only:
        pairs = distances.join(base, "method_id").join(target.drop("type_id"), "anchor_id")
    else:
        pairs = target.join(base, "type_id").join(distances, ["anchor_id", "method_id"], "left")
    return pairs.select(
        "anchor_id", "method_id", "entry_signature", "name", "visibility", "return_type", "is_static", "is_constructor",
        "begin_line", "distance", _entry_points().alias("score"), _entry_reasons().alias("reasons"),
    )


PAIRS_PER_TASK = 1 << 18  # pairs of a result of all pairs that a task makes, where types allow it


def dealt_by_type(target: DataFrame, base: DataFrame, pairs: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """Anchors and methods, dealt by type and part of its anchors (_part), so that both meet without a shuffle of their pairs.

    A type has a part for each ``pairs`` pairs, but not more than ``parts``, as each part gets all its methods. An anchor's
    pairs of a type are in one part. The number of tasks follows the pairs, which are many more than the rows dealt.
    """
    of = lambda df, name: df.groupBy("type_id").agg(F.count(F.lit(1)).alias(name))
    made = F.col("_a") * F.col("_b")
    wanted = F.least(F.lit(parts), F.ceil(made / pairs)).cast("int").alias("_parts")
    sizes = cut_lineage(of(target, "_a").join(of(base, "_b"), "type_id").select("type_id", wanted, made.alias("_made")))
    groups, total = sizes.agg(F.sum("_parts"), F.sum("_made")).first()
    tasks = max(1, min(2 * (groups or 0), (total or 0) // PAIRS_PER_TASK))
    sizes = sizes.drop("_made")
    key = ["type_id", "_part"]
    target = target.join(sizes, "type_id").withColumn("_part", F.pmod(F.xxhash64("anchor_id"), "_parts").cast("int"))
    base = base.join(sizes, "type_id").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return target.drop("_parts").repartition(tasks, *key), base.drop("_parts").repartition(tasks, *key)


def entry_candidates(anchors: DataFrame, methods: DataFrame, distances: DataFrame) -> DataFrame:
    """Entries in stored form: kind, access score, rank, preferred flag.

    Pairs of a type are made and ranked in one task per type and part of its anchors and never shuffled; the distances
    come with the anchor. Anchors whose id stands in several types are ranked over all of them apart.
    """
    home = W.partitionBy("anchor_id")
    target = _entry_target(anchors).withColumn("_roams", F.min("type_id").over(home) != F.max("type_id").over(home))
    near = distances.filter(F.col("method_id").isNotNull()).groupBy("anchor_id", "method_id").agg(F.collect_list("distance").alias("_d"))
    near = near.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("method_id", "_d"))).alias("_near"))
    base = _entry_base(methods).select(
        "method_id", "type_id", "entry_signature", "visibility", "is_static", "is_constructor", "begin_line", "_base", "_door",
        visibility_score("visibility", fixed.VISIBILITY_ACCESS).alias("access_score"), (~F.lower(safe("return_type")).isin("", "void")).alias("returns_value"),
    )
    settled = target.filter(~F.coalesce("_roams", F.lit(False))).drop("_roams").join(near, "anchor_id", "left")
    left, right = dealt_by_type(settled, base, 1 << 21, 64)
    order = [F.desc("score"), F.col("begin_line"), F.col("method_id")]
    # rows that come nearly in order are quickly sorted
    right = right.sortWithinPartitions("type_id", "_part", F.desc("_base"), "begin_line", "method_id")
    reached = F.coalesce(F.try_element_at("_near", F.col("method_id")), F.array(F.lit(None).cast("int")))
    pairs = left.join(right, ["type_id", "_part"]).withColumn("distance", F.explode(reached))
    ranked = _entry_ranks(pairs, W.partitionBy("anchor_id", "type_id", "_part").orderBy(*order))
    roaming = target.filter("_roams").drop("_roams")
    if not roaming.isEmpty():
        met = roaming.join(base, "type_id").join(distances, ["anchor_id", "method_id"], "left")
        ranked = ranked.unionByName(_entry_ranks(met, W.partitionBy("anchor_id").orderBy(*order)))
    return ranked


def _entry_ranks(pairs: DataFrame, order: WindowSpec) -> DataFrame:
    scored = pairs.withColumns({"score": _entry_points(), "reasons": _entry_reasons()})
    return scored.withColumn("entry_rank", F.row_number().over(order)).select(
        "anchor_id",
        "method_id",
        first_match([(F.col("is_constructor"), "PUBLIC_CONSTRUCTOR"), (F.col("is_static"), "STATIC_FACTORY")], "PUBLIC_METHOD").alias("entry_kind"),
        "access_score",
        "returns_value",
        (F.col("entry_rank") == 1).alias("preferred"),
        "entry_rank",
        "score",
        "reasons",
    )


def _by_points() -> list[Column]:
    return [F.desc("score"), F.col("begin_line"), F.col("method_id")]


def _leading_methods(rows: DataFrame, keys: list[str], keep: int) -> DataFrame:
    """(keys, method_id) of the first ``keep`` methods per key; a method counts once, by its best row."""
    once = best_per_key(rows, [*keys, "method_id"], _by_points(), 1, "_r").drop("_r")
    return best_per_key(once, keys, _by_points(), keep, "_r").select(*keys, "method_id")


def _leading_callers(anchors: DataFrame, methods: DataFrame, calls: DataFrame, base: DataFrame, keep: int, on: list[str]) -> DataFrame:
    """Direct callers of each anchor that can be among its first ``keep`` callers (anchor_id, method_id).

    All methods of one type and name share their callers by name, so each name's first ``keep`` and
    one (the anchor itself may be among them) decide. Callers by id are as many as there are calls, and are asked
    for where no name leads to them.
    """
    sites = call_sites(methods, calls)
    named = callers_of_names(sites).join(base.select(*on, "begin_line", "score"), on)
    by_name = anchors.select("anchor_id", "type_id", "name").join(_leading_methods(named, ["type_id", "name"], keep + 1), ["type_id", "name"])
    found, loose = by_name.select("anchor_id", "method_id"), unnamed(anchors, methods)
    return (found if loose.isEmpty() else found.unionByName(callers_by_id(loose, sites))).distinct()


def _live_base(methods: DataFrame) -> DataFrame:
    return methods.filter(F.lower("visibility") != "private").select(
        "method_id", "type_id", F.col("signature").alias("entry_signature"), "visibility", "begin_line",
        (visibility_score("visibility", fixed.VISIBILITY_QUERY) + _front_door(methods)).alias("_base"),
        _front_door_reason().alias("_door"),
    )


def _live_points(calls_it: Column) -> Column:
    return F.col("_base") + F.when(calls_it, F.lit(120.0)).otherwise(F.lit(0.0))


def _live_reasons(calls_it: Column) -> Column:
    return join_reasons(
        F.array(
            F.concat(F.col("visibility"), F.lit(" method in same class")),
            F.when(calls_it, F.lit("directly calls mutated method")).otherwise(F.lit("")),
            F.col("_door"),
        )
    )


def live_sides(anchors: DataFrame, methods: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of all live entries, linear in methods and calls; they meet by type, see `live_pair`.

    An anchor knows its places (type, name), a method its types and the names and ids that it calls.
    """
    sites = call_sites(methods, calls)
    called = sites.groupBy(F.col("caller_method_id").alias("method_id")).agg(
        F.array_compact(F.array_distinct(F.flatten(F.collect_set(F.array("resolved_name", "callee_method_name"))))).alias("_names"),
        F.collect_set("callee_method_id").alias("_ids"),
    )
    homes = methods.groupBy("method_id").agg(F.collect_set("type_id").alias("_types"))
    place = F.struct(F.col("type_id").alias("type"), "name")
    places = anchors.groupBy("anchor_id").agg(F.collect_set(place).alias("_places"))
    target = anchors.select("anchor_id", "type_id", "name").join(places, "anchor_id")
    return target, _live_base(methods).join(homes, "method_id").join(called, "method_id", "left")


def live_pair() -> tuple[Column, Column]:
    """For an anchor and a method of one type: whether it is another method, and whether it calls the anchor."""
    calls_id = F.array_contains("_ids", F.col("anchor_id"))
    there = F.array_contains("_names", F.col("name")) | calls_id
    # an id that stands for several methods is called by what calls any of them inside its type
    anywhere = F.exists("_places", lambda p: F.array_contains("_types", p["type"]) & (F.array_contains("_names", p["name"]) | calls_id))
    calls_it = F.when(F.size("_places") == 1, there).otherwise(anywhere)
    return F.col("method_id") != F.col("anchor_id"), F.coalesce(calls_it, F.lit(False))


ANCHOR_PARTS = 8  # at most so many parts of a type's anchors, where each part gets the calls of all its methods


def live_entries(anchors: DataFrame, methods: DataFrame, calls: DataFrame, keep: int | None = None) -> DataFrame:
    """Entries on the query scale: other non-private methods, direct callers first.

    All pairs of a type go straight to the result: only the two sides are shuffled, and whether a method calls a name
    is judged once for all anchors of that name. With ``keep``, pairs that
    cannot be among an anchor's first ``keep`` are left out, and no anchor meets all methods of its type.
    """
    if keep is None:
        return _all_live_entries(*live_sides(anchors, methods, calls))
    base = _live_base(methods)
    points = base.withColumnRenamed("_base", "score")
    callers = cut_lineage(_leading_callers(anchors, methods, calls, points, keep, ["type_id", "method_id"]))
    target = anchors.select("anchor_id", "type_id")
    usual = target.join(_leading_methods(points, ["type_id"], keep + 1), "type_id").select("anchor_id", "method_id")
    pairs = target.join(usual.unionByName(callers).distinct(), "anchor_id").join(base, ["type_id", "method_id"])
    pairs = pairs.filter(F.col("method_id") != F.col("anchor_id")).join(callers.withColumn("_calls", F.lit(True)), ["anchor_id", "method_id"], "left")
    calls_it = F.coalesce("_calls", F.lit(False))
    return pairs.select(
        "anchor_id", "method_id", "entry_signature", "begin_line", _live_points(calls_it).alias("score"), _live_reasons(calls_it).alias("reasons")
    )


def _all_live_entries(target: DataFrame, base: DataFrame) -> DataFrame:
    alone = F.size("_places") == 1
    left, right = dealt_by_type(target.filter(alone).drop("_places"), base.drop("_types"), 1 << 21, ANCHOR_PARTS)
    key = ["type_id", "_part"]
    named = left.groupBy(*key, "name").agg(F.collect_list("anchor_id").alias("_anchors"))
    met = named.join(right.withColumns(_variants()), key).withColumn("_named", F.coalesce(F.array_contains("_names", F.col("name")), F.lit(False)))
    pairs = met.withColumn("anchor_id", F.explode("_anchors")).filter(F.col("method_id") != F.col("anchor_id"))
    pairs = pairs.withColumn("_calls", F.col("_named") | F.coalesce(F.array_contains("_ids", F.col("anchor_id")), F.lit(False)))
    rows = lambda df: df.select(
        "anchor_id", "method_id", "entry_signature", "begin_line", *[F.when(F.col("_calls"), F.col(f"calling_{c}")).otherwise(F.col(f"plain_{c}")).alias(c) for c in ("score", "reasons")]
    )
    several = target.filter(~alone)
    if several.isEmpty():
        return rows(pairs)
    other, calls_it = live_pair()
    return rows(pairs).unionByName(rows(several.join(base.withColumns(_variants()), "type_id").filter(other).withColumn("_calls", calls_it)))


def _variants() -> dict[str, Column]:
    return {f"{name}_{point}": f(F.lit(calls_it)) for name, calls_it in (("plain", False), ("calling", True)) for point, f in (("score", _live_points), ("reasons", _live_reasons))}


def live_variants(base: DataFrame) -> DataFrame:
    """Score and reasons of each method as an entry, for anchors that it does not call (plain) and that it calls."""
    return base.withColumns(_variants()).drop("entry_signature", "visibility", "begin_line", "_base", "_door")


def _best_of(anchors: DataFrame, base: DataFrame, special: DataFrame, keep: int, spare: int) -> DataFrame:
    """Best ``keep`` methods per anchor of a type's base scores and the anchor's own scores.

    An own score is never below the method's base score, so a method outside of
    its type's best ``keep`` (and ``spare`` that an anchor may leave out) can only
    be among an anchor's best by an own score. So no anchor meets all methods of
    its type.
    """
    leading = best_per_key(base, ["type_id"], _by_points(), keep + spare, "_r").drop("_r")
    columns = ["anchor_id", "method_id", "begin_line", "score"]
    own = special.select(*columns)
    usual = anchors.select("anchor_id", "type_id").join(leading, "type_id").select(*columns)
    if spare:
        usual = usual.filter(F.col("method_id") != F.col("anchor_id"))
    rest = usual.join(own.select("anchor_id", "method_id"), ["anchor_id", "method_id"], "left_anti")
    return best_per_key(rest.unionByName(own), ["anchor_id"], _by_points(), keep, "entry_rank")


def best_entries(anchors: DataFrame, methods: DataFrame, distances: DataFrame, keep: int) -> DataFrame:
    """First ``keep`` entries of each anchor in stored form, as `entry_candidates` ranks them."""
    open_methods = methods.filter(F.lower("visibility") != "private")
    points = visibility_score("visibility", fixed.VISIBILITY_DERIVED) + _front_door(methods)
    base = open_methods.select("type_id", "signature", "method_id", "begin_line", points.alias("score"))
    # pairs with points of their own: on a call path to the anchor, or of the anchor's signature; all of one signature gain
    # the same there, so the first of each type and signature decide
    alike = ["type_id", "signature"]
    same = anchors.select("anchor_id", *alike).join(_leading_methods(base.filter(F.col("signature").isNotNull()), alike, keep), alike)
    pairs = distances.select("anchor_id", "method_id").unionByName(same.select("anchor_id", "method_id")).distinct()
    own = entry_scores(anchors, methods, pairs.join(distances, ["anchor_id", "method_id"], "left"), reached_only=True)
    return _best_of(anchors, base.drop("signature"), own, keep, 0)


def best_live_entries(anchors: DataFrame, methods: DataFrame, calls: DataFrame, keep: int) -> DataFrame:
    """First ``keep`` entries of each anchor on the query scale, as `live_entries` scores them."""
    points = visibility_score("visibility", fixed.VISIBILITY_QUERY) + _front_door(methods)
    base = methods.filter(F.lower("visibility") != "private").select("type_id", "method_id", "begin_line", points.alias("score"))
    callers = _leading_callers(anchors, methods, calls, base, keep, ["method_id"]).filter(F.col("method_id") != F.col("anchor_id"))
    own = callers.join(base.drop("type_id"), "method_id").withColumn("score", F.col("score") + F.lit(120.0))
    return _best_of(anchors, base, own, keep, 1)


# --- observers and observables ----------------------------------------------------------
def _observing() -> tuple[Column, Column, Column]:
    """Whether a method returns something, whether it reads the field, and its priority as an observer."""
    returns = F.lower(safe("return_type")) != "void"
    reads = F.upper("access_kind") == "READ"
    priority = (
        visibility_score("visibility", fixed.VISIBILITY_DERIVED)
        + F.when(reads, F.lit(80.0)).otherwise(F.lit(35.0))
        + F.when(returns, F.lit(20.0)).otherwise(F.lit(0.0))
    )
    return returns, reads, priority


def field_observers(anchors: DataFrame, methods: DataFrame, accesses: DataFrame, fields: DataFrame) -> DataFrame:
    """Methods that touch an affected field, with observer kind and priority."""
    rows = _readers(anchors, methods, accesses, fields, [])
    returns, reads, priority = _observing()
    kind = first_match([(returns, "DIRECT_RETURN"), (reads, "INDIRECT_RETURN")], "STATE_EFFECT")
    return rows.select(
        "anchor_id", "field_id", "field_name", "method_id", F.col("signature").alias("observer_signature"), "access_kind",
        kind.alias("observer_kind"), priority.alias("priority"), F.lit(1).alias("distance"),
    )


def best_observers(observers: DataFrame) -> DataFrame:
    """Best observer link per method of each anchor; ties go to the smaller field id."""
    return observers.groupBy("anchor_id", "method_id").agg(
        F.max("priority").alias("priority"),
        F.max_by(F.struct("field_name", "observer_kind", "observer_signature"), F.struct("priority", -F.col("field_id"), "access_kind")).alias("_b"),
    ).select("anchor_id", "method_id", "priority", "_b.field_name", "_b.observer_kind", "_b.observer_signature")


OBSERVABLE = ["anchor_id", "method_id", "observable_signature", "observable_kind", "priority", "source_order"]


def _own_rows(anchors: DataFrame, kind: str, priority: float, source_order: int, **more: Column) -> DataFrame:
    """Observables that are the anchor itself, dealt by anchor: where the others lie like that, a ranking of both shuffles neither."""
    return anchors.select(
        "anchor_id", F.col("anchor_id").alias("method_id"), F.col("signature").alias("observable_signature"),
        F.lit(kind).alias("observable_kind"), F.lit(priority).alias("priority"), F.lit(source_order).alias("source_order"),
        *[c.alias(name) for name, c in more.items()],
    ).repartition("anchor_id")


def _return_values(anchors: DataFrame, constructors: bool, **more: Column) -> DataFrame:
    returns = F.lower(safe("return_type")) != "void"
    return _own_rows(anchors.filter(returns if constructors else returns & ~F.col("is_constructor")), "RETURN_VALUE", 220.0, 0, **more)


def observable_candidates(anchors: DataFrame, best: DataFrame) -> DataFrame:
    """Return value, best link per observer method, completion when there is neither.

    ``best`` comes from ``best_observers`` and is read once: whether an anchor has
    an observer is seen where its rows are ranked.
    """
    seen = best.select(
        "anchor_id", "method_id", F.col("observer_signature").alias("observable_signature"),
        F.lit("PUBLIC_METHOD_DEPENDS_ON_MUTATED_STATE").alias("observable_kind"), "priority", F.lit(1).alias("source_order"),
    )
    strong = _return_values(anchors, constructors=False).unionByName(seen)
    silent = anchors.filter((F.lower(safe("return_type")) == "void") | F.col("is_constructor"))
    weak = _own_rows(silent, "METHOD_COMPLETION", 50.0, 2)
    every = strong.unionByName(weak)
    order = W.partitionBy("anchor_id").orderBy(F.desc("priority"), "source_order", "method_id")
    observed = F.max(F.col("source_order") == 1).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    stays = (F.col("source_order") != 2) | ~F.col("_observed")
    return (
        every.withColumn("_observed", observed)
        .withColumn("observable_rank", F.count_if(stays).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)).cast("int"))
        .filter(stays)
        .drop("_observed")
        .withColumn("is_primary", (F.col("observable_rank") == 1) | (F.col("observable_kind") == "RETURN_VALUE"))
    )


def observables_fallback(anchors: DataFrame, propagation: DataFrame) -> DataFrame:
    """Observables from the query-scale propagation list: first entry per reader method."""
    order = [F.desc("score"), F.col("field_name"), F.col("begin_line"), F.col("method_id"), F.col("line_number"), F.col("access_kind")]
    first = best_per_key(propagation.repartition("anchor_id"), ["anchor_id", "method_id"], order, 1, "_r").select(
        "anchor_id", "method_id", F.col("signature").alias("observable_signature"),
        F.lit("PUBLIC_METHOD_DEPENDS_ON_MUTATED_STATE").alias("observable_kind"), F.col("score").alias("priority"),
        F.lit(1).alias("source_order"), "field_name", "begin_line",
    )
    own = _return_values(anchors, constructors=True, field_name=F.lit(""), begin_line=F.lit(0))
    rank = W.partitionBy("anchor_id").orderBy("source_order", F.desc("priority"), "field_name", "begin_line", "method_id")
    return own.unionByName(first).withColumn("observable_rank", F.row_number().over(rank)).select(*OBSERVABLE, "observable_rank")


# --- witnesses --------------------------------------------------------------------------
def witness_chains(
    anchors: DataFrame, methods: DataFrame, distances: DataFrame, observables: DataFrame, keep: int = fixed.WITNESSES_PER_MUTANT
) -> DataFrame:
    """Best entry-to-observable chains per anchor.

    A chain's score is entry part + observable part, plus a bonus when both are
    one method. Chains without the bonus can only be among the best ``keep`` if
    entry and observable are each among the best ``keep`` of their kind; chains
    with the bonus come from an equi-join on the method. So the exact result
    never needs all pairs.
    """
    d = F.col("distance")
    near = first_match([(d == 0, 140.0), (d == 1, 90.0)], F.greatest(F.lit(10.0), F.lit(60.0) - d * F.lit(8.0)))
    entries = entry_scores(anchors, methods, distances, reached_only=True).select(
        "anchor_id",
        F.col("method_id").alias("entry_id"),
        "entry_signature",
        F.col("distance").alias("entry_distance"),
        F.col("score").alias("entry_score"),
        "begin_line",
        (F.col("score") + near).alias("entry_part"),
    )
    known = F.col("source_order") == 1  # rows that `observable_candidates` took from the best observers
    own = F.col("method_id") == F.col("anchor_id")
    rated = observables.select(
        "anchor_id",
        F.col("method_id").alias("observable_id"),
        "observable_signature",
        "observable_kind",
        "priority",
        "source_order",
        (F.col("priority") + first_match([(own, 160.0), (known, 100.0)], 25.0)).alias("observable_part"),
        F.when(own, F.lit(0)).otherwise(F.lit(1)).alias("observable_distance"),
        first_match([(F.col("observable_kind") == "RETURN_VALUE", 1), (F.col("is_primary"), 2)], 3).alias("hint"),
        first_match([(own, 80.0), (known, 45.0)], 90.0).alias("same_bonus"),
    )
    observable_order = [F.desc("observable_part"), F.col("observable_distance"), F.col("hint"), F.desc("priority"), F.col("source_order"), F.col("observable_id")]
    # the leading observables of an anchor and those that are its entries are marked where its rows are, and only these go on
    listed = entries.groupBy("anchor_id").agg(F.collect_set("entry_id").alias("_entries"))
    place = W.partitionBy("anchor_id").orderBy(*observable_order)
    rated = (
        rated.join(listed, "anchor_id")
        .withColumn("_met", F.array_contains("_entries", F.col("observable_id")))
        .drop("_entries")
        .withColumn("_first", F.row_number().over(W.partitionBy("anchor_id", "observable_signature", "observable_kind").orderBy(*observable_order)) == 1)
        .withColumn("_top", F.col("_first") & (F.count_if("_first").over(place.rowsBetween(W.unboundedPreceding, W.currentRow)) <= keep))
        .filter(F.col("_top") | F.col("_met"))
    )
    rated = cut_lineage(rated)
    top_entries = best_per_key(
        entries, ["anchor_id"],
        [F.desc("entry_part"), F.col("entry_distance"), F.desc("entry_score"), F.col("begin_line"), F.col("entry_id")], keep, "_r",
    ).drop("_r")
    apart = top_entries.join(rated.filter("_top").drop("_top", "_first", "_met"), "anchor_id").filter(F.col("entry_id") != F.col("observable_id"))
    met = rated.filter("_met").drop("_top", "_first", "_met")
    joined = entries.join(met, [entries["anchor_id"] == met["anchor_id"], entries["entry_id"] == met["observable_id"]]).drop(met["anchor_id"])
    chains = (
        apart.withColumn("score", F.col("entry_part") + F.col("observable_part"))
        .unionByName(
            joined.withColumn("score", F.col("entry_part") + F.col("observable_part") + F.col("same_bonus")).withColumn("hint", F.lit(0))
        )
    )
    order = [
        F.desc("score"), F.col("entry_distance"), F.col("observable_distance"), F.col("hint"), F.desc("entry_score"),
        F.col("begin_line"), F.col("entry_id"), F.desc("priority"), F.col("source_order"), F.col("observable_id"),
    ]
    unique = best_per_key(chains, ["anchor_id", "entry_id", "observable_signature", "observable_kind"], order, 1, "_r").drop("_r")
    return best_per_key(unique, ["anchor_id"], order, keep, "witness_rank").select(
        "anchor_id", "witness_rank", "entry_id", "entry_signature", "observable_id", "observable_kind", "score",
        "entry_distance", "observable_distance",
    )


def derive_witnesses(methods: DataFrame, calls: DataFrame, accesses: DataFrame, fields: DataFrame) -> DataFrame:
    """Witness chains of all methods from the fact tables; observables know which of them are observers."""
    anchors = anchors_of(methods)
    distances = call_distances(anchors, methods, calls)
    points = reader_points(anchors, methods, accesses, fields, _observing()[2])
    best = points.select("anchor_id", "method_id", F.col("points").alias("priority"), F.col("signature").alias("observer_signature"))
    return witness_chains(anchors, methods, distances, observable_candidates(anchors, best))


def witness_fallback(entries: DataFrame, observables: DataFrame, keep: int = 2) -> DataFrame:
    """The i-th entry with the i-th observable."""
    ranked = best_per_key(
        entries, ["anchor_id"], _by_points(), keep, "witness_rank"
    ).select("anchor_id", "witness_rank", F.col("method_id").alias("entry_id"), "entry_signature")
    seen = observables.filter(F.col("observable_rank") <= keep).select(
        "anchor_id", F.col("observable_rank").alias("witness_rank"), F.col("method_id").alias("observable_id"), "observable_kind"
    )
    return ranked.join(seen, ["anchor_id", "witness_rank"])


def stored_or_derived(stored: DataFrame, derived: DataFrame, key: str) -> DataFrame:
    """Stored candidates where a mutant has any, derived ones for the rest."""
    rest = derived.join(stored.select(key), key, "left_anti")
    return stored.unionByName(rest, allowMissingColumns=True)


# --- context -------------------------------------------------------------------------------
def context_sections(links: DataFrame, sections: dict[str, DataFrame], key: str, scope: str) -> DataFrame:
    """Everything known about each mutant, one (key, section, items_total, item) row per item.

    ``links`` has (key, scope), the sections have their items per scope. Items are JSON texts, written and
    counted once per scope however many mutants share it. The long form is the same at every size, so that
    no row or task has to hold a whole section.
    """
    stacked = None
    for name, df in sections.items():
        body = [c for c in df.columns if c != scope]
        rows = df.select(scope, F.lit(name).alias("section"), F.to_json(F.struct(*body)).alias("item"))
        stacked = rows if stacked is None else stacked.unionByName(rows)
    sizes = stacked.groupBy(scope, "section").agg(F.count(F.lit(1)).alias("_items"))
    totals = F.sum("_items").over(W.partitionBy(key, "section"))
    sized = links.filter(F.col(key).isNotNull()).select(key, scope).join(sizes, scope).withColumn("items_total", totals)
    return sized.join(stacked, [scope, "section"]).select(key, "section", "items_total", "item")
