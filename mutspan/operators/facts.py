"""Code-fact tables: lookups, resolution of ids, table health."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.keys import id_part, legacy_mutant_name, normalize_id
from ..functions.scores import visibility_score
from ..functions.signatures import simple_class_name, simple_owner, wildcard_constructor_arity
from ..functions.text import first_match, join_reasons, safe
from ..session import cut_lineage
from .ordering import best_per_key, first_by


# --- owner views --------------------------------------------------------------
def owner_members(types: DataFrame, methods: DataFrame, fields: DataFrame) -> DataFrame:
    """Members of each type as rows in report order: methods by line, fields by id."""
    method_rows = methods.select(
        "type_id",
        F.lit("METHOD").alias("member_kind"),
        F.col("method_id").alias("member_id"),
        F.col("name").alias("member_name"),
        "visibility",
        F.col("begin_line").cast("long").alias("position"),
    )
    field_rows = fields.select(
        "type_id",
        F.lit("FIELD").alias("member_kind"),
        F.col("field_id").alias("member_id"),
        F.col("field_name").alias("member_name"),
        "visibility",
        F.col("field_id").cast("long").alias("position"),
    )
    return types.select("type_id", "qualified_name").join(method_rows.unionByName(field_rows), "type_id")


# --- mutants --------------------------------------------------------------------
def mutants_with_project(mutants: DataFrame, projects: DataFrame) -> DataFrame:
    return mutants.join(projects.select("project_id", F.col("name").alias("project")), "project_id", "inner")


def find_mutants(requests: DataFrame, mutants: DataFrame) -> DataFrame:
    """Mutant of each requested id: exact id, scoped legacy name, bare legacy name.

    ``mutants`` has mutant_row_id, mutant_id, project, class_name, method,
    operator. The scoped tier accepts the full or the simple class name and the
    mutant id or the operator; the alternatives are rows of one equi-join. Rows are
    dealt to all tasks before ids are taken apart: a small file is one task.
    """
    requests, mutants = requests.repartition("request_id"), mutants.repartition("mutant_row_id")
    asked = requests.select("request_id", normalize_id("mutant_id").alias("wanted")).withColumns(
        {
            "legacy": legacy_mutant_name("wanted"),
            "w_project": id_part("wanted", 0),
            "w_class": id_part("wanted", 1),
            "w_method": id_part("wanted", 2),
        }
    )
    asked = cut_lineage(asked)  # both joins read it: ids are taken apart once
    known = mutants.select(
        "mutant_row_id", F.col("mutant_id").alias("found_id"), F.col("project").alias("w_project"),
        F.col("class_name").alias("w_class"), F.col("method").alias("w_method"), F.col("operator").alias("f_operator"),
    )
    scope = ["w_project", "w_class", "w_method"]

    def smallest(rows: DataFrame, *keys: str) -> DataFrame:
        # one row per key, so that a name that many classes have multiplies nothing
        return rows.groupBy(*keys).agg(F.min(F.struct("mutant_row_id", F.col("found_id").alias("id"))).alias("hit"))

    # a request's names (and its spellings of the class) are rows that meet one table, not joins of their own
    usable = (F.col("legacy") != "") & (F.col("legacy") != F.col("wanted"))
    name = lambda c, tier: F.struct(F.col(c).alias("name"), F.lit(tier).alias("tier"))
    named = asked.withColumn("_n", F.explode(F.array_compact(F.array(name("wanted", 1), F.when(usable, name("legacy", 3))))))
    by_name = smallest(known.withColumn("name", F.col("found_id")), "name")
    hits = named.select("request_id", "_n.*").join(by_name, "name")
    scoped = asked.filter(usable & (F.col("w_project") != "") & (F.col("w_class") != "") & (F.col("w_method") != ""))
    spellings = F.explode(F.array_distinct(F.array("w_class", simple_class_name("w_class"))))
    scoped = scoped.select("request_id", "w_project", spellings.alias("w_class"), "w_method", F.col("legacy").alias("name"))
    in_scope = smallest(known.withColumn("name", F.explode(F.array_distinct(F.array("found_id", "f_operator")))), *scope, "name")
    hits = hits.select("request_id", "hit", "tier").unionByName(
        scoped.join(in_scope, [*scope, "name"]).select("request_id", "hit", F.lit(2).alias("tier"))
    )
    found = hits.select("request_id", "hit.mutant_row_id", F.col("hit.id").alias("found_id"), "tier")
    return first_by(
        found,
        ["request_id"],
        [F.col("tier"), F.col("mutant_row_id")],
    )


def with_file_links(mutants: DataFrame, links: DataFrame, files: DataFrame) -> DataFrame:
    """Original and mutant file of each mutant."""
    out = mutants.join(links, "mutant_row_id", "left")
    for side in ("original", "mutant"):
        named = files.select(
            F.col("file_id").alias(f"{side}_file_id"), F.col("path").alias(f"{side}_path"), F.col("package_name").alias(f"{side}_package")
        )
        out = out.join(named, f"{side}_file_id", "left")
    return out


def with_method_links(mutants: DataFrame, links: DataFrame, methods: DataFrame, types: DataFrame) -> DataFrame:
    """Original and mutant method of each mutant with owner type."""
    described = methods.join(types.select("type_id", "qualified_name"), "type_id", "left")
    out = mutants.join(links, "mutant_row_id", "left")
    for side in ("original", "mutant"):
        named = described.select(
            F.col("method_id").alias(f"{side}_method_id"),
            F.col("name").alias(f"{side}_method"),
            F.col("signature").alias(f"{side}_signature"),
            F.col("qualified_name").alias(f"{side}_owner"),
        )
        out = out.join(named, f"{side}_method_id", "left")
    return out


# --- calls and field accesses ------------------------------------------------------
def method_calls(calls: DataFrame, methods: DataFrame, types: DataFrame) -> DataFrame:
    """Calls with the resolved callee where known, else the raw text."""
    callee = methods.join(types.select("type_id", "qualified_name"), "type_id", "left").select(
        F.col("method_id").alias("callee_method_id"), "qualified_name", "name", "signature"
    )
    return calls.join(callee, "callee_method_id", "left").select(
        "call_id",
        "caller_method_id",
        F.coalesce("qualified_name", "callee_owner").alias("owner"),
        F.coalesce("name", "callee_method_name").alias("callee"),
        F.coalesce("signature", "callee_signature").alias("callee_signature"),
        "line_number",
    )


def field_accesses(accesses: DataFrame, fields: DataFrame, types: DataFrame) -> DataFrame:
    """Field accesses with the resolved field where known, else the raw text."""
    named = fields.join(types.select("type_id", "qualified_name"), "type_id", "left").select(
        "field_id", "qualified_name", F.col("field_name").alias("resolved_name")
    )
    return accesses.join(named, "field_id", "left").select(
        "access_id",
        "method_id",
        F.coalesce("qualified_name", "owner_type").alias("owner"),
        F.coalesce("resolved_name", "raw_field_name").alias("field"),
        "access_kind",
        "line_number",
    )


def affected_fields(accesses: DataFrame, fields: DataFrame) -> DataFrame:
    """Distinct fields that a method touches."""
    touched = accesses.select("method_id", "field_id").filter(F.col("field_id").isNotNull()).distinct()
    return touched.join(fields.select("field_id", "field_name", "visibility"), "field_id", "inner")


def call_sites(methods: DataFrame, calls: DataFrame) -> DataFrame:
    """Distinct call targets of each caller, with the caller's type: repeated calls add nothing."""
    names = methods.select(F.col("method_id").alias("callee_method_id"), F.col("name").alias("resolved_name"))
    owners = methods.select(F.col("method_id").alias("caller_method_id"), "type_id")
    return (
        calls.select("caller_method_id", "callee_method_id", "callee_method_name")
        .distinct()
        .join(owners, "caller_method_id")
        .join(names, "callee_method_id", "left")
    )


def callers_by_id(anchors: DataFrame, sites: DataFrame) -> DataFrame:
    target = anchors.select("anchor_id", "type_id")
    met = sites.join(target, [sites["type_id"] == target["type_id"], sites["callee_method_id"] == target["anchor_id"]])
    return met.select("anchor_id", F.col("caller_method_id").alias("method_id"))


def unnamed(anchors: DataFrame, methods: DataFrame) -> DataFrame:
    """Anchors that are no method row by id and name; all others are called by name wherever they are called by id."""
    return anchors.join(methods.select(F.col("method_id").alias("anchor_id"), "name"), ["anchor_id", "name"], "left_anti")


def callers_of_names(sites: DataFrame) -> DataFrame:
    """(type_id, name, method_id): methods of a type that call something of that name, resolved or raw."""
    names = F.explode(F.array_distinct(F.array("resolved_name", "callee_method_name"))).alias("name")
    return sites.select("type_id", names, F.col("caller_method_id").alias("method_id")).filter(F.col("name").isNotNull()).distinct()


def direct_callers(anchors: DataFrame, methods: DataFrame, calls: DataFrame) -> DataFrame:
    """Methods of the anchor's type that call it by id, resolved name or raw name.

    Ids and names are separate equi-joins; one OR condition would fall
    back to a nested loop. A call by id resolves to the names of the id's methods, so ids are only joined for
    anchors that are no such method by name (mostly none, which is asked before the calls are read).
    """
    sites = call_sites(methods, calls)
    named = callers_of_names(sites)
    place = F.struct("type_id", "name")
    placed = anchors.groupBy("anchor_id").agg(F.collect_set(place).alias("_at")).select("anchor_id", (F.size("_at") > 1).alias("_several"), F.explode("_at").alias("_at"))
    placed = placed.select("anchor_id", "_several", "_at.*")
    # pairs by name are the many ones: they are distinct as they are, unless one id stands for several methods
    pairs = lambda some: placed.filter(some).join(named, ["type_id", "name"]).select("anchor_id", "method_id")
    found = pairs(~F.col("_several"))
    if not placed.filter("_several").isEmpty():
        found = found.unionByName(pairs(F.col("_several")).distinct())
    loose = unnamed(anchors, methods)
    if loose.isEmpty():
        return found
    by_id = callers_by_id(loose, sites).distinct()
    covered = by_id.join(placed, "anchor_id").join(named, ["type_id", "name", "method_id"], "left_semi").select("anchor_id", "method_id")
    return found.unionByName(by_id.join(covered, ["anchor_id", "method_id"], "left_anti"))


def reader_points(anchors: DataFrame, methods: DataFrame, accesses: DataFrame, fields: DataFrame, points: Column) -> DataFrame:
    """(anchor_id, method_id, signature, points): the readers of `_readers` with the best of their points, and nothing else of them.

    A method's accesses of a field are one row before they meet the anchors, and all pairs of an anchor come
    in one partition, so that what is ranked per anchor needs no further shuffle.
    """
    open_methods = methods.filter(F.lower("visibility") != "private").select("method_id", "type_id", "signature", "visibility", "return_type")
    touching = accesses.select("method_id", "field_id", "access_kind").join(open_methods, "method_id")
    touching = touching.groupBy("type_id", "field_id", "method_id", "signature").agg(F.max(points).alias("points"))
    affected = affected_fields(accesses, fields).select(F.col("method_id").alias("anchor_id"), "field_id")
    pairs = anchors.select("anchor_id", "type_id").join(affected, "anchor_id").join(touching, ["type_id", "field_id"])
    pairs = pairs.filter(F.col("method_id") != F.col("anchor_id")).select("anchor_id", "method_id", "signature", "points").repartition("anchor_id")
    best = pairs.groupBy("anchor_id", "method_id").agg(F.max(F.struct("points", "signature")).alias("_b"))
    return best.select("anchor_id", "method_id", "_b.signature", "_b.points")


def _readers(
    anchors: DataFrame, methods: DataFrame, accesses: DataFrame, fields: DataFrame, extra: list[str], leading: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Non-private methods of the anchor's type that touch one of its fields.

    ``leading`` may cut the methods of each type and field before they meet the anchors.
    """
    owned = accesses.join(
        methods.filter(F.lower("visibility") != "private").select(
            "method_id", "type_id", "signature", "visibility", "return_type", "begin_line"
        ),
        "method_id",
    )
    touching = owned.select(
        "type_id", "field_id", "method_id", "signature", "visibility", "return_type", "begin_line", "access_kind", *extra
    ).distinct()
    if leading:
        touching = leading(touching)
    affected = affected_fields(accesses, fields).select(F.col("method_id").alias("anchor_id"), "field_id", "field_name")
    wanted = anchors.select("anchor_id", "type_id").join(affected, "anchor_id")
    return wanted.join(touching, ["type_id", "field_id"]).filter(F.col("method_id") != F.col("anchor_id"))


def uses_reason() -> Column:
    return F.concat(F.lit("uses affected field '"), F.col("field_name"), F.lit("' as "), F.lower("access_kind"))


def reads_or_writes_reason() -> Column:
    verb = F.when(F.lower(safe("access_kind")) == "read", F.lit("reads ")).otherwise(F.lit("writes "))
    return F.concat(verb, F.lit("affected field '"), F.col("field_name"), F.lit("'"))


def field_reader_reasons(anchors: DataFrame, methods: DataFrame, accesses: DataFrame, fields: DataFrame, reason: Column | None = None) -> DataFrame:
    """Why a method of the same type is tied to the anchor, one joined text per method.

    ``reason`` is the text of one access: `uses_reason` (the default) or `reads_or_writes_reason`.
    """
    reason = uses_reason() if reason is None else reason
    rows = _readers(anchors, methods, accesses, fields, []).select(
        "anchor_id", "method_id", F.struct("field_id", F.lower("access_kind").alias("k"), reason.alias("reason")).alias("r")
    )
    return rows.groupBy("anchor_id", "method_id").agg(
        join_reasons(F.transform(F.array_sort(F.collect_set("r")), lambda r: r["reason"])).alias("reasons")
    )


def propagation_candidates(anchors: DataFrame, methods: DataFrame, accesses: DataFrame, fields: DataFrame, keep: int | None = None) -> DataFrame:
    """Methods through which an affected field can be seen, scored on the query scale.

    With ``keep``, rows that cannot be among the best rows of an anchor's first ``keep`` methods are left
    out: all anchors of a type order a field's methods alike, so its first ``keep`` and one (the anchor
    itself may be among them) decide.
    """
    returns = F.lower(safe("return_type")) != "void"
    score = (
        visibility_score("visibility", fixed.VISIBILITY_QUERY)
        + F.when(F.upper("access_kind") == "READ", F.lit(80.0)).otherwise(F.lit(35.0))
        + F.when(returns, F.lit(15.0)).otherwise(F.lit(0.0))
    )

    def leading(touching: DataFrame) -> DataFrame:
        scored, group = touching.withColumn("_s", score), ["type_id", "field_id"]
        order = [F.desc("_s"), F.col("begin_line"), F.col("method_id"), F.col("line_number"), F.col("access_kind")]
        best = best_per_key(scored, [*group, "method_id"], order, 1, "_r").drop("_r")
        return best_per_key(best, group, order, keep + 1, "_r").select(*touching.columns)

    rows = _readers(anchors, methods, accesses, fields, ["line_number"], leading if keep else None)
    return rows.select(
        "anchor_id", "field_id", "field_name", "method_id", "signature", "access_kind", "line_number", "begin_line",
        score.alias("score"),
    )


# --- resolution ------------------------------------------------------------------------
LINES_PER_BIN = 64


def methods_by_line(requests: DataFrame, methods: DataFrame) -> DataFrame:
    """Method around a line: same type and name, smallest enclosing span.

    Equal spans of a name count once, by their smallest id, and so do equal lines. Spans are cut into bins
    of lines, so that a line meets the spans near it and not all of its name.
    """
    names = ["variant_id", "type_simple_name", "name"]
    bin_of = lambda c: F.floor(F.col(c) / LINES_PER_BIN)
    spans = (
        methods.filter(F.col("begin_line") <= F.col("end_line"))
        .groupBy(*names, "begin_line", "end_line").agg(F.min("method_id").alias("method_id"))
        .withColumn("_bin", F.explode(F.sequence(bin_of("begin_line"), bin_of("end_line"))))
    )
    lines = requests.select(*names, "line").distinct().withColumn("_bin", bin_of("line"))
    hits = lines.join(spans, [*names, "_bin"]).filter(F.col("line").between(F.col("begin_line"), F.col("end_line")))
    order = [F.col("end_line") - F.col("begin_line"), F.col("method_id")]
    best = first_by(hits.select(*names, "line", "method_id", "begin_line", "end_line"), [*names, "line"], order)
    return first_by(
        requests.join(best, [*names, "line"]).select("request_id", "method_id", "begin_line", "end_line"),
        ["request_id"],
        order,
    )


def constructors_by_arity(requests: DataFrame, methods: DataFrame, parameters: DataFrame) -> DataFrame:
    """Constructor by owner and argument count; the qualified owner name is preferred."""
    counts = parameters.groupBy("method_id").agg(F.count(F.lit(1)).alias("_n"))
    known = (
        methods.filter("is_constructor")
        .join(counts, "method_id", "left")
        .select("variant_id", "qualified_name", "type_simple_name", "method_id", F.coalesce("_n", F.lit(0)).alias("arity"))
    )
    asked = requests.filter((safe("owner") != "") & (F.col("arity") >= 0)).withColumn("_simple", simple_owner("owner"))

    def by(name: str, column: str, tier: int) -> DataFrame:
        # one constructor per key before the join: the smallest id wins anyway
        one = known.groupBy("variant_id", F.col(name).alias(column), "arity").agg(F.min("method_id").alias("method_id"))
        return asked.join(one, ["variant_id", column, "arity"]).select("request_id", "method_id", F.lit(tier).alias("_tier"))

    exact, short = by("qualified_name", "owner", 0), by("type_simple_name", "_simple", 1)
    best = first_by(exact.unionByName(short), ["request_id"], [F.col("_tier"), F.col("method_id")])
    return best.select("request_id", "method_id")


def resolve_callees(calls: DataFrame, methods: DataFrame, parameters: DataFrame) -> DataFrame:
    """Method id of each call: constructor arity, same file, same variant."""
    asked = calls.withColumn("arity", wildcard_constructor_arity("callee_owner", "callee_method_name", "callee_signature"))
    usable = (safe("callee_owner") != "") & (safe("callee_signature") != "")
    ctor = constructors_by_arity(
        asked.filter(usable).select(F.col("call_id").alias("request_id"), "variant_id", F.col("callee_owner").alias("owner"), "arity"),
        methods, parameters,
    ).select(F.col("request_id").alias("call_id"), F.col("method_id").alias("_ctor"))

    def lookup(keys: list[str], name: str) -> DataFrame:
        return methods.groupBy(
            *[F.col(k) for k in keys], F.col("qualified_name").alias("callee_owner"), F.col("signature").alias("callee_signature")
        ).agg(F.min("method_id").alias(name))

    names = ["callee_owner", "callee_signature"]
    return (
        asked.join(ctor, "call_id", "left")
        .join(lookup(["file_id"], "_local"), ["file_id", *names], "left")
        .join(lookup(["variant_id"], "_wide"), ["variant_id", *names], "left")
        .select(
            *calls.columns,
            F.when(usable, F.coalesce("_ctor", "_local", "_wide")).alias("resolved_method_id"),
            first_match(
                [
                    (~usable, "NONE"),
                    (F.col("_ctor").isNotNull(), "CONSTRUCTOR"),
                    (F.col("_local").isNotNull(), "FILE"),
                    (F.col("_wide").isNotNull(), "VARIANT"),
                ],
                "NONE",
            ).alias("resolved_by"),
        )
    )


def resolve_fields(accesses: DataFrame, fields: DataFrame) -> DataFrame:
    """Field id of each access: same file, then same variant."""

    def lookup(key: str, name: str) -> DataFrame:
        return fields.groupBy(
            key, F.col("qualified_name").alias("owner_type"), F.col("field_name").alias("raw_field_name")
        ).agg(F.min("field_id").alias(name))

    names = ["owner_type", "raw_field_name"]
    return (
        accesses.join(lookup("file_id", "_local"), ["file_id", *names], "left")
        .join(lookup("variant_id", "_wide"), ["variant_id", *names], "left")
        .select(*accesses.columns, F.coalesce("_local", "_wide").alias("resolved_field_id"))
    )


# --- hierarchy, imports ------------------------------------------------------------------
def type_hierarchy(types: DataFrame) -> DataFrame:
    """Edges to super class, implemented types and enclosing type."""
    parents = F.filter(
        F.concat(
            F.array(F.struct(F.lit("EXTENDS").alias("relation"), safe("super_class").alias("parent"))),
            F.transform(
                F.coalesce("implemented", F.array().cast("array<string>")),
                lambda t: F.struct(F.lit("IMPLEMENTS").alias("relation"), safe(t).alias("parent")),
            ),
            F.array(F.struct(F.lit("ENCLOSED_BY").alias("relation"), safe("enclosing").alias("parent"))),
        ),
        lambda p: p["parent"] != "",
    )
    return types.select("type_id", F.explode(parents).alias("p")).select(
        "type_id", "p.parent", "p.relation", F.lit(1).alias("distance")
    )


def candidate_imports(facts: DataFrame, links: DataFrame) -> DataFrame:
    """Import facts with their usages (the view over both tables)."""
    return links.join(facts.select("import_fact_id", "import_value", "source_kind"), "import_fact_id", "inner")


def distinct_imports(rows: DataFrame, scope: list[str]) -> DataFrame:
    return rows.groupBy(*scope, "import_value", "source_kind").agg(F.max("priority").alias("priority"))


# --- coverage and health ------------------------------------------------------------------
def missing_keys(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    return expected.select(key).distinct().join(actual.select(key), key, "left_anti")


def missing_sample(missing: DataFrame, key: str, size: int = 10) -> DataFrame:
    """First names for a message; the number of all missing keys is ``missing.count()``."""
    return missing.orderBy(key).limit(size)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def table_health(counts: DataFrame, required: list[str], core: list[str]) -> DataFrame:
    """READY, or the tables that are absent or empty although they must not be."""
    spark = counts.sparkSession
    wanted = spark.createDataFrame(
        [(t, t in core) for t in required],
        T.StructType([T.StructField("table_name", T.StringType()), T.StructField("is_core", T.BooleanType())]),
    )
    checked = wanted.join(counts, "table_name", "left").withColumn(
        "problem",
        F.when(F.col("rows").isNull(), F.lit("MISSING")).when(F.col("is_core") & (F.col("rows") == 0), F.lit("EMPTY")),
    )
    return checked.agg(
        F.when(F.count_if(F.col("problem").isNotNull()) == 0, F.lit("READY")).otherwise(F.lit("ERROR")).alias("status"),
        F.count(F.lit(1)).alias("tables_checked"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"),
        F.array_join(
            F.array_sort(
                F.collect_list(F.when(F.col("problem").isNotNull(), F.concat_ws("=", "table_name", "problem")))
            ),
            ", ",
        ).alias("problems"),
    )
