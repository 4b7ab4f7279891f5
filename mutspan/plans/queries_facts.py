"""Code facts, candidates and imports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.attribution import Targets
from ..functions.text import first_match
from ..operators import bicliques as bc
from ..operators import candidates as cd
from ..operators import facts as fc
from ..operators import imports as im
from ..operators import upserts as up
from . import views as v
from .registry import query
from .views import table


def _n(df, *cols, name="n"):
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(name))


@query(
    "P1_owner_members",
    """
SELECT type_id, count(*) AS members, count_if(kind = 'FIELD') AS fields, min(position) AS first_position, sum(member_id) AS id_sum FROM (
  SELECT type_id, 'METHOD' AS kind, method_id AS member_id, begin_line AS position FROM v_methods
  UNION ALL SELECT type_id, 'FIELD', field_id, field_id FROM v_fields) JOIN v_types USING (type_id) GROUP BY 1""",
    ("v_methods", "v_types", "v_fields"),
)
def owner_members(spark, sf):
    m = fc.owner_members(v.v_types(spark, sf), v.v_methods(spark, sf), v.v_fields(spark, sf))
    return m.groupBy("type_id").agg(
        F.count(F.lit(1)).alias("members"), F.count_if(F.col("member_kind") == "FIELD").alias("fields"),
        F.min("position").alias("first_position"), F.sum("member_id").alias("id_sum"),
    )


def _mutants(spark, sf):
    """Mutants: one per order; its method is the part with the customer's number."""
    o = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        o.alias("mutant_row_id"),
        F.concat(F.lit("P"), (o % 7).cast("string")).alias("project_id"),
        F.when(o % 3 == 0, F.concat(F.lit("p"), (o % 7).cast("string"), F.lit("::org.demo.K"), (o % 40).cast("string"), F.lit("::m::AOIS_"), o.cast("string")))
        .otherwise(F.concat(F.lit("AOIS_"), o.cast("string"))).alias("mutant_id"),
        F.concat(F.lit("p"), (o % 7).cast("string")).alias("project"),
        F.concat(F.when(o % 2 == 0, F.lit("org.demo.K")).otherwise(F.lit("K")), (o % 40).cast("string")).alias("class_name"),
        F.lit("m").alias("method"),
        F.concat(F.lit("AOIS_"), o.cast("string")).alias("operator"),
        F.col("o_custkey").alias("original_method_id"),
    )


@query(
    "J1_mutants_with_project",
    "SELECT 'p' || (o_orderkey % 7) AS project, count(*) AS n FROM orders GROUP BY 1",
)
def mutants_with_project(spark, sf):
    m = _mutants(spark, sf).drop("project")
    projects = table(spark, sf, "nation").select(
        F.concat(F.lit("P"), F.col("n_nationkey").cast("string")).alias("project_id"), F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("name")
    )
    return _n(fc.mutants_with_project(m, projects), "project")


@query(
    "J2_find_mutants",
    """
SELECT o_orderkey AS request_id, o_orderkey AS mutant_row_id, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 5 = 1 THEN 1 WHEN o_orderkey % 5 = 2 THEN 3 ELSE 2 END AS tier
FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_orderkey % 5 = 1) AND NOT (o_orderkey % 3 = 0 AND o_orderkey % 5 = 2)""",
)
def find_mutants(spark, sf):
    """Requests by full id, by bare name, and by ids that only fit the scoped tier."""
    o = F.col("o_orderkey")
    key = o.cast("string")
    full = F.concat(F.lit("p"), (o % 7).cast("string"), F.lit("::org.demo.K"), (o % 40).cast("string"), F.lit("::m::AOIS_"), key)
    wrong = F.concat(F.lit("px::org.demo.K"), (o % 40).cast("string"), F.lit("::m::AOIS_"), key)
    bare = F.concat(F.lit("AOIS_"), key)
    requests = table(spark, sf, "orders").select(
        o.alias("request_id"), F.when(o % 5 == 1, bare).when(o % 5 == 2, wrong).otherwise(full).alias("mutant_id")
    )
    return fc.find_mutants(requests, _mutants(spark, sf)).select("request_id", "mutant_row_id", "tier")


@query(
    "J3_J4_file_and_method_links",
    """
SELECT o_orderkey AS mutant_row_id, 'src/' || (o_custkey % 10) || '.java' AS original_path, CASE WHEN o_orderkey % 4 <> 0 THEN 'mut/' || (o_orderkey % 10) || '.java' END AS mutant_path,
  m.name AS original_method, t.qualified_name AS original_owner, m2.name AS mutant_method
FROM orders JOIN v_methods m ON m.method_id = o_custkey LEFT JOIN v_types t ON t.type_id = m.type_id LEFT JOIN v_methods m2 ON m2.method_id = CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey + 1 END""",
    ("v_methods", "v_types"),
)
def file_and_method_links(spark, sf):
    m = _mutants(spark, sf)
    o = F.col("mutant_row_id")
    files = table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("long").alias("file_id"),
        F.concat(F.when(F.col("n_nationkey") < 10, F.lit("src/")).otherwise(F.lit("mut/")), (F.col("n_nationkey") % 10).cast("string"), F.lit(".java")).alias("path"),
        F.lit("org.demo").alias("package_name"),
    )
    file_links = m.select("mutant_row_id", (F.col("original_method_id") % 10).alias("original_file_id"), F.when(o % 4 != 0, o % 10 + 10).alias("mutant_file_id"))
    method_links = m.select("mutant_row_id", "original_method_id", F.when(o % 4 != 0, F.col("original_method_id") + 1).alias("mutant_method_id"))
    with_files = fc.with_file_links(m.select("mutant_row_id"), file_links, files)
    return fc.with_method_links(with_files, method_links, v.v_methods(spark, sf), v.v_types(spark, sf)).select(
        "mutant_row_id", "original_path", "mutant_path", "original_method", "original_owner", "mutant_method"
    )


@query(
    "J5_method_calls",
    """
SELECT c.caller_method_id, coalesce(t.qualified_name, c.callee_owner) AS owner, coalesce(m.name, c.callee_method_name) AS callee,
  coalesce(m.signature, c.callee_signature) AS callee_signature, count(*) AS n FROM v_calls c LEFT JOIN v_methods m ON m.method_id = c.callee_method_id
LEFT JOIN v_types t ON t.type_id = m.type_id GROUP BY ALL""",
    ("v_methods", "v_types", "v_calls"),
)
def method_calls(spark, sf):
    calls = fc.method_calls(v.v_calls(spark, sf), v.v_methods(spark, sf), v.v_types(spark, sf))
    return _n(calls, "caller_method_id", "owner", "callee", "callee_signature")


@query(
    "J6_field_accesses",
    """
SELECT coalesce(t.qualified_name, x.owner_type) AS owner, coalesce(f.field_name, x.raw_field_name) AS field, access_kind, count(*) AS n FROM v_accesses x
LEFT JOIN v_fields f ON f.field_id = x.field_id LEFT JOIN v_types t ON t.type_id = f.type_id GROUP BY ALL""",
    ("v_types", "v_fields", "v_accesses"),
)
def field_accesses(spark, sf):
    return _n(fc.field_accesses(v.v_accesses(spark, sf), v.v_fields(spark, sf), v.v_types(spark, sf)), "owner", "field", "access_kind")


@query(
    "J7_affected_fields",
    "SELECT DISTINCT method_id, field_id, field_name, visibility FROM v_accesses JOIN v_fields USING (field_id)",
    ("v_fields", "v_accesses"),
)
def affected_fields(spark, sf):
    return fc.affected_fields(v.v_accesses(spark, sf), v.v_fields(spark, sf))


_CALLERS = """SELECT DISTINCT a.method_id AS anchor_id, c.caller_method_id AS method_id FROM v_calls c JOIN v_methods own ON own.method_id = c.caller_method_id
LEFT JOIN v_methods cm ON cm.method_id = c.callee_method_id JOIN v_methods a ON a.type_id = own.type_id
AND (c.callee_method_id = a.method_id OR cm.name = a.name OR c.callee_method_name = a.name)"""


@query("J8_direct_callers", _CALLERS, ("v_methods", "v_calls"))
def direct_callers(spark, sf):
    m = v.v_methods(spark, sf)
    return fc.direct_callers(cd.anchors_of(m), m, v.v_calls(spark, sf))


def _facts(spark, sf):
    m = v.v_methods(spark, sf)
    return cd.anchors_of(m), m, v.v_accesses(spark, sf), v.v_fields(spark, sf)


@query(
    "J9_field_reader_reasons",
    """
SELECT anchor_id, method_id, string_agg('uses affected field ''' || field_name || ''' as ' || lower(access_kind), '; ' ORDER BY field_id, access_kind) AS reasons
FROM v_readers GROUP BY ALL""",
    ("v_methods", "v_fields", "v_accesses", "v_readers"),
)
def field_reader_reasons(spark, sf):
    return fc.field_reader_reasons(*_facts(spark, sf))


@query(
    "J9_field_access_reasons",
    """
SELECT anchor_id, method_id, string_agg(CASE access_kind WHEN 'READ' THEN 'reads' ELSE 'writes' END || ' affected field ' || chr(39) || field_name || chr(39), '; ' ORDER BY field_id, access_kind) AS reasons
FROM v_readers GROUP BY ALL""",
    ("v_methods", "v_fields", "v_accesses", "v_readers"),
)
def field_access_reasons(spark, sf):
    return fc.field_reader_reasons(*_facts(spark, sf), fc.reads_or_writes_reason())


_PROPAGATION = """SELECT DISTINCT r.anchor_id, r.field_id, r.field_name, r.method_id, r.access_kind, x.line_number, r.begin_line,
  CASE r.visibility WHEN 'public' THEN 60.0::DOUBLE WHEN 'protected' THEN 45.0 WHEN 'package-private' THEN 35.0 ELSE 0.0 END + CASE WHEN r.access_kind = 'READ' THEN 80.0 ELSE 35.0 END
  + CASE WHEN r.return_type <> 'void' THEN 15.0 ELSE 0.0 END AS score, r.signature
FROM v_readers r JOIN v_accesses x ON x.method_id = r.method_id AND x.field_id = r.field_id AND x.access_kind = r.access_kind"""


@query(
    "J10_propagation_candidates",
    f"SELECT anchor_id, field_id, method_id, access_kind, line_number, score FROM ({_PROPAGATION})",
    ("v_methods", "v_fields", "v_accesses", "v_readers"),
)
def propagation_candidates(spark, sf):
    return fc.propagation_candidates(*_facts(spark, sf)).select("anchor_id", "field_id", "method_id", "access_kind", "line_number", "score")


@query(
    "J9_J10_field_reader_sides",
    """
WITH seen AS (
  SELECT DISTINCT m.type_id, f.field_id, f.field_name, m.method_id, m.visibility, m.return_type, x.access_kind, x.line_number
  FROM v_accesses x JOIN v_fields f USING (field_id) JOIN v_methods m USING (method_id)
), stacked AS (
  SELECT DISTINCT type_id, field_id, 'LEFT' AS side, method_id, '' AS access_kind, CAST(-1 AS BIGINT) AS line_number, 0.0::DOUBLE AS score, '' AS reason FROM seen
  UNION ALL SELECT type_id, field_id, 'RIGHT', method_id, access_kind, line_number,
    CASE visibility WHEN 'public' THEN 60.0::DOUBLE WHEN 'protected' THEN 45.0 ELSE 35.0 END + CASE WHEN access_kind = 'READ' THEN 80.0 ELSE 35.0 END + CASE WHEN return_type <> 'void' THEN 15.0 ELSE 0.0 END,
    'uses affected field ''' || field_name || ''' as ' || lower(access_kind) FROM seen WHERE visibility <> 'private'
)
SELECT type_id, field_id, side, method_id, access_kind, line_number, score, reason
FROM (SELECT *, count(DISTINCT side) OVER (PARTITION BY type_id, field_id) AS two FROM stacked) WHERE two = 2""",
    ("v_methods", "v_fields", "v_accesses"),
)
def field_reader_sides(spark, sf):
    """Both sides of every field that methods of one type share: all propagation pairs in linear size."""
    rows = bc.field_readers(v.v_methods(spark, sf), v.v_accesses(spark, sf), v.v_fields(spark, sf))
    none = {"access_kind": "", "line_number": -1, "score": 0.0, "reason": ""}
    filled = [F.coalesce(c, F.lit(x)).alias(c) for c, x in none.items()]
    return rows.select("type_id", "field_id", "side", "method_id", *filled).withColumn("line_number", F.col("line_number").cast("long"))


@query(
    "J9_J10_W14_unfolded_readers",
    f"""
SELECT p.anchor_id, p.field_id, p.method_id, p.access_kind, p.line_number, p.score, CAST(o.priority AS DOUBLE) AS priority, o.observer_kind,
  'uses affected field ''' || p.field_name || ''' as ' || lower(p.access_kind) AS reason
FROM ({_PROPAGATION}) p JOIN v_observers o ON o.anchor_id = p.anchor_id AND o.field_id = p.field_id AND o.method_id = p.method_id AND o.access_kind = p.access_kind
WHERE p.anchor_id IN (SELECT c_custkey FROM customer)""",
    ("v_methods", "v_fields", "v_accesses", "v_readers", "v_observers"),
)
def unfolded_readers(spark, sf):
    """Pairs of the methods that hold a mutant: propagation score, observer and reason from one relation."""
    rows = bc.field_readers(v.v_methods(spark, sf), v.v_accesses(spark, sf), v.v_fields(spark, sf))
    asked = table(spark, sf, "customer").select(F.col("c_custkey").alias("anchor_id"))
    columns = ["anchor_id", "field_id", "method_id", "access_kind", "line_number", "score", "priority", "observer_kind", "reason"]
    return bc.field_reader_pairs(rows, asked).select(*columns)


def _located(spark, sf):
    m = v.v_methods(spark, sf)
    return m.select("*", F.lit(1).alias("variant_id"), F.col("type_id").alias("type_simple_name"))


@query(
    "J11_method_by_line",
    """
SELECT request_id, method_id FROM (SELECT r.method_id AS request_id, m.method_id, row_number() OVER (PARTITION BY r.method_id ORDER BY m.end_line - m.begin_line, m.method_id) AS rn
FROM v_methods r JOIN v_methods m ON m.type_id = r.type_id AND m.name = r.name AND r.begin_line + 10 BETWEEN m.begin_line AND m.end_line) WHERE rn = 1""",
    ("v_methods",),
)
def method_by_line(spark, sf):
    m = _located(spark, sf)
    requests = m.select(F.col("method_id").alias("request_id"), "variant_id", "type_simple_name", "name", (F.col("begin_line") + 10).alias("line"))
    return fc.methods_by_line(requests, m).select("request_id", "method_id")


def _resolvable(spark, sf):
    """Methods with owner names; parameters follow from the signature text."""
    m = v.v_methods(spark, sf)
    known = m.select(
        "method_id", "is_constructor", "signature", F.lit(1).alias("variant_id"), (F.col("method_id") % 4).alias("file_id"),
        F.concat(F.lit("org.demo."), "type_id").alias("qualified_name"), F.regexp_replace("type_id", r"^.*\.", "").alias("type_simple_name"),
    )
    inside = F.regexp_extract("signature", r"\((.*)\)", 1)
    parameters = known.filter(inside != "").select("method_id", F.explode(F.split(inside, ",")).alias("parameter_type"))
    return known, parameters


@query(
    "J12_constructor_by_arity",
    """
SELECT request_id, coalesce(a.id, b.id) AS method_id FROM (SELECT p_partkey AS request_id, CASE WHEN p_partkey % 2 = 0 THEN 'org.demo.' || p_brand || '.' || p_type ELSE p_type END AS owner, p_partkey % 3 AS arity FROM part) r
LEFT JOIN (SELECT 'org.demo.' || type_id AS owner, method_id % 3 AS arity, min(method_id) AS id FROM v_methods WHERE is_constructor GROUP BY ALL) a USING (owner, arity)
LEFT JOIN (SELECT regexp_extract(type_id, '[^.]*$') AS simple, method_id % 3 AS arity, min(method_id) AS id FROM v_methods WHERE is_constructor GROUP BY ALL) b
  ON b.simple = regexp_extract(r.owner, '[^.]*$') AND b.arity = r.arity WHERE coalesce(a.id, b.id) IS NOT NULL""",
    ("v_methods",),
)
def constructor_by_arity(spark, sf):
    known, parameters = _resolvable(spark, sf)
    p = F.col("p_partkey")
    requests = table(spark, sf, "part").select(
        p.alias("request_id"), F.lit(1).alias("variant_id"),
        F.when(p % 2 == 0, F.concat(F.lit("org.demo."), "p_brand", F.lit("."), "p_type")).otherwise(F.col("p_type")).alias("owner"),
        (p % 3).cast("int").alias("arity"),
    )
    return fc.constructors_by_arity(requests, known, parameters)


@query(
    "J13_resolve_callees",
    """
SELECT call_id, coalesce(l.id, w.id) AS resolved_method_id, CASE WHEN l.id IS NOT NULL THEN 'FILE' WHEN w.id IS NOT NULL THEN 'VARIANT' ELSE 'NONE' END AS resolved_by
FROM (SELECT l_orderkey * 10 + l_linenumber AS call_id, l_suppkey % 4 AS file_id, m.type_id, m.signature FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2) JOIN v_methods m ON m.method_id = l_partkey) c
LEFT JOIN (SELECT method_id % 4 AS file_id, type_id, signature, min(method_id) AS id FROM v_methods GROUP BY ALL) l USING (file_id, type_id, signature)
LEFT JOIN (SELECT type_id, signature, min(method_id) AS id FROM v_methods GROUP BY ALL) w USING (type_id, signature)""",
    ("v_methods",),
)
def resolve_callees(spark, sf):
    known, parameters = _resolvable(spark, sf)
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("method_id"), F.min("l_suppkey").alias("s"))
    named = known.select("method_id", F.col("qualified_name").alias("callee_owner"), F.col("signature").alias("callee_signature"))
    calls = li.join(named, "method_id").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call_id"), F.lit(1).alias("variant_id"), (F.col("s") % 4).alias("file_id"),
        "callee_owner", F.lit("x").alias("callee_method_name"), "callee_signature",
    )
    return fc.resolve_callees(calls, known, parameters).select("call_id", "resolved_method_id", "resolved_by")


@query(
    "J14_resolve_fields",
    """
SELECT access_id, coalesce(l.id, w.id) AS resolved_field_id FROM (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS access_id, l_partkey % 4 AS file_id, 'n' || (l_suppkey % 30) AS name FROM lineitem) x
LEFT JOIN (SELECT s_suppkey % 4 AS file_id, 'n' || (s_suppkey % 40) AS name, min(s_suppkey) AS id FROM supplier GROUP BY ALL) l USING (file_id, name)
LEFT JOIN (SELECT 'n' || (s_suppkey % 40) AS name, min(s_suppkey) AS id FROM supplier GROUP BY ALL) w USING (name)""",
)
def resolve_fields(spark, sf):
    li = table(spark, sf, "lineitem")
    accesses = li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("access_id"), F.lit(1).alias("variant_id"), (F.col("l_partkey") % 4).alias("file_id"),
        F.lit("Owner").alias("owner_type"), F.concat(F.lit("n"), (F.col("l_suppkey") % 30).cast("string")).alias("raw_field_name"),
    ).distinct()
    fields = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("field_id"), F.lit(1).alias("variant_id"), (F.col("s_suppkey") % 4).alias("file_id"),
        F.lit("Owner").alias("qualified_name"), F.concat(F.lit("n"), (F.col("s_suppkey") % 40).cast("string")).alias("field_name"),
    )
    return fc.resolve_fields(accesses, fields).select("access_id", "resolved_field_id")


@query(
    "G2_type_hierarchy",
    """
SELECT relation, count(*) AS edges, count(DISTINCT parent) AS parents FROM (SELECT unnest(list_filter([{'relation': 'EXTENDS', 'parent': CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END},
  {'relation': 'IMPLEMENTS', 'parent': p_name}, {'relation': 'IMPLEMENTS', 'parent': p_brand}, {'relation': 'ENCLOSED_BY', 'parent': CASE WHEN p_size % 5 = 0 THEN p_brand ELSE '' END}],
  lambda x: x.parent <> ''), recursive := true) FROM part) GROUP BY 1""",
)
def type_hierarchy(spark, sf):
    types = table(spark, sf, "part").select(
        F.col("p_partkey").alias("type_id"), F.when(F.col("p_size") % 3 != 0, F.col("p_type")).alias("super_class"),
        F.array("p_name", "p_brand").alias("implemented"), F.when(F.col("p_size") % 5 == 0, F.col("p_brand")).alias("enclosing"),
    )
    return fc.type_hierarchy(types).groupBy("relation").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("parent").alias("parents"))


def _imports(spark, sf):
    """Import facts: one per part name; usages: one per line item."""
    li = table(spark, sf, "lineitem")
    facts = table(spark, sf, "part").select(
        F.col("p_partkey").alias("import_fact_id"), F.concat(F.lit("pkg."), F.regexp_replace("p_name", " ", ".")).alias("import_value"), F.col("p_type").alias("source_kind")
    )
    links = li.select(
        F.col("l_partkey").alias("import_fact_id"), F.col("l_suppkey").alias("file_id"),
        F.when(F.col("l_returnflag") != "A", F.col("l_orderkey") % 300).alias("method_id"), F.col("l_linestatus").alias("usage_context"),
        (F.col("l_quantity").cast("int") * 2).alias("priority"),
    )
    return fc.candidate_imports(facts, links)


_IMPORT_SQL = """SELECT l_suppkey AS file_id, CASE WHEN l_returnflag <> 'A' THEN l_orderkey % 300 END AS method_id, 'pkg.' || replace(p_name, ' ', '.') AS import_value, p_type AS source_kind,
  l_linestatus AS usage_context, CAST(l_quantity AS INT) * 2 AS priority FROM lineitem JOIN part ON p_partkey = l_partkey"""


@query("J15_candidate_imports", f"SELECT import_value, source_kind, count(*) AS n, sum(priority) AS priorities FROM ({_IMPORT_SQL}) GROUP BY ALL")
def candidate_imports(spark, sf):
    return _imports(spark, sf).groupBy("import_value", "source_kind").agg(F.count(F.lit(1)).alias("n"), F.sum("priority").alias("priorities"))


@query(
    "M10_distinct_imports",
    f"SELECT file_id, import_value, source_kind, max(priority) AS priority FROM ({_IMPORT_SQL}) WHERE method_id IS NULL GROUP BY ALL",
)
def distinct_imports(spark, sf):
    return fc.distinct_imports(_imports(spark, sf).filter(F.col("method_id").isNull()), ["file_id"])


@query(
    "M10_method_imports",
    f"SELECT method_id, import_value, source_kind, max(priority) AS priority FROM ({_IMPORT_SQL}) WHERE method_id IS NOT NULL GROUP BY ALL",
)
def method_imports(spark, sf):
    return fc.distinct_imports(_imports(spark, sf).filter(F.col("method_id").isNotNull()), ["method_id"])


_EVENTS_SQL = """SELECT o_orderkey AS event_id, 'AOIS_' || (o_custkey % 200) AS mutant_id, o_totalprice / 1000000 AS confidence FROM orders"""
_CANDS_SQL = """SELECT o_orderkey AS event_id, CASE WHEN o_orderpriority = '5-LOW' THEN 'ENTRY' ELSE 'IMPORT' END AS kind, 'fb.' || o_orderstatus || (o_orderkey % 30) AS value,
  o_orderstatus <> 'P' AS accepted, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE CAST(o_orderkey % 100 AS INT) END AS priority FROM orders"""
_ACCEPTED_SQL = f"""SELECT mutant_id, value AS import_value, 'FEEDBACK_IMPORT' AS source_kind, '' AS usage_context, CASE WHEN priority > 0 THEN priority ELSE CAST(floor(confidence * 100 + 0.5) AS INT) END AS priority,
  'MUTANT' AS scope, '' AS owner_signature, 'FEEDBACK_KB' AS origin FROM ({_CANDS_SQL}) JOIN ({_EVENTS_SQL}) USING (event_id) WHERE kind = 'IMPORT' AND accepted"""


def _accepted(spark, sf):
    o = F.col("o_orderkey")
    base = table(spark, sf, "orders")
    events = base.select(o.alias("event_id"), F.concat(F.lit("AOIS_"), (F.col("o_custkey") % 200).cast("string")).alias("mutant_id"), (F.col("o_totalprice") / 1000000).alias("confidence"))
    cands = base.select(
        o.alias("event_id"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("ENTRY")).otherwise(F.lit("IMPORT")).alias("candidate_kind"),
        F.concat(F.lit("fb."), "o_orderstatus", (o % 30).cast("string")).alias("candidate_value"),
        F.lit(None).cast("string").alias("source_kind"), F.lit(None).cast("string").alias("usage_context"),
        F.lit(None).cast("string").alias("scope_type"), F.lit(None).cast("string").alias("scope_key"),
        F.when(o % 3 == 0, F.lit(0)).otherwise((o % 100).cast("int")).alias("candidate_priority"),
        F.when(F.col("o_orderstatus") != "P", 1).otherwise(0).alias("accepted"),
    )
    return im.accepted_imports(cands, events)


@query("J16_accepted_imports", f"SELECT mutant_id, import_value, priority, count(*) AS n FROM ({_ACCEPTED_SQL}) GROUP BY ALL")
def accepted_imports(spark, sf):
    return _n(_accepted(spark, sf), "mutant_id", "import_value", "priority")


@query(
    "M1_merged_imports",
    f"""
WITH m AS (SELECT c_custkey AS c, c_nationkey AS file_id, CASE WHEN c_custkey % 2 = 0 THEN 'p::C::m()::' ELSE '' END || 'AOIS_' || c_custkey AS mutant_id FROM customer)
SELECT mutant_id, scope, owner_signature, import_value, source_kind, max(priority) AS priority FROM (
  SELECT m.mutant_id, scope, owner_signature, import_value, source_kind, priority FROM m JOIN ({_ACCEPTED_SQL}) a ON a.mutant_id = 'AOIS_' || c
  UNION ALL SELECT mutant_id, 'SOURCE_FILE', '', import_value, source_kind, priority FROM m JOIN ({_IMPORT_SQL}) i ON i.file_id = m.file_id AND i.method_id IS NULL
  UNION ALL SELECT mutant_id, 'MUTATION_METHOD', 'sig' || (c % 300), import_value, source_kind, priority FROM m JOIN ({_IMPORT_SQL}) i ON i.method_id = c % 300
  UNION ALL SELECT mutant_id, 'ENTRY_METHOD', 'sig' || e, import_value, source_kind, priority
    FROM (SELECT mutant_id, unnest([c * 7 % 300, (c * 7 + 1) % 300]) AS e FROM m) JOIN ({_IMPORT_SQL}) i ON i.method_id = e
) GROUP BY ALL""",
)
def merged_imports(spark, sf):
    all_imports = _imports(spark, sf)
    c = table(spark, sf, "customer")
    bare = F.concat(F.lit("AOIS_"), F.col("c_custkey").cast("string"))
    mutant = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("p::C::m()::"), bare)).otherwise(bare).alias("mutant_id")
    by_file = c.select(mutant, F.col("c_nationkey").cast("long").alias("file_id"))
    by_method = c.select(mutant, (F.col("c_custkey") % 300).alias("method_id"), F.concat(F.lit("sig"), (F.col("c_custkey") % 300).cast("string")).alias("signature"))
    seven = F.col("c_custkey") * 7
    entry = c.select(mutant, F.explode(F.array(seven % 300, (seven + 1) % 300)).alias("method_id"))
    entry = entry.withColumn("signature", F.concat(F.lit("sig"), F.col("method_id").cast("string")))
    # equal usages of one file or method are cut before they meet its mutants
    of_file = all_imports.filter(F.col("method_id").isNull()).groupBy("file_id", "import_value", "source_kind").agg(
        F.max("priority").alias("priority"), F.max_by("usage_context", F.struct("priority", "usage_context")).alias("usage_context"))
    of_method = all_imports.filter(F.col("method_id").isNotNull()).groupBy("method_id", "import_value", "source_kind").agg(
        F.max("priority").alias("priority"), F.max_by("usage_context", F.struct("priority", "usage_context")).alias("usage_context"))
    links = {"file": by_file, "method": by_method, "entry": entry}
    merged = im.merged_by_scope(links, of_file, of_method, im.accepted_of(c.select(mutant), _accepted(spark, sf)))
    return merged.select("mutant_id", "scope", "owner_signature", "import_value", "source_kind", "priority")


@query(
    "J17_missing_mutants",
    "SELECT CAST(o_custkey AS VARCHAR) AS name FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY'))",
)
def missing_mutants(spark, sf):
    expected = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("name"))
    actual = table(spark, sf, "customer").filter("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").cast("string").alias("name"))
    return fc.missing_keys(expected, actual, "name")


@query(
    "J17_missing_sample",
    """SELECT CAST(o_custkey AS VARCHAR) AS name FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY'))
ORDER BY 1 LIMIT 10""",
)
def missing_sample(spark, sf):
    return fc.missing_sample(missing_mutants(spark, sf), "name")


_COUNTED = ["orders", "lineitem", "part", "supplier", "customer"]


@query("A33_table_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in _COUNTED))
def table_counts(spark, sf):
    return fc.table_counts({t: table(spark, sf, t) for t in _COUNTED})


@query(
    "A34_table_health",
    f"""
SELECT 'ERROR' AS status, 6 AS tables_checked, (SELECT CAST(sum(rows) AS BIGINT) FROM ({" UNION ALL ".join(f"SELECT count(*) AS rows FROM {t}" for t in _COUNTED)})) AS total_rows, 'files=MISSING' AS problems""",
)
def table_health(spark, sf):
    counts = fc.table_counts({t: table(spark, sf, t) for t in _COUNTED})
    return fc.table_health(counts, [*_COUNTED, "files"], ["orders", "part"])


@query(
    "A34_ready_tables",
    f"""
SELECT 'READY' AS status, 5 AS tables_checked, CAST(sum(rows) AS BIGINT) AS total_rows, '' AS problems FROM ({" UNION ALL ".join(f"SELECT count(*) AS rows FROM {t}" for t in _COUNTED)})""",
)
def ready_tables(spark, sf):
    counts = fc.table_counts({t: table(spark, sf, t) for t in _COUNTED})
    return fc.table_health(counts, _COUNTED, ["orders", "part"])


@query(
    "A34_empty_core_table",
    "SELECT 'ERROR' AS status, 3 AS tables_checked, (SELECT count(*) FROM part) AS total_rows, 'orders=EMPTY' AS problems",
)
def empty_core_table(spark, sf):
    """An empty core table is an error, an empty other table is not."""
    nothing = table(spark, sf, "orders").filter("o_orderkey < 0")
    counts = fc.table_counts({"orders": nothing, "part": table(spark, sf, "part"), "notes": nothing})
    return fc.table_health(counts, ["orders", "part", "notes"], ["orders", "part"])


@query(
    "J13_constructor_calls",
    """
WITH calls AS (
  SELECT l_orderkey * 10 + l_linenumber AS call_id, p_type AS simple, CASE WHEN l_orderkey % 2 = 0 THEN 'org.demo.' || p_brand || '.' || p_type ELSE p_type END AS owner, CASE WHEN l_orderkey % 3 = 0 THEN 3 ELSE p_partkey % 3 END AS arity
  FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2) JOIN part ON p_partkey = p
)
SELECT call_id, coalesce(a.id, b.id, -1) AS resolved_method_id, CASE WHEN coalesce(a.id, b.id) IS NULL THEN 'NONE' ELSE 'CONSTRUCTOR' END AS resolved_by FROM calls
LEFT JOIN (SELECT 'org.demo.' || type_id AS owner, method_id % 3 AS arity, min(method_id) AS id FROM v_methods WHERE is_constructor GROUP BY ALL) a USING (owner, arity)
LEFT JOIN (SELECT regexp_extract(type_id, '[^.]*$') AS simple, method_id % 3 AS arity, min(method_id) AS id FROM v_methods WHERE is_constructor GROUP BY ALL) b USING (simple, arity)""",
    ("v_methods",),
)
def constructor_calls(spark, sf):
    """Calls of constructors by owner and number of arguments; some have more arguments than any constructor."""
    known, parameters = _resolvable(spark, sf)
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p_partkey"))
    o = F.col("l_orderkey")
    arity = F.when(o % 3 == 0, 3).otherwise((F.col("p_partkey") % 3).cast("int"))
    calls = li.join(table(spark, sf, "part").select("p_partkey", "p_brand", "p_type"), "p_partkey").select(
        (o * 10 + F.col("l_linenumber")).alias("call_id"), F.lit(1).alias("variant_id"), (F.col("p_partkey") % 4).alias("file_id"),
        F.when(o % 2 == 0, F.concat(F.lit("org.demo."), "p_brand", F.lit("."), "p_type")).otherwise(F.col("p_type")).alias("callee_owner"),
        F.when(o % 5 == 0, "super").otherwise("").alias("callee_method_name"),
        F.concat("p_type", F.lit("("), F.array_join(F.array_repeat(F.lit("*"), arity), ","), F.lit(")")).alias("callee_signature"),
    )
    found = fc.resolve_callees(calls, known, parameters)
    return found.select("call_id", F.coalesce("resolved_method_id", F.lit(-1).cast("long")).alias("resolved_method_id"), "resolved_by")


# --- feedback ------------------------------------------------------------------------
def _feedback(spark, sf):
    return v.v_feedback(table(spark, sf, "events"), Targets())


_DROP = """CASE WHEN NOT analysed THEN 'NO_ANALYSIS' WHEN primary_fix <> 'KNOWLEDGE_BASE' THEN 'OTHER_TARGET' WHEN confidence < 0.3::DOUBLE THEN 'LOW_CONFIDENCE'
  WHEN NOT auto_repairable THEN 'NOT_AUTO_REPAIRABLE' ELSE '' END"""


@query(
    "P2_feedback_funnel",
    f"""
SELECT count(*) AS events, count_if(r = 'NO_ANALYSIS') AS no_analysis, count_if(r = 'OTHER_TARGET') AS other_target, count_if(r = 'LOW_CONFIDENCE') AS low_confidence,
  count_if(r = 'NOT_AUTO_REPAIRABLE') AS not_auto_repairable, count_if(r = '') AS accepted FROM (SELECT {_DROP} AS r FROM v_feedback)""",
    ("v_traj", "v_feedback"),
)
def feedback_funnel(spark, sf):
    return up.funnel_counts(up.with_drop_reason(_feedback(spark, sf), min_confidence=0.3))


@query(
    "P3_feedback_imports",
    f"""
SELECT event_id, mutant_id, import_value, 95 AS priority FROM (SELECT event_id, mutant_id, unnest(suspected_imports) AS import_value FROM v_feedback WHERE {_DROP} = '')""",
    ("v_traj", "v_feedback"),
)
def feedback_imports(spark, sf):
    kept = up.with_drop_reason(_feedback(spark, sf), min_confidence=0.3).filter(F.col("drop_reason") == "")
    return im.feedback_imports(kept)


@query(
    "M6_latest_upsert",
    """
SELECT part_id, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY is_new DESC, seq DESC) AS rn FROM (
  SELECT p_partkey AS part_id, 'old' AS value, p_partkey AS seq, 0 AS is_new FROM part
  UNION ALL SELECT l_partkey, l_returnflag || l_linenumber, l_orderkey * 10 + l_linenumber, 1 FROM (SELECT DISTINCT l_partkey, l_returnflag, l_linenumber, l_orderkey FROM lineitem))) WHERE rn = 1""",
)
def latest_upsert(spark, sf):
    old = table(spark, sf, "part").select(F.col("p_partkey").alias("part_id"), F.lit("old").alias("value"), F.col("p_partkey").alias("seq"))
    li = table(spark, sf, "lineitem")
    new = li.select(F.col("l_partkey").alias("part_id"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return up.upsert_latest(old, new, ["part_id"])


_EVENT_ROWS = """SELECT *, CASE WHEN k % 3 = 0 THEN NULL ELSE event_id END AS mutant_row_id, CASE WHEN k % 4 = 0 THEN '' ELSE created_at END AS made_at FROM v_feedback"""


M7_SQL = f"""
SELECT mutant_id, root_cause, symptom, auto_repairable, action, run_id, max(confidence) AS confidence, arg_max(mutant_row_id, seq) FILTER (mutant_row_id IS NOT NULL) AS mutant_row_id,
  coalesce(arg_min(made_at, seq) FILTER (made_at <> ''), '') AS created_at FROM ({_EVENT_ROWS}) GROUP BY mutant_id, root_cause, symptom, auto_repairable, action, run_id, failure_stage, primary_fix, failure_reason"""


def event_rows(feedback):
    """Feedback with the columns of stored events; some lack row id or time."""
    k = F.col("k")
    return feedback.withColumns(
        {
            "mutant_row_id": F.when(k % 3 != 0, F.col("event_id")),
            "created_at": F.when(k % 4 == 0, F.lit("")).otherwise(F.col("created_at")),
            "why": F.lit(""),
            "signal_ledger": F.lit(None).cast("string"),
        }
    )


def event_columns(events):
    return events.select("mutant_id", "root_cause", "symptom", "auto_repairable", "action", "run_id", "confidence", "mutant_row_id", "created_at")


@query("M7_event_upsert", M7_SQL, ("v_traj", "v_feedback"))
def event_upsert(spark, sf):
    return event_columns(up.upsert_events(event_rows(_feedback(spark, sf))))


@query(
    "M8_candidate_upsert",
    """
SELECT event_id, candidate_value, max(priority) AS priority, max(support) AS support_count, max(accepted) AS accepted,
  coalesce(nullif(arg_min(t_at, seq), ''), arg_min(t_at, seq) FILTER (accepted = 1 AND t_at <> ''), '') AS accepted_at
FROM (SELECT o_custkey AS event_id, 'v' || (o_orderkey % 4) AS candidate_value, CAST(o_orderkey % 90 AS INT) AS priority, CAST(o_orderkey % 7 AS INT) AS support,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS accepted, CASE WHEN o_orderpriority = '5-LOW' THEN 'at' || o_orderkey ELSE CASE WHEN o_orderstatus = 'F' THEN 'f' || o_orderkey ELSE '' END END AS t_at, o_orderkey AS seq FROM orders) GROUP BY ALL""",
)
def candidate_upsert(spark, sf):
    o, accepted = F.col("o_orderkey"), F.col("o_orderstatus") == "F"
    at = F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("at"), o.cast("string"))).when(accepted, F.concat(F.lit("f"), o.cast("string"))).otherwise(F.lit(""))
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("event_id"), F.lit("IMPORT").alias("candidate_kind"), F.concat(F.lit("v"), (o % 4).cast("string")).alias("candidate_value"),
        F.lit("s").alias("source_kind"), F.lit("").alias("usage_context"), F.lit("MUTANT").alias("scope_type"), F.lit("").alias("scope_key"),
        (o % 90).cast("int").alias("priority"), (o % 7).cast("int").alias("support_count"), accepted.cast("int").alias("accepted"), at.alias("accepted_at"), o.alias("seq"),
    )
    return up.upsert_candidates(rows).select("event_id", "candidate_value", "priority", "support_count", "accepted", "accepted_at")


@query(
    "M9_replaced_children",
    """
SELECT parent, count(*) AS children, sum(child) AS child_sum FROM (SELECT l_orderkey AS parent, l_suppkey AS child FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
  UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority <> '5-LOW') GROUP BY 1""",
)
def replaced_children(spark, sf):
    old = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("parent"), F.col("l_suppkey").alias("child"))
    renewed = table(spark, sf, "orders").filter("o_orderstatus = 'P'")
    parents = renewed.select(F.col("o_orderkey").alias("parent"))
    new = renewed.filter("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("parent"), F.col("o_custkey").alias("child"))
    return up.replace_children(old, new, parents, "parent").groupBy("parent").agg(F.count(F.lit(1)).alias("children"), F.sum("child").alias("child_sum"))


# --- candidates ----------------------------------------------------------------------------
_DIST = ("v_methods", "v_calls", "v_edges", "v_distances")


@query("G1_call_distances", "SELECT anchor_id, method_id, distance FROM v_distances", _DIST)
def call_distances(spark, sf):
    m = v.v_methods(spark, sf)
    return cd.call_distances(cd.anchors_of(m), m, v.v_calls(spark, sf))


_ENTRY_SQL = """SELECT a.method_id AS anchor_id, m.method_id, m.signature AS entry_signature, m.begin_line, m.is_constructor, m.is_static, m.visibility, m.return_type, d.distance,
  CASE m.visibility WHEN 'public' THEN 100.0::DOUBLE WHEN 'protected' THEN 70.0 ELSE 50.0 END + CASE WHEN m.method_id = a.method_id THEN 220.0 ELSE 0.0 END
  + CASE WHEN d.distance = 1 THEN 120.0 WHEN d.distance > 1 THEN greatest(25.0, 105.0 - 18.0 * d.distance) ELSE 0.0 END
  + CASE WHEN m.is_constructor THEN 30.0 WHEN m.name = 'parse' THEN 25.0 ELSE 0.0 END + CASE WHEN m.signature = a.signature THEN 25.0 ELSE 0.0 END AS score
FROM v_methods a JOIN v_methods m ON m.type_id = a.type_id AND m.visibility <> 'private' LEFT JOIN v_distances d ON d.anchor_id = a.method_id AND d.method_id = m.method_id"""


@query(
    "W12_entry_candidates",
    f"""
SELECT anchor_id, method_id, CASE WHEN is_constructor THEN 'PUBLIC_CONSTRUCTOR' WHEN is_static THEN 'STATIC_FACTORY' ELSE 'PUBLIC_METHOD' END AS entry_kind,
  CASE visibility WHEN 'public' THEN 100.0::DOUBLE WHEN 'protected' THEN 75.0 ELSE 50.0 END AS access_score, return_type <> 'void' AS returns_value, rn = 1 AS preferred, rn AS entry_rank, score
FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, begin_line, method_id) AS rn FROM ({_ENTRY_SQL}))""",
    _DIST,
)
def entry_candidates(spark, sf):
    m = v.v_methods(spark, sf)
    anchors = cd.anchors_of(m)
    d = cd.call_distances(anchors, m, v.v_calls(spark, sf))
    return cd.entry_candidates(anchors, m, d).drop("reasons")


@query(
    "W12_best_entries",
    f"""
SELECT anchor_id, method_id, begin_line, score, CAST(rn AS INT) AS entry_rank FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, begin_line, method_id) AS rn FROM ({_ENTRY_SQL})) WHERE rn <= 3""",
    _DIST,
)
def best_entries(spark, sf):
    """The three first entries of every method, without pairing all methods of a type."""
    m = v.v_methods(spark, sf)
    anchors = cd.anchors_of(m)
    best = cd.best_entries(anchors, m, cd.call_distances(anchors, m, v.v_calls(spark, sf)), 3)
    return best.select("anchor_id", "method_id", F.col("begin_line").cast("long").alias("begin_line"), "score", "entry_rank")


_LIVE_SQL = f"""SELECT a.method_id AS anchor_id, m.method_id, m.signature AS entry_signature, m.begin_line,
  CASE m.visibility WHEN 'public' THEN 60.0::DOUBLE WHEN 'protected' THEN 45.0 ELSE 35.0 END + CASE WHEN c.method_id IS NOT NULL THEN 120.0 ELSE 0.0 END
  + CASE WHEN m.is_constructor THEN 30.0 WHEN m.name = 'parse' THEN 25.0 ELSE 0.0 END AS score,
  m.visibility || ' method in same class' || CASE WHEN c.method_id IS NOT NULL THEN '; directly calls mutated method' ELSE '' END
  || CASE WHEN m.is_constructor THEN '; constructor can shape receiver state before the mutation method' WHEN m.name = 'parse' THEN '; parse-like front door may reach the mutation method' ELSE '' END AS reasons
FROM v_methods a JOIN v_methods m ON m.type_id = a.type_id AND m.visibility <> 'private' AND m.method_id <> a.method_id LEFT JOIN ({_CALLERS}) c ON c.anchor_id = a.method_id AND c.method_id = m.method_id"""


@query("W13_live_entries", f"SELECT anchor_id, method_id, score, reasons FROM ({_LIVE_SQL})", ("v_methods", "v_calls"))
def live_entries(spark, sf):
    m = v.v_methods(spark, sf)
    return cd.live_entries(cd.anchors_of(m), m, v.v_calls(spark, sf)).select("anchor_id", "method_id", "score", "reasons")


@query(
    "W13_best_live_entries",
    f"""
SELECT anchor_id, method_id, begin_line, score, CAST(rn AS INT) AS entry_rank FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, begin_line, method_id) AS rn FROM ({_LIVE_SQL})) WHERE rn <= 3""",
    ("v_methods", "v_calls"),
)
def best_live_entries(spark, sf):
    m = v.v_methods(spark, sf)
    best = cd.best_live_entries(cd.anchors_of(m), m, v.v_calls(spark, sf), 3)
    return best.select("anchor_id", "method_id", F.col("begin_line").cast("long").alias("begin_line"), "score", "entry_rank")


_READ = ("v_methods", "v_fields", "v_accesses", "v_readers")


@query(
    "W14_field_observers",
    "SELECT anchor_id, field_id, method_id, observer_kind, CAST(priority AS DOUBLE) AS priority, access_kind FROM v_observers",
    (*_READ, "v_observers"),
)
def field_observers(spark, sf):
    return cd.field_observers(*_facts(spark, sf)).select("anchor_id", "field_id", "method_id", "observer_kind", "priority", "access_kind")


_BEST_OBS = """SELECT anchor_id, method_id, signature, CAST(priority AS DOUBLE) AS priority, field_name FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id, method_id ORDER BY priority DESC, field_id) AS rn FROM v_observers) WHERE rn = 1"""


@query("W15_best_observers", f"SELECT anchor_id, method_id, priority, field_name FROM ({_BEST_OBS})", (*_READ, "v_observers"))
def best_observers(spark, sf):
    return cd.best_observers(cd.field_observers(*_facts(spark, sf))).select("anchor_id", "method_id", "priority", "field_name")


_OBSERVABLES = f"""SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY priority DESC, src, method_id) AS observable_rank FROM (
  SELECT method_id AS anchor_id, method_id, signature, 'RETURN_VALUE' AS kind, 220.0::DOUBLE AS priority, 0 AS src FROM v_methods WHERE return_type <> 'void' AND NOT is_constructor
  UNION ALL SELECT anchor_id, method_id, signature, 'PUBLIC_METHOD_DEPENDS_ON_MUTATED_STATE', priority, 1 FROM ({_BEST_OBS})
  UNION ALL SELECT method_id, method_id, signature, 'METHOD_COMPLETION', 50.0, 2 FROM v_methods WHERE (return_type = 'void' OR is_constructor) AND method_id NOT IN (SELECT anchor_id FROM v_observers))"""


@query(
    "W16_observable_candidates",
    f"SELECT anchor_id, method_id, kind AS observable_kind, priority, observable_rank, observable_rank = 1 OR kind = 'RETURN_VALUE' AS is_primary FROM ({_OBSERVABLES})",
    (*_READ, "v_observers"),
)
def observable_candidates(spark, sf):
    anchors, m, x, f = _facts(spark, sf)
    return cd.observable_candidates(anchors, cd.best_observers(cd.field_observers(anchors, m, x, f))).select(
        "anchor_id", "method_id", "observable_kind", "priority", "observable_rank", "is_primary"
    )


@query(
    "J29_W10_witness_chains",
    f"""
SELECT anchor_id, witness_rank, entry_id, observable_id, observable_kind, score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, distance, od, hint, entry_score DESC, begin_line, entry_id, priority DESC, src, observable_id) AS witness_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY anchor_id, entry_id, osig, observable_kind ORDER BY score DESC, distance, od, hint, priority DESC, src, observable_id) AS dup FROM (
    SELECT e.anchor_id, e.method_id AS entry_id, e.distance, e.score AS entry_score, e.begin_line, o.method_id AS observable_id, o.signature AS osig, o.kind AS observable_kind, o.priority, o.src,
      CASE WHEN o.method_id = e.anchor_id THEN 0 ELSE 1 END AS od,
      CASE WHEN o.method_id = e.method_id THEN 0 WHEN o.kind = 'RETURN_VALUE' THEN 1 WHEN o.observable_rank = 1 THEN 2 ELSE 3 END AS hint,
      e.score + o.priority + CASE WHEN e.distance = 0 THEN 140.0 WHEN e.distance = 1 THEN 90.0 ELSE greatest(10.0, 60.0 - 8.0 * e.distance) END
      + CASE WHEN o.method_id = e.anchor_id THEN 160.0 ELSE 100.0 END
      + CASE WHEN e.method_id = e.anchor_id AND o.method_id = e.anchor_id THEN 80.0 WHEN o.method_id = e.method_id THEN 45.0 ELSE 0.0 END AS score
    FROM ({_ENTRY_SQL}) e JOIN ({_OBSERVABLES}) o USING (anchor_id) WHERE e.distance IS NOT NULL)) WHERE dup = 1) WHERE witness_rank <= 5""",
    ("v_methods", "v_fields", "v_accesses", "v_calls", "v_readers", "v_observers", "v_edges", "v_distances"),
)
def witness_chains(spark, sf):
    _, m, x, f = _facts(spark, sf)
    chains = cd.derive_witnesses(m, v.v_calls(spark, sf), x, f)
    return chains.select("anchor_id", "witness_rank", "entry_id", "observable_id", "observable_kind", "score")


@query(
    "W11_witness_fallback",
    f"""
SELECT e.anchor_id, e.rn AS witness_rank, e.method_id AS entry_id, o.method_id AS observable_id, o.kind AS observable_kind
FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, begin_line, method_id) AS rn FROM ({_LIVE_SQL})) e
JOIN (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY src, score DESC, field_name, begin_line, method_id) AS rn FROM (
  SELECT method_id AS anchor_id, method_id, 'RETURN_VALUE' AS kind, 220.0::DOUBLE AS score, 0 AS src, '' AS field_name, 0 AS begin_line FROM v_methods WHERE return_type <> 'void'
  UNION ALL SELECT anchor_id, method_id, 'PUBLIC_METHOD_DEPENDS_ON_MUTATED_STATE', score, 1, field_name, begin_line FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id, method_id ORDER BY score DESC, field_name, begin_line, line_number, access_kind) AS r FROM ({_PROPAGATION})) WHERE r = 1)) o
  ON o.anchor_id = e.anchor_id AND o.rn = e.rn WHERE e.rn <= 2""",
    ("v_methods", "v_fields", "v_accesses", "v_calls", "v_readers"),
)
def witness_fallback(spark, sf):
    anchors, m, x, f = _facts(spark, sf)
    entries = cd.live_entries(anchors, m, v.v_calls(spark, sf), keep=2)
    observables = cd.observables_fallback(anchors, fc.propagation_candidates(anchors, m, x, f, keep=2))
    return cd.witness_fallback(entries, observables, 2).select("anchor_id", "witness_rank", "entry_id", "observable_id", "observable_kind")


@query(
    "M11_stored_or_derived",
    """
SELECT mutant, value FROM (SELECT l_orderkey AS mutant, 's' || l_suppkey AS value FROM lineitem WHERE l_returnflag = 'R'
UNION ALL SELECT o_orderkey, 'd' || o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'))""",
)
def stored_or_derived(spark, sf):
    stored = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("mutant"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("value"))
    derived = table(spark, sf, "orders").select(F.col("o_orderkey").alias("mutant"), F.concat(F.lit("d"), F.col("o_custkey").cast("string")).alias("value"))
    return cd.stored_or_derived(stored, derived, "mutant")


@query(
    "M12_context_sections",
    """
SELECT mutant_row_id, section, count(*) AS items_total, count(*) AS items, min(key) AS first_key, max(key) AS last_key FROM (
  SELECT o_orderkey AS mutant_row_id, 'calls' AS section, CAST(call_id AS VARCHAR) AS key FROM orders JOIN v_calls ON caller_method_id = o_custkey
  UNION ALL SELECT o_orderkey, 'fields', CAST(field_id AS VARCHAR) FROM orders JOIN (SELECT DISTINCT method_id, field_id FROM v_accesses JOIN v_fields USING (field_id)) ON method_id = o_custkey
  UNION ALL SELECT o_orderkey, 'method', name FROM orders JOIN v_methods ON method_id = o_custkey) GROUP BY ALL""",
    ("v_methods", "v_fields", "v_accesses", "v_calls"),
)
def context_sections(spark, sf):
    mutants = _mutants(spark, sf).select("mutant_row_id", F.col("original_method_id").alias("method_id"))
    m, t = v.v_methods(spark, sf), v.v_types(spark, sf)
    calls = fc.method_calls(v.v_calls(spark, sf), m, t).withColumnRenamed("caller_method_id", "method_id")
    fields = fc.affected_fields(v.v_accesses(spark, sf), v.v_fields(spark, sf))
    sections = {"method": m, "calls": calls, "fields": fields}
    names = {"calls": "call_id", "fields": "field_id", "method": "name"}
    key = first_match([(F.col("section") == s, F.get_json_object("item", f"$.{c}")) for s, c in names.items()], None)
    rows = cd.context_sections(mutants, sections, "mutant_row_id", "method_id").select("mutant_row_id", "section", "items_total", key.alias("key"))
    return rows.groupBy("mutant_row_id", "section", "items_total").agg(
        F.count(F.lit(1)).alias("items"), F.min("key").alias("first_key"), F.max("key").alias("last_key")
    )
