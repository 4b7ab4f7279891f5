"""The wide context of mutants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context as cx
from . import views as v
from .queries_facts import _ACCEPTED_SQL, _IMPORT_SQL, _LIVE_SQL, _accepted, _imports
from .registry import query
from .views import table


def context_facts(spark, sf):
    """Mutants: one per customer; methods: parts; stored candidates: orders of some kinds."""
    c, o, mutant = F.col("c_custkey"), F.col("o_orderkey"), F.col("o_custkey").alias("mutant_row_id")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    bare = text("AOIS_", c)
    mutants = table(spark, sf, "customer").select(
        c.alias("mutant_row_id"), F.when(c % 2 == 0, F.concat(F.lit("p::C::m()::"), bare)).otherwise(bare).alias("mutant_id"),
        text("proj", c % 5).alias("project"), text("AOIS_", c % 9).alias("operator"), (c % 100).alias("line"), F.col("c_mktsegment").alias("statement"),
        (c % 10 + 1).alias("original_file_id"), F.when(c % 4 != 0, c % 10 + 5).alias("mutant_file_id"),
        F.when(c % 50 != 49, c).alias("original_method_id"), F.when(c % 4 != 0, c + 1).alias("mutant_method_id"),
    )
    files = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("file_id"), text("src/", F.col("s_suppkey"), ".java").alias("path"), F.lit("org.demo").alias("package_name"))
    orders, status = table(spark, sf, "orders"), F.col("o_orderstatus")
    entries = orders.filter(status == "F").select(mutant, (F.col("o_custkey") + o % 5 + 1).alias("method_id"), (o % 90).cast("double").alias("priority"), "o_orderpriority")
    entries = entries.groupBy("mutant_row_id", "method_id").agg(F.max("priority").alias("priority"), text("stored ", F.min("o_orderpriority")).alias("reasons"))
    observers = orders.filter(status == "P").select(
        mutant, o.alias("id"), (o % 100 + 1).alias("field_id"), (F.col("o_custkey") + o % 3).alias("method_id"), v.pick(["DIRECT_RETURN", "STATE_EFFECT"], o % 2).alias("observer_kind"),
        F.lit(1).alias("distance"), (o % 70).cast("double").alias("priority"), text("seen ", o).alias("reasons"),
    )
    observables = orders.filter((status == "O") & (o % 3 == 0)).select(
        mutant, o.alias("id"), F.when(o % 11 != 0, F.col("o_custkey") + o % 4).alias("method_id"), v.pick(["RETURN_VALUE", "FIELD_STATE"], o % 2).alias("observable_kind"),
        text("e", o).alias("expression"), (o % 80).cast("double").alias("priority"), (o % 7 == 0).alias("is_primary"), v.pick(["why", "", "so"], o % 5 % 3).alias("reasons"),
    )
    witnesses = orders.filter((F.col("o_orderpriority") == "1-URGENT") & (o % 4 == 1)).select(
        mutant, o.alias("id"), F.col("o_custkey").alias("entry_id"), F.when(o % 11 != 0, F.col("o_custkey") + 1).alias("observable_id"), (o % 3 + 1).alias("witness_rank"),
        *[text(f"{n} ", o).alias(n) for n in cx.WITNESS[5:12]], F.lit(None).cast("string").alias("reasons"),
    )
    return cx.Facts(
        mutants, files, v.v_types(spark, sf), v.v_methods(spark, sf), v.v_fields(spark, sf), v.v_calls(spark, sf), v.v_accesses(spark, sf),
        _imports(spark, sf), _accepted(spark, sf), entries, observers, observables, witnesses,
    )


def _section(section, source, columns, score="0.0", name="''", a="0", b="0", c="0"):
    """SQL rows of one section; columns are names, or (name, expression)."""
    pairs = [x if isinstance(x, tuple) else (x, x) for x in columns]
    body = ", ".join(f"'{n}': {e}" for n, e in pairs)
    return f"SELECT mutant_row_id, {section} AS section, CAST({score} AS DOUBLE) AS score, {name} AS name, {a} AS a, {b} AS b, {c} AS c, CAST(to_json({{{body}}}) AS VARCHAR) AS item FROM {source}"


_OWNER = "regexp_extract(type_name, '[^.]*$')"
_CALL = f"CASE WHEN is_constructor THEN 'new ' || {_OWNER} || '(/* args */)' WHEN is_static THEN {_OWNER} || '.' || name || '(/* args */)' ELSE 'subject.' || name || '(/* args */)' END"
_KNOWN = "trim(coalesce(why, '')) <> ''"
_PARAMS = r"list_filter(string_split(regexp_extract(e_signature, '\((.*)\)', 1), ','), lambda x: x <> '')"
_METHOD = cx.METHOD
_RECEIVER = f"""CAST(to_json([CASE WHEN is_static THEN 'No receiver object is required for static entry ' || e_signature || '.'
  WHEN is_constructor THEN {_OWNER} || ' subject = new ' || {_OWNER} || '(/* constructor args */);' ELSE {_OWNER} || ' subject = /* construct a live receiver for ' || e_signature || ' */;' END,
  CASE WHEN {_KNOWN} THEN 'Satisfy the path predicates before the mutation-sensitive call.' ELSE 'Shape the receiver so the mutation-sensitive branch can execute.' END,
  'Observe the ' || lower(observable_kind) || ' sink after invoking ' || {_CALL} || '.']) AS VARCHAR)"""
_ARGUMENTS = f"""CAST(to_json(list_concat(list_concat(CASE WHEN len({_PARAMS}) = 0 THEN ['No call arguments are required for ' || e_signature || '; the witness depends on receiver state.']
  ELSE list_transform({_PARAMS}, lambda x, i: x || ' arg' || i || ' = /* type-compatible value that preserves the path predicates */;') END,
  CASE WHEN {_KNOWN} THEN ['Arguments should preserve the relevant conditions rather than short-circuiting the target branch.'] ELSE [] END),
  CASE WHEN observable_kind = 'RETURN_VALUE' THEN ['Choose argument values that make the returned value distinguish original from mutant.'] ELSE [] END)) AS VARCHAR)"""
_SKETCH = f"""CASE WHEN observable_kind = 'RETURN_VALUE' THEN 'assertNotEquals("mutant should alter the returned value", /* originalExpected */, ' || {_CALL} || ');'
  ELSE '// Invoke ' || {_CALL} || ' and assert the observable ' || expression || ' with a mutation-sensitive expectation.' END"""
_CALLED = """(SELECT c.caller_method_id, coalesce(t.qualified_name, c.callee_owner) AS owner, coalesce(m.name, c.callee_method_name) AS callee,
  coalesce(m.signature, c.callee_signature) AS callee_signature, c.line_number, call_id FROM v_calls c LEFT JOIN v_methods m ON m.method_id = c.callee_method_id
  LEFT JOIN v_types t ON t.type_id = m.type_id)"""
_TOUCHED = """(SELECT x.method_id, coalesce(t.qualified_name, x.owner_type) AS owner, coalesce(f.field_name, x.raw_field_name) AS field, access_kind, line_number, access_id
  FROM v_accesses x LEFT JOIN v_fields f ON f.field_id = x.field_id LEFT JOIN v_types t ON t.type_id = f.type_id)"""
_CONTEXT_SECTIONS = [
    _section("'mutant'", "mut", ["mutant_row_id", "mutant_id", "project", "operator", "line", "statement"]),
    *[_section(f"'{s}_file'", f"mut JOIN files ON file_id = {s}_file_id", ["file_id", "path", "package_name"]) for s in ("original", "mutant")],
    *[_section(f"'{s}_method'", f"mut JOIN d ON method_id = {s}_method_id", _METHOD) for s in ("original", "mutant")],
    _section("'method_calls'", f"mut JOIN {_CALLED} ON caller_method_id = mutant_method_id", ["owner", "callee", "callee_signature", "line_number"], a="line_number", b="call_id"),
    _section("'field_accesses'", f"mut JOIN {_TOUCHED} ON method_id = mutant_method_id", ["owner", "field", "access_kind", "line_number"], a="line_number", b="access_id"),
    _section("'affected_fields'", "mut JOIN affected ON method_id = mutant_method_id", ["field_id", "field_name", "visibility"], a="field_id"),
    _section("'owner_type'", "owned JOIN v_types t ON t.type_id = owned.type_id", [("type_id", "t.type_id"), "qualified_name"]),
    _section(
        "'owner_methods'", "owned JOIN v_methods m ON m.type_id = owned.type_id",
        [(x, f"m.{x}") for x in _METHOD if x not in ("type_id", "type_name", "begin_line", "end_line")], a="m.begin_line", b="m.method_id",
    ),
    _section("'owner_fields'", "owned JOIN v_fields f ON f.type_id = owned.type_id", ["field_id", "field_name", ("visibility", "f.visibility")], a="field_id"),
    _section(
        "'field_propagation'", "spread", ["field_id", "field_name", "field_visibility", *_METHOD, "access_kind", "line_number", "score", ("reasons", "why")],
        "score", "field_name", "begin_line", "method_id", "field_id * 1000000 + line_number",
    ),
    _section("'entries'", "entries", [*_METHOD, "score", ("reasons", "why")], "score", a="begin_line", b="method_id"),
    _section(
        "'field_observers'", "observers JOIN v_fields USING (field_id) JOIN v_methods m USING (method_id)",
        ["field_id", "field_name", "method_id", "signature", "observer_kind", "distance", "priority", ("reasons", "why")], "priority", a="id",
    ),
    _section(
        "'observables'", "observables", ["method_id", "signature", "observable_kind", "expression", "priority", "is_primary", ("reasons", "why")],
        "priority", "field_name", "place_a", "place_b",
    ),
    _section(
        "'witnesses'", "wit LEFT JOIN v_methods em ON em.method_id = entry_id LEFT JOIN v_methods om ON om.method_id = observable_id",
        ["entry_id", ("entry_signature", "em.signature"), "observable_id", ("observable_signature", "om.signature"), "witness_rank", *[(n, f"'{n} ' || id") for n in cx.WITNESS[5:12]], ("reasons", "CAST(NULL AS VARCHAR)")],
        a="witness_rank", b="id",
    ),
    _section(
        "'witnesses'", "fallback",
        [
            ("entry_id", "method_id"), ("entry_signature", "e_signature"), "observable_id", "observable_signature", ("witness_rank", "CAST(rn AS INT)"), ("receiver_setup", _RECEIVER),
            ("argument_setup", _ARGUMENTS), ("predicate_chain", f"CAST(to_json(CASE WHEN {_KNOWN} THEN [why] ELSE [] END) AS VARCHAR)"), ("original_outcome", "observable_kind || ' original outcome'"),
            ("mutant_outcome", "'different mutant outcome'"), ("outcome_kind", "observable_kind"), ("assertion_sketch", _SKETCH),
            ("reasons", "'fallback witness built from ranked entry/observable candidates'"),
        ],
        a="CAST(rn AS INT)",
    ),
    _section("'imports'", "imports", ["import_value", "source_kind", "usage_context", "priority", "scope", "owner_signature", "origin"], "priority", "scope || ' ' || import_value"),
]
_CONTEXT_SQL = f"""
WITH mut AS (
  SELECT c_custkey AS mutant_row_id, CASE WHEN c_custkey % 2 = 0 THEN 'p::C::m()::' ELSE '' END || 'AOIS_' || c_custkey AS mutant_id, 'proj' || (c_custkey % 5) AS project, 'AOIS_' || (c_custkey % 9) AS operator,
    c_custkey % 100 AS line, c_mktsegment AS statement, c_custkey % 10 + 1 AS original_file_id, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 10 + 5 END AS mutant_file_id,
    CASE WHEN c_custkey % 50 <> 49 THEN c_custkey END AS original_method_id, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey + 1 END AS mutant_method_id FROM customer
), files AS (
  SELECT s_suppkey AS file_id, 'src/' || s_suppkey || '.java' AS path, 'org.demo' AS package_name FROM supplier
), d AS (
  SELECT method_id, m.type_id, qualified_name AS type_name, name, signature, return_type, visibility, is_static, is_constructor, begin_line, end_line FROM v_methods m JOIN v_types USING (type_id)
), affected AS (
  SELECT DISTINCT method_id, field_id, field_name, visibility FROM v_accesses JOIN v_fields USING (field_id)
), owned AS (
  SELECT mut.*, type_id, return_type AS o_return, signature AS o_signature FROM mut JOIN d ON method_id = original_method_id
), st_entries AS (
  SELECT mutant_row_id, d.*, priority AS score, why FROM (SELECT o_custkey AS mutant_row_id, o_custkey + o_orderkey % 5 + 1 AS method_id, CAST(max(o_orderkey % 90) AS DOUBLE) AS priority,
    'stored ' || min(o_orderpriority) AS why FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2) JOIN d USING (method_id)
), entries AS (
  SELECT * FROM st_entries UNION ALL SELECT mutant_row_id, d.*, l.score, l.reasons FROM owned JOIN ({_LIVE_SQL}) l ON l.anchor_id = original_method_id JOIN d ON d.method_id = l.method_id
  WHERE mutant_row_id NOT IN (SELECT mutant_row_id FROM st_entries)
), observers AS (
  SELECT o_custkey AS mutant_row_id, o_orderkey AS id, o_orderkey % 100 + 1 AS field_id, o_custkey + o_orderkey % 3 AS method_id, ['DIRECT_RETURN', 'STATE_EFFECT'][o_orderkey % 2 + 1] AS observer_kind, 1 AS distance,
    CAST(o_orderkey % 70 AS DOUBLE) AS priority, 'seen ' || o_orderkey AS why FROM orders WHERE o_orderstatus = 'P'
), st_observables AS (
  SELECT o_custkey AS mutant_row_id, o_orderkey AS id, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey + o_orderkey % 4 END AS method_id, ['RETURN_VALUE', 'FIELD_STATE'][o_orderkey % 2 + 1] AS observable_kind,
    'e' || o_orderkey AS expression, CAST(o_orderkey % 80 AS DOUBLE) AS priority, o_orderkey % 7 = 0 AS is_primary, ['why', '', 'so'][o_orderkey % 5 % 3 + 1] AS why FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 3 = 0
), wit AS (
  SELECT o_custkey AS mutant_row_id, o_orderkey AS id, o_custkey AS entry_id, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey + 1 END AS observable_id, o_orderkey % 3 + 1 AS witness_rank
  FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 4 = 1
), spread AS (
  SELECT *, CASE visibility WHEN 'public' THEN 60.0::DOUBLE WHEN 'protected' THEN 45.0 WHEN 'package-private' THEN 35.0 ELSE 0.0 END + CASE WHEN access_kind = 'READ' THEN 80.0 ELSE 35.0 END
      + CASE WHEN return_type <> 'void' THEN 15.0 ELSE 0.0 END AS score,
    'method ' || signature || ' ' || lower(access_kind) || 's affected field ''' || field_name || '''' || CASE WHEN return_type <> 'void' THEN '; non-void return can expose propagated state' ELSE '' END
      || '; ' || visibility || ' visibility makes it a better test entry than private helpers' AS why
  FROM (SELECT DISTINCT owned.mutant_row_id, f.field_id, f.field_name, f.visibility AS field_visibility, d.*, x.access_kind, x.line_number FROM owned JOIN affected f ON f.method_id = owned.mutant_method_id
    JOIN v_accesses x ON x.field_id = f.field_id JOIN d ON d.method_id = x.method_id AND d.type_id = owned.type_id WHERE d.method_id <> owned.original_method_id AND d.visibility <> 'private')
), derived AS (
  SELECT mutant_row_id, original_method_id AS method_id, o_signature AS signature, 'RETURN_VALUE' AS observable_kind, 'result' AS expression, 220.0::DOUBLE AS priority,
    'mutated method returns a value directly observable by the test' AS why, '' AS field_name, 0 AS place_a, original_method_id AS place_b FROM owned WHERE o_return <> 'void'
  UNION ALL SELECT mutant_row_id, method_id, signature, 'PUBLIC_METHOD_DEPENDS_ON_MUTATED_STATE', signature, score, why, field_name, begin_line, method_id FROM (
    SELECT *, row_number() OVER (PARTITION BY mutant_row_id, method_id ORDER BY score DESC, field_name, begin_line, field_id, line_number, access_kind) AS r FROM spread) WHERE r = 1
), observables AS (
  SELECT mutant_row_id, s.method_id, signature, observable_kind, expression, priority, is_primary, why, '' AS field_name, id AS place_a, 0 AS place_b,
    row_number() OVER (PARTITION BY mutant_row_id ORDER BY priority DESC, id) AS rn FROM st_observables s LEFT JOIN v_methods m ON m.method_id = s.method_id
  UNION ALL SELECT mutant_row_id, method_id, signature, observable_kind, expression, priority, rn = 1, why, field_name, place_a, place_b, rn FROM (
    SELECT *, row_number() OVER (PARTITION BY mutant_row_id ORDER BY priority DESC, field_name, place_a, method_id) AS rn FROM derived WHERE mutant_row_id NOT IN (SELECT mutant_row_id FROM st_observables))
), fallback AS (
  SELECT e.mutant_row_id, e.rn, e.method_id, e.type_name, e.name, e.signature AS e_signature, e.is_static, e.is_constructor, o.method_id AS observable_id, o.signature AS observable_signature, o.observable_kind, o.expression, o.why
  FROM (SELECT *, row_number() OVER (PARTITION BY mutant_row_id ORDER BY score DESC, begin_line, method_id) AS rn FROM entries) e JOIN observables o ON o.mutant_row_id = e.mutant_row_id AND o.rn = e.rn
  WHERE e.rn <= 2 AND e.mutant_row_id NOT IN (SELECT mutant_row_id FROM wit)
), all_imports AS MATERIALIZED ({_IMPORT_SQL}
), imports AS (
  SELECT mutant_row_id, import_value, source_kind, x.u AS usage_context, x.p AS priority, scope, owner_signature, origin FROM (
    SELECT mutant_row_id, scope, owner_signature, import_value, source_kind, origin, max({{'p': priority, 'u': usage_context}}) AS x FROM (
      SELECT mutant_row_id, 'SOURCE_FILE' AS scope, '' AS owner_signature, import_value, source_kind, priority, usage_context, 'BASE_KB' AS origin FROM mut JOIN all_imports i ON i.file_id = original_file_id AND i.method_id IS NULL
      UNION ALL SELECT mutant_row_id, 'MUTATION_METHOD', o_signature, import_value, source_kind, priority, usage_context, 'BASE_KB' FROM owned JOIN all_imports i ON i.method_id = original_method_id
      UNION ALL SELECT mutant_row_id, 'ENTRY_METHOD', signature, import_value, source_kind, priority, usage_context, 'BASE_KB' FROM entries JOIN all_imports i USING (method_id)
      UNION ALL SELECT mutant_row_id, scope, owner_signature, import_value, source_kind, priority, usage_context, origin FROM mut JOIN ({_ACCEPTED_SQL}) a ON a.mutant_id = 'AOIS_' || mutant_row_id) GROUP BY ALL)
), items AS (
  {" UNION ALL ".join(_CONTEXT_SECTIONS)}
)
SELECT mutant_row_id, section, count(*) AS items, CAST(sum(CAST('0x' || md5(concat_ws('|', section, CAST(score AS VARCHAR), name, a, b, c, item))[:8] AS BIGINT)) AS BIGINT) AS content FROM items GROUP BY ALL"""


def items_and_content(rows):
    """Items of each section, and a sum of digests of all items with their places."""
    place = F.concat_ws("|", "section", F.col("at.score").cast("string"), "at.name", "at.a", "at.b", "at.c", "item")
    digest = F.conv(F.substring(F.md5(place), 1, 8), 16, 10).cast("long")
    return rows.groupBy("mutant_row_id", "section").agg(F.count(F.lit(1)).alias("items"), F.sum(digest).alias("content"))


@query("M12_wide_context", _CONTEXT_SQL, ("v_methods", "v_types", "v_fields", "v_accesses", "v_calls"))
def wide_context(spark, sf):
    """Every section of every mutant's context."""
    return items_and_content(cx.mutant_context(cx.build_store(context_facts(spark, sf))))
