"""Evidence under its character limit beside the same rules on nested objects."""

import copy
import json
import random

import pytest

from mutspan.functions import fixed
from mutspan.operators import evidence

SCHEMA = (
    "id string, action string, section string, field string, field_no int, item_no int, member string, member_no int, sub_no int, text string, quoted boolean"
)


def leaves_of(key, action, obj):
    rows = []

    def leaf(section, field, field_no, item_no, member, member_no, sub_no, value):
        quoted = isinstance(value, str)
        text = None if value is None else value if quoted else json.dumps(value)
        rows.append((key, action, section, field, field_no, item_no, member, member_no, sub_no, text, quoted))

    def members(section, field, field_no, item_no, value):
        for n, (name, x) in enumerate(value.items()):
            if isinstance(x, list):
                for i, y in enumerate(x or [None]):
                    leaf(section, field, field_no, item_no, name, n, i, y)
            else:
                leaf(section, field, field_no, item_no, name, n, -1, x)

    def value_of(section, field, field_no, value):
        if isinstance(value, list):
            for i, x in enumerate(value or [None]):
                if isinstance(x, dict):
                    members(section, field, field_no, i, x)
                else:
                    leaf(section, field, field_no, i, "", -1, -1, x)
        elif isinstance(value, dict):
            members(section, field, field_no, -1, value)
        else:
            leaf(section, field, field_no, -1, "", -1, -1, value)

    for section, content in obj.items():
        if isinstance(content, dict):
            for n, (field, value) in enumerate(content.items()):
                value_of(section, field, n, value)
        else:
            value_of(section, "", 0, content)
    return rows


def size(obj):
    return len(json.dumps(obj, ensure_ascii=False, separators=(",", ":")))


def short(text, n):
    text = text.strip("".join(map(chr, range(33))))
    return text if len(text) <= n else text[: n - 3] + "..."


def cut_list(obj, name, items, chars):
    if isinstance(obj, dict) and isinstance(obj.get(name), list):
        obj[name] = [short(x, chars) if isinstance(x, str) else x for x in obj[name][:items]]


def cut_object(obj, k, chars):
    for name, value in (obj or {}).items():
        if isinstance(value, dict):
            cut_object(value, max(1, k - 1), chars)
        elif isinstance(value, list):
            cut_list(obj, name, max(1, k), chars)
        elif isinstance(value, str):
            obj[name] = short(value, chars)


def cut_sections(obj, ks, sections):
    for section, name, least, more, chars in fixed.EVIDENCE_LISTS:
        if section in sections:
            cut_list(obj.get(section), name, least if more is None else max(least, ks(section) + more), chars)
    for section, name, chars in fixed.EVIDENCE_TEXTS:
        if (section in sections or section == "codeKbContext") and isinstance(obj.get(section, {}).get(name), str):
            obj[section][name] = short(obj[section][name], chars)
    for section, name, items, chars in fixed.EVIDENCE_OBJECTS:
        if section in sections and isinstance(obj.get(section, {}).get(name), dict):
            cut_object(obj[section][name], ks(section) if items is None else items, chars)


def cut_context(obj, limits):
    for name, which, count, chars in fixed.EVIDENCE_CONTEXT_LISTS:
        rows = obj.get("codeKbContext", {}).get(name)
        if isinstance(rows, list):
            obj["codeKbContext"][name] = [
                {m: short(x, chars) if isinstance(x, str) else x for m, x in list(r.items())[:count]} for r in rows[: limits[which]]
            ]


def brute_force(obj, action):
    """(object, level)"""
    obj = copy.deepcopy(obj)
    if action in (None, "BASELINE", "OTHER"):
        return obj, 0
    cap, entry, method, field, k = fixed.PROFILE_LIMITS[action]
    if action in fixed.PROFILE_SECTIONS_KEPT:
        obj = {s: v for s, v in obj.items() if s in fixed.PROFILE_SECTIONS_KEPT[action]}
    for s in fixed.PROFILE_SECTIONS_LEFT_OUT[action]:
        obj.pop(s, None)
    cut_sections(obj, lambda s: k, {s for s, *_ in fixed.EVIDENCE_LISTS + fixed.EVIDENCE_TEXTS + fixed.EVIDENCE_OBJECTS})
    cut_context(obj, {"entry": entry, "method": method, "field": field})
    for floor, names in fixed.EVIDENCE_PLANS.items():
        for s in names:
            cut_object(obj.get(s), max(floor, k), 220)
    cut_list(obj, "alternativeChains", min(2, k), 400)
    if size(obj) <= cap:
        return obj, 0
    cut_sections(obj, fixed.EVIDENCE_OVER_K.get, fixed.EVIDENCE_OVER_K)
    cut_context(obj, fixed.EVIDENCE_OVER_CONTEXT)
    for floor, names in fixed.EVIDENCE_OVER_PLANS.items():
        for s in names:
            cut_object(obj.get(s), floor, 220)
    cut_list(obj, "alternativeChains", 1, 360)
    level = 1
    for names in fixed.EVIDENCE_TIERS:
        if size(obj) > cap:
            level += 1
            for s in names:
                obj.pop(s, None)
    return obj, level


def some_evidence(rnd):
    texts = ["short", " blank ends \n", 'q"uo\\te', "é😀", "", "tab\tline\n"]
    text = lambda: rnd.choice(texts) if rnd.random() < 0.6 else rnd.choice("xyé") * rnd.randint(100, 900)
    many = lambda make: [make() for _ in range(rnd.randint(0, 8))]
    inner = lambda: {f"m{i}": rnd.choice([text, lambda: many(text), lambda: 7, lambda: True])() for i in range(rnd.randint(1, 6))}
    obj = {}
    names = {}
    for s, name, *_ in fixed.EVIDENCE_LISTS:
        names.setdefault(s, []).append((name, lambda: many(text)))
    for s, name, _ in fixed.EVIDENCE_TEXTS:
        names.setdefault(s, []).append((name, text))
    for s, name, *_ in fixed.EVIDENCE_OBJECTS:
        names.setdefault(s, []).append((name, inner))
    names["codeKbContext"] += [(name, lambda: many(lambda: {f"f{i}": text() if i % 2 else i for i in range(8)})) for name, *_ in fixed.EVIDENCE_CONTEXT_LISTS]
    plans = [s for ss in fixed.EVIDENCE_PLANS.values() for s in ss]
    for s in [*names, *plans, "notes", "canonicalCore", "entryEvidence"]:
        if rnd.random() < 0.7:
            parts = [(n, make) for n, make in names.get(s, []) if rnd.random() < 0.7]
            parts += [(f"other{i}", rnd.choice([text, lambda: many(text), inner])) for i in range(rnd.randint(1, 3))]
            if rnd.random() < 0.1:
                parts.append(("dump", lambda: "z" * rnd.randint(2000, 12000)))
            rnd.shuffle(parts)
            obj[s] = {name: make() for name, make in parts}
    if rnd.random() < 0.8:
        obj["alternativeChains"] = many(text)
    return obj


def test_evidence_under_its_limit_equals_the_rules_on_objects(spark):
    rnd = random.Random(8)
    actions = [*fixed.PROFILE_LIMITS, None, "OTHER", "ENTRY_HEAVY", "MUTATION_HEAVY", "ENTRY_HEAVY"]
    objects = {f"k{i}": (some_evidence(rnd), actions[i % len(actions)]) for i in range(120)}
    objects["only one"] = ({"entryEvidence": {"a": "x"}}, "COMPACT")
    rows = [r for key, (obj, action) in objects.items() for r in leaves_of(key, action, obj)]
    leaves = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got_rows, got_levels = evidence.capped_evidence(leaves, "id")
    got_levels = {r.id: (r.level, r.chars) for r in got_levels.collect()}
    got = {}
    for r in got_rows.collect():
        got.setdefault(r.id, []).append(tuple(r))
    seen = set()
    for key, (obj, action) in objects.items():
        want, level = brute_force(obj, action)
        seen.add(level)
        if not want:
            assert key not in got
            continue
        assert sorted(map(repr, got[key])) == sorted(map(repr, leaves_of(key, action, want)))
        assert got_levels[key] == (level, size(want))
    assert seen == {0, 1, 2, 3, 4}


@pytest.mark.parametrize("limit,want", [(3, "..."), (5, "ab..."), (6, "abcdef"), (0, "abcdef"), (None, " abcdef ")])
def test_cut_text(spark, limit, want):
    from pyspark.sql import functions as F

    assert spark.range(1).select(evidence.cut_text(F.lit(" abcdef "), F.lit(limit).cast("int"))).first()[0] == want
