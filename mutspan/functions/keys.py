"""Identity keys: canonical mutant ids, operator families, row numbers, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import INT_MAX
from .text import col, first_match, first_non_blank, let, or_default, safe

SEPARATOR = "::"


def canonical_id(project: Column | str, cls: Column | str, method: Column | str, mutant: Column | str) -> Column:
    parts = [safe(p) for p in (project, cls, method, mutant)]
    complete = (parts[0] != "") & (parts[1] != "") & (parts[2] != "") & (parts[3] != "")
    return F.when(complete, F.concat_ws(SEPARATOR, *parts)).otherwise(F.lit(""))


def last_path_segment(path: Column | str) -> Column:
    slashed = F.rtrim(F.translate(safe(path), "\\", "/"))
    return F.substring_index(F.regexp_replace(slashed, "/+$", ""), "/", -1)


def _joined_parts(parts: Column) -> Column:
    """First four parts as an id; '' when one of them is blank."""
    return let(
        F.transform(F.slice(parts, 1, 4), safe),
        lambda p: F.when(F.forall(p, lambda x: x != ""), F.array_join(p, SEPARATOR)).otherwise(F.lit("")),
    )


def _with_last_segment(parts: Column) -> Column:
    """Parts whose first one is a path: only its last segment counts."""
    return F.concat(F.array(last_path_segment(F.get(parts, 0))), F.slice(parts, 2, 3))


def normalize_id(raw: Column | str) -> Column:
    """Bring ``a::b::c::d`` and ``path##b##c##d`` into the canonical form."""

    def body(text: Column) -> Column:
        colons, hashes = F.split(text, SEPARATOR, -1), F.split(text, "##", -1)
        return first_match(
            [
                (F.size(colons) >= 4, _joined_parts(colons)),
                (F.size(hashes) >= 4, _joined_parts(_with_last_segment(hashes))),
            ],
            text,
        )

    return let(safe(raw), body)


def legacy_mutant_name(raw: Column | str, anchor_folder: str = "traditional_mutants") -> Column:
    """Mutant name inside an id or a path."""

    def fourth(parts: Column, text: Column) -> Column:
        return let(parts, lambda p: F.when(F.size(p) >= 4, safe(F.get(p, 3))).otherwise(text))

    def in_path(parts: Column) -> Column:
        # the anchor must leave two more segments behind it
        at = F.array_position(F.slice(parts, 1, F.greatest(F.size(parts) - 2, F.lit(0))), F.lit(anchor_folder))
        return let(
            at,
            lambda i: F.when(i > 0, safe(F.get(parts, (i + 1).cast("int")))).otherwise(safe(F.element_at(parts, -1))),
        )

    def body(text: Column) -> Column:
        return first_match(
            [
                (text.contains(SEPARATOR), fourth(F.split(text, SEPARATOR, -1), text)),
                (text.contains("##"), fourth(F.split(text, "##", -1), text)),
            ],
            let(F.split(F.translate(text, "\\", "/"), "/", -1), in_path),
        )

    return let(safe(raw), body)


def id_part(raw: Column | str, index: int) -> Column:
    """0 project, 1 class, 2 method, 3 mutant; '' when the id is not canonical."""
    return let(
        F.split(safe(raw), SEPARATOR, -1),
        lambda p: F.when(F.size(p) >= 4, safe(F.get(p, index))).otherwise(F.lit("")),
    )


def backfilled_id(mutant_id: Column | str, project, cls, method, operator) -> Column:
    """The id itself, else one made of its four parts."""
    return first_non_blank(
        mutant_id, F.concat_ws(SEPARATOR, safe(project), safe(cls), safe(method), safe(operator))
    )


def operator_family(operator: Column | str) -> Column:
    text = safe(operator)
    return F.when(F.instr(text, "_") > 1, F.substring_index(text, "_", 1)).otherwise(text)


def mutant_number(name: Column | str) -> Column:
    """Number after the last underscore, for natural sorting."""
    tail = F.when(safe(name).contains("_"), F.substring_index(safe(name), "_", -1))
    number = F.when(tail.rlike("^[0-9]{1,10}$"), F.try_to_number(tail, F.lit("9999999999")))
    return F.coalesce(F.when(number <= INT_MAX, number.cast("int")), F.lit(INT_MAX))


def row_number_of_task(task_id: Column | str) -> Column:
    """Row number of ``row-N``; null for any other text."""
    digits = F.regexp_extract(safe(task_id), r"^row-([0-9]+)$", 1)
    return digits.try_cast("int")


def function_id(project, cls, method) -> Column:
    return F.concat_ws(
        SEPARATOR,
        or_default(project, "UNKNOWN_PROJECT"),
        or_default(cls, "UNKNOWN_CLASS"),
        or_default(method, "UNKNOWN_METHOD"),
    )


def site_id_by_line(function: Column | str, line: Column | str) -> Column:
    return F.concat_ws(SEPARATOR, or_default(function, "UNKNOWN_FUNCTION"), or_default(line, "UNKNOWN_SITE"))


def site_id_by_family(function: Column | str, operator: Column | str) -> Column:
    return F.concat(col(function), F.lit(SEPARATOR), operator_family(operator))


def cluster_id(site: Column | str, family: Column | str) -> Column:
    return F.concat_ws(SEPARATOR, or_default(site, "UNKNOWN_SITE"), or_default(family, "UNKNOWN_OPERATOR"))


def clean_path(path: Column | str) -> Column:
    slashed = F.translate(safe(path), "\\", "/")
    return F.replace(slashed, F.lit("//?/"), F.lit(""))


def module_home(path: Column | str) -> Column:
    """Path in front of the ``result`` folder; the path itself when there is none."""
    text = safe(path)
    home = F.regexp_extract(text, r"(?i)^(.*?)[\\/]+result([\\/]+|$)", 1)
    return F.when(home != "", home).otherwise(text)


def report_key(*parts: Column | str) -> Column:
    return F.concat_ws("##", *[safe(p) for p in parts])


def prompt_cache_key(namespace: Column | str, prompt: Column | str) -> Column:
    return F.sha2(F.concat_ws("\n", F.coalesce(col(namespace), F.lit("")), F.coalesce(col(prompt), F.lit(""))), 256)


def mentions_test(tests: Column | str, name: Column | str) -> Column:
    """True when a comma list names the test class or one of its methods."""
    wanted = safe(name)
    hits = F.exists(
        F.split(safe(tests), ","),
        lambda t: (safe(t) == wanted) | F.startswith(safe(t), F.concat(wanted, F.lit("#"))),
    )
    return (wanted != "") & F.coalesce(hits, F.lit(False))
