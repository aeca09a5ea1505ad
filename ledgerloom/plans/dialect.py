"""Warehouse spellings in Spark's words, found on the plan that Spark's own parser makes.

A parsed node knows which part of the text it came from. A function or a table name that is spelled
as in the warehouse is replaced there, and the text is parsed again until nothing is left to replace.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

# Functions that only have another name.
RENAMED = {"safe_divide": "try_divide", "countif": "count_if", "ifnull": "coalesce", "logical_or": "bool_or", "logical_and": "bool_and"}
SHIFTED = {f"{kind}_{way}": sign for kind in ("date", "datetime", "timestamp") for way, sign in (("add", "+"), ("sub", "-"))}
TRUNCATED = {"day", "week", "isoweek", "month", "quarter", "year"}
BETWEEN = {
    "day": "datediff({0}, {1})", "week": "CAST(datediff(date_sub(next_day({0}, 'SUN'), 7), date_sub(next_day({1}, 'SUN'), 7)) / 7 AS BIGINT)",
    "month": "(year({0}) * 12 + month({0}) - year({1}) * 12 - month({1}))", "year": "(year({0}) - year({1}))",
    "quarter": "(year({0}) * 4 + quarter({0}) - year({1}) * 4 - quarter({1}))",
}


def each(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def kind_of(node) -> str:
    return node.getClass().getSimpleName()


def subplans(expression) -> list:
    """Plans of a subquery expression."""
    kind = kind_of(expression)
    if kind in ("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery"):
        return [expression.plan()]
    return [expression.query().plan()] if kind == "InSubquery" else []


def nodes(plan, parent: str = "") -> Iterator[tuple[object, str]]:
    """Every plan node and expression of a parsed query, each with the kind of the node above it."""
    yield plan, parent
    kind = kind_of(plan)
    inner = each(plan.innerChildren()) if kind == "UnresolvedWith" else []
    for below in [*inner, *each(plan.children())]:
        yield from nodes(below, kind)
    for expression in [*([plan.generator()] if kind == "Generate" else []), *each(plan.expressions())]:
        yield from _expressions(expression, kind)


def _expressions(expression, parent: str) -> Iterator[tuple[object, str]]:
    yield expression, parent
    for plan in subplans(expression):
        yield from nodes(plan, kind_of(expression))
    for below in each(expression.children()):
        yield from _expressions(below, kind_of(expression))


def span(node) -> tuple[int, int] | None:
    """Where a node's text begins and ends."""
    origin = node.origin()
    if not (origin.startIndex().isDefined() and origin.stopIndex().isDefined()):
        return None
    return origin.startIndex().get(), origin.stopIndex().get() + 1


def table_parts(relation) -> list[str]:
    """Parts of a table name; a quoted name may hold several."""
    return [p.lower() for part in each(relation.multipartIdentifier()) for p in part.split(".")]


def _arguments(text: str, function) -> list[str] | None:
    """The texts of a call's arguments, if each has its own place in the call's text."""
    whole, out = span(function), []
    for argument in each(function.arguments()):
        own = span(argument)
        if own is None or own[0] <= whole[0] or own[1] >= whole[1]:
            return None
        out.append(text[own[0]:own[1]])
    return out


def _unit(argument) -> str:
    return each(argument.nameParts())[0].lower() if kind_of(argument) == "UnresolvedAttribute" else ""


def _is_interval(argument) -> bool:
    return kind_of(argument) == "Literal" and "interval" in argument.dataType().simpleString()


def _call(text: str, function) -> tuple[int, int, str] | None:
    """The replacement of a call that the warehouse spells its own way."""
    parts, whole = each(function.nameParts()), span(function)
    if len(parts) != 1 or whole is None:
        return None
    name, given = parts[0].lower(), each(function.arguments())
    if name in RENAMED:
        end = text.index("(", whole[0])
        return whole[0], end, RENAMED[name]
    said = _arguments(text, function)
    if said is None:
        return None
    if name in SHIFTED and len(given) == 2 and _is_interval(given[1]):
        return *whole, f"(({said[0]}) {SHIFTED[name]} {said[1]})"
    if name == "date_diff" and len(given) == 3 and _unit(given[2]) in BETWEEN:
        return *whole, BETWEEN[_unit(given[2])].format(f"({said[0]})", f"({said[1]})")
    if name == "date_trunc" and len(given) == 2 and _unit(given[1]) in TRUNCATED:
        unit, day = _unit(given[1]), f"({said[0]})"
        if unit == "day":
            return *whole, f"CAST({day} AS DATE)"
        # The warehouse's week begins on Sunday, the ISO week on Monday.
        return *whole, f"date_sub(next_day({day}, 'SUN'), 7)" if unit == "week" else f"trunc({day}, '{unit.removeprefix('iso').upper()}')"
    return None


def translated(parse: Callable[[str], object], text: str, view_of: Callable[[list[str]], str | None]) -> str:
    """``text`` with warehouse functions and table names replaced.

    ``view_of`` maps the parts of a longer table name to a view, or to None if there is none: such a
    name stays, for the caller to refuse.
    """
    while True:
        found = set()
        for node, parent in nodes(parse(text)):
            kind, edit = kind_of(node), None
            if kind == "UnresolvedFunction":
                edit = _call(text, node)
            elif kind == "UnresolvedRelation" and len(parts := table_parts(node)) > 1:
                view, place = view_of(parts), span(node)
                if view is not None and place is not None:
                    # Columns may be named by the table, so it keeps its name.
                    edit = *place, f"`{view}`" + ("" if parent == "SubqueryAlias" or view == parts[-1] else f" AS `{parts[-1]}`")
            if edit is not None:
                found.add(edit)
        # Those inside others first; the rest come with the next parse.
        edits = [e for e in found if not any(o != e and e[0] <= o[0] and o[1] <= e[1] for o in found)]
        if not edits:
            return text
        for start, end, new in sorted(edits, reverse=True):
            text = text[:start] + new + text[end:]
