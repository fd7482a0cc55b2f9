"""Structural rules: what each part of a document may look like, as a table of fields compiled to one SQL expression per part.

A check is SQL for an array of (path, code, ord) structs. ord, an array of integers, is the place of an issue among those of its document: at each level the rank of the member or the
place of the element, and last the rank of the rule. It is only made for an issue that is raised. Parts are looked at where they stand, and small arrays in them are gone through with higher-order
functions; the elements of a document's long arrays (sources, claims, events, ...) are rows of their own. Neither needs a join or a shuffle.

Most parts have no issue, and to make the empty array of their issues costs far more than to see that it is empty. So a check also is SQL for a condition (ok) that holds only of parts
without an issue: few members read once, and compiled. A part of which it holds needs no more; all others are gone through in full. It may fail of a part without an issue (a text with
characters beyond UTF-16's first plane, a time with a zone), which then has none all the same.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from itertools import count

from attestry.functions import values as V

NONE = "CAST(array() AS array<struct<path:string,code:string,ord:array<int>>>)"
_names = count()


def places(*ranks: str | int) -> str:
    """SQL for an ord: each rank is a number or SQL for one; a first one that begins with * is SQL for an ord that goes before."""
    if ranks and str(ranks[0]).startswith("*"):
        return f"concat({str(ranks[0])[1:]}, {places(*ranks[1:])})"
    return f"CAST(array({', '.join(map(str, ranks))}) AS array<int>)"


@dataclass(frozen=True)
class At:
    """A value and where it is: SQL for a variant and for its path, and the ranks on the way to it."""

    v: str
    path: str
    ord: tuple[str | int, ...] = ()

    def __getitem__(self, name: str) -> At:
        return At(V.get(self.v, name), f"concat({self.path}, '.{name}')", self.ord)

    def under(self, *ranks: str | int) -> At:
        """The same with further ranks."""
        return replace(self, ord=(*self.ord, *ranks))


@dataclass(frozen=True)
class Check:
    """SQL for the issues of a part, and for a condition that holds only if there are none (never NULL)."""

    issues: Callable[[At], str]
    ok: Callable[[At], str]

    def __call__(self, at: At) -> Found:
        return Found.of(self.issues(at), lambda: self.ok(at))


def none(rules: Found) -> str:
    """A condition that holds only if there are none of these issues."""
    return rules.none()


def all_of(*conditions: str) -> str:
    return f"({' AND '.join(conditions)})" if conditions else "TRUE"


class Found(str):
    """SQL for the issues that are raised, with the condition that there are none."""

    none: Callable[[], str]

    @classmethod
    def of(cls, sql: str, none: Callable[[], str]) -> Found:
        made = cls(sql)
        made.none = none
        return made


def bound(at: At, body: Callable[[At], str]) -> str:
    """The body over a value and path that are worked out once, and named once, however often the body uses them."""
    o = f"o{next(_names)}"
    return f"transform(array(named_struct('v', {at.v}, 'p', {at.path})), {o} -> {body(At(f'{o}.v', f'{o}.p', at.ord))})[0]"


def named(expression: str, body: Callable[[str], str]) -> str:
    n = f"n{next(_names)}"
    return f"transform(array({expression}), {n} -> {body(n)})[0]"


def issue(at: At, path: str, code: str, *ranks: str | int) -> str:
    return f"named_struct('path', {path}, 'code', '{code}', 'ord', {places(*at.ord, *ranks)})"


def found(at: At, *rules: tuple[str, str, str], first: int = 0) -> Found:
    """(condition, path, code) of each issue that may be raised; a rule's rank is its number, counted from first."""
    raised = "filter(array(%s), i -> i IS NOT NULL)" % ", ".join(f"CASE WHEN {c} THEN {issue(at, p, code, first + k)} END" for k, (c, p, code) in enumerate(rules))
    return Found.of(raised, lambda: all_of(*(f"NOT coalesce({c}, FALSE)" for c, _, _ in rules)))


def both(*checks: Found) -> Found:
    return Found.of(f"concat({', '.join(checks)})" if checks else NONE, lambda: all_of(*map(none, checks)))


def given(condition: str, check: Found) -> Found:
    return Found.of(f"CASE WHEN {condition} THEN {check} ELSE {NONE} END", lambda: f"(NOT coalesce({condition}, FALSE) OR {none(check)})")


def text(low: int = 1, high: int = 20_000, plain: bool = False, pattern: tuple[str, str] | None = None) -> Check:
    """A string within bounds, without control characters, perhaps without active content, perhaps of a pattern (pattern, code)."""

    def check(at: At) -> str:
        return bound(at, lambda at: named(V.string(at.v), lambda s: rules_of(at, s)))

    def rules_of(at: At, s: str) -> str:
        rules = [(f"NOT {V.is_string(at.v)}", at.path, "invalid_type"), (f"{V.utf16_length(s)} < {low}", at.path, "string_too_short"), (f"{V.utf16_length(s)} > {high}", at.path, "string_too_long"), (f"{s} RLIKE '{V.CONTROL}'", at.path, "control_character")]
        if plain:
            rules.append((f"{s} RLIKE '{V.ACTIVE}'", at.path, "active_content"))
        if pattern:
            rules.append((f"NOT {s} RLIKE '{pattern[0]}'", at.path, pattern[1]))
        return found(at, *rules)

    # patterns are of texts that are not empty, and without control characters and active content
    sure = (lambda at: f"coalesce({V.string(at.v)} RLIKE '{pattern[0]}', FALSE)") if pattern else (lambda at: f"coalesce({V.string(at.v)} RLIKE '\\\\A{V.PLAIN if plain else V.FREE}{{{low},{high}}}\\\\z', FALSE)")
    if pattern and pattern[0] not in V.BOUNDED:
        own = sure
        sure = lambda at: all_of(own(at), f"octet_length({V.string(at.v)}) BETWEEN {low} AND {high}")
    return Check(check, sure)


def plain(high: int) -> Check:
    return text(1, high, plain=True)


ident = text(1, 128, pattern=(V.ID, "invalid_id"))
token = text(1, 128, pattern=(V.TOKEN, "invalid_token"))


def one_of(*choices: str) -> Check:
    listed = ", ".join(f"'{c}'" for c in choices)
    wrong = lambda at: f"NOT coalesce({V.string(at.v)} IN ({listed}), FALSE)"
    return Check(lambda at: found(at, (wrong(at), at.path, "invalid_enum")), lambda at: f"NOT ({wrong(at)})")


def literal(value: str) -> Check:
    return Check(lambda at: found(at, (f"NOT {V.string(at.v)} <=> '{value}'", at.path, "invalid_literal")), lambda at: f"{V.string(at.v)} <=> '{value}'")


flag = Check(lambda at: found(at, (f"{V.kind(at.v)} <> 'BOOLEAN'", at.path, "invalid_type")), lambda at: f"{V.kind(at.v)} = 'BOOLEAN'")


def integer(low: int = 0, high: int = 9007199254740991) -> Check:
    def check(at: At) -> str:
        return bound(at, lambda at: named(V.safe_integer(at.v), lambda n: rules_of(at, n)))

    def rules_of(at: At, n: str) -> str:
        return found(at, (f"{n} IS NULL", at.path, "invalid_integer"), (f"NOT {n} BETWEEN {low} AND {high}", at.path, "integer_out_of_range"))

    def sure(at: At) -> str:
        whole = [f"coalesce({V.read_as(at.v, 'string')} RLIKE '\\\\A[0-9]{{1,15}}\\\\z', FALSE)", f"NOT {V.is_string(at.v)}"]
        return all_of(*whole, f"coalesce({V.read_as(at.v, 'bigint')} BETWEEN {low} AND {high}, FALSE)")

    return Check(check, sure)


def real(low: str, high: str) -> Check:
    def check(at: At) -> str:
        return bound(at, lambda at: named(V.number(at.v), lambda n: rules_of(at, n)))

    def rules_of(at: At, n: str) -> str:
        infinite = f"{n} IS NULL OR isnan({n}) OR abs({n}) = double('Infinity')"
        return found(at, (infinite, at.path, "invalid_number"), (f"NOT ({infinite}) AND NOT {n} BETWEEN {low} AND {high}", at.path, "number_out_of_range"))

    return Check(check, lambda at: f"coalesce({V.number(at.v)} BETWEEN {low} AND {high}, FALSE)")


def _moment(at: At) -> str:
    wrong = lambda at: named(V.string(at.v), lambda s: found(at, (f"{s} IS NOT NULL AND {V.instant(s)} IS NULL", at.path, "invalid_timestamp"), first=9))
    return both(text(1, 64)(at), bound(at, wrong))


moment = Check(_moment, lambda at: f"coalesce({V.string(at.v)} RLIKE '{V.SURE_TIME}', FALSE)")


def _day(at: At) -> str:
    s = V.string(at.v)
    return both(text(1, 10)(at), found(at, (f"{V.is_string(at.v)} AND NOT ({s} RLIKE '{V.CALENDAR_DATE}' AND try_to_date({s}, 'yyyy-MM-dd') IS NOT NULL)", at.path, "invalid_date"), first=9))


day = Check(_day, lambda at: f"coalesce({V.string(at.v)} RLIKE '{V.SURE_DAY}', FALSE)")


def _url(at: At, s: str) -> str:
    return both(text(1, 2048)(at), named(V.web_url(s), lambda u: found(at, (f"{u} = 'credentials'", at.path, "url_credentials"), (f"{u} = 'invalid'", at.path, "invalid_url"), first=9)))


url = Check(lambda at: bound(at, lambda at: named(V.string(at.v), lambda s: _url(at, s))), lambda at: f"coalesce({V.string(at.v)} RLIKE '{V.SURE_URL}', FALSE)")


#: The rank of a member that the format does not know, before its place among the members as they are written (see engine.in_document_order).
UNKNOWN = -1


def thing(
    required: dict[str, Check], optional: dict[str, Check] | None = None, more: Callable[[At], str] | None = None, open_keys: Sequence[str] = (),
    order: Sequence[str] = (), after: dict[str, Callable[[At], str]] | None = None, ranks: dict[str, int] | None = None,
) -> Check:
    """A closed object: these members, those if they are present, no others (open_keys are checked elsewhere).

    Members are looked at in order, or as they are listed, and have the ranks 1, 2, ... (or those of ranks); what is unknown comes first. after: rules on the whole object that follow a member; more: those
    at the end.
    """
    checks = {**required, **(optional or {})}
    allowed = [*checks, *open_keys]
    listed = list(order) or list(checks)
    rank = {k: (ranks or {}).get(k, n + 1) for n, k in enumerate(listed)}

    def check(at: At) -> str:
        return bound(at, members)

    def members(at: At) -> str:
        names = ", ".join(f"'{k}'" for k in allowed)
        unknown = f"transform(array_except({V.keys(at.v)}, array({names})), k -> {issue(at, f'concat({at.path}, {chr(39)}.{chr(39)}, k)', 'unknown_field', 0, UNKNOWN)})"
        parts = [unknown]
        for name in listed:
            own = checks[name](at[name].under(rank[name]))
            parts.append(own if name in required else given(V.has(at.v, name), own))
            if name in (after or {}):
                parts.append(after[name](at.under(rank[name], 9)))
        if more:
            parts.append(more(at.under(max(rank.values(), default=0) + 1)))
        return f"CASE WHEN {V.is_object(at.v)} THEN {both(*parts)} ELSE array({issue(at, at.path, 'invalid_type', 0)}) END"

    def sure(at: At) -> str:
        names = ", ".join(f"'{k}'" for k in allowed)
        members = [checks[k].ok(at[k]) if k in required else f"({at[k].v} IS NULL OR {checks[k].ok(at[k])})" for k in listed]
        rest = [none(rule(at)) for rule in (*(after or {}).values(), *([more] if more else []))]
        return all_of(f"coalesce(size(array_except({V.keys(at.v)}, array({names}))) = 0, FALSE)", *members, *rest)

    return Check(check, sure)


def variants(tag: str, kinds: dict[str, Check], common_keys: Sequence[str] = ()) -> Check:
    """An object whose members depend on its tag. The checks of the kinds get the whole object."""

    def check(at: At) -> str:
        return bound(at, lambda at: named(V.string(V.get(at.v, tag)), lambda tagged: by_kind(at, tagged)))

    def by_kind(at: At, tagged: str) -> str:
        unknown_kind = both(thing({tag: one_of(*kinds)}, open_keys=common_keys)(at))
        cases = " ".join(f"WHEN {tagged} = '{name}' THEN {c(at)}" for name, c in kinds.items())
        return f"CASE WHEN NOT {V.is_object(at.v)} THEN array({issue(at, at.path, 'invalid_type', 0)}) {cases} ELSE {unknown_kind} END"

    def sure(at: At) -> str:
        cases = " ".join(f"WHEN '{name}' THEN {c.ok(at)}" for name, c in kinds.items())
        return f"(CASE {V.string(V.get(at.v, tag))} {cases} ELSE FALSE END)"

    return Check(check, sure)


def size(at: At, low: int, high: int) -> str:
    n = f"size({V.items(at.v)})"
    return found(at.under(0), (f"NOT {V.is_array(at.v)}", at.path, "invalid_type"), (f"{V.is_array(at.v)} AND {n} < {low}", at.path, "too_few_items"), (f"{V.is_array(at.v)} AND {n} > {high}", at.path, "too_many_items"))


def array_of(low: int, high: int) -> Check:
    """An array of so many elements, which are checked elsewhere."""
    return Check(lambda at: bound(at, lambda at: size(at, low, high)), lambda at: _sized(at, low, high))


def _sized(at: At, low: int, high: int) -> str:
    return f"coalesce(size({V.unread(at.v)}) BETWEEN {low} AND {high}, FALSE)"


def each(check: Check, low: int, high: int) -> Check:
    """An array of so many of these."""

    def run(at: At) -> str:
        return bound(at, gone_through)

    def gone_through(at: At) -> str:
        n = next(_names)
        item = At(f"x{n}", f"concat({at.path}, '[', i{n}, ']')", (*at.ord, 1, f"i{n}"))
        return both(size(at, low, high), f"flatten(transform({V.items(at.v)}, (x{n}, i{n}) -> {check(item)}))")

    def sure(at: At) -> str:
        n = next(_names)
        return all_of(_sized(at, low, high), f"forall({V.items(at.v)}, x{n} -> {check.ok(At(f'x{n}', at.path))})")

    return Check(run, sure)


def repeats(listed: str, at: At) -> Found:
    """An issue for each element of an array of strings that stands further ahead, too."""
    n = next(_names)
    path = f"concat({at.path}, '[', i{n}, ']')"
    raised = f"filter(transform({listed}, (s{n}, i{n}) -> CASE WHEN array_position({listed}, s{n}) <= i{n} THEN {issue(at, path, 'duplicate_id', f'i{n}')} END), i -> i IS NOT NULL)"
    return Found.of(raised, lambda: f"size(array_distinct({listed})) = size({listed})")


def listed(check: Check, low: int = 0, high: int = 20_000) -> Check:
    """An array of different strings."""
    own = each(check, low, high)
    return Check(lambda at: both(own(at), repeats(V.strings(at.v), at.under(2))), lambda at: all_of(own.ok(at), none(repeats(V.strings(at.v), at))))


def ids(low: int = 0, high: int = 20_000) -> Check:
    return listed(ident, low, high)


def choices(*allowed: str) -> Check:
    """1 to 10 different of these."""
    names = ", ".join(f"'{c}'" for c in allowed)
    own, known = each(one_of(*allowed), 1, 10), lambda at: f"filter({V.strings(at.v)}, s -> s IN ({names}))"
    return Check(lambda at: both(own(at), repeats(known(at), at.under(2))), lambda at: all_of(own.ok(at), none(repeats(V.strings(at.v), at))))


digest = thing({"algorithm": literal("sha-256"), "value": text(64, 64, pattern=(V.SHA_256, "invalid_digest"))})
