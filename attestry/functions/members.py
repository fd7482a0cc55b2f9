"""Where members of JSON objects are written."""

from __future__ import annotations

import json


def in_order(names: list[str]) -> list[str]:
    """Names of an object's members as JavaScript goes through them: array indices by value, then the others as they were first written."""
    once = list(dict.fromkeys(names))
    index = [n for n in once if len(n) <= 10 and n.isascii() and n.isdigit() and str(int(n)) == n and int(n) < 2**32 - 1]
    return sorted(index, key=int) + [n for n in once if n not in set(index)]


class _Object(dict):
    """An object that knows its members in order; of members with one name the last one counts."""

    def __init__(self, pairs: list):
        super().__init__(pairs)
        self.names = in_order([name for name, _ in pairs])


def places(wanted: set[str], texts: dict[str, str | None]) -> list[tuple[str, int]]:
    """(path, place among its object's members) of the wanted paths. texts: JSON by the path of its root. Text that cannot be read has no members."""
    found = []
    for root, text in texts.items():
        try:
            todo = [(root, json.loads(text, object_pairs_hook=_Object, parse_int=float))] if text else []
        except (ValueError, RecursionError):
            continue
        while todo:
            path, value = todo.pop()
            if isinstance(value, _Object):
                for place, name in enumerate(value.names):
                    own = f"{path}.{name}"
                    if own in wanted:
                        found.append((own, place))
                    todo.append((own, value[name]))
            elif isinstance(value, list):
                todo += [(f"{path}[{k}]", x) for k, x in enumerate(value)]
    return found
