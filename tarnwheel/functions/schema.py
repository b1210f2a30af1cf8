"""A small language of parameter schemas; all errors come with the path to the value."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any


def check_name(name: str) -> None:
    if not re.fullmatch(r"[A-Za-z][\w.\-]*", name):
        raise ValueError(f"not a name: {name!r}")


class Rule:
    """check(value) -> list of messages."""

    def __init__(self, check: Callable[[Any, str], list[str]]):
        self._check = check

    def check(self, value: Any, path: str = "") -> list[str]:
        return self._check(value, path)

    def __call__(self, value: Any) -> Any:
        errors = self.check(value)
        if errors:
            raise ValueError("; ".join(errors))
        return value


def of(*types: type, test: Callable[[Any], bool] | None = None, needs: str = "") -> Rule:
    def check(v: Any, path: str) -> list[str]:
        if not isinstance(v, types) or isinstance(v, bool) and bool not in types:
            return [f"{path or 'value'}: {' or '.join(t.__name__ for t in types)} is needed, not {type(v).__name__}"]
        return [f"{path or 'value'}: {needs or 'not allowed'}"] if test and not test(v) else []

    return Rule(check)


def list_of(item: Rule, least: int = 0) -> Rule:
    def check(v: Any, path: str) -> list[str]:
        if not isinstance(v, (list, tuple)):
            return [f"{path or 'value'}: a list is needed"]
        few = [f"{path or 'value'}: at least {least} items are needed"] if len(v) < least else []
        return few + [e for i, x in enumerate(v) for e in item.check(x, f"{path}[{i}]")]

    return Rule(check)


def dict_of(required: dict[str, Rule], optional: dict[str, Rule] | None = None) -> Rule:
    known = {**required, **(optional or {})}

    def check(v: Any, path: str) -> list[str]:
        if not isinstance(v, dict):
            return [f"{path or 'value'}: a dict is needed"]
        dot = f"{path}." if path else ""
        return [f"{dot}{k}: missing" for k in required if k not in v] + [f"{dot}{k}: unknown" for k in v if k not in known] + [e for k, x in v.items() if k in known for e in known[k].check(x, dot + k)]

    return Rule(check)


def any_of(*rules: Rule) -> Rule:
    def check(v: Any, path: str) -> list[str]:
        found = [r.check(v, path) for r in rules]
        return [] if any(not f for f in found) else [" | ".join(e for f in found for e in f)]

    return Rule(check)
