"""A registry of flows: functions from DataFrames to a DataFrame that name what they need and what they make."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..functions.schema import Rule
from ..sources.catalog import Database, provenance

Flow = Callable[..., DataFrame]


class Flows:
    """flow(name, needs)(function): run(name) makes everything it needs first, each thing once."""

    def __init__(self) -> None:
        self.flows: dict[str, tuple[Flow, tuple[str, ...], Rule | None]] = {}

    def flow(self, name: str, needs: tuple[str, ...] = (), params: Rule | None = None) -> Callable[[Flow], Flow]:
        def add(f: Flow) -> Flow:
            if name in self.flows:
                raise ValueError(f"{name} is registered twice")
            self.flows[name] = (f, needs, params)
            return f

        return add

    def order(self, name: str, made: frozenset[str] = frozenset(), _path: tuple[str, ...] = ()) -> list[str]:
        """What runs for `name` beyond what is made already, in order. A cycle or an unknown name raises ValueError."""
        if name in made:
            return []
        if name in _path:
            raise ValueError("a flow needs itself: " + " > ".join((*_path, name)))
        if name not in self.flows:
            raise ValueError(f"no flow {name}")
        out: list[str] = []
        for n in self.flows[name][1]:
            out += [x for x in self.order(n, made, (*_path, name)) if x not in out]
        return [*out, name]

    def run(self, name: str, given: dict[str, DataFrame] | None = None, **params) -> DataFrame:
        """The flow's result; `given` stands in for flows that are made already."""
        done = dict(given or {})
        for n in self.order(name, frozenset(done)):
            f, needs, rule = self.flows[n]
            if rule is not None:
                rule(params)
            done[n] = f(*(done[x] for x in needs), **(params if rule is not None else {}))
        return done[name]


    def resume(self, name: str, db: Database, given: dict[str, DataFrame], made_from: str = "", **params) -> DataFrame:
        """The flow's result, with every flow on the way written to a database: a run that broke off goes on behind what is there.

        made_from stands for code and inputs; what another provenance made raises ValueError. `given` are not written.
        """
        done = dict(given)
        for n in self.order(name, frozenset(done)):
            by = provenance(n, made_from, sorted(params.items()))
            if n not in db.names():
                f, needs, rule = self.flows[n]
                if rule is not None:
                    rule(params)
                db.write(n, f(*(done[x] for x in needs), **(params if rule is not None else {})), by)
            elif db.made_by(n) != by:
                raise ValueError(f"{n} is there already, made from something else")
            done[n] = db.read(n)
        return done[name]


def chained(df: DataFrame, *handlers: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Row handlers one after the other, as one plan."""
    for h in handlers:
        df = df.transform(h)
    return df
