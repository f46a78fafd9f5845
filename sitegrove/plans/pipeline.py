"""A pipeline of transforms: queue, if, else, endif, run.

As conditions are values at the time the chain is built, and only the innermost one counts, a true condition within a
false one still runs its steps.
"""

from __future__ import annotations

from collections.abc import Callable

from sitegrove.graph import Graph
from sitegrove.session import cut

#: Transforms by name.
TRANSFORMS: dict[str, Callable[..., Graph]] = {}


def transform(f: Callable[..., Graph]) -> Callable[..., Graph]:
    """Registers a transform under its name."""
    TRANSFORMS[f.__name__] = f
    return f


class PipelineError(Exception):
    """A step failed; the message names it."""


class Pipeline:
    """pipeline.queue(step).if_(flag).some_transform(...).endif().run(graph)"""

    def __init__(self) -> None:
        self.steps: list[tuple[str, Callable[[Graph], Graph]]] = []
        self.conditions: list[bool] = []

    def queue(self, *steps: Callable[[Graph], Graph] | None) -> Pipeline:
        """Adds steps; falsy ones are skipped."""
        if not self.conditions or self.conditions[-1]:
            self.steps.extend((getattr(s, "__name__", "step"), s) for s in steps if s)
        return self

    def if_(self, condition: object) -> Pipeline:
        self.conditions.append(bool(condition))
        return self

    def else_(self) -> Pipeline:
        if not self.conditions:
            raise PipelineError("else without if")
        self.conditions[-1] = not self.conditions[-1]
        return self

    def endif(self) -> Pipeline:
        if not self.conditions:
            raise PipelineError("endif without if")
        self.conditions.pop()
        return self

    def __getattr__(self, name: str) -> Callable[..., Pipeline]:
        if name not in TRANSFORMS:
            raise AttributeError(name)

        def add(*args, **options) -> Pipeline:
            step = lambda graph: TRANSFORMS[name](graph, *args, **options)
            step.__name__ = name
            return self.queue(step)

        return add

    def run(self, graph: Graph, listen: Callable[[str, str], None] | None = None, keep: bool = False) -> Graph:
        """The graph after all steps; `listen` hears ('before' | 'after', name).

        With keep, each table that a step changed is written to the shared checkpoint folder, so a later step neither
        computes it again nor depends on what came before.
        """
        if self.conditions:
            raise PipelineError("if without endif")
        for name, step in self.steps:
            if listen:
                listen("before", name)
            try:
                after = step(graph)
                if keep:
                    after = after.with_(cut(after.assets) if after.assets is not graph.assets else None, cut(after.relations) if after.relations is not graph.relations else None)
                graph = after
            except Exception as e:
                raise PipelineError(f"{name} transform: {e}") from e
            if listen:
                listen("after", name)
        return graph
