"""The scalar functions: names, how many arguments they take, and how they become columns.

A builder takes the compiler and compiled arguments and returns a typed column.  Arity is checked when a text is compiled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from siftql.plans.values import CompileProblem

REGISTRY: dict[str, Function] = {}


@dataclass(frozen=True)
class Function:
    name: str
    build: Callable
    least: int
    most: int | None
    #: The builder gets trees rather than compiled arguments.
    raw: bool = False

    def __call__(self, compiler, args):
        if len(args) < self.least or self.most is not None and len(args) > self.most:
            raise CompileProblem(f"{self.name} does not take {len(args)} arguments")
        return self.build(compiler, args) if self.raw else self.build(compiler, *[compiler(a) for a in args])


def function(*names: str, least: int = 1, most: int | None = 1, raw: bool = False):
    """Register a builder under one or more names."""

    def add(build):
        for n in names:
            REGISTRY[n] = Function(n, build, least, most, raw)
        return build

    return add


from siftql.functions import coding, collections, logic, text, times, web  # noqa: E402, F401
