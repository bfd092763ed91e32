"""Constants that say what they are: plain values with a description, as inputs of `for_each`."""

from __future__ import annotations

import inspect
import operator
from dataclasses import dataclass, field


@dataclass(frozen=True, eq=False)
class Constant:
    """A value with a description and the place it was written at. It computes and compares like its value."""

    value: object
    description: str = ""
    line: str = field(default="", compare=False)

    def __post_init__(self):
        if isinstance(self.value, Constant):
            raise TypeError("a Constant can't hold a Constant")
        if not self.line:
            at = inspect.stack()[2]
            object.__setattr__(self, "line", f"{at.filename}:{at.lineno}")

    def __hash__(self):
        return hash(self.value)

    def __getattr__(self, name):
        if name.startswith("__"):
            raise AttributeError(name)
        return getattr(self.value, name)

    def __repr__(self):
        return repr(self.value)

    def __str__(self):
        return str(self.value)

    def __format__(self, spec):
        return format(self.value, spec)


def plain_value(value):
    """The value of a Constant, of anything else itself; lists and dicts are looked into."""
    if isinstance(value, Constant):
        return value.value
    if type(value) in (list, tuple):
        return type(value)(map(plain_value, value))
    return {k: plain_value(v) for k, v in value.items()} if type(value) is dict else value


def _both(of):
    return lambda self, other: of(self.value, plain_value(other))


def _turned(of):
    return lambda self, other: of(plain_value(other), self.value)


for _name in ("add", "sub", "mul", "truediv", "floordiv", "mod", "pow", "matmul"):
    setattr(Constant, f"__{_name}__", _both(getattr(operator, _name)))
    setattr(Constant, f"__r{_name}__", _turned(getattr(operator, _name)))
for _name in ("eq", "ne", "lt", "le", "gt", "ge", "getitem", "contains"):
    setattr(Constant, f"__{_name}__", _both(getattr(operator, _name)))
for _name, _of in {"neg": operator.neg, "abs": abs, "len": len, "iter": iter, "int": int, "float": float, "bool": bool, "index": operator.index}.items():
    setattr(Constant, f"__{_name}__", lambda self, of=_of: of(self.value))
