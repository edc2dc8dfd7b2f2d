"""Helpers for composing Spark SQL expression text.

The functions of this package take and return SQL expression text, for ``selectExpr`` / ``expr``. Large
expressions are parsed by Spark in one go; building the same trees one Column call at a time costs more
than running them on a small batch, which hurts a streaming job at every trigger.
"""

from __future__ import annotations

import itertools

_names = itertools.count()


def q(value) -> str:
    """A literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value)
    text = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return f"'{text}'"


def array(values) -> str:
    return "array(" + ", ".join(q(v) for v in values) + ")"


def let(value: str, body) -> str:
    """Bind ``value`` once and use it several times in ``body``, a function of the bound name."""
    name = f"v{next(_names)}"
    return f"get(transform(array({value}), {name} -> {body(name)}), 0)"


def case(pairs, otherwise: str = "NULL") -> str:
    whens = " ".join(f"WHEN {cond} THEN {value}" for cond, value in pairs)
    return f"CASE {whens} ELSE {otherwise} END"


def transform(xs: str, body) -> str:
    name = f"v{next(_names)}"
    return f"transform({xs}, {name} -> {body(name)})"


def keep(xs: str, condition) -> str:
    name = f"v{next(_names)}"
    return f"filter({xs}, {name} -> {condition(name)})"


def struct(**fields) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def leading(xs: str, before) -> str:
    """How many entries of a sorted array stand before a place, by binary search.

    ``before`` tells of an entry whether it does; it must hold for a first part of the array and not behind it.
    """
    at, step = f"v{next(_names)}", f"v{next(_names)}"
    steps = array(2**k for k in range(30, -1, -1))
    return (f"aggregate({steps}, 0, ({at}, {step}) -> if({at} + {step} <= size({xs}) "
            f"AND {before(f'get({xs}, {at} + {step} - 1)')}, {at} + {step}, {at}))")
