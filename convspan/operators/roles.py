"""Role names and what other dialects call them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Role names and what other dialects call them.
ROLES = ("system", "developer", "user", "assistant", "tool")
ALIASES = {"human": "user", "gpt": "assistant", "function": "tool"}


def role_of(name: Column) -> Column:
    """The role a dialect's name stands for; null if it is none."""
    known = {r: r for r in ROLES} | ALIASES
    return F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[name]
