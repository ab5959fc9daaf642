"""Names of columns: quoted, and such as a table doesn't have yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """The column of just this name, dots and all."""
    return F.col(quoted(name))


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, each made longer until ``df`` has no column of that name, and no two are equal."""
    there, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in there:
            name += "_"
        there.add(name.lower())
        out.append(name)
    return out


def others(df: DataFrame, *names: str) -> list[Column]:
    """All columns of ``df`` as they are, but for those of the names, whatever their case."""
    gone = {n.lower() for n in names}
    return [col(c) for c in df.columns if c.lower() not in gone]
