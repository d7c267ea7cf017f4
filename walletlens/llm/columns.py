"""Names for columns that an operator adds to tables whose columns it does not know."""

from __future__ import annotations


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores in front as it takes to differ from all columns, whatever their case."""
    taken = {column.lower() for column in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
