"""Tables for people, from the rows of the report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame


def cell(v: object) -> str:
    return "—" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")


def table(names: list[str], rows) -> str:
    return "\n".join(["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows)])


def markdown(df: DataFrame, most: int | None = None) -> str:
    """A Markdown table of all rows; with `most` of so many, and a line that says there are more."""
    if most is None:
        return table(df.columns, df.toLocalIterator())
    rows = df.limit(most + 1).collect()
    return table(df.columns, rows[:most]) + ("\n\nmore rows follow" if len(rows) > most else "")


def spread(mean: float | None, low: float | None, high: float | None, sign: str = "") -> str | None:
    return None if mean is None else f"{mean:{sign}.2f} [{low:{sign}.2f}, {high:{sign}.2f}]"
