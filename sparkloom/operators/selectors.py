"""Attribute selectors: any clause of a list, all columns of a clause, any overlap of a column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Selector = tuple[tuple[tuple[str, tuple[str, ...]], ...], ...]


def normalize_selector(selector) -> Selector | None:
    """None stays None; an empty list matches nothing; scalars become lists; values compare as strings."""
    if selector is None:
        return None
    clauses = [selector] if isinstance(selector, Mapping) else list(selector)
    out = []
    for clause in clauses:
        if not isinstance(clause, Mapping) or not clause:
            raise ValueError(f"a selector clause must be a non-empty mapping, not {clause!r}")
        out.append(tuple((c, tuple(str(v) for v in (a if isinstance(a, Sequence) and not isinstance(a, str) else [a]))) for c, a in sorted(clause.items())))
    return tuple(out)


def matches(selector: Selector, columns: Sequence[str], multi_valued: Sequence[str] = (), types: Mapping[str, str] | None = None) -> Column:
    """The selector as a predicate that is never null; KeyError names a column that is not there.

    types are the columns' types, as in dict(df.dtypes); a boolean column is compared with 'True' and 'False'.
    """
    unknown = sorted({c for clause in selector for c, _ in clause} - set(columns))
    if unknown:
        raise KeyError(f"selector names unknown columns: {', '.join(unknown)}")

    def accepts(column: str, values: tuple[str, ...]) -> Column:
        if column in multi_valued:
            return F.arrays_overlap(F.col(column), F.array(*map(F.lit, values)) if values else F.array().cast("array<string>"))
        # booleans are written as Python writes them, True and False
        cell = F.initcap(F.col(column).cast("string")) if (types or {}).get(column) == "boolean" else F.col(column).cast("string")
        return cell.isin(*values) if values else F.lit(False)

    clauses = [reduce(Column.__and__, [accepts(c, v) for c, v in clause]) for clause in selector]
    return F.coalesce(reduce(Column.__or__, clauses, F.lit(False)), F.lit(False))
