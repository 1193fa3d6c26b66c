"""Model terms as columns, their global scaling, and per-group cross-products."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTERCEPT = "(Intercept)"


def order_terms(terms: Sequence[str]) -> list[str]:
    """Main effects before interactions, otherwise as given."""
    unique = list(dict.fromkeys(terms))
    return sorted(unique, key=lambda t: t.count(":"))


def term_column(term: str) -> Column:
    """``a`` or the product ``a:b``."""
    return reduce(lambda a, b: a * b, [F.col(f"`{p.strip()}`").cast("double") for p in term.split(":")])


@dataclass(frozen=True)
class Scales:
    """Shift and scale of every term and of the response."""

    shift: tuple[float, ...]
    scale: tuple[float, ...]
    y_shift: float = 0.0
    y_scale: float = 1.0

    def back(self) -> np.ndarray:
        """T with raw coefficients = T @ scaled coefficients (the response's shift is added to the intercept)."""
        p = len(self.shift)
        t = np.zeros((p + 1, p + 1))
        t[0, 0] = self.y_scale
        for j, (m, s) in enumerate(zip(self.shift, self.scale), start=1):
            t[j, j] = self.y_scale / s
            t[0, j] = -self.y_scale * m / s
        return t


def measure_scales(df: DataFrame, terms: Sequence[str], response: Column | None = None) -> Scales:
    """One pass for the means and standard deviations (two numbers per term reach the driver)."""
    columns = [term_column(t) for t in terms] + ([response] if response is not None else [])
    aggregates = [f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    if not aggregates:
        return Scales((), ())
    row = df.agg(*aggregates).first()
    means = [float(row[f"m{i}"] or 0.0) for i in range(len(columns))]
    spreads = [float(row[f"s{i}"] or 0.0) for i in range(len(columns))]
    spreads = [s if s > 1e-12 * max(abs(m), 1.0) else 1.0 for m, s in zip(means, spreads)]
    if response is None:
        return Scales(tuple(means), tuple(spreads))
    return Scales(tuple(means[:-1]), tuple(spreads[:-1]), means[-1], spreads[-1])


def scaled_terms(terms: Sequence[str], scales: Scales) -> list[Column]:
    """Intercept and standardised terms."""
    return [F.lit(1.0)] + [
        (term_column(t) - F.lit(m)) / F.lit(s) for t, m, s in zip(terms, scales.shift, scales.scale)
    ]


def packed_products(columns: Sequence[Column], weight: Column | None = None) -> Column:
    """Aggregate expression: the upper triangle of the sums of products, row by row, as one array."""
    sums = []
    for i, a in enumerate(columns):
        for b in columns[i:]:
            sums.append(F.sum(a * b if weight is None else weight * a * b))
    return F.array(*sums)


def unpack(packed: np.ndarray, width: int) -> np.ndarray:
    """(G, width*(width+1)/2) packed rows to (G, width, width) symmetric matrices."""
    rows, cols = np.triu_indices(width)
    full = np.zeros((len(packed), width, width))
    full[:, rows, cols] = packed
    full[:, cols, rows] = packed
    return full


def pack(full: np.ndarray) -> np.ndarray:
    rows, cols = np.triu_indices(full.shape[-1])
    return full[..., rows, cols]
