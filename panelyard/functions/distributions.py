"""Student-t and normal helpers: in numpy where a solve runs inside a task, and the normal quantile as a column."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


NORMAL_FROM = 1e5


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.lgamma, otypes=[float])(x)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta integral (modified Lentz evaluation)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    total = d.copy()
    for m in range(1, 400):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + numerator / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            total = total * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    return total


def incomplete_beta(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inner) + b * np.log1p(-inner))
    flip = inner > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - inner, inner)
    part = front * _beta_fraction(p, q, z) / p
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(flip, 1 - part, part)))


def t_two_sided(t, df) -> np.ndarray:
    """Two-sided p-value of a t statistic; NaN where it has no degrees of freedom. Above ``NORMAL_FROM`` degrees of
    freedom through the normal distribution, corrected to the order of 1 / df."""
    t, df = np.broadcast_arrays(np.asarray(t, dtype=float), np.asarray(df, dtype=float))
    out = np.full(t.shape, np.nan)
    ok = (df > 0) & ~np.isnan(t)
    many = ok & (df > NORMAL_FROM)
    few = ok & ~many
    if few.any():
        n, s = df[few], np.square(t[few])
        out[few] = incomplete_beta(n / 2, 0.5, n / (n + s))
    if many.any():
        n, x = df[many], t[many]
        z = x * (1 - 1 / (4 * n)) / np.sqrt(1 + np.square(x) / (2 * n))
        out[many] = [normal_two_sided(v) for v in z.tolist()]
    return out


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


# The coefficients of Wichura's algorithm AS 241 (1988) for the normal quantile, numerator and denominator
# of its three ranges, highest power first.
AS241 = (
    (2509.0809287301227, 33430.57558358813, 67265.7709270087, 45921.95393154987, 13731.69376550946, 1971.5909503065513, 133.14166789178438, 3.3871328727963665),
    (5226.495278852854, 28729.085735721943, 39307.89580009271, 21213.794301586597, 5394.196021424751, 687.1870074920579, 42.31333070160091, 1.0),
    (0.0007745450142783414, 0.022723844989269184, 0.2417807251774506, 1.2704582524523684, 3.6478483247632045, 5.769497221460691, 4.630337846156546, 1.4234371107496835),
    (1.0507500716444169e-09, 0.0005475938084995345, 0.015198666563616457, 0.14810397642748008, 0.6897673349851, 1.6763848301838038, 2.053191626637759, 1.0),
    (2.0103343992922881e-07, 2.7115555687434876e-05, 0.0012426609473880784, 0.026532189526576124, 0.29656057182850487, 1.7848265399172913, 5.463784911164114, 6.657904643501103),
    (2.0442631033899397e-15, 1.421511758316446e-07, 1.8463183175100548e-05, 0.0007868691311456133, 0.014875361290850615, 0.1369298809227358, 0.599832206555888, 1.0),
)
AS241_CENTRE, AS241_CENTRE_SQUARE, AS241_SHIFT, AS241_FAR = 0.425, 0.180625, 1.6, 5.0


def normal_quantile_column(p: Column) -> Column:
    """Normal quantile of a column strictly between 0 and 1, to about sixteen digits, as built-in expressions."""

    def ratio(r: Column, over: tuple[float, ...], under: tuple[float, ...]) -> Column:
        def horner(terms: tuple[float, ...]) -> Column:
            out = F.lit(terms[0])
            for t in terms[1:]:
                out = out * r + F.lit(t)
            return out

        return horner(over) / horner(under)

    q = p - F.lit(0.5)
    tail = F.sqrt(-F.log(F.least(p, F.lit(1.0) - p)))
    near = ratio(tail - F.lit(AS241_SHIFT), AS241[2], AS241[3])
    far = ratio(tail - F.lit(AS241_FAR), AS241[4], AS241[5])
    outer = F.when(tail <= AS241_FAR, near).otherwise(far)
    centre = q * ratio(F.lit(AS241_CENTRE_SQUARE) - q * q, AS241[0], AS241[1])
    return F.when(F.abs(q) <= AS241_CENTRE, centre).otherwise(F.when(q < 0, -outer).otherwise(outer))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))
