"""Quantile functions by name: the extension point of a prior.

A prior names a quantile function and carries a bag of fields.  Fields the function does not take are dropped, so
``mean`` and ``sd`` may ride along on a uniform prior.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# --- fixed values: coefficients of algorithm AS 241 (normal quantile, 16 digits), highest power first -------------
CENTRE = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
    (5226.495278852545925, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0),
)
TAIL = (
    (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0),
)
FAR_TAIL = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772),
    (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0),
)
# --- end of fixed values ---------------------------------------------------------------------------------------

_REGISTRY: dict[str, Callable[..., Column]] = {}
_VECTORS: dict[str, Callable[..., Column]] = {}


def register_qfun(name: str, builder: Callable[..., Column]) -> None:
    """Make ``builder(p, **fields) -> Column`` available under ``name``."""
    _REGISTRY[name] = builder


def register_vector_qfun(name: str, function: Callable[..., pd.Series]) -> None:
    """Make a vectorised function ``(p, **fields) -> Series`` of doubles available under ``name``: for quantiles that no column form expresses.

    It runs on Arrow batches, and only if ``name`` has no column form. The first argument takes the probabilities; every other argument is a field of the prior and
    needs a default, which stands in for a missing one.
    """
    first, *fields = inspect.signature(function).parameters.values()
    loose = [f.name for f in fields if f.default is inspect.Parameter.empty or isinstance(f.default, bool) or not isinstance(f.default, int | float)]
    if first.kind not in (inspect.Parameter.POSITIONAL_ONLY, inspect.Parameter.POSITIONAL_OR_KEYWORD) or loose:
        raise TypeError(f"{name}: a quantile function takes probabilities and fields with numeric defaults; not so: {loose or [first.name]}")
    names = [f.name for f in fields]

    def checked(p: pd.Series, *values: pd.Series) -> pd.Series:
        out = function(p, **dict(zip(names, values, strict=True)))
        if len(out) != len(p) or not np.issubdtype(np.asarray(out).dtype, np.floating):
            raise TypeError(f"{name}: expected {len(p)} doubles")
        return pd.Series(out, dtype="float64")

    vector = F.pandas_udf(checked, DoubleType())

    def build(p: Column, **given: object) -> Column:
        return vector(p.cast("double"), *[F.coalesce(_as_column(given.get(f.name, f.default)).cast("double"), F.lit(float(f.default))) for f in fields])

    build.__signature__ = inspect.signature(function)
    _VECTORS[name] = build


def _builder(name: str) -> Callable[..., Column]:
    found = _REGISTRY.get(name) or _VECTORS.get(name)
    if found is None:
        raise ValueError(f"unknown quantile function {name!r}; known: {sorted({*_REGISTRY, *_VECTORS})}")
    return found


def row_quantile(p: Column, columns: Sequence[str], vectors: Sequence[str] = ()) -> Column:
    """The quantile at ``p`` of the prior that stands in the same row: its function by name in ``qfun`` (``qunif`` when missing), its fields in columns.

    Fields that a row leaves null take the function's default; a name that is not registered fails. Of the vector functions only those named in ``vectors`` are planned.
    """
    name = F.coalesce("qfun", F.lit("qunif")) if "qfun" in columns else F.lit("qunif")
    out = F
    for known in [*_REGISTRY, *(v for v in vectors if v not in _REGISTRY)]:
        builder = _builder(known)
        _, *fields = inspect.signature(builder).parameters.values()
        given = {f.name: F.coalesce(F.col(f.name).cast("double"), F.lit(float(f.default))) for f in fields if f.name in columns}
        out = out.when(name == known, builder(p, **given))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown quantile function "), name)).cast("double"))


def apply_qfun(p: Column, spec: Mapping[str, object]) -> Column:
    """The quantile at probability ``p`` of the prior ``spec``; ``qunif`` when no function is named."""
    name = spec.get("qfun") or "qunif"
    builder = _builder(name)
    taken = inspect.signature(builder).parameters
    fields = {k: v for k, v in spec.items() if k != "qfun" and k in taken and v is not None}
    return builder(p, **fields)


def _as_column(value: object) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def _qunif(p: Column, min: object = 0.0, max: object = 1.0) -> Column:
    low, high = _as_column(min), _as_column(max)
    return low + p * (high - low)


def _qexp(p: Column, rate: object = 1.0) -> Column:
    return -F.log1p(-p) / _as_column(rate)


def _ratio(r: Column, parts: tuple[Sequence[float], Sequence[float]]) -> Column:
    """Quotient of two polynomials by Horner's rule."""
    above, below = (reduce(lambda acc, c: acc * r + F.lit(c), part[1:], F.lit(part[0])) for part in parts)
    return above / below


def _standard_normal_quantile(p: Column) -> Column:
    """In plain column arithmetic, to about 1e-15; infinite at and beyond 0 and 1, null for null, NaN for NaN."""
    q = p - 0.5
    centre = q * _ratio(F.lit(0.180625) - q * q, CENTRE)
    r = F.sqrt(-F.ln(F.least(p, F.lit(1.0) - p)))
    tail = F.when(r <= 5.0, _ratio(r - 1.6, TAIL)).otherwise(_ratio(r - 5.0, FAR_TAIL))
    inside = F.when(F.abs(q) <= 0.425, centre).when(q < 0.0, -tail).otherwise(tail)
    return F.when(F.isnan(p), p).when(p <= 0.0, F.lit(float("-inf"))).when(p >= 1.0, F.lit(float("inf"))).when(p.isNotNull(), inside)


def _qnorm(p: Column, mean: object = 0.0, sd: object = 1.0) -> Column:
    return _as_column(mean) + _as_column(sd) * _standard_normal_quantile(p)


register_qfun("qunif", _qunif)
register_qfun("qexp", _qexp)
register_qfun("qnorm", _qnorm)
