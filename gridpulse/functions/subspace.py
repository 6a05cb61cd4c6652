"""Arithmetic of the subspace model: second moments, principal axes, residual norms."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Below these a scale, an eigenvalue or a residual is round-off.
ZERO_SCALE = 1e-12
DOUBLE_EPSILON = 2.0**-52
ZERO_EIGENVALUE = 1e-9
ZERO_RESIDUAL = 1e-6

AXES = "rank int, eigenvalues array<double>, components array<array<double>>, outside array<double>"


def snap(x: Column) -> Column:
    """Round-off residuals are zero."""
    return F.when(x <= F.lit(ZERO_RESIDUAL), F.lit(0.0)).otherwise(x)


def standardised(features: Sequence[str], mean: str = "mean", scale: str = "scale") -> list[Column]:
    return [(F.col(f) - F.col(mean)[i]) / F.col(scale)[i] for i, f in enumerate(features)]


def flat_model(features: Sequence[str], mean: str = "mean", residual_map: str = "residual_map") -> list[Column]:
    """The model's arrays as scalar columns, which is how rows are scored: an array access costs a
    null and a bounds check in the generated code each time, and there would be p² + p of them."""
    p = len(features)
    means = [F.col(mean)[i].alias(f"_m{i}") for i in range(p)]
    return means + [F.col(residual_map)[i * p + j].alias(f"_r{i}_{j}") for i in range(p) for j in range(p)]


def raw_residual(features: Sequence[str]) -> Column:
    """Length of the part of a row outside the kept axes, from `flat_model` columns.

    Every operand occurs once (hence the power instead of a product): a filter on this value is
    merged into the join before it, where nothing removes repeated terms.
    """
    p = range(len(features))
    parts = [" + ".join(f"_r{i}_{j} * (`{features[j]}` - _m{j})" for j in p) for i in p]
    return F.expr("sqrt(" + " + ".join(f"power({part}, 2.0D)" for part in parts) + ")")


def principal_axes(k: int, p: int):
    """Pandas UDF: flat p×p second-moment matrix of one cell to its axes and the map onto the rest.

    One row per cell, decomposed a batch at a time. Kept are the first k axes whose eigenvalue is above
    round-off. Equal eigenvalues have no axes of their own, so where the cut falls among them their space
    gets the axes that come first when rotations take in one feature after the other: each is made of as few
    of the leading features as the space allows (from the last feature back, its projection is set apart). The
    map I - VVᵀ onto the rest does not depend on the sign of the axes; the axes are signed so
    that their largest entry is positive. The function refers to nothing in this package, so executors
    need not have it installed.
    """
    tiny = ZERO_EIGENVALUE

    @F.pandas_udf(AXES)
    def axes(moments: pd.Series) -> pd.DataFrame:
        matrices = np.stack(moments.to_numpy()).astype(float).reshape(-1, p, p)
        fine = np.isfinite(matrices).all(axis=(1, 2))
        values, vectors = np.linalg.eigh(np.where(fine[:, None, None], matrices, 0.0))
        values, vectors = values[:, ::-1], np.swapaxes(vectors, 1, 2)[:, ::-1, :].copy()
        cut = min(k, p)
        for i in np.flatnonzero((values[:, cut - 1] > tiny) & (values[:, cut - 1] - values[:, min(cut, p - 1)] <= tiny)) if cut < p else ():
            tied = np.flatnonzero(np.abs(values[i] - values[i, cut - 1]) <= tiny)
            held = []
            for axis in (vectors[i, tied].T @ vectors[i, tied])[::-1]:
                for other in held:
                    axis = axis - (axis @ other) * other
                if len(held) < len(tied) and np.linalg.norm(axis) > 1e-6:
                    held.append(axis / np.linalg.norm(axis))
            if len(held) == len(tied):
                vectors[i, tied] = held[::-1]
        largest = np.take_along_axis(vectors, np.abs(vectors).argmax(axis=2)[:, :, None], axis=2)
        vectors = vectors * np.where(largest < 0, -1.0, 1.0)
        rank = np.minimum((values > tiny).sum(axis=1), cut)
        dropped = vectors * (np.arange(p)[None, :] >= rank[:, None])[:, :, None]
        outside = np.einsum("nij,nik->njk", dropped, vectors).reshape(-1, p * p)
        rows = [
            (int(r), values[i].tolist(), vectors[i, :r].tolist(), outside[i].tolist()) if fine[i]
            else (None, None, None, None)
            for i, r in enumerate(rank)
        ]
        return pd.DataFrame(rows, columns=["rank", "eigenvalues", "components", "outside"])

    # Not deterministic to the optimizer, which would otherwise write the call out once per use of its result.
    return axes.asNondeterministic()
