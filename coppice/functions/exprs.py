"""Losses, gradients, hessians and structure scores as column expressions.

First-order losses give the negative gradient (the residual a tree is fitted to and added with); second-order losses give
the true gradient, negated in the leaf weight. The two conventions are kept apart on purpose.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Margins are clamped to this before exp().
MARGIN = 250.0


@dataclass(frozen=True)
class Loss:
    """loss, gradient and hessian of (label, prediction)."""

    name: str
    loss: Callable[[Column, Column], Column]
    gradient: Callable[[Column, Column], Column]
    hessian: Callable[[Column, Column], Column]


def squared() -> Loss:
    return Loss("squared", lambda y, p: 0.5 * (y - p) * (y - p), lambda y, p: y - p, lambda y, p: F.lit(1.0))


def huber(delta: float = 1.0) -> Loss:
    def loss(y: Column, p: Column) -> Column:
        r = F.abs(y - p)
        return F.when(r <= delta, 0.5 * r * r).otherwise(delta * (r - 0.5 * delta))

    return Loss("huber", loss, lambda y, p: F.least(F.greatest(y - p, F.lit(-delta)), F.lit(delta)), lambda y, p: F.when(F.abs(y - p) <= delta, 1.0).otherwise(0.0))


def absolute() -> Loss:
    return Loss("absolute", lambda y, p: F.abs(y - p), lambda y, p: F.signum(y - p), lambda y, p: F.lit(0.0))


def quantile(tau: float = 0.5) -> Loss:
    t = tau if 0 < tau < 1 else 0.5
    return Loss("quantile", lambda y, p: F.when(y >= p, t * (y - p)).otherwise((t - 1) * (y - p)), lambda y, p: F.when(y >= p, t).otherwise(t - 1), lambda y, p: F.lit(0.0))


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.least(F.greatest(z, F.lit(-MARGIN)), F.lit(MARGIN))))


def newton_squared() -> Loss:
    return Loss("reg:squarederror", lambda y, p: 0.5 * (y - p) * (y - p), lambda y, p: p - y, lambda y, p: F.lit(1.0))


def newton_logistic() -> Loss:
    def loss(y: Column, p: Column) -> Column:
        z = F.least(F.greatest(p, F.lit(-MARGIN)), F.lit(MARGIN))
        return y * F.log1p(F.exp(-z)) + (1.0 - y) * F.log1p(F.exp(z))

    return Loss("binary:logistic", loss, lambda y, p: sigmoid(p) - y, lambda y, p: sigmoid(p) * (1.0 - sigmoid(p)))


def structure_score(g: Column, h: Column, lam: float = 1.0) -> Column:
    """Half G^2 / (H + lambda); zero where the denominator is not positive."""
    return F.when(h + lam > 0, 0.5 * g * g / (h + lam)).otherwise(0.0)


def soft(g: Column, alpha: float) -> Column:
    """G after the L1 term: drawn towards zero by alpha."""
    return F.signum(g) * F.greatest(F.abs(g) - alpha, F.lit(0.0)) if alpha else g


def leaf_weight(g: Column, h: Column, lam: float = 1.0, alpha: float = 0.0) -> Column:
    return F.when(h + lam > 0, -soft(g, alpha) / (h + lam)).otherwise(0.0)


def log_cosh(r: Column) -> Column:
    """log(cosh(r)) that does not overflow."""
    return F.abs(r) + F.log1p(F.exp(-2.0 * F.abs(r))) - F.ln(F.lit(2.0))


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
