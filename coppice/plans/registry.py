"""Options as strings, name[:parameter], and what they stand for."""

from __future__ import annotations

from ..functions import exprs

FINDERS = ("exhaustive", "random", "quartile", "histogram_ew", "histogram_eq", "adaptive_ew", "adaptive_eq")
CRITERIA = ("mse", "mae", "huber", "quantile", "logcosh", "poisson")
PRUNERS = ("none", "mingain", "cost_complexity", "reduced_error")
RULES = ("sturges", "rice", "sqrt", "freedman_diaconis")


def option(text: str, known: tuple[str, ...], default: str) -> tuple[str, str]:
    """(name, parameter); an unknown name is the default."""
    name, _, param = text.partition(":")
    return (name, param) if name in known else (default, "")


def finder(text: str) -> tuple[str, str]:
    name, param = option({"exact": "exhaustive"}.get(text, text), FINDERS, "exhaustive")
    if name == "random":
        return name, param or "10"
    if name in ("histogram_ew", "histogram_eq"):
        return name, param or "64"
    if name == "adaptive_ew":
        return name, param if param in RULES else "sturges"
    return name, param


def loss(text: str) -> exprs.Loss:
    """First-order losses: squared, huber[:delta], absolute, quantile[:tau]."""
    name, _, param = text.partition(":")
    made = {"squared": exprs.squared, "huber": lambda: exprs.huber(float(param or 1)), "absolute": exprs.absolute, "quantile": lambda: exprs.quantile(float(param or 0.5))}
    if name not in made:
        raise ValueError(f"unknown loss {text!r}")
    return made[name]()


def objective(text: str) -> exprs.Loss:
    """Second-order losses by objective."""
    if text in ("reg:squarederror", "reg:linear"):
        return exprs.newton_squared()
    if text in ("reg:logistic", "binary:logistic"):
        return exprs.newton_logistic()
    raise ValueError(f"unknown objective {text!r}")
