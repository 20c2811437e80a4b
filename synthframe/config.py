"""Profiles of parameters, with overrides from dictionaries, dotted names and the environment."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping

PROFILES: dict[str, dict] = {
    "default": {"seed": 0, "models": {}},
    "quick": {"seed": 0, "models": {"cart": {"depth": 4}, "bayesian_network": {"bins": 10}, "langevin": {"steps": 5}}},
    "production": {"seed": 0, "models": {"cart": {"depth": 12}, "bayesian_network": {"bins": 50}, "marginals": {"knots": 1001}, "gaussian_copula": {"knots": 1001}}},
}
PREFIX = "SYNTHFRAME_"


def merged(base: Mapping, over: Mapping) -> dict:
    """base with over's values, dictionaries inside merged as well."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def dotted(overrides: Mapping[str, object]) -> dict:
    """{'a.b': 1} -> {'a': {'b': 1}}"""
    out: dict = {}
    for name, value in overrides.items():
        for part in reversed(name.split(".")):
            value = {part: value}
        out = merged(out, value)
    return out


def parsed(text: str):
    """JSON if it is any, else the text itself."""
    try:
        return json.loads(text)
    except ValueError:
        return text


def from_environment(model: str | None = None, environ: Mapping[str, str] | None = None) -> dict:
    """SYNTHFRAME_<PARAMETER> and, before it, SYNTHFRAME_<MODEL>_<PARAMETER>; of a known model only its own."""
    environ = os.environ if environ is None else environ
    from .models import registered

    models = [m.upper() + "_" for m in registered()]
    out, own = {}, {}
    for name, text in environ.items():
        if not name.startswith(PREFIX):
            continue
        rest = name[len(PREFIX) :]
        of = next((m for m in sorted(models, key=len, reverse=True) if rest.startswith(m)), None)
        if of is None:
            out[rest.lower()] = parsed(text)
        elif model and of == model.upper() + "_":
            own[rest[len(of) :].lower()] = parsed(text)
    return out | own


def load_profile(name: str = "default", model: str | None = None, overrides: Mapping[str, object] | None = None) -> dict:
    """The parameters of a profile (of one model in it), with overrides over them and the environment over all."""
    if name not in PROFILES:
        raise ValueError(f"unknown profile {name!r}; there are {', '.join(PROFILES)}")
    profile = merged(PROFILES[name], dotted(overrides or {}))
    if model is None:
        return merged(profile, from_environment())
    own = {"seed": profile["seed"]} | profile["models"].get(model, {}) | from_environment(model)
    return validated(own)


def validated(parameters: dict) -> dict:
    bad = [k for k in ("bins", "depth", "knots", "k", "steps", "anchors") if k in parameters and not (isinstance(parameters[k], int) and parameters[k] > 0)]
    if bad:
        raise ValueError(f"not a positive whole number: {', '.join(bad)}")
    return parameters


def register_profile(name: str, profile: Mapping) -> None:
    PROFILES[name] = merged(PROFILES["default"], profile)
