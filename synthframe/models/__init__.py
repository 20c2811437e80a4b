"""Generative models: fit(df).sample(n) gives exactly n rows in df's columns, order and types."""

from .base import Synthesizer, create, register, registered
from .copula import GaussianCopula, IndependentMarginals
from .identity import Identity
from .network import BayesianNetwork, PrivateMarginals
from .smote import Smote
from .trees import CartChain, PrivateCartChain
from .langevin import LangevinSampler

__all__ = [
    "BayesianNetwork", "CartChain", "GaussianCopula", "Identity", "IndependentMarginals", "LangevinSampler", "PrivateCartChain", "PrivateMarginals", "Smote", "Synthesizer",
    "create", "register", "registered",
]
