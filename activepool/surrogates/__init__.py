"""Surrogate models: fit on scored rows, predict mean and variance for the whole pool."""

from .base import (  # noqa: F401
    MODELS,
    BatchFunctionSurrogate,
    RandomSurrogate,
    Surrogate,
    build_model,
    ensemble_moments,
    register_model,
    training_rows,
)
from .linear import LinearGaussianSurrogate  # noqa: F401
from .trees import BoostedTreesSurrogate, ForestSurrogate  # noqa: F401
