"""Imports every query module so that it registers its queries."""

from . import texts  # noqa: F401  isort: skip
from . import annotation, decisions, evaluation, model_optimality, model_oracle, models, splits, tables  # noqa: F401
