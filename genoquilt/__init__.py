"""Association scans on Spark DataFrames."""

from .plans.api import LinearResult, MultivariateResult, run_linear, run_multivariate, run_unrelated
from .plans.fixtures import toy_dataset

__all__ = ["LinearResult", "MultivariateResult", "run_linear", "run_multivariate", "run_unrelated", "toy_dataset"]
