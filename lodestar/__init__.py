"""Lodestar: a PySpark-native engine for causal statistics and training-data pipelines."""

from lodestar.operators.linear import linear_regression, linear_regression_by
from lodestar.operators.logistic import logistic_regression
from lodestar.operators.logistic_by import logistic_regression_by
from lodestar.operators.results import LinearRegressionResult, LogisticRegressionResult, SyntheticControlResult, SyntheticDIDResult
from lodestar.operators.sdid import synthetic_did
from lodestar.operators.synthetic_control import synthetic_control

__version__ = "0.1.0"

__all__ = [
    "LinearRegressionResult",
    "LogisticRegressionResult",
    "SyntheticControlResult",
    "SyntheticDIDResult",
    "linear_regression",
    "linear_regression_by",
    "logistic_regression",
    "logistic_regression_by",
    "synthetic_control",
    "synthetic_did",
]


def about() -> None:
    """Print the version and what the package offers."""
    print(f"lodestar version {__version__}")
    print("Causal statistics on Spark DataFrames:")
    for line in ("linear regression (HC3, clustered, wild cluster bootstrap)", "logistic regression (HC3, clustered, score bootstrap)", "synthetic difference-in-differences", "synthetic control (traditional, penalized, robust, augmented)"):
        print(f"  - {line}")
