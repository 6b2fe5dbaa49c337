"""What the estimators return: records that print like an equation and turn into one-row DataFrames."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession


class Result:
    """A record; ``to_df`` gives it as one row, for writing or joining."""

    SCHEMA = ""

    def to_df(self, spark: SparkSession) -> DataFrame:
        names = [part.strip().split(" ")[0] for part in self.SCHEMA.split(", ")]
        values = asdict(self)  # type: ignore[call-overload]
        return spark.createDataFrame([tuple(values[n] for n in names)], self.SCHEMA)


def _number(x: float | None) -> str:
    return "None" if x is None else f"{x:.6f}"


_INFERENCE = "n_clusters bigint, cluster_se_type string, bootstrap_iterations_used bigint"


@dataclass
class LinearRegressionResult(Result):
    coefficients: list[float]
    intercept: float | None
    r_squared: float
    n_samples: int
    standard_errors: list[float]
    intercept_se: float | None
    n_clusters: int | None = None
    cluster_se_type: str | None = None
    bootstrap_iterations_used: int | None = None
    warnings: list[str] = field(default_factory=list)

    SCHEMA = "coefficients array<double>, intercept double, r_squared double, n_samples bigint, standard_errors array<double>, intercept_se double, " + _INFERENCE + ", warnings array<string>"

    @property
    def slope(self) -> float | None:
        """The coefficient, if there is just one."""
        return self.coefficients[0] if len(self.coefficients) == 1 else None

    def __repr__(self) -> str:
        kind = "None" if self.cluster_se_type is None else f'"{self.cluster_se_type}"'
        return (
            f"LinearRegressionResult(coefficients={self.coefficients}, intercept={_number(self.intercept)}, r_squared={self.r_squared:.6f}, n_samples={self.n_samples}, "
            f"standard_errors={self.standard_errors}, intercept_se={_number(self.intercept_se)}, n_clusters={self.n_clusters}, cluster_se_type={kind}, bootstrap_iterations_used={self.bootstrap_iterations_used})"
        )

    def __str__(self) -> str:
        constant = "" if self.intercept is None else f" + {self.intercept:.6f}"
        if len(self.coefficients) == 1:
            line = f"{self.coefficients[0]:.6f} ± {self.standard_errors[0]:.6f}x"
        else:
            line = " + ".join(f"{c:.6f}*x{k}" for k, c in enumerate(self.coefficients, 1))
        return f"y = {line}{constant} (R² = {self.r_squared:.6f}, n = {self.n_samples})"


@dataclass
class LogisticRegressionResult(Result):
    coefficients: list[float]
    intercept: float | None
    standard_errors: list[float]
    intercept_se: float | None
    n_samples: int
    converged: bool
    iterations: int
    log_likelihood: float
    pseudo_r_squared: float
    n_clusters: int | None = None
    cluster_se_type: str | None = None
    bootstrap_iterations_used: int | None = None
    warnings: list[str] = field(default_factory=list)

    SCHEMA = (
        "coefficients array<double>, intercept double, standard_errors array<double>, intercept_se double, n_samples bigint, converged boolean, iterations bigint, log_likelihood double, pseudo_r_squared double, "
        + _INFERENCE
        + ", warnings array<string>"
    )

    def __str__(self) -> str:
        constant = [] if self.intercept is None else [f"{self.intercept:.6f}"]
        line = " + ".join([*(f"{c:.6f}*x{k}" for k, c in enumerate(self.coefficients, 1)), *constant])
        return f"logit(P(y=1)) = {line} (log-likelihood = {self.log_likelihood:.4f}, pseudo R² = {self.pseudo_r_squared:.4f}, n = {self.n_samples})"


@dataclass
class SyntheticDIDResult(Result):
    att: float
    standard_error: float
    unit_weights: list[float]
    time_weights: list[float]
    n_units_control: int
    n_units_treated: int
    n_periods_pre: int
    n_periods_post: int
    solver_iterations: tuple[int, int]
    solver_converged: bool
    pre_treatment_fit: float
    bootstrap_iterations_used: int
    #: Steps that the two solvers took, and their last duality gaps.
    steps: tuple[int, int] = (0, 0)
    gaps: tuple[float, float] = (0.0, 0.0)
    warnings: list[str] = field(default_factory=list)

    SCHEMA = (
        "att double, standard_error double, unit_weights array<double>, time_weights array<double>, n_units_control bigint, n_units_treated bigint, n_periods_pre bigint, n_periods_post bigint, "
        "solver_iterations struct<unit:bigint,time:bigint>, solver_converged boolean, pre_treatment_fit double, bootstrap_iterations_used bigint, warnings array<string>"
    )

    def __str__(self) -> str:
        return f"SDID ATT = {self.att:.6f} ± {self.standard_error:.6f} ({self.n_units_treated} treated, {self.n_units_control} control units; {self.n_periods_pre} periods before, {self.n_periods_post} after)"


@dataclass
class SyntheticControlResult(Result):
    att: float
    standard_error: float | None
    unit_weights: list[float]
    pre_treatment_rmse: float
    pre_treatment_mse: float
    method: str
    lambda_used: float | None
    n_units_control: int
    n_periods_pre: int
    n_periods_post: int
    solver_converged: bool
    solver_iterations: int
    n_placebo_used: int | None
    n_failed_iterations: int | None
    #: The penalty that was in effect, also where it was selected and not given.
    lambda_selected: float | None = None
    warnings: list[str] = field(default_factory=list)

    SCHEMA = (
        "att double, standard_error double, unit_weights array<double>, pre_treatment_rmse double, pre_treatment_mse double, method string, lambda_used double, n_units_control bigint, n_periods_pre bigint, "
        "n_periods_post bigint, solver_converged boolean, solver_iterations bigint, n_placebo_used bigint, n_failed_iterations bigint, lambda_selected double, warnings array<string>"
    )

    def __str__(self) -> str:
        error = "" if self.standard_error is None else f" ± {self.standard_error:.6f}"
        return f"Synthetic control ({self.method}) ATT = {self.att:.6f}{error} (pre-treatment RMSE {self.pre_treatment_rmse:.6f}, {self.n_units_control} control units)"
