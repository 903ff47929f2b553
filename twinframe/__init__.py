"""twinframe: two-sided data validation and reconciliation on Spark DataFrames."""

from twinframe.plans.pair import Pair
from twinframe.plans.suite import run_suite
from twinframe.plans.validate import ValidationResult, register_check, validate
from twinframe.sources.registry import load_source, register_source
from twinframe.spec import SuiteSpec, ValidationSpec

__all__ = [
    "Pair",
    "SuiteSpec",
    "ValidationResult",
    "ValidationSpec",
    "load_source",
    "register_check",
    "register_source",
    "run_suite",
    "validate",
]
