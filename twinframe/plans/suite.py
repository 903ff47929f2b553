"""Several validations run one after the other, and their consolidated results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from twinframe.operators import summaries
from twinframe.operators.results import union_all
from twinframe.plans.validate import ValidationResult, validate
from twinframe.sources import sinks
from twinframe.spec import SuiteSpec


@dataclass
class SuiteResult:
    results: list[ValidationResult]

    @property
    def df(self) -> DataFrame:
        """Result rows of all validations, ``validation_name`` first."""
        return union_all(r.named() for r in self.results)

    def summary(self) -> DataFrame:
        return summaries.consolidated_summary(self.df)

    def failed(self) -> bool:
        return any(r.failed() for r in self.results)

    def write(self, fmt: str = "csv") -> list[str]:
        """Each validation's rows, and with more than one the consolidated rows in the first one's folder."""
        paths = [sinks.write_results(r.ordered(), r.spec.output_dir, r.spec.name, fmt) for r in self.results]
        if len(self.results) > 1:
            paths.append(sinks.write_results(self.df, self.results[0].spec.output_dir, "consolidated", fmt))
        return paths

    def close(self) -> None:
        """Delete what the runs have written to the shared folder."""
        for result in self.results:
            result.close()


def run_suite(spark: SparkSession, suite: SuiteSpec) -> SuiteResult:
    """Run every validation once; its result rows are kept in the shared folder, so reports rerun nothing."""
    return SuiteResult([validate(spark, spec).materialized() for spec in suite.validations])
