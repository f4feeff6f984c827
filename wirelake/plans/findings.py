"""Findings: what a check reports, as rows (severity, category, description, details, n).

A check is a detector reduced to one row. A report is a list of checks: their union is one lazy plan, and `run`
executes them side by side. The `packets` they read may be any DataFrame; each check prunes the scan to its own
columns.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, functions as F

from wirelake.errors import one_of

# Severities, most severe first.
SEVERITIES = ("critical", "high", "medium", "low", "info")


def finding(rows: DataFrame, severity: str, category: str, description: str, details: Column | None = None,
            more_than: int = 0) -> DataFrame:
    """One finding row when `rows` has more than `more_than` rows, else none.

    `description` is text with `{n}` for the number of rows; `details` is an aggregate over `rows`.
    """
    one_of("severity", severity, SEVERITIES)
    before, _, after = description.partition("{n}")
    has_number = "{n}" in description
    text = F.concat(F.lit(before), F.col("n").cast("string"), F.lit(after)) if has_number else F.lit(description)
    details = F.lit(None) if details is None else details
    return (
        rows.agg(F.count(F.lit(1)).alias("n"), details.cast("string").alias("details"))
        .where(F.col("n") > more_than)
        .select(F.lit(severity).alias("severity"), F.lit(category).alias("category"), text.alias("description"),
                "details", "n")
    )


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def section(rows: DataFrame, name: str, *metrics: str) -> DataFrame:
    """Rows of (section, metric, value) from the named columns of a small result."""
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("string").alias("value")) for m in metrics])
    return rows.select(F.lit(name).alias("section"), F.explode(entries).alias("m")).select("section", "m.*")


def _made(part):
    return part() if callable(part) else part


@dataclass
class Report:
    """A title, its checks (each a DataFrame of finding rows) and sections of (section, metric, value) rows.

    Each of `parts`, the checks, and the sections may also be a function that makes it when it is first needed.
    """

    title: str
    parts: list[DataFrame | Callable[[], DataFrame]]
    own_sections: DataFrame | Callable[[], DataFrame] | None = None
    timestamp: datetime = field(default_factory=lambda: datetime.now(timezone.utc))

    @cached_property
    def checks(self) -> list[DataFrame]:
        return list(map(_made, self.parts))

    @cached_property
    def sections(self) -> DataFrame | None:
        return _made(self.own_sections)

    @property
    def findings(self) -> DataFrame:
        """All findings, as one lazy plan."""
        return union(self.checks)

    def run(self, at_once: int = 8) -> DataFrame:
        """All findings, computed now: every check is a job of its own and several run at once.

        A check gives three rows at most, so what comes back to the driver is bounded by the number of checks.
        Compared with `findings`, stages of different checks overlap freely and each plan is re-optimised alone.
        """
        def found(part):
            check = _made(part)
            return check, check.collect()

        with ThreadPoolExecutor(at_once) as pool:
            done = list(pool.map(found, self.__dict__.get("checks", self.parts)))
        self.checks = [check for check, _ in done]
        return self.checks[0].sparkSession.createDataFrame(
            [row for _, rows in done for row in rows], "severity string, category string, description string, details string, n bigint")

    def add_finding(self, more: DataFrame) -> "Report":
        return Report(self.title, [*self.checks, more], self.sections, self.timestamp)

    def severity_counts(self) -> DataFrame:
        """Findings per severity, all five severities listed."""
        return severity_counts(self.findings)

    def to_json(self, path: str) -> None:
        """Write findings, severity counts and sections as JSON below `path`. The checks run once."""
        stamp = [F.lit(self.title).alias("title"), F.lit(self.timestamp.isoformat()).alias("timestamp")]
        findings = self.run()
        findings.select(*stamp, "*").write.mode("overwrite").json(f"{path}/findings")
        severity_counts(findings).select(*stamp, "*").write.mode("overwrite").json(f"{path}/severity_counts")
        if self.sections is not None:
            self.sections.select(*stamp, "*").write.mode("overwrite").json(f"{path}/sections")


def severity_counts(findings: DataFrame) -> DataFrame:
    counts = findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    entries = F.array(*[F.struct(F.lit(s).alias("severity"), F.col(s).alias("findings")) for s in SEVERITIES])
    return counts.select(F.explode(entries).alias("x")).select("x.*")
