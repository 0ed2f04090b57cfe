"""Rows in, rows out, and why rows were left out.

A job that leaves out rows with nulls says so with ``keep_complete``.  The rows are
written once with the first column that is null as their reason; the counts are
observed in that same pass, so they cost nothing more.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from aftershock.session import stored

KEPT, READ = "kept", "read"
LEDGER = "job string, reason string, rows long"


@dataclass(frozen=True)
class Account:
    """What became of the rows of a job; ``left_out`` has the rows by reason."""

    job: str
    read: int
    kept: int
    left_out: dict[str, int] = field(default_factory=dict)

    @property
    def balanced(self) -> bool:
        return self.read == self.kept + sum(self.left_out.values())

    def rows(self) -> list[tuple[str, str, int]]:
        """Lines of the ledger: rows read, rows kept, and rows left out by reason."""
        lost = [(self.job, reason, n) for reason, n in sorted(self.left_out.items()) if n]
        return [(self.job, READ, self.read), (self.job, KEPT, self.kept), *lost]


def first_null(columns: Sequence[str]) -> Column:
    """Name of the first column that is null, null if none is."""
    return F.coalesce(*[F.when(F.col(f"`{c}`").isNull(), F.lit(c)) for c in columns], F.lit(None).cast("string"))


def keep_complete(
    df: DataFrame, job: str, columns: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame, Account]:
    """Rows without nulls in ``columns`` (all by default), the others with their ``reason``, and the account.

    Both tables read what is written once; every row is in exactly one of them.
    """
    columns = list(columns or df.columns)
    reason = F.col("_reason")
    counts = [F.count_if(reason == c).alias(f"_{i}") for i, c in enumerate(columns)]
    seen = Observation(f"rows of {job}")
    marked = df.withColumn("_reason", first_null(columns)).observe(
        seen, F.count(F.lit(1)).alias("read"), F.count_if(reason.isNull()).alias("kept"), *counts
    )
    rows = stored(marked, "accounted")
    got = seen.get
    left_out = {c: got[f"_{i}"] for i, c in enumerate(columns) if got[f"_{i}"]}
    kept = rows.filter(reason.isNull()).drop("_reason")
    rejects = rows.filter(reason.isNotNull()).withColumnRenamed("_reason", "reason")
    return kept, rejects, Account(job, got["read"], got["kept"], left_out)


def ledger(spark: SparkSession, accounts: Sequence[Account]) -> DataFrame:
    """The accounts of several jobs as a table; raises if one does not balance."""
    for account in accounts:
        if not account.balanced:
            raise ValueError(f"rows of {account.job} do not add up: {account}")
    return spark.createDataFrame([row for a in accounts for row in a.rows()], LEDGER)
