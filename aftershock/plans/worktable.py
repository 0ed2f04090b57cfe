"""A table of work that runs share: what is claimed, done or failed, and by which attempt.

States are appended, never changed, so a killed run leaves nothing to repair.  The
last state of a unit counts; once done it stays done, by the attempt that was first.
Results carry their attempt, and only those of done attempts are read, so rows of an
attempt that died after writing, or of two runs that did the same, never show twice.
The table has some rows for each unit of a plan, whatever the size of the data.

Results lie in ``attempt=...`` folders, so the folder as a whole reads as one table,
that of all attempts; the states are beside them in ``_work``, which Spark's readers
leave out.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLAIMED, DONE, FAILED = "claimed", "done", "failed"
EVENT = "unit string, state string, attempt string, run string, at double, note string"
# Letters of an error that are kept.
_NOTE = 2000


@dataclass
class WorkTable:
    """The work of a folder, seen by one run."""

    spark: SparkSession
    path: str
    # A claim of another run holds for so long; after that the run counts as dead.
    lease_minutes: float = 0.0
    run: str = field(default_factory=lambda: uuid.uuid4().hex)

    def _events(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(EVENT).option("recursiveFileLookup", True).parquet(f"{self.path}/_work")
        except AnalysisException:  # nothing written yet
            return None

    def _append(self, unit: str, state: str, attempt: str, note: str = "") -> None:
        row = (unit, state, attempt, self.run, time.time(), note[:_NOTE])
        event = self.spark.createDataFrame([row], EVENT).coalesce(1)
        # Writers that share a folder clear each other's temporary files away, so each has its own.
        event.write.parquet(f"{self.path}/_work/{attempt}/{state}")

    def states(self) -> DataFrame:
        """``unit, state, attempt, run, at, note``: the state of every unit that was ever claimed."""
        events = self._events()
        if events is None:
            return self.spark.createDataFrame([], EVENT)
        # Done before all else, the first of these; then the latest.
        order = F.struct((F.col("state") == DONE), F.when(F.col("state") == DONE, -F.col("at")).otherwise(F.col("at")), "attempt")
        names = ["state", "attempt", "run", "at", "note"]
        last = events.groupBy("unit").agg(F.max_by(F.struct(*names), order).alias("_e"))
        return last.select("unit", "_e.*")

    def open_units(self, units: Iterable[str]) -> list[str]:
        """Units to do: neither done nor claimed by another run whose lease still holds."""
        known = {r["unit"]: r for r in self.states().collect()}
        held = time.time() - 60 * self.lease_minutes

        def free(unit: str) -> bool:
            r = known.get(unit)
            if r is None or r["state"] == FAILED:
                return True
            return r["state"] == CLAIMED and (r["run"] == self.run or r["at"] < held)

        return [u for u in units if free(u)]

    def do(self, unit: str, job: Callable[[], DataFrame]) -> bool:
        """Claims a unit, writes what the job returns and marks it done, or failed with the error."""
        attempt = uuid.uuid4().hex
        self._append(unit, CLAIMED, attempt)
        try:
            job().withColumn("unit", F.lit(unit)).write.parquet(f"{self.path}/attempt={attempt}")
        except Exception as error:  # noqa: BLE001  told in the table, and raised by run_all
            self._append(unit, FAILED, attempt, f"{type(error).__name__}: {error}")
            return False
        self._append(unit, DONE, attempt)
        return True

    def run_all(self, jobs: dict[str, Callable[[], DataFrame]], workers: int = 2) -> None:
        """Does all open units, ``workers`` at a time; raises at the end if any failed.

        Each worker's jobs have a pool of their own, which counts if the session's
        scheduler is FAIR.
        """
        left = self.open_units(jobs)
        context = self.spark.sparkContext

        def work(unit: str) -> str | None:
            done: list[bool] = []

            def inside() -> None:
                context.setLocalProperty("spark.scheduler.pool", f"work-{abs(hash(unit)) % workers}")
                done.append(self.do(unit, jobs[unit]))

            thread = InheritableThread(target=inside)
            thread.start()
            thread.join()
            return None if done and done[0] else unit

        with ThreadPoolExecutor(workers) as pool:
            failed = [u for u in pool.map(work, left) if u]
        if failed:
            raise RuntimeError(f"{len(failed)} of {len(left)} units failed, see {self.path}/_work: {failed[:5]}")

    def results(self) -> DataFrame | None:
        """Rows of all done units, whichever run did them; None if there are none."""
        done = [r["attempt"] for r in self.states().filter(F.col("state") == DONE).collect()]
        if not done:
            return None
        return self.spark.read.parquet(*[f"{self.path}/attempt={a}" for a in done]).drop("unit")
