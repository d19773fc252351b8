"""Named transformations run in order, with a run log."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

Phase = Callable[[DataFrame], DataFrame]
LOG = "run_id string, phase string, name string, status string, started double, ended double, duration_ms long, error string"


@dataclass
class Pipeline:
    """A registry of phases. Phases are lazy; ``run`` only chains them unless a sink makes one an action."""

    run_id: str = "run"
    phases: dict[str, tuple[str, Phase]] = field(default_factory=dict)
    log: list[tuple] = field(default_factory=list)
    progress: Callable[[int, int, str], None] | None = None

    def register(self, key: str, name: str, phase: Phase) -> Pipeline:
        if key in self.phases:
            raise ValueError(f"phase {key} is there already")
        self.phases[key] = (name, phase)
        return self

    def run(self, df: DataFrame, enabled: list[str] | None = None) -> DataFrame:
        """The phases in order of registration; the first that fails ends the run and is logged; phases left out are pending."""
        wanted = [k for k in self.phases if enabled is None or k in enabled]
        for n, (key, (name, phase)) in enumerate(self.phases.items()):
            if key not in wanted:
                self.log.append((self.run_id, key, name, "pending", None, None, None, None))
                continue
            began = time.time()
            try:
                df = df.transform(phase)
            except Exception as e:
                self.log.append((self.run_id, key, name, "failed", began, time.time(), int(1000 * (time.time() - began)), str(e)[:500]))
                raise
            self.log.append((self.run_id, key, name, "completed", began, time.time(), int(1000 * (time.time() - began)), None))
            if self.progress:
                self.progress(n + 1, len(self.phases), name)
        return df

    def log_frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.log, LOG)
