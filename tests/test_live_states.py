"""Live job views: the last transition of a task counts, history and late rows change nothing."""

import pandas as pd
import pytest
from pyspark.sql import Row

from runledger.streaming import processors


class Held:
    def __init__(self):
        self.value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def moves(processor, *rows):
    found = processor.handleInputRows((7, 1), iter([Row(job_id=7, task_id=1, pos=p, to_state=s) for p, s in rows]), None)
    return [(r.job_id, r.state, r.delta) for r in found]


def test_deltas_of_a_task_come_from_rows_without_frames(spark, monkeypatch):
    processor = processors.StateDeltaProcessor()
    processor.state = Held()
    for name in ("DataFrame", "concat"):
        monkeypatch.setattr(pd, name, lambda *a, **k: pytest.fail("a data frame for one task"))
    processor.handleInitialState((7, 1), Row(job_id=7, task_id=1, state="queued", pos=5), None)
    assert moves(processor, (3, "created"), (5, "queued")) == []  # the history held these
    assert moves(processor, (9, "running"), (6, "leased"), (8, "queued")) == [(7, "running", 1), (7, "queued", -1)]
    assert moves(processor, (7, "failed")) == [] and processor.state.value == ("running", 9)
    assert moves(processor, (12, "failed"), (12, "running")) == [] and processor.state.value == ("running", 12)
    fresh = processors.StateDeltaProcessor()
    fresh.state = Held()
    assert moves(fresh, (2, "created"), (1, "queued")) == [(7, "created", 1)]
