"""The job ledger as a stream: state per job, kept across batches and restarts by the checkpoint."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "job_id long, status string, total_titles long, processed_titles long, error_count long, processed_nodes long, dropped long"
_STATE = OUT.partition(", ")[2]
LIVE = ("planning", "running", "completed_with_errors")


def advance(s: tuple, kind: str, n: int, final: bool) -> tuple:
    """One event; an event whose guard fails changes nothing but the count of dropped ones."""
    status, total, done, errors, nodes, dropped = s
    ended = "completed_with_errors" if errors else "completed"
    if kind == "nodes":
        return status, total, done, errors, nodes + n, dropped
    if kind == "plan_failed":
        return "failed", total, done, errors + 1, nodes, dropped
    if kind == "planned" and status == "planning":
        return ("completed" if n == 0 else ended if done >= n else "running"), n, done, errors, nodes, dropped
    if kind == "titles" and status in LIVE:
        return (ended if status != "planning" and done + n >= total else status), total, done + n, errors, nodes, dropped
    if kind == "error" and status in LIVE:
        return ("failed" if final else status), total, done, errors + 1, nodes, dropped
    if kind == "abort" and status in ("planning", "running"):
        return "aborted", total, done, errors, nodes, dropped
    return status, total, done, errors, nodes, dropped + 1


def follow_jobs(events: DataFrame) -> DataFrame:
    """Latest state of each job touched by a batch of (job_id, seq, kind, n, final); update mode.

    Events of one job are taken in order of seq within a batch; batches in order of arrival.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = state.get if state.exists else ("planning", 0, 0, 0, 0, 0)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        for r in rows.itertuples():
            s = advance(s, r.kind, 0 if pd.isna(r.n) else int(r.n), bool(r.final) and not pd.isna(r.final))
        state.update(s)
        yield pd.DataFrame([(key[0], *s)], columns=[c.split()[0] for c in OUT.split(", ")])

    return events.groupBy("job_id").applyInPandasWithState(step, OUT, _STATE, "update", GroupStateTimeout.NoTimeout)
