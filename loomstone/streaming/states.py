"""Session state machines over a stream of requested changes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomstone.operators.agents import TRANSITIONS

RESULT = "id string, n long, state string, rejected long"


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now, n, rejected = state.get if state.exists else ("active", 0, 0)
    for pdf in frames:
        for wanted in pdf.sort_values("seq")["state"]:
            n += 1
            if wanted in TRANSITIONS.get(now, ()):
                now = wanted
            elif wanted != now:
                rejected += 1
    state.update((now, n, rejected))
    yield pd.DataFrame({"id": [key[0]], "n": [n], "state": [now], "rejected": [rejected]})


def session_states(changes: DataFrame) -> DataFrame:
    """changes (id, seq, state) as a stream: the state of each session after each batch, and how many changes were refused."""
    return changes.groupBy("id").applyInPandasWithState(_advance, RESULT, "state string, n long, rejected long", "update", GroupStateTimeout.NoTimeout)
