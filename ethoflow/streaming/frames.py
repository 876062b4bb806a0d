"""Live forms of the frame operators (an extension: the batch operators are the contract)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def label_shares(frames: DataFrame, time: str = "ts", width: str = "5 minutes", late: str = "10 minutes", label: str = "label") -> DataFrame:
    """Counts of labels by recording in event-time windows; rows later than the watermark are left out."""
    return frames.withWatermark(time, late).groupBy(F.window(time, width), "trial_id", label).agg(F.count(F.lit(1)).alias("n"))


def sessions(frames: DataFrame, time: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Recording sessions: a pause longer than the gap starts a new one."""
    return frames.withWatermark(time, late).groupBy(F.session_window(time, gap), "trial_id").agg(F.count(F.lit(1)).alias("n_frames"))


def live_bouts(frames: DataFrame) -> DataFrame:
    """Finished bouts of a stream ordered by frame within a recording; the open bout is the state."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.getOption
        label, first, last = held if held else (None, None, None)
        done = []
        rows = pd.concat(list(parts)).sort_values("frame_number")
        for f, x in zip(rows["frame_number"].tolist(), rows["label"].tolist()):
            if last is not None and f <= last:
                continue  # seen before, or late
            if label is not None and (x != label or f != last + 1):
                done.append((key[0], label, first, last, last - first + 1))
                label = None
            if label is None:
                label, first = x, f
            last = f
        if label is not None:
            state.update((int(label), int(first), int(last)))
        yield pd.DataFrame(done, columns=["trial_id", "label", "first_frame", "last_frame", "n_frames"])

    return frames.groupBy("trial_id").applyInPandasWithState(
        step, "trial_id long, label int, first_frame long, last_frame long, n_frames long", "label int, first long, last long", "append", GroupStateTimeout.NoTimeout
    )
