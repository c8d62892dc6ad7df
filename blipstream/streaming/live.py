"""The batch operators that make sense on endless points, as Structured Streaming."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_average(points: DataFrame, width: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """SEQ11 with event-time windows and a watermark on ts."""
    return points.withWatermark("ts", late).groupBy(F.window("ts", width), "sample_id", "channel").agg(F.avg("intensity").alias("mean"), F.count("*").alias("n"))


def live_events(points: DataFrame, start: float, stop: float, height: float) -> DataFrame:
    """SEQ4a with the open run of each trace kept as state between batches; a run is emitted when a point closes it."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        run = list(state.get) if state.exists else [-1, -1, 0.0, 0.0, 0]
        out = []
        for row in pd.concat(list(parts)).sort_values("idx").itertuples():
            y, i = row.intensity, row.idx
            if run[0] < 0:
                if y >= start:
                    run = [i, i, y, y, 1]
            elif y >= start or (y >= stop and y > 0):
                run = [run[0], i, run[2] + y, max(run[3], y), run[4] + 1]
            else:
                if run[3] > height:
                    out.append([*key, *run])
                run = [-1, -1, 0.0, 0.0, 0]
        state.update((int(run[0]), int(run[1]), float(run[2]), float(run[3]), int(run[4])))
        yield pd.DataFrame(out, columns=["sample_id", "channel", "start_idx", "end_idx", "area", "height", "n_points"])

    return points.groupBy("sample_id", "channel").applyInPandasWithState(
        step,
        "sample_id string, channel string, start_idx int, end_idx int, area double, height double, n_points int",
        "start_idx int, end_idx int, area double, height double, n_points int",
        "append",
        "NoTimeout",
    )
