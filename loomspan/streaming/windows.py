"""An extension to streams: contiguous windows over append-only segments, and windowed statistics with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_statistics(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums of events by type in tumbling windows; events later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def stream_windows(segments: DataFrame, doc: str, seg: str, text: str, k: int) -> DataFrame:
    """Windows of k consecutive segments of each document, as segments arrive in order; state holds k - 1 of them.

    A segment that does not follow the last one starts anew; one that comes again is left out.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, frames, state):
        held = list(zip(*state.get, strict=True)) if state.exists else []
        out = []
        for frame in frames:
            for s, t in sorted(zip(frame[seg].tolist(), frame[text].tolist(), strict=True)):
                if held and s <= held[-1][0]:
                    continue
                held = [*held, (s, t)] if held and s == held[-1][0] + 1 else [(s, t)]
                held = held[-k:]
                if len(held) == k:
                    out.append((key[0], held[0][0], " ".join(x for _, x in held)))
        keep = held[-(k - 1) :] if k > 1 else held[-1:]
        state.update(([s for s, _ in keep], [t for _, t in keep]))
        yield pd.DataFrame(out, columns=[doc, "seg_start", text])

    kinds = dict(segments.dtypes)
    return segments.groupBy(doc).applyInPandasWithState(step, f"{doc} {kinds[doc]}, seg_start {kinds[seg]}, {text} string", f"segs array<{kinds[seg]}>, texts array<string>", "append", GroupStateTimeout.NoTimeout)
