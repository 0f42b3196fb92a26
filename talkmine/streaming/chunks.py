"""Chunks of transcripts whose segments arrive one by one, late and out of order.

A window of an episode is kept as state until the watermark says that nothing more of it can come; a
timer then closes it and its chunk goes out, once. State holds the open windows only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHUNK = """video_id string, chunk_window long, chunk_text string, chunk_start_sec double, chunk_end_sec double,
    segment_count long, word_count long"""
STATE = "segment_index array<long>, start_time array<double>, duration_sec array<double>, text array<string>, closes long"
_PARTS = ["segment_index", "start_time", "duration_sec", "text"]


def stream_chunks(segments: DataFrame, arrived: str = "arrived", delay: str = "10 minutes", window: int = 120,
                  min_chars: int = 50) -> DataFrame:
    """Chunks of a stream of segments (video_id, segment_index, start_time, duration_sec, text, and the
    time each ``arrived``), as ``chunk_segments`` makes them of a table.

    ``delay`` is how much later than its window's first segment one may come, in arrival time; what comes
    after its window was closed is left out, as a watermark does. Repeated segments of one index
    count once. Blank and null texts are left out, windows of ``min_chars`` or less give nothing.
    """
    rows = segments.withWatermark(arrived, delay).filter(F.col("text").isNotNull() & (F.trim("text") != "")).select(
        "video_id", F.floor(F.col("start_time") / window).alias("chunk_window"), "segment_index", "start_time",
        "duration_sec", "text", arrived)

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else [[], [], [], [], 0]
        if state.hasTimedOut:
            state.remove()
            found = pd.DataFrame(dict(zip(_PARTS, held))).sort_values(["start_time", "segment_index"])
            text = " ".join(found["text"])
            if len(text) > min_chars:
                yield pd.DataFrame([{
                    "video_id": key[0], "chunk_window": key[1], "chunk_text": text,
                    "chunk_start_sec": found["start_time"].min(),
                    "chunk_end_sec": (found["start_time"] + found["duration_sec"]).max(),
                    "segment_count": len(found), "word_count": int(found["text"].str.split(" ").str.len().sum())}])
            return
        parts = [list(p) for p in held[:4]]
        closes = held[4]
        for frame in frames:
            known = set(parts[0])
            frame = frame.drop_duplicates("segment_index")
            frame = frame[~frame["segment_index"].isin(known)]
            for part, name in zip(parts, _PARTS):
                part.extend(frame[name].tolist())
            if len(frame):
                closes = max(closes, int(frame[arrived].max().timestamp() * 1000))
        # a window whose first segments come behind the watermark is closed by the next batch
        closes = max(closes, state.getCurrentWatermarkMs() + 1)
        state.update((*parts, closes))
        state.setTimeoutTimestamp(closes)

    return rows.groupBy("video_id", "chunk_window").applyInPandasWithState(
        keep, CHUNK, STATE, "append", GroupStateTimeout.EventTimeTimeout)
