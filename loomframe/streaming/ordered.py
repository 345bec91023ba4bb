"""Ordered, keyed processing of packet streams, with the same answers as the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def in_order(packets: DataFrame, most: int = 64) -> DataFrame:
    """Packets of each track as their turn comes: what arrives early waits, up to so many packets, beyond which the smallest goes on and the gap is told.

    packets has track_id, sequence and size; sequences count from 0 in each track. Repeated and late ones are dropped.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turn, waiting_seq, waiting_size = state.get if state.exists else (0, [], [])
        waiting = dict(zip(waiting_seq, waiting_size, strict=True))
        out = []
        for pdf in frames:
            for sequence, size in zip(pdf["sequence"].tolist(), pdf["size"].tolist(), strict=True):
                if sequence >= turn:
                    waiting.setdefault(sequence, size)
        while waiting and (turn in waiting or len(waiting) > most):
            now = min(waiting)
            out.append((key[0], now, waiting.pop(now), now - turn))
            turn = now + 1
        state.update((turn, sorted(waiting), [waiting[s] for s in sorted(waiting)]))
        yield pd.DataFrame(out, columns=["track_id", "sequence", "size", "skipped"])

    return packets.groupBy("track_id").applyInPandasWithState(step, "track_id long, sequence long, size long, skipped long", "turn long, seqs array<long>, sizes array<long>", "append", GroupStateTimeout.NoTimeout)


def rate_state(packets: DataFrame, start: int, low: int, high: int, step_by: int, target: int) -> DataFrame:
    """Quality parameter of each track after every batch; packets of a batch are taken in order of sequence."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        qp, n = state.get if state.exists else (start, 0)
        pdf = pd.concat(list(frames)).sort_values("sequence")
        for size, flags in zip(pdf["size"].tolist(), pdf["flags"].tolist(), strict=True):
            goal = target * (3 if flags & 1 else 1)
            qp = max(low, min(high, qp + (step_by if size > goal else -step_by if size < goal else 0)))
            n += 1
        state.update((qp, n))
        yield pd.DataFrame([(key[0], n, qp)], columns=["track_id", "packets", "qp"])

    return packets.groupBy("track_id").applyInPandasWithState(step, "track_id long, packets long, qp long", "qp long, n long", "update", GroupStateTimeout.NoTimeout)


def reference_state(frames: DataFrame, slots: int = 16) -> DataFrame:
    """References that each frame of a stream finds: a keyframe clears the slots, every frame then goes to the front, the oldest leaves."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (held,) = state.get if state.exists else ([],)
        held, out = list(held), []
        pdf = pd.concat(list(batches)).sort_values("frame")
        for frame, is_key in zip(pdf["frame"].tolist(), pdf["keyframe"].tolist(), strict=True):
            if is_key:
                held = []
            out.append((key[0], frame, held[0] if held else None, len(held)))
            held = [frame, *held][:slots]
        state.update((held,))
        yield pd.DataFrame(out, columns=["stream", "frame", "nearest", "held"]).astype({"nearest": "Int64"})

    return frames.groupBy("stream").applyInPandasWithState(step, "stream long, frame long, nearest long, held long", "held array<long>", "append", GroupStateTimeout.NoTimeout)
