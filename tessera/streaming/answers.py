"""Streams with state: answers that come in pieces (Q09), and the usage meter of turns (Q10).

State is kept by Spark for each answer or turn and checkpointed with the offsets, so a stream that starts again goes on in the middle of a line or of a turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions.extract import Renumberer

PIECES = "answer_id long, seq long, piece string, known int, last boolean"
READY = "answer_id long, seq long, text string, numbers array<int>"
#: what is open of an answer: the line that has not ended, whether it stands in a fence, the citations by first use, pieces that came early
OPEN = "held string, fenced boolean, numbers array<int>, next long, early array<struct<seq:long,piece:string,known:int,last:boolean>>"


def renumbered(pieces: DataFrame) -> DataFrame:
    """Q09: `pieces` of answers -> what is ready of each, with citations numbered by first use, as `seq` says in order; `numbers`: the original numbers so far.

    A line is held until it has ended, as a citation or a fence may stand across pieces; pieces that are ahead of one that has not come are held too. The texts of an answer, put together
    by `seq`, are the renumbered whole. An answer's state ends with its last piece.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, fenced, numbers, next_, early = state.get if state.exists else ("", False, [], 0, [])
        waiting = {p["seq"]: (p["piece"], p["known"], p["last"]) for p in (r if isinstance(r, dict) else r.asDict() for r in early)}
        for b in batches:
            waiting |= {int(s): (p, int(k), bool(z)) for s, p, k, z in zip(b.seq, b.piece, b.known, b["last"])}
        reader = Renumberer(0)
        reader.held, reader.fenced, reader.order = held, fenced, {n: i for i, n in enumerate(numbers, 1)}
        out, done = [], False
        while next_ in waiting and not done:
            piece, reader.known, done = waiting.pop(next_)
            out.append((key[0], next_, reader.feed(piece or "", done), list(reader.order)))
            next_ += 1
        if done:
            state.remove()
        else:
            state.update((reader.held, reader.fenced, list(reader.order), next_, [(s, *p) for s, p in sorted(waiting.items())]))
        yield pd.DataFrame(out, columns=["answer_id", "seq", "text", "numbers"])

    return pieces.groupBy("answer_id").applyInPandasWithState(step, READY, OPEN, "append", GroupStateTimeout.NoTimeout)


CALLS = "turn long, step string, ts timestamp, prompt long, completion long, cached long, closes boolean"
METER = "turn long, calls long, prompt long, completion long, cached long, started timestamp, ended timestamp, abandoned boolean"
#: turns that share a state, and what is open of them: rows of as many numbers as OPEN_TURN names
TOGETHER, OPEN_TURNS = 512, "turns binary"
OPEN_TURN = ("blank", "turn", "calls", "prompt", "completion", "cached", "said", "started", "ended", "deadline")


def metered(calls: DataFrame, patience: str = "30 minutes", late: str = "5 minutes") -> DataFrame:
    """Q10: `calls(turn, step, ts, prompt, completion, cached, closes)` of model steps -> one row per turn when it closes, or, `abandoned`, when nothing was heard of it for `patience` of event time.

    `cached` is null for calls that do not say; the sum is null only if none does. Calls later than `late` are not counted.
    Turns are dealt into TOGETHER states by their hash, for a call of Python costs as much for one turn as for thousands; each turn keeps its own deadline, and a state's is the first of them.
    """
    span_ms = int(pd.Timedelta(patience).total_seconds() * 1000)
    none = np.empty((0, len(OPEN_TURN)), np.int64)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, heard = state.getCurrentWatermarkMs(), [none]
        held = np.frombuffer(state.get[0], np.int64).reshape(-1, len(OPEN_TURN)) if state.exists else none
        closes = [np.zeros(len(held), bool)]
        if not state.hasTimedOut:
            for b in batches:
                heard.append(b[list(OPEN_TURN)].to_numpy(np.int64))
                closes.append(b.closes.to_numpy(bool))
        rows, closed = _per_turn(np.concatenate([held, *heard]), np.concatenate(closes), len(held), span_ms, now)
        over = closed | (rows[:, -1] < now)
        rest = rows[~over]
        if len(rest):
            state.update((rest.tobytes(),))
            state.setTimeoutTimestamp(max(int(rest[:, -1].min()), now))
        elif state.exists:
            state.remove()
        if over.any():
            yield pd.DataFrame(rows[over][:, :-1], columns=OPEN_TURN[:-1]).assign(abandoned=~closed[over])

    micros, whole = F.unix_micros("ts"), lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c)
    told = calls.withWatermark("ts", late).select("ts", F.pmod(F.xxhash64("turn"), F.lit(TOGETHER)).alias("bucket"), F.col("turn").isNull().cast("long").alias("blank"), whole("turn"), F.lit(1).cast("long").alias("calls"), whole("prompt"), whole("completion"), whole("cached"), F.col("cached").isNotNull().cast("long").alias("said"), micros.alias("started"), micros.alias("ended"), F.lit(0).cast("long").alias("deadline"), F.coalesce("closes", F.lit(False)).alias("closes"))
    sums = ", ".join(f"{c} long" for c in OPEN_TURN[:-1]) + ", abandoned boolean"
    made = told.groupBy("bucket").applyInPandasWithState(step, sums, OPEN_TURNS, "append", GroupStateTimeout.EventTimeTimeout)
    return made.select(F.when(F.col("blank") == 0, F.col("turn")).alias("turn"), "calls", "prompt", "completion", F.when(F.col("said") > 0, F.col("cached")).alias("cached"), F.timestamp_micros("started").alias("started"), F.timestamp_micros("ended").alias("ended"), "abandoned")


def _per_turn(rows: np.ndarray, closes: np.ndarray, held: int, span_ms: int, now: int) -> tuple[np.ndarray, np.ndarray]:
    """(OPEN_TURN of each turn, whether it closed) of `held` open turns and single calls after them; what was heard of now has a new deadline."""
    if not len(rows):
        return rows, closes
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    rows, closes, fresh = rows[order], closes[order], (order >= held).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
    out = np.concatenate([rows[first, :2], np.add.reduceat(rows[:, 2:7], first), np.minimum.reduceat(rows[:, 7:8], first), np.maximum.reduceat(rows[:, 8:], first)], axis=1)
    anew = np.add.reduceat(fresh, first) > 0
    out[anew, -1] = np.maximum(out[anew, -2] // 1000 + span_ms, now + 1)
    return out, np.logical_or.reduceat(closes, first)


def landed(spark, folder: str, schema: str, made, out: str, checkpoint: str) -> None:
    """What has landed in `folder` goes through the stream `made` to Parquet in `out`, once each, then it stops."""
    made(spark.readStream.schema(schema).parquet(folder)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
