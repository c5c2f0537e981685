"""Stateful event rules in batch form: time-to-live duplicates, alerts, cooldowns, as-of values, hysteresis, flip-flops.

Rules that look back run per (key, time bucket), see ``bucketed``; event time is a bigint of microseconds. The rules whose state is
a true chain (alerts, cooldown, flip-flop) walk runs: the rows in the order of key and time, cut at equal counts into partitions
whatever the keys. A run tells how its exit depends on its entry; folding that over the runs, one after another, gives the state
each is entered with, and then all of them are walked at once. A key of any size, and any burst of it, is spread over as many runs
as its rows fill; only rows of one key and one instant stay together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.operators.bucketed import HOUR, ordered_scan, rolling_range
from prefspark.session import cut_lineage


def ddl(df: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema)


Batches = Iterator[pd.DataFrame]


def grouped_arrays(batches: Batches, keys: Sequence[str], columns: Sequence[str]) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """(key, arrays) of every run of equal keys in a sorted partition; only the open run is held across batches."""
    held_key, held = None, []
    for frame in batches:
        if not len(frame):
            continue
        key_arrays, arrays = [frame[k].to_numpy() for k in keys], [frame[c].to_numpy() for c in columns]
        fresh = np.zeros(len(frame), dtype=bool)
        fresh[0] = True
        for values in key_arrays:
            fresh[1:] |= values[1:] != values[:-1]
        starts = np.flatnonzero(fresh)
        for begin, end in zip(starts, np.append(starts[1:], len(frame))):
            key, part = tuple(v[begin] for v in key_arrays), [a[begin:end] for a in arrays]
            if key == held_key:
                held = [np.concatenate(pair) for pair in zip(held, part)]
                continue
            if held_key is not None:
                yield held_key, held
            held_key, held = key, part
    if held_key is not None:
        yield held_key, held


def merged(produce, rows: int = 20_000):
    """Wrap a producer of many small frames so that it hands over fewer, larger ones."""

    def run(batches: Batches) -> Batches:
        waiting, size = [], 0
        for frame in produce(batches):
            if not len(frame):
                continue
            waiting.append(frame)
            size += len(frame)
            if size >= rows:
                yield pd.concat(waiting, ignore_index=True)
                waiting, size = [], 0
        if waiting:
            yield pd.concat(waiting, ignore_index=True)

    return run


def dedupe_ttl(df: DataFrame, keys: Sequence[str], ts: str, tie: str, ttl: int, width: int = 24 * HOUR) -> DataFrame:
    """Flag rows whose key was seen within ``ttl``; every sighting refreshes the clock."""
    scanned = ordered_scan(df, keys, ts, tie, width, previous={"_prev": F.col(ts)})
    return scanned.withColumn("is_duplicate", F.coalesce(F.col(ts) - F.col("_prev") <= ttl, F.lit(False))).drop("_prev")


def inactivity_gap(df: DataFrame, keys: Sequence[str], ts: str, tie: str, width: int = 24 * HOUR) -> DataFrame:
    """Time since the previous event of the key, null for the first."""
    scanned = ordered_scan(df, keys, ts, tie, width, previous={"_prev": F.col(ts)})
    return scanned.withColumn("gap", F.col(ts) - F.col("_prev")).drop("_prev")


def dedupe_upgrade(df: DataFrame, keys: Sequence[str], ts: str, tie: str, richer: Column, ttl: int, width: int = 24 * HOUR) -> DataFrame:
    """Status new / duplicate / duplicate_with_body: the first richer copy of a sighting still counts."""
    first = ordered_scan(df.withColumn("_rich", richer), keys, ts, tie, width, previous={"_prev": F.col(ts)})
    is_new = F.col("_prev").isNull() | (F.col(ts) - F.col("_prev") > ttl)
    opened = first.withColumn("_start", F.when(is_new, F.col(ts)))
    scanned = ordered_scan(
        opened, keys, ts, tie, width, last={"_since": F.col("_start")}, last_before={"_seen": F.when(F.col("_rich"), F.col(ts))}
    )
    unseen = F.col("_seen").isNull() | (F.col("_seen") < F.col("_since"))
    status = F.when(F.col("_start").isNotNull(), "new").when(F.col("_rich") & unseen, "duplicate_with_body").otherwise("duplicate")
    return scanned.withColumn("status", status).drop("_rich", "_prev", "_start", "_since", "_seen")


def asof_freshness(
    probes: DataFrame, readings: DataFrame, keys: Sequence[str], ts: str, tie: str, value: str, max_age: int, width: int = 24 * HOUR
) -> DataFrame:
    """Latest reading at or before each probe, null when older than ``max_age``. A reading at the same instant counts."""
    cols = [*keys, ts, tie]
    reading = F.struct(F.col(ts).alias("at"), F.col(value).alias("value"))
    both = readings.select(*cols, F.lit(0).alias("_side"), reading.alias("_reading")).unionByName(
        probes.select(*cols, F.lit(1).alias("_side")), allowMissingColumns=True
    )
    ordered = both.withColumn("_tie", F.struct("_side", tie))
    scanned = ordered_scan(ordered, keys, ts, "_tie", width, last={"_latest": F.col("_reading")})
    age = F.col(ts) - F.col("_latest.at")
    fresh = F.when(age <= max_age, F.col("_latest.value"))
    return scanned.filter(F.col("_side") == 1).select(*cols, fresh.alias(value), F.when(age <= max_age, age).alias("age"))


def recent_exists(df: DataFrame, keys: Sequence[str], ts: str, marks: Column, ttl: int) -> DataFrame:
    """Does a marked row of the key exist strictly before, within ``ttl``? Reading does not refresh anything."""
    marked = df.withColumn("_mark", marks)
    seen = rolling_range(
        marked, keys, ts, ttl, {"_last": lambda w: F.max(F.when(F.col("_mark"), F.col(ts))).over(w)}, include_current=False
    )
    return seen.withColumn("recent", F.col("_last").isNotNull()).drop("_mark", "_last")


def hysteresis(df: DataFrame, keys: Sequence[str], ts: str, tie: str, high: Column, low: Column, width: int = 24 * HOUR) -> DataFrame:
    """State entered at the high mark and left only below the low mark; 0 before the first crossing."""
    crossing = F.when(high, 1).when(low, 0)
    scanned = ordered_scan(df, keys, ts, tie, width, last={"state": crossing})
    return scanned.withColumn("state", F.coalesce("state", F.lit(0)))


def generation_filter(
    df: DataFrame, keys: Sequence[str], ts: str, tie: str, bump: Column, stamp: Column, check: Column, width: int = 24 * HOUR
) -> DataFrame:
    """Checked rows keep only when the generation has not moved since the last stamped row of their key."""
    counted = ordered_scan(df, keys, ts, tie, width, running_sum={"generation": bump.cast("bigint")})
    stamped = ordered_scan(counted, keys, ts, tie, width, last={"stamp": F.when(stamp, F.col("generation"))})
    current = F.coalesce(F.col("stamp") == F.col("generation"), F.lit(False))
    return stamped.filter(check).withColumn("is_current", current)


def rolling_counts(df: DataFrame, keys: Sequence[str], ts: str, window: int) -> DataFrame:
    """Rows of the key in the trailing window, the row itself included."""
    return rolling_range(df, keys, ts, window, {"in_window": lambda w: F.count("*").over(w)})


def in_runs(df: DataFrame, keys: Sequence[str], ts: str, tie: str) -> DataFrame:
    """Rows in the order of key and time, cut into partitions of near equal row counts, numbered by ``_run``."""
    ordered = df.repartitionByRange(*keys, ts).sortWithinPartitions(*keys, ts, tie)
    return cut_lineage(ordered).withColumn("_run", F.spark_partition_id())


def segments(batches: Batches, keys: Sequence[str], columns: Sequence[str]) -> Iterator[tuple[int, tuple, bool, bool, list[np.ndarray]]]:
    """(run, key, is it the run's first key, its last, arrays) of every key of a run."""
    held, first = None, True
    for (*key, run), arrays in grouped_arrays(batches, [*keys, "_run"], columns):
        if held is not None:
            yield held[0], held[1], first, held[0] != run, held[2]
            first = held[0] != run
        held = int(run), tuple(key), arrays
    if held is not None:
        yield held[0], held[1], first, True, held[2]


def folded(summary: DataFrame, state: str, step: Callable[[pd.DataFrame, object], object], keys: Sequence[str]) -> dict[int, object]:
    """What every run is entered with. ``summary`` has rows of (keys, _run, whole, ...): those of the run's first key and, unless this
    key fills the run (``whole``), of its last. ``step`` maps these rows and the entry of a key (None where it begins) to its exit.

    The fold reads a few rows per run, in one task; one value per run comes back."""

    def fold(batches: Batches) -> Batches:
        key, carried, out = None, None, []
        for frame in runs_of(batches):
            run, whole = int(frame["_run"].iloc[0]), bool(frame["whole"].iloc[0])
            names = list(frame[list(keys)].itertuples(index=False, name=None))
            entry = carried if names[0] == key else None
            if entry is not None:
                out.append((run, entry))
            own = frame if whole else frame[[n == names[-1] for n in names]]
            carried = step(own, entry if whole else None)
            key = names[-1]
        yield pd.DataFrame(out, columns=["_run", "entry"])

    def runs_of(batches: Batches) -> Iterator[pd.DataFrame]:
        waiting = None
        for frame in batches:
            waiting = frame if waiting is None else pd.concat([waiting, frame], ignore_index=True)
            last = waiting["_run"].iloc[-1] if len(waiting) else None
            for _, own in waiting[waiting["_run"] != last].groupby("_run", sort=False):
                yield own
            waiting = waiting[waiting["_run"] == last]
        if waiting is not None and len(waiting):
            yield waiting

    ordered = summary.repartition(1).sortWithinPartitions("_run", "place")
    return {r["_run"]: r["entry"] for r in ordered.mapInPandas(fold, f"_run int, entry {state}").collect()}


def _emitted(times: np.ndarray, allowed: int, gap: int) -> np.ndarray:
    """Places emitted from ``allowed`` on, each at least ``gap`` after the one before."""
    chosen, at = [], int(np.searchsorted(times, allowed, "left"))
    while at < len(times):
        chosen.append(at)
        at = int(np.searchsorted(times, times[at] + gap, "left"))
    return np.array(chosen, dtype=np.int64)


def _exits(times: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """How the last emission depends on the entry, as steps: entered with a time up to ``upto`` (and above the step before), the
    last emission is at ``final``. Different ways through a run soon meet, so there are few steps."""
    follow, last = np.searchsorted(times, times + gap, "left"), np.arange(len(times))
    moving = np.ones(len(last), dtype=bool)
    while moving.any():
        nxt = follow[last]
        moving = nxt < len(times)
        last[moving] = nxt[moving]
    final = times[last]
    keep = np.append(final[1:] != final[:-1], True)
    return times[keep], final[keep]


def cooldown(df: DataFrame, keys: Sequence[str], ts: str, tie: str, seconds: int) -> DataFrame:
    """Rows emitted when a key may emit again only ``seconds`` (in microseconds) after its last emission: a greedy choice."""
    return _cooled(in_runs(df.select(*keys, ts, tie), keys, ts, tie), list(keys), ts, tie, seconds)


def _cooled(runs: DataFrame, keys: list[str], ts: str, tie: str, seconds: int) -> DataFrame:
    key_schema = ddl(runs, keys)

    def summarize(batches: Batches) -> Batches:
        for run, key, first, last, (times,) in segments(batches, keys, [ts]):
            if first and last:
                upto, final = _exits(times, seconds)
                place = np.arange(len(upto))
            elif last:
                place, upto, final = np.array([1]), np.array([0]), times[_emitted(times, np.iinfo(np.int64).min, seconds)[-1:]]
            elif first:  # only its name is needed
                place, upto, final = np.array([0]), np.array([0]), np.array([0])
            else:
                continue
            yield pd.DataFrame({k: [v] * len(place) for k, v in zip(keys, key)} | {"_run": run, "whole": first and last, "place": place, "upto": upto, "final": final})

    def step(own: pd.DataFrame, entry: int | None) -> int | None:
        if not own["whole"].iloc[0]:
            return int(own["final"].iloc[0]) + seconds
        at = int(np.searchsorted(own["upto"].to_numpy(), np.iinfo(np.int64).min if entry is None else entry, "left"))
        return int(own["final"].iloc[at]) + seconds if at < len(own) else entry

    summary = runs.mapInPandas(merged(summarize), f"{key_schema}, _run int, whole boolean, place bigint, upto bigint, final bigint")
    entries = folded(summary, "bigint", step, keys)

    def emissions(batches: Batches) -> Batches:
        for run, key, first, _, (times, ties) in segments(batches, keys, [ts, tie]):
            allowed = entries.get(run) if first else None
            chosen = _emitted(times, np.iinfo(np.int64).min if allowed is None else allowed, seconds)
            yield pd.DataFrame({n: [v] * len(chosen) for n, v in zip(keys, key)} | {ts: times[chosen], tie: ties[chosen]})

    return runs.mapInPandas(merged(emissions), ddl(runs, [*keys, ts, tie]))


def threshold_alerts(df: DataFrame, keys: Sequence[str], ts: str, tie: str, window: int, threshold: int, cooldown_for: int) -> DataFrame:
    """Alerts: at least ``threshold`` rows of the key in the trailing window, then quiet for the cooldown.

    Whether a row has company enough depends on the ``threshold`` - 1 rows before it, which is all that a run hands on."""
    keys = list(keys)
    runs = in_runs(df.select(*keys, ts, tie), keys, ts, tie)
    back = threshold - 1

    def summarize(batches: Batches) -> Batches:
        for run, key, first, last, (times,) in segments(batches, keys, [ts]):
            if first or last:
                tail = times[len(times) - min(back, len(times)) :].tolist()
                yield pd.DataFrame([(*key, run, first and last, int(not first), tail)], columns=[*keys, "_run", "whole", "place", "tail"])

    def step(own: pd.DataFrame, entry: list[int] | None) -> list[int]:
        together = [*(entry if entry is not None else []), *own["tail"].iloc[0]]
        return together[max(0, len(together) - back) :]

    summary = runs.mapInPandas(merged(summarize), f"{ddl(runs, keys)}, _run int, whole boolean, place bigint, tail array<bigint>")
    entries = folded(summary, "array<bigint>", step, keys)

    def loud(batches: Batches) -> Batches:
        for run, key, first, _, (times, ties) in segments(batches, keys, [ts, tie]):
            before = np.array(entries.get(run) or [] if first else [], np.int64)
            every = np.concatenate([before, times])
            near = np.searchsorted(every, times, "right") - np.searchsorted(every, times - window, "left")
            at = near >= threshold
            yield pd.DataFrame({k: [v] * int(at.sum()) for k, v in zip(keys, key)} | {ts: times[at], tie: ties[at], "_run": run})

    found = runs.mapInPandas(merged(loud), f"{ddl(runs, [*keys, ts, tie])}, _run int")
    return _cooled(found, keys, ts, tie, cooldown_for)


STATE = {"cur": "string", "cur_same": "string", "prev": "string", "prev_same": "string", "changed": "bigint"}
BLANK = ("", "", "", "", 0)


def flipflop_step(state: tuple, at: int, item: str, name: str, hold: int) -> tuple[bool, tuple]:
    """One row: a return to the previous id within ``hold``, under the same name, is ignored and moves nothing."""
    cur, cur_same, prev, prev_same, changed = state
    if item and cur and item != cur and item == prev and name == cur_same == prev_same and at - changed <= hold:
        return True, state
    if item == cur and name == cur_same:
        return False, state
    return False, (item, name, cur, cur_same, at)


def flipflop_walk(times: np.ndarray, items: np.ndarray, names: np.ndarray, state: tuple, hold: int) -> tuple[np.ndarray, tuple]:
    """``flipflop_step`` over many rows: stretches of one id and name are taken at once, as after the first row of a stretch that
    is taken, or that is past the hold, the others change nothing."""
    ignored = np.zeros(len(times), bool)
    starts = np.flatnonzero(np.append(True, (items[1:] != items[:-1]) | (names[1:] != names[:-1])))
    for begin, end in zip(starts.tolist(), [*starts[1:].tolist(), len(times)]):
        skip, now = flipflop_step(state, int(times[begin]), items[begin], names[begin], hold)
        if skip:  # the state stays as it is until the hold is over
            late = begin + int(np.searchsorted(times[begin:end], state[4] + hold, "right"))
            ignored[begin:late] = True
            if late < end:
                _, now = flipflop_step(state, int(times[late]), items[late], names[late], hold)
        state = now
    return ignored, state


def flipflop(df: DataFrame, keys: Sequence[str], ts: str, tie: str, who: str, same: str, hold: int) -> DataFrame:
    """Flag rows that only flip back to the previous id (``who``), ``same`` being the name that must agree.

    Runs are walked from a guessed entry, the exit of the run before it under its own guess. Only a run that one key fills, and
    whose exit depends on its entry, can make the next guess wrong; such runs are walked again with the entry now known.
    An exit seldom depends on the entry, so that is seldom needed; each time brings one state per such run to the driver.
    """
    keys = list(keys)
    runs = in_runs(df.select(*keys, ts, tie, who, same), keys, ts, tie)
    fields = ", ".join(f"{name} {kind}" for name, kind in STATE.items())

    def exits(entries: dict[int, tuple], some: list[int] | None) -> list:
        def run_exits(batches: Batches) -> Batches:
            rows = []
            for run, key, first, last, (times, items, names) in segments(batches, keys, [ts, who, same]):
                if first:
                    start = key
                if last:
                    _, now = flipflop_walk(times, items, names, entries.get(run, BLANK) if first else BLANK, hold)
                    rows.append((run, repr(start), repr(key), first, *now))
            yield pd.DataFrame(rows, columns=["_run", "first", "last", "whole", *STATE])

        source = runs if some is None else runs.filter(F.col("_run").isin(some))
        return source.mapInPandas(run_exits, f"_run int, first string, last string, whole boolean, {fields}").collect()

    entries: dict[int, tuple] = {}
    told = {r["_run"]: r for r in exits(entries, None)}
    while True:
        order = sorted(told)
        wanted = {b: tuple(told[a][n] for n in STATE) for a, b in zip(order, order[1:]) if told[a]["last"] == told[b]["first"]}
        stale = [run for run, state in wanted.items() if told[run]["whole"] and entries.get(run, BLANK) != state]
        entries = wanted
        if not stale:
            break
        told |= {r["_run"]: r for r in exits(entries, stale)}

    def flag(batches: Batches) -> Batches:
        for run, key, first, _, (times, ties, items, names) in segments(batches, keys, [ts, tie, who, same]):
            ignored, _ = flipflop_walk(times, items, names, entries.get(run, BLANK) if first else BLANK, hold)
            yield pd.DataFrame({k: [v] * len(times) for k, v in zip(keys, key)} | {ts: times, tie: ties, "ignored": ignored})

    return runs.mapInPandas(merged(flag), f"{ddl(df, [*keys, ts, tie])}, ignored boolean")
