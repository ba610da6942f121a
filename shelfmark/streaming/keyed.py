"""Operators with keyed state; their code runs in the workers, state is kept by Spark's state store."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MICROS = 1_000_000


def kept_times(times: np.ndarray, last: int | None, width: int) -> list[int]:
    """Those of ascending ``times`` that lie at least ``width`` after the one kept before them.

    A step goes straight to the next time that can be kept, so it costs the logarithm of the times.
    """
    at = 0 if last is None else int(np.searchsorted(times, last + width))
    kept = []
    while at < len(times):
        kept.append(int(times[at]))
        at = int(np.searchsorted(times, times[at] + width))
    return kept


class Cooldown(StatefulProcessor):
    """Lets an event of an environment pass if the last one that passed is a cooldown ago.

    A key is a group of environments, which rows name in a column ``environment``; rows without
    that column are all of the environment that is the key. The state of a key is read and written
    once a batch, so many environments cost what one would cost by itself.
    """

    def __init__(self, cooldown: int) -> None:
        self.width = cooldown * MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "environments array<string>, at array<bigint>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        # Of a batch only the times of one key are held, 8 bytes each, and 8 for the number of their environment.
        numbers: dict[str | None, int] = {}
        parts = []
        for part in rows:
            given = part["environment"] if "environment" in part else pd.Series([key[0]] * len(part), dtype=object)
            codes, names = pd.factorize(given, use_na_sentinel=False)
            placed = np.array([numbers.setdefault(None if pd.isna(name) else name, len(numbers)) for name in names], np.int64)
            times = part["ts"].to_numpy("datetime64[us]").astype(np.int64)
            parts.append(np.unique(np.stack([placed[codes], times]), axis=1))
        of, times = np.unique(np.concatenate(parts, axis=1), axis=1)
        edges = np.searchsorted(of, np.arange(len(numbers) + 1))
        last = dict(zip(*self.last.get())) if self.last.exists() else {}
        kept = {
            name: found for name, k in numbers.items()
            if (found := kept_times(times[edges[k] : edges[k + 1]], last.get(name), self.width))
        }
        if kept:
            last |= {name: found[-1] for name, found in kept.items()}
            # The next batch has no event before the watermark of this one.
            open_from = None if timerValues is None else timerValues.getCurrentWatermarkInMs() * 1000 - self.width
            last = {name: at for name, at in last.items() if open_from is None or at > open_from}
            if last:
                self.last.update((list(last), list(last.values())))
                self.handle.registerTimer(-(-(max(last.values()) + self.width) // 1000))
            else:
                self.last.clear()
            environments = np.repeat(np.array(list(kept), object), [len(found) for found in kept.values()])
            yield pd.DataFrame({"environment": environments, "ts": np.concatenate(list(kept.values())).astype("datetime64[us]")})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        # A later event may have set a later timer meanwhile; that one will clear the state.
        if self.last.exists() and max(self.last.get()[1]) + self.width <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass
