"""One station's readings as keyed state: what the rules, the patterns and the neighbours need of each hour, in order of time.

The state of a station is of bounded size whatever its history: the last rows, two in-range values, runs, the clocks of
its neighbourhood, rows that wait for their hour, neighbours' rows of those hours, and counts of past spreads by size, from which their median
so far is read to within a part in ``FINE``.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from brontide.config import CONFIG, VARIABLES

#: Rows of the past that some pattern looks at, besides the row itself.
PAST = 26
#: Steps of spread for each doubling; the median of spreads is one of these steps.
FINE = 2048
HOUR = 3_600_000_000
_RANGES = [CONFIG["range"][v] for v in VARIABLES]
_FLAT = [CONFIG["flat_steps"][v] for v in VARIABLES]
#: What comes out for a row and variable, besides keys and what is kept.
NUMBERS = ("value", "mean", "std", "dewpoint", "prev_dewpoint", "lag1", "lag2", "lag3", "std6", "residual6", "baseline", "max_step", "net_day", "usual", "temporal", "std_6", "std_24", "run_length")
FLAGS = ("decoupled", "flat", "full_day")
OUT = "station_id string, ts timestamp, variable string, late boolean, kept string, prev_ts timestamp, seen long, " + ", ".join(f"{c} double" for c in NUMBERS) + ", " + ", ".join(f"{c} boolean" for c in FLAGS) + ", around array<struct<offset:int,all:array<double>,good:array<double>>>"
#: A row as it comes in: own rows have their neighbourhood, rows of neighbours and ticks of a clock have not.
ROW = ("station_id", "ts", "tick", "hood", "kept", "dewpoint", *VARIABLES, *(f"mean_{v}" for v in VARIABLES), *(f"std_{v}" for v in VARIABLES))


def samples(window: np.ndarray) -> np.ndarray:
    """The sample deviation of each row's numbers, NaN where there are fewer than two."""
    n = (~np.isnan(window)).sum(axis=1)
    total = np.nansum(window, axis=1)
    mean = np.divide(total, n, out=np.full(len(n), np.nan), where=n > 0)
    square = np.nansum((window - mean[:, None]) ** 2, axis=1)
    return np.sqrt(np.divide(square, n - 1, out=np.full(len(n), np.nan), where=n > 1))


def step_of(spread: float) -> int:
    return -(10**9) if spread <= 0 else round(math.log2(spread) * FINE)


def spread_at(step: int) -> float:
    return 0.0 if step == -(10**9) else 2.0 ** (step / FINE)


class Spreads:
    """Counts of spreads by step, kept in order, with the place of their median."""

    def __init__(self, steps: list[list[int]]):
        self.counts = {k: n for k, n in steps}
        self.order = sorted(self.counts)
        self.n = sum(self.counts.values())

    def add(self, spread: float) -> None:
        k = step_of(spread)
        if k not in self.counts:
            self.counts[k] = 0
            self.order.insert(int(np.searchsorted(self.order, k)), k)
        self.counts[k] += 1
        self.n += 1

    def median(self) -> float:
        if not self.n:
            return math.nan
        upto = np.cumsum([self.counts[k] for k in self.order])
        low, high = (spread_at(self.order[int(np.searchsorted(upto, r, side="right"))]) for r in ((self.n - 1) // 2, self.n // 2))
        return (low + high) / 2


class Station:
    """The state of a station, read from and written to JSON."""

    def __init__(self, text: str | None):
        s = json.loads(text) if text else {}
        self.clocks: dict[str, int] = s.get("clocks", {})
        self.hood: list[str] = s.get("hood", [])
        self.done: int | None = s.get("done")
        self.seen: int = s.get("seen", 0)
        self.wait: list = s.get("wait", [])
        self.near: dict[str, dict] = s.get("near", {})
        self.past: list = s.get("past", [])
        self.runs: list = s.get("runs", [[None, 0]] * len(VARIABLES))
        self.good: list = s.get("good", [[None, None]] * len(VARIABLES))
        self.recent: list = s.get("recent", [[] for _ in VARIABLES])
        self.spreads = [Spreads(x) for x in s.get("spreads", [[] for _ in VARIABLES])]

    def text(self) -> str:
        own = {k: getattr(self, k) for k in ("clocks", "hood", "done", "seen", "wait", "near", "past", "runs", "good", "recent")}
        return json.dumps(own | {"spreads": [[[k, s.counts[k]] for k in s.order] for s in self.spreads]})

    def take(self, name: str, rows: list[dict]) -> list[dict]:
        """Rows of a micro-batch into the state; own rows that come after their hour are given back, a second row for an hour is left out."""
        late = []
        known = {r["ts"] for r in self.wait}
        for r in sorted(rows, key=lambda r: (r["ts"], not r["tick"], str([r[v] for v in VARIABLES]))):
            self.clocks[r["station_id"]] = max(self.clocks.get(r["station_id"], r["ts"]), r["ts"])
            if r["tick"]:
                continue
            if r["station_id"] != name:
                if self.done is None or r["ts"] > self.done - CONFIG["window_h"] * HOUR:
                    self.near.setdefault(r["station_id"], {}).setdefault(str(r["ts"]), [[r[v] for v in VARIABLES], [r[f"mean_{v}"] for v in VARIABLES]])
            elif self.done is not None and r["ts"] <= self.done:
                late.append(r)
            elif r["ts"] not in known:
                known.add(r["ts"])
                self.wait.append({k: r[k] for k in ROW if k not in ("station_id", "hood", "tick")})
                self.hood = r["hood"] or []
        self.wait.sort(key=lambda r: r["ts"])
        return late

    def ready(self, name: str, late_h: int, patience_h: int) -> list[dict]:
        """Rows of hours that nobody is to add to: every neighbour has passed the look-ahead and ``late_h``, or most of the neighbourhood did so long ago.

        No single clock decides: one that is ahead, or stands still, changes nothing for the others.
        """
        reach = (CONFIG["window_h"] + late_h) * HOUR
        clocks = sorted(self.clocks.get(n, -(1 << 62)) for n in {name, *self.hood})
        upto = max(clocks[0] - reach, clocks[(len(clocks) - 1) // 2] - reach - patience_h * HOUR)
        k = 0
        while k < len(self.wait) and self.wait[k]["ts"] <= upto:
            k += 1
        out, self.wait = self.wait[:k], self.wait[k:]
        return out

    def judge(self, name: str, rows: list[dict]) -> pd.DataFrame:
        """OUT for rows in order of time, and the state after them."""
        before = len(self.past)
        both = self.past + [[r["ts"], r["dewpoint"], *(r[v] for v in VARIABLES)] for r in rows]
        table = np.array([[math.nan if x is None else x for x in r[1:]] for r in both], dtype=float)
        times = [r[0] for r in both]
        lead = np.vstack([np.full((PAST, table.shape[1]), np.nan), table])
        at = np.arange(before, len(both))
        exists = at[:, None] - np.arange(PAST, -1, -1) >= 0
        seen = self.seen + np.arange(1, len(rows) + 1)
        windows = np.stack([lead[k : k + PAST + 1] for k in at])
        dew, own = windows[:, :, 0], [windows[:, :, 1 + j] for j in range(len(VARIABLES))]
        step = [np.abs(w[:, -1] - w[:, -2]) for w in own]
        t, p, h = (CONFIG["decoupled"][v] for v in VARIABLES)
        shared = {"prev_dewpoint": dew[:, -2], "dewpoint": dew[:, -1], "decoupled": (step[0] > t) & (step[1] <= p) & (step[2] <= h), "prev_ts": [pd.NaT if k == 0 else pd.Timestamp(times[k - 1], unit="us") for k in at]}
        around = [[[self._around(r["ts"], j, o) for o in range(-CONFIG["window_h"], CONFIG["window_h"] + 1)] for j in range(len(VARIABLES))] for r in rows]
        frames = [pd.DataFrame(shared | self._variable(j, w, exists, seen, rows) | {"around": [[x for x in a[j] if x["all"]] for a in around]}) for j, w in enumerate(own)]
        self.seen += len(rows)
        self.past = both[-PAST:]
        self.done = rows[-1]["ts"]
        old = self.done - CONFIG["window_h"] * HOUR
        self.near = {n: {k: v for k, v in x.items() if int(k) > old} for n, x in self.near.items()}
        return pd.concat(frames, ignore_index=True)

    def _around(self, ts: int, j: int, offset: int) -> dict:
        """The neighbours' anomalies of a variable at an offset, and those of values in range."""
        key, (lo, hi) = str(ts + offset * HOUR), _RANGES[j]
        told = [(x[0][j], x[0][j] - x[1][j]) for n in self.hood if (x := self.near.get(n, {}).get(key)) and x[0][j] is not None and x[1][j] is not None]
        return {"offset": offset, "all": [a for _, a in told], "good": [a for v, a in told if lo <= v <= hi]}

    def _variable(self, j: int, w: np.ndarray, exists: np.ndarray, seen: np.ndarray, rows: list[dict]) -> dict:
        v = w[:, -1]
        count = lambda n: (~np.isnan(w[:, -n:])).sum(axis=1)
        n = _FLAT[j]
        flat = (exists[:, -n]) & (count(n) == n) & (np.nanmin(np.nan_to_num(w[:, -n:]), axis=1) == np.nanmax(np.nan_to_num(w[:, -n:]), axis=1))
        if VARIABLES[j] == "rh_pct":
            flat &= ~(v >= CONFIG["flat_ignore_rh"])
        spread, full = samples(w[:, -6:]), count(6) == 6
        x = np.arange(6) - 2.5
        y = w[:, -6:] - w[:, -6:].mean(axis=1, keepdims=True)
        rest = (y**2).sum(axis=1) - (y @ x) ** 2 / (x @ x)
        steps = np.abs(np.diff(w[:, -24:], axis=1))
        with np.errstate(all="ignore"):
            base = np.array([np.median(b[~np.isnan(b)]) if (~np.isnan(b)).sum() >= 3 else math.nan for b in w[:, :24]])
            biggest = np.array([np.nanmax(s) if (~np.isnan(s)).any() else math.nan for s in steps])
        usual, temporal, runs, loose = [], [], [], np.where(count(6) >= 4, spread, np.nan)
        whole = samples(w[:, -12:])
        lo, hi = _RANGES[j]
        for k in range(len(rows)):
            # spreads enter the median six rows later
            self.recent[j].append(None if np.isnan(loose[k]) else float(loose[k]))
            if len(self.recent[j]) > 6 and (old := self.recent[j].pop(0)) is not None:
                self.spreads[j].add(old)
            usual.append(float(whole[k]) if seen[k] <= 12 else self.spreads[j].median())
            last, previous = self.good[j]
            temporal.append(math.nan if last is None else last if previous is None else 2 * last - previous)
            own = None if np.isnan(v[k]) else float(v[k])
            if own is not None and lo <= own <= hi:
                self.good[j] = [own, last]
            value, run = self.runs[j]
            self.runs[j] = [own, run + 1 if own is not None and own == value else 1]
            runs.append(float(self.runs[j][1]))
        name = VARIABLES[j]
        given = lambda c: np.array([math.nan if r[c] is None else r[c] for r in rows], dtype=float)
        return {
            "ts": [pd.Timestamp(r["ts"], unit="us") for r in rows], "variable": name, "kept": [r["kept"] for r in rows], "seen": seen,
            "value": v, "mean": given(f"mean_{name}"), "std": given(f"std_{name}"), "lag1": w[:, -2], "lag2": w[:, -3], "lag3": w[:, -4], "flat": flat,
            "std6": np.where(full, spread, np.nan), "residual6": np.where(full, np.sqrt(np.maximum(rest, 0) / 5), np.nan), "baseline": base,
            "full_day": count(24) == 24, "max_step": biggest, "net_day": np.abs(v - w[:, -24]), "usual": usual, "temporal": temporal,
            "std_6": spread, "std_24": samples(w[:, -24:]), "run_length": runs,
        }


def _plain(x):
    return None if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)) else x


class StationProcessor(StatefulProcessor):
    """Rows for a station - its own, its neighbours', ticks - to OUT; late ones come out at once with nothing but their values."""

    def __init__(self, late_h: int, patience_h: int):
        self.late_h, self.patience_h = late_h, patience_h

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("station", "text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        name = key[0]
        station = Station(self.state.get()[0] if self.state.exists() else None)
        taken = []
        for frame in rows:
            frame = frame.assign(ts=frame["ts"].astype("datetime64[us]").astype("int64"))
            for r in frame[list(ROW)].to_dict("records"):
                r = {k: v if k == "hood" else _plain(v) for k, v in r.items()}
                r["hood"] = None if r["hood"] is None else sorted(r["hood"])
                taken.append(r)
        late = station.take(name, taken)
        ready = station.ready(name, self.late_h, self.patience_h)
        out = station.judge(name, ready).assign(late=False) if ready else None
        self.state.update((station.text(),))
        columns = [c.split()[0] for c in OUT.split(", ") if not c.startswith(("all:", "good:"))]
        if out is not None:
            yield out.assign(station_id=name)[columns]
        if late:
            told = [{"station_id": name, "ts": pd.Timestamp(r["ts"], unit="us"), "variable": v, "late": True, "kept": r["kept"], "value": r[v]} for r in late for v in VARIABLES]
            frame = pd.DataFrame(told).reindex(columns=columns).assign(prev_ts=pd.NaT, seen=0, **dict.fromkeys(FLAGS, False), around=[[] for _ in told])
            yield frame.assign(prev_ts=pd.to_datetime(frame["prev_ts"]))[columns]

    def close(self) -> None:
        pass


class TrustProcessor(StatefulProcessor):
    """A sensor's changes in order of time, added within bounds; its state is one number. Late rows pass by."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("trust", "trust double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = self.state.get()[0] if self.state.exists() else CONFIG["trust_start"]
        frame = pd.concat(list(rows)).sort_values("ts", kind="stable").reset_index(drop=True)
        out = []
        for change, late in zip(frame["change"], frame["late"], strict=True):
            now = now if late else min(max(now + change, 0.0), 100.0)
            out.append(math.nan if late else now)
        self.state.update((float(now),))
        yield frame.assign(trust=out).drop(columns="change")

    def close(self) -> None:
        pass
