"""Control of a scan from outside, and its progress as the stream itself measures it.

The gate is a file in the run's folder: whoever can write there pauses or stops the scan, from any process, and tasks on
any machine see it between two folders or documents. Progress comes from the events of the query's listener: the counts
are observed by the plan while it runs, one set for each micro-batch, so one that is run again counts once.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

#: Notes of finished documents that a feed shows; seconds between two looks at a shut gate.
RECENT, LOOK = 40, 0.25


class Stopped(Exception):
    """The scan was stopped by its gate."""


class Gate:
    """``open``, ``paused`` or ``stopped``, in a file that has the time it was shut and the seconds it was before."""

    def __init__(self, path: str) -> None:
        self.path = path

    def _read(self) -> dict:
        try:
            with open(self.path, encoding="utf-8") as file:
                return json.load(file)
        except (OSError, ValueError):
            return {"state": "open", "shut_s": 0.0}

    @property
    def state(self) -> str:
        return self._read()["state"]

    def shut_seconds(self) -> float:
        """How long the gate has been paused in all."""
        now = self._read()
        return now["shut_s"] + (time.time() - now["since"] if now["state"] == "paused" else 0.0)

    def put(self, state: str) -> None:
        if state != self.state:
            now = {"state": state, "shut_s": self.shut_seconds(), "since": time.time()}
            with open(f"{self.path}.tmp", "w", encoding="utf-8") as file:
                json.dump(now, file)
            os.replace(f"{self.path}.tmp", self.path)

    def pause(self) -> None:
        if self.state == "open":
            self.put("paused")

    def resume(self) -> None:
        if self.state == "paused":
            self.put("open")

    def stop(self) -> None:
        self.put("stopped")

    def reopen(self) -> None:
        """For a new session, whatever ended the last."""
        self.put("open")

    def wait(self) -> None:
        """Return once the gate is open; for tasks, between two pieces of work."""
        while (state := self.state) != "open":
            if state == "stopped":
                raise Stopped
            time.sleep(LOOK)


def watched(df: DataFrame, name: str, **counts: Column) -> DataFrame:
    """``df``, whose rows are counted as ``name`` while they pass, with other aggregates."""
    return df.observe(name, F.count(F.lit(1)).alias("docs"), *[c.alias(k) for k, c in counts.items()])


class Progress(StreamingQueryListener):
    """The progress of one scan: a small JSON file, replaced at every micro-batch, which ``listeners`` get as well.

    As long as folders are being listed there is neither a share nor a time left, since they would be of a part. Rate and
    time left are of this session: its documents, and the time that its micro-batches took less what the gate was shut.
    """

    def __init__(self, path: str, gate: Gate | None = None, listeners: tuple[Callable[[dict], None], ...] = ()) -> None:
        self.path, self.gate, self.listeners = path, gate, listeners
        self.query, self.discovering, self.total, self.before = "", True, 0, 0
        self.batches: dict[int, dict] = {}
        self.seconds: dict[int, float] = {}
        self.notes: dict[int, list[dict]] = {}
        self._shut = gate.shut_seconds() if gate else 0.0

    def begin(self, query: str, total: int, before: int) -> None:
        """``before`` of ``total`` documents were finished in earlier sessions; the query's events count from now on."""
        self.query, self.total, self.before, self.discovering = query, total, before, False
        self.publish()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if event.progress.name == self.query:
            self.batch(event.progress.batchId, {k: r.asDict() for k, r in event.progress.observedMetrics.items()}, event.progress.durationMs.get("triggerExecution", 0) / 1000)

    def batch(self, number: int, observed: dict[str, dict], seconds: float) -> None:
        """What was observed of a micro-batch; the last report of a batch holds."""
        if observed:
            self.batches[number], self.seconds[number] = observed, seconds
            self.publish()

    def noted(self, number: int, notes: list[dict]) -> None:
        self.notes[number] = notes
        for old in sorted(self.notes)[:-RECENT]:
            del self.notes[old]

    def counts(self, name: str) -> dict:
        """The sums of what was observed as ``name``."""
        out: dict = {}
        for observed in self.batches.values():
            for k, v in observed.get(name, {}).items():
                out[k] = out.get(k, 0) + (v or 0)
        return out

    def stages(self) -> list[dict]:
        """stage, docs, errors and ms_per_doc of the scan so far; stages run as one, so their time is shared."""
        names = dict.fromkeys(k for observed in self.batches.values() for k in observed if k.startswith("stage_"))
        spent, done = sum(self.seconds.values()), self.counts("finished").get("docs", 0)
        return [{"stage": n.removeprefix("stage_"), "ms_per_doc": 1000 * spent / done if done else 0.0} | self.counts(n) for n in names]

    def publish(self, state: str = "running") -> dict:
        counts = self.counts("finished")
        fresh = counts.pop("docs", 0)
        spent = max(0.0, sum(self.seconds.values()) - (self.gate.shut_seconds() - self._shut if self.gate else 0.0))
        done, known = self.before + fresh, bool(self.total) and not self.discovering
        rate = fresh / spent if fresh and spent and known else None
        notes = [n for number in sorted(self.notes, reverse=True) for n in self.notes[number]]
        told = {
            "state": state, "discovering": self.discovering, "done": done, "total": self.total, "counts": counts, "recent": notes[:RECENT], "stages": self.stages(),
            "paused": bool(self.gate and self.gate.state == "paused"), "elapsed_s": round(spent, 1), "rate": rate and round(rate, 2),
            "pct": 100.0 if state == "done" else round(100 * done / self.total, 1) if known else 0.0, "eta_s": 0 if state == "done" else round((self.total - done) / rate) if rate else None,
        }
        with open(f"{self.path}.tmp", "w", encoding="utf-8") as file:
            json.dump(told, file)
        os.replace(f"{self.path}.tmp", self.path)
        for listener in self.listeners:
            listener(told)
        return told


def terminal(out) -> Callable[[dict], None]:
    """A listener that keeps one line on a terminal."""

    def show(s: dict) -> None:
        left = f", {s['eta_s']} s left" if s["eta_s"] is not None else ""
        out.write(f"\r{s['state']}: {s['done']} of {s['total'] or '?'} ({s['pct']} %){left}   " + ("\n" if s["state"] != "running" else ""))
        out.flush()

    return show
