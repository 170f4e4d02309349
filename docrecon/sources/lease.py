"""Who may write a run: a short lock for one change, and a lease for a job, whose late writes are refused.

The lock is the operating system's on an open file, so that it goes with its process, however that ends. A lease outlives
no process either: its owner renews it, and one that wasn't renewed for ``ttl`` seconds is free. Every lease has a number
greater than those before it. Whoever writes for a job does so under the lock and only while the run's number is still the
job's own, so an owner that was thought dead and wakes up changes nothing. Ages are told by the times that the file system
gives to files, not by clocks of several machines.
"""

from __future__ import annotations

import fcntl
import json
import os
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager

META = "run_meta.json"
#: Seconds after which a lease that isn't renewed is free.
TTL = 60.0


class Busy(RuntimeError):
    """Another job holds the run."""


class LeaseLost(RuntimeError):
    """The run has passed to another owner."""


def read_meta(run: str) -> dict:
    try:
        with open(os.path.join(run, META), encoding="utf-8") as file:
            return json.load(file)
    except (OSError, ValueError):
        return {}


def put_meta(run: str, meta: dict) -> dict:
    """Replace the metadata at once; the caller holds the lock."""
    path = os.path.join(run, META)
    with open(path + ".tmp", "w", encoding="utf-8") as file:
        json.dump(meta, file, indent=1)
    os.replace(path + ".tmp", path)
    return meta


@contextmanager
def locked(run: str, wait: float = 30.0) -> Iterator[None]:
    """Hold the run's lock, which one thread of one process can have."""
    until = time.monotonic() + wait
    with open(os.path.join(run, META + ".lock"), "a") as file:
        while True:
            try:
                fcntl.flock(file, fcntl.LOCK_EX | fcntl.LOCK_NB)
                break
            except BlockingIOError:
                if time.monotonic() > until:
                    raise TimeoutError(f"{run} is locked by another process") from None
                time.sleep(0.02)
        yield


def _touch(run: str, name: str) -> float:
    """Write a small file and return the time that its file system gave it."""
    path = os.path.join(run, name)
    with open(path, "w") as file:
        file.write(".")
    return os.stat(path).st_mtime


def holder(run: str, meta: dict) -> str | None:
    """What holds the run, None if nothing does or its owner is gone. The caller holds the lock."""
    lease = meta.get("lease")
    if not lease:
        return None
    try:
        last = os.stat(os.path.join(run, "lease.beat")).st_mtime
    except FileNotFoundError:
        return None
    return lease["what"] if _touch(run, "lease.now") - last <= lease["ttl"] else None


def refuse_if_busy(run: str, meta: dict) -> None:
    if what := holder(run, meta):
        raise Busy(f"the run is busy: {what}")


class Lease:
    """A job's claim on a run, renewed by a thread as long as it is held."""

    def __init__(self, run: str, what: str, ttl: float = TTL) -> None:
        self.run, self.what, self.ttl, self.number = run, what, ttl, 0
        self._over = threading.Event()

    def __enter__(self) -> Lease:
        with locked(self.run):
            meta = read_meta(self.run)
            refuse_if_busy(self.run, meta)
            self.number = meta.get("lease_number", 0) + 1
            _touch(self.run, "lease.beat")
            put_meta(self.run, meta | {"lease_number": self.number, "lease": {"what": self.what, "number": self.number, "ttl": self.ttl}})
        threading.Thread(target=self._renew, daemon=True).start()
        return self

    def _renew(self) -> None:
        while not self._over.wait(self.ttl / 4):
            try:
                with self.writing():
                    _touch(self.run, "lease.beat")
            except LeaseLost:
                return
            except (OSError, TimeoutError):
                continue  # the next time may do, or the lease runs out

    @contextmanager
    def writing(self) -> Iterator[dict]:
        """Hold the lock for a write of this job, which is refused if the run has passed on; gives the metadata."""
        with locked(self.run):
            meta = read_meta(self.run)
            if (meta.get("lease") or {}).get("number") != self.number:
                raise LeaseLost(f"{self.what} no longer holds {self.run}")
            yield meta

    def __exit__(self, *_) -> None:
        self._over.set()
        with locked(self.run):
            meta = read_meta(self.run)
            if (meta.get("lease") or {}).get("number") == self.number:
                put_meta(self.run, meta | {"lease": None})


def write_meta(run: str, lease: Lease | None = None, **changes) -> dict:
    """Merge ``changes`` into the metadata, for a job if its ``lease`` is given."""
    with lease.writing() if lease else locked(run):
        return put_meta(run, read_meta(run) | changes)


@contextmanager
def edited(run: str, name: str) -> Iterator[int]:
    """A number of the run for one edit, which nobody else gets. The lock is held until the edit is written, so that no
    job begins in between; refused while one holds the run."""
    with locked(run):
        meta = read_meta(run)
        refuse_if_busy(run, meta)
        number = meta.get(name, 0) + 1
        yield number
        put_meta(run, meta | {name: number})
