"""Decisions of the batch layer as plain functions: which generation to run, when, in what order, and how a job's state is summed up."""

from __future__ import annotations

import json
from collections.abc import Callable, Hashable, Iterable
from concurrent.futures import ThreadPoolExecutor, as_completed
from dataclasses import dataclass, field, replace
from enum import Enum
from graphlib import CycleError, TopologicalSorter
from typing import TypeVar

from pyspark import inheritable_thread_target

T = TypeVar("T", bound=Hashable)

#: Seconds that the next generation's inbound folder must have existed before its predecessor is run.
BARRIER = 4 * 60
#: Endings of files that are still being uploaded.
UPLOADING = (".inprogress", "_COPYING_")


@dataclass(frozen=True)
class Choice:
    make: int | None = None  # generation to open
    run: int | None = None
    wait_for: int | None = None  # generation that must be open before
    last_done: int | None = None
    delete: tuple[int, ...] = ()


def choose(generations: Iterable[int], done: Iterable[int], keep: int) -> Choice:
    """What to do with the generations that exist. All but the newest ``keep`` are deleted first.

    The generation after the last done one is run once another one is open behind it, so that new data has a place to go; where there is none, it is made."""
    if keep < 2:
        raise ValueError("at least two generations are kept")
    all_of = sorted(set(generations))
    delete, left = tuple(all_of[:-keep]), all_of[-keep:]
    finished = [g for g in left if g in set(done)]
    last = finished[-1] if finished else None
    waiting = [g for g in left if last is None or g > last]
    if not waiting:
        return Choice(make=0 if last is None else last + 1, last_done=last, delete=delete)
    run = waiting[0]
    if len(waiting) == 1:
        return Choice(make=run + 1, run=run, wait_for=run + 1, last_done=last, delete=delete)
    return Choice(run=run, wait_for=waiting[1], last_done=last, delete=delete)


@dataclass(frozen=True)
class Barrier:
    ready: bool
    stale: tuple[str, ...] = ()  # unfinished uploads so old that they are deleted


def barrier(next_opened: float, uploads: dict[str, float], now: float, wait: float = BARRIER) -> Barrier:
    """Whether a generation may run: the next one has been open long enough and no upload to this one is under way. uploads: modification times by file."""
    unfinished = {f: t for f, t in uploads.items() if f.endswith(UPLOADING)}
    stale = tuple(sorted(f for f, t in unfinished.items() if now >= t + 5 * wait))
    return Barrier(now > next_opened + wait and len(stale) == len(unfinished), stale)


@dataclass(frozen=True)
class Clock:
    """When generations were and are due; ``due`` gives the next one. Seconds."""

    every: float = 1440 * 60
    data_mb: int | None = 1000
    due_at: float = 0.0


def clock(now: float, every_min: float = 1440, data_mb: int | None = 1000, first_min: float | None = None) -> Clock:
    return Clock(60 * every_min, data_mb, now + 60 * (every_min if first_min is None else first_min))


def due(c: Clock, now: float, inbound_bytes: int, any_generation: bool, forced: bool = False) -> tuple[bool, Clock]:
    """(whether a generation is to be run, the clock after that): when forced or there is none yet, by time or by data. Runs that are late don't shift those after them."""
    late = now >= c.due_at
    full = c.data_mb is not None and inbound_bytes // 1_000_000 >= c.data_mb
    if not (late or full or forced or not any_generation):
        return False, c
    return True, replace(c, due_at=(c.due_at if now > c.due_at else now) + c.every)


def caught_up(c: Clock, now: float) -> Clock:
    """After a run that took longer than the interval the next one is due at once, and only once."""
    return replace(c, due_at=now) if now > c.due_at else c


def waves(steps: Iterable[T], after: Iterable[tuple[T, T]]) -> list[list[T]]:
    """Steps in waves: each step comes after all it depends on. after: (step, what it needs). A cycle is an error."""
    order: TopologicalSorter = TopologicalSorter()
    for s in steps:
        order.add(s)
    for step, need in after:
        order.add(step, need)
    out = []
    try:
        order.prepare()
    except CycleError as e:
        raise ValueError(f"steps depend on each other: {e.args[1]}") from e
    while order.is_active():
        out.append(list(order.get_ready()))
        order.done(*out[-1])
    return out


class Status(Enum):
    PENDING = "PENDING"
    RUNNING = "RUNNING"
    FAILED = "FAILED"
    CANCELLED = "CANCELLED"
    COMPLETED = "COMPLETED"


def roll_up(states: Iterable[Status]) -> Status:
    """State of a job: the worst of its steps; done and pending steps together mean running."""
    seen = set(states)
    for worst in (Status.FAILED, Status.CANCELLED, Status.RUNNING):
        if worst in seen:
            return worst
    if Status.PENDING in seen or not seen:
        return Status.RUNNING if Status.COMPLETED in seen else Status.PENDING
    return Status.COMPLETED


class Interrupted(Exception):
    """Somebody asked for the run to end."""


@dataclass
class Job:
    """Named steps, run in waves with a thread for each step of a wave; the first failure ends the job. ``changed`` is told of every change of state, ``stop`` is asked before each wave."""

    steps: dict[str, Callable[[], None]]
    after: list[tuple[str, str]] = field(default_factory=list)
    status: dict[str, Status] = field(default_factory=dict)
    changed: Callable[[dict[str, Status]], None] = lambda status: None
    stop: Callable[[], bool] = lambda: False

    def _set(self, step: str, state: Status) -> None:
        self.status[step] = state
        self.changed(dict(self.status))

    def _cancel(self) -> None:
        for s, state in list(self.status.items()):
            if state is Status.PENDING:
                self._set(s, Status.CANCELLED)

    def run(self) -> Status:
        self.status = {s: Status.PENDING for s in self.steps}
        for wave in waves(self.steps, self.after):
            if self.stop():
                self._cancel()
                raise Interrupted
            with ThreadPoolExecutor(len(wave)) as pool:
                running = {}
                for s in wave:
                    self._set(s, Status.RUNNING)
                    running[pool.submit(inheritable_thread_target(self.steps[s]))] = s
                failure = None
                for f in as_completed(running):
                    error = f.exception()
                    self._set(running[f], Status.FAILED if error else Status.COMPLETED)
                    failure = failure or error
                if failure:
                    self._cancel()
                    raise failure
        return roll_up(self.status.values())


def status_json(status: dict[str, Status]) -> str:
    return json.dumps({"status": roll_up(status.values()).value, "steps": {k: v.value for k, v in status.items()}})


def minutes(text: str) -> int:
    """``90``, ``90m``, ``2h`` or ``1d`` as minutes."""
    factors = {"m": 1, "h": 60, "d": 1440}
    return int(text) if text[-1].isdigit() else int(text[:-1]) * factors[text[-1]]


def megabytes(text: str) -> int:
    """``500``, ``500m``, ``2g`` or ``1t`` as decimal megabytes."""
    factors = {"m": 1, "g": 1000, "t": 1_000_000}
    return int(text) if text[-1].isdigit() else int(text[:-1]) * factors[text[-1]]
