"""Appending preferences one by one, as a serving process does: lines are collected and put into the open generation's inbound folder as gzip files."""

from __future__ import annotations

import gzip
import math
import tempfile
import threading
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

from ..config import Settings
from . import layout
from .layout import Layout
from .store import Store


class EventWriter:
    """Collects lines in a local file and puts it into the inbound folder after ``writes_between_upload`` of them, when another generation has been opened, and on ``roll``.

    Every line has left the process before a call returns; files that a process left behind are put into the open generation by the next one with the same
    ``spool`` folder, which one process uses at a time. Each has the name it will get, so one that was uploaded before the process ended isn't taken twice. A file appears under its name only
    when it is complete; until then it ends in ``.inprogress``. Nothing is written without lines. Calls may come from several threads. ``every``: seconds
    after which ``check`` is called by itself."""

    def __init__(self, spark: SparkSession, root: str, instance: str, settings: Settings | int | None = None, spool: str | None = None, every: float | None = None, **options: int):
        limit = options.get("writes_between_upload") or (settings if isinstance(settings, int) else (settings or Settings()).writes_between_upload)
        self.store, self.at, self.limit = Store(spark), Layout(root, instance), limit
        self.generation = self._open()
        self.spool = Path(spool or tempfile.mkdtemp(prefix="factorloom-events-"))  # of this process's machine, as in any log before upload
        self.spool.mkdir(parents=True, exist_ok=True)
        self.count, self.file, self.out = 0, None, None
        self.busy, self.ended = threading.RLock(), threading.Event()
        for left in sorted(self.spool.glob("*.csv")):
            self._upload(left)
        if every is not None:
            threading.Thread(target=self._tick, args=(every,), daemon=True).start()

    def _tick(self, every: float) -> None:
        while not self.ended.wait(every):
            self.check()

    def close(self) -> None:
        self.ended.set()
        self.roll()

    def _open(self) -> int:
        there = [int(n) for n in self.store.list(self.at.home, files=False) if n.isdigit()]
        if not there:
            raise ValueError("no generation is open")
        return max(there)

    @staticmethod
    def _field(x: int | str) -> str:
        if isinstance(x, int):
            return str(x)
        if not x or any(c in x for c in '",\n\r'):
            raise ValueError(f"not a tag: {x!r}")
        return f'"{x}"'

    def append(self, user: int | str, item: int | str, value: float = 1.0) -> None:
        """A preference of a user for an item; either one, not both, may be a tag."""
        if isinstance(user, str) and isinstance(item, str):
            raise ValueError("user and item can't both be tags")
        if not math.isfinite(value):
            raise ValueError("the value must be finite")
        self._add(f"{self._field(user)},{self._field(item)},{value}")

    def remove(self, user: int | str, item: int | str) -> None:
        if isinstance(user, str) and isinstance(item, str):
            raise ValueError("user and item can't both be tags")
        self._add(f"{self._field(user)},{self._field(item)},")

    def _add(self, line: str) -> None:
        with self.busy:
            if self.out is None:
                self.file = self.spool / f"{self.generation:010d}-{uuid.uuid4().hex}.csv"
                self.out = self.file.open("a")
            self.out.write(line + "\n")
            self.out.flush()
            self.count += 1
            if self.count >= self.limit:
                self.roll()

    def _upload(self, file: Path) -> str | None:
        """Puts a local file into the generation that was open when it was begun, if that still takes data, else into the one open now."""
        begun, name = file.stem.split("-", 1)
        there = {int(n) for n in self.store.list(self.at.home, files=False) if n.isdigit()}
        if any(self.store.exists(self.at.generation(n, f"{layout.INBOUND}/{name}.csv.gz")) for n in there):
            file.unlink()
            return None
        data = file.read_bytes()
        data = data[: data.rfind(b"\n") + 1]  # a line that wasn't finished was never acknowledged
        n = int(begun)
        open_still = n in there and not self.store.exists(self.at.generation(n, layout.SUCCESS)) and max(there) <= n + 1
        written = self.at.generation(n if open_still else max(there), f"{layout.INBOUND}/{name}.csv.gz")
        if data:
            self.store.write(f"{written}.inprogress", gzip.compress(data))
            self.store.move(f"{written}.inprogress", written)
        file.unlink()
        return written if data else None

    def roll(self) -> str | None:
        """Puts what has been collected into the generation that was open when it was; returns the file."""
        with self.busy:
            written = None
            if self.out is not None:
                self.out.close()
                written = self._upload(self.file)
                self.count, self.file, self.out = 0, None, None
            self.generation = self._open()
            return written

    def check(self) -> None:
        """To be called now and then: rolls if another generation has been opened since."""
        with self.busy:
            if self._open() != self.generation:
                self.roll()
