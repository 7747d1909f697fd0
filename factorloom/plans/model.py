"""A published model as the serving side loads it."""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..config import Settings
from ..operators import loading
from ..sources import events, layout
from ..sources.layout import Layout
from ..sources.store import Store
from .generation import latest_complete

log = logging.getLogger(__name__)


@dataclass
class Model:
    generation: int
    x: DataFrame
    y: DataFrame
    known: DataFrame
    item_tags: DataFrame
    user_tags: DataFrame

    def prune(self, current: DataFrame, side: str, recent: DataFrame) -> DataFrame:
        return loading.prune(current, self.x if side == "x" else self.y, recent)


class Refresher:
    """Keeps the newest model of an instance: looks for one every ``every`` seconds, once at a time however often it is asked.

    On a change ``taken(model, before)`` is called; ``kept`` tells which of its rows the serving side keeps: those of the new model and those active of late, or,
    with ``remove_not_updated`` off, all."""

    def __init__(self, spark: SparkSession, root: str, instance: str, settings: Settings | None = None, part: int | None = None, parts: int = 1, taken: Callable[[Model, Model | None], None] = lambda new, old: None):
        self.spark, self.root, self.instance, self.settings, self.part, self.parts, self.taken = spark, root, instance, settings or Settings(), part, parts, taken
        self.model: Model | None = None
        self._busy, self._ended = threading.Lock(), threading.Event()
        self._thread: threading.Thread | None = None

    def refresh(self) -> bool:
        """True if a newer model was taken; False at once if another refresh is under way."""
        if not self._busy.acquire(blocking=False):
            return False
        try:
            newest = latest_complete(Store(self.spark), Layout(self.root, self.instance), with_model=True)
            if newest is None or self.model is not None and newest <= self.model.generation:
                return False
            new = load(self.spark, self.root, self.instance, self.part, self.parts)
            if new is None:
                return False
            old, self.model = self.model, new
            self.taken(new, old)
            return True
        finally:
            self._busy.release()

    def kept(self, current: DataFrame, side: str, recent: DataFrame) -> DataFrame:
        if self.model is None or not self.settings.remove_not_updated:
            return current
        return self.model.prune(current, side, recent)

    def start(self, every: float = 7 * 60) -> None:
        def run() -> None:
            while not self._ended.wait(every):
                try:
                    self.refresh()
                except Exception:
                    log.exception("refresh failed")

        self._thread = threading.Thread(target=run, daemon=True)
        self._thread.start()

    def stop(self) -> None:
        self._ended.set()
        if self._thread is not None:
            self._thread.join()


def load(spark: SparkSession, root: str, instance: str, part: int | None = None, parts: int = 1) -> Model | None:
    """The newest complete generation with a model, or None. X is that of one serving partition; Y and known items are always whole. A malformed line is an error."""
    store, at = Store(spark), Layout(root, instance)
    n = latest_complete(store, at, with_model=True)
    if n is None:
        return None
    x, y = (events.parse_factors(spark.read.text(at.generation(n, p))) for p in (layout.X, layout.Y))
    if x.isEmpty() or y.isEmpty():
        return None
    known = events.parse_known(spark.read.text(at.generation(n, layout.KNOWN)))
    tags = [events.read_tag_ids(spark, at.generation(n, p)) for p in (layout.X_TAGS, layout.Y_TAGS)]
    return Model(n, loading.of_partition(x, part, parts), y, known, *tags)


def load_clusters(spark: SparkSession, root: str, instance: str, generation: int, kind: str) -> DataFrame:
    at = Layout(root, instance)
    members = events.parse_factors(spark.read.text(at.generation(generation, at.clusters(kind)))).selectExpr("id", "cast(features[0] as int) as cluster")
    centroids = events.parse_factors(spark.read.text(at.generation(generation, at.centroids(kind)))).selectExpr("cast(id as int) as cluster", "features as centroid")
    return loading.clusters(members, centroids)
