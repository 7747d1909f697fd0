"""One generation from inbound lines to published results, each step resumable."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.linalg import full_rank, gramian
from ..operators import als, chain, cluster, merge, rows, topn
from ..session import ship
from ..sources import events, layout
from ..sources.layout import Layout
from ..sources.sinks import factor_lines, format_pairs, write_output, write_text
from ..sources.store import Store
from . import schedule


class Generation:
    """Steps of generation ``number`` of an instance; ``last`` is the last complete one. A step whose output carries ``_SUCCESS`` is skipped, any other output is replaced."""

    def __init__(self, spark: SparkSession, root: str, instance: str, number: int, last: int | None, settings: Settings | None = None):
        self.spark, self.settings, self.number, self.last = spark, settings or Settings(), number, last
        self.at, self.store = Layout(root, instance), Store(spark)
        self.centroids: dict[str, DataFrame] = {}
        self.noting = threading.Lock()
        ship(spark)

    def path(self, part: str, number: int | None = None) -> str:
        return self.at.generation(self.number if number is None else number, part)

    def kept(self, part: str, make: Callable[[], DataFrame], partitions: int | None = None) -> DataFrame:
        """The Parquet table of a step, made unless it is complete."""
        path = self.path(part)
        if not self.store.exists(f"{path}/{layout.SUCCESS}"):
            self.store.delete(path, recursive=True)
            df = make()
            (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
        return self.spark.read.parquet(path)

    def once(self, part: str, write: Callable[[str], None]) -> None:
        if not self.store.exists(f"{self.path(part)}/{layout.SUCCESS}"):
            write(self.path(part))

    def previous(self, part: str) -> DataFrame | None:
        """A table of the last generation; None if there is no last one. One that is gone is an error, or all history would be dropped."""
        if self.last is None:
            return None
        if not self.store.exists(self.path(part, self.last)):
            raise ValueError(f"generation {self.last} has no {part}")
        return self.spark.read.parquet(self.path(part, self.last))

    def previous_y(self) -> DataFrame | None:
        if self.last is None or not self.store.exists(self.path(layout.Y, self.last)):
            return None  # a model that wasn't published
        return events.parse_factors(self.spark.read.text(self.path(layout.Y, self.last)))

    def run(self, recommend: bool = True, similar: bool = True, clusters: bool = False, stop: Callable[[], bool] = lambda: False) -> als.Model:
        """All steps, in waves; those of a wave at the same time. Their states are kept in a file below ``sys`` of the instance; ``stop`` is asked between waves."""
        s, out = self.settings, {}

        def parse() -> None:
            parsed = self.kept("tmp/parsed", lambda: events.parse_lines(events.read_inbound(self.spark, s.input_path or self.path(layout.INBOUND), s.input_format)))
            events.check_budget(parsed, s.bad_line_budget)
            out["good"] = parsed.where("not is_bad")

        def merge_input() -> None:
            out["prefs"] = self.kept(layout.INPUT, lambda: merge.merge_old_new(self.previous(layout.INPUT), out["good"], s.decay_factor, s.zero_threshold))
            out["known"] = rows.known_items(out["prefs"])

        def tags(kind: str, name: str) -> Callable[[], None]:
            def step() -> None:
                before = None if self.last is None else events.read_tag_ids(self.spark, self.path(name, self.last))
                self.once(name, lambda p: write_text(merge.merge_tags(events.tags(out["good"]).where(F.col("kind") == kind), before), p, "id", one_file=True))
                out[f"{kind}_tags"] = events.read_tag_ids(self.spark, self.path(name))

            return step

        def publish_known() -> None:
            self.once(layout.KNOWN, lambda p: write_text(out["known"].withColumn("line", F.array_join(F.transform("items", lambda i: i.cast("string")), ",")), p, "user_id", "line"))

        def fit() -> None:
            out["model"] = self.fit(out["prefs"], (out["item_tags"], out["user_tags"]) if clusters else None)

        def publish(name: str, side: str) -> Callable[[], None]:
            return lambda: self.once(name, lambda p: write_text(factor_lines(getattr(out["model"], side)), p, "id", "line"))

        def recommendations() -> None:
            work = topn.recommend_work(out["model"].x, out["known"], out["item_tags"])  # tags that stand for users come from item tags
            recs = topn.recommend(work, out["model"].y, s.recs_count, out["user_tags"])
            self.once(layout.RECS, lambda p: write_output(recs.select("id", format_pairs("recs", s.recs_format).alias("line")), p, "id", "line", (s.recs_sink_format, s.recs_sink_path)))

        def similar_items() -> None:
            near = topn.similar(out["model"].y, s.similar_count, out["user_tags"])
            self.once(layout.SIMILAR, lambda p: write_output(near.select("id", format_pairs("recs", s.similar_format).alias("line")), p, "id", "line", (s.similar_sink_format, s.similar_sink_path)))

        def publish_clusters(kind: str, side: str, left_out: str) -> Callable[[], None]:
            def step() -> None:
                centres = self.centroids[kind]
                of = cluster.assign(getattr(out["model"], side), centres, out[left_out])
                self.once(self.at.clusters(kind), lambda p: write_text(of, p, "id", "cluster"))
                self.once(self.at.centroids(kind), lambda p: write_text(factor_lines(centres, "centroid"), p, "cluster", "line", one_file=True))

            return step

        steps = {"parse": parse, "merge": merge_input, "itemTags": tags("item", layout.X_TAGS), "userTags": tags("user", layout.Y_TAGS), "knownItems": publish_known, "factors": fit, "publishX": publish(layout.X, "x"), "publishY": publish(layout.Y, "y")}
        after = [("merge", "parse"), ("itemTags", "parse"), ("userTags", "parse"), ("knownItems", "merge"), ("factors", "merge"), ("factors", "itemTags"), ("factors", "userTags"), ("publishX", "factors"), ("publishY", "factors")]
        more = {}
        if recommend:
            more["recommend"] = recommendations
        if similar:
            more["similarItems"] = similar_items
        if clusters:
            more |= {"userClusters": publish_clusters("user", "x", "item_tags"), "itemClusters": publish_clusters("item", "y", "user_tags")}
        if s.merge_instance:
            more["mergeModel"] = lambda: self.merge_model(out["model"], s.merge_instance)
        steps |= more
        after += [(name, "factors") for name in more] + [("finish", name) for name in steps]
        if "mergeModel" in more:  # it replaces tags that others read
            after += [("mergeModel", name) for name in more if name != "mergeModel"]
        steps["finish"] = lambda: self.finish(out["model"])
        schedule.Job(steps, after, changed=self.note, stop=stop).run()
        return out["model"]

    def note(self, status: dict[str, schedule.Status]) -> None:
        with self.noting:
            self.store.write(status_path(self.at, self.number), schedule.status_json(status).encode())

    def fit(self, prefs: DataFrame, cluster_tags: tuple[DataFrame, DataFrame] | None = None) -> als.Model:
        """Factors, going on after the last iteration whose steps are complete; those of two before are removed on the way.

        With tags to leave out (of users, of items), clusters are followed on the way: seeds in the second iteration, one adjustment in each one after it."""
        at = self.path(layout.ITERATIONS)
        whole = lambda n: all(self.store.exists(f"{at}/{side}-{n}/{layout.SUCCESS}") for side in "xys")
        there = {int(name.split("-")[1]) for name in self.store.list(at) if name.startswith("s-")}
        done = max([n for n in there if whole(n) and (n == 1 or whole(n - 1))], default=0)

        def follow(n: int, x: DataFrame, y: DataFrame) -> None:
            if cluster_tags is None or n < 2:
                return
            for kind, m, k, tags in (("user", x, self.settings.user_clusters, cluster_tags[0]), ("item", y, self.settings.item_clusters, cluster_tags[1])):
                make = (lambda m=m, k=k, t=tags: cluster.seeds(m, k, t)) if kind not in self.centroids else (lambda m=m, t=tags, c=self.centroids[kind]: cluster.adjust(m, c, t).select("cluster", "centroid"))
                self.centroids[kind] = self.kept(f"{layout.ITERATIONS}/{kind}-{n}", make)

        model = als.fit(
            prefs,
            self.settings,
            self.previous_y(),
            keep=lambda df, name: self.kept(f"{layout.ITERATIONS}/{name}", lambda: df),
            done=done,
            drop=lambda name: self.store.delete(f"{at}/{name}", recursive=True),
            each=follow,
        )
        if cluster_tags is not None and not self.centroids:  # a run of one iteration
            follow(2, model.x, model.y)
        return model

    def merge_model(self, model: als.Model, other: str) -> None:
        """mergedY from this instance's Y and the newest complete model of another one; its user tags replace ours."""
        there = Layout(self.at.root, other)
        newest = latest_complete(self.store, there)
        if newest is None:
            raise ValueError(f"instance {other} has no complete generation")
        x, y = (events.parse_factors(self.spark.read.text(there.generation(newest, part))) for part in (layout.X, layout.Y))
        matrix = self.kept("tmp/YTX", lambda: chain.ytx(model.y, x))
        self.once(layout.MERGED_Y, lambda p: write_text(factor_lines(chain.merged_y(matrix, y)), p, "id", "line"))
        if self.store.exists(there.generation(newest, layout.Y_TAGS)):
            self.store.delete(self.path(layout.Y_TAGS), recursive=True)
            self.store.copy(there.generation(newest, layout.Y_TAGS), self.path(layout.Y_TAGS))

    def finish(self, model: als.Model) -> None:
        """Takes back what a model without full rank would publish, drops temporary files and marks the generation as done."""
        if not all(full_rank(gramian(m, "features", self.settings.features)) for m in (model.x, model.y)):
            for part in (layout.X, layout.Y, layout.RECS, layout.SIMILAR, Layout.clusters("user"), Layout.clusters("item")):
                self.store.delete(self.path(part), recursive=True)
        self.store.touch(self.path(layout.SUCCESS))
        if not self.settings.debug:
            self.store.delete(self.path(layout.TMP), recursive=True)


def generations(store: Store, at: Layout) -> list[int]:
    return [int(n) for n in store.list(at.home, files=False) if n.isdigit()]


def latest_complete(store: Store, at: Layout, with_model: bool = False) -> int | None:
    """The newest generation with ``_SUCCESS`` (and, on request, with X and Y)."""
    for n in reversed(generations(store, at)):
        parts = [layout.SUCCESS, *([layout.X, layout.Y] if with_model else [])]
        if all(store.exists(at.generation(n, p)) for p in parts):
            return n
    return None


def status_path(at: Layout, number: int) -> str:
    return f"{at.home}/{layout.SYS}/status-{number:010d}.json"


def control_path(at: Layout, what: str) -> str:
    """The file that asks a runner of the instance to ``force`` the next run or to ``interrupt`` the one under way."""
    return f"{at.home}/{layout.SYS}/{what}"


@contextmanager
def alone(store: Store, at: Layout, poll: float = 60, stale: float = 900) -> Iterator[Callable[[], bool]]:
    """Holds the instance's lock: waits while another process runs it. Gives a function that tells whether the lock is still ours.

    The lock holds its owner's token and is renewed all the time; one that hasn't been for ``stale`` seconds is what a process that died has left. An owner
    that finds another's token has lost the lock and doesn't delete it."""
    lock, token = f"{at.home}/{layout.SYS}/running", uuid.uuid4().hex.encode()
    while not store.claim(lock):
        try:
            old = time.time() > store.last_modified(lock) + stale
        except Exception:  # it has just gone
            continue
        if old:
            store.delete(lock)
        else:
            time.sleep(poll)
    store.write(lock, token)
    ended = threading.Event()

    def mine() -> bool:
        return store.exists(lock) and store.read(lock) == token

    def renew() -> None:
        while not ended.wait(max(1.0, stale / 10)):
            if not mine():
                return
            store.write(lock, token)

    thread = threading.Thread(target=renew, daemon=True)
    thread.start()
    try:
        yield mine
    finally:
        ended.set()
        thread.join()
        if mine():
            store.delete(lock)


def run_next(spark: SparkSession, root: str, instance: str, settings: Settings | None = None, wait: float = schedule.BARRIER, **outputs: bool) -> schedule.Choice:
    """One turn of the batch layer: deletes old generations, opens the next, waits for uploads and runs the one that is due. One process at a time runs an instance; one that loses the lock stops at the next step."""
    store, at = Store(spark), Layout(root, instance)
    with alone(store, at) as mine:
        stop = lambda: not mine() or store.exists(control_path(at, "interrupt"))
        try:
            return _turn(spark, root, instance, settings or Settings(), wait, stop, **outputs)
        finally:
            store.delete(control_path(at, "interrupt"))


def _turn(spark: SparkSession, root: str, instance: str, settings: Settings, wait: float, stop: Callable[[], bool], **outputs: bool) -> schedule.Choice:
    store, at = Store(spark), Layout(root, instance)
    there = generations(store, at)
    choice = schedule.choose(there, [g for g in there if store.exists(at.generation(g, layout.SUCCESS))], settings.generations_to_keep)
    for g in choice.delete:
        store.delete(at.generation(g), recursive=True)
    if choice.make is not None:
        store.mkdir(at.generation(choice.make, layout.INBOUND))
    if choice.run is None:
        return choice
    inbound = at.generation(choice.run, layout.INBOUND)
    while True:
        files = {f"{inbound}/{f}": store.last_modified(f"{inbound}/{f}") for f in store.list(inbound)}
        state = schedule.barrier(store.last_modified(at.generation(choice.wait_for, layout.INBOUND)), files, time.time(), wait)
        for f in state.stale:
            store.delete(f)
        if state.ready:
            break
        if stop():
            raise schedule.Interrupted
        time.sleep(min(60, max(0.1, wait)))
    Generation(spark, root, instance, choice.run, choice.last_done, settings).run(stop=stop, **outputs)
    return choice
