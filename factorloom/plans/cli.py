"""``python -m factorloom.plans.cli ROOT INSTANCE``: runs generations when they are due."""

from __future__ import annotations

import argparse
import logging
import time

from pyspark.sql import SparkSession

from ..config import from_properties
from ..session import forget, session
from ..sources import layout
from ..sources.layout import Layout
from ..sources.store import Store
from . import generation, schedule

log = logging.getLogger(__name__)


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="factorloom")
    p.add_argument("root", help="folder or bucket of all instances")
    p.add_argument("instance")
    p.add_argument("--data", default="1000", type=schedule.megabytes, help="new data that triggers a generation: megabytes, or with m, g or t")
    p.add_argument("--time", default="1440", help="time that triggers one: minutes, or with m, h or d; FIRST,NEXT for another first delay")
    p.add_argument("--recommend", action="store_true")
    p.add_argument("--item-similarity", action="store_true")
    p.add_argument("--cluster", action="store_true")
    p.add_argument("--force-run", action="store_true")
    p.add_argument("--status", action="store_true", help="print the states of the steps of the newest run and end")
    p.add_argument("--force", action="store_true", help="ask a runner elsewhere to run a generation now, and end")
    p.add_argument("--interrupt", action="store_true", help="ask a runner elsewhere to end its run, and end")
    p.add_argument("--once", action="store_true", help="run one generation that is due and end")
    p.add_argument("-D", action="append", default=[], metavar="KEY=VALUE", help="a model, output or batch property")
    a = p.parse_args(argv)
    first, _, following = a.time.partition(",")
    a.first_min, a.every_min = schedule.minutes(first), schedule.minutes(following or first)
    a.settings = from_properties(dict(x.split("=", 1) for x in a.D))
    return a


def control(spark: SparkSession, a: argparse.Namespace) -> bool:
    """Does what is asked of a runner elsewhere: prints the states of the steps of the newest run, or leaves the file that forces or interrupts one."""
    store, at = Store(spark), Layout(a.root, a.instance)
    if a.status:
        there = [n for n in generation.generations(store, at) if store.exists(generation.status_path(at, n))]
        print(store.read(generation.status_path(at, there[-1])).decode() if there else schedule.status_json({}))
    for what in ("force", "interrupt"):
        if getattr(a, what):
            store.write(generation.control_path(at, what), b"")
    return bool(a.status or a.force or a.interrupt)


def main(argv: list[str] | None = None) -> None:
    a = arguments(argv)
    at = Layout(a.root, a.instance)
    spark = session(**{"spark.checkpoint.dir": f"{at.home}/{layout.SYS}/work"})
    if control(spark, a):
        return
    store = Store(spark)
    clock = schedule.clock(time.time(), a.every_min, a.data, a.first_min)
    outputs = {"recommend": a.recommend, "similar": a.item_similarity, "clusters": a.cluster}
    forced = a.force_run
    while True:
        try:
            there = generation.generations(store, at)
            size = store.size(at.generation(there[-1], layout.INBOUND)) if there else 0
            asked = store.exists(generation.control_path(at, "force"))
            now, clock = schedule.due(clock, time.time(), size, bool(there), forced or asked)
            if now:
                forced = False
                store.delete(generation.control_path(at, "force"))
                choice = generation.run_next(spark, a.root, a.instance, a.settings, **outputs)
                clock = schedule.caught_up(clock, time.time())
                forget(spark)
                if a.once and choice.run is not None:
                    return
        except Exception:  # the next turn takes the generation up again
            log.exception("the run failed")
            if a.once:
                raise
        time.sleep(0 if a.once else 60)


if __name__ == "__main__":
    main()
