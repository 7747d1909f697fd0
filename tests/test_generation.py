import dataclasses

import numpy as np
import pytest

from factorloom.config import Settings
from factorloom.plans import generation as g
from factorloom.plans import model
from factorloom.plans import schedule
from factorloom.sources.layout import Layout
from factorloom.sources.store import Store
from factorloom.sources.writer import EventWriter

from .overlap import overlap


def write(path, lines):
    path.mkdir(parents=True, exist_ok=True)
    (path / "a.csv").write_text("\n".join(lines) + "\n")


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("root")
    rng = np.random.default_rng(0)
    lines = [f"{u},{i},{1 + (u * i) % 3}" for u in range(1, 25) for i in range(100, 118) if rng.random() < 0.4]
    settings = Settings(features=3, max_iterations=2, user_clusters=2, item_clusters=2, recs_count=4, similar_count=3, convergence_modulus=2, bad_line_budget=2)
    for instance in ("a", "b"):
        assert g.run_next(spark, str(root), instance, settings, wait=0).make == 0
        write(root / instance / "0000000000" / "inbound", [*lines, '"teen",100,2', '3,"genre",1', "# c", "bad"])
        assert g.run_next(spark, str(root), instance, settings, wait=0, clusters=True).run == 0
    return root, settings


def test_published(spark, root):
    home = root[0] / "a" / "0000000000"
    for part in ("input", "X", "Y", "XTags", "YTags", "knownItems", "recommend", "similarItems", "userClusters", "itemClusters", "userCentroids", "itemCentroids"):
        assert (home / part / "_SUCCESS").exists(), part
    assert (home / "_SUCCESS").exists() and not (home / "tmp").exists()
    assert spark.read.text(str(home / "recommend")).first().value.split("\t")[1].startswith("[")


def test_second_generation_builds_on_the_first(spark, root):
    path, settings = root
    write(path / "a" / "0000000001" / "inbound", ["1,100,", "1,999,5", "50,101,2"])
    choice = g.run_next(spark, str(path), "a", settings, wait=0)
    assert (choice.run, choice.last_done) == (1, 0)
    now = {(r.user_id, r.item_id): r.value for r in spark.read.parquet(str(path / "a" / "0000000001" / "input")).collect()}
    assert (1, 100) not in now and now[1, 999] == 5 and now[50, 101] == 2 and len(now) > 100


def test_model_loads(spark, root):
    m = model.load(spark, str(root[0]), "b", 1, 2)
    whole = model.load(spark, str(root[0]), "b")
    assert m.generation == 0 and 0 < m.x.count() < whole.x.count() and m.y.count() == whole.y.count()
    assert whole.item_tags.count() == 1 and whole.user_tags.count() == 1 and m.known.count() == whole.known.count()
    found = model.load_clusters(spark, str(root[0]), "b", 0, "user").collect()
    assert 1 <= len(found) <= 2
    assert model.load(spark, str(root[0]), "nobody") is None


def test_two_runs_agree(spark, root):
    def recs(instance):
        lines = spark.read.text(str(root[0] / instance / "0000000000" / "similarItems")).collect()
        return {r.value.split("\t")[0]: [x.split(":")[0] for x in r.value.split("\t")[1][1:-1].split(",")] for r in lines}

    a, b = recs("a"), recs("b")
    assert set(a) == set(b) and np.mean([overlap(a[k], b[k]) for k in a]) > 0.87


def test_chained_model(spark, root):
    path, settings = root
    rng = np.random.default_rng(4)
    write(path / "c" / "0000000000" / "inbound", [f"{u},{i},{1 + i % 4}" for u in range(100, 118) for i in range(9) if rng.random() < 0.5])
    chained = dataclasses.replace(settings, merge_instance="b", similar_format="json")
    g.Generation(spark, str(path), "c", 0, None, chained).run(recommend=False, similar=True)
    assert (path / "c" / "0000000000" / "mergedY" / "_SUCCESS").exists()
    assert spark.read.text(str(path / "c" / "0000000000" / "similarItems")).first().value.split("\t")[1].startswith("[[")


def test_resume_keeps_finished_steps(spark, root, tmp_path):
    at = Layout(str(tmp_path), "r")
    write(tmp_path / "r" / "0000000000" / "inbound", [f"{u},{i}" for u in range(9) for i in range(8) if (u * i) % 3])
    run = g.Generation(spark, str(tmp_path), "r", 0, None, Settings(features=2, max_iterations=2, debug=True))
    calls = []
    one = run.kept("tmp/x", lambda: calls.append(1) or spark.range(3))
    two = run.kept("tmp/x", lambda: calls.append(1) or spark.range(4))
    assert calls == [1] and one.count() == two.count() == 3
    Store(spark).delete(at.generation(0, "tmp/x/_SUCCESS"))
    assert run.kept("tmp/x", lambda: calls.append(1) or spark.range(4)).count() == 4
    run.run(recommend=False, similar=False)
    assert (tmp_path / "r" / "0000000000" / "tmp").exists()


def test_too_many_bad_lines_stop_the_run(spark, tmp_path):
    write(tmp_path / "z" / "0000000000" / "inbound", ["x"] * 3)
    with pytest.raises(ValueError, match="can't be read"):
        g.Generation(spark, str(tmp_path), "z", 0, None, Settings(bad_line_budget=2)).run()


def test_store(spark, tmp_path):
    s = Store(spark)
    base = str(tmp_path / "s")
    s.mkdir(f"{base}/sys")
    s.touch(f"{base}/a")
    (tmp_path / "up").write_text("hi\n")
    s.upload(str(tmp_path / "up"), f"{base}/b")
    assert s.list(base) == ["a", "b"] and s.size(f"{base}/b") == 3 and s.size(f"{base}/none") == 0 and s.exists(f"{base}/a")
    s.copy(f"{base}/b", f"{base}/c")
    s.move(f"{base}/c", f"{base}/d")
    s.download(f"{base}/d", str(tmp_path / "down"))
    assert (tmp_path / "down").read_text() == "hi\n" and list(s.lines(f"{base}/d")) == ["hi"] and s.last_modified(base) > 0
    s.delete(base, recursive=True)
    assert not s.exists(base)


def test_factors_are_resumed(spark, tmp_path):
    rng = np.random.default_rng(1)
    prefs = spark.createDataFrame([(u, i, 1.0 + (u * i) % 3) for u in range(20) for i in range(15) if rng.random() < 0.5], "user_id bigint, item_id bigint, value double")
    at = tmp_path / "q" / "0000000000" / "tmp" / "iterations"

    def fit(most):
        return g.Generation(spark, str(tmp_path), "q", 0, None, Settings(features=2, max_iterations=most, convergence_modulus=2, convergence_threshold=1e-9)).fit(prefs)

    first = fit(3)
    assert first.iterations == 3 and not (at / "x-1").exists() and (at / "x-2" / "_SUCCESS").exists()
    stamp = (at / "x-3" / "_SUCCESS").stat().st_mtime_ns
    again = fit(3)
    assert again.iterations == 3 and again.changes[-1] == first.changes[-1] and (at / "x-3" / "_SUCCESS").stat().st_mtime_ns == stamp
    assert fit(5).iterations == 5 and (at / "y-5" / "_SUCCESS").exists()


def test_writer(spark, tmp_path):
    w = None
    with pytest.raises(ValueError):
        w = EventWriter(spark, str(tmp_path), "w")
    g.run_next(spark, str(tmp_path), "w", wait=0)
    w = EventWriter(spark, str(tmp_path), "w", writes_between_upload=3)
    assert w.roll() is None
    w.append(1, 10, 2.5)
    w.append("teen", 10)
    w.remove(1, 10)  # the third: written
    assert w.count == 0 and not list(w.spool.iterdir())
    for bad in (lambda: w.append("a", "b"), lambda: w.append('a"', 1), lambda: w.append(1, "x,y"), lambda: w.append(1, 1, float("nan"))):
        with pytest.raises(ValueError):
            bad()
    w.append(2, 11)
    (tmp_path / "w" / "0000000001" / "inbound").mkdir(parents=True)
    w.check()
    lines = [r.value for r in spark.read.text(str(tmp_path / "w" / "0000000000" / "inbound")).collect()]
    assert sorted(lines) == ['"teen",10,1.0', "1,10,", "1,10,2.5", "2,11,1.0"] and w.generation == 1
    w.append(5, 5)
    left = next(w.spool.iterdir())
    left.write_text(left.read_text() + "6,")  # the process ends here
    again = EventWriter(spark, str(tmp_path), "w", spool=str(w.spool))
    lines = [r.value for r in spark.read.text(str(tmp_path / "w" / "0000000001" / "inbound")).collect()]
    assert lines == ["5,5,1.0"] and not list(w.spool.iterdir()) and again.limit == 10_000
    again.append(7, 7)
    again.close()
    assert len(list((tmp_path / "w" / "0000000001" / "inbound").glob("*.gz"))) == 2


def test_one_process_at_a_time(spark, tmp_path):
    store, at = Store(spark), Layout(str(tmp_path), "l")
    with g.alone(store, at):
        assert not store.claim(f"{at.home}/sys/running")
        with g.alone(store, at, poll=0, stale=-1):  # a lock as old as this one is taken over
            pass
    assert store.claim(f"{at.home}/sys/running")


def test_lost_lock_is_not_deleted(spark, tmp_path):
    store, at = Store(spark), Layout(str(tmp_path), "k")
    with g.alone(store, at) as mine:
        assert mine()
        store.write(f"{at.home}/sys/running", b"another")
        assert not mine()
    assert store.read(f"{at.home}/sys/running") == b"another"


def test_states_and_interruption(spark, root, tmp_path):
    from factorloom.plans import cli

    path, settings = root
    state = g.Store(spark).read(g.status_path(Layout(str(path), "a"), 0)).decode()
    assert '"status": "COMPLETED"' in state and '"userClusters": "COMPLETED"' in state
    write(tmp_path / "i" / "0000000000" / "inbound", ["1,2", "2,1"])
    at = Layout(str(tmp_path), "i")
    assert cli.control(spark, cli.arguments([str(tmp_path), "i", "--interrupt"]))
    with pytest.raises(schedule.Interrupted):
        g.run_next(spark, str(tmp_path), "i", settings, wait=0)
    store = Store(spark)
    assert not store.exists(g.control_path(at, "interrupt")) and not store.exists(f"{at.home}/sys/running")
    assert cli.control(spark, cli.arguments([str(tmp_path), "i", "--force", "--status"])) and store.exists(g.control_path(at, "force"))
    assert not cli.control(spark, cli.arguments([str(tmp_path), "i"]))


def test_lost_input_is_an_error(spark, tmp_path):
    write(tmp_path / "m" / "0000000001" / "inbound", ["1,2"])
    with pytest.raises(ValueError, match="has no input"):
        g.Generation(spark, str(tmp_path), "m", 1, 0, Settings()).run()


def test_refresher(spark, root):
    seen = []
    r = model.Refresher(spark, str(root[0]), "b", taken=lambda new, old: seen.append((new.generation, old)))
    assert r.refresh() and not r.refresh() and seen == [(0, None)]
    with r._busy:
        assert not r.refresh()
    current = spark.createDataFrame([(1,), (2,), (999_999,)], "id bigint")
    assert sorted(x.id for x in r.kept(current, "x", current.where("id < 0")).collect()) == [1, 2]
    r.settings = Settings(remove_not_updated=False)
    assert r.kept(current, "x", current.where("id < 0")).count() == 3
    r.start(every=0.05)
    r.stop()


def test_clusters_follow_the_iterations(spark, tmp_path):
    rng = np.random.default_rng(1)
    prefs = spark.createDataFrame([(u, i, 1.0 + (u * i) % 3) for u in range(20) for i in range(15) if rng.random() < 0.5], "user_id bigint, item_id bigint, value double")
    run = g.Generation(spark, str(tmp_path), "f", 0, None, Settings(features=2, max_iterations=4, convergence_modulus=2, convergence_threshold=1e-9, user_clusters=2, item_clusters=2))
    none = spark.createDataFrame([], "id bigint")
    assert run.fit(prefs, (none, none)).iterations == 4
    at = tmp_path / "f" / "0000000000" / "tmp" / "iterations"
    assert sorted(p.name for p in at.glob("user-*")) == ["user-2", "user-3", "user-4"] and 1 <= run.centroids["item"].count() <= 2
