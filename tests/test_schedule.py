import pytest

from factorloom.config import Settings, from_properties
from factorloom.plans import schedule as s
from factorloom.plans.cli import arguments

from .overlap import overlap


@pytest.mark.parametrize(
    "there,done,want",
    [
        ([], [], s.Choice(make=0)),
        ([0], [], s.Choice(make=1, run=0, wait_for=1)),
        ([0, 1], [], s.Choice(run=0, wait_for=1)),
        ([0], [0], s.Choice(make=1, last_done=0)),
        ([0, 1], [0], s.Choice(make=2, run=1, wait_for=2, last_done=0)),
        ([0, 1, 2], [0], s.Choice(run=1, wait_for=2, last_done=0)),
        ([3, 4, 5, 6], [4], s.Choice(run=5, wait_for=6, last_done=4, delete=(3,))),
    ],
)
def test_choice(there, done, want):
    assert s.choose(there, done, 3) == want


def test_barrier():
    assert s.barrier(0, {}, 241).ready and not s.barrier(0, {}, 239).ready
    assert not s.barrier(0, {"a.inprogress": 200}, 241).ready
    old = s.barrier(0, {"a.inprogress": 0, "b_COPYING_": 1}, 1201)
    assert old.ready and old.stale == ("a.inprogress", "b_COPYING_")


def test_due():
    c = s.clock(0, every_min=10, data_mb=5)
    now, c = s.due(c, 1, 0, any_generation=False)
    assert now
    assert not s.due(c, 2, 4_999_999, True)[0]
    now, c = s.due(c, 2, 5_000_000, True)
    assert now and c.due_at == 602
    assert not s.due(c, 600, 0, True)[0]
    now, c = s.due(c, 610, 0, True)
    assert now and c.due_at == 602 + 600
    c = s.caught_up(c, 5000)
    now, c = s.due(c, 5000, 0, True)
    assert now
    assert s.due(c, 5001, 0, True, forced=True)[0] and not s.due(c, 5002, 0, True)[0]


def test_waves():
    assert s.waves("abcd", [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c")]) == [["a"], ["b", "c"], ["d"]]
    with pytest.raises(ValueError):
        s.waves("ab", [("a", "b"), ("b", "a")])


def test_job():
    seen = []
    job = s.Job({"a": lambda: seen.append("a"), "b": lambda: seen.append("b")}, [("b", "a")])
    assert job.run() is s.Status.COMPLETED and seen == ["a", "b"]

    def fail():
        raise RuntimeError("no")

    bad = s.Job({"a": fail, "b": lambda: None}, [("b", "a")])
    with pytest.raises(RuntimeError):
        bad.run()
    assert bad.status == {"a": s.Status.FAILED, "b": s.Status.CANCELLED}
    told = []
    stopped = s.Job({"a": lambda: None, "b": lambda: None}, [("b", "a")], changed=told.append, stop=lambda: len(told) > 0)
    with pytest.raises(s.Interrupted):
        stopped.run()
    assert stopped.status == {"a": s.Status.COMPLETED, "b": s.Status.CANCELLED} and told[-1] == stopped.status
    assert s.status_json(told[-1]) == '{"status": "CANCELLED", "steps": {"a": "COMPLETED", "b": "CANCELLED"}}'


def test_roll_up():
    p, r, f, c, d = s.Status.PENDING, s.Status.RUNNING, s.Status.FAILED, s.Status.CANCELLED, s.Status.COMPLETED
    assert [s.roll_up(x) for x in ([], [p, d], [r, c], [c, f], [d, d], [p])] == [p, r, c, f, d, p]


def test_units_and_settings():
    assert [s.minutes(x) for x in ("90", "90m", "2h", "1d")] == [90, 90, 120, 1440]
    assert [s.megabytes(x) for x in ("5", "5m", "2g", "1t")] == [5, 5, 2000, 1_000_000]
    a = arguments(["/r", "i", "--time", "1h,2h", "-D", "model.features=7", "-D", "model.als.iterate=false", "-D", "output.x=1", "-D", "other=2"])
    assert (a.first_min, a.every_min, a.settings.features, a.settings.iterate, a.settings.extra) == (60, 120, 7, False, {"output.x": "1"})
    assert from_properties({}).effective_lambda == pytest.approx(0.1)
    for bad in (dict(features=0), dict(convergence_threshold=1.0), dict(zero_threshold=-1.0), dict(generations_to_keep=1), dict(recs_sink_format="csv")):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_overlap():
    assert overlap([1, 2, 3], [1, 2, 3]) == 1 and overlap([1, 2], [3, 4]) == 0 and 0.8 < overlap([1, 2, 3], [2, 1, 3]) < 1
