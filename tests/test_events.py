import hashlib

import pytest

from factorloom.sources import events


def tag(s: str) -> int:
    return int.from_bytes(hashlib.md5(s.encode()).digest()[:8], "big", signed=True)


CASES = [
    ("1,10,2.5", (1, 10, 2.5, False, False, False, False)),
    ("1,10", (1, 10, 1.0, False, False, False, False)),
    ("1,10,", (1, 10, None, True, False, False, False)),
    (" 1 , 10 , 3 ,ignored", (1, 10, 3.0, False, False, False, False)),
    ('"teen",10,1.0', (tag("teen"), 10, 1.0, False, True, False, False)),
    ('1,"scifi",1.0', (1, tag("scifi"), 1.0, False, False, True, False)),
    ('"teen",10,', (tag("teen"), 10, None, True, True, False, False)),
    ('"a","b",1', None),
    ("x,10,1", None),
    ("1", None),
    ("1,10,zz", None),
    ("1,10,NaN", None),
    ("1,10,1e39", None),
    (" # note", None),
    ('"a,b",10,1', None),
    ('",10,1', None),
    ("9223372036854775807,-9223372036854775808,0", (2**63 - 1, -(2**63), 0.0, False, False, False, False)),
    ("9223372036854775808,1", None),
]


def test_lines(spark):
    df = spark.createDataFrame([(i, c[0], 7) for i, c in enumerate(CASES)] + [(98, "# note", 7), (99, "", 7), (100, None, 7)], "n int, value string, user_id_of_line int")
    got = {r.n: r for r in events.parse_lines(df).collect()}
    assert set(got) == set(range(len(CASES)))
    for i, (line, want) in enumerate(CASES):
        r = got[i]
        assert r.is_bad == (want is None), line
        if want:
            assert (r.user_id, r.item_id, r.pref_value, r.is_delete, r.user_is_tag, r.item_is_tag, r.is_bad) == want, line


def test_budget(spark):
    p = events.parse_lines(spark.createDataFrame([("x",), ("1,2",)], "value string"))
    assert events.check_budget(p, 1) == 1
    with pytest.raises(ValueError):
        events.check_budget(p, 0)


def test_tags_count_for_deletes(spark):
    p = events.parse_lines(spark.createDataFrame([('"t",1,',), ('2,"g",1',)], "value string"))
    assert {(r.kind, r.id) for r in events.tags(p).collect()} == {("item", tag("t")), ("user", tag("g"))}


def test_factor_lines(spark):
    df = spark.createDataFrame([("-5\t1.5,-2.0E-5",)], "value string")
    assert [(r.id, r.features) for r in events.parse_factors(df).collect()] == [(-5, [1.5, pytest.approx(-2e-5)])]
    with pytest.raises(Exception, match="not a factor line"):
        events.parse_factors(spark.createDataFrame([("5 1.5",)], "value string")).collect()


def test_missing_tags_are_none(spark, tmp_path):
    assert events.read_tag_ids(spark, f"file://{tmp_path}/none").count() == 0
