import pytest

from factorloom.operators.merge import merge_old_new, merge_tags

CASES = [  # old, new (None: delete), decay, threshold, result
    (2.0, [3.0], 1, 0, 5.0),
    (2.0, [], 0.5, 0, 1.0),
    (None, [1.0, 2.0], 1, 0, 3.0),
    (2.0, [None], 1, 0, None),
    (2.0, [None, 3.0], 1, 0, None),
    (None, [None, 3.0], 1, 0, 3.0),
    (None, [None], 1, 0, None),
    (2.0, [-2.0], 1, 0, None),
    (0.2, [], 0.5, 0.1, None),
    (None, [0.1], 1, 0.1, None),
]


@pytest.mark.parametrize("old,new,decay,threshold,want", CASES)
def test_cases(spark, old, new, decay, threshold, want):
    o = spark.createDataFrame([(1, 2, old)] if old is not None else [], "user_id bigint, item_id bigint, value double")
    n = spark.createDataFrame([(1, 2, v, v is None) for v in new], "user_id bigint, item_id bigint, pref_value double, is_delete boolean")
    got = [r.value for r in merge_old_new(o, n, decay, threshold).collect()]
    assert got == ([] if want is None else [want])


def test_empty_batch_changes_nothing(spark):
    o = spark.createDataFrame([(1, 2, 3.0), (-1, 0, 4.0)], "user_id bigint, item_id bigint, value double")
    n = spark.createDataFrame([], "user_id bigint, item_id bigint, pref_value double, is_delete boolean")
    assert sorted(map(tuple, merge_old_new(o, n).collect())) == [(-1, 0, 4.0), (1, 2, 3.0)]


def test_null_ids_and_first_generation(spark):
    n = spark.createDataFrame([(None, 2, 1.0, False), (1, None, 1.0, None), (1, 2, 1.0, None)], "user_id bigint, item_id bigint, pref_value double, is_delete boolean")
    assert [tuple(r) for r in merge_old_new(None, n).collect()] == [(1, 2, 1.0)]


def test_tags(spark):
    a, b = (spark.createDataFrame([(x,) for x in t], "id bigint") for t in ([1, 2, None], [2, 3]))
    assert sorted(r.id for r in merge_tags(a, b).collect()) == [1, 2, 3]
    with pytest.raises(ValueError):
        merge_old_new(None, a, zero_threshold=-1)
