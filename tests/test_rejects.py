import csv
import hashlib
import random

import pytest

from factorloom.operators import rejects

CASES = [
    ("1,2,3", None), ("1,2", None), ("1,2,", None), ("1,2,,note", None), ('"a",2,1.5', None), ('1,"b b",.5', None), ("+1,-2,1.", None), (" 1\t,2 , 1e3 \r", None),
    ("1,2,3,4,5", "column_count"), ("1", "column_count"), (" # x", "column_count"), ("   ", "column_count"),
    ('"a,2,3', "quoting"), ('a",2,3', "quoting"), ('"",2,3', "quoting"), ('",2,3', "quoting"), ('"a"b",2,3', "quoting"), ('1,""x"",3', "quoting"), ('"a,b",1,1', "quoting"),
    ('"a","b",x', "both_tags"),
    (",2,3", "user_id"), ("x,y,z", "user_id"), ("1_0,2", "user_id"), ("٣,2", "user_id"), ("9223372036854775808,1", "user_id"), ("1.0,2", "user_id"), (" 1,2", "user_id"), ("0x1,2", "user_id"), ("1\r2,3", "user_id"), ("1\n2,3", "user_id"), ("1,2\n", "item_id"), ("1,2,3\n", "value"), ("1,2,\n", "value"), ("\r", "column_count"), ("\n", "column_count"), ("1,2\r\r", None), ("1\x00,2", "user_id"), ("1,2\r \t", None),
    ('"a",y', "item_id"), ("-9223372036854775808,--2", "item_id"), ("1," + "9" * 6000, "item_id"), ("1," + "0" * 6000 + "7", None),
    ("1,2,inf", "value"), ("1,2,NaN", "value"), ("1,2,1e39", "value"), ("1,2,.", "value"), ("1,2,1e", "value"), ("1,2,0x1p3", "value"), ('1,2,"3"', "value"), ("1,2,2.5f", "value"), ("1,2,3.4028235e38", None), ("1,2,1e-999", None), ("1,2,1e99999", "value"),
]


def test_reasons(spark):
    df = spark.createDataFrame([(i, c[0], "extra", 5) for i, c in enumerate(CASES)] + [(900, None, "", 1), (901, "", "", 1), (902, "#1,2", "", 1)], "line_id bigint, raw string, reason string, key int")
    got = {r.line_id: r for r in rejects.read_lines(df, "line_id", "raw").collect()}
    assert {i: got[i].reason for i in got} == {i: c[1] for i, c in enumerate(CASES)}
    assert (got[2].value, got[2].is_delete, got[1].value, got[4].user_tag, got[5].item_tag, got[0].user_id) == (None, True, 1.0, "a", "b b", 1)
    assert all(got[i].user_id is None and got[i].value is None for i, c in enumerate(CASES) if c[1])


def test_empty(spark):
    assert rejects.read_lines(spark.createDataFrame([], "a int, b string"), "a", "b").collect() == []


def joined(lines):
    out, held, start = [], [], 0
    for n, t in enumerate(lines):
        if not held:
            start = n
        held.append(t or "")
        if sum(x.count('"') for x in held) % 2 == 0:
            out.append((start, "\n".join(held)))
            held = []
    return out + ([(start, "\n".join(held))] if held else [])


@pytest.mark.parametrize("block", [1, 2, 3, 100])
def test_records_over_lines(spark, block):
    files = {"a": ['1,"x', "y", 'z",2', "plain", '"q"', '"open', "", None, 'end"'], "b": ["one", '"never closed', "two"], "c": []}
    df = spark.createDataFrame([(f, i, t) for f, ls in files.items() for i, t in enumerate(ls)], "file string, n bigint, text string")
    got = sorted((r.file, r.n, r.text) for r in rejects.assemble(df, "file", "n", "text", block).collect())
    assert got == sorted((f, n, t) for f, ls in files.items() for n, t in joined(ls))


def test_rejects_come_from_the_strict_reader(spark, monkeypatch):
    broken = [c[0] for c in CASES if c[1] == "quoting"]
    errors = 0
    for line in broken:
        try:
            rejects.strict(line)
        except rejects.csv.Error:
            errors += 1
    assert errors >= 4
    monkeypatch.setattr(rejects, "lone", lambda f: (f.strip('"'), f.startswith('"')))  # without its exceptions these lines would be loaded or fail later
    reasons = []
    for line in broken:
        try:
            reasons.append(rejects.record(line)[0])
        except rejects.Reject as e:
            reasons.append(str(e))
    assert "quoting" not in reasons


def test_records_by_the_strict_reader(spark):
    lines = [("a", 0, '1,"x'), ("a", 1, 'y",2'), ("a", 2, None), ("a", 3, '"q"z,1'), ("a", 4, "1,2,3"), ("a", 5, '"open'), ("a", 6, "end"), (None, 7, '"n,1"'), (None, 8, "")]
    df = spark.createDataFrame(lines, "file string, n bigint, text string")
    got = {(r.file, r.n): (r.n_lines, r.n_fields, r.error) for r in rejects.read_records(df, "file", "n", "text").collect()}
    assert got == {("a", 0): (2, 3, None), ("a", 3): (1, None, "',' expected after '\"'"), ("a", 4): (1, 3, None), ("a", 5): (2, None, "unexpected end of data"), (None, 7): (1, 1, None)}
    long = spark.createDataFrame([("a", i, '"' if i == 3 else "x,y") for i in range(50)], "file string, n bigint, text string")
    got = [(r.n, r.n_lines, r.error) for r in rejects.read_records(long, "file", "n", "text", most=20).where("error is not null").collect()]
    assert got == [(3, 47, "unexpected end of data")]
    assert rejects.read_records(df.limit(0), "file", "n", "text").count() == 0


def read(text):
    try:
        return len(next(csv.reader(text.splitlines(keepends=True) if "\r" not in text else [text], strict=True))), None
    except csv.Error as e:
        return None, str(e)


def test_records_of_any_length_are_whole(spark):
    files = {"closed": ['1,"x', *["y"] * 10_000, 'z",2'], "open": ["a,b", '"', *["y"] * 10_500]}
    df = spark.createDataFrame([(f, i, t) for f, ls in files.items() for i, t in enumerate(ls)], "file string, n bigint, text string")
    want = {(f, n): t for f, ls in files.items() for n, t in joined(ls)}
    assert {(r.file, r.n): r.text for r in rejects.assemble(df, "file", "n", "text").collect()} == want
    assert {(r.file, r.n): (r.n_lines, r.record) for r in rejects.digests(df, "file", "n", "text").collect()} == {k: (t.count("\n") + 1, hashlib.md5(t.encode()).hexdigest()) for k, t in want.items()}
    got = {(r.file, r.n): (r.n_fields, r.error) for r in rejects.read_records(df, "file", "n", "text").collect()}
    assert got == {("closed", 0): (3, None), ("open", 0): (2, None), ("open", 1): (None, "unexpected end of data")}


@pytest.mark.parametrize("most", [1, 3])
def test_long_records_are_read_as_whole_texts(spark, most):
    rng = random.Random(7)
    files = {f: ["".join(rng.choices(['"', ",", "a", "é", "\r", "\x0b", "\u2028"], [4, 3, 3, 1, f % 2 / 2, 0.2, 0.2], k=rng.randrange(6))) or None for _ in range(rng.randrange(12))] for f in range(800)}
    df = spark.createDataFrame([(f, i * 1500, t) for f, ls in files.items() for i, t in enumerate(ls)], "file int, n bigint, text string")  # three lines a block
    want = {(f, n * 1500): t for f, ls in files.items() for n, t in joined(ls)}
    assert {(r.file, r.n): r.text for r in rejects.assemble(df, "file", "n", "text", most=most).collect()} == want
    assert {(r.file, r.n): r.record for r in rejects.digests(df, "file", "n", "text", most=most).collect()} == {k: hashlib.md5(t.encode()).hexdigest() for k, t in want.items()}
    got = {(r.file, r.n): (r.n_fields, r.error) for r in rejects.read_records(df, "file", "n", "text", most=most).collect()}
    assert got == {k: read(t) for k, t in want.items() if t}
    assert len({e for _, e in got.values()}) == 4
