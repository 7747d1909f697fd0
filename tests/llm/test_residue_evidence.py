import time

import pytest

from factorloom.llm import residue as r

DOCS = "doc_id bigint, question_id bigint, title string, text string, source string, tags array<string>"


def table(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def questions(n):
    return [(1000 + i, None, f"Sorting a list of {w}", "I want to sort a list. How?", "h0", ["lists"]) for i, w in enumerate(["apples", "pears", "plums", "figs", "nuts", "dates"][:n])]


def test_wording_alone_is_not_enough(spark, monkeypatch):
    rows = [(1, 1000, None, "Access denied. You do not have permission to view this page.", "a", None), (2, 2000, None, "Access denied. You do not have permission to view this page.", "a", None)]
    rows += [*questions(1), (2000, None, "Permission denied for page view", "How do I get the permission?", "a", ["access"])]
    assert [x.doc_id for x in r.residue(table(spark, rows)).collect()] == [1]  # the second is about what its question asks
    why = {x.doc_id: x for x in r.evidence(table(spark, rows)).collect()}
    assert why[1].apart and not why[2].apart and why[2].score == 3
    monkeypatch.setattr(r, "NEEDED", 5)  # with two more parts asked for, one host isn't enough
    assert r.residue(table(spark, rows)).count() == 0


def test_copies_on_hosts_outweigh_a_title(spark):
    page = "Error 503. Service Unavailable. Reference {}."
    rows = [(i, 2000, None, page.format(i * 7919), f"h{i}", None) for i in range(3)] + [(2000, None, "Service unavailable, error 503", "How do I avoid it?", "h0", None)]
    assert sorted(x.doc_id for x in r.residue(table(spark, rows)).collect()) == [0, 1, 2]
    assert r.residue(table(spark, [(i, q, t, x, "h0", g) for i, q, t, x, _, g in rows])).count() == 0


def test_wording_learned_from_the_corpus(spark):
    known = [(i, 1000 + i % 3, None, f"Access denied. Gatekeeper zorblax refused quuxing at {i}.", f"h{i % 3}", None) for i in range(6)]
    unknown = [(100 + i, 1003 + i % 3, None, "Gatekeeper zorblax: refused, quuxing.", f"h{i % 3}", None) for i in range(4)]
    other = [(200 + i, 1000 + i % 3, None, "Sorted it by length, thanks.", f"h{i % 3}", None) for i in range(5)]
    rows = known + unknown + other + questions(6)
    assert sorted(x.doc_id for x in r.residue(table(spark, rows)).collect()) == [*range(6), *range(100, 104)]
    assert r.residue(table(spark, unknown + other + questions(6))).count() == 0


def test_slots_need_no_other_evidence(spark):
    assert [x.doc_id for x in r.residue(table(spark, [(5, None, None, "Hello {{name}}, thanks.", None, None)])).collect()] == [5]


@pytest.mark.parametrize("text", ["a" * 300_000, "error" * 60_000, "word error page " * 20_000, "(" * 100_000, "how do I? " * 30_000, "http://" + "x" * 200_000])
def test_long_texts_take_linear_time(text):
    began = time.process_time()
    r.judge(text)
    assert time.process_time() - began < 10
