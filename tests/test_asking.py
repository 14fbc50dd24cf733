"""Paced questions with a clock of the test's own, and replies read tolerantly."""

from __future__ import annotations

import pytest

from quillspark.operators import asking, dataset
from quillspark.operators.asking import Pace, Refused, _Caller


def clockwork():
    """A clock that only sleeping moves, and what was slept."""
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    return now, slept, lambda: ((lambda: now[0]), sleep)


def test_waits_of_a_task():
    now, slept, timer = clockwork()
    script = {b"a": ["{}"], b"b": [TimeoutError("1"), TimeoutError("2"), "talk", "{}"], b"c": [Refused("no")], b"d": [TimeoutError("x")] * 9}
    calls = []

    def ask(image, n):
        calls.append((image, n, now[0]))
        now[0] += 0.5
        got = script[image][n]
        if isinstance(got, Exception):
            raise got
        return got

    caller = _Caller(ask, lambda raw: "{" in raw, 5, Pace(1.5, (5.0, 15.0), timer))
    assert caller.page(b"a", 0) == ("{}", None, 1, True, 0.0)
    assert caller.page(b"b", 0) == ("{}", None, 4, True, 20.0)
    assert caller.page(b"c", 0) == ("", "no", 1, False, 0.0)
    assert caller.page(b"d", 3) == ("", "x", 5, False, 5.0)
    assert [n for image, n, _ in calls if image == b"d"] == [3, 4]
    starts = [at for *_, at in calls]
    assert min(b - a for a, b in zip(starts, starts[1:], strict=False)) == 2.0  # half a second of work and the delay
    assert slept == [1.5, 5.0, 15.0, 1.5, 1.5, 1.5, 5.0]


def test_a_page_is_taken_up_where_it_was_left(spark):
    images = spark.createDataFrame([(i, bytearray(b"x")) for i in range(4)], "id long, content binary")
    answers = spark.createDataFrame([(0, True, 1), (1, False, 2), (2, False, 3), (2, False, 1)], "id long, answered boolean, tries int")
    left = asking.unfinished(images, answers, ["id"], 3)
    assert sorted((r["id"], r["tries"]) for r in left.collect()) == [(1, 2), (3, None)]
    got = asking.asked(left, lambda image, n: f"try {n}", lambda raw: raw == "try 2", tries=3)
    assert sorted((r["id"], r["raw"], r["tries"], r["answered"]) for r in got.collect()) == [(1, "try 2", 3, True), (3, "try 2", 3, True)]
    assert asking.asked(images.where("false"), lambda image, n: "", bool).count() == 0


@pytest.mark.parametrize(
    ("reply", "rows"),
    [
        ('```json\n{"rows": [{"a": 1, "b": null, "c": "x"}]}\n```', [{"a": "1", "b": "", "c": "x"}]),
        ('so {"a": "1"} and {"b": 2}', [{"a": "1"}]),
        ('{"a": "}"}', None),
        ('{"rows": null}', []),
        ('{"rows": ["x", {"a": true}]}', [None, {"a": "True"}]),
        ('{"rows": {"a": 1}}', []),
        ("}{", None),
        ("", None),
        (None, None),
    ],
)
def test_replies(spark, reply, rows):
    df = dataset.with_replies(spark.createDataFrame([("b", reply, '{"rows": [{"a": "1"}]}')], "book_id string, reply string, target string"))
    r = df.first()
    assert r["got"] == rows and r["truth"] == [{"a": "1"}]
