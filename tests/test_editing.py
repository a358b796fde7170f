import random
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.operators import editing as E


def test_inserts_and_effects(spark):
    units = spark.createDataFrame([(1, "a", 0, "A"), (1, "a|1", 1, "B"), (1, "a|1|x", 2, "C"), (1, "b", 3, "D")], "doc_id long, unit_id string, pos int, text string")
    new = spark.createDataFrame([(1, "a|1", 1, "n1", "N1"), (1, "a|1", 2, "n2", "N2"), (1, "zz", 1, "n3", "N3")], "doc_id long, anchor string, seq int, unit_id string, text string")
    assert [r.unit_id for r in E.insert_after(units, new).orderBy("pos").collect()] == ["a", "a|1", "n1", "n2", "a|1|x", "b"]
    d = spark.createDataFrame([("a|1", "exclude", None), ("b", "replace", "new D")], "unit_id string, action string, text string")
    got = {r.unit_id: r for r in E.apply_effects(units, d).collect()}
    assert set(got) == {"a", "b"} and got["b"].text == "new D" and got["b"].replaced_sha256 and got["a"].replaced_sha256 is None


def test_rebuilt_articles(spark):
    old = spark.createDataFrame([("A", 1), ("B", 2)], "article string, n int")
    assert {tuple(r) for r in E.merge_rebuilt(old, spark.createDataFrame([("B", 9)], "article string, n int")).collect()} == {("A", 1), ("B", 9)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), max_size=4, unique=True), max_size=5))
def test_paths_by_enumeration(places):
    n = sum(all(a < b for a, b in zip(c, c[1:], strict=False)) for c in product(*places)) if places else 1
    assert E.increasing_paths(places) == min(2, n)


def test_title_paths_and_matches(spark, tmp_path):
    t = spark.createDataFrame([(1, 1, "One"), (1, 2, "Two"), (2, 1, "One")], "doc_id long, no int, title string")
    p = spark.createDataFrame([(1, 0, "one"), (1, 3, "two "), (1, 5, "x"), (2, 0, "one"), (2, 4, "ONE")], "doc_id long, pos int, text string")
    assert {r.doc_id: r.paths for r in E.unique_title_paths(t, p).collect()} == {1: 1, 2: 2}
    s = spark.createDataFrame([(1, "a", "x", 0.9), (1, "b", "x", 0.8), (1, "b", "y", 0.7), (1, "c", "z", 0.1)], "item_id long, old_id string, new_id string, score double")
    got = {r.old_id: (r.new_id, r.runner_up) for r in E.match_without_reuse(s, 0.5, str(tmp_path)).collect()}
    assert got == {"a": ("x", None), "b": ("y", 0.7)}


@pytest.mark.parametrize("turn", [None, "turn"])
def test_matches_are_those_of_going_in_order(spark, tmp_path, turn):
    """Few distinct scores, so that many pairs tie; and one line of pairs that wait for one another."""
    r = random.Random(1)
    rows = [(q, a, b, r.randint(0, 8) / 8, a * 7 % 11) for q in range(12) for a in range(9) for b in range(20, 28) if r.random() < 0.6]
    rows += [(99, a, b, 1 - (a + b) / 100, a) for a in range(12) for b in (a, a + 1)]
    got = E.match_without_reuse(spark.createDataFrame(rows, "item_id long, old_id long, new_id long, score double, turn int").repartition(4), 0.25, str(tmp_path), turn=turn)
    want = {}
    for q in {x[0] for x in rows}:
        used = set()
        for _, a, b, s, _ in sorted((x for x in rows if x[0] == q and x[3] >= 0.25), key=lambda x: ((x[4],) if turn else ()) + (-x[3], x[1], x[2])):
            if ("l", a) not in used and ("r", b) not in used:
                used |= {("l", a), ("r", b)}
                every = sorted((x[3] for x in rows if x[:2] == (q, a)), reverse=True)
                want[q, a] = (b, s, every[1] if len(every) > 1 else None)
    assert {(x.item_id, x.old_id): (x.new_id, x.score, x.runner_up) for x in got.collect()} == want
    assert E.match_without_reuse(spark.createDataFrame([], "item_id long, old_id long, new_id long, score double, turn int"), 0.1, str(tmp_path / "none")).count() == 0


def test_formulas(spark):
    assert E.linear_formula([["X =", "a  b", "x 100%"], ["c"]]) == "X = (a b / c) x 100%" and E.linear_formula([["a"]]) is None
    assert E.column_code_row(["(1)", "(2)"]) and not E.column_code_row(["Name", "1"])
    u = spark.createDataFrame([(1, 0, "p", "clause"), (1, 1, "t", "table"), (1, 2, "t2", "table"), (1, 3, "q", "clause")], "doc_id long, pos int, unit_id string, unit_type string")
    assert {(r.unit_id, r.before, r.behind) for r in E.formula_links(u).collect()} == {("t", "p", "q"), ("t2", "p", "q")}


def test_connected(spark, tmp_path):
    e = spark.createDataFrame([(3, 2), (2, 1), (7, 8)], "a long, b long")
    assert {r.node: r.root for r in E.connected(e, str(tmp_path)).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
