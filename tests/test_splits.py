"""Splits against walks through the graph, and their shares."""

import random

from siltstone.operators import splits as S
from siltstone.operators.editing import connected

SHARES = {"dev": 0.7, "test": 0.2, "held": 0.1}


def test_no_component_on_two_sides(spark, tmp_path):
    r = random.Random(2)
    items = [(i, r.choice(["x", "y", None])) for i in range(600)] + [(None, "x")]
    links = [(i, f"art{r.randint(0, 900)}") for i in range(600) for _ in range(r.choice([0, 1, 1, 2]))] + [(None, "art1"), (3, None), (10_000, "art2")]
    got = S.split_without_leaks(spark.createDataFrame(items, "item_id long, category string"), spark.createDataFrame(links, "item_id long, article string"), SHARES, str(tmp_path)).collect()
    assert len(got) == len([x for x in items if x[0] is not None])
    by_item = {x.item_id: x for x in got}
    seen: dict[int, int] = {}

    def find(x):
        while seen.setdefault(x, x) != x:
            x = seen[x]
        return x

    of = {}
    for i, a in links:
        if i is not None and a is not None:
            seen[find(i)] = find(of.setdefault(a, i))
    groups: dict[int, list[int]] = {}
    for i in by_item:
        groups.setdefault(find(i), []).append(i)
    assert len({x.component for x in got}) == len(groups)
    largest = 0
    for members in groups.values():
        rows = [by_item[i] for i in members]
        assert len({(x.component, x.split) for x in rows}) == 1 and {x.size for x in rows} == {len(rows)}
        largest = max(largest, len(rows))
    for name, share in SHARES.items():  # off by half of a component at two borders of each of three categories, at most
        assert abs(sum(x.split == name for x in got) - share * len(got)) <= 3 * largest
    again = S.split_without_leaks(spark.createDataFrame(items, "item_id long, category string").repartition(7), spark.createDataFrame(links[::-1], "item_id long, article string"), SHARES, str(tmp_path / "again")).collect()
    assert {(x.item_id, x.split) for x in again} == {(x.item_id, x.split) for x in got}


def test_no_items(spark, tmp_path):
    none = S.split_without_leaks(spark.createDataFrame([], "item_id long, category string"), spark.createDataFrame([], "item_id long, article string"), SHARES, str(tmp_path))
    assert none.count() == 0


def test_items_of_one_article_have_no_edges(spark, tmp_path):
    items = spark.createDataFrame([(i, "x") for i in range(60)] + [(60, "x")], "item_id long, category string")
    links = spark.createDataFrame([(i, f"art{i % 5}") for i in range(60)] + [(0, "art1"), (99, "art2"), (99, "art3")], "item_id long, article string")
    got = {r.item_id: r.component for r in S.components(items, links, str(tmp_path)).collect()}
    assert got == {i: ("a:art0", "a:art0", "a:art2", "a:art2", "a:art4")[i % 5] for i in range(60)} | {60: "i:60"}
    assert spark.read.parquet(f"{tmp_path}/edges").count() == 2


def test_a_long_path_takes_few_rounds(spark, tmp_path):
    names = list(range(256))
    random.Random(5).shuffle(names)
    edges = spark.createDataFrame([*zip(names, names[1:], strict=False), (1000, 1001), (2000, 2000)], "a long, b long")
    got = {r.node: r.root for r in connected(edges, str(tmp_path)).collect()}
    assert got == dict.fromkeys(names, 0) | {1000: 1000, 1001: 1000, 2000: 2000}
    assert len([x for x in tmp_path.iterdir() if x.name.isdigit()]) <= 10
