"""The legal parser against enumeration, nesting and planted texts."""

import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from siltstone.operators import parsing as P


def frames(spark, texts, needed):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return docs, spark.createDataFrame([(i, n) for i, ns in enumerate(needed) for n in ns], "doc_id long, no int")


def best_chain(text, needed):
    """Every chain that begins at a heading of the first number, measured on the text itself."""
    heads = [(int(m[1]), m.start()) for m in re.finditer(r"^Điều\s+(\d+)\s*[.．]", text, re.MULTILINE)]
    line = lambda at: text.count("\n", 0, at)
    chains = []
    for no, at in heads:
        if no == needed[0]:
            chain = [at]
            for k in needed[1:]:
                chain.append(next((a for n, a in heads if n == k and a > chain[-1]), None))
                if chain[-1] is None:
                    break
            else:
                bodies = []
                for i, a in enumerate(chain):
                    end = chain[i + 1] if i + 1 < len(chain) else next((x for _, x in heads if x > a), len(text))
                    begin = text.find("\n", a)
                    bodies.append(text[begin + 1 : end].strip() if begin >= 0 else "")
                whole = "\n\n".join(bodies)
                clauses = sum(len(re.findall(r"^\d{1,3}\.(?:\s|$)", b, re.MULTILINE)) for b in bodies)
                chains.append(((all(bodies), clauses, max(0, sum(map(len, bodies)) - 5 * whole.count(".....")), -at), chain))
    if chains:
        return [line(a) for a in max(chains)[1]]
    return sorted(min(line(a) for n, a in heads if n == k) for k in needed if k in {n for n, _ in heads})


@pytest.mark.parametrize("seed", [0, 1])
def test_main_sequence_against_all_chains(spark, tmp_path, seed):
    r = random.Random(seed)
    parts = ["Điều {}. Tên", "Điều {}. Tên .....", "1. khoản", "2. khoản hai", "", "   ", "  lời văn ", "..........", "Điều {} không phải", "10."]
    texts = ["\n".join(r.choice(parts).format(r.randint(1, 4)) for _ in range(r.randint(1, 40))) for _ in range(60)]
    needed = [r.choice([[1], [1, 2], [1, 2, 3], [2, 4], [1, 2, 3, 4, 9]]) for _ in texts]
    docs, need = frames(spark, texts, needed)
    got = {}
    for x in P.main_sequence(docs, need, str(tmp_path / "w")).collect():
        got.setdefault(x.doc_id, []).append(x.pos)
    for i, (t, n) in enumerate(zip(texts, needed, strict=True)):
        assert sorted(got.get(i, [])) == best_chain(t, n), (t, n)


def test_contents_and_quotes(spark, tmp_path):
    text = "Điều 1. A .....\nĐiều 2. B .....\nĐiều 1. A\n1. một\nĐiều 2. B\n1. sửa như sau:\nĐiều 3. Trích\nhết\nĐiều 3. C\n1. ba\n2. bốn"
    docs, need = frames(spark, [text, "", None, "Điều 7. X"], [[1, 2], [1], [1], [1]])
    got = P.main_sequence(docs, need, str(tmp_path / "w")).orderBy("pos").collect()
    assert [(x.doc_id, x.no, x.title, x.pos) for x in got] == [(0, 1, "A", 2), (0, 2, "B", 4)]
    empty = P.main_sequence(docs.where("false"), need, str(tmp_path / "v"))
    assert empty.count() == 0


def test_intervals_nest_and_cover(spark, tmp_path):
    r = random.Random(7)
    parts = ["PHỤ LỤC", "Phụ lục II:", "Mẫu số 03", "Chương I", "Mục 2. X", "Điều 1. A", "Điều 2. B", "Nơi nhận:", "text", "", "1. một", "theo PHỤ LỤC I"]
    texts = ["Chương I\nĐiều 1. A\nx\nĐiều 2. B\ny\n" + "\n".join(r.choice(parts) for _ in range(40)) for _ in range(30)]
    docs, need = frames(spark, texts, [[1, 2]] * len(texts))
    lines = P.text_lines(docs)
    found = P.containers(lines, P.main_sequence(docs, need, str(tmp_path / uuid.uuid4().hex)))
    rows = [x.asDict() for x in found.collect()]
    assert len({(x["doc_id"], x["container_id"]) for x in rows}) == len(rows)
    by_id = {(x["doc_id"], x["container_id"]): x for x in rows}
    kinds = {x["kind"] for x in rows}
    assert kinds == {"attachment", "form", "chapter", "article", "tail"}
    for x in rows:
        assert x["first_pos"] < x["end_pos"]
        over = by_id.get((x["doc_id"], x["parent_id"]))
        assert x["parent_id"] is None or over["first_pos"] < x["first_pos"] and x["end_pos"] <= over["end_pos"] and over["depth"] == x["depth"] - 1
        for y in rows:
            if y["doc_id"] == x["doc_id"]:  # apart, or one within the other
                assert x["end_pos"] <= y["first_pos"] or y["end_pos"] <= x["first_pos"] or x["first_pos"] <= y["first_pos"] and y["end_pos"] <= x["end_pos"] or y["first_pos"] <= x["first_pos"] and x["end_pos"] <= y["end_pos"]
    held = P.contained_lines(lines, found).collect()
    assert len(held) == sum(t.count("\n") + 1 for t in texts)
    for x in held:
        inner = [c for c in rows if c["doc_id"] == x.doc_id and c["first_pos"] <= x.pos < c["end_pos"]]
        assert x.container_id == (max(inner, key=lambda c: c["first_pos"])["container_id"] if inner else None)


def test_articles_are_cut_clear(spark, tmp_path):
    text = "Điều 1. A\n1. một\nSố 5 + 6 Ngày 1 tháng 2 năm 2020\n2. hai\nChương II\nTIẾP\nĐiều 2. B\n\n  1. ba./. KT. BỘ TRƯỞNG Ông\nNơi nhận:\n- lưu\nPHỤ LỤC\nĐiều 9. Z"
    docs, need = frames(spark, [text, "Điều 1. A\nhết\nTM. CHÍNH PHỦ\nx"], [[1, 2], [1]])
    got = {(x.doc_id, x.no): x for x in P.built_articles(docs, need, str(tmp_path / "w")).collect()}
    assert got[0, 1].body == "1. một\n2. hai" and got[0, 1].heading == "Điều 1. A" and got[0, 1].end_pos == 4
    assert got[0, 2].body == "1. ba./." and got[0, 2].tail_pos == 9
    assert got[1, 1].body == "hết" and got[1, 1].tail_pos == 2 and len(got) == 3


def test_patterns(spark):
    yes = {"ATTACHMENT": ["PHỤ LỤC", "Phụ lục IV.", "PHỤ LỤC 12:"], "CHAPTER": ["Chương IV", "Mục 1. X", "chương 2a: Y"], "FORM": ["Mẫu số 01a"], "TAIL": ["Nơi nhận:", "TM. CHÍNH PHỦ", "KT. BỘ TRƯỞNG THỨ", "VĂN PHÒNG QUỐC HỘI"]}
    no = {"ATTACHMENT": ["PHỤ LỤC I kèm theo", "theo PHỤ LỤC"], "CHAPTER": ["Chương trình", "Mụcx"], "FORM": ["Mẫu số 1 kèm"], "TAIL": ["Nơi nhận: ông A", "văn phòng quốc hội"]}
    for want, lines in ((True, yes), (False, no)):
        for name, texts in lines.items():
            got = spark.createDataFrame([(t,) for t in texts], "t string").where(F.col("t").rlike(getattr(P, name)) != F.lit(want)).collect()
            assert got == [], (name, got)


def test_lines_are_dealt_out_once(spark):
    lines = spark.createDataFrame([(1, 0, "Điều 1. A"), (1, 1, ""), (1, 2, "PHỤ LỤC"), (1, 3, " "), (1, 4, " Tên ")], "doc_id long, pos int, line string")
    found = P.containers(lines, spark.createDataFrame([(1, 1, "A", 0)], "doc_id long, no long, title string, pos int"))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 3  # lines, their number, the join of both
    assert sorted((x.container_id, x.title, x.subtitle, x.first_pos, x.end_pos) for x in found.collect()) == [("1|article=1", "Điều 1. A", None, 0, 2), ("1|attachment=1", "PHỤ LỤC", "Tên", 2, 5)]


def test_planted_texts_are_their_lines(spark):
    from siltstone.plans import parsing as plans

    keys = [*range(-13, 60), 5, 5, 330]
    orders = spark.createDataFrame([(k,) for k in keys], "o_orderkey long")
    lines = {}
    for x in spark.sql(plans.planted(plans._spark, "{orders}"), orders=orders).collect():
        lines.setdefault(x.n, []).append((x.p, x.line))
    got = orders.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("c")).select("o_orderkey", plans.planted_text(F.col("o_orderkey"), F.col("c")).alias("t")).collect()
    assert {x.o_orderkey: x.t for x in got} == {n: "\n".join(line for _, line in sorted(ls)) for n, ls in lines.items()}


def test_numbers_beyond_64_bits(spark):
    docs, need = frames(spark, ["Điều 1. A\nmột\nĐiều 99999999999999999999. B\nhai"], [[1]])
    assert [(x.no, x.pos) for x in P.main_sequence(docs, need).collect()] == [(1, 0)]
    assert [(x.no, x.body) for x in P.built_articles(docs, need).collect()] == [(1, "một")]


def test_texts_are_not_dealt_out(spark, small):
    from siltstone.plans import registry

    for name, most in (("main_sequence", 1), ("built_articles", 1), ("appendix_containers", 3)):
        plan = registry.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        dealt = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
        assert 0 < len(dealt) <= 2 * most, (name, dealt)  # both sides begin with the orders' numbers
        assert "Scan ExistingRDD" not in plan and plan.count("orders.parquet") >= 1, name
