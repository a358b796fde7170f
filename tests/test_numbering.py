"""List numbers against a walk through the paragraphs in order."""

import random
import re

import pytest

from siltstone.operators import numbering as N
from siltstone.sources import files


def walk(rows, defined):
    """Labels of (pos, num, level) in order, with counters as a document's reader keeps them."""
    lists = {}
    for num, level, start, form, pattern, restart in defined:
        lists.setdefault(num, {})[level] = (start, form, pattern, level - 1 if restart is None else restart - 1)
    counts, out = {}, {}
    for pos, num, level in sorted(rows):
        of = lists.get(num, {})
        if level not in of:
            out[pos] = None
            continue
        own = counts.setdefault(num, {})
        own[level] = own[level] + 1 if level in own else of[level][0]
        for k in [k for k in own if k > level and level <= of[k][3]]:
            del own[k]

        def shown(m, of=of, own=own):
            k = int(m[1]) - 1
            return m[0] if k not in of else files.number_text(own.get(k, of[k][0]), of[k][1]) if of[k][1] != "none" else ""

        out[pos] = re.sub("%([1-9])", shown, of[level][2]).replace("\t", " ").strip()
    return out


@pytest.mark.parametrize("seed", range(3))
def test_numbers_against_a_walk(spark, seed):
    r = random.Random(seed)
    forms = ["decimal", "decimalZero", "upperRoman", "lowerRoman", "upperLetter", "lowerLetter", "none"]
    defined = [(num, k, r.randint(1, 30), r.choice(forms), r.choice(["%1.%2.%3", f"%{k + 1})", "\t%9 x %1", f"§%{k + 1}"]), r.choice([None, 0, 1, 2])) for num in (1, 2) for k in range(4) if r.random() < 0.9]
    rows = [(d, p, r.choice([1, 1, 2, 3, None]), r.choice([0, 0, 1, 2, 3, 7])) for d in range(4) for p in range(60)]
    frame = spark.createDataFrame([(*x, "t") for x in rows], "doc_id long, pos int, num_id int, level int, text string").repartition(5)
    got = N.numbered(frame, spark.createDataFrame(defined, "num_id int, level int, start int, format string, pattern string, restart int"))
    got = {(x.doc_id, x.pos): x.label for x in got.collect()}
    for d in range(4):
        want = walk([x[1:] for x in rows if x[0] == d], defined)
        assert {p: got[d, p] for p in want} == want


def test_many_levels_have_no_cap(spark):
    """More list levels than any template has: all are used."""
    levels = spark.range(12_000).selectExpr("cast(id as int) as num_id", "0 as level", "cast(id as int) as start", "'lowerLetter' as format", "'%1)' as pattern")
    rows = spark.createDataFrame([(1, i, n, 0, "") for i, n in enumerate((11_999, 10_500, 28, 0))], "doc_id long, pos int, num_id int, level int, text string")
    assert [x.label for x in files.numbered(rows, levels).orderBy("pos").collect()] == ["qsm)", "omv)", "ab)", "0)"]


def test_styles_inherit(spark, tmp_path):
    ddl = "doc_id int, style string, based_on string, num_id int, level int"
    chain = [(1, "a0", None, 5, 1)] + [(1, f"a{i}", f"a{i - 1}", None, None) for i in range(1, 40)] + [(2, "a1", "a0", 7, None), (2, "a0", "gone", None, 3)]
    got = {(x.doc_id, x.style): (x.num_id, x.level) for x in N.style_lists(spark.createDataFrame(chain, ddl), str(tmp_path / "x"), ["doc_id"]).collect()}
    assert got[1, "a39"] == (5, 1) and got[2, "a1"] == (7, 3) and len(got) == len(chain)
    with pytest.raises(N.NumberingError, match="'b', 'c'"):
        N.style_lists(spark.createDataFrame([(1, "b", "c", 1, 1), (1, "c", "b", None, None), (1, "d", None, None, None)], ddl), str(tmp_path / "y"))
    assert N.style_lists(spark.createDataFrame([], ddl), str(tmp_path / "z")).count() == 0


def test_labels(spark):
    df = spark.range(1, 4100).selectExpr("id as n")
    for form in ("decimal", "decimalZero", "upperRoman", "lowerRoman", "upperLetter", "lowerLetter"):
        from pyspark.sql import functions as F

        assert all(x.s == files.number_text(x.n, form) for x in df.select("n", N.number_label(F.col("n"), F.lit(form)).alias("s")).collect())
