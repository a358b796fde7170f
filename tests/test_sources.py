"""Citations, registries, fetching, numbering, answers from sources, and the model of cases."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import citations as C
from siltstone.operators import editing
from siltstone.operators import pipelines as P
from siltstone.sources import files, html
from siltstone.streaming import sessions as S


def test_links_of_any_form(spark):
    page = """<a href="/a">x</a><A class='c' title="a > b" HREF='/b'>y</A><a data-href="/no" href=/c>z</a><abbr href="/no">w</abbr><a name=x>v</a>"""
    got = html.links(spark.createDataFrame([(1, page)], "page_id long, html string")).collect()
    assert [r.href for r in got] == ["/a", "/b", "/c"]


def test_long_chains_settle(spark, tmp_path):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in editing.connected(edges, str(tmp_path / "c")).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000}


def test_manifest_counts_repeats(spark):
    of = lambda xs: files.manifest(spark.createDataFrame([(x,) for x in xs], "k string"), "t", "k").first()
    assert of("aa").digest != of("bb").digest and of("ab").digest == of("ba").digest and of("aab").digest != of("abb").digest
    assert of("").rows == 0


def test_newest_row_of_a_batch(spark):
    rows = spark.createDataFrame([(1, 5, "old"), (1, 9, "new"), (2, 1, "a"), (2, 1, "b")], "k long, ts long, v string")
    assert sorted(map(tuple, S.newest_rows(rows, "k", "ts").collect())) == [(1, 9, "new"), (2, 1, "b")]


def test_readiness_is_kept_for_a_time():
    now, calls, ok = [0.0], [], [True]
    r = S.Readiness(lambda: calls.append(1) or ok[0], 60, 5, lambda: now[0])
    assert r.ready() and r.ready() and len(calls) == 1
    now[0], ok[0] = 61, False
    assert not r.ready() and not r.ready() and len(calls) == 2
    now[0], ok[0] = 66.5, True
    assert r.ready() and len(calls) == 3
    assert not S.Readiness(lambda: 1 / 0).ready()


def test_append_log(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        S.append_log(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 3


def test_relations_and_urls(spark):
    rows = [(1, 2, "b", None, "r", "h", True, None), (1, 1, "a", "c", "r", "h", None, True), (1, 3, "a", "c", "r", "h", True, True)]
    df = spark.createDataFrame(rows, "k long, pos int, target_id string, target_code string, relation_type string, href string, same_topic boolean, target_in_corpus boolean")
    r = C.relation_lists(df, "k", "pos").first()
    assert (r.target_ids, r.target_codes, r.relation_types, r.same_topic, r.in_corpus) == (["a", "b"], ["c", None], ["r", "r"], [False, True], [True, False])
    hits = spark.createDataFrame([(1, "X", ["u?ItemID=9"], None), (2, None, ["u", "v&itemid=7"], "n/1"), (3, "none", [], "N/1"), (4, None, ["  "], None)], "k long, source_document_id string, source_urls array<string>, document_number string")
    registry = spark.createDataFrame([("x", "1", "a", "U1"), ("y", "7", "b", "U2"), ("z", "8", "n/1", "U3")], "source_document_id string, item_id string, document_number string, canonical_url string")
    assert {r.k: r.official_url for r in C.official_urls(hits, registry, "k").collect()} == {1: "U1", 2: "U2", 3: "U3", 4: None}


def test_registry_faults(spark):
    docs = spark.createDataFrame([("a", "1/A", "h"), ("b", "2/B", "h"), ("c", "3/C", "h")], "document_id string, number string, sha256 string")
    own = spark.createDataFrame([("a", "h"), ("b", "x"), ("b", "x")], "document_id string, sha256 string")
    sources = spark.createDataFrame([("1/a", "u"), ("2/B", "v"), ("2/b", "w")], "number string, url string")
    rows, problems = files.registry(docs, own, sources)
    assert {(r.document_id, r.problem) for r in problems.collect()} == {("b", "many_files"), ("b", "changed"), ("b", "many_sources"), ("c", "no_file"), ("c", "no_source")}
    assert rows.count() == 3


def test_maps_and_retries():
    page = lambda *locs: f"<urlset xmlns='x'>{''.join(f'<url><loc>{u}</loc></url>' for u in locs)}</urlset>".encode()
    site = {"r": b"<sitemapindex><sitemap><loc>a</loc></sitemap><sitemap><loc>b</loc></sitemap><sitemap><loc>r</loc></sitemap></sitemapindex>", "a": page("1", "2"), "b": gzip.compress(page("2", "3"))}
    assert files.sitemap_urls(site.__getitem__, "r") == ["1", "2", "3"]
    with pytest.raises(files.CorpusError):
        files.sitemap_urls(site.__getitem__, "r", most=2)
    answers, waits = [(503, {}, b""), (429, {"Retry-After": "7"}, b""), (200, {"Content-Type": "text/html; x"}, b"ok")], []
    assert files.with_retry(lambda u: answers.pop(0), "u", kinds=("text/html",), sleep=waits.append) == b"ok" and waits == [0.5, 7.0]
    for answer in ((404, {}, b""), (200, {}, b"x" * 20)):
        with pytest.raises(files.CorpusError):
            files.with_retry(lambda u: answer, "u", most_bytes=10, sleep=waits.append)  # noqa: B023


def test_numbering(spark):
    levels = spark.createDataFrame([(1, 0, 1, "upperRoman", "Chương %1"), (1, 1, 1, "decimal", "%1.%2."), (2, 0, 3, "lowerLetter", "%1)")], "num_id int, level int, start int, format string, pattern string")
    rows = [(1, 0, 1, 0, "a"), (1, 1, 1, 1, "b"), (1, 2, 1, 1, "c"), (1, 3, 1, 0, "d"), (1, 4, 1, 1, "e"), (1, 5, 2, 0, "f"), (1, 6, None, None, "g"), (2, 0, 1, 1, "h")]
    got = files.numbered(spark.createDataFrame(rows, "doc_id long, pos int, num_id int, level int, text string"), levels)
    assert [r.label for r in got.orderBy("doc_id", "pos").collect()] == ["Chương I", "I.1.", "I.2.", "Chương II", "II.1.", "c)", None, "I.1."]


def test_ask(spark):
    questions = spark.createDataFrame([(1, "good"), (2, "bad source"), (3, "no hit"), (4, "broken"), (5, "fails")], "item_id long, question string")

    def retrieve(asked, k):
        rows = asked.where("item_id != 3").select("item_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("place"))
        return rows.where(F.col("place") <= k).select("item_id", "place", F.lit("Law").alias("source"), F.lit("see [S9] \x01 text").alias("text"))

    def generate(question, context):
        assert "[S1] Law\nsee (9)" in context and "\x01" not in context
        if question == "fails":
            raise RuntimeError
        if question == "broken":
            return "no json"
        ids = ["S1"] if question == "good" else ["S7"]
        return "```json " + json.dumps({"status": "answered", "answer": f"It is so [{ids[0]}].", "sources": ids}) + "```"

    got = {r.item_id: r for r in P.ask(questions, retrieve, generate, 2).collect()}
    assert (got[1].answer, got[1].status, got[1].sources) == ("It is so [S1].", "answered", ["S1", "S2"])
    assert (got[2].answer, got[2].rejected) == (None, "citation_unknown") and got[3].status == "insufficient_evidence"
    assert got[4].rejected == "invalid_schema" and got[5].rejected == "generation_failed" and len(got) == 5
    with pytest.raises(ValueError):
        P.ask(questions, retrieve, generate, 0)


def test_models_and_cases(spark):
    models = spark.createDataFrame([("a", "0", "0", 8000), ("b", "0", "0.1", 90000), ("c", "0", "0", 32000), ("d", "0", "0", 100)], "id string, prompt_price string, completion_price string, context_length int")
    assert [r.id for r in P.usable_models(models, 8000).collect()] == ["c", "a"]
    cases = spark.createDataFrame([(1, "draft"), (2, "adjudicated"), (3, "locked"), (4, "draft")], "case_id long, status string")
    moves = spark.createDataFrame([(1, "panel_reviewed"), (2, "locked"), (3, "draft"), (9, "locked"), (4, "panel_reviewed"), (4, "locked")], "case_id long, status string")
    now, bad = P.advance(cases, moves)
    assert {r.case_id: r.status for r in now.collect()} == {1: "panel_reviewed", 2: "locked", 3: "locked", 4: "draft"}
    assert {(r.case_id, r.problem) for r in bad.collect()} == {(3, "not_allowed"), (9, "unknown_case"), (4, "moved_twice")}


def test_segmenters_and_times(spark):
    cut = T.LongestMatch(["bất hợp pháp", "đình công", "hợp pháp"])
    df = spark.createDataFrame([("Đình công bất hợp pháp, hợp pháp.",), (None,)], "t string")
    assert [r[0] for r in df.select(T.segmented(F.col("t"), cut)).collect()] == [["Đình_công", "bất_hợp_pháp", ",", "hợp_pháp", "."], []]
    times = spark.createDataFrame([("2020-05-01T10:00:00Z",), ("2020-05-01T17:00:00+07:00",), ("2020-05-01 10:00:00",), ("1/5/2020",), ("2020-05-01",), ("x",)], "t string")
    assert [r[0] for r in times.select(F.unix_seconds(T.utc(F.col("t")))).collect()] == [1588327200] * 3 + [1588291200] * 2 + [None]
