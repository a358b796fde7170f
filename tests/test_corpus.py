import io
import json
import uuid
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import chunking as C
from siltstone.operators import metrics as M
from siltstone.operators import pipelines as P
from siltstone.operators import review, serving, units
from siltstone.sources import files, html

TEXT = "Article 1. Scope\n1. First clause of the law.\na) point one is here\nb) point two is there\n2. Second clause.\n2. Second again."


def test_text_functions(spark):
    df = spark.createDataFrame([("Trường Đại-học  Số 12/NĐ", "x")], "a string, b string")
    r = df.select(T.fold(F.col("a")).alias("f"), T.document_number_key(F.col("a")).alias("k"), T.squeeze(F.col("a")).alias("s"), T.fold_any("a").alias("g"), T.uuid5(str(C.NAMESPACE), F.lit("k|é")).alias("u"), T.slug(F.col("a")).alias("l")).first()
    assert r.f == r.g == "truong dai-hoc  so 12/nd" and r.k == "TRUONGDAIHOCSO12ND" and r.s == "Trường Đại-học Số 12/NĐ"
    assert r.u == str(uuid.uuid5(C.NAMESPACE, "k|é")) and r.l == "truong-dai-hoc-so-12-nd"


def test_units_hold_until_the_next(spark):
    u = units.units(spark.createDataFrame([(1, TEXT)], "doc_id long, text string")).orderBy("pos").collect()
    assert [x.unit_type for x in u] == ["article", "clause", "point", "point", "clause", "clause"]
    assert [x.clause for x in u] == [None, "1", "1", "1", "2", "2"] and [x.point for x in u][2:4] == ["a", "b"]
    assert [x.unit_occurrence for x in u] == [1, 1, 1, 1, 1, 2] and {x.article for x in u} == {"1"}


def test_quoted_amendment_opens_no_clause(spark):
    t = '1. Amends:\n"Article 5 reads\n2. quoted clause"\n3. next'
    assert [x.clause for x in units.units(spark.createDataFrame([(1, t)], "doc_id long, text string")).orderBy("pos").collect()] == ["1", "1", "1", "3"]


def test_rule_names_itself_and_what_is_below(spark):
    u = spark.createDataFrame([("a|1",), ("a|1|b",), ("a|10",), ("a",)], "unit_id string")
    got = units.rule_matches(u, spark.createDataFrame([("a|1",)], "rule string"))
    assert {r.unit_id for r in got.collect()} == {"a|1", "a|1|b"}


def test_chunks_keep_the_text(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "word " * 500)], "doc_id long, text string")
    chunks = C.chunk_documents(docs, 12)
    assert C.violations(chunks, docs, 12).collect() == []
    kinds = {r.chunk_type for r in chunks.where("doc_id = 1").collect()}
    assert kinds <= {"preamble", "clause", "points", "fallback_segment"} and "clause" in kinds


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .,;\n1)", max_size=300), st.integers(3, 40))
def test_splitter_loses_nothing(text, size):
    parts = C.split_recursive(text, size)
    assert "".join("".join(parts).split()) == "".join(text.split())
    assert all(C.estimated(p) <= size for p in parts)
    fit = C.split_to_fit(text, size)
    assert "".join("".join(fit).split()) == "".join(text.split())
    plain = lambda t: int(len(C.WORDS.findall(t)) * 1.3)  # noqa: E731  the same count, but without a ruler of its own
    assert C.split_recursive(text, size, size // 3, plain) == C.split_recursive(text, size, size // 3) and C.split_to_fit(text, size, plain) == fit


def plain_split(text, size, overlap):
    """The splitter's rule on counts of every prefix."""
    rest, out, at = text.strip(), [], 0
    n = C.estimated
    while at < len(rest):
        end = max([k for k in range(at + 1, len(rest) + 1) if n(rest[at:k]) <= size], default=at + 1)
        cut = end
        if end < len(rest):
            for s in C.SEPARATORS:
                found = [k for k in range(at + max(1, (end - at) // 3), end - len(s) + 1) if rest.startswith(s, k)]
                if found and rest[at : found[-1] + len(s)].strip():
                    cut = found[-1] + len(s)
                    break
        out.append(rest[at:cut].strip())
        if cut == len(rest):
            break
        again = min([k for k in range(cut + 1) if n(rest[k:cut]) <= overlap], default=cut) if overlap else cut
        at = again if again > at else cut
    return [x for x in out if x]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .,;\n1", max_size=120), st.integers(2, 20))
def test_splitter_against_its_rule(text, size):
    for overlap in (0, size // 2):
        assert C.split_recursive(text, size, overlap) == plain_split(text, size, overlap)


def test_marks_lead_their_text():
    """A mark that opens a part isn't cut off as a sentence, and marks don't open a part."""
    assert C.split_to_fit("1. alpha beta gamma delta", 4) == ["1. alpha", "beta gamma delta"]
    assert C.split_to_fit("One two three. Four five six; seven eight", 6) == ["One two three.", "Four five six;", "seven eight"]
    assert C.split_to_fit("abc", 0) == ["abc"] and C.split_to_fit("a , b", 1) == ["a,", "b"] and C.split_to_fit("a ; . b", 1) == ["a;.", "b"]
    assert C.point_context("a) Các trường hợp sau: x y") == "a) Các trường hợp sau:" and C.point_context("w " * 300).endswith("w …")


def test_tables_and_subpoints():
    got = C.table_chunks(["Name", "Value"], [[f"row {i}", str(i)] for i in range(6)], 18, 40)
    assert all(t.startswith("Name | Value\n") and C.estimated(t) <= 18 for t, _ in got) and len(got) == 3
    assert [line for t, _ in got for line in t.split("\n")[1:]] == [f"row {i} | {i}" for i in range(6)]
    long = C.table_chunks(["H"], [["w " * 40]], 15, 40)
    assert len(long) > 3 and all(w == ("oversized_table_row_split",) for _, w in long)
    wide = C.table_chunks(["h " * 12], [["a"], ["b"]], 10, 30)
    assert [w for _, w in wide] == [("oversized_table_header_context",)] * 2 and C.table_chunks(["H"], [], 5, 9) == [("H", ())]
    with pytest.raises(ValueError):
        C.table_chunks(["h " * 50], [["a"]], 10, 30)
    text = "1. Clause of it\na) the point says:\na1) one two three four five six\na2) seven eight nine ten eleven twelve"
    chunks = list(C.chunk_text("k", text, 19))
    assert [c for _, _, c in chunks if "twelve" in c] == ["a) the point says:\na2) seven eight nine ten eleven twelve"]
    led = list(C.chunk_text("k", "1. " + "word " * 60, 20, lead="Law: of 2020"))
    assert len(led) > 2 and all(c.startswith("Law: of 2020\n\n") and C.estimated(c) <= 20 for _, _, c in led)
    joined = list(C.chunk_text("k", "Preamble\n1. first clause\n2. " + "second " * 12, 18))
    assert joined[0] == ("k|clause=1", "clause", "Preamble\n1. first clause")


def test_planted_violations(spark):
    docs = spark.createDataFrame([(1, "a b. " * 30), (2, "x")], "doc_id long, text string")
    chunks = C.chunk_documents(docs, 20)
    bad = chunks.where("not (doc_id = 1 and chunk_no = 1)").unionByName(chunks.where("doc_id = 2").withColumn("doc_id", F.lit(9).cast("long")))
    assert {(r.doc_id, r.problem) for r in C.violations(bad, docs, 20).collect()} == {(1, "segment_gap"), (1, "number_gap"), (1, "text_lost"), (9, "no_document"), (9, "foreign_key"), (9, "repeated_id"), (2, "repeated_id"), (9, "repeated_key"), (2, "repeated_key")}
    led = C.chunk_documents(docs.withColumn("top", F.lit("Law: A")), 20, lead="top")
    assert C.violations(led, docs.withColumn("top", F.lit("Law: A")), 20, lead="top").count() == 0


def test_ranges_and_subpoints():
    assert C.label_ranges(["a", "b", "c", "e"]) == "a-c,e" and C.subpoints("a) x see a1) of:\na1) y; a2) z") == ["a) x see a1) of:", "a1) y;", "a2) z"]
    with pytest.raises(ValueError):
        C.chunk_id(" ")


CONTRACT = """Điều 2. Thử việc
Thời gian thử việc là 200 ngày kể từ ngày ký hợp đồng lao động.
Mức lương cơ bản là 10.000.000 đồng, trả vào ngày 05 hằng tháng.
Thời giờ làm việc là 9 giờ mỗi ngày từ thứ hai đến thứ sáu.
Hợp đồng này xác định thời hạn 12 tháng; một bên chấm dứt phải báo trước 15 ngày."""


def test_review_rules(spark):
    docs = spark.createDataFrame([(1, CONTRACT), (2, "Hợp đồng không có thỏa thuận thử việc."), (3, None)], "doc_id long, text string")
    got = {(r.doc_id, r.category): r for r in review.findings(docs).collect()}
    assert (got[1, "probation"].severity, got[1, "probation"].value) == ("warning", 200)
    assert (got[1, "working_time"].severity, got[1, "working_time"].value) == ("attention", 9)
    assert got[1, "termination"].severity == "warning" and got[1, "salary"].severity == "info"
    assert got[2, "probation"].evidence == "insufficient_evidence" and len(got) == 12


def test_review_wordings(spark):
    """The term is sought in the whole contract; notice alone needs attention; hours in either wording; a number must be near
    its phrase, and the nearest counts."""
    texts = [
        "Hợp đồng xác định thời hạn 24 tháng từ ngày ký.\nBên chấm dứt phải báo trước 20 ngày.", "Bên chấm dứt phải báo trước 45 ngày cho bên kia.", "Thời giờ làm việc: mỗi ngày nhân viên làm 11 giờ.",
        "Thời giờ làm việc mỗi tuần không quá 50 giờ.", "Sau 90 ngày thì thời gian thử việc 30 ngày kết thúc.", f"Thử việc theo quy định. {'x ' * 80} Trong 200 ngày.", "Hợp đồng xác định thời hạn 48 tháng.\nBên chấm dứt phải báo trước 20 ngày.", "Thời giờ làm việc theo ca của công ty.",
    ]
    got = {(r.doc_id, r.category): (r.severity, r.value) for r in review.findings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect() if r.evidence == "supported"}
    assert got[0, "termination"] == ("warning", 20) and got[1, "termination"] == ("attention", 45) and got[6, "termination"] == ("attention", 20)
    assert got[2, "working_time"] == ("warning", 11) and got[3, "working_time"] == ("warning", 50) and got[7, "working_time"] == ("info", None)
    assert got[4, "probation"] == ("info", 30) and got[5, "probation"] == ("attention", None)


def test_metrics_of_empty_expectation(spark):
    hits = spark.createDataFrame([("m", 1, 7, "A", 1), ("m", 1, 8, "B", 2)], "method string, item_id long, doc_id long, article string, rank int")
    want = spark.createDataFrame([(1, ["B", "C"], [8]), (2, [], [])], "item_id long, articles array<string>, documents array<bigint>")
    got = {r.item_id: r for r in M.metrics_at_k(hits, want, 5).collect()}
    assert (got[1].article_recall, got[1].article_mrr, got[1].all_evidence) == (0.5, 0.5, 1.0)
    assert (got[2].any_article, got[2].article_mrr) == (1.0, 0.0)


def test_gate_and_guardrail(spark):
    r = spark.range(1).select(M.gate({"a": F.lit(None).cast("double"), "b": F.lit(0.1), "c": F.lit(1.0)}, {"a": 0, "b": 0.5, "c": 1}).alias("g")).first()
    assert r.g == ["a:not_scoreable", "b:below_minimum"]
    rows = [("answered", ["S1"], ["S1"], ["S1", "S2"], "x"), ("answered", ["S3"], ["S3"], ["S1"], "x"), ("answered", [], [], ["S1"], "x"), ("insufficient_evidence", [], [], ["S1"], "x"), ("answered", ["S1"], ["S1", "S2"], ["S1", "S2"], "x"), ("other", [], [], [], "x")]
    df = spark.createDataFrame(rows, "s string, d array<string>, i array<string>, a array<string>, t string")
    assert [x[0] for x in df.select(M.guardrail(*(F.col(c) for c in "sdiat"))).collect()] == [None, "citation_unknown", "citation_missing", None, "citation_mismatch", "invalid_schema"]


def test_pages_and_previous_question(spark):
    with pytest.raises(ValueError):
        serving.page(spark.range(3), 0, 10, "id")
    assert [r.id for r in serving.page(spark.range(25), 3, 10, "id").collect()] == [20, 21, 22, 23, 24]


def docx(paragraphs):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in paragraphs)
    t = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p}{t}</w:body></w:document>")
    return b.getvalue()


def test_file_sources(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.docx").write_bytes(docx(["First paragraph of it"] * 5))
    (d / "b.txt").write_text("short")
    (d / "c.exe").write_bytes(b"x")
    (d / "d.docx").write_bytes(b"broken")
    got = {r.name: r for r in files.extract_files(spark, str(d)).collect()}
    assert got["a.docx"].text.endswith("a | b") and got["b.txt"].problem == "text_length" and got["c.exe"].problem == "unsupported_type"
    assert got["d.docx"].problem.startswith("unreadable")
    digests = files.file_digests(spark, str(d))
    inv = digests.select("name", "sha256").where("name != 'b.txt'").unionByName(spark.createDataFrame([("z", "0")], "name string, sha256 string"))
    assert {(r.name, r.problem) for r in files.verify_checksums(digests, inv).collect()} == {("b.txt", "unexpected"), ("z", "missing")}
    assert files.number_text(4, "lowerRoman") == "iv" and files.number_text(28, "upperLetter") == "AB"


def test_jsonl_and_index(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text("\n".join(json.dumps({"chunk_id": str(i), "content": f"text {i}"}) for i in range(3)) + "\n\n")
    df = files.read_jsonl(spark, str(p), expected_rows=3)
    with pytest.raises(files.CorpusError):
        files.read_jsonl(spark, str(p), expected_rows=4)
    p.write_text('{"chunk_id": "1", "content": "x"}\n{"chunk_id": "1", "content": " "}')
    with pytest.raises(files.CorpusError):
        files.read_jsonl(spark, str(p))
    df = spark.createDataFrame([("1", "x"), ("2", "y")], "chunk_id string, content string")
    root = str(tmp_path / "index")
    assert files.write_index(df, root, "v1", "f") == 2
    assert files.activate(spark, root, "v1", "f", 2, "current_index") == "created"
    assert files.activate(spark, root, "v1", "f", 2, "current_index") == "already_active"
    files.write_index(df, root, "v2", "f")
    assert files.activate(spark, root, "v2", "f", 2, "current_index") == "switched" and files.activate(spark, root, "v2", "f", 2, "current_index", True) == "verified"
    with pytest.raises(files.CorpusError):
        files.activate(spark, root, "v2", "g", 2, "current_index")


def test_html_tables():
    got = html.read_blocks("<h1>T</h1><p>a<br>b</p><table><tr><th>x</th><th>y</th></tr><tr><td>1</td><td>2</td></tr></table><script>no</script><p>z")
    assert got == [("heading", "T"), ("paragraph", "a b"), ("table", "x | y\n1 | 2"), ("paragraph", "z")]


def test_pipelines(spark):
    hits = spark.createDataFrame([(1, "q", "a", "A", 1, "s"), (1, "q", "bb", "B", 2, "s"), (1, "q", "b", "B", 3, "s")], "item_id long, question string, text string, article string, rank int, source string")
    got = P.rerank(hits, lambda pairs: [float(len(t)) for _, t in pairs], 5).orderBy("place")
    assert [r.text for r in got.collect()] == ["bb", "a"]
    fail = P.rerank(hits, lambda pairs: [float("nan")] * len(pairs), 5).orderBy("place")
    assert [r.text for r in fail.collect()] == ["a", "bb"]
    ctx = P.context(got)
    assert ctx.first().context.startswith("[S1] s\nbb")
    out = P.answer(ctx.withColumn("question", F.lit("q")), lambda q, c: q + "!")
    assert out.first().answer == "q!"
    assert P.embed(hits.limit(1), lambda ts: [[float(len(t))] for t in ts]).first().embedding == [10.0]
    done = spark.createDataFrame([(1, "m1")], "item_id long, model string")
    assert [r.model for r in P.pending_tasks(hits.select("item_id").distinct(), ["m1", "m2"], done).collect()] == ["m2"]


def test_streams(spark, tmp_path, small):
    from siltstone.streaming import sessions as S

    events = spark.read.parquet(f"{small}/events.parquet")
    src = str(tmp_path / "src")
    events.write.parquet(src)
    stream = spark.readStream.schema(events.schema).parquet(src)
    q = S.windowed_counts(stream).writeStream.format("memory").queryName("win").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = {(r.start, r.event_type): r.n for r in S.windowed_counts(events).collect()}
    got = {(r.start, r.event_type): r.n for r in spark.table("win").collect()}
    assert got and all(batch[k] == v for k, v in got.items())
    S.upsert(spark.readStream.schema(events.schema).parquet(src), str(tmp_path / "up"), "event_id", str(tmp_path / "cp2")).awaitTermination(120)
    assert S.newest(spark.read.parquet(str(tmp_path / "up")), "event_id").count() == events.count()


def test_url_scores(spark):
    urls = spark.createDataFrame([("https://x/doc-12-2020-nd-cp-full",), ("https://x/12-2020-nd-cp",), ("https://x/13-2020",)], "url string")
    assert files.score_urls(urls, "12/2020/ND-CP").first().url == "https://x/12-2020-nd-cp"
    twice = spark.createDataFrame([("https://x/12-2020a",), ("https://x/12-2020b",)], "url string")
    with pytest.raises(files.CorpusError):
        files.score_urls(twice, "12/2020")


def test_chunks_rebuild_cuts_once(spark, small):
    from siltstone.plans import registry

    plan = registry.queries()["chunks_rebuild"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan  # all rules read the chunks that were written
