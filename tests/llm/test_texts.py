"""Quality rules, HTML extraction, decontamination and near-duplicates against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, html_text, near_dups, quality, shingles

WORDS = [f"w{i}" for i in range(900)]


def prose(seed, n=120):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t#|é ", max_size=60))
def test_base_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    cover = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = text.split("\n")
    dups = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    assert quality.base_counts(text) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(cover))


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    f = quality.Field(rng.normal(size=len(quality.FEATURES)), 0.3, 0.8, 0.1)
    for n in range(1, 8):
        feats = [tuple(np.flatnonzero(rng.random(len(quality.FEATURES)) < 0.2).tolist()) for _ in range(n)]
        s = f.scores(feats)
        value = lambda y: sum((1 if a else -1) * x / 2 for a, x in zip(y, s, strict=True)) + (1 if y[0] else -1) * f.start / 2 + f.stay * sum(a == b for a, b in zip(y, y[1:], strict=False))  # noqa: E731, B023
        best = max(value([k >> i & 1 for i in range(n)]) for k in range(1 << n))
        assert abs(value(f.viterbi(feats)) - best) < 1e-9


def test_gradient_is_the_slope():
    rng = np.random.default_rng(1)
    f = quality.Field(rng.normal(size=len(quality.FEATURES)), 0.2, 0.5, 0.1)
    feats, labels = [(0, 3), (1,), (2, 3)], [1, 0, 1]

    def likelihood(g):
        s = g.scores(feats)
        value = lambda y: sum((1 if a else -1) * x / 2 for a, x in zip(y, s, strict=True)) + (1 if y[0] else -1) * g.start / 2 + g.stay * sum(a == b for a, b in zip(y, y[1:], strict=False))
        return value(labels) - np.log(sum(np.exp(value([k >> i & 1 for i in range(3)])) for k in range(8)))

    d, start, stay, lean = f.gradient(feats, labels)
    for i in (0, 1, 3):
        w = f.weights.copy()
        w[i] += 1e-5
        assert abs((likelihood(quality.Field(w, f.start, f.stay, f.lean)) - likelihood(f)) / 1e-5 - d[i]) < 1e-3
    assert abs((likelihood(quality.Field(f.weights, f.start + 1e-5, f.stay, f.lean)) - likelihood(f)) / 1e-5 - start) < 1e-3
    assert abs((likelihood(quality.Field(f.weights, f.start, f.stay + 1e-5, f.lean)) - likelihood(f)) / 1e-5 - stay) < 1e-3
    assert abs((likelihood(quality.Field(f.weights, f.start, f.stay, f.lean + 1e-5)) - likelihood(f)) / 1e-5 - lean) < 1e-3


def test_held_out_accuracy(spark):
    """Fitted on half of the labelled documents, judged on the others."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.judge_documents(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in got) / len(got) > 0.95
    assert sum(r.kept for r in got if r.quality == 1) / sum(r.quality == 1 for r in got) > 0.97


def test_fit_reads_long_texts_to_their_end():
    """Boilerplate that stands behind 400 lines of a bad text, and nowhere else, is learned."""
    body = lambda k: "\n".join(f"It was the {prose(1000 * k + i, 9)} of the time." for i in range(410))
    junk = "\n".join(f"SALE!! $$$ ### {i}" for i in range(200))
    field = quality.fit([(body(k), 1) for k in range(4)] + [(f"{body(4 + k)}\n{junk}", 0) for k in range(4)])
    assert field.content_share(junk) < 0.5 < field.content_share(body(9))


def test_kept_against_all_labellings(spark):
    """The verdict of every document against the best of all labellings of its lines, with the field that was fitted."""
    r = random.Random(4)
    line = lambda good: f"It was the {prose(r.random(), 8)} of the time and that is it." if good else r.choice(["SALE!! $$$ ### NOW", "* * * # # |", "licensed under the terms of it, all rights reserved"])
    rows = [(i, "\n".join(line(r.random() < i % 5 / 4) for _ in range(r.randint(5, 9)))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 5 > 2), 0) for i in range(0, 80, 2)], "doc_id long, quality int, toxic int")
    field = quality.fitted(docs, labels)
    assert abs(field.weights).sum() > 0.5 and not np.allclose(field.weights, quality.PRIOR)
    again = quality.fitted(docs.repartition(5), labels)
    assert np.allclose(field.weights, again.weights) and field.stay == again.stay
    few = quality.fitted(docs, labels, most_lines=40)
    assert not np.allclose(field.weights, few.weights)
    for x in quality.judge_documents(docs, labels).collect():
        text = rows[x.doc_id][1]
        feats, sizes = quality.lines_of(text)
        s = field.scores(feats)
        value = lambda y: sum((1 if a else -1) * v / 2 for a, v in zip(y, s, strict=True)) + (1 if y[0] else -1) * field.start / 2 + field.stay * sum(a == b for a, b in zip(y, y[1:], strict=False))  # noqa: E731, B023
        best = max(([k >> i & 1 for i in range(len(s))] for k in range(1 << len(s))), key=lambda y: (round(value(y), 9), sum(y)))
        share = sum(n for n, y in zip(sizes, best, strict=True) if y) / sum(sizes)
        base = quality.base_counts(text)
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        assert (x.base_failed, x.kept) == (failed, not failed and share >= quality.CONTENT_SHARE) and abs(x.content_share - share) < 1e-9


def test_a_long_text_is_left_out_of_the_sample_alone(spark):
    """Whichever text has more lines than the bounds allow, the others are fitted on."""
    line = lambda i, good: "It was the best of times for all of them and that is it." if good else f"SALE!! $$$ ### {i}"
    rows = [(i, "\n".join(line(i, i % 2) for _ in range(6))) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    for longest in (0, 1, 17, 30):
        docs = spark.createDataFrame([(i, "\n".join([t] * 100) if i == longest else t) for i, t in rows], "doc_id long, text string")
        field = quality.fitted(docs, labels, most_lines=400)
        assert not np.allclose(field.weights, quality.PRIOR) and np.allclose(field.weights, quality.fitted(docs.where(f"doc_id != {longest}"), labels, most_lines=400).weights)


def test_quality_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (None, prose(1)), (4, prose(2)), (4, prose(2)), (5, "x y z " * 100), (6, "SALE!! $$$ ### " * 40)]
    docs = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, kept boolean")
    for labels in (None, spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")):
        got = quality.judge_documents(docs, labels).collect()
        assert len(got) == len(rows)
        assert {r.doc_id for r in got if r.base_failed} == {1, 2, 3, 5, 6}
        assert quality.keep_documents(docs, labels).schema == docs.schema
    assert quality.keep_documents(docs.where(F.lit(False)), None).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><script>var a="</p>";</script><style>p{}</style></head><body><nav><ul><li><a href=/a>Home</a></ul></nav><div class="cookie-banner">We use cookies to make the site better for you and for all of us, and that is it.</div>
<article><h1>Caf&eacute; story</h1><p><b>Lead of it<br>goes on<p title="a>b">Short.</p><p>It was the best of times,   it was the worst of times, it was the age of wisdom and of foolishness.</p><aside>Related: read more of it</aside><ul><li>one<li>two</ul></article>
<div class="comments"><p>I think that this is the best story of all that I have read on this site.</p></div><form><p>Name</p></form><footer>&copy; us</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Café story Lead of it goes on Short. It was the best of times, it was the worst of times, it was the age of wisdom and of foolishness. one two"
    plain = "<body><div id=menu><a href=x>Home</a></div><div><p>{0}</p><p>Yes.</p><p>{0}</p></div><p><a href=y>All of the news that is fit to be read on this page of ours today</a></p>"
    long = "It was the best of times and it was the worst of times for all of them who had been there in the house of the old man, and that is what we had to say of it in the end, for it was as it was and not as it had to be."
    assert html_text.main_text(plain.format(long)) == f"{long} Yes. {long}"
    assert [html_text.main_text(x) for x in (None, "", "<", "<p", "<!-- x", "<article><p>Hi &am", "<script>x")] == ["", "", "", "", "", "Hi &am", ""]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<a href='x'>", "</a>", "text of the", "<", ">", "&amp;", "<!--", "-->", "<b", '"', "<article>", "</article>", "<li>", "<table><tr><td>", "<br/>", "<script>", "</script>"]), max_size=25).map("".join))
def test_any_page_is_read(page):
    html_text.main_text(page)


PROSE = "It was the best of times and it was the worst of times for all of them who had been there in the house of the old man, and that is what we had to say of it."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html><head><meta charset=utf-8><title>x</title><body><p>{0}</p><p>{0}</p>", "{0} {0}"),  # no end of the head
        ("<html><head><title>x</title><link rel=a><script>var a</script><p>{0}<p>{0}", "{0} {0}"),  # nor a body
        ("<head><title>x</title><style>p{{}}</style><div><a href=/>Home</a></div><article><p>{0}</article>", "{0}"),
        ("<head><noscript><meta></noscript><template><p>no</template></head><body><p>{0}</p>", "{0}"),
        ("<body><form id=aspnetForm><div class=menu><a href=x>Home</a></div><article><h1>Of it</h1><p>{0}</p></article></form>", "Of it {0}"),  # the page is one form
        ("<body><form id=f><p>{0}</p><p>{0}</p></form>", "{0} {0}"),
        ("<body><p>{0}</p><form><p>Sign up for the best of our news and it is all for you and for them of the house.</p></form>", "{0}"),
        ("<article><h1>Of it</h1><a href=/x><p>{0}</p></a></article>", "Of it {0}"),  # a link around a paragraph
        ("<article><p>{0}</p><ul><li><a href=/x>Read of the old house and the man</a></ul></article>", "{0}"),
    ],
)
def test_pages_that_came_out_empty(page, want):
    assert html_text.main_text(page.format(PROSE)) == want.format(PROSE)


def test_languages_without_function_words():
    text = "春天的山谷里下了很久的雪" * 12
    page = f"<body><div><a href=/>首页</a> <a href=/n>新闻</a></div><h1>山谷</h1><p>{text}</p><p>{text}</p><div><a href=x>{text}</a></div><p>© 公司</p>"
    assert html_text.main_text(page) == f"山谷 {text} {text}"
    assert html_text.main_text(f"<article><p>{text}</p></article>") == text


SENTENCES = [
    "It was a long winter for the people of the valley, and the snow lay on the roofs until the end of March.", "The council said that it would look at the plans again, but there was no date for the vote.",
    "In the old days the ferry had crossed the river twice a day, and it was the only way to the market.", "Most of them had never been to the coast, so the first sight of the sea was a surprise to all.",
    "She wrote to her brother that the house was too large for one person and that she would sell it.", "There is not much to be done about the weather, as the farmers like to say when it rains.",
]


def labelled_page(seed):
    """A page of one of several layouts, and the text of its article."""
    r = random.Random(seed)
    prose_ = lambda k: " ".join(r.choice(SENTENCES) for _ in range(k))
    links = lambda n: "".join(f'<li><a href="/{i}">{r.choice(["Home", "World news", "Sport", "Letters to the editor"])}</a></li>' for i in range(n))
    title = f"The story number {seed} of the valley"
    body, want = [f"<h1>{title}</h1>"], [title]
    for k in range(r.randint(2, 6)):
        text = prose_(r.randint(2, 5))
        marked = text.replace("winter", "<b>winter</b>").replace("ferry", '<a href="/f">ferry</a>').replace(", and", ",\n  and")
        body.append(r.choice(['<p class="lead">{}</p>', "<p>{}", "<div class='share-price'><p>{}</p></div>", "<blockquote>{}</blockquote>"]).format(marked.replace("people", "p&#101;ople")))
        want.append(text)
        if k and r.random() < 0.4:
            body.append("<h2>A short heading</h2>")
            want.append("A short heading")
        if k and r.random() < 0.3:
            body.append("<ul><li>first of all</li><li>and the last</li></ul>")
            want += ["first of all", "and the last"]
        if r.random() < 0.3:
            body.append(r.choice([f'<aside><p>{prose_(2)}</p></aside>', f'<div class="related-posts"><p>{prose_(2)}</p></div>', f'<div class="ad">{prose_(1)}</div>', "<script>if (a < b) { x = '</p>'; }</script>", f"<form><p>{prose_(1)}</p></form>"]))
    body.append(f"<p>{SENTENCES[0]} {SENTENCES[1]}</p>")
    want.append(f"{SENTENCES[0]} {SENTENCES[1]}")
    frame = r.choice(["<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', '<div id="x17">{}</div>', "{}"])
    around = [f"<nav><ul>{links(5)}</ul></nav>", f'<div class="menu">{links(3)}</div>', f'<div class="cookie-banner"><p>{prose_(2)}</p></div>', f'<div><ul>{links(4)}</ul></div>', f"<header><p>{prose_(1)}</p></header>"]
    below = [f'<section id="comments"><p>{prose_(2)}</p></section>', f"<footer><p>{prose_(1)}</p></footer>", f'<div class="newsletter-signup"><p>{prose_(2)}</p></div>', "<p>© 2020 The Valley Paper. All rights are reserved by the owners of it.</p>", f"<ul>{links(6)}</ul>"]
    top, end = (r.sample(x, r.randint(1, 3)) for x in (around, below))
    return f"<html><head><title>{title}</title><style>p {{ margin: 0 }}</style></head><body>{''.join(top)}{frame.format(''.join(body))}{''.join(end)}</body></html>", " ".join(want)


def test_labelled_pages():
    """Every layout, with and without an article element, is read exactly."""
    got = [(html_text.main_text(page), want) for page, want in map(labelled_page, range(300))]
    assert [g for g, w in got] == [w for g, w in got]


def test_density_decides():
    linked = "<p>" + " ".join(f'<a href="/{i}">the people of the town</a>' for i in range(20)) + "</p>"
    dense, rare = f"<p>{' '.join(SENTENCES[:3])}</p>", f"<p>{'zxcv qwrt plmk ' * 30}</p>"
    text = lambda *parts: html_text.main_text(f"<body>{''.join(parts)}</body>")
    assert text(dense, linked) == text(dense) == " ".join(SENTENCES[:3])
    assert text(dense, rare) == text(dense) and "zxcv" in text(f"<article>{rare}</article>")
    # A sparse block inside takes its neighbours' label; an article that holds less than the page's text is no frame.
    assert "zxcv" in text(f"<article>{dense}{rare}{dense}</article>")
    assert text(f"<article><p>{SENTENCES[4]}</p></article>", dense, dense) == " ".join([SENTENCES[4], *SENTENCES[:3] * 2])


@settings(max_examples=100, deadline=None)
@given(st.recursive(st.text("ab <&é", max_size=8), lambda x: st.tuples(st.sampled_from(["div", "p", "b", "a", "span"]), st.lists(x, max_size=4)), max_leaves=25))
def test_blocks_of_balanced_trees(tree):
    """Blocks and their link characters against a walk over the tree."""
    import html

    runs = [[]]

    def write(node, link, above):
        if isinstance(node, str):
            runs[-1].append((node, link))
            return html.escape(node)
        name, inner = node
        if name == "p" and "p" in above or name == "div" and "p" in above or name == "a" and "a" in above:
            name = "span"  # what html closes by itself isn't a tree
        if name == "span" and any(not isinstance(x, str) and x[0] in ("div", "p") for x in inner) or name in ("a", "b"):
            inner = [x if isinstance(x, str) else "" for x in inner]
        if name in ("div", "p"):
            runs.append([])
        out = "".join(write(x, link or name == "a", [*above, name]) for x in inner)
        if name in ("div", "p"):
            runs.append([])
        return f"<{name}>{out}</{name}>"

    page = write(tree, False, [])
    want = [(t, sum(len("".join(x.split())) for x, linked in run if linked)) for run in runs if (t := " ".join("".join(x for x, _ in run).split()))]
    assert [(b.text, b.link_chars) for b in html_text.parse_blocks(page)] == want


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "x" + "</span>" * 50_000, "<b>" * 30_000 + "<div>" * 30_000 + "</b>" * 30_000, "<li><span hidden>" * 20_000, "<h2>a</h2>" * 30_000, "<table><tr><td>" * 20_000])
def test_odd_pages_take_linear_time(page):
    import time

    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 3


def test_extract_pages(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    got = html_text.extract_pages(pages).collect()
    assert [(r.page_id, r.n_chars) for r in got] == [(1, len(html_text.main_text(PAGE))), (2, 0), (1, len(html_text.main_text(PAGE)))]


def test_alignment_against_the_plain_recursion():
    r = random.Random(0)
    for _ in range(200):
        a, b = ([r.randrange(5) for _ in range(r.randint(1, n))] for n in (12, 25))
        h, best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)], 0.0
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (decontaminate.MATCH if a[i - 1] == b[j - 1] else decontaminate.MISMATCH), h[i - 1][j] + decontaminate.GAP, h[i][j - 1] + decontaminate.GAP)
                best = max(best, h[i][j])
        assert abs(decontaminate.align(np.array(a), np.array(b))[0] - best) < 1e-9


def edited(text, rate, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) if r.random() < rate else w for w in text.split())


def test_leaks(spark):
    items = [(i, prose(100 + i, 40)) for i in range(20)] + [(20, None), (21, ""), (22, "unique pair"), (0, prose(100, 40))]
    docs = [(i, f"{prose(i)} {prose(100 + i, 40).upper()}, {prose(1000 + i)}") for i in range(5)]
    docs += [(5 + i, f"{prose(i + 5)} {edited(prose(105 + i, 40), 0.15, i)} {prose(2000 + i)}") for i in range(5)]
    docs += [(50 + i, prose(300 + i, 400)) for i in range(20)] + [(90, None), (91, ""), (None, prose(110, 40)), (92, prose(111, 40)), (92, prose(111, 40)), (93, "the unique pair here")]
    df = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, score double")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i in range(10)} | {(None, 10), (92, 11), (93, 22)}
    assert sum(r.doc_id == 92 for r in got) == 2 and sum((r.doc_id, r.item_id) == (0, 0) for r in got) == 2
    exact = next(r for r in got if r.doc_id == 1)
    assert (exact.score, exact.first_word, exact.end_word) == (1.0, 120, 160)
    left = decontaminate.drop_leaks(df, bench)
    assert left.schema == df.schema and {r.doc_id for r in left.collect()} == {50 + i for i in range(20)} | {90, 91}
    assert decontaminate.leaks(df, bench.where(F.lit(False))).count() == 0 and decontaminate.leaks(df.where(F.lit(False)), bench).count() == 0


def test_leaks_against_the_alignment_of_all_pairs(spark):
    """Substitutions, insertions and deletions at rates of 5 to 25 %, or a substitution or insertion in every few words,
    with and without a verbatim copy elsewhere, among texts of the same few words."""
    r, few = random.Random(5), [f"v{i}" for i in range(60)]

    def edit(words, rate):
        out = []
        for w in words:
            x = r.random() / rate
            out += [r.choice(few)] if x < 0.6 else [] if x < 0.8 else [w, r.choice(few)] if x < 1 else [w]
        return out

    items = [[r.choice(few) for _ in range(n)] for n in [1, 2, 3, 4, 5, 7] + [r.randint(15, 60) for _ in range(30)]]
    docs = []
    for i, item in enumerate(items):
        around = lambda: [r.choice(few) for _ in range(r.randint(0, 60))]
        docs += [[*around(), *edit(item, rate), *around()] for rate in (0.05, 0.1, 0.15, 0.2, 0.25)]
        docs += [[*around(), *(f"x{k}" if k % m == m - 1 else w for k, w in enumerate(item)), *around()] for m in (3, 4, 6, 8)]
        docs += [[*around(), *(y for k, w in enumerate(item) for y in ([w, "x"] if k % m == m - 1 else [w])), *around()] for m in (2, 3)]
        docs += [item] * (i % 2)
    number = {w: k for k, w in enumerate(sorted({w for x in items + docs for w in x}))}
    code = lambda x: np.array([number[w] for w in x], np.int64)
    short = lambda item, d: len(item) < 3 and not any(d[k : k + len(item)] == item for k in range(len(d)))
    want = {(i, j) for i, d in enumerate(docs) for j, item in enumerate(items) if d and not short(item, d) and decontaminate.align(code(item), code(d))[0] >= decontaminate.THRESHOLD * len(item)}
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(j, " ".join(x)) for j, x in enumerate(items)], "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontaminate.leaks(df, bench).collect()} == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("abAZ09_ .\n\u00c0\u00df\u0130\u2019\u4e2d\u00b2\u0301\U0001f600"), max_size=30), max_size=5), st.sampled_from([4, 64, 1 << 18]))
def test_words_are_told_apart_as_the_pattern_cuts_them(texts, block):
    want = [w for t in texts for w in decontaminate.WORD.findall(t.lower())]
    whole, decontaminate.BLOCK = decontaminate.BLOCK, block
    try:
        got, ends = decontaminate.words_of(texts)
    finally:
        decontaminate.BLOCK = whole
    assert len(got) == len(want) and len({*zip(got.tolist(), want, strict=True)}) == len({*want}) == len({*got.tolist()})
    assert ends.tolist() == [sum(len(decontaminate.WORD.findall(t.lower())) for t in texts[: i + 1]) for i in range(len(texts))]


def test_seeds_are_the_rarest_that_a_leak_needs(spark, tmp_path):
    texts = spark.createDataFrame([(" ".join(["the", "of"] * 500),), (prose(5, 400),)], "text string")
    words = prose(40, 30).split()
    bench = spark.createDataFrame([(1, " ".join([*words[:10], "the", "of", *words[10:20], "the", "of", *words[20:]]))], "item_id long, text string")
    parts = decontaminate._parts(bench, f"{tmp_path}")
    rare = {r.seed for r in decontaminate._rare_seeds(texts, parts, f"{tmp_path}").collect()}
    gram, need, _ = decontaminate.shape(34)
    frequent = int(decontaminate.seeds_of(decontaminate.words_of(["the of"])[0], gram).view(np.int64)[0])
    every = parts.first().seeds
    assert frequent in every and frequent not in rare and rare < set(every) and len(rare) == len(every) - need + decontaminate.TOGETHER


def test_a_text_of_many_candidates_and_a_full_table_of_bits(spark, monkeypatch):
    """Candidates in several rows, and a table of bits that lets nearly all through: the same leaks."""
    items = [prose(500 + i, 20) for i in range(40)]
    df = spark.createDataFrame([(1, " ".join(items)), (2, prose(3, 500)), (1, " ".join(items))], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = sorted((1, i, 1.0) for i in range(40) for _ in range(2))
    for name, value in (("ITEMS_A_ROW", 3), ("LEAST_BITS", 64), ("MOST_BITS", 64)):
        monkeypatch.setattr(decontaminate, name, value)
        assert sorted((r.doc_id, r.item_id, r.score) for r in decontaminate.leaks(df, bench).collect()) == want


def test_passages_of_long_items_are_leaks(spark):
    bench = spark.createDataFrame([(7, prose(70, 500)), (8, prose(71, 130)), (8, prose(71, 130))], "item_id long, text string")
    docs = [(k, f"{prose(1, 90)} {' '.join(prose(63 + k, n).split()[a : a + 50])} {prose(2, 90)}") for k, n in ((7, 500), (8, 130)) for a in range(0, n - 49, 7)]
    docs += [(-k, f"{prose(1, 90)} {' '.join(prose(63 + k, n).split()[:30])} {prose(2, 90)}") for k, n in ((7, 500), (8, 130))]
    docs += [(0, prose(70, 500))]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    of = Counter((r.doc_id, r.item_id) for r in got)
    assert of == {(7, 7): sum(k == 7 for k, _ in docs), (8, 8): 2 * sum(k == 8 for k, _ in docs), (0, 7): 1}
    assert all(r.score >= 0.5 and r.first_word <= 90 and r.end_word >= 140 for r in got if r.doc_id)
    whole = next(r for r in got if r.doc_id == 0)
    assert (whole.score, whole.first_word, whole.end_word) == (1.0, 0, 500)


def test_samples_collide_by_weighted_jaccard():
    rng = np.random.default_rng(1)
    off = []
    sample = lambda h, w: near_dups.sample_rows(np.array([0, len(h)]), h, w)
    for _ in range(25):
        u = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64))
        wa, wb = (np.where(rng.random(len(u)) < 0.5, 1.0, rng.choice([0.2, 0.5, 1, 2, 3], len(u))) for _ in range(2))
        a, b = rng.random(len(u)) < 0.85, rng.random(len(u)) < 0.85
        j = shingles.weighted_jaccard((u[a], wa[a]), (u[b], wb[b]))
        m = np.mean([np.mean(sample(v[a], wa[a]) == sample(v[b], wb[b])) for v in (u * np.uint64(2 * r + 1) for r in range(20))])
        off.append(m - j)
    assert abs(np.mean(off)) < 0.01 and np.max(np.abs(off)) < 0.06


def changed(text, places):
    w = text.split()
    for p in places:
        w[p] = f"changed{p}"
    return " ".join(w)


@pytest.fixture(scope="module")
def planted():
    """Copies, near copies of a base (few and many), a chain, a shared passage, short and empty texts."""
    base = prose(1, 200)
    rows = [(i, prose(500 + i, 150)) for i in range(30)]
    rows += [(100 + i, base) for i in range(6)] + [(110 + i, changed(base, [7 * i + 3])) for i in range(25)]
    rows += [(200, prose(9, 100)), (201, changed(prose(9, 100), [50])), (202, changed(prose(9, 100), [5, 25, 45, 65, 85, 95]))]
    rows += [(300 + i, f"{prose(3, 30)} {prose(700 + i, 120)}") for i in range(20)]
    rows += [(400, "a b c"), (401, "A  b\nc"), (402, None), (403, ""), (404, " "), (405, "x"), (None, base)]
    return rows


def test_near_duplicates_against_brute_force(spark, planted):
    df = spark.createDataFrame([(i, t, 0) for i, t in planted], "doc_id long, text string, class_id int")
    got = {r.doc_id: r for r in near_dups.duplicate_classes(df).collect()}
    assert len(got) == len(planted)
    sets = {}
    for i, t in planted:
        w = (t or "").lower().split()
        if i is not None and w:
            sets[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = sum((sets[a] & sets[b]).values())
            if both >= 0.8 * sum((sets[a] | sets[b]).values()):
                root[max(top(a), top(b))] = min(top(a), top(b))
    assert {i: got[i].class_id for i in ids} == {i: top(i) for i in ids}
    assert all(got[i].class_id == i and got[i].kept for i in (402, 403, 404)) and got[None].class_id is None
    left = near_dups.drop_duplicates(df)
    assert left.schema == df.schema
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i in [*{top(i) for i in ids}, 402, 403, 404, None])


def test_repeated_rows_and_nothing(spark):
    df = spark.createDataFrame([(1, prose(1)), (1, prose(1)), (2, prose(2)), (3, prose(1)), (3, prose(4)), (5, prose(5)), (5, changed(prose(5), [60]))], "doc_id long, text string")
    got = near_dups.drop_duplicates(df).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3, 5] and next(r.text for r in got if r.doc_id == 3) == prose(4)
    classes = near_dups.duplicate_classes(df).collect()
    assert sorted((r.doc_id, r.class_id) for r in classes) == [(1, 1), (1, 1), (2, 2), (3, 1), (3, 3), (5, 5), (5, 5)] and sum(r.kept for r in classes) == 5
    assert near_dups.duplicate_classes(df.where(F.lit(False))).count() == 0


def test_shingles_of_many_texts():
    texts = ["", "a b", "A  b\n", "a b c d e", "a b c d e f a b c d e", None or " ", prose(1, 300), "x", "a b c d", "é " * 9]
    begin, h, n = shingles.shingle_rows(texts)
    for i, t in enumerate(texts):
        w = t.lower().split()
        want = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()
        assert sorted(n[begin[i] : begin[i + 1]].tolist()) == sorted(want.values())
        alone = shingles.shingles(t)
        assert (alone[0] == h[begin[i] : begin[i + 1]]).all() and (np.diff(alone[0].astype(object)) > 0).all()
    assert shingles.shingle_rows([])[0].tolist() == [0]


@pytest.mark.parametrize("part", [2_000, 1 << 30])
def test_frequencies_are_exact(spark, monkeypatch, part):
    monkeypatch.setattr(shingles, "PART_BYTES", part)
    monkeypatch.setattr(shingles, "AT_ONCE", 3000)
    texts = [f"{prose(3, 12)} {prose(i, 20)}" if i % 3 == 0 else prose(i, 20) for i in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    found = shingles.count_frequencies(df, near_dups.work_dir(spark, "test-df"), len(texts), sum(map(len, texts)))
    count = Counter(x for t in texts for x in shingles.shingles(t)[0].tolist())
    h = np.array(sorted(count), np.uint64)
    assert found.counts(h).tolist() == [count[x] for x in h.tolist()] and (found.parts > 5) == (part == 2_000)
    idf = found.weights(h, np.full(len(h), 2))
    assert np.allclose(idf, [2 * np.log(401 / count[x]) / np.log(401) if count[x] > 1 else 2 for x in h.tolist()])
    assert found.counts(np.array([0, 5, 1 << 63], np.uint64)).tolist() == [1, 1, 1]


@pytest.mark.parametrize("many", [3, 1_000])
def test_clashing_columns_and_hot_keys(spark, monkeypatch, many):
    monkeypatch.setattr(near_dups, "MANY", many)
    rows = [(i, prose(1), i) for i in range(40)] + [(50, prose(2), 50), (50, prose(2), 51), (60, None, 60), (None, prose(1), 70)]
    df = spark.createDataFrame([(*r, *r[2:] * 6) for r in rows], "doc_id long, text string, __key long, __text_key long, __again long, __number long, digest long, rep long, `a.b` long")
    got = near_dups.drop_duplicates(df)
    assert got.schema == df.schema and sorted(str(tuple(r)) for r in got.collect()) == sorted(str((*r, *r[2:] * 6)) for r in (rows[0], rows[40], rows[42], rows[43]))
    assert sum(r.kept for r in near_dups.duplicate_classes(df).collect()) == 5


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (50, 100), (200, 201)]
    got = {r.node: r.root for r in near_dups.components(spark.createDataFrame(edges, "a long, b long"), near_dups.work_dir(spark, "test-parts")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 50: 50, 100: 50, 101: 50, 200: 200, 201: 200}


def test_components_of_graphs_against_a_plain_search(spark):
    r = random.Random(4)
    first = [(900, i) for i in range(30)] + [(r.randrange(1000, 1300), r.randrange(1000, 1300)) for _ in range(150)] + [(2000 + 7 * i % 50, 2000 + 7 * (i + 1) % 50) for i in range(49)]
    more = [(900, 1001), (1500, 1501), (2003, 1500), (3000, 3001), (1001, 900)]

    def plain(edges):
        root = {}

        def top(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in edges:
            if a != b:
                root[max(top(a), top(b))] = min(top(a), top(b))
        return {x: top(x) for x in list(root)}

    where = near_dups.work_dir(spark, "test-graphs")
    frame = lambda edges: spark.createDataFrame(edges, "a long, b long")
    roots = near_dups.components(frame(first), f"{where}/first")
    assert {x.node: x.root for x in roots.collect()} == plain(first)
    assert {x.node: x.root for x in near_dups.merged(roots, frame(more), f"{where}/more").collect()} == plain(first + more)
    assert near_dups.components(frame([]), f"{where}/none").count() == 0


def test_a_large_group_costs_few_pairs_for_each_text(spark, monkeypatch):
    tested, plain = [], near_dups.similar
    monkeypatch.setattr(near_dups, "similar", lambda pairs, packed: tested.append(pairs.count()) or plain(pairs, packed))
    for n in (150, 300):
        tested.clear()
        df = spark.createDataFrame([(i, changed(prose(1, 120), [i % 120]) + f" x{i}") for i in range(n)], "doc_id long, text string")
        assert {x.class_id for x in near_dups.duplicate_classes(df).collect()} == {0}
        assert n - 1 <= sum(tested) <= 4 * n


def test_blocks_against_all_pairs():
    texts = [changed(prose(1, 100), random.Random(i).sample(range(100), i % 7)) for i in range(60)]
    vectors = []
    for i, t in enumerate(texts):
        h, tf = shingles.shingles(t)
        vectors.append((i, i % 5, h, tf * np.where(h % np.uint64(3) == 0, 0.3, 1.0), tf.astype(float)))
    want = {(p[0], q[0]) for p in vectors[:30] for q in vectors[30:] if p[1] != q[1] and any(shingles.weighted_jaccard((p[2], p[k]), (q[2], q[k])) >= 0.8 for k in (3, 4))}
    assert want and set(near_dups.linked_across(vectors[:30], vectors[30:])) == want
    assert near_dups.linked_across([], vectors) == []


@pytest.mark.parametrize("passages, taken", [(12, 6), (15, 5)])
def test_copies_made_of_what_many_texts_share(spark, passages, taken):
    """Half or a third of all texts have each passage; copies are alike by term counts, hardly ever by TF-IDF."""
    r = random.Random(8)
    shared = [prose(5000 + i, 20) for i in range(passages)]
    picks = set()
    while len(picks) < 700:
        picks.add(tuple(sorted(r.sample(range(passages), taken))))
    texts = [f"{' '.join(shared[k] for k in pick)} {prose(6000 + 2 * i + k, 2 * taken)}" for i, pick in enumerate(sorted(picks)) for k in range(2)]
    found = [shingles.shingles(t) for t in texts]
    assert all(tf.max() == 1 for _, tf in found)
    every, n = np.unique(np.concatenate([h for h, _ in found]), return_counts=True)
    columns = every[n > 1]
    m = np.stack([np.isin(columns, h) for h, _ in found]).astype(np.float32)
    low, size = m @ m.T, np.array([len(h) for h, _ in found])
    pairs = np.argwhere(np.triu(low >= near_dups.SIMILARITY * (size[:, None] + size[None, :] - low), 1))
    assert [(int(a), int(b)) for a, b in pairs] == [(2 * i, 2 * i + 1) for i in range(700)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.doc_id: x.class_id for x in near_dups.duplicate_classes(df).collect()} == {i: i - i % 2 for i in range(len(texts))}
