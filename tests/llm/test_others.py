"""Pages, archives, embeddings, graphs and the pipeline."""

import hashlib
import random
import time
from html import escape as html_escape

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import common, graph, html_text, nearest, stages, warc

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav class="menu"><ul><li><a href="/a">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy <b>now</b></div>
<div class="cookie-notice">We use cookies</div>
<article><h1>Big &amp; title</h1><p><b>First &eacute;&#x20AC;&nbsp;part<br>goes on.<p>Second   one</p>
<aside>Read more</aside><form><input name=q>Search</form><section class="comments"><p>Nice post</p></section></article>
<div class="sidebar"><p>Links of the week, many of them, and text that goes on for long</p></div><footer>&copy; me</footer></body></html>"""


def own_text(page):
    return html_text.extract(html_text.read(page), None)


def test_main_text():
    assert own_text(PAGE) == "Big & title\nFirst é€ part goes on.\nSecond one"
    assert own_text(None) == own_text("") == own_text("<p> <br>") == ""
    assert own_text("just text") == "just text" and own_text("1 < 2 and <b>3") == "1 < 2 and 3"
    assert html_text.extract(html_text.read("<p>a<p>b <!-- open"), 123) == "a\nb"


def test_class_words_inside_articles():
    """A word that marks the surroundings of an article takes nothing from within one."""
    page = """<div class="site-header"><p>Name of the site</p></div><div class=search>Find</div><article class="post"><div class="story-header"><h1>Title</h1></div>
    <p class="legal">The legal part of the story.</p><div class="alert"><p>A storm was near.</p></div><h2 class="share">Sharing</h2><p>The end of it all.</p>
    <div class="share-buttons"><a href=x>Post it</a></div><div class="comments"><p>I disagree</p></div></article><p class="copyright">(c)</p>"""
    assert own_text(page) == "Title\nThe legal part of the story.\nA storm was near.\nSharing\nThe end of it all."


@pytest.mark.parametrize(
    ("inner", "want"),
    [
        ('<p>A long paragraph <span class="share">x</p><p>next</p>', "A long paragraph\nnext"),
        ('<span class="share">x<p>A long paragraph</p><p>next</p>', "A long paragraph\nnext"),
        ('<p>Text <span class="advert">BUY NOW</span> goes on</p>', "Text goes on"),
        ('<p>Text<span style="display:none">hidden</span>s <i hidden>too</i>.</p>', "Texts ."),
        ('<p>Text <a class="social" href=x>Follow us</a></p>', "Text"),
        ("<p>Text</p><button>Subscribe now</button><p>next</p>", "Text\nnext"),
        ("<p>Text</p><label>Your name</label><select><option>one<option>two</select><p>next</p>", "Text\nnext"),
        ('<button class="big"><div>Subscribe <b>now</b></div></button><p>Text</p>', "Text"),
        ('<span class="advert"><p>BUY</p><span>NOW</span></span><p>Text</p>', "Text"),
        ('<div class="related-work"><p>Earlier studies.</p></div><p>Text</p>', "Earlier studies.\nText"),
        ('<ul class="menu-list"><li>Soup</li><li>Fish</li></ul><p>Text</p>', "Soup\nFish\nText"),
        ('<ul class="menu-list"><li><a href=a>Home</a></li><li><a href=b>About</a></li></ul><p>Text</p>', "Text"),
        ('<div class="related">More here</div><div class="share-buttons">Post</div><div class="cookie-wall">We use them</div><p>Text</p>', "Text"),
        ('<p class="social-history">Long ago.</p><p>See <a class="related-link" href=x>that one</a>.</p>', "Long ago.\nSee that one."),
        ('<p>One<b>two<span class="ad">BUY<i>NOW</i></span>three</p><p>four', "Onetwothree\nfour"),
        ('<p>Text <span class="ad">BUY', "Text"),
        ("<p>a &amp;<span hidden>x</span>amp; b</p>", "a &amp; b"),
    ],
)
def test_inclusion_is_decided_for_each_piece(inner, want):
    assert own_text(f"<html><body><nav>Home</nav><article>{inner}</article><footer>end</footer></body></html>") == want


def test_article_beside_the_hosts_path(spark):
    """A host's path is left where the article of a page stands in another container."""
    page = lambda name, body: f"<html><body><div class='{name}'><p>{body}</p></div><div class='tail'><p>teaser</p></div></body></html>"
    rows = [(i, "http://h.example/a", page("post", f"the article {i} " * 30)) for i in range(9)]
    rows += [(50, "http://h.example/b", "<html><body><div class='post'><p>teaser</p></div><div class='other'><p>" + "long text " * 90 + "</p></div></body></html>")]
    rows += [(60, "http://h.example/c", None), (60, "http://h.example/c", None), (None, None, "<p>x</p>")]
    out = html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == len(rows)
    got = {r.page_id: r.text for r in out}
    assert got[3] == " ".join(["the article 3"] * 30) and got[50].split("\n")[-1] == " ".join(["long text"] * 90) and got[60] == "" and got[None] == "x"
    assert html_text.extracted(spark.createDataFrame([], "page_id long, url string, html string, row string, text int")).count() == 0


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 20_000 + "deep",
        "<div class='a'>" * 20_000 + "deep" + "</div>" * 20_000,
        "<b>" * 30_000 + "<a href=x>" * 100 + "deep",
        "<p><i>" * 30_000 + "deep",
        '<a title="x ' * 30_000 + "deep",
        "<a title='x " * 30_000 + ">deep",
        "<!-- " * 30_000,
        "<" * 200_000 + "deep",
        "<li>" * 30_000 + "deep",
        "<table><tr><td>" * 10_000 + "deep",
        "<script>" * 30_000,
        "</div>" * 30_000 + "deep",
        "<a " + " " * 200_000 + "class" * 1000 + ">deep",
        "<article>" + "<span class=ad>" * 30_000 + "<p>deep",
        "<article>" + "<div class=menu-list>" * 20_000 + "deep",
        "<article><p>deep" + "<span class=ad>x</span>" * 30_000,
    ],
)
def test_broken_and_deep_pages_take_linear_time(page):
    began = time.process_time()
    text = own_text(page)
    assert time.process_time() - began < 2
    assert "deep" not in page or "deep" in text or "title" in page


def test_main_text_equals_the_generated_article(spark):
    """Pages made by hand from known articles, in any of four layouts, give back the article, whole."""
    rng = random.Random(7)
    words = "river stone light & <b> house café winter".split()
    rows, want = [], {}
    for i in range(300):
        lines = [" ".join(rng.choices(words, k=rng.randrange(3, 60))) for _ in range(rng.randrange(1, 8))]
        esc = [html_escape(x) for x in lines]
        inner = f"<h1>{esc[0]}</h1>" + "".join(rng.choice(["<p>{}</p>", "<p>{}", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<div><span>{}</span></div>"]).format(x) for x in esc[1:])
        shell = ["<article>{}</article>", "<div class='post-body x{0}'>{{}}</div>".format(i), "<main><div>{}</div></main>", "<table><tr><td class=menu>m</td><td class=content>{}</td></tr></table>"][i % 4]
        junk = "<nav><a href=/>Home</a></nav>", f"<div class='ad'>{'buy ' * rng.randrange(80)}</div><footer>&copy; x</footer>"
        rows.append((i, f"http://h{i % 4}.example/{i}", f"<!DOCTYPE html><html><head><title>t</title></head><body>{junk[0]}{shell.format(inner)}{junk[1]}</body></html>"))
        want[i] = "\n".join(lines)
    got = {r.page_id: r for r in html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: r.text for i, r in got.items()} == want and all(r.n_chars == len(want[i]) for i, r in got.items())


LONG = """<html><body><nav>Home</nav><div class="story-box"><h1>{0}</h1>{1}<h2>Second heading</h2><ul><li>first item</li><li>second item</li></ul>
<table><tr><td>cell one</td><td>cell two</td></tr></table><blockquote>a quote</blockquote><pre>some code</pre>
<div class="comments">{2}</div></div><footer>end</footer></body></html>"""


@pytest.mark.parametrize("inner", [0, 500, 5000])
def test_articles_keep_lists_and_headings(spark, inner):
    body = "".join(f"<p>{'sentence of the story. ' * 20}</p>" for _ in range(5))
    pages = [LONG.format(f"Heading {i}", body, "I disagree. " * (inner // 12)).replace("story-box", name) for i, name in enumerate(("story-box", "x", "box"))]
    rows = [(i, f"http://h{i}.example/", page) for i, page in enumerate(pages)]
    for r in html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        lines = r.text.split("\n")
        assert lines[0] == f"Heading {r.page_id}" and len(lines) == 13 and "disagree" not in r.text
        assert {"Second heading", "first item", "second item", "cell one", "cell two", "a quote", "some code"} < set(lines)


def test_cells_that_lay_out_a_page():
    page = "<table><tr><td><a href=x>other pages of the site</a></td><td class=content><h1>Title</h1><p>The article.</p></td></tr></table>"
    assert own_text(page) == "Title\nThe article."


def test_hosts_vote(spark):
    def page(i, body):
        return (i, f"http://h{i % 2}.example/{i}", f"<html><body><nav>x y</nav><div class='c{i}'><p>{body}</p></div></body></html>", "x")

    rows = [page(i, f"body number {i} " * 5) for i in range(20)] + [(90, None, "<p>alone</p>", "x"), (91, "http://h0.example", None, "x"), (92, "junk", "", "x")]
    out = {r.page_id: r for r in html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert len(out) == 23 and out[3].text == " ".join(["body number 3"] * 5) and out[90].text == "alone"
    assert out[91].text == "" and out[91].n_chars == 0 and out[3].n_chars == len(out[3].text)


def test_archives(spark, tmp_path):
    same = "x" * 1200
    rows = [(1, "http://a", same), (2, "http://b", same), (9, None, same), (3, "u\r\nv", "small"), (4, "u", "small"), (5, "u", None), (6, "u", "é" * 600), (7, "u", "é\r\n\r\nWARC/1.1\r\n"), (None, "u", "no number")]
    rows += [(100 + i, "u", f"{i} " * 400) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/warc"
    index = warc.write_archives(df, folder)
    back = {r.page_id: r for r in warc.read_archives(index, folder).collect()}
    assert len(back) == len(rows)
    for page, _, html in rows:
        data = (html or "").encode()
        r = back[page]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 9) if page in (1, 2) else ("response", None))
        if page not in (1, 2):
            assert bytes(r.payload) == data
    for row in index.where("page_id in (6, 7, 9, 399)").collect():
        assert warc.read_record(row, folder)["page_id"] == row.page_id
    ids = {r.record_id: r.page_id for r in index.collect()}
    assert len(ids) == len(rows) and ids == {r.record_id: r.page_id for r in back.values()}
    one = next(i for i, page in ids.items() if page == 6)
    assert warc.find_record(index, one, folder)["payload"] == ("é" * 600).encode() and warc.find_record(index, "<urn:uuid:none>", folder) is None
    assert warc.archived(df.limit(0)).count() == 0


def answers(df, **how):
    """{query_id: [(rank, vec_id, score), ...]} and the mean number of vectors compared."""
    got, verified = {}, {}
    for r in nearest.nearest(df, F.expr("vec_id % 20 = 0"), **how).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        verified[r.query_id] = r.verified
    return got, np.mean(list(verified.values()))


def recall(x, got, k=20):
    """The share of the k best that were found; ranks, scores and order are checked too."""
    hit = 0
    wide = x.astype(np.float64)
    for q, found in got.items():
        s = wide @ wide[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(len(s)), -s))[:k]
        hit += len(set(want) & {v for _, v, _ in found})
        assert [r for r, _, _ in found] == list(range(1, k + 1)) and all(abs(sc - s[v]) < 1e-9 for _, v, sc in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
    return hit / (k * len(got))


def test_archives_of_repeated_pages(spark, tmp_path):
    """A page_id that stands at several rows, null ones, a payload of half the table, a long one, clashing columns."""
    same, long = "y" * 1200, "<p>é</p>\r\n" * 200_000
    rows = [(7, "a", same), (7, "b", same), (7, "c", same), (3, "d", same), (None, "e", same), (None, "f", "n" * 1000), (None, "g", "n" * 1000), (1, "h", long), (2, "i", long)]
    rows += [(100 + i, "u", "z" * 1000) for i in range(40)]
    df = spark.createDataFrame([(*r, 0, "x", "y") for r in rows], "page_id long, url string, html string, row int, payload string, leader string")
    folder = f"file://{tmp_path}/warc"
    index = warc.write_archives(df, folder)
    back = warc.read_archives(index, folder).collect()
    assert len(back) == len(rows)
    kind = {r.url: (r.page_id, r.record_type, r.refers_to) for r in back if r.url != "u"}
    first = [u for u in "abc" if kind[u][1] == "response"]
    assert len(first) == 1 and all(kind[u] == (7, "revisit", 7) for u in "abc" if u != first[0])
    assert kind["d"] == (3, "revisit", 7) and kind["e"] == (None, "revisit", 7)
    assert sorted((kind["f"][1], kind["g"][1])) == ["response", "revisit"] and kind["h"] == (1, "revisit", 2)
    assert [r.page_id for r in back if r.url == "u" and r.record_type == "response"] == [139]
    assert next(r for r in back if r.page_id == 2).payload_bytes == len(long.encode())


@pytest.mark.parametrize("pack_rows", [600, 20_000])
def test_nearest_equals_brute_force(spark, pack_rows):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 16)).round(3).astype(np.float32)
    x[5] = x[6] = x[7]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(5000, None, 0), (5020, [0.0] * 16, 0), (5040, [float("nan")] * 16, 0), (5060, [None] * 16, 0), (5080, [float("inf")] * 16, 0), (None, [1.0] * 16, 0), (5100, [1.0] * 3, 0)]
    df = nearest.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    got, _ = answers(df, pack_rows=pack_rows)
    assert len(got) == 150 and recall(x, got) >= 0.9
    few, none = df.where("vec_id < 3"), df.limit(0)
    assert nearest.nearest(few, F.expr("vec_id = 0")).count() == 2
    assert nearest.nearest(none, F.expr("vec_id = 0")).count() == 0
    assert nearest.nearest(df, F.expr("vec_id = -1")).count() == 0


def test_search_stops_early(spark):
    """Isotropic unit vectors, the worst case for an index, and tight groups, where whole packs are out of reach."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((12_000, 64))
    x = (x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32)
    df = nearest.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"))
    got, verified = answers(df)
    assert recall(x, got) >= 0.9 and verified <= 0.3 * len(x)
    y = (4 * rng.standard_normal((100, 64))[np.arange(6000) % 100] + 0.3 * rng.standard_normal((6000, 64))).astype(np.float32)
    df = nearest.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "vec_id long, embedding array<float>"))
    got, verified = answers(df, pack_rows=500)
    assert recall(y, got) >= 0.9 and verified <= 0.1 * len(y)


def test_nearest_of_repeated_rows(spark):
    """A third of all rows is one vector, and a vec_id stands at two rows: each is a query and a candidate by itself."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(8).round(2).tolist()) for i in range(200)] + [(1000 + i, [1.0] * 8) for i in range(100)]
    rows += [(20, [2.0] * 8), (40, rows[40][1])]
    df = nearest.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = nearest.nearest(df, F.expr("vec_id in (20, 40)"), k=5, pack_rows=40).collect()
    assert len(got) == 4 * 5
    vectors = [np.array(v) for _, v in rows]
    for at, (i, v) in enumerate(rows):
        if i in (20, 40):
            scores = sorted((float(np.array(v) @ w) for n, w in enumerate(vectors) if n != at), reverse=True)[:5]
            mine = [r for r in got if r.query_id == i]
            assert all(min(abs(s - r.score) for r in mine if r.rank == k + 1) < 1e-9 for k, s in enumerate(scores))


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 900 + i) for i in range(80)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)] + [(7, 7)]
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    stages_of = dict(corpus_pipeline.STAGES)
    one = common.written(stages_of["language_id"](spark, docs, sf), "language_id")
    two = common.written(stages_of["minhash_neardup"](spark, one, sf), "minhash_neardup")
    three = common.written(stages_of["decontamination"](spark, two, sf), "decontamination")
    four = common.written(stages_of["secret_scan"](spark, three, sf), "secret_scan")
    for step in (one, two, three, four):
        assert step.columns == docs.columns
    left = {r.doc_id: r.text for r in three.collect()}

    # by hand: groups of five-word shingles, then passages
    from tests.llm.test_documents import groups_by_hand, passages

    texts = {r.doc_id: r.text for r in docs.collect()}
    named = {i: t for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    group, _ = groups_by_hand(named, 5)
    first = {i: t for i, t in named.items() if group[i] == i}
    items = {r.item_id: r.text for r in common.table(spark, sf, "benchmark").collect()}
    leaks = {d for d, _ in passages(first, items)}
    assert set(left) == set(first) - leaks
    out = common.written(corpus_pipeline.run(spark, sf), "tokens")
    assert {r.doc_id for r in out.select("doc_id").collect()} == set(left)
    assert four.count() == len(left)
    ids = {r.doc_id: r.ids for r in out.collect()}
    clean = [r for r in four.collect() if r.text == left[r.doc_id]][:20]
    tokenizer = stages.tokenizer()
    assert all(tokenizer.decode(np.array(ids[r.doc_id], np.int32)).decode() == r.text for r in clean)


def test_stages_of_empty_tables(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.count() == 0
