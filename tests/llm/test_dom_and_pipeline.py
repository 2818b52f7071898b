import collections
import functools
import itertools
import math
import random
import re
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlens.llm import dom_marginals as dom
from ledgerlens.llm import quality
from tests.llm.test_mixing_and_quality import fill
from tests.llm.test_tgm_join import brute
from tests.llm.test_token_counts_and_packing import check_packing


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)


@functools.cache
def fitted():
    return dom.fit_pages([])


def enumerated(model, page):
    """Log weight of every labelling of a small page."""
    nodes, _ = dom.side_by_side([page])
    for labels in itertools.product((0, 1), repeat=len(page.parent)):
        score = 0.0
        for k, y in enumerate(labels):
            score += y * model.node[nodes.features[k]].sum()
            if k:
                score += model.pair[nodes.kind[k], labels[nodes.parent[k]], y]
        yield labels, score


def small_pages(n=40):
    rng = random.Random(1)
    tags = ["<div>", "<p>", "<ul>", "<li>", '<div class="ad">', "<article>", "<section>", "</div>", "</ul>", "</section>", "some text here "]
    found = [dom.parse("".join(rng.choices(tags, k=rng.randint(1, 12)))) for _ in range(n)]
    return [p for p in found if len(p.parent) <= 10]


def test_marginals_equal_enumeration():
    model = fitted()
    for page in small_pages():
        total, content = 0.0, np.zeros(len(page.parent))
        for labels, score in enumerated(model, page):
            total += math.exp(score)
            content += math.exp(score) * np.array(labels)
        assert np.allclose(model.marginals(dom.side_by_side([page])[0]), content / total, atol=1e-9)


def test_pair_marginals_equal_enumeration():
    model = fitted()
    for page in small_pages(20):
        nodes, _ = dom.side_by_side([page])
        kids = np.flatnonzero(nodes.parent >= 0)
        if not len(kids):
            continue
        total, want = 0.0, np.zeros((len(kids), 2, 2))
        for labels, score in enumerated(model, page):
            total += math.exp(score)
            for at, k in enumerate(kids):
                want[at, labels[nodes.parent[k]], labels[k]] += math.exp(score)
        assert np.allclose(model.messages(nodes, nodes.levels(), kids)[1], want / total, atol=1e-9)


def test_fit_reaches_a_maximum():
    """No weight can be moved to raise the penalised likelihood: the fitted
    marginals meet the labels, feature by feature, up to the penalty."""
    nodes, _ = dom.side_by_side([dom.parse(h) for h in dom.LABELLED])
    model = dom.TreeModel.fit(nodes, np.ones(len(nodes.parent)), steps=2000)
    gap = nodes.labels - model.marginals(nodes)
    slots = nodes.features.shape[1]
    gradient = np.bincount(nodes.features.ravel(), np.repeat(gap, slots), dom.FEATURES) - 0.02 * model.node
    assert np.abs(gradient).max() < 0.05


def test_hand_labels_are_learnt():
    for html in dom.LABELLED:
        page = dom.parse(html)
        nodes, _ = dom.side_by_side([page])
        content = fitted().marginals(nodes) > 0.5
        assert [bool(content[node]) for node, _ in page.blocks] == [bool(page.labelled[node]) for node, _ in page.blocks]


LONG = ("words that nobody has labelled " * 11).strip()
MID = ("a line of other words " * 4).strip()


@pytest.mark.parametrize("html,text", [
    # content inside marked wrappers: a rule by words gives nothing here
    (f'<div class="widget"><article><h1>T</h1><p>{MID}</p></article></div>', f"T\n{MID}"),
    (f'<div class="page-search"><article><p>{MID}</p><p>x</p></article></div>', f"{MID}\nx"),
    (f"<form id=f><article><p>{MID}</p></article><p>Send</p></form>", MID),
    (f'<div class="sidebar"><p>{MID}</p></div><div class="toolbar-page"><main><p>{LONG}</p></main></div>', LONG),
    # words with another meaning inside the article
    (f'<article><p>a</p><p class="related-work">{MID}</p><section id="discussion"><h2>D</h2><p>{LONG}</p></section></article>', f"a\n{MID}\nD\n{LONG}"),
    # boilerplate without marks inside an article, and beside one: a rule by words keeps it
    (f"<article><h1>T</h1><p>{LONG}</p><div><ul><li><a href=1>Older one</a></li><li><a href=2>Newer one</a></li></ul></div></article>", f"T\n{LONG}"),
    (f'<main><div class="x"><a href=1>Home</a> <a href=2>News</a></div><article><h1>T</h1><p>{LONG}</p></article><ul><li><a href=3>Older</a></li></ul></main>', f"T\n{LONG}"),
    # marked boilerplate, also where articles are nested
    (f"<article><p>{MID}</p><div class=comment-list><article><p>{LONG}</p></article></div></article>", MID),
    (f"<article><p>{MID}</p><div class=comment-list><article class=comment><p>{LONG}</p></article></div></article>", MID),
    (f"<div class=comments><article><p>{LONG}</p></article></div>", ""),
    (f"<article><p>{MID}</p><div class='promo-box'><p>{LONG}</p></div><aside><h3>S</h3><p>{LONG}</p></aside></article>", MID),
    ("<article><p>where <math><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow></math> holds</p></article>", "where x=1 holds"),
    ("<article><p>a <math><mi>x</mi></p><p>b</p></article>", "a x\nb"),
    ("<article><p>a</p><noscript><p>b</p></article>", "a\nb"), ("<article><p>a</p><script>b", "a"),
])
def test_the_model_decides_not_the_words(html, text):
    assert dom.main_texts(fitted(), [f"<body>{html}</body>"]) == [text]


def test_training_pages_do_not_show_their_marks():
    page = dom.without_marks(dom.parse(f"<nav><p>n</p></nav><article class=post><h1>T</h1><p>{LONG}</p></article>"))
    assert not any(page.opener) and dom._TAG_ID["article"] not in page.tag
    assert [page.labelled[node] for node, _ in page.blocks] == [0, 1, 1]
    for uncertain in ("<article><div class=related><p>x</p></div></article>", "<form><article><p>x</p></article></form>", "<p>x</p>"):
        assert dom.without_marks(dom.parse(uncertain)) is None


def test_pages_side_by_side_do_not_touch():
    model, htmls = fitted(), [*dom.LABELLED, "", "x", "<p>" * 30]
    assert dom.main_texts(model, htmls) == [dom.main_texts(model, [h])[0] for h in htmls]


@pytest.mark.parametrize("html,text", [
    ("<body><nav><a href=1>x</a></nav><article><h1>T &amp; U</h1><p>Hello &lt;b&gt; &eacute;<br>there,\n  <i>you</i></p><div class='ad'>buy</div>"
     "<section class=comments><p>a long reader comment that goes on and on</p></section><script>var p='<p>no</p>';</script><style>p{}</style>"
     "<!-- <p>nor this</p> --><form><p>Name</p><input></form></article><aside><p>side words</p></aside><footer>&copy; me</footer>", "T & U\nHello <b> é there, you"),
    ("<main><p>one<p>two<ul><li>a<li>b</ul>tail<span hidden>gone</span></main>", "one\ntwo\na\nb\ntail"),
    ("<ARTICLE><P>caps &#65;&#x42;&nbsp;c</P>\r\n</ARTICLE>", "caps AB c"),
    ("<article><p>cut off &am", "cut off &am"), ("<article><p>cut in a tag</p><p class='x", "cut in a tag"),
    ("<article></article>", ""), ("", ""), ("<", ""), ("<article>" + "<div>" * 2000 + "deep" + "</article>", "deep"),
    ("<article><header><h1>Head</h1></header><table><tr><td>1</td><td>2</td></tr></table></article>", "Head\n1 2"),
])
def test_main_text(html, text):
    assert dom.main_texts(fitted(), [html]) == [text]


def test_unmarked_pages_by_hand_labels():
    long = "plain words go here " * 12
    html = f'<div id=wrap><div class=menu><ul><li><a href=/>Home</a></li></ul></div><div><p>{long}</p><p>{long}</p></div><div id=cookie-notice><p>We use cookies {long}</p></div></div>'
    assert dom.main_texts(fitted(), [html]) == ["\n".join([long.strip()] * 2)]


def test_extract_rows_and_edges(spark, clashing):
    html = "<nav>n</nav><article><p>kept text</p></article>"
    rows = [(1, "u", html), (1, "u", html), (2, None, None), (3, "v", ""), (None, "w", html), (4, "x", "<article><p>" + "long " * 200000 + "</p></article>")]
    df = clashing(pages(spark, rows))
    model = dom.train(df)
    got = collections.Counter((r.page_id, r.url, r.text, r.n_chars) for r in dom.extract(df, model).collect())
    long = "long " * 199999 + "long"
    assert got == collections.Counter([(1, "u", "kept text", 9)] * 2 + [(2, None, "", 0), (3, "v", "", 0), (None, "w", "kept text", 9), (4, "x", long, len(long))])
    none = df.limit(0)
    assert dom.extract(none, dom.train(none)).count() == 0


def test_sample_pages(spark):
    d = "/root/testdata/sf0.01"
    html = {r.page_id: r.html for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    for r in dom.op4_dom_marginals(spark, d).collect():
        inner = re.search(r"<article>(.*?)</article>", html[r.page_id], re.S)[1]
        blocks = (" ".join(unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inner))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


# --- the pipeline, stage by stage against brute force ---

@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    sf_dir, out = "/root/testdata/sf0.001", tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, found[-1], sf_dir).write.parquet(f"{out}/{name}")
        found.append(spark.read.parquet(f"{out}/{name}"))
    return found


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_keep_the_columns(stages):
    assert all(s.dtypes == stages[0].dtypes for s in stages[:-1])


def test_quality_stage(spark, stages):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    ranker = quality.train(stages[0], labels)
    f = lambda t: quality.features(np.frombuffer((t or "").encode(), np.uint8))
    want = collections.Counter(r for r in texts(stages[0]) if ranker.score(f(r[1])[None])[0] >= ranker.threshold)
    assert collections.Counter(texts(stages[1])) == want
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    kept = {i for i, _ in texts(stages[1])}
    assert len(good & kept) >= 0.98 * len(good & {i for i, _ in texts(stages[0])})


def test_near_duplicate_stage(stages):
    rows = texts(stages[1])
    components = {c for _, _, c in brute(rows, 5, 80)}
    assert collections.Counter(texts(stages[2])) == collections.Counter(r for r in rows if r[0] in components)


def test_mixing_stage(stages):
    rows = stages[2].select("doc_id", "text", "source").collect()
    sizes, taken = collections.Counter(), collections.Counter()
    for r in rows:
        sizes[r.source] += len((r.text or "").encode().split())
    whole = {r.doc_id: r.text for r in rows}
    passes = collections.Counter()
    for r in stages[3].collect():
        taken[r.source] += len(r.text.encode().split())
        passes[r.doc_id] += 1
        assert whole[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    assert max(passes.values()) <= 2
    for s, target in fill(sizes).items():
        assert abs(taken[s] - target) <= 0.5


def test_packing_stage(stages):
    check_packing(texts(stages[3]), stages[4].collect(), 1024)


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    count = lambda df: collections.Counter(tuple(r) for r in df.select(columns).collect())
    assert count(got) == count(stages[4])


def test_stages_on_empty_and_odd_rows(spark, documents, clashing):
    rows = [(1, None), (2, ""), (None, "no id at all"), (3, "a b c d e f g"), (3, "a b c d e f g"), (4, "A B C D E F G"), (5, "x")]
    for docs in (documents(rows), documents(rows).limit(0), documents(rows).withColumn("score", F.lit(1)).withColumn("id", F.lit("clash"))):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            out.collect()
            if name != "packing":
                assert out.columns == docs.columns


def test_copies_of_pages_count_once_in_training(spark):
    pages = [f"<body><nav>Menu {k}</nav><article><h1>Title {k}</h1>" + f"<p>{'Words of it. ' * (3 * k + 1)}</p>" * (k % 4 + 1) + "</article></body>"
             for k in range(6)]
    make = lambda rows: spark.createDataFrame([(h,) for h in rows], "html string")
    want = dom.train(make(pages), train_pages=8)
    for copied in pages:
        got = dom.train(make(pages + [copied] * 60), train_pages=8)
        assert np.allclose(got.node, want.node) and np.allclose(got.pair, want.pair)
