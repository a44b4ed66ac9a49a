import numpy as np
import pytest

from pitwise.llm import maintext, neighbours
from pitwise.llm.queries import QUERIES


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 16))
    near = base[:60] + rng.normal(size=(60, 16)) * 0.15
    crowd = base[0] + rng.normal(size=(120, 16)) * 0.1
    vectors = [*base, *near, *crowd, *base[5:25]]
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(vectors)]
    bad = [(9000, None, 0), (9001, [0.0] * 16, 0), (9002, [float("nan")] + [1.0] * 15, 0), (9003, [None] + [1.0] * 15, 0),
           (9004, [1.0, 2.0], 0), (9005, [], 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in neighbours.near_duplicates(df).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = x @ x.T >= 0.9
    np.fill_diagonal(links, False)
    found = np.array([got[i].n_links for i in range(len(rows))])
    assert np.minimum(found, links.sum(1)).sum() >= 0.97 * links.sum() and (found <= links.sum(1)).all()
    for i in range(5, 25):
        assert got[i].component_id == got[480 + i - 5].component_id
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(9000, 9006))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_neighbours_of_nothing_and_of_one(spark):
    schema = "vec_id long, embedding array<float>"
    assert neighbours.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    one = neighbours.near_duplicates(spark.createDataFrame([(7, [1.0, 0.0]), (None, [1.0, 0.0]), (7, [1.0, 0.0])], schema)).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in one) == [
        ("7", 2, 7, True), ("7", 2, 7, True), ("None", 2, 7, False)
    ]


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href=/>Home</a></li><li><a href=/b>More</a></li></ul></nav><div id="cookie-notice">We use cookies.</div>
<div class="sidebar"><p>A side text that is long enough to look like a paragraph.</p></div>
<div class="post-content"><h2>Headline</h2><p>First para &eacute; of the article, it is
 here.<p>Unclosed, with <b>bold<br>and a break.</p><div class="ad">Buy now!</div><p>Short.</p>
<form><label>Email</label><input><button>Go</button></form><script>if (a < b) "</p>";</script></div>
<section id="comments"><p>I agree with this nice article, thank you very much.</p></section>
<footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert maintext.main_text(PAGE) == (
        "Headline\nFirst para é of the article, it is here.\nUnclosed, with bold and a break.\nShort."
    )
    assert maintext.main_text(None) == maintext.main_text("") == maintext.main_text("<p> </p><script>x") == ""
    assert maintext.main_text("<article><p>a < b &lt; c &am</p><p>x</article") == "a < b < c &am\nx"


def test_minimum_cut_is_minimal():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(1, 8))
        odds = rng.normal(size=n).tolist()
        edges = [(i, j, float(rng.random())) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def cost(label):
            return sum(max(z, 0) if not k else max(-z, 0) for z, k in zip(odds, label)) + sum(
                w for a, b, w in edges if label[a] != label[b]
            )

        best = min(cost([m >> i & 1 for i in range(n)]) for m in range(1 << n))
        assert cost(maintext.min_cut(odds, edges)) == pytest.approx(best)


def test_pages_of_every_kind(spark):
    rows = [(1, "u", PAGE, 5), (1, "u", PAGE, 5), (None, None, None, None), (3, "u", "", 1),
            (4, "u", "<article>" + "<p>word word word.</p>" * 5000 + "</article>", 1)]
    out = maintext.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    assert len(out) == 5 and all(r.n_chars == len(r.text) for r in out)
    assert max(r.text.count("\n") for r in out) == 4999
    assert maintext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline_over_the_smallest_tables(spark):
    import corpus_pipeline as cp

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, docs
    for name, stage in cp.STAGES[:-1]:
        after = stage(spark, seen, sf_dir)
        assert after.columns == columns, name
        seen = spark.createDataFrame(after.collect(), after.schema)
    last = cp.STAGES[-1][1](spark, seen, sf_dir)
    assert last.count() == seen.count() and last.where("not decodes").count() == 0
    assert len([q for q in QUERIES if q.startswith("op")]) == 13
