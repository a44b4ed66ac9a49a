"""Main text: where the cut overrules blocks, pages with misleading names, deep nesting, long pages."""

import time

from pitwise.llm import maintext

P = "<p>This is a long paragraph of prose, which tells what the page is about, in many words.</p>"
TEXT = P[3:-4]


def _changed(page):
    """(texts kept against their own odds, texts dropped against them)."""
    blocks = maintext.blocks_of(page)
    odds = [maintext.log_odds(b) for b in blocks]
    kept = maintext.min_cut(odds, maintext.edges_of(blocks))
    return ([b.text for b, z, k in zip(blocks, odds, kept) if k and z <= 0],
            [b.text for b, z, k in zip(blocks, odds, kept) if not k and z > 0])


def test_the_cut_overrules_single_blocks_in_both_directions():
    inside = f"<body><div>{P}{P}<p>Yes</p><div>No</div>{P}{P}</div></body>"
    kept, dropped = _changed(inside)
    assert kept == ["Yes", "No"] and not dropped
    assert maintext.main_text(inside).split("\n") == [TEXT, TEXT, "Yes", "No", TEXT, TEXT]
    links = "".join(f"<p><a href=/{i}>Go to the page {i}</a></p>" for i in range(4))
    listed = f"<body><div>{P * 3}</div><section><div>{links}<p>Read them all, one by one.</p>{links}</div></section></body>"
    kept, dropped = _changed(listed)
    assert dropped == ["Read them all, one by one."] and not kept
    assert maintext.main_text(listed).split("\n") == [TEXT] * 3


def test_no_feature_is_beyond_its_neighbours():
    around = 4 * maintext.SMOOTH
    for weight in (maintext.TAGGED, maintext.STRONG, maintext.WEAK, maintext.ARTICLE, maintext.LINKS):
        assert abs(weight) <= around


def test_names_of_the_frame_and_of_the_article():
    for attribute in ('class="with-sidebar"', 'id="popular-science"', 'class="page has-comments"', 'class="menu"'):
        assert maintext.main_text(f"<body><div {attribute}>{P * 3}</div></body>") == "\n".join([TEXT] * 3)
    headed = f'<article><header class="entry-header"><h1>The headline</h1></header>{P}</article>'
    assert maintext.main_text(headed) == f"The headline\n{TEXT}"
    assert maintext.main_text(f"<body><header><h1>Site</h1></header><article>{P}</article></body>") == TEXT
    said = "<p>I agree with this nice article, thank you very much for it.</p>"
    for section in (f'<section id="comments"><article class="comment">{said}</article>{said * 9}</section>',
                    f'<article class="teaser">{said}</article>', f'<div class="related"><article>{said}</article></div>'):
        assert maintext.main_text(f"<body><article>{P * 2}</article>{section}</body>") == f"{TEXT}\n{TEXT}"


def test_deep_and_long_pages_take_linear_time():
    def took(page):
        start = time.time()
        maintext.main_text(page)
        return time.time() - start

    for page in ("<div>" * 8000 + P, "<div><span>" * 8000 + P * 50, "<div>x</b></i>" * 8000, "<div><p>a b.</p>" * 8000,
                 "<ul><li>" * 8000 + "x", "<a>" * 8000 + "x"):
        assert took(page) < 1
    long = f"<article>{P * 20_000}</article>"
    assert maintext.main_text(long).count("\n") == 19_999
