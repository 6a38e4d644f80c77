import numpy as np
import pytest

from sonaria.llm import html


@pytest.mark.parametrize("tag", ["<svg viewBox='0 0 1 1'/>", '<svg a="x>y" />', "<MATH/>", "<object data='x'>", "<select class='menu'>", "<noscript>", "<svg>", "<template>"])
def test_what_is_not_closed_swallows_nothing(tag):
    assert html.blocks(f"<p>one</p>{tag}<p>two</p>") == (["one", "two"], False)
    assert html.blocks(f"<article><p>one</p>{tag}<p>two</p></article>") == (["one", "two"], True)


def test_what_is_closed_goes_with_all_it_holds():
    assert html.blocks("<p>one</p><svg><text>x</text></svg ><p>two</p><select><option>a</select><script>var x")[0] == ["one", "two"]
    assert html.blocks("<p>one</p><svg/><p>two</p><svg><text>x</text></svg><p>three</p>")[0] == ["one", "two", "three"]


def test_copies_of_a_page_are_one_page(spark):
    page = "<p>A text of its own about many things that nobody else ever writes</p><p>{}</p>"
    a, b = page.format("Short"), "<p>Another text with other words that stand only here and nowhere else</p>"
    rows = [(1, "http://h.example/1", a), (2, "http://h.example/2", a), (3, None, a), (4, None, a), (5, "http://h.example/5", b)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    whole = "A text of its own about many things that nobody else ever writes\nShort"
    assert got == {1: whole, 2: whole, 3: whole, 4: whole, 5: "Another text with other words that stand only here and nowhere else"}


def test_windows_run_over_all_pages_and_markup_checks_them(spark):
    menu, passage = "One two three four five six seven eight nine", "A passage that several pages of the host carry as their own words"
    own = ["First page with an article of its own", "Second page with other words in it", "Third page without any article but with its own text"]
    top = f"<nav>{menu}</nav>"
    rows = [(i, f"http://h.example/{i}", f"{top}<article><p>{own[i]}</p><p>{passage}</p></article>") for i in (0, 1)]
    # the same menu and passage where markup says nothing: the menu goes, what articles hold stays
    rows += [(2, "http://h.example/2", f"<div>{menu}</div><p>{own[2]}</p><p>{passage}</p>")]
    rows += [(3, "http://other.example/3", rows[0][2]), (4, "http://h.example/4", "")]
    got = {r.page_id: (r.text, r.n_repeated) for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    n, m = (len(x.split()) - html.DEPTH + 1 for x in (passage, menu))
    assert got == {0: (f"{own[0]}\n{passage}", n + m), 1: (f"{own[1]}\n{passage}", n + m), 2: (f"{own[2]}\n{passage}", n + m), 3: (f"{own[0]}\n{passage}", 0), 4: ("", 0)}


def test_buckets_change_nothing(spark, monkeypatch):
    pages = [(i, "http://h.example/", f"<p>{' '.join(f'w{(i * 7 + k) % 60}' for k in range(40))}</p><nav>a b c d e f g h i {i % 3}</nav>") for i in range(40)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    monkeypatch.setattr(html, "LEAST_BUCKETS", 1)
    one = sorted(map(tuple, html.main_text(frame).collect()))
    monkeypatch.setattr(html, "BUCKET_CHARS", 500)
    monkeypatch.setattr(html, "SMALL_ROWS", 10)
    assert sorted(map(tuple, html.main_text(frame).collect())) == one and any(r[4] for r in one)


def test_equal_windows_have_equal_anchors_which_are_half_as_many():
    r = np.random.default_rng(5)
    tokens = r.integers(0, 2**63, 4000).astype(np.uint64)
    tokens[3000:3100] = tokens[100:200]
    found, stand = html._rolled(tokens, html.DEPTH), html.anchors(tokens)
    assert len(found) == len(stand) and (stand[3000:3093] == stand[100:193]).all()
    assert len(np.unique(stand)) < 0.55 * len(np.unique(found))
    for depth in (1, 2, 3):
        assert len(html.anchors(tokens[:5], depth)) == 6 - depth
    assert len(html.anchors(tokens[:7])) == len(html.anchors(tokens[:0])) == 0


def test_what_meets_in_buckets_is_less_than_all_windows(spark, monkeypatch):
    r = np.random.default_rng(6)
    shared = " ".join(f"s{k}" for k in range(20))
    pages = [(i, "http://h.example/", f"<p>{' '.join(f'w{k}' for k in r.integers(0, 10**9, 400))}</p><p>{shared}</p>") for i in range(60)]
    # seven equal tokens meet as an anchor, but are no window
    pages += [(i, "http://h.example/", f"<p>a{i} b{i} one two three four five six seven c{i} d{i}</p>") for i in (60, 61)]
    moved = []
    keep = html._told
    monkeypatch.setattr(html, "_told", lambda dealt, *how: moved.append(dealt.selectExpr("count(*)", "sum(length(keys) + length(pages) + length(places) + length(hashes))").first()) or keep(dealt, *how))
    rows = html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(2)).collect()
    assert [x.n_repeated for x in sorted(rows)] == [13] * 60 + [0, 0]
    assert not any("s3" in x.text.split() for x in rows)
    windows = 60 * (420 - html.DEPTH + 1)
    assert len(moved) == 2 and sum(b for _, b in moved) < 5 * windows and max(n for n, _ in moved) <= 2 * (html.LEAST_BUCKETS + 1)
