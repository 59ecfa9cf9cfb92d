from timelake.llm import htmltext

PAGE = """<!DOCTYPE html><html><head><title>T t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy this now.</div>
<article><h1>A title here</h1><p><b>One &amp; two\n  three.<br><p>Caf&eacute; &lt;b&gt; and&nbsp;more of it.</p>
<div class="advert">Nope nope nope.</div><p>Last para with <a href="#">a link</a> inside.</p></article>
<section class="comments"><p>I like this page very much.</p></section><form><label>Mail</label></form>
<footer>&copy; me.example &middot; All.</footer></body></html>"""


def test_page(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, "u", None, "x"), (3, "u", "", "x"), (3, "u", "", "x"), (4, None, "<p>unclosed <b", "x"), (5, "u", "<" * 5000 + "a" * 10, "x")], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in htmltext.extract(df).collect()}
    assert got[1] == "A title here\nOne & two three.\nCafé <b> and more of it.\nLast para with a link inside."
    assert got[2] == got[3] == "" and set(got) == {1, 2, 3, 4, 5}
    assert htmltext.extract(df.limit(0)).count() == 0


def test_held_out_layouts():
    right = total = 0
    for page, labels in htmltext.labelled_pages(80, seed=1234):
        blocks = [(t.replace(htmltext._MARK, "").strip() or "x", a, x) for t, a, x in htmltext.leaf_blocks(page)]
        found = htmltext.model().decode(htmltext.features(blocks))
        right += sum(a == b for a, b in zip(found, labels, strict=True))
        total += len(labels)
    assert right >= 0.97 * total


def test_viterbi_is_the_best_of_all_paths():
    chain = htmltext.model()
    rows = htmltext.features(htmltext.leaf_blocks(PAGE))[:8]
    score = lambda path: sum(chain.weight[r].sum() * y for r, y in zip(rows, path)) + sum(chain.change[a, b] for a, b in zip(path, path[1:]))
    paths = [[k >> i & 1 for i in range(len(rows))] for k in range(2 ** len(rows))]
    assert abs(score(chain.decode(rows)) - max(map(score, paths))) < 1e-9


def test_long_pages_take_linear_time():
    page = "<div>" * 3000 + "<p class='a>" * 2000 + "<a href=x>y" * 20000
    assert isinstance(htmltext.main_text(page, htmltext.model()), str)


def test_unclosed_and_deep_elements_keep_their_ancestors():
    nav, article = htmltext._AT["t:nav"], htmltext._AT["t:article"]
    for tag in ("a", "span", "b"):
        blocks = htmltext.leaf_blocks("<nav>" + f"<{tag}>x" * 300 + "</nav><article><p>The text.</p></article>")
        assert blocks[-1][0] == "The text." and nav not in blocks[-1][1] and article in blocks[-1][1]
        assert blocks[-1][2] == 0
    blocks = htmltext.leaf_blocks("<nav>" + "<div>" * 5000 + "<article><p>In.</p></article>" + "</div>" * 4000 + "<p>Mid.</p>" + "</div>" * 1000 + "</nav><p>Out.</p>")
    assert [(t, article in f, nav in f) for t, f, _ in blocks] == [("In.", True, True), ("Mid.", False, True), ("Out.", False, False)]
    blocks = htmltext.leaf_blocks("<ul><li>one" + "<b>" * 300 + "<li><p>two</ul><p>three")
    assert [(t, htmltext._AT["t:li"] in f) for t, f, _ in blocks] == [("one", True), ("two", True), ("three", False)]


#: Pages and their main text, set by hand; none comes from the generator of the training pages.
BY_HAND = [
    ('<html><body><article><p data-id="ad">In the article here.</p><p>More of it.</p></article></body></html>', "In the article here.\nMore of it."),
    ("<html><head><title>T</title></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><header><h1>The headline of it</h1></header><p>First words of the text.</p><p>And then some more words follow.</p></article></body></html>", "The headline of it\nFirst words of the text.\nAnd then some more words follow."),
    ('<html><body><main><h1>Title words</h1><p>This is the story of a day.</p></main><div role="contentinfo"><p>All of the rights belong to the firm. Read the terms.</p></div></body></html>', "Title words\nThis is the story of a day."),
    ("Just a plain text, with no tags at all. It has two sentences.", "Just a plain text, with no tags at all. It has two sentences."),
    ("<p>One paragraph of a plain page.</p><p>Another one.</p>", "One paragraph of a plain page.\nAnother one."),
    ("<body><div role=\"navigation\"><a href=/a>Start</a> <a href=/b>News</a></div><div role=\"main\"><h2>Part</h2><p title='class=\"ad\"'>The words of the part.</p></div><div role=\"complementary\">See also our shop.</div></body>", "Part\nThe words of the part."),
    ("<body><header><h1>Site name</h1></header><main><article><header><h1>Real headline</h1><p>By line of the writer.</p></header><p>Body words go here.</p></article></main><footer>(c) me</footer></body>", "Real headline\nBy line of the writer.\nBody words go here."),
]


def test_layouts_labelled_by_hand():
    for page, text in BY_HAND:
        assert htmltext.main_text(page, htmltext.model()) == text


def test_attribute_names_are_whole():
    ad = htmltext._AT["c:ad"]
    for attrs, speaks in ((' class="ad"', True), (" id=ad", True), (" ROLE='x ad'", True), (' data-id="ad"', False), (" data-class=ad", False), (""" title='class="ad"'""", False), (' x="y"class="ad"', True), (" class = ad", True)):
        assert (ad in htmltext._own("div", attrs)) == speaks, attrs


def test_articles_of_the_table():
    """By the table's own layout: the headings and paragraphs of the article are the text."""
    import re
    from html import unescape

    import pyarrow.parquet as pq

    for row in pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist():
        blocks = []
        inside = re.search(r"<article>(.*)</article>", row["html"], re.S)
        for part in re.split(r"<(?:/?p|/?h1|/?div)[^>]*>", re.sub(r"<(div|aside|section) class=.*?</\1>", "<div>", inside[1], flags=re.S)):
            text = " ".join(unescape(re.sub(r"<br>", " ", re.sub(r"<(?!br)[^>]*>", "", part))).split())
            blocks += [text] if text else []
        assert htmltext.main_text(row["html"], htmltext.model()) == "\n".join(blocks), row["page_id"]
