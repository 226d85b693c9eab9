from ballotry.llm import main_text as mt

ARTICLE = "It was a quiet morning at the harbour and the boats lay still, waiting for the wind that never came."
MORE = "Later the fishermen told each other the same stories they had told for years, and no one listened."


def test_tree_reproduces_the_labelled_table():
    x, y = mt.labelled_table()
    assert ((mt.decide(mt.trained_tree(), x) >= 0.5) == y).all()


def test_article_without_furniture():
    page = f"""<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{{margin:0}}</style><script>var t="</p>";x<y;</script></head>
    <body><header><p>The site name and its motto for the day</p></header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- ad <p>0</p> -->
    <div class="ad">Buy this now, it is the best offer of the whole year for you.</div>
    <article><h1>Harbour &amp; wind</h1><p><b>{ARTICLE}<br><p>{MORE}  caf&eacute;&#33;</p><p>So.</p></article>
    <aside><p>{MORE} {ARTICLE}</p></aside><div class="comments"><p>{ARTICLE} I liked it.</p></div>
    <div id="cookie-notice">We use cookies to make this page better for you and for us.</div>
    <form><p>Give us your mail address and we send news to it.</p></form><footer>&copy; all rights</footer></body></html>"""
    assert mt.main_text(page, mt.trained_tree()) == f"Harbour & wind {ARTICLE} {MORE} café! So."


def test_pages_without_article_element():
    page = f"<div><a href=1>One</a> <a href=2>Two</a></div><div><p>{ARTICLE}</p><p>{MORE}</p></div><div><a href=3>Terms</a></div>"
    assert mt.main_text(page, mt.trained_tree()) == f"{ARTICLE} {MORE}"


def test_spark_edge_cases(spark):
    long = "<article>" + f"<p>{ARTICLE}</p>" * 5000 + "</article>"
    rows = [(1, "u", None, 1), (2, None, "", 2), (3, "u", "<article><p>a<b>b</b>\n c</p></article>", 3), (3, "u", "<article><p>a<b>b</b>\n c</p></article>", 3), (None, "u", long, 4), (5, "u", "<", 5), (6, "u", "<article><p>1 < 2 and <!-- never closed", 6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = sorted(map(tuple, mt.extract_main_text(df).collect()), key=str)
    by = {r[0]: r for r in got}
    assert len(got) == 7 and by[1][2:] == ("", 0) and by[2] == (2, None, "", 0)
    assert by[3][2:] == ("ab c", 4) and by[6][2] == "1 < 2 and"
    assert by[None][3] == 5000 * (len(ARTICLE) + 1) - 1
    assert mt.extract_main_text(df.limit(0)).count() == 0


def extract(page):
    return mt.main_text(page, mt.trained_tree())


def test_classes_of_layout_elements_dont_empty_a_page():
    for page in (
        f"<body class='no-sidebar header-dark'><article><h1>T</h1><p>{ARTICLE}</p></article></body>", f"<html class='has-cookie-banner'><body><main class='has-comments'><h1>T</h1><p>{ARTICLE}</p></main>",
        f"<body><article class='search-result'><h1>T</h1><p>{ARTICLE}</p></article>", f"<body id=menu-page class=widget><article class='post share-on'><h1>T</h1><p>{ARTICLE}</p></article>",
    ):
        assert extract(page) == f"T {ARTICLE}"
    assert extract(f"<body><article><p>{ARTICLE}</p></article><article class=comment><p>{MORE}</p></article>") == ARTICLE
    assert extract(f"<body hidden><article><p>{ARTICLE}</p></article>") == ""


def test_furniture_on_any_element():
    page = f"""<article><h1>T</h1><p>{ARTICLE} <button>Share now</button></p><label>Your rating</label><p class='advert'>Buy it now.</p><h2 class=newsletter>News by mail</h2>
    <p>{MORE} <span class="social">Like us</span> And so on.</p><p class=ad>Unclosed<p>{ARTICLE}</p><div class='author-bio'>She writes here.</div><p class="lead">{MORE}</p></article>"""
    assert extract(page) == f"T {ARTICLE} {MORE} And so on. {ARTICLE} {MORE}"


def test_truth_without_semantic_tags():
    """Pages of tables and plain containers, labelled by hand: the tree isn't trained on them."""
    side = "See all offers of the week"
    pages = [
        (f"<div><a href=1>Home</a> <a href=2>Shop</a></div><div><h1>Harbour</h1><p>{ARTICLE}</p><p>{MORE}</p></div><div><a href=3>{side}</a></div>", f"Harbour {ARTICLE} {MORE}"),
        (f"<table><tr><td><a href=1>Home</a></td><td><a href=2>{side}</a></td></tr></table><p>{ARTICLE}</p><p>{MORE}</p><p>{ARTICLE}</p>", f"{ARTICLE} {MORE} {ARTICLE}"),
        (f"<div class=c1><a href=1>One</a></div><div class=c2><div>{MORE}</div><div>{ARTICLE}</div></div><div class=c3><a href=5>Contact</a></div>", f"{MORE} {ARTICLE}"),
    ]
    for page, want in pages:
        assert extract(page) == want
