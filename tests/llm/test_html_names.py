"""Names of elements inside an article: those that prose has too need a second witness."""

from lectern.llm import html_text

ARTICLE = "<article><h1>Title {0}</h1><p>First {0}.</p>{1}<p>Last {0}.</p></article>"


def texts(spark, *bodies):
    rows = [(i, f"https://h/a/{i:03d}", f"<body><nav>Home</nav>{ARTICLE.format(i, body)}<footer>Imprint</footer></body>") for i, body in enumerate(bodies)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    return [r["text"].split("\n")[2:-1] for r in got.orderBy("page_id").collect()]


def test_parts_of_an_article_stay(spark):
    own = "<h2 id=related>Related work</h2><section id=discussion><h2>Discussion</h2><p>We <a href=/x>saw</a> it all {0}.</p></section><p class=alert-box>Mind the gap {0}.</p><div class=share-prices>Prices fell {0}.</div>"
    want = ["Related work", "Discussion", "We saw it all {0}.", "Mind the gap {0}.", "Prices fell {0}."]
    alone = texts(spark, own.replace("{0}", "0"))
    assert alone == [[x.replace("{0}", "0") for x in want]]
    copies = texts(spark, *[own.replace("{0}", "0")] * 2)  # a copy is no witness
    assert copies == [[x.replace("{0}", "0") for x in want]] * 2


def test_menus_and_notices_inside_an_article_go(spark):
    gone = (
        "<div class=related><h3>Related</h3><ul><li><a href=/1>One {0}</a></li><li><a href=/2>Another one {0}</a></li></ul></div>"
        "<div class='cookie notice'>We use cookies {0}</div><p class=ad>Buy {0}</p><div id=comments><p>First! {0}</p></div><p>A <span class=share>Share!</span>word {0}.</p>"
        "<div class=notice>All rights reserved</div><section class=discussion><p>Kept {0}</p><div class=comment>gone {0}</div><aside>gone</aside></section>"
    )
    got = texts(spark, gone.replace("{0}", "0"), gone.replace("{0}", "1"))
    assert got == [[f"A word {i}.", f"Kept {i}"] for i in range(2)]


def test_suspects_of_broken_markup_are_read_to_the_end():
    of = lambda page: [(text, how) for text, _, how in html_text.lines_of(page)]
    assert of("<article><div class=related><a>x y</a>") == [("x y", html_text.RULED_OUT)]
    assert of("<article><div class=related>x <a>y</a> z") == [("x y z", html_text.SUSPECT)]
    assert of("<div class=related>x</div>") == [("x", html_text.RULED_OUT)]
    assert of("<article><div class=share></div></a></a><p class=share>x</article><p>y") == [("x", html_text.SUSPECT), ("y", html_text.SHOWN)]
