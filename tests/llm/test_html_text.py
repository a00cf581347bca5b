import html
import re

import pytest

from attestor.llm import html_text as H

D = "/root/testdata/sf0.01"
LONG = "The cat of the house and the dog that is in the yard are to be seen by all who look at it from the road. "


def article(page):
    """The synthetic pages hold their text in one article element."""
    m = re.search(r"<article>(.*)</article>", page, re.S)
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", m[1])).split())


def test_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{D}/pages.parquet").collect()}
    got = H.op10_html_text(spark, D).collect()
    assert len(got) == len(pages)
    bad = [r.page_id for r in got if r.text != article(pages[r.page_id].html) or r.n_chars != len(r.text)]
    assert not bad


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""), ("", ""), ("<", ""), ("<div", ""), ("&amp", ""),
        (f"<body><div id=menu><a href=x>Home</a></div><h1>News</h1><p>{LONG * 3}</p><p>Yes.</p><p>{LONG * 3}</p><div class='sidebar'>{LONG * 3}</div>",
         f"News {' '.join((LONG * 3).split())} Yes. {' '.join((LONG * 3).split())}"),
        (f"<article><header><h1>T &amp;amp; x</h1></header><p>{LONG}<p>Go.<form>{LONG}</form><div class='comments'><p>{LONG}</div></article><p>{LONG * 4}</p>",
         f"T &amp; x {LONG.strip()} Go."),
        ("<main><p>one<br>two <b>th</b>ree</p><script>if (a < b) '</p>'</script><ul><li>x<li>y</ul></main>", "one two three x y"),
        (f"<p>{LONG * 3}</p><!-- a > b <p>no</p> --><p><a href='/'>{LONG}</a></p><footer>&copy; x", " ".join((LONG * 3).split())),
        (f"<article><p>tex", "tex"),
    ],
)
def test_rules(page, want):
    assert H.main_text(page) == want


def test_long_and_broken_pages():
    assert H.main_text("<div>" * 20000 + "x") == ""
    assert len(H.main_text("<article>" + "<p>word</p>" * 50000 + "</article>")) == 250000 - 1
    H.main_text("<a href=\"" * 5000)
    H.main_text("<!-- " * 5000)


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, "u", None, "t", 3), (1, "u", None, "t", 3), (None, None, "<article>a", "t", 3)], "page_id long, url string, html string, text string, n_chars int")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in H.extract(df).collect())
    assert got == [(0, "a", 1), (1, "", 0), (1, "", 0)]
    assert H.extract(df.limit(0)).count() == 0


ZH = "今天上午，市政府在新闻发布会上宣布，新的图书馆将于明年春天向公众开放。该项目历时三年，共投入资金约两亿元。负责人表示，馆内将设有儿童阅览室、自习区和展览厅，并提供多种语言的书籍。" * 2
RU = "Сегодня утром городская администрация объявила о том, что новая библиотека откроется для всех жителей весной следующего года, и пригласила каждого принять участие в её создании вместе с архитекторами. " * 2
EL = "Η νέα βιβλιοθήκη της πόλης θα ανοίξει την επόμενη άνοιξη και όλοι οι κάτοικοι είναι καλεσμένοι να την επισκεφθούν, όπως είπε ο δήμαρχος στη συνέντευξη που έδωσε σήμερα το πρωί στο δημαρχείο. " * 2
P = (LONG * 3).strip()
Q = P.replace("cat", "bird")


@pytest.mark.parametrize("body", [ZH, RU, EL])
def test_scripts_without_stop_words(body):
    """Pages without article, labelled by hand: the prose stays, menus and link lists go."""
    body = " ".join(body.split())
    menu = "<div><a href=/>首页</a> <a href=/a>Новости</a> <a href=/b>Αρχική</a></div>"
    assert H.main_text(f"<body>{menu}<div>{body}</div>{menu}<footer>{body}</footer></body>") == body
    assert H.main_text(f"<body>{menu}<div><a href=/>{body}</a></div></body>") == ""


@pytest.mark.parametrize(
    "page,want",
    [
        # no article: short blocks between prose stay, those next to link lists go
        (f"<div><a href=1>One</a></div><p>Tags</p><div><a href=2>Two</a></div><p>{P}</p><p>He said so.</p><p>{Q}</p><p>More</p><ul><li><a href=3>Three</a></ul>", f"{P} He said so. {Q} More"),
        # in the article: a list of links, what stands amid it, an advert between paragraphs, a short paragraph beside it
        (f"<article><p>{P}</p><div class=ad>{Q}</div><p>Go.</p><p>{Q}</p><div><a href=1>Share this</a></div><p>12:30</p><div><a href=2>Read more of it</a></div></article>", f"{P} Go. {Q}"),
        # names that speak for both leave it to the rules; plain ones decide
        (f"<article><div class='content related-content'><p>{P}</p></div><div class=related>{Q}</div></article>", P),
        (f"<main><div class='main-text'><p>{P}</p></div><div class='comment-list'><p>{Q}</p></div><div id=site-footer>{Q}</div></main>", P),
        (f"<div class='story promo-story'><p>{P}</p><p>Buy now</p></div><p>{Q}</p>", f"{P} {Q}"),
    ],
)
def test_rules_inside_and_outside_articles(page, want):
    assert H.main_text(page) == want


def test_many_open_elements_are_not_forgotten():
    page = f"<h1>{'<i>' * 9000}Title</h1><p>{P}</p>{'</i>' * 9000}<p>{Q}</p>"
    assert H.main_text(page) == f"Title {P} {Q}"
