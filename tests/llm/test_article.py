import time

from roundtide.llm import article as a

PROSE = "This is the story of a town that was built by the river, and it is said that the people were glad of it. " * 3
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>
<div class="cookie-notice">We use cookies and the like for you, as it is of use to us and to our partners in this.</div>
<article><h2>Head&shy;line &amp; more</h2><p>{PROSE}</p><p>Short.</p><script>var x = "<p>no</p>";</script>
<p>A <b>bold</b>  word<br>and&nbsp;a line.<p>{PROSE}<form><p>Sign up for the news</p><input name=a></form>
<!-- <p>hidden</p> --><p>End.</p></article>
<aside>{PROSE}</aside><section id="comments"><p>{PROSE}</p></section>
<footer>&copy; 2020 The site</footer></body></html>"""


def test_article_is_kept_and_furniture_goes():
    prose = PROSE.strip()
    assert a.main_text(PAGE).split("\n") == ["Head\xadline & more", prose, "Short.", "A bold word and a line.", prose, "End."]


def test_page_without_content_element_relies_on_rules():
    links = "".join(f"<div><a href='/{i}'>A link to the page of number {i} on this site</a></div>" for i in range(8))
    page = f"<body>{links}<div>Title</div><div>{PROSE}</div><div>Short one</div><div>{PROSE}</div><div>{links}</div></body>"
    assert a.main_text(page).split("\n") == [PROSE.strip(), "Short one", PROSE.strip()]


def test_broken_markup():
    for cut in range(0, len(PAGE), 37):
        a.main_text(PAGE[:cut])
    assert a.main_text("") == "" and a.main_text("<") == "" and a.main_text("<p") == ""
    assert a.main_text('<article><p>Some text <a href="x>y">link</a> of it</p><p title="a>b">' + PROSE).startswith("Some text link of it\n")
    assert a.main_text("<article><p>one &am</p><p>two &#12354; &lt;b&gt;</p>") == "one &am\ntwo あ <b>"


def test_every_page_and_odd_rows(spark):
    rows = [(1, "u", PAGE), (None, None, None), (2, "u", ""), (1, "u", PAGE), (3, None, "x" * 300_000), (4, "v", "<p>" * 20_000), (5, "v", "<div class='a'>" * 3000 + PROSE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "1 as n_chars")
    got = a.extract(df).collect()
    assert len(got) == len(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["text"] for r in got if r["page_id"] in (None, 2)} == {""}
    assert a.extract(df.limit(0)).count() == 0


def test_wrappers_of_the_main_text_and_other_languages():
    body = "This is the text of the page and it is about the things that were seen by the people who live in it. " * 3
    finnish = "Kaupungin vanhin kirjasto avattiin uudelleen keskiviikkona pitkien korjausten jälkeen, kertoo johtaja Virtanen. " * 3
    text = body.strip()
    menu = "<nav><a href=x>Home</a></nav>"
    for page in (
        f'{menu}<div class="layout has-sidebar"><article><p>{body}</p></article></div>',
        f'{menu}<div class="elementor-widget"><p>{body}</p></div>',
        f'<form id="aspnetForm">{menu}<p>{body}</p></form>',
    ):
        assert a.main_text(page) == text
    assert a.main_text(f"<article><header><h1>A title</h1></header><p>{body}</p></article>") == f"A title\n{text}"
    assert a.main_text(f"{menu}<div><p>{finnish}</p></div>") == finnish.strip()
    comments = f'<div class="comments"><article><p>{body}</p><p>{body}</p></article></div>'
    assert a.main_text(f"<main><p>{body}</p></main>{comments}") == text


def test_pages_of_short_blocks_only():
    assert a.main_text("<h1>Soup</h1><p>Cut the leeks.</p><p>Boil them in water.</p>") == "Soup\nCut the leeks.\nBoil them in water."
    line = "市立図書館は改修工事を終えて水曜日に再び開館し、多くの市民が朝から列を作って待っていた。"
    assert a.main_text("<div>" + f"<p>{line}</p>" * 12 + "</div>") == "\n".join([line] * 12)
    links = "".join(f"<li><a href=/{i}>A link to page number {i}</a></li>" for i in range(9))
    assert a.main_text(f"<nav><a href=x>Home</a></nav><ul>{links}</ul><p>Contact</p>") == ""


def test_formulas_and_linked_sentences_of_an_article_stay():
    page = f"<article><p>{PROSE}</p><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p><p><a href=x>The whole report can be read on this page of the town.</a></p><p>{PROSE}</p></article>"
    assert a.main_text(page).split("\n")[1:3] == ["So x=2 holds.", "The whole report can be read on this page of the town."]


def test_time_is_in_proportion_to_the_length():
    def seconds(page):
        start = time.process_time()
        a.main_text(page)
        return time.process_time() - start

    for make in (lambda n: "<a x" * n + "'", lambda n: "<div>" * n + "x" + "</div>" * n, lambda n: "<div>" * n + "</p>" * n, lambda n: "<p \"" * n):
        assert seconds(make(40_000)) < 16 * max(seconds(make(10_000)), 0.02)
