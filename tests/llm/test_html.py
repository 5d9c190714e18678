import random
import time

from dunlin.llm.html import extract, extract_pages

BODY = "This is a long paragraph, with commas, that tells the story of the page in many words. "


def test_article_without_the_rest():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <header>Site</header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- x --><div class="ad">Buy, buy, buy this thing that you never wanted to have at all.</div>
    <div class="cookie-notice">We use cookies, and so on, and so forth, for ever and ever.</div>
    <article><h1>Head &amp; line</h1><p><b>{BODY}<br><p>Second &eacute;&nbsp;x
      y</p><form>Name<input></form><blockquote>Quote, with words.</blockquote><ul><li>one<li>two</ul></article>
    <aside>Side</aside><div id="comments"><p>{BODY * 3}</p></div><footer>&copy; f</footer></body></html>"""
    assert extract(page) == "\n".join(["Head & line", BODY.strip(), "Second é x y", "Quote, with words.", "one", "two"])


def test_divs_and_siblings():
    page = f"<body><div class=menu><a href=x>{BODY}</a></div><div id=main><div><p>{BODY}</p><p>{BODY}</p></div><div><p>{BODY}</p></div></div><div><a href=1>l</a> <a href=2>m</a></div></body>"
    assert extract(page) == "\n".join([BODY.strip()] * 3)


def test_cut_and_odd_pages():
    assert extract(None) == extract("") == extract("<html><head><title>x</title></head></html>") == ""
    assert extract(f"<body><article><p>{BODY}</p><p>more &am") == f"{BODY.strip()}\nmore &am"
    assert extract("<article><p>short</p></article><footer>f</footer") == "short"
    assert extract("just text, no tags at all, but it is the page") == "just text, no tags at all, but it is the page"
    assert extract("<p>a < b and 3 > 2</p>") == "a < b and 3 > 2"
    deep = "<div>" * 3000 + f"<p>{BODY}</p>"
    assert extract(deep) == BODY.strip()


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>Hé</p>", "t"), (1, "u", "<p>Hé</p>", "t"), (None, None, None, None)], "page_id long, url string, html string, text string")
    out = extract_pages(df).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in out] == [(1, "Hé", 2), (1, "Hé", 2), (None, "", 0)]
    assert extract_pages(df.limit(0)).count() == 0


def test_short_parts_beside_the_best_container():
    page = f"<body><ul><li><a href=1>Home</a><li><a href=2>News</a></ul><h1>Title</h1><div id=main>Intro <a href=x>here</a> and on.<h2>Head</h2><div><p>{BODY}</p><p>{BODY}</p></div><blockquote>Quote</blockquote><div><p>{'short words ' * 8}</p></div><ul><li>one<li>two</ul><p>Short end.</p></div><div><a href=1>l</a></div></body>"
    assert extract(page) == "\n".join(["Title", "Intro here and on.", "Head", BODY.strip(), BODY.strip(), "Quote", ("short words " * 8).strip(), "one", "two", "Short end."])
    assert extract(f"<div id=main><h1>Title</h1><div><p>{BODY}</p><p>{BODY}</p></div><p>Short end.</p></div>") == "\n".join(["Title", BODY.strip(), BODY.strip(), "Short end."])


def test_names_weigh_but_do_not_decide():
    inside = f'<article><h1>T</h1><p>{BODY}</p><p class="share-price">The share price rose.</p><div class="story related-work"><p>{BODY}</p></div><div class="ad"><p>{BODY}</p></div><div class="share-buttons">Tell all</div></article>'
    assert extract(f"<body>{inside}</body>") == "\n".join(["T", BODY.strip(), "The share price rose.", BODY.strip()])
    # a container that holds nearly all stays, whatever it is called; reader comments never do
    assert extract(f'<body><div class="widget"><p>{BODY}</p><p>{BODY}</p></div><p>{BODY}</p></body>') == "\n".join([BODY.strip()] * 3)
    assert extract(f'<main><h1>T</h1><article><p>{BODY}</p></article><section><div><div><p>{BODY}</p></div></div></section><div class="post-comments"><article><p>{BODY * 9}</p></article></div></main>') == "\n".join(["T", BODY.strip(), BODY.strip()])
    assert extract(f"<body><h1>T</h1><article><p>{BODY}</p></article></body>") == f"T\n{BODY.strip()}"


def test_time_grows_with_length_only():
    n = 20_000
    pages = ["<div>" * n + "</p>" * n + BODY, "<p><table><tr><td>" + "<div>" * n + BODY, "<ul>" + "<div>" * n + "<li></li>" * n + BODY, "<span><div>x</div>" * n, "<b><p>word</p>" * n, "<div><p>word</p>" * n]
    for page in pages:
        began = time.time()
        assert extract(page)
        assert time.time() - began < 5


def test_marked_blocks_of_generated_pages():
    """Every block is planted as wanted or not; the text is exactly the wanted ones."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("aeinorst") for _ in range(rnd.randint(2, 8)))
    say = lambda n: " ".join(word() + rnd.choice(["", "", "", ","]) for _ in range(n)) + "."
    for _ in range(300):
        wanted: list[str] = []

        def keep(text: str) -> str:
            wanted.append(" ".join(text.split()))
            return text.replace(" ", rnd.choice([" ", "\n  "]), 2)

        def unwanted() -> str:
            return rnd.choice(
                [
                    lambda: f"<nav><ul><li><a href=x>{say(2)}</a></ul></nav>",
                    lambda: f"<aside>{say(20)}</aside>",
                    lambda: f"<div class='{rnd.choice(['ad', 'cookie-notice', 'promo-box', 'ad-slot', 'newsletter', 'share-bar'])}'><p>{say(15)}</p></div>",
                    lambda: f"<section id='comments'>{''.join(f'<p>{say(30)}</p>' for _ in range(rnd.randint(1, 9)))}</section>",
                    lambda: f"<form>{say(3)}<input></form>",
                    lambda: f"<script>{say(3)}</script><style>{say(3)}</style><!-- {say(3)} -->",
                    lambda: f"<div role=navigation>{say(4)}</div><p hidden>{say(9)}</p>",
                ]
            )()

        def part(depth: int = 0) -> str:
            kind = rnd.randint(0, 7 if depth < 3 else 4)
            if kind <= 2:
                return f"<p{rnd.choice(['', ' class=lead', ' class=share-price'])}>{keep(say(rnd.randint(3, 60)))}</p>"
            if kind == 3:
                return f"<h2>{keep(say(3))}</h2>"
            if kind == 4:
                return "<ul>" + "".join(f"<li>{keep(say(rnd.randint(1, 9)))}" for _ in range(rnd.randint(1, 4))) + "</ul>"
            if kind == 5:
                return unwanted()
            open_ = rnd.choice(["div", "section", "div class='story part'", "div class=block"])
            return f"<{open_}>" + "".join(part(depth + 1) for _ in range(rnd.randint(1, 4))) + f"</{open_.split()[0]}>"

        shell = rnd.choice(["article", "main", "div"])
        head = f"<h1>{keep(say(4))}</h1>"
        body = "".join(f"<p>{keep(say(60))}</p>" for _ in range(3)) + "".join(part() for _ in range(rnd.randint(2, 8)))
        page = f"<html><body><header>{say(3)}</header>{unwanted()}<{shell}>{head}{body}</{shell}>{unwanted()}<footer>{say(4)}</footer></body></html>"
        assert extract(page) == "\n".join(wanted), page
