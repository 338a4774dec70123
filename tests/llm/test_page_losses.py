"""Articles come whole: in wrappers of any name, with an inner division, quote or table as their larger part."""

import random

import pytest

from walkframe.llm import html

WRAPPERS = ["layout-with-sidebar", "content sidebar-right", "long-form", "post share-enabled", "social-history", "form-page", "banner-story", "related-work", "notice-of-meeting", "copyright-law",
            "search-and-rescue", "modal-logic", "sponsored-run", "alert-level", "ad-hoc", "cookie-recipes", "menu-of-the-day", "widget-theory", "sidebar", "main-nav-open"]
NOISE = ["<nav><a href=x>menu one</a></nav>", "<div class='cookie-notice'>we use cookies</div>", "<aside>an aside</aside>", "<div class='share-buttons'>share this</div>", "<ul class='related-posts'><li>other</li></ul>", "<div class='comments'><p>a reader says</p></div>", "<footer>the end of the page</footer>"]


def sentence(rng, n):
    return " ".join(rng.choice("river stone letter engine garden winter paper market".split()) for _ in range(n))


@pytest.mark.parametrize("name", WRAPPERS)
def test_words_in_longer_names(name):
    rng = random.Random(name)
    text = [sentence(rng, 30) for _ in range(4)]
    inner = "<h1>A title</h1>" + "".join(f"<p>{t}</p>" for t in text)
    for tag in ("div", "section"):
        page = f"<html><body>{NOISE[0]}<main><{tag} class='{name}'>{inner}</{tag}></main>{NOISE[-1]}</body></html>"
        assert html.extract(page, []) == "\n".join(["A title", *text])


@pytest.mark.parametrize("seed", range(40))
def test_made_pages(seed):
    rng = random.Random(seed)
    lines = [f"Title {seed}", sentence(rng, 12), *[sentence(rng, rng.randint(20, 60)) for _ in range(rng.randint(4, 9))], sentence(rng, 9)]
    title, intro, *large, end = lines
    paragraphs = "".join(f"<p>{t}</p>" + rng.choice(["", "", NOISE[3]]) for t in large)
    part = rng.choice(["<div class='body'>{}</div>", "<section>{}</section>", "<blockquote>{}</blockquote>", "<table><tr><td>{}</td></tr></table>", "<div><div class='inner'>{}</div></div>", "{}"]).format(paragraphs)
    article = f"<h1>{title}</h1><p>{intro}</p>{part}<p>{end}</p>"
    around = rng.choice(["<article>{}</article>", "<article class='p'>{}</article>", "<div class='post'>{}</div>", "<main><div class='x1'>{}</div></main>"]).format(article)
    noise = rng.sample(NOISE, 4)
    page = f"<html><body>{noise[0]}{noise[1]}<div id='wrap'>{around}</div>{noise[2]}{noise[3]}</body></html>"
    assert html.extract(page, []) == "\n".join(lines)


def test_votes_go_to_whole_articles(spark):
    page = lambda i: f"<article><h1>Title {i}</h1><p>intro {i}</p><div class='body'>" + f"<p>{'long words here ' * 20}{i}</p>" * 3 + f"</div><p>end {i}</p></article>"
    rows = spark.createDataFrame([(i, "http://h.org/x", page(i)) for i in range(5)], "page_id long, url string, html string")
    for r in html.main_text(rows).collect():
        assert r.text.startswith(f"Title {r.page_id}\nintro {r.page_id}\nlong") and r.text.endswith(f"{r.page_id}\nend {r.page_id}")


def test_boilerplate_stays_hidden():
    long_notice = "<div class='cookie-notice'>" + "we use cookies " * 30 + "</div>"
    page = f"<html><body>{long_notice}<article><p>a short article of a few words only here</p></article><div class='comments'>" + "<p>readers say a lot</p>" * 40 + "</div></body></html>"
    assert html.extract(page, []) == "a short article of a few words only here"
    assert html.extract("<article><p>AT&am<b>p;</b>T</p></article>", []) == "AT&amp;T"
    teasers = "<html><body><div id=w><div class='story'><p>" + "the story goes on " * 9 + "</p></div><div class='teasers'><p>read this too</p></div></div></body></html>"
    assert html.extract(teasers, []) == ("the story goes on " * 9).strip()
    assert html.extract("<form><h1>T</h1><p>a page in one form</p></form>", []) == "T\na page in one form"
