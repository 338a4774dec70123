"""Pages in linear time, and containers at any depth."""

import time

import pytest

from walkframe.llm import html

UNITS = ['<p class="', '<a "', "<a ", "</x ", "<div>", '<a ">" ', "<!-- ", "<b>", "<head>", "<li>", "<tr><td>", "</script", "<![CDATA[", "<ul><li><div>", "<b><p></p>", "<x y='\">", "<div class=c1>t", "<!"]


@pytest.mark.parametrize("unit", UNITS)
def test_no_page_takes_quadratic_time(unit):
    def seconds(n):
        began = time.process_time()
        html.extract("<p>before</p>" + unit * (n // len(unit)), [])
        return time.process_time() - began

    assert seconds(400_000) < 12 * max(0.05, seconds(100_000))


def test_quotes_and_ends():
    assert html.extract('<div><p title="a > b">x</p><p title="open>y</p><p>z</p></div>', []) == "x\ny\nz"
    assert html.extract("<div><p>a <!-- b", []) == "a" and html.extract("<div><p>a < b and c<3</p></div>", []) == "a < b and c<3"


def test_containers_deep_down_have_paths_of_their_own():
    page = html.Page("<div>" * 300 + "some text" + "<div class='x'>more text</div>")
    containers = [p for p, t in zip(page.path, page.tag) if t == "div"]
    assert len(set(containers)) == 301 and max(map(len, containers)) < 2 * html.LONG_PATH
    assert page.on_path(containers[250]) == [251]
