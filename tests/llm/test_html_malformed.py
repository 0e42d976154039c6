"""Pages that leave tags, quotes and comments open take time with their length, not with its square."""

from __future__ import annotations

import random
import time

import pytest

from crossweave.llm import html_text

MB = 1 << 20
MALFORMED = {
    "open tags": "<a " * (MB // 3),
    "unmatched ends": "<div>" * 40_000 + "</section>" * 40_000,
    "declarations": "<!" * (MB // 2),
    "options without an end": "<option>x" * (MB // 9),
    "open quotes": '<a "' * (MB // 4),
    "two kinds of quotes": "<a '\"" * (MB // 5),
    "parts beside": "<aside>t " * 40_000,
    "lines in unknown elements": "<li><div>" + "<x-f>" * 40_000 + "<li></li>" * 40_000,
    "hidden spans": "<span hidden>" * 40_000 + "</b>" * 40_000 + "</span>" * 40_000,
    "open comments": "<!--" * (MB // 4),
    "many menus": "<nav>a</nav>" * 40_000,
    "nested forms": "<form>a<b>" * 40_000,
    "blanks in an end tag": "<button></button" + " " * MB,
}


@pytest.mark.parametrize("kind", MALFORMED)
def test_malformed_page_of_a_megabyte(kind):
    began = time.perf_counter()
    html_text.blocks_of(MALFORMED[kind])
    assert time.perf_counter() - began < 6  # under 1 s alone; the square of the length would be minutes


def plain_wrappers(parts, outside):
    """Each part is judged on the text that is shown at the time, summed anew."""
    own = [p.text for p in parts]
    for p in reversed(parts):
        if p.within >= 0:
            parts[p.within].text += p.text
            parts[p.within].article += p.article

    def shown(k=None):
        around, at = {k}, k
        while at is not None and at >= 0:
            around.add(at)
            at = parts[at].within
        seen = []
        for i, p in enumerate(parts):
            seen.append(i != k and (p.wraps or (k is not None and i in around)) and (p.within < 0 or seen[p.within]))
        return outside + sum(n for n, s in zip(own, seen, strict=True) if s)

    for k in sorted(range(len(parts)), key=lambda k: (parts[k].rank, -parts[k].text, k)):
        p, known = parts[k], shown()
        if p.text and p.rank < 2 and (p.text >= html_text.MOST * known or p.article >= max(1, known)):
            p.wraps = p.text >= html_text.MOST * shown(k) or p.article >= max(1, shown(k))
        elif p.text and p.rank == 2 and not known:
            p.wraps = not shown(k)


def test_wrappers_are_those_of_the_plain_rule():
    rng = random.Random(21)
    for _ in range(2000):
        rows = [(rng.randrange(-1, k), rng.randrange(3), rng.choice((0, 0, 1, 5, 30, 200, 1000)), rng.choice((0, 0, 0, 50, 300))) for k in range(rng.randrange(1, 14))]
        outside = rng.choice((0, 0, 3, 40))
        found, expected = ([html_text.Part(*r) for r in rows] for _ in range(2))
        html_text.find_wrappers(found, outside)
        plain_wrappers(expected, outside)
        assert [p.wraps for p in found] == [p.wraps for p in expected]


def test_text_after_an_open_tag_is_kept():
    article = "The text of the article is in this block and it is long enough to be the one that is of use to a reader. " * 3
    assert article.split(".")[0] in html_text.main_text(f"<body><div>{article}</div><p>less < more, <b <i>and so on</i></p></body>")
