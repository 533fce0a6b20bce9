"""The whole rule of main texts against a version that looks at every line and element anew."""

import random

import numpy as np
import pytest

from foliant.llm import html


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def page(seed):
    rng = random.Random(seed)
    classes = ["", "", " class=content", " class='ad slot'", " class=notice-board-history", " class=comments", " class=sidebar", " role=navigation", " id=main-text"]

    def block(deep):
        kind = rng.choice(("p", "p", "p", "h2", "list", "box", "links", "bare", "form"))
        if kind == "box" and deep:
            tag = rng.choice(("div", "div", "section", "nav", "footer", "aside", "header", "article", "main"))
            return f"<{tag}{rng.choice(classes)}>" + "".join(block(deep - 1) for _ in range(rng.randint(0, 5))) + f"</{tag}>"
        if kind == "links":
            return "<ul>" + "".join(f"<li><a href=x>{prose(rng, 2)}</a></li>" for _ in range(rng.randint(1, 5))) + "</ul>"
        if kind == "list":
            return "<ol>" + "".join(f"<li>{prose(rng, rng.randint(1, 20))}</li>" for _ in range(rng.randint(1, 4))) + "</ol>"
        if kind == "form":
            return f"<form>{prose(rng, 3)}</form><script>{prose(rng, 3)}</script>"
        if kind == "bare":
            return prose(rng, rng.randint(1, 12)) + "<br>"
        tag = kind if kind == "h2" else "p"
        return f"<{tag}>{prose(rng, rng.choice((1, 5, 30, 60)))}<b>{prose(rng, 1)}</b></{tag}>"

    return "<html><body>" + "".join(block(3) for _ in range(rng.randint(1, 8))) + "</body></html>"


def plain_main_text(text):
    found = html.page_lines(text)
    lines, elements = found.lines, found.elements

    def up(n):
        while True:
            yield n
            if n == 0:
                return
            n = elements[n].parent

    size = lambda xs: sum(len(x.text) for x in xs)
    inside = lambda n: [x for x in lines if n in up(x.at)]
    title = lambda n: any(e.tag in ("h1", "article", "main") and n in up(k) for k, e in enumerate(elements))
    own = {}
    for n, e in enumerate(elements):
        shell = title(n) and 2 * size(inside(n)) >= size(lines)
        own[n] = 1.0 if e.anew or n == 0 else 0.0 if e.hard else min(e.weight, 1.0 if shell else e.hint)

    def chain(n):
        """Elements from n up to the nearest article that starts anew."""
        for k in up(n):
            yield k
            if elements[k].anew:
                return

    weight = [min(own[k] for k in chain(x.at)) for x in lines]
    lowered = [min((k for k in chain(x.at) if min(elements[k].weight, own[k] or 1.0) < 1 and own[k] <= 1), default=0) for x in lines]
    if not any(w == 1 for w in weight):
        return ""
    seeds = html.seeds_of(lines, weight)
    free = []
    for x, w, o in zip(lines, weight, lowered, strict=True):
        block = [(y, s) for y, s, p in zip(lines, seeds, lowered, strict=True) if p == o]
        free.append(w > 0 and (not o or 2 * size(y for y, s in block if s) >= size(y for y, _ in block)))
    seeds = [s and ok for s, ok in zip(seeds, free, strict=True)]
    marked = [x for x, s in zip(lines, seeds, strict=True) if s]

    def gain(n):
        return sum((1 if s else -1) * len(x.text) for x, s, ok in zip(lines, seeds, free, strict=True) if ok and n in up(x.at))

    holds = lambda n: any(n in up(x.at) for x in marked)
    root = max((n for n, e in enumerate(elements) if e.tag not in html.HEADINGS | html.INLINE and holds(n)), key=lambda n: (gain(n), elements[n].tag in ("article", "main"), n))
    article = next((n for n in up(root) if elements[n].tag in ("article", "main")), None)
    out = []
    first, last = (f(i for i, s in enumerate(seeds) if s) for f in (min, max))
    heading = max((i for i in range(first) if free[i] and lines[i].heading), default=None)
    for i, x in enumerate(lines):
        if not free[i]:
            continue
        if article is not None:
            if article in up(x.at) and (x.heading or not any(elements[k].tag == "header" for k in up(x.at))):
                out.append(x.text)
            continue
        bare = [k for k in up(x.at) if not holds(k) and k]
        b = bare[-1] if bare else 0
        group = inside(b) if b else [x]
        menu = 2 * sum(y.linked for y in group) >= size(group) if b else 2 * x.linked > len(x.text)
        whole = elements[root].tag in ("", "html", "body")
        near = root in up(x.at) and (first < i < last or not whole or (b and elements[b].tag in ("p", "ul", "ol", "pre", "blockquote", *html.HEADINGS)))
        if seeds[i] or (near and not menu) or (i == heading and elements[b].tag in html.HEADINGS):
            out.append(x.text)
    return " ".join(out)


@pytest.mark.parametrize("seed", range(150))
def test_main_text_equals_plain_version(seed):
    text = page(seed)
    assert html.main_text(text) == plain_main_text(text)


def test_density_decides_and_class_words_weigh(monkeypatch):
    rng = random.Random(5)
    paragraph = lambda n=60: f"<p>{prose(rng, n)}</p>"
    text = (
        "<body><nav><a href=a>Home</a></nav><div class=ad>Buy this now, it is cheap.</div><article><h1>Title</h1>" + paragraph()
        + f"<div class='notice-board-history'><h2>Boards</h2>{paragraph()}</div><div class='comments-on-the-treaty'>{paragraph()}</div>" + paragraph()
        + f"<div class='comments'>{paragraph()}<p>nice read</p></div></article><footer>&copy; somebody</footer></body>"
    )
    found = html.main_text(text)
    assert found.startswith("Title ") and "Boards" in found and len(found.split()) == 1 + 1 + 4 * 60 and "nice" not in found
    monkeypatch.setattr(html, "seeds_of", lambda lines, weight: [True] * len(lines))
    assert "Buy this" in html.main_text(text) and "nice read" in html.main_text(text)


def test_smoothed_ratios_choose_the_seeds():
    lines = [html.Line("x" * n, t, 0, k, False) for n, t, k in ((10, 5, 10), (300, 2, 0), (20, 1, 0), (280, 2, 10), (12, 6, 12), (9, 9, 9))]
    ratios = np.array([(len(x.text) - x.linked) / x.tags for x in lines])
    smooth = html.smoothed(ratios)
    assert html.seeds_of(lines, [1.0] * 6) == [bool(s >= smooth.std() and r >= smooth.std()) for s, r in zip(smooth, ratios, strict=True)]
