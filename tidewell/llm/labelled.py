"""A small labelled table of web pages: markup in page order, and whether it belongs to the article."""

from __future__ import annotations

WORDS = "the river rose over night and people of both towns moved their boats to higher ground before noon".split()


def text(words: int) -> str:
    """So many words of prose."""
    return " ".join(WORDS[i % len(WORDS)] for i in range(words)) + "."


def par(*words: int) -> str:
    return "".join(f"<p>{text(n)}</p>" for n in words)


def links(count: int, words: int = 1, item: str = "li") -> str:
    return "".join(f'<{item}><a href="/{i}">{text(words)}</a></{item}>' for i in range(count))


def linked(before: int, inside: int, after: int) -> str:
    """A paragraph with a link in it."""
    return f'<p>{text(before)} <a href="/x">{text(inside)}</a> {text(after)}</p>'


NAV = f"<nav><ul>{links(6)}</ul></nav>"
FOOT = "<footer>&copy; 2020 the towns &middot; all rights reserved</footer>"

#: Pages as lists of (belongs to the article, markup).
PAGES: list[list[tuple[bool, str]]] = [
    # A news page with an article element, an advert and one-word paragraphs.
    [(False, NAV + f'<div class="ad">{text(9)}</div>'), (True, f"<article><h1>{text(7)}</h1>" + par(60, 2, 1, 35, 4)), (False, "</article>" + FOOT)],
    # The same with prose in the advert, the sidebar and the readers' comments.
    [
        (False, f"<header><h2>{text(3)}</h2></header>" + NAV + f'<div class="cookie-notice"><p>{text(30)}</p></div>'),
        (True, f"<article><header><h1>{text(9)}</h1></header>" + par(45) + linked(20, 3, 10)),
        (False, f'<div class="advert">{text(25)}</div>'),
        (True, par(3, 80) + f"<ul>{links(2, 4)}<li>{text(12)}</li></ul>"),
        (False, f'</article><aside><p>{text(40)}</p></aside><section id="comments"><h3>{text(1)}</h3>{par(30, 50)}</section>' + FOOT),
    ],
    # Main element; prose outside it.
    [
        (False, f"<div><p>{text(40)}</p></div>" + NAV),
        (True, f"<main><h1>{text(5)}</h1>" + par(2, 90, 1) + f"<table><tr><td>{text(1)}</td><td>{text(2)}</td></tr></table>"),
        (False, f'<form><p>{text(20)}</p><label>{text(3)}</label></form>'),
        (True, f"<h2>{text(3)}</h2>" + par(18) + f"<blockquote>{text(30)}</blockquote>"),
        (False, f"</main><div><p>{text(28)}</p></div>" + FOOT),
    ],
    # A place named by its class.
    [
        (False, f'<div class="topbar"><p>{text(14)}</p></div><ul class="menu">{links(5, 2)}</ul>'),
        (True, f'<div class="post-content"><h1>{text(8)}</h1>' + par(50, 5)),
        (False, f'<div class="share">{text(4)}</div><div class="related"><ul>{links(3, 8)}</ul></div>'),
        (True, par(33, 1)),
        (False, f'</div><div><p>{text(22)}</p></div><div class="comment"><p>{text(26)}</p></div>'),
    ],
    # Articles that end in links, quote long passages, or hold single words between long paragraphs.
    [
        (False, f'<div class="site-header"><p>{text(12)}</p></div>' + NAV),
        (True, f"<article><h1>{text(6)}</h1>" + par(150, 1, 110, 2, 130) + f"<ul>{links(4, 3)}</ul><p><a href='/m'>{text(4)}</a></p>" + par(95)),
        (False, f'</article><div><p>{text(120)}</p><p>{text(60)}</p></div><div class="newsletter"><p>{text(35)}</p></div>' + FOOT),
    ],
    [
        (False, NAV + f'<div class="sidebar"><p>{text(70)}</p><ul>{links(5, 5)}</ul></div>'),
        (True, f'<article class="story"><h1>{text(11)}</h1>' + par(1, 1, 3) + f"<ol>{links(3, 6)}</ol><p><a href='/n'>{text(9)}</a></p>" + par(2, 160)),
        (False, f'<div class="comments"><p>{text(90)}</p><p>{text(2)}</p></div></article><section><p>{text(75)}</p></section>' + FOOT),
    ],
    # No names at all: words, links and neighbours decide.
    [(False, f"<ul>{links(7)}</ul>"), (True, f"<h1>{text(6)}</h1>" + par(70, 40, 9, 55)), (False, f"<p>{text(5)}</p><ul>{links(6, 2)}</ul><p>{text(6)}</p>")],
    [(False, f"<div>{links(4, 2, 'span')}</div><p>{text(3)}</p>"), (True, f"<h1>{text(8)}</h1>" + par(30) + linked(25, 4, 12) + par(12, 64)), (False, f"<div>{links(8, 1, 'span')}</div><p>{text(8)}</p>")],
    [(False, f"<p><a href='/'>{text(2)}</a></p>"), (True, f"<h2>{text(4)}</h2>" + par(25, 31) + f"<h2>{text(3)}</h2>" + par(48)), (False, f"<div>{links(5, 6, 'p')}</div>")],
    [(False, f"<ul>{links(9, 3)}</ul>"), (True, f"<h1>{text(10)}</h1>" + par(20, 28, 22, 120)), (False, f"<p>{text(7)}</p><p><a href='/t'>{text(2)}</a></p>")],
    [(False, f"<ul>{links(5, 2)}</ul>"), (True, par(40, 11, 35)), (False, f"<ul>{links(4, 12)}</ul>")],
    [(False, f"<div>{links(6, 3, 'p')}</div>"), (True, par(55, 8, 60, 14)), (False, f"<div>{links(3, 20, 'p')}</div><p>{text(4)}</p>")],
    [(False, f"<ul>{links(3, 15)}</ul>"), (True, f"<h1>{text(5)}</h1>" + par(33, 10, 44, 18)), (False, f"<ul>{links(5, 14)}</ul>")],
    [(False, f"<ul>{links(8)}</ul>"), (True, par(65) + linked(10, 5, 20) + par(13, 28, 17)), (False, f"<p><a href='/s'>{text(16)}</a></p><p><a href='/u'>{text(13)}</a></p>")],
    # Nothing but an article's text, and nothing but a list of links.
    [(True, par(100))],
    [(True, par(24))],
    [(False, f"<ul>{links(12, 4)}</ul>")],
]
