"""Labelled pages that the DOM model learns from: layouts with known content and boilerplate.

An element labelled as content carries data-y="1"; its descendants are content too unless they carry data-y="0".
"""

from __future__ import annotations

import random
import re

from .html_tree import TOKEN, Page, read

_SYLLABLES = "an be ca do el fi go hu in ja ko la mi no or pa qu re sa to un ve wi xo ya za".split()


def _words(r: random.Random, n: int) -> str:
    words = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n)]
    out = []
    for i, w in enumerate(words):
        out.append((w.capitalize() if i == 0 or out[-1].endswith(".") else w) + ("." if r.random() < 0.08 else "," if r.random() < 0.06 else ""))
    return " ".join(out) + r.choice([".", ".", "", "!"])


def _links(r: random.Random, n: int, tag: str = "ul") -> str:
    return f"<{tag}>" + "".join(f'<li><a href="/{i}">{_words(r, r.randint(1, 3))}</a></li>' for i in range(n)) + f"</{tag}>"


def _menu(r: random.Random) -> str:
    inner = _links(r, r.randint(3, 9))
    return r.choice([f"<nav>{inner}</nav>", f'<div class="{r.choice(["menu", "nav-links", "navbar", "breadcrumb", "main-menu"])}">{inner}</div>', f'<ul id="nav">{inner}</ul>', f'<div role="navigation">{inner}</div>', f"<nav>{' | '.join(f'<a href=#>{_words(r, 1)}</a>' for _ in range(4))}</nav>"])


def _header(r: random.Random) -> str:
    inner = r.choice([f"<a href=/>{_words(r, 2)}</a>", f"<h1>{_words(r, 2)}</h1><p>{_words(r, 6)}</p>", f"<h2>{_words(r, 3)}</h2>{_menu(r)}", f"<div class=logo>{_words(r, 2)}</div>"])
    return r.choice([f"<header>{inner}</header>", f'<div class="{r.choice(["header", "site-header", "masthead", "topbar"])}">{inner}</div>', f'<div id="header">{inner}</div>'])


def _footer(r: random.Random) -> str:
    inner = r.choice([f"&copy; {_words(r, 3)} &middot; {_words(r, r.randint(5, 25))}", f"<p>{_words(r, 12)}</p>{_links(r, 4)}", f"<p>&copy; 2020 {_words(r, 3)}</p>", _words(r, r.randint(20, 60))])
    return r.choice([f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", f'<div class="{r.choice(["footer", "site-footer", "copyright", "legal"])}">{inner}</div>', f'<div id="footer">{inner}</div>'])


def _advert(r: random.Random) -> str:
    inner = r.choice([_words(r, r.randint(4, 40)), f"<p>{_words(r, r.randint(5, 60))}</p>", f"<a href=/x>{_words(r, 6)}</a>"])
    return r.choice([f'<div class="{r.choice(["ad", "ads", "advert", "ad-box", "sponsored", "promo", "advertisement"])}">{inner}</div>', f'<div id="ad-1">{inner}</div>', f'<aside class="ad">{inner}</aside>', f'<section class="promo">{inner}</section>'])


def _notice(r: random.Random) -> str:
    inner = r.choice([f"<p>{_words(r, r.randint(8, 40))}</p><button>{_words(r, 1)}</button>", _words(r, r.randint(6, 40)), f"{_words(r, 12)} <a href=/p>{_words(r, 2)}</a>"])
    return r.choice([f'<div class="{r.choice(["cookie", "cookie-banner", "consent", "notice", "alert", "popup", "modal", "gdpr"])}">{inner}</div>', f'<div id="cookie-notice" role="dialog">{inner}</div>', f"<dialog open>{inner}</dialog>", f'<section class="notice">{inner}</section>', f'<p class="notice">{_words(r, 15)}</p>'])


def _side(r: random.Random) -> str:
    inner = r.choice([f"<h3>{_words(r, 2)}</h3>{_links(r, 5)}", f"<h2>{_words(r, 3)}</h2><p>{_words(r, r.randint(10, 60))}</p>", f"<p>{_words(r, r.randint(10, 70))}</p>", _words(r, r.randint(10, 50))])
    return r.choice([f"<aside>{inner}</aside>", f"<aside>{inner}</aside>", f'<div class="{r.choice(["sidebar", "related", "widget", "recommended", "side"])}">{inner}</div>', f'<div id="sidebar">{inner}</div>', f'<section class="related-posts">{inner}</section>'])


def _form(r: random.Random) -> str:
    inner = f"<label>{_words(r, 2)}</label><input name=q><button>{_words(r, 1)}</button>"
    inner = r.choice([inner, f"<p>{_words(r, r.randint(5, 30))}</p>{inner}", f"{_words(r, r.randint(3, 12))} {inner}", f"<h3>{_words(r, 3)}</h3>{inner}<select><option>{_words(r, 1)}<option>{_words(r, 1)}</select>"])
    return r.choice([f"<form>{inner}</form>", f'<form class="newsletter">{inner}</form>', f'<div class="subscribe"><form>{inner}</form></div>', f'<div class="{r.choice(["login", "search-box", "signup"])}">{inner}</div>'])


def _comments(r: random.Random) -> str:
    each = r.choice(["li", "div", "p", "article"])
    inner = "".join(f'<{each}{r.choice(["", " class=comment", " class=reply"])}>' + r.choice([f"<b>{_words(r, 1)}</b> {_words(r, r.randint(4, 40))}", f"<p>{_words(r, r.randint(4, 80))}</p>"]) + f"</{each}>" for _ in range(r.randint(1, 5)))
    inner = f"<ul>{inner}</ul>" if each == "li" else inner
    inner = r.choice(["", f"<h2>{_words(r, 2)}</h2>", f"<h3>{_words(r, 1)}</h3>"]) + inner
    return r.choice([f'<section class="comments">{inner}</section>', f'<div class="comments">{inner}</div>', f'<div id="comments">{inner}</div>', f'<section id="discussion">{inner}</section>', f'<div class="comment-list">{inner}</div>', f'<ol class="commentlist">{inner}</ol>'])


def _share(r: random.Random) -> str:
    return r.choice([f'<div class="share">{_links(r, 3)}</div>', f'<ul class="social"><li><a href=#>{_words(r, 1)}</a></li></ul>', f'<div class="tags"><a href=#>{_words(r, 1)}</a></div>'])


def _hidden(r: random.Random) -> str:
    """An element that readers do not see."""
    how = r.choice(["hidden", 'style="display: none"', 'style="visibility:hidden"', 'aria-hidden="true"', 'class="sr-only"', 'class="visually-hidden"'])
    return r.choice([f"<p {how}>{_words(r, r.randint(3, 40))}</p>", f"<div {how}><p>{_words(r, r.randint(3, 60))}</p></div>"])


EXTRAS = (_menu, _header, _footer, _advert, _notice, _side, _form, _comments, _share, _hidden)


def _block(r: random.Random) -> str:
    kind, n = r.random(), r.choice([2, 5, 12, 30, 60, 120])
    if kind < 0.6:
        return f"<p>{_words(r, n)}</p>"
    if kind < 0.68:
        return f"<p><b>{_words(r, n)}<br><p>{_words(r, 5)}</p>"
    if kind < 0.76:
        return f"<{(h := r.choice(['h2', 'h3']))}>{_words(r, 4)}</{h}>"
    if kind < 0.82:
        return "<ul>" + "".join(f"<li>{_words(r, r.randint(2, 20))}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
    if kind < 0.87:
        return f"<blockquote>{r.choice(['', '<p>'])}{_words(r, 20)}</blockquote>"
    if kind < 0.91:
        return f"<table><tr><td>{_words(r, 3)}</td><td>{_words(r, 2)}</td></tr></table>"
    if kind < 0.95:
        return f"<p>{_words(r, 10)} <a href=/y>{_words(r, 3)}</a> {_words(r, 10)}</p>"
    if kind < 0.97:
        return f"<figure><figcaption>{_words(r, 6)}</figcaption></figure>"
    return r.choice([f"<pre>{_words(r, 10)}</pre>", f"<div>{_words(r, n)}</div>", f"<section><h2>{_words(r, 3)}</h2><p>{_words(r, n)}</p></section>"])


def _unmarked(html: str) -> str:
    """Boilerplate: its outermost elements get data-y=0."""
    return re.sub(r"^<([a-z0-9]+)", r'<\1 data-y="0"', html)


def _page(r: random.Random) -> str:
    inside = [f"<h1>{_words(r, r.randint(2, 9))}</h1>"] if r.random() < 0.9 else []
    inside += [_block(r) for _ in range(r.randint(1, 12))]
    for _ in range(r.choice([0, 0, 1, 2])):
        inside.insert(r.randint(1, len(inside)), _unmarked(r.choice((_advert, _side, _form, _share, _notice, _comments, _menu, _footer, _hidden))(r)))
    body = "".join(inside)
    article = r.choice([f'<article data-y="1">{body}</article>'] * 4 + [f'<main data-y="1">{body}</main>', f'<main><article data-y="1">{body}</article></main>', f'<div data-y="1" class="{r.choice(["content", "post", "entry-content", "article-body", "main-text", "story"])}">{body}</div>', f'<div data-y="1" id="{r.choice(["content", "main", "article"])}">{body}</div>', f'<div data-y="1">{body}</div>'])
    before = [_unmarked(f(r)) for f in r.sample([_menu, _header, _notice, _advert, _form, _side], r.randint(0, 4))]
    after = [_unmarked(f(r)) for f in r.sample([_footer, _comments, _advert, _side, _form, _menu, _notice, _share], r.randint(0, 5))]
    inner = "".join([*before, article, *after])
    if r.random() < 0.3:
        inner = f'<div class="{r.choice(["wrapper", "container", "page", ""])}">{inner}</div>'
    return f"<html><body>{inner}</body></html>"


def labelled_pages(count: int = 600, seed: int = 1) -> tuple[list[Page], list[list[int]]]:
    """Pages and the label of each of their nodes."""
    r, pages, labels = random.Random(seed), [], []
    for _ in range(count):
        html = _page(r)
        page = read(html)
        # the labels are read off a second tree of the same page, whose marks are the data-y values
        own = [""] + [(re.search(r'data-y="(\d)"', m[3]) or [None, ""])[1] for m in TOKEN.finditer(html) if m[2] and not m[1] and m[2].lower() in _block_names()]
        y = [0] * len(page.parent)
        for i in range(1, len(y)):
            y[i] = int(own[i]) if own[i] else y[page.parent[i]]
        pages.append(page)
        labels.append(y)
    return pages, labels


def _block_names() -> frozenset[str]:
    from .html_tree import BLOCKS

    return BLOCKS
