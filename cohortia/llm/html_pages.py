"""Labelled pages for the content model, written by rule.

The page table carries no labels, so training pages are composed here: random
layouts of main text and boilerplate blocks with known labels. Only structure
matters to the model (tags, class words, lengths, links), so the words are
random syllables. The number of pages is a parameter.
"""

from __future__ import annotations

import random

SYLLABLES = "an be ci do el fa gor hin is jo ka lu men no or pa qui re sen ta un ver wen xi yo zu".split()


def _words(rng: random.Random, low: int, high: int) -> str:
    words = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(rng.randint(low, high))]
    return " ".join(words)


def _sentence(rng: random.Random, low: int = 3, high: int = 25) -> str:
    return _words(rng, low, high).capitalize() + rng.choice(["."] * 8 + ["!", "?"])


def _prose(rng: random.Random) -> str:
    return " ".join(_sentence(rng) for _ in range(rng.choice([1, 1, 2, 3, 5, 8])))


def _link(rng: random.Random, text: str) -> str:
    return f'<a href="/{rng.randint(1, 999)}">{text}</a>'


def _inline(rng: random.Random, text: str) -> str:
    kind = rng.random()
    if kind < 0.1:
        return f"<b>{text}</b>"
    if kind < 0.2:
        words = text.split(" ")
        words[0] = _link(rng, words[0])
        return " ".join(words)
    if kind < 0.25:
        return f"<b>{text}<br>"
    return text


def _box(rng: random.Random, tag: str, names: list[str], inner: str) -> str:
    name = rng.choice(names)
    place = rng.choice(["class", "id"]) if name else ""
    attribute = f' {place}="{name}"' if name else ""
    return f"<{tag}{attribute}>{inner}</{tag}>"


def _menu(rng: random.Random) -> str:
    items = "".join(f"<li>{_link(rng, _words(rng, 1, 3))}</li>" for _ in range(rng.randint(3, 9)))
    return f"<ul>{items}</ul>"


def _boilerplate(rng: random.Random, kind: str) -> str:
    text, few = _prose(rng), _sentence(rng, 2, 10)
    if kind == "nav":
        if rng.random() < 0.6:
            return f"<nav>{_menu(rng)}</nav>"
        return _box(rng, "div", ["menu", "navbar", "breadcrumbs", "main-nav", "nav-links"], _menu(rng))
    if kind == "header":
        inner = rng.choice([f"<h1>{few}</h1>", f"<p>{few}</p>", f"<div>{few}</div>{_menu(rng)}"])
        return rng.choice([f"<header>{inner}</header>",
                           _box(rng, "div", ["site-header", "header", "masthead", "topbar"], inner)])
    if kind == "footer":
        inner = rng.choice([f"&copy; {few}", f"<p>{few}</p>", f"<p>{text}</p>{_menu(rng)}"])
        return rng.choice([f"<footer>{inner}</footer>"] * 2 + [
            _box(rng, "div", ["footer", "site-footer", "copyright"], inner)])
    if kind == "ad":
        return _box(rng, rng.choice(["div", "div", "section", "aside"]),
                    ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "ad-box"],
                    rng.choice([few, text, f"<p>{text}</p>", f"<p>{_link(rng, few)}</p>"]))
    if kind == "sidebar":
        inner = rng.choice([f"<h3>{few}</h3><p>{text}</p>", _menu(rng), f"<p>{text}</p>"])
        return rng.choice([f"<aside>{inner}</aside>",
                           _box(rng, "div", ["sidebar", "side-bar", "related", "widget", "recommended"], inner)])
    if kind == "notice":
        return _box(rng, rng.choice(["div", "section"]),
                    ["cookie-notice", "cookies", "consent", "notice", "alert", "newsletter", "popup",
                     "subscribe", "gdpr", "disclaimer"],
                    rng.choice([f"<p>{text}</p><button>{_words(rng, 1, 2)}</button>", text, f"<p>{few}</p>"]))
    if kind == "form":
        return (f"<form><label>{few}</label><input><p>{few}</p><select><option>{_words(rng, 1, 2)}"
                f"</option></select><button>{_words(rng, 1, 2)}</button></form>")
    inner = "".join(rng.choice([f"<p>{_prose(rng)}</p>", f"<div><b>{_words(rng, 1, 2)}</b>"
                                f"<p>{_prose(rng)}</p></div>", f"<li>{_prose(rng)}</li>"])
                    for _ in range(rng.randint(1, 5)))
    return _box(rng, rng.choice(["div", "section", "ol"]),
                ["comments", "comment-list", "user-comments", "responses", "replies", "discussion"],
                f"<h3>{_words(rng, 1, 3)}</h3>{inner}")


def _main(rng: random.Random, opening: bool) -> str:
    parts = []
    if opening and rng.random() < 0.85:
        title = f"<h1>{_sentence(rng)}</h1>"
        parts.append(rng.choice([title] * 5 + [f"<header>{title}</header>",
                                               f"<header>{title}<p>{_sentence(rng)}</p></header>"]))
    for _ in range(rng.choice([1, 1, 2, 3, 6, 12])):
        text = _inline(rng, rng.choice([_prose(rng)] * 5 + [
            _sentence(rng, 1, 4), f"{_words(rng, 2, 9)} | {_sentence(rng)}", _words(rng, 1, 12)]))
        parts.append(rng.choice([f"<p>{text}</p>"] * 12 + [
            f"<p>{text}", f"<h2>{_sentence(rng, 2, 8)}</h2><p>{text}</p>",
            f"<h3>{_words(rng, 1, 6)}</h3><p>{text}</p>", f"<h4>{_words(rng, 1, 6)}</h4><p>{text}</p>",
            f"<ul><li>{_sentence(rng)}</li><li>{_words(rng, 1, 5)}</li></ul>",
            f"<ol><li>{text}</li><li>{_sentence(rng)}</li></ol>",
            f"<section><p>{text}</p><p>{_prose(rng)}</p></section>",
            f"<section><h2>{_words(rng, 1, 6)}</h2><p>{text}</p></section>",
            f"<figure><figcaption>{_sentence(rng)}</figcaption></figure>",
            f"<dl><dt>{_words(rng, 1, 3)}</dt><dd>{_sentence(rng)}</dd></dl>",
            f"<blockquote>{text}</blockquote>", f"<blockquote><p>{text}</p></blockquote>",
            f"<div>{text}</div>", f"<div><p>{text}</p></div>", f"<pre>{_words(rng, 3, 20)}</pre>",
            f"<table><tr><td>{_words(rng, 1, 6)}</td><td>{_words(rng, 1, 6)}</td></tr></table>"]))
    return "".join(parts)


KINDS = ["nav", "header", "footer", "ad", "sidebar", "notice", "form", "comments"]


def labelled_page(seed: int) -> list[tuple[str, bool]]:
    """One page as (html fragment, is main text) in order; the fragments joined
    are the page. Boilerplate may stand inside the article element too."""
    rng = random.Random(seed)
    open_tag, close_tag = rng.choice([
        ("<article>", "</article>")] * 4 + [("<main>", "</main>"), ("<main><article>", "</article></main>"),
        ('<div class="content">', "</div>"), ('<div id="main-content">', "</div>"),
        ('<div class="post-body">', "</div>"), ('<div class="article-text">', "</div>"),
        ("<div>", "</div>"), ("", "")])
    page: list[tuple[str, bool]] = [("<html><head><title>x</title></head><body>", False)]
    for kind in rng.sample(KINDS, rng.randint(0, 5)):
        page.append((_boilerplate(rng, kind), False))
    page.append((open_tag, False))
    for k in range(rng.randint(1, 5)):
        page.append((_main(rng, k == 0), True))
        if rng.random() < 0.6:
            page.append((_boilerplate(rng, rng.choice(["ad", "sidebar", "form", "comments", "notice", "nav"])),
                         False))
    page.append((close_tag, False))
    for kind in rng.sample(KINDS, rng.randint(0, 5)):
        page.append((_boilerplate(rng, kind), False))
    page.append(("</body></html>", False))
    return page
