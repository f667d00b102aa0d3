"""Main text of web pages by a linear-chain conditional random field.

A page is cut into leaf blocks: runs of text between block tags. Each block
has binary features of its ancestors (tags; words of their class, id and role)
and of its text (length, link share, final punctuation). A two-label
linear-chain CRF, trained on labelled pages (``html_pages``, a fixed number
given by ``TRAIN_PAGES``), scores the blocks of a page as one sequence, and
Viterbi decoding picks the main text.

White space inside a block becomes one space, character references are
decoded, blocks are joined by two line breaks. Scripts, styles, titles,
templates, comments, drawings and form controls hold no text blocks. Only
script, style, textarea and title run to the page end if unclosed; another
element without text ends with what it lies in or at the next block. Formulas
are text, without their annotations.

Edge cases: null, empty and tagless pages (bare text is one block that the
model judges) give the empty text where nothing is main text; unclosed and
stray tags are closed or ignored as a browser would roughly do; repeated rows
are extracted row by row; an empty table gives an empty result; other columns
are ignored. Pages are independent: nothing is shuffled.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_pages import labelled_page

TRAIN_PAGES = 600
EPOCHS = 120
L2 = 1e-3

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*+>|<\?[^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in
        ("script", "style", "textarea", "title")}
# elements without text; those of _NESTED may hold their like
_HIDDEN = {t: re.compile(rf"<(/?){t}(?=[\s/>])[^>]*+>", re.I) for t in
           ("template", "noscript", "svg", "iframe", "select", "object", "annotation", "annotation-xml")}
_NESTED = frozenset(("template", "svg", "object"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog div
dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html label legend li main menu
nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
# tags that end an open element of the same group
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",),
           "td": ("td", "th"), "th": ("td", "th")}
# elements that an unclosed tag inside cannot be ended from without: of a
# paragraph, and of the items of lists and tables (fixed lists of the language)
_PARAGRAPH_SCOPE = ("table", "td", "th", "caption", "button", "object", "template", "marquee", "applet")
_ITEM_SCOPE = ("table", "ul", "ol", "dl")
_TAG_FEATURES = """article main section nav header footer aside form button label fieldset ul ol li dl
table td figure figcaption blockquote pre details dialog menu address p div h1 h2 h3 h4 h5 h6""".split()
# words in class, id and role names
_CLASS_WORDS = {
    "ad": "ad ads adv advert advertisement advertising adverts sponsor sponsored sponsors promo "
          "promotion promoted banner adbox adslot",
    "nav": "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc tabs",
    "comment": "comment comments commentlist reply replies respond response responses disqus "
               "discussion reviews",
    "notice": "notice notices cookie cookies consent gdpr alert warning popup modal overlay "
              "newsletter subscribe subscription signup disclaimer toast privacy paywall",
    "side": "sidebar side aside related recommended recommendations widget widgets more trending "
            "popular share sharing social tags author bio complementary",
    "footer": "footer foot copyright legal contentinfo bottom credits",
    "header": "header head masthead topbar top logo banner-top brand",
    "form": "form login search searchbox contact register",
    "content": "content article post entry body text main story prose paragraph",
}
_CLASS_OF = {w: k for k, words in _CLASS_WORDS.items() for w in words.split()}
_TEXT_FEATURES = ["words1", "words4", "words11", "words31", "link0", "link30", "link80", "stop",
                  "symbol", "bias"]
NAMES = ([f"in:{t}" for t in _TAG_FEATURES] + [f"class:{k}" for k in _CLASS_WORDS]
         + ["article+boilerplate", "header outside"] + _TEXT_FEATURES)
_BIT = {n: 1 << i for i, n in enumerate(NAMES)}
_INSIDE = sum(_BIT[f"in:{t}"] for t in ("article", "main")) | _BIT["class:content"]
_PLATE = sum(_BIT[f"class:{k}"] for k in _CLASS_WORDS if k != "content") | sum(
    _BIT[f"in:{t}"] for t in ("nav", "aside", "footer", "form"))


def _own_bits(tag: str, attributes: str) -> int:
    bits = _BIT.get(f"in:{tag}", 0)
    if attributes and ("=" in attributes):
        for m in _ATTRIBUTE.finditer(attributes):
            for word in re.split(r"[^a-z]+", (m[1] or m[2] or m[3] or "").lower()):
                kind = _CLASS_OF.get(word)
                if kind:
                    bits |= _BIT[f"class:{kind}"]
    return bits


def _text_bits(text: str, linked: int) -> int:
    n = text.count(" ") + 1
    share = linked / len(text)
    return (_BIT["words1" if n < 4 else "words4" if n < 11 else "words11" if n < 31 else "words31"]
            | _BIT["link0" if share < 0.3 else "link30" if share < 0.8 else "link80"]
            | (_BIT["stop"] if text[-1] in ".!?\"”»…:" else 0)
            | (_BIT["symbol"] if any(c in text for c in "©|»›·") else 0) | _BIT["bias"])


def _pairs(page: str, tag: str, last: int) -> dict[int, int]:
    """Start of every closed element of a tag of ``_HIDDEN``, and its end."""
    pairs: dict[int, int] = {}
    opened: list[int] = []
    for m in _HIDDEN[tag].finditer(page, 0, last + 1):
        if m[1]:
            if opened:
                pairs[opened.pop()] = m.end()
        elif tag != "svg" or not m[0].endswith("/>"):
            if tag not in _NESTED:
                opened.clear()
            opened.append(m.start())
    return pairs


def blocks(page: str) -> list[tuple[str, int, int]]:
    """(text, feature bits, place in the page) of every leaf block in order."""
    out: list[tuple[str, int, int]] = []
    stack: list[tuple[str, int]] = []
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements, by name
    parts: list[str] = []
    linked = in_link = hidden = 0
    pairs: dict[str, dict[int, int]] = {}
    shared = -1
    start = 0

    def flush() -> None:
        nonlocal parts, linked, shared
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            if text:
                bits = shared if shared >= 0 else 0
                if bits & _INSIDE and bits & _PLATE:
                    bits |= _BIT["article+boilerplate"]
                if bits & _BIT["in:header"] and not bits & _INSIDE:
                    bits |= _BIT["header outside"]
                out.append((text, bits | _text_bits(text, min(linked, len(text))), start))
        parts, linked, shared = [], 0, -1

    def take(text: str, at: int) -> None:
        nonlocal linked, shared, start
        if hidden:
            return
        if not parts:
            start = at
        parts.append(text)
        size = len(text.strip())
        if size:
            bits = stack[-1][1] if stack else 0
            shared = bits if shared < 0 else shared & bits
            if in_link:
                linked += size

    def close(index: int) -> None:
        nonlocal in_link, hidden
        for name, _ in stack[index:]:
            in_link -= name == "a"
            hidden -= name in _HIDDEN
            places[name].pop()
        del stack[index:]

    def push(name: str, bits: int) -> None:
        places[name].append(len(stack))
        stack.append((name, bits))

    def innermost(names: tuple[str, ...]) -> int:
        return max((places[n][-1] for n in names if places[n]), default=-1)

    at, end = 0, len(page)
    # no tag ends and no comment opens beyond here: the rest is text, and is
    # not searched again from every "<"
    last = max(page.rfind(">"), page.rfind("<!--"))
    while at < end:
        found = _TAG.search(page, at) if at <= last else None
        if not found:
            take(page[at:], at)
            break
        if found.start() > at:
            take(page[at:found.start()], at)
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if tag == "br":
            take(" ", at)
            continue
        if tag in _BLOCK:
            flush()
        if found[1]:
            if places[tag]:
                close(places[tag][-1])
            continue
        if tag in _RAW:
            stop = _RAW[tag].search(page, at)
            at = stop.end() if stop else end
            continue
        if tag in _HIDDEN and not (tag == "svg" and found[3].endswith("/")):
            if tag not in pairs:
                pairs[tag] = _pairs(page, tag, last)
            if found.start() in pairs[tag]:
                at = pairs[tag][found.start()]
            else:
                push(tag, stack[-1][1] if stack else 0)
                hidden += 1
            continue
        if hidden and tag in _BLOCK:
            close(next(i for i, (name, _) in enumerate(stack) if name in _HIDDEN))
        if tag in _VOID or tag == "head" or found[3].endswith("/"):
            continue
        if tag in _BLOCK and stack:
            for other in _CLOSES.get(tag, ("p",)):
                if innermost((other,)) > innermost(_PARAGRAPH_SCOPE if other == "p" else _ITEM_SCOPE):
                    close(places[other][-1])
                    break
        push(tag, (stack[-1][1] if stack else 0) | _own_bits(tag, found[3]))
        in_link += tag == "a"
    flush()
    return out


def _matrix(bits: list[int]) -> np.ndarray:
    return np.array([[b >> i & 1 for i in range(len(NAMES))] for b in bits], float)


def labelled_blocks(seed: int) -> tuple[list[int], list[int]]:
    """Feature bits and labels of the blocks of one labelled page."""
    fragments = labelled_page(seed)
    ends, total = [], 0
    for text, _ in fragments:
        total += len(text)
        ends.append(total)
    found = blocks("".join(t for t, _ in fragments))
    labels = [int(fragments[int(np.searchsorted(ends, at, side="right"))][1]) for _, _, at in found]
    return [b for _, b, _ in found], labels


class Crf:
    """Two-label linear-chain CRF: emission weights (features x 2), transition
    weights (2 x 2) and start weights (2)."""

    def __init__(self, emit: np.ndarray, move: np.ndarray, begin: np.ndarray):
        self.emit, self.move, self.begin = emit, move, begin
        self._scores: dict[int, tuple[float, float]] = {}

    def score(self, bits: int) -> tuple[float, float]:
        got = self._scores.get(bits)
        if got is None:
            on = [i for i in range(len(NAMES)) if bits >> i & 1]
            got = tuple(float(x) for x in self.emit[on].sum(axis=0))
            self._scores[bits] = got
        return got

    def decode(self, sequence: list[int]) -> list[int]:
        """Viterbi: the most probable labels."""
        if not sequence:
            return []
        (m00, m01), (m10, m11) = self.move.tolist()
        s0, s1 = self.score(sequence[0])
        a, b = self.begin[0] + s0, self.begin[1] + s1
        back = []
        for bits in sequence[1:]:
            s0, s1 = self.score(bits)
            to0, to1 = (a + m00, b + m10), (a + m01, b + m11)
            back.append((int(to0[1] > to0[0]), int(to1[1] > to1[0])))
            a, b = max(to0) + s0, max(to1) + s1
        labels = [int(b > a)]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def train(pages: list[tuple[list[int], list[int]]], epochs: int = EPOCHS) -> Crf:
    """Maximum likelihood with an L2 penalty by full-batch Adam; pages are
    padded to one array, forward and backward run over all pages at once."""
    pages = [p for p in pages if p[0]]
    width, n, f = max(len(b) for b, _ in pages), len(pages), len(NAMES)
    x, y, mask = np.zeros((n, width, f)), np.zeros((n, width), int), np.zeros((n, width))
    for i, (bits, labels) in enumerate(pages):
        x[i, :len(bits)], y[i, :len(bits)], mask[i, :len(bits)] = _matrix(bits), labels, 1
    gold = np.eye(2)[y] * mask[..., None]
    steps = gold[:, :-1, :, None] * gold[:, 1:, None, :]
    params = [np.zeros((f, 2)), np.zeros((2, 2)), np.zeros(2)]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]

    def log_sum(v: np.ndarray, axis: int) -> np.ndarray:
        top = v.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(v - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for t in range(1, epochs + 1):
        emit, move, begin = params
        score = x @ emit
        ahead, back = np.zeros((n, width, 2)), np.zeros((n, width, 2))
        ahead[:, 0] = begin + score[:, 0]
        for k in range(1, width):
            nxt = log_sum(ahead[:, k - 1, :, None] + move, 1) + score[:, k]
            ahead[:, k] = np.where(mask[:, k, None] > 0, nxt, ahead[:, k - 1])
        for k in range(width - 2, -1, -1):
            prev = log_sum(move + (score[:, k + 1] + back[:, k + 1])[:, None, :], 2)
            back[:, k] = np.where(mask[:, k + 1, None] > 0, prev, 0)
        z = log_sum(ahead[:, -1], 1)
        node = np.exp(ahead + back - z[:, None, None]) * mask[..., None]
        edge = np.exp(ahead[:, :-1, :, None] + move + (score + back)[:, 1:, None, :]
                      - z[:, None, None, None]) * mask[:, 1:, None, None]
        slopes = [np.einsum("nkf,nkl->fl", x, gold - node), (steps - edge).sum(axis=(0, 1)),
                  (gold - node)[:, 0].sum(axis=0)]
        for j, g in enumerate(slopes):
            g = g / n - L2 * params[j]
            first[j] = 0.9 * first[j] + 0.1 * g
            second[j] = 0.999 * second[j] + 0.001 * g * g
            params[j] = params[j] + 0.1 * (first[j] / (1 - 0.9 ** t)) / (
                np.sqrt(second[j] / (1 - 0.999 ** t)) + 1e-8)
    return Crf(*params)


@lru_cache(maxsize=4)
def model(train_pages: int = TRAIN_PAGES) -> Crf:
    """The model of a number of labelled pages (deterministic)."""
    return train([labelled_blocks(seed) for seed in range(train_pages)])


def main_text(page: str | None, crf: Crf) -> str:
    found = blocks(page or "")
    labels = crf.decode([b for _, b, _ in found])
    return "\n\n".join(t for (t, _, _), keep in zip(found, labels, strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html", train_pages: int = TRAIN_PAGES) -> DataFrame:
    """``page_id, url, text`` for every page; the small model is trained on
    the driver from generated pages and sent with the tasks."""
    fitted = model(train_pages)
    weights = (fitted.emit, fitted.move, fitted.begin)
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = Crf(*weights)
        for b in batches:
            texts = [main_text(h.as_py(), crf) for h in b.column("html")]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string())],
                names=["page_id", "url", "text"])

    kind = slim.schema["page_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"page_id {kind}, url string, text string")
