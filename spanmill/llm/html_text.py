"""Main text of web pages by the distribution of text over lines.

Markup is read once, tag by tag: scripts, styles and comments are dropped, block elements begin a line, and every
line knows whether it stands in an article or main element and whether in a menu, header, footer, sidebar, notice,
advert, form or reader comment (by element, or by the words of its class, id and role). Lines of the latter kind and
lines that are mostly links weigh nothing; any other weighs its length. The text begins where the sum over ``WINDOW``
lines surges above a bound with weight in the lines that follow, and ends where it dives to zero; all text between
such points is kept, in page order. A page with an article or main element is judged by its lines alone, so there the
bound is a single character; elsewhere it is ``SURGE``.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanmill.llm.tasks import Batches, in_arrow

WINDOW, SURGE, LINKS = 3, 80, 0.5

_OPEN = re.compile(r"<(?=[!?/A-Za-z])")
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
_TORN = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)(?:>|\Z)")
_NAME = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")

_RAW = frozenset("script style noscript template iframe svg math canvas object audio video textarea select button head title".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_OUTSIDE = frozenset("nav aside footer form menu search dialog fieldset".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role names that mark what is not the article.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements sponsor sponsored promo promotion sidebar aside menu nav navbar navigation breadcrumb"
    " breadcrumbs masthead footer comment comments disqus respond replies cookie cookies consent notice notices alert banner popup modal overlay"
    " newsletter subscribe subscription signup login share sharing social related recommended widget toolbar pagination pager gdpr contentinfo"
    " complementary search copyright legal".split()
)
_TOP_MARKS = frozenset("header topbar".split())
#: Elements whose end may be left out: the next of the same kind, or the end of their parent, closes them.
_LOOSE = frozenset("p li dd dt tr td th option thead tbody tfoot".split())


def _marked(element: str, attributes: str, in_main: bool) -> bool:
    if element in _OUTSIDE or (element == "header" and not in_main):
        return True
    if not attributes or element in ("html", "body", "main"):
        return False
    if _HIDDEN.search(attributes):
        return True
    for found in _NAME.finditer(attributes):
        words = {w.lower() for w in _WORD.findall(next(g for g in found.groups() if g is not None))}
        if words & _MARKS or (not in_main and words & _TOP_MARKS):
            return True
    return False


def page_lines(page: str) -> list[tuple[str, int, int, bool, bool]]:
    """(text, characters, of these in links, in main, marked) of the lines of a page."""
    lines: list[tuple[str, int, int, bool, bool]] = []
    pieces: list[str] = []
    linked = links = main = marked = 0
    stack: list[tuple[str, bool, bool]] = []

    def end_line() -> None:
        nonlocal linked
        if pieces:
            text = _SPACE.sub(" ", html.unescape("".join(pieces))).strip()
            if text:
                lines.append((text, len(text), min(linked, len(text)), main > 0, marked > 0))
            pieces.clear()
        linked = 0

    def leave(position: int) -> None:
        nonlocal main, marked
        for _, in_main, is_marked in stack[position:]:
            main -= in_main
            marked -= is_marked
        del stack[position:]

    at = 0
    while at < len(page):
        opening = _OPEN.search(page, at)
        until = opening.start() if opening else len(page)
        if until > at:
            pieces.append(page[at:until])
            if links:
                linked += until - at
        if opening is None:
            break
        tag = _TAG.match(page, until) or _TORN.match(page, until)
        if tag is None:  # a comment or declaration, or a sign that begins no tag
            marks = ("<!--", "-->") if page.startswith("<!--", until) else ("<![CDATA[", "]]>") if page.startswith("<![CDATA[", until) else ("<", ">")
            if page[until + 1] == "/":
                marks = ("</", ">")
            end = page.find(marks[1], until + len(marks[0]))
            at = len(page) if end < 0 else end + len(marks[1])
            continue
        at = tag.end()
        closing, element = tag[1], tag[2].lower()
        if element in _RAW:
            if not closing and not tag[3].rstrip().endswith("/"):
                end = re.compile(rf"</{element}\b", re.I).search(page, at)
                at = end.start() if end else at if element in ("head", "button") else len(page)
        elif element == "a":
            links = max(0, links - 1) if closing else 1
        elif element == "br":
            pieces.append(" ")
        elif element in _BLOCKS:
            end_line()
            links = 0
            if closing:
                for position in range(len(stack) - 1, -1, -1):
                    if stack[position][0] == element:
                        leave(position)
                        break
            elif element not in _VOID:
                if element in _LOOSE and stack and stack[-1][0] == element:
                    leave(len(stack) - 1)
                is_marked = _marked(element, tag[3] or "", main > 0)
                in_main = element in ("article", "main") or 'role="main"' in (tag[3] or "")
                stack.append((element, in_main, is_marked))
                main += in_main
                marked += is_marked
    end_line()
    return lines


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The text between surges and dives of a page, blocks joined by two line breaks; empty if there is none."""
    lines = page_lines(page or "")
    framed = any(in_main and not marked for _, _, _, in_main, marked in lines)
    weights = np.array([0 if marked or (framed and not in_main) or (not framed and linked > LINKS * size) else size for _, size, linked, in_main, marked in lines], np.int64)
    if not weights.any():
        return ""
    bound = 1 if framed else min(surge, int(weights.sum()))
    total = np.concatenate([[0], np.cumsum(np.concatenate([weights, np.zeros(window, np.int64)]))])
    sums = total[window:] - total[:-window]
    kept, i = [], 0
    while i < len(weights):
        if weights[i] and sums[i] >= bound:
            while i < len(weights) and sums[i]:
                if weights[i]:
                    kept.append(lines[i][0])
                i += 1
        else:
            i += 1
    return "\n\n".join(kept)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages`` (page_id, url, html).

    Character references are decoded, white space within a block becomes one space, nothing is capped.

    Edge cases: a null or empty page, and one without text, gives an empty text; markup that is cut off or never
    closed is read as far as it goes; repeated rows and null ids are judged one by one; an empty table gives an empty
    result. Other columns are ignored.
    """

    def run(batches: Batches) -> Batches:
        for batch in batches:
            texts = [main_text(page) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return in_arrow(pages.select("page_id", "url", "html"), run, "page_id bigint, url string, text string, n_chars bigint")
