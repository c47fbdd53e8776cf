"""Main text of HTML pages by two passes of block rules.

A page is cut into blocks at block-level tags.  First pass, each block by itself: its length, the
share of its characters within links and the share of stop words give good, bad, near-good or
short; on a page without any good block the near-good ones are the best there is and become good.  Second pass, in context: headings and short blocks near good text, then each undecided
block takes the label of its nearest decided neighbours (near-good needs one good neighbour, short
needs both); a page's edges count as bad.  The good blocks are the text.  Tags are found by a scanner that
goes over the page once, whatever its markup.

Edge cases: a null or empty page has no block and an empty text; an empty table gives no rows; unclosed comments and scripts
end at the page's end, where an unclosed tag is text, and an unclosed title is none; unknown entities stay as they are; a null page_id is a page as any other;
repeated rows are repeated in the result; pages of any length are taken whole; further columns are
ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import STOP_WORDS
from .shared import small_batches

LENGTH_LOW, LENGTH_HIGH = 70, 200
STOPS_LOW, STOPS_HIGH = 0.15, 0.30
LINKS_HIGH = 0.2
HEADING_REACH = 200

_STOPS = frozenset(STOP_WORDS.split())
_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9]*")
_HIDDEN = frozenset("script style noscript template svg head".split())
_LETTER = re.compile(r"[a-zA-Z0-9_]")
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section select summary table tbody td textarea tfoot th thead tr ul".split()
)
_HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_FURNITURE = frozenset(("nav", "footer", "aside", "form", "select", "option"))


def _close(page: str, low: str, name: str, at: int, none: set[str]) -> tuple[int, int]:
    """(start, end) of the first `</name` tag from `at` on, or the page's end; names without a further one are noted."""
    if name not in none:
        i = low.find(f"</{name}", at)
        while i >= 0:
            end = i + len(name) + 2
            while page[end : end + 1].isspace():
                end += 1
            if page[end : end + 1] == ">":
                return i, end + 1
            i = low.find(f"</{name}", end)
        none.add(name)
    return len(page), len(page)


def tags(page: str) -> Iterator[tuple[str, str]]:
    """(text before it, name of the tag or empty) in order; a closing tag's name begins with a slash, the last one's is empty.

    Hidden elements, comments and declarations are tags without a name, hidden elements with their contents.  Whatever isn't found
    once isn't looked for again, so each character is passed over a bounded number of times.
    """
    low, at, start, none = page.lower(), 0, 0, set()
    if len(low) != len(page):  # a few capitals have longer small forms
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in page)
    while (i := page.find("<", at)) >= 0:
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            yield page[start:i], ""
            start = at = end + 3 if end >= 0 else len(page)
            continue
        m = _NAME.match(page, i + 1)
        if not m and page[i + 1 : i + 2] not in ("!", "?", "/"):
            at = i + 1
            continue
        end = page.find(">", i + 1)
        if end < 0:  # no tag ends any more, and a comment goes to the page's end
            comment = page.find("<!--", i)
            yield page[start : comment if comment >= 0 else len(page)], ""
            return
        name = m.group().lower() if m else ""
        yield page[start:i], "" if name in _HIDDEN else name
        start = at = end + 1
        if name in _HIDDEN and not _LETTER.match(page, m.end()):
            start = at = _close(page, low, name, end + 1, none)[1]
    yield page[start:], ""


def page_title(page: str | None) -> str:
    """The first title's text; none if it isn't closed."""
    low = (page or "").lower()
    if len(low) != len(page or ""):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in page)
    i = low.find("<title")
    while i >= 0 and _LETTER.match(low, i + 6):
        i = low.find("<title", i + 6)
    begin = low.find(">", i) if i >= 0 else -1
    end = low.find("</title", begin) if begin >= 0 else -1
    return " ".join(html.unescape(page[begin + 1 : end]).split()) if end >= 0 else ""


def blocks(page: str | None) -> list[tuple[str, int, bool, bool]]:
    """(text, characters within links, heading, within furniture such as navigation) of each block that has text."""
    out: list[tuple[str, int, bool, bool]] = []
    if not page:
        return out
    parts: list[str] = []
    state = {"linked": 0, "link": 0, "heading": False, "outside": 0, "breaks": 0}

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append((text, min(state["linked"], len(text)), state["heading"], state["outside"] > 0))
        parts.clear()
        state["linked"] = 0

    def take(piece: str) -> None:
        if piece:
            parts.append(piece)
            if state["link"]:
                state["linked"] += len(" ".join(html.unescape(piece).split()))

    for text, name in tags(page):
        take(text)
        closing = name.startswith("/")
        name = name.removeprefix("/")
        if not name:
            parts.append(" ")
            continue
        if name == "br":
            parts.append(" ")
            state["breaks"] += 1
            if state["breaks"] == 2:  # two line breaks end a paragraph
                flush()
            continue
        state["breaks"] = 0 if name in _BLOCK else state["breaks"]
        if name == "a":
            state["link"] = 0 if closing else 1
        elif name in _BLOCK:
            flush()
            state["link"] = 0
            if name in _HEADING:
                state["heading"] = not closing
            if name in _FURNITURE:
                state["outside"] = max(0, state["outside"] + (-1 if closing else 1))
    flush()
    return out


def classify(text: str, linked: int, outside: bool) -> str:
    """First pass."""
    n = len(text)
    if linked / n > LINKS_HIGH or "©" in text:
        return "bad"
    if n < LENGTH_LOW:
        return "bad" if linked or outside else "short"
    words = text.lower().split()
    stops = sum(w.strip(".,;:!?\"'()") in _STOPS for w in words) / len(words)
    if outside:
        return "bad" if n < LENGTH_HIGH or stops < STOPS_HIGH else "neargood"
    if stops >= STOPS_HIGH:
        return "good" if n > LENGTH_HIGH else "neargood"
    return "neargood" if stops >= STOPS_LOW else "bad"


def revise(kinds: list[str], headings: list[bool], sizes: list[int]) -> list[str]:
    """Second pass: every block good or bad."""
    n = len(kinds)
    first = list(kinds)
    # A short heading is near-good if good text follows within reach.
    for i in range(n):
        if headings[i] and first[i] == "short":
            reach, j = 0, i + 1
            while j < n and reach <= HEADING_REACH:
                if first[j] in ("good", "neargood"):
                    kinds[i] = "neargood"
                    break
                reach += sizes[j]
                j += 1

    def nearest(of: list[str], skip: tuple[str, ...]) -> tuple[list[str], list[str]]:
        left, right, last = [""] * n, [""] * n, "bad"
        for i in range(n):
            left[i] = last
            last = last if of[i] in skip else of[i]
        last = "bad"
        for i in reversed(range(n)):
            right[i] = last
            last = last if of[i] in skip else of[i]
        return left, right

    # Short blocks: both nearest decided neighbours, or a near-good block beside them if those differ.
    left, right = nearest(kinds, ("short", "neargood"))
    near_left, near_right = nearest(kinds, ("short",))
    done = list(kinds)
    for i in range(n):
        if kinds[i] == "short":
            if left[i] == right[i]:
                done[i] = left[i]
            else:
                good_side = near_left[i] if left[i] == "good" else near_right[i]
                bad_side = near_right[i] if left[i] == "good" else near_left[i]
                done[i] = "good" if bad_side == "neargood" and good_side in ("good", "neargood") else "bad"
    left, right = nearest(done, ("neargood",))
    return ["good" if k == "good" or (k == "neargood" and "good" in (left[i], right[i])) else "bad" for i, k in enumerate(done)]


def extract(page: str | None) -> tuple[str, str, int, int]:
    """(title, main text, blocks, good blocks)."""
    bs = blocks(page)
    kinds = [classify(t, k, o) for t, k, _, o in bs]
    if kinds and not any(k in ("good",) for k in kinds) and "neargood" in kinds:
        # Without a long block, near-good text is the best there is.
        kinds = ["good" if k == "neargood" else k for k in kinds]
    labels = revise(kinds, [h for _, _, h, _ in bs], [len(t) for t, *_ in bs])
    good = [t for (t, *_), k in zip(bs, labels) if k == "good"]
    return page_title(page), "\n".join(good), len(bs), len(good)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [extract(x) for x in b.column(2).to_pylist()]
        title, text, n, good = zip(*rows) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(title, pa.string()), pa.array(text, pa.string()), pa.array(n, pa.int32()), pa.array(good, pa.int32())],
            ["page_id", "url", "title", "text", "n_blocks", "n_good"],
        )


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, text, n_blocks, n_good) of every page."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_extract, "page_id long, url string, title string, text string, n_blocks int, n_good int")
