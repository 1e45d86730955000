"""Main text of web pages by text-to-tag ratios.

A page is fed to the standard library's streaming parser in pieces. Its events are gathered into lines (one per block
element or source line break between tags) with their text and number of tags. The ratio of text to tags of each line is smoothed with a
Gaussian, and a threshold from the spread of the ratios separates content from the rest, on every page. Lines of menus, headers, footers,
sidebars, notices, adverts, forms, scripts and reader comments have no text of their own and split the page into regions;
a region is content if its smoothed ratio reaches the threshold anywhere, so short paragraphs between long ones stay.
``<article>`` and ``<main>`` are hints: each is one region, however often notices interrupt it, and its ratios count double, but it
must reach the threshold like any other, so teasers in ``<article>`` beside the body in a ``<div>`` are none. Where content in them holds
at least half of all content, regions outside are not content, apart from headings right before it. Outside of them,
lines that consist of links and stay below the threshold are cut.

Rules: a null page counts as empty; a page without text gives an empty text; unclosed and stray tags are tolerated;
repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow.llm.tables import slices

PIECE = 1 << 16
#: Standard deviation of the smoothing kernel in lines, its reach, and the threshold in spreads of the ratio.
SIGMA, REACH, SPREADS, HINT = 1.0, 2, 0.5, 2.0

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements whose text is never content.
OUTSIDE = frozenset("head title script style noscript template nav footer aside form button select textarea iframe svg canvas menu dialog object".split())
#: Words of class, id or role that mark what is around an article.
MARKS = frozenset((
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer "
    "gdpr header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo related replies reply respond "
    "search share sharing sidebar social sponsor sponsored subscribe toolbar widget").split())
#: A class word with one of these parts tells about the page around it ("has-sidebar", "comments-open").
TELLING = frozenset("has with without no is not open closed enabled disabled layout fixed".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
KERNEL = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-REACH, REACH + 1)]


class LineGatherer(HTMLParser):
    """Turns parser events into lines: [text pieces, tags, number of the article or main part, outside the content, heading,
    characters in links]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[list] = [[[], 0, 0, False, False, 0]]
        self.open: list[tuple[str, bool, int]] = []  # tag, outside, number of the part it begins
        self.outside = self.headings = self.links = self.parts = 0

    def _part(self) -> int:
        """The outermost article, or else the main part."""
        numbers = [(tag, number) for tag, _, number in self.open if number]
        return next((number for tag, number in numbers if tag == "article"), numbers[0][1] if numbers else 0)

    def _break(self) -> None:
        last, part = self.lines[-1], self._part()
        if last[0] or last[3] != bool(self.outside) or last[2] != part:
            self.lines.append([[], 0, part, bool(self.outside), False, 0])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.lines[-1][0].append("\n")
            return
        if tag not in VOID:
            whole = tag in ("body", "article", "main")
            marked = _marked(attrs, whole)
            if whole and not marked:
                self._close_unclosed()
            outside = tag in OUTSIDE or marked or (tag == "header" and not self._part())
            number = 0
            if tag in ("article", "main"):
                self.parts += 1
                number = self.parts
            self.open.append((tag, outside, number))
            self.outside += outside
            self.headings += tag in HEADINGS
            self.links += tag == "a"
        if tag not in INLINE or (self.open and self.open[-1][1]):
            self._break()
        self.lines[-1][1] += 1

    def _close_unclosed(self) -> None:
        """A new body or article ends whatever was left open before it, apart from an article around it."""
        self.open = [entry for entry in self.open if not entry[1]]
        self.outside = 0
        self._count()

    def _count(self) -> None:
        self.headings = sum(tag in HEADINGS for tag, _, _ in self.open)
        self.links = sum(tag == "a" for tag, _, _ in self.open)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:  # HTML ignores the slash of other elements
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.lines[-1][1] += 1
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                closed = self.open[at:] if self.open[at][1] or self.open[at][2] or tag not in INLINE else [self.open[at]]
                if len(closed) == 1 and at < len(self.open) - 1:
                    del self.open[at]
                else:
                    del self.open[at:]
                self.outside -= sum(entry[1] for entry in closed)
                self._count()
                break
        if tag not in INLINE or self.lines[-1][3] != bool(self.outside):
            self._break()

    def handle_data(self, data: str) -> None:
        if data:
            line = self.lines[-1]
            line[0].append(data)
            line[4] |= self.headings > 0
            if self.links:
                line[5] += len("".join(data.split()))


def _marked(attrs: list, whole: bool = False) -> bool:
    """Whether class, id or role mark an element as outside the content. Of hyphenated words parts count too, unless they
    tell about the page around; for ``whole`` elements, which hold the page, only whole words count."""
    for name, value in attrs:
        if name in ("class", "id") and value:
            for word in value.lower().replace("_", "-").split():
                parts = word.split("-")
                if word in MARKS or not whole and not MARKS.isdisjoint(parts) and TELLING.isdisjoint(parts):
                    return True
        elif name == "role" and value and value.lower() in ROLES:
            return True
        elif name in ("hidden", "aria-hidden") and (name == "hidden" or value == "true"):
            return True
    return False


def smoothed(values: list[float]) -> list[float]:
    out = []
    for i in range(len(values)):
        low, high = max(0, i - REACH), min(len(values), i + REACH + 1)
        weights = KERNEL[low - i + REACH : high - i + REACH]
        out.append(sum(w * v for w, v in zip(weights, values[low:high])) / sum(weights))
    return out


def main_text(html: str) -> str:
    parser = LineGatherer()
    for start in range(0, len(html), PIECE):
        parser.feed(html[start : start + PIECE])
    parser.close()
    lines = []  # text, tags, part, content is possible, heading, only links
    for pieces, tags, part, outside, heading, linked in parser.lines:
        text = " ".join("".join(pieces).split())
        if text:
            lines.append((text, tags, part, not outside, heading, linked >= 0.9 * len(text.replace(" ", ""))))
    if not any(line[3] for line in lines):
        return ""
    ratios = [len(text) / max(1, tags) * (HINT if part else 1.0) if possible else 0.0 for text, tags, part, possible, _, _ in lines]
    # regions: the lines of a part together, other lines from one interruption to the next; each is smoothed by itself
    regions: dict[tuple, list[int]] = {}
    gap = 0
    for at, (_, _, part, possible, _, _) in enumerate(lines):
        gap += not possible or part > 0
        if possible:
            regions.setdefault(("part", part) if part else ("gap", gap), []).append(at)
    smooth = [0.0] * len(lines)
    for rows in regions.values():
        for at, value in zip(rows, smoothed([ratios[at] for at in rows])):
            smooth[at] = value
    mean = sum(smooth) / len(smooth)
    spread = math.sqrt(sum((v - mean) ** 2 for v in smooth) / len(smooth))
    threshold = min(SPREADS * spread, max(v for v, line in zip(smooth, lines) if line[3]))
    content = {key: rows for key, rows in regions.items() if max(smooth[at] for at in rows) >= threshold}
    sizes = {kind: sum(len(lines[at][0]) for (k, _), rows in content.items() if k == kind for at in rows) for kind in ("part", "gap")}
    chosen = {at for (kind, _), rows in content.items() for at in rows if kind == "part" or sizes["part"] < sizes["gap"]}
    if sizes["part"] >= sizes["gap"]:
        for rows in [rows for (kind, _), rows in content.items() if kind == "part"]:
            at = rows[0] - 1
            while at >= 0 and lines[at][3] and lines[at][4] and at not in chosen:
                chosen.add(at)
                at -= 1
    return " ".join(line[0] for at, line in enumerate(lines) if at in chosen and (line[2] or not line[5] or ratios[at] >= threshold))


def extract(pages: DataFrame, id_column: str = "page_id", html_column: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id``, the columns of ``keep`` and the page's main ``text``."""
    source = pages.select(F.col(id_column).alias("id"), F.coalesce(F.col(html_column).cast("string"), F.lit("")).alias("html"), *[F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)])
    names = ["id", *[f"keep{i}" for i in range(len(keep))], "text"]
    schema = T.StructType([*[source.schema[n] for n in names[:-1]], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                texts = pa.array(map(main_text, part.column(1).to_pylist()), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], texts], names=names)

    found = source.mapInArrow(run, schema)
    return found.select(F.col("id").alias(id_column), *[F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)], "text")
