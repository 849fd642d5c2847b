"""Main text of web pages by maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive, tags negative, by weights learned from pages that
mark their main text themselves; one linear scan finds the contiguous region with the highest sum. Inside the
region, elements that are never main text are left out.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendguard.llm.registry import query, table

# Element names of HTML by what they mean here.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary "
    "table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPAQUE = "script|style|noscript|template|textarea|svg|math|iframe|object|select|canvas|audio|video"
NEVER = frozenset("head nav header footer aside form button dialog menu search title".split())
MARKS = frozenset(["article", "main"])
WHOLE = MARKS | {"html", "body"}  # never left out for their names
KNOWN = BLOCKS | VOID | NEVER | frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
# Words in class, id and role that name parts around the main text.
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement advertising advertorial banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus footer header masthead menu navbar navigation nav newsletter notice notices popup promo promoted "
    "promotion related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar "
    "complementary contentinfo search".split()
)

# Elements that text is made of; of those, one tag outweighs a fifth of a word where nothing is learned.
FLOWING = frozenset("p br b strong i em code pre blockquote h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th figure figcaption".split())
# Of ASIDE_WORDS, those that tell also as a part of a compound name, unless a part denies it.
COMPOUND_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "navbar newsletter popup promo related share sharing sidebar signup sponsored subscribe".split()
)
DENIALS = frozenset("no not has with without free".split())

_OPAQUE_END = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in OPAQUE.split("|")}
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/><]*)")
_SPECIAL = re.compile("[\"'>]")
_NEXT = re.compile("[<>]")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_WORD = re.compile(r"\S+")


def _is_aside(tag: str, attrs: str) -> bool:
    if "=" not in attrs:
        return False
    if re.search(r"\bhidden\b(?!\s*=\s*[\"']?false)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", attrs, re.IGNORECASE):
        return True
    if tag in WHOLE:
        return False
    for m in _NAMES.finditer(attrs):
        value = m[1] or m[2] or m[3] or ""
        for name in value.split():
            parts = {p.lower() for p in _PART.findall(name)}
            if name.lower() in ASIDE_WORDS or (parts & COMPOUND_WORDS and not parts & DENIALS):
                return True
    return False


class _TagEnds:
    """Where a tag ends: at the first `>` outside quotes. Any sequence of questions about a page takes linear time."""

    def __init__(self, page: str):
        self.page, self.open_ended = page, set()
        self.asked, self.special = 0, -1

    def _next(self, at: int) -> int:
        """The first quote or `>` from `at` on; its length if there is none."""
        if not self.asked <= at <= self.special:
            m = _SPECIAL.search(self.page, at)
            self.asked, self.special = at, m.start() if m else len(self.page)
        return self.special

    def __call__(self, at: int) -> int:
        """Place of the `>` of a tag whose attributes start at `at`; -1 if it or a quote in it never ends."""
        passed = []
        while (at := self._next(at)) < len(self.page) and at not in self.open_ended:
            if self.page[at] == ">":
                return at
            passed.append(at)
            at = self.page.find(self.page[at], at + 1) + 1
            if not at:
                break
        self.open_ended.update(passed)
        return -1


def page_tokens(page: str):
    """(kind, name, attributes, text) in page order; kind is "text", "open", "close" or "opaque".

    Comments, declarations and tags that never end up to the next `<` or `>` are passed over; a `<` that starts
    neither is text. The contents of opaque elements go up to their end tag or to the end of the page.
    """
    ends, at, size = _TagEnds(page), 0, len(page)
    while at < size:
        if page[at] != "<":
            stop = page.find("<", at)
            stop = size if stop < 0 else stop
            yield "text", "", "", page[at:stop]
            at = stop
        elif page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            at = size if stop < 0 else stop + 3
        elif page.startswith(("<!", "<?"), at):
            stop = page.find(">", at)
            at = size if stop < 0 else stop + 1
        elif (m := _TAG.match(page, at)) and (stop := ends(m.end())) >= 0:
            name = m[2].lower()
            if name in _OPAQUE_END and not m[1]:
                end = _OPAQUE_END[name].search(page, stop + 1)
                yield "opaque", name, "", ""
                at = end.end() if end else size
            else:
                yield ("close" if m[1] else "open"), name, page[m.end() : stop], ""
                at = stop + 1
        elif m and (not (after := _NEXT.search(page, m.end())) or after[0] == ">"):
            at = after.end() if after else size
        else:
            stop = page.find("<", at + 1)
            stop = size if stop < 0 else stop
            yield "text", "", "", page[at:stop]
            at = stop


class _Open:
    """The open elements: (name, dropped, marked) each; looking one up takes constant time."""

    def __init__(self):
        self.stack: list[tuple[str, bool, bool]] = []
        self.blocks: list[int] = []
        self.count: Counter = Counter()

    def top(self) -> tuple[str, bool, bool]:
        return self.stack[-1] if self.stack else ("", False, False)

    def push(self, name: str, dropped: bool, marked: bool) -> None:
        if name in BLOCKS:
            self.blocks.append(len(self.stack))
        self.count[name] += 1
        self.stack.append((name, dropped, marked))

    def pop(self) -> str:
        name = self.stack.pop()[0]
        self.count[name] -= 1
        if name in BLOCKS:
            self.blocks.pop()
        return name

    def close(self, name: str) -> None:
        if self.count[name]:
            while self.pop() != name:
                pass

    def close_implied(self, tag: str) -> None:
        """Close elements whose end tag is left out: a block ends a paragraph, an item the item before it."""
        while self.blocks:
            at = self.blocks[-1]
            name = self.stack[at][0]
            same = name == tag and tag in ("li", "dt", "dd", "tr", "td", "th")
            if name != "p" and not same:
                return
            while len(self.stack) > at:
                self.pop()
            if same:
                return


def page_items(page: str):
    """(feature, words, block, text or None, dropped, marked) of every text and tag of a page, in order.

    `block` numbers the blocks, `dropped` tells what lies in elements that are never main text, `marked` what lies
    in an element that pages use to mark their main text.
    """
    opened = _Open()
    block, items = 0, []
    for kind, tag, attrs, text in page_tokens(page):
        name, dropped, marked = opened.top()
        if kind == "text":
            n = len(_WORD.findall(text))
            items.append((f"in {name if name in KNOWN else '?'}", n, block, text, dropped, marked))
        elif kind == "opaque":
            items.append((tag, 0, block, None, dropped, marked))
        else:
            closing = kind == "close"
            aside = not closing and _is_aside(tag, attrs)
            label = f"{'/' if closing else ''}{tag if tag in KNOWN else '?'}{' aside' if aside else ''}"
            if tag in BLOCKS:
                block += 1
            if closing:
                opened.close(tag)
                marked = marked and opened.top()[2]
            items.append((label, 0, block, None, dropped, marked))
            if not closing and tag not in VOID and not attrs.rstrip().endswith("/"):
                if tag in BLOCKS:
                    opened.close_implied(tag)
                    _, dropped, marked = opened.top()
                opened.push(tag, dropped or aside or tag in NEVER, marked or tag in MARKS)
            if tag == "br":
                items.append(("in br", 0, block, " ", dropped, marked))
    return items


def default_weight(feature: str) -> float:
    """A word is worth one; of tags, those that text is made of cost little."""
    if feature.startswith("in "):
        return 1.0
    return -0.2 if feature.lstrip("/") in FLOWING else -1.0


def main_text(page: str, weights: dict[str, float]) -> str:
    """Blocks of the best region, white space within a block as one space, joined by line feeds."""
    items = page_items(page)
    best = total = 0.0
    start = begin = end = 0
    for i, (feature, words, _, text, dropped, _) in enumerate(items):
        if not dropped:
            total += weights.get(feature, default_weight(feature)) * (words if text is not None else 1)
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, begin, end = total, start, i + 1
    if not best:
        return ""
    first, last = items[begin][2], items[end - 1][2]
    blocks: dict[int, list[str]] = {}
    for feature, _, block, text, dropped, _ in items:
        if text is not None and not dropped and first <= block <= last:
            blocks.setdefault(block, []).append(html.unescape(text))
    joined = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(b for b in joined if b)


def fit_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_pages: int = 4_000) -> dict[str, float]:
    """Log-odds of every kind of word and tag to lie in the marked main text, words at least a little positive
    and tags at least a little negative.

    Labelled pages are those that mark their main text with an `article` or `main` element; at most about
    `max_pages` of them, picked by a hash of `id_col`, are read. Without labelled pages every word scores 1 and
    every tag -1, or -0.2 where text is made of it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                for feature, words, _, text, dropped, marked in page_items(page):
                    found[feature, bool(marked and not dropped)] += words if text is not None else 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.bool_()),
                pa.array(list(found.values()), pa.int64()),
            ],
            ["feature", "inside", "n"],
        )

    labelled = pages.select(F.col(id_col).alias("_id"), F.col(html_col).cast("string").alias("_html")).where(
        F.col("_html").rlike("(?i)<(article|main)[ >]")
    )
    n = labelled.count()
    if n > max_pages:
        labelled = labelled.where(F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(1 << 30)) < int((1 << 30) * max_pages / n))
    counts = labelled.select("_html").mapInArrow(count, "feature string, inside boolean, n long")
    seen: dict[str, list[float]] = {}
    for row in counts.groupBy("feature", "inside").agg(F.sum("n").alias("n")).collect():  # features are a fixed list
        seen.setdefault(row["feature"], [0.5, 0.5])[row["inside"]] += row["n"]
    weights = {}
    for feature, (outside, inside) in seen.items():
        odds = math.log(inside / outside)
        weights[feature] = min(max(odds, 0.05), 5.0) if feature.startswith("in ") else max(min(odds, -0.01), -12.0)
    return weights


def extract(
    pages: DataFrame, weights: dict[str, float], id_col: str = "page_id", html_col: str = "html", carry=("url",)
) -> DataFrame:
    """`id_col`, the columns of `carry`, text and n_chars (code points) for every row of `pages`.

    A null or empty page, or one without a positive region, has an empty text. Repeated rows are handled each;
    pages of any length are read whole; columns not named are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, weights) for page in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], [*batch.schema.names[1:], "_text"])

    slim = pages.select(
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("_html"), F.col(id_col).alias("_id"),
        *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(carry)],
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema if f.name != "_html")
    return slim.mapInArrow(run, schema + ", _text string").select(
        F.col("_id").alias(id_col), *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(carry)],
        F.col("_text").alias("text"), F.char_length("_text").cast("long").alias("n_chars"),
    )


@query("op6_extraction")
def op6_extraction(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit_weights(pages))
