"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page."""

from __future__ import annotations

import html as references
import random
import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from auditframe.llm import crf
from auditframe.llm._table import bounded_sample, slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of HTML: elements inside a line, elements without content, elements whose content is no markup,
# and what an opening element closes when it is still open.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
UNSEEN = frozenset(("script", "style", "iframe", "noembed", "noframes"))
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
# Elements that end where they stand, so that what closes others does not reach beyond them.
BARRIERS = frozenset("body article section main div nav aside footer header form table ul ol dl blockquote".split())

# A quote opens a value only behind an equals sign; anywhere else it is part of a name. Possessive, so that no page costs more than its length.
_SPACE = r"[\t\n\f\r ]"
_ATTRIBUTES = rf"""(?:[\t\n\f\r /]|[^\t\n\f\r />][^\t\n\f\r />=]*+(?:{_SPACE}*+={_SPACE}*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\t\n\f\r >"'][^\t\n\f\r >]*+)?+)?+)*+"""
_TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?:>|[^a-zA-Z>][^>]*(?:>|\Z))|<(/?)([a-zA-Z][^\t\n\f\r />]*)({_ATTRIBUTES})(?:>|\Z)", re.DOTALL
)
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.IGNORECASE) for tag in RAW}
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_PARTS = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
MAIN_MARK = "data-main"


BUCKETS = 1 << 14


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % (BUCKETS - 1) + 1


@lru_cache(maxsize=20_000)
def _own_features(tag: str, attributes: str) -> frozenset[int]:
    """The tag of an element and the words of its classes, ids and roles."""
    names = {f"name {w}" for found in _NAMES.findall(attributes) for w in _PARTS.split("".join(found).lower()) if w}
    return frozenset(map(_bucket, names if tag in INLINE else names | {f"in {tag}"}))


class Element:
    """An open element: what holds it, and the features of it and all that holds it, shared where it adds none."""

    __slots__ = ("attributes", "depth", "features", "leaf", "parent", "tag")

    def __init__(self, parent: Element | None, tag: str, attributes: str) -> None:
        self.parent, self.tag, self.attributes = parent, tag, attributes
        above, self.leaf, self.depth = (parent.features, parent.leaf, parent.depth) if parent else (frozenset(), (), 0)
        own = _own_features(tag, attributes)
        self.features = above if own <= above else above | own
        if tag not in INLINE:
            self.leaf, self.depth = (*self.leaf[-1:], tag), self.depth + 1


class Block(NamedTuple):
    """A leaf block: its text, the characters of it inside links, and the innermost element that holds it."""

    text: str
    linked: int
    holder: Element | None

    @property
    def path(self) -> list[tuple[str, str]]:
        """Tags and attributes of the elements that hold the block, outermost first."""
        out, at = [], self.holder
        while at:
            out.append((at.tag, at.attributes))
            at = at.parent
        return out[::-1]


def leaf_blocks(page: str) -> Iterator[Block]:
    """Blocks of text in page order, with references decoded and white space inside turned into one space.

    A block ends where an element begins or ends that is not one of a line.
    Comments, scripts and styles have no text. Elements left open end with
    what holds them; an end without a beginning is passed over.
    """
    path: list[Element] = []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked = at = 0

    def close(depth: int) -> None:
        opened.subtract(e.tag for e in path[depth:])
        del path[depth:]

    def flush() -> Iterator[Block]:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                yield Block(text, min(linked, len(text)), path[-1] if path else None)
            parts.clear()
            linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = references.unescape(raw)
            parts.append(text)
            if opened["a"]:
                linked += len(text.strip())

    while at < len(page):
        token = _TOKEN.search(page, at)
        if token is None:
            add(page[at:])
            break
        add(page[at : token.start()])
        at = token.end()
        if token[2] is None:
            continue
        tag, attributes = token[2].lower(), token[3]
        if tag == "br":
            parts.append(" ")
        if tag not in INLINE:
            yield from flush()
        if token[1]:
            if opened[tag]:
                depth = next(i for i in range(len(path) - 1, -1, -1) if path[i].tag == tag)
                if tag not in INLINE or all(e.tag in INLINE for e in path[depth:]):
                    close(depth)
            continue
        if tag not in INLINE:
            while path and path[-1].tag in INLINE:
                close(-1)
            if path and path[-1].tag == "p":
                close(-1)
            for closed in CLOSES.get(tag, ()):
                for i in range(len(path) - 1, -1, -1):
                    if path[i].tag == closed:
                        close(i)
                        break
                    if path[i].tag in BARRIERS:
                        break
        if tag in RAW:
            end = _ENDS[tag].search(page, at)
            stop = end.start() if end else len(page)
            if tag not in UNSEEN:
                path.append(Element(path[-1] if path else None, tag, attributes))
                add(page[at:stop])
                yield from flush()
                path.pop()
            closing = page.find(">", stop)
            at = len(page) if closing < 0 else closing + 1
        elif tag not in EMPTY and not attributes.rstrip().endswith("/"):
            path.append(Element(path[-1] if path else None, tag, attributes))
            opened[tag] += 1
    yield from flush()


@lru_cache(maxsize=20_000)
def _leaf_features(leaf: tuple[str, ...], depth: int) -> tuple[int, ...]:
    """How near the element of a block is, and how deep."""
    return tuple(sorted(map(_bucket, {*(f"leaf {t}" for t in leaf[-1:]), f"leaf {' '.join(leaf)}", f"depth {depth}"})))


def block_features(blocks: list[Block]) -> list[list[int]]:
    """Feature numbers of each block of one page: ancestors, length, links, marks, and the place in the page."""
    out = []
    for i, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        size, share = min(words.bit_length(), 8), int(4 * b.linked / len(b.text))
        names = [
            f"size {size}", f"links {share}", f"end {b.text[-1] if not b.text[-1].isalnum() else 'w'}", f"size links {size} {share}",
            f"place {min(i, 3)} {min(len(blocks) - 1 - i, 3)}", f"commas {min(b.text.count(','), 3)}", f"first {b.text[0] if not b.text[0].isalnum() else 'w'}",
            f"digits {int(4 * sum(map(str.isdigit, b.text)) / len(b.text))}",
        ]
        held, leaf, depth = (b.holder.features, b.holder.leaf, b.holder.depth) if b.holder else ((), (), 0)
        out.append([0, *sorted(held), *_leaf_features(leaf, min(depth, 8)), *map(_bucket, names)])
    return out


def _grid(rows: list[list[int]]) -> crf.Features:
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    return crf.Features(np.fromiter((x for r in rows for x in r), np.int64, int(sizes.sum())), np.cumsum(sizes) - sizes)


# Labelled pages. For each part of a page that is no article, its elements and names seen on the web.
PARTS = {
    "menu": ("nav ul menu", "nav navbar menu site-nav main-menu breadcrumb breadcrumbs tabs pagination pager toc skip-link"),
    "header": ("header", "header masthead site-header topbar page-header branding site-title tagline"),
    "footer": ("footer", "footer site-footer copyright colophon legal bottom credits"),
    "sidebar": ("aside", "sidebar aside widget related recommended trending popular most-read teaser rail"),
    "notice": ("div section dialog", "notice cookie-banner cookie consent gdpr alert paywall subscribe-notice popup modal banner disclaimer"),
    "advert": ("div aside ins", "ad ads advert advertisement sponsored promo banner-ad ad-slot adsbygoogle"),
    "form": ("form fieldset", "form newsletter signup search-form login subscribe contact-form poll"),
    "share": ("div ul", "share social follow tags author-bio byline meta actions tools print"),
    "comments": ("section div ol", "comments comment-list comment replies discussion disqus respond reader-comments"),
}
HOLDERS = ("article main div section", "article post content entry entry-content story main body post-body text article-body page-content")


class _Maker:
    """Writes one page with known labels from texts of real pages."""

    def __init__(self, seed: int, texts: list[str]) -> None:
        self.r, self.texts = random.Random(seed), texts

    def open(self, tags: str, names: str, named: float, mark: str = "") -> tuple[str, str]:
        r = self.r
        tag = r.choice(tags.split()) if r.random() < 0.6 else "div"
        name = f' {r.choice(["class", "class", "id"])}="{r.choice(names.split())}"' if r.random() < named or tag == "div" else ""
        return f"<{tag}{name}{mark}>", f"</{tag}>"

    def words(self, least: int, most: int) -> str:
        own = self.r.choice(self.texts).split()
        n = self.r.randint(least, most)
        at = self.r.randrange(max(1, len(own) - n))
        return references.escape(" ".join(own[at : at + n]), quote=False)

    def sentence(self) -> str:
        return self.words(4, 60).rstrip(".,;") + self.r.choice("....!?")

    def part(self, kind: str) -> str:
        r, (tags, names) = self.r, PARTS[kind]
        before, after = self.open(tags, names, 0.7)
        link = lambda: f'<a href="/x">{self.words(1, 4)}</a>'
        if kind == "menu" or kind == "sidebar" and r.random() < 0.6:
            inner = "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 8))) + "</ul>"
        elif kind == "header":
            inner = r.choice([f"<h1>{link()}</h1>", f"<div>{self.words(1, 3)}</div>", f"<p>{self.words(2, 6)}</p>"])
        elif kind == "footer":
            inner = r.choice(["&copy; ", "", "© 2024 "]) + self.words(2, 12) + r.choice(["", " &middot; " + self.words(1, 6), "<p>" + link() + "</p>"])
        elif kind == "form":
            inner = f"<label>{self.words(1, 3)}</label><input name=q><p>{self.sentence()}</p><button>{self.words(1, 2)}</button>"
        elif kind == "comments":
            inner = f"<h3>{self.words(1, 3)}</h3>" + "".join(
                f'<div class="{r.choice(["comment", "reply", "comment-body"])}"><b>{self.words(1, 2)}</b><p>{self.sentence()}</p></div>' for _ in range(r.randint(1, 5))
            )
        elif kind == "share":
            inner = "".join(f"<span>{link()}</span> " for _ in range(r.randint(1, 4)))
        else:
            inner = r.choice(["{}", "<p>{}</p>", "<div>{}</div>"]).format(self.sentence()) + r.choice(["", link()])
        return before + inner + after

    def article(self) -> str:
        r = self.r
        before, after = self.open(*HOLDERS, 0.5, f" {MAIN_MARK}")
        out = [f"<h1>{self.words(3, 14)}</h1>"] * (r.random() < 0.8)
        for _ in range(r.choice([1, 2, 4, 8, 14])):
            kind = r.random()
            if kind < 0.7:
                out.append(r.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}</b></p>", "<p><b>{}<br></p>"]).format(" ".join(self.sentence() for _ in range(r.choice([1, 1, 3, 6])))))
            elif kind < 0.78:
                out.append(f"<h{r.choice('23')}>{self.words(1, 8)}</h2>")
            elif kind < 0.84:
                out.append("<ul>" + "".join(f"<li>{self.words(2, 20)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.88:
                out.append(f"<blockquote><p>{self.sentence()}</p></blockquote>")
            elif kind < 0.91:
                out.append(f"<table><tr><td>{self.words(1, 5)}</td><td>{self.words(1, 5)}</td></tr></table>")
            elif kind < 0.95:
                out.append(f"<p>{self.words(1, 3)}.</p>")
            else:
                out.append(self.part(r.choice(["advert", "share", "notice", "sidebar"])).replace(">", f" {MAIN_MARK}=no>", 1))
        if r.random() < 0.2:
            out.append(self.part("comments").replace(">", f" {MAIN_MARK}=no>", 1))
        return before + "".join(out) + after

    def page(self) -> str:
        r = self.r
        some = lambda kinds, p: "".join(self.part(k) for k in kinds.split() if r.random() < p)
        head = f"<html><head><title>{self.words(2, 9)}</title></head><body>"
        return head + some("notice header menu advert form", 0.5) + self.article() + some("share sidebar comments form advert menu notice", 0.3) + some("footer", 0.8)


def truth(block: Block) -> int:
    """1 for blocks that the innermost marked ancestor calls main text."""
    marks = [a for _, a in block.path if MAIN_MARK in a]
    return int(bool(marks) and f"{MAIN_MARK}=no" not in marks[-1])


_PART_TAGS = {"nav", "aside", "footer", "form"}
_PART_NAMES = {name for _, names in PARTS.values() for name in names.split()}


def weak_truth(block: Block) -> int:
    """The label of a block of a real page by its elements: inside an article and in no part that is none."""
    tags = [t for t, _ in block.path]
    if "article" not in tags:
        return 0
    inside = block.path[tags.index("article") + 1 :]
    names = {w for _, attributes in inside for found in _NAMES.findall(attributes) for w in "".join(found).lower().split()}
    return int(not _PART_TAGS & {t for t, _ in inside} and not _PART_NAMES & names)


def fit(pages: list[str], made: int = 500, seed: int = 9) -> crf.Chain:
    """A field from labelled pages: the given ones that have one article element, labelled by it, and ``made`` written ones.

    Written pages draw their texts from the given ones and vary the parts,
    elements and names of pages, so that no single sign decides.
    """
    real = [list(leaf_blocks(p)) for p in pages]
    texts = [b.text for blocks in real for b in blocks if " " in b.text] or ["some words of a page stand here and there, and more follow in turn"]
    labelled = [(blocks, [weak_truth(b) for b in blocks]) for p, blocks in zip(pages, real, strict=True) if len(re.findall(r"<article\b", p, re.IGNORECASE)) == 1]
    for i in range(made):
        blocks = list(leaf_blocks(_Maker(seed * 100_003 + i, texts).page()))
        labelled.append((blocks, [truth(b) for b in blocks]))
    labelled = [x for x in labelled if x[0]]
    sizes = np.array([len(b) for b, _ in labelled])
    rows = [r for blocks, _ in labelled for r in block_features(blocks)]
    labels = np.concatenate([y for _, y in labelled])
    return crf.fit(_grid(rows), np.arange(len(rows)), np.cumsum(sizes) - sizes, labels, 2, BUCKETS, rounds=80)


def learn(pages: DataFrame, sample: int = 150, most_chars: int = 20_000) -> crf.Chain:
    """A field from at most ``sample`` pages of up to ``most_chars`` characters, those of the smallest hash."""
    known = bounded_sample(pages.filter(F.length("html") <= most_chars).select("html"), None, sample, 9)
    return fit(sorted(r.html for r in known.collect()))


def _extract(chain: crf.Chain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "html", 4 << 20):
                pages = [list(leaf_blocks(h.as_py() or "")) for h in b.column(b.num_columns - 1)]
                rows = [r for blocks in pages for r in block_features(blocks)]
                sizes = np.array([len(p) for p in pages], np.int64)
                first = np.cumsum(sizes) - sizes
                main = crf.viterbi(chain, _grid(rows).sums(chain.weights), first[sizes > 0]) if rows else []
                texts = ["\n\n".join(x.text for x, y in zip(blocks, main[at : at + len(blocks)], strict=True) if y) for at, blocks in zip(first, pages, strict=True)]
                sizes = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *sizes], [*b.schema.names[:-1], "text", "n_chars"])

    return run


def extract(pages: DataFrame, chain: crf.Chain, html_col: str = "html") -> DataFrame:
    """All columns but the page itself, with ``text`` and ``n_chars``: the blocks that Viterbi decoding labels main text.

    Blocks are joined by an empty line. Null and empty pages, and pages
    without main text, give an empty text; repeated rows repeat. Columns of
    the input called ``text`` or ``n_chars`` are replaced. No shuffle.
    """
    keep = [c for c in pages.columns if c.lower() not in (html_col.lower(), "text", "n_chars")]
    # Under plain names, since tasks do not take a dot in one.
    rows = pages.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(html_col).alias("html"))
    made = rows.mapInArrow(_extract(chain), StructType([*rows.schema.fields[:-1], StructField("text", StringType()), StructField("n_chars", LongType())]))
    return made.toDF(*keep, "text", "n_chars")
