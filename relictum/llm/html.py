"""Main-text extraction by composite text density (op7).

A page is read into an element tree. Every element gets its characters per tag, adjusted by the share of link characters
and link tags (composite text density); an element's density sum is that of its children. The element of the largest sum is
the article's core; the lowest density on its path to body is the threshold. On the way up to body, or to an article or main
element around the core, what stands beside the path joins if it reaches the threshold and is not mostly links; within an
article or main element, and for headings before text that joins, it need not reach the threshold.

Elements that are never article text by their tag (menus, footers, sidebars, forms, scripts, styles) are left out. A class, id or
role can only name an element as a suspect (menu, notice, advert, reader comments ..): a suspect is left out if the core lies
outside, and the core lies in one only if the text outside does not support another.

Defined results: null or blank html gives the empty text; broken markup is read as far as it goes; repeated rows give a
row each; other columns are passed through; an empty table gives none. Reading takes time in proportion to the page's
length, however deep its elements nest and however many end tags stray.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relictum.llm import shared

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp".split())
NEVER = frozenset("head nav footer aside form button select option textarea script style noscript template iframe object svg canvas dialog menu input title meta link audio video map".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role that name what is not the article, as a whole token or as one end of a compound.
SUSPECT = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promotions banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies "
    "consent notice alert popup modal overlay newsletter subscribe signup login share sharing social related recommended recommendations comment comments commentlist disqus replies reply respond pagination pager "
    "toolbar widget contentinfo complementary".split()
)
#: With these at one end, a compound tells of a state or of the article itself (has-sidebar, share-enabled, related-post).
STATE = frozenset("has have with without no not is are hide hidden show shown enable enabled disable disabled on off open closed allow allowed post posts article articles content contents entry page body main story text container wrapper layout results".split())
#: Headings of reader comments.
COMMENTS = re.compile(r"\W*(?:\d+\s+)?(?:reader\s+)?(?:comments?|responses?|replies|kommentare?|commentaires?|comentarios?)\b\W*(?:\(?\d+\)?)?\W*", re.I)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: What a start tag ends, if it is the innermost open block.
IMPLIED = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option", "p")}


def suspect(value: str) -> bool:
    """Whether a class, id or role names something beside the article."""
    for token in value.lower().split():
        if token in SUSPECT:
            return True
        parts = re.split(r"[-_]+", token)
        if len(parts) > 1 and (parts[0] in SUSPECT or parts[-1] in SUSPECT) and not (parts[0] in STATE or parts[-1] in STATE):
            return True
    return False


class Tree:
    """Elements by number in page order: parent, tag, whether left out, whether suspect; texts as (element, block, text)."""

    def __init__(self, html: str):
        self.parent, self.tag, self.out, self.suspect = [-1], ["#root"], [False], [False]
        self.texts: list[tuple[int, int, str]] = []
        self.block = 0
        # The open elements; of each name, of blocks, and of those that hold stray end tags back, their places in that list.
        self.path = [0]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks = [0]
        self.barriers = [0]
        self.read(html)

    def text(self, text: str) -> None:
        if text and not self.out[self.path[-1]]:
            self.texts.append((self.path[-1], self.block, unescape(text) if "&" in text else text))

    def read(self, html: str) -> None:
        pos, size = 0, len(html)
        while pos < size:
            low = html.find("<", pos)
            if low < 0:
                self.text(html[pos:])
                return
            self.text(html[pos:low])
            if html.startswith("<!--", low):
                end = html.find("-->", low + 4)
                pos = size if end < 0 else end + 3
                continue
            if html.startswith(("<!", "<?"), low):
                end = html.find(">", low)
                pos = size if end < 0 else end + 1
                continue
            found = TAG.match(html, low)
            if not found:
                if low + 1 < size and (html[low + 1].isalpha() or html[low + 1] == "/"):  # a tag that never ends well
                    end = html.find(">", low)
                    pos = size if end < 0 else end + 1
                else:
                    self.text("<")
                    pos = low + 1
                continue
            pos = found.end()
            name = found[2].lower()
            if name not in INLINE:
                self.block += 1
            if found[1]:
                self.close(name)
                continue
            if name not in INLINE and self.tag[self.path[self.blocks[-1]]] in IMPLIED.get(name, ("p",)):
                self.cut(self.blocks[-1])
            self.add(name, found[3])
            if name in VOID or found[3].endswith("/") and name not in INLINE:
                if name == "br":
                    self.text(" ")
                continue
            if name in RAW:
                end = re.compile(f"</{name}", re.I).search(html, pos)
                close = html.find(">", end.start()) if end else -1
                pos = size if close < 0 else close + 1
                continue
            place = len(self.path)
            self.places[name].append(place)
            if name not in INLINE:
                self.blocks.append(place)
            if name in ("article", "main", "body"):
                self.barriers.append(place)
            self.path.append(len(self.tag) - 1)

    def add(self, name: str, attributes: str) -> None:
        up = self.path[-1]
        out, own = self.out[up] or name in NEVER, self.suspect[up]
        if name == "header" and not (self.places["article"] or self.places["main"]):
            own = True
        if not out and attributes and name not in ("html", "body", "article", "main"):
            for key, *values in ATTRIBUTE.findall(attributes):
                value = "".join(values)
                if key.lower() == "hidden" or key.lower() == "aria-hidden" and value == "true":
                    out = True
                elif not own and suspect(value):
                    own = True
        self.parent.append(up)
        self.tag.append(name)
        self.out.append(out)
        self.suspect.append(own)

    def close(self, name: str) -> None:
        """Ends the innermost open element of that name and all within it; an end tag that strays does nothing."""
        places = self.places.get(name)
        if not places:
            return
        if name in INLINE and places[-1] < self.blocks[-1] or name in ("p", "li", "div", "span") and places[-1] < self.barriers[-1]:
            return
        self.cut(places[-1])

    def cut(self, place: int) -> None:
        while len(self.path) > place:
            name = self.tag[self.path.pop()]
            self.places[name].pop()
            if self.blocks[-1] == len(self.path):
                self.blocks.pop()
            if self.barriers[-1] == len(self.path):
                self.barriers.pop()


def density(chars: int, links: int, tags: int, link_tags: int, body_chars: int, body_links: int) -> float:
    """Composite text density: characters per tag, lowered by the share of links."""
    if not chars:
        return 0.0
    c, lc, t, lt = chars, max(1, links), max(1, tags), max(1, link_tags)
    base = math.log(c / max(1, chars - links) * lc + max(1, body_links) / max(1, body_chars) * c + math.e)
    return c / t * math.log(max(1.0, c / lc * t / lt) + 1e-9, max(base, 1.0001))


def core(tree: Tree, chars: list[int], sums: list[float]) -> int:
    """The element of the largest density sum; within a suspect only if no element outside has a tenth of its text."""
    n = len(sums)
    known = [i for i in range(n) if not tree.out[i]]
    best = max(known, key=lambda i: sums[i])
    if not tree.suspect[best]:
        return best
    plain = max((i for i in known if not tree.suspect[i] and chars[i]), key=lambda i: sums[i], default=best)
    # What a plain element has beside its suspects.
    own = [0] * n
    for at, _, text in tree.texts:
        if not tree.suspect[at]:
            own[at] += len(text.strip())
    for i in range(n - 1, 0, -1):
        own[tree.parent[i]] += own[i]
    return plain if own[0] * 10 >= chars[best] else best


def extract(html: str | None) -> str:
    """The page's main text: blocks joined by a line feed."""
    if not html:
        return ""
    tree = Tree(html)
    n = len(tree.tag)
    chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for at, _, text in tree.texts:
        chars[at] += len(text.strip())
    commented(tree)
    for i in range(n - 1, 0, -1):
        if tree.tag[i] == "a":
            links[i], link_tags[i] = chars[i], link_tags[i] + 1
        if not tree.out[i]:
            up = tree.parent[i]
            chars[up] += chars[i]
            links[up] += links[i]
            tags[up] += tags[i] + 1
            link_tags[up] += link_tags[i]
    if not chars[0]:
        return ""
    body = next((i for i in range(n) if tree.tag[i] == "body"), 0)
    if not chars[body]:
        body = 0
    dense = [density(chars[i], links[i], tags[i], link_tags[i], chars[body], links[body]) for i in range(n)]
    sums = [0.0] * n
    for i in range(1, n):
        if not tree.out[i]:
            sums[tree.parent[i]] += dense[i]
    for i in range(n):  # an element without element children is its own only child
        sums[i] = sums[i] or dense[i]
    best = core(tree, chars, sums)
    path = [best]
    while path[-1] > 0 and path[-1] != body:
        path.append(tree.parent[path[-1]])
    threshold = min(dense[i] for i in path)
    on_path = set(path)
    inside = [k for k, i in enumerate(path) if tree.tag[i] in ("article", "main")]
    member = [False] * n
    member[best] = True
    children: dict[int, list[int]] = {}
    for i in range(1, n):
        if tree.parent[i] in on_path:
            children.setdefault(tree.parent[i], []).append(i)
    for k, up in enumerate(path[1 : inside[-1] + 1 if inside else None], 1):
        member[up] = True
        joined = True  # whether what follows has joined
        for i in reversed(children.get(up, [])):
            if i in on_path:
                joined = True
            elif chars[i] and not tree.out[i] and not (tree.suspect[i] and not tree.suspect[up]):
                plain = links[i] * 2 <= chars[i]
                member[i] = joined = plain and (bool(inside) or dense[i] >= threshold or joined and tree.tag[i] in HEADINGS)
    cut = [False] * n  # suspects that the core lies outside of, and what is in them
    for i in range(1, n):
        up = tree.parent[i]
        cut[i] = cut[up] or tree.suspect[i] and not tree.suspect[up] and i not in on_path
        member[i] = not cut[i] and (member[i] or member[up] and (up == best or up not in on_path))
    blocks: dict[int, list[str]] = {}
    for at, block, text in tree.texts:
        if member[at]:
            blocks.setdefault(block, []).append(text)
    found = (" ".join("".join(x).split()) for x in blocks.values())
    return "\n".join(x for x in found if x)


def commented(tree: Tree) -> None:
    """An element whose first text is a heading of reader comments is a suspect, if it is not all of the page's text."""
    first: dict[int, int] = {}
    for at, _, text in tree.texts:
        if not text.strip():
            continue
        up = at
        while up > 0 and up not in first:
            first[up] = at
            up = tree.parent[up]
        if up == 0 and 0 not in first:
            first[0] = at
    heading = defaultdict(list)
    for at, _, text in tree.texts:
        if tree.tag[at] in HEADINGS:
            heading[at].append(text)
    marked = {at for at, x in heading.items() if COMMENTS.fullmatch("".join(x).strip())}
    if not marked:
        return
    for i, at in first.items():
        if at in marked and i != at and tree.tag[i] not in ("#root", "html", "body", "article", "main"):
            tree.suspect[i] = True
    for i in range(1, len(tree.tag)):
        tree.suspect[i] = tree.suspect[i] or tree.suspect[tree.parent[i]]


def extracted(pages: DataFrame) -> DataFrame:
    """The operator: pages with text and n_chars in place of html."""
    others = [c for c in pages.columns if c not in ("html", "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                own = batch.slice(low, 256)
                texts = [extract(x.as_py()) for x in own.column(len(others))]
                yield pa.RecordBatch.from_arrays([*own.columns[: len(others)], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*others, "text", "n_chars"])

    kept = pages.select(*[F.col(f"`{c}`") for c in [*others, "html"]])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{schema}, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(shared.read(spark, sf_dir, "pages").select("page_id", "url", "html"))
