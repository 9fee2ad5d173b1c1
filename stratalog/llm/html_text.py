"""Main text of web pages by scoring the element tree.

Elements that are never article text (scripts, forms, menus, footers, comments and the like, by tag,
role or the words of class and id) are cut out, but for wrappers named like that around the article. Every
remaining block of text gives points for its length and its commas to its ancestors, less with every
level; an element's points are discounted by its link density. The element with the most points is
the container; if it is in an article or main element, all of that element is kept, else siblings that
score enough by themselves, or read as prose, are kept with it. The text of all blocks kept is decoded, its white space folded, and joined in page order.

Defined results: null and empty pages, and pages without any text, give an empty text; unclosed,
crossed and cut-off tags are repaired like browsers do in the usual cases; pages of any length are
read whole; repeated rows give equal texts; an empty table gives an empty table; clashing column
names get underscores.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.llm.common import added, byte_batches, free_name, lean, small_batches

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"""
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+(?:>|\Z)|[^>]*+(?:>|\Z))""",
    re.S,
)
#: a name, and its value in one of three forms, where it has one
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
NAME_WORD = re.compile(r"[a-z]+|[0-9]+")

# Element kinds of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"br", "html", "body", "head", "option", "optgroup", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt"}
CLOSED_BY_SAME = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"},
}
SCOPE = {"table", "ul", "ol", "dl", "select", "html", "body", "article", "section", "div", "main", "aside"}
NEVER = set(
    "script style noscript template svg math canvas object embed applet iframe head title nav header footer aside form button select "
    "textarea input label menu dialog audio video map noframes noembed".split()
)
NEVER_ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar tablist".split())
# Words of class and id that name page furniture and reader comments.
FURNITURE = set(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright "
    "disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination "
    "popup promo promotion recommended related replies respond share sharing sidebar signup skyscraper social sponsor sponsored subscribe "
    "subscription teaser toolbar topbar widget widgets".split()
)
# Of these, what no article is in.
NO_WRAPPER = set(
    "comment comments commentlist consent cookie cookies copyright disclaimer disqus gdpr notice notices notification replies respond".split()
)
PROSE = set("article body content entry main post story text".split())
LEVELS = (1.0, 0.5, 1 / 3, 1 / 4, 1 / 5)


class Page:
    """The element tree as lists by node number; parents come before their children."""

    def __init__(self, source: str):
        self.tag, self.parent, self.cut, self.never, self.bonus = ["#root"], [-1], [False], [False], [0.0]
        self.pieces: list[tuple[int, int, str]] = []  # (node, block, text): block is the nearest block element, counted anew after breaks
        self.places: dict[str, list[int]] = {}  # by tag, where its open elements are in the stack
        self._read(source)

    def _read(self, source: str) -> None:
        tag, parent = self.tag, self.parent
        open_, at, end, block, blocks = [0], 0, len(source), 0, 0
        while at < end:
            m = TOKEN.search(source, at)
            stop = m.start() if m else end
            if stop > at:
                self.pieces.append((open_[-1], block, source[at:stop]))
            if not m:
                break
            at = m.end()
            name = m["tag"]
            if not name:
                if m[0].startswith("<![CDATA["):
                    self.pieces.append((open_[-1], block, html.escape(m[0][9:].removesuffix("]]>"), quote=False)))
                continue
            name = name.lower()
            if not m[0].endswith(">"):
                break  # the page was cut off inside this tag
            if name in BLOCK:
                blocks += 1
                block = blocks
            if m["end"]:
                self._close(open_, name)
                continue
            if name in CLOSES_P:
                self._close(open_, "p", {"p"}, stop=SCOPE | {"td", "th", "li"})
            if name in CLOSED_BY_SAME:
                while len(open_) > 1 and tag[open_[-1]] not in SCOPE and any(tag[k] in CLOSED_BY_SAME[name] for k in self._until_scope(open_)):
                    self._pop(open_)
            node = len(tag)
            tag.append(name)
            parent.append(open_[-1])
            cut, never, bonus = self._kind(name, m["rest"])
            self.cut.append(cut)
            self.never.append(never)
            self.bonus.append(bonus)
            if name in RAW and not m["rest"].endswith("/>"):
                close = re.compile(f"</{name}", re.I).search(source, at)
                if name == "textarea" and close:
                    self.pieces.append((node, block, source[at : close.start()]))
                at = close.end() if close else end
                at = source.find(">", at) + 1 or end
            elif name not in VOID and not m["rest"].endswith("/>"):
                self.places.setdefault(name, []).append(len(open_))
                open_.append(node)
        return

    def _until_scope(self, open_):
        for k in reversed(open_):
            if self.tag[k] in SCOPE:
                return
            yield k

    def _close(self, open_, name: str, names: set[str] | None = None, stop: set[str] = frozenset()) -> None:
        names = names or {name}
        last = lambda kinds: max((self.places[x][-1] for x in kinds if self.places.get(x)), default=0)
        at = last(names)
        if at > last(stop - names):
            while len(open_) > at:
                self._pop(open_)

    def _pop(self, open_) -> None:
        self.places[self.tag[open_.pop()]].pop()

    @staticmethod
    def _kind(name: str, rest: str) -> tuple[bool, bool, float]:
        """Whether it is cut, whether it stays cut as a wrapper, and its points."""
        if name in NEVER:
            return True, True, 0.0
        bonus = 25.0 if name in ("article", "main") else 0.0
        if "=" not in rest and "hidden" not in rest:
            return False, False, bonus
        cut = never = False
        for key, a, b, c in ATTRIBUTE.findall(rest):
            key, value = key.lower(), (a or b or c).lower()
            if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                cut = never = True
            elif key == "role":
                cut |= value in NEVER_ROLES
                never |= value in NEVER_ROLES
                bonus += 25.0 if value in ("main", "article") else 0.0
            elif key in ("class", "id", "itemprop"):
                words = set(NAME_WORD.findall(value))
                cut |= bool(words & FURNITURE) and name not in ("html", "body")
                never |= bool(words & NO_WRAPPER)
                bonus += 10.0 if words & PROSE else 0.0
        return cut, never and name not in ("html", "body"), bonus

    def text(self) -> str:
        n = len(self.tag)
        length, links = [0] * n, [0] * n
        in_link = [False] * n
        for k in range(1, n):
            in_link[k] = in_link[self.parent[k]] or self.tag[k] == "a"
        sizes = []
        for node, _, piece in self.pieces:
            size = len(piece) - piece.count(" ") - piece.count("\n")
            sizes.append(size)
            length[node] += size
            links[node] += size if in_link[node] else 0
        self._restore(length, in_link)
        gone = [False] * n
        for k in range(1, n):
            gone[k] = gone[self.parent[k]] or self.cut[k]
        # length and links of what is left
        length, links = [0] * n, [0] * n
        commas = [0] * n
        for (node, _, piece), size in zip(self.pieces, sizes):
            if not gone[node] and size:
                length[node] += size
                links[node] += size if in_link[node] else 0
                commas[node] += sum(map(piece.count, (",", "，", "、", "،")))
        home = list(range(n))  # the nearest block element
        for k in range(1, n):
            if self.tag[k] not in BLOCK:
                home[k] = home[self.parent[k]]
        size_of, commas_of, linked = {}, {}, {}
        for k in range(n):
            if length[k]:
                b = home[k]
                size_of[b] = size_of.get(b, 0) + length[k]
                commas_of[b] = commas_of.get(b, 0) + commas[k]
                linked[b] = linked.get(b, 0) + links[k]
        if not size_of:
            return ""
        score = [b if not g else 0.0 for b, g in zip(self.bonus, gone)]
        for b, size in size_of.items():
            points = (1 + commas_of[b] + min(size / 100, 3)) * (1 - linked[b] / size)
            up = self.parent[b] if self.tag[b] in ("p", "pre", "li", "td", "th", "blockquote", "dd", "dt", "h1", "h2", "h3", "h4", "h5", "h6", "br") and b else b
            for share in LEVELS:
                if up < 0:
                    break
                score[up] += points * share
                up = self.parent[up]
        for k in range(n - 1, 0, -1):
            length[self.parent[k]] += length[k]
            links[self.parent[k]] += links[k]
        final = [s * (1 - links[k] / length[k]) if length[k] else 0.0 for k, s in enumerate(score)]
        best = max(range(n), key=lambda k: (final[k], -k))
        while self.tag[best] not in BLOCK and best:
            best = self.parent[best]
        whole = self._article(best)
        kept = {best if whole is None else whole}
        if whole is None and best and self.tag[best] not in ("html", "body"):
            for k in range(1, n):
                if self.parent[k] == self.parent[best] and not gone[k] and length[k]:
                    density = links[k] / length[k]
                    prose = self.tag[k] in ("p", "pre", "blockquote") and (length[k] > 80 and density < 0.25 or not links[k] and commas[k] + size_of.get(k, 0) > 20)
                    listing = self.tag[k] in ("ul", "ol", "dl", "table", "figure", "section") and density < 0.25
                    if final[k] >= 3 or prose or listing or self.tag[k] in ("h1", "h2", "h3", "h4", "h5", "h6") and density < 0.3:
                        kept.add(k)
        inside = [False] * n
        listed: dict[int, int] = {}
        for k in range(1, n):
            if self.tag[k] == "a":
                up = self.parent[k]
                while up > 0 and self.tag[up] not in ("ul", "ol", "dl", "table", "div", "section", "p"):
                    up = self.parent[up]
                listed[up] = listed.get(up, 0) + 1
        for k in range(n):
            menu = whole is None and k not in kept and listed.get(k, 0) >= 3 and length[k] and links[k] > 0.66 * length[k]
            inside[k] = (k in kept or (k > 0 and inside[self.parent[k]])) and not gone[k] and not menu
        out: list[str] = []
        last = None
        for node, block, piece in self.pieces:
            if inside[node]:
                if block != last:
                    out.append("\n")
                    last = block
                out.append(piece)
        return " ".join(html.unescape("".join(out)).split())

    def _article(self, node: int) -> int | None:
        """The outermost article around node, else the nearest element of the role or kind of main."""
        found = main = None
        while node > 0:
            if self.bonus[node] >= 25:
                if self.tag[node] == "article":
                    found = node
                elif main is None:
                    main = node
            node = self.parent[node]
        return main if found is None else found

    def _restore(self, own, in_link) -> None:
        """A wrapper isn't cut for its class if most of the text is in it and the article is: an article
        or main element, or, on pages without one, nearly all the text that isn't cut or linked."""
        n = len(self.tag)
        hidden, gone = [False] * n, [False] * n
        for k in range(1, n):
            hidden[k] = hidden[self.parent[k]] or self.never[k]
            gone[k] = gone[self.parent[k]] or self.cut[k]
        length = [0 if h else size for h, size in zip(hidden, own)]
        plain = sum(length)
        outside = sum(size for size, g, a in zip(own, gone, in_link) if not g and not a)
        marked = [not h and not c and (t in ("article", "main") or b >= 25) for h, c, t, b in zip(hidden, self.cut, self.tag, self.bonus)]
        none = not any(marked)
        for k in range(n - 1, 0, -1):
            length[self.parent[k]] += length[k]
            marked[self.parent[k]] |= marked[k] and not self.cut[k] or marked[k] and length[k] > 0.5 * plain
        for k in range(1, n):
            if self.cut[k] and not hidden[k] and length[k] > 0.5 * max(plain, 1) and (marked[k] or none and outside < 0.1 * length[k]):
                self.cut[k] = False


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


def extract_text(pages: DataFrame, html_column: str = "html", columns: list[str] | None = None) -> DataFrame:
    """columns of pages (all, by default) with main_text."""
    keep = pages.columns if columns is None else columns
    schema = added(pages.select(*[F.col(f"`{c}`") for c in keep]), (free_name(pages, "main_text"), T.StringType()))

    def run(batches):
        import pyarrow as pa

        for batch in byte_batches(batches, html_column, 4 << 20):
            found = pa.array([main_text(x) for x in batch.column(html_column).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), found], names=schema.names)

    small_batches(pages.sparkSession)
    return pages.mapInArrow(lean(run), schema)
