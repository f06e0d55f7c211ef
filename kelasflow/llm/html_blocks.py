"""Blocks of text and the elements that hold them, from one page's HTML.

A tolerant reader in one pass over the tags: unclosed and stray tags, raw text
elements, comments and character references as browsers treat them.  It keeps
no tree; an element is known by the hash of its path of signatures (tag, id,
classes, role; digits folded), so equal branches of a site's pages meet.
"""

from __future__ import annotations

import hashlib
import html
import re
from dataclasses import dataclass, field

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*+)>?""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
PART = re.compile(r"[A-Za-z][a-z]*|[0-9]+")
DIGITS = re.compile(r"[0-9]+")
DEPTH = 64                  # deeper elements count as content of the one at this depth

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template iframe noscript noembed noframes xmp svg math object canvas "
                "audio video select datalist".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table "
    "caption tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# An opening tag closes an open element of these, up to the nearest container.
CLOSES = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
          "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tbody": ("tr td th thead", "table")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}

# Presentation that marks a branch as none of the article: elements, roles, words of ids and classes.
NOISE_TAGS = frozenset("nav aside footer form menu dialog search button label fieldset legend".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar "
                        "toolbar tablist".split())
NOISE_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs masthead banner footer foot sidebar aside widget widgets "
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion cookie "
    "cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login register "
    "form search share sharing social comment comments reply replies respond disqus related recommended recommendations "
    "pagination pager copyright disclaimer skip toolbar topbar hidden".split())
HEADER_WORDS = frozenset("header head".split())
NOT_ABOUT = frozenset("no has with without open closed is".split())    # "no-sidebar", "comments-open"
ROOT_TAGS, ROOT_ROLES = frozenset(["article", "main"]), frozenset(["article", "main"])
PLAIN = HEADINGS | frozenset("p ul ol li dl dt dd blockquote pre figure figcaption table thead tbody tfoot tr td th "
                             "caption div section hgroup header".split())


def _hash(parent: int, text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8,
                                          key=parent.to_bytes(8, "little", signed=True)).digest(), "little", signed=True)


def _names(value: str, known: frozenset) -> bool:
    words = [w.lower() for w in PART.findall(value)]
    return any(w in known and (i == 0 or words[i - 1] not in NOT_ABOUT)
               and (i + 1 == len(words) or words[i + 1] not in NOT_ABOUT) for i, w in enumerate(words))


@dataclass(slots=True)
class Kind:
    """What an element's tag and attributes say."""

    signature: str
    noise: bool             # presentation of importance 0
    root: bool              # marked as the article
    header: bool            # a header by element or name
    plain: bool             # neither id, class nor role


def kind_of(tag: str, attributes: str) -> Kind:
    given = {}
    if attributes and not attributes.isspace():
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            given.setdefault(name.lower(), html.unescape(a or b or c))
    name, classes, role = given.get("id", ""), given.get("class", ""), given.get("role", "").strip().lower()
    root = tag in ROOT_TAGS or role in ROOT_ROLES or given.get("itemprop", "").lower() == "articlebody"
    top = tag in ("html", "body")
    noise = (tag in NOISE_TAGS or role in NOISE_ROLES or "hidden" in given or given.get("aria-hidden") == "true"
             or "display:none" in given.get("style", "").replace(" ", "").lower()
             or any(_names(v, NOISE_WORDS) for v in (name, *classes.split())))
    if top or (tag in ROOT_TAGS and not _comment_like(name, classes)):
        noise = "hidden" in given and not top
    signature = DIGITS.sub("0", ".".join([tag, name, *sorted(set(classes.split())), role]))
    header = tag == "header" or (tag not in HEADINGS and not top and not root
                                 and any(_names(v, HEADER_WORDS) for v in (name, *classes.split())))
    return Kind(signature, noise, root and not noise, header, not (name or classes or role))


def _comment_like(name: str, classes: str) -> bool:
    """A comment may be marked up as an article of its own."""
    words = {w.lower() for w in PART.findall(f"{name} {classes}")}
    return bool(words & {"comment", "reply", "ad", "advert", "advertisement", "promo", "sponsored", "related"})


@dataclass(slots=True)
class Node:
    tag: str
    path: int
    above: tuple            # paths from the top to this one
    noise: bool
    root: bool
    head: bool              # a header of the article: its headings alone are text
    safe: bool              # never removed for low importance
    inline: bool            # noise inside a block: its own text is passed over


@dataclass(slots=True)
class Page:
    blocks: list = field(default_factory=list)      # (text, path, characters in links, under a root)
    children: dict = field(default_factory=dict)    # path -> signatures of its children, repeats folded
    nodes: dict = field(default_factory=dict)       # path -> (paths from the top, safe or noise)


class Reader:
    """Reads pages; remembers element kinds and path hashes between them."""

    def __init__(self):
        self.kinds: dict = {}
        self.paths: dict = {}
        self.noise: dict = {}

    def _kind(self, tag: str, attributes: str) -> Kind:
        key = (tag, attributes)
        if key not in self.kinds:
            if len(self.kinds) > 20_000:
                self.kinds.clear()
            self.kinds[key] = kind_of(tag, attributes)
        return self.kinds[key]

    def _path(self, parent: int, signature: str) -> int:
        key = (parent, signature)
        if key not in self.paths:
            if len(self.paths) > 50_000:
                self.paths.clear()
            self.paths[key] = _hash(parent, signature)
        return self.paths[key]

    def _noise_node(self, tag: str) -> Node:
        if tag not in self.noise:
            if len(self.noise) > 1_000:
                self.noise.clear()
            self.noise[tag] = Node(tag, 0, (), True, False, False, True, tag not in BLOCK)
        return self.noise[tag]

    def read(self, text: str, removed: frozenset = frozenset()) -> Page:
        """Blocks in page order, without those below a branch that its
        presentation marks as noise or whose path is in ``removed``."""
        page = Page()
        stack = [Node("", 0, (), False, False, False, True, False)]
        opened: dict[str, int] = {}
        parts: list[str] = []
        links, in_link, at, n = 0, False, 0, len(text)

        def flush():
            nonlocal links, in_link
            if parts:
                block = " ".join("".join(parts).split())
                if block:
                    top = next(node for node in reversed(stack) if not node.inline)
                    if not (top.head and top.tag not in HEADINGS):
                        page.blocks.append((block, top.path, min(links, len(block)), top.root))
                parts.clear()
            links, in_link = 0, False

        def close(until: int):
            if not all(node.inline for node in stack[until:]):
                flush()
            for node in stack[until:]:
                opened[node.tag] -= 1
            del stack[until:]

        def say(piece: str):
            nonlocal links
            if stack[-1].noise:
                return
            if "&" in piece:
                piece = html.unescape(piece)
            parts.append(piece)
            if in_link:
                links += len(piece)

        while at < n:
            m = TAG.search(text, at)
            if m is None:
                say(text[at:])
                break
            if m.start() > at:
                say(text[at:m.start()])
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:                                                    # an end tag
                if tag == "a":
                    in_link = False
                elif opened.get(tag):
                    close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
                elif tag in BLOCK:
                    flush()
                continue
            if tag in RAW:
                if not (tag in ("svg", "math") and m[3].endswith("/")):
                    end = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|\\Z)", re.I).search(text, at)
                    at = end.start() if end else n
                continue
            if tag == "a":
                in_link = True
            block = tag in BLOCK
            if tag in VOID:
                if block:
                    flush()
                elif tag in ("br", "wbr"):
                    parts.append(" " if tag == "br" else "")
                continue
            kind = self._kind(tag, m[3])
            if not block and not kind.noise and not opened.get(tag):
                continue
            if block:
                flush()
                i = len(stack) - 1
                while stack[i].inline:
                    i -= 1
                if stack[i].tag == "p":                                 # a block ends an open paragraph
                    close(i)
                if tag in CLOSES:
                    ends, within = CLOSES[tag]
                    i = len(stack) - 1
                    low = None
                    while i and stack[i].tag not in within and len(stack) - i < DEPTH:
                        if stack[i].tag in ends:
                            low = i
                        i -= 1
                    if low is not None:
                        close(low)
            parent = stack[-1]
            if parent.noise:                                            # below noise only nesting counts
                stack.append(self._noise_node(tag))
                opened[tag] = opened.get(tag, 0) + 1
                continue
            root = parent.root or kind.root
            head = parent.head or (kind.header and parent.root)
            noise = kind.noise or (kind.header and not parent.root)
            if len(parent.above) < DEPTH:
                path = self._path(parent.path, kind.signature)
                above = (*parent.above, path)
                below = page.children.setdefault(parent.path, [])
                if kind.signature not in below[-1:]:
                    below.append(kind.signature)
                safe = tag in ("html", "body") or kind.root or (parent.root and kind.plain and tag in PLAIN)
                page.nodes[path] = (above, safe or noise)
            else:
                path, above, safe = parent.path, parent.above, parent.safe
            stack.append(Node(tag, path, above, noise or (path in removed and not safe), root, head, safe,
                              not block))
            opened[tag] = opened.get(tag, 0) + 1
        flush()
        return page


def main_text(page: Page) -> str:
    """The blocks left, in page order; where the page marks its article, those inside it."""
    marked = [b for b in page.blocks if b[3]]
    return " ".join(b[0] for b in (marked or page.blocks))
