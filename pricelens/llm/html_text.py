"""Main text of web pages by tag-path ratios.

A page becomes a sequence of text blocks, each with its root-to-leaf tag path. Blocks of the same path are taken together:
text length, punctuation and linked text per block of the path. These ratios are smoothed over the page's block order with a
Gaussian window and fused into one weight: length * (1 + punctuation) * (1 - 2 * linked share), never below zero. The
weights decide: paths at THRESHOLD of the mean weight (by text) or more are content, and give the content's container; within it,
paths at INSIDE of that bound stay, so that an article's short blocks do and its lists of links don't; outside it
nothing stays, or, where paragraphs stand right in the body, the content paths do. The container is the smallest element with
most of the heaviest path's text or, where most of that text stands in article or main elements, the nearest of these, and a
wider one that holds no text in other articles; articles in it without a content path go. The top heading before a
container without one belongs to it.

Before that, elements that never hold the article go (menus, footers, adverts, comments, ...: by tag, role, class or id). A class that
only has such a word as a part, or a form, doesn't count where the element holds most of the page's text, and no article has text outside it. Comments
never count, however long, unless the page's h1 is in their element; they are also told by an article within an article that has text of its own, by a
heading that says so (TALK) before lists or sections, and by lists of which nearly every item holds a paragraph and a time.

A null or empty page gives an empty text; a page without content paths too. Of paths of equal weight the one that sorts last
is the heaviest. Broken markup is read as browsers do: an unclosed comment, script or tag lasts to the end of the page, a new
paragraph or item closes the last one, an end tag of an inline element is looked for within INLINE_OPEN open ones. Pages of any
length and depth are read whole, in time linear in their length. Repeated rows give equal rows; only page_id, url and html are read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, map_batches

#: Shares of the mean weight (by text) from which a path is content, and of that bound within the container; the smoothing
#: window (blocks each way, sigma); the share of the heaviest path's text that its container holds.
THRESHOLD, INSIDE, REACH, SIGMA, HOLDS = 0.35, 0.002, 2, 1.0, 0.8
INLINE_OPEN = 64
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_BARE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?+""")
_EMPTY = re.compile(r"""(?:^|[\s"'])/$""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_MARKS = re.compile(r"[.,;:!?…。，；：！？、]")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template title textarea iframe svg object canvas math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
#: Elements, roles and words of a class or id whose text is never the article's.
NO_TAGS = frozenset("head nav footer aside button select option menu dialog fieldset".split())
NO_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
NO_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice
    notices popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer social share sharing related
    recommended comment comments commentlist commentslist commentarea commentsection disqus respond reply replies newsletter subscribe subscription signup login widget widgets
    toolbar pagination pager""".split()
)
#: Not the article's unless inside it: its own heading may stand in such an element.
TOP_ONLY = frozenset("header masthead topbar".split())
#: Those of NO_WORDS that stand for readers' comments; last words of a class that only say whether there are any; headings of comments.
COMMENTS = frozenset("comment comments commentlist commentslist commentarea commentsection disqus respond reply replies".split())
STATES = frozenset("open closed enabled disabled on off".split())
TALK = re.compile(r"\W*(?:\d+\s+)?(?:(?:reader|user|your|leser)\s?)?(?:comments?|repl(?:y|ies)|responses?|discussion|kommentare?|antworten|commentaires?|réponses?|comentarios?|respuestas?)(?:\s*\(?\d+\)?)?\W*", re.I)
#: Characters of its own from which an article's inner articles are comments or teasers.
OWN_TEXT = 100
#: First words of class names that say what a page has or lacks elsewhere.
SAYS = frozenset("has have no not with without is hide show".split())
#: Elements of single blocks: a part of a class name says nothing there.
SMALL = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th tr pre blockquote figcaption caption".split())
#: An element closes these open ones, if it meets them before any of the stops.
CLOSES = {"li": ("li", "ul ol menu"), "dd": ("dd dt", "dl"), "dt": ("dd dt", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
HEAD = frozenset("meta link base title style script noscript template".split())
#: How sure it is that an element doesn't hold the article.
FINE, UNLIKELY, HARDLY, NEVER = range(4)


@dataclass
class Block:
    path: int
    text: str
    linked: int
    node: int


@dataclass
class Tree:
    """The elements of a page in the order in which they start, the root first, and its tag paths."""

    tag: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [-1])
    path: list[int] = field(default_factory=lambda: [0])
    flag: list[int] = field(default_factory=lambda: [FINE])
    article: list[int] = field(default_factory=lambda: [-1])
    talk: list[bool] = field(default_factory=lambda: [False])
    paths: dict[tuple[int, str], int] = field(default_factory=dict)

    def add(self, tag: str, label: str, parent: int, flag: int, article: bool, talk: bool) -> int:
        at = len(self.tag)
        self.tag.append(tag)
        self.parent.append(parent)
        own = self.path[parent]
        self.path.append(own if tag in INLINE else self.paths.setdefault((own, label), len(self.paths) + 1))
        self.flag.append(flag)
        self.article.append(at if article else self.article[parent])
        self.talk.append(talk)
        return at

    def upward(self, value: list) -> list:
        """Sums of value over each element and what it holds."""
        for k in range(len(value) - 1, 0, -1):
            value[self.parent[k]] += value[k]
        return value

    def names(self) -> dict[int, tuple[str, ...]]:
        out: dict[int, tuple[str, ...]] = {0: ()}
        for (above, label), k in self.paths.items():
            out[k] = (*out[above], label)
        return out


def _attributes(raw: str) -> tuple[str, list[str], set[str], bool]:
    """(label for the path, names in class and id, roles, hidden)."""
    label, names, roles, hidden = "", [], set(), False
    seen: set[str] = set()
    for m in _ATTRIBUTE.finditer(raw):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name in seen:  # the first one counts
            continue
        seen.add(name)
        if name in ("class", "id"):
            names += value.split()
            label = label or value.split(" ")[0] if name == "class" else label
        elif name == "role":
            roles = set(value.lower().split())
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
        elif name in ("hidden", "aria-hidden"):
            hidden |= name == "hidden" or value.lower() == "true"
    return label, names, roles, hidden


def _flag(tag: str, names: list[str], roles: set[str], hidden: bool, in_article: bool) -> int:
    if tag in ("html", "body", "article", "main"):
        return FINE
    if hidden or tag in NO_TAGS or roles & NO_ROLES or (tag == "header" and not in_article):
        return NEVER
    flag = UNLIKELY if tag == "form" else FINE
    for name in names:
        if name.lower() in NO_WORDS or (not in_article and name.lower() in TOP_ONLY):
            return HARDLY
        words = [w.lower() for w in _WORDS.findall(name)]
        if words and words[-1] in STATES and not COMMENTS.isdisjoint(words):
            continue
        if len(words) > 1 and words[0] not in SAYS and tag not in SMALL and not NO_WORDS.isdisjoint(words):
            flag = UNLIKELY
    return flag


def parse(page: str) -> tuple[Tree, list[tuple[int, list[tuple[int, str, bool]]]]]:
    """The elements of a page, and its blocks: (element, pieces of text with their element and whether they are linked)."""
    tree = Tree()
    stack: list[int] = [0]
    is_open: Counter[str] = Counter()
    out: list[tuple[int, list[tuple[int, str, bool]]]] = []
    pieces: list[tuple[int, str, bool]] = []
    block_at: list[int] = [0]  # open elements that aren't inline

    def end_block() -> None:
        nonlocal pieces
        if pieces:
            out.append((block_at[-1], pieces))
            pieces = []

    def close(at: int) -> None:
        if any(tree.tag[k] not in INLINE for k in stack[at:]):
            end_block()
        for k in stack[at:]:
            is_open[tree.tag[k]] -= 1
            if tree.tag[k] not in INLINE:
                block_at.pop()
        del stack[at:]

    def add(raw: str) -> None:
        if raw:
            pieces.append((stack[-1], html.unescape(raw), is_open["a"] > 0))

    at, n = 0, len(page)
    last_end = page.rfind(">")
    while 0 <= (start := page.find("<", at)):
        if start > last_end:  # an unclosed tag, if it is one
            if re.compile(r"<[a-zA-Z/!?]").match(page, start):
                add(page[at:start])
                at = n
            else:
                add(page[at : start + 1])
                at = start + 1
            continue
        add(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        m = _TAG.match(page, start) or _BARE.match(page, start)
        if not m:
            if page[start + 1 : start + 2] in ("!", "?", "/"):
                at = page.find(">", start) + 1
            else:
                add("<")
                at = start + 1
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if not is_open[tag]:
                continue
            low = max(1, len(stack) - INLINE_OPEN) if tag in INLINE else 1
            for i in range(len(stack) - 1, low - 1, -1):
                if tree.tag[stack[i]] == tag:
                    close(i)
                    break
                if tag in INLINE and tree.tag[stack[i]] not in INLINE:
                    break
            continue
        if tag in VOID:
            add(" ")
            if tag == "hr":
                end_block()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag not in INLINE:
            if is_open["head"] and tag not in HEAD:
                close(next(i for i in range(len(stack)) if tree.tag[stack[i]] == "head"))
            if tag in CLOSES:
                shut, stops = CLOSES[tag]
                if any(is_open[x] for x in shut):
                    for i in range(len(stack) - 1, 0, -1):
                        if tree.tag[stack[i]] in stops:
                            break
                        if tree.tag[stack[i]] in shut:
                            close(i)
                            break
            elif is_open["p"]:
                for i in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                    if tree.tag[stack[i]] == "p":
                        close(i)
                        break
                    if tree.tag[stack[i]] not in INLINE:
                        break
            end_block()
        label, names, roles, hidden = _attributes(m[3]) if m[3] else ("", [], set(), False)
        article = tag in ("article", "main") or "main" in roles or "article" in roles
        flag = _flag(tag, names, roles, hidden, tree.article[stack[-1]] >= 0)
        if not _EMPTY.search(m[3]):
            talk = flag in (UNLIKELY, HARDLY) and any(not COMMENTS.isdisjoint([x.lower(), *(w.lower() for w in _WORDS.findall(x))]) for x in names)
            k = tree.add(tag, f"{tag}.{label}" if label else tag, stack[-1], flag, article, talk)
            stack.append(k)
            is_open[tag] += 1
            if tag not in INLINE:
                block_at.append(k)
    add(page[at:])
    end_block()
    return tree, out


def _comments(tree: Tree, raw: list, own: list[int], tops: list[int]) -> list[bool]:
    """By element: whether it is readers' comments by what stands around it. own: the text of an article that is in none of its inner articles."""
    n = len(tree.tag)
    out, inside = [False] * n, [-1] * n  # inside: the nearest article element, itself included
    items, told, times, texts = [0] * n, [0] * n, [int(t == "time") for t in tree.tag], [int(t == "p") for t in tree.tag]
    times, texts = tree.upward(times), tree.upward(texts)
    for k in range(1, n):
        up = tree.parent[k]
        inside[k] = k if tree.tag[k] == "article" else inside[up]
        if tree.tag[k] == "article" and inside[up] >= 0 and own[inside[up]] >= OWN_TEXT and not tops[k]:
            out[k] = True
        if tree.tag[k] == "li":
            items[up] += 1
            told[up] += times[k] > 0 and texts[k] > 0
    for k in range(1, n):
        if tree.tag[k] in ("ol", "ul") and told[k] >= 2 and 5 * told[k] >= 4 * items[k]:
            out[k] = True
    heads: dict[int, list[tuple[int, str]]] = {}  # headings that speak of comments, by what they stand in
    for node, pieces in raw:
        if re.fullmatch("h[2-6]", tree.tag[node]) and TALK.fullmatch("".join(said for _, said, _ in pieces).strip()):
            heads.setdefault(tree.parent[node], []).append((node, tree.tag[node]))
    if heads:
        active: dict[int, tuple[int, str]] = {}
        for k in range(1, n):
            up = tree.parent[k]
            if up not in heads:
                continue
            if re.fullmatch("h[1-6]", tree.tag[k]):
                here = next((h for h in heads[up] if h[0] == k), None)
                if here:
                    active[up] = here
                elif up in active and tree.tag[k] <= active[up][1]:
                    del active[up]
            elif up in active and tree.tag[k] in ("ol", "ul", "dl", "div", "section", "article") and not tops[k]:
                out[k] = out[active[up][0]] = True
    return out


def blocks(page: str) -> tuple[Tree, list[Block]]:
    """The text blocks of a page in order, without those that never hold the article."""
    tree, raw = parse(page)
    n = len(tree.tag)
    never = [False] * n
    for k in range(1, n):
        never[k] = never[tree.parent[k]] or tree.flag[k] == NEVER
    free, many, own, spoken = [0] * n, [0] * n, [0] * n, [0] * n
    for node, pieces in raw:
        size = sum(len(said.strip()) for k, said, linked in pieces if not linked and not never[k])
        free[node] += size
        many[node] += size > 0
        if tree.article[node] >= 0:
            own[tree.article[node]] += size
            spoken[node] += size
    free, many, spoken = tree.upward(free), tree.upward(many), tree.upward(spoken)
    marks, tops = (tree.upward([int(t in names) for t in tree.tag]) for names in (("article", "main", "h1"), ("h1",)))
    talk = _comments(tree, raw, own, tops)
    gone = [False] * n
    for k in range(1, n):
        f = tree.flag[k]
        if f and f < NEVER and 2 * free[k] > free[0]:  # it holds most of the page, the article too
            alone = f == UNLIKELY and many[k] > 2 and spoken[0] == spoken[k]
            if tops[k] if tree.talk[k] else marks[k] or alone:
                f = FINE
        gone[k] = gone[tree.parent[k]] or f > FINE or talk[k]
    out = []
    for node, pieces in raw:
        text = " ".join("".join(said for k, said, _ in pieces if not gone[k]).split())
        if text:
            linked = sum(len(said.strip()) for k, said, is_linked in pieces if is_linked and not gone[k])
            out.append(Block(tree.path[node], text, min(linked, len(text)), node))
    return tree, out


def _smooth(x: list[float]) -> list[float]:
    kernel = [math.exp(-0.5 * (k / SIGMA) ** 2) for k in range(REACH + 1)]
    out = []
    for i in range(len(x)):
        near = range(max(0, i - REACH), min(len(x), i + REACH + 1))
        out.append(sum(kernel[abs(i - j)] * x[j] for j in near) / sum(kernel[abs(i - j)] for j in near))
    return out


def path_sums(found: list[Block]) -> dict[int, list[int]]:
    """(text, punctuation, linked text, blocks) of each path."""
    sums: dict[int, list[int]] = {}
    for b in found:
        s = sums.setdefault(b.path, [0, 0, 0, 0])
        for k, v in enumerate((len(b.text), len(_MARKS.findall(b.text)), b.linked, 1)):
            s[k] += v
    return sums


def weights(found: list[Block]) -> tuple[dict[int, float], float]:
    """The fused weight of each path, and their mean by text."""
    sums = path_sums(found)
    length = _smooth([sums[b.path][0] / sums[b.path][3] for b in found])
    marks = _smooth([sums[b.path][1] / sums[b.path][3] for b in found])
    total: dict[int, float] = dict.fromkeys(sums, 0.0)
    for b, x, y in zip(found, length, marks, strict=True):
        total[b.path] += x * (1 + y)
    fused = {p: total[p] / s[3] * max(0.0, 1 - 2 * s[2] / max(1, s[0])) for p, s in sums.items()}
    return fused, sum(fused[p] * s[0] for p, s in sums.items()) / max(1, sum(s[0] for s in sums.values()))


def _articles(tree: Tree, found: list[Block], heavy: list[Block], chosen: set[int]) -> set[int]:
    """The articles that give the text, if most of the heavy blocks' text stands in articles."""
    own: Counter[int] = Counter(a for b in found if (a := tree.article[b.node]) >= 0)
    if 2 * sum(len(b.text) for b in heavy if tree.article[b.node] >= 0) <= sum(len(b.text) for b in heavy):
        return set()
    around = lambda a: tree.article[tree.parent[a]]
    for a in list(own):
        while (a := around(a)) >= 0 and a not in own:
            own[a] = 0
    held = {tree.article[b.node] for b in heavy}
    # from the inmost: one that holds the path, or around such ones if no other article in it has text
    below, covered, box = dict.fromkeys(own, 0), dict.fromkeys(own, 0), set()
    for a in sorted(own, reverse=True):
        if a in held or (covered[a] and covered[a] == below[a]):
            box.add(a)
            covered[a] = own[a] + below[a]
        if around(a) >= 0:
            below[around(a)] += own[a] + below[a]
            covered[around(a)] += covered[a]
    # from the outmost: articles in these, as far as they have content
    good, inside = {tree.article[b.node] for b in found if b.path in chosen}, set()
    for a in sorted(own):
        if a in box or around(a) in inside:
            inside.add(a)
    return box | (inside & good)


def _container(tree: Tree, heavy: list[Block]) -> int:
    """The smallest element with HOLDS of the heavy blocks' text."""
    held = [0] * len(tree.tag)
    for b in heavy:
        held[tree.parent[b.node] if tree.tag[b.node] in SMALL else b.node] += len(b.text)
    held = tree.upward(held)
    return max(k for k, x in enumerate(held) if x >= HOLDS * held[0])


def content(tree: Tree, found: list[Block]) -> list[Block]:
    """The blocks whose paths are content."""
    if not found:
        return []
    fused, mean = weights(found)
    least = THRESHOLD * mean
    chosen = {p for p, w in fused.items() if w > 0 and w >= least}
    if not chosen:
        return []
    text: Counter[int] = Counter()
    for b in found:
        text[b.path] += len(b.text)
    heaviest = max(chosen, key=lambda p: (fused[p] * text[p], p))
    heavy = [b for b in found if b.path == heaviest]
    stays = lambda b: fused[b.path] > 0 and fused[b.path] >= INSIDE * least
    if articles := _articles(tree, found, heavy, chosen):
        return [b for b in found if tree.article[b.node] in articles and stays(b)]
    home = _container(tree, heavy)
    if tree.tag[home] in ("body", "html", ""):  # its paragraphs stand among everything else
        return [b for b in found if b.path in chosen]
    within = [False] * len(tree.tag)
    for k in range(home, len(within)):
        within[k] = k == home or within[tree.parent[k]]
    kept = [b for b in found if within[b.node] and stays(b)]
    top = [b for b in found if tree.tag[b.node] == "h1"]
    if len(top) == 1 and top[0].node < home and stays(top[0]):
        kept.insert(0, top[0])
    return kept


def main_text(page: str | None) -> str:
    return "\n".join(b.text for b in content(*blocks(page))) if page else ""


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(it):
        for batch in it:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield from batches(
                {"page_id": batch.column(0).to_pylist(), "url": batch.column(1).to_pylist(), "text": texts, "n_chars": list(map(len, texts))}, _OUT
            )

    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    return map_batches(rows, run, "page_id long, url string, text string, n_chars long")
