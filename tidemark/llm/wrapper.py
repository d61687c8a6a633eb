"""Main texts of web pages, by union-free expressions inferred from the pages of a host."""

from __future__ import annotations

import html as references
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged

# Element names by their part in a page.
BLOCKS = set(
    "address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table tbody "
    "td tfoot th thead tr ul".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
TRANSPARENT = {"html", "head", "body"}
# What says that an element is none of the article, and what says that it is.
BOILERPLATE_TAGS = set(
    "aside audio button canvas dialog footer form menu nav noscript object search select svg template video".split())
BOILERPLATE_ROLES = set(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search tablist toolbar".split())
BOILERPLATE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies copyright "
    "footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup "
    "promo promotion recommended related share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split())
COMMENT_WORDS = set("comment comments commentlist disqus replies reply respond".split())
STATE_WORDS = set("closed has hidden hide no open with without".split())  # as in has-sidebar, comments-open
MAIN_TAGS = {"article", "main"}
MAIN_ROLES = {"article", "main"}
MAIN_WORDS = [{"entry", "content"}, {"post", "content"}, {"post", "body"}, {"article", "content"}, {"article", "body"},
              {"article", "text"}, {"story", "body"}, {"main", "content"}, {"articlebody"}, {"maincontent"}]
# a start tag of the key closes an open element of the values, up to one of the last set
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "tbody": ({"thead", "tbody"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"}), "option": ({"option"}, {"select"})}
_NARROW = {"p", "li", "dt", "dd", "tr", "td", "th"} | HEADINGS

_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/><]*)((?:[^<>"']++|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*>""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+))""")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile("(?<=[a-z])(?=[A-Z])")
TEXT = "#"
DEEPEST = 200

_MARKED = re.compile(r"\b(?:class|id|role|itemprop)\s*=", re.IGNORECASE)
_MOST_LABELS = 1 << 14

Step = tuple[str, ...]
Labels = dict[tuple[str, str], str]


def _label(tag: str, attributes: str) -> str:
    """Name of an element in wrappers: a sign, the tag and its classes.

    The sign is + for the article, ! for comments, - for what is none of the article unless it holds the article, ^ for
    what is none of it unless inside.
    """
    found = {}
    if attributes:
        for name, *value in _ATTRIBUTE.findall(attributes):
            found.setdefault(name.lower(), references.unescape("".join(value)))
    words: set[str] = set()
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        parts = set(_WORD.findall(name.lower())) | set(_WORD.findall(_CAMEL.sub(" ", name).lower()))
        if not parts & STATE_WORDS:
            words |= parts
    roles = set(found.get("role", "").lower().split())
    sign = ""
    if words & COMMENT_WORDS:
        sign = "!"
    elif tag in BOILERPLATE_TAGS or roles & BOILERPLATE_ROLES or words & BOILERPLATE_WORDS:
        sign = "-"
    elif tag in MAIN_TAGS or roles & MAIN_ROLES or "articlebody" in found.get("itemprop", "").lower() or any(
            w <= words for w in MAIN_WORDS):
        sign = "+"
    elif tag == "header" or "header" in words:
        sign = "^"
    return sign + ".".join([tag, *sorted(set(re.sub(r"[^a-z_-]", "", c) for c in found.get("class", "").lower().split()) - {""})])


def tokens(page: str | None, labels: Labels | None = None) -> list[Step]:
    """The normalised token stream: ("open", label), ("close",) and ("text", text, characters in links).

    Blocks and elements of a known part are opened and closed in pairs, also where the page leaves tags out; other
    markup only goes on with the text.  References are decoded and white space becomes one blank.  Elements nested
    more than 200 deep go on in their parent.  Null is an empty page.  ``labels`` keeps names for the next page.
    """
    page = page or ""
    out: list[Step] = []
    stack: list[tuple[str, bool]] = []  # tag, whether it was opened in the stream
    parts: list[str] = []
    linked = deep = 0
    links = 0
    labels = {} if labels is None else labels
    standing: Counter[str] = Counter()

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((TEXT, text, min(links, len(text))))
            parts.clear()
            links = 0

    def close_to(k: int) -> None:
        nonlocal deep
        flush()
        while len(stack) > k:
            name, opened = stack.pop()
            standing[name] -= 1
            if opened:
                deep -= 1
                out.append(("close",))

    def innermost(tags: set[str], until: set[str] | None) -> int | None:
        for t in tags:
            if standing[t]:
                break
        else:
            return None
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                return k
            if until is None and stack[k][0] in BLOCKS or until is not None and stack[k][0] in until:
                return None
        return None

    at, token = 0, _TOKEN.search
    while True:
        m = token(page, at)
        text = page[at:m.start() if m else len(page)]
        if text:
            text = references.unescape(text) if "&" in text else text
            parts.append(text)
            if linked:
                links += len(text)
        if m is None:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag, attributes = tag.lower(), m[3]
        if m[1]:
            if tag == "a":
                linked = max(0, linked - 1)
            if tag in HEADINGS:
                k = innermost(HEADINGS, None)
            elif not standing[tag]:
                k = None
            elif tag in _NARROW:
                k = innermost({tag}, None if tag == "p" else CLOSES[tag][1])
            else:
                k = innermost({tag}, {"td", "th"})
            if k is not None:
                close_to(k)
            elif tag in BLOCKS:
                flush()
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE).search(page, at)
            at = len(page) if end is None else end.start()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            linked = 1
        if tag in TRANSPARENT:
            flush()
            continue
        block = tag in BLOCKS
        if not block and tag not in BOILERPLATE_TAGS and not (attributes and _MARKED.search(attributes)):
            continue
        label = labels.get((tag, attributes))
        if label is None:
            if len(labels) > _MOST_LABELS:
                labels.clear()
            label = labels[tag, attributes] = _label(tag, attributes)
        if not block and label[0] not in "!-+":
            continue
        if block:
            k = innermost({"p"}, None) if standing["p"] else None
            if k is not None:
                close_to(k)
            if tag in HEADINGS and stack and stack[-1][0] in HEADINGS:
                close_to(len(stack) - 1)
            if tag in CLOSES and (k := innermost(*CLOSES[tag])) is not None:
                close_to(k)
        flush()
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            continue
        opened = deep < (DEEPEST * 2 if label[0] in "!-" else DEEPEST)
        stack.append((tag, opened))
        standing[tag] += 1
        if opened:
            deep += 1
            out.append(("open", label))
    close_to(0)
    return out


@dataclass
class Node:
    """Part of a wrapper: an element, what it may hold and in which order.

    ``loops[k]`` tells that the k-th member and the next are in one repeated group.  ``count`` is how often the element
    came, ``holders`` in how many occurrences of its parent; fewer than those make it optional.  The text slot
    sums up what came directly in the element: texts, characters, those in links, smallest and greatest hash.
    """

    order: list[str]
    loops: list[bool]
    members: dict[str, Node]
    count: int = 0
    holders: int = 0
    repeated: bool = False
    text: list[int] | None = None

    @classmethod
    def new(cls) -> Node:
        return cls([], [], {})

    def place(self, label: str, last: int) -> int:
        """Align one member: its place in the order, behind place ``last`` where it is new.

        One that came before is the start of another round of a repeated group.
        """
        if label not in self.members:
            self.members[label] = Node.new()
            self.order.insert(last + 1, label)
            self.loops.insert(last + 1, 0 <= last < len(self.loops) and self.loops[last])
            return last + 1
        at = self.order.index(label)
        for k in range(at, last):
            self.loops[k] = True
        return at

    def put_text(self, text: str, links: int) -> None:
        h = xxhash.xxh3_64_intdigest(text) >> 1
        self._add_text([1, len(text), links, h, h])

    def _add_text(self, more: list[int]) -> None:
        t = self.text
        self.text = more if t is None else [
            t[0] + more[0], t[1] + more[1], t[2] + more[2], min(t[3], more[3]), max(t[4], more[4])]

    def align(self, page: list[Step]) -> None:
        """Generalise the wrapper so that it takes in one more page."""
        self.count += 1
        above: list[tuple[Node, int, set[str]]] = []
        node, last, seen = self, -1, set()
        for step in page:
            if step[0] == "close":
                node, last, seen = above.pop()
                continue
            label = TEXT if step[0] == TEXT else step[1]
            at = node.place(label, last)
            member = node.members[label]
            member.repeated |= at == last
            if label not in seen:
                seen.add(label)
                member.holders += 1
            member.count += 1
            if label == TEXT:
                member.put_text(step[1], step[2])
                last = at
            else:
                above.append((node, at, seen))
                node, last, seen = member, -1, set()

    def merge(self, other: Node) -> None:
        """Align the wrapper of other pages, member by member."""
        self.count += other.count
        self.holders += other.holders
        self.repeated |= other.repeated
        if other.text:
            self._add_text(other.text)
        last, at = -1, []
        for label in other.order:
            last = self.place(label, last)
            at.append(label)
            self.members[label].merge(other.members[label])
        for k, loop in enumerate(other.loops[:-1]):
            if loop:
                a, b = sorted((self.order.index(at[k]), self.order.index(at[k + 1])))
                for j in range(a, b):
                    self.loops[j] = True

    def packed(self) -> list:
        return [self.count, self.holders, int(self.repeated), self.text, self.order, [int(x) for x in self.loops],
                [self.members[x].packed() for x in self.order]]

    @classmethod
    def unpacked(cls, data: list) -> Node:
        count, holders, repeated, text, order, loops, members = data
        return cls(order, [bool(x) for x in loops], {x: cls.unpacked(m) for x, m in zip(order, members, strict=True)},
                   count, holders, bool(repeated), text)

    def expression(self) -> str:
        """The wrapper as a union-free expression: # for a text slot, ? optional, + repeated."""
        out, k = [], 0
        while k < len(self.order):
            end = k
            while end < len(self.order) - 1 and self.loops[end]:
                end += 1
            group = " ".join(self._member(x) for x in self.order[k:end + 1])
            out.append(f"({group})+" if end > k else group)
            k = end + 1
        return " ".join(out)

    def _member(self, label: str) -> str:
        m = self.members[label]
        inner = "" if label == TEXT else f"[{m.expression()}]"
        return label + inner + ("+" if m.repeated else "") + ("?" if m.holders < self.count else "")


def _variable(node: Node) -> int:
    """Characters outside links of a slot whose text differs; a text that is always the same is the template's."""
    t = node.text
    return 0 if t is None or (t[0] > 1 and t[3] == t[4]) else t[1] - t[2]


def _holds_main(node: Node) -> bool:
    return any(x[0] == "+" or x[0] != "!" and _holds_main(m) for x, m in node.members.items())


def slots_of(wrapper: Node) -> dict[str, int]:
    """Level of each slot of a wrapper, by its path: 1 in an element that says it is the article, 2 in
    the element that holds most text itself, 3 any other; slots of menus, notices and the like are missing.

    An element counts the differing text of itself, its headings, paragraphs and list items.
    """
    found: list[tuple[str, Node, bool]] = []
    weights: dict[str, int] = {}

    def walk(node: Node, path: str, main: bool) -> None:
        weights[path] = 0
        for label, member in node.members.items():
            here = f"{path}/{label}"
            if label == TEXT:
                found.append((here, member, main))
                weights[path] += _variable(member)
                continue
            if label[0] == "!" or label[0] in "-^" and not _holds_main(member) and not (label[0] == "^" and main):
                continue
            tag = label.lstrip("+^-!").split(".")[0]
            if (tag in HEADINGS or tag in ("p", "pre", "blockquote", "ul", "ol")) and label[0].isalpha():
                inner = [member, *(m for x, m in member.members.items() if x.startswith("li"))]
                weights[path] += sum(_variable(m.members[TEXT]) for m in inner if TEXT in m.members)
            walk(member, here, main or label[0] == "+")

    walk(wrapper, "", False)
    best = max(weights, key=lambda x: (weights[x], -len(x), x))
    inside = [p for p, *_ in found if p.startswith(best + "/")]
    titled = any("/h1" in p[len(best):] for p in inside)
    out = {}
    for path, _, main in found:
        title = not titled and "/h1" in path
        out[path] = 1 if main else 2 if path.startswith(best + "/") or title else 3
    return out


def main_text(page: list[Step], slots: dict[str, int]) -> str:
    """The texts of a page that fall into slots of the lowest level the page has, blocks in page order."""
    path, above, texts = "", [], []
    for step in page:
        if step[0] == "open":
            above.append(path)
            path = f"{path}/{step[1]}"
        elif step[0] == "close":
            path = above.pop()
        else:
            level = slots.get(f"{path}/{TEXT}")
            if level:
                texts.append((level, step[1]))
    lowest = min((level for level, _ in texts), default=0)
    return "\n\n".join(text for level, text in texts if level == lowest)


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; empty where there is none."""
    found = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\s]+)", 1)
    return F.lower(F.coalesce(found, F.lit("")))


def _dumped(node: Node) -> str:
    return json.dumps(node.packed(), separators=(",", ":"))


def wrappers(pages: DataFrame, fan: int = 64) -> DataFrame:
    """(host, wrapper, expression, slots): one union-free expression per host of ``pages`` (url, html), from all its pages.

    Pages are aligned one by one with the wrapper of their host in each batch.  Only those wrappers are shuffled; they
    merge in rounds of about ``fan`` per group, so a host that owns most pages is spread like the others.  Wrappers
    merge to the same slots in any order.  An empty table gives an empty one.
    """
    def infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            of_host, labels = {}, {}
            for host, page in zip(batch["host"], batch["html"], strict=True):
                of_host.setdefault(host, Node.new()).align(tokens(page, labels))
            yield pd.DataFrame({"host": list(of_host), "wrapper": list(map(_dumped, of_host.values()))},
                               columns=["host", "wrapper"])

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        total = Node.new()
        for data in sorted(group["wrapper"]):
            total.merge(Node.unpacked(json.loads(data)))
        return pd.DataFrame({"host": group["host"].iloc[:1], "wrapper": [_dumped(total)]})

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            nodes = [Node.unpacked(json.loads(x)) for x in batch["wrapper"]]
            yield batch.assign(expression=[n.expression() for n in nodes], slots=[slots_of(n) for n in nodes])

    kind = "host string, wrapper string"
    parts = staged(pages.select(host_of(F.col("url")).alias("host"), "html").mapInPandas(infer, kind), "wrappers")
    while (most := parts.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        groups = -(-most // fan)
        salt = F.pmod(F.monotonically_increasing_id(), F.lit(groups))
        parts = staged(parts.withColumn("salt", salt).groupBy("host", "salt").applyInPandas(merged, kind), "wrappers")
    return parts.mapInPandas(described, f"{kind}, expression string, slots map<string,int>")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row: the article's text, blocks parted by two line feeds, empty if there is none.

    The wrapper of a page's host tells which of its text slots belong to the article.  Null or empty pages have no text; pages
    without a host in their URL share a wrapper.  Ids may repeat or be missing; other columns are ignored.
    """
    pages = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    slots = staged(wrappers(pages).select("host", F.to_json("slots").alias("slots")), "slots")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column("slots").to_pylist()
            known = {x: json.loads(x) for x in set(listed)}
            labels: Labels = {}
            found = [main_text(tokens(h, labels), known[x]) for h, x in zip(batch.column("html").to_pylist(), listed, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string())],
                                             ["page_id", "url", "text"])

    return (pages.join(slots, "host").select(F.col("page_id").cast("long"), "url", "html", "slots")
            .mapInArrow(texts, "page_id long, url string, text string"))
