"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page is a stream of tags and texts, read leniently into nested lists. A wrapper is such a nest whose parts may be optional (``?``), repeated
(``+``, also groups of several neighbours) and whose texts are either constants or open slots. It is inferred by alignment:
neighbours of equal signature (tag with its class and id) fold into a repetition, the children of two streams are aligned along their longest
common sequence of signatures, what has no partner becomes optional, and texts that differ become a slot. A host may have several templates:
pages with an article that holds text are one, the others are told apart by the path to their heaviest node. Every page is
aligned into the wrapper of its host and template: first within a partition, then the partitions' wrappers with each other, salted. So what
is shuffled are wrappers, a few for each host and partition, never the pages of a host.

A wrapper decides once which of its slots are main text: those inside articles, else those below the node that holds most
of the text outside of links and constants. Left out are parts whose tag, or a whole word of whose class, id or role, names a menu, header, footer,
sidebar, notice, advert, form or comments, and parts that name one in a piece of a compound word if their text is the same on several
pages or mostly links; never the page, its body, main or an article for their names. Each page is then read along the wrapper of its template;
a page that this leaves empty is read along its own.

Cases: a null html counts as empty, an empty text has 0 characters. Pages without a host share the wrappers of one. Rows come back one for one. Elements
nested deeper than ``DEEPEST`` hang at that depth; their text is kept. Character references are decoded; ``<br>`` is white space. Unclosed
tags end where HTML ends them, an unclosed comment, script or style at the end of the page. An empty table gives an empty result. Further columns
are not read.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwarden.llm.common import staged
from listwarden.llm.url_filter import host

DEEPEST = 150
HOSTS = 4096
SALTS = 64

_ATTRIBUTES = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style)\b{_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-z][^\s/>]*)({_ATTRIBUTES})>|([^<]+|<)", re.I | re.S
)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: An opening tag ends an open element of these names, up to the nearest of the limits.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr"}),
    "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
LEFT_OUT = frozenset("head nav header footer aside form button select textarea input noscript iframe object template dialog menu svg canvas audio video".split())
NAMES_LEFT_OUT = frozenset(
    "ad ads advert advertisement sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside rail widget footer header masthead "
    "cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup login search share sharing social related recommended comment comments "
    "discussion replies reply disqus toolbar pagination pager skip".split()
)
ARTICLES = frozenset(("article", "main"))
#: Blocks of text: the heaviest node is looked for above them.
ONE_BLOCK = frozenset(("p", "li", "td", "th", "h1", "h2", "h3", "pre", "blockquote"))
NEVER_LEFT_OUT = ARTICLES | {"html", "body"}


class Part:
    """A part of a wrapper: an element, a group or a text (``#``), with its children."""

    __slots__ = ("chars", "constant", "kids", "links", "many", "maybe", "sign")

    def __init__(self, sign: str, kids=(), constant=None, chars: int = 0, links: int = 0, maybe: bool = False, many: bool = False):
        self.sign, self.kids, self.constant, self.chars, self.links, self.maybe, self.many = sign, list(kids), constant, chars, links, maybe, many

    def told(self) -> list:
        return [self.sign, [k.told() for k in self.kids], self.constant, self.chars, self.links, self.maybe, self.many]

    @staticmethod
    def read(told: list) -> Part:
        return Part(told[0], [Part.read(k) for k in told[1]], *told[2:])


def signature(name: str, attributes: str) -> str:
    """Tag with the words of its class, id and role, digits as 0."""
    if "=" not in attributes or not any(x in attributes.lower() for x in ("class", "id", "role")):
        return name
    found = [v for _, *vs in NAMED.findall(attributes) for v in vs if v]
    return ".".join([name, *sorted({re.sub(r"\d+", "0", w.lower()) for v in found for w in v.split()})])


def parse(html: str) -> list:
    """[signature, children] of a page; a child is such a list or a text."""
    root: list = ["", []]
    names, nodes = [""], [root]
    for _, slash, name, attributes, text in TOKEN.findall(html):
        if text:
            nodes[-1][1].append(text)
            continue
        if not name:
            continue
        name = name.lower()
        if slash:
            for k in range(len(names) - 1, 0, -1):
                if names[k] == name:
                    del names[k:], nodes[k:]
                    break
                if name not in BLOCK and names[k] in BLOCK:
                    break
            continue
        closing, limits = ENDS.get(name, ((), ()))
        if name in BLOCK and name not in ENDS:
            closing, limits = ("p",), BLOCK
        for k in range(len(names) - 1, 0, -1):
            if names[k] in closing:
                del names[k:], nodes[k:]
                break
            if names[k] in limits:
                break
        node = [signature(name, attributes), []]
        nodes[-1][1].append(node)
        if name not in VOID and len(nodes) < DEEPEST:
            names.append(name)
            nodes.append(node)
    return root


def wrapper(node: list, linked: bool = False) -> Part:
    """The wrapper of one page or part of it."""
    linked = linked or node[0].split(".")[0] == "a"
    kids: list[Part] = []
    for kid in node[1]:
        if isinstance(kid, list):
            if kids and kids[-1].sign == kid[0]:
                kids[-1] = absorbed(kids[-1], kid, linked)
                kids[-1].many = True
            else:
                kids.append(wrapper(kid, linked))
        elif text := kid.strip():
            kids.append(Part("#", constant=text if len(text) <= 100 else None, chars=len(text), links=len(text) * linked))
    return Part(node[0], folded(kids))


def absorbed(part: Part, node: list, linked: bool) -> Part:
    """``merged(part, wrapper(node))``, in place where the node fits the part already."""
    below = linked or node[0].split(".")[0] == "a"
    kids = [k for k in node[1] if isinstance(k, list) or k.strip()]
    signs = [k[0] if isinstance(k, list) else "#" for k in kids]
    fits = [p for p in part.kids if p.sign in signs]
    if [p.sign for p in fits] != signs or not all(p.maybe for p in part.kids if p.sign not in signs):
        return merged(part, wrapper(node, linked))
    for own, kid in zip(fits, kids):
        if isinstance(kid, list):
            part.kids[part.kids.index(own)] = absorbed(own, kid, below)
        else:
            text = kid.strip()
            own.constant = own.constant if own.constant == text else None
            own.chars, own.links = own.chars + len(text), own.links + len(text) * below
    return part


def folded(parts: list[Part]) -> list[Part]:
    """Neighbours that repeat, alone or as groups of up to four, as one repetition."""
    out: list[Part] = []
    for part in parts:
        if out and out[-1].sign == part.sign:
            out[-1] = merged(out[-1], part)
            out[-1].many = True
        else:
            out.append(part)
    for width in (2, 3, 4):
        k = 0
        while k + 2 * width <= len(out):
            period = [p.sign for p in out[k : k + width]]
            stop = k + width
            while [p.sign for p in out[stop : stop + width]] == period:
                stop += width
            if stop > k + width:
                kids = out[k : k + width]
                for start in range(k + width, stop, width):
                    kids = [merged(a, b) for a, b in zip(kids, out[start : start + width])]
                out[k:stop] = [Part(f"({' '.join(period)})", kids, many=True)]
            k += 1
    return out


def merged(a: Part, b: Part) -> Part:
    """What covers both parts of one signature."""
    constant = a.constant if a.constant == b.constant else None
    return Part(a.sign, aligned(a.kids, b.kids), constant, a.chars + b.chars, a.links + b.links, a.maybe or b.maybe, a.many or b.many)


def aligned(a: list[Part], b: list[Part]) -> list[Part]:
    """Two sequences of children along their longest common sequence of signatures; the others become optional."""
    if [p.sign for p in a] == [p.sign for p in b]:
        return [merged(x, y) for x, y in zip(a, b)]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i].sign == b[j].sign else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i].sign == b[j].sign and best[i][j] == best[i + 1][j + 1] + 1:
            out.append(merged(a[i], b[j]))
            i, j = i + 1, j + 1
        else:
            from_a = j == len(b) or i < len(a) and best[i + 1][j] >= best[i][j + 1]
            part = a[i] if from_a else b[j]
            part.maybe = True
            out.append(part)
            i, j = i + from_a, j + (not from_a)
    return folded(out)


def named_out(sign: str) -> bool:
    name, *words = sign.split(".")
    return name in LEFT_OUT or name not in NEVER_LEFT_OUT and any(w in NAMES_LEFT_OUT for w in words)


def left_out(part: Part) -> bool:
    name, *words = part.sign.split(".")
    if named_out(part.sign) or name in NEVER_LEFT_OUT:
        return named_out(part.sign)
    if not any(w in NAMES_LEFT_OUT for word in words for w in re.split(r"[^a-z]+", word)):
        return False
    texts = [part]
    for p in texts:
        texts.extend(p.kids)
    chars = sum(p.chars for p in texts)
    same = sum(p.chars for p in texts if p.constant is not None and p.chars > len(p.constant))
    return max(same, sum(p.links for p in texts)) > 0.5 * chars


def template(page: list) -> str:
    """What tells the templates of a host apart: "article", or the path to the node that holds most of the text outside of links."""
    weights: dict[int, int] = {}

    def weigh(node: list) -> tuple[int, bool]:
        """Text outside of links, and whether an article holds some."""
        total, article = 0, False
        for kid in node[1]:
            if isinstance(kid, str):
                total += len(kid.strip())
            elif not named_out(kid[0]) and kid[0].split(".")[0] != "a":
                n, inside = weigh(kid)
                total, article = total + n, article or inside or n > 0 and kid[0].split(".")[0] in ARTICLES
        weights[id(node)] = total
        return total, article

    if weigh(page)[1]:
        return "article"
    path, node = [], page
    while True:
        heavy = [k for k in node[1] if isinstance(k, list) and weights.get(id(k), 0) > 0.7 * weights[id(node)] > 0]
        if not heavy or heavy[0][0].split(".")[0] in ONE_BLOCK:
            return " ".join(path)
        node = heavy[0]
        path.append(node[0])


def slots(root: Part) -> dict:
    """The wrapper's decision: signature -> (main text or not, the same for its children), groups dissolved."""

    def weight(part: Part, constants: bool) -> int:
        if part.sign == "#":
            return 0 if constants and part.constant is not None else part.chars - part.links
        return 0 if left_out(part) else sum(weight(k, constants) for k in part.kids)

    def children(part: Part) -> Iterator[Part]:
        for kid in part.kids:
            if kid.sign.startswith("("):
                yield from children(kid)
            elif kid.sign != "#":
                yield kid

    def has_article(part: Part) -> bool:
        return any(not left_out(k) and (k.sign.split(".")[0] in ARTICLES and weight(k, False) > 0 or has_article(k)) for k in children(part))

    chosen: set[int] = set()
    if not has_article(root):
        several = weight(root, True) > 0
        node = root
        while True:
            heavy = [k for k in children(node) if weight(k, several) > 0.7 * weight(node, several) > 0]
            if not heavy or heavy[0].sign.split(".")[0] in ONE_BLOCK:
                break
            node = heavy[0]
        chosen.add(id(node))

    def decide(part: Part, inside: bool, article: bool) -> tuple[bool, dict]:
        inside = inside or id(part) in chosen
        below: dict = {}
        for kid in children(part):
            name = kid.sign.split(".")[0]
            title = article and name == "header"
            if left_out(kid) and not title:
                continue
            if id(part) in chosen and kid.links > 0.5 * max(1, kid.chars) and name in ("ul", "ol", "div"):
                continue
            said, more = decide(kid, inside or name in ARTICLES, article or name in ARTICLES)
            if kid.sign in below:
                said, more = said or below[kid.sign][0], {**below[kid.sign][1], **more}
            below[kid.sign] = (said, more)
        return inside, below

    return dict([("", decide(root, False, False))])


def main_text(page: list, decided: dict) -> str:
    """Blocks of the page's main text, one a line."""
    blocks: list[str] = []
    held: list[str] = []

    def end() -> None:
        if text := " ".join(entities.unescape("".join(held)).split()):
            blocks.append(text)
        held.clear()

    def read(node: list, inside: bool, below: dict) -> None:
        for kid in node[1]:
            if isinstance(kid, str):
                if inside:
                    held.append(kid)
                continue
            name = kid[0].split(".", 1)[0]
            block = name in BLOCK
            if block:
                end()
            if name == "br":
                held.append("\n")
            elif kid[0] in below:
                read(kid, *below[kid[0]])
            if block:
                end()

    read(page, *decided[""])
    end()
    return "\n".join(blocks)


def infer(pages: DataFrame) -> DataFrame:
    """(host, template, wrapper) of every template of every host of ``pages`` (host, html); wrapper is JSON."""

    def of_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        salt, known = TaskContext.get().partitionId() % SALTS, {}

        def told() -> pd.DataFrame:
            names, templates = [n for n, _ in known], [t for _, t in known]
            return pd.DataFrame({"host": names, "template": templates, "salt": salt, "wrapper": [json.dumps(w.told()) for w in known.values()]}, dtype=object)

        for batch in batches:
            for name, page in zip(batch["host"], batch["html"]):
                read = parse(page)
                key, one = (name, template(read)), wrapper(read)
                known[key] = merged(known[key], one) if key in known else one
                if len(known) >= HOSTS:
                    yield told()
                    known.clear()
        yield told()

    def together(frame: pd.DataFrame) -> pd.DataFrame:
        first, *others = (Part.read(json.loads(w)) for w in sorted(frame["wrapper"]))
        for other in others:
            first = merged(first, other)
        keys = {c: [frame[c].iloc[0]] for c in ("host", "template", "salt")}
        return pd.DataFrame({**keys, "wrapper": [json.dumps(first.told())]}, dtype=object)

    schema = "host string, template string, salt int, wrapper string"
    partial = pages.select("host", "html").mapInPandas(of_partition, schema)
    salted = partial.groupBy("host", "template", "salt").applyInPandas(together, schema)
    return staged(salted.groupBy("host", "template").applyInPandas(together, schema).select("host", "template", "wrapper"), "wrappers")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""
    read_pages = pages.select("page_id", "url", host(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    wrappers = infer(read_pages)

    def sorted_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(template=pd.Series([template(parse(page)) for page in batch["html"]], dtype=object, index=batch.index))

    def read_along(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decisions: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for page, told in zip(batch["html"], batch["wrapper"]):
                if told not in decisions:
                    if len(decisions) >= HOSTS:
                        decisions.clear()
                    decisions[told] = slots(Part.read(json.loads(told)))
                read = parse(page)
                texts.append(main_text(read, decisions[told]) or main_text(read, slots(wrapper(read))))
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"].astype(object), "text": pd.Series(texts, dtype=object)})

    # page_id goes as a text: pandas has no null in whole numbers
    sorted_pages = read_pages.withColumn("page_id", F.col("page_id").cast("string")).mapInPandas(sorted_out, "page_id string, url string, host string, html string, template string")
    sorted_pages = sorted_pages.withColumn("page_id", F.col("page_id").cast("long"))
    found = sorted_pages.join(wrappers, ["host", "template"]).select("page_id", "url", "html", "wrapper").mapInPandas(read_along, "page_id long, url string, text string")
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
