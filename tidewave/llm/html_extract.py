"""Main text of web pages by wrapper induction (operator 1).

Pages of one host share a template. Each page's tree of blocks is laid on the host's wrapper by simple
tree matching (wrappers.py). What is the same on all pages is template; what varies is a slot. Menus, adverts and
notices vary too, but stand at a fixed place and hold few words beside links: the content is the subtree that holds
most of the slots' letters outside links (Template), and a page's main text is what its own nodes at that place hold,
less what is constant there or made of links, with the headings that lead to it.

Elements, roles and class names decide two things only, and `rules=False` switches both off: pages of hosts with fewer
than WITNESSES different pages, or that lack their host's content node, are read by them alone (by_rules), and within the content
they take out what is named as a comment, advert, share bar or the like. Scripts, styles and forms never count as text.

Wrappers grow in two scans without moving a page: each task merges its pages per host, and partial
wrappers, small trees, are merged by host in groups of 64, of 64 groups and so on. Pages meet their host's wrapper in
a join that AQE splits for hosts with very many pages.

Defined cases: null or empty html gives an empty text; a null URL's pages share the wrapper of the empty host; repeated rows (and ties: copies
of one page under several URLs) each get their text and are one witness; cut-off pages are read as far as they go; very long and very deep
pages are read whole; an empty table gives an empty result; further columns pass through, whatever their names are, but for text and n_chars, which are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .dom import Node, parse
from .url_rules import host_of
from .wrappers import RARE, WITNESSES, W, absorb, aligned, digest, dumps, loads, post_order, pruned, skeleton

#: Hosts whose wrappers a task holds at a time, and partial wrappers that are merged at a time.
HOSTS, PARTS = 2000, 64
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p li blockquote pre td th dd dt figcaption caption article main".split())
HEADING = re.compile(r"h[1-6](\.|$)")
LEAD = re.compile(r"(h[1-6]|p|blockquote)(\.|$)")


class Template:
    """Where a host's pages have their content."""

    def __init__(self, root: W, rules: bool = True):
        self.root, self.rules = root, rules
        self.constant, self.linked, self.lead = set(), set(), set()
        mass: dict[int, int] = {}
        chars: dict[int, tuple[int, int]] = {}
        for w in post_order(root, lambda x: x.kids):
            if w.text is not None and len(w.seen) >= WITNESSES:
                self.constant.add(id(w))
            own = 0 if id(w) in self.constant else w.chars - w.links
            out = w.dress == 2 or rules and w.dress
            mass[id(w)] = 0 if out else own + sum(mass[id(k)] for k in w.kids)
            chars[id(w)] = (w.chars + sum(chars[id(k)][0] for k in w.kids), w.links + sum(chars[id(k)][1] for k in w.kids))
            if 2 * chars[id(w)][1] > chars[id(w)][0] and not HEADING.match(w.key):
                self.linked.add(id(w))
        at = root
        while at.kids:
            best = max(at.kids, key=lambda k: mass[id(k)])
            if 2 * mass[id(best)] <= mass[id(at)] or not best.kids or 10 * best.rows >= best.n:
                break
            for k in at.kids[: at.kids.index(best)]:  # headings and lead paragraphs before the content, alone or in a block of their own
                below = [w for w in post_order(k, lambda x: x.kids) if mass[id(w)] and w.chars]
                if below and all(LEAD.match(w.key) for w in below) and any(HEADING.match(w.key) for w in below):
                    self.lead |= {id(w) for w in below}
            at = best
        self.content = at
        self.found = bool(mass[id(root)])


def _dropped(node: Node, top: set[int]) -> bool:
    """A node within the content that is dress by its name."""
    return node.dead or node.dressed in ("tag", "word") and id(node) not in top


def main_text(page: str | None, template: Template | None = None) -> str:
    """The text at the content's place. Without a template nothing is known of the page, and all its text is main text."""
    if not page:
        return ""
    root, blocks = parse(page)
    inside: dict[int, W | None] = {}  # nodes of the content, with the wrapper's node if it has one
    lead: set[int] = set()
    if template is None:
        inside[id(root)] = None
    else:
        todo = [(template.root, skeleton(root, 0))]
        while todo:
            w, own = todo.pop()
            if w is template.content:
                inside |= {id(n): w for n in own.nodes}
            elif id(w) in template.lead:
                lead |= {id(n) for n in own.nodes}
            elif any(id(n.parent) in inside for n in own.nodes):
                inside |= {id(n): w for n in own.nodes}
            todo += [(p, q) for p, q in aligned(w.kids, own.kids) if p and q]
        if not inside:
            return by_rules(root, blocks) if template.rules else ""
    rules = template is not None and template.rules
    top = _ancestors(n for n in _walk(root) if n.main and not n.dressed) if rules else set()
    verdicts: dict[int, bool] = {}
    kept = []
    for node, text in blocks:
        path, at = [], node
        while at is not None and id(at) not in verdicts:
            path.append(at)
            at = at.parent
        for n in reversed(path):
            up = n.parent is not None and verdicts[id(n.parent)]
            w = inside.get(id(n))
            if id(n) in lead:
                good = True
            elif w is not None and w is template.content:
                good = not n.dead
            else:
                good = up or template is None and n is root
                if good:
                    boiler = w is not None and (id(w) in template.linked or id(w) in template.constant and not w.kids and n.tag not in PROSE)
                    good = not n.dead and not boiler and not (rules and _dropped(n, top))
            verdicts[id(n)] = good
        w = inside.get(id(node))
        constant = w is not None and w is not template.content and id(w) in template.constant and node.tag not in PROSE
        if verdicts[id(node)] and not constant:
            kept.append(text)
    return "\n\n".join(kept)


def by_rules(root: Node, blocks: list[tuple[Node, str]]) -> str:
    """The text by elements, roles and class names: that of the article or main element if there is one, without what is named as dress."""
    holds_main = _ancestors(n for n in _walk(root) if n.main and not n.dressed)
    verdicts: dict[int, tuple[bool, bool]] = {id(root): (False, False)}  # dress, inside a main element

    def verdict(node: Node) -> tuple[bool, bool]:
        path = []
        while id(node) not in verdicts:
            path.append(node)
            node = node.parent
        for n in reversed(path):
            dress, inside = verdicts[id(n.parent)]
            own = n.dressed == "tag" or n.dressed == "word" and id(n) not in holds_main or n.dressed == "header" and not inside and id(n) not in holds_main
            verdicts[id(n)] = (dress or own, inside or n.main and not own)
        return verdicts[id(path[0] if path else node)]

    has_main = any(verdict(n) == (False, True) for n, _ in blocks)
    return "\n\n".join(text for node, text in blocks if not verdict(node)[0] and (verdict(node)[1] or not has_main))


def _ancestors(nodes) -> set[int]:
    out: set[int] = set()
    for n in nodes:
        up = n.parent
        while up is not None and id(up) not in out:
            out.add(id(up))
            up = up.parent
    return out


def _walk(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        n = todo.pop()
        yield n
        todo += n.children


def induce(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, wrapper: one row per host."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: dict[str, W] = {}

        def out() -> pd.DataFrame:
            return pd.DataFrame([(h, part, dumps(w)) for h, w in held.items()], columns=["host", "part", "wrapper"])

        for pdf in batches:
            for host, page in zip(pdf["host"], pdf["html"], strict=True):
                if page:
                    w = skeleton(parse(page)[0], digest(page))
                    if host in held:
                        w = absorb(held[host], w)
                        if w.n % RARE == 0:
                            pruned(w)
                    for k in post_order(w, lambda x: x.kids):
                        k.nodes = []
                    held[host] = w
                if len(held) >= HOSTS:
                    yield out()
                    held.clear()
        yield out()

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        w = None
        for s in sorted(pdf["wrapper"]):
            w = loads(s) if w is None else absorb(w, loads(s))
        return pd.DataFrame([(pdf["host"].iloc[0], pdf["part"].iloc[0], dumps(pruned(w)))], columns=["host", "part", "wrapper"])

    schema = "host string, part int, wrapper string"
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    parts, n = rows.mapInPandas(partial, schema), rows.rdd.getNumPartitions()
    while True:  # wrappers of a host meet in groups of PARTS
        parts, n = parts.withColumn("part", F.expr(f"part div {PARTS}").cast("int")).groupBy("host", "part").applyInPandas(whole, schema), -(-n // PARTS)
        if n <= 1:
            return parts.select("host", "wrapper")


def _witnessed(w: W) -> bool:
    return len(w.seen) >= WITNESSES


def extract_main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", rules: bool = True) -> DataFrame:
    """pages with text (the main text) and n_chars (its code points)."""
    wrappers = cut(induce(pages, url_col, html_col), "wrappers").toDF("_host", "_wrapper")
    names = [c for c in pages.columns if c not in ("text", "n_chars")]
    plain = pages.select(F.struct(*names).alias("_row"), F.col(html_col).alias("_html"), host_of(F.col(url_col)).alias("_key"))  # clear of the names used here
    joined = plain.join(wrappers, F.col("_key") == F.col("_host"), "left")

    @F.pandas_udf("string")
    def text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[str, Template | None] = {}
        for pages_, ws in batches:
            rows = []
            for page, s in zip(pages_, ws, strict=True):
                if s is not None and s not in known:
                    if len(known) >= HOSTS:
                        known.clear()
                    w = loads(s)
                    known[s] = Template(w, rules) if _witnessed(w) else None
                template = known.get(s)
                if template is None or not template.found:
                    rows.append(by_rules(*parse(page)) if page and rules else main_text(page))
                else:
                    rows.append(main_text(page, template))
            yield pd.Series(rows, dtype="object")

    out = joined.select("_row", text("_html", "_wrapper").alias("_text"))
    return out.select(*[F.col("_row")[c].alias(c) for c in names], F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))
