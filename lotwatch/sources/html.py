"""Elements of landed HTML pages as rows: one for each card, with the texts and attributes that are asked for."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from lotwatch.operators.files import ship

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


@dataclass
class Node:
    tag: str
    attrs: dict[str, str]
    parent: Node | None = None
    children: list[Node | str] = field(default_factory=list)

    def below(self) -> Iterator[Node]:
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def text(self) -> str:
        """All text below, pieces stripped and joined by a space."""
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n.strip())
            elif n.tag not in ("script", "style"):
                stack += reversed(n.children)
        return " ".join(x for x in out if x)

    def fits(self, part: str) -> bool:
        tag, *classes = part.split(".")
        return tag in ("", self.tag) and set(classes) <= set(self.attrs.get("class", "").split())


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:  # an end without a start is passed over
            self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def found(node: Node, selector: str) -> list[Node]:
    """Elements below node, by parts (tag.class) that stand within each other; '>' before a part asks for a child."""
    nodes, direct = [node], False
    for part in selector.split():
        if part == ">":
            direct = True
            continue
        seen: dict[int, Node] = {}
        for n in nodes:
            for x in n.children if direct else n.below():
                if isinstance(x, Node) and x.fits(part):
                    seen.setdefault(id(x), x)
        nodes, direct = list(seen.values()), False
    return nodes


def value(card: Node, spec: str) -> str | None:
    """What a spec names: [^tags ]selector[@attribute[~pattern]] or selector* for all texts joined.

    '^li|div ' starts from the nearest element around the card of one of these
    tags (else the card); '.' alone is the card itself; with a pattern the first
    attribute that it matches counts.
    """
    spec, _, pattern = spec.partition("~")
    selector, _, attribute = spec.partition("@")
    start = card
    if selector.startswith("^"):
        tags, _, selector = selector[1:].partition(" ")
        up = card.parent
        while up is not None and up.tag not in tags.split("|"):
            up = up.parent
        start = up or card
    every = selector.endswith("*")
    nodes = [start] if selector in ("", ".") else found(start, selector.rstrip("*"))
    if attribute:
        values = (n.attrs.get(a) for n in nodes for a in attribute.split("|"))
        return next((v for v in values if v and (not pattern or re.search(pattern, v))), None)
    if every:
        return " ".join(n.text() for n in nodes)
    return nodes[0].text() if nodes else None


def tree_of(body: str | None) -> Node:
    """The root of a page's elements; a null page has none."""
    tree = _Tree()
    tree.feed(body or "")
    tree.close()
    return tree.root


def elements(payloads: DataFrame, card: str, fields: dict[str, str], need: str | None = None, keep: tuple[str, ...] = ("url", "turn", "kind")) -> DataFrame:
    """keep, pos and a string for each field of every element that `card` names in payloads(keep, body).

    need: a selector that a page must hold, else the job fails: a page without
    it was moved or blocked, which isn't the same as an empty one.
    """
    ship(payloads.sparkSession)
    kept = [c for c in keep if c in payloads.columns]
    kinds = {f.name: f.dataType.simpleString() for f in payloads.schema.fields}
    columns = [*kept, "pos", *fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for *key, body in zip(*[pdf[c] for c in kept], pdf["body"], strict=True):
                root = tree_of(body)
                if need and not any(found(root, n) for n in need.split(",")):
                    raise ValueError(f"no {need} in the page (moved or blocked?)")
                out += [(*key, i, *[value(n, s) for s in fields.values()]) for i, n in enumerate(found(root, card))]
            yield pd.DataFrame(out, columns=columns)

    return payloads.select(*kept, "body").mapInPandas(run, ", ".join([*[f"{c} {kinds[c]}" for c in kept], "pos int", *[f"{c} string" for c in fields]]))
