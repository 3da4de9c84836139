"""Parsers for SQL: table functions that a query joins to its pages with LATERAL.

page_elements(body, card, fields): pos and a column for each field of every
element that `card` names in an HTML page; fields is a constant JSON object
from names to what they select (see html.value), which sets the columns.

feed_items(body): pos, title, link, published, description and image of every
item of an RSS feed or entry of an Atom feed, read as XML: entities, CDATA and
namespaces are the parser's; HTML's named entities are known too.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lotwatch.operators.files import ship
from lotwatch.sources.html import found, tree_of, value

# The entities that XML itself has.
XML_ENTITIES = {"amp", "lt", "gt", "quot", "apos"}
ENTITY = re.compile(r"<!\[CDATA\[.*?\]\]>|&([A-Za-z][A-Za-z0-9]*);", re.S)


class PageElements:
    @staticmethod
    def analyze(body: AnalyzeArgument, card: AnalyzeArgument, fields: AnalyzeArgument) -> AnalyzeResult:
        if not (card.isConstantExpression and fields.isConstantExpression):
            raise ValueError("page_elements takes a constant card and constant fields")
        schema = StructType().add("pos", IntegerType())
        for name in json.loads(fields.value):
            schema = schema.add(name, StringType())
        return AnalyzeResult(schema)

    def eval(self, body: str | None, card: str, fields: str) -> Iterator[tuple]:
        asked = json.loads(fields).values()
        for i, n in enumerate(found(tree_of(body), card)):
            yield i, *[value(n, s) for s in asked]


def without_namespace(tag: str) -> str:
    return tag.rpartition("}")[2]


class FeedItems:
    def eval(self, body: str | None) -> Iterator[tuple]:
        if not body or not body.strip():
            return
        known = ENTITY.sub(lambda m: m[0] if m[1] is None or m[1] in XML_ENTITIES else html.escape(html.unescape(m[0])), body.strip())
        items = (e for e in ElementTree.fromstring(known).iter() if without_namespace(e.tag) in ("item", "entry"))
        for i, item in enumerate(items):
            held: dict[str, str] = {}
            image = link = None
            for e in item:
                name, text = without_namespace(e.tag), " ".join("".join(e.itertext()).split())
                if name == "link":
                    link = link or text or e.get("href")
                elif name in ("content", "thumbnail", "enclosure") and e.get("url"):
                    image = image or e.get("url")
                else:
                    held.setdefault({"summary": "description", "content": "description", "encoded": "body", "pubDate": "published", "updated": "published"}.get(name, name), text)
            description = held.get("description") or held.get("body")
            page = tree_of(description)
            image = image or value(page, "img@src")
            yield i, held.get("title"), link, held.get("published"), page.text() or None, image


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session's SQL."""
    ship(spark)
    spark.udtf.register("page_elements", udtf(PageElements))
    spark.udtf.register("feed_items", udtf(FeedItems, returnType="pos int, title string, link string, published string, description string, image string"))
