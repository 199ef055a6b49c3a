"""Landed web pages: content containers, links and XPath."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Blocks(HTMLParser):
    """Texts of the p and div children of one container; a table of contents is skipped, references end it."""

    def __init__(self, container: str) -> None:
        super().__init__(convert_charrefs=True)
        self.container, self.depth, self.skip, self.over = container, 0, 0, False
        self.blocks: list[list[str]] = []
        self.inside = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID or self.over:
            return
        named = dict(attrs)
        if not self.depth:
            self.depth = int(named.get("id") == self.container or (self.container == "article" and tag == "article"))
            return
        self.depth += 1
        if self.skip:
            self.skip += 1
        elif tag in ("script", "style") or named.get("id") == "toc" or "toc" in (named.get("class") or "").split():
            self.skip = 1
        elif tag == "ol" and "references" in (named.get("class") or "").split():
            self.over = True
        elif self.depth == 2 and tag in ("p", "div"):
            self.inside = True
            self.blocks.append([])

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID or not self.depth or self.over:
            return
        self.depth -= 1
        self.skip = max(0, self.skip - 1)
        if self.depth <= 1:
            self.inside = False
        if not self.depth:
            self.over = True

    def handle_data(self, data: str) -> None:
        if self.inside and not self.skip and not self.over:
            self.blocks[-1].append(data)


def content_of(html: str | None, container: str = "mw-content-text") -> str:
    """Text of the container's blocks, one line each; without such a container that of an article element."""
    for name in (container, "article"):
        parser = _Blocks(name)
        parser.feed(html or "")
        parser.close()
        lines = [" ".join("".join(b).split()) for b in parser.blocks]
        if any(lines):
            return "".join(f"{line}\n" for line in lines if line)
    return ""


def with_content(pages: DataFrame, html: str = "html", container: str = "mw-content-text") -> DataFrame:
    """pages with `content`, '' for pages without a container and null html."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([content_of(x if isinstance(x, str) else None, container) for x in batch], dtype=object)

    return pages.withColumn("content", F.pandas_udf(run, "string")(F.col(html).cast("string")))


def host(url: Column) -> Column:
    """Lower-case host name; null if the URL has none."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def base_href(html: Column) -> Column:
    """href of the base element; null if there is none."""
    return F.nullif(F.regexp_extract(html, r'(?i)<base\s[^>]*href\s*=\s*"([^"]*)"', 1), F.lit(""))


@F.pandas_udf(StringType())
def resolve(base: pd.Series, link: pd.Series) -> pd.Series:
    """Absolute URL of a link on a page; null where either is null or can't be read."""

    def one(b: str | None, u: str | None) -> str | None:
        try:
            return urljoin(b, u) if isinstance(b, str) and isinstance(u, str) else None
        except ValueError:
            return None

    return pd.Series([one(b, u) for b, u in zip(base, link)], dtype=object)


def links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, link): absolute targets of a page's links, distinct."""
    found = pages.select(key, F.coalesce(base_href(F.col(html)), F.col(url)).alias("base"), F.explode(F.regexp_extract_all(F.col(html), F.lit(r'(?i)<a\s[^>]*?href\s*=\s*"([^"]*)"'), F.lit(1))).alias("href"))
    return found.select(key, resolve("base", "href").alias("link")).where("link is not null").distinct()


def xpath_texts(xml: Column, expression: str) -> Column:
    """Texts that an XPath expression selects in well-formed XML."""
    return F.xpath(xml, F.lit(expression))
