"""HTML extraction by consensus of host paths.

The containers of a page are scored by the text they hold themselves, outside links.  Every
page votes for the generalised tag-class path of its best container; per host the path
with most votes wins, and all pages of the host are extracted anew along it.

A page is parsed once, in time linear in its length however broken it is: the first pass
stores its text and the spans of its containers, from which the second one cuts.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .shared import small, written

CONTAINERS = frozenset("html body main article section div td th table tr tbody nav aside footer header ul ol form center dl figure fieldset".split())
SILENT = frozenset("script style noscript template head title svg math iframe object select textarea".split())
BREAKS = CONTAINERS | frozenset("p br li h1 h2 h3 h4 h5 h6 pre blockquote dt dd hr tr".split())
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_CLASS = re.compile(r"""(?:^|\s)class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in SILENT}
_DIGITS = re.compile(r"\d+")
_BLANKS = re.compile(r"[ \t\r\f\v ]+")


class Container(NamedTuple):
    path: str
    score: int
    text: str


def step_name(tag: str, attributes: str) -> str:
    """Tag with its sorted classes; digits in class names become #, so that counters don't tell paths apart."""
    found = _CLASS.search(attributes) if "class" in attributes.lower() else None
    if not found:
        return tag
    names = sorted({_DIGITS.sub("#", c.lower()) for c in (found.group(1) or found.group(2) or found.group(3) or "").split()})
    return ".".join([tag, *names])


def tidy(raw: str) -> str:
    lines = (_BLANKS.sub(" ", line).strip() for line in entities.unescape(raw).split("\n"))
    return "\n".join(line for line in lines if line)


def path_hash(path: str) -> int:
    """The hash that a container on this path has."""
    out = 0
    for step in path.split(">")[1:]:
        out = _next_hash(out, step) if step else out
    return _signed(out)


def _next_hash(parent: int, step: str) -> int:
    return xxhash.xxh3_64_intdigest(step, seed=parent)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


class Markup:
    """Finds tags in a page; what was looked for in vain once isn't looked for again, so a page is read once."""

    def __init__(self, page: str) -> None:
        self.page, self.absent = page, set()

    def find(self, what: str, at: int) -> int:
        if what in self.absent:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.absent.add(what)
        return found

    def close(self, tag: str, at: int) -> int:
        """End of the closing tag of a silent element; -1 if there is none."""
        if tag in self.absent:
            return -1
        found = _CLOSE[tag].search(self.page, at)
        if not found:
            self.absent.add(tag)
            return -1
        return found.end()

    def tag_end(self, at: int) -> int:
        """Place of the > that ends a tag, outside quoted values; -1 if there is none.  A quote that never ends is no quote."""
        while True:
            if ">" in self.absent:
                return -1
            m = _STOP.search(self.page, at)
            if not m:
                self.absent |= {">", '"', "'"}
                return -1
            if m.group() == ">":
                return m.start()
            end = self.find(m.group(), m.end())
            if end < 0:
                return self.find(">", m.end())
            at = end + 1

    def __iter__(self) -> Iterator[tuple[str, bool, str, str]]:
        """(text before, end tag?, tag name or '', attributes); the last one has text only.  skip_to() moves on."""
        page, self.at, start = self.page, 0, 0
        while True:
            lt = page.find("<", self.at)
            if lt < 0:
                break
            following = page[lt + 1 : lt + 2]
            if following in ("!", "?"):
                if page.startswith("<!--", lt):
                    end = self.find("-->", lt + 4)
                    end = len(page) if end < 0 else end + 3
                else:
                    end = self.find(">", lt + 1) + 1
                if not end:  # never closed: text
                    self.at = lt + 1
                    continue
                text, self.at = page[start:lt], end
                yield text, False, "", ""
            else:
                name = _NAME.match(page, lt + 1)
                end = self.tag_end(name.end()) if name else -1
                if end < 0:
                    self.at = lt + 1
                    continue
                text, self.at = page[start:lt], end + 1
                yield text, following == "/", name.group(1).lower(), page[name.end() : end]
            start = self.at
        yield page[start:], False, "", ""


class Page:
    """A parsed page: its raw text, and for each container, in document order, path, score and span of text.

    score: characters of text directly in the container (not in one within it) outside
    links, less those inside links.  Paths are kept as nodes with a parent, and as hashes.
    Unclosed elements end with their parent; stray end tags are passed over.
    """

    def __init__(self, page: str) -> None:
        parents, steps, hashes = [-1], [""], [0]
        nodes: dict[tuple[int, str], int] = {}
        done: list[tuple[int, int, int, int, int]] = []
        stack: list[list] = [["", 0, 0, 0, 0]]  # tag, node, score, order, start of text
        opened: dict[str, int] = {}
        out: list[str] = []
        size, order, link = 0, 0, False
        markup = Markup(page)
        for text, ending, tag, attributes in markup:
            if text:
                out.append(text.replace("\n", " "))
                size += len(text)
                solid = len(text) - text.count(" ")
                stack[-1][2] += -solid if link else solid
            if not tag:
                continue
            if ending:
                if tag == "a":
                    link = False
                elif opened.get(tag):
                    link = False
                    while True:
                        name, node, score, k, start = stack.pop()
                        opened[name] -= 1
                        done.append((k, node, score, start, size))
                        if name == tag:
                            break
            elif tag in SILENT:
                if not attributes.endswith("/"):
                    end = markup.close(tag, markup.at)
                    if end >= 0:
                        markup.at = end
                    elif tag in ("script", "style", "textarea"):
                        break
                continue
            if tag in BREAKS:
                out.append("\n")
                size += 1
            if ending:
                continue
            if tag == "a":
                link = True
            elif tag in CONTAINERS and not attributes.endswith("/"):
                order += 1
                key = (stack[-1][1], step_name(tag, attributes))
                if key not in nodes:
                    nodes[key] = len(parents)
                    parents.append(key[0])
                    steps.append(key[1])
                    hashes.append(_next_hash(hashes[key[0]], key[1]))
                stack.append([tag, nodes[key], 0, order, size])
                opened[tag] = opened.get(tag, 0) + 1
        while len(stack) > 1:
            _, node, score, k, start = stack.pop()
            done.append((k, node, score, start, size))
        if stack[0][2] > 0:  # text outside any container
            done.append((0, 0, stack[0][2], 0, size))
        done.sort()
        self.raw, self.containers = "".join(out), [x[1:] for x in done]
        self._parents, self._steps, self._hashes = parents, steps, hashes

    def path(self, node: int) -> str:
        """Steps from the root on, each after a >; '>' for text outside any container."""
        found = []
        while node:
            found.append(self._steps[node])
            node = self._parents[node]
        return ">" + ">".join(reversed(found))

    def hash_of(self, node: int) -> int:
        return _signed(self._hashes[node])

    def best(self) -> tuple[int, int, int, int] | None:
        """(node, score, start, end) of the container of highest score, the first of equals; None without text."""
        top = max(self.containers, key=lambda c: c[1], default=None)
        return top if top and top[1] > 0 else None


def containers(page: str) -> list[Container]:
    """All containers of a page with their texts."""
    parsed = Page(page)
    return [Container(parsed.path(node), score, tidy(parsed.raw[a:b])) for node, score, a, b in parsed.containers]


def best_path(page: str) -> tuple[str, int] | None:
    parsed = Page(page)
    top = parsed.best()
    return (parsed.path(top[0]), top[1]) if top else None


def cut(raw: str, hashes: list[int], starts: list[int], ends: list[int], winner: int | None) -> str:
    """Texts of all containers on the winning path, which can't lie within one another; '' if there are none."""
    if winner is None:
        return ""
    found = (tidy(raw[a:b]) for h, a, b in zip(hashes, starts, ends) if h == winner)
    return "\n".join(x for x in found if x)


_PARSED_SQL = "host string, path string, score long, path_hash long, best_start int, best_end int, raw string, hashes array<long>, starts array<int>, ends array<int>"
_PARSED = [("host", pa.string()), ("path", pa.string()), ("score", pa.int64()), ("path_hash", pa.int64()), ("best_start", pa.int32()), ("best_end", pa.int32()), ("raw", pa.string()), ("hashes", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tokens.slices(batch, "html"):
            rows = []
            for host, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                parsed = Page(page or "")
                top = parsed.best()
                node, score, a, b = top or (None, None, None, None)
                each = parsed.containers
                # containers of the same path as others count for the vote of other pages: all spans are kept
                rows.append((host, parsed.path(node) if top else None, score, parsed.hash_of(node) if top else None, a, b, parsed.raw, [parsed.hash_of(c[0]) for c in each], [c[2] for c in each], [c[3] for c in each]))
            arrays = [pa.array(list(c), t) for c, (_, t) in zip(zip(*rows), _PARSED)]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), *arrays], ["page_id", *[n for n, _ in _PARSED]])


def parsed_pages(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) parsed; a null or hostless url belongs to the host ''."""
    host = F.coalesce(F.lower(F.try_parse_url(F.col("url").cast("string"), F.lit("HOST"))), F.lit(""))
    rows = pages.select("page_id", host.alias("host"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_parse, f"page_id {dict(pages.dtypes)['page_id']}, {_PARSED_SQL}")


def winners(ballots: DataFrame) -> DataFrame:
    """(host, path, path_hash, votes): most votes, then the higher sum of scores, then the path that sorts first."""
    counted = ballots.groupBy("host", "path", "path_hash").agg(F.count(F.lit(1)).alias("votes"), F.sum("score").alias("score"))
    top = F.min(F.struct((-F.col("votes")).alias("votes"), (-F.col("score")).alias("score"), "path", "path_hash")).alias("top")
    return counted.groupBy("host").agg(top).select("host", "top.path", "top.path_hash", (-F.col("top.votes")).alias("votes"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, consensus, text) of every page of pages (page_id, url, html).

    A page without the winning path is extracted from its own best container (consensus
    false).  Null and empty html, and pages without text, give an empty text and a null
    path.  Of paths with equal votes the one of higher score wins, then the one that sorts
    first; of containers with equal score the first.  Very long pages are parsed whole, in
    linear time.  Repeated pages vote and are extracted each; extra columns are ignored,
    whatever their names; an empty table gives no rows.
    """
    parsed = written(parsed_pages(pages), "parsed")
    chosen = written(winners(parsed.where("path is not null").select("host", "path", "path_hash", "score")), "paths")
    chosen = small(chosen.select("host", F.col("path").alias("winner"), F.col("path_hash").alias("winner_hash")))
    rows = parsed.select("page_id", "host", "path", "best_start", "best_end", "raw", "hashes", "starts", "ends").join(chosen, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, "raw"):
                each = {n: part.column(n).to_pylist() for n in ("path", "best_start", "best_end", "raw", "hashes", "starts", "ends", "winner", "winner_hash")}
                texts, paths, agreed = [], [], []
                for path, a, b, raw, hashes, starts, ends, winner, mark in zip(*each.values()):
                    text = cut(raw, hashes, starts, ends, mark)
                    agreed.append(bool(text))
                    paths.append(winner if text else path)
                    texts.append(text or (tidy(raw[a:b]) if path is not None else ""))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("host"), pa.array(paths, pa.string()), pa.array(agreed, pa.bool_()), pa.array(texts, pa.string())], ["page_id", "host", "path", "consensus", "text"])

    return rows.mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, host string, path string, consensus boolean, text string")
