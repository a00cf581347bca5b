"""Records of an HTML provider: parser, polite client and a Python data source."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Labels of the fields, class and scope of a result, forms of the links.
LABELS = {"rawi": "الراوي", "mohdith": "المحدث", "book": "المصدر", "number_or_page": "الصفحة أو الرقم", "grade": "خلاصة حكم المحدث", "degree": "درجة الحديث", "takhrij": "التخريج"}
BLOCK_CLASS, SCOPE_ID = "border-bottom", "home"
RECORD_ID = re.compile(r"/h/([A-Za-z0-9]+)")
LEADING_NUMBER = re.compile(r"^\s*\d*\s*-\s*:?\s*")
RECORD = (
    "struct<text: string, rawi: string, mohdith: string, book: string, number_or_page: string, grade: string, takhrij: string, "
    "hadith_id: string, has_alternate: boolean, has_similar: boolean>"
)
VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "source", "area", "base", "col", "embed"}


class _Tree(HTMLParser):
    """A plain tree: each node is [tag, attributes, children]; texts are strings."""

    def __init__(self) -> None:
        super().__init__()
        self.root: list = ["", {}, []]
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs), []]
        self.open[-1][2].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][0] == tag:
                del self.open[at:]
                return

    def handle_data(self, data):
        self.open[-1][2].append(data)


def _nodes(node: list) -> Iterator[list]:
    todo = list(reversed([c for c in node[2] if isinstance(c, list)]))
    while todo:
        n = todo.pop()
        yield n
        todo += reversed([c for c in n[2] if isinstance(c, list)])


def _text(node: list) -> str:
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        else:
            todo += reversed(n[2])
    return " ".join(" ".join(out).split())


def _record(block: list) -> dict | None:
    nodes = list(_nodes(block))
    head = next((n for n in nodes if n[0] in ("h5", "article")), None)
    text = re.sub(r"\s+([،,.:؛])", r"\1", LEADING_NUMBER.sub("", _text(head))) if head else ""
    if not text:
        return None
    got: dict[str, str] = {}
    for strong in (n for n in nodes if n[0] == "strong"):
        span = next((n for n in _nodes(strong) if n[0] == "span"), None)
        label = " ".join(_text(strong).split(":")[0].replace("|", "").split())
        for field, wanted in LABELS.items():
            if span is not None and label == wanted:
                got.setdefault(field, _text(span))
    links = [n[1].get("href") or "" for n in nodes if n[0] == "a"]
    ids = [m[1] for x in links if (m := RECORD_ID.search(x))] or [n[1]["tag"] for n in nodes if n[0] == "a" and n[1].get("tag")]
    return {
        "text": text, **{f: got.get(f, "") for f in ("rawi", "mohdith", "book", "number_or_page")}, "grade": got.get("grade") or got.get("degree", ""),
        "takhrij": got.get("takhrij", ""), "hadith_id": ids[0] if ids else None,
        "has_alternate": any(x.endswith("?alts=1") for x in links), "has_similar": any(x.endswith("?sims=1") for x in links),
    }


def parse(page: str | None, whole: bool = False) -> list[dict]:
    """Records of the result blocks within the scope element; of the whole page where there is none or if asked."""
    tree = _Tree()
    tree.feed(page or "")
    tree.close()
    scope = tree.root if whole else next((n for n in _nodes(tree.root) if n[1].get("id") == SCOPE_ID), tree.root)
    blocks = (n for n in _nodes(scope) if BLOCK_CLASS in (n[1].get("class") or "").split())
    return [r for b in blocks if (r := _record(b))]


def records(html: Column) -> Column:
    """Array of records of each page, parsed in Arrow batches."""

    @F.pandas_udf(f"array<{RECORD}>")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(parse)

    return run(html)


class FetchError(Exception):
    def __init__(self, status: int | None, message: str = ""):
        super().__init__(message or str(status))
        self.status = status


class Client:
    """Fetches pages no faster than one each ``interval`` seconds, with two retries for 429, 5xx and network errors;
    other errors fail at once. ``fetch`` is given a URL; without one the client is offline."""

    def __init__(self, base: str, fetch: Callable[[str], str] | None = None, interval: float = 1.2, sleep=time.sleep, clock=time.monotonic):
        self.base, self.fetch, self.interval, self.sleep, self.clock, self.last = base.rstrip("/"), fetch, interval, sleep, clock, float("-inf")

    def get(self, url: str) -> str:
        if self.fetch is None:
            raise FetchError(None, "offline")
        for attempt in range(3):
            wait = self.last + self.interval - self.clock()
            if wait > 0:
                self.sleep(wait)
            self.last = self.clock()
            try:
                return self.fetch(url)
            except FetchError as e:
                again = e.status is None or e.status == 429 or e.status >= 500
                if not again or attempt == 2:
                    raise
        raise AssertionError

    def search(self, text: str) -> list[dict]:
        return parse(self.get(f"{self.base}/hadith/search?q={quote(' '.join(text.split())[:200])}"))

    def alternate(self, record_id: str) -> dict | None:
        found = parse(self.get(f"{self.base}/h/{record_id}?alts=1"), whole=True)
        return found[1] if len(found) > 1 else None

    def similar(self, record_id: str) -> list[dict]:
        return parse(self.get(f"{self.base}/h/{record_id}?sims=1"), whole=True)


class ProviderSource(DataSource):
    """spark.read.format("provider") with options ``queries`` (JSON array of texts), ``base`` and ``fetcher``
    (module:function, called on the executors): query and its records. One partition keeps the provider's pace."""

    @classmethod
    def name(cls) -> str:
        return "provider"

    def schema(self) -> str:
        return f"query string, records array<{RECORD}>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.queries, self.base, self.fetcher = json.loads(options.get("queries", "[]")), options.get("base", ""), options.get("fetcher")

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        import importlib

        module, _, function = self.fetcher.partition(":")
        client = Client(self.base, getattr(importlib.import_module(module), function), interval=0 if self.base.startswith("test") else 1.2)
        for q in self.queries:
            yield q, [tuple(r.values()) for r in client.search(q)]
