"""Records from stored result pages."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplelake.functions.text import clean_summary, format_key, let, strip
from samplelake.session import materialise

# Tags that never hold content, and tags whose text is not shown.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset(("script", "style", "template"))


@dataclass(frozen=True)
class Selector:
    """A tag, and the class it must carry if one is given."""

    tag: str
    css_class: str | None = None


@dataclass(frozen=True)
class Rules:
    """Where a page keeps its records and a record its parts. ``summary``, ``ids`` and
    ``links`` may be left out; pairs are the dt/dd of the selected lists."""

    record: Selector
    title: Selector
    summary: Selector | None = None
    details: Selector | None = None
    aside: Selector | None = None
    ids: Selector | None = None
    links: Selector | None = None
    base: str = ""
    record_url: str = ""
    accession_key: str = "accession"


# The layout of a result page and the addresses its links are relative to.
RESULT_PAGE = Rules(
    record=Selector("div", "rprt"),
    title=Selector("p", "title"),
    summary=Selector("div", "supp"),
    details=Selector("dl", "details"),
    aside=Selector("div", "aux"),
    ids=Selector("dl", "rprtid"),
    links=Selector("p", "links"),
    base="https://www.ncbi.nlm.nih.gov",
    record_url="https://www.ncbi.nlm.nih.gov/geo/query/acc.cgi?acc=",
)


@dataclass
class _Node:
    tag: str
    classes: tuple[str, ...] = ()
    href: str | None = None
    parts: list = field(default_factory=list)

    def walk(self) -> Iterator[_Node | str]:
        """What is inside, in order; pages may be nested deeper than calls can be."""
        waiting = self.parts[::-1]
        while waiting:
            part = waiting.pop()
            yield part
            if isinstance(part, _Node) and part.tag not in HIDDEN:
                waiting += part.parts[::-1]

    def text(self) -> str:
        return "" if self.tag in HIDDEN else "".join(p for p in self.walk() if isinstance(p, str))

    def find(self, wanted: Selector) -> Iterator[_Node]:
        for part in self.walk():
            if isinstance(part, _Node) and part.tag == wanted.tag:
                if wanted.css_class is None or wanted.css_class in part.classes:
                    yield part

    def first(self, wanted: Selector | None) -> _Node | None:
        return next(self.find(wanted), None) if wanted else None


class _Tree(HTMLParser):
    """Elements of a page; an end tag closes what was left open inside its element."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("")
        self.open = [self.root]
        # Where in ``open`` the elements of a tag are.
        self.places: defaultdict[str, list[int]] = defaultdict(list)

    def _close(self, depth: int) -> None:
        for node in self.open[depth:]:
            self.places[node.tag].pop()
        del self.open[depth:]

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        if tag == "p" and self.open[-1].tag == "p":
            self._close(len(self.open) - 1)
        node = _Node(tag, tuple((values.get("class") or "").split()), values.get("href"))
        self.open[-1].parts.append(node)
        if tag not in VOID:
            self.places[tag].append(len(self.open))
            self.open.append(node)

    def handle_endtag(self, tag):
        if self.places[tag]:
            self._close(self.places[tag][-1])

    def handle_data(self, data):
        self.open[-1].parts.append(data)


def _pairs(nodes: Iterator[_Node]) -> list[tuple[str, str]]:
    found = []
    for node in nodes:
        key, value = node.first(Selector("dt")), node.first(Selector("dd"))
        if key is not None and value is not None:
            found.append((key.text(), value.text()))
    return found


def _record(node: _Node, rules: Rules) -> dict:
    title, summary, aside = node.first(rules.title), node.first(rules.summary), node.first(rules.aside)
    details = _pairs(summary.find(rules.details)) if summary and rules.details else []
    if aside and rules.ids:
        details += _pairs(aside.find(rules.ids))
    holder = (aside or node).first(rules.links) if rules.links else None
    anchors = holder.find(Selector("a")) if holder else ()
    return {
        "title": title.text() if title else None,
        "summary": summary.text() if summary else None,
        "details": [{"k": k, "v": v} for k, v in details],
        "links": [{"k": a.text(), "v": a.href} for a in anchors],
    }


def _records(html: str | None, rules: Rules) -> list[dict]:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return [_record(node, rules) for node in tree.root.find(rules.record)]


_PAIRS = "array<struct<k:string,v:string>>"


def _last_wins(pairs: Column) -> Column:
    """Pairs to a map; of equal keys the last counts."""

    def mapped(all_pairs: Column) -> Column:
        keys = F.array_distinct(F.transform(all_pairs, lambda p: p["k"]))
        return F.map_from_entries(
            F.transform(
                keys,
                lambda k: F.struct(
                    k.alias("k"), F.element_at(F.filter(all_pairs, lambda p: p["k"] == k), -1)["v"].alias("v")
                ),
            )
        )

    return let(pairs, mapped)


def _parsed(pages: DataFrame, html: str, rules: Rules, key: str) -> DataFrame:
    """``key, records, error`` of each page; a page that cannot be read has an error alone."""
    key_type = pages.schema[key].dataType.simpleString()
    raw = f"array<struct<title:string,summary:string,details:{_PAIRS},links:{_PAIRS}>>"

    def read(page: str | None) -> tuple[list[dict] | None, str | None]:
        try:
            return _records(page, rules), None
        except Exception as error:  # the parser has errors of many kinds
            return None, f"{type(error).__name__}: {error}"

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [read(page) for page in batch[html]]
            yield pd.DataFrame({key: batch[key], "records": [f for f, _ in found], "error": [e for _, e in found]})

    return pages.select(key, html).mapInPandas(parse, f"`{key}` {key_type}, records {raw}, error string")


def extract_records(pages: DataFrame, html: str = "html", rules: Rules = RESULT_PAGE, *, key: str = "page_id") -> DataFrame:
    """``key, rec_no, title, summary, details, links, url``, one row per record of a page.

    Pages are read by a small parser inside the tasks of the scan; everything after the raw
    texts is columns. ``details`` and ``links`` are maps with normalised keys; a record without
    an accession has no url. A page that cannot be read gives no record (``read_pages`` tells why).
    """
    return _records_of(_parsed(pages, html, rules, key), rules, key)


def read_pages(pages: DataFrame, html: str = "html", rules: Rules = RESULT_PAGE, *, key: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """The records (``extract_records``) and ``key, stage, message`` of the pages that cannot be read.
    Pages are parsed once."""
    parsed = materialise(_parsed(pages, html, rules, key), "pages")
    bad = parsed.filter("error IS NOT NULL").select(key, F.lit("page").alias("stage"), F.col("error").alias("message"))
    return _records_of(parsed, rules, key), bad


def _records_of(parsed: DataFrame, rules: Rules, key: str) -> DataFrame:
    rows = parsed.select(key, F.posexplode("records").alias("rec_no", "r"))

    def tidy(pair: Column) -> Column:
        name = format_key(strip(F.replace(pair["k"], F.lit(":"), F.lit(""))))
        return F.struct(name.alias("k"), strip(pair["v"]).alias("v"))

    def absolute(pair: Column) -> Column:
        address = F.when(pair["v"].startswith("/"), F.concat(F.lit(rules.base), pair["v"])).otherwise(pair["v"])
        return F.struct(format_key(pair["k"]).alias("k"), address.alias("v"))

    tidied = rows.select(
        key,
        "rec_no",
        strip(F.col("r.title")).alias("title"),
        clean_summary(F.col("r.summary")).alias("summary"),
        _last_wins(F.transform("r.details", tidy)).alias("details"),
        _last_wins(F.transform("r.links", absolute)).alias("links"),
    )
    url = F.concat(F.lit(rules.record_url), F.try_element_at("details", F.lit(rules.accession_key)))
    return tidied.withColumn("url", url if rules.record_url else F.lit(None).cast("string"))
