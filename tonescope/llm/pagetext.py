"""HTML extraction: block roles from the markup, and a suffix array per host for the blocks that markup leaves open.

A page is read as blocks of text. The markup gives most blocks a role: `main` inside article or main elements, `drop` inside
menus, headers (outside main), footers, sidebars, notices, adverts, forms, dialogs and reader comments, known by element,
role, class or id. Other blocks are `open`. The token streams of all open and dropped blocks of a host are concatenated;
suffixes, cut at RUN tokens, are ordered by host and name, and those that stand on two distinct pages, or in a dropped
block, cover boilerplate. The text of a page is its main blocks and, on a page without any, the runs of its open blocks that
are not covered.

The suffix array alone can't give right results: articles share passages and whole copies across pages of a host, and
menus, adverts and footers may be of one page only. So repetition never removes main blocks.

Null html counts as empty and gives an empty text. Null or odd urls belong to the host ''. Rows repeated whole, with one
page_id, are one page and get equal results. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonescope.llm.common import only, settle
from tonescope.llm.urlfilter import url_parts

#: Tokens of a suffix that count; a shorter block counts as a whole.
RUN = 12

_QUOTED = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""
#: Comments, elements whose content is no text, and other tags.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|title|noscript|template|svg|iframe|textarea|select|object|canvas|audio|video)\b"
    + _QUOTED + r"(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>" + _QUOTED + r")>"
    r"|<[!?][^>]*>", re.S | re.I)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORDS = re.compile(r"[a-z]+")

DROPPED = frozenset("nav footer aside form button dialog menu head label fieldset".split())
MAIN = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table
tbody td tfoot th thead tr ul""".split())
#: Words of a class or id that tell what is no article text.
MARKS = frozenset("""ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav
navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent gdpr notice alert popup
modal overlay newsletter subscribe signup login comment comments commentlist disqus reply replies share sharing social
related recommended recommendations widget pagination pager toolbar skip""".split())
HEAD_MARKS = frozenset("header topbar".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())


def _role(name: str, attrs: str, in_main: bool) -> bool:
    """Whether an element and all in it is dropped."""
    if name in DROPPED or name == "header" and not in_main:
        return True
    if not attrs.strip():
        return False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in ROLES:
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if key in ("class", "id") and name not in ("body", "html"):
            words = set(_WORDS.findall(value))
            if words & MARKS or words & HEAD_MARKS and not in_main:
                return True
    return False


def blocks(page: str) -> list[tuple[str, str]]:
    """(role, text) of the non-empty blocks in page order."""
    out: list[tuple[str, str]] = []
    open_: list[tuple[str, bool, bool]] = []  # name, dropped, main: with all that is around
    pending: list[str] = []

    def flush() -> None:
        text = " ".join("".join(pending).split())
        pending.clear()
        if text:
            _, dropped, main = open_[-1] if open_ else ("", False, False)
            out.append(("drop" if dropped else "main" if main else "open", text))

    at = 0
    for m in _TAG.finditer(page):
        if m.start() > at:
            pending.append(entities.unescape(page[at:m.start()]))
        at = m.end()
        if not m["name"]:
            if m["raw"]:
                pending.append(" ")
            continue
        name = m["name"].lower()
        if name in BLOCKS:
            flush()
        if m["end"]:
            at_open = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == name), None)
            if at_open is not None:
                around = open_[at_open - 1] if at_open else ("", False, False)
                if around[1:] != open_[-1][1:]:  # what follows has another role
                    flush()
                del open_[at_open:]
            continue
        if name in BLOCKS and name != "br":
            # A paragraph or item ends where the next block begins.
            ends = {"p"} | ({name} if name in ("li", "dt", "dd", "tr", "td", "th", "option") else set())
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] in ends:
                    del open_[i:]
                    break
                if open_[i][0] in BLOCKS:
                    break
        if name in VOID or m["attrs"].endswith("/"):
            continue
        _, dropped, main = open_[-1] if open_ else ("", False, False)
        gone = dropped or _role(name, m["attrs"], main)
        if gone and not dropped:
            flush()
        open_.append((name, gone, main or name in MAIN))
    if at < len(page):
        pending.append(entities.unescape(page[at:]))
    flush()
    return out


def _suffix_names(tokens: list[str], run: int) -> list[int]:
    """Name of the `run` tokens from each place, of all tokens if there are fewer."""
    import xxhash
    n = max(1, len(tokens) - run + 1)
    return [xxhash.xxh3_64_intdigest(" ".join(tokens[i:i + run])) - 2**63 for i in range(n)]


def host_suffixes(pages: DataFrame, run: int = RUN) -> DataFrame:
    """host, name, page_id, place (block * 2^32 + token), dropped: a row per suffix of the blocks outside main."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, host, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for i, (role, block) in enumerate(blocks(text or "")):
                    if role != "main":
                        rows.extend((host, name, page, (i << 32) + k, role == "drop")
                                    for k, name in enumerate(_suffix_names(block.split(), run)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=["host", "name", "page_id", "place", "dropped"])

    hosts = only(pages, "page_id", "url", "html").select("page_id", url_parts(F.col("url"))[0].alias("host"), "html")
    return hosts.mapInArrow(read, "host string, name long, page_id long, place long, dropped boolean")


def covered_places(suffixes: DataFrame) -> DataFrame:
    """page_id, place of suffixes in open blocks that are boilerplate of their host."""
    shared = suffixes.groupBy("host", "name").agg(
        F.min("page_id").alias("low"), F.max("page_id").alias("high"), F.bool_or("dropped").alias("known")
    ).where("known or low < high").select("host", "name")
    return suffixes.where("not dropped").join(shared, ["host", "name"]).select("page_id", "place").distinct()


def main_text(pages: DataFrame, run: int = RUN) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = only(pages, "page_id", "url", "html")

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Pages whose text needs no repetition: those with main blocks, or without open ones.
        for batch in batches:
            texts, need = [], []
            for page in batch.column(2):
                found = blocks(page.as_py() or "")
                main = [t for r, t in found if r == "main"]
                need.append(not main and any(r == "open" for r, _ in found))
                texts.append(" ".join(main))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(need, pa.bool_()),
                 pc_keep(batch.column(2), need)], names=["page_id", "url", "text", "needs", "html"])

    def pc_keep(column: pa.Array, need: list[bool]) -> pa.Array:
        return pa.array([c if k else None for c, k in zip(column.to_pylist(), need)], pa.string()) if any(need) \
            else pa.nulls(len(need), pa.string())

    def uncovered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                places = np.array(gone or [], dtype=np.int64)
                kept = []
                for i, (role, block) in enumerate(blocks(page or "")):
                    if role == "open":
                        tokens = block.split()
                        here = places[places >> 32 == i] & 0xFFFFFFFF
                        covered = {j for p in here.tolist() for j in range(p, p + run)}
                        kept.extend(t for j, t in enumerate(tokens) if j not in covered)
                texts.append(" ".join(kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                                             names=["page_id", "url", "text"])

    read = rows.mapInArrow(settled, "page_id long, url string, text string, needs boolean, html string")
    open_ = settle(read.where("needs").select("page_id", "url", "html"), "open")
    covered = covered_places(settle(host_suffixes(pages, run), "suffixes"))
    marks = covered.groupBy("page_id").agg(F.collect_list("place").alias("places"))
    rest = open_.join(marks, "page_id", "left").mapInArrow(uncovered, "page_id long, url string, text string")
    return (read.where("not needs").select("page_id", "url", "text").unionByName(rest)
            .withColumn("n_chars", F.char_length("text").cast("long")))
