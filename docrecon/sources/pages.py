"""Pages of documents: how many there are, and the text of each from a native layer or, where that is thin, recognition."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecon.settings import DEFAULTS, Settings
from docrecon.sources.text import Provider, contents
from docrecon.sources.tree import explode_pages
from docrecon.streaming.control import Gate

Counter = Callable[[bytes], int | None]


def count_pages(content: bytes) -> int | None:
    """Pages by the page tree of a PDF whose objects aren't packed; None where that can't be told.

    The root of the tree has the greatest count. Register a counter of your own for files with packed objects.
    """
    if not content.lstrip()[:5] == b"%PDF-":
        return None
    trees = [int(n) for body in re.findall(rb"<<(?:[^<>]|<<[^<>]*>>|<[^<>]*>)*>>", content) if re.search(rb"/Type\s*/Pages\b", body) for n in re.findall(rb"/Count\s+(\d+)", body)]
    single = len(re.findall(rb"/Type\s*/Page\b(?!s)", content))
    return max(trees, default=0) or single or None


def with_pages(files: DataFrame, counter: Counter = count_pages, gate: Gate | None = None) -> DataFrame:
    """Add ``pages``, null where the counter can't tell or fails, of the column ``content`` or else of the file at the path."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for content in contents(batch, gate):
                try:
                    found.append(counter(content()))
                except Exception:  # an unreadable file stays one document, and extraction will tell why
                    found.append(None)
            yield batch.assign(pages=pd.array(found, dtype="Int32"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.mapInPandas(count, schema + ", pages int")


def walk_pages(files: DataFrame, settings: Settings = DEFAULTS, counter: Counter = count_pages, gate: Gate | None = None) -> DataFrame:
    """Files with a row for each page of those that have several, or files as they are if the settings say so."""
    if not settings.explode_pages:
        return files.withColumn("page_index", F.lit(None).cast("int")).withColumn("source_key", F.concat(F.lit("local:"), "path"))
    return explode_pages(with_pages(files, counter, gate))


def escalating(cheap: Callable[[bytes, int], tuple[str, float]], careful: Callable[[bytes, int], tuple[str, float]], floor: float = 55.0) -> Callable[[bytes, int], tuple[str, float]]:
    """Recognition of a page by a cheap pass, and again by a careful one if its confidence is below ``floor``; the surer text stays."""

    def run(content: bytes, page: int) -> tuple[str, float]:
        first = cheap(content, page)
        if first[1] >= floor:
            return first
        second = careful(content, page)
        return second if second[1] > first[1] else first

    return run


def layered(native: Callable[[bytes], list[str]], recognise: Callable[[bytes, int], tuple[str, float]] | None = None, settings: Settings = DEFAULTS, floor: float = 55.0) -> Provider:
    """A text provider of a native layer (the text of each page) and recognition (text and confidence of a page).

    A page with fewer than ``min_text_chars`` characters, spaces at its ends aside, is recognised. Pages are joined by line
    ends. The notes tell a page that the file doesn't have, and pages recognised with less confidence than ``floor``.
    """

    def run(content: bytes, page: int | None) -> tuple[str, str, list[tuple[str, str]]]:
        pages = native(content)
        if page is not None and page >= len(pages):
            return "", "none", [("page_out_of_range", f"page {page + 1} of {len(pages)} (source file changed since discovery?)")]
        parts, used, unsure = [], False, 0
        for k in range(len(pages)) if page is None else [page]:
            text = pages[k] or ""
            if len(text.strip()) < settings.min_text_chars and recognise is not None:
                text, confidence = recognise(content, k)
                used = True
                unsure += confidence < floor
            parts.append(text)
        notes = [("low_ocr_confidence", f"{unsure} page(s) OCR'd below the confidence floor")] if unsure else []
        whole = "\n".join(parts).strip()
        return (whole, "ocr" if used else "text", notes) if whole else ("", "none", notes)

    return run
