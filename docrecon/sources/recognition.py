"""Recognition as passes of its own: pages that need it are rows, dealt to all tasks by runs of pages and not by document.

``with_text`` of ``sources.text`` gives a whole document to one call, so a scanned file of hundreds of pages holds up one
task. Here a first pass takes the native layer of each file, a second recognises the pages that are thin, a third, careful
and slow, those that the second was unsure of, and between passes the pages are dealt anew. Page texts meet again by an ordered
aggregate. The result is that of ``sources.pages.layered`` with ``escalating``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecon.settings import DEFAULTS, Settings
from docrecon.sources.pages import escalating, layered
from docrecon.sources.text import Provider, contents
from docrecon.streaming.control import Gate

Recogniser = Callable[[bytes, int], tuple[str, float]]
#: Pages of a file that go to a task together, so that it opens the file once for them.
RUN_PAGES = 8
#: What ``str.strip`` takes off, as a class of a pattern.
_BLANK = "[" + "".join(f"\\x{{{c:x}}}" for c in range(0x10000) if chr(c).isspace()) + "]+"
_FIELDS = {"page": "int", "text": "string", "confidence": "double", "used": "boolean", "thin": "boolean", "error": "string", "fault": "string", "note": "string"}


@dataclass(frozen=True)
class Layers:
    """A native layer (texts of a file's pages), recognition of one page, and a careful recognition of pages whose
    confidence is below ``floor``."""

    native: Callable[[bytes], list[str]]
    cheap: Recogniser | None = None
    careful: Recogniser | None = None
    floor: float = 55.0

    def provider(self, settings: Settings = DEFAULTS) -> Provider:
        """The same for a document in one call."""
        recognise = escalating(self.cheap, self.careful, self.floor) if self.cheap and self.careful else self.cheap
        return layered(self.native, recognise, settings, self.floor)


def _told(error: Exception) -> dict:
    return {"text": "", "thin": False, "error": f"extract: {error!r}", "fault": " ".join(str(error).split())}


def _lines(notes) -> str:
    return "\n".join(f"warn\t{code}\t{' '.join(message.split())}" for code, message in notes)


def _native(files: DataFrame, layers: Layers, settings: Settings, gate: Gate | None, explode: bool) -> DataFrame:
    """Rows of pages by the native layer. Documents that aren't one page become a row a page, or are read in one call."""
    blank = {"page": -1, "text": "", "confidence": None, "used": False, "thin": False, "error": None, "fault": None, "note": ""}

    def of(content: bytes, page: int | None) -> list[dict]:
        if page is None and not explode:
            text, kind, notes = layers.provider(settings)(content, None)
            return [{"text": text, "used": kind == "ocr", "note": _lines(notes)}]
        texts = layers.native(content)
        if page is not None and page >= len(texts):
            return [{"note": _lines([("page_out_of_range", f"page {page + 1} of {len(texts)} (source file changed since discovery?)")])}]
        rows = [(k, texts[k] or "") for k in (range(len(texts)) if page is None else [page])]
        return [{"page": k, "text": t, "thin": layers.cheap is not None and len(t.strip()) < settings.min_text_chars} for k, t in rows] or [{}]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, out = [], []
            for i, (content, page) in enumerate(zip(contents(batch, gate), batch["page_index"], strict=True)):
                try:
                    rows = of(content(), None if pd.isna(page) else int(page))
                except Exception as error:  # one bad document must not end the job
                    rows = [_told(error)]
                at += [i] * len(rows)
                out += [{**blank, **row} for row in rows]
            pages = pd.DataFrame(out, columns=list(_FIELDS))
            yield batch.iloc[at].reset_index(drop=True).assign(**{c: pages[c] for c in _FIELDS})

    return files.mapInPandas(read, _schema(files))


def _schema(files: DataFrame) -> str:
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields if f.name not in _FIELDS]
    return ", ".join(kept + [f"{name} {kind}" for name, kind in _FIELDS.items()])


def _pass(pages: DataFrame, recognise: Recogniser, wanted: Callable[[pd.DataFrame], pd.Series], surer: bool, gate: Gate | None) -> DataFrame:
    """Recognise the wanted pages; a text stays if ``surer`` is asked for and the new one isn't."""
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pages.repartition(parts, "path", F.floor(F.col("page") / RUN_PAGES))
    dealt = dealt if pages.isStreaming else dealt.sortWithinPartitions("path", "page")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.reset_index(drop=True)
            rows = batch.to_dict("list")
            chosen = batch.index[wanted(batch).fillna(False).astype(bool)]
            for i, content in zip(chosen, contents(batch.loc[chosen], gate), strict=True):
                try:
                    text, confidence = recognise(content(), int(rows["page"][i]))
                    new = {"text": text, "confidence": float(confidence), "used": True}
                    if surer and not confidence > rows["confidence"][i]:
                        continue
                except Exception as error:
                    new = _told(error)
                for name, value in new.items():
                    rows[name][i] = value
            yield batch.assign(**{c: pd.Series(rows[c], dtype="float64" if c == "confidence" else object) for c in ("text", "confidence", "used", "thin", "error", "fault")})

    return dealt.mapInPandas(run, _schema(pages))


def recognised(files: DataFrame, layers: Layers, settings: Settings = DEFAULTS, gate: Gate | None = None) -> DataFrame:
    """Add text, source, error and text_notes, as ``with_text`` does, to rows of path and page_index (null: all pages).

    Tasks open the files; a column ``content`` isn't read. A document that any page of fails, or that can't be opened, keeps
    its row, with the error of its first failing page. Rows that repeat a path and page each get its text, which is read once.
    A null path is a file that can't be opened. In a stream, which can't gather a document's pages within a micro-batch,
    rows that aren't single pages are read in one call.
    """
    floor = layers.floor
    stream = files.isStreaming
    keys = files.drop("content", *_FIELDS) if stream else files.select("path", "page_index").distinct()
    pages = _native(keys, layers, settings, gate, explode=not stream)
    if layers.cheap:
        pages = _pass(pages, layers.cheap, lambda b: b["thin"], False, gate)
    if layers.cheap and layers.careful:
        pages = _pass(pages, layers.careful, lambda b: b["thin"].astype(bool) & (b["confidence"] < floor), True, gate)
    unsure = F.col("thin") & (F.col("confidence") < floor)
    if stream:
        done = pages.withColumn("unsure", F.when(unsure, 1).otherwise(0))
    else:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"])
        first = lambda c: F.min_by(c, F.when(F.col("error").isNotNull(), F.col("page")))
        done = pages.groupBy("path", "page_index").agg(
            F.array_join(ordered, "\n").alias("text"), F.bool_or("used").alias("used"), F.count_if(unsure).alias("unsure"),
            first("error").alias("error"), first("fault").alias("fault"), F.max("note").alias("note"))
    text = F.regexp_replace("text", f"^{_BLANK}|{_BLANK}$", "")
    bad = F.col("error").isNotNull()
    low = F.when(F.col("unsure") > 0, F.format_string("warn\tlow_ocr_confidence\t%d page(s) OCR'd below the confidence floor", "unsure"))
    notes = F.concat_ws("\n", F.when(F.col("note") != "", F.col("note")), low)
    columns = {
        "text": F.when(bad, "").otherwise(text),
        "source": F.when(bad | (text == ""), "none").when(F.col("used"), "ocr").otherwise("text"),
        "text_notes": F.when(bad, F.concat(F.lit("error\tstage_error\textract failed: "), "fault")).otherwise(notes),
    }
    rest = [F.col(f"`{c}`") for c in keys.columns]
    done = done.select(*rest, *(v.alias(k) for k, v in columns.items()), "error")
    if stream:
        return done
    kept = files.drop("content", "text", "source", "error", "text_notes").alias("f")
    same = F.col("f.path").eqNullSafe(F.col("d.path")) & F.col("f.page_index").eqNullSafe(F.col("d.page_index"))
    return kept.join(done.alias("d"), same, "left").select("f.*", "d.text", "d.source", "d.error", "d.text_notes")
