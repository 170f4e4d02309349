"""Text of documents: pluggable providers, and the assembly of recognised words into lines.

A provider maps (bytes, page or None) to (text, kind), kind being text, ocr or none, or to (text, kind, notes), notes
being (code, message) of what it has to say of the document. None is built in, since no PDF or recognition library can
be counted on; ``register`` one (``pages.layered`` makes one of a library's functions), or bring a text column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecon.streaming.control import Gate

Provider = Callable[[bytes, int | None], tuple]
_providers: dict[str, Provider] = {}


def register(name: str, provider: Provider) -> None:
    _providers[name] = provider


def contents(batch: pd.DataFrame, gate: Gate | None = None) -> Iterator[Callable[[], bytes]]:
    """What opens each row's file: its column ``content``, or the file at its path, kept while rows of the same file follow.
    Before each row the gate is waited for."""
    path, held = None, b""

    def read(at: str) -> bytes:
        nonlocal path, held
        if at != path:
            with open(at, "rb") as file:
                path, held = None, file.read()
            path = at
        return held

    for row in batch["content"] if "content" in batch else batch["path"]:
        if gate:
            gate.wait()
        yield (lambda row=row: bytes(row)) if "content" in batch else (lambda row=row: read(row))


def with_text(files: DataFrame, provider: str | Provider, gate: Gate | None = None) -> DataFrame:
    """Add text, source, error and text_notes (lines of severity, code and message). A document that a provider fails on,
    or that can't be opened, keeps its row and goes through the later stages, with the error.

    Without a column ``content`` the tasks open the files themselves, so bytes never travel between tasks.
    """
    run = _providers.get(provider) if isinstance(provider, str) else provider
    if run is None:
        raise NotImplementedError(f"no text provider {provider!r} is registered; PDF text and recognition need a library of your choice")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for content, page in zip(contents(batch, gate), batch["page_index"], strict=True):
                try:
                    got = run(content(), None if pd.isna(page) else int(page))
                    notes = [f"warn\t{code}\t{' '.join(message.split())}" for code, message in (got[2] if len(got) > 2 else ())]
                    out.append((got[0], got[1], None, "\n".join(notes)))
                except Exception as error:  # one bad document must not end the job
                    out.append(("", "none", f"extract: {error!r}", f"error\tstage_error\textract failed: {' '.join(str(error).split())}"))
            rest = batch.drop(columns="content", errors="ignore")
            yield rest.assign(**{c: [o[i] for o in out] for i, c in enumerate(("text", "source", "error", "text_notes"))})

    kept = [f for f in files.schema.fields if f.name != "content"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", text string, source string, error string, text_notes string"
    return files.mapInPandas(read, schema)


def assemble_lines(words: DataFrame) -> DataFrame:
    """page, text, confidence from recognised words (page, block, par, line, pos, word, conf).

    Blank words go; words of a line stand in order, lines in the order of their first words; the confidence is the mean
    of those that aren't negative, 0 if there are none.
    """
    kept = words.filter(F.trim("word") != "")
    lines = kept.groupBy("page", "block", "par", "line").agg(F.min("pos").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("text"), F.sum(F.when(F.col("conf") >= 0, F.col("conf"))).alias("total"), F.count_if(F.col("conf") >= 0).alias("n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "text"))), lambda x: x["text"]), "\n")
    return lines.groupBy("page").agg(text.alias("text"), F.coalesce(F.round(F.try_divide(F.sum("total"), F.sum("n")), 6), F.lit(0.0)).alias("confidence"))


def escalate(cheap: DataFrame, second: Callable[[DataFrame], DataFrame], floor: float = 55.0) -> DataFrame:
    """Results (page, text, confidence) of a cheap pass, with those below ``floor`` retried; the surer text stays."""
    again = second(cheap.filter(F.col("confidence") < floor).select("page")).select("page", F.col("text").alias("t2"), F.col("confidence").alias("c2"))
    out = cheap.join(again, "page", "left")
    better = F.col("c2") > F.col("confidence")
    return out.select("page", F.when(better, F.col("t2")).otherwise(F.col("text")).alias("text"), F.when(better, F.col("c2")).otherwise(F.col("confidence")).alias("confidence"))


def otsu_threshold(pixels: np.ndarray) -> int:
    """The grey level that splits 8-bit pixels into two classes with the greatest variance between; of equals the lowest."""
    histogram = np.bincount(np.asarray(pixels, np.uint8).ravel(), minlength=256).astype(float)
    below = np.cumsum(histogram)
    total, mass = below[-1], np.cumsum(histogram * np.arange(256))
    above = total - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return int(np.argmax(np.nan_to_num(between, nan=0.0, posinf=0.0)))
