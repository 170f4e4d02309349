"""The stages of a document, each a function of a DataFrame and settings.

A document is a row with path, filename, text, source (none, text or ocr), page_index and source_key. Stages add flat
columns; flags are an array of (code, message, severity), unique by code. Everything is a column expression.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrecon.functions.fuzzy import name_scores, once
from docrecon.functions.norm import LINE_END, blank_to_null, company_name, day_first, found, invoice_key, money
from docrecon.settings import (
    APPROVAL_MARKER, BILL_TO, DATE_FOLDER, DEFAULTS, FILENAME_APPROVAL, FILENAME_INVOICE, FY_FOLDER, GSTIN, ID_FROM_FILENAME, INVOICE_DATE, INVOICE_NO, INVOICE_SIGNALS, MONTH_FOLDER,
    OTHER_SIGNALS, RETURN_MARKER, TAXABLE, TOTAL, Settings,
)

FLAG = "struct<code:string,message:string,severity:string>"


def flag(when: Column, code: str, message: Column | str, severity: str = "warn") -> Column:
    """The flag where ``when`` holds, else null."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(when, F.struct(F.lit(code).alias("code"), text.alias("message"), F.lit(severity).alias("severity")))


def with_flags(df: DataFrame, *new: Column) -> DataFrame:
    """Append the flags that apply; of a code that is there already the first stays."""
    added = F.array_compact(F.array(*new)).cast(f"array<{FLAG}>")
    merged = F.aggregate(added, F.col("flags"), lambda have, x: F.when(F.exists(have, lambda h: h["code"] == x["code"]), have).otherwise(F.concat(have, F.array(x))))
    return df.withColumn("flags", merged)


def codes(flags: str = "flags") -> Column:
    return F.array_join(F.transform(flags, lambda x: x["code"]), "; ")


def document_id(key: Column) -> Column:
    return F.concat(F.lit("d"), F.substring(F.sha1(key), 1, 10))


def relative_parts(path: Column, root: str) -> Column:
    """Components of a path below ``root``; all of its components if it isn't below it."""
    base = root.rstrip("/") + "/"
    below = F.when(path.startswith(base), F.substring(path, F.lit(len(base) + 1), F.length(path))) if root else F.lit(None).cast("string")
    return F.filter(F.split(F.coalesce(below, path), "/"), lambda p: p != "")


def _bank(folders: Column, scope: str) -> Column:
    low = F.transform(folders, F.lower)
    numbered = F.filter(F.transform(low, lambda p, i: F.when(p == "payments", i + 2)), lambda i: i.isNotNull() & (i <= F.size(folders)))
    after = F.try_element_at(folders, F.try_element_at(numbered, F.lit(1)).cast("int"))
    return F.coalesce(after, F.try_element_at(F.filter(folders, lambda p: F.lower(p) == scope.lower()), F.lit(1)))


def _folders(parts: Column) -> Column:
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def _year(part: Column) -> Column:
    return part.rlike(FY_FOLDER)


def _in_scope(folders: Column, settings: Settings) -> Column:
    """Whether a document of these folders is one of the bank's and the year's."""
    good = F.lower(_bank(folders, settings.bank_scope)) == settings.bank_scope.lower()
    if settings.fy_scope:
        own = F.upper(F.regexp_replace(F.lit(settings.fy_scope), r"\s+", ""))
        good = good & F.forall(folders, lambda p: ~_year(p) | (F.upper(F.regexp_replace(p, r"(?U)\s+", "")) == own))
    return good


def seed(docs: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Id, labels of the path's folders, and the flags of an incomplete path. Documents outside the bank or the year go.

    ``docs`` has path; filename, page_index and text columns are kept if there. The last folder that fits a shape wins;
    the deepest one that fits none is the company.
    """
    have = set(docs.columns)
    df = docs if "page_index" in have else docs.withColumn("page_index", F.lit(None).cast("int"))
    parts = relative_parts(F.col("path"), settings.root)
    df = df.withColumn("rel_parts", parts).withColumn("folders", _folders(F.col("rel_parts")))
    if "filename" not in have:
        df = df.withColumn("filename", F.element_at("rel_parts", -1))
    if "source_key" not in have:
        df = df.withColumn("source_key", F.concat(F.lit("local:"), "path", F.coalesce(F.concat(F.lit("#page="), F.col("page_index").cast("string")), F.lit(""))))
    df = df.withColumn("doc_id", document_id(F.col("source_key")))
    last = lambda shape: F.try_element_at(F.filter("folders", shape), F.lit(-1))
    year = _year
    month = lambda p: ~year(p) & p.rlike(MONTH_FOLDER)
    date = lambda p: ~year(p) & ~month(p) & p.rlike(DATE_FOLDER)
    plain = lambda p: ~year(p) & ~month(p) & ~date(p) & ~F.lower(p).isin("payments", "kotak")
    df = df.withColumns({"fy": last(year), "month": last(month), "date_folder": last(date), "unlabelled": F.filter("folders", plain), "bank": _bank(F.col("folders"), settings.bank_scope)})
    df = df.withColumn("company", F.try_element_at("unlabelled", F.lit(-1))).withColumn("unmatched", F.slice("unlabelled", 1, F.greatest(F.size("unlabelled") - 1, F.lit(0)))).drop("unlabelled")
    # Spark moves a filter down to where the path is made and writes out there all that it names, so it names the path once.
    df = df.filter(once(F.col("path"), lambda path: once(relative_parts(path, settings.root), lambda all_: once(_folders(all_), lambda own: _in_scope(own, settings)))))
    df = df.withColumn("flags", F.array().cast(f"array<{FLAG}>"))
    lacking = F.col("fy").isNull() | F.col("month").isNull() | F.col("date_folder").isNull()
    return with_flags(df, flag(F.col("company").isNull(), "no_company_folder", "could not derive company from path"), flag(lacking, "path_incomplete", "missing FY/month/date folder level"))


def extract(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Where the text came from. Needs text; source is derived if it isn't there."""
    if "source" not in df.columns:
        df = df.withColumn("source", F.when(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0, "text").otherwise("none"))
    df = df.withColumn("text", F.coalesce("text", F.lit("")))
    if "text_notes" in df.columns:
        lines = F.filter(F.split(F.coalesce("text_notes", F.lit("")), "\n"), lambda x: x != "")
        part = lambda x, i: F.element_at(F.split(x, "\t"), i)
        told = F.transform(lines, lambda x: F.struct(part(x, 2).alias("code"), part(x, 3).alias("message"), part(x, 1).alias("severity")))
        df = df.withColumn("flags", F.concat("flags", F.filter(told, lambda x: ~F.exists("flags", lambda h: h["code"] == x["code"])))).drop("text_notes")
    failed = F.coalesce(F.col("error") != "", F.lit(False)) if "error" in df.columns else F.lit(False)
    return with_flags(df, flag((F.col("source") == "none") & ~failed, "no_text", "no extractable text even after OCR"))


def classify(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """classify_score (rounded), doc_type, reasons, and the flag of a file name that says something else."""
    name = F.col("filename")
    signals = [(p, w, why, 1.0) for p, w, why in INVOICE_SIGNALS] + [(p, w, why, -1.0) for p, w, why in OTHER_SIGNALS]
    # Each pattern is searched once; the score, the reasons and the type read what was found.
    df = df.withColumn("_hits", F.array(*[F.col("text").rlike("(?iU)" + p) for p, *_ in signals]))
    hit = {p: F.col("_hits")[i] for i, (p, *_) in enumerate(signals)}
    as_invoice, as_approval = name.rlike("(?iU)" + FILENAME_INVOICE), name.rlike("(?iU)" + FILENAME_APPROVAL)
    hint = F.when(as_invoice, settings.filename_hint).when(as_approval, -settings.filename_hint).otherwise(0.0)
    weigh = lambda sign: reduce(lambda a, b: a + b, [F.when(hit[p], F.lit(w)).otherwise(0.0) for p, w, _, s in signals if s == sign])
    reasons = [*(F.when(hit[p], F.lit(f"{'+' if s > 0 else '-'}{w} {why}")) for p, w, why, s in signals), F.when(as_invoice, F.lit(f"+{settings.filename_hint} filename~invoice")).when(as_approval, F.lit(f"-{settings.filename_hint} filename~approval"))]
    df = df.withColumn("score", weigh(1.0) - weigh(-1.0) + hint)
    kind = F.when(hit[APPROVAL_MARKER], "approval").when(hit[RETURN_MARKER], "gstr2a").when(F.col("score") >= settings.invoice_score, "invoice").when(F.col("text") == "", "unknown").otherwise("other")
    df = df.withColumns({"doc_type": kind, "reasons": F.array_join(F.array_compact(F.array(*reasons)), "; ")}).drop("_hits")
    looks = F.concat(F.lit("filename looks like invoice but classified "), "doc_type", F.format_string(" (score %.1f)", F.col("score")))
    df = with_flags(
        df,
        flag(as_invoice & (F.col("doc_type") != "invoice"), "filename_content_mismatch", looks),
        flag(as_approval & (F.col("doc_type") == "invoice"), "filename_content_mismatch", "filename looks like approval but content scored as invoice"),
    )
    return df.withColumn("classify_score", F.round("score", 2)).drop("score")


@dataclass(frozen=True)
class VendorLayout:
    """Fields of a vendor's own layout: where ``applies`` holds, each field's column wins unless it is null. The highest priority wins."""

    name: str
    applies: Column | Callable[[], Column]
    fields: dict[str, Column] | Callable[[], dict[str, Column]]
    priority: int = 0


def gstin_starts(prefix: str) -> Column:
    return F.coalesce(F.upper("vendor_gstin").startswith(prefix.upper()), F.lit(False))


def vendor_contains(part: str) -> Column:
    return F.coalesce(F.contains(F.lower("vendor_name_pdf"), F.lit(part.lower())), F.lit(False))


def text_has(pattern: str) -> Column:
    return F.col("text").rlike("(?iU)" + pattern)


def _logistics() -> dict[str, Column]:
    text = F.col("text")
    raw = found(text, r"\bdated\s*:?\s*([0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4})")
    return {
        "invoice_no_content": found(text, r"bill\s*no\.?\s*:?\s*([A-Za-z0-9][A-Za-z0-9/\-]+)"),
        "invoice_date_raw": raw,
        "invoice_date": day_first(raw),
        "total_value": money(found(text, r"amount\s+payable\s*:?\s*(?:inr|rs\.?|₹)?\s*([\d,]+\.\d{2})")),
        "taxable_value": money(found(text, r"taxable\s*:?\s*(?:inr|rs\.?|₹)?\s*([\d,]+\.\d{2})")),
    }


LAYOUTS = [VendorLayout("zephyr-logistics", lambda: text_has(r"zephyr\s+logistics"), _logistics, 10)]
FIELDS = ("invoice_no_content", "vendor_name_pdf", "vendor_gstin", "bill_to_gstin", "bill_to_name", "invoice_date_raw", "invoice_date", "taxable_value", "total_value")


def _mined(df: DataFrame) -> DataFrame:
    """``df`` with what the baseline's fields are made of, as columns that begin with ``_b_``, so that each text is
    searched once however many fields read what was found. Null where the document is no invoice."""
    text = F.col("_b_text")
    df = df.withColumn("_b_text", F.when(F.col("doc_type") == "invoice", F.col("text")))
    lines = F.filter(F.transform(F.split(text, LINE_END), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    # Ids before the bill-to marker are the seller's. One character more is kept, so that cutting makes no word end.
    df = df.withColumns({"_b_lines": lines, "_b_marker": F.regexp_instr(text, F.lit("(?iU)" + BILL_TO)), "_b_ids": _ids(text), "_b_raw": found(text, INVOICE_DATE)})
    at = F.coalesce(F.array_position(F.transform("_b_lines", lambda x: x.rlike(r"(?iU)tax\s+invoice")), F.lit(True)), F.lit(0))
    before = F.when(F.col("_b_marker") > 0, F.size(_ids(F.substring(text, F.lit(1), F.col("_b_marker"))))).otherwise(F.size("_b_ids"))
    return df.withColumns({"_b_at": at, "_b_before": before})


def _ids(part: Column) -> Column:
    return F.regexp_extract_all(part, F.lit("(?U)" + GSTIN), F.lit(1))


def _baseline() -> dict[str, Column]:
    """The fields from what ``_mined`` found."""
    text, lines, at, before = (F.col(c) for c in ("_b_text", "_b_lines", "_b_at", "_b_before"))
    vendor = F.when((at > 0) & (at < F.size(lines)), F.try_element_at(lines, (at + 1).cast("int"))).otherwise(F.try_element_at(lines, F.lit(1)))
    tail = F.regexp_replace(F.regexp_extract(text, r"(?isU)" + BILL_TO + r"(.*)", 1), r"(?U)^[\s:]+", "")
    name = F.try_element_at(F.filter(F.split(tail, LINE_END), lambda x: x.rlike("[A-Za-z0-9]")), F.lit(1))
    return {
        "invoice_no_content": found(text, INVOICE_NO),
        "vendor_name_pdf": vendor,
        "vendor_gstin": F.try_element_at("_b_ids", F.lit(1)),
        "bill_to_gstin": F.try_element_at("_b_ids", before + 1),
        "bill_to_name": F.when(F.col("_b_marker") > 0, F.regexp_replace(name, r"(?U)^\s+|\s+$", "")),
        "invoice_date_raw": F.col("_b_raw"),
        "invoice_date": day_first(F.col("_b_raw")),
        "taxable_value": money(found(text, TAXABLE)),
        "total_value": money(found(text, TOTAL)),
    }


def parse(df: DataFrame, settings: Settings = DEFAULTS, layouts: list[VendorLayout] | None = None) -> DataFrame:
    """The invoice id from the file name of every document, and fields from the text of invoices."""
    name = F.col("filename")
    base = F.when(name.rlike("(?iU)" + ID_FROM_FILENAME), F.regexp_replace(F.regexp_extract(name, "(?iU)" + ID_FROM_FILENAME, 1), r"(?U)^\s+|\s+$", ""))
    page = F.coalesce(F.concat(F.lit("-p"), (F.col("page_index") + 1).cast("string")), F.lit(""))
    df = df.withColumn("invoice_id", F.when(F.length(base) > 0, F.concat(base, page)).otherwise(base))
    invoice = F.col("doc_type") == "invoice"
    df = _mined(df).withColumns({k: F.when(invoice, c) for k, c in _baseline().items()})
    df = df.drop(*[c for c in df.columns if c.startswith("_b_")])
    applied = []
    for layout in sorted(LAYOUTS if layouts is None else layouts, key=lambda x: x.priority):
        applies = layout.applies() if callable(layout.applies) else layout.applies
        fields = layout.fields() if callable(layout.fields) else layout.fields
        mark = f"_layout_{len(applied)}"
        df = df.withColumn(mark, F.coalesce(invoice & applies, F.lit(False)))
        applied.append((layout.name, mark, fields))
    for _, mark, fields in applied:  # all were decided on the baseline's fields
        df = df.withColumns({k: F.coalesce(F.when(F.col(mark), c), F.col(k)) for k, c in fields.items() if k != "invoice_date"} | ({"invoice_date": F.when(F.col(mark) & fields["invoice_date_raw"].isNotNull(), fields["invoice_date"]).otherwise(F.col("invoice_date"))} if "invoice_date_raw" in fields else {}))
    df = df.withColumn("layouts", F.array_compact(F.array(*[F.when(F.col(mark), F.lit(n)) for n, mark, _ in applied])).cast("array<string>")).drop(*[m for _, m, _ in applied])
    names = lambda keys, has: F.array_join(F.array_compact(F.array(*[F.when(F.col(k).isNotNull() == has, F.lit(k)) for k in keys])), ",")
    got = names(("vendor_name_pdf", "vendor_gstin", "invoice_date", "taxable_value", "total_value"), True)
    missing = names(("vendor_gstin", "invoice_date", "total_value"), False)
    return df.withColumns({"got": F.when(invoice, got), "missing": F.when(invoice, missing)})


def reconcile(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """company_score, and the flags of a folder or file name that disagrees with the text. Invoices only."""
    invoice = F.col("doc_type") == "invoice"
    company, vendor = blank_to_null(F.col("company")), blank_to_null(F.col("vendor_name_pdf"))
    both = invoice & company.isNotNull() & vendor.isNotNull()
    names = [F.when(both, company_name(F.col(c))) for c in ("company", "vendor_name_pdf")]
    df = df.withColumn("company_score", name_scores(*names))
    score = F.col("company_score")
    text = F.concat(F.lit("folder '"), "company", F.lit("' vs PDF '"), "vendor_name_pdf", F.format_string("' (fuzzy %.0f)", score))
    number, own = blank_to_null(F.col("invoice_no_content")), blank_to_null(F.col("invoice_id"))
    differs = invoice & own.isNotNull() & number.isNotNull() & (invoice_key(own) != invoice_key(number))
    return with_flags(
        df,
        flag((score >= settings.soft) & (score < settings.accept), "company_name_soft_mismatch", text, "info"),
        flag(score < settings.soft, "company_mismatch", text),
        flag(differs, "id_mismatch", F.concat(F.lit("filename id '"), "invoice_id", F.lit("' vs PDF '"), "invoice_no_content", F.lit("'"))),
    )


def validate(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """confidence of invoices: one less a deduction for each lack or flag, subtracted in turn as doubles; 0 for others."""
    invoice = F.col("doc_type") == "invoice"
    missing = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    short = F.col("taxable_value").isNotNull() & F.col("total_value").isNotNull() & (F.col("total_value") + settings.tolerance < F.col("taxable_value"))
    cuts = [(F.col("source") == "ocr", 0.15), (missing("vendor_gstin"), 0.15), (missing("invoice_date"), 0.10), (F.col("total_value").isNull(), 0.15), (F.col("taxable_value").isNull(), 0.05), (missing("vendor_name_pdf"), 0.10), (short, 0.20)]
    start = reduce(lambda c, cut: F.when(cut[0], c - F.lit(cut[1])).otherwise(c), cuts, F.lit(1.0))
    by_flag = {"company_mismatch": 0.30, "company_name_soft_mismatch": 0.10, "id_mismatch": 0.20}  # fixed values
    cost = lambda code: reduce(lambda c, kv: c.when(code == kv[0], kv[1]), list(by_flag.items())[1:], F.when(code == "company_mismatch", by_flag["company_mismatch"])).otherwise(0.0)
    df = df.withColumn("_c", F.aggregate("flags", start, lambda c, x: c - cost(x["code"])))
    df = df.withColumn("_c", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "_c")))
    df = with_flags(
        df,
        flag(invoice & short, "amount_inconsistent", F.concat(F.lit("total "), F.col("total_value").cast("string"), F.lit(" < taxable "), F.col("taxable_value").cast("string"))),
        flag(invoice & (F.col("_c") < settings.review_below), "low_confidence", F.format_string(f"confidence %.2f below {settings.review_below:.2f}", F.col("_c"))),
    )
    return df.withColumn("confidence", F.when(invoice, F.round("_c", 3)).otherwise(0.0)).drop("_c")


STAGES = (extract, classify, parse, reconcile, validate)


def process(docs: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """All stages in turn; the result has a row for each document in scope."""
    df = seed(docs, settings)
    for stage in STAGES:
        df = df.transform(stage, settings)
    return finish(df)


def finish(df: DataFrame) -> DataFrame:
    """Documents of all stages with the columns that reviews and failures fill."""
    for column, value in (("reviewed", False), ("hidden", False)):
        if column not in df.columns:
            df = df.withColumn(column, F.lit(value))
    if "error" not in df.columns:
        df = df.withColumn("error", F.lit(None).cast("string"))
    return df
