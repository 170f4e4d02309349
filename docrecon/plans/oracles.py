"""DuckDB SQL for the reconciliation queries, written from their definitions and not from the Spark plans."""

from __future__ import annotations

from docrecon.plans.fixtures import DOCS, ROWS
from docrecon.settings import GSTIN, INVOICE_DATE, INVOICE_NO, INVOICE_SIGNALS, MASTER_COLUMNS, OTHER_SIGNALS, TAXABLE, TOTAL

_FIXTURE = {"orders": "orders", "customer": "customer"}
_QUERY = ("apex", "consultnts", "0000123")


def _has(pattern: str, text: str = "text") -> str:
    return f"regexp_matches({text}, '(?i){pattern}')"


def _get(pattern: str, text: str = "text", group: int = 1, options: str = "(?i)") -> str:
    return f"nullif(regexp_extract({text}, '{options}{pattern}', {group}), '')"


def _lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of two strings, the first of at most 62 characters: rows of the dynamic programme as bits."""
    full = f"((1::BIGINT << length({a})) - 1)"
    mask = f"coalesce(list_sum(list_transform(range(1, length({a}) + 1), lambda i: CASE WHEN substr({a}, i, 1) = ch THEN 1::BIGINT << (i - 1)::INT ELSE 0::BIGINT END)), 0)::BIGINT"
    masks = f"list_transform(string_split({b}, ''), lambda ch: {mask})"
    return f"(length({a}) - bit_count(list_reduce(list_prepend({full}, {masks}), lambda r, m: ((r + (r & m)) | (r - (r & m))) & {full})))"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' AND {b} = '' THEN 100.0::DOUBLE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE ELSE 200.0::DOUBLE * {_lcs(a, b)} / (length({a}) + length({b})) END"


_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def _spelled(c: str, prefix: str) -> str:
    """How often each letter and digit stands in a string, as columns."""
    return ", ".join(f"(length({c}) - length(replace({c}, '{x}', '')))::SMALLINT AS {prefix}{x}" for x in _LETTERS)


def _name(c: str) -> str:
    s = rf"regexp_replace(lower({c}), '\(.*?\)', ' ', 'g')"
    s = rf"trim(regexp_replace(regexp_replace(replace({s}, '&', ' and '), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"
    for suffix in ("private limited", "incorporated", "and associates", "pvt limited", "limited", "pvt ltd", "company", "llp", "ltd", "inc", "co"):
        s = rf"regexp_replace({s}, '\b{suffix}\b', ' ', 'g')"
    return f"trim(regexp_replace({s}, ' +', ' ', 'g'))"


def _key(c: str) -> str:
    return f"regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]', '', 'g')"


def _tax(c: str) -> str:
    return f"regexp_replace(upper(coalesce({c}, '')), '[^A-Z0-9]', '', 'g')"


def _file(c: str, other: str) -> str:
    s = rf"regexp_replace(regexp_replace(regexp_replace(trim({c}), '[/\\]|\s+', '-', 'g'), '[^A-Za-z0-9._-]', '', 'g'), '^[-._]+|[-._]+$', '', 'g')"
    return f"coalesce(nullif({s}, ''), '{other}')"


_REF = f"{_file('gstin', 'NOGSTIN')} || '__' || {_file('invoice_no', 'NOINV')} || '.pdf'"
_MONEY = "round(TRY_CAST(replace({}, ',', '') AS DOUBLE), 2)"
_FLAG_ORDER = (
    ("no_company_folder", "company IS NULL"), ("path_incomplete", "fy IS NULL OR month IS NULL OR date_folder IS NULL"), ("no_text", "source = 'none'"),
    ("filename_content_mismatch", "(regexp_matches(filename, '(?i)^invoice[_\\-\\s]') AND doc_type <> 'invoice') OR (regexp_matches(filename, '(?i)^approval[_\\-\\s]') AND doc_type = 'invoice')"),
    ("company_name_soft_mismatch", "company_score >= 70 AND company_score < 90"), ("company_mismatch", "company_score < 70"), ("id_mismatch", "differs"), ("amount_inconsistent", "short"), ("low_confidence", "doc_type = 'invoice' AND exact < 0.8"),
)


def _signals(signals) -> str:
    return " + ".join(f"CASE WHEN {_has(p)} THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for p, w, _ in signals)


def _reasons() -> str:
    parts = [f"CASE WHEN {_has(p)} THEN '{sign}{w} {why.replace(chr(39), chr(39) * 2)}' END" for sign, signals in (("+", INVOICE_SIGNALS), ("-", OTHER_SIGNALS)) for p, w, why in signals]
    parts += ["CASE WHEN regexp_matches(filename, '(?i)^invoice[_\\-\\s]') THEN '+1.0 filename~invoice' WHEN regexp_matches(filename, '(?i)^approval[_\\-\\s]') THEN '-1.0 filename~approval' END"]
    return f"concat_ws('; ', {', '.join(parts)})"


_LAYOUT = _has(r"zephyr\s+logistics")
_ZEPHYR_DATE = _get(r"\bdated\s*:?\s*([0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4})")
#: The processed documents.
_DOCS = f"""
WITH {DOCS.format(**_FIXTURE)}, located AS (
  SELECT *, string_split(substr(path, 7), '/') AS parts, string_split(substr(path, 7), '/')[:-2] AS folders, 'd' || substr(sha1('local:' || path), 1, 10) AS doc_id FROM inv_docs
), labelled AS (
  SELECT *, folders[3] AS bank,
    list_filter(folders, lambda p: regexp_matches(p, '(?i)^FY\\s*\\d{{2}}\\s*-\\s*\\d{{2}}$'))[-1] AS fy,
    list_filter(folders, lambda p: regexp_matches(p, '^[A-Za-z]{{3,9}}-\\d{{4}}$'))[-1] AS month,
    list_filter(folders, lambda p: regexp_matches(p, '^\\d{{1,2}}-[A-Za-z]{{3,9}}-\\d{{4}}$'))[-1] AS date_folder,
    list_filter(folders, lambda p: NOT regexp_matches(p, '(?i)^(FY\\s*\\d{{2}}\\s*-\\s*\\d{{2}}|[A-Za-z]{{3,9}}-\\d{{4}}|\\d{{1,2}}-[A-Za-z]{{3,9}}-\\d{{4}}|payments|kotak)$')) AS plain
  FROM located
), scored AS (
  SELECT *, plain[-1] AS company, array_to_string(plain[:-2], '|') AS unmatched,
    ({_signals(INVOICE_SIGNALS)}) - ({_signals(OTHER_SIGNALS)}) + CASE WHEN regexp_matches(filename, '(?i)^invoice[_\\-\\s]') THEN 1.0::DOUBLE WHEN regexp_matches(filename, '(?i)^approval[_\\-\\s]') THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS score,
    {_reasons()} AS reasons
  FROM labelled
), typed AS (
  SELECT *, CASE WHEN {_has(OTHER_SIGNALS[0][0])} THEN 'approval' WHEN {_has(OTHER_SIGNALS[3][0])} THEN 'gstr2a' WHEN score >= 3 THEN 'invoice' WHEN text = '' THEN 'unknown' ELSE 'other' END AS doc_type,
    trim({_get(r'^(?:invoice[_\-\s])?(.+?)\.pdf$', 'filename')}) AS invoice_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines,
    CASE WHEN {_has(r'bill\s*to')} THEN regexp_extract(text, '(?is)^(.*?)bill\\s*to', 1) END AS head, regexp_extract(text, '(?is)bill\\s*to(.*)$', 1) AS tail
  FROM scored
), mined AS (
  SELECT *, doc_type = 'invoice' AND {_LAYOUT} AS zephyr, list_position(list_transform(lines, lambda x: regexp_matches(x, '(?i)tax\\s+invoice')), true) AS title,
    regexp_extract_all(text, '{GSTIN}', 1) AS ids, length(regexp_extract_all(coalesce(head, text), '{GSTIN}', 1)) AS own_ids
  FROM typed
), parsed AS (
  SELECT * EXCLUDE (zephyr), CASE WHEN zephyr THEN 'zephyr-logistics' ELSE '' END AS layouts,
    CASE WHEN doc_type = 'invoice' THEN CASE WHEN zephyr THEN coalesce({_get(r'bill\s*no\.?\s*:?\s*([A-Za-z0-9][A-Za-z0-9/\-]+)')}, {_get(INVOICE_NO)}) ELSE {_get(INVOICE_NO)} END END AS invoice_no_content,
    CASE WHEN doc_type = 'invoice' THEN CASE WHEN title > 0 AND title < len(lines) THEN lines[title + 1] ELSE lines[1] END END AS vendor_name_pdf,
    CASE WHEN doc_type = 'invoice' THEN ids[1] END AS vendor_gstin,
    CASE WHEN doc_type = 'invoice' THEN ids[own_ids + 1] END AS bill_to_gstin,
    CASE WHEN doc_type = 'invoice' AND head IS NOT NULL THEN trim(list_filter(string_split(regexp_replace(tail, '^[\\s:]+', ''), chr(10)), lambda x: regexp_matches(x, '[A-Za-z0-9]'))[1]) END AS bill_to_name,
    CASE WHEN doc_type = 'invoice' THEN CASE WHEN zephyr THEN coalesce({_ZEPHYR_DATE}, {_get(INVOICE_DATE)}) ELSE {_get(INVOICE_DATE)} END END AS invoice_date_raw,
    CASE WHEN doc_type = 'invoice' THEN CASE WHEN zephyr THEN coalesce({_MONEY.format(_get(r'taxable\s*:?\s*(?:inr|rs\.?)?\s*([\d,]+\.\d{2})'))}, {_MONEY.format(_get(TAXABLE))}) ELSE {_MONEY.format(_get(TAXABLE))} END END AS taxable_value,
    CASE WHEN doc_type = 'invoice' THEN CASE WHEN zephyr THEN coalesce({_MONEY.format(_get(r'amount\s+payable\s*:?\s*(?:inr|rs\.?)?\s*([\d,]+\.\d{2})'))}, {_MONEY.format(_get(TOTAL))}) ELSE {_MONEY.format(_get(TOTAL))} END END AS total_value
  FROM mined
), dated AS (
  SELECT *, strftime(coalesce(try_strptime(invoice_date_raw, '%d-%b-%Y'), try_strptime(invoice_date_raw, '%d/%m/%Y')), '%Y-%m-%d') AS invoice_date,
    {_name('company')} AS a, {_name('vendor_name_pdf')} AS b
  FROM parsed
), split AS (
  SELECT *, list_intersect(list_distinct(string_split(a, ' ')), list_distinct(string_split(b, ' '))) AS i FROM dated
), worded AS (
  SELECT *, array_to_string(list_sort(i), ' ') AS s, array_to_string(list_sort(list_filter(list_distinct(string_split(a, ' ')), lambda w: NOT list_contains(i, w))), ' ') AS x,
    array_to_string(list_sort(list_filter(list_distinct(string_split(b, ' ')), lambda w: NOT list_contains(i, w))), ' ') AS y FROM split
), likened AS (
  SELECT *, CASE WHEN company IS NULL OR vendor_name_pdf IS NULL THEN NULL WHEN a = '' OR b = '' THEN 0.0::DOUBLE WHEN a = b THEN 100.0::DOUBLE WHEN len(i) > 0 AND (x = '' OR y = '') THEN 100.0::DOUBLE
      ELSE greatest(100.0::DOUBLE * (1.0::DOUBLE - (length(x) + length(y) - 2 * {_lcs('x', 'y')}) / (2 * length(s) + CASE WHEN len(i) > 0 THEN 2 ELSE 0 END + length(x) + length(y))::DOUBLE),
        CASE WHEN len(i) > 0 THEN 200.0::DOUBLE * length(s) / (2 * length(s) + 1 + length(x)) ELSE 0.0::DOUBLE END, CASE WHEN len(i) > 0 THEN 200.0::DOUBLE * length(s) / (2 * length(s) + 1 + length(y)) ELSE 0.0::DOUBLE END) END AS name_score,
    CASE WHEN doc_type = 'invoice' AND company IS NOT NULL AND vendor_name_pdf IS NOT NULL THEN true ELSE false END AS named,
    doc_type = 'invoice' AND invoice_id IS NOT NULL AND invoice_no_content IS NOT NULL AND {_key('invoice_id')} <> {_key('invoice_no_content')} AS differs,
    coalesce(total_value + 1.0 < taxable_value, false) AS short
  FROM worded
), judged AS (
  SELECT *, CASE WHEN named THEN name_score END AS company_score,
    CAST(1 AS DOUBLE) - CASE WHEN source = 'ocr' THEN 0.15::DOUBLE ELSE 0 END - CASE WHEN vendor_gstin IS NULL THEN 0.15::DOUBLE ELSE 0 END - CASE WHEN invoice_date IS NULL THEN 0.1::DOUBLE ELSE 0 END - CASE WHEN total_value IS NULL THEN 0.15::DOUBLE ELSE 0 END
      - CASE WHEN taxable_value IS NULL THEN 0.05::DOUBLE ELSE 0 END - CASE WHEN vendor_name_pdf IS NULL THEN 0.1::DOUBLE ELSE 0 END - CASE WHEN short THEN 0.2::DOUBLE ELSE 0 END AS before_flags
  FROM likened
), sure AS (
  SELECT *, greatest(0, least(1, before_flags - CASE WHEN company_score >= 70 AND company_score < 90 THEN 0.1::DOUBLE WHEN company_score < 70 THEN 0.3::DOUBLE ELSE 0 END - CASE WHEN differs THEN 0.2::DOUBLE ELSE 0 END)) AS exact FROM judged
), docs AS MATERIALIZED (
  SELECT *, CASE WHEN doc_type = 'invoice' THEN round(exact, 3) ELSE 0.0::DOUBLE END AS confidence, list_filter([{", ".join(f"CASE WHEN {w} THEN '{c}' END" for c, w in _FLAG_ORDER)}], lambda f: f IS NOT NULL) AS flags,
    CASE WHEN doc_type = 'invoice' THEN concat_ws(',', {", ".join(f"CASE WHEN {f} IS NOT NULL THEN '{f}' END" for f in ("vendor_name_pdf", "vendor_gstin", "invoice_date", "taxable_value", "total_value"))}) END AS got,
    CASE WHEN doc_type = 'invoice' THEN concat_ws(',', {", ".join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in ("vendor_gstin", "invoice_date", "total_value"))}) END AS missing
  FROM sure
)"""

_PLAN = f"""{_DOCS}, {ROWS.format(**_FIXTURE).replace("base AS (", "r_base AS (").replace("FROM base", "FROM r_base").replace("told AS (", "r_told AS (").replace("FROM told", "FROM r_told").replace("priced AS (", "r_priced AS (").replace("FROM priced", "FROM r_priced")}, return_clean AS (
  SELECT * FROM return_rows
), keys AS MATERIALIZED (
  SELECT DISTINCT doc_id, k, n, {_tax('vendor_gstin')} AS g, confidence, doc_type FROM docs, UNNEST([{_key('invoice_id')}, {_key('invoice_no_content')}]) AS t(n) WHERE n <> ''
), wanted AS (
  SELECT row, {_tax('gstin')} AS g, {_key('invoice_no')} AS n FROM return_clean
), exact_hits AS (
  SELECT row, doc_id, k.g, confidence FROM wanted w JOIN keys k ON w.n = k.n AND w.g = k.g WHERE w.g <> '' AND w.n <> '' AND doc_type = 'invoice'
), loose_hits AS (
  SELECT row, doc_id, k.g, confidence FROM wanted w JOIN keys k ON w.n = k.n WHERE w.n <> '' AND doc_type = 'invoice' AND row NOT IN (SELECT row FROM exact_hits)
), hits AS (
  SELECT DISTINCT * FROM exact_hits UNION SELECT DISTINCT * FROM loose_hits
), summed AS (
  SELECT row, count(*) AS copies, count(DISTINCT nullif(g, '')) AS ids, arg_max(doc_id, row(confidence, doc_id)) AS best, array_to_string(list_sort(list(doc_id)), ',') AS all_ids FROM hits GROUP BY row
), plan AS MATERIALIZED (
  SELECT r.*, coalesce(copies, 0) AS copies, CASE WHEN copies IS NULL THEN 'not_found' WHEN copies > 1 AND ids > 1 THEN 'ambiguous' ELSE 'matched' END AS status,
    CASE WHEN copies IS NOT NULL AND NOT (copies > 1 AND ids > 1) THEN best END AS doc_id, CASE WHEN copies > 1 THEN all_ids ELSE '' END AS candidates
  FROM return_clean r LEFT JOIN summed USING (row)
)"""

_DECIDED = f"""{_PLAN}, bound AS (
  SELECT k + 2 AS row, doc_id AS bound_doc FROM docs WHERE k % 27 = 5
), forced AS (
  SELECT p.* EXCLUDE (status, doc_id), CASE WHEN d.doc_id IS NOT NULL THEN 'matched' ELSE status END AS status, coalesce(d.doc_id, p.doc_id) AS doc_id, d.doc_id IS NOT NULL AS manual
  FROM plan p LEFT JOIN bound b ON p.row = b.row LEFT JOIN docs d ON d.doc_id = b.bound_doc AND d.doc_type = 'invoice'
), looked AS (
  SELECT * EXCLUDE (status), CASE WHEN status IN ('not_found', 'ambiguous') AND (row - 2) % 22 = 3 AND row - 2 IN (SELECT k FROM docs) THEN 'manual_not_found' ELSE status END AS status FROM forced
), final AS (
  SELECT * EXCLUDE (status), CASE WHEN status IN ('not_found', 'ambiguous') AND lower(supplier) IN (SELECT 'cobalt stores ' || CAST(k % 97 AS VARCHAR) FROM docs WHERE k % 500 = 4) THEN 'skipped' ELSE status END AS status FROM looked
)"""



def _resolved(name: str, rows: str, pool: str) -> str:
    """CTEs that end in ``name``: row, copies, ids, best of the rows of ``rows`` among the keys of ``pool``."""
    return f"""{name}_exact AS (
  SELECT row, doc_id, p.g, confidence FROM {rows} w JOIN {pool} p ON w.n = p.n AND w.g = p.g WHERE w.g <> '' AND w.n <> ''
), {name}_hits AS (
  SELECT * FROM {name}_exact UNION SELECT row, doc_id, p.g, confidence FROM {rows} w JOIN {pool} p ON w.n = p.n WHERE w.n <> '' AND row NOT IN (SELECT row FROM {name}_exact)
), {name} AS (
  SELECT row, count(*) AS copies, count(DISTINCT nullif(g, '')) AS ids, arg_max(doc_id, row(confidence, doc_id)) AS best FROM {name}_hits GROUP BY row
)"""


_BACKFILL = f"""{_PLAN}, current AS (
  SELECT * FROM keys WHERE doc_type = 'invoice' AND k % 6 <> 0
), {_resolved('now', 'wanted', 'current')}, lost AS (
  SELECT * FROM wanted WHERE row % 2 = 0 AND row NOT IN (SELECT row FROM now WHERE NOT (copies > 1 AND ids > 1))
), {_resolved('again', 'lost', 'keys')}
SELECT a.row, best AS doc_id, k % 6 = 0 OR doc_type <> 'invoice' AS promote FROM again a JOIN docs ON best = docs.doc_id WHERE NOT (a.copies > 1 AND a.ids > 1)"""
_CANON = """, tallied AS (
  SELECT vendor_gstin, company, count(*) AS n, min(path) AS first_path FROM docs WHERE doc_type = 'invoice' AND vendor_gstin IS NOT NULL AND company IS NOT NULL GROUP BY ALL
), canon AS (
  SELECT vendor_gstin, company AS canonical FROM tallied QUALIFY row_number() OVER (PARTITION BY vendor_gstin ORDER BY n DESC, first_path) = 1
)"""
_PAIR = f"""{_CANON}, pairs AS (
  SELECT DISTINCT t.vendor_gstin, t.company AS folder, canonical, {_name('t.company')} AS p, {_name('canonical')} AS q FROM tallied t JOIN canon USING (vendor_gstin)
), pairs2 AS (SELECT *, list_intersect(list_distinct(string_split(p, ' ')), list_distinct(string_split(q, ' '))) AS j FROM pairs
), pairs3 AS (SELECT *, array_to_string(list_sort(j), ' ') AS c, array_to_string(list_sort(list_filter(list_distinct(string_split(p, ' ')), lambda w: NOT list_contains(j, w))), ' ') AS u,
    array_to_string(list_sort(list_filter(list_distinct(string_split(q, ' ')), lambda w: NOT list_contains(j, w))), ' ') AS v FROM pairs2
), variants AS (
  SELECT *, CASE WHEN p = '' OR q = '' THEN 0.0::DOUBLE WHEN p = q OR (len(j) > 0 AND (u = '' OR v = '')) THEN 100.0::DOUBLE
      ELSE greatest(100.0::DOUBLE * (1.0::DOUBLE - (length(u) + length(v) - 2 * {_lcs('u', 'v')}) / (2 * length(c) + CASE WHEN len(j) > 0 THEN 2 ELSE 0 END + length(u) + length(v))::DOUBLE),
        CASE WHEN len(j) > 0 THEN 200.0::DOUBLE * length(c) / (2 * length(c) + 1 + length(u)) ELSE 0.0::DOUBLE END, CASE WHEN len(j) > 0 THEN 200.0::DOUBLE * length(c) / (2 * length(c) + 1 + length(v)) ELSE 0.0::DOUBLE END) END < 70 AS variant
  FROM pairs3
), copied AS (
  SELECT invoice_id AS dup_id, count(*) AS copies, array_to_string(list(filename ORDER BY path), '|') AS names FROM docs WHERE doc_type = 'invoice' AND invoice_id IS NOT NULL GROUP BY invoice_id HAVING count(*) > 1
), whole AS (
  SELECT d.*, canonical, coalesce(w.variant, false) AND doc_type = 'invoice' AS variant, CASE WHEN doc_type = 'invoice' AND dup_id IS NOT NULL THEN true ELSE false END AS doubled
  FROM docs d LEFT JOIN variants w ON d.vendor_gstin = w.vendor_gstin AND d.company = w.folder LEFT JOIN copied ON d.invoice_id = dup_id
), flagged AS (
  SELECT *, list_filter(flags || [CASE WHEN variant THEN 'vendor_folder_variant' END, CASE WHEN doubled THEN 'duplicate_id' END], lambda f: f IS NOT NULL) AS all_flags FROM whole
)"""

_MASTER = {
    "invoice_date": "coalesce(invoice_date, invoice_date_raw, '')", "reviewed": "''", "flags": "array_to_string(all_flags, '; ')", "rel_path": "substr(path, 7)", "file_path": "path",
    "link_status": "'unknown'", "gstr_row": "''", "gstr_ref": "''", "confidence": "CAST(confidence AS VARCHAR)",
}


def _master(column: str) -> str:
    return _MASTER.get(column) or f"coalesce(CAST({column} AS VARCHAR), '')"


_HAY = "trim(regexp_replace(lower(concat_ws(' ', array_to_string(parts, ' '), company, month, date_folder, fy, invoice_id, invoice_no_content, vendor_name_pdf, vendor_gstin)), '[^a-z0-9]+', ' ', 'g'))"
_POSTS = f"{_DOCS}, hays AS (SELECT doc_id, doc_type, {_HAY} AS hay FROM docs), posts AS (SELECT DISTINCT doc_id, t.token FROM hays, UNNEST(string_split(hay, ' ')) AS t(token) WHERE t.token <> ''), vocab AS (SELECT DISTINCT token FROM posts)"


def _search() -> str:
    words = ", ".join(f"({i}, '{w}')" for i, w in enumerate(_QUERY))
    window = "substr(long, greatest(i, 1)::BIGINT, (least(i + length(short) - 1, length(long)) - greatest(i, 1) + 1)::BIGINT)"
    best = f"list_max(list_transform(list_distinct(list_transform(range(2 - length(short), length(long) + 1), lambda i: {window})), lambda z: {_ratio('short', 'z')}))"
    return f"""{_POSTS}, words AS (SELECT * FROM (VALUES {words}) AS v(pos, w)), met AS (
      SELECT pos, w, token, CASE WHEN length(w) <= length(token) THEN w ELSE token END AS short, CASE WHEN length(w) <= length(token) THEN token ELSE w END AS long FROM words, vocab
    ), rated AS (SELECT *, {_ratio('short', 'long')} AS whole FROM met
    ), scored_words AS (SELECT pos, token, greatest(CASE WHEN whole >= 75 THEN whole ELSE 0 END, CASE WHEN {best} >= 75 THEN {best} * 0.95::DOUBLE ELSE 0 END) AS s FROM rated
    ), per AS (SELECT doc_id, pos, max(s) AS s FROM scored_words JOIN posts USING (token) WHERE s > 0 GROUP BY ALL
    ), means AS (SELECT doc_id, sum(s) / {len(_QUERY)} AS mean FROM per GROUP BY doc_id HAVING sum(s) / {len(_QUERY)} >= 62)
    SELECT doc_id, round(CASE WHEN contains(hay, '{" ".join(_QUERY)}') THEN least(100, mean + 12) ELSE mean END, 1) AS score, doc_type FROM means JOIN hays USING (doc_id)"""


_FOLDERS = f"""{_PLAN}, wanted_names AS MATERIALIZED (SELECT DISTINCT supplier, {_name('supplier')} AS a FROM return_clean), folder_names AS MATERIALIZED (SELECT DISTINCT company AS name, {_name('company')} AS b FROM docs WHERE company IS NOT NULL
), met AS (SELECT a, b, string_split(a, ' ') AS aw, string_split(b, ' ') AS bw, list_intersect(string_split(a, ' '), string_split(b, ' ')) AS j FROM (SELECT DISTINCT a FROM wanted_names WHERE a <> ''), (SELECT DISTINCT b FROM folder_names WHERE b <> '')
), rests AS (SELECT a, b, length(array_to_string(j, ' ')) + CASE WHEN len(j) > 0 THEN 1 ELSE 0 END AS n, array_to_string(list_sort(list_filter(list_distinct(aw), lambda w: NOT list_contains(j, w))), ' ') AS u, array_to_string(list_sort(list_filter(list_distinct(bw), lambda w: NOT list_contains(j, w))), ' ') AS v FROM met
), likely AS (SELECT * FROM rests WHERE (n > 0 AND (u = '' OR v = '')) OR 100.0::DOUBLE * (1 - (length(u) + length(v) - 2 * least(length(u), length(v)))::DOUBLE / (2 * n + length(u) + length(v))) >= 70 OR n::DOUBLE / (2 * n + least(length(u), length(v))) >= 0.35
), likened_names AS (SELECT a, b, CASE WHEN n > 0 AND (u = '' OR v = '') THEN 100.0::DOUBLE ELSE greatest(100.0::DOUBLE * (1.0::DOUBLE - (length(u) + length(v) - 2 * {_lcs('u', 'v')}) / (2 * n + length(u) + length(v))::DOUBLE),
    CASE WHEN n > 0 THEN 200.0::DOUBLE * (n - 1) / (2 * n - 1 + length(u)) ELSE 0 END, CASE WHEN n > 0 THEN 200.0::DOUBLE * (n - 1) / (2 * n - 1 + length(v)) ELSE 0 END) END AS s FROM likely
)
SELECT supplier, row_number() OVER (PARTITION BY supplier ORDER BY round(s, 1) DESC, lower(name), name)::INTEGER AS place, name, round(s, 1) AS score
FROM likened_names JOIN wanted_names USING (a) JOIN folder_names USING (b) WHERE s >= 70 QUALIFY place <= 3"""
_FIELDS = "invoice_no_content, vendor_name_pdf, vendor_gstin, bill_to_gstin, bill_to_name, invoice_date_raw, invoice_date, taxable_value, total_value"
_NAMED = f"SELECT row, {_REF} AS name FROM"
_CELLS = f"""numbered AS (
  SELECT row, status, candidates, existing_ref, {_REF} AS base, row_number() OVER (PARTITION BY status = 'matched', {_REF} ORDER BY row) - 1 AS nth FROM plan
), cells AS (
  SELECT row, status, CASE WHEN status = 'matched' THEN substr(base, 1, length(base) - 4) || repeat('-dup', nth) || '.pdf' END AS name,
    nullif(existing_ref, '') AS kept, candidates FROM numbered
)"""

ORACLES = {
    "classify_docs": f"{_DOCS} SELECT k, doc_type, round(score, 2) AS classify_score, reasons FROM docs",
    "parse_fields": f"{_DOCS} SELECT k, invoice_id, {_FIELDS}, got, missing FROM docs WHERE doc_type = 'invoice' AND layouts = ''",
    "vendor_override": f"{_DOCS} SELECT k, layouts, invoice_no_content, invoice_date_raw, invoice_date, taxable_value, total_value FROM docs WHERE layouts <> ''",
    "path_labels": f"{_DOCS} SELECT k, bank, fy, month, date_folder, company, unmatched, array_to_string(list_filter(flags, lambda f: f IN ('no_company_folder', 'path_incomplete')), '; ') AS flags FROM docs",
    "confidence": f"{_DOCS} SELECT k, confidence, list_contains(flags, 'low_confidence') AS low FROM docs WHERE doc_type = 'invoice'",
    "vendor_similarity": f"{_DOCS} SELECT DISTINCT company, vendor_name_pdf AS vendor, a, b, round(name_score, 6) AS score FROM docs WHERE company IS NOT NULL AND vendor_name_pdf IS NOT NULL",
    "reconcile_flags": f"{_DOCS} SELECT k, round(company_score, 6) AS company_score, array_to_string(flags, '; ') AS flags FROM docs WHERE doc_type = 'invoice'",
    "doc_summary": f"""{_DOCS} SELECT count(*) AS total_pdfs, count_if(doc_type = 'invoice')::BIGINT AS invoices, count_if(len(flags) > 0)::BIGINT AS flagged, 0::BIGINT AS reviewed, count_if(source = 'ocr')::BIGINT AS ocr_docs,
        round(count_if(source = 'ocr')::DOUBLE / count(*), 3) AS ocr_ratio, round(sum(CASE WHEN doc_type = 'invoice' THEN confidence::DECIMAL(18,3) END)::DOUBLE / count_if(doc_type = 'invoice'), 3) AS avg_invoice_confidence FROM docs""",
    "doc_types": f"{_DOCS} SELECT doc_type, count(*) AS n FROM docs GROUP BY doc_type",
    "canonical_vendor": f"{_DOCS}{_PAIR} SELECT k, w.vendor_gstin, c.canonical, variant FROM whole w LEFT JOIN canon c ON w.vendor_gstin = c.vendor_gstin WHERE doc_type = 'invoice'",
    "duplicate_ids": f"{_DOCS}{_PAIR} SELECT dup_id AS invoice_id, copies, names FROM copied",
    "master_sheet": f"{_DOCS}{_PAIR} SELECT {', '.join(f'{_master(c)} AS {c}' for c in MASTER_COLUMNS)}, len(all_flags) > 0 AS highlight FROM flagged WHERE doc_type = 'invoice'",
    "exceptions_sheet": f"{_DOCS}{_PAIR} SELECT substr(path, 7) AS rel_path, doc_type, array_to_string(all_flags, '; ') AS flags, confidence, coalesce(company, '') AS company_folder FROM flagged WHERE len(all_flags) > 0 OR doc_type NOT IN ('invoice', 'approval')",
    "match_index": f"{_PLAN} SELECT doc_id, n AS number, g AS gstin FROM keys WHERE doc_type = 'invoice'",
    "match_rows": f"{_PLAN} SELECT row, status, doc_id, candidates FROM plan",
    "match_counts": f"""{_PLAN} SELECT count(*) AS total, {", ".join(f"count_if(status = '{s}')::BIGINT AS {s}" for s in ("matched", "not_found", "ambiguous", "skipped", "manual_not_found"))},
        count_if(status = 'matched' AND copies > 1)::BIGINT AS duplicate_filings, (SELECT count(*) FROM docs WHERE doc_type = 'invoice' AND doc_id NOT IN (SELECT doc_id FROM plan WHERE doc_id IS NOT NULL)) AS unreferenced FROM plan""",
    "match_manual": f"{_DECIDED} SELECT row, status, doc_id, manual FROM forced",
    "match_skips": f"{_DECIDED} SELECT status, count(*) AS n, sum(row)::BIGINT AS rows FROM final GROUP BY status",
    "unreferenced": f"{_PLAN} SELECT doc_id FROM docs WHERE doc_type = 'invoice' AND doc_id NOT IN (SELECT doc_id FROM plan WHERE doc_id IS NOT NULL)",
    "stamp_links": f"""{_PLAN}, last_rows AS (SELECT doc_id, row, {_REF} AS ref FROM plan WHERE doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY row DESC) = 1
        ), unclear AS (SELECT DISTINCT t.d AS doc_id FROM plan, UNNEST(string_split(candidates, ',')) AS t(d) WHERE status = 'ambiguous')
        SELECT i.doc_id, CASE WHEN l.row IS NOT NULL THEN 'matched' WHEN u.doc_id IS NOT NULL THEN 'ambiguous' ELSE 'unreferenced' END AS link_status, l.row AS gstr_row, l.ref AS gstr_ref
        FROM docs i LEFT JOIN last_rows l USING (doc_id) LEFT JOIN unclear u ON u.doc_id = i.doc_id WHERE doc_type = 'invoice'""",
    # The edit distance bounds a score from below and the letters in common from above; only what these leave open is worked out.
    "suggest_topk": f"""{_PLAN}, lost AS MATERIALIZED (SELECT row, {_tax('gstin')} AS g, {_key('invoice_no')} AS n FROM plan WHERE status = 'not_found'
        ), own AS MATERIALIZED (SELECT doc_id, {_tax('vendor_gstin')} AS dg, {_key('invoice_id')} AS n1, {_key('invoice_no_content')} AS n2 FROM docs WHERE doc_type = 'invoice' AND coalesce(invoice_id, invoice_no_content, vendor_gstin) IS NOT NULL
        ), owned AS MATERIALIZED (SELECT doc_id, dg, n1 AS m, true AS one FROM own UNION ALL SELECT doc_id, dg, n2, false FROM own WHERE n2 <> n1
        ), spelled AS MATERIALIZED (SELECT *, {_spelled('m', 'd_')} FROM owned), asked AS MATERIALIZED (SELECT *, {_spelled('n', 'r_')} FROM lost
        ), bounds AS MATERIALIZED (SELECT row, doc_id, n, m, one, CASE WHEN g <> '' AND g = dg THEN 25 ELSE 0 END AS extra, CASE WHEN m = '' THEN 0 ELSE 150.0::DOUBLE * ({" + ".join(f"least(r_{c}, d_{c})" for c in _LETTERS)}) / (length(n) + length(m)) END AS most,
            CASE WHEN m = '' OR NOT one THEN 0 ELSE 75 * greatest(0, 1 - 2 * levenshtein(n, m)::DOUBLE / (length(n) + length(m))) END AS low FROM asked, spelled
        ), fifth AS (SELECT row, list_min(max(low + extra, 5)) AS least FROM bounds WHERE one GROUP BY row
        ), near AS (SELECT b.* FROM bounds b JOIN fifth USING (row) WHERE most + extra >= least - 0.2
        ), points AS (SELECT row, doc_id, round(max(0.75::DOUBLE * CASE WHEN m = '' THEN 0 ELSE {_ratio('n', 'm')} END + extra), 1) AS score FROM near GROUP BY row, doc_id)
        SELECT row, row_number() OVER (PARTITION BY row ORDER BY score DESC, doc_id)::INTEGER AS place, doc_id, score FROM points WHERE score > 0 QUALIFY place <= 5""",
    "unmatched_by_supplier": f"{_PLAN} SELECT supplier, count(*) AS rows FROM plan WHERE status IN ('not_found', 'ambiguous') GROUP BY supplier",
    "row_candidates": f"{_PLAN} SELECT row, t.d AS doc_id, filename, path, NULL::DOUBLE AS score FROM plan, UNNEST(string_split(candidates, ',')) AS t(d) JOIN docs ON docs.doc_id = t.d WHERE status = 'ambiguous'",
    "ref_names": f"WITH {ROWS.format(**_FIXTURE)} SELECT row, name, row_number() OVER (PARTITION BY name ORDER BY row) - 1 AS nth FROM ({_NAMED} return_rows)",
    "link_cells": f"{_PLAN}, {_CELLS} SELECT row, coalesce(name, kept, CASE WHEN status = 'ambiguous' THEN 'AMBIGUOUS (' || CAST(len(string_split(candidates, ',')) AS VARCHAR) || ')' ELSE 'NOT FOUND' END) AS cell, name FROM cells",
    "link_report": f"""{_PLAN}, one AS (SELECT count(*) AS b2b_rows, count_if(status = 'matched') AS matched, count_if(status = 'not_found') AS not_found, count_if(status = 'ambiguous') AS ambiguous, 0 AS skipped, 0 AS reviewer_confirmed_not_found, 0 AS copy_failed,
        count_if(status = 'matched' AND copies > 1) AS duplicate_filings, (SELECT count(*) FROM docs WHERE doc_type = 'invoice' AND doc_id NOT IN (SELECT doc_id FROM plan WHERE doc_id IS NOT NULL)) AS detected_invoices_unreferenced FROM plan)
        SELECT name AS metric, value::BIGINT AS value FROM (UNPIVOT (SELECT {", ".join(f"{c}::BIGINT AS {c}" for c in ("b2b_rows", "matched", "not_found", "ambiguous", "skipped", "reviewer_confirmed_not_found", "copy_failed", "duplicate_filings", "detected_invoices_unreferenced"))} FROM one) ON *)""",
    "backfill": _BACKFILL,
    "postings": f"{_POSTS} SELECT token, count(*) AS docs FROM posts GROUP BY token",
    "token_search": _search(),
    "grep_docs": f"{_DOCS} SELECT k, filename FROM docs WHERE contains(lower(array_to_string(parts, ' ') || ' ' || text), 'tax') AND contains(lower(array_to_string(parts, ' ') || ' ' || text), '00012') AND contains(lower(array_to_string(parts, ' ') || ' ' || text), 'pune')",
    "browse_level": f"{_DOCS} SELECT parts[1] AS name, count(*) AS pdfs, count_if(doc_type = 'invoice')::BIGINT AS invoices FROM docs GROUP BY 1",
    "browse_prefix": f"{_DOCS} SELECT parts[4] AS name, count(*) AS pdfs, count_if(doc_type = 'invoice')::BIGINT AS invoices FROM docs WHERE parts[1:3] = ['FY 95-96', 'Payments', 'Kotak'] AND len(parts) > 4 GROUP BY 1",
    "browse_files": f"{_DOCS} SELECT k, filename FROM docs WHERE parts[1:3] = ['FY 95-96', 'Payments', 'Kotak']",
    "tallies": f"""{_DOCS} SELECT count(*) AS pdfs, count_if(doc_type = 'invoice')::BIGINT AS invoices, count_if(doc_type = 'approval')::BIGINT AS approvals, count_if(source = 'ocr')::BIGINT AS ocr, count_if(len(flags) > 0)::BIGINT AS flagged, 0::BIGINT AS errors FROM docs""",
    "picker_hits": f"""{_DOCS} SELECT doc_id AS id, filename, array_to_string(folders, '/') AS folder, array_to_string(parts, '/') AS rel, invoice_id, vendor_gstin AS gstin, vendor_name_pdf AS vendor, invoice_date AS date, total_value AS amount, company,
        doc_type = 'invoice' AS is_invoice, doc_type, false AS hidden FROM docs""",
    "report_not_found": f"{_PLAN} SELECT row, gstin, invoice_no FROM plan WHERE status = 'not_found'",
    "report_ambiguous": f"{_PLAN} SELECT row, gstin, invoice_no, len(string_split(candidates, ',')) AS candidates FROM plan WHERE status = 'ambiguous'",
    "report_skipped": f"{_DECIDED} SELECT row, gstin, invoice_no, supplier FROM final WHERE status = 'skipped'",
    "report_manual_not_found": f"{_DECIDED} SELECT row, gstin, invoice_no, supplier FROM final WHERE status = 'manual_not_found'",
    "search_top": f"SELECT *, row_number() OVER (ORDER BY score DESC, doc_type <> 'invoice', doc_id) AS place FROM ({_search()}) QUALIFY place <= 20",
    "browse_deep": f"{_DOCS} SELECT parts[4] AS name, count(*) AS pdfs, count_if(doc_type = 'invoice')::BIGINT AS invoices FROM docs WHERE len(parts) > 4 GROUP BY 1",
    "folder_suggest": _FOLDERS,
    "ledger_lww": "SELECT user_id AS source_key, arg_max(event_id, event_id) AS seq, arg_max(event_type, event_id) AS event_type, min(event_id) AS position FROM events GROUP BY user_id",
    "ledger_overlay": f"WITH {DOCS.format(**_FIXTURE)} SELECT k, path AS source_key, CASE WHEN k % 3 = 0 THEN 'snapshot' ELSE 'ledger' END AS origin FROM inv_docs WHERE k % 3 = 0 OR k % 2 = 0",
    "resume_skip": f"WITH {DOCS.format(**_FIXTURE)} SELECT k, path AS source_key FROM inv_docs WHERE k % 3 <> 0",
    "ocr_lines": """WITH words AS (SELECT l_orderkey AS page, l_linenumber AS block, l_suppkey % 2 AS par, l_partkey % 3 AS line, l_partkey * 1000 + CAST(l_quantity AS BIGINT) AS pos,
        l_returnflag || CAST(l_partkey AS VARCHAR) AS word, CASE WHEN l_suppkey % 4 = 0 THEN -1.0 ELSE l_quantity END AS conf FROM lineitem WHERE l_partkey % 5 <> 0
        ), lines AS (SELECT page, block, par, line, min(pos) AS first_pos, string_agg(word, ' ' ORDER BY pos, word) AS text, sum(CASE WHEN conf >= 0 THEN conf END) AS total, count_if(conf >= 0) AS n FROM words GROUP BY ALL)
        SELECT page, string_agg(text, chr(10) ORDER BY first_pos, text) AS text, coalesce(round(sum(total) / nullif(sum(n), 0), 6), 0) AS confidence FROM lines GROUP BY page""",
    "bindings": f"""{_DECIDED}, own AS (SELECT row::INTEGER AS row, 'bound' AS kind, bound_doc AS doc_id FROM bound UNION ALL SELECT (k + 2)::INTEGER, 'missing', NULL FROM docs WHERE k % 22 = 3)
        SELECT o.row, kind, o.doc_id, coalesce(CASE WHEN kind = 'bound' THEN status = 'matched' AND f.doc_id = o.doc_id ELSE status = 'manual_not_found' END, false) AS effective FROM own o LEFT JOIN final f USING (row)""",
    "decisions_overlay": f"""{_DOCS} SELECT k, CASE WHEN k % 27 = 5 AND doc_type <> 'invoice' THEN 'invoice' ELSE doc_type END AS doc_type,
        (k % 27 = 5 AND doc_type <> 'invoice') OR (k % 103 = 9 AND len(flags) > 0) AS reviewed, k % 101 = 7 AS hidden FROM docs""",
    "next_unresolved": f"{_PLAN}, todo AS (SELECT row FROM plan WHERE status IN ('not_found', 'ambiguous')) SELECT row, coalesce(lead(row) OVER (ORDER BY row), min(row) OVER ()) AS next_row FROM todo",
    "stable_ids": f"WITH {DOCS.format(**_FIXTURE)} SELECT k, 'd' || substr(sha1('local:' || path), 1, 10) AS doc_id FROM inv_docs",
    "running_tally": "SELECT event_type AS kind, count(*) AS n, sum(value::DECIMAL(18,4))::DOUBLE AS total FROM events GROUP BY event_type",
}
