"""Finding documents: ranked search over paths and fields, listing with full-text filter, and browsing the tree."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docrecon.functions.fuzzy import lcs, name_score_of, name_scores, partial_ratio, ratio
from docrecon.functions.norm import company_name, search_key
from docrecon.operators.nearest import nearest_numbers
from docrecon.settings import FOLDER_CUTOFF, LITERAL_BONUS, PARTIAL_SHADE, SEARCH_CUTOFF, SHORT_TOKEN, TOKEN_CUTOFF
from docrecon.sources.shared import snapshot

#: Words of a name up to which all sets of them are looked at, and floors of likeness in a search for names.
WORDS, NAME_LADDER = 6, ((88, 2), (78, 2), (70, 2))


#: Labels and parsed fields that ranked search looks at.
FIELDS = ("company", "month", "date_folder", "fy", "invoice_id", "invoice_no_content", "vendor_name_pdf", "vendor_gstin")


def haystack() -> Column:
    """What ranked search looks at: the path below the root, then labels and parsed fields."""
    fields = [F.when(F.col(c) != "", F.col(c)) for c in FIELDS]
    return search_key(F.concat_ws(" ", F.array_join("rel_parts", " "), *fields))


def postings(docs: DataFrame) -> DataFrame:
    """token, doc_id: distinct words of each document's haystack."""
    return docs.select("doc_id", F.explode(F.array_distinct(F.split(haystack(), " "))).alias("token")).filter("token != ''")


def vocabulary(docs: DataFrame) -> DataFrame:
    """token, docs: how many ids hold each token; documents that share an id are one."""
    return postings(docs).distinct().groupBy("token").agg(F.count("*").alias("docs"))


def _letters_of(word: str, token: Column) -> Column:
    """How many of the token's letters stand somewhere in the word."""
    return F.length(token) - F.length(F.translate(token, "".join(sorted(set(word))), ""))


def may_answer(words: Sequence[str], token: Column) -> Column:
    """Whether a token can answer one of the words at all, by the tests that ``token_scores`` makes before any similarity."""
    able = F.lit(False)
    for word in words:
        letters, size = _letters_of(word, token), F.length(token)
        near = F.least(letters, size, F.lit(len(word))) * 2 >= 0.75 * (size + len(word))
        able = able | (token == word if len(word) <= SHORT_TOKEN else near | (letters * 10 >= F.least(size, F.lit(len(word))) * 6))
    return able


def token_scores(words: Sequence[str], posts: DataFrame) -> DataFrame:
    """pos, token, s: how well each distinct token of the postings answers each query word.

    The words are a handful of literals and the vocabulary is scanned once. A ratio of 75 needs the shorter length to be
    0.6 of the longer, and no subsequence is longer than the letters that the word has too; both are tested before any
    similarity is taken, so that most of a vocabulary of serial numbers costs no more than these tests.
    """
    tokens = posts.select("token").distinct()
    found = None
    for pos, word in enumerate(words):
        w, t = F.lit(word), F.col("token")
        if len(word) <= SHORT_TOKEN:
            hit = tokens.filter(t == word).select(F.lit(pos).alias("pos"), "token", F.lit(100.0).alias("s"))
        else:
            letters = _letters_of(word, t)
            near = F.least(letters, F.length(t), F.lit(len(word))) * 2 >= 0.75 * (F.length(t) + len(word))
            whole = F.when(near, ratio(w, t)).otherwise(0.0)
            # No window does better than 2L / (m + L), L being the common subsequence of the whole and m the shorter length.
            shorter = F.least(F.length(t), F.lit(len(word)))
            part = F.when(letters * 10 < shorter * 6, 0.0).when(lcs(w, t) * 10 >= shorter * 6, partial_ratio(w, t)).otherwise(0.0)
            best = F.greatest(F.when(whole >= TOKEN_CUTOFF, whole).otherwise(0.0), F.when(part >= TOKEN_CUTOFF, part * PARTIAL_SHADE).otherwise(0.0))
            hit = tokens.select(F.lit(pos).alias("pos"), "token", best.alias("s")).filter("s > 0")
        found = hit if found is None else found.unionByName(hit)
    return found


def query_words(query: str) -> tuple[str, list[str]]:
    """A query normalised as what it is held against, and its words."""
    key = re.sub("[^a-z0-9]+", " ", query.lower()).strip()
    return key, key.split()


def searched(docs: DataFrame, invoices_only: bool, include_hidden: bool) -> DataFrame:
    """The documents that a search looks at."""
    pool = docs.filter("doc_type = 'invoice'") if invoices_only else docs
    return pool if include_hidden else pool.filter("NOT hidden")


def ranked(pool: DataFrame, key: str, means: DataFrame, limit: int | None) -> DataFrame:
    """doc_id, score, doc_type of the documents whose mean (doc_id, mean) is high enough, best first."""
    hits = means.filter(F.col("mean") >= SEARCH_CUTOFF).join(pool.select("doc_id", "doc_type", haystack().alias("hay")), "doc_id")
    score = F.when(F.contains("hay", F.lit(key)), F.least(F.lit(100.0), F.col("mean") + LITERAL_BONUS)).otherwise(F.col("mean"))
    out = hits.select("doc_id", F.round(score, 1).alias("score"), "doc_type").orderBy(F.desc("score"), F.col("doc_type") != "invoice", "doc_id")
    return out.limit(limit) if limit is not None else out


def search(docs: DataFrame, query: str, limit: int | None = 20, invoices_only: bool = False, include_hidden: bool = False) -> DataFrame:
    """doc_id, score, doc_type: documents by the mean of how well they answer each word of the query, best first."""
    key, words = query_words(query)
    if not words:
        return docs.select("doc_id", F.lit(0.0).alias("score"), "doc_type").limit(0)
    pool = searched(docs, invoices_only, include_hidden)
    posts = postings(pool).filter(may_answer(words, F.col("token")))  # the others are most of them and aren't moved
    per_word = token_scores(words, posts).join(posts, "token").groupBy("doc_id", "pos").agg(F.max("s").alias("s"))
    return ranked(pool, key, per_word.groupBy("doc_id").agg((F.sum("s") / len(words)).alias("mean")), limit)


def grep(docs: DataFrame, query: str, include_hidden: bool = False) -> DataFrame:
    """Documents whose path or text holds every word of the query."""
    hay = F.lower(F.concat_ws(" ", F.array_join("rel_parts", " "), F.coalesce("text", F.lit(""))))
    out = docs if include_hidden else docs.filter("NOT hidden")
    for word in query.lower().split():
        out = out.filter(F.contains(hay, F.lit(word)))
    return out


def flat(docs: DataFrame, query: str = "", page: int = 1, page_size: int = 50, include_hidden: bool = False) -> tuple[DataFrame, dict]:
    """One page of the documents that ``grep`` finds, in order of their paths, and total, page and pages."""
    found = grep(docs, query, include_hidden)
    total, size = found.count(), max(1, page_size)
    pages = -(-total // size)
    page = min(max(1, page), max(1, pages))
    rows = found.orderBy(F.lower(F.array_join("rel_parts", "/")), "doc_id").offset((page - 1) * size).limit(size)
    return rows, {"total": total, "page": page, "pages": pages, "page_size": size}


def _under(docs: DataFrame, prefix: Sequence[str], include_hidden: bool) -> DataFrame:
    own = [p for p in prefix if p]
    out = docs if include_hidden else docs.filter("NOT hidden")
    return out.filter(F.slice("rel_parts", 1, len(own)) == F.array(*map(F.lit, own))) if own else out


def browse_folders(docs: DataFrame, prefix: Sequence[str] = (), include_hidden: bool = False) -> DataFrame:
    """name, pdfs, invoices of each folder under ``prefix``, with all that lies anywhere below it."""
    depth = len([p for p in prefix if p])
    deep = _under(docs, prefix, include_hidden).filter(F.size("rel_parts") > depth + 1)
    return deep.groupBy(F.element_at("rel_parts", depth + 1).alias("name")).agg(F.count("*").alias("pdfs"), F.count_if(F.col("doc_type") == "invoice").alias("invoices")).orderBy(F.lower("name"), "name")


def browse_files(docs: DataFrame, prefix: Sequence[str] = (), include_hidden: bool = False) -> DataFrame:
    """Documents that lie directly under ``prefix``, by file name."""
    depth = len([p for p in prefix if p])
    return _under(docs, prefix, include_hidden).filter(F.size("rel_parts") <= depth + 1).orderBy(F.lower("filename"), "doc_id")


def name_words(c: Column) -> Column:
    """The distinct words of a company's normalised name in order; names of the same words score alike."""
    return F.array_sort(F.array_distinct(F.filter(F.split(company_name(c), " "), lambda w: w != "")))


def folder_scores(suppliers: DataFrame, folders: DataFrame, limit: int | None = 3) -> DataFrame:
    """supplier, place, name, score: of each supplier the folders whose names are alike enough, best first, ``limit`` of them.

    A score is the best of three, and each has its way to the pairs that can have it. Likeness of the letters is found as
    that of numbers is. A supplier that consists for the most part of the words that it shares scores alike with all
    folders that hold these words, so the first of them stand for all; and of the folders that consist of them for the
    most part those with the least beside stand for the others. Both meet under sets of words; names of more words than
    ``WORDS`` meet all that share a word with them.
    """
    most = limit if limit is not None else (1 << 31) - 1
    want = snapshot(suppliers.select("supplier", name_words(F.col("supplier")).alias("words")).filter("size(words) > 0").distinct().withColumn("_a", F.array_join("words", " ")), "suppliers")
    have = snapshot(folders.select("name", name_words(F.col("name")).alias("words")).filter("size(words) > 0").distinct().withColumn("_b", F.array_join("words", " ")), "folders")
    asked = want.groupBy("_a").agg(F.first("words").alias("words"))
    names = have.groupBy("_b").agg(F.first("words").alias("words"), F.min(F.lower("name")).alias("_first"))
    queries = asked.select(F.lit("").alias("scope"), F.col("_a").alias("n"), F.lit(0.0).alias("more"), F.lit(int(10 * FOLDER_CUTOFF)).cast("long").alias("least"))
    items = names.select(F.lit("").alias("scope"), F.col("_b").alias("number"), F.col("_first").alias("first"))
    alike = nearest_numbers(queries, items, most, _name_tenths, 1.0, NAME_LADDER).select(F.col("n").alias("_a"), F.col("number").alias("_b"))
    pairs = snapshot(alike.unionByName(_by_words(asked, names, most)).distinct(), "name-pairs")
    scored = pairs.withColumn("score", name_scores(F.col("_a"), F.col("_b"))).filter(F.round("score", 9) >= FOLDER_CUTOFF)
    found = scored.withColumn("score", F.floor(F.col("score") * 10 + 0.5) / 10)
    if limit is not None:  # a normalised name has a folder at least
        best = Window.partitionBy("_a").orderBy(F.desc("score"), "_first", "_b")
        found = found.join(names.drop("words"), "_b").withColumn("_nth", F.row_number().over(best)).filter(F.col("_nth") <= limit).drop("_nth", "_first")
    each = found.join(want.drop("words"), "_a").join(have.drop("words"), "_b").select("supplier", "name", "score")
    placed = each.withColumn("place", F.row_number().over(Window.partitionBy("supplier").orderBy(F.desc("score"), F.lower("name"), "name")))
    return (placed.filter(F.col("place") <= limit) if limit is not None else placed).select("supplier", "place", "name", "score")


def _name_tenths(left: list[str], right: list[str], x: np.ndarray, y: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Scores of pairs of names in tenths, 0 below the cut-off."""
    pairs, where = np.unique(x * len(right) + y, return_inverse=True)
    scores = np.array([name_score_of(left[k // len(right)], right[k % len(right)]) for k in pairs.tolist()] or [0.0])
    return np.where(np.round(scores, 9) >= FOLDER_CUTOFF, np.floor(scores * 10 + 0.5), 0).astype(np.int64)[where.ravel()]


def _subsets(df: DataFrame) -> DataFrame:
    """``df`` with a row for each set of words of its names, as ``shared``, and ``beside``, the length of the other words."""
    step = lambda sets, w: F.concat(sets, F.transform(sets, lambda s: F.concat(s, F.array(w))))
    sets = F.aggregate("words", F.array(F.array().cast("array<string>")), step)
    each = df.filter(F.size("words") <= WORDS).withColumn("set", F.explode(sets)).filter("size(set) > 0")
    return each.withColumns({"shared": F.array_join("set", " "), "beside": F.length(F.array_join(F.array_except("words", "set"), " "))})


def _mostly(shared: Column, beside: Column) -> Column:
    """Whether the shared words make up a score by themselves: 200 n / (2 n + 1 + beside) at the cut-off, or nothing beside."""
    return (beside == 0) | (200 * F.length(shared) >= FOLDER_CUTOFF * (2 * F.length(shared) + 1 + beside))


def _by_words(asked: DataFrame, names: DataFrame, most: int) -> DataFrame:
    """_a, _b: pairs whose shared words alone may reach the cut-off; of those that score alike by them the first ``most``."""
    a, b = _subsets(asked).select("_a", "shared", "beside"), _subsets(names).select("_b", "_first", "shared", "beside")

    def leading(df: DataFrame, *order: str) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy("shared").orderBy(*order))
        return df.withColumn("_nth", nth).filter(F.col("_nth") <= most).select("shared", "_b")

    heavy = _mostly(F.col("shared"), F.col("beside"))
    found = a.filter(heavy).join(leading(b, "_first", "_b"), "shared").select("_a", "_b")
    found = found.unionByName(a.join(leading(b.filter(heavy), "beside", "_first", "_b"), "shared").select("_a", "_b"))
    long_ = F.size("words") > WORDS
    each = lambda df, c: df.select(c, F.explode("words").alias("word"))
    return found.unionByName(each(asked.filter(long_), "_a").join(each(names, "_b"), "word").select("_a", "_b")).unionByName(each(asked, "_a").join(each(names.filter(long_), "_b"), "word").select("_a", "_b"))


def suggest_folders(supplier: str, docs: DataFrame, limit: int = 3, prefix: Sequence[str] = ()) -> DataFrame:
    """The folders under ``prefix`` whose names are most like the supplier's."""
    one = docs.sparkSession.createDataFrame([(supplier,)], "supplier string")
    folders = browse_folders(docs, prefix)
    return folder_scores(one, folders.select("name"), limit).join(folders, "name").orderBy("place")
