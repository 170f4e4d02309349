"""Mixing sources to target weights by pivotal dependent rounding. DataFrame functions only.

A source that is to give ``target`` words of its ``source_size`` repeats each of its documents target / source_size
times: the whole part for all, and one more copy with the fractional part as probability. The extra copies are drawn by
the pivotal method: two documents with fractional probabilities move mass (probability times size) between them in a
random direction, odds set so that both expectations hold, until one of them is 0 or 1; the other meets the next. Mass
is conserved until the root, where the last open document of each source is rounded to the nearer side, so a source's
words end within half a document of its target. Groups of a bounded number of documents are rounded independently, the
one document that each leaves over goes up a level, and so on up the tree.

Edge cases: a null or empty text has size 0, so nothing is taken (it keeps its source's whole number of copies). Null is
a source of its own, last in the order. Rows that share a document id are drawn separately. A null document id is a
document like any other. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docrecon.llm.storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Documents rounded in one group, on average.
GROUP = 128
_UNIT = "struct<id:bigint,tie:bigint,nth:int,size:bigint,p:double>"


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """source, source_size, target of each source of ``sizes`` (source, source_size).

    Shares by weight stop at ``ceiling`` times the source's size and their excess goes to the others by weight. With
    the sources sorted by size over weight, those that stop are a prefix, and the level of the rest follows from sums
    over that prefix. One row a source; the sort is of that small table.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))).withColumn("w", w)
    by_level = Window.orderBy(F.col("source_size") / F.col("w"), "rank")
    upto = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = ranked.select(
        "*",
        (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("source_size").over(upto), F.lit(0)) * ceiling).alias("left"),
        F.sum("w").over(rest).alias("w_left"),
        (F.col("source_size") * ceiling).alias("cap"),
    ).withColumn("level", F.col("left") / F.col("w_left"))
    # The first source whose cap isn't reached fixes the level of all after it.
    stop = level.withColumn("fixed", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct((F.col("source_size") / F.col("w")).alias("at"), "rank", "level"))).over(whole))
    target = F.when(F.col("source_size") == 0, 0.0).when(F.col("fixed").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("fixed.level") * F.col("w")))
    return stop.select("source", "source_size", target.alias("target"))


def _uniform(*columns: Column) -> Column:
    """A reproducible number from 0 to below 1."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def _meet(state: Column, unit: Column, seed: int) -> Column:
    """The pivotal step: ``state`` has the fractional unit so far (``open``) and the units that are decided (``done``)."""
    a, b = state["open"], unit
    sa, sb = a["size"].cast("double"), b["size"].cast("double")
    u = _uniform(a["id"], a["tie"], a["nth"], b["id"], b["tie"], b["nth"], F.lit(seed))
    up = F.least((1 - a["p"]) * sa, b["p"] * sb)  # mass that can move from b to a
    down = F.least(a["p"] * sa, (1 - b["p"]) * sb)  # and from a to b
    moved = F.when(u * (up + down) < down, up).otherwise(-down)
    tidy = lambda p: F.when(p < 1e-9, 0.0).when(p > 1 - 1e-9, 1.0).otherwise(p)
    made = lambda x, p: F.struct(x["id"].alias("id"), x["tie"].alias("tie"), x["nth"].alias("nth"), x["size"].alias("size"), p.alias("p"))
    pair = F.array(made(a, tidy(a["p"] + moved / sa)), made(b, tidy(b["p"] - moved / sb)))
    pair_out = lambda x: (x["p"] == 0.0) | (x["p"] == 1.0)
    step = F.struct(
        F.element_at(F.concat(F.filter(pair, lambda x: ~pair_out(x)), F.array(F.lit(None).cast(_UNIT))), 1).alias("open"),
        F.concat(state["done"], F.filter(pair, pair_out)).alias("done"),
    )
    start = F.when(pair_out(unit), F.struct(F.lit(None).cast(_UNIT).alias("open"), F.concat(state["done"], F.array(unit)).alias("done"))).otherwise(F.struct(unit.alias("open"), state["done"].alias("done")))
    return F.when(a.isNull(), start).otherwise(step)


def _round_groups(units: DataFrame, groups: Column, seed: int) -> DataFrame:
    """Round the units of each source in ``groups`` groups: source, open (what is left over, or null), done."""
    key = F.pmod(F.xxhash64("id", "tie", "nth", F.lit(seed)), groups)
    gathered = units.withColumn("key", key).groupBy("source", "key").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("id", "tie", "nth", F.lit(seed + 1)).alias("h"), F.struct("id", "tie", "nth", "size", "p").alias("unit")))).alias("units"))
    start = F.struct(F.lit(None).cast(_UNIT).alias("open"), F.array().cast(f"array<{_UNIT}>").alias("done"))
    rounded = gathered.withColumn("r", F.aggregate("units", start, lambda s, x: _meet(s, x["unit"], seed)))
    return rounded.select("source", "r.open", "r.done")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0, group: int = GROUP, seed: int = 7) -> DataFrame:
    """doc_id, source, size, tie (a hash of the text), nth (which of equal rows), source_size, target, copies, taken of
    every row of ``docs``.

    Equal rows (doc_id, source, text) are counted before they are shuffled and told apart by ``nth``, so that groups
    are dealt by a hash that no hot key can fill. A group holds about ``group`` documents however large its source is.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64(F.col("text").cast("string")).alias("tie"))
    counted = materialize(rows.groupBy("doc_id", "source", "size", "tie").agg(F.count("*").alias("n")), "mix-rows")
    sources = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("source_docs"))
    sources = materialize(sources, "mix-sources")
    targets = source_targets(sources.select("source", "source_size"), weights, share, ceiling)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = materialize(targets.join(sources.select(F.col("source").alias("s"), "source_docs"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("rate", rate).withColumn("whole", F.floor("rate")).withColumn("p", F.col("rate") - F.col("whole")), "mix-targets")

    t = targets.withColumnRenamed("source", "t_source")
    units = counted.join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    units = units.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n")
    drawn = (F.col("size") > 0) & (F.col("p") > 1e-9) & (F.col("p") < 1 - 1e-9)
    level = units.filter(drawn).select("source", F.col("doc_id").alias("id"), "tie", "nth", "size", "p", F.ceil(F.col("source_docs") / group).alias("groups"))
    decided, last, n = [], False, 0
    most = targets.agg(F.max("source_docs")).first()[0] or 0
    while not last:
        last = most <= group
        rounded = materialize(_round_groups(level, F.col("groups") if not last else F.lit(1), seed + 2 * n).select("source", "open", "done"), f"mix-level-{n}")
        decided.append(rounded.select("source", F.inline("done")))
        level = rounded.filter(F.col("open").isNotNull()).select("source", "open.*")
        most, n = -(-most // group), n + 1
        if not last:  # as many units as there were groups
            g = F.ceil(F.col("source_docs") / float(group) ** (n + 1))
            level = level.join(targets.select(F.col("source").alias("s"), g.alias("groups")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # One unit a source is still open. Rounded to the nearer side it misses the target by half its size at most.
    decided.append(level.select("source", "id", "tie", "nth", "size", F.round("p").alias("p")))
    extra = decided[0]
    for more in decided[1:]:
        extra = extra.unionByName(more.select(extra.columns))

    # What isn't drawn takes its whole number of copies; what is drawn comes from the tree, with its source's figures.
    even = units.filter(~drawn).select("doc_id", "source", "size", "tie", "nth", "source_size", "target", (F.col("whole") + F.when((F.col("p") >= 1 - 1e-9), 1).otherwise(0)).cast("int").alias("copies"))
    odd = extra.join(t.select("t_source", "source_size", "target", "whole"), F.col("source").eqNullSafe(F.col("t_source"))).select(F.col("id").alias("doc_id"), "source", "size", "tie", "nth", "source_size", "target", (F.col("whole") + F.col("p")).cast("int").alias("copies"))
    return even.unionByName(odd).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken.

    Rows of equal id, source and text stand for each other: one of them comes as often as all are taken together. They
    are joined before they are shuffled, so no key, null ids among them, gathers rows in a task.
    """
    taken = mix(docs, **options).filter("copies > 0").groupBy(F.col("doc_id").alias("k_id"), F.col("source").alias("k_source"), F.col("size").alias("k_size"), F.col("tie").alias("k_tie")).agg(F.sum("copies").cast("int").alias("copies"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("src"), word_count(F.col("text")).alias("words"), F.xxhash64(F.col("text").cast("string")).alias("tie"), F.struct(*docs.columns).alias("row"))
    each = keyed.groupBy("id", "src", "words", "tie").agg(F.first("row").alias("row"))
    same = F.col("id").eqNullSafe(F.col("k_id")) & F.col("src").eqNullSafe(F.col("k_source")) & (F.col("words") == F.col("k_size")) & (F.col("tie") == F.col("k_tie"))
    return each.join(taken, same).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
