"""Mixing sources to target weights by weighted fair queueing (DataFrame operations only).

Every source queues its documents in a fixed shuffled order, up to three times over (epochs).
A queued copy's virtual finish time is the source's words up to and including it, divided by the
source's target. All copies are range-sorted by finish time and the mix is cut where the running
total reaches the budget. Prefix sums are two-level (buckets of the order, then rows of a bucket),
so no source and no time range is gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WS, fresh, materialize, numbered, text_or_empty

#: No source may supply, and no document may appear in the mix, more often than this.
MAX_EPOCHS = 3
#: Buckets of the shuffled order per source, and how many of them make a group of the level above.
#: Each bucket is one window group: at 10^10 rows of one source a bucket has some 150,000.
ORDER_BUCKETS, GROUP = 65536, 256
#: Cells into which a range is cut when the end of the mix is narrowed down, and rows that are sorted in the end.
CELLS, EDGE_ROWS = 1024, 200_000
#: Ranges into which the sources are dealt to be numbered.
RANGES = 64


def n_words(column: str = "text") -> Column:
    """Number of maximal runs outside ASCII white space; null counts 0. No array is built."""
    text = text_or_empty(column)
    marks = F.regexp_replace(text, f"[{WS}]*+[^{WS}]++[{WS}]*+", "x")
    return F.when(text.rlike(f"[^{WS}]"), F.length(marks)).otherwise(0).cast("long")


def _prefix(df: DataFrame, order: list[Column], **sums: str) -> DataFrame:
    """Exclusive running sums of columns in a global order: ``df`` is dealt to ranges, summed inside each, and
    the ranges' own totals (RANGES rows) are summed up and added."""
    part = "_range"
    dealt = materialize(df.repartitionByRange(RANGES, *order).withColumn(part, F.spark_partition_id()))
    inside = W.partitionBy(part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    totals = dealt.groupBy(part).agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    starts = totals.select(part, *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    local = dealt.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(n) for n, c in sums.items()])
    return local.join(starts, part).select(*df.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])


def targets(sizes: DataFrame) -> DataFrame:
    """Target words of each source, from (source, source_size).

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share all words; a target stops
    at three times the source's size and the excess goes to the others by weight. This is water
    filling: sources in order of cap/weight are full until the level no longer reaches their cap.
    However many sources there are, they are numbered and summed range by range.
    """
    rows = sizes.select("source", F.col("source_size").cast("double").alias("s"), F.lit(1).cast("long").alias("one"))
    by_name = [F.col("source").isNull(), F.col("source")]
    ranked = _prefix(rows, by_name, rank="one").select("source", "s", (F.col("rank") % 3 + 1).cast("double").alias("w"), (F.col("s") * MAX_EPOCHS).alias("cap"))
    summed = _prefix(ranked, [F.col("cap") / F.col("w"), *by_name], cap_before="cap", w_before="w")
    whole = ranked.agg(F.sum("s").alias("all_s"), F.sum("w").alias("all_w"))
    levels = materialize(summed.crossJoin(F.broadcast(whole)).select(
        "source", "s", "w", "cap", ((F.col("all_s") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before"))).alias("level")
    ))
    full = F.col("cap") <= F.col("w") * F.col("level")
    top = levels.agg(F.max(F.when(~full, F.col("level"))).alias("top"))
    return levels.crossJoin(F.broadcast(top)).select(
        "source", F.col("s").cast("long").alias("source_size"), F.when(full, F.col("cap")).otherwise(F.col("w") * F.col("top")).alias("target")
    )


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, source, row, size, source_size, target, epochs, taken.

    ``epochs`` is how often the mix takes the document, ``taken`` the words that makes. Null or
    blank texts have size 0 and are never taken; a table without words has target 0 throughout;
    repeated rows queue one behind the other; an empty table gives an empty one. ``row`` is the column of
    that name in ``docs`` if a written number is handed in, or else made and written here. The order is a
    hash of seed and doc_id, so reruns agree.
    """
    row = F.col("row") if dict(docs.dtypes).get("row") == "bigint" else F.monotonically_increasing_id()
    base = materialize(
        docs.select(
            F.col("doc_id"),
            F.col("source"),
            row.alias("row"),
            n_words().alias("size"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("h"),
        ).withColumn("b", (F.conv(F.substring("h", 1, 4), 16, 10).cast("long") * ORDER_BUCKETS / 65536).cast("int"))
    )
    cells = materialize(base.groupBy("source", "b").agg(F.sum("size").alias("cell")).withColumn("g", F.floor(F.col("b") / GROUP).cast("int")))
    groups = cells.groupBy("source", "g").agg(F.sum("cell").alias("n"))
    sizes = groups.groupBy("source").agg(F.sum("n").alias("source_size"))
    # words before a bucket: those of the groups before its own, and those before it in its group
    above = groups.select("source", "g", (F.sum("n").over(W.partitionBy("source").orderBy("g")) - F.col("n")).alias("above"))
    within = cells.select("source", "g", "b", (F.sum("cell").over(W.partitionBy("source", "g").orderBy("b")) - F.col("cell")).alias("inside"))
    same = lambda a, b, *more: [F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")), *[F.col(f"{a}.{c}") == F.col(f"{b}.{c}") for c in more]]
    meta = above.alias("a").join(targets(sizes).alias("t"), same("a", "t")).select("a.*", "source_size", "target")
    starts = within.alias("c").join(meta.alias("m"), same("c", "m", "g")).select(
        "c.source", "c.b", (F.col("inside") + F.col("above")).alias("cell_start"), "source_size", "target"
    )
    joined = base.alias("d").join(starts.alias("m"), same("d", "m", "b")).select(
        "d.doc_id", "d.source", "d.row", "d.size", "d.h", "d.b", "cell_start", "source_size", "target"
    )
    queue = W.partitionBy("source", "b").orderBy("h", "doc_id", "size", "row")
    placed = materialize(joined.select(
        "doc_id", "source", "row", "size", "h", "source_size", "target",
        (F.col("cell_start") + F.sum("size").over(queue)).alias("finish"),
    ))
    cut = _cut(placed)
    taken = sum(
        (F.when((F.col("size") > 0) & (F.col("target") > 0) & (_key(e) <= cut), 1).otherwise(0) for e in range(MAX_EPOCHS)),
        F.lit(0),
    )
    return placed.withColumn("epochs", taken.cast("int")).select(
        "doc_id", "source", "row", "size", "source_size", "target", "epochs", (F.col("size") * F.col("epochs")).cast("long").alias("taken")
    )


def _finish(epoch: int) -> Column:
    return (F.col("finish") + F.lit(epoch) * F.col("source_size")).cast("double") / F.col("target")


def _key(epoch: int) -> Column:
    """Sort key of a queued copy: virtual finish time, then the shuffled order, then the row."""
    return F.struct(_finish(epoch).alias("v"), F.col("h").alias("h"), F.col("row").alias("r"))


def _cut(placed: DataFrame) -> Column:
    """The last key that fits the budget, as a literal: one row reaches the driver.

    The copy at which the running total passes the budget is closed in on: words are summed by cells of
    the finish time, then of the cell in which the total passes, and so on; copies of one finish time by
    the digits of their hash; those of one hash by row. Each pass is a partial sum into CELLS rows; only
    the last EDGE_ROWS copies, if that many, are sorted.
    """
    queued = placed.filter((F.col("size") > 0) & (F.col("target") > 0))
    copies = queued.select("size", F.explode(F.array(*[_key(e) for e in range(MAX_EPOCHS)])).alias("k")).select("size", "k", "k.*")
    budget = room = placed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    inside, digits = copies, 0
    while True:
        low = inside.agg(*[f(c).alias(f"{n}_{c}") for n, f in (("least", F.min), ("most", F.max)) for c in ("v", "h", "r")], F.count("*").alias("n")).first()
        if low["n"] <= EDGE_ROWS or not budget:
            break
        if low["least_v"] < low["most_v"]:
            cell = _scaled("v", low["least_v"], low["most_v"])
        elif low["least_h"] < low["most_h"] and digits < 32:
            digits += 2
            cell = F.conv(F.substring("h", digits - 1, 2), 16, 10).cast("long")
        else:
            cell = _scaled("r", low["least_r"], low["most_r"])
        sums = inside.groupBy(cell.alias("cell")).agg(F.sum("size").alias("n"))
        run = sums.select("cell", "n", F.sum("n").over(W.orderBy("cell")).alias("upto"))
        edge = run.filter(F.col("upto") > F.lit(room)).orderBy("cell").limit(1).first()
        if edge is None:  # all that is left fits
            break
        room -= edge["upto"] - edge["n"]
        inside = inside.filter(cell == F.lit(edge["cell"]))
    summed = inside.select("k", F.sum("size").over(W.orderBy("k")).alias("upto")) if low["n"] <= EDGE_ROWS else inside.select("k", F.lit(0).alias("upto"))
    last = summed.filter(F.col("upto") <= F.lit(room)).agg(F.max("k").alias("k")).first()["k"]
    if last is None:
        # none of these fits: the last key before them
        first = inside.agg(F.min("k").alias("k")).first()["k"]
        last = copies.filter(F.col("k") < _literal(first)).agg(F.max("k").alias("k")).first()["k"] if first is not None else None
    return _literal(last) if last is not None else F.struct(F.lit(float("-inf")).alias("v"), F.lit("").alias("h"), F.lit(-1).cast("long").alias("r"))


def _scaled(column: str, least, most) -> Column:
    """Number of the cell of a range that a value lies in, from 0 to CELLS."""
    return F.floor((F.col(column) - F.lit(least)).cast("double") / F.lit(float(most - least) or 1.0) * CELLS).cast("long")


def _literal(key) -> Column:
    return F.struct(F.lit(key["v"]).alias("v"), F.lit(key["h"]).alias("h"), F.lit(key["r"]).cast("long").alias("r"))


def mixed_documents(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``.

    Null and blank texts have no words to take and are left out; see :func:`mix` for ties and repeated rows.
    """
    rows, row = numbered(docs)
    n, copy = fresh(docs, "_epochs"), fresh(docs, "_copy")
    plan = mix(rows.select(F.col(row).alias("row"), "doc_id", "source", "text"), seed).filter("epochs > 0")
    return (
        rows.join(plan.select(F.col("row").alias(row), F.col("epochs").alias(n)).hint("merge"), row)
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n))))
        .select(*docs.columns)
    )


def op3(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document; see :func:`mix` for nulls, empty texts,
    ties, repeated rows and empty tables. Extra columns are not read."""
    return mix(docs.select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

ORACLE = rf"""
WITH d AS (SELECT doc_id, source, {_WORDS}::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT source, source_size::DOUBLE AS s, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM s),
l AS (SELECT *, 3 * s AS cap, (sum(s) OVER () - coalesce(sum(3 * s) OVER (ORDER BY 3 * s / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY 3 * s / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
g AS (SELECT source, s::BIGINT AS source_size, CASE WHEN cap <= w * level THEN cap ELSE w * max(CASE WHEN cap > w * level THEN level END) OVER () END AS target FROM l),
p AS (SELECT d.*, g.source_size, g.target, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size) AS finish
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
c AS (SELECT doc_id, size, h, (finish + e * source_size)::DOUBLE / target AS v FROM p, (VALUES (0), (1), (2)) t(e) WHERE size > 0 AND target > 0),
k AS (SELECT *, sum(size) OVER (ORDER BY v, h ROWS UNBOUNDED PRECEDING) AS upto FROM c),
t AS (SELECT doc_id, count(*) AS n FROM k WHERE upto <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT p.doc_id, p.size, p.source_size, p.target, (p.size * coalesce(t.n, 0))::BIGINT AS taken
FROM p LEFT JOIN t ON p.doc_id = t.doc_id
"""
