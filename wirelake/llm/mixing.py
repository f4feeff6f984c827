"""Mixing sources to target weights: hash-random keys, prefix sums over ranges of keys, a cut at each source's budget.

Keys of a source are cut into 4096 equal ranges. Sums by range (made before anything is shuffled) show the range in
which a source's budget ends; only that range's documents are then put in order of key. So no task sorts a source,
and the documents themselves are not shuffled: each learns its share from a table with one row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wirelake.llm.common import quoted, without, written

RANGES = 4096
#: Rows of a table by source up to which executors get it whole (six numbers and a name each).
BROADCAST_ROWS = 100_000
CYCLE = (5.0, 2.0, 1.0)
CEILING = 3.0
_ADDED = ["size", "source_size", "target", "taken", "epochs"]


def word_count(text_col: str = "text") -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of the text; a null text has none."""
    return F.coalesce(F.regexp_count(quoted(text_col), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, ceiling: float = CEILING, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources by code point, null last, weigh as `cycle` says, repeating. The sum of all sizes is shared by weight; a
    target stops at `ceiling` times its source's size and the excess is shared again by weight until none is above.
    That end state is min(ceiling x size, level x weight) for one level, found by prefix sums over the sources in
    the order in which they reach their ceilings.
    """
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    t = sizes.withColumn("at", F.expr("row_number() over (order by source is null, source) - 1"))
    t = t.withColumn("weight", F.get(weights, F.col("at") % len(cycle))).withColumn("most", F.col("source_size") * ceiling)
    by_level = "order by most / weight, at"
    t = t.withColumns({
        "total": F.expr("sum(source_size) over ()"),
        "full_before": F.expr(f"coalesce(sum(most) over ({by_level} rows between unbounded preceding and 1 preceding), 0)"),
        "weight_left": F.expr(f"sum(weight) over ({by_level} rows between current row and unbounded following)"),
    })
    t = t.withColumn("level", (F.col("total") - F.col("full_before")) / F.col("weight_left"))
    # The first source in that order which its level does not fill ends the saturated ones; later levels are no higher.
    t = t.withColumn("level", F.expr("max(case when level * weight <= most then level end) over ()"))
    return t.select("source", "source_size",
                    F.least("most", F.coalesce(F.col("level") * F.col("weight"), "most")).alias("target"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         ceiling: float = CEILING, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """One row per source: source, source_size, target, epochs (whole repeats), cut_key and cut_share.

    Documents with a key below cut_key are taken once more than `epochs`; those at cut_key (one document, or equal
    rows) for cut_share of their words.
    """
    keyed = docs.select(quoted(source_col).alias("source"), _key(id_col, text_col).alias("key"), word_count(text_col).alias("size"))
    keyed = keyed.withColumn("range", F.shiftright("key", 51).cast("int"))
    ranges = keyed.groupBy("source", "range").agg(F.sum("size").alias("size"))
    sources = targets(ranges.groupBy("source").agg(F.sum("size").alias("source_size")), ceiling, cycle)
    sources = sources.withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    sources = sources.withColumn("left", F.floor(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size"))
    sources = sources.withColumn("left", F.greatest("left", F.lit(0)))
    same = F.col("r.source").eqNullSafe(F.col("s.source"))
    upto = "sum(size) over (partition by source order by {} rows between unbounded preceding and current row)"
    ends = ranges.withColumn("upto", F.expr(upto.format("range"))).alias("r").join(sources.alias("s"), same) \
        .where("upto > left and upto - size <= left") \
        .select(F.col("s.source").alias("source"), "range", (F.col("left") - (F.col("upto") - F.col("size"))).alias("rest"))
    inside = keyed.alias("r").join(_small(ends, "ends").alias("s"), same & (F.col("r.range") == F.col("s.range"))) \
        .groupBy("r.source", "key").agg(F.sum("size").alias("size"), F.first("rest").alias("rest"))
    cuts = inside.withColumn("upto", F.expr(upto.format("key"))) \
        .where("upto > rest and upto - size <= rest") \
        .select("source", F.col("key").alias("cut_key"), ((F.col("rest") - (F.col("upto") - F.col("size"))) / F.col("size")).alias("cut_share"))
    return sources.alias("r").join(cuts.alias("s"), same, "left") \
        .select("r.source", "source_size", "target", "epochs", "cut_key", "cut_share")


def _small(by_source: DataFrame, name: str) -> DataFrame:
    """A table with a row per source, marked for broadcast if its counted rows are few enough.

    Else it is joined by shuffle; the documents of a hot source are then split by Spark's skew join.
    """
    made = written(by_source, name)
    return F.broadcast(made) if made.count() <= BROADCAST_ROWS else made


def _key(id_col: str, text_col: str) -> Column:
    """Hash-random key of 63 bits, not negative, so that its order is that of its leading bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("mix"), quoted(id_col), quoted(text_col)), 1)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        ceiling: float = CEILING, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """`docs` with size, source_size, target, epochs and taken: the words that the mix takes of it, repeats counted.

    taken is size x epochs, and once more for documents before the cut; the document at the cut gives the first
    words that fill the budget (equal rows there share them evenly). Rerun or recomputed, the same documents are
    taken, since keys depend on id and text alone. Null texts and texts without words have size 0 and taken 0; a null
    source is a source of its own; columns of `docs` with such names are replaced; an empty table gives an empty one.
    """
    keep = without(docs, _ADDED)
    p = _small(plan(docs, id_col, text_col, source_col, ceiling, cycle), "plan")
    sized = docs.select(*[quoted(x).alias(f"c{i}") for i, x in enumerate(keep)], quoted(source_col).alias("own_source"),
                        _key(id_col, text_col).alias("key"), word_count(text_col).alias("size"))
    joined = sized.join(p, F.col("own_source").eqNullSafe(F.col("source")))
    part = F.when(F.col("key") < F.coalesce("cut_key", F.lit(0)), F.col("size")) \
        .when(F.col("key") == F.col("cut_key"), F.floor(F.col("size") * F.col("cut_share") + 1e-6).cast("long")) \
        .otherwise(F.lit(0))
    return joined.select(*[F.col(f"c{i}").alias(x) for i, x in enumerate(keep)], "size", "source_size", "target", "epochs",
                         (F.col("size") * F.col("epochs") + part).cast("long").alias("taken"))


def repeated(mixed: DataFrame) -> DataFrame:
    """The documents of a mix as rows, each as often as it is taken: its whole epochs, and once more if at least
    half of it lies before the cut. Documents without words, null texts too, are kept once; rows that are equal are taken
    each for itself, and so as often as each other. All columns stay; an empty mix gives an empty table."""
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size")).cast("int")).otherwise(1)
    rows = mixed.where(copies > 0).select(*[quoted(x).alias(f"c{i}") for i, x in enumerate(mixed.columns)],
                                          F.explode(F.sequence(F.lit(1), copies)).alias("copy"))
    return rows.select(*[F.col(f"c{i}").alias(x) for i, x in enumerate(mixed.columns)])
