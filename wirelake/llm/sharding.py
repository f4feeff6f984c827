"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

The ring is cut into equal cells; a document belongs to the cell that its hash falls in, and a cell to the first
virtual node clockwise. A node stands where the hash of its shard and replica falls, whatever other shards there are, so
one more shard takes over cells and leaves the rest where they are, but for overflow. Cells are dealt by descending
size. A cell that would fill its shard over the bound goes on clockwise to the first shard that still has room. Small
cells come last and fill what is left, so no shard is over the bound, `slack` above the mean, unless single cells are so
large that none has room; such a cell goes to the least full shard, which it fills over the bound by less than itself.

Only the table of cell sizes (`cells` rows, whatever the input) is brought together; documents are aggregated to it
before anything is shuffled, and get their shard by a join with that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wirelake.llm.common import quoted, without

CELLS = 4096
VIRTUAL_NODES = 128
SLACK = 0.0005
SUB_CELLS = 16


def document_size(text_col: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return (F.coalesce(F.octet_length(quoted(text_col)), F.lit(0)) + 8).cast("long")


def _key(id_col: str, text_col: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), quoted(id_col), F.crc32(F.coalesce(quoted(text_col), F.lit("")).cast("binary")))


def ring(shards: int, virtual_nodes: int, cells: int) -> Column:
    """The virtual nodes clockwise: array of (cell at whose start the node stands, shard)."""
    return F.array_sort(F.transform(
        F.sequence(F.lit(0), F.lit(shards * virtual_nodes - 1)),
        lambda i: F.struct(F.pmod(F.xxhash64(F.lit("node"), i % shards, F.floor(i / shards)), F.lit(cells)).alias("cell"), (i % shards).alias("shard"))))


def place_cells(sizes: DataFrame, shards: int, virtual_nodes: int, cells: int, slack: float) -> DataFrame:
    """(cell, shard, home) from (cell, size): bounded loads, one fold over at most `cells` rows."""
    one = sizes.groupBy().agg(
        F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("turn"), F.xxhash64(F.lit("order"), "cell").alias("tie"), "cell", "size"))).alias("queue"),
        F.ceil(F.sum("size") * (1 + slack) / shards).alias("bound"))
    one = _settled(one.withColumn("ring", ring(shards, virtual_nodes, cells)))
    # A cell's walk: owners from its first node on, then from the start of the ring; a shard comes up again harmlessly.
    one = _settled(one.select(
        "bound", F.concat(F.col("ring.shard"), F.col("ring.shard")).alias("owners"),
        F.transform("queue", lambda c: F.struct(
            c["cell"].alias("cell"), c["size"].alias("size"),
            F.size(F.filter(F.col("ring.cell"), lambda x: x < c["cell"])).alias("first"))).alias("queue")))

    def deal(state: Column, c: Column) -> Column:
        load, owners = state["load"], F.col("owners")
        room = lambda s: F.get(load, s) + c["size"] <= F.col("bound")
        home = F.get(owners, c["first"])
        walk = F.get(F.filter(F.slice(owners, c["first"] + 1, shards * virtual_nodes), room), F.lit(0))
        least = (F.array_position(load, F.array_min(load)) - 1).cast("int")
        chosen = F.when(room(home), home).otherwise(F.coalesce(walk, least))
        return F.get(F.transform(F.array(chosen), lambda s: F.struct(
            F.transform(load, lambda x, i: F.when(i == s, x + c["size"]).otherwise(x)).alias("load"),
            F.concat(state["placed"], F.array(F.struct(c["cell"].alias("cell"), s.alias("shard"), home.alias("home"))))
            .alias("placed"))), F.lit(0))

    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), shards).alias("load"),
        F.array().cast("array<struct<cell:bigint,shard:int,home:int>>").alias("placed"))
    return _settled(one.select(F.aggregate("queue", start, deal)["placed"].alias("placed"))).select(F.inline("placed"))


def _settled(one: DataFrame) -> DataFrame:
    """One row whose columns are worked out once, not again in every place that uses them."""
    return one.groupBy().agg(*[F.first(x).alias(x) for x in one.columns])


def assign_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS,
                  virtual_nodes: int = VIRTUAL_NODES, slack: float = SLACK) -> DataFrame:
    """`docs` with `size` (long), `shard` (0 to shards - 1), `home_shard` (where the ring alone would put it) and `cell`.

    No shard is larger than the mean by more than `slack` (see above for cells too large for that); the key of a document
    is its id with its text. Rows equal in both share a cell. A null id or text is a value like any other; a column of that name in
    `docs` is replaced; an empty table gives an empty one.
    """
    keep = without(docs, ["size", "shard", "home_shard", "cell"])
    keyed = docs.select(*[quoted(x) for x in keep], document_size(text_col).alias("size"),
                        F.pmod(_key(id_col, text_col, 1), F.lit(cells)).alias("cell"))
    sizes = docs.select(document_size(text_col).alias("size"), F.pmod(_key(id_col, text_col, 1), F.lit(cells)).alias("cell")) \
        .groupBy("cell").agg(F.sum("size").alias("size"))
    placed = place_cells(sizes, shards, virtual_nodes, cells, slack).select(
        "cell", "shard", F.col("home").alias("home_shard"))
    return keyed.join(F.broadcast(placed), "cell")  # at most `cells` rows of three numbers


def with_slots(assigned: DataFrame, order: list[str], id_col: str = "doc_id") -> DataFrame:
    """`assigned` (of assign_shards) with `slot`: its place in the shard, without gaps.

    Places are counted in two levels, cells and parts of cells, so no task sees a whole shard. `assigned` is
    shuffled as it is: select what is wanted first. Rows follow `order` inside a part of a cell, nulls first; rows equal in
    it have places next to each other. All columns stay but one named slot; an empty table gives an empty one.
    """
    keep = without(assigned, ["slot"])
    part = F.pmod(F.xxhash64(F.lit(2), quoted(id_col)), F.lit(SUB_CELLS))
    rows = assigned.select(F.struct(*[quoted(x) for x in keep]).alias("row"), "shard", "cell", part.alias("part"))
    rank = "row_number() over (partition by cell, part order by " + ", ".join(f"row.`{x}`" for x in order) + ")"
    ranked = rows.select("row", "cell", "part", F.expr(rank).alias("rank"))
    before = rows.groupBy("shard", "cell", "part").agg(F.count("*").alias("n")).withColumn(
        "before", F.expr("coalesce(sum(n) over (partition by shard order by cell, part rows between unbounded preceding "
                         "and 1 preceding), 0)")).select("cell", "part", "before")
    return ranked.join(before, ["cell", "part"]).select(
        *[F.col("row").getField(x).alias(x) for x in keep], (F.col("before") + F.col("rank") - 1).alias("slot"))
