"""Decoded packets as they leave a capture: {timestamp, raw_size, layers: [{layer_name, fields}]}.

`flatten_packets` turns them into the wide packet table; `nest_packets` is the way back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from wirelake.functions.scalars import epoch_to_timestamp
from wirelake.schema import LAYER_FIELDS, NESTED_SCHEMA, PACKET_SCHEMA, micros

LAYERS = tuple(LAYER_FIELDS)
LINE_SCHEMA = T.StructType([*NESTED_SCHEMA.fields, T.StructField("total_packets", T.LongType())])
_NO_FIELDS = "cast(map() as map<string,string>)"


def read_nested(spark: SparkSession, path: str) -> DataFrame:
    """Nested packets from JSON lines; the schema is given, so nothing is inferred. The line with the total is left out."""
    return packet_lines(spark.read.schema(LINE_SCHEMA).json(path))


def packet_lines(lines: DataFrame) -> DataFrame:
    """Lines of a JSON export, read with LINE_SCHEMA, without the one that holds the total."""
    return lines.where(F.col("total_packets").isNull()).drop("total_packets")


def has_layer(name: str, layers: str = "layers") -> Column:
    """Whether any layer has that name."""
    return F.coalesce(F.exists(F.col(layers), lambda x: x["layer_name"] == name), F.lit(False))


def get_layer(name: str, layers: str = "layers") -> Column:
    """The first layer with that name, or null."""
    return F.try_element_at(F.filter(F.col(layers), lambda x: x["layer_name"] == name), F.lit(1))


def _merge(layers: Column, fields) -> Column:
    """Fields of all given layers as one map; where a name comes twice the later layer wins. No fields add nothing."""
    own = lambda x: F.coalesce(fields(x), F.expr(_NO_FIELDS))
    later = lambda acc, x: F.map_concat(
        F.map_filter(acc, lambda k, _: ~F.map_contains_key(own(x), k)), own(x))
    return F.coalesce(F.aggregate(layers, F.expr(_NO_FIELDS), later), F.expr(_NO_FIELDS))


def _named(name: str):
    names = (name, "Ether") if name == "Ethernet" else (name,)
    return lambda layer: layer["layer_name"].isin(*names)


def _prefixed(fields: Column, prefix: Column) -> Column:
    return F.transform_keys(fields, lambda k, _: F.concat(prefix, k))


def _without(fields: Column, names: list[str]) -> Column:
    return F.map_filter(fields, lambda k, _: ~k.isin(*names))


def flatten_packets(nested: DataFrame) -> DataFrame:
    """One wide row per packet, in the fixed packet schema.

    A value that does not fit its column's type is null. Fields without a column go to `extras` under
    `<layer>_<field>`; where two fields come to the same name, that of a known layer wins. The Ethernet layer may
    also be called Ether. A layer without fields adds nothing and takes nothing away.
    """
    known = F.array(*[F.lit(x) for x in (*LAYERS, "Ether")])
    columns = {f"_{name}": _merge(F.filter("layers", _named(name)), lambda x: x["fields"]) for name in LAYERS}
    columns["_extras"] = _merge(F.filter("layers", lambda x: ~F.array_contains(known, x["layer_name"])),
                                lambda x: _prefixed(x["fields"], F.concat(x["layer_name"], F.lit("_"))))
    wide = nested.withColumns(columns)

    unnamed = []
    projected = [epoch_to_timestamp(F.col("timestamp")).alias("timestamp"), F.col("raw_size")]
    for layer, ddl in LAYER_FIELDS.items():
        fields = [part.split()[0] for part in ddl.split(",")]
        for field in fields:
            name = f"{layer}_{field}"
            projected.append(F.try_element_at(F.col(f"_{layer}"), F.lit(field))
                             .try_cast(PACKET_SCHEMA[name].dataType).alias(name))
        unnamed.append(_prefixed(_without(F.col(f"_{layer}"), fields), F.lit(f"{layer}_")))
    extras = _merge(F.array(F.col("_extras"), *unnamed), lambda x: x)
    projected.append(F.when(F.size(extras) > 0, extras).alias("extras"))
    return wide.select(*projected)


def nest_packets(packets: DataFrame) -> DataFrame:
    """Wide packets as nested ones: a layer appears when any of its columns is set."""
    layers = []
    for layer, ddl in LAYER_FIELDS.items():
        fields = [part.split()[0] for part in ddl.split(",") if f"{layer}_{part.split()[0]}" in packets.columns]
        if not fields:
            continue
        entries = F.array(*[F.struct(F.lit(f).alias("key"), F.col(f"{layer}_{f}").cast("string").alias("value"))
                            for f in fields])
        filled = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
        layers.append(F.when(F.size(filled) > 0, F.struct(F.lit(layer).alias("layer_name"), filled.alias("fields"))))
    return packets.select(
        (micros(packets) / F.lit(1e6)).alias("timestamp"),
        F.array_compact(F.array(*layers)).alias("layers"), F.col("raw_size"))


def to_json(nested: DataFrame) -> DataFrame:
    """JSON lines: one text with `total_packets`, and one for each packet."""
    packets = nested.select(F.to_json(F.struct("timestamp", "layers", "raw_size")).alias("value"))
    total = nested.agg(F.count(F.lit(1)).alias("total_packets"))
    return total.select(F.to_json(F.struct("total_packets")).alias("value")).unionByName(packets)


def write_json(nested: DataFrame, path: str) -> None:
    """JSON lines: total_packets, and one line for each packet; `read_nested` reads them."""
    to_json(nested).write.mode("overwrite").text(path)


def show_stats(nested: DataFrame) -> DataFrame:
    """Packets per layer name and their percent of all packets.

    A null marker is added to each packet's layers, so the total comes out of the same aggregation.
    """
    names = F.concat(F.transform(F.coalesce("layers", F.array()), lambda x: x["layer_name"]),
                     F.array(F.lit(None).cast("string")))
    counts = nested.select(F.explode(names).alias("layer_name")).groupBy("layer_name").agg(
        F.count(F.lit(1)).alias("packets"))
    total = F.max(F.when(F.col("layer_name").isNull(), F.col("packets"))).over(Window.partitionBy("_all"))
    return (
        counts.withColumn("_all", F.lit(0))
        .withColumn("percentage", F.col("packets") * 100.0 / total)
        .where(F.col("layer_name").isNotNull()).drop("_all").orderBy(F.desc("packets"), "layer_name")
    )
