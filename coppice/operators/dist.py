"""Bundles: which source files their source maps cover, and what that says about unused code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Digits of the base-64 variable-length numbers in source maps, in order of value.
DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
MAP_SCHEMA = "version int, sources array<string>, mappings string"


def vlq(segment: Column) -> Column:
    """Signed numbers of one mapping segment: five bits a digit, the sixth continues, the lowest bit of a number is its sign."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("acc"), F.lit(0).alias("shift"))

    def fold(state: Column, digit: Column) -> Column:
        acc = state["acc"].bitwiseOR(F.call_function("shiftleft", digit.bitwiseAND(F.lit(31)), state["shift"]))
        more = digit >= 32
        value = F.shiftright(acc, 1) * F.when(acc.bitwiseAND(F.lit(1)) == 1, -1).otherwise(1)
        out = F.when(more, state["out"]).otherwise(F.array_append(state["out"], value))
        return F.struct(out.alias("out"), F.when(more, acc).otherwise(0).alias("acc"), F.when(more, state["shift"] + 5).otherwise(0).alias("shift"))

    digits = F.transform(F.filter(F.split(segment, ""), lambda c: c != ""), lambda c: F.position(c, F.lit(DIGITS)) - 1)
    return F.aggregate(digits, start, fold, lambda s: s["out"])


def covered_sources(maps: DataFrame) -> DataFrame:
    """chunk, source and number of mapped segments, from chunk and the content of its source map.

    A segment's second number moves the source index on from the segment before it, so the
    index is a running sum over the map.
    """
    parsed = maps.select("chunk", F.from_json("content", MAP_SCHEMA).alias("m")).where("m.mappings IS NOT NULL")
    segments = F.filter(F.split("m.mappings", "[;,]"), lambda x: x != "")
    steps = F.transform(segments, lambda x: F.coalesce(F.try_element_at(vlq(x), F.lit(2)), F.lit(0)))
    mapped = F.transform(segments, lambda x: F.length(x) >= 4)
    rows = parsed.select("chunk", "m.sources", F.posexplode(F.arrays_zip(steps.alias("step"), mapped.alias("mapped"))).alias("i", "s"))
    index = F.sum("s.step").over(Window.partitionBy("chunk").orderBy("i"))
    found = rows.select("chunk", "sources", index.alias("index"), "s.mapped").where("mapped")
    return found.select("chunk", F.get("sources", F.col("index").cast("int")).alias("source")).groupBy("chunk", "source").agg(F.count("*").alias("segments"))


def bundle_classes(exports: DataFrame, covered: DataFrame, chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """Files with exports by what the chunks (chunk, boot) hold of them; the first class that holds.

    in no chunk: dead_in_all_chunks. With several chunks: a lazy target that a boot chunk
    holds and that is also imported statically or stands in a feature chunk: fake_lazy; in
    feature chunks only: feature_local; in boot chunks only: boot_path_only. Else verify_first.
    """
    held = covered.join(chunks, "chunk").groupBy(F.col("source").alias("path")).agg(F.bool_or("boot").alias("in_boot"), F.bool_or(~F.col("boot")).alias("in_feature"))
    imports = edges.groupBy(F.col("dst").alias("path")).agg(F.bool_or(F.col("label") == "lazy_import").alias("lazy"), F.bool_or(F.col("label") != "lazy_import").alias("static"))
    many = chunks.agg((F.count("*") > 1).alias("several"))
    rows = exports.select("path").distinct().join(held, "path", "left").join(imports, "path", "left").crossJoin(many).na.fill(False)
    boot, feature = F.col("in_boot"), F.col("in_feature")
    kind = (
        F.when(~boot & ~feature, "dead_in_all_chunks").when(~F.col("several"), "verify_first")
        .when(F.col("lazy") & boot & (F.col("static") | feature), "fake_lazy").when(feature & ~boot, "feature_local").when(boot & ~feature, "boot_path_only").otherwise("verify_first")
    )
    return rows.select("path", kind.alias("class"))
