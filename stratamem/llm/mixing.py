"""Mixing sources to target weights by capped water-filling.

Each source asks for its weight's share of the mix; a source that would be read more
than ``max_epochs`` times is clamped, and what it leaves is shared by weight among the
others until none is above its cap. A target is met by whole repetitions of a source
and a seeded fraction: its documents in the order of a seeded hash, up to the word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratamem.operators.bounded import MAX_BROADCAST_ROWS
from stratamem.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = 20240
# Hexadecimal digits of the seeded hash that name a bucket of the fraction's order.
BUCKET_DIGITS = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def draw(seed: int) -> Column:
    """A document's place in the seeded order of its source."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def water_fill(sources: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int) -> DataFrame:
    """Add weight and target to a table of sources (source, source_size), one row each.

    Both windows order one row per source. In the order of cap per weight, a prefix of
    the sources is clamped; ``level`` is what a unit of weight gets once the sources
    before are clamped, and the first that stays under its cap sets it for the rest.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighted = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    weighted = weighted.withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = weighted.withColumn("level", left / heavy).withColumn(
        "free", F.col("level") * F.col("weight") < F.col("cap"))
    level = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"]
    return levels.withColumn("target", F.when(level.isNull(), F.col("cap")).otherwise(
        F.least(F.col("cap"), level * F.col("weight")))).select("source", "source_size", "documents", "target")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS,
        seed: int = SEED, broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Add size, source_size, target and taken to ``docs`` (doc_id, text, source, ...).

    size counts the words of a text, 0 for null. Sources weigh ``weights`` in turn by
    code point, null being a source of its own and the last; the targets share ``share``
    times all sizes. taken is what the mix takes of a document: its size for every whole
    repetition and, of the fractional one, all, a first part (one document per source)
    or nothing. Documents of one id take neighbouring places; equal rows are
    interchangeable. Other columns stay; an empty table gives an empty result.
    """
    added = ("size", "source_size", "target", "taken")
    docs = docs.drop(*added)
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    sized = docs.withColumns({"size": words(F.col("text")), "_key": key, "_draw": draw(seed)}).withColumn(
        "_bucket", F.substring("_draw", 1, BUCKET_DIGITS))
    sums = materialize(sized.groupBy("source", "_key", "_bucket").agg(
        F.sum("size").alias("words"), F.count(F.lit(1)).alias("documents")), "mix-buckets")
    sources = water_fill(sums.groupBy("source").agg(F.sum("words").alias("source_size"),
                                                    F.sum("documents").alias("documents")),
                         weights, share, max_epochs)
    whole = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(
        F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs)))
    sources = sources.withColumn("_whole", whole.cast("long")).withColumn(
        "_rest", F.round(F.col("target") - F.col("_whole") * F.col("source_size")).cast("long"))
    # The bucket in which the fraction ends, and the words of the buckets before it.
    upto = F.sum("words").over(Window.partitionBy("_key").orderBy("_bucket"))
    cuts = sums.withColumn("_upto", upto).join(
        sources.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_key"), "_rest"), "_key")
    cut = cuts.filter(F.col("_upto") > F.col("_rest")).groupBy("_key").agg(
        F.min(F.struct("_bucket", (F.col("_upto") - F.col("words")).alias("before"))).alias("_cut"))
    plan = sources.withColumn("_key", key).drop("source").join(cut, "_key", "left").select(
        "_key", "source_size", "target", F.col("documents").alias("_documents"), "_whole", "_rest", F.col("_cut._bucket").alias("_end"),
        F.col("_cut.before").alias("_before"))
    plan = materialize(plan, "mix-plan")
    total = plan.agg(F.sum("_documents")).first()[0] or 0
    often = max(total // broadcast_rows, 1000)
    # At most broadcast_rows sources hold more documents than this; the others are rare keys.
    if plan.count() <= broadcast_rows:
        planned = sized.join(F.broadcast(plan), "_key")
    else:
        marked = sized.join(F.broadcast(plan.filter(F.col("_documents") > often)), "_key", "left")
        planned = marked.filter(F.col("_documents").isNotNull()).unionByName(
            marked.filter(F.col("_documents").isNull()).select(sized.columns).join(
                plan.filter(F.col("_documents") <= often), "_key"))
    in_cut = F.col("_bucket").eqNullSafe(F.col("_end"))
    part = F.when(F.col("_end").isNull() | (F.col("_bucket") < F.col("_end")), F.col("size")).otherwise(F.lit(0))
    part = F.when(F.col("_rest") > 0, part).otherwise(F.lit(0))
    outside = planned.filter(~in_cut).withColumn("_part", part.cast("long"))
    so_far = F.sum("size").over(
        Window.partitionBy("_key", "_bucket").orderBy("_draw", "size", F.xxhash64(*docs.columns))
        .rowsBetween(Window.unboundedPreceding, -1))
    room = F.col("_rest") - F.col("_before") - F.coalesce(so_far, F.lit(0))
    inside = planned.filter(in_cut).withColumn(
        "_part", F.greatest(F.lit(0), F.least(F.col("size"), room)).cast("long"))
    return outside.unionByName(inside).withColumn(
        "taken", F.col("_whole") * F.col("size") + F.col("_part")).select(*docs.columns, *added)


def repeat(mixed: DataFrame) -> DataFrame:
    """The mixed corpus: a row per repetition of a document, the columns of ``mix`` dropped.

    A fractional repetition of part of a text has its first words, joined by blanks.
    A document without words takes part once, since it costs nothing.
    """
    names = [c for c in mixed.columns if c not in ("size", "source_size", "target", "taken")]
    full = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.floor(F.col("taken") / F.col("size"))).cast("int")
    left = (F.col("taken") - full * F.col("size")).cast("int")
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(full + F.when(left > 0, 1).otherwise(0))
    rows = mixed.withColumns({"_full": full, "_left": left}).withColumn(
        "_nth", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))))
    parts = F.filter(F.split("text", SPACES), lambda w: w != "")
    text = F.when((F.col("size") == 0) | (F.col("_nth") <= F.col("_full")), F.col("text")).otherwise(
        F.array_join(F.slice(parts, F.lit(1), F.greatest(F.col("_left"), F.lit(1))), " "))
    changed = (F.col("size") > 0) & (F.col("_nth") > F.col("_full"))
    out = rows.withColumn("_text", text)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(changed, F.length("_text").cast("long")).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col("_text")).select(*names)
