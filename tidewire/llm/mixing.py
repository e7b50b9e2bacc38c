"""Mixing sources to target weights by Pareto order sampling, in column functions only.

A source with target ``T`` and size ``Z`` words gets ``floor(T / Z)`` certain copies of each document. One more copy
goes to a sample that fills the rest ``R`` of the target. A document of ``s`` words is in it with probability
``p = c * s``, where ``c`` makes the expected words, the sum of ``p * s``, equal to ``R``. Documents whose ``p``
would reach 1 are certain, and ``c`` is that of the others.

The others are sampled by their Pareto ranks: with a uniform number ``u`` of the row, the odds ratio
``(u / (1 - u)) / (p / (1 - p))``, lowest first. The sample's size is fixed, not only for a source but for each of
its classes of like sizes (an eighth of an octave): the sums of ``p``, added up over the classes from a
random start and cut to whole numbers. So each document is in the sample with its ``p`` (as far as order
sampling has it), and the words differ from ``R`` by about one document. ``u`` is drawn from a hash of
seed, id, source, text and the row's number among equal rows, so reruns and retried tasks agree.

Texts are read once: ids, sizes and hashes are stored, and all sums are taken from those. Ranks are counted by slices
first; rows are ordered only in the slice in which a class's sample ends. A decision is then a
function of the row and of one small row for its class, so a source that holds a third of all rows is
spread over all tasks.

Defined results: null texts have no words; rows without words get the whole copies only; null is a source
of its own; of equal rows as many are taken as their draws say, each row having one of its own; existing
columns with the names of results are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.tables import checked_broadcast
from tidewire.operators.lineage import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
#: No source is repeated more often.
MOST = 3
SEED = "mix"
#: Classes of sizes to an octave.
STEPS = 8
SLICES = 1 << 14
#: Strata (classes of sources) up to which their decisions are broadcast.
MOST_STRATA = 500_000
RESULTS = ("size", "source_size", "target", "copies", "taken")
_PART_BITS = 33


def _or_null(value: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("null"))


def fingerprint(doc_id: Column, source: Column, text: Column) -> Column:
    """Equal for rows of equal id, source and text."""
    parts = F.concat_ws("|", _or_null(doc_id), _or_null(F.md5(text.cast("binary"))), _or_null(source))
    return F.md5(parts.cast("binary"))


def draw(seed: str, *parts: Column) -> Column:
    """A number in (0, 1) with 52 bits."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(seed), *parts).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def size_class(size: Column) -> Column:
    """The octave of a size of 1 or more, and its part, as one number."""
    octave = F.length(F.bin(size)) - F.lit(1)
    part = F.floor(size.cast("double") * F.lit(STEPS) / F.pow(F.lit(2.0), octave))
    return (octave * F.lit(STEPS) + part).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Rows ``(source, source_size)`` with weight and target words.

    Sources in code point order, null last, weigh WEIGHTS in turn and share all words.
    Who would get more than MOST times its size stops there, and the others share the excess by
    weight. In the order of the share at which a source stops these are the first
    ones, so one running sum over the sources finds them all.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(w) for w in WEIGHTS]),
        (F.pmod(F.row_number().over(by_name) - F.lit(1), F.lit(len(WEIGHTS))) + F.lit(1)).cast("int"),
    ).cast("long")
    limit = F.col("source_size") * F.lit(MOST)
    by_stop = Window.orderBy(
        (F.col("source_size").cast("double") / F.col("weight")).asc(), F.col("source").asc_nulls_last()
    ).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(by_stop), F.lit(0).cast("long"))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_stop), F.lit(0).cast("long"))
    level = left.cast("double") / heavy
    shared = (
        sizes.withColumn("weight", weight)
        .withColumn("level", level)
        .withColumn("stops", F.col("level") * F.col("weight") > limit)
        .withColumn("final", F.max(F.when(~F.col("stops"), F.col("level"))).over(everything))
    )
    # Past the last source that stops, ``left`` and ``heavy`` also lack sources that don't,
    # which only lowers the level: its highest value there is the one that holds.
    return shared.select(
        "source",
        "source_size",
        "weight",
        F.when(F.col("stops"), limit.cast("double"))
        .otherwise(F.least(F.col("final") * F.col("weight"), limit.cast("double")))
        .alias("target"),
    )


def inclusion(by_size: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows ``(source, c, certain)`` for sources with words left: ``p = c * size`` below ``certain`` words, 1 from there.

    From the largest size down, a size is certain while ``c`` of the sizes up to it would bring
    its ``p`` to 1; there is one row for each size that occurs in a source.
    """
    larger = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source")
    words = (F.col("rows") * F.col("size")).cast("decimal(38,0)")
    squares = words * F.col("size").cast("decimal(19,0)")
    none = F.lit(0).cast("decimal(38,0)")
    left = F.col("rest") - F.coalesce(F.sum("_words").over(larger), none).cast("double")
    below = F.sum("_squares").over(whole) - F.coalesce(F.sum("_squares").over(larger), none)
    return (
        by_size.filter(F.col("size") > 0)
        .join(plan.select(F.col("source").alias("_s"), "rest"), F.col("source").eqNullSafe(F.col("_s")))
        .filter(F.col("rest") > 0)
        .select("source", "size", "rest", words.alias("_words"), squares.cast("decimal(38,0)").alias("_squares"))
        .select("source", "size", (left / below.cast("double")).alias("c"))
        .filter(F.col("c") * F.col("size") < 1)
        .groupBy("source")
        .agg(F.max(F.struct("size", "c")).alias("first"))
        .select(F.col("source").alias("_s"), F.greatest("first.c", F.lit(0.0)).alias("c"), (F.col("first.size") + 1).alias("certain"))
    )


def _rank(c: Column, u: Column) -> Column:
    p = c * F.col("size")
    return F.when(p > 0, (u / (F.lit(1.0) - u)) / (p / (F.lit(1.0) - p)))


def repeats(rows: DataFrame) -> DataFrame:
    """``(_row, nth)`` of the rows that have equal ones before them, counted in parts of the table."""
    parted = rows.select("_same", "_row", F.shiftrightunsigned("_row", _PART_BITS).alias("_part"))
    earlier = Window.partitionBy("_same").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parted.groupBy("_same", "_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_same", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"), "_n")
        .filter((F.col("_offset") > 0) | (F.col("_n") > 1))
    )
    inside = F.row_number().over(Window.partitionBy("_same", "_part").orderBy("_row"))
    return (
        parted.join(offsets, ["_same", "_part"])
        .select(F.col("_row").alias("_r"), (F.col("_offset") + inside - F.lit(1)).cast("long").alias("nth"))
        .filter(F.col("nth") > 0)
    )


def mix(
    docs: DataFrame, seed: str = SEED, key: str = "doc_id", text: str = "text", source: str = "source",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` (all) of ``docs`` with size, source_size, target, copies and taken (words: copies * size)."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    kept = [F.col(c) for c in (docs.columns if keep is None else keep) if c not in RESULTS]
    sized = stored(
        docs.select(
            F.struct(*kept).alias("row"),
            F.col(source).alias("source"),
            size.alias("size"),
            fingerprint(F.col(key), F.col(source), F.col(text)).alias("_same"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "sized",
    )
    narrow = sized.select("source", "size", "_same", "_row")
    by_size = narrow.groupBy("source", "size").agg(F.count(F.lit(1)).alias("rows"))
    by_size = stored(by_size, "sizes")
    plan = targets(by_size.groupBy("source").agg(F.sum(F.col("rows") * F.col("size")).alias("source_size")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("whole", whole).withColumn(
        "rest", F.col("target") - (F.col("whole") * F.col("source_size")).cast("double")
    )
    plan = stored(plan, "plan")
    odds = inclusion(by_size, plan)
    strata = (
        by_size.filter(F.col("size") > 0)
        .join(odds, F.col("source").eqNullSafe(F.col("_s")))
        .filter(F.col("size") < F.col("certain"))
        .groupBy("source", size_class(F.col("size")).alias("class"), "c", "certain")
        .agg(F.sum(F.col("rows") * F.col("size")).alias("words"))
    )
    upto = Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, 0)
    start = draw(seed, F.lit("start"), _or_null(F.col("source")))
    reached = F.floor(F.col("c") * F.sum("words").over(upto) + start)
    previous = Window.partitionBy("source").orderBy("class")
    strata = strata.withColumn("_reached", reached).select(
        "source", "class", "c", "certain", (F.col("_reached") - F.coalesce(F.lag("_reached").over(previous), F.lit(0))).alias("n")
    )
    strata = checked_broadcast(
        strata.select(F.col("source").alias("_t"), F.col("class").alias("_class"), "c", "n"), "strata", MOST_STRATA
    )
    nth = checked_broadcast(repeats(narrow), "repeats")

    def ranked(rows: DataFrame) -> DataFrame:
        drawn = rows.join(nth, F.col("_row") == F.col("_r"), "left").withColumn("nth", F.coalesce("nth", F.lit(0).cast("long")))
        u = draw(seed, F.col("_same"), F.col("nth").cast("string"))
        like = F.col("source").eqNullSafe(F.col("_t")) & (F.col("class") == F.col("_class"))
        classed = drawn.withColumn("class", F.when(F.col("size") > 0, size_class(F.col("size"))).otherwise(F.lit(-1)))
        rank = F.when(F.col("c") * F.col("size") < 1, _rank(F.col("c"), u))
        return classed.join(strata, like, "left").withColumn("_rank", rank)

    slice_ = F.floor(F.col("_rank") / (F.lit(1.0) + F.col("_rank")) * F.lit(SLICES))
    candidates = ranked(narrow).filter(F.col("_rank").isNotNull() & (F.col("n") > 0)).withColumn("_slice", slice_)
    candidates = stored(candidates.select("source", "class", "n", "_slice", "_rank", "_same", "nth"), "ranks")
    stratum = Window.partitionBy("source", "class")
    slices = candidates.groupBy("source", "class", "n", "_slice").agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(stratum.orderBy("_slice")) - F.col("rows")
    last = (
        slices.withColumn("before", before)
        .filter((F.col("before") < F.col("n")) & (F.col("n") <= F.col("before") + F.col("rows")))
        .select(F.col("source").alias("_t"), F.col("class").alias("_class"), F.col("_slice").alias("_end"), "before")
    )
    ends = (
        candidates.join(
            last,
            F.col("source").eqNullSafe(F.col("_t")) & (F.col("class") == F.col("_class")) & (F.col("_slice") == F.col("_end")),
        )
        .withColumn("place", F.col("before") + F.row_number().over(stratum.orderBy("_rank", "_same", "nth")))
        .filter(F.col("place") == F.col("n"))
        .select(F.col("source").alias("_e"), F.col("class").alias("_eclass"), F.struct("_rank", "_same", "nth").alias("_last"))
    )
    ends = checked_broadcast(ends, "ends", MOST_STRATA)
    certain = odds.select(F.col("_s").alias("_c"), "certain")
    sources = checked_broadcast(
        plan.join(certain, F.col("source").eqNullSafe(F.col("_c")), "left").select(
            F.col("source").alias("_s"), "source_size", "target", "whole", "certain"
        ),
        "mix",
        MOST_STRATA,
    )
    inside = F.struct("_rank", "_same", "nth") <= F.col("_last")
    extra = F.coalesce((F.col("size") >= F.col("certain")) | inside, F.lit(False)).cast("long")
    return (
        ranked(sized)
        .join(sources, F.col("source").eqNullSafe(F.col("_s")))
        .join(ends, F.col("source").eqNullSafe(F.col("_e")) & (F.col("class") == F.col("_eclass")), "left")
        .withColumn("copies", F.col("whole") + extra)
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select("row.*", *RESULTS)
    )


def mixture(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with their own columns."""
    packed = docs.select(F.struct("*").alias("whole_row"), "doc_id", "text", "source")
    times = F.sequence(F.lit(1).cast("long"), F.col("copies"))
    return (
        mix(packed, seed, keep=["whole_row"])
        .filter(F.col("copies") > 0)
        .select("whole_row", F.explode(times).alias("nth"))
        .select("whole_row.*")
    )
