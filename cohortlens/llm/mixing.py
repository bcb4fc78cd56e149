"""Mixing sources to target weights by a low-discrepancy schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import PARTS, fresh, row_hash, running, unit_interval, without

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block, and the blocks that a small source's target is at least made of: its blocks are shorter.
BLOCK_WORDS, LEAST_BLOCKS = 64, 16
#: Binary digits of a slot.
DIGITS = 63
MOST_REPEATS = 3


def word_count(text: Column) -> Column:
    """Words of a text; none in null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A source as a text without nulls, in the order of the sources with null last."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), source.cast("string")))


def targets(sizes: DataFrame, most: int = MOST_REPEATS) -> DataFrame:
    """Add ``target`` to the sources (``key``, ``source_size``, one row each).

    Sources in order of their key weigh 1, 2, 3, repeating, and share the total. A target stops at
    ``most`` times its source's size; the excess is shared again by weight until none is above. That
    is a level L with target = least(most * size, L * weight): going up by most * size / weight, a
    source is cut off while it lies below the level that the remaining sources would share.

    One row per source is all this orders in one task; documents don't take part.
    """
    every = Window.partitionBy()
    ordered = sizes.withColumn("place", F.row_number().over(Window.orderBy("key")))
    weighed = ordered.withColumn("weight", (F.col("place") - 1) % 3 + 1).withColumns(
        {"limit": F.col("source_size") * most, "total": F.sum("source_size").over(every)}
    )
    rising = Window.orderBy(F.col("limit") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    shared = weighed.withColumns(
        {
            "left": F.col("total") - F.coalesce(F.sum("limit").over(rising), F.lit(0)),
            "weights": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(rising), F.lit(0)),
        }
    ).withColumn("level", F.col("left") / F.col("weights"))
    free = F.col("limit") / F.col("weight") >= F.col("level")
    level = F.max(F.when(free, F.col("level"))).over(every)
    return shared.withColumn("target", F.least(F.col("limit").cast("double"), level * F.col("weight"))).select(
        "key", "source_size", "place", "target"
    )


def draws(sources: DataFrame, block_words: int = BLOCK_WORDS, most: int = MOST_REPEATS) -> DataFrame:
    """Add to the sources ``words`` (of a block), ``blocks``, ``drawn`` (blocks to draw) and ``start`` (drawn for sources before).

    A source's word line is cut into equal blocks, the last one shorter: of ``block_words`` words, or of a
    LEAST_BLOCKS-th of its target where that is less, one word at least. Whole passes over the line and the blocks nearest
    to the rest of the target are drawn.
    """
    sources = sources.withColumn(
        "words", F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("target") / LEAST_BLOCKS))).cast("long")
    )
    size, t = F.col("source_size"), F.col("words")
    blocks = F.expr("(source_size + words - 1) div words")
    passes = F.floor(F.col("target") / size)
    rest = F.round((F.col("target") - passes * size) / t).cast("long")
    counted = sources.withColumn("blocks", blocks).withColumn(
        "drawn",
        F.when(size == 0, F.lit(0).cast("long")).otherwise(F.least(passes * F.col("blocks") + rest, F.col("blocks") * most)),
    )
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("start", F.coalesce(F.sum("drawn").over(before), F.lit(0)))


def mirrored(number: Column) -> Column:
    """The number's binary digits in reverse order: van der Corput's radical inverse, times 2^DIGITS."""
    return F.conv(F.reverse(F.lpad(F.bin(number), DIGITS, "0")), 2, 10).cast("long")


def source_lines(docs: DataFrame, size: str, group: str, h: str, first: str, total: str, parts: int) -> DataFrame:
    """Shuffled rows of each source end to end: ``first`` is the number of words before a row."""
    [upto] = fresh([*docs.columns, first, total], "upto")
    order = [F.col(h)]
    lined = running(docs, group, unit_interval(F.col(h)), order, F.col(size), upto, total, parts)
    return lined.withColumn(first, F.col(upto) - F.col(size)).drop(upto)


def schedule(lines: DataFrame, parts: int = PARTS) -> DataFrame:
    """The mix as slots: ``key``, ``slot`` (order in the mix), ``block`` (drawn there) and ``pass``.

    The points of van der Corput's sequence, mapped through the cumulative draws of the sources, say
    which source each slot takes; the slots of a source are ranked, and rank j takes block j of its
    shuffled line, again from the start after the last. The sequence visits every multiple of a power
    of 1/2 once, so the points of a source are the multiples in its stretch of the cumulative draws,
    and the slot of such a point is its number with the binary digits mirrored. Blocks
    come from the rows in which they begin, and draw x of a source is its block x mod blocks, so
    points are enumerated where the documents lie. ``lines`` has ``key``, ``first``, ``size`` and its source's :func:`draws`.
    """
    begins, ends = "(first + words - 1) div words", "(first + size + words - 1) div words"
    begun = lines.filter(f"{begins} < {ends}")
    points = (
        begun.selectExpr("key", "blocks", "drawn", "start", f"explode(sequence({begins}, {ends} - 1, 1L)) as at")
        .withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(MOST_REPEATS - 1))))
        .withColumn("x", F.col("turn") * F.col("blocks") + F.col("at"))
        .filter("x < drawn")
    )
    slots = points.select("key", "blocks", mirrored(F.col("start") + F.col("x")).alias("slot"))
    place = F.col("slot") * F.lit(2.0**-DIGITS)
    ranked = running(slots, "key", place, [F.col("slot")], F.lit(1).cast("long"), "rank", "slots", parts)
    return ranked.selectExpr("key", "slot", "(rank - 1) % blocks as block", "(rank - 1) div blocks as pass")


def mix(
    docs: DataFrame, text: str = "text", source: str = "source", seed: int = 42, block_words: int = BLOCK_WORDS,
    parts: int = PARTS,
) -> DataFrame:
    """Every row with ``size``, ``source_size``, ``target`` and ``taken``, the words the mix takes of it.

    Targets come from :func:`targets`, the mix from :func:`schedule`: equal blocks of shuffled words
    of a source fill the slots that the low-discrepancy sequence gives it. A row's ``taken`` adds up
    what the drawn blocks hold of it, a block drawn twice counting twice. A source's sum lies within
    one block of its target (a word or a sixteenth of it where it is small), and no row is taken more than three times.

    Shuffling and laying out go by parts of a source (:func:`common.running`), blocks and slots are
    joined by source and block, so no source meets in one task.

    Defined cases: null, empty and blank texts have size 0 and are taken 0 times; a null source is a
    source of its own, the last; ties in the shuffle are rows equal in all columns and
    interchangeable; a table without words has targets 0; an empty table gives no rows. Result
    columns replace input columns of the same names.
    """
    results = ("size", "source_size", "target", "taken")
    group, h, first, total, at = fresh([*docs.columns, *results], "group", "h", "first", "total", "at")
    keep = without(docs.columns, *results)
    quoted = [f"`{c}`" for c in keep]
    marked = docs.withColumns({group: source_key(F.col(source)), h: row_hash(docs, docs.columns, seed)})
    sized = marked.withColumn("size", word_count(F.col(text))).select(*quoted, group, h, "size")
    lined = source_lines(sized, "size", group, h, first, total, parts)

    slim = sized.select(F.col(group).alias("key"), F.col(h).alias("h"), "size")
    lines = source_lines(slim, "size", "key", "h", "first", "source_size", parts).select("key", "first", "size")
    sizes = slim.groupBy("key").agg(F.sum("size").alias("source_size"))
    sources = draws(targets(sizes), block_words)
    lines = lines.join(sources.select("key", "words", "blocks", "drawn", "start"), "key")
    visits = schedule(lines, parts).groupBy("key", "block").agg(F.count(F.lit(1)).alias("visits"))
    pieces = lines.filter("size > 0").selectExpr(
        "key", "first", "size", "words", "explode(sequence(first div words, (first + size - 1) div words, 1L)) as block"
    )
    shared = F.expr("least(first + size, (block + 1) * words) - greatest(first, block * words)")
    taken = (
        pieces.join(visits, ["key", "block"])
        .groupBy("key", "first")
        .agg(F.sum(shared * F.col("visits")).alias("taken"))
        .select(F.col("key").alias(group), F.col("first").alias(at), "taken")
    )
    # rows without words share their place with the next row: they look for none, each at a place of its own
    looked = lined.withColumn(
        at, F.when(F.col("size") > 0, F.col(first)).otherwise(-1 - F.shiftrightunsigned(F.col(h), 1))
    )
    meant = sources.select(F.col("key").alias(group), "source_size", "target")
    return (
        looked.join(taken, [group, at], "left")
        .join(meant, group)
        .select(*quoted, "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"),
                F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
    )


def mixed_copies(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a mix as often as it takes them: ``taken`` / ``size``, to the nearest whole number.

    A row without words has no share in any target and stays once.
    """
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5).cast("int"))
    copies, copy = fresh([*mixed.columns, *columns], "copies", "copy")
    repeated = mixed.withColumn(copies, times).filter(F.col(copies) > 0)
    return repeated.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[f"`{c}`" for c in columns])
