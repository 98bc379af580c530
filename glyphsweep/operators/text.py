"""Operators over text tables: clean, find, profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from glyphsweep.functions import raw
from glyphsweep.functions.bind import sql_over
from glyphsweep.functions.hidden import (
    FINDINGS_TYPE,
    category_classes,
    category_sql,
    contains_hidden,
    find_hidden_array,
    hidden_hits,
    pieces,
    strip_hidden,
    strip_hidden_bytes,
    u_plus_sql,
)
from glyphsweep.rules import (
    HIDDEN_RULES,
    UNKNOWN_CATEGORY,
    typography_rules,
)



def _names(columns: str | Sequence[str]) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def _is_bytes(df: DataFrame, col: str) -> bool:
    return df.select(col).schema[0].dataType == BinaryType()


def _text(df: DataFrame, col: str) -> Column:
    """The column as a string; bytes that are not UTF-8 stay in it as they are."""
    return F.col(col).cast("string") if _is_bytes(df, col) else F.col(col)


def clean_text(df: DataFrame, col: str, cleaned: str = "cleaned", **opts) -> DataFrame:
    """Add the cleaned text and whether it differs.

    A BINARY column gives bytes again; what is not UTF-8 in it stays as it is.
    """
    strip = strip_hidden_bytes if _is_bytes(df, col) else strip_hidden
    return df.withColumns(
        {cleaned: strip(col, **opts), "changed": contains_hidden(_text(df, col), **opts)}
    )


def with_findings(df: DataFrame, col: str, name: str = "findings", **opts) -> DataFrame:
    """Add the findings of each row as an array; empty for a clean text."""
    text = _text(df, col)
    found = (
        F.when(contains_hidden(text, **opts), find_hidden_array(text, **opts))
        .when(F.col(col).isNotNull(), F.array().cast(FINDINGS_TYPE))
    )
    return df.withColumn(name, found)


def find_hidden(
    df: DataFrame, key: str | Sequence[str], col: str, ordered: bool = False, **opts
) -> DataFrame:
    """One row per hidden character with its byte offset, line and column.

    Positions are worked out inside the row, so nothing is shuffled; ``ordered`` adds
    the one sort by key and offset. The column may be BINARY: a byte that is not UTF-8
    is one byte and one column.
    """
    keys, text = _names(key), _text(df, col)
    # The outer generator adds no row, no dirty text being without findings, and keeps
    # the optimizer from testing the array's size in a filter that computes it again.
    found = df.where(contains_hidden(text, **opts)).select(
        *keys, F.inline_outer(find_hidden_array(text, **opts))
    )
    return found.orderBy(*keys, "offset") if ordered else found


def running_positions(
    df: DataFrame, key: str | Sequence[str], col: str, **opts
) -> DataFrame:
    """``find_hidden`` with window sums over the exploded hits.

    For texts with so many hits that their findings should not be held in one row:
    pieces are measured one by one, only integers are shuffled, and the windows stream
    over each text's hits. ``key``
    must be unique.
    """
    keys, text = _names(key), _text(df, col)
    # cut before it is exploded: what stands beside a generator is computed again for every piece
    whole = df.where(contains_hidden(text, **opts)).select(
        *keys, F.is_valid_utf8(text).alias("_valid"), pieces(text, **opts).alias("_pieces"))
    cut = whole.select(*keys, "_valid", F.posexplode_outer("_pieces").alias("pos", "piece"))
    feeds = F.octet_length("piece") - F.octet_length(F.replace("piece", F.lit("\n"), F.lit("")))
    last_line = F.substring_index("piece", "\n", -1)

    def either(whole: Column, as_bytes: Column) -> Column:
        return F.when(F.col("_valid"), whole).otherwise(as_bytes)

    measured = cut.select(
        *keys, "pos", either(F.ascii("piece"), F.expr(raw.rune_sql("piece"))).alias("head"),
        either(F.octet_length("piece"), F.char_length("piece")).cast("long").alias("bytes"),
        feeds.cast("long").alias("lines"),
        either(F.char_length(last_line), sql_over(last_line, raw.units_sql("t"))).cast("long").alias("chars"),
    )
    # a piece ends where the hit stands that the next one begins with
    ends = Window.partitionBy(*keys).orderBy("pos")
    hits = measured.withColumn("rune", F.lead("head").over(ends)).where("rune IS NOT NULL")
    so_far = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = hits.select(
        *keys, "pos", "rune", "chars",
        (F.sum("bytes").over(so_far) - 1).alias("offset"),
        (F.sum("lines").over(so_far) + 1).alias("line"),
    )
    on_line = Window.partitionBy(*keys, "line").orderBy("pos").rowsBetween(
        Window.unboundedPreceding, 0
    )
    ahead = F.sum("chars").over(on_line)
    return placed.select(
        *keys,
        "rune",
        F.expr(u_plus_sql("rune")).alias("u"),
        "offset",
        "line",
        F.when(F.col("line") == 1, ahead).otherwise(ahead + 1).alias("col"),
        F.expr(category_sql("rune", opts.get("extra", ()))).alias("category"),
    )


def code_points(spark: SparkSession, typography: bool = True) -> DataFrame:
    """The character rules as a table: lo, hi, category, replacement."""
    rules = (*HIDDEN_RULES, *(typography_rules() if typography else ()))
    rows = [(lo, hi, r.category, r.replacement) for r in rules for lo, hi in r.ranges]
    return spark.createDataFrame(rows, "lo int, hi int, category string, replacement string")


def disjoint_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges (lo, hi, category) cut into pieces (lo, hi, category) that do not overlap.

    Where ranges overlap, the one of the least ``priority`` counts if there is such a
    column (null is last), then the narrowest, then the one that begins first, then the
    first by name. Empty ranges and bounds beyond Unicode are dropped or cut. The sweep
    goes block by block of 256 code points, so its work is bounded by Unicode's size,
    however many ranges there are, and no task sees more than its blocks.
    """
    order = F.col("priority") if "priority" in ranges.columns else F.lit(None).cast("int")
    lo, hi = F.greatest(F.col("lo"), F.lit(0)), F.least(F.col("hi"), F.lit(0x10FFFF))
    ranked = ranges.where(F.col("lo").isNotNull() & F.col("hi").isNotNull() & (lo <= hi)).select(
        lo.alias("lo"), hi.alias("hi"),
        F.struct(order.isNull().alias("last"), order.alias("priority"), (F.col("hi") - F.col("lo")).alias("width"),
                 F.col("lo").alias("from"), F.col("category").alias("category")).alias("rank"))
    blocks = ranked.select("*", F.explode(F.sequence(F.shiftright("lo", 8), F.shiftright("hi", 8))).alias("block"))
    start = F.col("block") * 256
    # of ranges alike within the block the best is enough
    cut = blocks.groupBy("block", F.greatest("lo", start).alias("lo"), F.least("hi", start + 255).alias("hi")).agg(F.min("rank").alias("rank"))
    points = cut.select("block", "rank", F.explode(F.sequence("lo", "hi")).alias("cp")).groupBy("block", "cp").agg(F.min("rank").alias("rank"))
    named = points.select("block", "cp", F.col("rank.category").alias("category"))
    # neighbours of one category are a piece: their places less their ranks agree
    along = Window.partitionBy("block", "category").orderBy("cp")
    islands = named.withColumn("island", F.col("cp") - F.row_number().over(along))
    return islands.groupBy("block", "category", "island").agg(F.min("cp").alias("lo"), F.max("cp").alias("hi")).select("lo", "hi", "category")


def categorize(
    findings: DataFrame, ranges: DataFrame | None = None, rune: str = "rune"
) -> DataFrame:
    """Label code points by a table of ranges (lo, hi, category, perhaps priority).

    Ranges may overlap; ``disjoint_ranges`` says which counts. They are spread over blocks
    of 256 code points, so the range join is an equality join on the block.
    """
    if ranges is None:
        rules = F.broadcast(code_points(findings.sparkSession).select("lo", "hi", "category"))
    else:  # adaptive execution sees the size of the table and splits a frequent block
        rules = disjoint_ranges(ranges)
    first, last = F.shiftright("lo", 8), F.shiftright("hi", 8)
    blocks = rules.select(
        F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("category").alias("_category"),
        F.explode(F.sequence(first, last)).alias("_block"),
    )
    joined = findings.join(
        blocks,
        (F.shiftright(rune, 8) == F.col("_block"))
        & F.col(rune).between(F.col("_lo"), F.col("_hi")),
        "left",
    )
    label = F.coalesce(F.col("_category"), F.lit(UNKNOWN_CATEGORY))
    kept = [F.col(c) for c in findings.columns if c != "category"]
    return joined.select(*kept, label.alias("category"))


def profile_counts(df: DataFrame, col: str, keep: Sequence[Column | str], **opts) -> DataFrame:
    """Rows with hidden characters, with their number per category (``n_0``, ``n_1``, ...).

    The text is scanned once for its hits; the categories are counted in those.
    """
    hits = F.array_join(hidden_hits(col, **opts), "").alias("_hits")
    dirty = df.where(contains_hidden(col, **opts)).select(*keep, hits)
    names = [c for c in dirty.columns if c != "_hits"]
    counts = [
        F.regexp_count("_hits", F.lit(cls)).cast("long").alias(f"n_{i}")
        for i, cls in enumerate(category_classes(opts.get("extra", ())).values())
    ]
    return dirty.select(*names, *counts)


def profile_categories(opts: dict) -> list[str]:
    return list(category_classes(opts.get("extra", ())))


def unpivot_profile(wide: DataFrame, by: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """``h_i``/``d_i`` columns to (category, n_hits, n_docs) rows, empty ones dropped."""
    rows = F.array(*[
        F.struct(
            F.lit(label).alias("category"),
            F.col(f"h_{i}").alias("n_hits"),
            F.col(f"d_{i}").alias("n_docs"),
        )
        for i, label in enumerate(categories)
    ])
    return wide.select(*by, F.inline(F.filter(rows, lambda r: r["n_hits"] > 0)))


def profile_hidden(
    df: DataFrame,
    col: str,
    by: str | Sequence[str] = (),
    key: str | Sequence[str] | None = None,
    rollup: bool = False,
    **opts,
) -> DataFrame:
    """Hits and dirty documents per category and per group of ``by``.

    Each row is one document unless ``key`` names its identity. Every dirty row enters
    the aggregation once, as a row of counters, and is combined before the shuffle, so
    neither the number of hits nor a dominant group makes a partition large.

    ``rollup`` adds subtotals: ``level`` is 0 for (by, category), 1 for (by), and one
    more for each column of ``by`` summed over; summed-over columns are null.
    """
    by = _names(by)
    categories = profile_categories(opts)
    n = len(categories)
    keys = _names(key or ())
    counts = profile_counts(df, col, list(dict.fromkeys([*by, *keys])), **opts)
    sums = [F.sum(f"n_{i}").alias(f"n_{i}") for i in range(n)]
    levels = sum((F.grouping(c).cast("int") for c in by), F.lit(0)).alias("_up")

    if keys:
        # Fold the rows of one document together first; in a rollup, once per level,
        # since a document may span groups.
        if rollup and by:
            sets = [[*by[: len(by) - up], *keys] for up in range(len(by) + 1)]
            counts = counts.groupingSets(
                sets, *dict.fromkeys([*by, *keys])
            ).agg(*sums, levels)
        else:
            counts = counts.groupBy(*dict.fromkeys([*by, *keys])).agg(*sums)

    any_hit = sum((F.col(f"n_{i}") for i in range(1, n)), F.col("n_0"))
    aggregates = [
        *[F.sum(f"n_{i}").alias(f"h_{i}") for i in range(n)],
        *[F.count_if(F.col(f"n_{i}") > 0).alias(f"d_{i}") for i in range(n)],
        F.sum(any_hit).alias("h_all"),
        F.count(F.lit(1)).alias("d_all"),
    ]
    if not rollup:
        return unpivot_profile(counts.groupBy(*by).agg(*aggregates), by, categories)

    if not by:
        wide = counts.agg(*aggregates).where(F.col("d_all") > 0).withColumn("_up", F.lit(0))
    elif keys:
        wide = counts.groupBy(*by, "_up").agg(*aggregates)
    else:
        wide = counts.rollup(*by).agg(*aggregates, levels)
    detail = [
        F.struct(
            F.lit(0).alias("level"), F.lit(label).alias("category"),
            F.when(F.col("_up") == 0, F.col(f"h_{i}")).alias("n_hits"),
            F.col(f"d_{i}").alias("n_docs"),
        )
        for i, label in enumerate(categories)
    ]
    total = F.struct(
        (F.col("_up") + 1).alias("level"), F.lit(None).cast("string").alias("category"),
        F.col("h_all").alias("n_hits"), F.col("d_all").alias("n_docs"),
    )
    rows = F.filter(F.array(*detail, total), lambda r: r["n_hits"] > 0)
    return wide.select(*by, F.inline(rows))


def hidden_rate(df: DataFrame, col: str, by: str | Sequence[str] = (), **opts) -> DataFrame:
    """Rows, dirty rows and the share of dirty rows per group."""
    dirty = contains_hidden(col, **opts)
    return df.groupBy(*_names(by)).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(dirty).alias("n_dirty"),
        F.avg(dirty.cast("int")).alias("dirty_rate"),
    )
