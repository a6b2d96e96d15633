"""What still needs review: risk, priority, four buckets and the signals behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights and limits of the review list.
DOUBT_RISK, NARROW, CRITICAL, DOUBTFUL, TRUSTED, MIN_USES, LONG_CELL = 0.6, 3.0, 1.0, 0.80, 0.95, 5, 28


def priority(tables: DataFrame) -> DataFrame:
    """tables(quality, encabezado_dudoso, usos, cols) with risk and prio."""
    risk = 1 - F.col("quality") + F.when(F.col("encabezado_dudoso"), DOUBT_RISK).otherwise(0.0)
    out = tables.withColumn("risk", risk)
    return out.withColumn("prio", F.col("usos") * F.col("risk") + F.col("risk") + F.when(F.col("cols") < 2, NARROW).otherwise(0.0))


def buckets(tables: DataFrame) -> DataFrame:
    """critical, doubtful, control and unflagged: flags, as a table may be both critical and control."""
    out = tables.withColumn("critical", F.col("prio") >= CRITICAL).withColumn("doubtful", (F.col("prio") < CRITICAL) & (F.col("quality") < DOUBTFUL))
    out = out.withColumn("control", (F.col("quality") >= TRUSTED) & ~F.col("encabezado_dudoso") & (F.col("usos") >= MIN_USES))
    return out.withColumn("unflagged", ~(F.col("critical") | F.col("doubtful") | F.col("control")))


def with_usage(tables: DataFrame, usage: DataFrame) -> DataFrame:
    return tables.join(usage.select("id", "usos"), "id", "left").fillna(0, ["usos"])


def unverified(tables: DataFrame) -> DataFrame:
    return tables.where(F.col("verificada").isNull())


def to_review(tables: DataFrame, below: float = DOUBTFUL) -> DataFrame:
    """Tables below the quality, worst first."""
    return tables.where(F.col("quality") < below).select("id", "quality", "cols", F.size("rows").alias("rows"), "pages", "title").orderBy("quality", "id")


def signals(merged_values: Column) -> Column:
    """The reasons to look at a table, as texts; merged_values counts its cells with several bare numbers."""
    return F.array_compact(
        F.array(
            F.when(F.col("cols") < 2, "one column only"),
            F.when(merged_values > 0, F.concat(merged_values.cast("string"), F.lit(" cells with several values"))),
            F.when(F.col("grid") == "huecos", "no drawn grid"),
            F.when(F.col("header_rows") == 0, "no header found"),
            F.when(F.col("encabezado_dudoso"), "a header column too many"),
            F.when(F.size("pages") > 1, F.concat(F.lit("spans "), F.size("pages").cast("string"), F.lit(" pages"))),
        )
    )


def ordered_buckets(tables: DataFrame) -> dict[str, DataFrame]:
    """Each bucket in its own order; ties by id in code point order."""
    return {
        "critical": tables.where("critical").orderBy(F.desc("prio"), "id"),
        "doubtful": tables.where("doubtful").orderBy(F.desc("usos"), "quality", "id"),
        "control": tables.where("control").orderBy(F.desc("usos"), "id"),
        "unflagged": tables.where("unflagged").orderBy("page", "id"),
    }


def display_flags(cells: DataFrame) -> DataFrame:
    """Cells (t, cs, row, header_rows) with `long` and the scope of header cells."""
    out = cells.withColumn("long", F.char_length("t") > LONG_CELL)
    return out.withColumn("scope", F.when(F.col("row") >= F.col("header_rows"), None).when(F.col("cs") > 1, "colgroup").otherwise("col"))
