"""Human corrections over computed records: update the fields a correction names, insert records it brings whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a correction may change in a table, and what it must bring to insert one.
TABLE_FIELDS = ("title", "cols", "header_rows", "intro", "rows", "notes", "informativa", "regions")
TABLE_REQUIRED = ("article", "pages", "cols", "header_rows", "rows", "regions")


def merge(base: DataFrame, overlay: DataFrame, key: str, fields: list[str], constant: dict[str, Column] | None = None, defaults: dict[str, Column] | None = None, required: list[str] | None = None) -> DataFrame:
    """Full outer merge on key. Non-null overlay values win in `fields`; `constant` is set on every corrected row; a key that base lacks
    becomes a row of overlay values and `defaults`, and fails with the missing field's name if a required one is null or no column of overlay."""
    constant, defaults = constant or {}, defaults or {}
    o = overlay.select(*[F.col(c).alias("o_" + c) for c in overlay.columns])
    joined = base.withColumn("_base", F.lit(True)).join(o, F.col(key) == F.col("o_" + key), "full_outer")
    new, touched = F.col("_base").isNull(), F.col("o_" + key).isNotNull()
    missing = F.array_compact(F.array(*[F.when(F.col("o_" + c).isNull(), F.lit(c)) if c in overlay.columns else F.lit(c) for c in required or []])) if required else F.array().cast("array<string>")
    fail = F.when(new & (F.size(missing) > 0), F.raise_error(F.concat(F.lit("cannot insert "), F.col("o_" + key).cast("string"), F.lit(": missing "), F.array_join(missing, ", "))).cast("string"))

    def value(c: str) -> Column:
        if c == key:
            return F.coalesce(fail.cast(dict(base.dtypes)[c]), F.col(c), F.col("o_" + c))
        over = F.col("o_" + c) if "o_" + c in o.columns else F.lit(None)
        held = F.coalesce(over, F.col(c)) if c in fields else F.col(c)
        fresh = F.coalesce(over, defaults[c]) if c in defaults else over
        out = F.when(new, fresh).otherwise(held)
        return F.when(touched, constant[c]).otherwise(out) if c in constant else out

    return joined.select(*[value(c).alias(c) for c in base.columns])


def correct_tables(tables: DataFrame, overlay: DataFrame) -> DataFrame:
    """The overlay on reconstructed tables: a corrected table is verified and its quality is no estimate any more."""
    o = overlay if "verificada" in overlay.columns else overlay.withColumn("verificada", F.lit(None).cast("string"))
    title = F.col("o_title")
    defaults = {"sin_numero": title.isNull() | (title == ""), "informativa": F.lit(False), "page": F.col("o_pages")[0], "intro": F.lit(""), "grid": F.lit("dibujada"), "notes": F.array().cast("array<string>"), "encabezado_dudoso": F.lit(False), "verificada": F.col("o_verificada")}
    defaults = {k: v for k, v in defaults.items() if k in tables.columns}
    constant = {"quality": F.lit(1.0), "verificada": F.col("o_verificada")}
    return merge(tables, o, "id", list(TABLE_FIELDS), {k: v for k, v in constant.items() if k in tables.columns}, defaults, list(TABLE_REQUIRED))
