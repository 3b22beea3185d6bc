"""Readers of landed files, each with a declared schema and dirty values made null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tremor.functions.scalars import finite, normalised_key, safe_date


class MissingArtifact(FileNotFoundError):
    pass


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def load_frame(spark: SparkSession, root: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """A saved table; names the artifact when it is missing."""
    path = f"{root}/{name}.parquet"
    if not path_exists(spark, path):
        raise MissingArtifact(f"artifact '{name}' not found at {path}; run the stage that writes it")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the first under an explicit total order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def number(c: str) -> Column:
    """Number from text with thousands commas; anything else is null."""
    return finite(F.expr(f"try_cast(replace(`{c}`, ',', '') AS DOUBLE)"))


def load_daily_series(spark: SparkSession, path: str, min_date: str | None = None, value: str = "close") -> DataFrame:
    """(date, value) from a headed CSV: coerced, nulls dropped, first row per date kept.

    ``seq`` is the file's own line order column, the tie-breaker of duplicates.
    """
    raw = spark.read.schema(f"seq LONG, date STRING, {value} STRING").csv(path, header=True)
    df = raw.select("seq", F.try_to_date("date", "yyyy-MM-dd").alias("date"), number(value).alias(value))
    df = df.where(F.col("date").isNotNull() & F.col(value).isNotNull())
    if min_date:
        df = df.where(F.col("date") >= F.lit(min_date).cast("date"))
    return keep_first(df, ["date"], ["seq"]).drop("seq")


def load_trade_files(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(daily volume over all files, count of rejected rows per file)."""
    schema = "date STRING, quantity STRING, _bad STRING"
    raw = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_bad").csv(paths, header=True)
    parsed = raw.select(
        F.try_to_date("date", "yyyy-MM-dd").alias("date"), number("quantity").alias("quantity"),
        F.input_file_name().alias("file"),
    )
    good = F.col("date").isNotNull() & F.col("quantity").isNotNull()
    volume = parsed.where(good).groupBy("date").agg(F.sum("quantity").alias("volume"))
    rejected = parsed.groupBy("file").agg(F.sum((~good).cast("long")).alias("n_rejected"), F.count("*").alias("n_rows"))
    return volume, rejected


def wide_to_panel(wide: DataFrame, date: str, excluded: list[str], min_coverage: float) -> DataFrame:
    """Wide sheet to (date, series_id, close), keeping series observed often enough."""
    drop = {e.lower() for e in excluded}
    cols = [c for c in wide.columns if c != date and c.lower() not in drop]
    long = wide.unpivot([date], cols, "series_id", "close")
    share = long.groupBy("series_id").agg(F.avg(F.col("close").isNotNull().cast("double")).alias("coverage"))
    kept = share.where(F.col("coverage") >= min_coverage)
    return long.join(kept, "series_id", "left_semi").where(F.col("close").isNotNull())


def html_rows(pages: DataFrame, html: str, row_tag: str, keys: list[str]) -> DataFrame:
    """Rows of a tag, in document order: (keys, pos, inner), over the whole text."""
    pattern = rf"(?s)<{row_tag}[^>]*>(.*?)</{row_tag}>"
    return pages.select(
        *keys, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1))).alias("pos", "inner")
    )


def html_cells(rows: DataFrame, cell_tag: str) -> DataFrame:
    """Adds the text of each cell, tags stripped."""
    pattern = rf"(?s)<{cell_tag}[^>]*>(.*?)</{cell_tag}>"
    cells = F.regexp_extract_all(F.col("inner"), F.lit(pattern), F.lit(1))
    return rows.withColumn("cells", F.transform(cells, lambda c: F.trim(F.regexp_replace(c, "<[^>]+>", ""))))


def html_price_table(pages: DataFrame, html: str) -> DataFrame:
    """(date, close) from table rows whose first cell is MM/DD/YYYY, first row per date."""
    rows = html_cells(html_rows(pages, html, "tr", ["page_id"]), "td")
    day, price = F.element_at("cells", 1), F.replace(F.element_at("cells", 2), F.lit(","), F.lit(""))
    picked = rows.where(F.size("cells") >= 2).select(
        "page_id", "pos",
        F.when(day.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_date(day, "MM/dd/yyyy")).alias("date"),
        price.try_cast("double").alias("close"),
    ).where("date IS NOT NULL AND close IS NOT NULL")
    return keep_first(picked, ["date"], ["page_id", "pos"]).select("date", "close")


def json_daily_parameters(payloads: DataFrame, key: str, payload: str, sentinel: float = -900.0) -> DataFrame:
    """(key, date, parameter, value) from {parameter: {yyyymmdd: value}}; sentinels become null."""
    parsed = payloads.select(key, F.from_json(payload, "map<string,map<string,double>>").alias("m"))
    return (
        parsed.select(key, F.explode("m").alias("parameter", "days"))
        .select(key, "parameter", F.explode("days").alias("day", "v"))
        .select(
            key, "parameter", F.try_to_date("day", "yyyyMMdd").alias("date"),
            F.when(F.col("v") > sentinel, F.col("v")).alias("value"),
        )
    )


def load_loss_xml(spark: SparkSession, path: str, row_tag: str = "TR") -> DataFrame:
    """Typed loss records from XML rows; rows without a valid date are dropped."""
    schema = "fechano STRING, fechames STRING, fechadia STRING, evento STRING, name1 STRING, afectados STRING, muertos STRING"
    raw = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    parts = [F.expr(f"try_cast({c} AS INT)") for c in ("fechano", "fechames", "fechadia")]
    return raw.select(
        safe_date(*parts).alias("date"), F.upper(F.trim("evento")).alias("evento"), "name1",
        number("afectados").alias("afectados"), number("muertos").alias("muertos"),
    ).where(F.col("date").isNotNull())


def load_rate_csv(spark: SparkSession, path: str) -> DataFrame:
    """(date, rate) from a CSV that marks gaps with a dot."""
    raw = spark.read.schema("date STRING, rate STRING").csv(path, header=True)
    return raw.select(F.try_to_date("date", "yyyy-MM-dd").alias("date"), number("rate").alias("rate")).where(
        "rate IS NOT NULL AND date IS NOT NULL"
    )


def load_bindings(spark: SparkSession, path: str) -> DataFrame:
    """(date, name) from JSON result bindings, first name per date."""
    value = "struct<value:string>"
    schema = f"results struct<bindings:array<struct<date:{value},name:{value}>>>"
    raw = spark.read.schema(schema).json(path)
    rows = raw.select(F.explode("results.bindings").alias("b")).select(
        F.try_to_date(F.substring("b.date.value", 1, 10), "yyyy-MM-dd").alias("date"), F.col("b.name.value").alias("name")
    )
    return keep_first(rows.where("date IS NOT NULL"), ["date"], ["name"])


def map_event_file(raw: DataFrame) -> DataFrame:
    """Event export to the canonical event schema.

    Missing month or day counts as 1 and lowers the date precision; the adjusted
    damage wins over the raw one; the magnitude is split by its unit.
    """
    y, m, d = F.col("start_year"), F.col("start_month"), F.col("start_day")
    precision = F.when(m.isNull(), "year_only").when(d.isNull(), "month_only").otherwise("exact_day")
    source = (
        F.when(F.col("damage_adjusted").isNotNull(), "cpi_adjusted")
        .when(F.col("damage").isNotNull(), "unadjusted_fallback")
        .otherwise("missing")
    )
    unit = F.lower(F.trim("magnitude_scale"))
    area = F.when(unit == "km2", F.col("magnitude"))
    wind = F.when(unit == "kph", F.col("magnitude"))
    flag = lambda c: c.isNotNull().cast("double")
    return raw.select(
        "event_id", safe_date(y, m, d).alias("event_date"), precision.alias("date_precision"),
        (precision == "exact_day").cast("double").alias("date_is_exact"), "type",
        (F.coalesce("damage_adjusted", "damage") * 1000.0).alias("damage"), source.alias("damage_source"),
        (source != "missing").cast("double").alias("damage_observed"),
        F.col("deaths").alias("deaths"), flag(F.col("deaths")).alias("deaths_available"),
        area.alias("mag_area"), wind.alias("mag_wind"), flag(area).alias("mag_area_available"), flag(wind).alias("mag_wind_available"),
    ).where(F.col("event_date").isNotNull())


def macro_by_year(long: DataFrame, year: str, series: str, value: str, names: list[str]) -> DataFrame:
    """One row per year, one column per named series, dated when it becomes public (July after)."""
    wide = long.groupBy(year).pivot(series, names).agg(F.first(value, ignorenulls=True))
    return wide.withColumn("available_from", F.make_date(F.col(year) + 1, F.lit(7), F.lit(1)))


def locate_column(columns: list[str], wanted: str) -> str | None:
    """The column whose header equals ``wanted`` after normalising, if any."""
    clean = lambda s: "".join(ch for ch in s.lower() if ch.isalnum())
    return next((c for c in columns if clean(c) == clean(wanted)), None)
