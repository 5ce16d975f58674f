"""Fields over time: discovery, axes, series, signals and correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import facts, parse
from .ordered import CHUNK, Scan

KEY = ["file", "line_no"]


def field_rows(lines: DataFrame) -> DataFrame:
    """A row for each field of each line."""
    return lines.select(*KEY, F.explode(parse.extract_fields("text")).alias("name", "raw"))


def discover_fields(lines: DataFrame) -> DataFrame:
    """Fields by name: majority type, occurrences, distinct values, three examples."""
    rows = field_rows(lines).withColumn("type", parse.classify_value("raw"))
    by_value = rows.groupBy("name", "raw", "type").agg(F.count(F.lit(1)).alias("n"))
    by_type = by_value.groupBy("name", "type").agg(F.sum("n").alias("n"))
    kind = by_type.groupBy("name").agg(F.max_by("type", F.struct("n", "type")).alias("type"), F.sum("n").alias("occurrences"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy("raw"))
    first = by_value.select("name", "raw").distinct().withColumn("_r", rank).where("_r <= 3").groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("raw")), "|").alias("examples"))
    distinct = by_value.groupBy("name").agg(F.count_distinct("raw").alias("distinct"))
    return kind.join(distinct, "name").join(first, "name")


# Names of fields that are clocks, and of ones that are durations or rates.
CLOCK_NAME = r"(?i)(^|[_.])(time|timestamp|ts|clock|epoch|date|uptime|monotonic|elapsedrealtime)($|[_.\d])"
DURATION_NAME = r"(?i)(rate|hz|freq|fps|offset|deadline|duration|interval|latency|delay|timeout|period|count|nanos?|millis?|micros?)"


def axis(lines: DataFrame, spec: str) -> Column:
    """The x of a line (see :func:`..functions.parse.axis_value`), from its stored time if it has one."""
    return parse.epoch_ms(facts.ts(lines)).cast("double") if spec == "time" else parse.axis_value(spec)


def discover_axes(lines: DataFrame, specs: list[str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """Axes of each file, with a score: ``line``, ``time``, ``relative`` and numeric fields (all of
    them, or the given specs).

    An axis needs half of the lines and more than one value.  Times score highest, then fields
    with a clock's name by coverage and by the square of the share of steps that do not fall;
    other fields stay below the line number's 0.15, and fields with a duration's name that do not
    rise nearly always are no axis.
    """
    total = lines.groupBy("file").agg(F.count(F.lit(1)).alias("_n"))
    entry = lambda name, x: F.struct(name.alias("axis"), x.cast("double").alias("x"))
    plain = ["line", "time", "relative"] if specs is None else specs
    values = F.array(*[entry(F.lit(x), axis(lines, x)) for x in plain])
    if specs is None:
        fields = F.transform(F.map_entries(parse.extract_fields("text")), lambda e: entry(F.concat(F.lit("field:"), e["key"]), parse.to_num(e["value"])))
        values = F.concat(values, fields)
    long = lines.select(*KEY, F.explode(values).alias("v")).select(*KEY, "v.axis", "v.x").where("x is not null")
    before = Scan(long, by=("file", "axis"), chunk=chunk).lag("x", "_prev")
    rising = F.avg((F.col("x") >= F.col("_prev")).cast("double"))
    out = before.groupBy("file", "axis").agg(F.count(F.lit(1)).alias("points"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.round(F.coalesce(rising, F.lit(1.0)), 6).alias("monotone")).join(total, "file")
    out = out.withColumn("coverage", F.round(F.col("points") / F.col("_n"), 6)).where((F.col("coverage") >= 0.5) & (F.col("x_max") > F.col("x_min")) | (F.col("axis") == "line"))
    name, mono = F.substring_index("axis", ":", -1), F.col("monotone")
    clock = name.rlike(CLOCK_NAME)
    by_field = F.col("coverage") * mono * mono
    score = (
        F.when(F.col("axis") == "line", 0.15).when(F.col("axis") == "time", 0.9 + 0.1 * mono).when(F.col("axis") == "relative", 0.85 + 0.1 * mono)
        .when(clock, by_field).otherwise(F.least(by_field, F.lit(0.12)))
    )
    is_field = F.col("axis").startswith("field:")
    return out.where(~(is_field & name.rlike(DURATION_NAME) & ~clock & (mono < 0.9))).withColumn("score", F.round(score, 6)).drop("_n")


def _bucketed(points: DataFrame, buckets: int) -> DataFrame:
    """Points (file, line_no, x, …) with their bucket; files without any x go by line number."""
    line = F.col("line_no").cast("double")
    ends = points.groupBy("file").agg(
        F.coalesce(F.min("x"), F.min(line)).alias("_x0"), F.coalesce(F.max("x"), F.max(line)).alias("_x1"), (F.count("x") == 0).alias("_bare")
    )
    at = F.when(F.col("_x1") > F.col("_x0"), F.floor((F.col("x") - F.col("_x0")) * buckets / (F.col("_x1") - F.col("_x0")))).otherwise(0)
    placed = points.join(ends, "file").withColumn("x", F.when(F.col("_bare"), line).otherwise(F.col("x"))).where("x is not null")
    return placed.withColumn("bucket", F.least(F.lit(buckets - 1), at).cast("long"))


def series(lines: DataFrame, field: str | None, axis_spec: str = "time", buckets: int = 200, pattern: str | None = None) -> DataFrame:
    """A field, or what a pattern finds, over an axis in so many buckets: points, sum, least, most,
    and the sum over all points of the bucket, numeric or not."""
    points = lines.select(*KEY, axis(lines, axis_spec).alias("x"), parse.value_of("text", field, pattern).alias("raw")).where("raw is not null")
    rows = _bucketed(points, buckets).withColumn("num", parse.series_num("raw"))
    return rows.groupBy("file", "bucket").agg(
        F.count(F.lit(1)).alias("points"), F.round(F.sum("num"), 6).alias("total"), F.min("num").alias("low"), F.max("num").alias("high"), F.round(F.sum("num") / F.count(F.lit(1)), 6).alias("average")
    )


def series_top_values(lines: DataFrame, field: str, axis_spec: str = "time", buckets: int = 200, k: int = 8) -> DataFrame:
    """The most frequent values of a field in each bucket."""
    points = lines.select(*KEY, axis(lines, axis_spec).alias("x"), parse.field("text", field).alias("value")).where("value is not null")
    counts = _bucketed(points, buckets).groupBy("file", "bucket", "value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("file", "bucket").orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def signals(lines: DataFrame, fields: list[str], buckets: int = 100) -> DataFrame:
    """Several numeric fields in buckets of equally many lines: points, average, least, most, the
    first line and its time, and the average on a scale from the field's least to its most value.  No fields give no rows."""
    total = lines.groupBy("file").agg((F.max("line_no") + 1).alias("_n"))
    values = F.array(*[F.struct(F.lit(f).alias("field"), parse.to_num(parse.field("text", f)).alias("v")) for f in fields]).cast("array<struct<field:string,v:double>>")
    rows = lines.select(*KEY, parse.epoch_ms(facts.ts(lines)).alias("ms"), F.explode(values).alias("e")).where("e.v is not null").join(total, "file")
    bucket = F.floor(F.col("line_no") / F.ceil(F.col("_n") / buckets)).cast("long").alias("bucket")
    out = rows.groupBy("file", F.col("e.field").alias("field"), bucket).agg(
        F.count(F.lit(1)).alias("points"), F.avg("e.v").alias("average"), F.min("e.v").alias("low"), F.max("e.v").alias("high"),
        F.min("line_no").alias("first_line"), F.min_by("ms", "line_no").alias("first_ms"),
    )
    whole = Window.partitionBy("file", "field")  # at most so many buckets
    low, high = F.min("low").over(whole), F.max("high").over(whole)
    scaled = F.when(high > low, (F.col("average") - low) / (high - low)).otherwise(0.0)
    return out.withColumn("scaled", F.round(scaled, 6)).withColumn("average", F.round("average", 6))


def correlate(lines: DataFrame, field: str, event: str) -> DataFrame:
    """A field's statistics on lines with and without a text."""
    num = parse.to_num(parse.field("text", field))
    rows = lines.select("file", num.alias("v"), F.contains(F.lower("text"), F.lit(event.lower())).alias("with_event")).where("v is not null")
    return rows.groupBy("file", "with_event").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.round(F.avg("v"), 6).alias("mean"))


def correlate_values(lines: DataFrame, field: str, event: str, k: int = 15) -> DataFrame:
    """The most frequent values of a field on lines with and without a text."""
    rows = lines.select(parse.field("text", field).alias("value"), F.contains(F.lower("text"), F.lit(event.lower())).alias("with_event")).where("value is not null")
    counts = rows.groupBy("with_event", "value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("with_event").orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def recurring_templates(lines: DataFrame, least: int = 5, k: int = 12) -> DataFrame:
    """The most frequent line shapes that are timed somewhere and have a distinctive text."""
    rows = lines.select(parse.line_template("text").alias("template"), facts.ts(lines).isNotNull().alias("timed"))
    counts = rows.groupBy("template").agg(F.count(F.lit(1)).alias("n"), F.bool_or("timed").alias("timed")).where((F.col("n") >= least) & F.col("timed"))
    out = counts.withColumn("literal", parse.template_literal("template")).where(F.length("literal") >= 4)
    return out.orderBy(F.desc("n"), "template").limit(k).select("template", "n", "literal")


def top_repeats(lines: DataFrame, k: int = 20) -> DataFrame:
    counts = lines.groupBy(parse.noise_key("text").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "key").limit(k)


def field_summary(lines: DataFrame, field: str) -> DataFrame:
    v = parse.to_num(parse.field("text", field))
    return lines.select("file", v.alias("v")).where("v is not null").groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.round(F.avg("v"), 6).alias("average"))


def largest(lines: DataFrame, field: str, k: int = 10) -> DataFrame:
    """The lines with the highest values of a field."""
    v = parse.to_num(parse.field("text", field))
    return lines.withColumn("value", v).where("value is not null").orderBy(F.desc("value"), *KEY).limit(k).select(*KEY, "value")


def same_column(values: Column) -> Column:
    """What all values of a column share at its start: that of the least and the greatest."""
    low, high = F.min(values), F.max(values)
    n = F.least(F.length(low), F.length(high))
    return F.substring(low, 1, F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (F.substr(low, i, F.lit(1)) == F.substr(high, i, F.lit(1))), i).otherwise(acc)))
