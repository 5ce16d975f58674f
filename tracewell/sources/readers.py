"""Readers: text, JSON lines, cloud log records and folders as numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import facts, parse
from .store import store

TIME_KEYS = ["timestamp", "@timestamp", "time", "ts", "date"]
LEVEL_KEYS = ["level", "severity", "lvl", "loglevel"]
MESSAGE_KEYS = ["message", "msg", "text", "event"]


def read_lines(spark: SparkSession, path: str | list[str], max_len: int | None = None, skip_split_headers: bool = True, recursive: bool = False) -> DataFrame:
    """Text files as ``(file, line_no, text)``, numbered from 0 in each file.

    Spark reads a split in order inside one task, so rows get a task-wide number there; a
    count of rows for each split (a few rows) then gives each split its first line number.
    LF and CRLF end lines.  ``max_len`` cuts long lines with a mark.  A first line
    ``#SPLIT:part=..`` is dropped.
    """
    raw = (
        spark.read.option("recursiveFileLookup", str(recursive).lower()).text(path)
        .select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_id"), F.rtrim(F.col("value"), F.lit("\r")).alias("text"),
        )
    )
    blocks = raw.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    lines = raw.join(starts, ["file", "_block"]).select("file", (F.col("_start") + F.col("_id") - F.col("_first")).alias("line_no"), "text")
    if skip_split_headers:
        lines = without_split_headers(lines)
    if max_len:
        lines = lines.withColumn("text", F.when(F.length("text") > max_len, F.concat(F.substring("text", 1, max_len), F.lit(" … (truncated)"))).otherwise(F.col("text")))
    return lines


def parsed(lines: DataFrame) -> DataFrame:
    """Lines with what verbs read from their text, written once in the shared folder: several
    verbs over the same lines then read it instead of parsing again."""
    return store(facts.with_facts(lines), "parsed")


def without_split_headers(lines: DataFrame) -> DataFrame:
    """Lines without a first line that only tells which part of a split log the file is."""
    heads = lines.where((F.col("line_no") == 0) & F.col("text").startswith("#SPLIT:")).select("file", F.lit(1).alias("_head"))
    return lines.join(heads, "file", "left").where("_head is null or line_no > 0").select(
        "file", (F.col("line_no") - F.coalesce("_head", F.lit(0))).cast("long").alias("line_no"), *[c for c in lines.columns if c not in ("file", "line_no")]
    )


def part_number(file: str | Column) -> Column:
    """The n of ``name_part<n>.ext``; 0 for other names."""
    c = F.col(file) if isinstance(file, str) else file
    return F.coalesce(F.regexp_extract(c, r"_part(\d+)(?:\.[^./]*)?$", 1).try_cast("int"), F.lit(0))


def _first_of(keys: list[str]) -> Column:
    return F.coalesce(*[F.col("_m")[k] for k in keys])


def json_lines(lines: DataFrame) -> DataFrame:
    """JSON objects as ``time LEVEL message k=v …``; what is no object stays as it is."""
    used = F.array(*[F.coalesce(*[F.when(F.col("_m")[k].isNotNull(), k) for k in keys]) for keys in (TIME_KEYS, LEVEL_KEYS, MESSAGE_KEYS)])
    rest = F.transform(
        F.filter(F.map_entries("_m"), lambda e: ~F.coalesce(F.array_contains(F.col("_used"), e["key"]), F.lit(False))),
        lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))),
    )
    text = F.concat_ws(" ", _first_of(TIME_KEYS), F.upper(_first_of(LEVEL_KEYS)), _first_of(MESSAGE_KEYS), rest)
    object_like = F.trim("text").rlike(r"^\{.*\}$")
    parsed = lines.withColumn("_m", F.when(object_like, F.from_json("text", "map<string,string>")))
    parsed = parsed.withColumn("_used", F.filter(used, lambda x: x.isNotNull()))
    return parsed.withColumn("text", F.when(F.size("_m") > 0, text).otherwise(F.col("text"))).drop("_m", "_used")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(read_lines(spark, path))


def log_records(records: DataFrame) -> DataFrame:
    """Cloud log rows (timestamp text or epoch milliseconds, status, service, message, rest) to
    text ``time [STATUS] service - message``; without a message the rest as JSON."""
    stamp = F.coalesce(
        F.date_format(F.timestamp_millis(F.col("timestamp").try_cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.col("timestamp")
    )
    status = F.concat(F.lit("["), F.upper("status"), F.lit("]"))
    head = F.concat_ws(" ", stamp, status, F.col("service"))
    return records.select(F.concat_ws(" - ", head, F.coalesce("message", "rest")).alias("text"))


def compose(lines: DataFrame) -> DataFrame:
    """Files in order of part number and name as one line space: ``global_line_no``.

    Only the sums of lines by file pass through one task: a row for each file.
    """
    sizes = lines.groupBy("file").agg((F.max("line_no") + 1).alias("_n"))
    before = Window.orderBy(part_number("file"), "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("first_global"))
    return lines.join(starts, "file").withColumn("global_line_no", F.col("first_global") + F.col("line_no"))


def read_folder(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("log", "txt", "out", "json", "jsonl", "csv"), depth: int = 3) -> DataFrame:
    """All text files below a folder, without hidden and build folders, to a depth."""
    lines = read_lines(spark, path, recursive=True)
    below = F.regexp_replace("file", r"^[a-z]+:/*", "/")
    root = path.split("://")[-1].rstrip("/")
    rest = F.substring_index(below, root + "/", -1)
    return lines.where(
        F.col("file").rlike(r"\.(" + "|".join(extensions) + ")$")
        & ~rest.rlike(r"(^|/)(\.[^/]*|node_modules|dist|build|target|__pycache__)/")
        & (F.size(F.split(rest, "/")) <= depth + 1)
    )


def detect_format(lines: DataFrame, head: int = 5) -> DataFrame:
    """One guess for each file from its first lines: json, xml, csv, keyvalue, syslog or text."""
    t = F.trim("text")
    seen = lines.where((F.col("line_no") < head) & (t != "")).groupBy("file").agg(
        F.bool_and(t.rlike(r"^\{.*\}$")).alias("json"), F.bool_or(t.rlike(r"^<\?xml|^<[A-Za-z]")).alias("xml"),
        F.bool_and(F.regexp_count(t, F.lit(r"[A-Za-z_][A-Za-z0-9_.]*=")) >= 2).alias("kv"), F.bool_and(t.rlike("^" + parse.SYSLOG)).alias("syslog"),
        (F.min(F.regexp_count(t, F.lit(","))) == F.max(F.regexp_count(t, F.lit(",")))).alias("even"), F.min(F.regexp_count(t, F.lit(","))).alias("commas"),
    )
    kind = (
        F.when(F.col("json"), "json").when(F.col("xml"), "xml").when(F.col("kv"), "keyvalue").when(F.col("syslog"), "syslog")
        .when(F.col("even") & (F.col("commas") >= 1), "csv").otherwise("text")
    )
    return seen.select("file", kind.alias("format"))


def get_lines(lines: DataFrame, start: int, count: int) -> DataFrame:
    return lines.where(F.col("line_no").between(start, start + count - 1))


def get_lines_by_numbers(lines: DataFrame, numbers: DataFrame) -> DataFrame:
    """Lines whose (file, line_no) or line_no is listed."""
    return lines.join(numbers.distinct(), [c for c in ("file", "line_no") if c in numbers.columns], "left_semi")


DELIMITERS = {"\t": "tab", ",": "comma", "|": "pipe", ";": "semicolon", " ": "space", ":": "colon"}


def delimiter_scores(lines: DataFrame, head: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Score of each delimiter over all lines but the first (for each of the columns ``by``), to
    line ``head`` if that is given: average count x share of lines with the usual count x share of
    lines with any; a colon in times counts three tenths."""
    some = lines.where((F.col("line_no") >= 1) & (F.trim("text") != ""))
    if head is not None:
        some = some.where(F.col("line_no") <= head)
    rows = F.array(*[F.struct(F.lit(n).alias("delimiter"), F.regexp_count("text", F.lit("[" + ("\\|" if d == "|" else "\\t" if d == "\t" else d) + "]")).alias("n")) for d, n in DELIMITERS.items()])
    long = some.select(*by, F.explode(rows).alias("d"), F.col("text").rlike(r"\d{2}:\d{2}").alias("timed")).select(*by, "d.delimiter", "d.n", "timed")
    # few different counts: all sums follow from how often each occurs
    tally = long.groupBy(*by, "delimiter", "n").agg(F.count(F.lit(1)).alias("lines"), F.count_if("timed").alias("timed"))
    lines_, n = F.col("lines"), F.col("n")
    sums = tally.groupBy(*by, "delimiter").agg(
        (F.sum(n * lines_) / F.sum(lines_)).alias("avg"), (F.sum(F.when(n > 0, lines_).otherwise(0)) / F.sum(lines_)).alias("presence"), (F.sum("timed") / F.sum(lines_)).alias("timed"),
        (F.max(lines_) / F.sum(lines_)).alias("consistency"), F.min_by("n", F.struct(-lines_, n)).alias("usual"),
    )
    weight = F.when((F.col("delimiter") == "colon") & (F.col("timed") > 0.8), 0.3).otherwise(1.0)
    return sums.select(*by, "delimiter", F.round(F.col("avg") * F.col("consistency") * F.col("presence") * weight, 6).alias("score"), "usual")
