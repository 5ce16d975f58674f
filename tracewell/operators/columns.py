"""Logs with columns: their delimiter, header, roles and types, file by file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import facts, parse
from ..sources import readers

ROLES = ["timestamp", "level", "message", "source", "channel"]


def delimiters(lines: DataFrame) -> DataFrame:
    """``(file, delimiter, score, cells)``: each file's delimiter of the highest score, none below
    one; ``cells`` is the usual number of columns."""
    scores = readers.delimiter_scores(lines, by=("file",))
    best = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("score"), "delimiter"))
    found = scores.where("score > 1").withColumn("_r", best).where("_r = 1")
    return found.select("file", "delimiter", "score", (F.col("usual") + 1).alias("cells"))


def split_by(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Lines with ``cells``, cut by their file's delimiter; null where it has none."""
    by = F.coalesce(*[F.when(F.col("delimiter") == name, parse.split_columns("text", mark)) for mark, name in readers.DELIMITERS.items()])
    return lines.join(found.select("file", "delimiter"), "file", "left").withColumn("cells", by)


def analyze_columns(lines: DataFrame, samples: int = 5) -> DataFrame:
    """A row for each column of each file: its name (of the header, else ``column<n>``), role, type
    of most values, non-empty values, and the first different values as samples."""
    found = delimiters(lines)
    rows = split_by(lines, found).where("cells is not null")
    heads = rows.where((F.col("line_no") == 0) & parse.is_header("text"))
    names = heads.select("file", F.posexplode("cells").alias("place", "name"))
    body = rows.join(heads.select("file", F.lit(0).cast("long").alias("line_no")), ["file", "line_no"], "left_anti")
    values = body.select("file", "line_no", F.posexplode("cells").alias("place", "value")).where("value != ''")
    by_value = values.withColumn("type", parse.classify_value("value")).groupBy("file", "place", "type", "value").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first"))
    kinds = by_value.groupBy("file", "place", "type").agg(F.sum("n").alias("n")).groupBy("file", "place").agg(F.max_by("type", F.struct("n", "type")).alias("type"), F.sum("n").alias("values"))
    order = F.row_number().over(Window.partitionBy("file", "place").orderBy("first", "value"))
    shown = by_value.withColumn("_r", order).where(F.col("_r") <= samples).groupBy("file", "place").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "value"))), lambda x: x["value"]), "|").alias("samples")
    )
    out = kinds.join(shown, ["file", "place"]).join(names, ["file", "place"], "left")
    name = F.coalesce(F.trim("name"), F.concat(F.lit("column"), (F.col("place") + 1).cast("string")))
    role = F.when(F.col("name").isNotNull(), parse.header_role("name")).otherwise("other")
    return out.select("file", "place", name.alias("name"), role.alias("role"), "type", "values", "samples")


def column_table(lines: DataFrame, delimiter: str, names: list[str] | None = None) -> DataFrame:
    """A delimited log as a table with typed columns.  Names come from the header of the files'
    first lines if none are given; values that read as numbers or booleans throughout are cast.
    Only the header's cells and one type for each column reach the driver."""
    rows = lines.select("file", "line_no", parse.split_columns("text", delimiter).alias("_cells"), "text")
    body = rows
    if names is None:
        head = rows.where((F.col("line_no") == 0) & parse.is_header("text"))
        first = head.agg(F.min(F.struct("file", "_cells"))["_cells"].alias("c")).first()
        width = rows.agg(F.max(F.size("_cells")).alias("n")).first()["n"] or 0
        names = [(x.strip() or f"column{k}") for k, x in enumerate(first["c"], 1)] if first["c"] else [f"column{k + 1}" for k in range(width)]
        body = rows.join(head.select("file", "line_no"), ["file", "line_no"], "left_anti")
    unique: list[str] = []
    for n in names:
        unique.append(n if n not in unique else f"{n}_{len(unique) + 1}")
    cells = [F.nullif(F.get("_cells", F.lit(k)), F.lit("")) for k in range(len(unique))]
    if not cells:
        return body.select("file", "line_no")
    wide = body.select("file", "line_no", *[c.alias(f"_{k}") for k, c in enumerate(cells)])
    tests = [F.struct(F.bool_and(F.col(f"_{k}").rlike(parse.NUMERIC)).alias("number"), F.bool_and(F.lower(f"_{k}").isin("true", "false")).alias("flag")).alias(f"t{k}") for k in range(len(unique))]
    kinds = wide.agg(*tests).first()
    typed = []
    for k, n in enumerate(unique):
        t = kinds[f"t{k}"]
        kind = "double" if t["number"] else "boolean" if t["flag"] else "string"
        typed.append(F.col(f"_{k}").try_cast(kind).alias(n))
    return wide.select("file", "line_no", *typed)


def by_role(lines: DataFrame) -> DataFrame:
    """Lines of files with a header, without it, with the cells that its names give a role:
    ``message``, ``level_cell``, ``component_cell`` (channel, else source); null for other files,
    where ``message`` is the last cell."""
    found = delimiters(lines)
    rows = split_by(lines, found)
    heads = rows.where((F.col("line_no") == 0) & parse.is_header("text"))
    places = heads.select("file", F.posexplode("cells").alias("place", "name")).withColumn("role", parse.header_role("name"))
    at = places.groupBy("file").pivot("role", ROLES).agg(F.min("place"))
    out = rows.join(heads.select("file", "line_no"), ["file", "line_no"], "left_anti").join(at, "file", "left")
    cell = lambda role: F.get("cells", F.col(role))
    last = F.try_element_at("cells", F.lit(-1))
    keep = [c for c in facts.forget(lines).columns if c not in ("message", "level_cell", "component_cell")]
    return out.select(*keep, F.coalesce(cell("message"), last, F.col("text")).alias("message"), cell("level").alias("level_cell"), F.coalesce(cell("channel"), cell("source")).alias("component_cell"))
