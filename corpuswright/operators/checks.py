"""Documentation checks: numbers in Markdown tables and claims in prose against measured data, and broken links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBER = r"^-?[0-9][0-9,]*(\.[0-9]+)?$"


def table_cells(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, header, row, cell and first (the header of the rows' names) of every cell of the Markdown tables of each document. A table is a run of lines
    that begin with a bar; its first line is the header and its second the rule."""
    from .markdown import line_table

    lines = line_table(docs, key, text)
    # runs of table lines: the place minus the number of table lines so far is constant in a run
    from pyspark.sql.window import Window

    rows = lines.where("kind = 'table'").withColumn("run", F.col("pos") - F.row_number().over(Window.partitionBy("key").orderBy("pos")))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\s*\||\|\s*$", ""), r"\|"), lambda x: F.trim(x))
    rows = rows.withColumn("cells", cells).withColumn("k", F.row_number().over(Window.partitionBy("key", "run").orderBy("pos")))
    header = rows.where("k = 1").select("key", "run", F.col("cells").alias("header"))
    met = rows.where("k > 2").join(header, ["key", "run"])
    each = met.select("key", "pos", "header", F.get("header", F.lit(0)).alias("first"), F.get("cells", F.lit(0)).alias("row"), F.posexplode("cells").alias("at", "cell")).where("at > 0")
    return each.select("key", F.col("pos").alias("line"), F.get("header", F.col("at")).alias("header"), "row", "cell", "first")


# Column names that are no plain measure of their row: bound to days, derived, or of a cohort; what may stand
# before a measure's name.
SCOPED, DERIVED, COHORT, OPENING = r"\(\s*(?:\d+\s*-\s*\d+|\d+月|[^)]*日)\s*\)", r"(?:差|比|変化|倍|残存|%|\(件\)|件数)\s*\**\s*$", "デビュー|コホート|層|群|世代|期別", "[（(【\\[「 　]*"
LABELS = {"体言止め": "nominal_ending_ratio", "読点/文": "ten_per_sentence", "文長のばらつき": "burstiness_mora", "漢字率": "kanji_ratio", "地の文字数": "chars_body", "MTLD": "mtld"}


def field_of(header: Column, labels: dict[str, str] | None = None) -> Column:
    """The measure that a table's column shows, from its header; null for one that is scoped or derived, or where another
    word stands before the measure's name. The first label that occurs decides."""
    name = F.regexp_replace(F.trim(header), "^[* ]+|[* ]+$", "")
    out = F.when(name.rlike(SCOPED) | name.rlike(DERIVED), F.lit(None).cast("string"))
    for label, field in (labels or LABELS).items():
        quoted = "\\Q" + label + "\\E"
        out = out.when(name.rlike(quoted), F.when(name.rlike(f"^{OPENING}{quoted}"), F.lit(field)))
    return out


def resolved_cells(cells: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """Cells of :func:`table_cells` with the measure they show as ``header``, without those of cohorts' tables and of
    columns that show none. ``first`` is the header of the rows' names."""
    return cells.where(~F.coalesce(F.col("first").rlike(COHORT), F.lit(False))).withColumn("header", field_of(F.col("header"), labels)).where("header is not null")


def verified(docs: DataFrame, key: str, text: str, measured: DataFrame) -> DataFrame:
    """One pass over all documents: how many table cells of each were compared with ``measured`` (row, header, value),
    and how many differ."""
    cells = resolved_cells(table_cells(docs, key, text))
    bad = mismatches(cells, measured).groupBy("key").agg(F.count(F.lit(1)).alias("wrong"))
    seen = cells.join(measured, ["row", "header"]).groupBy("key").agg(F.count(F.lit(1)).alias("compared"))
    return docs.select(F.col(key).alias("key")).join(seen, "key", "left").join(bad, "key", "left").fillna(0, ["compared", "wrong"])


def decimals(cell: Column) -> Column:
    return F.length(F.regexp_extract(cell, r"\.([0-9]+)$", 1))


def mismatches(cells: DataFrame, measured: DataFrame) -> DataFrame:
    """Cells that differ from (row, header, value) by more than half of their last printed digit."""
    printed = F.regexp_replace("cell", "[,+]", "").cast("double")
    rows = cells.where(F.regexp_replace("cell", "^\\+", "").rlike(NUMBER)).withColumn("printed", printed)
    met = rows.join(measured, ["row", "header"])
    return met.where(F.abs(F.col("printed") - F.col("value")) > F.pow(F.lit(10.0), -decimals(F.col("cell"))) / 2 + 1e-9)


def scale_claims(docs: DataFrame, key: str, text: str, unit: str | Sequence[str], totals: list[float], tolerance: float = 0.05, least: float = 0.0) -> DataFrame:
    """Claims '<number>[万] <unit>' above ``least`` that are near none of the totals; 万 is ten thousand."""
    units = "|".join([unit] if isinstance(unit, str) else unit)
    pattern = f"([0-9][0-9,.]*)\\s*(万)?\\s*(?:{units})"
    found = F.explode(F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("b")))
    rows = docs.select(F.col(key).alias("key"), found.alias("z")).select("key", F.concat("z.a", "z.b").alias("claim"), F.regexp_replace("z.a", ",|[.]$", "").alias("_n"), (F.col("z.b") != "").alias("_many"))
    value = F.expr("try_cast(_n AS DOUBLE)") * F.when(F.col("_many"), 10_000.0).otherwise(1.0)
    near = [F.abs(F.col("value") - t) <= tolerance * t for t in totals]
    ok = near[0]
    for more in near[1:]:
        ok = ok | more
    return rows.withColumn("value", value).where((F.col("value") > least) & ~ok).select("key", "claim", "value")


def folded(path: Column) -> Column:
    """A path without '.', '..' (at any depth) and empty parts."""
    start = F.when(path.startswith("/"), "/").otherwise("")
    up = lambda a: (F.size(a) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), a), -1) != "..")
    step = lambda a, x: F.when(x.isin("", "."), a).when((x == "..") & up(a), F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.array_append(a, x))
    return F.concat(start, F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/"))


def relative_links(docs: DataFrame, path: str, text: str) -> DataFrame:
    """(source, target) of relative links, resolved against the folder of their document."""
    links = F.explode(F.regexp_extract_all(text, F.lit(r"\]\(([^)#\s]+)[^)]*\)"), F.lit(1)))
    rows = docs.select(F.col(path).alias("source"), links.alias("link")).where(~F.col("link").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"))
    return rows.select("source", folded(F.concat(F.regexp_extract("source", "^(.*/)?[^/]*$", 1), "link")).alias("target"))


def broken_links(docs: DataFrame, files: DataFrame, path: str, text: str) -> DataFrame:
    """Relative links to a path that is neither a file nor a folder of one. ``files``: column path."""
    parts = F.split(F.regexp_replace("path", "/?[^/]*$", ""), "/")
    folders = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("target"))
    known = files.select(F.col("path").alias("target")).unionByName(folders).distinct()
    rows = relative_links(docs, path, text).withColumn("target", F.regexp_replace("target", "/$", ""))
    return rows.join(known, "target", "left_anti").select("source", "target")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and length of all files of a folder, whose content is never read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")


def large_files(files: DataFrame, most: int = 500_000) -> DataFrame:
    """Files over a size, from the path and length that the binaryFile source gives."""
    return files.where(F.col("length") > most).select("path", "length")
