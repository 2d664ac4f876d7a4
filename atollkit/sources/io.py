"""Sources and sinks of planning data."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atollkit.functions.scalars import bool_text

#: Parameter keys by category.
PARAM_KEYS = {
    "files": "INPUTDIR PUNAME SPECNAME PUVSPRNAME BOUNDNAME".split(),
    "run": "BLM PROP RANDSEED NUMREPS NUMITNS STARTTEMP NUMTEMP COSTTHRESH THRESHPEN1 THRESHPEN2 SAVERUN SAVEBEST SAVESUMMARY SAVESCEN SAVETARGMET SAVESUMSOLN SAVEPENALTY SAVELOG OUTPUTDIR RUNMODE MISSLEVEL ITIMPTYPE HEURTYPE CLUMPTYPE VERBOSITY".split(),
    "metadata": "DESCRIPTION CREATEDATE PLANNING_UNIT_NAME OLDVERSION IUCN_CATEGORY PRIVATE COSTS".split(),
    "renderer": "CLASSIFICATION NUMCLASSES COLORCODE TOPCLASSES OPACITY".split(),
}

#: Attribute columns that a protected-area release sheds.
PRUNED = "wdpa_pid pa_def name orig_name desig desig_eng desig_type int_crit marine rep_m_area gis_m_area rep_area gis_area no_take no_tk_area status status_yr gov_type own_type mang_auth mang_plan verif metadataid sub_loc".split()

MARKER = "^(<<<<<<<|=======|>>>>>>>)"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def read_table(spark: SparkSession, path: str, schema: str | T.StructType, sep: str | None = None) -> DataFrame:
    """Delimited text with a header. The separator is sniffed from the first line (tab or comma) unless given; a missing
    path gives an empty table of the schema; lines of version-control merge markers and rows that do not fit are left out."""
    empty = spark.createDataFrame([], schema)
    if not exists(spark, path):
        return empty
    lines = spark.read.text(path).where(~F.col("value").rlike(MARKER))
    head = lines.first()
    if head is None:
        return empty
    header = head["value"]
    sep = sep or ("\t" if "\t" in header else ",")
    names = [h.strip().strip('"').lower() for h in header.split(sep)]
    by_name = {f.name.lower(): f for f in empty.schema.fields}
    read_as = T.StructType([*(by_name.get(n, T.StructField(f"_c{i}", T.StringType())) for i, n in enumerate(names)), T.StructField("_misfit", T.StringType())])
    fits = [f.name for f in empty.schema.fields if f.name.lower() in names]
    if not fits:
        return empty
    # A short line's last fields are null; a line with too many, or with a value of another kind, is the parser's corrupt record.
    missing = F.greatest(F.lit(0), F.lit(len(names)) - F.size(F.split("value", re.escape(sep))))
    whole = F.concat("value", F.repeat(F.lit(sep), missing.cast("int")))
    options = {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_misfit"}
    parsed = lines.where((F.col("value") != header) & (F.trim("value") != "")).select(F.from_csv(whole, F.lit(", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in read_as)), options).alias("r"))
    rows = parsed.where(F.col("r._misfit").isNull())
    return rows.select(*(F.col("r")[f.name].alias(f.name) if f.name in fits else F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema.fields))


#: Columns of solver files by kind.
RUN_KINDS = {
    "r": "planning_unit long, selected int",
    "mv": "feature long, name string, target double, held double, occurrence_target double, occurrences double, separation_target double, separation double, target_met string, mpm double",
}


def read_runs(spark: SparkSession, glob: str, kind: str) -> DataFrame:
    """All solver files of a kind, whatever their extension, with run from the five digits of the name. Columns go by
    position, so trailing blanks in header names do not matter. No file: an empty table."""
    fields = spark.createDataFrame([], RUN_KINDS[kind]).schema
    if not exists(spark, glob):
        return spark.createDataFrame([], fields.add("run", T.IntegerType()))
    lines = spark.read.text(glob).select("value", F.regexp_extract(F.input_file_name(), r"(\d{5})\.", 1).alias("digits"))
    sep = F.when(F.col("value").contains("\t"), "\t").otherwise(",")
    parts = F.transform(F.split("value", sep), lambda x: F.trim(F.regexp_replace(x, '^"|"$', "")))
    rows = lines.where("digits != ''").withColumn("p", parts).where(F.get("p", F.lit(0)).try_cast("long").isNotNull())
    return rows.select(*(F.get("p", F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(fields.fields)), F.col("digits").cast("int").alias("run"))


def parse_params(files: DataFrame) -> DataFrame:
    """(project_id, key, value, flag) from (project_id, text): a key follows a line break; its value is the rest of its own line
    after one character, trimmed; flag is the value as a Boolean where it reads True or False."""
    pair = F.explode(F.regexp_extract_all("text", F.lit(r"(?<=\n)([A-Z0-9_]+[^\n]*)"), F.lit(0))).alias("line")
    rows = files.select("project_id", pair).select("project_id", F.regexp_extract("line", "^[A-Z0-9_]+", 0).alias("key"), "line")
    value = F.trim(F.expr("substring(line, length(key) + 2)"))
    return rows.select("project_id", "key", value.alias("value"), bool_text(value).alias("flag"))


def categorise_params(params: DataFrame) -> DataFrame:
    """params with category; keys of no category are dropped. The lookup has a fixed 42 rows."""
    lookup = params.sparkSession.createDataFrame([(k, c) for c, ks in PARAM_KEYS.items() for k in ks], "key string, category string")
    return params.join(F.broadcast(lookup), "key")


def project_updates_from_params(params: DataFrame, grids: DataFrame) -> DataFrame:
    """Metadata keys as typed project columns; planning_unit_id by the grid's name, null where no grid has it."""
    keys = ["DESCRIPTION", "OLDVERSION", "PRIVATE", "IUCN_CATEGORY", "COSTS", "PLANNING_UNIT_NAME"]
    wide = params.where(F.col("key").isin(keys)).groupBy("project_id").pivot("key", keys).agg(F.min("value"))
    out = wide.join(grids.select(F.col("feature_class_name").alias("PLANNING_UNIT_NAME"), F.col("unique_id").alias("planning_unit_id")), "PLANNING_UNIT_NAME", "left")
    yes = lambda c: F.coalesce(F.col(c) == "True", F.lit(False))
    return out.select("project_id", F.col("DESCRIPTION").alias("description"), yes("OLDVERSION").alias("old_version"), yes("PRIVATE").alias("is_private"), F.col("IUCN_CATEGORY").alias("iucn_category"), F.col("COSTS").alias("costs"), "planning_unit_id")


def write_table(df: DataFrame, path: str) -> None:
    """CSV with a header, no index."""
    df.write.mode("overwrite").option("header", True).csv(path)


def append_table(df: DataFrame, path: str) -> None:
    """Add rows after those at path; an empty table is an error."""
    if df.isEmpty():
        raise ValueError("nothing to append")
    df.write.mode("append").option("header", True).csv(path)


def delete_records(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """Rows whose id is not among ids (one column of the same name)."""
    return df.join(ids.select(id_col).distinct(), id_col, "left_anti")


def read_ascii_grid(spark: SparkSession, path: str, files: str = "*.asc") -> DataFrame:
    """(layer, r, c, v) of all ESRI ASCII grids below path, labelled by file stem, or by a layer=... folder, whose files are one grid in
    the order of their names; no-data cells are left out, so the table is sparse. Row 0 is the top.

    Files are read as lines, however large they are: a line's row is its place in its stretch of the file and the lines of the
    stretches before. A line that has not as many values as ncols says is an error."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", files).text(path)
    name = F.col("_metadata.file_path")
    folder = F.regexp_extract(name, "layer=([^/]+)/", 1)
    layer = F.when(folder != "", folder).otherwise(F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[^.]*$", ""))
    lines = text.select(layer.alias("layer"), F.struct(name.alias("f"), F.col("_metadata.file_block_start").alias("b")).alias("at"), F.trim("value").alias("value")).where("value != ''")
    is_head = F.col("value").rlike("^[A-Za-z]") & ~F.lower("value").startswith("nan")
    word = F.split("value", r"\s+")
    said = lambda key: F.max(F.when(F.lower(word[0]) == key, word[1].cast("double")))
    heads = lines.where(is_head).groupBy("layer").agg(said("ncols").alias("ncols"), said("nodata_value").alias("nodata"))
    rows = lines.where(~is_head).withColumn("n", F.monotonically_increasing_id())  # ascends by one within a stretch
    parts = rows.groupBy("layer", "at").agg(F.min("n").alias("first"), F.count("*").alias("lines"))
    before = F.sum("lines").over(Window.partitionBy("layer").orderBy("at")) - F.col("lines")  # one row a stretch of a file
    placed = rows.join(parts.withColumn("before", before), ["layer", "at"]).join(heads, "layer")
    right = F.when(F.size(word) == F.col("ncols"), word).otherwise(F.raise_error(F.concat(F.lit("a row of other length than ncols in "), "layer")))
    cells = placed.select("layer", (F.col("before") + F.col("n") - F.col("first")).cast("int").alias("r"), "nodata", F.posexplode(right).alias("c", "v"))
    value = F.col("v").cast("double")
    return cells.where(~F.isnan(value) & (value != F.coalesce("nodata", F.lit(-9999.0)))).select("layer", "r", "c", value.alias("v"))


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, low: int = 0, high: int = 0, parts: int = 8, **options: str) -> DataFrame:
    """A database table; with column, as parallel reads of equal ranges of it."""
    if column:
        return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)
    return spark.read.jdbc(url, table, properties=options)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    df.write.jdbc(url, table, mode=mode, properties=options)


def load_pad(df: DataFrame) -> DataFrame:
    """Pressures of activities: lower-case names, and a score of 0.3 for low, 1 for all else."""
    low = df.toDF(*(c.lower() for c in df.columns))
    return low.withColumn("rppscore", F.when(F.lower("rpptitle") == "low", 0.3).otherwise(1.0))


def prune_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """df without the attribute columns; those that are not there are ignored."""
    return df.drop(*(columns or PRUNED))


def replace_table(df: DataFrame, path: str) -> None:
    """Swap a whole table for a new release."""
    df.write.mode("overwrite").parquet(path)
