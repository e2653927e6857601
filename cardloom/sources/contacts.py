"""Reading and writing contacts and site settings."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import domain_type, email_domain
from .export import export_table

CONTACT = "row_id long, name string, email string, phone string, title string, location string, profile_url string"


def read_contacts(spark: SparkSession, path: str | list[str], form: str | None = None) -> DataFrame:
    """Contacts from JSON (a bare array, or an object with `contacts`), Parquet or CSV; empty text becomes null.

    A row without row_id gets its place: of its file by name, then within the file.
    """
    form = form or ("parquet" if str(path).endswith(".parquet") else "csv" if str(path).endswith(".csv") else "json")
    fields = CONTACT.replace("profile_url", "profileUrl")
    if form == "json":
        raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file_"), "value")
        wrapped = F.from_json("value", f"contacts array<struct<{', '.join(f.replace(' ', ':', 1) for f in fields.split(', '))}>>")["contacts"]
        bare = F.from_json("value", f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in fields.split(', '))}>>")
        either = F.when(F.ltrim("value").startswith("["), bare).otherwise(wrapped)
        either = F.coalesce(either, F.raise_error(F.concat(F.lit("no contacts in "), "file_")).cast(f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in fields.split(', '))}>>"))
        d = raw.select("file_", F.posexplode(either).alias("pos_", "c")).select("file_", "pos_", "c.*")
        files = raw.select("file_").distinct().withColumn("rank_", F.row_number().over(Window.orderBy("file_")) - 1)  # a row per file
        d = d.join(files, "file_").withColumn("row_id", F.coalesce("row_id", F.shiftleft(F.col("rank_").cast("long"), 33) + F.col("pos_")))
    else:
        d = spark.read.parquet(path) if form == "parquet" else spark.read.option("header", True).csv(path)
        d = d.withColumnRenamed("profile_url", "profileUrl")
        d = d if "row_id" in d.columns else d.withColumn("row_id", F.monotonically_increasing_id())
    names = [f.split()[0] for f in CONTACT.split(", ")][1:]
    source = {n: "profileUrl" if n == "profile_url" else n for n in names}
    have = set(d.columns)
    return d.select(F.col("row_id").cast("long"), *(F.nullif(F.col(source[n]).cast("string"), F.lit("")).alias(n) if source[n] in have else F.lit(None).cast("string").alias(n) for n in names))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, html and nothing else.

    A table too small to give every core a split of its own is dealt out anew, as its few rows cost far more to parse than to move; what is
    moved is bounded by the cores times a split.
    """
    pages = spark.read.parquet(path).select("page_id", "url", "html")
    cores = spark.sparkContext.defaultParallelism
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    split = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    size = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return pages.repartition(cores) if size < cores * split else pages


def write_contacts(df: DataFrame, path: str, source: str, form: str = "json") -> DataFrame:
    """The contacts and, under `<path>/metadata`, one row of counts (contacts, fields, domains by kind), which is returned."""
    df.write.mode("overwrite").format(form).save(f"{path}/contacts")
    domain = email_domain(F.col("email"))
    kind = domain_type(domain, missing=None)
    meta = df.agg(
        F.count("*").alias("total"), F.count("email").alias("with_email"), F.count("phone").alias("with_phone"), F.count_distinct(domain).alias("domains"),
        F.count_if(kind == "business").alias("business"), F.count_if(kind == "personal").alias("personal"), F.lit(source).alias("source"),
    )
    meta.write.mode("overwrite").format(form).save(f"{path}/metadata")
    return df.sparkSession.read.format(form).load(f"{path}/metadata")


def export_view(df: DataFrame, columns: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Chosen columns (else all with any value) under their headers, as text without nulls; see `export.export_table` for the other choices."""
    return export_table(df, columns, every=columns is None, exclude=exclude)


def append_export(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """More rows to an export, without a header."""
    df.write.mode("append").option("maxRecordsPerFile", rows_per_file).csv(path)


def merged_settings(default: dict, own: Column) -> Column:
    """map<string,variant>: `own` (the same) over the default: objects merge key by key at every depth, all else that is there replaces,
    null too. The depth is that of the default; deeper objects of `own` have nothing to meet."""
    def value(k: str, d: object) -> Column:
        given, fixed = own[k], F.parse_json(F.lit(json.dumps(d)))
        there = F.coalesce(F.map_contains_key(own, k), F.lit(False))
        if not isinstance(d, dict):
            return F.when(there, given).otherwise(fixed)
        inner = F.try_variant_get(given, "$", "map<string,variant>")
        return F.when(there & inner.isNotNull(), F.to_variant_object(merged_settings(d, inner))).when(there, given).otherwise(fixed)

    rest = F.map_filter(own, lambda k, v: ~k.isin(list(default))) if default else own
    known = [x for k, d in default.items() for x in (F.lit(k), value(k, d))]
    return F.map_concat(F.create_map(*known), rest) if known else rest


def resolve_site_config(pages: DataFrame, configs: DataFrame, default: dict, small: int = 200_000) -> DataFrame:
    """S3: page_id, url, domain, settings: the settings of each page's domain over the defaults.

    configs: domain, settings, one row per domain. Settings as JSON text or VARIANT merge at every depth and come back as JSON text with
    sorted keys; text that is no JSON object counts as none. Settings as map<string,string> have one level and come back as a map. They are
    merged once per domain; up to `small` rows (counted) are broadcast to the pages.
    """
    domain = F.regexp_replace(F.lower(F.try_parse_url("url", F.lit("HOST"))), r"^www\.", "")
    kind = dict(configs.dtypes)["settings"]
    if kind.startswith("map"):
        base = F.create_map(*(F.lit(x) for kv in default.items() for x in kv))
        d = pages.withColumn("domain", domain).join(configs.select("domain", "settings"), "domain", "left")
        own = F.coalesce("settings", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
        rest = F.map_filter(base, lambda k, v: ~F.map_contains_key(own, k))
        return d.select("page_id", "url", "domain", F.map_concat(rest, own).alias("settings"))
    own = F.col("settings") if kind == "variant" else F.try_parse_json("settings")
    own = F.coalesce(F.try_variant_get(own, "$", "map<string,variant>"), F.try_variant_get(F.parse_json(F.lit("{}")), "$", "map<string,variant>"))
    per = configs.select("domain", own.alias("own_")).select("domain", F.to_json(F.to_variant_object(merged_settings(default, F.col("own_")))).alias("settings"))
    per = F.broadcast(per) if configs.count() <= small else per
    return pages.withColumn("domain", domain).join(per, "domain", "left").select("page_id", "url", "domain", F.coalesce("settings", F.to_json(F.parse_json(F.lit(json.dumps(default))))).alias("settings"))
