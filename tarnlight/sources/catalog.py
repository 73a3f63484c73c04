"""Reading catalogs and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from tarnlight.functions.text import breadcrumb_tail, flatten_pairs, normalize_phrase, primary_attribute, searchable
from tarnlight.operators.fusion import popularity

_PAIRS = T.ArrayType(T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType())]))
#: details keep their order, so they are read as text and cut into pairs.
PRODUCT = T.StructType([
    T.StructField("parent_asin", T.StringType(), False), T.StructField("title", T.StringType()), T.StructField("features", T.StringType()),
    T.StructField("description", T.StringType()), T.StructField("price", T.StringType()), T.StructField("categories", T.ArrayType(T.StringType())),
    T.StructField("details", T.StringType()), T.StructField("average_rating", T.DoubleType()), T.StructField("rating_number", T.DoubleType()), T.StructField("store", T.StringType()),
])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One object a line; blank lines are skipped."""
    reader = spark.read.option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def string_list(c):
    """A JSON list as array<string>; a plain string as a list of itself."""
    return F.when(c.startswith("["), F.from_json(c, T.ArrayType(T.StringType()))).when(c.isNotNull() & (c != ""), F.array(c)).otherwise(F.array().cast("array<string>"))


def detail_pairs(c):
    """A JSON object as array<struct<k, v>> in the order of its keys; anything else is empty."""
    keys = F.when(c.startswith("{"), F.json_object_keys(c))
    held = F.from_json(c, T.MapType(T.StringType(), T.StringType()))
    return F.coalesce(F.transform(keys, lambda k: F.struct(k.alias("k"), F.element_at(held, k).alias("v"))), F.array().cast(_PAIRS))


#: Where a row stands: its file, the start of its split, and its place in the task that reads the split.
_AT = "__at"


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """Catalog lines as PRODUCT, with the place of each line, for products()."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    return read_jsonl(spark, path, PRODUCT).select("*", place.alias(_AT))


def _dense_ordinals(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """Adds ord: 0, 1, 2 ... by the group columns and then order. Rows are numbered within their group; only the groups' sizes meet in one task."""
    before = rows.groupBy(*group).agg(F.count("*").alias("__n"))
    before = before.withColumn("__before", F.sum("__n").over(Window.orderBy(*group)) - F.col("__n")).drop("__n")
    own = F.row_number().over(Window.partitionBy(*group).orderBy(order)) - 1
    return rows.withColumn("__own", own).join(before, group).withColumn("ord", F.col("__before") + F.col("__own")).drop("__before", "__own")


def products(raw: DataFrame) -> DataFrame:
    """raw: as PRODUCT. Adds ord, typed columns, searchable, shelf, primary attributes, popularity.

    With the places of read_products, ord goes by file (by name) and line, and of repeated ids the last line stays; else ord
    goes by id, and the least row stays.
    """
    if _AT in raw.columns:
        # The last line of an id is a maximum, which is combined before it is shuffled.
        last = raw.groupBy("parent_asin").agg(F.max_by(F.struct(*(c for c in raw.columns if c != "parent_asin")), _AT).alias("r")).select("parent_asin", "r.*")
        rows = last.select("*", f"{_AT}.file", f"{_AT}.split", F.col(f"{_AT}.row").alias("__row")).drop(_AT)
        rows = _dense_ordinals(rows, ["file", "split"], "__row").drop("file", "split", "__row")
    else:
        least = Window.partitionBy("parent_asin").orderBy(F.to_json(F.struct(*raw.columns)))
        rows = raw.withColumn("__nth", F.row_number().over(least)).where("__nth = 1").drop("__nth")
        rows = _dense_ordinals(rows.withColumn("__part", F.pmod(F.xxhash64("parent_asin"), F.lit(1 << 10))), ["__part"], "parent_asin").drop("__part")
    numeric = F.when(~F.col("price").startswith('"'), F.col("price").try_cast("double"))
    rows = rows.withColumns({
        "is_list": F.col("features").startswith("["), "price": numeric, "details": detail_pairs(F.col("details")),
        "description": string_list(F.col("description")), "features": string_list(F.col("features")),
    })
    text = searchable(F.col("title"), F.concat_ws(" ", "features"), flatten_pairs(F.col("details")), F.concat_ws(" ", "description"), F.concat_ws(" ", "categories"), F.col("store"))
    rows = rows.withColumn("searchable", F.lower(text)).withColumn("store", F.lower("store")).withColumn("shelf", normalize_phrase(breadcrumb_tail(F.col("categories"))))
    rows = rows.withColumn("primary_material", F.nullif(primary_attribute(F.col("searchable"), "material"), F.lit(""))).withColumn("primary_color", F.nullif(primary_attribute(F.col("searchable"), "color"), F.lit("")))
    spoken = F.concat(F.when(F.col("is_list"), F.col("features")).otherwise(F.array().cast("array<string>")), F.transform("details", lambda e: F.concat(e["k"], F.lit(": "), e["v"])))
    return popularity(rows.withColumn("phrases", spoken).drop("is_list"), "rating_number")


def flat_values(c):
    """A JSON value as the texts that a customer may name: "key: value" of an object, else the value or values; without nulls, blanks and empty lists."""
    pairs = F.transform(F.filter(detail_pairs(c), lambda e: ~F.coalesce(e["v"], F.lit("")).isin("", "[]")), lambda e: F.concat(e["k"], F.lit(": "), e["v"]))
    many = F.filter(string_list(c), lambda v: F.coalesce(v, F.lit("")) != "")
    return F.when(c.startswith("{"), pairs).otherwise(many)


def customer_text(title, features, details, description, categories, store):
    """The text in which the simulated customer looks for material and color: case as it is, and a field that is not there adds no space."""
    each = F.flatten(F.array(features, F.transform(details, lambda e: F.concat_ws(" ", e["k"], e["v"])), description, F.coalesce(categories, F.array().cast("array<string>"))))
    return F.trim(F.concat_ws(" ", title, each, store))


def customer_catalog(raw: DataFrame) -> DataFrame:
    """raw: as PRODUCT. What the simulation needs of each product: parent_asin, title, categories, features, details ("key: value"), price, corpus."""
    rows = raw.select("parent_asin", "title", "categories", "store", "description", "price", F.col("features").alias("told"), F.col("details").alias("named"))
    corpus = customer_text(F.col("title"), string_list(F.col("told")), detail_pairs(F.col("named")), string_list(F.col("description")), F.col("categories"), F.col("store"))
    return rows.select(
        "parent_asin", "title", "categories", flat_values(F.col("told")).alias("features"), flat_values(F.col("named")).alias("details"), F.trim(F.col("price"), F.lit('"')).alias("price"), corpus.alias("corpus"),
    )


def write_results(summary: DataFrame, sessions: DataFrame, path: str) -> None:
    """JSON: sessions and summary in folders of their own."""
    sessions.write.mode("overwrite").json(f"{path}/sessions")
    summary.write.mode("overwrite").json(f"{path}/summary")
