"""Sources: story lines, ledgers, catalogues, raw texts, batches, event logs, packs, polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text as X

STORY = T.StructType([T.StructField(n, k) for n, k in [("story_id", T.StringType()), ("book_id", T.StringType()), ("seq_in_book", T.IntegerType()), ("title", T.StringType()), ("language", T.StringType()), ("culture_region", T.StringType()), ("latitude", T.DoubleType()), ("longitude", T.DoubleType()), ("location_precision", T.StringType()), ("word_count", T.IntegerType()), ("char_count", T.IntegerType()), ("text", T.StringType())]])
# Which form of a text is wanted first.
MIME_ORDER = ["text/plain; charset=utf-8", "text/plain; charset=us-ascii", "text/plain; charset=iso-8859-1", "text/plain"]


def stories(spark: SparkSession, path: str, schema: T.StructType = STORY) -> DataFrame:
    """One JSON story per line; blank lines are skipped."""
    return spark.read.schema(schema).json(path).where(F.coalesce(*[F.col(c).cast("string") for c in schema.names]).isNotNull())


def with_vectors(stories_: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Stories with their vectors by key; fails on a story without one, so that no row order has to be trusted."""
    j = stories_.join(vectors.withColumn("has_", F.lit(True)), key, "left")
    return j.where(F.assert_true(F.col("has_").isNotNull(), F.lit("a story has no vector")).isNull()).drop("has_")


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """One row per book of a ledger document, the document's policy in each."""
    d = spark.read.option("multiLine", True).json(path)
    return d.select(F.explode("books").alias("book"), *[F.col(c) for c in d.columns if c != "books"])


def catalogue_url(formats: Column) -> Column:
    """The body's url: by kind in a fixed order, no archives or readmes; null where the work is audio."""
    pick = F.coalesce(*[F.when(~F.lower(formats[k]).rlike(r"\.zip$|readme"), formats[k]) for k in MIME_ORDER])
    return F.when(~F.exists(F.map_keys(formats), lambda k: k.startswith("audio/")), pick)


def raw_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): UTF-8, else Latin-1."""
    b = spark.read.format("binaryFile").load(path)
    return b.select("path", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1")).alias("text"))


def bodies(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) without marker lines, bad bytes replaced."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.make_valid_utf8("value").alias("text"))
    return t.select("path", X.strip_boilerplate(F.col("text")).alias("text"))


def source_problem(text: Column, least: int = 20_000) -> Column:
    """Why a raw text can't be used; null if it can."""
    return F.when(~text.rlike(X.START_LINE), "no start mark").when(~text.rlike(X.END_LINE), "no end mark").when(F.length(text) < least, "short")


def batches(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, paragraphs) of JSON maps from id to paragraphs, one map per file."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", "map<string,array<string>>").alias("m"))
    return t.select("file", F.explode("m").alias("id", "paragraphs"))


def optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON-lines table, or an empty one if it isn't there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def counted(df: DataFrame, expected: int) -> DataFrame:
    """``df`` if it has as many rows as expected; a stale cache stops the query."""
    n = df.count()
    if n != expected:
        raise ValueError(f"{n} rows where {expected} are expected")
    return df


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, record) of JSON lines with their physical line numbers; lines that don't parse are dropped."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\n")).alias("i", "raw"))
    r = t.select("file", (F.col("i") + 1).alias("line"), F.try_parse_json("raw").alias("record")).where("record IS NOT NULL")
    return r.where(F.schema_of_variant("record").startswith("OBJECT"))


def envelope(log: DataFrame) -> DataFrame:
    """The log's fixed fields as columns, its data as a map of strings."""
    get = lambda k: F.try_variant_get("record", f"$.{k}", "string").alias(k)
    return log.select("file", "line", *[get(k) for k in ("v", "ts", "project", "loop_id", "event")], F.from_json(F.to_json("record"), "data map<string,string>")["data"].alias("data"))


def ledger_section(spark: SparkSession, path: str, section: str) -> DataFrame:
    """(name, reason) of the list items below one heading of a Markdown file."""
    t = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("i", "raw"))
    head = F.when(F.col("raw").startswith("#"), F.trim(F.regexp_replace("raw", "^#+", "")))
    t = t.withColumn("head", F.last(head, ignorenulls=True).over(Window.partitionBy(F.lit(1)).orderBy("i")))  # one file's lines
    return t.where((F.col("head") == section) & F.col("raw").rlike(r"^\s*[-*]\s+")).select(F.regexp_extract("raw", r"^\s*[-*]\s+`?([^`:—]+?)`?\s*[:—]", 1).alias("name"), F.trim(F.regexp_extract("raw", r"[:—]\s*(.*)$", 1)).alias("reason"))


def files(spark: SparkSession, root: str, pattern: str = "*", skip: list[str] | None = None) -> DataFrame:
    """(path, modified, content) of files below ``root`` by name, outside folders named in ``skip``."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    for name in skip or []:
        b = b.where(~F.col("path").contains(f"/{name}/"))
    return b.select("path", F.col("modificationTime").alias("modified"), "content")


def stale(artefacts: DataFrame, inputs: DataFrame) -> DataFrame:
    """(name, newer): artefacts (name, made, needs) with inputs (path, changed) that changed after them; an input without a time counts as changed now."""
    j = artefacts.select("name", "made", F.explode("needs").alias("path")).join(inputs, "path")
    return j.where(F.coalesce(F.col("changed"), F.lit("9999")) > F.col("made")).groupBy("name").agg(F.array_sort(F.collect_list("path")).alias("newer"))


def polygons(spark: SparkSession, path: str) -> DataFrame:
    """(feature, ring, points) of a GeoJSON collection of polygons and multipolygons; one ring per row."""
    schema = "features array<struct<geometry: struct<type: string, coordinates: string>>>"
    d = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d")).select(F.posexplode("d.features").alias("feature", "f"))
    g = d.select("feature", F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("c"))
    single = g.where("type = 'Polygon'").select("feature", F.array(F.from_json("c", "array<array<array<double>>>")).alias("polys"))
    multi = g.where("type = 'MultiPolygon'").select("feature", F.from_json("c", "array<array<array<array<double>>>>").alias("polys"))
    return single.union(multi).select("feature", F.posexplode(F.flatten("polys")).alias("ring", "points"))


def pack(spark: SparkSession, path: str, key: str, vec: str, expected: int | None = None) -> DataFrame:
    """Vectors of a byte pack under their scale; the row count is checked if it is told."""
    d = spark.read.parquet(path)
    d = counted(d, expected) if expected is not None else d
    return d.select(key, F.transform(vec, lambda x: x.cast("double") * F.col("scale") / 127).alias(vec))


def windows(spark: SparkSession, path: str, owner: str, offset: str, vec: str, expected: int | None = None) -> DataFrame:
    """(owner, offset, vec) of a window pack, the mean still off; as many rows as its ``meta`` says, and as ``expected``."""
    meta = spark.read.json(f"{path}/meta").first()
    d = spark.read.parquet(f"{path}/windows")
    for n in {meta["n"], meta["n"] if expected is None else expected}:
        d = counted(d, n)
    return d.select(owner, offset, F.transform(vec, lambda x: x.cast("double") * F.lit(meta["scale"]) / 127).alias(vec))


def window_mean(spark: SparkSession, path: str) -> DataFrame:
    """(mean): the one mean vector of a window pack, which a query takes off before it meets the windows."""
    return spark.read.json(f"{path}/meta").select("mean")


def documents(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    """A table per named JSON document below ``root``, read when it is used and registered as a view of its name."""
    out = {}
    for name in names:
        out[name] = spark.read.option("multiLine", True).json(f"{root}/{name}.json")
        out[name].createOrReplaceTempView(name)
    return out


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, formats) of cached catalogue answers, one JSON document each; an answer of another id than its file's stops the query."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(\d+)", 1).cast("long").alias("asked"), F.from_json("value", "id long, title string, formats map<string,string>").alias("d"))
    same = F.assert_true(F.col("d.id").eqNullSafe(F.col("asked")), F.lit("a catalogue answer has another id"))
    return raw.withColumn("ok_", same).where("ok_ IS NULL").select("d.*")
