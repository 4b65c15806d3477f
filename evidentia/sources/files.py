"""File sources and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.functions.arrays import running_sums

#: Route -> extensions.
ROUTES = {"office": ("docx", "xlsx", "pptx", "doc", "rtf", "odt"), "image": ("png", "jpg", "jpeg", "tif", "tiff"), "audio": ("mp3", "wav", "ogg", "m4a"), "video": ("mp4", "mov", "avi"), "pdf": ("pdf",)}


def scan_files(spark: SparkSession, path: str, routes=ROUTES) -> DataFrame:
    """path, ext, route, size, sha16 of every file below a folder."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    route = F.lit("other")
    for name, exts in routes.items():
        route = F.when(ext.isin(*exts), name).otherwise(route)
    return df.select("path", ext.alias("ext"), route.alias("route"), F.col("length").alias("size"), F.left(F.sha2("content", 256), F.lit(16)).alias("sha16"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of JSON lines; torn lines are kept in _corrupt, counted by callers."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path).withColumn("file", F.input_file_name())


def strict_totals(lines: DataFrame, value: str) -> DataFrame:
    """file, status, total: one torn line makes its file corrupt, without a total."""
    rows = lines.groupBy("file").agg(F.bool_or(F.col("_corrupt").isNotNull()).alias("bad"), F.sum(value).alias("t"))
    return rows.select("file", F.when(F.col("bad"), "corrupt").otherwise("ok").alias("status"), F.when(~F.col("bad"), F.col("t")).alias("total"))


def parse_statement(lines: DataFrame, doc: str, pos: str, line: str) -> DataFrame:
    """Operations of statement lines: doc, op, day, amount (decimal), text. A
    line that begins with a date opens one; a date after an amount opens another
    on the same line; other lines, such as of a phone number, continue the
    operation above. Blank lines and page numbers are no part of any."""
    from pyspark.sql import Window

    number = r"(?:\d{1,3}(?:[ \x{A0}\x{202F}]\d{3})+|\d+)[.,]\d{2}"
    day = r"\d{2}\.\d{2}\.\d{4}\b"
    text = F.regexp_replace(F.col(line), rf"({number}(?:[^\d\n]*?)) +(?={day})", "$1\n")
    rows = lines.filter(~F.col(line).rlike(r"^\s*$|^(?i)(page|страница)\b")).select(doc, pos, F.posexplode(F.split(text, "\n")).alias("__k", "__line"))
    order = Window.partitionBy(doc).orderBy(pos, "__k")
    rows = rows.withColumn("op", F.sum(F.col("__line").rlike("^" + day).cast("int")).over(order)).filter("op > 0")
    rows = rows.groupBy(doc, "op").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, "__k", "__line"))), lambda x: x["__line"]), " ").alias("text"))
    amount = F.regexp_extract(F.substring("text", 11, 2**31 - 12), rf"([+-]?{number})", 1)
    value = F.translate(F.regexp_replace(amount, r"[ \x{A0}\x{202F}]", ""), ",", ".").try_cast("decimal(18,2)")
    return rows.select(doc, "op", F.try_to_date(F.left("text", F.lit(10)), "dd.MM.yyyy").alias("day"), value.alias("amount"), "text")


def tail_files(spark: SparkSession, path: str, state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Whole lines that were added to growing files below a folder since the
    state (path, offset), and the next state: path, offset, size, restarted,
    waiting. Lines: path, at (its byte in the file), line.

    A file that is shorter than its offset is read from its start again
    (restarted). What follows the last line feed waits for the next call. The
    state is the coverage as well: offset of size bytes are read. Files are
    columns of tasks, so one that grows by more than a task holds should be
    tailed more often."""
    known = spark.createDataFrame([], "path string, offset long") if state is None else state.select("path", "offset")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), "content")
    rows = files.join(known, "path", "left").withColumn("restarted", F.coalesce(F.col("offset") > F.col("size"), F.lit(False)))
    start = F.when(F.col("restarted"), 0).otherwise(F.coalesce("offset", F.lit(0))).cast("int")
    rows = rows.withColumn("start", start).withColumn("new", F.expr("substring(content, start + 1)").cast("string"))
    whole = F.regexp_extract("new", r"(?s)\A(.*\n)", 1)
    rows = rows.withColumn("whole", whole).withColumn("end", F.col("start") + F.octet_length("whole"))
    lines = rows.filter("whole <> ''").select("path", "start", F.split(F.expr("left(whole, length(whole) - 1)"), "\n").alias("parts"))
    placed = lines.select("path", "start", F.posexplode(F.arrays_zip(F.col("parts").alias("line"), running_sums(F.transform("parts", lambda x: F.octet_length(x) + 1)).alias("b"))).alias("i", "x"))
    return placed.select("path", (F.col("start") + F.col("x.b")).alias("at"), F.col("x.line").alias("line")), rows.select("path", F.col("end").cast("long").alias("offset"), "size", "restarted", (F.col("end") < F.col("size")).alias("waiting"))


def publish_snapshot(df: DataFrame, path: str, fingerprint: str) -> bool:
    """Write df as a new version under path and move the pointer, unless the
    pointer has this fingerprint. The pointer is written last; readers that
    follow it never see half a version. Returns whether it wrote."""
    spark = df.sparkSession
    pointer = f"{path}/pointer"
    try:
        last = spark.read.schema("fingerprint string, version long").parquet(pointer).orderBy(F.desc("version")).first()
    except Exception as e:  # no pointer yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        last = None
    if last and last["fingerprint"] == fingerprint:
        return False
    version = (last["version"] if last else 0) + 1
    df.write.parquet(f"{path}/v{version}")
    spark.createDataFrame([(fingerprint, version)], "fingerprint string, version long").write.mode("append").parquet(pointer)
    return True


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    version = spark.read.parquet(f"{path}/pointer").orderBy(F.desc("version")).first()["version"]
    return spark.read.parquet(f"{path}/v{version}")
