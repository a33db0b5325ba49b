"""File sources and sinks. Paths go to Spark and Hadoop only, so any store works."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PERSON = T.StructType([T.StructField("9107", T.StringType()), T.StructField("11330", T.StringType())])
#: The raw record: what is not listed is ignored. Numbers and flags are read as text,
#: since their JSON types vary.
RECORD = T.StructType([
    T.StructField("acn", T.StringType()), T.StructField("dateOfOccurrence", T.StringType()), T.StructField("synopsis", T.StringType()),
    T.StructField("isAbbreviated", T.StringType()), T.StructField("isGeneralAviation", T.StringType()), T.StructField("isUas", T.StringType()),
    T.StructField("people", T.ArrayType(PERSON)),
])


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """All columns as text, empty fields as '', line breaks inside quotes kept. With
    `columns` no pass over the data is made to learn the header."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False)
    df = reader.schema(text_schema(columns)).csv(path) if columns else reader.option("inferSchema", False).csv(path)
    return df.fillna("")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_csv_if_any(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """The rows of those paths that exist, projected to `columns`; none are no error."""
    found = [p for p in paths if exists(spark, p)]
    out = spark.createDataFrame([], text_schema(columns))
    for p in found:
        df = read_csv(spark, p)
        out = out.unionByName(df.select(*[F.col(c) if c in df.columns else F.lit("").alias(c) for c in columns]))
    return out


def write_csv(df: DataFrame, path: str, columns: list[str], mode: str = "overwrite") -> None:
    """Columns in the given order with a header; other columns of df are an error."""
    extra = [c for c in df.columns if c not in columns]
    if extra:
        raise ValueError(f"columns without a place: {extra}")
    df.select(*columns).write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def append_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """More rows for a directory of CSV files; every file has its header."""
    write_csv(df, path, columns, "append")


def read_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of JSON array files, with file (name), file_ord (place of the path) and
    pos (place in the file). Each path is a plan of its own, so paths may share names; a
    file is one split, whose rows are numbered as they stand."""
    out = None
    for i, path in enumerate(paths):
        df = spark.read.option("multiLine", True).schema(RECORD).json(path)
        name = F.element_at(F.split(F.input_file_name(), "/"), -1)
        df = df.withColumns({"file": name, "pos": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)), "file_ord": F.lit(i)})
        out = df if out is None else out.unionByName(df)
    if out is None:
        out = spark.createDataFrame([], RECORD).withColumns({"file": F.lit(""), "pos": F.lit(0).cast("long"), "file_ord": F.lit(0)})
    return out.filter("acn IS NOT NULL")


def write_json_config(spark: SparkSession, config: dict, path: str) -> None:
    """One small JSON document, indented."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(json.dumps(config, indent=2, ensure_ascii=False).encode("utf-8")))
    finally:
        out.close()


#: Bytes of a file up to which it is read as one row.
ROW_FILE = 256 << 20


def manifest(spark: SparkSession, path: str, root: str = "", largest: int = ROW_FILE) -> DataFrame:
    """(relative_path, size_bytes, sha256) of all files below path. Files of up to `largest`
    bytes are rows that tasks hash. A longer one is hashed as a stream, which takes no
    memory: a digest goes from the first byte to the last, whatever reads it."""
    name = F.regexp_replace("path", f"^.*?{root}/" if root else "^", "").alias("relative_path")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    small = files.filter(F.col("length") <= largest).select(name, F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(path)
    store = top.getFileSystem(conf)
    listed, rows = store.listFiles(top, True), []
    while listed.hasNext():  # of the listing only empty files, which Spark leaves out, and long ones
        f = listed.next()
        if 0 < f.getLen() <= largest or f.getPath().getName().startswith(("_", ".")):
            continue
        stream = store.open(f.getPath())
        try:
            rows.append((f.getPath().toString(), f.getLen(), jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)))
        finally:
            stream.close()
    if not rows:
        return small
    return small.unionByName(spark.createDataFrame(rows, "path string, size_bytes long, sha256 string").select(name, "size_bytes", "sha256"))
