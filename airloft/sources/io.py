"""Scans, payload decoders and sinks. Landed files only; nothing is fetched."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException


def read_bom_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """CSV with a header, whatever its file name; a byte order mark is not part of the first name."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8")
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_table(spark: SparkSession, path: str, cols=None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*cols) if cols else df


def write_table(df: DataFrame, path: str, by=None) -> None:
    """Overwrites as Parquet; rows of one partition value are brought together first, so each has few files."""
    if by:
        by = [by] if isinstance(by, str) else list(by)
        df.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def _json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """JSON documents: each on a line of its own if the first line is a whole one, else one a file."""
    first = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> ''").limit(1).collect()
    whole = not first or first[0]["v"][0] + first[0]["v"][-1] in ("{}", "[]")
    reader = spark.read.option("multiLine", not whole)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_records(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """JSON array of objects, or one object a line."""
    return _json(spark, path, schema)


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_map(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """A JSON object of key to number as rows."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", "map<string,double>")).alias(key, value))


def write_map(df: DataFrame, path: str) -> None:
    """Two columns as one JSON object; for maps that one reader takes whole."""
    key, value = df.columns
    df.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value))))).alias("value")).write.mode("overwrite").text(path)


FEATURES = T.StructType().add(
    "features",
    T.ArrayType(
        T.StructType()
        .add("properties", T.StructType().add("GEOID", T.StringType()).add("NAME", T.StringType()))
        .add("geometry", T.StructType().add("type", T.StringType()).add("coordinates", T.StringType()))
    ),
)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON features as (geoid, name, rings); parts of a multipolygon give their rings to one row."""
    rows = _json(spark, path, FEATURES).select(F.explode("features").alias("f"))
    return rows.select(F.col("f.properties.GEOID").alias("geoid"), F.col("f.properties.NAME").alias("name"), rings_of(F.col("f.geometry")).alias("rings"))


def rings_of(geometry) -> F.Column:
    """Rings of a struct(type, coordinates as text)."""
    one = F.from_json(geometry["coordinates"], "array<array<array<double>>>")
    many = F.flatten(F.from_json(geometry["coordinates"], "array<array<array<array<double>>>>"))
    return F.when(geometry["type"] == "MultiPolygon", many).when(geometry["type"] == "Polygon", one)


def merge_features(dfs, path: str | None = None) -> DataFrame:
    """Features of several frames; written as one feature a line if a path is given."""
    merged = union_all(dfs)
    if path:
        geometry = F.struct(F.lit("Polygon").alias("type"), F.col("rings").alias("coordinates"))
        merged.select(F.lit("Feature").alias("type"), F.struct(F.col("geoid").alias("GEOID"), F.col("name").alias("NAME")).alias("properties"), geometry.alias("geometry")).write.mode("overwrite").json(path)
    return merged


def union_all(dfs) -> DataFrame:
    """All rows; columns by name, missing ones null."""
    dfs = list(dfs)
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def decode_positional(df: DataFrame, fields: str, data: str, want) -> DataFrame:
    """Rows of {fields: [...], data: [[...]]}: wanted names by position, null where a name is missing."""
    rows = df.select(F.col(fields).alias("_f"), F.explode(data).alias("_row"))
    at = lambda name: F.array_position("_f", F.lit(name)).cast("int")
    return rows.select(*[F.when(at(name) > 0, F.get("_row", at(name) - 1)).alias(name) for name in want])


def decode_parallel(df: DataFrame, struct: str, time: str, variables) -> DataFrame:
    """Rows of {struct: {time: [], a: [], b: []}}; short arrays end in nulls. Other columns stay."""
    keep = [c for c in df.columns if c != struct]
    zipped = F.arrays_zip(*[F.col(f"{struct}.{v}").alias(v) for v in (time, *variables)])
    return df.select(*keep, F.explode(zipped).alias("_z")).select(*keep, *[F.col("_z")[v].alias(v) for v in (time, *variables)])


def decode_keyed(df: DataFrame, parameter: str, variables: dict, sentinel: float = -999.0) -> DataFrame:
    """Rows of {VAR: {yyyymmdd: value}} as wide rows by day; the sentinel is null. Days come from the first variable."""
    first = next(iter(variables))
    rows = df.select("*", F.explode(F.map_keys(F.col(parameter)[first])).alias("_day"))
    value = lambda v: F.col(parameter)[v][F.col("_day")]
    keep = [c for c in df.columns if c != parameter]
    columns = [F.when(value(v) != sentinel, value(v)).alias(name) for v, name in variables.items()]
    return rows.select(*keep, F.try_to_timestamp("_day", F.lit("yyyyMMdd")).cast("date").alias("date"), *columns)


def align_by_position(requests: DataFrame, payloads: DataFrame, batch: str, asked: str, got: str) -> DataFrame:
    """(batch, asked, got) pairs: the n-th answer belongs to the n-th location asked for.

    requests: (batch, asked array); payloads: (batch, got array, one object counts as an array of one).
    """
    a = requests.select(batch, F.posexplode(asked).alias("_n", asked))
    b = payloads.select(batch, F.posexplode(got).alias("_n", got))
    return a.join(b, [batch, "_n"], "left").drop("_n")


def largest_per_key(files: DataFrame, key: str, size: str = "size", path: str = "path") -> DataFrame:
    """The largest file of each key; ties go to the first path."""
    best = Window.partitionBy(key).orderBy(F.desc(size), path)
    return files.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")


def largest_files(df: DataFrame, key: str) -> DataFrame:
    """(key, path, size) of the largest file that has rows of each key, by the sizes the file system gives; df is read from files."""
    files = df.select(key, F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).distinct()
    return largest_per_key(files, key)


def rows_of(df: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of df that come from one of the files (path)."""
    marked = df.select("*", F.col("_metadata.file_path").alias("_path"))
    return marked.join(files.select(F.col("path").alias("_path")).distinct(), "_path", "left_semi").drop("_path")


def prefer(primary: DataFrame, fallback: DataFrame, key) -> DataFrame:
    """Rows of primary, and of fallback for keys that primary lacks; weather_source tells which."""
    key = [key] if isinstance(key, str) else list(key)
    rest = fallback.join(primary.select(*key).distinct(), key, "left_anti")
    return union_all([primary.withColumn("weather_source", F.lit("primary")), rest.withColumn("weather_source", F.lit("fallback"))])


def latest_day(df: DataFrame, as_of, back: int = 3, date: str = "date") -> DataFrame:
    """Rows of the last day with rows among as_of and the `back` days before."""
    day = F.lit(as_of).cast("date")
    near = df.where(F.col(date).between(F.date_sub(day, back), day))
    return near.join(near.agg(F.max(date).alias(date)), date, "left_semi")


def publish(df: DataFrame, path: str, batch: int | None = None, keep: int | None = None) -> bool:
    """Adds a version to the published table: a folder of its own, by Spark's commit protocol.

    A failed write leaves the last good version, which is the newest that has
    a success marker. A batch whose number has a complete version already is
    not written again, so a replay changes nothing; tells whether it wrote. With
    `keep`, complete versions before the newest so many are removed after it.
    """
    spark = df.sparkSession
    held, mark = _versions(spark, path), "" if batch is None else f"b{batch:012d}-"
    if batch is not None and any(f"-{mark}" in f for f in _versions(spark, path, done=True).values()):
        return False
    df.write.parquet(f"{path}/version={max(held, default=0) + 1:012d}-{mark}{uuid.uuid4().hex[:8]}")
    if keep:
        done = _versions(spark, path, done=True)
        for number in sorted(done)[:-keep]:
            remove(spark, done[number])
    return True


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library made."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)


def _versions(spark: SparkSession, path: str, done: bool | str = False) -> dict[int, str]:
    """Number to folder of the versions under path, of complete ones if `done`: those with a success marker, or with the file that it names."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return {}
    marker = "_SUCCESS" if done is True else done
    found = [s.getPath() for s in files.listStatus(root) if s.getPath().getName().startswith("version=")]
    kept = [f for f in found if not done or files.exists(jvm.org.apache.hadoop.fs.Path(f, marker))]
    return {int(f.getName()[8:20]): f.toString() for f in sorted(kept, key=lambda f: f.getName())}


def load_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete version of a published table, or a plain table at path; None if there is neither."""
    held = _versions(spark, path, done=True)
    try:
        return spark.read.parquet(held[max(held)] if held else path)
    except AnalysisException:
        return None


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the session's shared checkpoint folder; in local mode one of the machine where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df by a reliable checkpoint: later steps start from the written rows."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark, "steps"))
    return df.checkpoint()


def stage(df: DataFrame, path: str) -> DataFrame:
    """Written and read again, so later phases restart from here."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
