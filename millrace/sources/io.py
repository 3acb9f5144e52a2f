"""Readers, writers, conversion and profiles."""

from __future__ import annotations

import csv
import io as _io
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, NumericType, StructType

SUFFIXES = {".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".csv": "csv", ".tsv": "csv", ".parquet": "parquet", ".txt": "text", ".md": "text", ".rst": "text", ".html": "html", ".htm": "html", ".xml": "xml", ".svg": "xml", ".orc": "orc", ".arrow": "arrow"}
#: Suffixes of programs, which are no data.
REJECTED = (".py", ".pyc", ".pyw", ".exe", ".dll", ".so", ".sh", ".bat", ".cmd", ".com", ".bin", ".jar")

_formats: dict[str, object] = {}


def register_format(name: str, reader) -> None:
    """``reader(spark, path, options)`` reads files of the format from now on."""
    _formats[name] = reader


def registered_formats() -> list[str]:
    return sorted({*SUFFIXES.values(), *_formats})


def check_source(path: str) -> str:
    """The path, or ValueError if it is blank or a program."""
    if not path or not path.strip():
        raise ValueError("the source is empty")
    if path.strip().lower().endswith(REJECTED):
        raise ValueError(f"{path} is a program, no data set")
    return path.strip()


def detect(path: str) -> str:
    ext = os.path.splitext(path.rstrip("/*"))[1].lower()
    if ext not in SUFFIXES:
        raise ValueError(f"no format is known for {path}; name one")
    return SUFFIXES[ext]


def load(spark: SparkSession, source: str, format: str | None = None, max_rows: int | None = None, columns: list[str] | None = None, schema: StructType | str | None = None, **options: str) -> DataFrame:
    """A table by catalog name, or files by path; the format follows the suffix unless it is named."""
    source = check_source(source)
    if format is None and spark.catalog.tableExists(source) if "/" not in source and "." not in source else False:
        df = spark.table(source)
    else:
        kind = format or detect(source)
        r = spark.read.options(**options)
        if schema is not None:
            r = r.schema(schema)
        if kind in _formats:
            df = _formats[kind](spark, source, options)
        elif kind == "json":
            df = r.option("multiLine", "true").json(source)
        elif kind == "jsonl":
            df = r.json(source)
        elif kind == "csv":
            df = r.options(**({"header": "true", "inferSchema": "true", "sep": "\t" if source.endswith(".tsv") else ","} | options)).csv(source)
        elif kind in ("text", "html"):
            df = r.text(source, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
        elif kind == "xml":
            df = r.options(**({"rowTag": "row"} | options)).format("xml").load(source)
        elif kind == "arrow":
            import pyarrow as pa

            df = spark.createDataFrame(pa.ipc.open_file(source).read_all())
        else:
            df = r.format(kind).load(source)
    if columns is not None:
        df = df.select(*(c for c in columns if c in df.columns))
    return df if max_rows is None else df.limit(max_rows)


def page(df: DataFrame, key: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows by key from ``offset``; a negative offset raises, and a limit of 0 or less gives none."""
    if offset < 0:
        raise ValueError("offset must not be negative")
    out = df.orderBy(key).offset(offset)
    return out if limit is None else out.limit(max(0, limit))


def jsonl(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Lines as rows; blank lines are skipped."""
    return load(spark, path, "jsonl", schema=schema)


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).filter(F.trim("value") != "").count()


def csv_dialect(spark: SparkSession, path: str, sample_lines: int = 50) -> dict[str, object]:
    """sep, quote, header from the first lines; a comma, a double quote and a header where they don't tell."""
    text = "\n".join(r[0] for r in spark.read.text(path).limit(sample_lines).collect())
    try:
        d = csv.Sniffer().sniff(text)
        return {"sep": d.delimiter, "quote": d.quotechar or '"', "header": csv.Sniffer().has_header(text)}
    except csv.Error:
        return {"sep": ",", "quote": '"', "header": True}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    d = csv_dialect(spark, path)
    return spark.read.csv(path, sep=d["sep"], quote=d["quote"], header=bool(d["header"]), inferSchema=True)


def profile(df: DataFrame) -> DataFrame:
    """column, type, n, nulls, min, max, mean, stdev; the last four of numbers only. One pass."""
    aggs = [F.count("*").alias("n")]
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        aggs.append(F.count_if(c.isNull()).alias(f"z{i}"))
        if isinstance(f.dataType, NumericType):
            d = c.cast("double")
            aggs += [F.min(d).alias(f"a{i}"), F.max(d).alias(f"b{i}"), F.avg(d).alias(f"m{i}"), F.stddev_samp(d).alias(f"s{i}")]
    one = df.agg(*aggs)
    rows = []
    for i, f in enumerate(df.schema.fields):
        v = [F.col(f"{x}{i}") if isinstance(f.dataType, NumericType) else F.lit(None).cast("double") for x in "abms"]
        rows.append(F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col("n").alias("n"), F.col(f"z{i}").alias("nulls"), *(x.alias(y) for x, y in zip(v, ("min", "max", "mean", "stdev"), strict=True))))
    return one.select(F.inline(F.array(*rows)))


def describe_tables(spark: SparkSession, sample_rows: int = 10) -> list[dict[str, object]]:
    """Name, columns, rows and a sample of each table of the catalog."""
    return [{"name": t.name, "columns": [(c.name, c.dataType) for c in spark.catalog.listColumns(t.name)], "rows": spark.table(t.name).count(), "sample": spark.table(t.name).limit(sample_rows).collect()} for t in spark.catalog.listTables()]


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a database, read only; pass partitionColumn and bounds to read it in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def hub_path(dataset: str, split: str = "train") -> str:
    """Where a file system for the hub, if one is configured, has a data set's Parquet."""
    return f"hf://datasets/{dataset}/data/{split}-*.parquet"


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, size, modified, extension, md5, sha256 of files."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("extension"), F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256, records of text files."""
    lines = spark.read.text(path).filter(F.trim("value") != "").groupBy(F.input_file_name().alias("path")).agg(F.count("*").alias("records"))
    own = files(spark, path).select(F.regexp_replace("path", "^file:/+", "/").alias("p"), F.col("size").alias("bytes"), "sha256")
    return own.join(lines.select(F.regexp_replace("path", "^file:/+", "/").alias("p"), "records"), "p", "left").select(F.col("p").alias("path"), "bytes", "sha256", F.coalesce("records", F.lit(0)).alias("records"))


def exported(spark: SparkSession, path: str, field: str = "emails") -> DataFrame:
    """Rows of a JSON export {field: [...]}; an export without the field raises."""
    doc = spark.read.option("multiLine", "true").json(path)
    if field not in doc.columns:
        raise ValueError(f"the export has no {field}")
    return doc.select(F.explode(field).alias("x")).select("x.*")


def domain_lookup(index: DataFrame, domain: str, max_matches: int = 100) -> DataFrame:
    """Rows of a crawl index(url, file, offset, length) on a domain or below it."""
    host = F.lower(F.regexp_extract("url", r"://([^/:?#]*)", 1))
    return index.filter((host == domain) | host.endswith(f".{domain}")).orderBy("url", "offset").limit(max_matches)


def json_structure(text: Column) -> dict[str, Column]:
    """Counts of keys, objects and arrays in JSON text outside strings, and whether it parses."""
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', '""')
    return {"n_keys": F.regexp_count(bare, F.lit(r'""\s*:')), "n_objects": F.regexp_count(bare, F.lit(r"\{")), "n_arrays": F.regexp_count(bare, F.lit(r"\[")), "valid": F.try_parse_json(text).isNotNull()}


def xml_text(xml: Column) -> Column:
    """The character data of markup, a space between elements."""
    return F.trim(F.regexp_replace(F.regexp_replace(xml, r"(?s)<!--.*?-->|<\?.*?\?>|<[^>]+>", " "), r"\s+", " "))


# ---- shaping for writers ---------------------------------------------------------------------------
def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Struct fields as columns a_b; lists and maps as JSON text."""
    out: list[Column] = []

    def walk(kind, path: list[str]) -> None:
        for f in kind.fields:
            full = [*path, f.name]
            c = F.col(".".join(f"`{p}`" for p in full))
            if isinstance(f.dataType, StructType):
                walk(f.dataType, full)
            else:
                out.append((F.to_json(c) if isinstance(f.dataType, ArrayType | MapType) else c).alias(sep.join(full)))

    walk(df.schema, [])
    return df.select(*out)


def canonical_json(*columns: str) -> Column:
    """JSON with keys in order and no spaces; nulls are kept out."""
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(columns))))


def jsonify(df: DataFrame) -> DataFrame:
    """Complex columns as JSON text; empty maps are null."""
    def one(f) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, MapType):
            return F.when(F.size(c) > 0, F.to_json(c)).alias(f.name)
        return F.to_json(c).alias(f.name) if isinstance(f.dataType, StructType | ArrayType) else c

    return df.select(*(one(f) for f in df.schema.fields))


def save(df: DataFrame, path: str, format: str | None = None, compression: str | None = None, mode: str = "errorifexists", sep: str = ",", max_records: int | None = None) -> None:
    """Writes json (lines), jsonl, csv (columns in order), parquet (flat), text (one column) or any Spark format."""
    kind = format or detect(path)
    w = lambda d: (lambda x: x.option("compression", compression) if compression else x)(d.write.mode(mode).option("maxRecordsPerFile", max_records or 0))
    if kind in ("json", "jsonl"):
        w(df).json(path)
    elif kind == "csv":
        flat = flatten(df)
        if not flat.columns:
            raise ValueError("nothing to write")
        w(flat.select(*sorted(flat.columns))).csv(path, header=True, sep=sep)
    elif kind == "parquet":
        w(flatten(df)).parquet(path)
    elif kind == "text":
        w(df.select(df.columns[0])).text(path)
    else:
        w(df).format(kind).save(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    jsonify(df).write.mode(mode).option("compression", "zstd").parquet(path)


def convert(spark: SparkSession, source: str, target: str, format_in: str | None = None, format_out: str | None = None) -> bool:
    """Reads and writes; equal formats are left alone, which gives False."""
    a, b = format_in or detect(source), format_out or detect(target)
    if a == b:
        return False
    save(load(spark, source, a), target, b)
    return True


def convert_many(spark: SparkSession, jobs: list[tuple[str, str]]) -> dict[str, object]:
    """status success, partial or error, and the errors by source."""
    errors: dict[str, str] = {}
    for source, target in jobs:
        try:
            convert(spark, source, target)
        except Exception as e:  # noqa: BLE001  a job's fault is its result
            errors[source] = str(e)
    return {"status": "success" if not errors else "error" if len(errors) == len(jobs) else "partial", "errors": errors}


def write_shards(df: DataFrame, path: str, key: str, n: int) -> None:
    """Shards by hash of key, each in order of key, as folders shard=0 and on."""
    from millrace.functions.text import shard_index

    out = df.withColumn("shard", shard_index(F.col(key).cast("string"), n))
    out.repartition(n, "shard").sortWithinPartitions("shard", key).write.partitionBy("shard").parquet(path)


def rebuild(df: DataFrame, key: str) -> DataFrame:
    """df with key as text and without rows whose key is blank."""
    return df.withColumn(key, F.col(key).cast("string")).filter(F.trim(key) != "")


def ntriples(edges: DataFrame, base: str = "urn:x:") -> DataFrame:
    """line: edges(src, type, dst) as N-Triples."""
    iri = lambda c: F.concat(F.lit(f"<{base}"), F.regexp_replace(c, r"[^A-Za-z0-9._~:-]", "_"), F.lit(">"))
    return edges.select(F.concat_ws(" ", iri(F.col("src")), iri(F.col("type")), iri(F.col("dst")), F.lit(".")).alias("line"))


def first_vector(vectors: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """vectors(cid, embedding, text_chunk_order) -> cid, embedding: the first that isn't empty, of the keys if given."""
    if keys is not None:
        vectors = vectors.join(keys.select("cid").distinct(), "cid", "left_semi")
    full = vectors.filter(F.size("embedding") > 0)
    return full.withColumn("rn", F.row_number().over(W.partitionBy("cid").orderBy("text_chunk_order"))).filter("rn = 1").select("cid", "embedding")


def attach_vectors(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    return rows.join(first_vector(vectors), "cid", "left")


def json_text(rows: list[dict]) -> str:
    """A few rows as CSV text, for messages."""
    out = _io.StringIO()
    w = csv.DictWriter(out, sorted({k for r in rows for k in r}))
    w.writeheader()
    w.writerows(rows)
    return out.getvalue()
