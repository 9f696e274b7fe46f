"""Sources: documents, manifests, tables, archives and reports, with explicit schemas."""

from __future__ import annotations

import io
import json
import time
import urllib.request
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of the file formats.
RAW_DOCUMENT = "id string, dolma_id string, text string, metadata string, url string"
SAMPLED_DOCUMENT = "dolma_id string, source string, text string, token_count int, metadata string"
CHECKPOINT = "source_name string, accumulated_tokens long, accumulated_docs long, completed_files array<string>, finished boolean"


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: str = RAW_DOCUMENT) -> DataFrame:
    """JSON lines, gzip by suffix.  Objects in string columns stay JSON text; broken lines are dropped.

    A gzip file is one task, so many files read well and one huge file doesn't: split before, or repartition after.
    """
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(paths)


def read_urls(urls: DataFrame, retries: int = 3, chunk: int = 1 << 18, wait: float = 1.0) -> DataFrame:
    """Documents of gzip JSON-lines files behind HTTP(S) addresses (column url): url, id, dolma_id, text, metadata, source_url, error.

    Every address is fetched by one task in chunks of 256 KiB, unpacked and parsed as it arrives.  A failed fetch starts again after 1, 2, 4, ... times
    ``wait`` seconds; after ``retries`` failures the address gives one row with the error and its documents so far are dropped.  Broken
    lines are left out; objects in string columns stay JSON text.
    """
    schema = "url string, id string, dolma_id string, text string, metadata string, source_url string, error string"
    names = [x.split()[0] for x in schema.split(", ")]

    def documents(url: str) -> Iterator[tuple]:
        with urllib.request.urlopen(url, timeout=60) as r:  # noqa: S310
            unpack, rest = zlib.decompressobj(zlib.MAX_WBITS | 32), b""
            while block := r.read(chunk):
                *lines, rest = (rest + unpack.decompress(block)).split(b"\n")
                yield from filter(None, map(parse, lines))
            if not unpack.eof:
                raise OSError("the file ends early")
            yield from filter(None, map(parse, [rest]))

    def parse(line: bytes) -> tuple | None:
        try:
            d = json.loads(line)
        except ValueError:
            return None
        if not isinstance(d, dict):
            return None
        say = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
        return tuple(say(d.get(k)) for k in ("id", "dolma_id", "text", "metadata", "url"))

    def fetch(pdfs):
        for pdf in pdfs:
            for url in pdf["url"]:
                for attempt in range(retries):
                    rows: list[tuple] = []
                    try:
                        for d in documents(url):
                            rows.append((url, *d, None))
                    except (OSError, zlib.error) as e:
                        if attempt + 1 == retries:
                            rows = [(url, *[None] * 5, str(e))]
                            break
                        time.sleep(wait * 2**attempt)
                    else:
                        break
                yield pd.DataFrame(rows, columns=names)

    return urls.select("url").distinct().repartition("url").mapInPandas(fetch, schema)


def in_file_order(df: DataFrame) -> DataFrame:
    """Rows by the name of the file they come from: with column ``file``, sorted by it."""
    return df.withColumn("file", F.input_file_name()).sort("file")


def document_id() -> F.Column:
    return F.coalesce("dolma_id", "id", F.lit(""))


def read_manifest(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    """URLs of a manifest that have one of the folders in their path: url, folder."""
    lines = spark.read.text(path).select(F.trim("value").alias("url")).filter("url != ''")
    hit = lines.select("url", F.explode(F.array(*[F.lit(f) for f in folders])).alias("folder"))
    return hit.filter(F.contains("url", F.concat(F.lit("/"), "folder", F.lit("/")))).dropDuplicates(["url"])


def shuffled_files(manifest: DataFrame, seed: int = 42) -> DataFrame:
    return manifest.orderBy(F.md5(F.concat("url", F.lit(str(seed)))))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, quoted fields that may hold line feeds, and doubled quotes."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"')


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def read_zip_texts(spark: SparkSession, path: str) -> DataFrame:
    """Text members of zip archives: name (without folders), text (UTF-8, else Latin-1).  One archive is one task."""

    def unzip(pdfs):
        for pdf in pdfs:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        if info.is_dir() or not info.filename.endswith(".txt"):
                            continue
                        raw = z.read(info)
                        try:
                            text = raw.decode("utf-8")
                        except UnicodeDecodeError:
                            text = raw.decode("latin-1")
                        yield pd.DataFrame({"name": [info.filename.rsplit("/", 1)[-1]], "text": [text]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unzip, "name string, text string")


def join_index(index: DataFrame, files: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(index rows with their text, index rows whose file is missing)."""
    f = files.withColumnRenamed("name", "_name")
    return index.join(f, index[name] == f["_name"]).drop("_name"), index.join(f, index[name] == f["_name"], "left_anti")


def read_report(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """A two-dimensional .npy array as (row_id, vec).  One file is one task; large collections belong in parquet."""
    import numpy as np

    def load(pdfs):
        for pdf in pdfs:
            for content in pdf["content"]:
                x = np.load(io.BytesIO(content))
                for i in range(0, len(x), 4096):
                    yield pd.DataFrame({"row_id": np.arange(i, min(i + 4096, len(x))), "vec": list(x[i : i + 4096].astype("float32"))})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(load, "row_id long, vec array<float>")


def pending(everything: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is not done yet."""
    return everything.join(done.select(key).distinct(), key, "left_anti")
