"""File sources and sinks: plain text, epub, recognised pages as JSON, manifests, partitioned results."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.functions import files as N
from quirespark.functions import text as T
from quirespark.operators.layout import OCR_SCHEMA


METRIC_TOLERANCE = 15.0  # how far a line type's left edge may lie from its offset


def file_info(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``path, name, size, modified, format, mime`` without reading contents."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    df = (r.option("pathGlobFilter", glob) if glob else r).load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    name = N.basename(F.col("path"))
    return df.select("path", name.alias("name"), "size", "modified", N.format_of(name).alias("format"), N.mime(N.format_of(name)).alias("mime"))


def headers(spark: SparkSession, path: str) -> DataFrame:
    """``path, size, header``: the first kilobyte of each file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), F.substring("content", 1, 1024).alias("header"))


def plain_text(spark: SparkSession, path: str, sniff: bool = True) -> DataFrame:
    """``path, encoding, text``: whole files; without sniffing all are UTF-8."""
    if not sniff:
        return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.lit("utf8").alias("encoding"), F.col("value").alias("text"))
    d = spark.read.format("binaryFile").load(path)
    got = N.decode_bytes(F.col("content"))
    return d.select("path", got["encoding"].alias("encoding"), got["text"].alias("text"))


def read_epub(content: bytes) -> dict:
    """Metadata and chapters of an epub in spine order; chapters that cannot be read are left out."""
    z = zipfile.ZipFile(io.BytesIO(content))
    strip = lambda tag: tag.rsplit("}", 1)[-1]
    container = ElementTree.fromstring(z.read("META-INF/container.xml"))
    opf = next(e.attrib["full-path"] for e in container.iter() if strip(e.tag) == "rootfile")
    root = ElementTree.fromstring(z.read(opf))
    base = opf.rsplit("/", 1)[0] + "/" if "/" in opf else ""
    items = {e.attrib["id"]: e.attrib["href"] for e in root.iter() if strip(e.tag) == "item"}
    meta = {strip(e.tag): (e.text or "").strip() for e in root.iter() if strip(e.tag) in ("title", "creator", "language")}
    chapters = []
    for e in root.iter():
        if strip(e.tag) == "itemref" and e.attrib["idref"] in items:
            try:
                html = z.read(base + items[e.attrib["idref"]]).decode("utf-8", "replace")
            except KeyError:
                continue
            m = re.search(r"(?is)<h\d[^>]*>(.*?)</h\d>|<title[^>]*>(.*?)</title>", html)
            chapters.append({"title": re.sub("<[^>]*>", "", (m[1] or m[2] or "") if m else "").strip(), "html": html})
    return {"title": meta.get("title") or "Unknown", "author": meta.get("creator") or "Unknown", "language": meta.get("language") or "Unknown", "chapters": chapters}


def epub(spark: SparkSession, path: str) -> DataFrame:
    """``path, title, author, language, chapter_no (from 1), chapter_title, text, words``; files that are no epub give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, c in zip(b["path"], b["content"]):
                try:
                    got = read_epub(bytes(c))
                except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError):
                    continue
                rows += [(p, got["title"], got["author"], got["language"], n, ch["title"] or f"Chapter {n}", ch["html"]) for n, ch in enumerate(got["chapters"], 1)]
            yield pd.DataFrame(rows, columns=["path", "title", "author", "language", "chapter_no", "chapter_title", "html"])

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path).select("path", "content")
    x = raw.mapInPandas(run, "path string, title string, author string, language string, chapter_no int, chapter_title string, html string")
    return x.withColumn("text", T.strip_html(F.col("html"))).drop("html").withColumn("words", T.word_count(F.col("text")))


def recognised_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of nested paragraphs, lines, words and symbols from JSON files; damaged files give null rows, which are left out."""
    return spark.read.schema(OCR_SCHEMA).option("multiLine", "true").option("mode", "PERMISSIVE").json(path).filter("doc_id IS NOT NULL")


def write_pages(pages: DataFrame, path: str) -> None:
    pages.write.mode("overwrite").json(path)


def write_texts(texts: DataFrame, path: str, key: str = "book_key", buckets: int = 64) -> None:
    """Books in a fixed number of folders by the hash of their key; a large book is spread over files by the writer's own tasks."""
    texts.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_texts(spark: SparkSession, path: str, keys: list[str] | None = None, key: str = "book_key", buckets: int = 64) -> DataFrame:
    """What write_texts() wrote; of given books only their folders are read."""
    df = spark.read.parquet(path)
    if keys is not None:
        of = spark.range(1).select(F.array(*[F.pmod(F.xxhash64(F.lit(k)), F.lit(buckets)).cast("int") for k in keys])).first()[0] if keys else []
        df = df.filter(F.col("bucket").isin(*of) & F.col(key).isin(*keys)) if keys else df.limit(0)
    return df.drop("bucket")


def book_types(path: str) -> dict[str, dict]:
    """Book types from a JSON or (where a parser is installed) YAML file.

    A type has ``header-types`` (or ``headerTypes``, ``header-type``) of ``level1`` to ``level3``
    with ``formats`` (strings, or ``pattern`` and ``multipleLines``), ``metrics`` (line
    type to offset), and ``text-removal-patterns``; all may be missing. Types that the
    file lacks have no formats, offsets or patterns; 'default' is always there.
    """
    with open(path, encoding="utf-8") as f:
        raw = f.read()
    if path.endswith(".json"):
        data = json.loads(raw)
    else:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs a parser; give the book types as JSON") from e
        data = yaml.safe_load(raw)
    if not isinstance(data, dict):
        raise ValueError(f"{path} holds no book types")
    out: dict[str, dict] = {"default": {"headers": [[], [], []], "offsets": {}, "removal": []}}
    for name, c in data.items():
        c = c or {}
        head = c.get("header-types") or c.get("headerTypes") or c.get("header-type") or {}
        levels = [[(x, False) if isinstance(x, str) else (x["pattern"], bool(x.get("multipleLines"))) for x in ((head.get(f"level{k}") or {}).get("formats") or [])] for k in (1, 2, 3)]
        offsets = {k: (float(v), METRIC_TOLERANCE) for k, v in (c.get("metrics") or {}).items() if k != "paragraph-text"}
        out[name] = {"headers": levels, "offsets": offsets, "removal": list(c.get("text-removal-patterns") or c.get("textRemovalPatterns") or [])}
    return out


def not_yet_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows whose key has no stored result."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def choose_source(df: DataFrame, ocr: str, given: str, stored: str) -> DataFrame:
    """Adds ``source_text, source_type, source_priority``: recognised text before a given file before a stored result; empty counts as missing."""
    o, g, s = (F.nullif(F.col(c), F.lit("")) for c in (ocr, given, stored))
    return df.withColumns({
        "source_text": F.coalesce(o, g, s),
        "source_type": F.when(o.isNotNull(), "ocr").when(g.isNotNull(), "file").when(s.isNotNull(), "stored"),
        "source_priority": F.when(o.isNotNull(), 1).when(g.isNotNull(), 2).when(s.isNotNull(), 3),
    })


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """``book_key, yaml``: manifest files below a folder, the template left out; the folder name is the key."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.yaml").load(path)
    key = F.regexp_extract(F.url_decode("path"), r"([^/]+)/[^/]+\.yaml$", 1)
    return d.select(key.alias("book_key"), F.col("content").cast("string").alias("yaml"), "path").filter(~F.col("path").contains("default-")).drop("path")


def manifest_fields(df: DataFrame) -> DataFrame:
    """Simple scalar fields and list entries of manifest texts: ``book_key, author, title, book_index, text_before, text_after, book_structure``.

    Reads the flat layout in which manifests are written here: ``key: value``
    lines and ``- item`` lists, with optional quotes; both spellings of the
    structure's key are known.
    """
    field = lambda k: F.nullif(F.regexp_extract("yaml", rf"(?m)^{k}:[ ]*['\"]?(.*?)['\"]?[ ]*$", 1), F.lit(""))
    block = F.regexp_extract("yaml", r"(?m)^(?:book-)?structure:[ ]*\n((?:[ ]*- .*\n?)*)", 1)
    items = F.transform(F.regexp_extract_all(block, F.lit(r"(?m)^[ ]*- ['\"]?(.*?)['\"]?[ ]*$"), F.lit(1)), lambda x: x)
    return df.select("book_key", field("author").alias("author"), field("title").alias("title"), field("book-index").alias("book_index"), field("text-before-first-chapter").alias("text_before"), field("text-after-last-chapter").alias("text_after"), items.alias("book_structure"))


def manifest_yaml(df: DataFrame) -> DataFrame:
    """``book_key, yaml``: manifest rows as texts of that layout; null fields are left out."""
    line = lambda k, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{k}: '"), F.col(c).cast("string"), F.lit("'\n"))).otherwise("")
    s = F.when(F.size("book_structure") > 0, F.concat(F.lit("book-structure:\n"), F.array_join(F.transform("book_structure", lambda x: F.concat(F.lit("  - '"), x, F.lit("'\n"))), ""))).otherwise("")
    return df.select("book_key", F.concat(line("author", "author"), line("title", "title"), line("book-index", "book_index"), line("text-before-first-chapter", "text_before"), line("text-after-last-chapter", "text_after"), F.coalesce(s, F.lit(""))).alias("yaml"))
