"""Where the engine's relations come from: driver tables, files, links, and what is known of them before reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from exposark.functions import tables
from exposark.functions.text import stripped

SCANNABLE = (".pdf", ".png", ".jpg", ".jpeg", ".txt", ".docx", ".doc", ".html", ".csv")
AS_OF = "2024-01-31"
#: Bytes of an Arrow batch at most, or one row where that has more: a worker holds a batch of whole texts, not 10 000 rows of any length.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan history from events: scan_id, owner_id, upload_date, score, source, n_findings, risk."""
    from exposark.operators.score import risk

    events = table(spark, sf_dir, "events")
    score = F.round(F.least(F.coalesce("value", F.lit(0.0)), F.lit(100.0)), 1)
    return events.select(
        F.col("event_id").alias("scan_id"),
        F.col("user_id").alias("owner_id"),
        F.col("ts").cast("timestamp").alias("upload_date"),
        score.alias("score"),
        F.coalesce("event_type", F.lit("file")).alias("source"),
        F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("n_findings"),
        risk(score, "aggregate").alias("risk"),
    )


def files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as path, length, content, extension and kind by their first bytes."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", "length", "content", extension(F.col("path")).alias("extension"), sniffed(F.col("content")).alias("kind"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as path and text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))


def is_scannable(path: Column, length: Column, most: int = 25 * 1024 * 1024) -> Column:
    return extension(path).isin(*SCANNABLE) & (length <= most)


def sniffed(content: Column) -> Column:
    """The kind of a file by its first bytes."""
    out = None
    for magic, kind in tables.MAGIC:
        test = F.hex(F.substring(content, 1, len(magic) // 2)) == magic
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.when(F.lower(F.substring(content, 1, 256).cast("string")).rlike(r"^\s*<(!doctype html|html)"), ".html")


def guessed_extension(content_type: Column, url: Column) -> Column:
    """From the content type, else the end of the URL, else .pdf."""
    out = None
    kind = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    for k, v in tables.CONTENT_TYPES.items():
        out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
    return F.coalesce(out, F.nullif(extension(F.substring_index(url, "?", 1)), F.lit("")), F.lit(".pdf"))


def resolved_link(url: Column) -> Column:
    """struct(provider, download): direct addresses of shared files."""
    drive = F.regexp_extract(url, r"drive\.google\.com/(?:file/d/|open\?id=|uc\?id=)([A-Za-z0-9_-]+)", 1)
    dropbox = F.concat(F.regexp_replace(url, r"[?&]dl=[01]", ""), F.lit("?dl=1"))
    onedrive = F.concat(url, F.when(F.contains(url, F.lit("?")), "&download=1").otherwise("?download=1"))
    found = lambda provider, download: F.struct(F.lit(provider).alias("provider"), download.alias("download"))
    return (
        F.when(drive != "", found("gdrive", F.concat(F.lit("https://drive.google.com/uc?export=download&id="), drive)))
        .when(F.contains(url, F.lit("dropbox.com")), found("dropbox", dropbox))
        .when(url.rlike(r"1drv\.ms|onedrive\.live\.com|sharepoint\.com"), found("onedrive", onedrive))
        .when(url.rlike("^https?://"), found("direct_url", url))
    )


def with_scheme(url: Column) -> Column:
    """A URL without the white space around it; https where it names no web scheme."""
    u = stripped(url)
    return F.when(u.rlike("^https?://"), u).otherwise(F.concat(F.lit("https://"), u))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))


def is_private(host: Column) -> Column:
    """Whether a host is an IPv4 address of a private, local or link-local net, by its numbers."""
    part = lambda k: F.try_element_at(F.split(host, r"\."), F.lit(k)).try_cast("int")
    a, b = part(1), part(2)
    literal = host.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$")
    return F.coalesce(literal & (a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254))), F.lit(False))


def is_allowed(url: Column) -> Column:
    """Whether a page may be fetched: no blocked host, no path of machine metadata, and no private address."""
    u = with_scheme(url)
    h = host(u)
    path = F.regexp_extract(u, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    return (h != "") & ~h.isin(*tables.BLOCKED_HOSTS) & ~path.rlike(r"(?i)/(metadata|computeMetadata|latest/meta-data)") & ~is_private(h)


def platform(url: Column) -> Column:
    """The platform of a profile, by its host or a host above it."""
    h = host(url)
    out = None
    for site, name in tables.PLATFORMS:
        test = (h == site) | F.endswith(h, F.lit("." + site))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("unsupported")


def decimal_degrees(degrees: Column, minutes: Column, seconds: Column, side: Column) -> Column:
    value = degrees + minutes / 60 + seconds / 3600
    return F.round(F.when(side.isin("S", "W"), -value).otherwise(value), 6)


#: Extensions by who reads files, and kinds of office files.
ALLOWED = {
    "metadata": (".jpg", ".jpeg", ".png", ".tiff", ".tif", ".webp", ".bmp", ".pdf", ".docx", ".doc", ".xlsx", ".xls", ".pptx", ".ppt"),
    "batch": (".jpg", ".jpeg", ".png", ".bmp", ".webp"),
    "agent": (".pdf", ".docx", ".doc", ".txt", ".png", ".jpg", ".jpeg", ".bmp", ".tiff"),
    "blur": (".png", ".jpg", ".jpeg"),
}
OFFICE_CORE = (("dc:creator", "author"), ("cp:lastModifiedBy", "last_modified_by"), ("cp:revision", "revision"), ("dcterms:created", "creation_date"), ("dcterms:modified", "modification_date"), ("dc:title", "doc_title"), ("dc:subject", "subject"), ("cp:keywords", "keywords"))
OFFICE_APP = (("Company", "company", ".*?"), ("Application", "software", ".*?"), ("Words", "word_count", r"\d+"), ("Sheets", "sheet_count", r"\d+"))


def is_readable(path: Column, length: Column, reader: str, most: int = 25 * 1024 * 1024) -> Column:
    """Whether a reader takes a file, by its extension and size."""
    return extension(path).isin(*ALLOWED[reader]) & (length <= most)


def office_parts(files: DataFrame) -> DataFrame:
    """path, core, app and settings of zipped office files: the texts of the parts that hold properties, null where there are none or the file is no such file.

    Only opening the zip is left to Python, an Arrow batch at a time; what the parts say is told by column expressions.
    """
    import io
    import zipfile
    from collections.abc import Iterator

    import pyarrow as pa

    names = ("docProps/core.xml", "docProps/app.xml", "word/settings.xml")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(1).to_pylist():
                try:
                    with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
                        there = set(z.namelist())
                        rows.append([z.read(n).decode("utf-8", "ignore") if n in there else None for n in names])
                except (zipfile.BadZipFile, OSError, RuntimeError):
                    rows.append([None] * 3)
            columns = list(zip(*rows, strict=True)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], ["path", "core", "app", "settings"])

    return files.select("path", "content").mapInArrow(run, "path string, core string, app string, settings string")


def office_fields(parts: DataFrame) -> DataFrame:
    """path, field and value of the properties in office files; placeholders are left out."""
    from exposark.operators.detect import meaningful

    found = [(key, F.regexp_extract("core", rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1)) for tag, key in OFFICE_CORE]
    found += [(key, F.regexp_extract("app", rf"(?s)<{tag}>({form})</{tag}>", 1)) for tag, key, form in OFFICE_APP]
    found.append(("tracked_changes", F.when(F.contains("settings", F.lit("<w:trackRevisions")), "ACTIVE (Privacy Risk: Edit history is visible)")))
    pairs = F.array(*(F.struct(F.lit(k).alias("field"), meaningful(v).alias("value")) for k, v in found))
    return parts.select("path", F.explode(pairs).alias("f")).where(F.col("f.value").isNotNull()).select("path", "f.*")
