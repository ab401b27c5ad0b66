"""Readers and writers of files: delimited text of unknown make, the video store, and the export."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.operators import ingest
from opinara.schema import VIDEO_SCHEMA

#: Bytes that cp1252 leaves open, as pairs of hexadecimal digits; a file with one of them is Latin-1.
_OPEN = "^(?:..)*(?:81|8D|8F|90|9D)"
#: Spark does not read cp1252; it is read as Latin-1, where 0x80 to 0x9F differ.
_LATIN = "".join(chr(b) for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore"))
_CP1252 = _LATIN.encode("latin-1").decode("cp1252")


def delimiter(header: str) -> str:
    try:
        return csv.Sniffer().sniff(header + "\n", ",;\t|").delimiter
    except csv.Error:
        return ","


def judged(lines: DataFrame) -> tuple[str, bool]:
    """Encoding of a file, and whether quotes span its lines, from all its lines in one pass."""
    value = F.col("value")
    quotes = F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))
    one = lines.agg(F.count_if(F.trim(value) != "").alias("n"), F.max(~F.is_valid_utf8(value)).alias("other"), F.max(F.hex(value.cast("binary")).rlike(_OPEN)).alias("open"), F.max(quotes % 2 == 1).alias("spans")).first()
    if not one["n"]:
        raise ValueError("the file is empty")
    return ("utf-8" if not one["other"] else "latin-1" if one["open"] else "cp1252"), bool(one["spans"])


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, names trimmed, only the empty string null; unnamed empty columns are dropped.

    A file is UTF-8 if every line of it is; one whose quotes span no line is read in parallel parts.
    """
    lines = spark.read.text(path)
    encoding, spans = judged(lines)
    header = lines.where(F.trim("value") != "").select(F.col("value").cast("binary").alias("v")).first()["v"]
    charset = "UTF-8" if encoding == "utf-8" else "ISO-8859-1"
    df = spark.read.csv(path, header=True, inferSchema=False, sep=delimiter(bytes(header).decode(charset)), encoding=charset, multiLine=spans, escape='"', nullValue="", ignoreLeadingWhiteSpace=True)
    df = df.drop(*[c for c in df.columns if c.startswith("_c")])
    if encoding == "cp1252":
        df = df.select(*[F.translate(F.col(f"`{c}`"), _LATIN, _CP1252).alias(c) for c in df.columns])
    return df.toDF(*[c.strip().lstrip("\ufeff") for c in df.columns])


def read_reviews(spark: SparkSession, path: str, stem: str, mapping: dict[str, str] | None = None) -> DataFrame:
    """A file's good reviews; a field without a column is an error that names it."""
    raw = read_delimited(spark, path)
    if mapping is None:
        found = ingest.detect_columns(raw)
        if found.missing:
            raise ValueError(f"{path}: no column for {', '.join(found.missing)}")
        mapping = found.columns
    elif problems := ingest.mapping_problems(mapping, raw.columns):
        raise ValueError(f"{path}: {'; '.join(problems)}")
    return ingest.validate(ingest.normalise(raw, mapping, stem)).withColumn("source_file", F.lit(stem))


def load_reviews(spark: SparkSession, path: str, stem: str, sample: DataFrame) -> tuple[DataFrame, str]:
    """A file's reviews, or ``sample`` where it can't be read, and why it could not."""
    try:
        return read_reviews(spark, path, stem), ""
    except Exception as e:  # whatever is wrong with the file, there is something to show
        return sample, str(e).splitlines()[0]


def read_many(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame | None, dict[str, str]]:
    """The union of the files that can be read, and why the others cannot."""
    parts, failed = [], {}
    for stem, path in paths.items():
        try:
            parts.append(read_reviews(spark, path, stem))
        except Exception as e:  # one file never keeps the others out
            failed[stem] = str(e).splitlines()[0]
    return (ingest.union_all(parts) if parts else None), failed


def read_videos(spark: SparkSession, path: str) -> DataFrame:
    """The video store: JSON objects, in an array or one to a line; entries without an id or a text are dropped."""
    start = spark.read.text(path).where("trim(value) <> ''").first()
    return spark.read.schema(VIDEO_SCHEMA).json(path, multiLine=bool(start) and start["value"].lstrip().startswith("["), mode="PERMISSIVE").where("review_id IS NOT NULL AND review_text IS NOT NULL")


def analysis_fields(videos: DataFrame) -> DataFrame:
    """Only the columns that the analysis uses; missing ones are null."""
    kinds = dict(part.strip().split(" ", 1) for part in (VIDEO_SCHEMA.rsplit(", timestamps", 1)[0]).split(", "))
    return videos.select(*[F.col(c) if c in videos.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()])


def write_videos(videos: DataFrame, path: str) -> None:
    videos.write.mode("overwrite").json(path)


def export(reviews: DataFrame, path: str) -> None:
    """UTF-8 CSV with a header; arrays become text parted by semicolons."""
    flat = [F.array_join(c, "; ").alias(c) if t.startswith("array<string>") else F.col(c) for c, t in reviews.dtypes]
    reviews.select(*flat).write.mode("overwrite").csv(path, header=True, escape='"')
