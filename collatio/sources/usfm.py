"""Marked-up source texts: directories and archives of USFM files to reference records."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.digests import file_set_digest, ordered_digest, record_json
from ..functions.text import ref_label, trim_unicode
from .archives import read_entries

#: The importer's version, as locks have it.
IMPORTER = "1"
#: Codes and names of books in canonical order.
BOOKS = (
    ("GEN", "Genesis"), ("EXO", "Exodus"), ("LEV", "Leviticus"), ("NUM", "Numbers"), ("DEU", "Deuteronomy"), ("JOS", "Joshua"), ("JDG", "Judges"), ("RUT", "Ruth"),
    ("1SA", "1 Samuel"), ("2SA", "2 Samuel"), ("1KI", "1 Kings"), ("2KI", "2 Kings"), ("1CH", "1 Chronicles"), ("2CH", "2 Chronicles"), ("EZR", "Ezra"), ("NEH", "Nehemiah"),
    ("EST", "Esther"), ("JOB", "Job"), ("PSA", "Psalms"), ("PRO", "Proverbs"), ("ECC", "Ecclesiastes"), ("SNG", "Song of Solomon"), ("ISA", "Isaiah"), ("JER", "Jeremiah"),
    ("LAM", "Lamentations"), ("EZK", "Ezekiel"), ("DAN", "Daniel"), ("HOS", "Hosea"), ("JOL", "Joel"), ("AMO", "Amos"), ("OBA", "Obadiah"), ("JON", "Jonah"), ("MIC", "Micah"),
    ("NAM", "Nahum"), ("HAB", "Habakkuk"), ("ZEP", "Zephaniah"), ("HAG", "Haggai"), ("ZEC", "Zechariah"), ("MAL", "Malachi"), ("MAT", "Matthew"), ("MRK", "Mark"), ("LUK", "Luke"),
    ("JHN", "John"), ("ACT", "Acts"), ("ROM", "Romans"), ("1CO", "1 Corinthians"), ("2CO", "2 Corinthians"), ("GAL", "Galatians"), ("EPH", "Ephesians"), ("PHP", "Philippians"),
    ("COL", "Colossians"), ("1TH", "1 Thessalonians"), ("2TH", "2 Thessalonians"), ("1TI", "1 Timothy"), ("2TI", "2 Timothy"), ("TIT", "Titus"), ("PHM", "Philemon"), ("HEB", "Hebrews"),
    ("JAS", "James"), ("1PE", "1 Peter"), ("2PE", "2 Peter"), ("1JN", "1 John"), ("2JN", "2 John"), ("3JN", "3 John"), ("JUD", "Jude"), ("REV", "Revelation"),
)
#: Markers of lines that do not continue a verse.
HEADINGS = ("id", "ide", "h", "toc1", "toc2", "toc3", "mt", "mt1", "mt2", "s", "s1", "s2", "s3", "r", "d", "cl", "rem")
#: Fixed value: a verse's marker and number.
VERSE = r"\\v\s+([0-9]+(?:-[0-9]+)?[a-z]?)\s*"


def clean(raw: Column) -> Column:
    """Text without notes, references and markers. The patterns, in this order."""
    out = raw
    for pattern, put in (
        (r"(?s)\\f\s.*?\\f\*", " "),
        (r"(?s)\\x\s.*?\\x\*", " "),
        (r"(?s)\\(?:fe|ef|ex)\s.*?\\(?:fe|ef|ex)\*", " "),
        (r"\\\+?w\s+([^|\\]+)(?:\|[^\\]*)?\\\+?w\*", "$1"),
        (r"\\\+?[A-Za-z][A-Za-z0-9+\-]*\*?(?:\s+)?", " "),
        (r"[\p{Z}\t\n]+", " "),
    ):
        out = F.regexp_replace(out, pattern, put)
    return trim_unicode(out)


def read_directory(spark: SparkSession, root: str) -> DataFrame:
    """`path` (relative to the root, with /) and `content` of USFM files below it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).filter(r"lower(path) rlike '[.](usfm|sfm)$'")
    return files.select(F.regexp_replace("path", rf"^.*?\Q{root.rstrip('/')}\E/", "").alias("path"), "content")


def read_zip(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """`path` and `content` of the USFM entries of archives, each entry read by itself."""
    entries = read_entries(spark, path, (".usfm", ".sfm"))
    return entries.select(F.replace("path", F.lit("\\"), F.lit("/")).alias("path"), "content")


def parse(files: DataFrame, edition: str) -> DataFrame:
    """Verses of `path`, `content`: `translation`, book, chapter, verses, text, and `path`, `line` they begin at.

    Book, chapter and verse are carried forward over a file's lines by windows. Lines before a verse or
    under a heading belong to none. A verse before any chapter is an error; one of an unknown book is dropped.
    """
    lines = files.select("path", F.posexplode(F.split(F.decode("content", "UTF-8"), "\n")).alias("no", "raw"))
    lines = lines.withColumn("line", trim_unicode(F.regexp_replace("raw", "^﻿+", "")))
    is_id, is_chapter = F.col("line").startswith("\\id "), F.col("line").startswith("\\c ")
    marked = ~is_id & ~is_chapter
    first_word = lambda c, n: F.get(F.filter(F.split(c.substr(F.lit(n), F.length(c)), r"\s+"), lambda x: x != ""), F.lit(0))
    lines = lines.withColumns(
        {
            "code": F.when(is_id, F.upper(first_word(F.col("line"), 5))),
            "chapter_no": F.when(is_chapter, first_word(F.col("line"), 4).cast("int")),
            "numbers": F.when(marked, F.regexp_extract_all("line", F.lit(VERSE), 1)).otherwise(F.array().cast("array<string>")),
            "parts": F.when(marked, F.split("line", VERSE)).otherwise(F.array().cast("array<string>")),
        }
    )
    marker = F.regexp_extract("line", r"^\\(\S+)", 1)
    goes_on = marked & (F.size("numbers") == 0) & (F.col("line") != "") & ~marker.isin(*HEADINGS)
    prefix = F.when((F.size("numbers") > 0) & (clean(F.get("parts", F.lit(0))) != ""), F.get("parts", F.lit(0)))
    # Pieces in order: what continues the verse before (number null), then each verse of the line; a chapter ends a verse.
    opening = F.array_compact(F.array(F.when(goes_on, F.struct(F.lit(None).cast("string").alias("number"), F.col("line").alias("text"), F.lit(False).alias("ends"))), F.when(prefix.isNotNull(), F.struct(F.lit(None).cast("string").alias("number"), prefix.alias("text"), F.lit(False).alias("ends"))), F.when(is_chapter, F.struct(F.lit(None).cast("string").alias("number"), F.lit("").alias("text"), F.lit(True).alias("ends")))))
    verses = F.transform("numbers", lambda n, i: F.struct(n.alias("number"), F.get("parts", i + 1).alias("text"), F.lit(False).alias("ends")))
    down = Window.partitionBy("path").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumns({"code": F.last("code", ignorenulls=True).over(down), "chapter": F.coalesce(F.last("chapter_no", ignorenulls=True).over(down), F.lit(0))})
    pieces = lines.select("path", "no", "code", "chapter", F.posexplode(F.concat(opening, verses)).alias("k", "p")).select("path", "no", "k", "code", "chapter", "p.*")
    order = Window.partitionBy("path").orderBy("no", "k").rowsBetween(Window.unboundedPreceding, 0)
    begins = F.col("number").isNotNull() | F.col("ends")
    pieces = pieces.withColumn("verse", F.sum(begins.cast("int")).over(order)).filter("verse > 0")
    whole = pieces.groupBy("path", "verse").agg(
        F.min_by(F.struct("code", "chapter", "number", "no", "ends"), F.struct("no", "k")).alias("v"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "k", "text"))), lambda x: x["text"]), " ").alias("raw"),
    )
    whole = whole.filter("v.number is not null").withColumn("text", clean(F.col("raw")))
    names = F.create_map(*(F.lit(x) for pair in BOOKS for x in pair))
    range_ = F.split("v.number", "-")
    number = lambda i: F.regexp_replace(F.get(range_, F.lit(i)), "[A-Za-z]+$", "").cast("int")
    whole = whole.withColumns({"book": F.try_element_at(names, F.col("v.code")), "verse_start": number(0), "verse_end": number(1)}).filter("book is not null")
    fault = F.when(F.col("v.chapter") == 0, "verse appeared before a chapter").when((F.col("verse_start") > 65535) | (F.col("verse_end") > 65535), "invalid verse number")
    chapter = F.when(fault.isNotNull(), F.raise_error(fault).cast("int")).otherwise(F.col("v.chapter"))
    return whole.select(F.lit(edition).alias("translation"), "book", chapter.alias("chapter"), "verse_start", "verse_end", "text", "path", F.col("v.no").alias("line")).filter("text <> ''")


def import_edition(files: DataFrame, edition: str) -> DataFrame:
    """Verses in canonical order with `ord`; of verses with one reference the first stays."""
    order = F.create_map(*(F.lit(x) for k, (_, name) in enumerate(BOOKS) for x in (name, k)))
    rows = parse(files, edition)
    once = Window.partitionBy("book", "chapter", "verse_start", "verse_end").orderBy("path", "line")
    rows = rows.withColumn("n", F.row_number().over(once)).filter("n = 1").drop("n")
    sort = [F.element_at(order, F.col("book")), "chapter", "verse_start", F.coalesce("verse_end", F.lit(0))]
    return rows.withColumns({"book_order": sort[0], "ref_label": ref_label(*(F.col(c) for c in ("book", "chapter", "verse_start", "verse_end")))})


def lock(files: DataFrame, verses: DataFrame, edition: str, edition_text: str = "", source_url: str = "", archive: bytes | None = None) -> DataFrame:
    """One row, as it stands in a lock file: the digest of the source (of `archive`, else of the set of files), each file's digest and
    size, how many references `verses` (of `import_edition`) are, and the digest of these as JSON lines in canonical order."""
    artifacts = files.agg(F.array_sort(F.collect_list(F.struct("path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("decimal(20,0)").alias("bytes")))).alias("artifacts"))
    record = record_json(translation=F.lit(edition), reference=F.struct("book", "chapter", "verse_start", "verse_end"), text=F.col("text"))
    corpus = ordered_digest(verses, record, F.struct("book_order", "chapter", "verse_start", F.coalesce("verse_end", F.lit(0))), lines=True).withColumnRenamed("digest", "corpus_sha256")
    source = file_set_digest(files).withColumnRenamed("digest", "source_sha256")
    if archive is not None:
        source = source.withColumn("source_sha256", F.lit(hashlib.sha256(archive).hexdigest()))
    rows = source.crossJoin(artifacts).crossJoin(verses.agg(F.count(F.lit(1)).alias("reference_count"))).crossJoin(corpus)  # single rows
    return rows.select(F.lit(1).alias("schema_version"), F.lit(edition).alias("translation"), F.lit(edition_text).alias("edition"), F.lit(source_url).alias("source_url"), "source_sha256", F.lit(IMPORTER).alias("importer_version"), "artifacts", "reference_count", "corpus_sha256")


def render(refs: DataFrame, codes: Column) -> DataFrame:
    """USFM files of references with a single verse each (`path`, `content`): a file a book, for round trips."""
    verse = F.concat(F.lit("\\v "), "verse_start", F.lit(" "), "text")
    chapter = refs.withColumn("code", codes).groupBy("book", "code", "chapter").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("verse_start", verse.alias("v")))), lambda x: x["v"]), "\n").alias("verses"))
    body = chapter.withColumn("c", F.concat(F.lit("\\c "), "chapter", F.lit("\n\\s1 A heading\n\\p\n"), "verses"))
    book = body.groupBy("book", "code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chapter", "c"))), lambda x: x["c"]), "\n").alias("text"))
    return book.select(F.concat("code", F.lit(".usfm")).alias("path"), F.encode(F.concat(F.lit("\\id "), "code", F.lit(" test\n"), "text", F.lit("\n")), "UTF-8").alias("content"))
