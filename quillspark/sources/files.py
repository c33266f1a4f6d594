"""Files as a source: scans, routing to readers, listings and logs."""

from __future__ import annotations

import base64
import importlib.util
import io
import os
import re
import shutil
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.grade import after_recognition, image_grade, text_grade
from quillspark.operators.profile import extension
from quillspark.operators.security import clean_log
from quillspark.session import ship

# Suffixes that are processed, and the limits of a valid file.
TEXT_SUFFIXES = (".txt", ".md")
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".tiff", ".bmp", ".gif")
SUFFIXES = (".pdf", *TEXT_SUFFIXES, *IMAGE_SUFFIXES)
MAX_BYTES = 50 * 1024 * 1024
CHARS_PER_PAGE = 100

Reader = Callable[[str, bytes], tuple[str, str]]
Strategy = Callable[[bytes], tuple[str, int]]  # (text, pages) of a document
OCR_PAGES = 4  # pages of a document that a recogniser reads


def read_text(path: str, content: bytes) -> tuple[str, str]:
    return content.decode("utf-8", "replace"), "text_file"


def read_none(path: str, content: bytes) -> tuple[str, str]:
    """For kinds without an installed reader: an extraction that failed, as a missing dependency does."""
    return "", "failed"


class Encrypted(ValueError):
    """A document that cannot be read without its password; no other reader is tried."""


def installed(module: str) -> bool:
    return importlib.util.find_spec(module) is not None


def pages_by_fitz(content: bytes) -> tuple[str, int]:
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        if doc.needs_pass:
            raise Encrypted("PDF is encrypted")
        return "\n".join(x for p in doc if (x := p.get_text()).strip()), len(doc)


def pages_by_pypdf(content: bytes) -> tuple[str, int]:
    import pypdf

    reader = pypdf.PdfReader(io.BytesIO(content))
    if reader.is_encrypted:
        raise Encrypted("PDF is encrypted")
    return "\n".join(x for p in reader.pages if (x := p.extract_text()).strip()), len(reader.pages)


def pages_by_recognition(content: bytes) -> tuple[str, int]:
    """The first OCR_PAGES pages, rendered and recognised."""
    import fitz
    import pytesseract
    from PIL import Image

    out = []
    with fitz.open(stream=content, filetype="pdf") as doc:
        pages = min(OCR_PAGES, len(doc))
        for i in range(pages):
            picture = doc[i].get_pixmap(matrix=fitz.Matrix(3.5, 3.5)).tobytes("png")
            out.append(pytesseract.image_to_string(Image.open(io.BytesIO(picture))))
    return "\n".join(x for x in out if x.strip()), pages


# Readers of a document in the order in which they are tried, with the modules they need.
STRATEGIES: tuple[tuple[str, tuple[str, ...], Strategy], ...] = (
    ("pymupdf_text", ("fitz",), pages_by_fitz),
    ("pypdf_text", ("pypdf",), pages_by_pypdf),
    ("ocr_extraction", ("fitz", "pytesseract", "PIL"), pages_by_recognition),
)
GRADES = ("failed", "poor", "fair", "good", "excellent")


def quick_grade(text: str) -> str:
    """text_grade() of one text in Python, for the choice between readers within one row."""
    plain = text.strip()
    words = plain.split()
    if len(plain) < 10 or len(words) < 20:
        return "failed"
    n = len(text)
    odd = sum(1 for c in text if not (c.isalnum() or c in " \n\t.,!?"))
    poor = sum((text.count("\ufffd") > n * 0.01, text.count("\n") > n * 0.1, len(words) < n * 0.1, odd > n * 0.1))
    if poor:
        return "poor" if poor > 1 else "fair"
    sized = 50 <= n <= 50_000 and sum(len(w) >= 3 for w in words) > 10
    return "fair" if not sized else "excellent" if "." in text else "good"


def document_reader(strategies: tuple[tuple[str, Strategy], ...] | None = None) -> Reader:
    """A reader that tries strategies in order.

    The first text of grade good or better is taken, unless the pages hold so little text that they must be pictures and a
    recogniser is there; a recognised text is taken if it is any good at all; otherwise the best of the failed tries. An
    encrypted document fails at once, and so does one that no strategy can read.
    """
    chosen = strategies if strategies is not None else tuple((n, f) for n, needs, f in STRATEGIES if all(map(installed, needs)))

    def read(path: str, content: bytes) -> tuple[str, str]:
        best, thin, recogniser = None, False, any(n.startswith("ocr") for n, _ in chosen)
        for name, strategy in chosen:
            try:
                text, pages = strategy(content)
            except Encrypted:
                raise
            except Exception:  # a reader that breaks leaves the document to the next one
                continue
            grade = quick_grade(text)
            by_text = not name.startswith("ocr")
            thin = thin or by_text and bool(text) and len(text.strip()) < CHARS_PER_PAGE * max(1, pages)
            if grade == "failed":
                continue
            if not by_text or grade in ("good", "excellent") and not (thin and recogniser):
                return text, name
            if best is None or GRADES.index(grade) > GRADES.index(best[0]):
                best = (grade, text, name)
        if best is None:
            raise ValueError("no reader could extract text")
        return best[1], best[2]

    return read


def image_reader(recognise: Strategy | None = None) -> Reader:
    """A reader that recognises the text of a picture."""

    def own(content: bytes) -> tuple[str, int]:
        import pytesseract
        from PIL import Image

        return pytesseract.image_to_string(Image.open(io.BytesIO(content)).convert("RGB")), 1

    def read(path: str, content: bytes) -> tuple[str, str]:
        if recognise is None and not (installed("pytesseract") and installed("PIL")):
            raise ValueError("no recogniser is installed")
        return (recognise or own)(content)[0], "tesseract_ocr"

    return read


READERS: dict[str, Reader] = {s: read_text for s in TEXT_SUFFIXES} | {".pdf": document_reader()} | {s: image_reader() for s in IMAGE_SUFFIXES}


def discover(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, length, modificationTime, content) of the files with a processed suffix; hidden and empty files are skipped.

    The content column is read only where a later step asks for it.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    name = F.regexp_extract("path", "[^/]*$", 0)
    return files.filter(extension(name).isin(*SUFFIXES) & ~F.startswith(name, F.lit(".")))


def valid(files: DataFrame) -> DataFrame:
    """Files that are neither empty nor over the limit of 50 MB."""
    return files.filter((F.col("length") > 0) & (F.col("length") <= MAX_BYTES))


def extract(files: DataFrame, readers: dict[str, Reader] | None = None) -> DataFrame:
    """(path, file_type, text, extraction_method, error_message, quality) by the reader of each suffix.

    An error of a reader becomes an error_message on its row and never stops the batch.
    """
    chosen = READERS | (readers or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b.path, b.content):
                suffix = re.search(r"\.[^./]*$", path)
                try:
                    text, method = chosen.get(suffix.group().lower() if suffix else "", read_none)(path, content)
                    rows.append((path, text, method, None))
                except Exception as error:
                    rows.append((path, "", "failed", str(error)))
            yield pd.DataFrame(rows, columns=["path", "text", "extraction_method", "error_message"])

    out = files.select("path", "content").mapInPandas(run, "path string, text string, extraction_method string, error_message string")
    kind = F.replace(extension(F.regexp_extract("path", "[^/]*$", 0)), F.lit("."), F.lit(""))
    recognised = F.col("extraction_method").isin("ocr", "ocr_extraction", "tesseract", "tesseract_ocr")
    grade = F.when(F.col("extraction_method") == "failed", "failed").when(recognised & kind.isin(*[s[1:] for s in IMAGE_SUFFIXES]), image_grade(F.col("text"))).when(recognised, after_recognition(text_grade(F.col("text")))).otherwise(text_grade(F.col("text")))
    return out.withColumn("file_type", kind).withColumn("quality", grade)


def needs_recognition(text: Column, pages: Column) -> Column:
    """Fewer than 100 characters a page: the pages are pictures."""
    return F.length(F.coalesce(text, F.lit(""))) < pages * CHARS_PER_PAGE


def placeholder(name: Column, size: Column) -> Column:
    return F.format_string("Document: %s, Size: %d bytes", name, size)


def one_line_base64(content: Column) -> Column:
    """Base64 without the line breaks that Spark's function puts in."""
    return F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))


def as_base64(files: DataFrame) -> DataFrame:
    return files.select("path", one_line_base64(F.col("content")).alias("image_data"))


def decoded(text: str) -> bytes:
    return base64.b64decode(text)


def listing_statistics(files: DataFrame, root: str) -> DataFrame:
    """(extension, files, bytes, depth) of a listing under a root."""
    below = F.regexp_replace("path", "^.*" + re.escape(root.rstrip("/")) + "/", "")
    name = F.regexp_extract("path", "[^/]*$", 0)
    depth = F.length(below) - F.length(F.replace(below, F.lit("/"), F.lit("")))
    return files.groupBy(extension(name).alias("extension")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.max(depth).cast("bigint").alias("depth"))


def older_than(files: DataFrame, days: int, now: Column | None = None) -> DataFrame:
    """Log files to clean up: last modified more than so many days before now."""
    return files.filter(F.col("modificationTime") < (now if now is not None else F.current_timestamp()) - F.expr(f"INTERVAL {days} DAYS")).select("path")


def write_history(rows: DataFrame, path: str) -> None:
    """Append to a history table; Spark's commit protocol makes the append atomic."""
    rows.write.mode("append").parquet(path)


def append_and_read(parts: list[DataFrame], path: str) -> DataFrame:
    """A history table after several appends."""
    for p in parts:
        write_history(p, path)
    return parts[0].sparkSession.read.schema(parts[0].schema).parquet(path)


def state_written(rows: DataFrame, path: str) -> DataFrame:
    """Rows of learned state written as JSON lines and read back, null fields included."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return rows.sparkSession.read.schema(rows.schema).json(path)


def read_settings(spark: SparkSession, path: str, defaults: dict[str, str]) -> dict[str, str]:
    """A small JSON state file over its defaults; a missing or broken file gives the defaults."""
    try:
        row = spark.read.option("multiLine", "true").option("mode", "FAILFAST").json(path).first()
    except Exception:
        return dict(defaults)
    return defaults | {k: str(v) for k, v in (row.asDict() if row else {}).items() if v is not None}


def write_settings(spark: SparkSession, settings: dict[str, str], path: str, secret: tuple[str, ...] = ("API_KEY", "SECRET", "TOKEN", "PASSWORD")) -> None:
    """Overwrite a JSON state file; keys that name a secret are never written."""
    kept = {k: v for k, v in settings.items() if not any(s in k.upper() for s in secret)}
    spark.createDataFrame([tuple(kept.values())], ", ".join(f"`{k}` string" for k in kept)).coalesce(1).write.mode("overwrite").json(path)


def chosen_attempts(attempts: DataFrame) -> DataFrame:
    """(file_id, content_id, extraction_method): the attempt document_reader() would keep, for attempts made beforehand.

    attempts: (file_id, content_id, extraction_method, quality, chars, pages). One aggregation a file with a comparable key:
    attempts that are taken at once come first, by the order of the readers, then the others by grade.
    """
    order = F.when(F.col("extraction_method") == "pymupdf", 0).when(F.col("extraction_method") == "pypdf", 1).when(F.col("extraction_method") == "ocr", 2).otherwise(3)
    grade = F.coalesce(F.array_position(F.array(*[F.lit(g) for g in GRADES]), F.coalesce("quality", F.lit("failed"))), F.lit(0)).cast("int")
    a = attempts.filter("file_id is not null").withColumns({"o": order, "g": grade}).filter("g > 1")
    thin = (F.col("o") < 2) & (F.coalesce("chars", F.lit(0)) < CHARS_PER_PAGE * F.greatest(F.lit(1), F.coalesce("pages", F.lit(1))))

    def first(at_once: Column) -> Column:
        """The attempt that comes first if those at_once are taken by the order of the readers, the others by grade."""
        key = F.struct(F.when(at_once, 0).otherwise(1), F.when(at_once, F.col("o")).otherwise(-F.col("g")), F.col("content_id"))
        return F.min_by(F.struct("content_id", "extraction_method"), key)

    file = a.groupBy("file_id").agg((F.max(thin) & F.max(F.col("o") == 2)).alias("wait"), first((F.col("o") == 2) | (F.col("g") >= 4)).alias("plain"), first(F.col("o") == 2).alias("waited"))
    best = file.select("file_id", F.when(F.col("wait"), F.col("waited")).otherwise(F.col("plain")).alias("k"))
    return best.select("file_id", "k.content_id", "k.extraction_method")


def free_target(path: str) -> str:
    """The path, or with _1, _2, ... before its suffix where a file is already there."""
    stem, suffix = os.path.splitext(path)
    out, n = path, 0
    while os.path.exists(out):
        n += 1
        out = f"{stem}_{n}{suffix}"
    return out


def run_operation(kind: str, source: str, target: str) -> str:
    """Run one operation on the local disk of the driver; returns where it went. Nothing is ever overwritten."""
    if kind == "create_dir":
        os.makedirs(target, mode=0o755, exist_ok=True)
        return target
    if kind not in ("move", "copy"):
        raise ValueError(f"Invalid operation type: {kind}")
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    out = free_target(target)
    if kind == "copy":
        shutil.copy2(source, out)
    else:
        shutil.move(source, out)
    return out


def run_operations(operations: DataFrame) -> DataFrame:
    """(type, source, target, error) of planned operations after running them one by one, folders first.

    Moving files is a side effect of one machine's disk, so it happens on the driver, row by row from an iterator; planning
    and the tally stay distributed. An operation that fails gives its error and does not stop the others.
    """
    spark, done = operations.sparkSession, []
    for r in operations.select("type", "source", "target").orderBy(F.col("type") != "create_dir", "target", "source").toLocalIterator():
        try:
            done.append((r.type, r.source, run_operation(r.type, r.source, r.target), None))
        except Exception as error:
            done.append((r.type, r.source, r.target, str(error)))
    return spark.createDataFrame(done, "type string, source string, target string, error string")


def write_atomically(path: str, content: str, tries: int = 3) -> None:
    """Write a text file beside its place and put it there in one step; on failure the old file stays."""
    beside = f"{path}.tmp"
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    for left in range(tries - 1, -1, -1):
        try:
            with open(beside, "w", encoding="utf-8") as f:
                f.write(content)
            os.replace(beside, path)
            return
        except OSError:
            if not left:
                if os.path.exists(beside):
                    os.remove(beside)
                raise


def log_lines(messages: DataFrame, moment: Column | None = None) -> DataFrame:
    """(line) of an error log: a time stamp and the message without secrets, to be appended with write_log()."""
    stamp = F.date_format(moment if moment is not None else F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    return messages.filter("message is not null").select(F.concat(F.lit("["), stamp, F.lit("] "), clean_log(F.col("message"))).alias("line"))


def write_log(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("append").text(path)
