"""Reading uploaded files: admission, landing layout, DOCX and PDF text."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossiergrid.functions.text import best_text, clean_text, week_of_month

#: What an upload may be.
EXTENSIONS = ("pdf", "docx")
MOST_FILES = 10
MOST_BYTES = 160 * 1024 * 1024


def extension(path: Column) -> Column:
    """The lower-cased extension of a path."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content, file_hash) of the files below ``path`` that an upload may be.

    Any store that Spark reads will do.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    files = reader.load(path)
    return files.where(extension(F.col("path")).isin(*EXTENSIONS) & (F.col("length") <= MOST_BYTES)).withColumn("file_hash", F.sha2("content", 256))


def safe_name(filename: Column) -> Column:
    """A file name of letters, digits, dots, dashes and underscores, with a random part before its extension."""
    base = F.regexp_replace(F.element_at(F.split(filename, r"[/\\]"), -1), r"[^A-Za-z0-9._-]+", "_")
    stem = F.regexp_replace(F.regexp_replace(base, r"\.[^.]*$", ""), r"^[._]+|[._]+$", "")
    return F.concat(F.coalesce(F.nullif(stem, F.lit("")), F.lit("resume")), F.lit("_"), F.substring(F.regexp_replace(F.uuid(), "-", ""), 1, 12), F.lit("."), extension(filename))


def landing_columns(title: Column, job_id: Column, at: Column) -> list[Column]:
    """The partition columns of the landing layout: job, year, month and week of the month."""
    slug = F.regexp_replace(F.lower(F.trim(title)), "[^a-z0-9]+", "-")
    return [
        F.concat(F.btrim(slug, F.lit("-")), F.lit("-"), job_id.cast("string")).alias("job"),
        F.year(at).alias("year"), F.month(at).alias("month"), week_of_month(at).alias("week"),
    ]


def land(rows: DataFrame, path: str, title: str = "title", job_id: str = "job_id", at: str = "uploaded_at") -> None:
    """Append rows in the landing layout."""
    parts = landing_columns(F.col(title), F.col(job_id), F.col(at))
    rows.select("*", *parts).write.mode("append").partitionBy("job", "year", "month", "week").parquet(path)


def inside(path: str, folder: str) -> bool:
    """Whether a path lies in a folder, after resolving what leads out of it."""
    import posixpath

    flat = lambda p: posixpath.normpath(p.split("://", 1)[-1])
    return flat(path) != flat(folder) and flat(path).startswith(flat(folder).rstrip("/") + "/")


def delete_file(spark: SparkSession, path: str, folder: str) -> bool:
    """Delete a landed file, if it lies in the landing folder and is there."""
    if not inside(path, folder):
        return False
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, False))


# DOCX -----------------------------------------------------------------------

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _flat(value: str) -> str:
    return re.sub(r"\s+", " ", value).strip()


def _paragraph(node: ElementTree.Element) -> list[str]:
    """A paragraph's own text, then the text of each box that is drawn in it."""
    boxes = [b for b in node.iter() if b.tag.endswith("}txbxContent")]
    boxed = {id(x) for b in boxes for x in b.iter()}
    own = ""
    for x in node.iter():
        if id(x) in boxed:
            continue
        own += (x.text or "") if x.tag == f"{_W}t" else "\t" if x.tag == f"{_W}tab" else "\n" if x.tag in (f"{_W}br", f"{_W}cr") else ""
    out = [own.strip()] if own.strip() else []
    for b in boxes:
        text = _flat(" ".join(t.text.strip() for t in b.iter(f"{_W}t") if t.text and t.text.strip()))
        if text and text not in out:
            out.append(text)
    return out


def _table(node: ElementTree.Element) -> list[str]:
    """A table's lines; tables of application forms are rewritten as labelled values, education, work or references."""
    rows = []
    for tr in node.findall(f"{_W}tr"):
        cells = []
        for tc in tr.findall(f"{_W}tc"):
            if tc.find(f"{_W}tcPr/{_W}vMerge") is not None and tc.find(f"{_W}tcPr/{_W}vMerge").get(f"{_W}val") != "restart":
                continue
            parts = [p for x in tc.iter(f"{_W}p") for p in _paragraph(x)]
            cells.append("\n".join(dict.fromkeys(parts)))
        if any(cells):
            rows.append(cells)
    if not rows:
        return []
    header = [_flat(c).casefold() for c in rows[0]]
    labels = {_flat(c).casefold() for r in rows for c in r}
    cell = lambda row, i: row[i].strip() if i < len(row) else ""
    if {"full name", "residence"} <= labels and any("email" in x or "cellphone" in x for x in labels):
        return [f"{cell(r, i)}: {cell(r, i + 1)}" for r in rows for i in range(0, len(r) - 1, 2) if cell(r, i) and cell(r, i + 1)]
    if "level" in header and any("school name" in x for x in header):
        out = ["EDUCATION"]
        for r in rows[1:]:
            level, school, course = (cell(r, i) for i in range(3))
            if level and school:
                degree = level if course.casefold() in ("", "n/a", "na") else course
                out += ["Elementary Education" if degree.casefold() == "elementary" else degree, school]
        return out
    if "position" in header and any("company" in x or "organization" in x for x in header):
        out = ["WORK EXPERIENCE"]
        for r in rows[1:]:
            company, position, place, start, end, duties = (cell(r, i) for i in range(6))
            if company or position:
                out.append(" | ".join(x for x in (position or "Position Not Stated", company, place, f"{start} - {end}".strip(" -")) if x))
                out += [f"Duties: {duties}"] if duties else []
        return out
    if "full name" in header and any("relationship" in x for x in header):
        return ["CHARACTER REFERENCES", *(" | ".join(c.strip() for c in r if c.strip()) for r in rows[1:])]
    return ["  ".join(c for c in r if c) for r in rows]


def _story(root: ElementTree.Element) -> list[str]:
    out = []
    for child in root:
        if child.tag == f"{_W}p":
            out += _paragraph(child)
        elif child.tag == f"{_W}tbl":
            out += _table(child)
        elif child.tag == f"{_W}sdt":
            content = child.find(f"{_W}sdtContent")
            out += _story(content) if content is not None else []
    return out


def docx_text(content: bytes) -> str | None:
    """Headers, body in its order, footers; None for what is no DOCX file."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            parts = sorted(n for n in names if re.fullmatch(r"word/header\d*\.xml", n)), sorted(n for n in names if re.fullmatch(r"word/footer\d*\.xml", n))
            tree = lambda n: ElementTree.fromstring(z.read(n))
            lines = [x for n in parts[0] for x in _story(tree(n))]
            body = tree("word/document.xml").find(f"{_W}body")
            lines += _story(body) if body is not None else []
            return "\n".join(lines + [x for n in parts[1] for x in _story(tree(n))])
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None


# PDF ------------------------------------------------------------------------


def words_to_lines(words: list[dict], tolerance: float = 3) -> list[str]:
    """Lines of positioned words (text, x0, x1, top); a wide gap becomes two spaces."""
    rows: list[tuple[float, list[dict]]] = []
    for word in sorted(words, key=lambda w: (w["top"], w["x0"])):
        near = [r for r in rows[-3:] if abs(r[0] - word["top"]) <= tolerance]
        if near:
            near[-1][1].append(word)
        else:
            rows.append((word["top"], [word]))
    lines = []
    for _, row in sorted(rows, key=lambda r: r[0]):
        row.sort(key=lambda w: w["x0"])
        line = row[0]["text"] + "".join(("  " if b["x0"] - a["x1"] >= 12 else " ") + b["text"] for a, b in zip(row, row[1:], strict=False))
        if line.strip():
            lines.append(line.strip())
    return lines


def column_gutter(words: list[dict], width: float) -> tuple[float, float] | None:
    """The widest vertical band that at most one word crosses, with enough words on both sides; None on usual pages."""
    if len(words) < 35 or width <= 0:
        return None
    bands, start, x = [], None, width * 0.22
    while True:
        free = x < width * 0.68 and sum(w["x0"] < x + 2 and w["x1"] > x for w in words) <= 1
        if free and start is None:
            start = x
        if not free and start is not None:
            edge = min(x, width * 0.68)
            bands += [(start, edge)] if edge - start >= 16 else []
            start = None
        if x >= width * 0.68:
            break
        x += 2
    for left, right in sorted(bands, key=lambda b: b[0] - b[1]):
        n, m = sum(w["x1"] <= left for w in words), sum(w["x0"] >= right for w in words)
        if n >= 12 and m >= 20 and min(n, m) / len(words) >= 0.12:
            return left, right
    return None


def page_text(words: list[dict], width: float) -> str:
    """A page's text, column by column where it has two; the column that begins higher comes first."""
    gutter = column_gutter(words, width)
    if gutter is None:
        return "\n".join(words_to_lines(words))
    middle = sum(gutter) / 2
    sides = [[w for w in words if ((w["x0"] + w["x1"]) / 2 < middle) == left] for left in (True, False)]
    return "\n".join(line for side in sorted(filter(None, sides), key=lambda s: min(w["top"] for w in s)) for line in words_to_lines(side))


def pdf_texts(content: bytes) -> list[tuple[str, str]]:
    """(method, text) by every PDF library that is installed; none here without one."""
    out = []
    try:
        import pdfplumber

        with pdfplumber.open(io.BytesIO(content)) as pdf:
            pages = []
            for page in pdf.pages:
                text = page_text(page.extract_words(x_tolerance=1, y_tolerance=3), page.width)
                if len(_flat(text)) < 200:
                    rows = ["  ".join(c.strip() for c in r if c and c.strip()) for t in page.extract_tables() for r in t]
                    text = "\n".join([text, *(r for r in rows if r and _flat(r).lower() not in _flat(text).lower())])
                pages.append(text)
        out.append(("pdfplumber", "\n".join(p for p in pages if p.strip())))
    except ImportError:
        pass
    try:
        import PyPDF2

        out.append(("PyPDF2", "\n".join(p.extract_text() or "" for p in PyPDF2.PdfReader(io.BytesIO(content)).pages)))
    except ImportError:
        pass
    return out


def extract_texts(files: DataFrame) -> DataFrame:
    """(path, file_hash, method, text, error): the cleaned text of every file; the better of a PDF's parses.

    A file that can't be read has a null text and says why; the others go on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                error, found = None, []
                try:
                    if path.lower().endswith(".docx"):
                        text = docx_text(content)
                        found = [("docx", text)] if text is not None else []
                    elif path.lower().endswith(".pdf"):
                        found = pdf_texts(content)
                except Exception as e:  # a broken file must not stop the batch
                    error = f"{type(e).__name__}: {e}"[:300]
                out.append(([{"method": m, "text": t} for m, t in found], error if found or error else "no reader for this file"))
            yield batch[["path", "file_hash"]].assign(candidates=[c for c, _ in out], error=[e for _, e in out])

    schema = "path string, file_hash string, candidates array<struct<method:string,text:string>>, error string"
    best = files.select("path", "file_hash", "content").mapInPandas(run, schema).withColumn("best", best_text(F.col("candidates")))
    return best.select("path", "file_hash", "best.method", clean_text(F.col("best.text")).alias("text"), "error")
