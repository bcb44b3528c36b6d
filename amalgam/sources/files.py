"""Files: text of documents, and the sources of a batch of candidate folders."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from amalgam.operators.scratch import scratch_path

#: File name in a candidate's folder -> source type, in the order of sources.
FOLDER_FILES = {"data.csv": "csv", "ats.json": "ats_json", "resume.pdf": "resume_pdf", "resume.docx": "resume_docx", "notes.txt": "recruiter_txt"}
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes | None) -> str:
    """Paragraphs that aren't blank, one a line; the body's own paragraphs only, not tables. Empty if it can't be read."""
    import io
    import zipfile
    from xml.etree import ElementTree

    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body")
        marks = {f"{WORD}t": None, f"{WORD}tab": "\t", f"{WORD}br": "\n", f"{WORD}cr": "\n"}
        found = ["".join((x.text or "") if x.tag == f"{WORD}t" else marks[x.tag] for x in p.iter() if x.tag in marks) for p in body.findall(f"{WORD}p")]
        return "\n".join(p for p in found if p.strip())
    except Exception:  # a damaged file gives no text
        return ""


def pdf_text(content: bytes | None) -> str:
    """Text of all pages, by OCR where a page has hardly any; needs optional libraries, and is empty without them."""
    import io

    try:
        import pdfplumber
    except ImportError:
        return ""
    try:
        pages = []
        with pdfplumber.open(io.BytesIO(content or b"")) as pdf:
            for page in pdf.pages:
                text = page.extract_text(x_tolerance=1, x_tolerance_ratio=None) or ""
                if len(text.strip()) < 10:
                    text = ocr_text(page) or text
                if text:
                    pages.append(text)
        return "\n".join(pages)
    except Exception:  # a damaged file gives no text
        return ""


def ocr_text(page) -> str:
    try:
        import pytesseract

        seen = pytesseract.image_to_string(page.to_image(resolution=300).original) or ""
        return seen if seen.strip() else ""
    except Exception:  # OCR is optional
        return ""


READERS = {"resume_docx": docx_text, "resume_pdf": pdf_text}


def document_text(source_type: Column, content: Column) -> Column:
    """Text of binary documents by their type, in one pass; other types' contents stay where they are, and are null here."""

    def texts(kinds: pd.Series, batch: pd.Series) -> pd.Series:
        return pd.Series([READERS[k](c) if k in READERS and c is not None else None for k, c in zip(kinds, batch, strict=True)], dtype="object")

    return F.pandas_udf(texts, "string")(source_type, F.when(source_type.isin(*READERS), content))


def text_of(source_type: Column, content: Column) -> Column:
    """A file's text: that of documents by their readers, else decoded. Null stays null: the file could not be read."""
    return F.when(source_type.isin(*READERS), document_text(source_type, content)).otherwise(F.decode(content, "UTF-8"))


#: Names that are listed and written at a time.
NAMES = 50_000


def qualified(spark: SparkSession, root: str):
    """The folder as the file system names it, and the file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.makeQualified(path), files


def landed_names(spark: SparkSession, root: str, path: str) -> DataFrame:
    """(run_id) of the folders directly in ``root``, hidden ones left out. The listing is written as it comes, so the driver holds a part of it only."""
    top, files = qualified(spark, root)
    found, names, any_ = files.listStatusIterator(top), [], False
    while True:
        more = found.hasNext()
        if more:
            status = found.next()
            name = status.getPath().getName()
            if status.isDirectory() and not name.startswith((".", "_")):
                names.append((name,))
        if names and (not more or len(names) >= NAMES):
            spark.createDataFrame(names, "run_id string").write.mode("append").parquet(path)
            names, any_ = [], True
        if not more:
            break
    if not any_:
        raise FileNotFoundError(f"no candidate folders in {root}")
    return spark.read.schema("run_id string").parquet(path)


def folder_files(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, src_seq, source_type, content as text) of the known files in the folders directly in ``root``: each file is opened once, in the tasks."""
    top, _ = qualified(spark, root)
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.read.schema(schema).format("binaryFile").option("pathGlobFilter", "{" + ",".join(FOLDER_FILES) + "}").load(f"{root.rstrip('/')}/*/")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    known = F.create_map(*[F.lit(x) for seq, (file, kind) in enumerate(FOLDER_FILES.items()) for x in (file, f"{seq}:{kind}")])
    rows = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("run_id"), F.regexp_replace("path", r"/[^/]+/[^/]+$", "").alias("root"), F.split(known[name], ":").alias("known"), "content")
    rows = rows.filter((F.col("root") == top.toString()) & ~F.col("run_id").rlike(r"^[._]"))
    kind = F.col("known")[1]
    return rows.select("run_id", F.col("known")[0].cast("int").alias("src_seq"), kind.alias("source_type"), text_of(kind, F.col("content")).alias("content"))


def folder_items(spark: SparkSession, root: str, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Sources of the candidate folders directly in ``root`` (run_id, src_seq, source_type, content), and all folders' names.

    Both are landed in ``path`` (scratch where none is given), the sources by their type, so a reader scans its own ones and no file is
    opened twice. Only files of a known name are opened, and none of deeper folders. A resume in PDF excludes the one in DOCX.
    Folders without a known file are listed too, also empty ones.
    """
    path = path or scratch_path(spark, "folders")
    folders = landed_names(spark, root, f"{path}/names")
    either, given = "resume_docx", "resume_docx given"
    rows = folder_files(spark, root)
    rows.withColumn("source_type", F.when(F.col("source_type") == either, given).otherwise(F.col("source_type"))).write.partitionBy("source_type").parquet(f"{path}/items")
    schema = "run_id string, src_seq int, content string, source_type string"
    read = lambda: spark.read.schema(schema).parquet(f"{path}/items")
    documents = read().filter(F.col("source_type") == given)
    if not documents.isEmpty():
        alone = documents.join(read().filter("source_type = 'resume_pdf'").select("run_id"), "run_id", "left_anti")
        alone.withColumn("source_type", F.lit(either)).write.mode("append").partitionBy("source_type").parquet(f"{path}/items")
    return read().filter(F.col("source_type") != given).select("run_id", "src_seq", "source_type", "content"), folders
