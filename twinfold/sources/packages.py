"""Members and text runs of zipped office packages (one file per row)."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.functions import text as tx
from twinfold.operators.predicates import layout_role

# ---- fixed values ----------------------------------------------------------
ENTRY_LIMIT = 512
OCR_EXTENSIONS = ("png", "jpg", "jpeg", "bmp", "gif", "tif", "tiff")
_TEXT_PART = {
    "docx": r"(?i)^word/(?:.*(?:document|header|footer|footnote|endnote).*|(?:charts|diagrams|drawings)/.*)\.xml$",
    "pptx": r"(?i)^ppt/.*(?:slide|notes).*\.xml$",
    "xlsx": r"(?i)^xl/(?:sharedStrings\.xml|worksheets/.*\.xml)$",
    "odt": r"(?i)^(?:content|styles)\.xml$",
    "ods": r"(?i)^(?:content|styles)\.xml$",
    "odp": r"(?i)^(?:content|styles)\.xml$",
}
_CONTAINERS = {"docx": {"p"}, "pptx": {"p"}, "xlsx": {"si", "is"}}


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(
        F.col("path").alias("doc_id"), F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)).alias("ext"), "content"
    )


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc, content in zip(batch["doc_id"], batch["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                rows += [(doc, i.filename, i.file_size, z.read(i)) for i in sorted(z.infolist(), key=lambda i: i.filename)]
        yield pd.DataFrame(rows, columns=["doc_id", "part", "bytes", "content"])


def package_members(files: DataFrame) -> DataFrame:
    """``(doc_id, part, bytes, content)`` of every package member, sorted by name."""
    return files.select("doc_id", "content").mapInPandas(
        _members, "doc_id string, part string, bytes bigint, content binary"
    )


def package_inventory(members: DataFrame) -> DataFrame:
    """Members with hash, kind and whether the package as a whole is acceptable."""
    lower = F.lower("part")
    ext = F.regexp_extract(lower, r"\.([a-z0-9]+)$", 1)
    kind = (
        F.when(lower.startswith("word/media/"), "media")
        .when(lower.startswith("word/embeddings/"), "object")
        .when(lower.startswith("word/") & lower.endswith(".xml"), "xml")
        .otherwise("other")
    )
    unsafe = F.col("part").rlike(r"(^|/)\.\.(/|$)|^/|\\|:")
    described = members.select(
        "doc_id",
        "part",
        "bytes",
        F.sha2("content", 256).alias("sha256"),
        kind.alias("kind"),
        ext.isin(*OCR_EXTENSIONS).alias("readable_image"),
        unsafe.alias("unsafe"),
    )
    names = described.groupBy("doc_id", F.lower("part").alias("name")).agg(
        F.count("*").alias("n"), F.bool_or("unsafe").alias("unsafe")
    )
    verdict = names.groupBy("doc_id").agg(
        ((F.sum("n") <= ENTRY_LIMIT) & ~F.bool_or(F.col("n") > 1) & ~F.bool_or("unsafe")).alias("accepted")
    )
    return described.join(verdict, "doc_id")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _runs(element: ET.Element, docx: bool) -> str:
    """Visible text of one container; field codes do not count."""
    if not docx:
        return "".join(element.itertext())
    out, depth, skip = [], 0, set()
    for node in element.iter():
        name = _local(node.tag)
        if node is not element and name == "p":
            skip.update(id(x) for x in node.iter())
        if name == "fldSimple":
            skip.update(id(x) for x in node.iter())
        if id(node) in skip:
            continue
        if name == "fldChar":
            kind = next((v for k, v in node.attrib.items() if _local(k) == "fldCharType"), "")
            depth = depth + 1 if kind == "begin" else max(0, depth - 1) if kind == "end" else depth
        elif name == "t" and depth == 0 and node.text:
            out.append(node.text)
    return "".join(out)


def _paragraphs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["doc_id", "ext", "part", "ord", "para_id", "text", "in_table", "in_text_box", "has_column_break"]
    for batch in batches:
        rows = []
        for doc, ext, part, content in zip(batch["doc_id"], batch["ext"], batch["part"], batch["content"]):
            wanted = _CONTAINERS.get(ext, {"p", "h"})
            stack = [(ET.fromstring(content), ())]
            ordered = 0
            while stack:
                node, above = stack.pop()
                name = _local(node.tag)
                if name in wanted:
                    names = {_local(x.tag) for x in node.iter()}
                    brk = "br" in names and any(
                        _local(x.tag) == "br" and any(_local(k) == "type" and v == "column" for k, v in x.attrib.items())
                        for x in node.iter()
                    )
                    para = next((v for k, v in node.attrib.items() if _local(k) == "paraId"), "")
                    rows.append(
                        (doc, ext, part, ordered, para, _runs(node, ext == "docx"), "tc" in above, "txbxContent" in above, brk)
                    )
                    ordered += 1
                stack.extend((child, (*above, name)) for child in reversed(list(node)))
        yield pd.DataFrame(rows, columns=columns)


def read_units_ooxml(files: DataFrame) -> DataFrame:
    """Translation units of package text parts with role, budget and stable id."""
    members = package_members(files).join(files.select("doc_id", "ext"), "doc_id")
    wanted = F.lit(False)
    for ext, pattern in _TEXT_PART.items():
        wanted = wanted | ((F.col("ext") == ext) & F.col("part").rlike(pattern))
    paragraphs = members.where(wanted).select("doc_id", "ext", "part", "content").mapInPandas(
        _paragraphs,
        "doc_id string, ext string, part string, ord int, para_id string, text string, "
        "in_table boolean, in_text_box boolean, has_column_break boolean",
    )
    kept = paragraphs.withColumn("text", tx.strip_space(F.col("text"))).where(tx.has_letter(F.col("text")))
    roles = layout_role(kept)
    para = F.when(F.col("para_id") != "", F.col("para_id")).otherwise(F.format_string("%08d", F.col("ord")))
    context = F.concat_ws(":", "part", F.lit("p"), para, "role")
    hashed = F.concat(F.lit("docx_"), F.substring(tx.sha256_hex(F.concat(context, F.lit("|"), F.col("text"))), 1, 20))
    return roles.withColumn("context", context).withColumn(
        "unit_id", F.when(F.col("ext") == "docx", hashed).otherwise(F.format_string("pkg_%08d", F.col("ord")))
    )
