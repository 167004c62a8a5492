"""CV files as text: txt, md and tex by Spark's reader, docx by its XML, pdf by an optional library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tex_text(c: Column) -> Column:
    """TeX without comments and preamble; macros give way to their arguments."""
    c = F.regexp_replace(F.regexp_replace(c, r"(?<!\\)%[^\n]*", ""), r"(?s)^.*?\\begin\{document\}", "")
    c = F.regexp_replace(c, r"\\(begin|end)\{[^}]*\}|\\item", "\n")
    for _ in range(3):
        c = F.regexp_replace(c, r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", "$1 ")
    return F.regexp_replace(F.regexp_replace(c, r"\\[a-zA-Z]+\*?|[{}$~]", " "), r"\\([&%_#])", "$1")


@F.pandas_udf(T.StringType())
def _document_text(names: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    def docx(raw: bytes) -> str:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            xml = z.read("word/document.xml").decode("utf-8", "replace")
        return re.sub(r"<[^>]+>", "", re.sub(r"</w:p>|<w:br[^>]*/>", "\n", xml))

    def pdf(raw: bytes) -> str | None:
        try:
            from pypdf import PdfReader
        except ImportError:
            return None
        return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(raw)).pages)

    for paths, raws in names:
        yield pd.Series([docx(r) if p.lower().endswith(".docx") else pdf(r) for p, r in zip(paths, raws, strict=True)], dtype=object)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """path, text of every CV below ``folder``; text is null where a kind can't be read here."""
    plain = spark.read.option("pathGlobFilter", "*.{txt,md,tex}").option("recursiveFileLookup", "true").text(folder, wholetext=True).select(F.input_file_name().alias("path"), "value")
    text = plain.select("path", F.when(F.lower("path").endswith(".tex"), tex_text(F.col("value"))).otherwise(F.col("value")).alias("text"))
    other = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,docx}").option("recursiveFileLookup", "true").load(folder)
    return text.unionByName(other.select("path", _document_text("path", "content").alias("text")))


def profile(path: str) -> dict:
    """A profile from YAML, with the defaults that later steps read."""
    import yaml

    with open(path, encoding="utf-8") as file:
        given = yaml.safe_load(file) or {}
    defaults = {"permits": [], "max_seniority": "senior", "max_years": 0, "forbidden": [], "needs_sponsor": False, "languages": ["english"], "practitioner": False, "show_off_domain": False, "families": [], "strong": {}, "weak": {}, "sector_bonus": [], "remote_bonus": 0.0}
    return defaults | given
