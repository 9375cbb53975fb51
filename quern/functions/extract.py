"""Text of files by their extension."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from . import text as T
from .wordlists import RAW_EXTENSIONS

# Extensions with a reader of their own, and image extensions.
HTML, GO, PDF = [".html", ".htm"], [".go"], [".pdf"]
IMAGES = [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".tiff", ".tif"]
# Reserved words of Go.
GO_KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())


class _Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self.hidden:
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.parts.append(data.strip())


def visible_html(source: str) -> str:
    """Each visible text node on a line of its own; scripts, styles and comments left out."""
    p = _Visible()
    p.feed(source)
    p.close()
    return "".join(f"{x}\n" for x in p.parts)


_GO = re.compile(r"//[^\n]*|/\*.*?\*/|`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|[A-Za-z_]\w*", re.S)


def go_text(source: str) -> str:
    """Package name, a line for each comment without its marks, then the identifiers other than ``_`` in the order they stand.

    By lexer, not parser: identifiers of one declaration can come in another order than from a syntax
    tree. A source without a package clause, with brackets that do not match or with a string or comment that does not end is
    returned as it is.
    """
    comments, names, open_, at = [], [], [], 0
    for m in _GO.finditer(source):
        between = source[at : m.start()]
        at = m.end()
        s = m.group()
        for ch in between:
            if ch in "([{":
                open_.append(ch)
            elif ch in ")]}" and (not open_ or open_.pop() + ch not in ("()", "[]", "{}")):
                return source
            elif ch in "`\"'":
                return source
        if "/*" in between:
            return source
        if s.startswith("//"):
            comments.append(s[2:].strip())
        elif s.startswith("/*"):
            comments.append(s[2:-2].strip())
        elif s[0] not in "`\"'":
            names.append(s)
    for ch in source[at:]:
        if ch in "([{":
            open_.append(ch)
        elif ch in ")]}" and (not open_ or open_.pop() + ch not in ("()", "[]", "{}")) or ch in "`\"'":
            return source
    if open_ or len(names) < 2 or names[0] != "package":
        return source
    # the package name stands first and again where the tree has it
    kept = [n for n in names if n not in GO_KEYWORDS and n != "_"]
    return "".join(f"{x}\n" for x in [names[1], *comments]) + "".join(f"{x} " for x in kept)


@pandas_udf(StringType())
def html_text(sources: pd.Series) -> pd.Series:
    return sources.map(lambda s: None if s is None else visible_html(s))


@pandas_udf(StringType())
def go_source_text(sources: pd.Series) -> pd.Series:
    return sources.map(lambda s: None if s is None else go_text(s))


def extension(path) -> Column:
    return F.lower(F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"(\.[^./\\]*)$", 1))


def supported(path) -> Column:
    return extension(path).isin(RAW_EXTENSIONS + HTML + GO + PDF + IMAGES)


def extracted(files: DataFrame) -> DataFrame:
    """``(path, text, error)`` of ``(path, content)``: by extension, unknown ones as they are; PDF has no reader here, images give their path's words."""
    ext, raw = extension("path"), F.decode("content", "UTF-8")
    rows = files.select("path", ext.alias("ext"), raw.alias("raw"))
    # one branch per reader, so that only its own rows pass through Python
    plain = rows.where(~F.col("ext").isin(HTML + GO + PDF + IMAGES)).select("path", F.col("raw").alias("text"), F.lit(None).cast("string").alias("error"))
    html = rows.where(F.col("ext").isin(HTML)).select("path", html_text("raw").alias("text"), F.lit(None).cast("string").alias("error"))
    go = rows.where(F.col("ext").isin(GO)).select("path", go_source_text("raw").alias("text"), F.lit(None).cast("string").alias("error"))
    image = rows.where(F.col("ext").isin(IMAGES)).select("path", T.path_words("path").alias("text"), F.lit(None).cast("string").alias("error"))
    pdf = rows.where(F.col("ext").isin(PDF)).select("path", F.lit(None).cast("string").alias("text"), F.lit("unsupported").alias("error"))
    return plain.unionByName(html).unionByName(go).unionByName(image).unionByName(pdf)
