"""EPUB packages: written per book on the executors, scanned back as rows."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html import parse


def build(title: str, chapters: list[tuple[int, str, str]]) -> bytes:
    """(number, title, body html) as chap_%04d.xhtml with contents and spine."""
    esc = lambda x: x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", '<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        items = "".join(f'<item id="c{n}" href="chap_{n:04d}.xhtml" media-type="application/xhtml+xml"/>' for n, _, _ in chapters)
        spine = "".join(f'<itemref idref="c{n}"/>' for n, _, _ in chapters)
        z.writestr("content.opf", f'<package version="3.0" xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{esc(title)}</dc:title></metadata><manifest>{items}<item id="nav" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/></manifest><spine>{spine}</spine></package>')
        z.writestr("nav.xhtml", "<html><body><nav><ol>" + "".join(f'<li><a href="chap_{n:04d}.xhtml">{esc(t)}</a></li>' for n, t, _ in chapters) + "</ol></nav></body></html>")
        for n, t, body in chapters:
            z.writestr(f"chap_{n:04d}.xhtml", f"<html><body><h1>{esc(t)}</h1>{body}</body></html>")
    return out.getvalue()


def scan(files: DataFrame) -> DataFrame:
    """Rows (path, name, title, text) of chapter files, from a binaryFile table (path, content)."""

    def run(batches):
        for b in batches:
            rows = {"path": [], "name": [], "title": [], "text": []}
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(z.namelist()):
                        if name.rpartition("/")[2].startswith("chap_"):
                            doc = parse(z.read(name).decode())
                            head = doc.first("h1") or doc.first("title")
                            rows["path"].append(path), rows["name"].append(name), rows["title"].append(head.text if head else name), rows["text"].append(doc.spaced)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.string()) for k, v in rows.items()})

    return files.select(F.col("path"), F.col("content")).mapInArrow(run, "path string, name string, title string, text string")


def books(chapters: DataFrame, key: str = "item_id") -> DataFrame:
    """(path, content) of one book per key, from chapters (key, n, title, body)."""

    def one(pdf):
        import pandas as pd

        pdf = pdf.sort_values("n")
        rows = [(int(n), t or "", "<p>" + (b or "").replace("&", "&amp;").replace("<", "&lt;") + "</p>") for n, t, b in zip(pdf["n"], pdf["title"], pdf["body"], strict=True)]
        return pd.DataFrame({"path": [f"book-{pdf[key].iloc[0]}.epub"], "content": [build(f"Book {pdf[key].iloc[0]}", rows)]})

    return chapters.groupBy(key).applyInPandas(one, "path string, content binary")
