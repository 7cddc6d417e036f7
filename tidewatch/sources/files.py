"""Readers of captured files: JSON answers, spreadsheets, the text of PDF files, replayed captures."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text

NOTICES = """struct<status:int, avisos:array<struct<aviso:struct<codigoAviso:string, designacaoPT:string>,
  estrutura:array<struct<programaOperacionalDesignacao:string, fundoDesignacao:string, tipologiaOperacaoDesignacao:string, marca:string, dotacao:double>>,
  calendario:struct<dataPublicacao:string, dataInicio:string, dataFim:string, dataFimAtual:string>,
  documentos:array<struct<tipoDocumentoDesignacao:string, documentoDesignacao:string, path:string, container:string>>>>>"""
HEADER_MARK = "designacao do aviso"


def notices(answers: DataFrame, body: str = "body") -> DataFrame:
    """Open notices of JSON answers; rows without code or title are dropped, invalid answers give none."""
    day = lambda c: F.to_date(F.nullif(F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("")))
    rows = answers.select(F.explode(F.from_json(body, NOTICES)["avisos"]).alias("a"))
    code, title = text.blank_to_null(text.squeeze(F.col("a.aviso.codigoAviso"))), text.blank_to_null(text.squeeze(F.col("a.aviso.designacaoPT")))
    budget = F.aggregate(F.coalesce("a.estrutura", F.array().cast("array<struct<programaOperacionalDesignacao:string,fundoDesignacao:string,tipologiaOperacaoDesignacao:string,marca:string,dotacao:double>>")), F.lit(0.0), lambda acc, e: acc + F.coalesce(e["dotacao"], F.lit(0.0)))
    docs = F.filter("a.documentos", lambda x: (x["tipoDocumentoDesignacao"] == "Aviso") & F.lower(x["path"]).endswith(".pdf"))
    return rows.select(
        code.alias("codigo"), title.alias("titulo"), F.nullif(F.round(budget, 2), F.lit(0.0)).alias("dotacao"), F.array_distinct(F.filter(F.transform("a.estrutura", lambda e: e["marca"]), lambda m: m.isNotNull())).alias("marcas"),
        day("a.calendario.dataInicio").alias("abre"), F.coalesce(day("a.calendario.dataFimAtual"), day("a.calendario.dataFim")).alias("fecha"), F.when(F.size(docs) == 1, F.element_at(docs, -1)["path"]).alias("documento"),
    ).where("codigo is not null and titulo is not null")


def _cells(data: bytes) -> list[list[str]]:
    """The first sheet as a grid of strings; shared strings resolved, gaps empty."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        sheet = sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))[0]
        grid = []
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{{{ns['m']}}}row"):
            line: list[str] = []
            for c in row.findall("m:c", ns):
                column = 0
                for letter in re.match(r"[A-Z]*", c.get("r", "")).group():
                    column = column * 26 + ord(letter) - 64
                value = c.findtext("m:v", None, ns)
                if c.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t"))
                elif c.get("t") == "s" and value is not None:
                    value = shared[int(value)]
                line += [""] * (max(0, column - 1) - len(line)) + [value or ""]
            grid.append(line)
    return grid


def sheet_lines(data: bytes | None) -> Iterator[tuple[int, dict[str, str]]]:
    """(line, values by column name) of a spreadsheet; the header is the first row that names the notice's title. A workbook is held whole."""
    header = None
    for n, line in enumerate(_cells(data) if data else []):
        names = [" ".join(x.split()) for x in line]
        if header is None:
            plain = [x.lower().replace("ç", "c").replace("ã", "a") for x in names]
            header = names if HEADER_MARK in plain else None
        elif any(x.strip() for x in line):
            yield n, {k: x.strip() for k, x in zip(header, line, strict=False) if k}


def sheet_rows(files: DataFrame, content: str = "content") -> DataFrame:
    """(linha, valores: map<string,string>) of spreadsheets, as ``sheet_lines`` gives them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, maps = [], []
            for data in batch.column(0).to_pylist():
                for n, values in sheet_lines(data):
                    numbers.append(n)
                    maps.append(list(values.items()))
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(maps, pa.map_(pa.string(), pa.string()))], ["linha", "valores"])

    return files.select(content).mapInArrow(read, "linha int, valores map<string,string>")


_STREAM = re.compile(rb"stream\r?\n(.*?)endstream", re.S)
_SHOW = re.compile(rb"\[((?:[^\[\]\\()]|\\.|\((?:[^()\\]|\\.)*\))*)\]\s*TJ|\(((?:[^()\\]|\\.)*)\)\s*(?:Tj|'|\")|(T\*|\bTd\b|\bTD\b|\bET\b)", re.S)
_PART = re.compile(rb"\(((?:[^()\\]|\\.)*)\)|(-?\d+(?:\.\d+)?)", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r?\n|.)", re.S)


def _literal(b: bytes) -> str:
    named = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
    value = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() and m[1][0] < 56 else b"" if m[1].strip(b"\r\n") == b"" else named.get(m[1], m[1])
    return _ESCAPE.sub(value, b).decode("cp1252", "replace")


def text_layer(data: bytes | None) -> str | None:
    """The text layer: strings that are shown, in order; a kerning gap under -120 is a space, a new line a break."""
    if not data or not data.startswith(b"%PDF-"):
        return None
    out: list[str] = []
    for m in _STREAM.finditer(data):
        try:
            body = zlib.decompressobj().decompress(m[1].lstrip(b"\r\n"))
        except zlib.error:
            body = m[1]
        for s in _SHOW.finditer(body):
            if s[3]:
                out.append("\n")
            elif s[2] is not None:
                out.append(_literal(s[2]))
            elif s[1] is not None:
                for part in _PART.finditer(s[1]):
                    out.append(_literal(part[1]) if part[1] is not None else " " if float(part[2]) < -120 else "")
    return "\n".join(line for line in (" ".join(x.split()) for x in "".join(out).split("\n")) if line)


def changed_at(data: bytes | None) -> str | None:
    for key in (rb"/ModDate", rb"/CreationDate"):
        if data and (m := re.search(key + rb"\s*\(D:(\d{4})(\d{2})(\d{2})(\d{2})?(\d{2})?(\d{2})?", data)):
            y, mo, d, h, mi, s = ((x or b"00").decode() for x in m.groups())
            return f"{y}-{mo}-{d}T{h}:{mi}:{s}"
    return None


def pdf_text(content: Column) -> Column:
    return _pandas(text_layer)(content)


def pdf_date(content: Column) -> Column:
    """When a file was last changed, else made; the offset is dropped."""
    return _pandas(changed_at)(content)


def _pandas(f):
    def column(s: pd.Series) -> pd.Series:
        return s.map(f)

    return F.pandas_udf(column, "string")


def is_pdf(content: Column) -> Column:
    return F.coalesce(F.substring(content, 1, 5) == F.lit(b"%PDF-"), F.lit(False))


def replay(manifest: DataFrame, bodies: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Captures of a manifest (url, ficheiro, etag) with their bodies by file name; a missing file is an error, never empty.

    With ``seen`` (url, etag: what the last read got) each has a status: 304 without a body where the etag is the same, else 200.
    """
    if seen is not None:
        last = seen.where("etag is not null").groupBy("url").agg(F.max("etag").alias("_visto"))
        same = manifest.join(last, "url", "left").withColumn("estado", F.when(F.col("etag") == F.col("_visto"), 304).otherwise(200)).drop("_visto")
        old = same.where("estado = 304").withColumn("content", F.lit(None).cast("binary"))
        return replay(same.where("estado = 200"), bodies).unionByName(old)
    named = bodies.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("ficheiro"), "content")
    rows = manifest.join(named, "ficheiro", "left")
    return rows.withColumn("content", F.when(F.col("content").isNull(), F.raise_error(F.concat(F.lit("no capture for "), "url")).cast("binary")).otherwise(F.col("content")))
