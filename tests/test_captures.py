"""The source and sink of captures: what is written, refused, killed, pushed down, and each kind read."""

import io
import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from tidewatch.sources import captures, files


@pytest.fixture(scope="module")
def session(spark):
    return captures.registered(spark)


def save(spark, path, *rows, **options):
    df = spark.createDataFrame([(u, f, s, None, bytearray(c) if c is not None else None) for u, f, s, c in rows], captures.SCHEMA).repartition(2)
    df.write.format("notices").option("path", path).options(**options).mode("append").save()


def load(spark, path, kind):
    return spark.read.format("notices").option("path", path).option("kind", kind).load()


ANSWER = {"avisos": [
    {"aviso": {"codigoAviso": " A-1 ", "designacaoPT": "Um  título"}, "estrutura": [{"dotacao": 1.5, "marca": "N"}, {"dotacao": 2.25, "marca": "C"}, {"marca": "N"}], "calendario": {"dataInicio": "2026-01-02T00:00", "dataFim": "2026-02-03", "dataFimAtual": None},
     "documentos": [{"tipoDocumentoDesignacao": "Aviso", "path": "x/A.PDF"}, {"tipoDocumentoDesignacao": "Anexo", "path": "x/B.pdf"}]},
    {"aviso": {"codigoAviso": "A-2", "designacaoPT": " "}}, {"aviso": None}, {"aviso": {"codigoAviso": "A-3", "designacaoPT": "t"}, "estrutura": [{"dotacao": 0}], "calendario": {"dataFim": "em breve"}},
]}


def workbook():
    out = io.BytesIO()
    cell = lambda r, c, s: f'<c r="{c}{r}" t="inlineStr"><is><t>{s}</t></is></c>'
    lines = [["x", ""], ["ID", "Designação do Aviso"], ["1", "Plano A"], ["", ""], ["2", "Plano B"]]
    sheet = "".join(f'<row r="{i}">{"".join(cell(i, "AB"[j], s) for j, s in enumerate(line) if s)}</row>' for i, line in enumerate(lines, 1))
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{sheet}</sheetData></worksheet>')
    return out.getvalue()


def test_kinds(session, tmp_path):
    path = f"file://{tmp_path}/c"
    pdf = b"%PDF-1.4\n<< /ModDate (D:20260102030405) >>\nstream\n" + zlib.compress(b"BT (Ola) Tj ET") + b"\nendstream"
    body = json.dumps(ANSWER).encode()
    save(session, path, ("u1", "a.json", 200, body), ("u2", "b.json", 200, b"no json"), ("u3", "p.html", 200, b'<a href="/x">Um <b>aviso</b></a><a href="y">z</a>'), ("u4", "s.xlsx", 200, workbook()), ("u5", "d.pdf", 200, pdf), ("u6", "e.pdf", 200, b"<html>"))
    got = [tuple(r) for r in load(session, path, "json").orderBy("codigo").collect()]
    same = files.notices(session.createDataFrame([(body.decode(),)], "body string")).orderBy("codigo").collect()
    assert got == [("a.json", *tuple(r)) for r in same] and [r[1] for r in got] == ["A-1", "A-3"] and got[0][3:5] == (3.75, ["N", "C"])
    assert [tuple(r) for r in load(session, path, "html").collect()] == [("p.html", 0, "/x", "Um aviso"), ("p.html", 1, "y", "z")]
    assert [tuple(r) for r in load(session, path, "xlsx").collect()] == [("s.xlsx", 2, {"ID": "1", "Designação do Aviso": "Plano A"}), ("s.xlsx", 4, {"ID": "2", "Designação do Aviso": "Plano B"})]
    assert [tuple(r) for r in load(session, path, "pdf").collect()] == [("d.pdf", "Ola", "2026-01-02T03:04:05")]
    assert load(session, f"file://{tmp_path}/none", "json").count() == 0


def test_refusals_and_killed_captures(session, tmp_path):
    path = f"file://{tmp_path}/c"
    save(session, path, ("u1", "a.html", 200, b'<a href="1">x</a>'), ("u2", "b.html", 404, b'<a href="2">x</a>'), ("u3", "c.html", 200, b"x" * 100), ("u4", "d.html", 200, None), cap="50")
    assert [r.ficheiro for r in load(session, path, "html").collect()] == ["a.html"]
    assert sorted((r.url, r.ficheiro, r.status) for r in captures.manifest(session, path).collect()) == [("u1", "a.html", 200), ("u2", None, 404), ("u3", None, 200), ("u4", None, 200)]
    rows = session.createDataFrame([("u9", "z.html", 200, None, bytearray(b"x")), ("u9", "y.html", 200, None, bytearray(b"x"))], captures.SCHEMA)
    with pytest.raises(Exception, match="killed"):
        rows.withColumn("etag", F.when(F.col("ficheiro") == "y.html", F.raise_error(F.lit("killed"))).otherwise("e")).write.format("notices").option("path", path).mode("append").save()
    assert [r.ficheiro for r in load(session, path, "html").collect()] == ["a.html"] and sorted(p.name[0] == "_" for p in (tmp_path / "c").iterdir()) == [False]


def test_filters_are_pushed_down(session, tmp_path):
    path = f"file://{tmp_path}/c"
    save(session, path, *[(f"u{i}", f"{'ab'[i % 2]}{i}.html", 200, b'<a href="1">x</a>') for i in range(6)])
    some = load(session, path, "html").where(F.col("ficheiro").startswith("a") & (F.col("ficheiro") != "a2.html") & (F.col("posicao") == 0))
    assert sorted(r.ficheiro for r in some.collect()) == ["a0.html", "a4.html"]
    for f in (tmp_path / "c").rglob("b*.html"):  # what isn't wanted isn't opened
        f.chmod(0) or f.unlink() or f.mkdir()
    assert sorted(r.ficheiro for r in load(session, path, "html").where("ficheiro in ('a0.html', 'a4.html', 'none')").collect()) == ["a0.html", "a4.html"]
    reader = captures.CaptureReader(path, "html", None)
    rest = list(reader.pushFilters([captures.EqualTo(("ficheiro",), "a2.html"), captures.EqualTo(("posicao",), 0)]))
    assert [f.attribute for f in rest] == [("posicao",)] and [p.rsplit("/", 1)[-1] for x in reader.partitions() for p in x.names] == ["a2.html"]
