"""Captured files as a source and a sink of Spark: ``spark.read.format("notices")`` and ``df.write.format("notices")``.

A capture is a folder below ``path`` that appears whole: tasks write their files and their part of the manifest into a folder
whose name begins with an underscore, which the commit renames, so a capture that fails or is killed is never seen. Answers
other than 200 and bodies above ``cap`` bytes are refused and counted in the manifest, never written.

Reading deals files out by size, so many small ones share a task and each is read once; a condition on ``ficheiro`` (equal,
among, begins with) is pushed down and spares the files it refuses. ``kind`` says what files hold; those of other endings are
left alone. Answers that aren't JSON and files that aren't PDF give no rows; of two rows with one file name one stays. A file
is read whole by its task.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

from . import files, pages

#: Of each kind, the ending of its files and the columns they give.
KINDS = {
    "json": (".json", "ficheiro string, codigo string, titulo string, dotacao double, marcas array<string>, abre date, fecha date, documento string"),
    "html": (".html", "ficheiro string, posicao int, href string, texto string"),
    "xlsx": (".xlsx", "ficheiro string, linha int, valores map<string,string>"),
    "pdf": (".pdf", "ficheiro string, texto string, modificado string"),
}
SCHEMA = "url string, ficheiro string, status int, etag string, content binary"
CAP = 20 << 20
#: Bytes of files that a task reads, if no file has more.
TASK_BYTES = 32 << 20


def _squeezed(x) -> str | None:
    return " ".join(x.split()) or None if isinstance(x, str) else None


def _day(x) -> date | None:
    try:
        return date.fromisoformat(x[:10]) if isinstance(x, str) else None
    except ValueError:
        return None


def _notices(data: bytes) -> Iterator[tuple]:
    """The notices of a JSON answer, by the rules of ``files.notices``."""
    try:
        found = json.loads(data)
    except ValueError:
        return
    for a in (found.get("avisos") if isinstance(found, dict) else None) or []:
        code, title = (_squeezed((a.get("aviso") or {}).get(k)) for k in ("codigoAviso", "designacaoPT"))
        if code is None or title is None:
            continue
        parts, dates = a.get("estrutura") or [], a.get("calendario") or {}
        budget = round(sum(p.get("dotacao") or 0.0 for p in parts), 2)
        papers = [d["path"] for d in a.get("documentos") or [] if d.get("tipoDocumentoDesignacao") == "Aviso" and (d.get("path") or "").lower().endswith(".pdf")]
        marks = list(dict.fromkeys(p["marca"] for p in parts if p.get("marca") is not None))
        yield code, title, budget or None, marks if "estrutura" in a else None, _day(dates.get("dataInicio")), _day(dates.get("dataFimAtual")) or _day(dates.get("dataFim")), papers[0] if len(papers) == 1 else None


def _rows(kind: str, data: bytes) -> Iterator[tuple]:
    if kind == "json":
        yield from _notices(data)
    elif kind == "html":
        yield from ((i, *x) for i, x in enumerate(pages.page_links(data.decode("utf-8", "replace"))))
    elif kind == "xlsx":
        yield from files.sheet_lines(data)
    elif (text := files.text_layer(data)) is not None:
        yield text, files.changed_at(data)


@dataclass
class Files(InputPartition):
    names: list[str]


class CaptureReader(DataSourceReader):
    def __init__(self, path: str, kind: str, schema: pa.Schema) -> None:
        self.path, self.kind, self.schema, self.tests = path, kind, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            test = None
            if getattr(f, "attribute", None) == ("ficheiro",):
                if isinstance(f, EqualTo):
                    test = lambda name, v=f.value: name == v
                elif isinstance(f, In):
                    test = lambda name, v=set(f.value): name in v
                elif isinstance(f, StringStartsWith):
                    test = lambda name, v=f.value: name.startswith(v)
            if test is None:
                yield f
            else:
                self.tests.append(test)

    def partitions(self) -> list[Files]:
        system, root = fs.FileSystem.from_uri(self.path)
        found = []
        for f in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            inside = f.path.removeprefix(root).strip("/").split("/")
            if f.is_file and inside[-1].lower().endswith(KINDS[self.kind][0]) and not any(x.startswith(("_", ".")) for x in inside) and all(t(inside[-1]) for t in self.tests):
                found.append((f.path, f.size or 0))
        out, size = [], 0
        for path, n in sorted(found):
            if not out or size + n > TASK_BYTES:
                out, size = [*out, []], 0
            out[-1].append(path)
            size += n
        return [Files(x) for x in out] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path)
        for path in partition.names:
            with system.open_input_file(path) as file:
                name, rows = path.rsplit("/", 1)[-1], list(_rows(self.kind, file.read()))
            columns = list(zip(*[(name, *r) for r in rows], strict=True)) if rows else [[]] * len(self.schema)
            columns = [[list(x.items()) if isinstance(x, dict) else x for x in c] for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)


@dataclass
class Wrote(WriterCommitMessage):
    part: str


class CaptureWriter(DataSourceWriter):
    def __init__(self, path: str, cap: int) -> None:
        self.path, self.cap, self.name = path, cap, uuid.uuid4().hex

    @property
    def staged(self) -> str:
        return f"{self.path}/_{self.name}"

    def write(self, iterator) -> WriterCommitMessage:
        system, root = fs.FileSystem.from_uri(self.staged)
        system.create_dir(root, recursive=True)
        manifest, part = io.StringIO(), uuid.uuid4().hex
        for r in iterator:
            refused = r["status"] != 200 or r["content"] is None or len(r["content"]) > self.cap
            if not refused:
                with system.open_output_stream(f"{root}/_{part}", compression=None) as out:
                    out.write(bytes(r["content"]))
                system.move(f"{root}/_{part}", f"{root}/{r['ficheiro']}")  # a repeated task puts the same in its place
            manifest.write(json.dumps({"url": r["url"], "ficheiro": None if refused else r["ficheiro"], "status": r["status"], "etag": r["etag"]}) + "\n")
        if manifest.tell():
            with system.open_output_stream(f"{root}/manifest-{part}.jsonl", compression=None) as out:
                out.write(manifest.getvalue().encode())
        return Wrote(part)

    def commit(self, messages) -> None:
        system, root = fs.FileSystem.from_uri(self.staged)
        if system.get_file_info(root).type != fs.FileType.NotFound:
            counted = {f"manifest-{m.part}.jsonl" for m in messages}
            for f in system.get_file_info(fs.FileSelector(root)):
                if f.base_name.startswith(("_", "manifest-")) and f.base_name not in counted:  # of attempts that Spark didn't take
                    system.delete_file(f.path)
            system.move(root, f"{root.rsplit('/', 1)[0]}/{self.name}")

    def abort(self, messages) -> None:
        system, root = fs.FileSystem.from_uri(self.staged)
        if system.get_file_info(root).type != fs.FileType.NotFound:
            system.delete_dir(root)


class Captures(DataSource):
    """Options: ``path``, a folder that pyarrow's file systems reach from all executors; ``kind`` (json, html, xlsx, pdf) to read; ``cap`` to write."""

    @classmethod
    def name(cls) -> str:
        return "notices"

    def schema(self) -> str:
        return KINDS[self.options.get("kind", "json")][1]

    def reader(self, schema) -> DataSourceReader:
        from pyspark.sql.pandas.types import to_arrow_schema

        return CaptureReader(self.options["path"], self.options.get("kind", "json"), to_arrow_schema(schema))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("captures are only added to")
        return CaptureWriter(self.options["path"], int(self.options.get("cap", CAP)))


def manifest(spark: SparkSession, path: str):
    """url, ficheiro (null where refused), status, etag of all captures below ``path``."""
    return spark.read.schema("url string, ficheiro string, status int, etag string").json(f"{path}/[!_]*/manifest-*.jsonl")


def registered(spark: SparkSession) -> SparkSession:
    """The session with the format ``notices``, and filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Captures)
    return spark
