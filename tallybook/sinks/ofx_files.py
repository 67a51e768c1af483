"""OFX output as files: one document per account, written in a stream by a data source with commit."""
from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tallybook.session import ship
from tallybook.sinks.ofx_writer import to_ofx

FORMAT = "text_documents"
DRAFTS = "_drafts-"


@dataclass
class Written(WriterCommitMessage):
    folder: str


class DocumentWriter(DataSourceArrowWriter):
    """Rows (name, text), those of a name next to each other and in order, to a file of that name.

    A task writes to a folder of its own attempt; the files of the attempts that count are renamed at the end, so an attempt that died or was
    overtaken leaves nothing, and no reader sees half a document. A file of the same name is replaced, others stay.
    """

    def __init__(self, path: str, encoding: str):
        self.path, self.encoding = path.rstrip("/"), encoding
        self.drafts = f"{self.path}/{DRAFTS}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, folder = fs.FileSystem.from_uri(f"{self.drafts}/{uuid.uuid4().hex}")
        files.create_dir(folder, recursive=True)
        name, out, done = None, None, set()
        try:
            for batch in iterator:
                for own, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    if own != name:
                        if out:
                            out.close()
                        if own in done:
                            raise ValueError(f"the lines of {own} do not stand together")
                        done.add(own)
                        name, out = own, files.open_output_stream(f"{folder}/{own}")
                    out.write(f"{text}\n".encode(self.encoding, "xmlcharrefreplace"))
        finally:
            if out:
                out.close()
        return Written(f"{self.drafts}/{folder.rsplit('/', 1)[1]}")

    def commit(self, messages: list[Written | None]) -> None:
        files, target = fs.FileSystem.from_uri(self.path)
        files.create_dir(target, recursive=True)
        with ThreadPoolExecutor(16) as pool:
            for message in filter(None, messages):       # one task's files after the other's: the driver holds no list of all accounts
                written = files.get_file_info(fs.FileSelector(fs.FileSystem.from_uri(message.folder)[1]))
                list(pool.map(lambda f: files.move(f.path, f"{target}/{f.base_name}"), written))
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        files, drafts = fs.FileSystem.from_uri(self.drafts)
        if files.get_file_info(drafts).type != fs.FileType.NotFound:
            files.delete_dir(drafts)


class TextDocuments(DataSource):
    """``df.write.format("text_documents").mode("append").option("encoding", ...).save(path)`` for rows (name, text)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        if overwrite:
            raise ValueError("documents are replaced one by one: write in mode append")
        return DocumentWriter(self.options["path"], self.options.get("encoding", "utf-8"))


def file_name(keys: list[str], ending: str = ".ofx") -> Column:
    """A name that no other keys have: the values, percent-encoded, with commas between; a null is ``%``. None is hidden (Spark reads no file that begins with ``.`` or ``_``)."""
    name = F.concat_ws(",", *[F.coalesce(F.url_encode(F.col(k).cast("string")), F.lit("%")) for k in keys])
    name = F.when(name.startswith("."), F.concat(F.lit("%2E"), F.substr(name, F.lit(2)))).when(name.startswith("_"), F.concat(F.lit("%5F"), F.substr(name, F.lit(2)))).otherwise(name)
    return F.concat(name, F.lit(ending))


def write_ofx(txn: DataFrame, keys: list[str], path: str, now: str, encoding: str = "cp1252", **settings) -> None:
    """K3: one ``.ofx`` file per account (:func:`file_name`) in ``path``, which ``read_ofx`` reads back to the same rows.

    An account is sorted by Spark, which spills, and streamed to its file by one task, as a file is written in order; no account is held in memory. Letters that the
    encoding lacks are written as ``&#n;``. An account without rows has no file; accounts written before are replaced, others stay. ``settings`` go to :func:`to_ofx`.
    """
    ship(txn.sparkSession)
    txn.sparkSession.dataSource.register(TextDocuments)
    parts = to_ofx(txn, keys, now, **settings)
    (parts.select(file_name(keys).alias("name"), "ord", "text").repartition("name").sortWithinPartitions("name", "ord").select("name", "text")
     .write.format(FORMAT).mode("append").option("encoding", encoding).save(path))
