"""Text boxes of Word files: a data source with a partition for every few files, and the same over files that Spark has read."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SCHEMA = "path string, block int, textbox int, para int, text string, runs array<struct<text:string,bold:boolean,italic:boolean,font:string,size:double,color:string>>"


def _run(r: ElementTree.Element) -> dict | None:
    text = "".join(t.text or "" for t in r.findall(f"{_W}t"))
    if not text:
        return None
    one = {"text": text, "bold": None, "italic": None, "font": None, "size": None, "color": None}
    if (p := r.find(f"{_W}rPr")) is not None:
        at = lambda tag, *names: next((v for n in names if (e := p.find(f"{_W}{tag}")) is not None and (v := e.get(f"{_W}{n}"))), None)
        size = at("sz", "val")
        one |= {"bold": p.find(f"{_W}b") is not None, "italic": p.find(f"{_W}i") is not None, "font": at("rFonts", "ascii", "hAnsi"), "size": int(size) / 2 if size and size.isdigit() else None, "color": at("color", "val")}
    return one


def text_box_rows(content: bytes) -> list[tuple[int, int, int, str, list[dict]]]:
    """Paragraphs with text in the text boxes of a Word file: number, text box, paragraph in it, text, runs. Boxes count in the order of the body's paragraphs."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out: list[tuple[int, int, int, str, list[dict]]] = []
    for box, inner in enumerate(b for p in body.findall(f"{_W}p") for b in p.iter(f"{_W}txbxContent")):
        for k, p in enumerate(inner.findall(f"{_W}p")):
            runs = [x for r in p.findall(f"{_W}r") if (x := _run(r))]
            if text := "".join(x["text"] for x in runs).strip():
                out.append((len(out), box, k, text, runs))
    return out


class Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.most = options["path"], int(options.get("filesperpartition", "32"))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        found = [store.get_file_info(root)] if store.get_file_info(root).is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        paths = sorted(f.path for f in found if f.is_file and f.path.endswith(".docx"))
        return [Files(paths[i : i + self.most]) for i in range(0, len(paths), self.most)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path)
        for path in partition.paths:
            with store.open_input_stream(path) as f:
                content = f.read()
            yield from ((path, *row) for row in text_box_rows(content))


class WordTextBoxes(DataSource):
    """Option path: a file or folder in a store that Arrow opens (local, shared, HDFS, S3, GCS); filesPerPartition: 32."""

    @classmethod
    def name(cls) -> str:
        return "word_textboxes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def word_text_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Text boxes of the Word files below a path, read by their partitions."""
    spark.dataSource.register(WordTextBoxes)
    return spark.read.format("word_textboxes").load(path)


def text_boxes(files: DataFrame) -> DataFrame:
    """The same of files (path, content), wherever Spark has them from."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            made = [(p, *r) for p, c in zip(pdf["path"], pdf["content"], strict=True) for r in text_box_rows(c)]
            yield pd.DataFrame(made, columns=["path", "block", "textbox", "para", "text", "runs"])

    return files.select("path", "content").mapInPandas(read, SCHEMA)
