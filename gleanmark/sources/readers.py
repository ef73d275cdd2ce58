"""Readers of structured texts as Spark data sources: concept cards, lectures, votes, lists of questions and search output.

A reader deals a folder's files into partitions of about equal size, leaves out files that a pushed filter on ``file`` can't
match, and parses each where it is read. A file that can't be decoded or a line that doesn't fit costs only itself. Folders are
local paths, or addresses that pyarrow's file systems know.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringStartsWith

#: Bytes of the files of one partition, and rows of one batch.
PART_BYTES, ROWS = 32 << 20, 4096


class Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


def _opened(root: str):
    from pyarrow import fs

    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(root if "://" in root else root.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), root


class FolderReader(DataSourceReader):
    """Reads what ``parse`` makes of each file that ``takes`` wants: rows beginning with ``file``, its path below the folder."""

    def __init__(self, root: str, schema: str, takes, parse) -> None:
        self.root, self.takes, self.parse, self.wanted = root, takes, parse, []
        self.kind = schema

    def pushFilters(self, filters: list[Filter]):
        """Filters on ``file`` choose files; Spark still checks the rows of those that are read."""
        for f in filters:
            if getattr(f, "attribute", None) == ("file",) and isinstance(f, (EqualTo, In, StringStartsWith, StringContains)):
                self.wanted.append(f)
            yield f

    def _fits(self, name: str) -> bool:
        tests = {EqualTo: lambda f: name == f.value, In: lambda f: name in f.value, StringStartsWith: lambda f: name.startswith(f.value), StringContains: lambda f: f.value in name}
        return all(tests[type(f)](f) for f in self.wanted)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, base = _opened(self.root)
        found = system.get_file_info(fs.FileSelector(base, recursive=True))
        named = sorted((i.path[len(base.rstrip("/")) + 1 :], i.size) for i in found if i.type == fs.FileType.File)
        parts, size = [], PART_BYTES
        for name, n in named:
            if not _last(name).startswith(("_", ".")) and self.takes(name) and self._fits(name):
                if size >= PART_BYTES:
                    parts.append(Files([]))
                    size = 0
                parts[-1].paths.append(name)
                size += n
        return parts

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        # Workers have no session that could read the types' names.
        kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
        schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split(" ") for x in self.kind.split(", "))])
        system, base = _opened(self.root)
        rows: list[tuple] = []
        for name in partition.paths if partition else []:
            with system.open_input_stream(f"{base.rstrip('/')}/{name}") as stream:
                text = stream.read().decode("utf-8", "replace")
            for row in self.parse(name, text):
                rows.append((name, *row))
                if len(rows) >= ROWS:
                    yield self._batch(rows, schema)
                    rows = []
        if rows:
            yield self._batch(rows, schema)

    @staticmethod
    def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class Folder(DataSource):
    """A data source over a folder; subclasses say which files they take, and what rows are in one."""

    kind = ""
    fields = ""

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return f"file string, {self.fields}"

    @staticmethod
    def takes(name: str) -> bool:
        return True

    @staticmethod
    def parse(name: str, text: str) -> Iterator[tuple]:
        raise NotImplementedError

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options["path"], self.schema(), type(self).takes, type(self).parse)


def _last(name: str) -> str:
    return name.rsplit("/", 1)[-1]


def header(text: str) -> tuple[dict[str, str], str]:
    """The fields between the first two lines of three dashes, quotes off, later names first, and what follows."""
    parts = text.split("---", 2)
    if not text.startswith("---") or len(parts) < 3:
        return {}, text
    found = re.findall(r"(?m)^(\w+)[ \t]*:[ \t]*(\S.*?)[ \t]*$", parts[1])
    return {k: v.strip("\"'") for k, v in found}, parts[2]


class Cards(Folder):
    """Concept cards, K-*.md: one row each, with the Relations section as it stands. A card without a header counts as well; it
    has its file's name for id and title."""

    kind, fields = "cards", "card_id string, title string, status string, definition string, relations string, inbox boolean"

    @staticmethod
    def takes(name: str) -> bool:
        return bool(re.fullmatch(r"K-.*\.md", _last(name)))

    @staticmethod
    def parse(name: str, text: str) -> Iterator[tuple]:
        fields, body = header(text)
        stem = _last(name)[:-3]
        section = lambda title: (re.findall(rf"(?s)##\s+{title}\s*\n(.*?)(?=\n##\s|\Z)", body) or [""])[0].strip()
        yield fields.get("concept_id", stem), fields.get("canonical_name", stem), fields.get("status", "unknown"), section("Definition")[:500], section("Relations"), "_inbox/" in name


class Lectures(Folder):
    """Lecture texts that were put into form (.ai_v1.md, .ai_v2.md, .terra.md), outside folders of raw texts: one row each, with the TITLE,
    SOURCE, URL and VIDEO_ID lines of the first 2,000 characters; the file's name stands for a title that isn't told."""

    kind, fields = "lectures", "title string, source string, url string, video_id string, text string"

    @staticmethod
    def takes(name: str) -> bool:
        return name.endswith((".ai_v1.md", ".ai_v2.md", ".terra.md")) and "raw" not in name.split("/")[:-1]

    @staticmethod
    def parse(name: str, text: str) -> Iterator[tuple]:
        told = dict(reversed(re.findall(r"(?m)^(TITLE|SOURCE|URL|VIDEO_ID):[ \t]*(\S.*?)[ \t]*$", text[:2000])))
        yield told.get("TITLE", _last(name).split(".")[0]), *(told.get(k, "") for k in ("SOURCE", "URL", "VIDEO_ID")), text


class Votes(Folder):
    """Votes on folders, name|dept|discipline|broad: one row for each line of four parts or more, with its place; blank lines,
    comments and others are passed over."""

    kind, fields = "votes", "line long, folder string, dept string, discipline string, broad string"

    @staticmethod
    def parse(name: str, text: str) -> Iterator[tuple]:
        for at, line in enumerate(text.split("\n")):
            parts = [p.strip() for p in line.strip().split("|")]
            if len(parts) >= 4 and not parts[0].startswith("#"):
                yield at, *parts[:4]


class Questions(Folder):
    """Lists of questions, the plain kind of YAML: "- query:" opens one, and lines of its depth fill its fields; expected is a list in
    brackets or one id. Comments and other lines are passed over, and a question without a query is none."""

    kind, fields = "questions", "place long, query string, expected array<string>, type string"

    @staticmethod
    def takes(name: str) -> bool:
        return name.endswith((".yaml", ".yml"))

    @staticmethod
    def parse(name: str, text: str) -> Iterator[tuple]:
        place, now = 0, {}
        for line in [*text.split("\n"), "- "]:
            opened = re.match(r"-\s", line) or line == "-"
            if opened:
                if now.get("query"):
                    yield place, now["query"], now.get("expected", []), now.get("type")
                    place += 1
                now = {}
            met = re.fullmatch(r"(?:-|\s)\s*(\w+):\s*(.*?)\s*", line)
            if met and (opened or line[:1] == " "):
                name_, value = met[1], re.sub(r"\s+#.*$", "", met[2])
                if name_ == "expected":
                    now[name_] = [x.strip().strip("\"'") for x in value.strip("[]").split(",") if x.strip()]
                else:
                    now[name_] = value.strip("\"'")


class SearchOutput(Folder):
    """What the search prints, block by block: source_id, title, url, video_id and quote, of the blocks that have an address, a video
    and a quote."""

    kind, fields = "search_output", "place long, source_id string, title string, url string, video_id string, quote string"

    @staticmethod
    def parse(name: str, text: str) -> Iterator[tuple]:
        place = 0
        for block in re.split(r"(?m)^(?=--- SOURCE )", text):
            told = re.match(r"--- SOURCE \d+ \[([^\]]+:[^\]]+)\] ---\nTITLE: ([^\n]+)\nURL: ([^\n]+)\nVIDEO_ID: ([^\n]+)\n\n", block)
            if told:
                source, title, url, video = (x.strip() for x in told.groups())
                quote = block[told.end() :].strip()
                if quote and url.startswith("http") and video:
                    yield place, source, title, url, video, quote
                    place += 1


def register(spark: SparkSession) -> None:
    """Make the sources known as cards, lectures, votes, questions and search_output, with filters pushed to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Cards, Lectures, Votes, Questions, SearchOutput):
        spark.dataSource.register(source)


def last_votes(votes: DataFrame) -> DataFrame:
    """The vote that counts for each folder: the last by file and line."""
    return votes.groupBy("folder").agg(F.max_by(F.struct("dept", "discipline", "broad"), F.struct("file", "line")).alias("v")).select("folder", "v.*")
