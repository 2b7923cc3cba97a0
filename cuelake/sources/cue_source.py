"""Cue files as a data source of their own: ``spark.read.format("cues").load(folder)``, and ``readStream`` for files as they come."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "item_id string, cue_index int, start_ms long, end_ms long, text string, error string"
#: The endings of cue files.
ENDINGS = (".srt", ".vtt", ".ass", ".ssa")
#: Bytes of files that one task reads, unless told otherwise.
GROUP_BYTES = 32 << 20
_TIME = r"(?:([0-9]+):)?([0-9]{1,2}):([0-9]{2})[,.]([0-9]{1,3})"
_LINE = re.compile(_TIME + r"[ \t]*-->[ \t]*" + _TIME)
_DIALOGUE = re.compile(r"Dialogue:\s*[^,]*,([0-9]+):([0-9]{1,2}):([0-9]{2})[.:]([0-9]{1,3}),([0-9]+):([0-9]{1,2}):([0-9]{2})[.:]([0-9]{1,3}),(?:[^,]*,){6}([^\n]*)")
_SPACE, _DRAWING = re.compile(r"[ \t\n\x0b\x0c\r]+"), re.compile(r"\{[^}]*\\p[1-9][^}]*\}")


def _millis(parts: tuple) -> int:
    hours, minutes, seconds, fraction = parts
    return ((int(hours or 0) * 60 + int(minutes)) * 60 + int(seconds)) * 1000 + int(fraction.ljust(3, "0"))


def cues_of(raw: bytes) -> Iterator[tuple[int, int, int, str]]:
    """(cue_index, start_ms, end_ms, text) of a file, as ``parse_cues`` and ``parse_styled`` have them; styled files are told by what they hold."""
    body = raw.decode("utf-8", "replace").removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    if re.search(r"^Dialogue:", body, re.M):
        events = [x for x in body.split("\n") if x.startswith(("Dialogue:", "Comment:"))]
        for k, line in enumerate(events):
            m = _DIALOGUE.match(line)
            if m and not _DRAWING.search(m[9]):
                text = _SPACE.sub(" ", re.sub(r"\\[Nnh]", " ", re.sub(r"\{[^}]*\}", "", m[9]))).strip(" ")
                if text:
                    yield k, _millis(m.groups()[:4]), _millis(m.groups()[4:8]), text
        return
    blocks = (b for b in re.split(r"\n[ \t]*\n+", body) if _LINE.search(b))
    for k, block in enumerate(blocks):
        m = _LINE.search(block)
        text = re.sub(r"\A.*?-->[^\n]*\n?", "", block, count=1, flags=re.S)
        text = _SPACE.sub(" ", re.sub(r"<[^>]*>|\{[^}]*\}", "", text)).strip(" ")
        if text:
            yield k, _millis(m.groups()[:4]), _millis(m.groups()[4:]), text


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


def _listed(uri: str) -> list[tuple[int, str, int]]:
    """(time of change, path, bytes) of the cue files below a folder, in order."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))
    found = store.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted((x.mtime_ns or 0, x.path, x.size) for x in found if x.is_file and x.path.lower().endswith(ENDINGS))


def _grouped(files: list[tuple[int, str, int]], most: int) -> list[_Files]:
    groups, held = [], 0
    for _, path, size in files:
        if not groups or held + size > most:
            groups.append([])
            held = 0
        groups[-1].append(path)
        held += size
    return [_Files(g) for g in groups]


def _rows(uri: str, partition: _Files) -> Iterator[tuple]:
    from pyarrow import fs

    store = fs.FileSystem.from_uri(uri)[0] if "://" in uri else fs.LocalFileSystem()
    for path in partition.paths:
        try:
            with store.open_input_file(path) as file:
                cues = list(cues_of(file.read()))
        except OSError as e:
            cues = []
            yield path, None, None, None, None, f"unreadable: {e}"
            continue
        for cue in cues:
            yield path, *cue, None
        if not cues:
            yield path, None, None, None, None, "no cues"


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.most = options["path"], int(options.get("groupBytes", GROUP_BYTES))

    def partitions(self) -> list[_Files]:
        return _grouped(_listed(self.uri), self.most)

    def read(self, partition: _Files) -> Iterator[tuple]:
        yield from _rows(self.uri, partition)


class _StreamReader(DataSourceStreamReader):
    """Files in order of change and path; the offset is the last one that was read."""

    def __init__(self, options: dict):
        self.uri, self.most = options["path"], int(options.get("groupBytes", GROUP_BYTES))

    def initialOffset(self) -> dict:
        return {"after": json.dumps([-1, ""])}

    def latestOffset(self) -> dict:
        files = _listed(self.uri)
        return {"after": json.dumps(list(files[-1][:2]))} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[_Files]:
        low, high = (tuple(json.loads(x["after"])) for x in (start, end))
        return _grouped([f for f in _listed(self.uri) if low < f[:2] <= high], self.most)

    def read(self, partition: _Files) -> Iterator[tuple]:
        yield from _rows(self.uri, partition)

    def commit(self, end: dict) -> None:
        pass


class CueSource(DataSource):
    """Rows of SCHEMA: the cues of each file, or one row with ``error`` for a file that has none or can't be read. Options: path, a folder that tasks can open by
    pyarrow's file systems (what only Spark's readers can open is for ``read_cues``), and groupBytes, how much a task reads. The driver lists names, and nothing is read there.
    A stream takes a file once, by its time of change: files must come whole, by renaming."""

    @classmethod
    def name(cls) -> str:
        return "cues"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def register(spark: SparkSession) -> SparkSession:
    """Make the format ``cues`` known to a session."""
    spark.dataSource.register(CueSource)
    return spark
