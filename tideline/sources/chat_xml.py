"""Recorder files of chat messages: XML, read tolerantly, with the metadata at a file's head.

A file is read in one pass by an event parser. Messages are the d elements anywhere in it, in order; what can't be a
message (no uid, no whole-number timestamp) is skipped. A file with forbidden control signs is read without them, and
one that breaks off between elements, or within a message's text, is read up to there; any other damage makes it
unreadable, which is a status and no failure of the job.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.shipping import ship_package

#: Signs that XML forbids, and how much of a file's head holds its metadata.
CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
HEAD_BYTES = 65536

READ_SCHEMA = "path string, status string, reason string, metadata map<string,string>, messages array<struct<pos:int,uid:string,ts_ms:bigint,text:string>>"


class UnreadableFile(ValueError):
    """A file that holds no readable messages though it should."""

    def __init__(self, path: str, message: str):
        super().__init__(f"{path}: {message}")
        self.path = path


@dataclass
class Reading:
    messages: list[tuple[str, int, str]]
    repair: str | None = None


@dataclass
class _Walk:
    """What the event parser has seen: open elements, and messages with their text so far."""

    open: list[tuple[str, int | None]] = field(default_factory=list)
    rows: list[list] = field(default_factory=list)
    bare: list[bool] = field(default_factory=list)  # whether the open element has had no child yet

    def start(self, name: str, attributes: dict) -> None:
        if self.bare:
            self.bare[-1] = False
        row = None
        if name == "d":
            row = len(self.rows)
            self.rows.append([attributes.get("uid"), attributes.get("timestamp"), ""])
        self.open.append((name, row))
        self.bare.append(True)

    def end(self, _: str) -> None:
        self.open.pop()
        self.bare.pop()

    def text(self, data: str) -> None:
        if self.open and self.open[-1][1] is not None and self.bare[-1]:
            self.rows[self.open[-1][1]][2] += data


def _walked(text: str) -> tuple[_Walk, str]:
    """The walk over a document and how it ended: whole, cut (between elements or in a message) or broken."""
    walk = _Walk()
    parser = expat.ParserCreate("utf-8")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = walk.start, walk.end, walk.text
    data = text.encode("utf-8", "replace")
    try:
        parser.Parse(data, False)
    except expat.ExpatError:
        return walk, "broken"
    try:
        parser.Parse(b"", True)
    except expat.ExpatError as e:
        ended_between = e.code == expat.errors.codes[expat.errors.XML_ERROR_NO_ELEMENTS] and bool(walk.open)
        inner = [name for name, _ in walk.open[1:]]
        return walk, "cut" if ended_between and inner in ([], ["d"]) else "broken"
    return walk, "whole"


def _whole_number(raw: str | None) -> int | None:
    try:
        return int(raw) if raw is not None else None
    except ValueError:
        return None


def read_bytes(content: bytes, path: str = "<bytes>") -> Reading:
    """Messages (uid, ts_ms, text) of a file's bytes, and what had to be repaired; UnreadableFile if nothing can be read."""
    text = content.decode("utf-8", "replace")
    walk, ending = _walked(text)
    repair = None
    if ending != "whole":
        clean = CONTROL.sub("", text)
        if clean != text:
            walk, ending = _walked(clean)
            repair = "control characters removed"
        if ending == "cut":
            repair = "file breaks off, closed at its end"
        elif ending != "whole":
            raise UnreadableFile(path, "not a readable chat file")
    messages = [(uid, ts, body) for uid, ts, body in ((u, _whole_number(t), b) for u, t, b in walk.rows) if uid is not None and ts is not None]
    if not messages and walk.rows:
        raise UnreadableFile(path, f"all {len(walk.rows)} messages are malformed")
    return Reading(messages, repair)


def read_file(path: str) -> Reading:
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    with open(path, "rb") as f:
        return read_bytes(f.read(), path)


def metadata(head: bytes) -> dict[str, str | None]:
    """Tag and text of the metadata block's children, from a file's first bytes; empty without a usable block."""
    text = CONTROL.sub("", head[:HEAD_BYTES].decode("utf-8", "replace"))
    lo = text.find("<metadata>")
    hi = text.find("</metadata>", lo)
    if lo < 0 or hi < 0:
        return {}
    found: dict[str, str | None] = {}
    depth = 0
    name: str | None = None

    def start(tag: str, _: dict) -> None:
        nonlocal depth, name
        depth += 1
        name = tag if depth == 2 else None
        if depth == 2:
            found[tag] = None

    def end(_: str) -> None:
        nonlocal depth, name
        depth -= 1
        name = None

    def data(value: str) -> None:
        if name is not None:
            found[name] = (found[name] or "") + value

    parser = expat.ParserCreate("utf-8")
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    try:
        parser.Parse(text[lo : hi + len("</metadata>")].encode("utf-8", "replace"), True)
    except expat.ExpatError:
        return {}
    return found


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for path, content in zip(batch["path"], batch["content"], strict=True):
            head = metadata(bytes(content))
            try:
                found = read_bytes(bytes(content), path)
                rows = [{"pos": i, "uid": u, "ts_ms": t, "text": x} for i, (u, t, x) in enumerate(found.messages)]
                out.append((path, "repaired" if found.repair else "ok", found.repair, head, rows))
            except UnreadableFile as e:
                out.append((path, "skipped", str(e), head, []))
        yield pd.DataFrame(out, columns=["path", "status", "reason", "metadata", "messages"])


def files(spark: SparkSession, path: str) -> DataFrame:
    """One row per XML file anywhere under path: path, content, modified_ms, length."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").load(path)
    return found.select("path", "content", F.unix_millis("modificationTime").alias("modified_ms"), "length")


def contents(frame: DataFrame) -> DataFrame:
    """What each of the files (path, content) holds: status (ok, repaired, skipped), reason, metadata and messages."""
    ship_package(frame.sparkSession)
    return frame.select("path", "content").mapInPandas(_rows, READ_SCHEMA)


def messages(read: DataFrame) -> DataFrame:
    """stream_id, path, pos, uid, ts_ms and text of read files; the stream is the file until sessions are known."""
    return read.select(F.col("path").alias("stream_id"), "path", F.inline("messages"))


def uploaded(spark: SparkSession, name: str, content: bytes) -> DataFrame:
    """A file given as bytes, as files() would have it."""
    return spark.createDataFrame([(name, bytearray(content))], "path string, content binary")


def chunk_table(read: DataFrame, times: DataFrame) -> DataFrame:
    """Chunks for sessions: path, created_ms, modified_ms, platform, user_name, room_title. times: path, created_ms, modified_ms."""
    return read.join(times, "path").select("path", "created_ms", "modified_ms", *[F.col("metadata").getItem(k).alias(k) for k in ("platform", "user_name", "room_title")])


HEAD_SCHEMA = "path string, metadata map<string,string>"


def heads(paths: DataFrame) -> DataFrame:
    """path and metadata of files, of which no more than HEAD_BYTES are read: for lists of many recordings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            found = []
            for path in batch["path"]:
                uri = path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:"))
                store, name = fs.FileSystem.from_uri(uri)
                with store.open_input_file(name) as f:
                    found.append((path, metadata(f.read(HEAD_BYTES))))
            yield pd.DataFrame(found, columns=["path", "metadata"])

    ship_package(paths.sparkSession)
    return paths.select("path").mapInPandas(run, HEAD_SCHEMA)


def listed(spark: SparkSession, root: str) -> DataFrame:
    """path, created_ms and modified_ms of XML files anywhere under a folder; contents aren't read.

    Stores tell when a file was changed. Where it is a local file too, its entry's last change counts as its making.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").load(root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            local = [p.removeprefix("file://").removeprefix("file:") for p in batch["path"]]
            made = [int(os.stat(x).st_ctime * 1000) if p.startswith("file:") and os.path.exists(x) else m for p, x, m in zip(batch["path"], local, batch["modified_ms"], strict=True)]
            yield pd.DataFrame({"path": batch["path"], "created_ms": made, "modified_ms": batch["modified_ms"]})

    ship_package(spark)
    return found.select("path", F.unix_millis("modificationTime").alias("modified_ms")).mapInPandas(run, "path string, created_ms bigint, modified_ms bigint")
