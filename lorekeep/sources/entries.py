"""Markdown entries with TOML front matter: scan, parse, serialise, write."""

from __future__ import annotations

import json
import os
import secrets
import time
import tomllib
import uuid
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.schema import DEFAULT_KIND, ENTRIES, KINDS

DELIMITER = "+++"
_PARSED = ENTRIES + ", error string, file string"


def scan_entries(spark: SparkSession, folder: str) -> DataFrame:
    """file, content of the ``*.md`` of a folder, not those hidden by a leading dot; a missing folder is empty."""
    files = _files(spark, folder)
    return files.select("file", F.col("content").cast("string").alias("content"))


def count_entries(spark: SparkSession, folder: str) -> int:
    """How many files ``scan_entries`` has; their contents are not read."""
    return _files(spark, folder).select("file").count()


def _files(spark: SparkSession, folder: str) -> DataFrame:
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "file string, content binary")
    return files.withColumn("file", F.element_at(F.split("path", "/"), -1)).where(~F.col("file").startswith("."))


def parse_entry(content: str, strict: bool = False) -> dict:
    """The fields of an entry. strict: the closing delimiter has a line of its own, and the kind no default."""
    rest = content.lstrip("﻿")
    if not rest.startswith(DELIMITER):
        raise ValueError("missing opening +++ delimiter")
    rest = rest[len(DELIMITER) :]
    if strict:
        lines = rest.split("\n")
        close = next((i for i, line in enumerate(lines) if i and line.strip() == DELIMITER), None)
        if close is None:
            raise ValueError("missing closing +++ delimiter")
        block, body = "\n".join(lines[:close]), "\n".join(lines[close + 1 :])
    else:
        block, close, body = rest.partition("\n" + DELIMITER)
        if not close:
            raise ValueError("missing closing +++ delimiter")
    meta = tomllib.loads(block.strip())
    for name in ("id", "created_at"):
        if not isinstance(meta.get(name), str):
            raise ValueError(f"missing field {name}")
    if not meta["id"]:
        raise ValueError("entry id must not be empty")
    kind = meta.get("kind", "" if strict else DEFAULT_KIND)
    if kind not in KINDS and not strict:
        raise ValueError(f"unknown kind: {kind}")
    return {"id": meta["id"], "created_at": meta["created_at"], "kind": kind, "supersedes": list(meta.get("supersedes", [])), "tags": list(meta.get("tags", [])), "body": body.strip()}


def parse_entries(files: DataFrame, strict: bool = False) -> DataFrame:
    """file, content -> the entry's fields, error (null if it could be read), file."""
    columns = [c.split()[0] for c in _PARSED.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for name, content in zip(batch.file, batch.content, strict=True):
                try:
                    rows.append(parse_entry(content or "", strict) | {"error": None, "file": name})
                except (ValueError, tomllib.TOMLDecodeError) as e:
                    rows.append(dict.fromkeys(columns) | {"error": str(e), "file": name})
            yield pd.DataFrame(rows, columns=columns)

    return files.select("file", "content").mapInPandas(run, _PARSED)


def read_entries(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The entries, and (file, reason) of files that could not be read."""
    parsed = parse_entries(scan_entries(spark, folder))
    return parsed.where("error is null").drop("error", "file"), parsed.where("error is not null").select("file", F.col("error").alias("reason"))


def load_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Strict load: any unreadable file or repeated id is an error; bodies have normal line ends."""
    from lorekeep.functions.text import normalize_body
    from lorekeep.operators.supersede import duplicate_ids

    parsed = parse_entries(scan_entries(spark, folder), strict=True)
    for row in parsed.where("error is not null").limit(1).collect():
        raise ValueError(f"{row['file']}: {row['error']}")
    for row in duplicate_ids(parsed).limit(1).collect():
        raise ValueError(f"duplicate id {row['id']}")
    return parsed.drop("error").withColumn("body", normalize_body(F.col("body"))).orderBy("file").drop("file")


def serialize_entry(entry: dict) -> str:
    quoted = lambda v: json.dumps(v, ensure_ascii=False)  # noqa: E731  a JSON string is a TOML basic string
    lines = [f"{name} = {quoted(entry[name])}" for name in ("id", "created_at", "kind")]
    lines += [f"{name} = [{', '.join(map(quoted, entry[name]))}]" for name in ("supersedes", "tags") if entry.get(name)]
    body = f"\n{entry['body']}\n" if entry.get("body") else ""
    return "\n".join([DELIMITER, *lines, DELIMITER, ""]) + body


def new_entry_id() -> str:
    """A version 7 UUID: ordered by time."""
    stamp = time.time_ns() // 1_000_000
    return str(uuid.UUID(int=(stamp << 80) | (7 << 76) | (secrets.randbits(12) << 64) | (2 << 62) | secrets.randbits(62)))


def now() -> str:
    return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())


def new_entry(body: str, kind: str = DEFAULT_KIND, tags: list[str] | None = None, supersedes: list[str] | None = None) -> dict:
    return {"id": new_entry_id(), "created_at": now(), "kind": kind, "supersedes": supersedes or [], "tags": tags or [], "body": body.strip()}


def write_entry(folder: str, entry: dict) -> str:
    """Writes beside and renames, so that a reader sees all of the file or none."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    path, beside = Path(folder, f"{entry['id']}.md"), Path(folder, f".{entry['id']}.md.tmp")
    beside.write_text(serialize_entry(entry), encoding="utf-8")
    os.replace(beside, path)
    return str(path)
