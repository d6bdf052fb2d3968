"""Sinks of evaluation sets, and configuration files."""

from __future__ import annotations

import json
import tomllib
from dataclasses import fields
from pathlib import Path

from pyspark.sql import DataFrame

from lorekeep.schema import Chunking, Config, Search

_SPOTCHECK = "# Spot check\n\nversion {version}, corpus {corpus_hash}, rows in {name}\n"


def write_testset(rows: DataFrame, out: str, meta: dict, force: bool = False) -> str:
    """Writes {out}/{version}/{corpus hash}.jsonl with a .meta.json beside, and once a sheet for spot checks."""
    folder, name = Path(out, meta["version"]), f"{meta['corpus_hash']}.jsonl"
    rows.write.mode("overwrite" if force else "errorifexists").json(str(folder / name))
    (folder / f"{meta['corpus_hash']}.meta.json").write_text(json.dumps(meta, indent=2, sort_keys=True) + "\n")
    sheet = folder / f"{meta['corpus_hash']}.spotcheck.md"
    if not sheet.exists():
        sheet.write_text(_SPOTCHECK.format(name=name, **meta))
    return str(folder / name)


def load_config(path: str) -> Config:
    """Settings of a TOML file over the defaults; a missing file has the defaults."""
    said = tomllib.loads(Path(path).read_text()) if Path(path).exists() else {}
    part = lambda kind, name: kind(**{f.name: said[name][f.name] for f in fields(kind) if f.name in said.get(name, {})})
    return Config(said.get("data_dir", Config.data_dir), part(Chunking, "chunking"), part(Search, "search")).checked()


def find_root(start: str, marker: str = ".lorekeep/lorekeep.toml") -> tuple[str | None, list[str]]:
    """The nearest folder upwards that has the marker, and those above that it hides."""
    here = Path(start).resolve()
    found = [str(p) for p in (here, *here.parents) if (p / marker).is_file()]
    return (found[0] if found else None), found[1:]
