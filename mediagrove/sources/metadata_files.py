"""Statements of the frontends' metadata files: each file (seq, kind, scope, content) gives rows of what it says, or of why it can't be read.

``kind``: appinfo, manifest, shortcuts, gamelist or library; ``scope``: a game list's system, else ''. A damaged file fails no task: it is a diagnostic.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from . import formats, paged

SCHEMA = "seq long, place long, what string, source string, id string, text string, plugin string, game_id string"

# The names of the sources, and what is said of files that can't be read.
SOURCES = {"appinfo": "steam-appinfo", "manifest": "steam-manifest", "shortcuts": "steam-shortcut", "library": "playnite"}
UNREADABLE = {
    "appinfo": ("warning", "Steam titles unavailable - appinfo.vdf could not be read safely."), "manifest": ("warning", "invalid appmanifest source"),
    "shortcuts": ("warning", "Non-Steam shortcut titles unavailable - shortcuts.vdf could not be read safely."),
    "gamelist": ("unsupported", "This system is using cleaned file names because its gamelist could not be read safely."),
    "library": ("unavailable", "Playnite titles unavailable - the local games database could not be read safely."),
}
SKIPPED = {"appinfo": "Steam titles loaded with {} unreadable app records skipped.", "shortcuts": "Non-Steam titles loaded with {} incomplete shortcuts skipped."}
NOTHING = {"appinfo": "Steam titles unavailable - appinfo.vdf contained no readable names."}


def _read(kind: str, scope: str, data: bytes) -> Iterator[tuple]:
    """(what, source, id, text, plugin, game_id)."""
    source = f"esde:{scope.lower()}" if kind == "gamelist" else SOURCES[kind]

    def say(status: str, message: str) -> tuple:
        return "diagnostic", source, status, message, "", ""

    try:
        if kind in ("appinfo", "shortcuts"):
            titles, skipped = (formats.app_info if kind == "appinfo" else formats.shortcuts)(data)
            yield from (("app", source, str(app), title, "", "") for app, title in sorted(titles.items()))
            if skipped:
                yield say("warning", SKIPPED[kind].format(skipped))
            if not titles and kind in NOTHING:
                yield say("warning", NOTHING[kind])
        elif kind == "manifest":
            found = formats.app_manifest(data)
            yield ("app", source, str(found[0]), found[1], "", "") if found else say(*UNREADABLE[kind])
        elif kind == "gamelist":
            yield from (("rom", source, stem, name, "", "") for stem, name in formats.gamelist(data))
        else:
            status, games, _ = paged.read_library(data)
            if status != "ok":
                yield say(*UNREADABLE[kind])
            yield from (("game", source, g["guid"], g["name"], g["plugin"], g["game_id"]) for g in games)
    except (formats.Damaged, struct.error):
        yield say(*UNREADABLE[kind])


def statements(files: DataFrame) -> DataFrame:
    """(seq, place in the file, what: app, rom, game or diagnostic, source, id, text, plugin, game_id) of ``files`` (seq, kind, scope, content)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(seq, n, *said) for seq, kind, scope, content in pdf.itertuples(index=False) for n, said in enumerate(_read(kind, scope, bytes(content)))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.select("seq", "kind", "scope", "content").mapInPandas(run, SCHEMA)
