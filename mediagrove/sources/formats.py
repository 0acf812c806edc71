"""Readers of the frontends' metadata files, for rows of ``binaryFile``: each file gives rows or a status, and never fails a task.

Application info (versions 28 and 29), shortcuts and library folders are key-value trees in binary or text; game lists are XML; the
library is a paged document database whose documents are BSON.
"""

from __future__ import annotations

import ntpath
import posixpath
import re
import struct
import uuid
import xml.parsers.expat
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.functions import udtf

MAX_DEPTH, MAX_NODES, MAX_ENTRIES, MAX_TEXT = 64, 500_000, 50_000, 8192
MAX_STRING, MAX_TEXT_NODES = 1 << 20, 1_000_000


class Damaged(ValueError):
    """The container can't be read."""


# ---- binary key-value trees ----------------------------------------------------------------------------------------
class _Bytes:
    def __init__(self, data: bytes, at: int = 0, end: int | None = None):
        self.data, self.at, self.end = data, at, len(data) if end is None else end

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > self.end:
            raise Damaged("cut short")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, form: str) -> int:
        return struct.unpack("<" + form, self.take(struct.calcsize(form)))[0]

    def text(self) -> str:
        stop = self.data.find(b"\0", self.at, self.end)
        if stop < 0:
            raise Damaged("text without an end")
        out = self.data[self.at : stop]
        self.at = stop + 1
        return out.decode("utf-8", "replace")


def binary_tree(r: _Bytes, names: list[str] | None, depth: int = 0) -> list[tuple[str, object]]:
    """(key, value) pairs up to the end tag; keys are texts, or numbers into ``names``."""
    if depth > MAX_DEPTH:
        raise Damaged("too deep")
    out: list[tuple[str, object]] = []
    while True:
        tag = r.number("B")
        if tag == 0x08:
            return out
        if len(out) >= MAX_NODES:
            raise Damaged("too many entries")
        if names is None:
            key = r.text()
        else:
            k = r.number("I")
            if k >= len(names):
                raise Damaged("unknown name")
            key = names[k]
        if tag == 0x00:
            out.append((key, binary_tree(r, names, depth + 1)))
        elif tag == 0x01:
            out.append((key, r.text()))
        elif tag == 0x02:
            out.append((key, r.number("I")))
        elif tag in (0x07, 0x0A, 0x0B) and (names is None or tag != 0x0B):
            out.append((key, r.number("Q")))
        elif tag in (0x03, 0x04, 0x06):
            r.take(4)
        elif tag == 0x05 and names is None:
            while r.take(2) != b"\0\0":
                pass
        else:
            raise Damaged(f"unknown tag {tag}")


def child(tree, *path: str):
    for name in path:
        tree = next((v for k, v in tree if k.lower() == name.lower()), None) if isinstance(tree, list) else None
    return tree


def app_info(data: bytes) -> tuple[dict[int, str], int]:
    """({app id: title}, records that were skipped). A record that can't be read is skipped; a damaged container raises."""
    r = _Bytes(data)
    magic = r.number("I")
    r.take(4)
    names, end = None, len(data)
    if magic == 0x07564429:
        table = r.number("q")
        if not 16 <= table <= len(data) - 4:
            raise Damaged("name table")
        t = _Bytes(data, table)
        names = [t.text() for _ in range(min(t.number("I"), 1_000_000))]
        end = table
    elif magic != 0x07564428:
        raise Damaged("unknown version")
    titles, skipped = {}, 0
    r.end = end
    while True:
        app = r.number("I")
        if app == 0:
            return titles, skipped
        size = r.number("I")
        body = r.take(size)
        try:
            name = child(binary_tree(_Bytes(body, 60), names), "appinfo", "common", "name")
            if isinstance(name, str) and name.strip():
                titles.setdefault(app, name.strip())
        except Damaged:
            skipped += 1


def shortcuts(data: bytes) -> tuple[dict[int, str], int]:
    """({app id: title}, entries without id or title); the first title of an id stands."""
    entries = child(binary_tree(_Bytes(data + b"\x08"), None), "shortcuts")
    if not isinstance(entries, list):
        raise Damaged("no shortcuts")
    titles, skipped = {}, 0
    for _, entry in entries:
        app, name = child(entry, "appid"), child(entry, "appname")
        if isinstance(app, int) and app and isinstance(name, str) and name.strip():
            titles.setdefault(app, name.strip())
        else:
            skipped += 1
    return titles, skipped


# ---- text key-value trees ------------------------------------------------------------------------------------------
#: White space, a comment, a brace, quoted text or bare text; a lone slash and open quotes match nothing.
_TOKEN = re.compile(rb'''[ \t\r\n]+|//[^\n]*|(?P<brace>[{}])|"(?P<quoted>(?:[^"\\]|\\.)*)"|(?P<bare>[^ \t\r\n{}"/][^ \t\r\n{}]*)''', re.S)
_ESCAPE = re.compile(rb"\\(.)", re.S)
_NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t"}


def _tokens(data: bytes) -> Iterator[tuple[str, str]]:
    """('{' or '}', '') and ('text', value). An escape stands for a line end, a return, a tab, or else for its own character."""
    at = 0
    while at < len(data):
        found = _TOKEN.match(data, at)
        if not found:
            raise Damaged("unexpected character or open quotes")
        at = found.end()
        kind = found.lastgroup
        if kind == "brace":
            yield found["brace"].decode(), ""
        elif kind:
            raw = found[kind] if kind == "bare" else _ESCAPE.sub(lambda m: _NAMED.get(m[1], m[1]), found[kind])
            if len(raw) > MAX_STRING:
                raise Damaged("text too long")
            try:
                yield "text", raw.decode()
            except UnicodeDecodeError as e:
                raise Damaged("not UTF-8") from e


def text_tree(data: bytes) -> list[tuple[str, object]]:
    """(key, value) pairs; an object's value is the list of its pairs."""
    stack: list[list] = [[]]
    key, nodes = None, 0
    for kind, value in _tokens(data):
        if kind == "}":
            if len(stack) == 1 or key is not None:
                raise Damaged("unbalanced")
            stack.pop()
            continue
        if key is None:
            if kind != "text":
                raise Damaged("object without a name")
            key = value
            continue
        nodes += 1
        stack[-1].append((key, [] if kind == "{" else value))
        if kind == "{":
            stack.append(stack[-1][-1][1])
        if nodes > MAX_TEXT_NODES or len(stack) > MAX_DEPTH + 1:
            raise Damaged("too large")
        key = None
    if len(stack) != 1 or key is not None:
        raise Damaged("cut short")
    return stack[0]


def _named(pairs, name: str) -> Iterator:
    return (v for k, v in pairs if k.lower() == name)


def folder_path(value: str) -> str | None:
    """A library folder in its shortest form; None unless it is absolute and takes no step upwards."""
    value = value.strip()
    if not value or ".." in re.split(r"[/\\]", value):
        return None
    if value.startswith("/"):
        return "/" + posixpath.normpath(value).lstrip("/")
    return ntpath.normpath(value) if re.match(r"[A-Za-z]:[/\\]", value) else None


def library_folders(data: bytes) -> list[str]:
    """The folders of all library lists, each once; entries are folders or objects with a path, names in any case."""
    entries = [v for own in _named(text_tree(data), "libraryfolders") if isinstance(own, list) for _, v in own]
    stated = [p for v in entries for p in ([v] if isinstance(v, str) else _named(v, "path")) if isinstance(p, str)]
    return list(dict.fromkeys(filter(None, map(folder_path, stated))))


def app_manifest(data: bytes) -> tuple[int, str] | None:
    """(app id, name) of the first state; of fields that repeat the last counts."""
    own = next(_named(text_tree(data), "appstate"), None)
    last = lambda name: next(iter([v for v in _named(own, name) if isinstance(v, str)][-1:]), "").strip()
    app, name = (last("appid"), last("name")) if isinstance(own, list) else ("", "")
    return (int(app), name) if re.fullmatch("[0-9]+", app) and int(app) < 2**32 and name else None


# ---- game lists ----------------------------------------------------------------------------------------------------
def gamelist(data: bytes) -> list[tuple[str, str]]:
    """(raw stem, name) of each game; strict: own entities, depth, size and a cut end are errors."""
    if len(data) > 4 << 20:
        raise Damaged("too large")
    out: list[tuple[str, str]] = []
    stack: list[str] = []
    now: dict[str, str] = {}
    p = xml.parsers.expat.ParserCreate()

    def start(name, _):
        stack.append(name)
        if len(stack) > 32:
            raise Damaged("too deep")
        if name == "game":
            now.clear()

    def text(value):
        if len(stack) >= 2 and stack[-2] == "game" and stack[-1] in ("path", "name"):
            now[stack[-1]] = now.get(stack[-1], "") + value
            if len(now[stack[-1]]) > MAX_TEXT:
                raise Damaged("text too long")

    def end(name):
        stack.pop()
        if name == "game":
            path = now.get("path", "").strip().replace("\\", "/").rsplit("/", 1)[-1]
            stem = path.rsplit(".", 1)[0] if "." in path.lstrip(".") else path
            if stem and now.get("name", "").strip():
                out.append((stem, now["name"].strip()))
            if len(out) > MAX_ENTRIES:
                raise Damaged("too many entries")

    def entity(*_):
        raise Damaged("own entities")

    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler, p.EntityDeclHandler = start, end, text, entity
    try:
        p.Parse(data, True)
    except xml.parsers.expat.ExpatError as e:
        raise Damaged(str(e)) from e
    return out


# ---- BSON and the paged library ------------------------------------------------------------------------------------
def guid_text(raw: bytes) -> str:
    return str(uuid.UUID(bytes_le=raw))


def bson(data: bytes, depth: int = 0) -> list[tuple[str, object]]:
    """The pairs of a document; kinds that nothing needs are stepped over."""
    if depth > MAX_DEPTH or len(data) < 5 or len(data) > 16 << 20 or struct.unpack_from("<i", data)[0] != len(data) or data[-1]:
        raise Damaged("document")
    r, out = _Bytes(data, 4, len(data) - 1), []
    skip = {0x01: 8, 0x07: 12, 0x11: 8, 0x13: 16, 0xFF: 0, 0x7F: 0, 0x06: 0}
    while r.at < r.end:
        tag, key = r.number("B"), r.text()
        if tag == 0x02:
            value = r.take(r.number("i"))
            if not value or value[-1]:
                raise Damaged("text")
            out.append((key, value[:-1].decode("utf-8", "replace")))
        elif tag in (0x03, 0x04):
            size = struct.unpack_from("<i", r.take(4))[0]
            r.at -= 4
            pairs = bson(r.take(size), depth + 1)
            out.append((key, pairs if tag == 0x03 else [v for _, v in pairs]))
        elif tag == 0x05:
            size, kind = r.number("i"), r.number("B")
            raw = r.take(size)
            out.append((key, guid_text(raw) if kind in (3, 4) and size == 16 else raw))
        elif tag == 0x08:
            out.append((key, bool(r.number("B"))))
        elif tag in (0x09, 0x12):
            out.append((key, r.number("q")))
        elif tag == 0x0A:
            out.append((key, None))
        elif tag == 0x10:
            out.append((key, r.number("i")))
        elif tag == 0x0B:
            r.text(), r.text()
        elif tag in (0x0D, 0x0E):
            r.take(r.number("i"))
        elif tag in skip:
            r.take(skip[tag])
        else:
            raise Damaged(f"unknown kind {tag}")
        if len(out) > 100_000:
            raise Damaged("too many elements")
    return out


def library_game(data: bytes) -> dict | None:
    """A library document as a game row; None if it lacks an id or name or states a field twice."""
    try:
        pairs = bson(data)
    except (Damaged, struct.error):
        return None
    fields = dict(pairs)
    if len(fields) != len(pairs) or not isinstance(fields.get("_id"), str) or not isinstance(fields.get("Name"), str):
        return None
    ids = fields.get("PlatformIds") or []
    return {
        "guid": fields["_id"], "name": fields["Name"], "game_id": fields.get("GameId") or "", "plugin": fields.get("PluginId") or "",
        "platform_ids": sorted(x for x in ids if isinstance(x, str)), "hidden": bool(fields.get("Hidden")),
        "media": sorted(str(fields[k]) for k in ("Icon", "CoverImage", "BackgroundImage") if fields.get(k)),
    }


# ---- rows ----------------------------------------------------------------------------------------------------------
def _rows(kind: str, path: str, data: bytes) -> Iterator[tuple]:
    try:
        if kind in ("appinfo", "shortcuts"):
            titles, skipped = (app_info if kind == "appinfo" else shortcuts)(data)
            yield from ((path, app, title, "ok") for app, title in titles.items())
            if skipped:
                yield path, skipped, "", "skipped"
        elif kind == "manifest":
            got = app_manifest(data)
            yield (path, *got, "ok") if got else (path, 1, "", "skipped")
        elif kind == "folders":
            yield from ((path, k, p, "ok") for k, p in enumerate(library_folders(data)))
        elif kind == "gamelist":
            yield from ((path, k, f"{stem}\t{name}", "ok") for k, (stem, name) in enumerate(gamelist(data)))
        elif kind == "library":
            from .paged import read_library

            status, games, skipped = read_library(data)
            yield from ((path, k, f"{g['guid']}\t{g['name']}", "ok") for k, g in enumerate(games))
            if skipped or status != "ok":
                yield path, skipped, "", "skipped" if skipped else status
        elif kind == "bson":
            game = library_game(data)
            yield (path, 0, f"{game['guid']}\t{game['name']}", "ok") if game else (path, 1, "", "skipped")
    except (Damaged, struct.error) as e:
        yield path, 0, str(e), "unsupported"


class _Parse:
    def eval(self, kind: str, path: str, data: bytes):
        yield from _rows(kind, path, bytes(data))


def parse(files: DataFrame, kind: str) -> DataFrame:
    """(path, number, text, status) of ``files`` (path, content): appinfo, shortcuts, manifest, folders, gamelist, library or bson."""
    spark = files.sparkSession
    spark.udtf.register("parse_catalog_file", udtf(_Parse, returnType="path string, number long, text string, status string"))
    return spark.sql("SELECT t.* FROM {files} f, LATERAL parse_catalog_file({kind}, f.path, f.content) t", files=files, kind=kind)
