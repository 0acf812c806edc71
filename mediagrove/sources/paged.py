"""The library file: a paged document database, file version 7, read offline and never locked or written.

Pages are decoded once into items by slot; the primary index is a linked list of keys from its head to its tail. A file is a
complete snapshot or a status: unsupported, encrypted, recovering, journal, corrupt. Documents that can't be read are skipped and counted.
"""

from __future__ import annotations

import struct
from functools import lru_cache

from .formats import Damaged, guid_text, library_game

PAGE, HEAD, NONE = 4096, 25, 0xFFFFFFFF
SIGNATURE, VERSION = b"** This is a LiteDB file **", 7
COLLECTION, INDEX, DATA, EXTEND = 2, 3, 4, 5
MOST_PAGES, MOST_GAMES, MOST_DOCUMENT = 1 << 20, 100_000, 16 << 20


class Status(Damaged):
    """A file that isn't a snapshot; the argument is its status."""


def _header(data: bytes) -> int:
    """The games collection's page."""
    if len(data) < PAGE:
        raise Status("corrupt")
    if data[HEAD : HEAD + len(SIGNATURE)] != SIGNATURE or data[52] != VERSION:
        raise Status("unsupported")
    if data[:4] != b"\0\0\0\0" or data[4] != 1 or any(data[17:25]):
        raise Status("corrupt")
    if any(data[65:85]):
        raise Status("encrypted")
    if data[PAGE - 1]:
        raise Status("recovering")
    last = struct.unpack_from("<I", data, 59)[0]
    if last >= MOST_PAGES or (last + 1) * PAGE > len(data):
        raise Status("corrupt")
    if (last + 1) * PAGE < len(data):
        raise Status("journal")
    at, found = 102, []
    for _ in range(data[101]):
        size = struct.unpack_from("<I", data, at)[0]
        if at + 8 + size > PAGE:
            raise Status("corrupt")
        name = data[at + 4 : at + 4 + size].lower()
        if name in (b"game", b"games"):
            found.append(struct.unpack_from("<I", data, at + 4 + size)[0])
        at += 8 + size
    if len(found) != 1:
        raise Status("corrupt" if found else "unsupported")
    return found[0]


class Library:
    def __init__(self, data: bytes):
        self.data = data
        self.start = _header(data)
        self.items = lru_cache(None)(self._items)

    def page(self, number: int, kind: int) -> tuple[bytes, int, int]:
        """(the page, the page after it, its item count)."""
        raw = self.data[number * PAGE : (number + 1) * PAGE]
        if len(raw) < PAGE or struct.unpack_from("<I", raw)[0] != number or raw[4] != kind or any(raw[17:25]):
            raise Status("corrupt")
        return raw, *struct.unpack_from("<IH", raw, 9)

    def _items(self, number: int, kind: int) -> dict[int, tuple]:
        """Index items: slot -> (key, data address, next address); data items: slot -> (overflow page, bytes)."""
        raw, _, count = self.page(number, kind)
        out, at = {}, HEAD
        for _ in range(count):
            if kind == INDEX:
                slot, levels, _, _, _, size, form = struct.unpack_from("<HBB6s6sHB", raw, at)
                at += 19
                if not 1 <= levels <= 32 or at + size + 6 + 12 * levels > PAGE:
                    raise Status("corrupt")
                key = guid_text(raw[at : at + size]) if form == 11 and size == 16 else "" if form in (0, 14) else None
                if key is None:
                    raise Status("corrupt")
                data, after = struct.unpack_from("<IH", raw, at + size), struct.unpack_from("<IH", raw, at + size + 12)
                out.setdefault(slot, (key, data, after))
                at += size + 6 + 12 * levels
            else:
                slot, more, size = struct.unpack_from("<HIH", raw, at)
                at += 8
                if at + size > PAGE:
                    raise Status("corrupt")
                out.setdefault(slot, (more, raw[at : at + size]))
                at += size
        return out

    def item(self, address: tuple[int, int], kind: int) -> tuple:
        found = self.items(address[0], kind).get(address[1])
        if found is None:
            raise Status("corrupt")
        return found

    def ends(self) -> tuple[tuple[int, int], tuple[int, int]]:
        """Head and tail of the primary index."""
        raw, _, _ = self.page(self.start, COLLECTION)
        size = struct.unpack_from("<I", raw, HEAD)[0]
        if size > PAGE or raw[HEAD + 4 : HEAD + 4 + size].lower() not in (b"game", b"games"):
            raise Status("corrupt")
        at = HEAD + 4 + size + 12
        size = struct.unpack_from("<I", raw, at)[0]
        field = raw[at + 4 : at + 4 + size].split(b"=")[0]
        at += 4 + size
        if field != b"_id" or not raw[at]:
            raise Status("corrupt")
        return struct.unpack_from("<IH", raw, at + 1), struct.unpack_from("<IH", raw, at + 7)

    def document(self, address: tuple[int, int]) -> bytes:
        more, inline = self.item(address, DATA)
        if more == NONE:
            return inline
        parts, seen = [], set()
        while more != NONE:
            if more in seen or len(seen) * PAGE > MOST_DOCUMENT:
                raise Status("corrupt")
            seen.add(more)
            raw, after, size = self.page(more, EXTEND)
            if size > PAGE - HEAD:
                raise Status("corrupt")
            parts.append(raw[HEAD : HEAD + size])
            more = after
        return b"".join(parts)

    def games(self) -> tuple[list[dict], int]:
        head, tail = self.ends()
        at, seen, rows, skipped = self.item(head, INDEX)[2], set(), {}, 0
        self.item(tail, INDEX)
        while at != tail:
            if at in seen or len(seen) >= MOST_GAMES:
                raise Status("corrupt")
            seen.add(at)
            key, data, after = self.item(at, INDEX)
            if not key or key in rows:
                raise Status("corrupt")
            try:
                rows[key] = library_game(self.document(data))
            except (Damaged, struct.error):
                rows[key] = None
            if rows[key] is None:
                skipped += 1
            elif rows[key]["guid"] != key:
                raise Status("corrupt")
            at = after
        return sorted((g for g in rows.values() if g), key=lambda g: (g["name"].lower(), g["guid"])), skipped


def read_library(data: bytes) -> tuple[str, list[dict], int]:
    """(status, games by name and id, skipped documents); no games unless the status is ok."""
    try:
        return "ok", *Library(data).games()
    except Status as e:
        return str(e), [], 0
    except (Damaged, struct.error, IndexError):
        return "corrupt", [], 0
