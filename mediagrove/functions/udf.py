"""What built-in functions can't express: a ratio with two decimals, canonical JSON, lexical path cleaning, sniffing."""

from __future__ import annotations

import hashlib
import json
import posixpath
import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def aspect(width: pd.Series, height: pd.Series) -> pd.Series:
    """'1.78:1': the ratio with two decimals, ties of the binary value to even; '' without both sides."""
    return pd.Series([f"{w / h:.2f}:1" if w and h and w >= 1 and h >= 1 else "" for w, h in zip(width, height, strict=True)])


def canonical_json(value) -> str:
    """Keys of maps sorted, no spaces, and <, >, & and line separators escaped."""
    text = json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=isinstance(value, dict))
    for c in "<>&  ":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return text


def digest(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def clean_path(path: str) -> str:
    """Lexical cleaning: single slashes, no '.' and no inner '..'; '.' for nothing."""
    out = posixpath.normpath(path) if path else "."
    return "/" + out.lstrip("/") if path.startswith("/") else out


@F.pandas_udf(StringType())
def cleaned(path: pd.Series) -> pd.Series:
    return path.map(lambda p: None if p is None else clean_path(p))


def strict_json(text: str, fields: set[str]):
    """A JSON object without unknown fields and without anything after it; ValueError otherwise."""
    value = json.loads(text)
    if not isinstance(value, dict) or set(value) - fields:
        raise ValueError("unknown fields")
    return value


def sniff(head: bytes, ext: str = "") -> str:
    """The MIME type of a file's first 512 bytes, by magic numbers; text and unknown binary by their bytes."""
    if head.startswith(b"%PDF-"):
        return "application/pdf"
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        return "image/webp"
    if len(head) >= 12 and head[4:8] == b"ftyp":
        return "video/mp4"
    if head[:4] == b"\0\0\1\0":
        return "image/x-icon"
    for magic, kind in ((b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF87a", "image/gif"), (b"GIF89a", "image/gif"), (b"BM", "image/bmp"), (b"\x1aE\xdf\xa3", "video/webm")):
        if head.startswith(magic):
            return kind
    if any(c < 9 or 13 < c < 27 or 27 < c < 32 or c == 11 for c in head):
        return {"mkv": "video/x-matroska", "webm": "video/webm"}.get(ext, "application/octet-stream")
    if head.startswith((b"\xfe\xff", b"\xff\xfe")):
        return "text/plain; charset=utf-16be" if head[0] == 0xFE else "text/plain; charset=utf-16le"
    low = head.lstrip(b"\t\n\x0c\r ").lower()
    if low.startswith((b"<!doctype html", b"<html", b"<head", b"<script", b"<body", b"<title", b"<div", b"<p>", b"<!--")):
        return "text/html; charset=utf-8"
    return "text/xml; charset=utf-8" if low.startswith(b"<?xml") else "text/plain; charset=utf-8"


def image_size(data: bytes) -> tuple[int, int]:
    """(width, height) from the header of a PNG, JPEG, GIF, BMP, WebP or ICO file; (0, 0) if it can't be read."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR":
            return struct.unpack(">II", data[16:24])
        if data[:4] in (b"GIF8",):
            return struct.unpack("<HH", data[6:10])
        if data[:2] == b"BM":
            w, h = struct.unpack("<ii", data[18:26])
            return w, abs(h)
        if data[:4] == b"\0\0\1\0":
            w, h = max(((data[6 + 16 * k] or 256, data[7 + 16 * k] or 256) for k in range(struct.unpack("<H", data[4:6])[0])), default=(0, 0))
            return w, h
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            if data[12:16] == b"VP8X":
                return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
            if data[12:16] == b"VP8L":
                bits = int.from_bytes(data[21:25], "little")
                return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
            w, h = struct.unpack("<HH", data[26:30])
            return w & 0x3FFF, h & 0x3FFF
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(data):
                kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
                if kind in range(0xC0, 0xD0) and kind not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                    return w, h
                at += 2 + size
    except (struct.error, IndexError):
        pass
    return 0, 0
