"""Telephony audio columns: byte payloads stored as mu-law, A-law or IMA ADPCM WAV files, decoded and resampled.

mu-law and A-law expand by 256-entry lookup tables made from the G.711 rules. ADPCM blocks are independent, so
numpy decodes the k-th nibble of all blocks of a batch at once. Resampling is integer linear interpolation, so
results are the same on every machine.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import spread
from .kernel import flat, slices

UNIT, RATE, TO_RATE, OUT_BYTES, RUN = 64, 8000, 16000, 4 << 20, 1 << 18
CODES = {"mulaw": 7, "alaw": 6, "adpcm": 0x11, "pcm": 1}
NAMES = ("mulaw", "alaw", "adpcm")

# Fixed values of the IMA ADPCM format: the step sizes, and how a nibble's magnitude moves the step index.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143,
    157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552,
    1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
    12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def _mulaw() -> np.ndarray:
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((u & 15) << 3) + 132) << (u >> 4 & 7)) - 132
    return np.where(u & 128, -size, size).astype("<i2")


def _alaw() -> np.ndarray:
    a = np.arange(256, dtype=np.int32) ^ 0x55
    part, low = a >> 4 & 7, (a & 15) << 4
    size = np.where(part == 0, low + 8, (low + 264) << np.maximum(part - 1, 0))
    return np.where(a & 128, size, -size).astype("<i2")


TABLES = {"mulaw": _mulaw(), "alaw": _alaw()}


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples of mono IMA ADPCM blocks (uint8, one row a block): 1 + 2 * (bytes - 4) a block, all blocks in step.

    A step index beyond the table is the last one, as players treat it.
    """
    n, width = blocks.shape
    out = np.empty((n, 1 + 2 * (width - 4)), "<i2")
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    out[:, 0] = value
    body = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(2 * (width - 4)):
        nibble = (body[k >> 1] >> (4 * (k & 1))) & 15
        step = STEPS[index]
        change = (step >> 3) + ((nibble >> 2 & 1) * step) + ((nibble >> 1 & 1) * (step >> 1)) + ((nibble & 1) * (step >> 2))
        value = np.clip(np.where(nibble & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + MOVES[nibble], 0, len(STEPS) - 1)
        out[:, k + 1] = value
    return out


def resample(pcm: np.ndarray, rate: int, to_rate: int) -> np.ndarray:
    """Linear interpolation at multiples of rate / to_rate, in integers, rounded down."""
    if not len(pcm) or rate == to_rate:
        return pcm.astype("<i2")
    if to_rate == 2 * rate:  # the same rule without divisions
        x = pcm.astype(np.int32)
        out = np.empty(2 * len(x), "<i2")
        out[::2], out[1:-1:2], out[-1] = x, (x[:-1] + x[1:]) >> 1, x[-1]
        return out
    at = np.arange(-(-len(pcm) * to_rate // rate), dtype=np.int64) * rate
    k, rest = at // to_rate, at % to_rate
    x = pcm.astype(np.int64)
    return ((x[k] * (to_rate - rest) + x[np.minimum(k + 1, len(x) - 1)] * rest) // to_rate).astype("<i2")


def wav(codec: str, payload: bytes, rate: int = RATE) -> bytes:
    """A WAV file whose data chunk is the payload as it is (padded to an even length by the container)."""
    bits, block, more = {"pcm": (16, 2, b""), "adpcm": (4, UNIT, struct.pack("<HH", 2, 1 + 2 * (UNIT - 4)))}.get(codec, (8, 1, struct.pack("<H", 0)))
    per_s = {"pcm": 2 * rate, "adpcm": rate * UNIT // (1 + 2 * (UNIT - 4))}.get(codec, rate)
    samples = {"pcm": len(payload) // 2, "adpcm": len(payload) // UNIT * (1 + 2 * (UNIT - 4))}.get(codec, len(payload))
    head = struct.pack("<HHIIHH", CODES[codec], 1, rate, per_s, block, bits) + more
    chunks = [(b"fmt ", head), *([] if codec == "pcm" else [(b"fact", struct.pack("<I", samples))]), (b"data", payload)]
    body = b"".join(name + struct.pack("<I", len(x)) + x + b"\0" * (len(x) & 1) for name, x in chunks)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def read_wav(media: bytes) -> tuple[str, int, int, bytes]:
    """(codec, rate, block size, data chunk) of a WAV file; ValueError if it isn't one that is known here."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data":
            codec = next((k for k, v in CODES.items() if form and v == form[0]), None)
            if codec is None or form[1] != 1 or at + 8 + size > len(media):
                raise ValueError("unknown format or cut short")
            return codec, form[2], form[4], media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data")


def expand(codec: str, block: int, payload: bytes) -> np.ndarray:
    """16-bit samples of a data chunk."""
    if codec == "pcm":
        return np.frombuffer(payload, "<i2")
    data = np.frombuffer(payload, np.uint8)
    return decode_adpcm(data.reshape(-1, block)).ravel() if codec == "adpcm" else TABLES[codec][data]


def payload_of(text: bytes) -> bytes:
    return text + b"\0" * (UNIT * max(1, -(-len(text) // UNIT)) - len(text))


def codec_of(payload: bytes) -> str:
    """The codec of a payload, by its checksum: equal payloads, equal codecs."""
    return NAMES[zlib.crc32(payload) % len(NAMES)]


def describe(pcm: np.ndarray) -> str:
    """Samples, peak, root mean square in thousandths, sign changes: all from exact integers."""
    power = sum(int((part * part).sum()) for part in (pcm[k : k + RUN].astype(np.int64) for k in range(0, len(pcm), RUN)))
    peak = max(int(pcm.max(initial=0)), -int(pcm.min(initial=0)))
    sign = pcm >= 0
    return f"n={len(pcm)};peak={peak};rms={int(1000 * (power / max(1, len(pcm))) ** 0.5)};zc={int((sign[1:] != sign[:-1]).sum())}"


def store_audio(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", codec: str | None = None, to_rate: int = TO_RATE, keep_media: bool = True) -> DataFrame:
    """Stores each text's bytes as a telephony WAV file, reads that back, and stores its resampled PCM.

    One row an input row: ``id_col``, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature (codec; statistics of the expanded samples; sha256 of the resampled 16-bit PCM), and with ``keep_media`` the files:
    media (the coded WAV) and pcm (the resampled WAV). Null texts are empty; an empty text is 64 zero bytes; ids may
    be null or repeat; other columns aren't read. ``codec``: mulaw, alaw or adpcm, by the payload's checksum if None. The payload
    is padded with zeros to a positive multiple of 64, which is also the ADPCM block.
    """
    rows = spread(df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text")))
    kind = rows.schema["id"].dataType.simpleString()
    fields = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary, pcm binary" * keep_media

    def one(text: bytes, stored: str, media: bytes, pcm: np.ndarray, payload: bytes) -> tuple:
        out = resample(pcm, RATE, to_rate)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        row = (len(text), len(payload), sha(payload), zlib.crc32(payload[-UNIT:]), len(media), sha(media), f"{stored};{describe(pcm)};pcm={sha(out.tobytes())}")
        return row + (media, wav("pcm", out.tobytes(), to_rate)) * keep_media

    names = ["id", *(f.split()[0] for f in fields.split(", "))]

    def run(batches):
        for batch in batches:
            data, ends = flat(batch.column(1))
            for a, b in slices(ends, OUT_BYTES // 8):  # a byte becomes up to eight
                blocks, waiting, done = [], [], [()] * (b - a)
                for k in range(a, b):
                    text = data[ends[k] : ends[k + 1]].tobytes()
                    payload = payload_of(text)
                    media = wav(codec or codec_of(payload), payload)
                    stored, _, block, back = read_wav(media)
                    if stored == "adpcm":
                        blocks.append(np.frombuffer(back, np.uint8).reshape(-1, block))
                        waiting.append((k - a, text, media, back))
                    else:
                        done[k - a] = one(text, stored, media, expand(stored, block, back), back)
                if blocks:
                    samples, at = decode_adpcm(np.concatenate(blocks)), 0
                    for x, (k, text, media, back) in zip(blocks, waiting, strict=True):
                        done[k] = one(text, "adpcm", media, samples[at : at + len(x)].ravel(), back)
                        at += len(x)
                columns = [pa.array(c) for c in zip(*done, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], names)

    return rows.mapInArrow(run, f"id {kind}, {fields}").withColumnRenamed("id", id_col)
