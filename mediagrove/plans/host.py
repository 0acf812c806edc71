"""Host-side effects: deterministic JSON documents, immutable artifacts, compare-and-swap saves, verified copies, a review ledger.

These act on a small number of files of one machine and are never called by queries.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile
import threading

from ..functions.udf import digest


class Conflict(Exception):
    """What is there isn't what the caller saw."""


def _replace(path: str, data: bytes) -> None:
    os.makedirs(os.path.dirname(path) or ".", mode=0o700, exist_ok=True)
    fd, name = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def write_json(path: str, value) -> None:
    """Two-space JSON with sorted keys, by a temporary file and a rename."""
    _replace(path, (json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode())


def read_json(path: str, default=None):
    try:
        with open(path, "rb") as f:
            return json.load(f)
    except FileNotFoundError:
        if default is None:
            raise
        return default


def write_once(path: str, value) -> bool:
    """Creates an artifact; the same content again is no change (False), other content a Conflict."""
    data = (json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode()
    if os.path.exists(path):
        with open(path, "rb") as f:
            if f.read() == data:
                return False
        raise Conflict(path)
    _replace(path, data)
    return True


def save_draft(path: str, payload, base: str) -> str:
    """Saves if the current draft's digest is ``base`` ('' for none); the new digest."""
    now = read_json(path, {}).get("digest", "")
    if now != base:
        raise Conflict(path)
    new = digest(payload)
    write_json(path, {"baseDigest": base, "digest": new, "payload": payload})
    return new


def file_sha256(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()


def verify_file(path: str, expected: str) -> bool:
    return file_sha256(path).lower() == expected.lower()


def contain(base: str, path: str) -> str:
    """The place of ``path`` under ``base``; ValueError if it leaves it, also by a link."""
    out = os.path.realpath(os.path.join(base, path))
    root = os.path.realpath(base)
    if out != root and not out.startswith(root + os.sep):
        raise ValueError(path)
    return out


def copy_verified(source: str, target: str, sha256: str) -> None:
    """Copies by a temporary file that replaces the target only if its content has the digest."""
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    fd, name = tempfile.mkstemp(dir=os.path.dirname(target) or ".")
    os.close(fd)
    try:
        shutil.copyfile(source, name)
        if file_sha256(name) != sha256:
            raise Conflict(source)
        os.replace(name, target)
    finally:
        if os.path.exists(name):
            os.unlink(name)


def overlaps(a: str, b: str) -> bool:
    x, y = os.path.realpath(a), os.path.realpath(b)
    return x == y or x.startswith(y + os.sep) or y.startswith(x + os.sep)


def operation_id(kind: str, actions: list[dict]) -> str:
    order = sorted(actions, key=lambda a: tuple(a.get(k, "") for k in ("destinationRoot", "destinationPath", "sourceRoot", "sourcePath")))
    return f"{kind}-{digest(order)[:16]}"


class Ledger:
    """Reviews A, B, C in a folder: each names the one before by its id, which is a digest of its content; C never permits execution."""

    def __init__(self, folder: str):
        self.folder = folder

    def _path(self, gate: str, key: str) -> str:
        return os.path.join(self.folder, gate, f"{key}.json")

    def add(self, gate: str, record: dict, before: str = "") -> str:
        if gate not in "ABC" or (gate == "A") == bool(before):
            raise ValueError("A comes first; B and C name the review before")
        body = {**record, "gate": gate, "before": before} | ({"executable": False} if gate == "C" else {})
        if before and not self.verified("AB"["BC".index(gate)], before):
            raise Conflict(before)
        key = digest(body)[:32]
        write_once(self._path(gate, key), body)
        return key

    def verified(self, gate: str, key: str) -> bool:
        body = read_json(self._path(gate, key), {})
        return bool(body) and digest(body)[:32] == key


class Publisher:
    """Publishes approved files into a target folder with a write-ahead receipt; rolls back what still is what it published."""

    def __init__(self, target: str, state: str):
        self.target, self.state = target, state

    def publish(self, receipt: str, files: list[dict]) -> dict:
        """``files``: source, path, sha256, previous (digest seen in the plan, '' if missing)."""
        for f in files:
            at = contain(self.target, f["path"])
            if (file_sha256(at) if os.path.exists(at) else "") != f["previous"]:
                raise Conflict(f["path"])
        log = {"receipt": receipt, "state": "in-progress", "files": files}
        at = os.path.join(self.state, f"{receipt}.json")
        write_json(at, log)
        for f in files:
            place = contain(self.target, f["path"])
            if f["previous"]:
                copy_verified(place, os.path.join(self.state, receipt, f["path"]), f["previous"])
            copy_verified(f["source"], place, f["sha256"])
        log["state"] = "complete"
        write_json(at, log)
        return log

    def rollback(self, receipt: str) -> dict:
        at = os.path.join(self.state, f"{receipt}.json")
        log = read_json(at)
        log["state"] = "restoring"
        write_json(at, log)
        for f in log["files"]:
            place = contain(self.target, f["path"])
            if os.path.exists(place) and file_sha256(place) == f["sha256"]:
                if f["previous"]:
                    copy_verified(os.path.join(self.state, receipt, f["path"]), place, f["previous"])
                else:
                    os.unlink(place)
        log["state"] = "rolled-back"
        write_json(at, log)
        return log


def well_known_places(home: str, environ: dict[str, str], windows: bool) -> list[tuple]:
    """(seq, id, kind, name, path, is_dir, file_key) of the places where frontends keep artwork, for ``detect.detect``."""
    found = []
    join = os.path.join

    def add(name: str, kind: str, shown: str, path: str) -> None:
        path = os.path.normpath(path)
        key = ""
        if os.path.isdir(path):
            stat = os.stat(path)
            key = f"{stat.st_dev}:{stat.st_ino}"
        found.append((len(found), name, kind, shown, path, bool(key), key))

    def accounts(folder: str) -> None:
        names = sorted(os.listdir(folder)) if os.path.isdir(folder) else []
        for account in names:
            if account.isascii() and account.isdigit() and os.path.isdir(join(folder, account)):
                add(f"steam-{account}", "steam-grid", f"Steam custom artwork - account {account}", join(folder, account, "config", "grid"))

    if windows:
        programs = environ.get("ProgramFiles(x86)") or environ.get("ProgramFiles")
        if programs:
            accounts(join(programs, "Steam", "userdata"))
        if environ.get("APPDATA"):
            add("playnite-library", "playnite-library", "Playnite library", join(environ["APPDATA"], "Playnite", "library", "files"))
            add("playnite-extra", "playnite-extra", "Playnite ExtraMetadata", join(environ["APPDATA"], "Playnite", "ExtraMetadata"))
    else:
        accounts(join(home, ".local", "share", "Steam", "userdata"))
        accounts(join(home, ".steam", "steam", "userdata"))
        add("retrodeck-media", "esde-media", "RetroDECK / ES-DE artwork", join(home, "retrodeck", "ES-DE", "downloaded_media"))
    add("gaming-profiles-syncthing", "decky-catalog", "Deck Gaming Profiles", join(home, "Syncthing", "GamingProfiles"))
    add("gaming-profiles-home", "decky-catalog", "Deck Gaming Profiles", join(home, "GamingProfiles"))
    return found


def count_files(folder: str, most: int = 10_000) -> int:
    """Regular files below a folder, up to ``most``; what can't be read doesn't count."""
    n = 0
    for at, _, names in os.walk(folder):
        for name in names:
            path = os.path.join(at, name)
            n += os.path.isfile(path) and not os.path.islink(path)
            if n >= most:
                return n
    return n


class SingleFlight:
    """One refresh at a time, and only when the fingerprint has changed: while one runs, the value of another fingerprint is withheld."""

    def __init__(self):
        self._lock, self._running, self._print, self._value = threading.Lock(), False, None, None

    def get(self, fingerprint: str):
        with self._lock:
            return self._value if fingerprint == self._print else None

    def refresh(self, fingerprint: str, make) -> bool:
        """Whether this call did the refresh: not if it wasn't needed, or if another is under way."""
        with self._lock:
            if self._running or fingerprint == self._print:
                return False
            self._running = True
        try:
            value = make()
            with self._lock:
                self._print, self._value = fingerprint, value
            return True
        finally:
            with self._lock:
                self._running = False
