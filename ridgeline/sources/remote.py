"""Calls to the outside: credentials, a probe, catalog pages and downloads."""

from __future__ import annotations

import base64
import json
import os
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path


def credentials(*names: str) -> tuple[str, ...]:
    """Values of environment variables; an error lists all that are missing or empty, and no values."""
    missing = [n for n in names if not os.environ.get(n)]
    if missing:
        raise RuntimeError(f"Missing required environment variable(s): {', '.join(missing)}")
    return tuple(os.environ[n] for n in names)


def _request(url: str, user: str, password: str, **headers: str) -> urllib.request.Request:
    token = base64.b64encode(f"{user}:{password}".encode()).decode()
    return urllib.request.Request(url, headers={"Authorization": f"Basic {token}", **headers})


def probe(url: str, user: str, password: str, opener: Callable = urllib.request.urlopen) -> tuple[int, int | None]:
    """(status, length) of the first byte of a file; any status but 200 and 206 is an error that names it."""
    try:
        with opener(_request(url, user, password, Range="bytes=0-0"), timeout=30) as r:
            status, length = r.status, r.headers.get("Content-Length")
    except urllib.error.HTTPError as e:
        raise RuntimeError(f"access failed with status {e.code}") from e
    if status not in (200, 206):
        raise RuntimeError(f"access failed with status {status}")
    return status, None if length is None else int(length)


def pages(url: str, opener: Callable = urllib.request.urlopen) -> Iterator[dict]:
    """A catalog's pages from the first on, as linked."""
    while url:
        with opener(url) as r:
            page = json.load(r)
        yield page
        url = next((x["href"] for x in page.get("links", []) if x.get("rel") == "next"), None)


def _private(folder: str, url: str) -> tuple[Path, Path]:
    """(the name that all share, one of this attempt alone) of a file of the cache."""
    target = Path(folder) / urllib.request.url2pathname(url.split("?")[0].split("#")[0].rstrip("/").rsplit("/", 1)[-1])
    target.parent.mkdir(parents=True, exist_ok=True)
    return target, target.with_name(f".{target.name}.{uuid.uuid4().hex}.part")


def _fetch(url: str, size: int, part: Path, name: str, user: str, password: str, opener: Callable, mbps: float | None = None) -> None:
    began, done = time.monotonic(), 0
    with opener(_request(url, user, password)) as r, part.open("wb") as out:
        while block := r.read(1 << 20):
            out.write(block)
            done += len(block)
            if mbps:
                time.sleep(max(0.0, done * 8 / (mbps * 1e6) - (time.monotonic() - began)))
    if done != size:
        raise RuntimeError(f"{name} has {done} bytes instead of {size}")


def download(url: str, size: int, folder: str, user: str, password: str, opener: Callable = urllib.request.urlopen) -> Path:
    """A file of the exact size under its own name; one that is there already is kept. It appears as a whole or not at all, whoever else fetches it."""
    target, part = _private(folder, url)
    if target.exists() and target.stat().st_size == size:
        return target
    try:
        _fetch(url, size, part, target.name, user, password, opener)
        part.replace(target)
    finally:
        part.unlink(missing_ok=True)
    return target


def tile_bytes(
    url: str,
    size: int,
    folder: str,
    user: str,
    password: str,
    check: Callable[[bytes], object],
    keep: bool = False,
    attempts: int = 4,
    wait: float = 0.5,
    mbps: float | None = None,
    opener: Callable = urllib.request.urlopen,
) -> bytes:
    """The bytes of a file that ``check`` accepts: those in the cache, or fetched ones. Nothing that another attempt does to the cache can change them.

    Each try waits twice as long as the one before; the last failure is raised. The file is committed to the cache if ``keep`` is set.
    """
    target, part = _private(folder, url)
    for k in range(attempts):
        try:
            try:
                data = target.read_bytes()
                if len(data) == size:
                    check(data)
                    if not keep:
                        target.unlink(missing_ok=True)
                    return data
            except FileNotFoundError:
                pass
            except Exception:  # a corrupt file gives way to a new one
                target.unlink(missing_ok=True)
            _fetch(url, size, part, target.name, user, password, opener, mbps)
            data = part.read_bytes()
            check(data)
            if keep:
                part.replace(target)
            return data
        except urllib.error.HTTPError as e:
            if e.code < 500 and e.code != 429:  # asking again wouldn't help
                raise RuntimeError(f"{target.name}: access failed with status {e.code}") from e
            if k + 1 == attempts:
                raise RuntimeError(f"{target.name}: access failed with status {e.code}") from e
        except Exception:
            if k + 1 == attempts:
                raise
        finally:
            part.unlink(missing_ok=True)
        time.sleep(wait * 2**k)
    raise ValueError("attempts must be positive")
