"""Sources of bytes with a known length: files, memory, HTTP in ranges or whole, and a caching wrapper."""

from __future__ import annotations

import os
import threading
import time
import urllib.error
import urllib.request
from collections import OrderedDict
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Protocol

from ..functions.hashing import fnv1a


class SourceError(OSError):
    """A source that can't be read; status is HTTP's where there is one."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


class ByteSource(Protocol):
    def count(self) -> int: ...
    def get_bytes(self, offset: int, size: int) -> bytes: ...
    def close(self) -> None: ...


class FileSource:
    """A local file by path, or bytes in memory. Reads of memory end at its end; a file that is too short is an error."""

    def __init__(self, source: str | os.PathLike | bytes | bytearray | memoryview):
        self._data = memoryview(source) if isinstance(source, (bytes, bytearray, memoryview)) else None
        self._path = None if self._data is not None else os.fspath(source)
        self._file = None

    def count(self) -> int:
        return len(self._data) if self._data is not None else os.stat(self._path).st_size

    def get_bytes(self, offset: int, size: int) -> bytes:
        if self._data is not None:
            return bytes(self._data[offset : offset + size])
        if self._file is None:
            self._file = open(self._path, "rb")  # noqa: SIM115
        if len(found := os.pread(self._file.fileno(), size, offset)) != size:
            raise SourceError(f"{self._path} ends before {offset + size}")
        return found

    def close(self) -> None:
        if self._file:
            self._file.close()
            self._file = None


def retrying(call: Callable[[], object], attempts: int = 3, base: float = 0.5, most: float = 5.0, sleep=time.sleep):
    """The call's result; server errors (5xx), time-outs and network errors are tried again after a doubling delay."""
    if attempts < 1:
        raise ValueError("at least one attempt")
    for attempt in range(attempts):
        try:
            return call()
        except (OSError, TimeoutError) as e:
            code = getattr(e, "code", getattr(e, "status", None))
            if attempt + 1 == attempts or code is not None and code < 500:
                raise
            sleep(min(base * 2**attempt, most))
    return None


class HttpSource:
    """A remote file read in ranges. With validate, a file that changed since it was opened is an error."""

    def __init__(self, url: str, validate: bool = True, timeout: float = 30.0, attempts: int = 1, opener=urllib.request.urlopen):
        self.url, self.validate, self.timeout, self.attempts, self._open = url, validate, timeout, attempts, opener
        self._meta: tuple[int, str | None, str | None] | None = None

    def _request(self, method: str, headers: dict[str, str]):
        def call():
            return self._open(urllib.request.Request(self.url, method=method, headers=headers), timeout=self.timeout)

        try:
            return retrying(call, self.attempts)
        except urllib.error.HTTPError as e:
            raise SourceError(f"File not found: {self.url}" if e.code == 404 else f"HTTP status {e.code}: {self.url}", e.code) from e

    def metadata(self) -> tuple[int, str | None, str | None]:
        """Length, ETag and time of the last change."""
        if self._meta is None:
            with self._request("HEAD", {}) as reply:
                if (length := reply.headers.get("Content-Length")) is None:
                    raise SourceError(f"no Content-Length: {self.url}")
                self._meta = int(length), reply.headers.get("ETag"), reply.headers.get("Last-Modified")
        return self._meta

    def count(self) -> int:
        return self.metadata()[0]

    def get_bytes(self, offset: int, size: int) -> bytes:
        length, etag, changed = self.metadata()
        if offset < 0 or size <= 0 or offset + size > length:
            raise SourceError(f"[{offset}, {offset + size}) is outside of the file's {length} bytes")
        headers = {"Range": f"bytes={offset}-{offset + size - 1}"}
        if self.validate:
            headers |= {k: v for k, v in (("If-Match", etag), ("If-Unmodified-Since", changed)) if v}
        with self._request("GET", headers) as reply:
            data = reply.read()
            if reply.status == 200 and len(data) == length:  # the server knows no ranges
                data = data[offset : offset + size]
        if len(data) != size:
            raise SourceError(f"{len(data)} bytes came instead of {size}")
        return data

    def key(self) -> int:
        """A number for this version of the file: of its url, ETag (if validated) and time."""
        _, etag, changed = self.metadata()
        return fnv1a(self.url) ^ (fnv1a(etag) if self.validate and etag else 0) ^ (fnv1a(changed) if changed else 0)

    def cached(self, cache: BlockCache) -> BlockCachedSource:
        """Read through a cache, under the kind of key that the cache takes; a text key is the url alone, for files that never change."""
        return BlockCachedSource(self, cache, self.url if getattr(cache, "key_kind", "number") == "text" else self.key())

    def close(self) -> None:
        self._meta = None


class MemoryHttpSource:
    """A remote file fetched whole, once, from the moment it is made; files above the limit are refused."""

    def __init__(self, url: str, max_bytes: int = 200 * 1024 * 1024, progress: Callable[[int, int], None] | None = None, opener=urllib.request.urlopen):
        self.url, self.max_bytes, self._progress, self._open = url, max_bytes, progress, opener
        self._pool = ThreadPoolExecutor(1)
        self._length: int | None = None
        self._data = self._pool.submit(self._fetch)

    def _size(self) -> int:
        if self._length is None:
            with self._open(urllib.request.Request(self.url, method="HEAD")) as reply:
                if (n := reply.headers.get("Content-Length")) is None:
                    raise SourceError(f"no Content-Length: {self.url}")
            if int(n) > self.max_bytes:
                raise SourceError(f"{n} bytes are over the limit of {self.max_bytes}")
            self._length = int(n)
        return self._length

    def _fetch(self) -> bytes:
        total, out, told = self._size(), bytearray(), 0.0
        with self._open(urllib.request.Request(self.url)) as reply:
            while part := reply.read(1 << 16):
                out += part
                if self._progress and time.monotonic() - told >= 0.1:
                    told = time.monotonic()
                    self._progress(len(out), total)
        if self._progress:
            self._progress(len(out), total)
        return bytes(out)

    def count(self) -> int:
        return self._size()

    def get_bytes(self, offset: int, size: int) -> bytes:
        try:
            data = self._data.result()
        except Exception as e:
            raise SourceError(f"loading {self.url} failed: {e}") from e
        if offset < 0 or size < 0 or offset + size > len(data):
            raise SourceError(f"[{offset}, {offset + size}) is outside of the file's {len(data)} bytes")
        return data[offset : offset + size]

    @property
    def loaded(self) -> bool:
        return self._data.done() and not self._data.cancelled() and self._data.exception() is None

    def data(self) -> bytes | None:
        return self._data.result() if self.loaded else None

    def reload(self) -> None:
        self._length = None
        self._data = self._pool.submit(self._fetch)

    def close(self) -> None:
        self._data = Future()
        self._data.set_exception(SourceError("closed"))
        self._pool.shutdown(wait=False)


class BlockCache(Protocol):
    block_size: int

    def get(self, key, fetch: Callable[[], bytes]) -> bytes: ...
    def prefetch(self, key, fetch: Callable[[], bytes]) -> None: ...
    def size(self, key) -> int | None: ...
    def clear(self) -> None: ...


class LruBlockCache:
    """Blocks in memory; the least recently used go. Threads that miss the same block share one fetch."""

    key_kind = "number"

    def __init__(self, block_size: int = 64 * 1024, max_blocks: int = 256):
        self.block_size, self.max_blocks = block_size, max(1, max_blocks)
        self._held: OrderedDict = OrderedDict()
        self._flying: dict = {}
        self._lock = threading.Lock()
        self.hits = self.misses = 0

    def get(self, key, fetch):
        with self._lock:
            if key in self._held:
                self._held.move_to_end(key)
                self.hits += 1
                return self._held[key]
            self.misses += 1
            mine = key not in self._flying
            flight = self._flying.setdefault(key, Future())
        if not mine:
            return flight.result()
        try:
            data = self._load(key, fetch)
        except BaseException as e:
            with self._lock:
                del self._flying[key]
            flight.set_exception(e)
            raise
        with self._lock:
            del self._flying[key]
            self._held[key] = data
            while len(self._held) > self.max_blocks:
                self._held.popitem(last=False)
        flight.set_result(data)
        return data

    def _load(self, key, fetch) -> bytes:
        return fetch()

    def prefetch(self, key, fetch) -> None:
        if key not in self._held:
            try:
                self.get(key, fetch)
            except OSError:
                pass  # a later get asks again and reports

    def size(self, key) -> None:
        return None

    def clear(self) -> None:
        with self._lock:
            self._held.clear()


class DiskBlockCache(LruBlockCache):
    """As LruBlockCache, with a second tier of files; above max_bytes the oldest files go until a fraction is free.

    Blocks in memory that nobody asked for during `ttl` seconds go. At most `fetches` loads from the source
    run at once, first come, first served. Each file begins with the length of the block's source, if
    that is known, so the source's size can be told without asking it.
    """

    key_kind = "text"

    def __init__(self, folder: str, block_size: int = 64 * 1024, max_blocks: int = 256, max_bytes: int = 1 << 30, fraction: float = 0.1, ttl: float = 1.0, fetches: int = 10, clock=time.monotonic):
        super().__init__(block_size, max_blocks)
        self.folder, self.max_bytes, self.fraction, self.ttl, self._clock = folder, max_bytes, fraction, ttl, clock
        self._used: dict = {}
        self._slots = threading.BoundedSemaphore(max(1, fetches))
        self.loading = self.waiting = 0
        os.makedirs(folder, exist_ok=True)

    def _path(self, key) -> str:
        return os.path.join(self.folder, f"{fnv1a(str(key)):016x}")

    def _expire(self, key) -> None:
        now = self._clock()
        with self._lock:
            for old in [k for k, t in self._used.items() if now - t > self.ttl]:
                self._held.pop(old, None)
                del self._used[old]
            self._used[key] = now

    def get(self, key, fetch, total: int | None = None):
        self._expire(key)
        return super().get(key, lambda: (fetch(), total))

    def _load(self, key, fetch) -> bytes:
        try:
            with open(self._path(key), "rb") as f:
                return f.read()[8:]
        except FileNotFoundError:
            pass
        with self._lock:
            self.waiting += 1
        with self._slots:
            with self._lock:
                self.waiting, self.loading = self.waiting - 1, self.loading + 1
            try:
                data, total = fetch()
            finally:
                with self._lock:
                    self.loading -= 1
        with open(part := f"{self._path(key)}.{threading.get_ident()}.part", "wb") as f:
            f.write((-1 if total is None else total).to_bytes(8, "little", signed=True) + data)
        os.replace(part, self._path(key))
        self._evict()
        return data

    def size(self, key) -> int | None:
        """The length of the source that this block belongs to, if a file says so."""
        try:
            with open(self._path(key), "rb") as f:
                found = int.from_bytes(f.read(8), "little", signed=True)
        except FileNotFoundError:
            return None
        return None if found < 0 else found

    def entries(self) -> list[tuple[str, int, float]]:
        """Path, size and time of each file, the oldest first."""
        found = [(e.path, e.stat()) for e in os.scandir(self.folder) if not e.name.endswith(".part")]
        return sorted(((p, s.st_size, s.st_mtime) for p, s in found), key=lambda x: x[2])

    def _evict(self) -> None:
        held = self.entries()
        total = sum(n for _, n, _ in held)
        if total > self.max_bytes:
            for path, n, _ in held:
                if total <= self.max_bytes * (1 - self.fraction):
                    break
                os.unlink(path)
                total -= n

    def stats(self) -> dict[str, int]:
        held = self.entries()
        """What both tiers hold and do: files and their bytes, blocks and bytes in memory, loads that run and wait, requests that share a load."""
        with self._lock:
            kept, flying = list(self._held.values()), len(self._flying)
            more = {"memory_blocks": len(kept), "memory_bytes": sum(map(len, kept)), "loading": self.loading, "waiting": self.waiting, "in_flight": flying, "hits": self.hits, "misses": self.misses}
        return {"entries": len(held), "bytes": sum(n for _, n, _ in held), "max_bytes": self.max_bytes, "block_size": self.block_size} | more

    def clear(self) -> None:
        super().clear()
        for path, *_ in self.entries():
            os.unlink(path)


class BlockCachedSource:
    """A source read in blocks that a cache holds. Blocks are counted from the end of the file; the first one is short."""

    def __init__(self, source: ByteSource, cache: BlockCache, base: int | str):
        self.source, self.cache, self.base = source, cache, base
        self._count: int | None = None

    def key(self, block: int):
        return self.base + block if isinstance(self.base, int) else f"{self.base}/block/{block}"

    def count(self) -> int:
        """Known already, or told by the cache, or asked of the source, in this order."""
        if self._count is None:
            told = self.cache.size(self.key(0))
            self._count = self.source.count() if told is None else told
        return self._count

    def blocks(self, offset: int, size: int) -> list[tuple[int, int, int]]:
        """Number, start and end of each block that the extent needs, in the order of the file."""
        n, bs = self.count(), self.cache.block_size
        last, first = (n - offset - size) // bs, (n - offset - 1) // bs
        return [(b, max(0, n - (b + 1) * bs), n - b * bs) for b in range(first, last - 1, -1)]

    def _fetch(self, start: int, end: int) -> Callable[[], bytes]:
        return lambda: self.source.get_bytes(start, end - start)

    def get_bytes(self, offset: int, size: int) -> bytes:
        if size <= 0:
            return b""
        found = self.blocks(offset, size)
        more = {"total": self.count()} if isinstance(self.cache, DiskBlockCache) else {}
        data = b"".join(self.cache.get(self.key(b), self._fetch(s, e), **more) for b, s, e in found)
        return data[offset - found[0][1] :][:size]

    def prefetch_tasks(self, offset: int, size: int) -> list[Callable[[], None]]:
        return [lambda b=b, s=s, e=e: self.cache.prefetch(self.key(b), self._fetch(s, e)) for b, s, e in self.blocks(offset, size)]

    def close(self) -> None:
        self.source.close()


def run_limited(tasks: list[Callable[[], object]], limit: int, stop: threading.Event | None = None) -> list:
    """Results in order; at most `limit` tasks run at once, batch by batch, and none begins after stop is set."""
    if limit < 1:
        raise ValueError("limit must be positive")
    out = []
    with ThreadPoolExecutor(limit) as pool:
        for i in range(0, len(tasks), limit):
            if stop is not None and stop.is_set():
                raise InterruptedError("stopped")
            out += pool.map(lambda t: t(), tasks[i : i + limit])
    return out
