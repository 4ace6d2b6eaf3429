"""Byte sources, caches, retries and bounded runs; hashes, encodings and cache simulations."""

import http.server
import random
import threading
from collections import OrderedDict

import pytest

from ndspark.functions import codec, hashing
from ndspark.operators import cache_sim, io_plan
from ndspark.sources.bytes import BlockCachedSource, DiskBlockCache, FileSource, HttpSource, LruBlockCache, MemoryHttpSource, SourceError, retrying, run_limited

DATA = bytes(random.Random(1).randbytes(10_000))


@pytest.fixture(scope="module")
def url():
    class Handler(http.server.BaseHTTPRequestHandler):
        def reply(self, body):
            if self.path == "/none":
                self.send_error(404)
                return
            data, status = DATA, 200
            if r := self.headers.get("Range"):
                a, b = r.removeprefix("bytes=").split("-")
                data, status = DATA[int(a) : int(b) + 1], 206
            self.send_response(status)
            self.send_header("Content-Length", str(len(data)))
            self.send_header("ETag", '"x"')
            self.end_headers()
            if body:
                self.wfile.write(data)

        def do_GET(self):
            self.reply(True)

        def do_HEAD(self):
            self.reply(False)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_files(tmp_path):
    (tmp_path / "f").write_bytes(DATA)
    for s in (FileSource(tmp_path / "f"), FileSource(DATA)):
        assert s.count() == len(DATA) and s.get_bytes(5, 7) == DATA[5:12]
        s.close()
    assert FileSource(DATA).get_bytes(9_990, 100) == DATA[9_990:]
    with pytest.raises(SourceError):
        FileSource(tmp_path / "f").get_bytes(9_990, 100)


def test_http(url):
    s = HttpSource(f"{url}/f")
    assert s.count() == len(DATA) and s.get_bytes(100, 50) == DATA[100:150]
    assert s.key() == hashing.fnv1a(f"{url}/f") ^ hashing.fnv1a('"x"')
    for bad in ((-1, 5), (0, 0), (9_999, 2)):
        with pytest.raises(SourceError):
            s.get_bytes(*bad)
    with pytest.raises(SourceError, match="not found"):
        HttpSource(f"{url}/none").count()
    told = []
    m = MemoryHttpSource(f"{url}/f", progress=lambda a, b: told.append((a, b)))
    assert m.get_bytes(0, 10_000) == DATA and m.loaded and m.data() == DATA and told[-1] == (10_000, 10_000)
    m.reload()
    assert m.get_bytes(1, 2) == DATA[1:3]
    m.close()
    with pytest.raises(SourceError):
        m.get_bytes(0, 1)
    for _ in range(2):
        with pytest.raises(SourceError, match="limit"):
            MemoryHttpSource(f"{url}/f", max_bytes=10).count()


@pytest.mark.parametrize("block", [64, 1000, 4096, 20_000])
def test_cached_reads(tmp_path, url, block):
    for cache in (LruBlockCache(block, 4), DiskBlockCache(str(tmp_path / str(block)), block, 2, 6000)):
        for base in (17, "name"):
            s = BlockCachedSource(FileSource(DATA), cache, base)
            for _ in range(100):
                a = random.randrange(10_000)
                n = random.randrange(1, 10_001 - a)
                assert s.get_bytes(a, n) == DATA[a : a + n]
            for t in s.prefetch_tasks(0, 3000):
                t()
        if isinstance(cache, DiskBlockCache):
            assert cache.stats()["bytes"] <= 6000 + block
        cache.clear()
    assert HttpSource(f"{url}/f").cached(LruBlockCache(block)).get_bytes(3, 9_000) == DATA[3:9_003]


def test_second_tier(tmp_path, url):
    """Keys by kind, length from the files, memory that expires, few loads at once, what stats tell."""
    now = [0.0]
    cache = DiskBlockCache(str(tmp_path / "c"), 1000, 8, ttl=1.0, fetches=2, clock=lambda: now[0])
    s = HttpSource(f"{url}/f").cached(cache)
    assert s.base == f"{url}/f" and HttpSource(f"{url}/f").cached(LruBlockCache()).base == HttpSource(f"{url}/f").key()
    assert s.get_bytes(9_500, 500) == DATA[9_500:]
    again = BlockCachedSource(FileSource(b""), cache, f"{url}/f")  # its own length isn't asked for
    assert again.count() == len(DATA) and again.get_bytes(9_500, 500) == DATA[9_500:]
    assert cache.stats()["memory_blocks"] == 1 and cache.stats()["memory_bytes"] == 1000
    now[0] = 2.0
    cache.get("other", lambda: b"x")
    assert cache.stats()["memory_blocks"] == 1 and cache.stats()["entries"] == 2
    running, most, lock, gate = [0], [0], threading.Lock(), threading.Event()

    def slow():
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        gate.wait(0.05)
        with lock:
            running[0] -= 1
        return b"y"

    threads = [threading.Thread(target=lambda i=i: cache.get(f"k{i}", slow)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    told = cache.stats()
    assert most[0] <= 2 and (told["loading"], told["waiting"], told["in_flight"]) == (0, 0, 0)
    assert (told["max_bytes"], told["block_size"]) == (1 << 30, 1000)


def test_eviction_over_ranges(spark):
    """One cache that holds everything, and many, against a plain loop."""
    rnd = random.Random(9)
    rows = [(i, rnd.randrange(1, 90), rnd.choice([None, *range(40)]), rnd.choice(["a", "b", None])) for i in range(600)]
    df = spark.createDataFrame(rows, "key int, size bigint, created_at bigint, name string").repartition(6)
    for cache in (None, "name"):
        for limit in (100, 9_000, 10**6):
            want = {}
            for c in {r[3] if cache else "" for r in rows}:
                mine = sorted((r for r in rows if not cache or r[3] == c), key=lambda r: (r[2] or 0, r[0]))
                total = left = sum(r[1] for r in mine)
                for r in mine:
                    want[r[0]] = total > limit and left > limit * 0.9
                    left -= r[1]
            assert {r.key: r.evicted for r in cache_sim.evict_fifo(df, limit, 0.1, cache).collect()} == want


def test_first_block_is_the_short_one():
    s = BlockCachedSource(FileSource(DATA), LruBlockCache(4096), 0)
    assert s.blocks(0, 10_000) == [(2, 0, 1808), (1, 1808, 5904), (0, 5904, 10_000)]


def test_one_flight_and_errors():
    cache, calls = LruBlockCache(10), []
    gate = threading.Event()

    def fetch():
        calls.append(1)
        gate.wait(5)
        return b"x"

    threads = [threading.Thread(target=lambda: cache.get("k", fetch)) for _ in range(5)]
    for t in threads:
        t.start()
    gate.set()
    for t in threads:
        t.join()
    assert len(calls) == 1

    def fails():
        raise OSError("no")

    with pytest.raises(OSError):
        cache.get("bad", fails)
    cache.prefetch("bad", fails)
    assert cache.get("bad", lambda: b"y") == b"y"


def test_retrying():
    waits, left = [], [3]

    def call():
        left[0] -= 1
        if left[0]:
            raise SourceError("busy", 503)
        return "done"

    assert retrying(call, 3, sleep=waits.append) == "done" and waits == [0.5, 1.0]

    def refused():
        raise SourceError("no", 404)

    with pytest.raises(SourceError):
        retrying(refused, 3, sleep=lambda _: pytest.fail("a 404 is final"))
    with pytest.raises(ValueError):
        retrying(call, 0)


def test_run_limited():
    assert run_limited([lambda i=i: i for i in range(5)], 2) == [0, 1, 2, 3, 4]
    stop, ran = threading.Event(), []
    with pytest.raises(InterruptedError):
        run_limited([lambda: ran.append(1), stop.set, lambda: ran.append(2)], 2, stop)
    assert ran == [1]
    with pytest.raises(ValueError):
        run_limited([], 0)


def test_fnv(spark):
    assert hashing.fnv1a("Hello, World!") == 7993990320990026836
    df = spark.createDataFrame([("Hello, World!",), ("",), (None,), ("é",)], "s string").select(hashing.fnv1a64("s").alias("h"))
    assert [r.h for r in df.collect()] == ["7993990320990026836", str(hashing.OFFSET), None, str(hashing.fnv1a("é"))]


def test_lru_simulation_in_short_segments(spark):
    keys = [random.Random(3).randrange(30) for _ in range(1)] + [random.randrange(30) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(keys)), "t bigint, k bigint")
    for cap in (1, 5, 12):
        held, want = OrderedDict(), []
        for k in keys:
            want.append(k in held)
            held.pop(k, None)
            held[k] = None
            if len(held) > cap:
                held.popitem(last=False)
        got = cache_sim.lru_hits(df, "k", "t", cap, segment=16).orderBy("t").collect()
        assert [r.hit for r in got] == want


def test_scaling_keeps_range_and_halves(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (1e9,), (-2.5,)], "x double")
    assert [r.q for r in df.select(codec.scale_int16(df.x, 1.0).alias("q")).collect()] == [2, 4, None, -2]
    back = spark.createDataFrame([(402,), (426,)], "q int").select(codec.unscale(codec.F.col("q"), 20.0).cast("float").alias("x"))
    assert [r.x for r in back.collect()] == pytest.approx([20.1, 21.3], abs=1e-6)


def test_blocks_cover_extents(spark):
    df = spark.createDataFrame([(1, 0, 10_000, 10_000), (2, 1807, 2, 10_000), (3, 9_999, 1, 10_000), (4, 5, 0, 10_000)], "id int, off bigint, size bigint, file_size bigint")
    got = {}
    for r in io_plan.block_cover(df, 4096).collect():
        got.setdefault(r.id, []).append((r.block, r.block_start, r.block_end))
    assert sorted(got[1]) == [(0, 5904, 10_000), (1, 1808, 5904), (2, 0, 1808)]
    assert sorted(got[2]) == [(1, 1808, 5904), (2, 0, 1808)] and got[3] == [(0, 5904, 10_000)] and 4 not in got
