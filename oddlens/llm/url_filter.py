"""URL filters by a sorted digest array.

Rules (host and path prefix) are kept as an array sorted by the 64-bit xxhash of the rule, beside the rules' full
strings. The array lies in a file that every executor gets once and memory-maps. Beside it lies a second one of the
rules' hosts, with the lengths that paths have there: host suffixes of a batch of URLs are looked up in it by one
vectorised binary search, then the path prefixes of just those lengths, hashed on from one to the next, in the digest
array by another. Each hit is confirmed against the stored string, so that hash collisions can't decide. Batches are
cut so that a search holds some PROBES keys. Rules are taken in blocks of at most BLOCK, each a file of its own, so
their number isn't bounded by memory.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; path: from there up to ``?``,
``#`` or the end. Null urls and urls without ``://`` have empty host and path, and no rule fits them. A rule fits its host and
all subdomains if the path starts with the rule's path; the longest rule wins, of equally long ones the first by
code point. Rules that are repeated with different verdicts block.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterable
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from oddlens.llm.common import Batches, shared_dir, slices

BLOCK = 1_000_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
PROBES = 1 << 18
HOST = np.dtype([("key", "<u8"), ("length", "<u4")])
RULE = np.dtype([("key", "<u8"), ("at", "<u8"), ("size", "<u4"), ("allow", "u1")])


def parts(url: bytes | None) -> tuple[bytes, bytes]:
    """Host and path of a URL."""
    _, mark, rest = (url or b"").partition(b"://")
    if not mark:
        return b"", b""
    rest = rest.split(b"?", 1)[0].split(b"#", 1)[0]
    host, slash, path = rest.partition(b"/")
    return host.translate(_LOWER), slash + path


def normal(rule: str) -> bytes:
    host, slash, path = rule.encode().partition(b"/")
    return host.translate(_LOWER) + slash + path


def build(rules: Iterable[tuple[str, bool]], hash64=xxhash.xxh64_intdigest) -> tuple[bytes, bytes, bytes]:
    """(rule, allow) -> the digest array as a .npy file, the strings, and the array of hosts and path lengths as a .npy file."""
    verdicts: dict[bytes, bool] = {}
    for rule, allow in rules:
        verdicts[normal(rule)] = allow and verdicts.get(normal(rule), True)
    names = sorted(verdicts)
    array = np.zeros(len(names), RULE)
    sizes = np.fromiter(map(len, names), np.int64, len(names))
    array["key"] = [hash64(x) for x in names]
    array["at"], array["size"], array["allow"] = np.cumsum(sizes) - sizes, sizes, [verdicts[x] for x in names]
    ends = {(hash64(x.split(b"/", 1)[0]), len(x) - len(x.split(b"/", 1)[0])) for x in names}
    return _file(array[np.argsort(array["key"], kind="stable")]), b"".join(names), _file(np.array(sorted(ends), HOST))


def _file(array: np.ndarray) -> bytes:
    file = io.BytesIO()
    np.save(file, array)
    return file.getvalue()


class Rules:
    """A digest array, its strings and its hosts, all mapped into memory (``hosts`` may also be the file's bytes)."""

    def __init__(self, array: str, strings: str, hosts: str | bytes, hash64=xxhash.xxh64_intdigest):
        self.array = np.load(array, mmap_mode="r")
        self.keys = self.array["key"]
        self.strings = np.memmap(strings, np.uint8, "r") if len(self.array) else np.empty(0, np.uint8)
        self.hosts = np.load(io.BytesIO(hosts)) if isinstance(hosts, bytes) else np.load(hosts, mmap_mode="r")
        self.hash64 = hash64

    def _prefix_keys(self, host: bytes, path: bytes, lengths: list[int]) -> list[int]:
        if self.hash64 is not xxhash.xxh64_intdigest:
            return [self.hash64(host + path[:n]) for n in lengths]
        state, done, out = xxhash.xxh64(host), 0, []
        for n in lengths:
            state.update(path[done:n])
            done = n
            out.append(state.intdigest())
        return out

    def find(self, urls: list[tuple[bytes, bytes]]) -> list[tuple[bytes, bool] | None]:
        """The longest fitting rule of each (host, path), and whether it allows."""
        best: list[tuple[bytes, bool] | None] = [None] * len(urls)
        row, start = [], []
        for k, (host, _) in enumerate(urls):
            at = 0
            while at < len(host):
                row.append(k)
                start.append(at)
                at = host.find(b".", at) + 1 or len(host)
        keys = np.fromiter((self.hash64(urls[k][0][at:]) for k, at in zip(row, start, strict=True)), np.uint64, len(row))
        left, right = np.searchsorted(self.hosts["key"], keys), np.searchsorted(self.hosts["key"], keys, "right")
        probes: list[tuple[int, int, int]] = []  # row, where the host's suffix starts, length of the path
        wanted: list[int] = []
        for i in np.flatnonzero(right > left):
            (host, path), at = urls[row[i]], start[i]
            lengths = [n for n in self.hosts["length"][left[i] : right[i]].tolist() if n <= len(path)]
            wanted += self._prefix_keys(host[at:], path, lengths)
            probes += [(row[i], at, n) for n in lengths]
            if len(probes) >= PROBES:
                self._confirm(urls, probes, wanted, best)
                probes, wanted = [], []
        self._confirm(urls, probes, wanted, best)
        return best

    def _confirm(self, urls, probes, wanted, best) -> None:
        keys = np.fromiter(wanted, np.uint64, len(wanted))
        left, right = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, "right")
        for i in np.flatnonzero(right > left):
            k, at, n = probes[i]
            probe = urls[k][0][at:] + urls[k][1][:n]
            for r in self.array[left[i] : right[i]]:
                if self.strings[r["at"] : r["at"] + r["size"]].tobytes() == probe:
                    best[k] = better(best[k], (probe, bool(r["allow"])))


def better(a: tuple[bytes, bool] | None, b: tuple[bytes, bool] | None):
    if a is None or b is None:
        return a or b
    return min(a, b, key=lambda x: (-len(x[0]), x[0], x[1]))


def _put(spark: SparkSession, name: str, data: bytes) -> str:
    """A file in the shared folder that every executor gets; its name there."""
    jvm, path = spark.sparkContext._jvm, f"{shared_dir(spark)}/{name}"
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    for k in range(0, len(data), 1 << 22):
        stream.write(bytearray(data[k : k + (1 << 22)]))
    stream.close()
    spark.sparkContext.addFile(path)
    return name


def _judged(batches: Batches, files: list[tuple[str, str, str]], default: str) -> Batches:
    rules = [Rules(*map(SparkFiles.get, names)) for names in files]
    for batch in slices(batches):
        urls = [parts(u) for u in batch.column("url").cast(pa.binary()).to_pylist()]
        best: list = [None] * len(urls)
        for part in rules:
            best = [better(a, b) for a, b in zip(best, part.find(urls), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("page_id"),
                *(pa.array([u[k].decode() for u in urls], pa.string()) for k in (0, 1)),
                pa.array([x and x[0].decode() for x in best], pa.string()),
                pa.array([default if x is None else "allow" if x[1] else "block" for x in best], pa.string()),
            ],
            ["page_id", "host", "path", "rule", "verdict"],
        )


def judge(pages: DataFrame, rules: DataFrame | Iterable[tuple[str, str]], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (null if none fits), verdict for each row of ``pages`` (page_id, url).

    ``rules``: rows (rule, verdict), verdict ``allow`` or ``block``; null rules are left out. ``default``: the
    verdict where no rule fits.
    """
    spark = pages.sparkSession
    rows = ((r.rule, r.verdict) for r in rules.select("rule", "verdict").toLocalIterator()) if isinstance(rules, DataFrame) else rules
    files, block = [], []

    def flush():
        name = uuid.uuid4().hex
        files.append(tuple(_put(spark, f"{name}.{end}", data) for end, data in zip(("npy", "txt", "hosts.npy"), build(block), strict=True)))

    for rule, verdict in rows:
        if rule is not None:
            block.append((rule, verdict == "allow"))
        if len(block) >= BLOCK:
            flush()
            block = []
    if block:
        flush()
    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, host string, path string, rule string, verdict string"
    return pages.select("page_id", "url").mapInArrow(partial(_judged, files=files, default=default), schema)
