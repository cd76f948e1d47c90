"""Benchmark decontamination: a broadcast set of normalised test n-grams, scanned over training windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, checkpointed

#: Bytes of benchmark text that one broadcast set may be built from, about 80 bytes of arrays for each window of
#: it; a larger benchmark goes in blocks, of which so many are scanned in a row before the rows are kept.
BLOCK_BYTES, CHAINED = 4 << 20, 4
#: ASCII letters and digits and every byte of a non-ASCII character belong to words; the rest separates.
SEPARATORS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in LOWER)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def item_words(text: bytes) -> list[bytes]:
    return text.translate(SEPARATORS).split()


def word_spans(text: bytes) -> list[tuple[int, int]]:
    """Byte ranges of the words."""
    clean, at, spans = text.translate(SEPARATORS), 0, []
    for word in clean.split():
        at = clean.index(word, at)
        spans.append((at, at := at + len(word)))
    return spans


def _codes(ids: np.ndarray, starts: np.ndarray, length: int, seed: int) -> np.ndarray:
    code = np.zeros(len(starts), np.uint64)
    for k in range(length):
        code = code * (_MULTIPLIER * np.uint64(seed)) + ids[starts + k].astype(np.uint64) + np.uint64(1)
    return code


def window_set(items: list[tuple[str, bytes]], width: int) -> tuple:
    """The windows of benchmark items as sorted arrays: (words, items, sets).

    sets: for each length of window its codes in order, the word numbers of the window
    with that code, and where the numbers of its items begin in the last array. Tasks get
    these arrays as they are; only the numbers of words become a dictionary there.
    """
    number: dict[bytes, int] = {}
    by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
    for item, (_, text) in enumerate(items):
        ids = np.array([number.setdefault(w, len(number)) for w in item_words(text)], np.int32)
        if length := min(width, len(ids)):
            by_length.setdefault(length, []).append((item, np.lib.stride_tricks.sliding_window_view(ids, length)))
    sets = []
    for length, own in sorted(by_length.items()):
        windows, which = np.unique(np.concatenate([w for _, w in own]), axis=0, return_inverse=True)
        owner = np.repeat([item for item, _ in own], [len(w) for _, w in own])
        pairs = np.unique(np.stack([which.ravel(), owner], 1), axis=0)
        start = np.arange(0, windows.size, length)
        seed = 1
        while len(np.unique(codes := _codes(windows.ravel(), start, length, seed))) < len(codes):  # no two windows share a code
            seed += 2
        order = np.argsort(codes)
        ends = np.cumsum(np.bincount(pairs[:, 0], minlength=len(windows)))
        begins = ends - np.bincount(pairs[:, 0], minlength=len(windows))
        sets.append((length, seed, codes[order], windows[order], begins[order], ends[order], pairs[:, 1].astype(np.int32)))
    return list(number), [name for name, _ in items], sets


class WindowScan:
    """Scans words for the windows of a set: candidates by code, verified by their words."""

    def __init__(self, windows: tuple):
        words, self.names, self.sets = windows
        self.ids = {w: k for k, w in enumerate(words)}

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The windows' occurrences as merged ranges of words, and the items that have any."""
        ids = np.fromiter(map(self.ids.get, found, repeat(-1)), np.int32, len(found))
        unknown = np.concatenate([[0], np.cumsum(ids < 0)])
        hits, items = [], set()
        for length, seed, codes, windows, begins, ends, owners in self.sets:
            if len(ids) < length:
                continue
            starts = np.flatnonzero(unknown[length:] == unknown[:-length])
            if not len(starts):
                continue
            code = _codes(ids, starts, length, seed)
            at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            same = codes[at] == code
            starts, at = starts[same], at[same]
            same = (windows[at] == ids[starts[:, None] + np.arange(length)]).all(1)
            starts, at = starts[same], np.unique(at[same])
            if len(starts):
                first = np.flatnonzero(np.concatenate([[True], starts[1:] > starts[:-1] + length]))
                hits += zip(starts[first].tolist(), (starts[np.append(first[1:], len(starts)) - 1] + length).tolist(), strict=True)
                for a, b in zip(begins[at].tolist(), ends[at].tolist(), strict=True):
                    items |= {self.names[k] for k in owners[a:b].tolist()}
        return merged(hits), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def find_windows(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with bench_words (long), bench_ranges (array of [start, end) word ranges, flattened) and bench_items (array of ids as text).

    Each benchmark item gives its windows of `width` words, or one window if it is
    shorter. The set of windows is broadcast as sorted arrays; the size of the benchmark is checked
    first, and a benchmark of over `block_bytes` is scanned in blocks of about that size, CHAINED of them in a
    row, after which the rows are kept in the shared folder.

    A null text has no words. An item with null text gives no window; an item with
    null id counts as the item ''. Repeated items count once. An empty benchmark hits nothing. Repeated rows are
    scanned each, long texts whole; columns of docs with the names of the three go. An empty table gives no rows.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.encode(F.col("text"), "UTF-8").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    added = [T.StructField("bench_words", T.LongType()), T.StructField("bench_ranges", T.ArrayType(T.LongType())), T.StructField("bench_items", T.ArrayType(T.StringType()))]
    out = docs.drop(*(f.name for f in added))
    schema = T.StructType([*out.schema, *added])
    for block in range(max(1, blocks)):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(max(1, blocks))) == block)
        shared = spark.sparkContext.broadcast(window_set([(r["item"], bytes(r["text"])) for r in own.collect()], width))
        if block and block % CHAINED == 0:
            out = checkpointed(out)
        out = out.mapInArrow(_scanner(shared, block > 0), schema)
    return out


def _scanner(shared, again: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = WindowScan(shared.value)
        for batch in batches:
            count, ranges, items = [], [], []
            for i, text in enumerate(batch.column("text")):
                found = item_words(text.as_buffer().to_pybytes()) if text.is_valid else []
                hits, own = windows.scan(found)
                if again:
                    old = batch.column("bench_ranges")[i].as_py()
                    hits = merged([*hits, *zip(old[::2], old[1::2], strict=True)])
                    own |= set(batch.column("bench_items")[i].as_py())
                count.append(len(found))
                ranges.append([x for hit in hits for x in hit])
                items.append(sorted(own))
            kept = batch.columns[: -3 if again else None]
            new = [pa.array(count, pa.int64()), pa.array(ranges, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*kept, *new], [*batch.schema.names[: len(kept)], "bench_words", "bench_ranges", "bench_items"])

    return scan


def remove_documents(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The documents of docs in which no window of the benchmark occurs, with the columns of docs.

    Null and empty texts stay, as do repeated rows; an empty table gives no rows.
    """
    found = find_windows(docs, benchmark, width)
    return found.where(F.size("bench_ranges") == 0).select(*(F.col(f"`{c}`") for c in docs.columns))


def remove_spans(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """docs with the text of each hit range of words cut out; other texts, null and empty ones among them, stay as they are.

    Repeated rows are cut each; an empty table gives no rows.
    """
    found, columns = find_windows(docs, benchmark, width), docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, ranges in zip(batch.column("text"), batch.column("bench_ranges").to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else None
                if ranges:
                    spans = word_spans(raw)
                    for start, end in reversed(list(zip(ranges[::2], ranges[1::2], strict=True))):
                        raw = raw[: spans[start][0]] + raw[spans[end - 1][1] :]
                texts.append(None if raw is None else raw.decode())
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array(texts, pa.string())).select(columns)

    return found.mapInArrow(cut, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """One row a document: how many words are hit, by how many items, and a hash of the items' ids."""
    ends = F.filter("bench_ranges", lambda x, i: i % 2 == 1)
    starts = F.filter("bench_ranges", lambda x, i: i % 2 == 0)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select(
        "doc_id",
        F.col("bench_words").alias("n_words"),
        (total(ends) - total(starts)).alias("n_hit"),
        F.size("bench_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("bench_items"), ","), 256).alias("items_sha256"),
        (F.size("bench_ranges") > 0).alias("contaminated"),
    )


def brute_force(texts: list[str | None], items: list[tuple[object, str | None]], width: int = 10) -> list[tuple[int, int, int, str, bool]]:
    """The rows of `digest` by plain comparison, for tests on small inputs."""
    out = []
    windows: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        found = item_words((text or "").encode())
        n = min(width, len(found))
        for i in range(len(found) - n + 1 if n else 0):
            windows.setdefault(tuple(found[i : i + n]), set()).add("" if item is None else str(item))
    lengths = {len(w) for w in windows}
    for text in texts:
        found = item_words((text or "").encode())
        hit: set[int] = set()
        own: set[str] = set()
        for n in lengths:
            for i in range(len(found) - n + 1):
                if (window := tuple(found[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    own |= windows[window]
        out.append((len(found), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return out
