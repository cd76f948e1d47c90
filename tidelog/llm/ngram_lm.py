"""Language-model scores: an interpolated modified Kneser-Ney bigram model in memory-mapped sorted hash arrays.

Spark counts the bigrams: blocks of documents are counted in the tasks that read
them and their counts meet in shards by hash. A shard's sorted hashes and counts are
files in the shared folder. What a block asks of a shard is answered in the task that
has the shard, and the answers of a block meet in one file; so a scoring task maps its
blocks' answers and the word files, and the number of files that are opened grows as the input does.
"""

from __future__ import annotations

import itertools
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, checkpointed, use_checkpoint_dir

#: Tokens that a task counts or scores at once, and bigrams that a shard should hold.
BLOCK_TOKENS, SHARD_ROWS = 1_000_000, 800_000
#: Words in a file that scoring tasks map: 13 bytes each.
FILE_WORDS = 4_000_000
#: Documents of which the frequent words, whose bigrams are dealt out to several shards, are estimated. Results don't depend on them.
HOT_SAMPLE = 2000
START, END = np.uint64(1), np.uint64(2)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
STATS = ("c", "n1", "n2", "n3", "nc")
#: A statistic is kept in one byte; words with one from here on have a row of whole numbers besides.
LARGE = 255


def tokens(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    h = v * _A + w
    h ^= h >> np.uint64(29)
    h *= _B
    return h ^ (h >> np.uint64(32))


def shard_of(v: np.ndarray, w: np.ndarray, shards: int, hot: np.ndarray) -> np.ndarray:
    """By the first word, so that its statistics are made in one place; by both where the first is frequent."""
    spread = np.where(np.isin(v, hot), w, np.uint64(0))
    return (pair_hash(v, spread) >> np.uint64(40)).astype(np.int64) % shards


def word_range(h: np.ndarray, ranges: int) -> np.ndarray:
    """Which of so many ranges of hashes, in order, a word falls into."""
    return ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def dealt(v: np.ndarray, w: np.ndarray, shards: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, shards that are there, where each ends): bigrams by shard, in a shard by the first word."""
    shard = shard_of(v, w, shards, hot)
    there, counts = np.unique(shard, return_counts=True)
    return np.lexsort((v, shard)), there, np.cumsum(counts)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers from 0, of equal lengths, in the bytes that they need, compressed."""
    parts = [len(columns[0]).to_bytes(8, "little")]
    for c in columns:
        small = np.ascontiguousarray(_small(c))
        parts += [bytes([small.itemsize]), small.view(np.uint8).reshape(-1, small.itemsize).T.tobytes()]
    raw = b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(packed: bytes) -> list[np.ndarray]:
    raw = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True)
    n, at, columns = int.from_bytes(raw[:8], "little"), 8, []
    while at < len(raw):
        size, at = raw[at], at + 1
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        columns.append(np.ascontiguousarray(planes.T).view(f"<u{size}").ravel())
        at += n * size
    return columns


def _small(n: np.ndarray) -> np.ndarray:
    """Numbers in as many bytes each as the largest needs: 1, 2, 4 or 8."""
    most = int(n.max(initial=0))
    return n.astype(next(f"<u{k}" for k in (1, 2, 4, 8) if most < 1 << 8 * k))


class Block:
    """Documents read together: their words as numbers, their bigrams sorted by word number, and a digest that names the block."""

    def __init__(self):
        self.ids: defaultdict[bytes, int] = defaultdict(itertools.count(2).__next__)
        self.docs: list[np.ndarray] = []
        self.learns: list[bool] = []
        self.size = 0
        self.digest = xxhash.xxh64()

    def add(self, text: bytes, learns: bool = True) -> None:
        found = tokens(text)
        ids = np.empty(len(found) + 2, np.int64)
        ids[0], ids[-1] = 0, 1
        ids[1:-1] = np.fromiter(map(self.ids.__getitem__, found), np.int64, len(found))
        self.docs.append(ids)
        self.learns.append(learns)
        self.size += len(found) + 1
        self.digest.update(xxhash.xxh64_digest(text))

    def name(self) -> int:
        return self.digest.intdigest() - (1 << 63)

    def hashes(self) -> np.ndarray:
        """By word number; the first two are the start and the end of a document."""
        digest = xxhash.xxh64_intdigest
        return np.array([int(START), int(END), *(digest(w) for w in self.ids)], np.uint64)

    def pairs(self) -> tuple:
        """(first, second, where each token's pair is, counts in documents that are learnt from): distinct bigrams as word numbers."""
        if not self.docs:
            return (np.zeros(0, np.int64),) * 4
        code = np.concatenate([(d[:-1] << 32) | d[1:] for d in self.docs])
        unique, inverse = np.unique(code, return_inverse=True)
        learnt = np.repeat(self.learns, [len(d) - 1 for d in self.docs])
        return unique >> 32, unique & 0xFFFFFFFF, inverse, np.bincount(inverse[learnt], minlength=len(unique))


@dataclass
class Model:
    """Where the shards are, and what all bigrams add up to."""

    uri: str
    shards: int
    hot: list[int]
    pairs_of_count: list[int] = field(default_factory=lambda: [0] * 4)
    words_of_count: list[int] = field(default_factory=lambda: [0] * 5)
    distinct_pairs: int = 0
    vocabulary: int = 0
    train_tokens: int = 0
    train_docs: int = 0
    word_files: int = 0

    def discounts(self, n: list[int]) -> np.ndarray:
        """0, D1, D2, D3+ from how many have the counts 1 to 4 (Chen and Goodman, 1998), kept between 0 and the count."""
        y = n[0] / max(1, n[0] + 2 * n[1])
        d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.0 for k in (1, 2, 3)]
        return np.array([0.0, *(min(max(x, 0.01 if y else 0.5), k - 0.01) for k, x in zip((1, 2, 3), d, strict=True))])

    def unigram(self, continuations: np.ndarray) -> np.ndarray:
        """Probability of words by how many different words they follow, the rest spread over the vocabulary and one unknown word."""
        if not self.distinct_pairs:
            return np.full(len(continuations), 1.0 / (self.vocabulary + 1))
        d = self.discounts(self.words_of_count[:4])
        n1, n2 = self.words_of_count[:2]
        n3 = self.words_of_count[4] - n1 - n2
        rest = (d[1] * n1 + d[2] * n2 + d[3] * n3) / self.distinct_pairs
        return np.maximum(continuations - d[np.minimum(continuations, 3)], 0) / self.distinct_pairs + rest / (self.vocabulary + 1)

    def probability(self, count: np.ndarray, v: dict[str, np.ndarray], w_unigram: np.ndarray) -> np.ndarray:
        d = self.discounts(self.pairs_of_count)
        seen = v["c"] > 0
        total = np.maximum(v["c"], 1)
        rest = np.where(seen, (d[1] * v["n1"] + d[2] * v["n2"] + d[3] * v["n3"]) / total, 1.0)
        return np.where(seen, np.maximum(count - d[np.minimum(count, 3)], 0) / total, 0.0) + rest * w_unigram


# --- files of the model ---------------------------------------------------------------------


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write(uri: str, name: str, array: np.ndarray) -> None:
    """Under another name first, so that a task that is lost or run twice never leaves half a file."""
    store, base = _store(uri)
    part = f"{base}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(np.ascontiguousarray(array).tobytes())
    store.move(part, f"{base}/{name}")


def _mapped(uri: str, name: str, kind: type) -> np.ndarray:
    """A file of the model, memory-mapped. A folder that is not mounted is read through its own file system."""
    if urlparse(uri).scheme in ("", "file"):
        path = f"{urlparse(uri).path}/{name}"
        with open(path, "rb") as f:
            return np.memmap(path, kind, "r") if f.seek(0, 2) else np.zeros(0, kind)
    store, base = _store(uri)
    with store.open_input_file(f"{base}/{name}") as f:
        return np.frombuffer(f.read(), kind)


def _find(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, found) of each wanted key."""
    if not len(sorted_keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return at, sorted_keys[at] == wanted


# --- training -------------------------------------------------------------------------------

#: first: the first words in order, as differences, and how many bigrams each has; second: the second words and counts.
_CHUNK = "shard int, block long, first binary, second binary"
#: What shards give: statistics of words, for a range of hashes (kind 0), or counts that a block asked for (kind 1), both packed.
_GIVEN = "kind int, key long, part int, pairs array<long>, body binary"
_SUMS = ("p1", "p2", "p3", "p4", "w1", "w2", "w3", "w4", "w_all", "distinct_pairs", "vocabulary", "train_tokens", "train_docs")


def _by_shard(shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, shards that are there, where each ends)."""
    order = np.argsort(shard, kind="stable")
    there, counts = np.unique(shard, return_counts=True)
    return order, there, np.cumsum(counts)


def frequent_words(docs: DataFrame, shards: int, rows: int) -> list[int]:
    """Hashes of words with over a quarter of a shard's share of a sample's tokens: 4 * shards at most.

    The sample is of about HOT_SAMPLE documents, chosen by hash; it decides where bigrams are counted, not what is counted.
    """
    kept = docs.select("text").where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("text"), F.lit(max(1, rows // HOT_SAMPLE))) == 0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = Block()
            for text in batch.column("text"):
                block.add(text.as_buffer().to_pybytes())
            ids, n = np.unique(np.concatenate([d[:-1] for d in block.docs]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(block.hashes()[ids].view(np.int64)), pa.array(n)], ["h", "n"])

    counted = kept.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    return sorted(r["h"] & (2**64 - 1) for r in counted.where(F.col("n") > total / (4 * shards)).collect())


def _counts(raw: np.ndarray, rows: int) -> np.ndarray:
    return raw.view(f"<u{len(raw) // rows}") if rows else np.zeros(0, np.uint8)


def added(at: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sums of whole numbers by row, as whole numbers."""
    out = np.zeros(rows, np.int64)
    np.add.at(out, at, values)
    return out


def _chunks(docs: DataFrame, shards: int, hot: np.ndarray) -> DataFrame:
    """A row for each block of docs (text, learns) and shard: the block's bigrams there, and how often learnt documents have them."""

    def of(block: Block) -> pa.RecordBatch:
        v, w, _, n = block.pairs()
        h = block.hashes()
        v, w = h[v], h[w]
        order, there, ends = dealt(v, w, shards, hot)
        first, second = [], []
        for rows in np.split(order, ends[:-1]):
            own, runs = np.unique(v[rows], return_counts=True)
            first.append(pack(np.diff(own, prepend=np.uint64(0)), runs))
            second.append(pack(w[rows], n[rows]))
        cells = [pa.array(there.astype(np.int32)), pa.array(np.full(len(there), block.name())), pa.array(first, pa.binary()), pa.array(second, pa.binary())]
        return pa.RecordBatch.from_arrays(cells, ["shard", "block", "first", "second"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()
        for batch in batches:
            for text, learns in zip(batch.column("text"), batch.column("learns").to_pylist(), strict=True):
                block.add(text.as_buffer().to_pybytes() if text.is_valid else b"", learns)
                if block.size >= BLOCK_TOKENS:
                    yield of(block)
                    block = Block()
        if block.docs:
            yield of(block)

    return docs.select("text", "learns").mapInArrow(count, _CHUNK)


def _bigrams(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(v, w, n, where each chunk ends) of a shard's chunks."""
    v, w, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for first, second in zip(table.column("first"), table.column("second"), strict=True):
        steps, runs = unpack(first.as_py())
        words, counts = unpack(second.as_py())
        v.append(np.repeat(np.cumsum(steps, dtype=np.uint64), runs))
        w.append(words.astype(np.uint64))
        n.append(counts.astype(np.int64))
    return np.concatenate(v), np.concatenate(w), np.concatenate(n), np.cumsum([len(x) for x in w[1:]])


def _given(kind: int, key: pa.Array, part: pa.Array, pairs: list, bodies: list[bytes]) -> pa.Table:
    cells = [pa.array(np.full(len(bodies), kind, np.int32)), key, part, pa.array(pairs, pa.list_(pa.int64())), pa.array(bodies, pa.binary())]
    return pa.table(cells, ["kind", "key", "part", "pairs", "body"])


def _answers(table: pa.Table, counts: np.ndarray, ends: np.ndarray) -> pa.Table:
    """The counts of a shard's chunks, for the blocks that sent them."""
    bodies = [pack(c) for c in np.split(counts, ends[:-1])] if len(ends) else []
    return _given(1, table.column("block").combine_chunks(), table.column("shard").combine_chunks(), [[]] * len(bodies), bodies)


def _finisher(uri: str):
    """A function of what meets for a range of words, or for a block: writes its files and gives one row of sums."""

    def words(table: pa.Table, part: int) -> list[int]:
        columns = [unpack(b.as_py()) for b in table.column("body")]
        key, at = np.unique(np.concatenate([np.cumsum(c[0], dtype=np.uint64) for c in columns]), return_inverse=True)
        stats = {s: added(at, np.concatenate([c[1 + i] for c in columns]).astype(np.int64), len(key)) for i, s in enumerate(STATS)}
        every = np.stack([stats[s] for s in STATS], 1)
        large = (every >= LARGE).any(1)
        _write(f"{uri}/ranges", f"{part}.keys", key)
        _write(f"{uri}/ranges", f"{part}.stats", np.minimum(every, LARGE).astype(np.uint8))
        _write(f"{uri}/ranges", f"{part}.large", np.column_stack([key[large].view(np.int64), every[large]]))
        nc = stats["nc"]
        pairs = np.array([x for x in table.column("pairs").to_pylist() if x], np.int64).reshape(-1, 4).sum(0).tolist()
        starts = int(stats["c"][key == START].sum())
        return [*pairs, *(int((nc == k).sum()) for k in (1, 2, 3, 4)), int((nc > 0).sum()), int(nc.sum()), int((nc > 0).sum()), int(stats["c"].sum()), starts]

    def block(table: pa.Table, name: int) -> list[int]:
        # blocks of the same texts have one name and the same answers
        parts = dict(zip(table.column("part").to_pylist(), table.column("body").to_pylist(), strict=True))
        counts = np.concatenate([unpack(parts[k])[0].astype(np.uint64) for k in sorted(parts)])
        _write(uri, f"block-{name}", np.frombuffer(pack(counts), np.uint8))
        return [0] * len(_SUMS)

    def finish(table: pa.Table) -> pa.Table:
        kind, key = table.column("kind")[0].as_py(), table.column("key")[0].as_py()
        row = block(table, key) if kind else words(table, key)
        return pa.table({k: pa.array([x], pa.int64()) for k, x in zip(_SUMS, row, strict=True)})

    return finish


def _finished(given: DataFrame, uri: str) -> list[int]:
    sums = given.groupBy("kind", "key").applyInArrow(_finisher(uri), ", ".join(f"{s} long" for s in _SUMS))
    return [x or 0 for x in sums.agg(*(F.sum(c) for c in _SUMS)).first()]


def train(docs: DataFrame) -> Model:
    """The bigram model of the texts of docs, as files in the shared folder; delete() removes them.

    If docs have a column learns (boolean), the model learns from those where it holds; the counts that
    blocks of all docs will ask for are then answered on the way, and score(docs, ..., asked=True) finds them.
    Null texts count as empty ones: a document without words is an end after a start.
    """
    spark = docs.sparkSession
    use_checkpoint_dir(spark)
    if "learns" not in docs.columns:
        docs = docs.select("text", F.lit(True).alias("learns"))
    size, rows = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    size = size or 0
    shards = max(4, -(-size // (7 * SHARD_ROWS)))
    uri = f"{spark.sparkContext.getCheckpointDir()}/ngrams-{uuid.uuid4().hex}"
    store, base = _store(uri if "://" in uri or uri.startswith(("/", "file:")) else f"/{uri}")
    store.create_dir(f"{base}/ranges")
    uri = uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri
    hot_list = frequent_words(docs.where("learns"), shards, rows)

    def merge(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        v, w, n, ends = _bigrams(table)
        key, first, inverse = np.unique(pair_hash(v, w), return_index=True, return_inverse=True)
        n = added(inverse, n, len(key))
        answers = _answers(table, n[inverse], ends)
        learnt = n > 0
        key, n, v, w = key[learnt], n[learnt], v[first[learnt]], w[first[learnt]]
        _write(uri, f"pairs-{shard}.once", key[n == 1])
        _write(uri, f"pairs-{shard}.keys", key[n > 1])
        _write(uri, f"pairs-{shard}.counts", _small(n[n > 1]))
        key, at = np.unique(np.concatenate([v, w]), return_inverse=True)
        at_v, at_w = np.split(at, 2)
        stats = [added(at_v, n, len(key)), *(np.bincount(at_v[n == k if k < 3 else n >= 3], minlength=len(key)) for k in (1, 2, 3)), np.bincount(at_w, minlength=len(key))]
        there, counts = np.unique(word_range(key, shards), return_counts=True)  # key is sorted, and so are the ranges
        ends = np.cumsum(counts)
        bodies = [pack(np.diff(key[a:b], prepend=np.uint64(0)), *(x[a:b] for x in stats)) for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
        pairs = [[int((n == k).sum()) for k in (1, 2, 3, 4)] if i == 0 else [] for i in range(len(there))]
        return pa.concat_tables([_given(0, pa.array(there), pa.array(np.full(len(there), shard, np.int32)), pairs, bodies), answers])

    s = _finished(_chunks(docs, shards, np.array(hot_list, np.uint64)).groupBy("shard").applyInArrow(merge, _GIVEN), uri)
    model = Model(uri, shards, hot_list, s[:4], s[4:9], s[9], s[10], s[11], s[12])
    model.word_files = max(1, -(-model.vocabulary // FILE_WORDS))
    _gather_words(spark, model)
    return model


def _gather_words(spark, model: Model) -> None:
    """Ranges of words, written in order of their hashes, become fewer and larger files, copied piece by piece."""
    uri, shards, files = model.uri, model.shards, model.word_files

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(uri)
        for batch in batches:
            for file in batch.column("id").to_pylist():
                for end in ("keys", "stats", "large"):
                    part = f"{base}/_words-{file}.{uuid.uuid4().hex}"
                    with store.open_output_stream(part) as out:
                        for k in range(-(-file * shards // files), -(-(file + 1) * shards // files)):
                            try:
                                source = store.open_input_stream(f"{base}/ranges/{k}.{end}")
                            except FileNotFoundError:  # a range that no word fell into
                                continue
                            with source:
                                while piece := source.read(1 << 22):
                                    out.write(piece)
                    store.move(part, f"{base}/words-{file}.{end}")
            yield batch

    spark.range(files).repartition(min(files, 1000)).mapInArrow(gather, "id long").count()
    store, base = _store(uri)
    store.delete_dir(f"{base}/ranges")


def ask(docs: DataFrame, model: Model) -> None:
    """Answers the counts that blocks of docs (text) will ask for, each shard in one task, and writes them as a file a block."""
    uri = model.uri

    def answer(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        v, w, _, ends = _bigrams(table)
        return _answers(table, _shard_counts(uri, shard, pair_hash(v, w)), ends)

    chunks = _chunks(docs.select("text", F.lit(False).alias("learns")), model.shards, np.array(model.hot, np.uint64))
    _finished(chunks.groupBy("shard").applyInArrow(answer, _GIVEN), uri)


def delete(model: Model) -> None:
    store, base = _store(model.uri)
    store.delete_dir(base)


# --- scoring --------------------------------------------------------------------------------


def _shard_counts(uri: str, shard: int, wanted: np.ndarray) -> np.ndarray:
    """Counts of bigrams by hash, from the mapped arrays of their shard: those seen once, and the others with their counts."""
    out = np.zeros(len(wanted), np.int64)
    try:
        once, keys = (_mapped(uri, f"pairs-{shard}.{end}", np.uint64) for end in ("once", "keys"))
    except FileNotFoundError:  # a shard that no bigram fell into
        return out
    order = np.argsort(wanted)
    out[order[_find(once, wanted[order])[1]]] = 1
    at, found = _find(keys, wanted[order])
    out[order[found]] = _counts(_mapped(uri, f"pairs-{shard}.counts", np.uint8), len(keys))[at[found]]
    return out


class Lookup:
    """A model as a scoring task sees it: the word files, mapped once, and a file of counts for each block."""

    def __init__(self, model: Model):
        self.model, self.hot = model, np.array(model.hot, np.uint64)
        self.files: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def _words_file(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if k not in self.files:
            stats, large = (_mapped(self.model.uri, f"words-{k}.{end}", kind) for end, kind in (("stats", np.uint8), ("large", np.int64)))
            self.files[k] = _mapped(self.model.uri, f"words-{k}.keys", np.uint64), stats.reshape(-1, len(STATS)), large.reshape(-1, 1 + len(STATS))
        return self.files[k]

    def words(self, h: np.ndarray) -> dict[str, np.ndarray]:
        out = np.zeros((len(h), len(STATS)), np.int64)
        order, there, ends = _by_shard(word_range(h, self.model.shards) * self.model.word_files // self.model.shards)
        for k, rows in zip(there.tolist(), np.split(order, ends[:-1]), strict=True):
            keys, stats, large = self._words_file(k)
            rows = rows[np.argsort(h[rows])]
            at, found = _find(keys, h[rows])
            out[rows[found]] = stats[at[found]]
            full = rows[found][(stats[at[found]] == LARGE).any(1)]
            if len(full):
                out[full] = large[np.searchsorted(large[:, 0].view(np.uint64), h[full]), 1:]
        return {s: out[:, i] for i, s in enumerate(STATS)}

    def pairs(self, block: Block, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Counts of the block's bigrams: from its file, or from the shards if it was not asked for as it stands here, as where a scan is split in another way."""
        order, there, ends = dealt(v, w, self.model.shards, self.hot)
        out = np.zeros(len(v), np.int64)
        try:
            out[order] = unpack(_mapped(self.model.uri, f"block-{block.name()}", np.uint8).tobytes())[0]
        except FileNotFoundError:
            for shard, rows in zip(there.tolist(), np.split(order, ends[:-1]), strict=True):
                out[rows] = _shard_counts(self.model.uri, shard, pair_hash(v[rows], w[rows]))
        return out

    def scores(self, block: Block) -> dict[str, list]:
        """For each document of the block: n_tokens, n_known, base_score, score."""
        m = self.model
        v, w, inverse, _ = block.pairs()
        h = block.hashes()
        stats = self.words(h)
        logs = np.log10(m.probability(self.pairs(block, h[v], h[w]), {s: x[v] for s, x in stats.items()}, m.unigram(stats["nc"])[w]))[inverse]
        count = stats["c"].copy()
        count[1] = m.train_docs
        base = np.log10((count + 0.5) / (m.train_tokens + 0.5 * (m.vocabulary + 1)))
        seconds = np.concatenate([d[1:] for d in block.docs])
        lengths = np.array([len(d) - 1 for d in block.docs])
        sums = lambda x: np.add.reduceat(x, np.concatenate([[0], np.cumsum(lengths)[:-1]]))
        return {"n_tokens": lengths, "n_known": sums((count > 0)[seconds].astype(np.int64)), "base_score": sums(base[seconds]), "score": sums(logs)}


def score(docs: DataFrame, model: Model, keep: list[str], asked: bool = False) -> DataFrame:
    """The columns `keep` of docs with n_tokens, n_known, train_tokens (long), base_score, score and perplexity (double).

    score is the log10 probability of the text and its end; a null text is an empty one. asked: the model
    was trained on these docs, or ask() has run over them.
    """
    if not asked:
        ask(docs, model)
    extra = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    kinds = ["long", "long", "long", "double", "double", "double"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(model)

        def rows(block: Block, kept: list[pa.RecordBatch]) -> pa.RecordBatch:
            s = lookup.scores(block)
            n = len(s["score"])
            cells = [s["n_tokens"], s["n_known"], np.full(n, model.train_tokens), s["base_score"], s["score"], 10 ** np.minimum(-s["score"] / s["n_tokens"], 300)]
            table = pa.Table.from_batches(kept).combine_chunks()
            have = [table.column(c).combine_chunks() for c in keep]
            return pa.RecordBatch.from_arrays([*have, *map(pa.array, cells)], [*keep, *extra])

        block, kept = Block(), []
        for batch in batches:
            start = 0
            for i, text in enumerate(batch.column("text")):
                block.add(text.as_buffer().to_pybytes() if text.is_valid else b"")
                if block.size >= BLOCK_TOKENS:
                    yield rows(block, [*kept, batch.select(keep).slice(start, i + 1 - start)])
                    block, kept, start = Block(), [], i + 1
            if start < batch.num_rows:
                kept.append(batch.select(keep).slice(start))
        if block.docs:
            yield rows(block, kept)

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"{c} {k}" for c, k in zip(extra, kinds, strict=True))])
    return docs.select(*keep, "text").mapInArrow(run, schema)


def held_out_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of all documents.

    The model learns from documents whose crc32(doc_id as text) mod 5 is not 1; the
    others, and only they, are held out. A null doc_id is not held out. The scores are
    kept, the model's files are then removed. Null and empty texts are an end alone; repeated rows are learnt
    from and scored each; other columns, whatever their names, are left out. An empty table gives no rows.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    rows = docs.select("doc_id", "text", held.alias("held_out"), (~held).alias("learns"))
    model = train(rows)
    scored = checkpointed(score(rows, model, ["doc_id", "held_out"], asked=True))
    delete(model)
    return scored.drop("perplexity")
