"""New batches against all history: a kept index of graph shards over word sets.

The index is a folder. Every delivery of rows becomes a segment of it: the word sets are dealt into shards of bounded
size, each a navigable small-world graph that is written as one row, with the ids of its sets and the hashes of the
rows beside it. Later deliveries load the graphs and read no text of earlier ones. Segments of one level are compacted,
several into one of the next level, by a fixed schedule; a manifest names the segments that are in force.

A graph links every set with the nearest of those that stand beside it in a number of orders, each sorted by a tuple of
minhashes, and with a few random sets far away. A search enters every order where the query would stand, and widens a
beam along the links while it gets closer. Distances on the way are those of bit signatures; sets that come near the
threshold are compared exactly. The width of the beam is tuned for each shard when it is built: it is doubled until the
beam finds what exhaustive search finds for a sample of queries at the threshold's distance. Where a beam is full of
near sets that are all too young, the query is compared with the whole shard, so that large groups of copies lose
nothing.

Shards are cut by the sizes of sets first: sets that differ in size by more than the threshold allows can't be alike,
so a query goes to the shards of three neighbouring bands of sizes only. Equal sets are one node with the age of the
earliest, so copies don't fill a beam. Shards are searched in blocks of queries, and nothing that grows with the rows
is sent to the driver: it sees counts for each band and the names of segments.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.session import cut, shared_folder, shuffle_partitions

ORDERS = 12
TUPLE = 4
SIDE = 2
#: Links of a node: the nearest of its neighbours in the orders, and random ones.
NEAR, FAR = 16, 4
BEAM = 12
ROUNDS = 3
EXPAND = 2
#: Signature similarity from which sets are compared exactly, below the threshold by this much.
MARGIN = 0.12
WORDS = 8
#: Sets of a shard at most, about 550 bytes each with 60 words; queries that meet a shard at a time.
SHARD_SETS = 50_000
SHARDS_PER_FILE = 4
BLOCK_QUERIES = 20_000
#: A beam is widened until it finds this share of what exhaustive search finds, on so many queries of the shard.
BEAM_RECALL, TUNED_ON, WIDEST = 0.99, 100, 192
#: Segments of one level that are compacted into one of the next.
FAN = 4
#: Age of rows that are history from the start: before any batch.
BEFORE_ALL = -(1 << 63)


def word_set(text: Column) -> Column:
    """Sorted distinct 32-bit hashes of the runs of [A-Za-z0-9_] in a text; null for null."""
    words = F.regexp_extract_all(text, F.lit("([A-Za-z0-9_]+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.shiftright(F.xxhash64(w), 32).cast("int"))))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def order_keys(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sort keys [sets, ORDERS]: TUPLE minhashes of 16 bits each in one number. Sets must not be empty."""
    seeds = _mix(np.arange(1, ORDERS * TUPLE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    n = len(offsets) - 1
    out = np.empty((n, ORDERS), dtype=np.uint64)
    base = _mix(values.astype(np.uint32).astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    for a in range(0, n, 512):
        b = min(n, a + 512)
        part = base[offsets[a] : offsets[b]]
        h = (part[:, None] ^ seeds) * np.uint64(0xC4CEB9FE1A85EC53)
        least = np.minimum.reduceat(h, offsets[a:b] - offsets[a], axis=0)
        short = (_mix(least) >> np.uint64(48)).reshape(b - a, ORDERS, TUPLE)
        key = short[:, :, 0]
        for t in range(1, TUPLE):
            key = (key << np.uint64(16)) | short[:, :, t]
        out[a:b] = key
    return out


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One bit of 64 * WORDS for each word of a set."""
    n = len(offsets) - 1
    sig = np.zeros(n * WORDS, dtype=np.uint64)
    bit = _mix(values.astype(np.uint32).astype(np.uint64)) % np.uint64(64 * WORDS)
    row = np.repeat(np.arange(n), np.diff(offsets))
    np.bitwise_or.at(sig, row * WORDS + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return sig.reshape(n, WORDS)


def _chunks(n: int, size: int = 4096):
    return ((a, min(n, a + size)) for a in range(0, n, size))


class Shard:
    """Navigable graph of sets: words with offsets, ages as batch and row, and the parts that make it searchable."""

    #: Stored arrays with their types.
    PARTS = {"values": np.int32, "offsets": np.int64, "batches": np.int64, "rows": np.int64, "sig": np.uint64, "keys": np.uint64, "orders": np.int32, "links": np.int32}

    def __init__(self, parts: dict[str, np.ndarray], width: int = BEAM):
        self.parts, self.width = parts, width
        self.values, self.offsets, self.batches, self.rows = (parts[k] for k in ("values", "offsets", "batches", "rows"))
        self.n = n = len(self.batches)
        self.sig, self.links = parts["sig"].reshape(n, WORDS), parts["links"].reshape(n, -1)
        self.orders = parts["orders"].reshape(ORDERS, n)
        self.sorted = [parts["keys"].reshape(n, ORDERS)[o, i] for i, o in enumerate(self.orders)]
        self.bits = np.bitwise_count(self.sig).sum(axis=1, dtype=np.int32)

    @classmethod
    def build(cls, values: np.ndarray, offsets: np.ndarray, batches: np.ndarray, rows: np.ndarray) -> Shard:
        n = len(batches)
        keys, sig = order_keys(values, offsets), signatures(values, offsets)
        orders, beside = np.empty((ORDERS, n), dtype=np.int32), []
        for i in range(ORDERS):
            orders[i] = np.argsort(keys[:, i], kind="stable")
            place = np.empty(n, dtype=np.int64)
            place[orders[i]] = np.arange(n)
            for d in range(1, SIDE + 1):
                beside += [orders[i][np.minimum(place + d, n - 1)], orders[i][np.maximum(place - d, 0)]]
        beside = np.stack(beside, axis=1)
        links = np.random.default_rng(n).integers(0, n, (n, NEAR + FAR), dtype=np.int32)
        parts = {"values": values, "offsets": offsets, "batches": batches, "rows": rows, "sig": sig, "keys": keys, "orders": orders, "links": links}
        shard = cls(parts)
        for a, z in _chunks(n):
            sims = shard.near(sig[a:z], shard.bits[a:z], beside[a:z])
            sims[beside[a:z] == np.arange(a, z)[:, None]] = -1
            links[a:z, : min(NEAR, beside.shape[1])] = cls._best(beside[a:z], sims, NEAR)[0]
        return shard

    @classmethod
    def load(cls, row: dict) -> Shard:
        return cls({k: np.frombuffer(row[k], dtype=t) for k, t in cls.PARTS.items()}, row["width"])

    def stored(self) -> dict[str, bytes]:
        return {k: np.ascontiguousarray(self.parts[k], dtype=t).tobytes() for k, t in self.PARTS.items()}

    def near(self, sig: np.ndarray, bits: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Signature similarity of queries [q] to nodes [q, k]."""
        both = np.zeros(nodes.shape, dtype=np.int32)
        for w in range(WORDS):
            both += np.bitwise_count(self.sig[nodes, w] & sig[:, w, None])
        return both / np.maximum(1, bits[:, None] + self.bits[nodes] - both)

    def beam(self, keys: np.ndarray, sig: np.ndarray, bits: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The nodes of each query's final beam, nearest first, and their signature similarity; repeats have -1."""
        entry = []
        for i in range(ORDERS):
            at = np.searchsorted(self.sorted[i], keys[:, i])
            entry += [self.orders[i][np.clip(at + d, 0, self.n - 1)] for d in range(-SIDE, SIDE)]
        cand = np.stack(entry, axis=1)
        nodes, sims = self._best(cand, self.near(sig, bits, cand), width)
        for r in range(ROUNDS):
            top = nodes[:, r * EXPAND : (r + 1) * EXPAND]
            if top.shape[1] == 0:
                break
            cand = self.links[top].reshape(len(nodes), -1)
            nodes, sims = self._best(np.hstack([nodes, cand]), np.hstack([sims, self.near(sig, bits, cand)]), width)
        return nodes, sims

    @staticmethod
    def _best(nodes: np.ndarray, sims: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The width nearest different nodes of each row."""
        order = np.argsort(nodes, axis=1, kind="stable")
        nodes, sims = np.take_along_axis(nodes, order, 1), np.take_along_axis(sims, order, 1)
        sims = sims.copy()
        sims[:, 1:][nodes[:, 1:] == nodes[:, :-1]] = -1
        width = min(width, nodes.shape[1])
        part = np.argpartition(-sims, width - 1, axis=1)[:, :width]
        nodes, sims = np.take_along_axis(nodes, part, 1), np.take_along_axis(sims, part, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(nodes, order, 1), np.take_along_axis(sims, order, 1)

    def words(self, i: int) -> np.ndarray:
        return self.values[self.offsets[i] : self.offsets[i + 1]]

    def tune(self, threshold: float) -> float:
        """Doubles the beam until it finds what exhaustive search finds, and gives the recall it reaches then.

        Queries are sets of the shard, spread over it, that have lost as many words as the threshold allows.
        """
        rng = np.random.default_rng(self.n)
        queries = []
        for i in np.unique(np.linspace(0, self.n - 1, TUNED_ON).astype(int)):
            w = self.words(i)
            queries.append(np.delete(w, rng.choice(len(w), min(len(w) - 1, int(len(w) * (1 - threshold) + 1e-9)), replace=False)))
        values, offsets = np.concatenate(queries), np.concatenate([[0], np.cumsum([len(q) for q in queries])])
        last = np.full(len(queries), (1 << 63) - 1)
        wanted = np.array([self._any_older(set(q.tolist()), np.arange(self.n)[self._alike(s, b, threshold - MARGIN)], last[0], 0, threshold) for q, s, b in zip(queries, *self._signed(values, offsets))])
        while True:
            found = self.older_like(values, offsets, last, last, threshold, exhaustive=False)
            recall = float((found & wanted).sum() / max(1, wanted.sum()))
            if recall >= BEAM_RECALL or self.width >= min(WIDEST, self.n):
                return recall
            self.width *= 2

    @staticmethod
    def _signed(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sig = signatures(values, offsets)
        return sig, np.bitwise_count(sig).sum(axis=1, dtype=np.int32)

    def older_like(self, values: np.ndarray, offsets: np.ndarray, batches: np.ndarray, rows: np.ndarray, threshold: float, exhaustive: bool = True) -> np.ndarray:
        """Whether each query set has a similar set in the shard that is older than it."""
        q = len(batches)
        found = np.zeros(q, dtype=bool)
        if not self.n or not q:
            return found
        sig, bits = self._signed(values, offsets)
        keys = order_keys(values, offsets)
        least = threshold - MARGIN
        for a, z in _chunks(q, 1024):
            nodes, sims = self.beam(keys[a:z], sig[a:z], bits[a:z], self.width)
            hit = sims >= least
            for i in np.flatnonzero(hit.any(axis=1)):
                mine = set(values[offsets[a + i] : offsets[a + i + 1]].tolist())
                near = nodes[i][hit[i]]
                age = batches[a + i], rows[a + i]
                found[a + i] = self._any_older(mine, near, *age, threshold)
                if exhaustive and not found[a + i] and hit[i].all() and self.n > len(near):
                    found[a + i] = self._any_older(mine, np.flatnonzero(self._alike(sig[a + i], bits[a + i], least) & self._older(*age)), *age, threshold)
        return found

    def _older(self, batch: int, row: int) -> np.ndarray:
        return (self.batches < batch) | ((self.batches == batch) & (self.rows < row))

    def _alike(self, sig: np.ndarray, bits: int, least: float) -> np.ndarray:
        both = np.bitwise_count(self.sig & sig).sum(axis=1, dtype=np.int32)
        return both / np.maximum(1, bits + self.bits - both) >= least

    def _any_older(self, mine: set, nodes: np.ndarray, batch: int, row: int, threshold: float) -> bool:
        for j in nodes:
            if (self.batches[j], self.rows[j]) < (batch, row):
                w = self.words(j)
                both = len(mine.intersection(w.tolist()))
                if both >= threshold * (len(mine) + len(w) - both) - 1e-9:
                    return True
        return False


# --- the kept index -----------------------------------------------------------------------------------------------

_SHARD = "segment string, shard int, band int, n int, width int, recall double, " + ", ".join(f"{p} binary" for p in Shard.PARTS)


def _lists(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    col = pa.concat_arrays(col.chunks) if col.num_chunks != 1 else col.chunk(0)
    values = col.flatten().to_numpy(zero_copy_only=False)
    return values, np.concatenate([[0], np.cumsum(np.diff(col.offsets.to_numpy()))]).astype(np.int64)


def _builder(segment: str, threshold: float):
    def run(table: pa.Table) -> pa.Table:
        shard = Shard.build(*_lists(table.column("words")), table.column("batch").to_numpy(), table.column("row").to_numpy())
        recall = shard.tune(threshold)
        one = {"segment": segment, "shard": table.column("shard")[0].as_py(), "band": table.column("band")[0].as_py(), "n": shard.n, "width": shard.width, "recall": recall, **shard.stored()}
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), *[pa.binary()] * len(Shard.PARTS)]
        return pa.table({k: pa.array([v], t) for (k, v), t in zip(one.items(), kinds)})

    return run


def _searcher(threshold: float):
    def run(shards: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(shards) or not len(queries):
            return pa.table({"set_id": pa.array([], pa.int64())})
        shard = Shard.load(shards.to_pylist()[0])
        found = shard.older_like(*_lists(queries.column("words")), queries.column("batch").to_numpy(), queries.column("row").to_numpy(), threshold)
        return pa.table({"set_id": pa.array(queries.column("set_id").to_numpy()[found], pa.int64())})

    return run


class HistoryIndex:
    """Everything accepted so far, in a folder that all executors reach; a new folder is an empty index.

    threshold: least similarity of two sets of words, shared by either; it is kept with the index. Rows are (row_id long,
    batch int, hash string, text string): a row is earlier by a lower batch, or the same batch and a lower row_id, and
    repeated rows count once. A null hash equals nothing, a null text or one without words resembles nothing.
    """

    def __init__(self, spark: SparkSession, path: str, threshold: float = 0.8, fan: int = FAN):
        self.spark, self.path, self.threshold, self.fan = spark, path.rstrip("/"), threshold, fan
        self.version, self.segments = 0, []
        try:
            last = spark.read.parquet(f"{self.path}/manifest").orderBy(F.desc("version")).first()
        except AnalysisException:
            last = None
        if last:
            self.version, self.segments, self.threshold = last.version, [(s.name, s.level) for s in last.segments], last.threshold

    def _commit(self, segments: list[tuple[str, int]]) -> None:
        self.version += 1
        self.segments = segments
        row = self.spark.createDataFrame([(self.version, self.threshold, segments)], "version long, threshold double, segments array<struct<name string, level int>>")
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _read(self, part: str, segments: list[tuple[str, int]] | None = None) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{name}/{part}" for name, _ in (self.segments if segments is None else segments)])

    def _band(self, size: Column) -> Column:
        return F.floor(F.log(size.cast("double")) / F.lit(math.log(1 / self.threshold)) + 1e-9).cast("int")

    def _parts(self) -> int:
        return max(shuffle_partitions(self.spark), 2 * self.spark.sparkContext.defaultParallelism)

    def _write(self, sets: DataFrame, hashes: DataFrame, level: int, kept: list[tuple[str, int]]) -> None:
        """A new segment of sets (set_id, words, batch, row) and hashes (hash, batch, row), and the manifest with it."""
        name = f"segment-{self.version + 1}-{uuid.uuid4().hex[:8]}"
        sized = sets.withColumn("band", self._band(F.size("words")))
        counts = {r.band: r.n for r in sized.groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each band of sizes
        first, starts = 0, {}
        for band, n in sorted(counts.items()):
            starts[band] = (first, max(1, math.ceil(n / SHARD_SETS)))
            first += starts[band][1]
        home = F.lit(0)
        for band, (start, n) in starts.items():
            home = F.when(F.col("band") == band, F.lit(start) + F.pmod(F.xxhash64("set_id"), F.lit(n)).cast("int")).otherwise(home)
        placed = sized.withColumn("shard", home.cast("int")).repartition(self._parts(), "shard")
        # few rows to a file, as a writer or reader may hold all rows of one at a time
        built = placed.groupBy("shard").applyInArrow(_builder(name, self.threshold), _SHARD)
        built.write.option("maxRecordsPerFile", SHARDS_PER_FILE).parquet(f"{self.path}/{name}/shards")
        sets.select("set_id", "batch", "row").write.parquet(f"{self.path}/{name}/sets")
        hashes.write.parquet(f"{self.path}/{name}/hashes")
        self._commit([*kept, (name, level)])

    @staticmethod
    def _prepared(rows: DataFrame) -> DataFrame:
        """Each row once: row, batch, hash, words, set_id."""
        words = word_set(F.col("text"))
        flat = rows.select(F.col("row_id").cast("long").alias("row"), F.struct(F.col("batch").cast("long").alias("batch"), F.col("hash"), words.alias("words")).alias("r"))
        once = flat.groupBy("row").agg(F.min("r").alias("r")).select("row", "r.*")
        return cut(once.withColumn("set_id", F.when(F.size("words") > 0, F.xxhash64("words"))))

    @staticmethod
    def _sets(rows: DataFrame) -> DataFrame:
        """Each set once, with its earliest age."""
        return rows.filter("set_id is not null").groupBy("set_id").agg(F.min("words").alias("words"), F.min(F.struct("batch", "row")).alias("a")).select("set_id", "words", "a.*")

    @staticmethod
    def _hashes(rows: DataFrame) -> DataFrame:
        return rows.filter("hash is not null").groupBy("hash").agg(F.min(F.struct("batch", "row")).alias("a")).select("hash", "a.*")

    def add_history(self, texts: DataFrame, hashes: DataFrame) -> None:
        """Takes in texts (text) and hashes (hash) that are older than any batch."""
        words = texts.select(word_set(F.col("text")).alias("words")).filter(F.size("words") > 0)
        sets = words.groupBy(F.xxhash64("words").alias("set_id")).agg(F.min("words").alias("words")).withColumns({"batch": F.lit(BEFORE_ALL), "row": F.lit(0).cast("long")})
        known = hashes.filter("hash is not null").select("hash").distinct().withColumns({"batch": F.lit(BEFORE_ALL), "row": F.lit(0).cast("long")})
        self._write(cut(sets), known, 0, self.segments)

    def check(self, rows: DataFrame) -> DataFrame:
        """(row_id): the rows of one or more batches that repeat or nearly repeat something older, in the index or among
        themselves. They become a segment of the index, repeats too. Only the index is read, no text of earlier rows."""
        mine = self._prepared(rows)
        sets = cut(self._sets(mine))
        self._write(sets, self._hashes(mine), 0, self.segments)
        age = F.struct("batch", "row")
        equal = self._read("sets").groupBy("set_id").agg(F.min(age).alias("set_age")).hint("merge")
        known = self._read("hashes").groupBy("hash").agg(F.min(age).alias("hash_age")).hint("merge")
        # a set whose earliest row has something older alike has it for all its rows
        like = self._search(sets).withColumn("like", F.lit(True)).hint("merge")
        out = mine.join(known, "hash", "left").join(equal, "set_id", "left").join(like, "set_id", "left")
        case = F.coalesce(F.col("like"), F.lit(False)) | (F.col("hash_age") < age) | (F.col("set_age") < age)
        out = cut(out.filter(F.coalesce(case, F.lit(False))).select(F.col("row").alias("row_id")))
        self.compact()
        return out

    def _search(self, sets: DataFrame) -> DataFrame:
        """set_id of the sets that are like an older one of the index."""
        shards = self._read("shards")
        # a row for each shard: one for SHARD_SETS sets, or for each band of a segment
        places = F.broadcast(self._read("shards").select("segment", "shard", F.col("band").alias("place")))
        band = self._band(F.size("words"))
        bands = F.sequence(band - 1, band + 1)
        sent = sets.select("set_id", "words", "batch", "row", F.explode(bands).alias("place"))
        densest = sent.groupBy("place").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        blocks = max(1, math.ceil(densest / BLOCK_QUERIES))
        keys = ["segment", "shard", "block"]
        sent = sent.join(places, "place").drop("place").withColumn("block", F.pmod(F.xxhash64("set_id", F.lit(3)), F.lit(blocks)).cast("int"))
        held = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        n = self._parts()
        left, right = (x.repartition(n, *keys).groupBy(*keys) for x in (held, sent))
        return left.cogroup(right).applyInArrow(_searcher(self.threshold), "set_id long").distinct()

    def compact(self) -> int:
        """Joins every full set of segments of one level into one of the next; gives how many went. Words are read from
        the shards. Segments out of force stay in the folder until vacuum."""
        gone = 0
        for level in range(64):
            mine = [s for s in self.segments if s[1] == level]
            if len(mine) < self.fan:
                continue
            shards = self._read("shards", mine).select("values", "offsets", "batches", "rows")
            sets = cut(shards.mapInArrow(_unpacked, "words array<int>, batch long, row long").withColumn("set_id", F.xxhash64("words")))
            hashes = self._read("hashes", mine).groupBy("hash").agg(F.min(F.struct("batch", "row")).alias("a")).select("hash", "a.*")
            self._write(self._sets(sets), hashes, level + 1, [s for s in self.segments if s not in mine])
            gone += len(mine)
        return gone

    def report(self) -> DataFrame:
        """(segment, shard, band, n, width, recall) of the shards in force: their tuned beams and what these find."""
        return self._read("shards").select("segment", "shard", "band", "n", "width", "recall")


def _unpacked(batches):  # type: ignore[no-untyped-def]
    """Rows of sets from stored shards."""
    for b in batches:
        for r in b.to_pylist():
            values, offsets, batch, row = (np.frombuffer(r[k], dtype=Shard.PARTS[k]) for k in ("values", "offsets", "batches", "rows"))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values)), pa.array(batch), pa.array(row)], names=["words", "batch", "row"])


def repeats_of_known(incoming: DataFrame, known_texts: DataFrame, known_hashes: DataFrame, threshold: float, path: str | None = None) -> DataFrame:
    """(row_id): the incoming rows that repeat or nearly repeat something known or an earlier incoming row.

    A new index takes in known_texts (text) and known_hashes (hash) once, and incoming is checked against it, see
    HistoryIndex. path: where the index is kept for later batches; by default beside the checkpoints. Empty tables work.
    """
    index = HistoryIndex(incoming.sparkSession, path or shared_folder(incoming.sparkSession, "history"), threshold)
    index.add_history(known_texts, known_hashes)
    return index.check(incoming)
