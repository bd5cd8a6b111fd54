"""Operator 12: documents packed into sequences by a grouping genetic algorithm on islands.

Texts are encoded where they are read; only the lengths of pieces travel. Whole pieces are sequences by themselves. The
others are dealt over blocks of some BLOCK pieces, each a problem of its own. On each of ISLANDS islands a
population of packings of the block evolves: crossover injects whole well-filled bins of one parent into another, which gives up
the bins that hold the same pieces; their other pieces are displaced and put back where they fit best. Between
epochs each island's best packing migrates to the next. Of a block's best packing, the worst-filled bins are
opened again: their pieces move on to the next level, where blocks are made anew, until one block is left; so what blocks
waste doesn't add up.

Islands stop once a packing needs no more bins than Martello and Toth's lower bound and leaves room in one alone.
Null and empty texts are one token, the end. A text of any length is encoded as a whole and cut afterwards. Repeated rows
are pieces each (they are told apart by their place). An empty table gives an empty result. Extra columns don't matter.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe, shared

CAPACITY, END = 2048, 0
BLOCK, ISLANDS, EPOCHS, GENERATIONS, POPULATION, SEED = 4096, 2, 2, 12, 6, 20240229
#: The bins that stay of a block have the ROOM-th of one together; of INJECTED bins a crossover injects one.
ROOM, INJECTED = 32, 12


# Encoding.
class Encoder:
    """Token ids of whole texts by the vocabulary of a tokenizers file. Where its merges come in the order of
    the ids that they make, ranks say the same and the encoder for ranks, which is four times as fast, gives the same ids."""

    def __init__(self, spec: str):
        model, letters = json.loads(spec), bpe.byte_alphabet()
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        vocab = {t: i for t, i in model["model"]["vocab"].items() if t not in special}
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["model"]["merges"]]
        self.ranks = None
        if made == sorted(set(made)):
            ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
            self.ranks = tiktoken.Encoding("file", pat_str=bpe.PIECES, mergeable_ranks=ranks, special_tokens=special)
        self.spec, self.exact = spec, None

    def ids(self, text: str) -> np.ndarray:
        if self.ranks is not None:
            try:
                return self.ranks.encode_to_numpy(text, allowed_special="all")
            except Exception:  # noqa: BLE001  its pattern matcher gives up on some very long runs
                pass
        if self.exact is None:
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_str(self.spec)
            self.exact.no_padding()
            self.exact.no_truncation()
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


_BUILT: dict[str, Encoder] = {}


def built(spec: str) -> Encoder:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Encoder(spec)
    return _BUILT[key]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, vocabulary: str | None = None, ids: bool = False) -> DataFrame:
    """Pieces of documents, written to the shared folder: item (unique), doc_id, piece, start, length, ids_crc32 and, on request,
    ids as little-endian unsigned 32-bit integers. A document's first piece takes what doesn't fill a whole one."""
    with open(vocabulary or bpe.default_vocabulary(), encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = built(spec.value)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                keys, texts = b.column(0).slice(at, 500), b.column(1).slice(at, 500)
                of, number, start, length, crc, raws = [], [], [], [], [], []
                for k in range(len(texts)):
                    found = np.append(encoder.ids(texts[k].as_py() or "").astype("<u4"), np.uint32(end)).astype("<u4")
                    cuts = [0, *range(len(found) % capacity or capacity, len(found) + 1, capacity)]
                    for p, (one, two) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        raw = found[one:two].tobytes()
                        of.append(k)
                        number.append(p)
                        start.append(one)
                        length.append(two - one)
                        crc.append(zlib.crc32(raw))
                        raws.append(raw)
                columns = [keys.take(pa.array(of, pa.int32())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.record_batch(columns + ([pa.array(raws, pa.binary())] if ids else []), names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + (["ids"] if ids else [])
    kinds = [docs.schema[doc_id].dataType, T.IntegerType(), T.LongType(), T.LongType(), T.LongType(), T.BinaryType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=False)])
    return shared.stored(docs.select(doc_id, text).mapInArrow(run, schema).withColumn("item", F.monotonically_increasing_id()), "pieces")


# One block.
def least_bins(sizes: np.ndarray, capacity: int) -> int:
    """Martello and Toth's second lower bound: for each k, pieces above capacity-k are alone, those above half stand apart, and
    what of those from k up to half finds no room beside them needs further bins."""
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    pieces_to, tokens_to = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    half, k = capacity // 2, np.arange(capacity // 2 + 1)
    alone, big = len(sizes) - pieces_to[capacity - k], pieces_to[capacity - k] - pieces_to[half]
    room = big * capacity - (tokens_to[capacity - k] - tokens_to[half])
    rest = tokens_to[half] - np.where(k > 0, tokens_to[np.maximum(k - 1, 0)], 0)
    return int((alone + big + np.maximum(-(-(rest - room) // capacity), 0)).max())


def best_fit(order: list[int], sizes: list[int], bins: np.ndarray, fill: list[int], capacity: int) -> None:
    """Puts pieces, in this order, into the bin whose room they leave least of, or a new one. Bins by their room in lists,
    and the rooms that occur as the bits of a number: the least that is large enough is its lowest bit from there."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    there = 0
    for i, f in enumerate(fill):
        if 0 < f < capacity:
            by_room[capacity - f].append(i)
            there |= 1 << (capacity - f)
    for item in order:
        size = sizes[item]
        fits = there >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            i = by_room[room].pop()
            if not by_room[room]:
                there ^= 1 << room
        else:
            i, room = len(fill), capacity
            fill.append(0)
        bins[item] = i
        fill[i] += size
        room -= size
        if room:
            by_room[room].append(i)
            there |= 1 << room


def tidy(bins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins numbered without gaps, and how full each is."""
    bins = np.unique(bins, return_inverse=True)[1]
    return bins, np.bincount(bins, weights=sizes).astype(np.int64)


def worth(fill: np.ndarray, capacity: int) -> tuple[int, float]:
    """Packings by the number of bins, then by how unequally these are filled: full bins leave room in few."""
    return -len(fill), float(np.square(fill / capacity).sum())


def crossed(one: np.ndarray, two: np.ndarray, sizes: np.ndarray, listed: list[int], capacity: int, draw: np.random.Generator) -> np.ndarray:
    """``one`` with some well-filled bins of ``two``."""
    fill, full = np.bincount(one, weights=sizes).astype(np.int64), np.bincount(two, weights=sizes).astype(np.int64)
    good = np.argsort(-full, kind="stable")[: max(1, len(full) // 2)]
    take = np.zeros(len(full), bool)
    take[draw.choice(good, max(1, len(full) // INJECTED), replace=False) if len(good) > len(full) // INJECTED else good] = True
    injected = take[two]
    hit = np.zeros(len(fill), bool)
    hit[one[injected]] = True
    poor = np.argsort(fill, kind="stable")[: 1 + len(fill) // 50]  # and the worst bins: the mutation
    hit[poor] = True
    displaced = hit[one] & ~injected
    child = one.copy()
    child[injected] = len(fill) + two[injected]
    child[displaced] = -1
    kept, back = ~displaced, np.flatnonzero(displaced)
    child[kept], filled = tidy(child[kept], sizes[kept]) if kept.any() else (child[kept], np.zeros(0, np.int64))
    order = back[np.argsort(-(sizes[back] + draw.uniform(0, draw.choice([0.5, 40.0]), len(back))), kind="stable")]
    room = filled.tolist()
    best_fit(order.tolist(), listed, child, room, capacity)
    return child


def evolved(sizes: np.ndarray, population: list[np.ndarray], generations: int, size: int, capacity: int, seed: list[int]) -> list[np.ndarray]:
    """The population after some generations, best first. It is filled up with best-fit packings."""
    draw, listed = np.random.default_rng(seed), sizes.tolist()
    population = list(population)
    while len(population) < size:
        bins, fill = np.empty(len(sizes), np.int64), []
        noise = draw.uniform(0, 1 + 60 * len(population), len(sizes)) if population or seed[-1] else 0
        best_fit(np.argsort(-(sizes + noise), kind="stable").tolist(), listed, bins, fill, capacity)
        population.append(bins)
    rank = lambda p: worth(np.bincount(p, weights=sizes), capacity)
    scored = sorted(((rank(p), i, p) for i, p in enumerate(population)), key=lambda s: (s[0], -s[1]), reverse=True)[:size]
    least = least_bins(sizes, capacity)
    born = len(population)
    for _ in range(generations):
        if done(scored[0][2], sizes, least, capacity):
            break
        for _ in range(size // 2):
            a, b = (min(draw.integers(0, len(scored), 2)) for _ in range(2))
            if a == b:
                b = (a + 1) % len(scored)
            child = crossed(scored[a][2], scored[b][2], sizes, listed, capacity, draw)
            born += 1
            scored.append((rank(child), born, child))
        scored = sorted(scored, key=lambda s: (s[0], -s[1]), reverse=True)[:size]
    return [p for _, _, p in scored]


def done(bins: np.ndarray, sizes: np.ndarray, least: int, capacity: int) -> bool:
    """Whether no packing of these pieces leaves better bins."""
    fill = np.bincount(bins, weights=sizes)
    return len(fill) <= least and (fill < capacity).sum() <= 1


# Blocks as Spark rows.
STATE = "block long, island int, items array<long>, sizes array<int>, population array<array<int>>, bins int, worth double"


def islands_of(rest: DataFrame, level: int, blocks: int, capacity: int, generations: int = GENERATIONS, islands: int = ISLANDS) -> DataFrame:
    """A row of STATE for each block and island, after the first epoch. ``rest``: item, length."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        t = group.sort_by("item")
        sizes = t.column("length").to_numpy().astype(np.int64)
        block, island = key[0].as_py(), key[1].as_py()
        return state(block, island, t.column("item").to_numpy(), sizes, evolved(sizes, [], generations, POPULATION, capacity, [SEED, level, block, island]), capacity)

    dealt = rest.select("item", "length", F.pmod(F.xxhash64("item", F.lit(SEED + level)), F.lit(blocks)).alias("block"), F.explode(F.array(*map(F.lit, range(islands)))).alias("island"))
    return dealt.groupBy("block", "island").applyInArrow(run, STATE)


def state(block: int, island: int, items: np.ndarray, sizes: np.ndarray, population: list[np.ndarray], capacity: int) -> pa.Table:
    bins, value = worth(np.bincount(population[0], weights=sizes), capacity)
    one = lambda x, kind: pa.array([x], kind)
    return pa.table([one(block, pa.int64()), one(island, pa.int32()), one(items, pa.list_(pa.int64())), one(sizes.astype(np.int32), pa.list_(pa.int32())), one([p.astype(np.int32) for p in population], pa.list_(pa.list_(pa.int32()))), one(-bins, pa.int32()), one(value, pa.float64())], names=["block", "island", "items", "sizes", "population", "bins", "worth"])


def migrated(states: DataFrame, level: int, epoch: int, capacity: int, islands: int = ISLANDS) -> DataFrame:
    """The next epoch: the best packing of each island joins the population of the next island of its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                array = lambda c, r=r: b.column(c)[r].values.to_numpy(zero_copy_only=False)
                sizes, block, island = array("sizes").astype(np.int64), b.column("block")[r].as_py(), b.column("island")[r].as_py()
                own = [p.values.to_numpy(zero_copy_only=False).astype(np.int64) for p in b.column("population")[r].values]
                guest = array("guest").astype(np.int64)
                grown = evolved(sizes, [*own, guest], GENERATIONS, POPULATION, capacity, [SEED, level, block, island, epoch])
                yield from state(block, island, array("items"), sizes, grown, capacity).to_batches()

    elite = states.select("block", ((F.col("island") + 1) % islands).cast("int").alias("island"), F.get("population", F.lit(0)).alias("guest"))
    return states.join(elite, ["block", "island"]).mapInArrow(run, STATE)


def opened(states: DataFrame, level: int, capacity: int, last: bool) -> DataFrame:
    """Pieces of each block's best packing with sequence_id and offset; ``stays`` is false for those of its worst bins, which are opened
    until the others leave no more room than the ROOM-th of one, but no more than half of the pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                array = lambda c, r=r: b.column(c)[r].values.to_numpy(zero_copy_only=False)
                items, sizes, block = array("items"), array("sizes").astype(np.int64), b.column("block")[r].as_py()
                bins, fill = tidy(array("best").astype(np.int64), sizes)
                order = np.argsort(bins, kind="stable")
                upto = np.cumsum(sizes[order])
                first = np.concatenate(([0], np.cumsum(fill)[:-1]))
                offset = np.empty(len(items), np.int64)
                offset[order] = upto - sizes[order] - first[bins[order]]
                stays = np.ones(len(fill), bool)
                if not last:
                    held, poor = np.bincount(bins), np.argsort(fill, kind="stable")
                    room = (capacity - fill).sum() - np.concatenate(([0], np.cumsum((capacity - fill)[poor])[:-1]))
                    stays[poor[(room > capacity // ROOM) & (np.cumsum(held[poor]) <= len(items) // 2)]] = False
                ids = ((level << 40) + block << 16) + bins
                yield pa.record_batch([pa.array(items), pa.array(sizes), pa.array(ids), pa.array(offset), pa.array(stays[bins])], names=["item", "length", "sequence_id", "offset", "stays"])

    best = states.groupBy("block").agg(F.min_by(F.struct("items", "sizes", F.get("population", F.lit(0)).alias("best")), F.struct("bins", -F.col("worth"), "island")).alias("b")).select("block", "b.*")
    return best.mapInArrow(run, "item long, length long, sequence_id long, offset long, stays boolean")


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The columns of ``found`` (as of pieces()) but item, with sequence_id and offset (gapless from 0 in each sequence)."""
    whole = found.filter(F.col("length") == capacity).select("item", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, level, homes = found.filter(F.col("length") < capacity).select("item", "length"), 0, whole
    while n := rest.count():
        blocks = -(-n // BLOCK)
        states = shared.stored(islands_of(rest, level, blocks, capacity), "islands")
        for epoch in range(1, EPOCHS):
            states = shared.stored(migrated(states, level, epoch, capacity), "islands")
        out = shared.stored(opened(states, level, capacity, blocks == 1), "packed")
        homes = homes.unionByName(out.filter("stays").select("item", "sequence_id", "offset"))
        rest, level = out.filter("NOT stays").select("item", "length"), level + 1
    return found.join(homes, "item").drop("item")


def sequences(packed: DataFrame) -> DataFrame:
    """Rows (sequence_id, length, ids) of packed pieces that carry their ids (pieces(ids=True)), in order of their places."""
    lists = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_p"))  # CAPACITY tokens at most
    return lists.select("sequence_id", "length", F.aggregate("_p", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(shared.table(spark, sf_dir, "documents").select("doc_id", "text")))
