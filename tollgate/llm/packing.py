"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents are tokenised (ids, then an end id), longer ones cut into full pieces after a shorter first one. Full pieces are
sequences of their own; the first pieces, one of each document, are packed.  Documents are dealt by a hash into
blocks of a bounded size, so that packing costs at most a part-filled sequence a block.  Each block is
packed by several islands, tasks of their own: a population of packings, best-fit decreasing among them, evolves by
crossovers that inject whole well-filled bins of one parent into the other, remove bins with duplicates and best-fit the
displaced documents.  Between epochs the elite of an island migrates to the next one.  An island stops at the lower bound.

Defined cases: null text counts as empty and packs as its end id alone; an empty table gives no rows; rows
repeated whole are packed each; a text of any length is tokenised whole; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.llm.bpe import Encoder
from tollgate.llm.common import grouped_arrow, prepare, scratch, slices, table

CAPACITY = 1024
END_ID = 2
#: Bytes of text that a task encodes at once.
SLICE = 1 << 20
BLOCK = 8192
ISLANDS = 2
EPOCHS = 2
POPULATION = 5
GENERATIONS = 6
TOKENS = "row long, doc_id long, n_tokens long, crcs array<long>, ids binary"


# ---- tokens ------------------------------------------------------------------------------------------------------

def vocabulary() -> tuple[str, str]:
    """(path, pre-tokenisation pattern) of the public byte-level vocabulary; its ids are those of byte_bpe_50k.json."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``n`` tokens: full ones after a first one that may be shorter."""
    first = n % capacity or capacity
    return [(0, first), *((a, a + capacity) for a in range(first, n, capacity))]


def tokenise(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row per document: its tokens' number, the CRC-32 of each piece and, if asked for, the ids (uint32, little-endian)."""
    spark = docs.sparkSession
    prepare(spark)

    def run(batches):
        encoder = Encoder(*vocabulary())
        for b in slices(batches, "text", SLICE):
            ids, off = encoder.encode(b.column("text"))
            counts, crcs, raws = [], [], []
            for i in range(b.num_rows):
                raw = ids[off[i]: off[i + 1]].astype("<u4").tobytes() + END_ID.to_bytes(4, "little")
                counts.append(len(raw) // 4)
                crcs.append([zlib.crc32(raw[4 * s: 4 * e]) for s, e in cuts(counts[-1], capacity)])
                raws.append(raw if with_ids else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(crcs, pa.list_(pa.int64())),
                 pa.array(raws, pa.binary())], names=["row", "doc_id", "n_tokens", "crcs", "ids"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, TOKENS)


# ---- the grouping genetic algorithm --------------------------------------------------------------------------------

class Bins:
    """Best fit in constant time: open bins by free space, and a bit mask of the free spaces that occur."""

    def __init__(self, lengths: list[int], capacity: int, bins: list[list[int]] = ()):
        self.lengths, self.capacity = lengths, capacity
        self.bins = [list(b) for b in bins]
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0
        for i, b in enumerate(self.bins):
            self._open(i, capacity - sum(lengths[x] for x in b))

    def _open(self, i: int, free: int) -> None:
        self.by_free[free].append(i)
        self.mask |= 1 << free

    def add(self, item: int) -> None:
        need = self.lengths[item]
        fitting = self.mask >> need
        if fitting:
            free = need + (fitting & -fitting).bit_length() - 1
            i = self.by_free[free].pop()
            if not self.by_free[free]:
                self.mask ^= 1 << free
            self.bins[i].append(item)
        else:
            i, free = len(self.bins), self.capacity
            self.bins.append([item])
        self._open(i, free - need)

    def add_all(self, items) -> Bins:
        for x in items:
            self.add(x)
        return self


def fitness(bins: list[list[int]], lengths: list[int], capacity: int) -> float:
    """Mean squared filling: for equal numbers of bins, better the more uneven they are filled."""
    return sum((sum(lengths[x] for x in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def swap(bins: list[list[int]], displaced: list[int], lengths: list[int], capacity: int) -> list[int]:
    """Fill bins by exchanging one or two of their documents for a displaced one that is longer and fits; returns what is
    displaced then, shorter documents that are easier to place."""
    waiting = sorted((lengths[x], x) for x in displaced)
    for b in bins:
        free = capacity - sum(lengths[x] for x in b)
        if not free or not waiting:
            continue
        best = (0, None, None)
        for n, x in enumerate(b):
            for out in [(x,), *((x, y) for y in b[n + 1:])]:
                size = sum(lengths[o] for o in out)
                at = bisect_right(waiting, (free + size, len(lengths))) - 1
                if at >= 0 and waiting[at][0] - size > best[0]:
                    best = (waiting[at][0] - size, at, out)
        if best[1] is not None:
            _, x = waiting.pop(best[1])
            for o in best[2]:
                b.remove(o)
                insort(waiting, (lengths[o], o))
            b.append(x)
    return [x for _, x in waiting]


def refill(bins: list[list[int]], displaced: list[int], lengths: list[int], capacity: int) -> list[list[int]]:
    """Displaced documents exchanged for shorter ones, then best-fitted, largest first."""
    bins = [list(b) for b in bins]
    rest = swap(bins, displaced, lengths, capacity)
    rest.sort(key=lambda x: (-lengths[x], x))
    return Bins(lengths, capacity, bins).add_all(rest).bins


def crossover(one, other, lengths, capacity, rng) -> list[list[int]]:
    """``one`` with a share of the best filled bins of ``other`` injected whole; bins of ``one`` that hold duplicates go, and what
    that displaces is placed anew."""
    fill = [sum(lengths[x] for x in b) for b in other]
    best = sorted(range(len(other)), key=lambda i: (-fill[i], i))[: max(1, len(other) // 2)]
    injected = [other[i] for i in best if rng.random() < 0.5] or [other[best[0]]]
    inside = {x for b in injected for x in b}
    kept, displaced = [], []
    for b in one:
        if inside.isdisjoint(b):
            kept.append(b)
        else:
            displaced += [x for x in b if x not in inside]
    return refill(injected + kept, displaced, lengths, capacity)


def mutate(bins, lengths, capacity, rng) -> list[list[int]]:
    """The worst filled bin and a few others dissolved, their documents placed anew."""
    order = sorted(range(len(bins)), key=lambda i: sum(lengths[x] for x in bins[i]))
    gone = {order[0], *rng.sample(range(len(bins)), min(len(bins), 2 + len(bins) // 20))}
    return refill([b for i, b in enumerate(bins) if i not in gone], [x for i in sorted(gone) for x in bins[i]], lengths, capacity)


def lower_bound(lengths: list[int], capacity: int) -> int:
    """Sequences that any packing needs (Martello and Toth's second bound): for every k, documents over half a sequence
    need one each, and those from k up to a half only fit beside the ones of at most capacity - k."""
    x = np.sort(np.asarray(lengths, np.int64))
    if not len(x):
        return 0
    upto = np.concatenate([[0], np.cumsum(x)])
    k = np.arange(0, capacity // 2 + 1)
    half = np.searchsorted(x, capacity // 2, side="right")
    most = np.searchsorted(x, capacity - k, side="right")  # from here on: over capacity - k
    least = np.searchsorted(x, k, side="left")
    middle = most - half
    room = middle * capacity - (upto[most] - upto[half])
    over = np.maximum(0, upto[half] - upto[least] - room)
    return int((len(x) - most + middle + -(-over // capacity)).max())


def evolve(lengths: list[int], population: list[list[list[int]]], capacity: int, rng, generations: int, size: int) -> list:
    """The population after some generations, best first; ends early at the lower bound."""
    bound = lower_bound(lengths, capacity)
    rank = lambda p: (len(p), -fitness(p, lengths, capacity))
    order = sorted(range(len(lengths)), key=lambda x: (-lengths[x], x))
    if not population:
        population = [Bins(lengths, capacity).add_all(order).bins]
    if len(population[0]) > bound:
        while len(population) < size:
            noisy = sorted(order, key=lambda x: -lengths[x] * rng.uniform(0.9, 1.0))
            population.append(Bins(lengths, capacity).add_all(noisy).bins)
    population.sort(key=rank)
    for _ in range(generations):
        if len(population[0]) <= bound:
            break
        a, b = sorted(rng.sample(range(len(population)), 2))
        child = crossover(population[a], population[b], lengths, capacity, rng)
        population += [child, crossover(population[b], population[a], lengths, capacity, rng), mutate(child, lengths, capacity, rng),
                       mutate(population[0], lengths, capacity, rng)]
        population = sorted(population, key=rank)[:size]
    return population


def _assigned(bins: list[list[int]], n: int) -> bytes:
    out = np.zeros(n, np.int32)
    for i, b in enumerate(bins):
        out[b] = i
    return out.tobytes()


def _bins(raw: bytes) -> list[list[int]]:
    bin_of = np.frombuffer(raw, np.int32)
    order = np.argsort(bin_of, kind="stable")
    return [x.tolist() for x in np.split(order, np.cumsum(np.bincount(bin_of))[:-1])]


STATE = "block long, island int, rows binary, lengths binary, pieces binary, population array<binary>"


def _state(block, island, rows, lengths, pieces, population) -> pa.Table:
    return pa.table({"block": pa.array([block], pa.int64()), "island": pa.array([island], pa.int32()),
                     "rows": pa.array([rows], pa.binary()), "lengths": pa.array([lengths], pa.binary()), "pieces": pa.array([pieces], pa.binary()),
                     "population": pa.array([population], pa.list_(pa.binary()))})


def _rng(block: int, island: int, epoch: int):
    import random
    return random.Random(f"{block}:{island}:{epoch}")


def pack(pieces: DataFrame, rows: int, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS,
         epochs: int = EPOCHS, generations: int = GENERATIONS, size: int = POPULATION) -> DataFrame:
    """Places of documents (row, n_tokens): (row, sequence_id, offset, full_id); the full pieces after the first one get
    sequence ids from ``full_id`` on."""
    blocks = max(1, -(-rows // block))
    dealt = pieces.select("row", "n_tokens", F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"),
                          F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))

    def begin(group: pa.Table) -> pa.Table:
        at, island = group["block"][0].as_py(), group["island"][0].as_py()
        n = group["n_tokens"].to_numpy()
        first = np.where(n % capacity == 0, capacity, n % capacity).astype(np.int32)
        found = evolve(first.tolist(), [], capacity, _rng(at, island, 0), generations, size)
        return _state(at, island, group["row"].to_numpy().astype(np.int64).tobytes(), first.tobytes(),
                      (-(-n // capacity)).astype(np.int32).tobytes(), [_assigned(p, len(n)) for p in found])

    state = scratch(grouped_arrow(dealt, ["block", "island"], begin, STATE, order=["row"]), "pack-0")

    def go_on(epoch: int):
        def fn(group: pa.Table) -> pa.Table:
            r = group.to_pylist()
            own = next(x for x in r if not x["migrant"])
            lengths = np.frombuffer(own["lengths"], np.int32).tolist()
            population = list(dict.fromkeys(p for x in sorted(r, key=lambda x: x["migrant"]) for p in x["population"]))
            found = sorted(map(_bins, population), key=lambda p: (len(p), -fitness(p, lengths, capacity)))[:size]
            found = evolve(lengths, found, capacity, _rng(own["block"], own["island"], epoch), generations, size)
            return _state(own["block"], own["island"], own["rows"], own["lengths"], own["pieces"], [_assigned(p, len(lengths)) for p in found])
        return fn

    for epoch in range(1, epochs):
        elite = state.select("block", ((F.col("island") + 1) % islands).alias("island"), F.lit(None).cast("binary").alias("rows"),
                             F.lit(None).cast("binary").alias("lengths"), F.lit(None).cast("binary").alias("pieces"),
                             F.slice("population", 1, 1).alias("population"), F.lit(True).alias("migrant"))
        both = state.select("*", F.lit(False).alias("migrant")).unionByName(elite)
        state = scratch(grouped_arrow(both, ["block", "island"], go_on(epoch), STATE, order=["migrant"]), f"pack-{epoch}")

    def place(group: pa.Table) -> pa.Table:
        r = sorted(group.to_pylist(), key=lambda x: x["island"])
        lengths = np.frombuffer(r[0]["lengths"], np.int32)
        best = min((_bins(x["population"][0]) for x in r), key=lambda p: (len(p), -fitness(p, lengths.tolist(), capacity)))
        bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for i, b in enumerate(best):
            bin_of[b] = i
            offset[b] = np.cumsum(lengths[b]) - lengths[b]
        more = np.frombuffer(r[0]["pieces"], np.int32).astype(np.int64) - 1
        base = r[0]["block"] << 40
        return pa.table({"row": np.frombuffer(r[0]["rows"], np.int64), "sequence_id": base + bin_of, "offset": offset,
                         "full_id": base + len(best) + np.cumsum(more) - more})

    return grouped_arrow(state, ["block"], place, "row long, sequence_id long, offset long, full_id long", order=["island"])


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False, **options) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids."""
    tokens = scratch(tokenise(docs, capacity, with_ids), "tokens")
    places = pack(tokens.select("row", "n_tokens"), tokens.count(), capacity, **options)
    first = F.when(F.col("n_tokens") % capacity == 0, capacity).otherwise(F.col("n_tokens") % capacity)
    later = F.col("piece") > 0
    start = F.when(later, F.col("first") + (F.col("piece") - 1) * capacity).otherwise(0)
    out = tokens.join(places, "row").withColumn("first", first)
    out = out.select("doc_id", "first", "sequence_id", "offset", "full_id", "ids", F.posexplode("crcs").alias("piece", "ids_crc32"))
    cols = [
        "doc_id", "piece", start.cast("long").alias("start"), F.when(later, capacity).otherwise(F.col("first")).cast("long").alias("length"),
        "ids_crc32", F.when(later, F.col("full_id") + F.col("piece") - 1).otherwise(F.col("sequence_id")).alias("sequence_id"),
        F.when(later, 0).otherwise(F.col("offset")).cast("long").alias("offset")]
    if with_ids:
        cols.append(F.substring("ids", 4 * start.cast("int") + 1, 4 * F.when(later, capacity).otherwise(F.col("first")).cast("int")).alias("ids"))
    return out.select(*cols)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces with ids: sequence_id, n_tokens, ids, spans (doc_id, piece, offset, length)."""
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids"))).alias("parts"),
    ).select("sequence_id", "n_tokens", F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.ids))").alias("ids"),
             F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["offset"].alias("offset"),
                                                     p["length"].alias("length"))).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
