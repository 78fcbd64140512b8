"""Near-duplicate detection by SuperMinHash, banding, exact verification and union-find.

1. A text's shingle set is hashed to 64 bits a shingle. SuperMinHash gives each element a permutation of the
   registers: at level j it offers j plus a fraction to its j-th register. Levels run over all elements of a batch
   at once, and a set drops out as soon as no later level can lower a register of it.
2. Rows with one set are a class. All that follows works on classes, so copies cost nothing more.
3. Registers go into bands. Classes that share a band form a bucket, and each is paired with the bucket's hub, its
   smallest member: the pairs are linear in the rows.
4. Pairs are verified on full sets, and links go through union-find: first each class with the hub that it shares
   most bands with, then the pairs that this has not connected.
5. Members of one hub that are still in different components have not all met. Those outside the hub's largest
   component are the queries of further passes: in blocks, against the hub's members of about their size, for sets
   of other sizes cannot be similar enough. A pass takes a few queries of each hub, the next one eight times as many
   of those that are then still outside, until none is left to ask. So every pair that shares a band is either compared or
   already connected, without all pairs of a group ever being made.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cells, checkpointed, forget, mapped, small, spread
from tidemark.llm.components import connected_components

#: With 48 bands of 6, a pair at a similarity of 0.8 shares none with a probability of (1 - 0.8**6)**48 < 1e-6, and
#: one at 0.1 shares any with one below 5e-5.
BANDS, ROWS = 48, 6
#: Elements of the queries of a block, and the least number of elements of the members that one task compares with them.
QUERIES, MEMBERS = 1 << 19, 1 << 14
#: Members of a hub of which the first of the further passes asks those outside the main component.
FIRST_QUERIES = 128
#: Elements that are sketched at once.
BATCH_ELEMENTS = 1 << 16

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles. A-Z are lower-cased; with fewer words than a
    shingle has, the whole sequence is one; without words the set is empty."""
    found = text.encode("utf-8").lower().split() if text else []
    if not found:
        return np.empty(0, U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), U, len(found))
    k = min(words, len(found))
    out = h[: len(h) - k + 1]
    with np.errstate(over="ignore"):
        for j in range(1, k):
            out = mix(out * U(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j])
        return np.unique(mix(out + U(k)))


def super_minhash(sets: list[np.ndarray], registers: int) -> np.ndarray:
    """The SuperMinHash signatures of non-empty sets: row by set, value j * 2**32 + fraction."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    elements, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    out = np.full((n, registers), np.iinfo(np.uint64).max, U)
    flat = out.reshape(-1)
    taken: list[np.ndarray] = []  # the swaps of the first levels
    order = None  # the permutations, once they are written out
    with np.errstate(over="ignore"):
        for j in range(registers):
            r = mix(elements + U(j + 1) * U(0x9E3779B97F4A7C15))
            k = (((r >> U(32)) * U(registers - j)) >> U(32)).astype(np.int64) + j
            if order is None:
                at = k
                for t in range(j - 1, -1, -1):
                    at = np.where(at == taken[t], t, at)
                taken.append(k)
            else:
                rows = np.arange(len(k))
                at = order[rows, k].astype(np.int64)
                order[rows, k] = order[:, j]
                order[:, j] = at
            np.minimum.at(flat, owner * registers + at, (U(j) << U(32)) | (r & U(0xFFFFFFFF)))
            open_ = out.max(1) >= U(j + 1) << U(32)
            if not open_.any():
                break
            keep = open_[owner]
            if not keep.all():
                elements, owner = elements[keep], owner[keep]
                taken = [t[keep] for t in taken]
                order = order[keep] if order is not None else None
            if order is None and j == 7 and registers > 8:
                order = np.tile(np.arange(registers, dtype=np.uint16), (len(elements), 1))
                rows = np.arange(len(elements))
                for t, swap in enumerate(taken):
                    other = order[rows, swap]
                    order[rows, swap] = order[:, t]
                    order[:, t] = other
                taken = []
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    cut = signatures.reshape(len(signatures), bands, rows)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U) * U(0x9E3779B97F4A7C15)), cut.shape[:2])
        for r in range(rows):
            key = mix(key ^ (cut[:, :, r] + U(r + 1)))
    return key.view(np.int64)


def fingerprint(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, fp, bands) of each row; fp and bands are null for an empty set."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("fp", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches):
        import pyarrow as pa

        def flushed(held):
            full = [k for k, (_, s) in enumerate(held) if len(s)]
            keys = band_keys(super_minhash([held[k][1] for k in full], BANDS * ROWS), BANDS, ROWS) if full else np.empty((0, BANDS), np.int64)
            place = {k: i for i, k in enumerate(full)}
            ends = np.cumsum([0] + [BANDS if k in place else 0 for k in range(len(held))], dtype=np.int32)
            known = pa.array([k not in place for k in range(len(held))])
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1)), mask=known)
            return pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in held], kind), pa.array([len(s) for _, s in held], pa.int64()), pa.array([fingerprint(s) if len(s) else None for _, s in held], pa.binary()), bands],
                [f.name for f in schema],
            )

        held, size = [], 0
        for batch in batches:
            kind = batch.schema.field(id_col).type
            for i, text in cells([batch], id_col, text_col):
                held.append((i, shingle_set(text, words)))
                size += len(held[-1][1]) + 64
                if size >= BATCH_ELEMENTS:
                    yield flushed(held)
                    held, size = [], 0
        if held:
            yield flushed(held)

    return mapped(spread(docs.select(id_col, text_col)), run, schema)


def full_sets(docs: DataFrame, ids: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(fp, shingles) of the rows whose id is in ids (id), one row a set, checkpointed. Sets are shuffled only if rows
    of one id have the same set."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sets = [shingle_set(text, words) for (text,) in cells([batch], text_col)]
            yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["fp", "shingles"])

    rows = docs.select(F.col(id_col).alias("id"), text_col).join(small(ids), "id", "left_semi")
    sets = checkpointed(mapped(rows, run, "fp binary, shingles binary"))
    if sets.groupBy("fp").count().where("count > 1").isEmpty():
        return sets
    once = checkpointed(sets.dropDuplicates(["fp"]))
    forget(sets)
    return once


class Index:
    """Sets by their elements, to be compared with one set at a time."""

    def __init__(self, held: list[np.ndarray]):
        values = np.concatenate(held)
        order = np.argsort(values, kind="stable")
        self.values, self.owner, self.sizes = values[order], np.repeat(np.arange(len(held)), [len(h) for h in held])[order], np.array([len(h) for h in held])
        slots = 1 << min((16 * len(values)).bit_length(), 23)
        self.last, self.present = U(slots - 1), np.zeros(slots, bool)
        self.present[values & self.last] = True

    def linked(self, s: np.ndarray, percent: int) -> np.ndarray:
        """The places of the sets that s is linked with. A set of which too few elements occur at all is told at once."""
        some = s[self.present[s & self.last]]
        if 100 * len(some) < percent * len(s):
            return np.empty(0, np.int64)
        low, high = np.searchsorted(self.values, some, "left"), np.searchsorted(self.values, some, "right")
        many = high - low
        at = np.repeat(low - np.concatenate([[0], many.cumsum()[:-1]]), many) + np.arange(many.sum())
        common = np.bincount(self.owner[at], minlength=len(self.sizes))
        return np.flatnonzero(100 * common >= percent * (self.sizes + len(s) - common))


BLOCK = ["block", "size", "chunk"]


def verified(queries: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the queries with the members of the same block, both (BLOCK, fp, n), by full sets of n elements.

    A block's members are dealt over tasks by a salt, in parts of about as many elements as its queries have; the
    queries go to each. Rows arrive sorted, queries first, so that a task holds the queries of one block and one
    member at a time.
    """
    row = lambda rows, role: rows.select(*BLOCK, F.lit(role).alias("role"), "fp", "n")
    given = checkpointed(row(queries, 0).unionByName(row(members, 1)))
    of = lambda role: F.sum(F.when(F.col("role") == role, F.col("n")))
    counts = given.groupBy(*BLOCK).agg(of(0).alias("asked"), of(1).alias("all")).where("asked > 0 AND all > 0")
    counts = counts.select(*BLOCK, F.ceil(F.col("all") / F.greatest("asked", F.lit(MEMBERS))).cast("int").alias("salts"))
    salts = F.when(F.col("role") == 0, F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int")))
    places = checkpointed(given.join(counts, BLOCK).select(*BLOCK, F.explode(salts).alias("salt"), "role", "fp"))
    rows = sets.join(small(places), "fp").repartition(*BLOCK, "salt").sortWithinPartitions(*BLOCK, "salt", "role")

    def run(batches):
        import pyarrow as pa

        here, names, held, index = None, [], [], None
        for batch in batches:
            out = []
            for *at, role, fp, raw in cells([batch], *BLOCK, "salt", "role", "fp", "shingles"):
                if at != here:
                    here, names, held, index = at, [], [], None
                s = np.frombuffer(raw, U)
                if not role:
                    names.append(fp)
                    held.append(s)
                    continue
                if not names:
                    continue
                if index is None:
                    index = Index(held)
                out += [(names[k], fp) for k in index.linked(s, percent) if names[k] != fp]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], ["a", "b"])

    links = checkpointed(mapped(rows, run, "a binary, b binary"))
    forget(given, places)
    return links


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id and kept for each row of docs.

    Two rows are linked if 100 * intersection >= percent * union of their sets of word shingles. component_id is
    the smallest id that links reach, the row's own included; kept says that it is the row's own. Null and empty
    texts have an empty set, are linked with nothing and stay. Repeated rows (same id and text) are all kept, or
    none is. A row with a null id is a copy of rows with its set and otherwise alone; it stays if no other row of
    its set has an id. Other columns are ignored. An empty table gives an empty one.
    """
    rows = checkpointed(sketches(docs, words, id_col, text_col))
    classes = rows.where(F.col("fp").isNotNull()).groupBy("fp", "n_shingles", "bands").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = checkpointed(classes)
    banded = classes.where(F.col("rep").isNotNull()).select("fp", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    hubs = checkpointed(banded.groupBy("key").agg(F.min("fp").alias("hub"), F.count(F.lit(1)).alias("many")).where("many > 1").select("key", "hub"))
    pairs = checkpointed(banded.join(small(hubs), "key").where("fp <> hub").groupBy("hub", "fp", "n").agg(F.count(F.lit(1)).alias("shared")))

    involved = pairs.select("fp").union(pairs.select("hub")).distinct()
    known = checkpointed(classes.join(involved, "fp", "left_semi").select("fp", F.col("n_shingles").alias("n"), "rep"))
    sets = full_sets(docs, known.select(F.col("rep").alias("id")).distinct(), words, id_col, text_col)
    linked = _linked(pairs, known, sets, percent)

    roots = linked.select(F.col("a").alias("fp"), F.col("b").alias("root")).union(linked.select("b", "b").distinct())
    reps = classes.select("fp", "rep", "copies").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    groups = reps.groupBy("root").agg(F.min("rep").alias("component_id"), F.sum("copies").alias("__n")).where(F.col("__n") > 1).drop("__n")
    found = checkpointed(reps.join(groups, "root").select("fp", "component_id"))
    out = rows.select("id", "n_shingles", "fp").join(small(found), "fp", "left")
    forget(classes, hubs, pairs, known, sets, linked)
    # A row whose set no other has is alone, whatever its id.
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _linked(pairs: DataFrame, known: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The components (see connected_components) of the links among the members of each hub and the hub itself, from
    pairs (hub, fp, n, shared)."""
    none = pairs.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)

    def joined(linked: DataFrame, links: DataFrame) -> DataFrame:
        out = connected_components(linked.unionByName(links), kept=True)
        forget(links)
        return out

    def met(some: DataFrame, linked: DataFrame) -> DataFrame:
        star = some.select(F.col("hub").alias("block"), F.lit(0).alias("size"), F.lit(0).alias("chunk"), "fp", "n")
        centre = some.select(F.col("hub").alias("fp")).distinct().join(small(known.select("fp", "n")), "fp")
        centre = centre.select(F.col("fp").alias("block"), F.lit(0).alias("size"), F.lit(0).alias("chunk"), "fp", "n")
        return joined(linked, verified(centre, star, sets, percent))

    first = checkpointed(pairs.groupBy("fp", "n").agg(F.max(F.struct("shared", "hub")).alias("best")).select("fp", "n", "best.hub"))
    linked = met(first, none)
    rest = checkpointed(_rooted(_rooted(pairs, linked, "hub", "hub_root"), linked, "fp", "root").where("root <> hub_root").select("hub", "fp", "n"))
    if not rest.isEmpty():
        linked, old = met(rest, linked), linked
        forget(old)
    forget(first, rest)

    split = _split(_rooted(pairs, linked, "fp", "root"))
    asked = 0
    while True:
        placed = checkpointed(_rooted(_rooted(pairs.join(small(split), "hub"), linked, "fp", "root"), linked, "first", "main").select("hub", "fp", "n", F.col("all").alias("place"), "root", "main"))
        queries, members, asked = _unmet(placed, asked, percent)
        if queries is None:
            forget(placed, split)
            return linked
        linked, old = joined(linked, verified(queries, members, sets, percent)), linked
        forget(placed, old)


def _rooted(rows: DataFrame, linked: DataFrame, col: str, name: str) -> DataFrame:
    """rows with the root of a column's class, itself if it is not linked or the smallest."""
    roots = linked.select(F.col("a").alias(col), F.col("b").alias("__root"))
    return rows.join(small(roots), col, "left").withColumn(name, F.coalesce("__root", col)).drop("__root")


def _split(placed: DataFrame) -> DataFrame:
    """(hub, first, all): the hubs whose members (hub, fp, root) lie in several components, a class of the largest one,
    and how many members there are."""
    sizes = placed.groupBy("hub", "root").agg(F.count(F.lit(1)).alias("many"))
    most = sizes.groupBy("hub").agg(F.max(F.struct("many", "root")).alias("most"), F.sum("many").alias("all"))
    return checkpointed(most.where(F.col("all") > F.col("most.many")).select("hub", F.col("most.root").alias("first"), "all"))


def _unmet(placed: DataFrame, asked: int, percent: int) -> tuple[DataFrame | None, DataFrame | None, int]:
    """Queries and members of a further pass, both (BLOCK, fp, n), and the place up to which members are then asked.

    A hub's main component is that of one class, so it only grows, and a member that is outside it at last was outside
    it all along. Members have a place, by their hash, among as many as there are; those from place asked on that are
    outside have not been asked, and the ones up to the next bound are the queries. None if nobody is left to ask.
    """
    placed = placed.withColumn("place", F.pmod(F.xxhash64("fp"), F.col("place")))
    left = placed.where((F.col("root") != F.col("main")) & (F.col("place") >= asked))
    until = max(FIRST_QUERIES, 8 * asked)
    if left.isEmpty():
        return None, None, until
    while (near := left.where(F.col("place") < until)).isEmpty():
        until *= 8
    # Linked sets differ in size by a factor of 100 / percent at most, so by one class at most.
    size = F.floor(F.log("n") / math.log(100 / percent * (1 + 1e-9))).cast("long")
    near = near.select(F.col("hub").alias("block"), F.explode(F.sequence(size - 1, size + 1)).alias("size"), "fp", "n")
    chunks = near.groupBy("block", "size").agg(F.ceil(F.sum("n") / QUERIES).cast("int").alias("chunks"))
    queries = near.join(chunks, ["block", "size"]).select("block", "size", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("chunks")).cast("int").alias("chunk"), "fp", "n")
    members = placed.select(F.col("hub").alias("block"), size.alias("size"), "fp", "n").join(chunks, ["block", "size"])
    return queries, members.select("block", "size", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "fp", "n"), until


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that near_duplicates() keeps, with the columns of docs.

    Of rows that share an id all stay or none, but for repeated rows. The ids that go are joined against docs:
    by broadcast if they are counted and few, else by a shuffle.
    """
    gone = checkpointed(near_duplicates(docs, id_col=id_col, **options).where("not kept").select(F.col(id_col).alias("__nd_id")).where(F.col("__nd_id").isNotNull()).distinct())
    return docs.join(small(gone), F.col(id_col) == F.col("__nd_id"), "left_anti")
