"""MinHash near-duplicates with an LSH forest, confirmed on full shingle sets.

Documents with equal sets are one class at once. Each class has a signature, and the forest is TREES sorted orders of the
classes, each by the signature's rows from another row on. In an order, the neighbours of a class are those that it shares
a longest common prefix of DEPTH rows or more with: they lie next to it, before and behind, over the borders of range
partitions too. Such a region's members are compared with each other by their whole signatures. Where a region is dense,
the depth grows, row by row, until the parts are small enough for a task; parts that no further row splits are dealt and
share some leaders. What that leaves apart is then held against all of the dense region, so that depth decides only in
which order pairs are looked at, not which.

Neighbours whose signatures agree well enough are put into one block. Each block gets its texts once, and every pair within
it that could pass is decided on the full sets; links are searched, not sampled, until the block's components are known.
Blocks too large for one task are first read in several sorted signature orders, in slices, which links most of what belongs
together; every pair that could join two of the groups left is then decided by a join on the rarest shingles of its sets.

What can be missed: a pair at the threshold t has no common prefix of DEPTH rows in any order with a probability of
(1 - t ** DEPTH) ** TREES, 2e-8 at 0.85 and 3e-6 at 0.8, and agrees in too few rows of the signature with one of 2e-6 at
0.85 and 1e-6 at 0.8. Such a pair is still found if its documents are linked by way of others. No other step loses a link.

Cases: documents without words or text have no shingles and link with nothing; with fewer words than a shingle has, all
words are the only shingle; rows with one id are one document, linked by whichever of their texts; rows without id are
kept and have no component; of alike documents the one with the smallest id stays; long texts count whole; an empty table gives no rows. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_text, stored
from .components import components

SHINGLE, DEPTH, TREES = 5, 4, 24
ROWS = DEPTH * TREES
#: Rows of an order that are sorted by: a region can be split down to so many.
DEEPEST = 2 * DEPTH
ORDERS = 4
#: Slots in which shingles of large blocks are counted, to take the rarest first.
SLOTS = 1 << 18
SEED = 11
_random = np.random.default_rng(SEED)
FACTORS = _random.integers(0, 2**63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _random.integers(0, 2**63, ROWS, np.uint64)


@dataclass(frozen=True)
class Limits:
    """What one task takes. These bound memory and change no result.

    dense: members of a region, or of one part of it, that one task compares; leaders: members that are in all parts, about.
    block_shingles, block_bytes: shingles, and bytes of text, of a block. hot: sets that have one shingle."""

    dense: int = 4_000
    leaders: int = 16
    block_shingles: int = 3_000_000
    block_bytes: int = 32_000_000
    hot: int = 4_000


class Words(dict):
    """Hashes of words; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, words: Words) -> np.ndarray:
    """The set as sorted hashes of 64 bits: words are runs of other than ASCII white space, with A-Z lower-cased."""
    said = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(words.__getitem__, said), np.uint64, len(said))
    if len(h) < SHINGLE:
        if not len(h):
            return h
        one = np.full(1, len(h), np.uint64)
        for w in h:
            one = mixed(one * np.uint64(0x9E3779B97F4A7C15) + w)
        return one
    out = np.zeros(len(h) - SHINGLE + 1, np.uint64)
    for i in range(SHINGLE):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - SHINGLE + 1 + i]
    return np.unique(mixed(out))


def signature(s: np.ndarray) -> np.ndarray:
    """ROWS numbers of 16 bits."""
    least = np.full(ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        np.minimum(least, (s[i : i + 4096, None] * FACTORS + TERMS).min(0), out=least)
    return mixed(least).astype(np.uint16)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, n_bytes, set_key (of the whole set), sig: one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            n, keys, sigs = [], [], []
            for text in each_text(batch.column("text")):
                s = shingles(text, words)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), batch.column("n_bytes"), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "n_bytes", "set_key", "sig"])

    slim = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return slim.mapInArrow(run, "doc_id long, n_shingles long, n_bytes long, set_key binary, sig binary")


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def orders(classes: DataFrame) -> DataFrame:
    """tree, head, deep, rep: of each class and order, the first DEPTH rows and the next ones up to DEEPEST, as numbers that
    sort like them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sigs = matrix(batch.column("sig"), np.uint16)
                for tree in range(TREES):
                    rows = np.take(sigs, range(tree * DEPTH, tree * DEPTH + DEEPEST), axis=1, mode="wrap").astype(">u2")
                    head, deep = np.ascontiguousarray(rows).view(">i8").astype(np.int64).T
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(head), tree, np.int32)), pa.array(head), pa.array(deep), batch.column("rep")], ["tree", "head", "deep", "rep"])

    return classes.select("rep", "sig").mapInArrow(run, "tree int, head long, deep long, rep long")


def prefix_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one range of an order: the rows that share DEPTH rows with the one before or behind them, and those at the ends of
    the range, whose neighbours may lie in the next range."""
    held, own, joins = None, None, None
    before = True  # whether the row before the held batch is alike, or there is none
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.column_stack((batch.column("tree").to_numpy(), batch.column("head").to_numpy()))
        same = (at[1:] == at[:-1]).all(1)
        if held is not None:
            meets = bool((own[-1] == at[0]).all())
            yield held.filter(pa.array(np.concatenate(([before], joins)) | np.concatenate((joins, [meets]))))
            before = meets
        held, own, joins = batch, at, same
    if held is not None:
        yield held.filter(pa.array(np.concatenate(([before], joins)) | np.concatenate((joins, [True]))))


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of one key after the other, from batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = batch.column(key).to_numpy()
        if not len(keys):
            continue
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and keys[lo] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = keys[lo]
    if held:
        yield pa.Table.from_batches(held)


def alike(sigs: np.ndarray, least: int) -> np.ndarray:
    """For each row the first row of its component, where rows that agree in at least so many places are linked."""
    root = np.full(len(sigs), -1)
    left = np.arange(len(sigs))
    while len(left):
        first, front = left[0], [left[0]]
        root[first], left = first, left[1:]
        while front and len(left):
            hit = (sigs[left] == sigs[front.pop()]).sum(1) >= least
            front += left[hit].tolist()
            root[left[hit]], left = first, left[~hit]
    return root


def block_edges(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Edges from the least to each other class of what is alike in one region: the same ones in every order that finds them."""
    found: list[np.ndarray] = []
    for table in runs(batches, "key"):
        if table.num_rows > 1:
            rep = table["rep"].to_numpy()
            root = alike(matrix(table["sig"].combine_chunks(), np.uint16), least)
            least_of = np.full(len(rep), np.iinfo(np.int64).max)
            np.minimum.at(least_of, root, rep)
            rest = least_of[root] != rep
            found.append(np.column_stack((least_of[root[rest]], rep[rest])))
        if len(found) >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(found).T.copy()], ["a", "b"])
            found = []
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(found).T.copy()], ["a", "b"])


def part_edges(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Of the members of a part and the outsiders that are held against it: edges between components that are alike."""
    for table in runs(batches, "key"):
        outside = table["outside"].to_numpy()
        rep, comp, sigs = table["rep"].to_numpy(), table["comp"].to_numpy(), matrix(table["sig"].combine_chunks(), np.uint16)
        part = np.flatnonzero(~outside)
        now = np.unique(comp, return_inverse=True)[1]
        found = []
        for i in np.flatnonzero(outside):
            left = part[now[part] != now[i]]
            for j in left[(sigs[left] == sigs[i]).sum(1) >= least]:
                if now[j] != now[i]:
                    found.append((rep[i], rep[j]))
                    now[now == now[j]] = now[i]
        yield from pairs(found)


def deeper(rows: DataFrame, dense: int) -> DataFrame:
    """rows with the key of the smallest depth at which at most so many share it, and how many do (size), from key and size at DEPTH."""
    for k in range(1, DEEPEST - DEPTH + 1):
        prefix = F.shiftright("deep", 16 * (DEEPEST - DEPTH - k))
        rows = rows.withColumn("key", F.when(F.col("size") > dense, F.xxhash64("key", prefix)).otherwise(F.col("key")))
        sizes = rows.groupBy("key").agg(F.count("*").alias("size"))
        rows = rows.drop("size").join(sizes, "key")
    return rows


def neighbours(members: DataFrame, least: int, limits: Limits, some_dense: bool) -> DataFrame:
    """Edges a, b that give the components of what is alike in each region (tree, head, n of its members, deep, rep, sig);
    some_dense: whether any n is above limits.dense."""
    slim = members.select(F.xxhash64("tree", "head").alias("key"), F.col("n").alias("size"), "deep", "rep", "sig")
    rows = slim.where(F.col("size") <= limits.dense).select("key", "deep", "rep", "sig")
    if some_dense:
        split = stored(deeper(slim.where(F.col("size") > limits.dense), limits.dense), "near-parts")
        # Parts that no row splits any further are dealt, and share some leaders.
        parts = F.ceil(F.col("size") / limits.dense)
        leads = F.pmod(F.xxhash64("rep", "key"), "size") < limits.leaders
        at = F.explode(F.when(leads, F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("rep"), parts))))
        rows = rows.unionByName(split.select("key", "deep", "rep", "sig", at.alias("part")).select(F.xxhash64("key", "part").alias("key"), "deep", "rep", "sig"))
    edges = rows.repartition("key").sortWithinPartitions("key", "deep", "rep").mapInArrow(lambda b: block_edges(b, least), "a long, b long").distinct()
    if not some_dense:
        return edges
    edges = stored(edges, "near-edges")
    known = components(edges).withColumnRenamed("node", "rep")
    region = members.select(F.xxhash64("tree", "head").alias("bucket"), "n", "rep", "sig").where(F.col("n") > limits.dense)
    dense = stored(region.join(known, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")), "near-dense")
    sizes = dense.groupBy("bucket", "comp").agg(F.count("*").alias("m")).groupBy("bucket").agg(F.max_by("comp", F.struct("m", "comp")).alias("most"), (F.sum("m") - F.max("m")).alias("out")).where("out > 0")
    rows = dense.join(sizes, "bucket")
    # Tiles of outsiders by parts of all members: every pair with an outsider is in one of them.
    tiles, parts = F.ceil(F.col("out") / limits.dense), F.ceil(F.col("n") / limits.dense)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    inside = rows.select("bucket", "rep", "comp", "sig", F.lit(False).alias("outside"), F.pmod(F.xxhash64("rep"), parts).alias("part"), each(tiles).alias("tile"))
    outside = rows.where("comp != most").select("bucket", "rep", "comp", "sig", F.lit(True).alias("outside"), each(parts).alias("part"), F.pmod(F.xxhash64("rep"), tiles).alias("tile"))
    met = inside.unionByName(outside).select(F.xxhash64("bucket", "part", "tile").alias("key"), "rep", "comp", "sig", "outside")
    return edges.unionByName(met.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(lambda b: part_edges(b, least), "a long, b long"))


def verified(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set the root of its component under links on full sets; every pair that could join two components is decided."""
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    # Most of a block usually links with a few of its members.
    leaders: list[int] = []
    for i, s in enumerate(sets):
        for j in leaders:
            if root(i) != root(j) and linked(s, sets[j], percent):
                parent[root(i)] = root(j)
        if parent[i] == i and len(leaders) < 16:
            leaders.append(i)
    roots = np.array([root(i) for i in range(len(sets))])
    names, sizes = np.unique(roots, return_counts=True)
    if len(names) == 1:
        return roots.tolist()
    # A pair of two components has a member outside the largest one: count what each of those shares with all sets.
    outside = np.flatnonzero(roots != names[sizes.argmax()])
    lengths = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), lengths)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    del order
    for i in outside:
        lo, hi = np.searchsorted(values, sets[i], "left"), np.searchsorted(values, sets[i], "right")
        width = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(width)[:-1])), width) + np.arange(width.sum())
        shared = np.bincount(owner[at], minlength=len(sets))
        for j in np.flatnonzero(100 * shared >= percent * (lengths + lengths[i] - shared)):
            if root(i) != root(int(j)):
                parent[root(int(i))] = root(int(j))
    return [root(i) for i in range(len(sets))]


def links(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    return [(int(ids[r]), int(ids[i])) for i, r in enumerate(verified(sets, percent)) if i != r]


def confirm_blocks(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    words = Words()
    for table in runs(batches, "comp"):
        sets = [shingles(t.as_py(), words) for t in table["text"]]
        some = [i for i, s in enumerate(sets) if len(s)]
        if found := links(table["doc_id"].to_numpy()[some], [sets[i] for i in some], percent):
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def confirm_slices(batches: Iterator[pa.RecordBatch], percent: int, limits: Limits) -> Iterator[pa.RecordBatch]:
    """Of large blocks in one order: slices as large as a task may take, each begun by the later half of the one before in
    its partition. What lies in other slices or partitions is left to joined_groups."""
    words = Words()
    for table in runs(batches, "part"):
        ids, sets, size, read = [], [], 0, 0
        for i, text in zip(table["doc_id"].to_pylist(), table["text"], strict=True):
            said = text.as_py()
            s = shingles(said, words)
            read += len(said or "")
            if len(s):
                ids.append(i)
                sets.append(s)
                size += len(s)
            if size >= limits.block_shingles or read >= limits.block_bytes:
                yield from pairs(links(np.array(ids), sets, percent))
                ids, sets = ids[len(ids) // 2 :], sets[len(ids) // 2 :]
                size, read = sum(map(len, sets)), 0
        if len(ids) > 1:
            yield from pairs(links(np.array(ids), sets, percent))


def pairs(found: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if found:
        a, b = zip(*found, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def large_sets(rows: DataFrame) -> DataFrame:
    """rep, comp, grp, outside and the set of each text that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            sets = [shingles(t, words).view(np.int64) for t in each_text(batch.column("text"))]
            some = pa.array([i for i, s in enumerate(sets) if len(s)], pa.int64())
            kept = [batch.column(c).take(some) for c in ("rep", "comp", "grp", "outside")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([s for s in sets if len(s)], pa.list_(pa.int64()))], ["rep", "comp", "grp", "outside", "set"])

    return rows.select("rep", "comp", "grp", "outside", "text").mapInArrow(run, "rep long, comp long, grp long, outside boolean, set array<long>")


def slot_counts(sets: DataFrame) -> np.ndarray:
    """How often the shingles of each slot come up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            values = batch.column("set").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            counts += np.bincount((values % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["slot", "n"])

    counts = np.zeros(SLOTS, np.int64)
    got = sets.select("set").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    counts[got["slot"]] = got["n"]
    return counts


def prefixes(sets: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """The shingles of each set that a set linked with it must share one of, rarest first; the order is the same for all sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                keys, n = [], []
                for s in part.column("set"):
                    values = s.values.to_numpy(zero_copy_only=False)
                    order = np.lexsort((values, counts[(values.view(np.uint64) % np.uint64(SLOTS)).astype(np.int64)]))
                    n.append(len(values))
                    keys.append(values[order[: len(values) - -(-percent * len(values) // 100) + 1]])
                width = np.array([len(k) for k in keys])
                at = pa.array(np.repeat(np.arange(len(keys)), width))
                place = np.concatenate([np.arange(w) for w in width])
                columns = [part.column(c).take(at) for c in ("rep", "comp", "grp", "outside")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.repeat(n, width)), pa.array(place), pa.array(np.concatenate(keys))], ["rep", "comp", "grp", "outside", "n", "place", "key"])

    return sets.mapInArrow(run, "rep long, comp long, grp long, outside boolean, n long, place long, key long")


def joined_groups(sets: DataFrame, percent: int, hot_sets: int) -> DataFrame:
    """Edges a, b: all pairs of a block that are linked and belong to different groups. Such a pair has a member outside the
    block's largest group. It shares one of the rarest shingles of both, and at the first of them as many others are left as
    it needs; what passes is decided on full sets."""
    keys = stored(prefixes(sets, slot_counts(sets), percent), "near-prefixes")
    # Of a key that many sets have, these are dealt to several tasks, and those outside go to each of them.
    hot = keys.groupBy("comp", "key").agg(F.count_if("outside").alias("out"), F.count("*").alias("m")).where("out > 0 and m > 1")
    hot = stored(hot.select("comp", "key", F.ceil(F.col("m") / hot_sets).alias("salts")), "near-keys")
    of_key = keys.join(hot, ["comp", "key"])
    side = lambda rows, x: rows.select("comp", "key", "salt", *(F.col(c).alias(f"{c}_{x}") for c in ("rep", "grp", "outside", "n", "place")))
    a = side(of_key.where("outside").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))), "a")
    b = side(of_key.withColumn("salt", F.pmod(F.xxhash64("rep"), "salts")), "b")
    met = a.join(b, ["comp", "key", "salt"]).where("grp_a != grp_b and (not outside_b or rep_a < rep_b)")
    met = met.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) and {100 + percent} * least(n_a - place_a, n_b - place_b) >= {percent} * (n_a + n_b)")
    met = met.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()
    of = lambda x: sets.select(F.col("rep").alias(x), F.col("set").alias(f"set_{x}"))
    both = met.join(of("a"), "a").join(of("b"), "b").select("a", "b", F.size("set_a").alias("n_a"), F.size("set_b").alias("n_b"), F.size(F.array_intersect("set_a", "set_b")).alias("both"))
    return both.where(f"100L * both >= {percent} * (n_a + n_b - both)").select("a", "b")


def resolve(docs: DataFrame, percent: int = 85, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """doc_id, n_shingles, component_id, kept. percent: documents whose sets have that Jaccard similarity or more are linked."""
    feats = stored(features(docs), "near-features")
    named = feats.where("n_shingles > 0 and doc_id is not null")
    one = named.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("n_shingles").alias("size"), F.max("n_bytes").alias("n_bytes"), F.first("sig").alias("sig"))
    classes = stored(one, "near-classes")

    # The forest's orders; what has neighbours in one, with the size of its region there.
    order = ("tree", "head", "deep", "rep")
    lying = orders(classes).repartitionByRange(*order).sortWithinPartitions(*order)
    near = stored(lying.mapInArrow(prefix_neighbours, "tree int, head long, deep long, rep long"), "near-neighbours")
    counts = stored(near.groupBy("tree", "head").agg(F.count("*").alias("n")).where("n > 1"), "near-regions")
    members = near.join(counts, ["tree", "head"]).join(classes.select("rep", "sig"), "rep")
    # Five standard errors below the threshold's expected number of agreeing rows.
    t = percent / 100
    least = int(ROWS * (t - 5 * (t * (1 - t) / ROWS) ** 0.5))
    edges = neighbours(members, least, limits, not counts.where(F.col("n") > limits.dense).isEmpty())
    blocks = components(edges)

    # Texts meet in their blocks; of blocks too large for a task, in several sorted orders.
    sized = blocks.join(classes.select("rep", "size", "n_bytes", "sig"), F.col("node") == F.col("rep"))
    large = stored(sized.groupBy("comp").agg(F.sum("size").alias("shingles"), F.sum("n_bytes").alias("read")).where((F.col("shingles") > limits.block_shingles) | (F.col("read") > limits.block_bytes)).select("comp"), "near-large")
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    usual = blocks.join(large, "comp", "left_anti").select(F.col("node").alias("doc_id"), "comp")
    confirmed = texts.join(usual, "doc_id").repartition("comp").sortWithinPartitions("comp", "doc_id").mapInArrow(lambda b: confirm_blocks(b, percent), "a long, b long")
    found = [confirmed]
    if not large.isEmpty():
        turns = F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1)))
        rows = sized.join(large, "comp").select(F.col("node").alias("doc_id"), "comp", "sig", turns.alias("order"))
        turned = F.substring(F.concat("sig", "sig"), F.col("order") * (2 * ROWS // ORDERS) + 1, F.lit(2 * ROWS))
        rows = rows.select("doc_id", "order", "comp", turned.alias("place")).join(texts, "doc_id")
        sliced = rows.repartitionByRange("order", "comp", "place").sortWithinPartitions("order", "comp", "place").select("doc_id", "text", F.xxhash64("order", "comp").alias("part"))
        first = stored(sliced.mapInArrow(lambda b: confirm_slices(b, percent, limits), "a long, b long").distinct(), "near-slices")
        found.append(first)
        groups = components(first).select(F.col("node").alias("rep"), F.col("comp").alias("grp"))
        grouped = sized.join(large, "comp").select("rep", "comp").join(groups, "rep", "left").select("rep", "comp", F.coalesce("grp", "rep").alias("grp")).distinct()
        most = grouped.groupBy("comp", "grp").agg(F.count("*").alias("m")).groupBy("comp").agg(F.max_by("grp", F.struct("m", "grp")).alias("most"), F.count("*").alias("groups")).where("groups > 1")
        unsettled = grouped.join(most, "comp").select(F.col("rep").alias("doc_id"), "rep", "comp", "grp", (F.col("grp") != F.col("most")).alias("outside"))
        sets = stored(large_sets(unsettled.join(texts, "doc_id")), "near-large-sets")
        if not sets.isEmpty():
            found.append(joined_groups(sets, percent, limits.hot))

    # Rows with one id are one document, whatever their texts.
    own = named.select("doc_id", "set_key").join(classes.select("set_key", "rep"), "set_key")
    several = own.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z")
    found.append(own.join(several, "doc_id").select("a", F.col("rep").alias("b")))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    joined = components(every)

    of_class = classes.join(joined, F.col("rep") == F.col("node"), "left").select("set_key", F.coalesce("comp", "rep").alias("class_comp"), "rep", "n").where("n > 1 or class_comp < rep").select("set_key", "class_comp")
    out = feats.select("doc_id", "n_shingles", "set_key").join(of_class, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_comp", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
