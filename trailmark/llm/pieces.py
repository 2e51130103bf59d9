"""SentencePiece encoding and decoding with a given model.

A text becomes units that no piece crosses: a run of blanks with a run of letters of one kind, where two letters are of one
kind if a piece has them side by side. Documents are cut once, in chunks with a dictionary of units each. All distinct
units of the corpus then pass a relational lattice: they are exploded into substrings no longer than the longest piece,
joined to the piece table, grouped by unit into edges, and folded into pieces by Spark's higher-order aggregate. For a
unigram model the fold is Viterbi's best path. In a BPE model scores are merge ranks, and the path with the best sum isn't
what such a model means; its fold merges the best-scored edge that spans two neighbours (the leftmost of equals) until
none is left, which gives the ids that the model's own library gives.

Dictionaries travel as packed lists of units by hash bucket, so that what is shuffled is a part of the text. The folded
units come back to the chunks' dictionaries, bucket by bucket, and each chunk's documents are put together from its own
dictionary. Nothing of this passes the driver, and no step depends on how large the corpus is. Only a unit that holds a
character without a piece (it is a unit of its own), no piece of two characters, or more than LONGEST_UNIT characters is
folded by the same rule in Python, where the folded units come back.

Cases: null and empty texts have no ids; characters without a piece become byte pieces, or the unknown piece in a model
without those; U+2581 in a text reads as a blank, as in the library; long texts and units count whole (merging n characters
takes n log n steps); repeated rows give repeated results; an empty table gives no rows. Extra columns are kept only where
keep names them. Models with a character map, with white space removed or as suffix, with user-defined or unused pieces
aren't read: load() raises.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from .common import bucketed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
UNIGRAM, BPE = 1, 2
#: Cuts of a unit of so many characters are the bits of a long.
LONGEST_UNIT = 61
#: Buckets of units by hash.
BUCKETS = 2048
#: Documents that a task holds as text or ids at once.
TOGETHER = 250


@dataclass(frozen=True)
class Limits:
    """Units of a chunk's dictionary, and their places in its documents, at which the next chunk begins; and entries of
    dictionaries that one group of a bucket takes. They bound the memory of tasks and change no result."""

    chunk_units: int = 400_000
    chunk_places: int = 8_000_000
    chunk_rows: int = 500_000
    bucket_entries: float = 500_000


@dataclass
class Model:
    """The pieces that text can match, with scores and ids; ids of single bytes; every id's bytes for decoding."""

    kind: int
    pieces: dict[str, tuple[float, int]]
    byte_ids: list[int] | None
    unknown: int
    raw: list[bytes]
    prefix: bool = True
    longest: int = field(init=False)

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.pieces), default=1)
        if any(BLANK in p.lstrip(BLANK) for p in self.pieces):
            raise ValueError("a piece crosses from a word into the next")

    def kinds(self) -> list[str]:
        """The characters that pieces have side by side, in groups none of whose characters is beside one of another group."""
        kind: dict[str, str] = {}

        def top(c: str) -> str:
            while kind.setdefault(c, c) != c:
                kind[c] = c = kind[kind[c]]
            return c

        for piece in self.pieces:
            said = piece.lstrip(BLANK)
            for a, b in zip(said, said[1:], strict=False):
                kind[top(a)] = top(b)
        groups: dict[str, list[str]] = {}
        for c in sorted(kind):
            groups.setdefault(top(c), []).append(c)
        return ["".join(g) for g in groups.values()]

    def pattern(self) -> str:
        """A regular expression for the units of a text with marked blanks."""
        one_kind = "".join(f"[{re.escape(g)}]+|" for g in sorted(self.kinds(), key=len, reverse=True))
        return f"(?s:{BLANK}*(?:{one_kind}[^{BLANK}])|{BLANK}+)"


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (b[i] & 127) << shift
        i, shift = i + 1, shift + 7
        if b[i - 1] < 128:
            return value, i


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one message in protocol buffer format."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        wire = key & 7
        if wire == 0:
            value, i = _varint(b, i)
        else:
            n, i = _varint(b, i) if wire == 2 else ({1: 8, 5: 4}[wire], i)
            value, i = b[i : i + n], i + n
        yield key >> 3, value


def load(path: str = MODEL) -> Model:
    """A model file of the SentencePiece format, read on the driver."""
    with open(path, "rb") as file:
        data = file.read()
    # Fixed values of the format: the kinds of piece.
    normal, unknown_kind, control, user_defined, unused, byte = 1, 2, 3, 4, 5, 6
    pieces, raw, byte_ids, unknown, kind, prefix = {}, [], {}, 0, UNIGRAM, True
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            text, score, what = own[1].decode(), struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0], own.get(3, normal)
            if what in (user_defined, unused):
                raise ValueError("user-defined and unused pieces are not supported")
            if what == normal:
                pieces[text] = (score, len(raw))
            if what == byte:
                byte_ids[int(text[3:5], 16)] = len(raw)
            if what == unknown_kind:
                unknown = len(raw)
            raw.append(bytes([int(text[3:5], 16)]) if what == byte else b"" if what == control else " ⁇ ".encode() if what == unknown_kind else text.replace(BLANK, " ").encode())
        elif number == 2:
            trained = dict(_fields(value))
            kind = trained.get(3, UNIGRAM)
            if trained.get(24, 0):
                raise ValueError("blanks as suffixes are not supported")
        elif number == 3:
            normalizer = dict(_fields(value))
            prefix = bool(normalizer.get(3, 1))
            if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
                raise ValueError("character maps, removed white space and unmarked blanks are not supported")
    if kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are folded")
    return Model(kind, pieces, [byte_ids[i] for i in range(256)] if len(byte_ids) == 256 else None, unknown, raw, prefix)


def marked(text: str, model: Model) -> str:
    return (BLANK if model.prefix and text else "") + text.replace(" ", BLANK)


def fallback(symbol: str, model: Model) -> list[int]:
    return [model.byte_ids[b] for b in symbol.encode("utf-8", "replace")] if model.byte_ids else [model.unknown]


def merge(unit: str, model: Model) -> list[int]:
    """The BPE fold of one unit: the best-scored pair first, of equals the leftmost."""
    known, n = model.pieces, len(unit)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(unit)
    queue: list[tuple[float, int, int, str]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (hit := known.get(both := alive[i] + alive[j])):
            heapq.heappush(queue, (-hit[0], i, j, both))

    for i in range(n):
        offer(i)
    while queue:
        _, i, j, both = heapq.heappop(queue)
        if alive[i] and alive[j] and after[i] == j and alive[i] + alive[j] == both:
            alive[i], alive[j] = both, ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
    return [x for s in alive if s for x in ([known[s][1]] if s in known else fallback(s, model))]


def best_path(unit: str, model: Model) -> list[int]:
    """The unigram fold of one unit: the path with the best sum of scores, of equals the one whose last piece is longer."""
    least = min((s for s, _ in model.pieces.values()), default=0.0) - 10
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(unit) + 1):
        ways = [(best[at][0] + hit[0], at) for at in range(max(0, end - model.longest), end) if (hit := model.pieces.get(unit[at:end]))]
        if unit[end - 1] not in model.pieces:
            ways.append((best[end - 1][0] + least, end - 1))
        best.append(max(ways, key=lambda w: (w[0], -w[1])))
    ids, end = [], len(unit)
    while end:
        at = best[end][1]
        own = unit[at:end]
        ids[:0] = [model.pieces[own][1]] if own in model.pieces else fallback(own, model)
        end = at
    return ids


def packed(numbers: np.ndarray) -> bytes:
    """Numbers of up to 32 bits, all lowest bytes first, then all second ones and so on, compressed."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


class Places(dict):
    """The units met so far, numbered in order of appearance."""

    def __missing__(self, unit: str) -> int:
        found = self[unit] = len(self)
        return found


def bucket_of(unit: str) -> int:
    return zlib.crc32(unit.encode()) % BUCKETS


def cut(docs: DataFrame, model: Model, keep: tuple[str, ...], limits: Limits) -> DataFrame:
    """One row for each document (keep, __chunk, __cut: its units' numbers), for each chunk (__order: the buckets of its
    units by number), and for each bucket of its units (__bucket, __units: those units in order, __n of them)."""
    find = re.compile(model.pattern()).findall
    inner = StructType([StructField(f.name, f.dataType) for f in docs.select(*keep).schema])
    schema = StructType(list(inner)).add("__chunk", "long").add("__cut", "binary").add("__order", "binary").add("__bucket", "integer").add("__units", "string").add("__n", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, places, used, rows = TaskContext.get().partitionId() << 32, Places(), 0, 0
        none = lambda n, kind: pa.nulls(n, kind)

        def dictionary(kept: pa.Schema) -> pa.RecordBatch:
            units: dict[int, list[str]] = {}
            order = np.fromiter(map(bucket_of, places), np.int32, len(places))
            for unit, b in zip(places, order.tolist(), strict=True):
                units.setdefault(b, []).append(unit)
            # Units hold no blank, which is marked.
            said = [" ".join(u) for u in units.values()]
            n = 1 + len(units)
            lists = [[packed(order), *[None] * len(units)], [None, *units], [None, *said], [None, *map(len, units.values())]]
            columns = [pa.array(x, k) for x, k in zip(lists, (pa.binary(), pa.int32(), pa.string(), pa.int32()), strict=True)]
            return pa.RecordBatch.from_arrays([*(none(n, f.type) for f in kept), pa.array([chunk] * n, pa.int64()), none(n, pa.binary()), *columns], schema.names)

        kept = None
        for batch in (whole.slice(lo, TOGETHER) for whole in batches for lo in range(0, whole.num_rows, TOGETHER)):
            kept = pa.schema([batch.schema.field(k) for k in keep])
            cuts = []
            for text in batch.column("__text").to_pylist():
                found = find(marked(text, model)) if text else []
                used += len(found)
                cuts.append(packed(np.fromiter(map(places.__getitem__, found), np.uint32, len(found))))
            n = len(cuts)
            rest = [none(n, k) for k in (pa.binary(), pa.int32(), pa.string(), pa.int32())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array([chunk] * n, pa.int64()), pa.array(cuts, pa.binary()), *rest], schema.names)
            rows += n
            if len(places) >= limits.chunk_units or used >= limits.chunk_places or rows >= limits.chunk_rows:
                yield dictionary(kept)
                chunk, places, used, rows = chunk + 1, Places(), 0, 0
        if kept is not None:
            yield dictionary(kept)

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def lattice(units: DataFrame, model: Model, within: tuple[str, ...] = ()) -> DataFrame:
    """within, unit, n_chars, edges: the pieces found in each unit, for units whose every character has a piece. Of an edge
    the key holds the rank of its score, its start and its length, so that better edges, and of equals the leftmost, come
    first. A BPE fold needs no edges of one character; units without longer ones are left out there, having nothing to fold.

    within: columns by which the units lie together already; grouping by them and the unit doesn't shuffle again."""
    spark = units.sparkSession
    rank = {s: r for r, s in enumerate(sorted({s for s, _ in model.pieces.values()}, reverse=True))}
    least = 2 if model.kind == BPE else 1
    rows = [(p, s, rank[s] << 12 | len(p)) for p, (s, _) in model.pieces.items() if len(p) >= least]
    table = spark.createDataFrame(rows, "piece string, score double, key long")  # bounded: the model's vocabulary
    letters = "".join(p for p in model.pieces if len(p) == 1)
    whole = units.where((F.length("unit") <= LONGEST_UNIT) & (F.translate("unit", letters, "") == ""))
    at = whole.select(*within, "unit", F.length("unit").alias("n_chars"), F.explode(F.sequence(F.lit(0), F.greatest(F.length("unit") - least, F.lit(0)))).alias("start"))
    sizes = F.expr(f"sequence({least}, greatest({least}, least({model.longest}, n_chars - start)))")
    at = at.select(*within, "unit", "n_chars", "start", F.explode(sizes).alias("size"))
    at = at.withColumn("piece", F.expr("substring(unit, start + 1, size)"))
    edges = at.join(F.broadcast(table), "piece").withColumn("key", F.col("key") + F.col("start").cast("long") * 64)
    edge = F.col("key") if model.kind == BPE else F.struct("key", "score")
    return edges.groupBy(*within, "unit").agg(F.first("n_chars").alias("n_chars"), F.collect_list(edge).alias("edges"))


def folded(edges: DataFrame, model: Model) -> DataFrame:
    """edges' other columns, unit, cuts: the lattice of each unit folded into its pieces. Where they begin and end are the bits
    of a long."""
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))
    start = lambda key: F.shiftright(key, 6).bitwiseAND(63).cast("int")
    size = lambda key: key.bitwiseAND(63).cast("int")
    others = [c for c in edges.columns if c not in ("n_chars", "edges")]

    def spanned(key: Column) -> Column:
        """The edge's ends, and these with everything between them, as bits."""
        ends = F.call_function("shiftleft", bit(size(key)) + 1, start(key))
        whole = F.call_function("shiftleft", bit(size(key) + 1) - 1, start(key))
        return F.struct(ends.alias("ends"), whole.alias("whole"))

    def merge_step(cuts: Column, _: Column) -> Column:
        """The first edge over two neighbours loses the cut between them."""
        fits = lambda e: (F.bit_count(cuts.bitwiseAND(e["whole"])) == 3) & (cuts.bitwiseAND(e["ends"]) == e["ends"])
        first = F.get(F.filter("spans", fits), F.lit(0))
        return F.coalesce(cuts - cuts.bitwiseAND(first["whole"] - first["ends"]), cuts)

    def path_step(best: Column, end: Column) -> Column:
        """best: for each end so far (score, cuts up to it)."""
        ways = F.transform(F.filter("edges", lambda e: start(e["key"]) + size(e["key"]) == end), lambda e: F.struct((F.get(best, start(e["key"]))["score"] + e["score"]).alias("score"), (-start(e["key"])).alias("at")))
        top = F.array_max(ways)
        return F.concat(best, F.array(F.struct(top["score"].alias("score"), (F.get(best, -top["at"])["cuts"] + bit(end)).alias("cuts"))))

    ends = F.sequence(F.lit(1), F.col("n_chars"))
    if model.kind == BPE:
        edges = edges.select(*others, "n_chars", F.transform(F.sort_array("edges"), spanned).alias("spans"))
        cuts = F.aggregate(F.slice(ends, 2, LONGEST_UNIT), bit(F.col("n_chars") + 1) - 1, merge_step)
    else:
        begin = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(1).cast("long").alias("cuts")))
        cuts = F.element_at(F.aggregate(ends, begin, path_step), -1)["cuts"]
    return edges.select(*others, cuts.alias("cuts"))


def pieces_of(unit: str, cuts: int, model: Model) -> list[int]:
    """The ids of the pieces between the cuts."""
    at = [i for i in range(len(unit) + 1) if cuts >> i & 1]
    return [model.pieces[unit[a:b]][1] for a, b in zip(at, at[1:], strict=False)]


def spelled(ids: list[int], model: Model) -> str:
    """The characters that ids stand for; bytes that are no UTF-8 become replacement characters."""
    return b"".join([model.raw[i] for i in ids]).decode("utf-8", "replace")


def decoded(ids: list[int] | np.ndarray, model: Model) -> str:
    """The text that ids stand for."""
    said = spelled(ids, model)
    return said[1:] if model.prefix and said[:1] == " " else said


def answers(dictionaries: DataFrame, folds: DataFrame, model: Model, parts: int) -> DataFrame:
    """__chunk, __bucket, __widths, __ids, __bad: of each unit of a chunk's dictionary, in order, how many ids it has, the
    ids, and which units don't decode to themselves."""
    fold = merge if model.kind == BPE else best_path

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        cuts = dict(zip(right["unit"].to_pylist(), right["cuts"].to_pylist(), strict=True))
        known: dict[str, list[int]] = {}
        bad: dict[str, bool] = {}

        def ids(unit: str) -> list[int]:
            if unit not in known:
                known[unit] = pieces_of(unit, cuts[unit], model) if unit in cuts else fold(unit, model)
            return known[unit]

        def wrong(unit: str) -> bool:
            if unit not in bad:
                bad[unit] = spelled(ids(unit), model) != unit.replace(BLANK, " ")
            return bad[unit]

        out: list[tuple[bytes, bytes, bytes]] = []
        for said in left["__units"].to_pylist():
            units = said.split(" ")
            each = [ids(u) for u in units]
            out.append((packed(np.array([len(x) for x in each], np.uint32)), packed(np.array([i for x in each for i in x], np.uint32)), packed(np.array([wrong(u) for u in units], np.uint32))))
        columns = [pa.array(x, pa.binary()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.binary())] * 3
        return pa.table([left["__chunk"], left["__bucket"], *columns], ["__chunk", "__bucket", "__widths", "__ids", "__bad"])

    folds = folds.withColumnRenamed("__bucket", "__of")
    key, of = ["__bucket"], ["__of"]
    if parts > 1:
        # A bucket with more entries than a task should take: its chunks are dealt, and each part gets the bucket's folds.
        key, of = [*key, "__part"], [*of, "__of_part"]
        dictionaries = dictionaries.withColumn("__part", F.pmod(F.xxhash64("__chunk"), F.lit(parts)).cast("int"))
        folds = folds.withColumn("__of_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return dictionaries.groupBy(*key).cogroup(folds.groupBy(*of)).applyInArrow(run, "__chunk long, __bucket int, __widths binary, __ids binary, __bad binary")


def encode(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """keep, n_tokens, ids, exact: whether the ids decode to the text (with U+2581 as a blank); one row for each row of docs."""
    spark = docs.sparkSession
    tasks = 8 * spark.sparkContext.defaultParallelism
    # Bucketed by chunk, so that a chunk's documents don't move again.
    chunks, files = bucketed(cut(docs, model, keep, limits), "pieces_chunks", "__chunk", tasks)
    entries = files.agg(F.sum("__n")).first()[0] or 0
    # A fixed number of tasks, as the dictionaries are small for what is done with them. Both that read this shuffle ask for
    # the same columns, so that it is done once.
    dictionaries = files.where("__units is not null").select("__chunk", "__bucket", "__units").repartition(tasks, "__bucket")
    each = dictionaries.select("__chunk", "__bucket", F.explode(F.split("__units", " ")).alias("unit"))
    distinct = each.groupBy("__bucket", "unit").agg(F.min("__chunk").alias("first")).where("first is not null").drop("first")
    folds = folded(lattice(distinct, model, ("__bucket",)), model)
    found = answers(dictionaries, folds, model, 1 + int(entries / (BUCKETS * limits.bucket_entries)))

    inner = StructType([StructField(f.name, f.dataType) for f in docs.select(*keep).schema])
    schema = StructType(list(inner)).add("n_tokens", IntegerType()).add("ids", ArrayType(IntegerType())).add("exact", BooleanType())

    def put_together(left: pa.Table, right: pa.Table) -> pa.Table:
        order = next((unpacked(x) for x in left["__order"].to_pylist() if x is not None), np.empty(0, np.int32))
        by_bucket = np.argsort(right["__bucket"].to_numpy(), kind="stable")
        joined = lambda name: np.concatenate([unpacked(b) for b in right[name].take(pa.array(by_bucket)).to_pylist()]) if right.num_rows else np.empty(0, np.int32)
        flat, widths = joined("__ids"), joined("__widths")
        number = np.argsort(order, kind="stable")
        begin, width, bad = (np.empty(len(order), np.int64) for _ in range(3))
        begin[number], width[number], bad[number] = np.cumsum(widths) - widths, widths, joined("__bad")
        docs_of = left.filter(pa.compute.is_valid(left["__cut"]))
        parts = []
        for lo in range(0, docs_of.num_rows, TOGETHER):
            some = docs_of.slice(lo, TOGETHER)
            cuts = [unpacked(c) for c in some["__cut"].to_pylist()]
            ends = np.cumsum([0, *map(len, cuts)])
            at = np.concatenate(cuts)
            places = np.concatenate(([0], np.cumsum(width[at])))
            ids = flat[np.repeat(begin[at] - places[:-1], width[at]) + np.arange(places[-1])]
            wrong = np.concatenate(([0], np.cumsum(bad[at])))
            lists = pa.ListArray.from_arrays(pa.array(places[ends].astype(np.int32)), pa.array(ids.astype(np.int32)))
            exact = pa.array(wrong[ends[1:]] == wrong[ends[:-1]])
            parts.append(pa.table([*(some[k] for k in keep), pa.array(np.diff(places[ends]).astype(np.int32)), lists, exact], [*keep, "n_tokens", "ids", "exact"]))
        if parts:
            return pa.concat_tables(parts)
        return pa.table([*(docs_of[k] for k in keep), pa.array([], pa.int32()), pa.array([], pa.list_(pa.int32())), pa.array([], pa.bool_())], [*keep, "n_tokens", "ids", "exact"])

    own = chunks.where("__cut is not null or __order is not null").select(*keep, "__chunk", "__cut", "__order")
    return own.groupBy("__chunk").cogroup(found.groupBy("__chunk")).applyInArrow(put_together, schema)


def decode(encoded: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, decoded; null ids decode to null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(lo, TOGETHER) for whole in batches for lo in range(0, whole.num_rows, TOGETHER)):
            out = [None if x is None else decoded(x, model) for x in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(out, pa.string())], [*keep, "decoded"])

    schema = encoded.select(*keep).schema.add("decoded", "string")
    return encoded.select(*keep, F.col("ids").alias("__ids")).mapInArrow(run, schema)
