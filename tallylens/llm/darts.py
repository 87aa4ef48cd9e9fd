"""Near copies by DartMinHash.

A document is the multiset of its five-word windows (words with ASCII letters in
lower case; a shorter text is one window). A window found w times owns the
region ``[0, w)``, cut into unit strips. Darts fall on every strip as a Poisson
process that only depends on the hash of window and strip: the ranks of a strip
are sums of exponential gaps, each taken from a hash, and every dart has a
hashed coordinate of the signature. A document keeps the darts of rank below
``t / weight``, about ``t`` whatever its size; the earliest dart of a coordinate
is the signature's value there. Two documents agree in a coordinate with the
probability of their weighted Jaccard similarity.

Equal texts (by their words) are one text from the start. Signatures are cut into
``BANDS`` bands of ``ROWS`` values; texts with an equal band share a bucket.
Texts that share a bucket are compared on their windows, in two steps:

* Pivots. In each round every bucket whose texts are not of one class yet names
  its most central text that was no pivot before, and a text is compared with one
  of the pivots of its buckets: a round has no more pairs than texts. Rounds go
  on as long as a good part of their pairs are similar. They tie up groups of
  near copies, however large.
* What is left in buckets of several classes meets by an exact prefix filter. Two
  multisets of similarity 0.8 share one of the rarest ``n - ceil(0.8 n) + 1``
  strips of each, at places that leave enough strips behind them. How rare a
  strip is, is read from a table of fixed size of hashed counts: any order is
  right, and the table tells the strips of shared passages, which are in very
  many texts, from the rest. Pairs whose similarities to a common pivot differ too
  much are left out, as ``1 - similarity`` obeys the triangle inequality.

So no link between texts that share a bucket is lost, and texts that merely share
a passage do not meet. A comparison sends the windows of a text once, and those
of its partner once for every ``CELL`` texts compared with it.

Defined results: every row is a document, also with a repeated id. Rows without
words are a class of their own each. A null id is never the smallest of its
class; a class without any id has a null class_id. ``class_size`` counts rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylens.llm.graph import components
from tallylens.llm.tables import pick
from tallylens.llm.tokens import cut, find_words, mix, raw, unit
from tallylens.session import bucketed
from tallylens.sources.files import row_hash, staged

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 25, 5
DARTS = 1200  # expected number per document; a coordinate stays empty once in about 15,000
CELL = 64  # texts compared with one copy of a partner's windows
PROGRESS = 0.25  # rounds of pivots go on as long as this share of their pairs is similar
COUNTERS = 1 << 20  # of the table that tells frequent strips
MARKS, CELL_MARKS = 1 << 24, 1 << 15  # bits of the map that tells whose windows are needed, and of one row of it
PAIRS_SALT = np.uint64(0x5851F42D4C957F2D)


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text the sorted hashes of its windows (repeated ones repeated), their numbers, and a hash of all its words."""
    data, offsets = raw(column)
    upper = (data >= 65) & (data <= 90)
    words = find_words(data + 32 * upper.astype(np.uint8), offsets)
    grams, counts = words.grams(WORDS)
    short = (words.counts > 0) & (words.counts < WORDS)
    # a short text is one window of all its words; place and word give its hash
    place = np.arange(len(words.hashes)) - np.repeat(words.first[:-1], words.counts)
    powers = mix(place.astype(np.uint64) + np.uint64(1)) | np.uint64(1)
    whole = np.zeros(len(words.counts), np.uint64)
    held = words.counts > 0
    if held.any():
        whole[held] = np.add.reduceat(words.hashes * powers, words.first[:-1][held])
    whole = mix(whole + words.counts.astype(np.uint64))
    owner = np.concatenate([np.repeat(np.arange(len(counts)), counts), np.flatnonzero(short)])
    items = np.concatenate([grams, whole[short]])
    order = np.lexsort((items, owner))
    return items[order], counts + short, whole


def signatures(items: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The earliest darts: one row of ``BANDS * ROWS`` hashes per text (0: none)."""
    k, texts = BANDS * ROWS, len(counts)
    owner = np.repeat(np.arange(texts), counts)
    best = np.full((texts, k), np.inf)
    dart = np.zeros((texts, k), np.uint64)
    if not len(items):
        return dart
    # strips of a window's region: the first, second ... time that a text has it
    new = np.ones(len(items), bool)
    new[1:] = (items[1:] != items[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(new)
    strip = np.arange(len(items)) - np.repeat(heads, np.diff(np.append(heads, len(items))))
    state = mix(items + mix(strip.astype(np.uint64) * PAIRS_SALT))
    rank = np.zeros(len(items))
    limit = DARTS / np.maximum(counts, 1)[owner]
    while len(state):
        state = mix(state)
        rank = rank - np.log(unit(state))
        inside = rank < limit
        state, rank, limit, owner = state[inside], rank[inside], limit[inside], owner[inside]
        value = mix(state ^ PAIRS_SALT)
        at = owner * k + (value % np.uint64(k)).astype(np.int64)
        order = np.lexsort((rank, at))
        ahead = np.ones(len(order), bool)
        ahead[1:] = at[order][1:] != at[order][:-1]
        first = order[ahead]
        nearer = first[rank[first] < best.ravel()[at[first]]]
        best.ravel()[at[nearer]] = rank[nearer]
        dart.ravel()[at[nearer]] = value[nearer]
    return dart


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The row without its text, the name of the text, its weight, and its bands where it is the first of its kind in a run."""
    for batch in batches:
        for at, part in cut(batch["text"], 1 << 20):
            items, counts, whole = shingles(part)
            _, first = np.unique(whole, return_index=True)
            new = np.zeros(len(part), bool)
            new[first] = True
            new &= counts > 0
            darts = signatures(items[np.repeat(new, counts)], counts[new]).reshape(int(new.sum()), BANDS, ROWS)
            bands = np.broadcast_to(mix(np.arange(BANDS, dtype=np.uint64)), darts.shape[:2])
            for i in range(ROWS):
                bands = mix(bands * np.uint64(0xD6E8FEB86659FD93) + darts[:, :, i])
            edges = pa.array(np.concatenate([[0], np.cumsum(new * BANDS)]), pa.int32())
            rows = {c: batch[c].slice(at, len(part)) for c in batch.schema.names if c != "text"}
            yield pa.record_batch(rows | {
                "node": pa.array(whole.view(np.int64)),
                "weight": pa.array(counts.astype(np.int64)),
                "bands": pa.ListArray.from_arrays(edges, pa.array(bands.reshape(-1).view(np.int64)))})


def _mark(column: str) -> F.Column:
    """The bit of a value; any value, and null, has one."""
    return F.pmod(F.xxhash64(column), F.lit(MARKS))


def marks(ids: DataFrame, column: str) -> bytes:
    """A map with the bits of all values of a column set. Its size is fixed: the more values, the more others share their bits."""
    held = np.zeros(MARKS // 8, np.uint8)
    table = ids.select(_mark(column).alias("mark")).groupBy(F.floor(F.col("mark") / CELL_MARKS).alias("cell")).agg(
        F.bitmap_construct_agg(F.col("mark") % CELL_MARKS).alias("bits")).toArrow()
    for cell, bits in zip(table["cell"].to_pylist(), table["bits"].to_pylist(), strict=True):
        held[cell * CELL_MARKS // 8 : (cell + 1) * CELL_MARKS // 8] = np.frombuffer(bits, np.uint8)
    return held.tobytes()


def _windows(held: bytes):
    bits = np.frombuffer(held, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The name of a text and its windows, of rows whose mark is set."""
        for batch in batches:
            mark = batch["mark"].to_numpy()
            batch = batch.filter(pa.array((bits[mark >> 3] >> (mark & 7) & 1).astype(bool)))
            for _, part in cut(batch["text"], 1 << 20):
                items, counts, whole = shingles(part)
                edges = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                yield pa.record_batch({
                    "node": pa.array(whole.view(np.int64)), "items": pa.ListArray.from_arrays(edges, pa.array(items.view(np.int64)))})

    return run


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets of windows."""
    both = np.concatenate([a, b])
    side = np.concatenate([np.ones(len(a), np.int64), -np.ones(len(b), np.int64)])
    order = np.argsort(both, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], both[order][1:] != both[order][:-1]]))
    apart = int(np.abs(np.add.reduceat(side[order], heads)).sum())
    # |a| + |b| = shared * 2 + apart, union = shared + apart
    shared = (len(a) + len(b) - apart) // 2
    return shared / (shared + apart)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Similarities within sorted cells: the pivot of a cell comes first."""
    now = windows = None
    for batch in batches:
        pivot, nodes, found = [], [], []
        for p, first, node, items in zip(
                batch["pivot"].to_pylist(), batch["first"].to_pylist(), batch["node"].to_pylist(), batch["items"], strict=True):
            if first == 0:
                now, windows = p, items.values.to_numpy()
            elif now == p:
                pivot.append(p)
                nodes.append(node)
                found.append(similarity(windows, items.values.to_numpy()))
        yield pa.record_batch({
            "pivot": pa.array(pivot, pa.int64()), "node": pa.array(nodes, pa.int64()), "similarity": pa.array(found, pa.float64())})


def compared(pairs: DataFrame, windows: DataFrame) -> DataFrame:
    """pivot, node, similarity of every pair (pivot, node)."""
    sizes = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / CELL).cast("int").alias("salts"))
    members = pairs.join(sizes, "pivot").select(
        "node", "pivot", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("first"))
    pivots = sizes.select(F.col("pivot").alias("node"), "pivot", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("first"))
    sides = members.unionByName(pivots).join(windows, "node")
    return staged(
        sides.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "first")
        .select("pivot", "first", "node", "items").mapInArrow(_compared, "pivot bigint, node bigint, similarity double"), "compared")


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """node and label after the texts of ``links`` (pivot, node) have come to one class."""
    ends = links.join(labels, "node").select("pivot", F.col("label").alias("x")).join(
        labels.withColumnRenamed("node", "pivot"), "pivot").select("x", F.col("label").alias("y"))
    after = components(ends).select(F.col("node").alias("label"), F.col("label").alias("root"))
    return staged(labels.join(after, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")


def _split(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members, with their labels, of buckets whose texts are not of one class."""
    now = members.join(labels, "node")
    mixed = now.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket")
    return now.join(mixed, "bucket")


def _pivots(members: DataFrame, labels: DataFrame, before: DataFrame) -> DataFrame:
    """pivot, node: every text of a mixed bucket with the most central pivot of its buckets that is of another class."""
    now = staged(_split(members, labels), "mixed")
    pivots = now.join(before, "node", "left_anti").groupBy("bucket").agg(
        F.max(F.struct("central", "node", "label", "weight")).alias("p"))
    near = F.least("weight", "p.weight") >= SIMILAR * F.greatest("weight", "p.weight")
    return now.join(pivots, "bucket").where((F.col("label") != F.col("p.label")) & near).groupBy("node").agg(
        F.max(F.struct("p.central", "p.node")).alias("p")).select(F.col("p.node").alias("pivot"), "node")


def _strips(items: np.ndarray) -> np.ndarray:
    """The strips of sorted windows: a window and the times that it came before."""
    new = np.append(True, items[1:] != items[:-1])
    heads = np.flatnonzero(new)
    times = np.arange(len(items)) - np.repeat(heads, np.diff(np.append(heads, len(items))))
    return mix(items.view(np.uint64) + mix(times.astype(np.uint64)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        every = [_strips(items.values.to_numpy()) % np.uint64(COUNTERS) for items in batch["items"]]
        if every:
            total += np.bincount(np.concatenate(every).astype(np.int64), minlength=COUNTERS)
    at = np.flatnonzero(total)
    yield pa.record_batch({"counter": pa.array(at, pa.int32()), "n": pa.array(total[at])})


def _prefixes(counts: bytes):
    often = np.frombuffer(counts, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rarest strips of each text and how many strips lie behind each."""
        for batch in batches:
            rows, strips, behind = [], [], []
            for at, items in enumerate(batch["items"]):
                own = _strips(items.values.to_numpy())
                n = len(own)
                own = own[np.lexsort((own, often[(own % np.uint64(COUNTERS)).astype(np.int64)]))]
                first = n - int(np.ceil(SIMILAR * n - 1e-9)) + 1
                rows.append(np.full(first, at))
                strips.append(own[:first])
                behind.append(n - 1 - np.arange(first))
            if rows:
                yield pa.record_batch([
                    *[c.take(pa.array(np.concatenate(rows))) for c in batch.columns[:-1]],
                    pa.array(np.concatenate(strips).view(np.int64)), pa.array(np.concatenate(behind))],
                    names=[*batch.schema.names[:-1], "strip", "behind"])

    return run


def candidates(rows: DataFrame) -> DataFrame:
    """pivot, node: pairs of different classes that share a rare strip. rows: node, label, weight, pivot, similarity, items."""
    counts = np.zeros(COUNTERS, np.int64)
    # as many rows as there are counters, whatever the input
    table = rows.select("items").mapInArrow(_counted, "counter int, n bigint").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    counts[table["counter"].to_numpy()] = table["n"].to_numpy()
    kinds = dict(rows.dtypes)
    names = ["node", "label", "weight", "pivot", "similarity"]
    prefix = staged(rows.select(*names, "items").mapInArrow(
        _prefixes(counts.tobytes()), ", ".join(f"{c} {kinds[c]}" for c in names) + ", strip bigint, behind bigint"), "prefixes")
    a, b = prefix.alias("a"), prefix.alias("b")
    both = F.col("a.weight") + F.col("b.weight")
    enough = F.lit(1 + 1e-9) + F.least("a.behind", "b.behind") >= SIMILAR / (1 + SIMILAR) * both
    # a difference of similarities to one pivot is at most the distance
    far = F.coalesce((F.col("a.pivot") == F.col("b.pivot")) & (F.abs(F.col("a.similarity") - F.col("b.similarity")) > 1 - SIMILAR + 1e-9), F.lit(False))
    met = a.join(b, (F.col("a.strip") == F.col("b.strip")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.label") != F.col("b.label")) & enough & ~far)
    return staged(met.select(F.col("a.node").alias("pivot"), F.col("b.node").alias("node")).distinct(), "candidates")


def labelled(members: DataFrame, windows: DataFrame) -> DataFrame:
    """node and label of all texts that share a bucket. members: bucket, node, weight, central; windows: node, items."""
    labels = staged(members.select("node", F.col("node").alias("label")).distinct(), "labels")
    before = labels.select("node").limit(0)
    first = None
    while True:
        pairs = staged(_pivots(members, labels, before), "pairs")
        before = staged(before.unionByName(pairs.select(F.col("pivot").alias("node"))).distinct(), "pivots")
        found = compared(pairs, windows)
        first = found if first is None else first
        n, near = found.agg(F.count("*"), F.count_if(F.col("similarity") >= SIMILAR)).first()
        if near:
            labels = joined(labels, found.where(F.col("similarity") >= SIMILAR))
        if near < max(1, PROGRESS * n):
            break
    left = _split(members, labels).select("node", "label", "weight").distinct()
    known = first.groupBy("node").agg(F.max(F.struct("pivot", "similarity")).alias("k")).select("node", "k.*")
    # read twice by ``candidates``, so written once
    left = staged(left.join(known, "node", "left"), "left")
    pairs = candidates(left.join(windows, "node"))
    return joined(labels, compared(pairs, windows).where(F.col("similarity") >= SIMILAR))


def _named(docs: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """doc_id, node, weight and ``more`` (long columns) of every row; node and label of the texts that share a bucket."""
    docs = pick(docs, "doc_id", "text", *more)
    kept = "".join(f"{c} bigint, " for c in ("doc_id", *more))
    signed = staged(docs.mapInArrow(_signed, f"{kept}node bigint, weight bigint, bands array<bigint>"), "signatures")
    texts = signed.where(F.size("bands") > 0).dropDuplicates(["node"])
    rows = texts.select(F.explode("bands").alias("bucket"), "node", "weight")
    shared = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = staged(rows.join(shared, "bucket"), "members")
    central = members.groupBy("node").agg(F.sum("size").alias("central"))
    members = staged(members.join(central, "node").select("bucket", "node", "weight", "central"), "members")
    # windows take more room than the texts: only texts that share a bucket need them, from one row each. Whole texts stay
    # where they are read: a map of the ids sorts most others out, the join by node the rest
    wanted = central.select("node")
    heads = signed.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    windows = bucketed(
        docs.select("text", _mark("doc_id").alias("mark")).mapInArrow(_windows(marks(heads, "doc_id")), "node bigint, items array<bigint>")
        .join(wanted, "node", "left_semi").groupBy("node").agg(F.first("items").alias("items")), "node", "windows")
    return signed.drop("bands"), labelled(members, windows)


def _classed(signed: DataFrame, labels: DataFrame) -> DataFrame:
    """class, class_id, class_size for every text with words: node, class ..."""
    sizes = signed.where("weight > 0").groupBy("node").agg(F.min("doc_id").alias("head"), F.count("*").alias("rows"))
    texts = staged(sizes.join(labels, "node", "left").withColumn("class", F.coalesce("label", "node")).drop("label"), "texts")
    whole = texts.groupBy("class").agg(F.min("head").alias("class_id"), F.sum("rows").alias("class_size"))
    return staged(texts.select("node", "class").join(whole, "class"), "classes")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class) and class_size (its rows) for every row."""
    signed, labels = _named(docs)
    found = signed.join(_classed(signed, labels), "node", "left")
    return found.select(
        "doc_id", F.when(F.isnull("class"), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: the smallest of each class by doc_id (null last), then by its values' hash.

    Rows are chosen by two hashes, of all values and of id and text; whole rows move once, to be met with the chosen ones.
    """
    own = F.xxhash64(F.isnull("doc_id"), "doc_id", F.isnull("text"), "text")  # without nulls' places, rows of unlike texts may share ``__row``
    keyed = docs.withColumn("__row", row_hash(docs, 0)).withColumn("__own", own)
    signed, labels = _named(keyed, "__row", "__own")
    found = _classed(signed, labels).select("node", "class")
    first = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "__row", "__own")).alias("first")
    firsts = signed.where("weight > 0").groupBy("node").agg(first)  # one row for all copies of a text
    least = firsts.join(found, "node").groupBy("class").agg(F.min("first").alias("least"))
    words = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    # equal rows share both hashes; one of them stays
    once = keyed.where(words).join(least.select("least.__row", "least.__own"), ["__row", "__own"], "left_semi").dropDuplicates(["__row", "__own"])
    return once.select(*docs.columns).unionByName(docs.where(~words))
