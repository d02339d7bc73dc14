"""Near-duplicate documents by BagMinHash.

A document is the multiset of its word five-grams; two documents are linked if the weighted Jaccard similarity of
their multisets is `SIMILAR` or more, and classes are the connected parts of the links, copies included.

Signatures: each element has Poisson processes over its discretised weight, one for each of the dyadic weight intervals
(0,1], (1,2], (2,4], (4,8] ..., so that an element of weight w shares all points below w with the same element
of any larger weight; points in the interval that holds w are thinned by their place. Every point has an arrival
time and a slot, a slot keeps its earliest time, and a process stops as soon as its time passes the latest slot. Slots
of two documents agree with the probability of their weighted Jaccard similarity.

Copies are folded first. Then signatures are banded; documents of a bucket are compared with a centre of the bucket,
never with each other in all pairs, first each with the centre that shares most bands, then, in two rounds, one witness
of every class in a bucket with a witness of another. Rows of buckets that still hold several classes are searched by an exact
prefix filter on their grams: where they meet, each class's most central text is first compared with the most central of all
(`central`), which joins the copies of one text to it by one pair each, and what is left is then searched completely (`candidates`).
The rounds only join most classes cheaply.
All comparisons are exact, on the whole multisets. With 24 bands of 5 slots a pair at the threshold shares a bucket
with probability 0.9999; a pair that does is never missed.

The texts are read twice: for signatures, and for the grams of the documents that share a bucket, which are written and serve all
comparisons.

Defined cases: texts of one to four words are one gram of all their words; a null text or one without words is alone in its
class; a text of any length is compared whole, and a task holds one such text at a time; repeated rows are copies, doc_id need
not be unique, and a class is named by its least doc_id (null if all are null); of rows with the same least doc_id the first row
stays; extra columns travel in a struct, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import map_slices, materialize, packed

#: Words of a gram, similarity of a link.
WORDS, SIMILAR = 5, 0.8
#: Bands of a signature and slots of a band.
BANDS, SLOTS = 24, 5
#: Rounds that compare witnesses of different classes in a bucket, before the buckets are searched completely.
ROUNDS = 2
#: Rounds that compare classes with the most central text they share rare grams with, before the search is complete.
CENTRAL_ROUNDS = 2
#: A set of row numbers is broadcast up to this many rows (8 MB); beyond, the join is shuffled.
BROADCAST_ROWS = 500_000

GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """A hash as a number in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def grams(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The text's number and the 64-bit hash of every gram of texts given as words."""
    known: dict[str, int] = {}
    for ws in texts:
        for w in set(ws):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
    size = np.array([len(ws) for ws in texts], np.int64)
    flat = np.fromiter((known[w] for ws in texts for w in ws), np.uint64, int(size.sum()))
    doc = np.repeat(np.arange(len(texts)), size)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    rolled = np.zeros(len(flat), np.uint64)
    for k in range(WORDS):
        later = np.zeros(len(flat), np.uint64)
        later[: max(0, len(flat) - k)] = flat[k:]
        inside = place + k < np.repeat(size, size)
        rolled = np.where(inside, mix(rolled * GOLD + later + np.uint64(k + 1)), rolled)
    first = (place == 0) | (place + WORDS <= np.repeat(size, size))
    return doc[first], rolled[first]


def weigh(doc: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, gram) with their counts, sorted."""
    if not len(doc):
        return doc, gram, np.zeros(0, np.int64)
    order = np.lexsort((gram, doc))
    d, g = doc[order], gram[order]
    new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (g[1:] != g[:-1])])
    return d[new], g[new], np.diff(np.r_[new, len(d)])


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, slots: int) -> np.ndarray:
    """BagMinHash of n_docs multisets: earliest arrival times, a row of `slots` for each; inf for empty multisets."""
    rows_doc, rows_seed, rows_low, rows_size, rows_weight = [], [], [], [], []
    low, size, level = 0, 1, 0
    while len(doc):
        rows_doc.append(doc)
        rows_seed.append(mix(element + np.uint64(int(GOLD) * (level + 1) & (1 << 64) - 1)))
        rows_low.append(np.full(len(doc), low))
        rows_size.append(np.full(len(doc), size))
        rows_weight.append(weight)
        low, size, level = low + size, max(1, low + size), level + 1
        more = weight > low
        doc, element, weight = doc[more], element[more], weight[more]
    best = np.full(n_docs * slots, np.inf)
    if not rows_doc:
        return best.reshape(n_docs, slots)
    doc, seed, low, size, weight = map(np.concatenate, (rows_doc, rows_seed, rows_low, rows_size, rows_weight))
    time = np.zeros(len(doc))
    while len(doc):
        seed = mix(seed + GOLD)
        time = time - np.log(unit(seed)) / size
        own = mix(seed ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        slot = (own % np.uint64(slots)).astype(np.int64)
        inside = low + np.floor(unit(mix(own)) * size * (1 - 2.0**-52)) < weight
        np.minimum.at(best, doc[inside] * slots + slot[inside], time[inside])
        last = best.reshape(n_docs, slots).max(1)
        live = time < last[doc]
        doc, seed, low, size, weight, time = doc[live], seed[live], low[live], size[live], weight[live], time[live]
    return best.reshape(n_docs, slots)


def bands(signature: np.ndarray) -> np.ndarray:
    """One hash for each band, a row for each document."""
    bits = signature.view(np.uint64).reshape(len(signature), BANDS, SLOTS)
    out = np.zeros(bits.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for k in range(SLOTS):
        out = mix(out * GOLD + bits[:, :, k])
    return out.view(np.int64)


def _signed(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = [words(t) for t in batch.column("text").to_pylist()]
    found = bands(signatures(*weigh(*grams(texts)), len(texts), BANDS * SLOTS))
    digest = pa.array([xxhash.xxh3_128_digest("\x20".join(ws).encode()) if ws else None for ws in texts], pa.binary())
    some = pa.array([bool(ws) for ws in texts])
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * BANDS, pa.int32()), pa.array(found.ravel(), pa.int64()))
    return pa.RecordBatch.from_arrays([batch.column("kept"), batch.column("row"), digest, lists, some], names=["kept", "row", "digest", "bands", "some"])


def _gathered(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = [words(t) for t in batch.column("text").to_pylist()]
    doc, gram = grams(texts)
    gram = gram[np.lexsort((gram, doc))]
    ends = np.cumsum(np.bincount(doc, minlength=len(texts)))
    return pa.RecordBatch.from_arrays([batch.column("row"), pa.array([g.tobytes() for g in np.split(gram, ends[:-1])], pa.binary())], names=["row", "grams"])


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard of two sorted lists of grams."""
    (x, n), (y, m) = (np.unique(np.frombuffer(v, np.uint64), return_counts=True) for v in (a, b))
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both / max(1, (len(a) + len(b)) // 8 - both)


def _verified(batch: pa.RecordBatch) -> pa.RecordBatch:
    good = []
    for a, b in zip(batch.column("a_grams"), batch.column("b_grams"), strict=True):
        good.append(similarity(a.as_py(), b.as_py()) >= SIMILAR)
    return batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _among(df: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on row: with a broadcast if the rows are few, counted first, else shuffled."""
    return df.join(F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows, "row", how)


def verify(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """The pairs (a, b) of rows whose grams are similar. own: row, grams, a written table."""
    side = lambda x: own.select(F.col("row").alias(x), F.col("grams").alias(f"{x}_grams"))
    near = F.least(F.octet_length("a_grams"), F.octet_length("b_grams")) >= SIMILAR * F.greatest(F.octet_length("a_grams"), F.octet_length("b_grams"))
    return map_slices(pairs.join(side("a"), "a").join(side("b"), "b").where(near), _verified, "a long, b long", "a_grams")


def components(links: DataFrame) -> DataFrame:
    """(row, label) of every row in the links (a, b): the least row of its connected part. Contracts the links until none is left."""
    edges = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    out = None
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = materialize(both.groupBy(F.col("a").alias("row")).agg(F.min("b").alias("m")).select("row", F.least("row", "m").alias("label")))
        if out is None:
            out = step
        else:
            moved = step.select(F.col("row").alias("label"), F.col("label").alias("next"))
            out = materialize(out.join(moved, "label", "left").select("row", F.coalesce("next", "label").alias("label")))
        to = lambda x: step.select(F.col("row").alias(x), F.col("label").alias(f"{x}_to"))  # noqa: E731, B023
        moved = edges.join(to("a"), "a").join(to("b"), "b").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
        edges = materialize(moved.where("a <> b").distinct())
    return out if out is not None else edges.select(F.col("a").alias("row"), F.col("b").alias("label"))


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (row, label) after links between labels are added."""
    moved = components(links).select(F.col("row").alias("label"), F.col("label").alias("next"))
    return materialize(labels.join(moved, "label", "left").select("row", F.coalesce("next", "label").alias("label")))


def _elements(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The grams of each row as a set: the k-th occurrence of a gram is an element of its own."""
    rows, sizes, elements = [], [], []
    for row, raw in zip(batch.column("row").to_pylist(), batch.column("grams").to_pylist(), strict=True):
        gram = np.frombuffer(raw, np.uint64)
        new = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]][: len(gram)])
        nth = np.arange(len(gram)) - np.repeat(new, np.diff(np.r_[new, len(gram)]))
        elements.append(np.where(nth > 0, mix(gram + GOLD * nth.astype(np.uint64)), gram).view(np.int64))
        rows.append(np.full(len(gram), row, np.int64))
        sizes.append(np.full(len(gram), len(gram), np.int32))
    whole = lambda x, kind: pa.array(np.concatenate([np.zeros(0, kind), *x]))
    return pa.RecordBatch.from_arrays([whole(rows, np.int64), whole(sizes, np.int32), whole(elements, np.int64)], names=["row", "size", "element"])


def heads(members: DataFrame, labels: DataFrame, own: DataFrame) -> DataFrame:
    """(row, size, mass, element, place), written: where texts of the buckets that still hold several classes have to meet if they are similar.

    With elements in one order, rarest first, the first common element of two similar texts lies within the first
    size - need + 1 of both, where need is the least overlap that reaches the similarity. Elements that the very same rows
    have come one after the other in all of them, so the first stands for all. mass: how many rows have an element of
    the row, on average; the text that a group's texts are copies of has more than they.
    """
    held = materialize(members.select("band", "key", "row").join(labels, "row"))
    # A bucket of two rows is done: the first round compared them.
    mixed = materialize(held.groupBy("band", "key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high and n > 2").select("band", "key"))
    rows = materialize(held.join(mixed, ["band", "key"]).select("row").distinct())
    each = materialize(map_slices(_among(own, rows, "left_semi"), _elements, "row long, size int, element long", "grams"))
    # 128 bits stand for the set of rows that have the element.
    same = F.bit_xor(F.xxhash64("row")).alias("same"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("same_too")
    often = materialize(each.groupBy("element").agg(F.count(F.lit(1)).alias("n"), *same).where("n > 1"))
    by_row = Window.partitionBy("row")
    in_order = by_row.orderBy("n", "same", "same_too", "element")
    # Elements of one row alone come first in every order; they only count.
    place = F.col("size") - F.count(F.lit(1)).over(by_row) + F.row_number().over(in_order) - 1
    first = F.coalesce((F.lag("same").over(in_order) != F.col("same")) | (F.lag("same_too").over(in_order) != F.col("same_too")), F.lit(True))
    placed = each.join(often, "element").select("row", "size", (F.sum("n").over(by_row) / F.col("size")).alias("mass"), "element", place.alias("place"), first.alias("first"))
    return materialize(placed.where(F.col("first") & (F.col("place") <= F.col("size") * (1 - SIMILAR) + 1e-6)).drop("first"))


def central(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b), one for each element and class: the class's row of greatest mass, and that of all classes. found: as heads() gives it.

    A text that is similar to the one of greatest mass in a class meets it here, since they share an element of their heads.
    """
    of_class = materialize(found.join(labels, "row").groupBy("element", "label").agg(F.max(F.struct("mass", "row")).alias("top")))
    hub = materialize(of_class.groupBy("element").agg(F.max(F.struct("top", "label")).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    pairs = of_class.join(hub, "element").where(F.col("label") != F.col("hub.label"))
    return pairs.select(F.least("top.row", "hub.top.row").alias("a"), F.greatest("top.row", "hub.top.row").alias("b")).distinct()


def candidates(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows of different classes that can be similar, all of them. found: as heads() gives it.

    The smaller text of a similar pair has their first common element in a shorter head than the larger, so texts that share
    less than the threshold with each other, as those of a template do, meet nowhere. A class that holds most rows of an element
    is never compared with itself.
    """
    named = materialize(found.drop("mass").join(labels, "row"))
    of_class = named.groupBy("element", "label").agg(F.count(F.lit(1)).alias("n"))
    most = of_class.groupBy("element").agg(F.max_by("label", F.struct("n", "label")).alias("most"), F.count(F.lit(1)).alias("classes")).where("classes > 1").drop("classes")
    met = materialize(named.join(materialize(most), "element"))
    side = lambda df, x: df.select("element", *[F.col(c).alias(f"{x}_{c}") for c in ("row", "label", "size", "place")])
    short = met.where(F.col("place") <= F.col("size") * (1 - 2 * SIMILAR / (1 + SIMILAR)) + 1e-6)
    need = (F.col("a_size") + F.col("b_size")) * (SIMILAR / (1 + SIMILAR)) - 1e-6
    fits = (F.col("a_label") != F.col("b_label")) & (F.col("a_size") <= F.col("b_size")) & (F.col("a_size") - F.col("a_place") >= need) & (F.col("b_size") - F.col("b_place") >= need)
    pair = F.least("a_row", "b_row").alias("a"), F.greatest("a_row", "b_row").alias("b")
    meet = lambda small, large: side(small, "a").join(side(large, "b"), "element").where(fits).select(*pair)
    return meet(short.where("label <> most"), met).unionAll(meet(short.where("label = most"), met.where("label <> most"))).distinct()


def _linked(labels: DataFrame, pairs: DataFrame, own: DataFrame) -> DataFrame:
    """labels after the similar ones of the pairs are linked."""
    at = lambda x: labels.select(F.col("row").alias(x), F.col("label").alias(f"{x}_label"))
    links = verify(pairs, own).join(at("a"), "a").join(at("b"), "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))
    return _relabel(labels, links)


def classes(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """(signed rows of docs: kept, a struct of the columns of `keep`, row, ...; labels: row, label), both written tables."""
    # The text is among the kept columns, so that it is written once.
    taken = packed(docs, list(dict.fromkeys([*keep, "text"]))).withColumn("row", F.monotonically_increasing_id())
    schema = T.StructType([taken.schema["kept"], taken.schema["row"], T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("some", T.BooleanType())])
    signed = materialize(map_slices(taken, _signed, schema))
    worded = signed.where("some")
    firsts = materialize(worded.groupBy("digest").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("n")))

    first_rows = firsts.select("row")
    buckets = _among(worded.select("row", "bands"), first_rows, "left_semi").select("row", F.posexplode("bands").alias("band", "key"))
    centres = buckets.groupBy("band", "key").agg(F.min("row").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = materialize(buckets.join(centres, ["band", "key"]))

    shared = members.where("row <> centre").groupBy("row", "centre").agg(F.count(F.lit(1)).alias("n"))
    pairs = shared.groupBy("row").agg(F.max_by("centre", F.struct("n", -F.col("centre"))).alias("b")).select(F.col("row").alias("a"), "b")
    tried = materialize(pairs)
    # Whatever meets in a bucket: its grams are written once, by row.
    met = materialize(members.select("row").distinct())
    own = materialize(map_slices(_among(signed.select("row", F.col("kept.text").alias("text")), met, "left_semi"), _gathered, "row long, grams binary"))
    ids = materialize(met.select("row", F.col("row").alias("label")))
    labels = _relabel(ids, verify(tried, own))

    for turn in range(ROUNDS):
        # One witness of every class of a bucket meets a witness of the bucket's least or greatest class in turn.
        pick, other = (F.min, F.max) if turn % 2 == 0 else (F.max, F.min)
        seen = members.select("band", "key", "row").join(labels, "row").groupBy("band", "key", "label").agg(pick("row").alias("row"))
        hub = seen.groupBy("band", "key").agg(pick(F.struct("label", "row")).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
        pairs = seen.join(hub, ["band", "key"]).where(F.col("label") != F.col("hub.label"))
        pairs = pairs.select(F.least("row", "hub.row").alias("a"), F.greatest("row", "hub.row").alias("b")).distinct()
        known = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        fresh = materialize(pairs.join(known, ["a", "b"], "left_anti"))
        if fresh.isEmpty():
            continue
        labels = _linked(labels, fresh, own)
        tried = materialize(known.unionAll(fresh))

    found = heads(members, labels, own)
    for turn in range(CENTRAL_ROUNDS + 1):
        # What is central first; at last all that is left, completely.
        pairs = central(found, labels) if turn < CENTRAL_ROUNDS else candidates(found, labels)
        known = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        fresh = materialize(pairs.join(known, ["a", "b"], "left_anti"))
        if fresh.isEmpty():
            continue
        labels = _linked(labels, fresh, own)
        tried = materialize(known.unionAll(fresh))

    of_first = firsts.join(labels, "row", "left").select("digest", F.coalesce("label", "row").alias("label"))
    labelled = worded.select("row", "digest").join(of_first, "digest").select("row", "label")
    alone = signed.where(~F.col("some")).select("row", F.col("row").alias("label"))
    return signed, materialize(labelled.unionAll(alone))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, class_id (the least doc_id of its class), class_size."""
    signed, labels = classes(docs, [doc_id])
    ids = materialize(signed.select("row", F.col("kept").getField(doc_id).alias("doc_id")).join(labels, "row"))
    # Written, so that the join below has exchanges of its own and a class of any size is split among tasks.
    sizes = materialize(ids.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")))
    return ids.join(sizes, "label").select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs, all columns, without all but one of each class: the least doc_id, then the first row, stays."""
    signed, labels = classes(docs, docs.columns)
    own = F.col("kept").getField(doc_id)
    ranked = materialize(signed.select("row", F.struct(own.isNull().alias("no"), own.alias("id"), F.col("row")).alias("rank")).join(labels, "row"))
    # Written, so that the join below has exchanges of its own and a class of any size is split among tasks.
    kept = materialize(ranked.groupBy("label").agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    gone = ranked.select("label", "row").join(kept.select("label", F.col("rank.row").alias("first")), "label").where("row <> first").select("row")
    return _among(signed.select("row", "kept"), materialize(gone), "left_anti").select("kept.*")
