"""MinHash near-dedup: bottom-k sketches, inverted lists, union-sketch estimates, exact Jaccard.

A document's set is its distinct ``width``-word shingles (64-bit hashes). Equal sets are one class from the start, so
exact copies in any number cost one row. Each class keeps its ``k`` least hash values, one hash function for all.

Two sets of Jaccard similarity t share about t k of the values retained, and with near certainty at least ``overlap``
of them (5.7 standard deviations below). So, with a class's values ordered by how many classes retain them, rarest
first, two such classes share one of their first n - overlap + 1. Values kept by one class only link nothing: a class
with that many of them is done. The rest go to inverted lists.

A list of any length gives no pairs. Its hub is the class whose values are the most common in sum; every class in it
is a member of the hub's group, so groups are stars and grow with the rows. A group is dealt to parts of ``HUB_ROWS``
members or more, each with a copy of the hub's row, so no join on the hub puts a large group into one task. Within a
group

1. members whose union-sketch estimate against the hub allows it are compared with the hub exactly, on full sets;
2. connected components follow; groups of one component are done;
3. members outside the hub's component (leftovers) are compared with all members of other components, exactly, in
   blocks of ``block`` x ``block`` held as bit matrices; only links come out.

Defined cases: null text is empty; a text with fewer words than ``width`` is one shingle of all its words; a text without
words has an empty set and links with nothing; repeated rows are copies; a null doc_id stays alone; empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS, component_labels, lower_ascii, mix64, small_batches, written

K = 64
BLOCK = 256
#: Ids of group members (16 bytes each) that are sent to the tasks; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Members in a part of a group; parts of huge groups hold 8 times the root of the group's size.
HUB_ROWS = 1024
_MUL = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = WORDS.findall(lower_ascii(text or ""))
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return mix64(np.array([xxhash.xxh64_intdigest("\x1f".join(words), len(words))], np.uint64))
    ids = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    h = ids[: len(ids) - width + 1].copy()
    for j in range(1, width):
        h = mix64(h * _MUL + ids[j : len(ids) - width + 1 + j])
    return np.unique(h)


def least_overlap(k: int, similarity: float) -> int:
    """How many of k retained values two sets of that similarity share but for about 1e-8 of cases."""
    return max(1, math.floor(k * similarity - 5.7 * math.sqrt(k * similarity * (1 - similarity))))


def _features(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, width) for t in b.column("text").to_pylist()]
            mark = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(mark, pa.binary()), pa.array([s[:k].view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["doc_id", "n", "mark", "sketch"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([shingle_set(t, width).view(np.int64) for t in b.column("text").to_pylist()], pa.list_(pa.int64()))], names=["id", "grams"])

    return run


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all of b: a matrix product over the values both sides have."""
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(flat_a, flat_b)
    if not len(shared):
        return np.zeros((len(a), len(b)), np.int64)
    out = np.zeros((len(a), len(b)), np.float32)
    row = lambda x: np.repeat(np.arange(len(x)), [len(s) for s in x])

    def placed(flat: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(shared, flat)
        ok = (at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == flat)
        return rows[ok], at[ok]

    (ra, ca), (rb, cb) = placed(flat_a, row(a)), placed(flat_b, row(b))
    for lo in range(0, len(shared), 8192):  # columns in slices: bounded memory
        wide = min(8192, len(shared) - lo)
        ma, mb = np.zeros((len(a), wide), np.float32), np.zeros((len(b), wide), np.float32)
        for m, r, c in ((ma, ra, ca), (mb, rb, cb)):
            ok = (c >= lo) & (c < lo + wide)
            m[r[ok], c[ok] - lo] = 1
        out += ma @ mb.T
    return out.astype(np.int64)


def _block_links(percent: int):
    def run(cell: pd.DataFrame) -> pd.DataFrame:
        left, right = cell[cell.side], cell[~cell.side]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="int64")})
        na, nb = left.grams.map(len).to_numpy(), right.grams.map(len).to_numpy()
        both = _overlaps(list(left.grams), list(right.grams))
        hit = (100 * both >= percent * (na[:, None] + nb[None] - both)) & (left.label.to_numpy()[:, None] != right.label.to_numpy()[None])
        i, j = np.nonzero(hit)
        return pd.DataFrame({"a": left.id.to_numpy()[i], "b": right.id.to_numpy()[j]})

    return run


def near_components(docs: DataFrame, width: int = 5, percent: int = 80, k: int = K, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): components of documents linked by 100 |A & B| >= percent |A | B|.

    component_id is the smallest doc_id of the component; kept marks that document.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    feats = written(docs.mapInArrow(_features(width, k), "doc_id long, n long, mark binary, sketch array<long>"), "near-sketches")
    reps = written(feats.where("n > 0 and doc_id is not null").groupBy("n", "mark").agg(F.min("doc_id").alias("id"), F.min("sketch").alias("sketch")), "near-classes")

    share = least_overlap(k, percent / 100) / k
    held = F.size("sketch")
    spare = held - F.greatest(F.lit(1), F.floor(held * share)) + 1
    kept_by = reps.select(F.explode("sketch").alias("value")).groupBy("value").agg(F.count("*").alias("f")).where("f > 1")
    values = reps.select("id", spare.cast("int").alias("spare"), held.alias("held"), F.explode("sketch").alias("value")).join(kept_by, "value")
    lists = values.groupBy("id", "spare", "held").agg(F.sort_array(F.collect_list(F.struct("f", "value"))).alias("common"), F.sum(F.log("f")).alias("weight"))
    # values of one class only come first in the order; they use up part of the prefix
    left = F.col("spare") - (F.col("held") - F.size("common"))
    lists = lists.where(left > 0).select("id", "weight", F.explode(F.slice("common", 1, F.greatest(left, F.lit(1)))).alias("x")).select("id", "weight", F.col("x.value").alias("value"))
    lists = written(lists, "near-lists")
    hubs = lists.groupBy("value").agg(F.count("*").alias("n"), F.max(F.struct("weight", (-F.col("id")).alias("minus"))).alias("top")).where("n > 1").select("value", "n", (-F.col("top.minus")).alias("hub"))
    hubs = written(hubs, "near-hubs")
    # a hub leads as many lists as it has values at most; the sum of their lengths bounds its group
    of_list = F.sum("n")
    heads = hubs.groupBy("hub").agg(F.ceil(of_list / F.greatest(F.lit(HUB_ROWS), 8 * F.sqrt(of_list))).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")
    copies = lambda rows: rows.join(heads, "hub").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    members = written(lists.select("id", "value").join(hubs.join(heads, "hub"), "value").select("hub", part, "id").distinct(), "near-members")

    # whatever is in a group; few enough ids are sent to the tasks, so that neither texts nor sketches are shuffled
    ids = written(members.select("id").unionByName(members.select(F.col("hub").alias("id"))).distinct(), "near-ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    # union-sketch estimates against the hub
    sk = reps.select("id", "sketch", "n").join(wanted, "id")
    pairs = members.where("hub <> id").join(sk, "id").join(copies(sk.select(F.col("id").alias("hub"), F.col("sketch").alias("of_hub"), F.col("n").alias("hub_n"))), ["hub", "part"])
    union = F.slice(F.array_sort(F.array_union("sketch", "of_hub")), 1, k)
    estimate = F.size(F.array_intersect(union, F.array_intersect("sketch", "of_hub"))) / F.size(union)
    near = (F.lit(100) * F.least("n", "hub_n") >= F.lit(percent) * F.greatest("n", "hub_n")) & (estimate >= share)
    stars = pairs.select("hub", "part", "id", near.alias("near"))

    texts = docs.join(wanted.withColumnRenamed("id", "doc_id"), "doc_id").select(F.col("doc_id").alias("id"), "text")
    grams = texts.mapInArrow(_sets(width), "id long, grams array<long>")
    grams = written(grams, "near-sets")

    tested = stars.where("near").select("hub", "part", "id").join(grams, "id").join(copies(grams.select(F.col("id").alias("hub"), F.col("grams").alias("of_hub"))), ["hub", "part"])
    both = F.size(F.array_intersect("grams", "of_hub"))
    tested = tested.where(F.lit(100) * both >= F.lit(percent) * (F.size("grams") + F.size("of_hub") - both))
    links = written(tested.select(F.col("hub").alias("a"), F.col("id").alias("b")), "near-links")
    labels = component_labels(links)

    named = members.unionByName(heads.withColumn("id", F.col("hub")).select("hub", part, "id")).distinct().join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    hub_label = labels.select(F.col("id").alias("hub"), F.col("label").alias("hub_label"))
    named = named.join(copies(hub_label), ["hub", "part"], "left").withColumn("loose", F.col("label") != F.coalesce("hub_label", "hub"))
    named = written(named.select("hub", "part", "id", "label", "loose"), "near-groups")
    # leftovers against all members, less what step 1 compared: groups of hub and one member have nothing left
    sizes = named.groupBy("hub").agg(F.count_if("loose").alias("n_loose"), F.count("*").alias("n_all")).where("n_loose > 0 and n_all > 2")
    rest = named.join(copies(sizes), ["hub", "part"])
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    cell = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), blocks(n)).cast("int")
    loose = rest.where("loose").select("hub", "id", "label", F.lit(True).alias("side"), cell("n_loose", 1).alias("i"), F.explode(F.sequence(F.lit(0), blocks("n_all") - 1)).alias("j"))
    every = rest.select("hub", "id", "label", F.lit(False).alias("side"), F.explode(F.sequence(F.lit(0), blocks("n_loose") - 1)).alias("i"), cell("n_all", 2).alias("j"))
    cells = loose.unionByName(every).join(grams, "id")
    more = cells.groupBy("hub", "i", "j").applyInPandas(_block_links(percent), "a long, b long")
    more = written(more.distinct(), "near-links")
    if not more.isEmpty():
        labels = component_labels(links.unionByName(more))

    # from classes back to documents; the smallest doc_id of a component is the smallest class id in it
    classes = reps.join(labels, "id", "left").select("n", "mark", F.coalesce("label", "id").alias("component"))
    out = feats.select("doc_id", "n", "mark").join(classes, ["n", "mark"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
