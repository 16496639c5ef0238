"""Near-duplicate documents by ProbMinHash, banding and verification.

Each distinct 5-word shingle of a text sends arrivals of a Poisson process, at a rate that
is its weight, to random registers; a register keeps its earliest arrival, and a shingle
stops once its next arrival is later than every register's. Two texts agree in a register
with the probability Jaccard of their weighted shingles. Registers are cut into bands; texts
with an equal band are candidates, and candidates are linked if the Jaccard similarity of
their shingle sets is high enough. Classes are the connected components of the links.

Exact copies are one node. In a band's bucket no node meets all others: all are compared
with the bucket's most typical node first (the one with the fewest shingles of its own),
then the rest with the most typical node of the bucket's commonest class. What is still in
another class, and could by its counts be similar enough to a bucket member at all, is
compared with the texts of other classes with which it shares one of its rarest shingles: as
two sets of Jaccard similarity s have more than s of either in common, the rarest 1 - s of one
and of the other, by one order, can't be disjoint. So a bucket of n similar texts costs about
n comparisons, n texts that share a band by boilerplate meet by what sets them apart, and no
link between classes is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterloom.llm.shared import aliased, cut, few, stored, with_row_id
from rosterloom.llm.words import distinct_grams, mix, slices, word_table

SHINGLE, SIMILAR = 5, 0.8
#: Registers, in bands of ROWS: at similarity 0.8 all bands miss with probability 5e-8.
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: A shingle found n times weighs 1 + REPEAT * ln(n).
REPEAT = 0.25

_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: np.ndarray, owner: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, hash and count of the distinct shingles, by owner and hash; a text of 1 to 4 words is one shingle."""
    return distinct_grams(words, owner, n_texts, SHINGLE)


def signatures(of: np.ndarray, codes: np.ndarray, counts: np.ndarray, n_texts: int) -> np.ndarray:
    """ProbMinHash registers of every text: the hash of the shingle that arrives first; all arrivals of one round at a time."""
    earliest = np.full(n_texts * REGISTERS, np.inf)
    winner = np.zeros(n_texts * REGISTERS, np.uint64)
    rate = 1 + REPEAT * np.log(counts)
    time, text, code, step = np.zeros(len(codes)), of, codes, 0
    with np.errstate(over="ignore"):
        while len(code):
            step += 1
            draw = mix(code + np.uint64(step) * _STEP)
            time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / rate
            at = text * REGISTERS + (draw & np.uint64(REGISTERS - 1)).astype(np.int64)
            np.minimum.at(earliest, at, time)
            won = earliest[at] == time
            winner[at[won]] = code[won]
            if len(code) < n_texts:
                texts, where = np.unique(text, return_inverse=True)
                last = earliest.reshape(n_texts, REGISTERS)[texts].max(axis=1)[where]
            else:
                last = earliest.reshape(n_texts, REGISTERS).max(axis=1)[text]
            on = time < last
            time, text, code, rate = time[on], text[on], code[on], rate[on]
    return winner.reshape(n_texts, REGISTERS)


def _sign(batches):
    """The rows with a digest of their words and the hashes of their bands; null for texts without words."""
    for batch in batches:
        for row, data, offsets in slices(batch.column(batch.schema.get_field_index("text"))):
            n = len(offsets) - 1
            words, owner, _ = word_table(data, offsets)
            of, codes, counts = shingles(words, owner, n)
            winner = signatures(of, codes, counts, n).reshape(n, BANDS, ROWS)
            with np.errstate(over="ignore"):
                band = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP, (n, BANDS)).copy()
                for j in range(ROWS):
                    band = mix(band * _STEP + winner[:, :, j])
            some = np.bincount(of, minlength=n) > 0
            edges = np.searchsorted(owner, np.arange(n + 1))
            digests = [xxhash.xxh3_128_digest(words[a:b].tobytes()) if b > a else None for a, b in zip(edges[:-1], edges[1:])]
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(some * BANDS))).astype(np.int32)), pa.array(band[some].reshape(-1).view(np.int64)))
            piece = batch.slice(row, n)
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(digests, pa.binary()), bands], names=[*piece.schema.names, "_digest", "_bands"])


def _shingle_sets(batches):
    for batch in batches:
        for row, data, offsets in slices(batch.column(1)):
            n = len(offsets) - 1
            words, owner, _ = word_table(data, offsets)
            of, codes, _ = shingles(words, owner, n)
            edges = pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.ListArray.from_arrays(edges, pa.array(codes.view(np.int64)))], names=["node", "shingles"])


def components(edges: DataFrame) -> DataFrame:
    """node and label of all nodes of ``edges`` (a, b): the smallest node of the connected component.

    Each round takes the smallest label around a node and then the label of that label; the
    rounds are about the logarithm of the longest path.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = cut(labels.join(cut(near), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("farther"))
        lower = cut(lower.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("farther", "label")).alias("label")))
        labels = lower.select("node", "label")
        if lower.filter("old != label").isEmpty():
            return labels


def _bound(a: str, b: str):
    """The most that the similarity of two nodes can be, by their shingle counts and those that others have too."""
    common = F.least(F.col(f"{a}.shared"), F.col(f"{b}.shared"))
    return common / (F.col(f"{a}.size") + F.col(f"{b}.size") - common)


def rarest(sets: DataFrame, similar: float) -> DataFrame:
    """node, shingle, left and first of the rarest shingles of each of ``sets``, by one order; those of no other set are left out.

    Two sets whose Jaccard similarity is ``similar`` or more have one of these in common. ``left``
    is how many shingles the set has from this one on, ``first`` are all of its rarest.
    """
    terms = sets.select("node", F.explode("shingles").alias("shingle"))
    counted = terms.join(terms.groupBy("shingle").agg(F.count("*").alias("n")), "shingle")
    ranked = counted.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("ranked"))
    size = F.size("ranked")
    first = F.slice("ranked", F.lit(1), (size - F.ceil(similar * size - 1e-9) + 1).cast("int"))
    ranked = ranked.select("node", size.alias("size"), first.alias("first"))
    shared = F.transform(F.filter("first", lambda r: r["n"] > 1), lambda r: r["shingle"])
    rows = ranked.select("node", "size", shared.alias("shared"), F.posexplode("first").alias("at", "rare")).filter("rare.n > 1")
    return rows.select("node", "rare.shingle", (F.col("size") - F.col("at")).alias("left"), F.col("shared").alias("first"))


def signed(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` with _row, _digest and _bands, written once."""
    numbered = with_row_id(documents)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema)
    return stored(numbered.mapInArrow(_sign, f"{schema}, _digest binary, _bands array<long>"))


def classes(rows: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """_row, doc_id, class_row and class_id of every row of ``signed()``: the class is named by one of its rows and its doc_id."""
    nodes = rows.filter("_digest IS NOT NULL").groupBy("_digest").agg(F.min(F.struct("doc_id", "_row")).alias("first"), F.min_by("_bands", F.struct("doc_id", "_row")).alias("bands"))
    nodes = stored(nodes.select("_digest", F.col("first.doc_id").alias("node_doc"), F.col("first._row").alias("node"), "bands"))
    entries = nodes.select(F.explode("bands").alias("bucket"), "node")
    full = stored(entries.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("bucket"))
    members = stored(entries.join(full, "bucket"))
    active = cut(members.select("node").distinct())
    sets = rows.select(F.col("_row").alias("node"), "text").join(few(active), "node").mapInArrow(_shingle_sets, "node long, shingles array<long>")
    sets = stored(sets)
    # Shingles that no other active node has can't be common with one.
    alone = sets.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.min("node").alias("node"), F.count("*").alias("n")).filter("n = 1")
    alone = stored(alone.groupBy("node").agg(F.count("*").alias("alone")))
    sizes = sets.select("node", F.size("shingles").alias("size")).join(alone, "node", "left")
    sizes = sizes.select("node", F.struct("size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("shared")).alias("count"))
    members = stored(members.join(stored(sizes), "node"))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        one = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("s")), "a")
        two = one.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("t")), "b").select("a", "b", F.size(F.array_intersect("s", "t")).alias("common"), (F.size("s") + F.size("t")).alias("sum"))
        return cut(two.filter(F.col("common") >= similar * (F.col("sum") - F.col("common"))).select("a", "b"))

    typical = F.struct((F.col("count.size") - F.col("count.shared")).alias("alone"), F.col("node"), F.col("count"))
    leaders = stored(members.groupBy("bucket").agg(F.min(typical).alias("leader")).select("bucket", F.col("leader.node").alias("y"), F.col("leader.count").alias("v")))
    first = members.select("bucket", F.col("node").alias("x"), F.col("count").alias("u")).join(leaders, "bucket").filter((F.col("x") != F.col("y")) & (_bound("u", "v") >= similar))
    edges = verified(first)
    labels = components(edges)
    sizes = stored(members.select("node", "count").distinct())

    def apart(labels: DataFrame) -> DataFrame:
        """Bucket entries that may still be linked across classes, with their class and the bucket's commonest one."""
        named = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        named = stored(named)
        least = named.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.min("count.size").alias("least"))
        least = least.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("most"), F.min("least").alias("least"), F.count("*").alias("labels"))
        least = stored(least.filter("labels > 1").select("bucket", F.col("most.label").alias("most"), "least"))
        # By its counts, the node could be similar enough to a text as small as the bucket's smallest.
        able = F.col("count.shared") / (F.col("count.size") + F.greatest("least", "count.shared") - F.col("count.shared")) >= similar
        return stored(named.join(least, "bucket").filter(able).select("bucket", "node", "label", "count", "most"))

    # The rest of a bucket meets the most typical node of the commonest class, wherever that node is.
    open_ = apart(labels)
    centres = sizes.join(labels, "node").groupBy("label").agg(F.min(typical).alias("centre"))
    centres = cut(centres.select(F.col("label").alias("most"), F.col("centre.node").alias("y"), F.col("centre.count").alias("v")))
    minor = open_.filter("label != most").select(F.col("node").alias("x"), F.col("count").alias("u"), "most").distinct()
    central = verified(cut(minor).join(centres, "most").filter((F.col("x") != F.col("y")) & (_bound("u", "v") >= similar)))
    if not central.isEmpty():
        edges = cut(edges.unionByName(central))
        labels = components(edges)
        open_ = apart(labels)
    # Of what is still apart, two texts can be similar enough only if they have one of their rarest shingles in common.
    able = open_.groupBy("node").agg(F.first("label").alias("label"), F.first("count").alias("count"), F.max(F.col("label") != F.col("most")).alias("minor"))
    able = stored(able)
    if not able.isEmpty():
        rare = rarest(sets.join(few(able.select("node")), "node"), similar).join(able, "node")
        rare = stored(rare)
        one = rare.filter("minor").select("shingle", F.col("node").alias("x"), F.col("label").alias("x_label"), F.col("count").alias("u"), F.col("left").alias("x_left"), F.col("first").alias("x_first"))
        two = rare.select("shingle", F.col("node").alias("y"), F.col("label").alias("y_label"), F.col("count").alias("v"), F.col("left").alias("y_left"), F.col("first").alias("y_first"))
        # A pair meets at the first shingle that it has in common, once, and only if enough are left from there on.
        least = similar / (1 + similar) * (F.col("u.size") + F.col("v.size")) - 1e-6
        able_pair = (F.col("x_label") != F.col("y_label")) & (_bound("u", "v") >= similar) & (F.least("x_left", "y_left") >= least)
        once = F.get(F.array_intersect("x_first", "y_first"), F.lit(0)) == F.col("shingle")
        late = verified(one.join(two, "shingle").filter(able_pair & once))
        if not late.isEmpty():
            labels = components(edges.unionByName(late))
    labels = cut(labels)
    named = cut(labels.join(nodes.select(F.col("node").alias("label"), F.col("node_doc").alias("class_id")), "label").select("node", "label", "class_id"))
    found = nodes.select("_digest", "node", "node_doc").join(named, "node", "left")
    found = stored(found.select("_digest", F.coalesce("label", "node").alias("class_row"), F.when(F.col("label").isNull(), F.col("node_doc")).otherwise(F.col("class_id")).alias("class_id")))
    out = rows.select("_row", "doc_id", "_digest").join(found, "_digest", "left")
    return out.select("_row", "doc_id", F.coalesce("class_row", "_row").alias("class_row"), F.when(F.col("class_row").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def near_duplicates(documents: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row for each row of ``documents``: doc_id, class_id, kept.

    Texts with equal words are in one class, and so are texts linked by similarity. ``class_id``
    is the doc_id of the class's first row, which alone is ``kept``. Null and empty texts and
    texts without words are each a class of their own; a text of fewer than 5 words is one
    shingle; very long texts are compared whole. Repeated rows are one class; rows with equal or
    null doc_id stay apart, and the row read first comes first among them. An empty table gives
    no row; other columns are ignored, whatever their names.
    """
    out = classes(signed(documents.select("doc_id", "text")), similar)
    return out.select("doc_id", "class_id", (F.col("_row") == F.col("class_row")).alias("kept"))


def without_near_duplicates(documents: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``documents`` with one row of each class, as it is."""
    safe, restored = aliased(documents)
    rows = signed(safe)
    gone = cut(classes(rows, similar).filter("_row != class_row").select("_row"))
    return restored(rows.join(few(gone), "_row", "left_anti"))
