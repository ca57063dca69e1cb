"""Groups near-duplicate documents by the shingles they share.

Method: a MinHash LSH forest. The signatures are sorted in several orders, each of which starts at other hashes. Neighbours in an order whose longest common
prefix is at least DEPTH are candidates; as the order puts those with the longest prefixes side by side, dense regions are linked at great depths
and sparse ones at DEPTH. Likely neighbours are confirmed on the full sets, those of the first orders first, and join into components. Then
nothing may be left out: a region is all documents with DEPTH hashes in common at the start of an order, of any size, and every likely pair in it whose
ends are in different components is compared on the full sets, in tasks of two blocks, until all components that a link joins are one.
Equal sets are one class from the start, so copies are never paired.

Two documents at a threshold of 0.85 share a region in none of the orders with a chance of about 1e-5 (at 0.8, 2e-4), less above it. The work in a region
grows with the square of the documents that no link joins to its largest component. A pair is likely if its estimate is not below the threshold by more than SLACK.

Defined results: null text, empty text and text without words have the empty set and stay alone; rows without an id have no component and are not kept;
rows that repeat an id are one node; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

HASHES = 64
ORDERS = 12
DEPTH = 3
#: Hashes by which an order is sorted.
SORTED = 16
#: Neighbours of the first orders are confirmed before those of the others, of which most are then in one component already.
FIRST = 3
#: Below the threshold by so much, an estimate from HASHES hashes is off by over four deviations.
SLACK = 0.2
#: Documents, and shingles of documents, in a block of the second pass; a task holds two blocks.
BLOCK = 256
BLOCK_SHINGLES = 1 << 19
COLUMNS = 4096
#: Words of which a task remembers the hash.
CACHE = 300_000
BASE = "doc_id long, n long, k1 long, k2 long, sig array<int>"

_RNG = np.random.default_rng(7)
_A = _RNG.integers(1, 2**32, HASHES, np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 2**32, HASHES, np.uint32)
_FACTORS = _RNG.integers(1, 2**63, 16, np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles; bytes.lower and bytes.split treat just A-Z and the six blanks."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(width, len(h))
    total = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        total += h[k : len(h) - n + 1 + k] * _FACTORS[k]
    return np.unique(mixed(total + np.uint64(n)))


def signature(s: np.ndarray) -> np.ndarray:
    low = (s >> np.uint64(16)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 4096):
        np.minimum(out, (low[at : at + 4096, None] * _A + _B).min(0), out=out)
    return out.view(np.int32)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n, keys, sigs = [], [], []
            for text in batch["text"]:
                s = shingles(text.as_py(), width, hashes)
                n.append(len(s))
                keys.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64))
                sigs.append(signature(s) if len(s) else None)
            k = np.array(keys, np.int64).reshape(-1, 2)
            yield pa.record_batch([batch["doc_id"], pa.array(n, pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(sigs, pa.list_(pa.int32()))], names=["doc_id", "n", "k1", "k2", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, BASE)


def sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [shingles(t.as_py(), width, hashes).view(np.int64) for t in batch["text"]]
            yield pa.record_batch([batch["doc_id"], pa.array(found, pa.list_(pa.int64()))], names=["id", "s"])

    return docs.mapInArrow(run, "id long, s array<long>")


def keyed(nodes: DataFrame) -> DataFrame:
    """id, n, tree, key: a row for each order, keyed by the first DEPTH hashes in that order."""
    twice = nodes.select("id", "n", F.concat("sig", "sig").alias("sig"))
    of = lambda t: F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), F.slice("sig", t * DEPTH + 1, DEPTH)).alias("key"))
    return twice.select("id", "n", F.inline(F.array(*map(of, range(ORDERS)))))


def neighbours(nodes: DataFrame) -> DataFrame:
    """a, b, tree: neighbours in the sorted orders with a common prefix of DEPTH hashes at least, each pair once, under its first order.

    Ranges are cut between any two rows, so a dense region is spread over tasks; the two rows beside a cut don't meet here.
    """

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = batch["sig"].flatten().to_numpy().reshape(-1, HASHES).view(np.uint32).astype(">u4")
            twice = np.concatenate([sig, sig], 1)
            for t in range(ORDERS):
                key = np.ascontiguousarray(twice[:, t * DEPTH : t * DEPTH + SORTED]).tobytes()
                keys = pa.Array.from_buffers(pa.binary(4 * SORTED), len(sig), [None, pa.py_buffer(key)]).cast(pa.binary())
                yield pa.record_batch([batch["id"], pa.array(np.full(len(sig), t, np.int32)), keys], names=["id", "tree", "key"])

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, tree = batch["id"].to_numpy(), batch["tree"].to_numpy()
            key = np.frombuffer(b"".join(batch["key"].to_pylist()), np.uint32).reshape(-1, SORTED)
            if last is not None:
                ids, tree, key = (np.concatenate([x, y]) for x, y in zip(last, (ids, tree, key), strict=True))
            near = (tree[1:] == tree[:-1]) & (key[1:, :DEPTH] == key[:-1, :DEPTH]).all(1)
            a, b = ids[:-1][near], ids[1:][near]
            yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(tree[1:][near])], names=["a", "b", "tree"])
            last = ids[-1:], tree[-1:], key[-1:]

    count = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    orders = common.save(nodes.select("id", "sig").mapInArrow(turn, "id long, tree int, key binary"))
    orders = orders.repartitionByRange(count, "tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    return orders.mapInArrow(beside, "a long, b long, tree int").groupBy("a", "b").agg(F.min("tree").alias("tree"))


def likely_pairs(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose estimate and sizes allow a link."""
    side = lambda name: nodes.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.col("sig").alias(f"sig_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    same = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return both.filter((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (same >= (percent / 100 - SLACK) * HASHES)).select("a", "b", "tree")


def confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are alike enough."""
    side = lambda name: full.select(F.col("id").alias(name), F.col("s").alias(f"s_{name}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    shared = both.select("a", "b", F.size(F.array_intersect("s_a", "s_b")).alias("i"), (F.size("s_a") + F.size("s_b")).alias("n"))
    return shared.filter(100 * F.col("i") >= percent * (F.col("n") - F.col("i"))).select("a", "b")


def of_groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[list[tuple]]:
    """The rows of each group as tuples of Arrow scalars' values, without the key; the rows of a group lie together."""
    held, rows = None, []
    for batch in batches:
        keys = zip(*(batch[k].to_pylist() for k in key), strict=True)
        own = [c.to_numpy(zero_copy_only=False) for name, c in zip(batch.schema.names, batch.columns, strict=True) if name not in key]
        for k, *row in zip(keys, *own, strict=True):
            if k != held:
                if rows:
                    yield rows
                held, rows = k, []
            rows.append(tuple(row))
    if rows:
        yield rows


def blocks(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """tree, key, x, y, id, component, n, sig: the regions that hold several components, their members dealt into pairs of blocks.

    Every two members of different components are in one pair of blocks: the largest component's blocks meet all blocks of the others, and
    those meet each other.
    """
    rows = keyed(nodes).join(labels, "id")
    by = rows.groupBy("tree", "key", "component").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    top = by.groupBy("tree", "key").agg(F.sum("c").alias("c"), F.sum("n").alias("n"), F.max(F.struct("c", "n", "component")).alias("most"), F.count("*").alias("kinds"))
    top = top.filter(F.col("kinds") > 1)
    parts = lambda c, n: F.ceil(F.greatest(c / BLOCK, n / BLOCK_SHINGLES)).cast("int")
    one = (F.col("c") <= BLOCK) & (F.col("n") <= BLOCK_SHINGLES)
    others = F.when(one, 1).otherwise(parts(F.col("c") - F.col("most.c"), F.col("n") - F.col("most.n")))
    top = common.save(top.select("tree", "key", others.alias("o"), F.when(one, 0).otherwise(parts(F.col("most.c"), F.col("most.n"))).alias("l"), F.col("most.component").alias("most")))
    own = rows.join(common.small(top), ["tree", "key"])
    x = F.when((F.col("l") > 0) & (F.col("component") == F.col("most")), F.col("o") + F.expr("pmod(xxhash64(id), l)")).otherwise(F.expr("pmod(xxhash64(id), o)"))
    own = own.withColumn("x", x.cast("int")).join(nodes.select("id", "sig"), "id")
    met = F.explode(F.expr("case when o + l = 1 then array(0) when x < o then array_remove(sequence(0, o + l - 1), x) else sequence(0, o - 1) end"))
    return own.withColumn("y", met).select("tree", "key", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "id", "component", "n", "sig")


def likely(n: np.ndarray, component: np.ndarray, sig: np.ndarray, percent: int) -> np.ndarray:
    """Which of a group's documents have a likely partner in another component."""
    out = np.zeros(len(n), bool)
    sig = sig.astype(np.int8)  # eight bits of each hash: no estimate gets lower
    for at in range(0, len(n), 64):
        own = slice(at, at + 64)
        same = (sig[own, None, :] == sig[None, :, :]).view(np.uint64)
        e = np.bitwise_count(same).sum(-1, dtype=np.int64) / HASHES
        small, large = np.minimum(n[own, None], n[None, :]), np.maximum(n[own, None], n[None, :])
        out[own] = ((e >= percent / 100 - SLACK) & (100 * small >= percent * large) & (component[own, None] != component[None, :])).any(1)
    return out


def linked(ids: list[int], component: list[int], found: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links on full sets that connect all of a group's components that any link connects."""
    g, sizes = len(ids), np.array([len(s) for s in found])
    _, at, counts = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    often = counts > 1
    keep = often[at]
    who, column = np.repeat(np.arange(g), sizes)[keep], (np.cumsum(often) - 1)[at[keep]]
    order = np.argsort(column, kind="stable")
    who, column = who[order], column[order]
    both = np.zeros((g, g))
    for start in range(0, int(often.sum()), COLUMNS):
        a, b = np.searchsorted(column, (start, start + COLUMNS))
        m = np.zeros((g, min(COLUMNS, int(often.sum()) - start)), np.float32)
        m[who[a:b], column[a:b] - start] = 1
        both += m @ m.T
    i, j = np.nonzero(np.triu(100 * both >= percent * (sizes[:, None] + sizes[None, :] - both), 1))
    root = {c: c for c in component}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        a, b = find(component[x]), find(component[y])
        if a != b:
            root[a] = b
            out.append((int(ids[x]), int(ids[y])))
    return out


def full_sets(docs: DataFrame, ids: DataFrame, known: DataFrame | None, width: int) -> DataFrame:
    """id, s: the full sets of the documents named by ids (doc_id), beside those known."""
    ids = common.save(ids.distinct() if known is None else ids.distinct().join(known.select(F.col("id").alias("doc_id")), "doc_id", "left_anti"))
    if known is not None and not ids.take(1):
        return known
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(common.small(ids), "doc_id", "left_semi")
    more = common.save(sets(texts, width))
    return more if known is None else known.unionByName(more)


def bridges(docs: DataFrame, nodes: DataFrame, labels: DataFrame, full: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b: the links between the components found so far, from all likely pairs of each region."""
    key = ["tree", "key", "x", "y"]
    count = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in of_groups(batches, key):
            ids, component, n, sig = (np.array(x) for x in zip(*rows, strict=True))
            chosen = likely(n, component, np.stack(sig) if sig.ndim == 1 else sig, percent)
            if chosen.any():
                # Named by its members, so that the same group from several orders is confirmed once.
                named = sorted(zip(ids[chosen].tolist(), component[chosen].tolist(), strict=True))
                ids, component = zip(*named, strict=True)
                g = xxhash.xxh3_64_intdigest(np.array(ids, np.int64).tobytes()) >> 1
                yield pa.record_batch([pa.array([g] * len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array(component, pa.int64())], names=["g", "id", "component"])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in of_groups(batches, ["g"]):
            out = linked(*map(list, zip(*rows, strict=True)), percent)
            if out:
                a, b = zip(*out, strict=True)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    chosen = blocks(nodes, labels).repartition(count, *key).sortWithinPartitions(*key).mapInArrow(choose, "g long, id long, component long")
    chosen = common.save(chosen.distinct())
    full = full_sets(docs, chosen.select(F.col("id").alias("doc_id")), full, width)
    return chosen.join(full, "id").select("g", "id", "component", "s").repartition(count, "g").sortWithinPartitions("g").mapInArrow(confirm, "a long, b long")


def labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, component of every node; links must be saved."""
    return common.save(nodes.select("id").distinct().join(components(links), "id", "left").select("id", F.coalesce("component", "id").alias("component")))


def links(docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """a, b: confirmed neighbours; the nodes' components by them; id, s: the full sets of the documents that were compared for them."""
    pairs = common.save(likely_pairs(common.save(neighbours(nodes)), nodes, percent))
    ends = lambda x: x.select(F.col("a").alias("doc_id")).unionByName(x.select(F.col("b").alias("doc_id")))
    first = pairs.filter(F.col("tree") < FIRST)
    full = full_sets(docs, ends(first), None, width)
    sure = common.save(confirmed(first, full, percent))
    at = labelled(nodes, sure)
    end = lambda name: at.select(F.col("id").alias(name), F.col("component").alias(f"c_{name}"))
    rest = common.save(pairs.filter(F.col("tree") >= FIRST).join(end("a"), "a").join(end("b"), "b").filter("c_a <> c_b").select("a", "b"))
    full = full_sets(docs, ends(rest), full, width)
    sure = common.save(sure.unionByName(confirmed(rest, full, percent)))
    return sure, labelled(nodes, sure), full


def groups(docs: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    base = common.save(signatures(docs, width))
    some = base.filter("n > 0 and doc_id is not null")
    classes = common.save(some.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "n", "sig")).alias("r")).select("k1", "k2", F.col("r.doc_id").alias("id"), F.col("r.n").alias("n"), F.col("r.sig").alias("sig")))
    nodes = classes.select("id", "n", "sig")
    sure, labels, full = links(docs, nodes, width, percent)
    more = common.save(bridges(docs, nodes, labels, full, width, percent))
    found = labels if not more.take(1) else labelled(nodes, common.save(sure.unionByName(more)))
    named = common.save(classes.select("k1", "k2", "id").join(found, "id", "left").select("k1", "k2", F.coalesce("component", "id").alias("component")))
    out = base.select("doc_id", "n", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay, one of each group, unchanged; rows without an id stay; rows that share an id are told apart by their texts."""
    ids = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id", F.lit(True).alias("_again"))
    again = common.save(ids)
    own = docs.select(*common.DOCUMENT)
    if not again.count():
        return own.join(_gone(own, width, percent), "doc_id", "left_anti")
    # Other ids are below these, so of a group a row with an id of its own stays first.
    node = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    own = own.join(common.small(again), "doc_id", "left").withColumn("_node", F.when(F.col("_again"), node).otherwise(F.col("doc_id").cast("long")))
    gone = _gone(own.select(F.col("_node").alias("doc_id"), "text"), width, percent)
    out = own.join(gone.withColumnRenamed("doc_id", "_node"), "_node", "left_anti")
    once = out.filter("_again").dropDuplicates(["_node"])
    return out.filter("_again is null").unionByName(once).select(*common.DOCUMENT)


def _gone(docs: DataFrame, width: int, percent: int) -> DataFrame:
    found = groups(docs, width, percent)
    return common.small(common.save(found.filter("not kept and doc_id is not null").select("doc_id").distinct()))
