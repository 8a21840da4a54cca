"""N-gram Jaccard join that skips along relations between sets.

Sets of word shingles are compared without comparing all pairs:

* Equal sets are one node.
* The shingles of a node are put in one global order, rare ones first: shingles fall on a fixed number of counters,
  each task counts its own, and the counters are added up. Nodes that are similar enough share one of their first
  shingles (their prefix), so only prefixes are indexed, and a shingle of many nodes is only in the prefixes of
  those that have hardly any others. The index list of a
  shingle is sorted by set size and read in steps: a step ends, and the rest of the list is skipped, where
  the sizes or the positions in the prefixes already rule the link out. What is left is tested with bit
  maps, whose distance is never more than that of the sets.
* Index lists are counted. A long one is not read pair by pair; a node only meets the first node of its part
  of the list, so the pairs that are formed grow with the nodes and not with the square of a list.
* The nodes that met form clusters. A cluster is joined exactly in one task: the overlaps of a set with all
  others are derived from those of a highly similar set by adding and taking away the lists of the few
  shingles in which the two differ. Sets that are linked already, directly or over others, are not compared
  any more.
* The sets of a large cluster are compared with a few of its own first. Those that this links are one group;
  a group is not compared with itself, so of a large group of near copies only the few sets that were not
  linked meet all the others, part by part.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmill.llm.components import connected_components
from gridmill.llm.grouping import join_group_facts, keep_rows, likely_rows
from gridmill.llm.pretokens import text_slices
from gridmill.llm.scratch import Scratch
from gridmill.llm.words import mix, powers, split_words, window_hashes
from gridmill.llm.worker import lean

#: Shingles of a part of a cluster; a larger cluster is joined part by part.
PART = 1 << 20
#: How many of its own sets all sets of a large cluster are compared with first.
PIVOTS = 4
#: Counters on which the shingles fall, whatever the corpus; they set the order of shingles, which has no bearing on the result.
COUNTERS = 1 << 22
#: Counters that are stored and added up together.
BLOCK = 1 << 14
#: A longer index list is not read pair by pair.
LONG = 256


class Rule(NamedTuple):
    """Sets of ``size``-word shingles are linked if 100 * intersection >= percent * union."""

    size: int
    percent: int

    def overlap(self, x, y):
        """The smallest overlap that links sets of these sizes."""
        return -(-self.percent * (x + y) // (100 + self.percent))

    def prefix(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1


def shingle_sets(texts: pa.StringArray, size: int) -> list[np.ndarray]:
    """The sorted distinct 63-bit shingle hashes of each text; fewer words make one shingle together."""
    words = split_words(texts, lower=True)
    every = window_hashes(words.hash, size) >> np.uint64(1)
    stops = np.cumsum(words.counts)
    sets = []
    for stop, n in zip(stops.tolist(), words.counts.tolist()):
        if n >= size:
            own = np.sort(every[stop - n : stop - size + 1])
            new = np.empty(len(own), bool)
            new[0] = True
            np.not_equal(own[1:], own[:-1], out=new[1:])
            sets.append(own[new])
        elif n:
            whole = (words.hash[stop - n : stop] * powers(n)[0][:n]).sum(dtype=np.uint64) + np.uint64(n)
            sets.append(mix(np.array([whole], np.uint64)) >> np.uint64(1))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def signature(one: np.ndarray) -> tuple[int, int]:
    """Two sums of hashes that are equal for equal sets only."""
    a, b = mix(one).sum(dtype=np.uint64), mix(one ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def bit_map(one: np.ndarray) -> bytes:
    """The parity of how many shingles fall on each bit; the width is a power of two that follows the size."""
    width = 1 << max(8, int(2 * len(one) - 1).bit_length())
    bits = np.bincount((one & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def bit_distance(x: bytes, y: bytes) -> int:
    """A lower bound of the number of shingles in one set only; the wider map is folded."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def counters_of(shingles: np.ndarray) -> np.ndarray:
    """The counter on which each shingle falls."""
    return (shingles & np.uint64(COUNTERS - 1)).astype(np.int64)


PROFILES = "doc_id bigint, text_key bigint, n bigint, a bigint, b bigint, block int, counts binary"


def _profiles(size: int):
    """Per document its signature; per task the counters of the shingles of its sets, block by block."""
    kinds = [pa.int64()] * 5 + [pa.int32(), pa.binary()]

    def rows(*columns) -> pa.RecordBatch:
        names = [f.split()[0] for f in PROFILES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for part in text_slices(batch, 1_000_000):
                sets = shingle_sets(part.column("text"), size)
                np.add.at(total, counters_of(np.concatenate(sets)), np.uint32(1))
                a, b = zip(*[signature(s) for s in sets])
                none = [None] * len(sets)
                yield rows(part.column("doc_id"), part.column("text_key"), list(map(len, sets)), a, b, none, none)
        codec = pa.Codec("zstd")
        counted = total.reshape(-1, BLOCK)
        blocks = np.flatnonzero(counted.any(axis=1)).tolist()
        if blocks:
            counts = [codec.compress(counted[i].astype("<u4").tobytes(), asbytes=True) for i in blocks]
            none = [None] * len(blocks)
            yield rows(none, none, none, none, none, blocks, counts)

    return run


def _add_counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block the counters of all tasks together, as classes: eight to a doubling, 0 for no shingle."""
    codec = pa.Codec("zstd")
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
            own = np.frombuffer(codec.decompress(counts, 4 * BLOCK), "<u4")
            sums[block] = sums.get(block, np.int64(0)) + own
    if sums:
        classes = [_classes(x).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array(classes, pa.binary())], ["block", "classes"])


def _classes(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, np.minimum(1 + 8 * np.log2(np.maximum(counts, 1)), 255), 0).astype(np.uint8)


def _frequency(profiles: DataFrame) -> np.ndarray:
    """The class of each counter; ``COUNTERS`` bytes."""
    blocks = profiles.where("block is not null").select("block", "counts").repartition("block")
    blocks = blocks.mapInArrow(lean(_add_counters, "words"), "block int, classes binary").toArrow()
    classes = np.zeros((COUNTERS // BLOCK, BLOCK), np.uint8)
    for block, own in zip(blocks.column("block").to_pylist(), blocks.column("classes").to_pylist()):
        classes[block] = np.frombuffer(own, np.uint8)
    return classes.ravel()


def _prefixes(rule: Rule, frequency: np.ndarray):
    """Per document its signature, the prefix of its set in the global order and its bit map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1_000_000):
                found = []
                for one in shingle_sets(part.column("text"), rule.size):
                    if not len(one):
                        continue
                    # A set is in ascending order, so shingles of one class stay so.
                    order = np.argsort(frequency[counters_of(one)], kind="stable")
                    first = one[order[: rule.prefix(len(one))]]
                    found.append((*signature(one), len(one), first.astype(np.int64), bit_map(one)))
                if found:
                    a, b, n, first, bits = zip(*found)
                    ends = np.cumsum([0, *map(len, first)], dtype=np.int32)
                    arrays = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())]
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(first))))
                    arrays.append(pa.array(bits, pa.binary()))
                    yield pa.RecordBatch.from_arrays(arrays, ["a", "b", "n", "prefix", "bits"])

    return run


def _read_lists(rule: Rule):
    """Pairs of nodes from index lists that arrive sorted by shingle and set size."""

    def pairs(token: np.ndarray, n: np.ndarray, at: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        active = np.arange(len(token))
        step = 1
        while len(active):
            active = active[active + step < len(token)]
            other = active + step
            # Sizes ascend, so from the first set that is too large on, the rest of the list is skipped.
            near = (token[active] == token[other]) & (100 * n[active] >= rule.percent * n[other])
            active, other = active[near], other[near]
            best = 1 + np.minimum(n[active] - 1 - at[active], n[other] - 1 - at[other])
            fits = best >= rule.overlap(n[active], n[other])
            if fits.any():
                u, v = node[active[fits]], node[other[fits]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"]
                )
            step += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        names = ("token", "n", "at", "node")
        for batch in batches:
            own = [batch.column(name).to_numpy() for name in names]
            if held is not None:
                own = [np.concatenate(x) for x in zip(held, own)]
            if not len(own[0]):
                continue
            cut = int(np.searchsorted(own[0], own[0][-1]))  # the last list may go on in the next batch
            held = [x[cut:] for x in own]
            yield from pairs(*[x[:cut] for x in own])
        if held is not None:
            yield from pairs(*held)

    return run


def _bit_filter(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_u, n_v = batch.column("n_u").to_numpy(), batch.column("n_v").to_numpy()
            most = n_u + n_v - 2 * rule.overlap(n_u, n_v)
            bits = zip(batch.column("bits_u").to_pylist(), batch.column("bits_v").to_pylist())
            fits = np.array([bit_distance(x, y) for x, y in bits], np.int64) <= most
            yield batch.select(["u", "v"]).filter(pa.array(fits))

    return run


def join_cluster(sets: list[np.ndarray], rule: Rule, groups: list[int] | None = None) -> np.ndarray:
    """For each set the index of the first set that it is linked with, directly or over others.

    Sets of equal ``groups`` are known to be linked.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    label = np.arange(m)
    if groups is not None:
        _, first_of, group = np.unique(groups, return_index=True, return_inverse=True)
        label = first_of[group]
    owner = np.repeat(np.arange(m), sizes)
    tokens, of = np.unique(np.concatenate(sets), return_inverse=True)
    lists = np.bincount(of, minlength=len(tokens))
    shared = lists[of] > 1  # a shingle of one set only adds to no overlap
    of, owner = of[shared], owner[shared]
    members = owner[np.argsort(of, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(tokens)))])
    ends = np.searchsorted(owner, np.arange(m + 1))
    mine = [of[lo:hi] for lo, hi in zip(ends[:-1], ends[1:])]

    def count(own: np.ndarray) -> np.ndarray:
        """How many of the given shingles each set has."""
        if not len(own):
            return np.zeros(m, np.int64)
        size = first[own + 1] - first[own]
        stop = np.cumsum(size)
        at = np.arange(stop[-1]) + np.repeat(first[own] - (stop - size), size)
        return np.bincount(members[at], minlength=m)

    answers: list[tuple[int, np.ndarray]] = []
    for x in range(m):
        near = (100 * sizes >= rule.percent * sizes[x]) & (100 * sizes[x] >= rule.percent * sizes)
        if not (near & (label != label[x])).any():
            continue
        base = max(answers, key=lambda a: a[1][x], default=None)
        if base is not None and 2 * base[1][x] > len(mine[x]) and 2 * base[1][x] > len(mine[base[0]]):
            more = np.setdiff1d(mine[x], mine[base[0]], assume_unique=True)
            less = np.setdiff1d(mine[base[0]], mine[x], assume_unique=True)
            overlap = base[1] + count(more) - count(less)
        else:
            overlap = count(mine[x])
            answers = [*answers[-7:], (x, overlap)]
        linked = near & (100 * overlap >= rule.percent * (sizes + sizes[x] - overlap))
        linked[x] = True
        old = np.unique(label[linked])
        if len(old) > 1:
            label[np.isin(label, old)] = old[0]
    return label


def _join_clusters(rule: Rule):
    """Links from clusters that arrive sorted by cluster and part."""

    def links(nodes: list[int], groups: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        label = join_cluster(sets, rule, groups) if len(sets) > 1 else np.zeros(len(sets), int)
        return [(nodes[i], nodes[k]) for i, k in enumerate(label.tolist()) if i != k]

    def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
        u, v = zip(*found)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, groups, sets, found = None, [], [], [], []
        for batch in batches:
            flat, ends = _flat(batch.column("tokens"))
            rows = zip(*[batch.column(c).to_pylist() for c in ("pair", "node", "group")])
            for i, (own, node, group) in enumerate(rows):
                if own != key:
                    found += links(nodes, groups, sets)
                    key, nodes, groups, sets = own, [], [], []
                nodes.append(node)
                groups.append(group)
                sets.append(flat[ends[i] : ends[i + 1]].copy())
            if found:
                yield batch_of(found)
                found = []
        found = links(nodes, groups, sets)
        if found:
            yield batch_of(found)

    return run


def _flat(tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of a column of sets, and where each set starts in them."""
    lengths = tokens.value_lengths().to_numpy()
    return tokens.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(lengths)])


def _test_pivots(rule: Rule):
    """Links between sets and the pivots of their clusters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, at = _flat(batch.column("tokens"))
            pivot, pivot_at = _flat(batch.column("pivot_tokens"))
            x, y = np.diff(at), np.diff(pivot_at)
            both = np.array([
                len(np.intersect1d(own[at[i] : at[i + 1]], pivot[pivot_at[i] : pivot_at[i + 1]], assume_unique=True))
                for i in range(len(x))
            ], np.int64)
            linked = pa.array(100 * both >= rule.percent * (x + y - both))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("pivot")], ["u", "v"]).filter(linked)

    return run


def _wanted_sets(size: int):
    """The sets of the rows whose signature is the wanted one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1_000_000):
                sets = shingle_sets(part.column("text"), size)
                wanted = zip(part.column("a").to_pylist(), part.column("b").to_pylist())
                right = [i for i, (s, w) in enumerate(zip(sets, wanted)) if signature(s) == w]
                if right:
                    ends = np.cumsum([0, *(len(sets[i]) for i in right)], dtype=np.int32)
                    flat = np.concatenate([sets[i] for i in right]).astype(np.int64)
                    rows = part.select(["cluster", "parts", "node"]).take(pa.array(right))
                    tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([*rows.columns, tokens], [*rows.schema.names, "tokens"])

    return run


def jaccard_components(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    A-Z count as a-z; words are runs of characters other than space, tab, line feed, vertical tab, form feed
    and carriage return; a document's set are its distinct ``size``-word shingles, or all its words as one where
    they are fewer. Without words (null or empty text) the set is empty and linked with nothing. Two sets are
    linked if 100 * intersection >= ``percent`` * union. ``component_id`` is the smallest doc_id that can be
    reached over links, the own one included; rows without doc_id take part in links and name a component only
    where all its rows are without. Equal rows are linked as equal sets; other columns are ignored.
    """
    linked = _linked(docs, size, percent)
    own = F.when(F.isnull("facts"), F.col("doc_id")).otherwise(F.col("facts.component_id"))
    return linked.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def drop_near_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one of each component stays.

    The smallest doc_id stays (rows without one only where there is no other), of its rows that with the
    smallest text hash; rows without words stay all. Of rows that agree in doc_id and text one stays.
    """
    linked = _linked(docs, size, percent)
    first = F.col("facts.first_row")
    is_first = first["doc_id"].eqNullSafe(F.col("doc_id")) & (first["text_key"] == F.col("text_key"))
    kept = F.isnull("facts") | is_first
    again = F.row_number().over(Window.partitionBy("doc_id", "text_key").orderBy("n")) > 1
    verdicts = linked.select("doc_id", F.col("text_key").alias("raw"), (kept & ~(again & (F.col("n") > 0))).alias("kept"))
    return keep_rows(docs, verdicts)


def _linked(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Every document with its signature and, if it has words, the ``facts`` of its component."""
    rule = Rule(size, percent)
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("text_key", F.xxhash64("text"))
    profiles = scratch.store(texts.mapInArrow(lean(_profiles(size), "words"), PROFILES), "profiles")
    rows = profiles.where("n is not null").select("doc_id", "text_key", "n", "a", "b")
    prefixes = texts.mapInArrow(
        lean(_prefixes(rule, _frequency(profiles)), "words"),
        "a bigint, b bigint, n bigint, prefix array<bigint>, bits binary",
    )
    nodes = prefixes.groupBy("a", "b", "n").agg(F.any_value("prefix").alias("prefix"), F.any_value("bits").alias("bits"))
    nodes = scratch.store(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    met = _meetings(rule, nodes, scratch)
    clusters = connected_components(met, scratch, "clusters")
    # Deleted once they are read: what lies in the shared folder stays beside all later steps.
    for name in ("index", "long", "pairs", "common", "heads"):
        scratch.drop(name)
    links = scratch.store(_links(rule, texts, rows, nodes, clusters, scratch), "links")
    for name in ("wanted", "sets", "placed"):
        scratch.drop(name)
    found = connected_components(links, scratch, "components")
    classes = rows.where("n > 0").groupBy("a", "b").agg(
        F.min("doc_id").alias("first_id"),
        F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "text_key")).alias("first_row"),
        F.count(F.lit(1)).alias("size"),
    )
    named = (
        classes.join(nodes.select("a", "b", "node"), ["a", "b"])
        .join(found, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    named = scratch.store(named, "classes")
    scratch.drop("nodes")
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"), F.min("first_row").alias("first_row"))
    named = named.select("a", "b", "size", "component").join(smallest, "component").drop("component")
    return join_group_facts(rows, rows.count(), scratch.store(named, "named"), ["a", "b"], "size")


def _meetings(rule: Rule, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v): enough pairs of nodes that every link lies inside one of their connected components."""
    index = nodes.select("node", "n", F.posexplode("prefix").alias("at", "token"))
    index = scratch.store(index.select("token", "n", F.col("at").cast("bigint").alias("at"), "node"), "index")
    long = index.groupBy("token").agg(F.count(F.lit(1)).alias("length")).where(F.col("length") > LONG)
    long = scratch.store(long.select("token"), "long")
    rare = index.join(long, "token", "anti")
    read = (
        rare.repartition("token").sortWithinPartitions("token", "n")
        .mapInArrow(lean(_read_lists(rule), "words"), "u bigint, v bigint").distinct()
    )
    read = scratch.store(read, "pairs")
    facts = nodes.select("node", "n", "bits")
    tested = (
        read.join(facts.toDF("u", "n_u", "bits_u"), "u").join(facts.toDF("v", "n_v", "bits_v"), "v")
        .mapInArrow(lean(_bit_filter(rule), "words"), "u bigint, v bigint")
    )
    # Sizes that can be linked lie in one block or in neighbouring ones.
    block = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / rule.percent)) - 1e-9)
    common = scratch.store(index.join(long, "token", "semi").select("token", block.alias("block"), "node"), "common")
    heads = scratch.store(common.groupBy("token", "block").agg(F.min("node").alias("head")), "heads")
    own = common.join(heads, ["token", "block"]).select(F.col("node").alias("u"), F.col("head").alias("v"))
    beside = Window.partitionBy("token").orderBy("block")
    chain = heads.select(
        F.col("head").alias("u"), F.lag("head").over(beside).alias("v"),
        (F.col("block") - F.lag("block").over(beside)).alias("apart"),
    ).where("apart <= 2")
    return tested.unionByName(own).unionByName(chain.select("u", "v")).where("u <> v")


def _links(
    rule: Rule, texts: DataFrame, rows: DataFrame, nodes: DataFrame, clusters: DataFrame, scratch: Scratch
) -> DataFrame:
    """Links (u, v) that connect exactly the nodes that are linked inside each cluster."""
    sized = clusters.join(nodes.select("node", "n", "a", "b"), "node")
    totals = sized.groupBy("component").agg(F.ceil(F.sum("n") / PART).cast("int").alias("parts"))
    # The document to read a node's set from: any row of the class, with an id if there is one.
    row = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "text_key")
    source = rows.where("n > 0").groupBy("a", "b").agg(F.min(row).alias("row"))
    wanted = sized.join(totals, "component").join(source, ["a", "b"]).select(
        F.col("component").alias("cluster"), "parts", "node", "a", "b",
        F.col("row.doc_id").alias("wanted_id"), F.col("row.text_key").alias("wanted_key"),
    )
    wanted = scratch.store(wanted, "wanted")
    same = F.col("doc_id").eqNullSafe(F.col("wanted_id")) & (F.col("text_key") == F.col("wanted_key"))
    likely = likely_rows(texts, wanted.select(F.col("wanted_id").alias("doc_id"), F.col("wanted_key").alias("text_key")))
    sets = (
        likely.join(wanted, same)
        .select("text", "cluster", "parts", "node", "a", "b")
        .mapInArrow(lean(_wanted_sets(rule.size), "words"), "cluster bigint, parts int, node bigint, tokens array<bigint>")
    )
    sets = scratch.store(sets, "sets")
    small = sets.where("parts = 1").select(F.col("cluster").alias("pair"), "node", F.col("node").alias("group"), "tokens")
    large = sets.where("parts > 1")
    if large.isEmpty():
        return _compared(rule, small)
    by_pivots = _pivot_links(rule, large, scratch)
    return _compared(rule, small.unionByName(_pairs_of_parts(large, by_pivots, scratch))).unionByName(by_pivots)


def _compared(rule: Rule, pairs: DataFrame) -> DataFrame:
    in_pairs = pairs.repartition("pair").sortWithinPartitions("pair", "node")
    return in_pairs.mapInArrow(lean(_join_clusters(rule), "words"), "u bigint, v bigint")


def _pivot_links(rule: Rule, large: DataFrame, scratch: Scratch) -> DataFrame:
    """Links of the sets of large clusters with a few sets of their own, each new one not linked so far."""
    links = None
    for turn in range(PIVOTS):
        free = large.select("cluster", "node")
        if links is not None:
            free = free.join(links.select(F.col("u").alias("node")), "node", "anti")
        first = F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node"))["node"]
        chosen = free.groupBy("cluster").agg(first.alias("pivot"))
        tokens = large.select(F.col("node").alias("pivot"), F.col("tokens").alias("pivot_tokens"))
        pivots = scratch.store(chosen.join(tokens, "pivot"), f"pivots{turn}")
        tested = large.join(pivots, "cluster").select("node", "tokens", "pivot", "pivot_tokens")
        found = scratch.store(tested.mapInArrow(lean(_test_pivots(rule), "words"), "u bigint, v bigint"), f"pivot-links{turn}")
        links = found if links is None else links.unionByName(found)
    return links


def _pairs_of_parts(large: DataFrame, by_pivots: DataFrame, scratch: Scratch) -> DataFrame:
    """The sets of large clusters, once for each pair of parts in which they have to be compared."""
    known = connected_components(by_pivots, scratch, "groups").withColumnRenamed("component", "group")
    grouped = large.join(known, "node", "left").withColumn("group", F.coalesce("group", "node"))
    grouped = grouped.select("cluster", "group", "node", "tokens")
    sums = grouped.groupBy("cluster", "group").agg(F.sum(F.size("tokens")).alias("total"))
    sums = scratch.store(sums, "group-sums")
    # A group that fills a part has parts of its own; all other sets of the cluster share theirs.
    homes = sums.where(F.col("total") > PART).select("cluster", "group", F.col("group").alias("home"), F.ceil(F.col("total") / PART).alias("k"))
    rest = sums.where(F.col("total") <= PART).groupBy("cluster").agg(F.ceil(F.sum("total") / PART).alias("rest_k"))
    placed = grouped.join(homes, ["cluster", "group"], "left").join(rest, "cluster", "left")
    number = F.pmod(F.xxhash64("node"), F.coalesce("k", "rest_k"))
    placed = placed.withColumn("part", F.xxhash64("cluster", F.coalesce("home", F.lit(-1)), number))
    placed = scratch.store(placed.select("cluster", "home", "part", "node", "group", "tokens"), "placed")
    parts = placed.select("cluster", "home", "part").distinct()
    other = parts.toDF("cluster", "other_home", "other")
    met = parts.join(other, "cluster").where("part <= other and (home is null or not home <=> other_home)")
    met = met.select("part", "other", F.xxhash64("part", "other").alias("pair"))
    both = met.select("part", "pair").unionByName(met.select(F.col("other").alias("part"), "pair")).distinct()
    return placed.join(both, "part").select("pair", "node", "group", "tokens")
