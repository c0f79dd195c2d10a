"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints: a bit is set where over half of the 64-bit shingle hashes have it.

Links (Hamming distance <= bits): distinct fingerprints enter the index under upper nodes,
each a masked bit pattern that its members share. The top level has bits + 1 masks that
divide the 64 bits, so two linked fingerprints share the pattern of at least one mask
(at most `bits` masks can hold a difference). A node of more than NODE members gets
children in the same way over its remaining bits, until every node is small: the exact
way for any hot pattern. Inside a node codes are sorted by Gray rank; runs of
LEAF neighbours form groups with the mask and pattern of the bits that all of them
share, and runs of groups form larger ones; a pair of groups is dropped as soon as
the differences accumulated on their common masks exceed `bits`, and only the rest is
compared code by code. A node gives the forest of its links, not its pairs.

Near copies (near_copies) take candidates from the same index: a node is a group of fingerprints, here of the set of shingles,
that links at `bits` bits join. As texts of similarity 0.8 may differ in more bits than an index of 64 can search, further nodes add what the
fingerprints miss: the values of BANDS bands of ROWS minima over shingles, each by a permutation of its own. First every text of a node is compared with one of them,
the node's hub. In nodes whose texts are not all joined by that, sketches mark the texts that may have a partner in
another part; only those get their whole sets of shingles, and the node decides every pair of parts by them, exactly.
What leaves a node is marks, then the forest of its links, never its pairs. A node of more than NODE texts, or WEIGHT shingles,
is compared as pairs of blocks, so no pair is left out at any size.

Components: alternating large-star and small-star rounds on the forests; each
round's edges are written to the shared folder. Nothing of document size reaches the driver.

Defined results: null and empty texts and texts of white space have fingerprint 0 (in near_copies: no shingles), linked
like any other; a text of fewer words than a shingle is one shingle; equal rows are one
group; a null id is ignored when the smallest id of a group is taken, but its row links others; an id that repeats names each of its rows; texts of any length count whole; other columns
pass by, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, remove, small, small_batches, text_key, written

NODE, LEAF, FAN = 4096, 16, 16
#: Pairs compared at a time; bands of an index of minima and minima of a band: texts of similarity s share a band with 1 - (1 - s^ROWS)^BANDS.
PAIRS, BANDS, ROWS = 16_384, 24, 4
BINS = BANDS * ROWS
#: Shingles that the blocks of a divided node hold on average at most.
WEIGHT = 2_000_000
_MOVE = np.random.default_rng(42).integers(0, 2**64, (2, BINS), np.uint64) | np.array([[1], [0]], np.uint64)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOW = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint_of(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint of one whole text."""
    tokens = _WORD.findall((text or "").encode().translate(_LOW))
    if not tokens:
        return 0
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), seed)
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[: -words] + 1]).tolist()
    stops = ends[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, stops)), np.uint64, len(stops))
    return voted(h)


def voted(h: np.ndarray) -> int:
    """The bits that over half of the hashes have; 0 of none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):  # bounded memory for any length
        ones += np.unpackbits(h[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def shingles_of(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles of one whole text; a text of fewer words is one shingle."""
    tokens = _WORD.findall((text or "").encode().translate(_LOW))
    if not tokens:
        return np.empty(0, np.uint64)
    line, k = b" ".join(tokens), min(words, len(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-k] + 1])
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b], 42) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist())), np.uint64, len(starts)))


def minima_of(shingles: np.ndarray) -> np.ndarray:
    """The smallest hash under each of BINS permutations; zeros where there is no shingle."""
    out = np.full(BINS, 2**64 - 1 if len(shingles) else 0, np.uint64)
    for at in range(0, len(shingles), 4096):  # bounded memory for any length
        out = np.minimum(out, (shingles[at : at + 4096, None] * _MOVE[0] + _MOVE[1]).min(axis=0))
    return out


def _code(shingles: np.ndarray) -> int:
    return _signed(xxhash.xxh3_64_intdigest(shingles.tobytes(), 42))


def _bytes_of(minima: np.ndarray) -> bytes:
    # Bits that do not depend on a minimum's being small.
    return np.where(minima == 0, 0, (minima * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(255) + np.uint64(1)).astype(np.uint8).tobytes()


def sketch_of(text: str | None, words: int = 5) -> bytes:
    """A byte from 1 for each minimum; 0 where there is none."""
    return _bytes_of(minima_of(shingles_of(text, words)))


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of rows of sketches: equal bins over bins that either has."""
    either = ((a != 0) | (b != 0)).sum(axis=1)
    return np.where(either == 0, 1.0, ((a == b) & (a != 0)).sum(axis=1) / np.maximum(either, 1))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets, as sorted distinct rows; 1 of two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42, text: str = "text", to: str = "fp") -> DataFrame:
    """docs with the fingerprint as a signed long in column `to`."""

    @F.pandas_udf("long")
    def fp(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(np.array([fingerprint_of(t, words, seed) for t in part], np.uint64).view(np.int64))

    return docs.withColumn(to, fp(F.col(text)))


def gray_rank(code: Column) -> Column:
    """Position of a code in Gray order: the running exclusive-or from the highest bit."""
    for s in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, s))
    return code


def _top_masks(n: int) -> list[int]:
    """All 64 bits, divided into n masks of near-equal size."""
    cuts = [64 * k // n for k in range(n + 1)]
    return [sum(1 << b for b in range(x, y)) for x, y in zip(cuts, cuts[1:])]


def _blocks(mask: Column, n: int) -> Column:
    """The set bits of a mask column, divided into n masks of near-equal size."""
    at = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(mask, b) == 1)
    one = F.lit(1).cast("long")

    def block(k: Column) -> Column:
        lo, hi = F.floor(F.size(at) * k / n).cast("int"), F.floor(F.size(at) * (k + 1) / n).cast("int")
        return F.aggregate(F.slice(at, lo + 1, hi - lo), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(F.call_function("shiftleft", one, b)))

    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), block), lambda m: m != 0)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _firsts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))


def _groups(node: np.ndarray, size: int) -> np.ndarray:
    """Starts of runs of at most `size` rows within each node (rows are sorted by node)."""
    first = _firsts(node)
    length = np.diff(np.append(first, len(node)))
    within = np.arange(len(node)) - np.repeat(first, length)
    return np.flatnonzero(within % size == 0)


def _pairs_within(node: np.ndarray, both: np.ndarray, ones: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs a <= b of groups of one node, whose differences on the bits that each group shares are at most `bits`."""
    mask = ~(both ^ ones)
    n, left, right = len(node), [np.arange(len(node))], [np.arange(len(node))]
    last = np.append(_firsts(node)[1:], n)
    stop = np.repeat(last, np.diff(np.append(_firsts(node), n)))
    step, live = 1, np.arange(n)
    while len(live := live[live + step < stop[live]]):
        other = live + step
        near = _popcount((both[live] ^ both[other]) & mask[live] & mask[other]) <= bits
        left.append(live[near])
        right.append(other[near])
        step += 1
    return np.concatenate(left), np.concatenate(right)


def _children(a: np.ndarray, b: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs x of a's rows and y of b's rows with x <= y (x < y inside one group is left to the caller)."""
    na, nb = stop[a] - start[a], stop[b] - start[b]
    total = na * nb
    which = np.repeat(np.arange(len(a)), total)
    off = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    x, y = start[a][which] + off // nb[which], start[b][which] + off % nb[which]
    ok = x <= y
    return x[ok], y[ok]


def linked(node: np.ndarray, code: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of linked codes; rows are sorted by node, then by Gray rank. Chunks bound the memory."""
    leaf = _groups(node, LEAF)
    leaf_stop = np.append(leaf[1:], len(node))
    low, any1 = np.bitwise_and.reduceat(code, leaf), np.bitwise_or.reduceat(code, leaf)
    top = _groups(node[leaf], FAN)
    top_stop = np.append(top[1:], len(leaf))
    a, b = _pairs_within(node[leaf][top], np.bitwise_and.reduceat(low, top), np.bitwise_or.reduceat(any1, top), bits)
    mask = ~(low ^ any1)
    for at in range(0, len(a), 2048):
        x, y = _children(a[at : at + 2048], b[at : at + 2048], top, top_stop)
        near = _popcount((low[x] ^ low[y]) & mask[x] & mask[y]) <= bits
        x, y = x[near], y[near]
        for k in range(0, len(x), 4096):
            i, j = _children(x[k : k + 4096], y[k : k + 4096], leaf, leaf_stop)
            close = (i < j) & (_popcount(code[i] ^ code[j]) <= bits)
            yield i[close], j[close]


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index linked with each index."""
    root = np.arange(n)
    for i_all, j_all in pairs:
        for at in range(0, len(i_all), PAIRS):
            i, j = i_all[at : at + PAIRS], j_all[at : at + PAIRS]
            while len(i):
                ri, rj = root[i], root[j]
                differ = ri != rj
                i, j, ri, rj = i[differ], j[differ], ri[differ], rj[differ]
                np.minimum.at(root, np.maximum(ri, rj), np.minimum(ri, rj))
                while not np.array_equal(up := root[root], root):
                    root = up
    return root


def _by_node(of, names: tuple[str, ...], out: list[str]):
    """of(columns of whole nodes) for batches sorted by node: the last node waits for the next batch."""

    def rows_of(column: pa.Array, name: str) -> np.ndarray:
        if name == "sketch":
            return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)
        return column.to_numpy(zero_copy_only=name != "shingles")

    empty = {"sketch": np.empty((0, BINS), np.uint8), "shingles": np.empty(0, object)}

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = tuple(empty.get(n, np.empty(0, np.int64)) for n in names)
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [np.concatenate([r, rows_of(batch.column(n), n)]) for r, n in zip(rest, names)]
            cut = _firsts(now[0])[-1]
            for x, y in of(*(c[:cut] for c in now)):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], out)
            rest = tuple(c[cut:] for c in now)
        for x, y in of(*rest):
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], out)

    return results


def _node_edges(bits: int):
    """Edges (u, v) of the forests of whole nodes."""

    def of(node, code, rep):
        if len(node) < 2:
            return
        root = forest(len(node), linked(node, code.view(np.uint64), bits))
        at = np.flatnonzero(root != np.arange(len(node)))
        at = at[rep[at] != rep[root[at]]]
        if len(at):
            x, y = rep[at], rep[root[at]]
            yield np.maximum(x, y), np.minimum(x, y)

    return _by_node(of, ("node", "fp", "rep"), ["u", "v"])


def links(codes: DataFrame, bits: int = 4) -> DataFrame:
    """Edges (u, v), u > v, whose components are those of all links. codes: fp (distinct), rep (its name, a long)."""
    level = codes.select("fp", "rep", F.lit(0).cast("long").alias("up"), F.lit(-1).cast("long").alias("free"))
    out = []
    while True:
        # Children: one row for each mask that divides what is still free of the node above.
        masks = _blocks(F.col("free"), bits + 1) if out else F.array(*[F.lit(_signed(m)) for m in _top_masks(bits + 1)])
        rows = level.select("fp", "rep", "up", "free", F.explode(masks).alias("mask"))
        rows = rows.select("fp", "rep", F.xxhash64("up", "mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("node"), F.col("free").bitwiseAND(F.bitwise_not("mask")).alias("free"))
        if out:
            rows = written(rows, "node-rows")  # read three times below
        # More than NODE distinct codes under one node differ in more than log2(NODE) free bits, so the descent ends.
        hot = written(rows.where("free <> 0").groupBy("node").count().where(F.col("count") > NODE).select("node"), "hot-nodes")
        more = not hot.isEmpty()
        cold = rows.join(hot, "node", "left_anti") if more else rows
        sorted_rows = cold.select("node", "fp", "rep").repartition("node").sortWithinPartitions("node", gray_rank(F.col("fp")))
        out.append(sorted_rows.mapInArrow(_node_edges(bits), "u long, v long"))
        if not more:
            break
        level = written(rows.join(hot, "node", "left_semi").select("fp", "rep", F.col("node").alias("up"), "free"), "hot-rows")
    edges = out[0]
    for e in out[1:]:
        edges = edges.union(e)
    return edges.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that an edge (u, v), u > v, touches."""
    edges = written(edges, "edges")
    while True:
        # Large star: neighbours above u move to the smallest of u and its neighbours.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        # Small star: of a node's lower neighbours, the rest and the node move to the smallest.
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        moved = large.join(low.where("n > 1").select("u", "m"), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(low.select("u", F.col("m").alias("v")).union(moved).distinct(), "small-star")
        remove(edges)
        remove(large)
        edges = after
        # Ended: each node has one edge, and no root is itself below another.
        roots = edges.select(F.col("v").alias("u")).distinct()
        if moved_none(edges, roots):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def moved_none(edges: DataFrame, roots: DataFrame) -> bool:
    return edges.join(roots, "u", "left_semi").isEmpty() and edges.groupBy("u").count().where("count > 1").isEmpty()


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = 4, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, fp (signed long), component_id (the smallest id reachable, null where no row of the group has one)."""
    return grouped(written(fingerprints(docs.select(doc_id, text), words, seed, text).select(doc_id, "fp"), "fingerprints"), bits, doc_id)


def grouped(fps: DataFrame, bits: int = 4, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp) with component_id. The graph's nodes are fingerprints, so rows without an id carry links as others do, and
    rows that share only an id are not linked by it. fps is read twice."""
    codes = written(fps.groupBy("fp").agg(F.min(doc_id).alias("first")), "codes")
    below = components(links(codes.select("fp", F.col("fp").alias("rep")), bits))
    groups = written(below.union(below.select("root", "root")).distinct(), "groups")
    # Only codes that a link touches have a group; the rest stand for themselves.
    heads = codes.join(groups, codes["fp"] == groups["node"]).groupBy("root").agg(F.min("first").alias("head"))
    of = groups.join(heads, "root").select(F.col("node").alias("fp"), "head")
    # A group's head is null only where all its ids are, and then so is the code's own.
    named = codes.join(of, "fp", "left").select("fp", F.coalesce("head", "first").alias("component_id"))
    return fps.join(named, "fp").select(doc_id, "fp", "component_id")


def _runs(node: np.ndarray) -> Iterator[tuple[int, int]]:
    first = _firsts(node) if len(node) else []
    return zip(first, np.append(first, len(node))[1:])


def _open_texts(least: float):
    """Marks (node, code) of texts with a partner in another part whose sketch agrees so far.
    Of a pair of blocks (other = 1) only pairs from both count."""

    def of(node, part, code, block, other, sketch):
        for lo, hi in _runs(node):
            p, k, o, s = (x[lo:hi] for x in (part, block, other, sketch))  # sorted by part
            has = np.zeros(hi - lo, bool)
            for i, at in enumerate(np.searchsorted(p, p, "right")):
                if at < len(p):
                    j = at + np.flatnonzero((s[at:] == s[i]).sum(axis=1) >= least * BINS)
                    j = j[(k[j] != k[i]) | (o[j] == 0)]
                    has[j] = True
                    has[i] |= len(j) > 0
            if has.any():
                yield node[lo:hi][has], code[lo:hi][has]

    return _by_node(of, ("node", "part", "code", "block", "other", "sketch"), ["node", "code"])


def _exact_links(least: float):
    """Edges (u, v) of the forests of whole nodes: pairs of different parts, and of both blocks, of similarity `least` or more."""

    def of(node, part, code, block, other, shingles):
        for lo, hi in _runs(node):
            p, c, k, o = (x[lo:hi] for x in (part, code, block, other))  # sorted by part
            sets = [np.frombuffer(x, np.uint64) for x in shingles[lo:hi]]
            size = np.array([len(x) for x in sets])
            # An empty set stands for one shingle of its own, so runs have a start each and two empty sets are equal.
            flat = np.unique(np.concatenate([x if len(x) else np.zeros(1, np.uint64) for x in sets]), return_inverse=True)[1]
            held = np.maximum(size, 1)
            start = np.concatenate([[0], np.cumsum(held)])

            def found():
                mark = np.zeros(flat.max() + 1, np.int64)
                for i, at in enumerate(np.searchsorted(p, p, "right")):
                    if at < len(p):
                        own = flat[start[i] : start[i + 1]]
                        mark[own] = 1
                        both = np.add.reduceat(mark[flat[start[at] :]], start[at:-1] - start[at])
                        mark[own] = 0
                        j = at + np.flatnonzero(both / (held[i] + held[at:] - both) >= least)
                        j = j[((k[j] != k[i]) | (o[j] == 0)) & ((size[j] == 0) == (size[i] == 0))]
                        yield np.full(len(j), i), j

            root = forest(len(p), found())
            at = np.flatnonzero(root != np.arange(len(p)))
            if len(at):
                x, y = c[at], c[root[at]]
                yield np.maximum(x, y), np.minimum(x, y)

    return _by_node(of, ("node", "part", "code", "block", "other", "shingles"), ["u", "v"])


def near_nodes(codes: DataFrame, bits: int = 4) -> DataFrame:
    """(code, size, node) of codes (code, size, fp) whose fingerprint the Gray-order index links with that of another code, or that share theirs: a node is a group of linked fingerprints."""
    prints = written(codes.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "prints")
    below = components(links(prints.select("fp", F.col("fp").alias("rep")), bits))
    groups = written(below.union(below.select("root", "root")).distinct(), "print-groups")
    of = prints.join(groups, prints["fp"] == groups["node"], "left").where("root is not null or n > 1").select("fp", F.xxhash64(F.lit("fingerprints"), F.coalesce("root", "fp")).alias("node"))
    return codes.select("code", "size", "fp").join(of, "fp").select("code", "size", "node")


def near_copies(docs: DataFrame, words: int = 5, least: float = 0.8, doc_id: str = "doc_id", text: str = "text", bits: int = 4) -> DataFrame:
    """A row for each row of docs: doc_id, text_key (MD5 of the text), component_id (the smallest id reachable, null where no row
    of the group has one), stays (whether the row is the one of its group that has the smallest id, then the smallest key).

    Texts that share a node are candidates: all pairs whose fingerprints differ in `bits` bits or fewer, and by 24 bands of 4 minima all
    but three in a million of the pairs of similarity 0.8. Sketches drop pairs over 0.18 below `least` (a pair at 0.8 deviates by 0.04), and the exact Jaccard
    similarity of all `words`-word shingles decides. Rows that repeat id and text stay or go together.
    """

    @F.pandas_udf("code long, nodes array<long>, sketch binary, size int, fp long")
    def index(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for t in part:
                h = shingles_of(t, words)
                m = minima_of(h)
                bands = [xxhash.xxh64_intdigest(m[at : at + ROWS].tobytes(), at) for at in range(0, BINS, ROWS)]
                out.append((_code(h), np.array(bands, np.uint64).view(np.int64), _bytes_of(m), len(h), _signed(voted(h))))
            yield pd.DataFrame(out, columns=["code", "nodes", "sketch", "size", "fp"])

    with small_batches(docs.sparkSession):
        rows = written(docs.select(F.col(doc_id).alias("id"), text_key(F.col(text)).alias("key"), index(F.col(text)).alias("b")).select("id", "key", "b.*"), "sketches")
    # Texts with the same shingles are one code; its first row has the smallest id, null ids last.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")
    codes = written(rows.groupBy("code").agg(first, F.first("nodes").alias("nodes"), F.first("sketch").alias("sketch"), F.first("size").alias("size"), F.first("fp").alias("fp")), "codes")
    members = codes.select("code", "size", F.explode("nodes").alias("node")).union(near_nodes(codes, bits))
    hubs = members.groupBy("node").agg(F.min("code").alias("hub"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight")).where("n > 1")
    members = written(members.drop("size").join(hubs, "node"), "members")
    # Whole sets of shingles, only of codes that share a node with another.
    wanted = codes.join(members.select("code").distinct(), "code").select("code", F.col("first.id").alias("want_id"), F.col("first.key").alias("want_key"))

    @F.pandas_udf("binary")
    def set_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([shingles_of(t, words).tobytes() for t in part], dtype=object)

    texts = docs.select(F.col(doc_id).alias("id"), text_key(F.col(text)).alias("key"), F.col(text).alias("t"))
    # A text of that key has that code, and rows that repeat id and text are one.
    known = texts.join(small(written(wanted, "wanted")), (F.col("key") == F.col("want_key")) & F.col("id").eqNullSafe(F.col("want_id")))
    with small_batches(docs.sparkSession):
        sets = written(known.select("code", set_of("t").alias("shingles")).groupBy("code").agg(F.first("shingles").alias("shingles")), "sets")

    @F.pandas_udf("boolean")
    def agrees(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least for x, y in zip(a, b)], dtype=bool)

    # At most one pair a member: that with its hub.
    pairs = members.where("code <> hub").select(F.least("code", "hub").alias("v"), F.greatest("code", "hub").alias("u")).distinct()
    a, b = (sets.select(F.col("code").alias(x), F.col("shingles").alias(f"s{x}")) for x in "uv")
    with small_batches(docs.sparkSession):
        edges = written(pairs.join(a, "u").join(b, "v").where(agrees("su", "sv")).select("u", "v"), "hub-links")
    # What is still apart within a node. Large nodes as pairs of blocks.
    groups = written(components(edges), "hub-groups").withColumnRenamed("node", "code")
    parts = members.join(groups, "code", "left").select("node", "code", "n", "weight", F.coalesce("root", "code").alias("part"))
    torn = parts.groupBy("node").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("node")
    cuts = F.greatest(F.ceil(F.col("n") / NODE), F.ceil(F.col("weight") / WEIGHT)).cast("long")
    apart = parts.join(torn, "node").withColumn("cuts", cuts).withColumn("block", F.expr("pmod(xxhash64(code), cuts)"))
    apart = apart.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
    unit = F.when(F.col("cuts") == 1, F.col("node")).otherwise(F.xxhash64("node", F.least("block", "with"), F.greatest("block", "with")))
    apart = apart.select(unit.alias("node"), "part", "code", "block", (F.col("with") != F.col("block")).cast("long").alias("other"))
    apart = written(apart, "apart")
    marks = apart.join(codes.select("code", "sketch"), "code").repartition("node").sortWithinPartitions("node", "part").mapInArrow(_open_texts(least - 0.18), "node long, code long")
    left = apart.join(written(marks, "open-texts"), ["node", "code"]).join(sets, "code")
    more = left.repartition("node").sortWithinPartitions("node", "part").mapInArrow(_exact_links(least), "u long, v long")
    with small_batches(docs.sparkSession):
        edges = edges.union(written(more.distinct(), "open-links")).distinct()
    named = codes.select("code", "first").join(components(edges).withColumnRenamed("node", "code"), "code", "left").select("code", "first", F.coalesce("root", "code").alias("root"))
    named = written(named, "named")
    heads = named.groupBy("root").agg(F.min("first").alias("head"))
    of = named.select("code", "root").join(heads, "root").select("code", "head")
    stays = F.col("id").eqNullSafe(F.col("head.id")) & (F.col("key") == F.col("head.key"))
    return rows.select("id", "key", "code").join(of, "code").select(F.col("id").alias(doc_id), F.col("key").alias("text_key"), F.col("head.id").alias("component_id"), stays.alias("stays"))
