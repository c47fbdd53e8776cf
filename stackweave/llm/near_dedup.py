"""Near duplicates by SimHash and a binary-trie self-join.

Signature: 128 bits over the set of a document's words.  All pairs of signatures within `budget` differing bits are
found, whatever the size of the table: a fixed order of the bits is cut into blocks, and each block gets an error budget so that
a pair can't exceed all of them without exceeding the whole budget (pigeonhole).  For each block there is a binary trie whose
order begins with the block's bits; it is joined with itself.  Pairs of nodes go down together, add up their differing
bits, and end when the sum passes the block's budget within the block, or the whole one below it.  The tries' top levels
are traversed first: a task gets pairs of top nodes with the bits in which they differ.  How many blocks there
are depends on the number of signatures and only changes the cost; no pair depends on other documents, and no group
is capped.

Edge cases: a null, empty or wordless text has no signature and no duplicates; an empty table gives no rows; a null doc_id can't
be named and is left out; rows that repeat a doc_id are one document if their words agree, else
each of their texts links to it; texts of any length are taken whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import kept, small_batches
from .words import ROW_BITS, segment

BITS = 128
BUDGET = 22
LEAF = 128
#: Node pairs that are taken down at once.
FRONTIER = 1 << 16
#: Of a block's bits, those that make a root of stars; a root with more rows first connects its rows to a few of them (stars), so that thousands of copies aren't compared pair by pair.
STAR_BITS = 14
STAR_ROWS = 48
STAR_ROUNDS = 4
_LANES = ((np.arange(256)[:, None] >> np.arange(8)[None, :] & 1).astype(np.uint64) << (np.arange(8, dtype=np.uint64) * 8)[None, :]).sum(1).astype(np.uint64)
SIGNATURE = "doc_id long, s0 long, s1 long"


def signatures(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 2) uint64 signatures, and which rows have any word.  Bit b is set if most distinct words set it in their hash."""
    n = len(texts)
    out, has = np.zeros((n, 2), np.uint64), np.zeros(n, bool)
    for w in segment(texts):
        if not len(w.hash):
            continue
        keep = np.uint64(ROW_BITS)  # the same for every piece: a signature mustn't depend on the rows beside its own
        shift = np.uint64(64) - keep
        key = np.sort((w.row.astype(np.uint64) << shift) | (w.hash >> keep))
        key = key[np.r_[True, key[1:] != key[:-1]]]
        row = (key >> shift).astype(np.int64)
        # Pieces of at most 255 words of one row: a byte lane holds their count.
        begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        size = np.diff(np.r_[begin, len(row)])
        pieces = -(-size // 255)
        piece_row = np.repeat(np.arange(len(begin)), pieces)
        nth = np.arange(len(piece_row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = begin[piece_row] + nth * 255
        first_piece = np.cumsum(pieces) - pieces
        value = key << keep
        one, two = _spread(value, 0x2545F4914F6CDD1D), _spread(value, 0x9E6C63D0876A9A47)
        counts = np.empty((len(begin), BITS), np.int64)
        for half, hashed in enumerate((one, two)):
            octets = hashed.view(np.uint8).reshape(-1, 8)
            for b in range(8):
                lanes = np.add.reduceat(_LANES[octets[:, b]], at)
                each = lanes.view(np.uint8).reshape(-1, 8).astype(np.int64)
                counts[:, half * 64 + b * 8 : half * 64 + b * 8 + 8] = np.add.reduceat(each, first_piece, axis=0)
        bits = counts * 2 > size[:, None]
        packed = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        at_row = w.lo + row[begin]
        out[at_row], has[at_row] = packed, True
    return out, has


def _spread(x: np.ndarray, by: int) -> np.ndarray:
    x = x * np.uint64(by)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sig, has = signatures(b.column(1))
        sig = sig[has].view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(has)), pa.array(sig[:, 0]), pa.array(sig[:, 1])], ["doc_id", "s0", "s1"])


def budgets(blocks: int, budget: int) -> list[int]:
    """Error budgets of the blocks: a pair that exceeds every one has at least sum(e + 1) > budget differing bits."""
    low, more = divmod(max(0, budget - blocks + 1), blocks)
    return [low + (i < more) for i in range(blocks)]


def within(bits: int, errors: int) -> int:
    """How many values differ from one of `bits` bits in at most `errors`."""
    return sum(math.comb(bits, e) for e in range(errors + 1))


def plan(signatures_: int, budget: int = BUDGET) -> tuple[list[tuple[int, int]], int]:
    """(bits, error budget) of each block, and the top levels that are split over tasks: the cheapest for so many signatures.

    The cost of a trie is the number of node pairs within the block's budget where the signatures part, or where the block ends.
    """
    deep = max(1, int(signatures_).bit_length())

    def blocks(m: int) -> list[tuple[int, int]]:
        return [(BITS // m + (i < BITS % m), e) for i, e in enumerate(budgets(m, budget))]

    def cost(m: int) -> float:
        return sum(within(min(bits, deep), e) * max(1.0, signatures_ / 2**bits) for bits, e in blocks(m))

    best = min(range(4, 17), key=cost)
    return blocks(best), max(2 + (deep > 16), deep - 20)


def bit_order(bits: int = BITS) -> np.ndarray:
    return np.random.default_rng(20240229).permutation(bits)


def _nodes(blocks: list[tuple[int, int]], top: int):
    """Each signature once for every pair of top nodes, within the block's budget, that its node belongs to."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = bit_order()
        for b in batches:
            sig = np.stack([b.column(1).to_numpy(), b.column(2).to_numpy()], 1).view(np.uint64)
            bits = np.unpackbits(sig.view(np.uint8).reshape(len(sig), -1), axis=1, bitorder="little")
            at = 0
            for n, (width, errors) in enumerate(blocks):
                # Most significant bit first, so that sorting by (p0, p1) is the trie's order.
                p = np.ascontiguousarray(np.packbits(bits[:, np.roll(order, -at)], axis=1)).view(">u8").astype(np.uint64)
                node = (p[:, 0] >> np.uint64(64 - top)).astype(np.int64)
                at += width
                for mask in range(1 << top):
                    if mask.bit_count() <= errors:
                        key = (np.int64(n) << np.int64(2 * top)) | (np.minimum(node, node ^ mask) << np.int64(top)) | np.maximum(node, node ^ mask)
                        yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0), pa.array(p[:, 0].view(np.int64)), pa.array(p[:, 1].view(np.int64))], ["key", "rep", "p0", "p1"])

    return expand


def stars(p: np.ndarray, lo: np.ndarray, hi: np.ndarray, budget: int, rounds: int = STAR_ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A label for each row, and the pairs (pivot, row) that give it: below each large root the middle row without a label, which is
    likely one of the largest group, takes all rows within the budget, some rounds long.  Rows of one label are connected, so pairs of them need no comparison."""
    label = -1 - np.arange(len(p))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        size = hi - lo
        rows = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        root = np.repeat(np.arange(len(lo)), size)
        free = label[rows] < 0
        rows, root = rows[free], root[free]
        if not len(rows):
            break
        begin = np.flatnonzero(np.r_[True, root[1:] != root[:-1]])
        many = np.diff(np.r_[begin, len(rows)])
        pivot = np.repeat(rows[begin + many // 2], many)
        near = (np.bitwise_count(p[rows, 0] ^ p[pivot, 0]).astype(np.int64) + np.bitwise_count(p[rows, 1] ^ p[pivot, 1])) <= budget
        label[rows[near]] = pivot[near]
        other = near & (rows != pivot)
        found.append((pivot[other], rows[other]))
    return label, *(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))


def _middle(p: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """The first row of each range lo..hi whose bit at `depth` is set."""
    word, at = divmod(depth, 64)
    shift, lo, hi = np.uint64(63 - at), lo.copy(), hi.copy()
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) >> 1
        one = (p[mid, word] >> shift & np.uint64(1)).astype(bool)
        hi[open_[one]] = mid[one]
        lo[open_[~one]] = mid[~one] + 1
    return lo


def trie_pairs(
    p: np.ndarray, nodes: tuple[np.ndarray, ...], depth: int, block: tuple[int, int], budget: int, leaf: int = LEAF, label: np.ndarray | None = None, frontier: int = FRONTIER
) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within `budget` differing bits below each pair of nodes.  p: (n, 2) uint64; nodes: (a_lo, a_hi, b_lo,
    b_hi, differing bits so far), where a node is a range of rows that agree in the first `depth` bits, sorted.
    block: (bits, errors) that a pair may have at most in the first bits.
    With labels, a pair of nodes whose rows all have one label is skipped."""
    turns = None if label is None else np.cumsum(np.r_[0, label[1:] != label[:-1]])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    p0, p1 = (np.ascontiguousarray(p[:, i]) for i in (0, 1))
    todo = [(depth, nodes)]
    while todo:
        depth, (a_lo, a_hi, b_lo, b_hi, err) = todo.pop()
        alive = (a_hi > a_lo) & (b_hi > b_lo) & (err <= (block[1] if depth <= block[0] else budget)) & ~((a_lo == b_lo) & (a_hi - a_lo < 2))
        a_lo, a_hi, b_lo, b_hi, err = (x[alive] for x in (a_lo, a_hi, b_lo, b_hi, err))
        if turns is not None and len(err):
            known = (turns[a_lo] == turns[a_hi - 1]) & (turns[b_lo] == turns[b_hi - 1]) & (label[a_lo] == label[b_lo])
            a_lo, a_hi, b_lo, b_hi, err = (x[~known] for x in (a_lo, a_hi, b_lo, b_hi, err))
        if len(err) > frontier:
            for i in range(0, len(err), frontier):
                todo.append((depth, tuple(x[i : i + frontier] for x in (a_lo, a_hi, b_lo, b_hi, err))))
            continue
        if not len(err):
            continue
        same = a_lo == b_lo
        done = ((a_hi - a_lo) * (b_hi - b_lo) <= leaf) | (depth == BITS)
        if done.any():
            found += _compare(p0, p1, a_lo[done], a_hi[done], b_lo[done], b_hi[done], same[done], budget)
        a_lo, a_hi, b_lo, b_hi, err, same = (x[~done] for x in (a_lo, a_hi, b_lo, b_hi, err, same))
        if not len(err):
            continue
        a_mid = _middle(p, a_lo, a_hi, depth)
        other = ~same
        b_mid = a_mid.copy()
        b_mid[other] = _middle(p, b_lo[other], b_hi[other], depth)
        children = (
            (a_lo, a_mid, a_lo, a_mid[other]),
            (a_mid, a_hi, a_mid, a_hi[other]),
            (b_lo, b_mid, b_mid, b_lo[other]),
            (b_mid, b_hi, b_hi, b_mid[other]),
            (err, err, err + 1, err[other] + 1),
        )
        todo.append((depth + 1, tuple(np.concatenate(x) for x in children)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _compare(p0, p1, a_lo, a_hi, b_lo, b_hi, same, budget, step: int = 1 << 16):
    """The pairs of a row of each node a and one of its node b that are within the budget; pieces of about `step` pairs stay in the cache."""
    out = []
    many = a_hi - a_lo
    node = np.repeat(np.arange(len(many), dtype=np.int32), many)
    rows = (np.arange(len(node)) + np.repeat(a_lo - (np.cumsum(many) - many), many)).astype(np.int32)
    width = (b_hi - b_lo)[node]
    total = np.cumsum(width)
    first = b_lo[node] - (total - width)
    i = 0
    while i < len(rows):
        base = int(total[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(total, base + step, "right")))
        w = width[i:j]
        x = np.repeat(rows[i:j], w)
        y = (np.arange(base, int(total[j - 1])) + np.repeat(first[i:j], w)).astype(np.int32)
        # Most unrelated pairs exceed the budget in the last 64 bits alone.
        bits = np.bitwise_count(p1[x] ^ p1[y])
        at = np.flatnonzero(bits <= budget)
        x, y, bits = x[at], y[at], bits[at]
        near = bits + np.bitwise_count(p0[x] ^ p0[y]) <= budget
        if same[node[i:j]].any():
            near &= ~np.repeat(same[node[i:j]], w)[at] | (x < y)
        out.append((x[near].astype(np.int64), y[near].astype(np.int64)))
        i = j
    return out


def _dense(p: np.ndarray, begin: np.ndarray, end: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stars below the roots of STAR_BITS bits within the ranges that have more than STAR_ROWS rows."""
    prefix = p[:, 0] >> np.uint64(64 - STAR_BITS)
    inside = np.zeros(len(p) + 1, np.int64)
    np.add.at(inside, begin, 1)
    np.add.at(inside, end, -1)
    turn = prefix[1:] != prefix[:-1]
    turn[begin[begin > 0] - 1] = True
    lo = np.flatnonzero(np.r_[True, turn])
    hi = np.r_[lo[1:], len(p)]
    many = (hi - lo > STAR_ROWS) & (np.cumsum(inside)[lo] > 0)
    return stars(p, lo[many], hi[many], budget)


def forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges (node, least node of its component) that connect what the pairs x, y connect."""
    if not len(x):
        return x, y
    nodes, inv = np.unique(np.r_[x, y], return_inverse=True)
    a, b = inv[: len(x)], inv[len(x) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        label = label[label]
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            break
    away = label != np.arange(len(nodes))
    return nodes[away], nodes[label[away]]


def _join_tries(blocks: list[tuple[int, int]], top: int, budget: int):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work(parts: list[np.ndarray]) -> pa.RecordBatch:
            key, rep, p0, p1 = parts
            order = np.lexsort((p1, p0, key))
            key, rep = key[order], rep[order]
            p = np.stack([p0[order], p1[order]], 1)
            begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            end = np.r_[begin[1:], len(key)]
            block, u, v = key[begin] >> (2 * top), key[begin] >> top & ((1 << top) - 1), key[begin] & ((1 << top) - 1)
            node = (p[:, 0] >> np.uint64(64 - top)).astype(np.int64)
            # The lesser node's rows come first.
            split = begin + np.add.reduceat((node == np.repeat(u, end - begin)).astype(np.int64), begin)
            alone = u == v
            label, x0, y0 = _dense(p, begin[alone], end[alone], budget)
            xs, ys = [x0], [y0]
            for n in np.unique(block):
                own = block == n
                nodes = (begin[own], np.where(alone, end, split)[own], np.where(alone, begin, split)[own], end[own], np.bitwise_count(u ^ v)[own].astype(np.int64))
                x, y = trie_pairs(p, nodes, top, blocks[n], budget, label=label)
                xs.append(x)
                ys.append(y)
            x, y = forest(rep[np.concatenate(xs)], rep[np.concatenate(ys)])
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["src", "dst"])

        def columns(bs: list[pa.RecordBatch]) -> list[np.ndarray]:
            t = pa.Table.from_batches(bs)
            key, rep, p0, p1 = (t.column(i).to_numpy() for i in range(4))
            return [key, rep, p0.view(np.uint64), p1.view(np.uint64)]

        rows = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= 400_000:
                cols = columns(held)
                cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last pair of nodes may go on in the next batch
                if cut:
                    yield work([c[:cut] for c in cols])
                    rest = pa.Table.from_batches(held).slice(cut)
                    held, rows = rest.to_batches(), rest.num_rows
        if held:
            yield work(columns(held))

    return join


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of the undirected edges (src, dst) with the least node it is connected to.

    Large-star and small-star rounds, each kept in the shared folder, until nothing changes.
    """
    edges = kept(edges.filter("src != dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        roots = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(roots, "u").select("v", "m").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = kept(small.unionByName(roots.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = now


def near_duplicates(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(doc_id, kept_id): every document of each group of two or more, with the group's least doc_id, which stays."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = kept(base.filter("doc_id is not null").mapInArrow(_sign, SIGNATURE), "signatures")
    reps = kept(signed.groupBy("s0", "s1").agg(F.min("doc_id").alias("rep")), "reps").select("rep", "s0", "s1")
    blocks, top = plan(reps.count(), budget)
    rows = reps.mapInArrow(_nodes(blocks, top), "key long, rep long, p0 long, p1 long")
    edges = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_join_tries(blocks, top, budget), "src long, dst long")
    same = signed.join(reps, ["s0", "s1"]).select("doc_id", "rep")
    linked = components(edges.unionByName(same.filter("doc_id != rep").select(F.col("doc_id").alias("src"), F.col("rep").alias("dst"))))
    members = linked.select(F.col("node").alias("doc_id"), F.col("root").alias("kept_id"))
    return members.unionByName(members.select(F.col("kept_id").alias("doc_id"), "kept_id").distinct())


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs without the documents of a group that aren't its least doc_id; all rows of a kept doc_id stay."""
    gone = near_duplicates(docs, **options).filter("doc_id != kept_id").select(F.col("doc_id").alias("__sw_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__sw_gone"), "left_anti")
