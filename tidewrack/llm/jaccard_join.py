"""N-gram Jaccard join with count-vector R-trees.

A document is the set of its distinct word shingles. Shingles are hashed into
groups and a set becomes the point of its counts for each group. The sum of the
smaller coordinates of two points bounds the overlap of their sets; pairs whose
bound suffices are verified on the sets themselves.

One tree over all points fits nowhere, so it is cut at its top. There the
groups are fine: practically one shingle each. With the coordinates in one
order for all points, two points without a common coordinate among the first
few of each (as many as a linked set may lack, and one more) have too small a
sum of minima. So the top has one subtree for each coordinate, and a point is
in the subtrees of its first few. The order puts frequent shingles last, by a
histogram of fixed size over all documents; a passage of very many documents
thus opens subtrees only for documents made of such passages.

Below, a subtree's points have coarse counts. In small subtrees all bounds are
worked out at once. A large one is an R-tree, and goes round by hubs: a hub
takes all points near enough for a link, and points up to twice as far are
compared with those it took. 1 - sum of minima / sum of maxima is a metric, so
no other pair can be linked. Subtrees give points that are connected by bounds
that suffice, and those of a whole cluster meet once, with their sets: links
are verified, and components are built from verified links only.

Scale: equal sets are one point throughout, combined in each batch first. A
cluster of more than block_bytes is cut into blocks, and each block also gets a
few hubs of the cluster, which nearly always connect all of it. What they leave
apart, and only that, is compared with the other blocks. Inside a task, sets
that are connected already aren't verified. Nothing is capped.

Defined results: null, empty and white-space texts have no shingles and link
with nothing; each is its own component. A text of fewer words than a shingle
is one shingle. Repeated rows get a row each; of repeated ids with different
texts each is linked by its own text. Rows with a null id link like others and
connect others, but a null id names a component only if all its ids are null.
Extra columns don't matter. Shingles are compared by 49 bits of a hash, sets as
a whole by 128.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import histogram
from .batches import id_field, pieces
from .components import components
from .shared import discard, stored
from .words import mix, split, windows

LEAF, FAN = 16, 8
#: Subtrees of up to so many points need no tree of their own.
SMALL = 64
#: Documents of more than block_bytes of shingles get so many hubs.
HUBS = 16
#: A sort key holds a document's place in its piece, whether the shingle is frequent, and the shingle.
PIECE_ROWS, VALUE_BITS = 1 << 14, 49
_BATCH = 1 << 20
_U = np.uint64
_VALUE = _U((1 << VALUE_BITS) - 1)


def shingle_sets(texts: pa.Array, width: int, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document and hash of all distinct shingles, sorted by both, and how many each document has.

    frequent: a flag for each cell; a document's shingles of such cells come last.
    """
    w = split(texts, lower=True)
    if w.n_docs > PIECE_ROWS:
        raise ValueError(f"at most {PIECE_ROWS} texts at once")
    h = w.hashes()
    n = w.counts()
    g = windows(h, width, seed=11)
    inside = w.doc[: len(g)] == w.doc[width - 1 :] if len(g) else np.zeros(0, bool)
    doc, value = [w.doc[: len(g)][inside]], [g[inside]]
    for k in range(1, width):
        few = np.flatnonzero(n == k)
        if len(few):
            doc.append(few)
            value.append(windows(h, k, seed=100 + k)[w.first[few]])
    value = np.concatenate(value) >> _U(64 - VALUE_BITS)
    key = (np.concatenate(doc).astype(_U) << _U(VALUE_BITS + 1)) | value
    if frequent is not None:
        key |= frequent[cells(value)].astype(_U) << _U(VALUE_BITS)
    key.sort()
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    doc = (key >> _U(VALUE_BITS + 1)).astype(np.int64)
    return doc, key & _VALUE, np.bincount(doc, minlength=w.n_docs)


def cells(value: np.ndarray) -> np.ndarray:
    return histogram.cells(value, VALUE_BITS)


def _sums(doc: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, _U)
    if len(doc):
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        with np.errstate(over="ignore"):
            out[doc[first]] = np.add.reduceat(value, first)
    return out


def set_names(doc: np.ndarray, value: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set."""
    n = len(size)
    with np.errstate(over="ignore"):
        return mix(_sums(doc, mix(value), n) + size.astype(_U)), mix(_sums(doc, mix(value ^ _U(0xA5A5A5A5)), n) ^ size.astype(_U))


def size_class(size: np.ndarray) -> np.ndarray:
    """Sets of 2**c to 2**(c + 1) - 1 shingles are of class c."""
    return np.frexp(np.maximum(size, 1).astype(float))[1] - 1


def n_groups(kind: int) -> int:
    """Groups of a class: 2 to 4 shingles in each, up to 512 groups."""
    return 1 << min(9, max(4, kind - 1))


def points(doc: np.ndarray, value: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Each set's counts for the groups of its class, in as few bits as they need: two in a byte, or one in 1, 2 or 4 bytes."""
    dims = 1 << np.clip(size_class(size) - 1, 4, 9)
    end = np.cumsum(dims)
    start = end - dims
    count = np.bincount(start[doc] + (value & (dims[doc] - 1).astype(_U)).astype(np.int64), minlength=int(end[-1]) if len(end) else 0)
    top = np.maximum.reduceat(count, start) if len(start) else start
    half = (count[0::2] | (count[1::2] << 4)).astype(np.uint8)
    byte = count.astype(np.uint8)
    out = []
    for a, b, most in zip(start.tolist(), end.tolist(), top.tolist(), strict=True):
        if most < 16:
            out.append(half[a // 2 : b // 2].tobytes())
        else:
            out.append((byte[a:b] if most < 1 << 8 else count[a:b].astype("<u2" if most < 1 << 16 else "<u4")).tobytes())
    return out


def unpacked(packed: list[bytes], own: np.ndarray, kind: int) -> np.ndarray:
    """Counts of points for the groups of a class that is theirs or the next smaller one. own: their classes."""
    dims = n_groups(kind)
    out = np.zeros((len(packed), dims), np.int32)
    groups = np.array([n_groups(k) for k in own.tolist()])
    sizes = np.array(list(map(len, packed)))
    for d, n in {*zip(groups.tolist(), sizes.tolist(), strict=True)}:
        at = np.flatnonzero((groups == d) & (sizes == n))
        raw = np.frombuffer(b"".join([packed[i] for i in at]), np.uint8 if n <= d else f"<u{n // d}").reshape(len(at), -1)
        if 2 * n == d:
            raw = np.stack([raw & 15, raw >> 4], axis=2).reshape(len(at), d)
        raw = raw.astype(np.int32)
        out[at] = raw if d == dims else raw.reshape(len(at), 2, dims).sum(axis=1)
    return out


def first_coordinates(doc: np.ndarray, value: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """Places of the shingles in whose subtrees a set is, of values sorted in the common order."""
    first = np.cumsum(size) - size
    place = np.arange(len(doc)) - first[doc]
    return np.flatnonzero(place <= (size - -(-percent * size // 100))[doc])


class Tree:
    """An R-tree over count vectors, packed from the leaves up in the order of size and counts."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((*vectors.T[:3][::-1], sizes))
        self.vectors, self.sizes = vectors[self.order], sizes[self.order]
        self.levels = []
        high, low, most = self.vectors, self.sizes, self.sizes
        fan = LEAF
        while len(high) > fan:
            cut = np.arange(0, len(high), fan)
            high, low, most = np.maximum.reduceat(high, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(most, cut)
            self.levels.append((high, low, most, fan))
            fan = FAN

    def near(self, vector: np.ndarray, size: int, percent: int, above: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places in order of members whose bound on the overlap with a set suffices for a link, and the bounds. above: only those after this place."""
        percent = max(percent, 0)
        least, most = -(-percent * size // 100), 100 * size // percent if percent else np.iinfo(np.int64).max
        at = np.arange(len(self.levels[-1][0])) if self.levels else None
        for k in range(len(self.levels) - 1, -1, -1):
            high, low, top, fan = self.levels[k]
            bound = np.minimum(vector, high[at]).sum(axis=1)
            fits = (low[at] <= most) & (top[at] >= least) & ((100 + percent) * bound >= percent * (size + np.maximum(low[at], least)))
            below = len(self.levels[k - 1][0]) if k else len(self.sizes)
            at = (at[fits, None] * fan + np.arange(fan)).ravel()
            at = at[at < below]
        if at is None:
            at = np.arange(len(self.sizes))
        at = at[at > above]
        bound = np.minimum(vector, self.vectors[at]).sum(axis=1)
        ok = (100 + percent) * bound >= percent * (size + self.sizes[at])
        return at[ok], bound[ok]


def _joined(comp: np.ndarray, places: np.ndarray) -> None:
    """Make one of the components that places are in."""
    kinds = np.unique(comp[places])
    if len(kinds) > 1:
        comp[np.isin(comp, kinds[1:])] = kinds[0]


def connected(vectors: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Component of each point, over pairs whose bound suffices for a link."""
    tree, loose = Tree(vectors, sizes), 2 * percent - 100
    comp, done = np.arange(len(sizes)), np.zeros(len(sizes), bool)
    for hub in range(len(sizes)):
        if done[hub]:
            continue
        at, bound = tree.near(tree.vectors[hub], int(tree.sizes[hub]), loose)
        tight = (100 + percent) * bound >= percent * (tree.sizes[hub] + tree.sizes[at])
        ball = at[tight]
        done[ball] = True
        _joined(comp, ball)
        # Points up to twice as far can be linked with what the hub took.
        shell = at[~tight]
        shell = shell[~done[shell] & (comp[shell] != comp[hub])]
        for a in range(0, len(ball), 64):
            if not len(shell):
                break
            part, found = ball[a : a + 64], []
            for b in range(0, len(shell), 256):
                some = shell[b : b + 256]
                bound = np.minimum(tree.vectors[some, None], tree.vectors[None, part]).sum(axis=2)
                found.append(((100 + percent) * bound >= percent * (tree.sizes[some, None] + tree.sizes[part])).any(axis=1))
            found = np.concatenate(found)
            if found.any():
                _joined(comp, np.r_[hub, shell[found]])
                shell = shell[comp[shell] != comp[hub]]
    out = np.empty_like(comp)
    out[tree.order] = comp
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def links(sets: list[np.ndarray], percent: int, comp: list | None = None, guest: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Verified links that connect all that is linked. comp: what is connected already; guest: only links of guests with others are needed."""
    sizes = np.array([len(s) for s in sets])
    label = np.unique(comp, return_inverse=True)[1] if comp is not None else np.arange(len(sets))
    out: list[tuple[int, int]] = []

    def verified(i: int, j: int) -> bool:
        if (100 + percent) * overlap(sets[i], sets[j]) < percent * (len(sets[i]) + len(sets[j])):
            return False
        out.append((i, j))
        return True

    if len(sets) == 2:
        if label[0] != label[1]:
            verified(0, 1)
        return out
    dims = 1 << int(np.clip(np.ceil(np.log2(max(1, np.median(sizes) / 4))), 4, 8))
    owner = np.repeat(np.arange(len(sets)), sizes)
    group = (np.concatenate(sets) & _U(dims - 1)).astype(np.int64) if len(owner) else owner
    vectors = np.bincount(owner * dims + group, minlength=len(sets) * dims).reshape(len(sets), dims).astype(np.int32)
    tree = Tree(vectors, sizes)
    label = label[tree.order]
    if guest is not None:
        guest = guest[tree.order]
    for place, i in enumerate(tree.order):
        at, bound = tree.near(tree.vectors[place], int(tree.sizes[place]), percent, place)
        at = at[np.argsort(-bound, kind="stable")]
        if guest is not None:
            at = at[guest[at] != guest[place]]
        at = at[label[at] != label[place]]
        while len(at):
            other, at = at[0], at[1:]
            if verified(int(i), int(tree.order[other])):
                _joined(label, np.array([place, other]))
                at = at[label[at] != label[place]]
    return out


_SET = [T.StructField(k, t()) for k, t in (("key", T.LongType), ("name", T.StringType), ("node", T.LongType), ("n", T.LongType), ("point", T.BinaryType), ("cell", T.IntegerType), ("counts", T.BinaryType))]


def _sets(width: int, schema: T.StructType):
    """Names, sizes and points of all documents' sets; after them, once in each task, how many shingles fell in each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        to = to_arrow_schema(schema)
        counts = histogram.empty()
        for batch in batches:
            for piece in pieces(batch, most=_BATCH, rows=PIECE_ROWS):
                doc, value, size = shingle_sets(piece.column("text"), width)
                a, b = set_names(doc, value, size)
                histogram.add(counts, cells(value))
                names = [f"{x:016x}{y:016x}" if n else None for x, y, n in zip(a.tolist(), b.tolist(), size.tolist(), strict=True)]
                rows = len(size)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(to.field(0).type), piece.column("key"), pa.array(names, pa.string()), pa.array(a.view(np.int64)), pa.array(size, pa.int64()), pa.array(points(doc, value, size), pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], schema=to)
        rows = histogram.packed(counts)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(rows.num_rows, to.field(i).type) for i in range(6)), *rows.columns], schema=to)

    return run


def frequent_cells(counts: np.ndarray) -> np.ndarray:
    """Flags of the cells with clearly more shingles than chance gives."""
    mean = counts.mean()
    return counts > mean + 6 * np.sqrt(mean) + 16


def _coordinates(width: int, percent: int, frequent):
    """For each set of a batch, its first coordinates: shingle, class and whether the next smaller class can have links with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(np.frombuffer(frequent.value, np.uint8)).astype(bool)
        for batch in batches:
            for piece in pieces(batch, most=_BATCH, rows=PIECE_ROWS):
                doc, value, size = shingle_sets(piece.column("text"), width, flags)
                node, _ = set_names(doc, value, size)
                _, first = np.unique(node, return_index=True)
                mine = np.zeros(len(size), bool)
                mine[first] = True
                at = first_coordinates(doc, value, size, percent)
                at = at[mine[doc[at]]]
                kind = size_class(size)
                below = -(-percent * size // 100) < (1 << kind)
                code = (kind << 1 | below).astype(_U)
                yield pa.RecordBatch.from_arrays([pa.array(((value[at] << _U(6)) | code[doc[at]]).view(np.int64)), pa.array(node[doc[at]].view(np.int64))], names=["t", "node"])

    return run


def _whole_runs(batches: Iterator[pa.RecordBatch], key) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, in batches that cut no run of equal keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = key(batch)
        if last is not None and k[-1] == last:
            held.append(batch)
            continue
        cut = int(np.flatnonzero(k[1:] != k[:-1])[-1]) + 1 if k[0] != k[-1] else 0
        held.append(batch.slice(0, cut))
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()
        yield from whole
        held, last = [batch.slice(cut)], k[-1]
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by t and node: the subtrees with more than one point, split by classes."""
    for batch in _whole_runs(batches, lambda b: b.column("t").to_numpy() >> 6):
        t, node = batch.column("t").to_numpy(), batch.column("node").to_numpy()
        new = np.r_[True, (t[1:] != t[:-1]) | (node[1:] != node[:-1])]
        t, node = t[new], node[new]
        tree = ((t >> 6) << 5) | ((t >> 1) & 31)
        both = (t & 1) > 0
        tree, node = np.r_[tree, tree[both] - 1], np.r_[node, node[both]]
        order = np.lexsort((node, tree))
        tree, node = tree[order], node[order]
        same = tree[1:] == tree[:-1]
        keep = np.r_[same, False] | np.r_[False, same] if len(tree) else np.zeros(0, bool)
        yield pa.RecordBatch.from_arrays([pa.array(tree[keep]), pa.array(node[keep])], names=["tree", "node"])


def _candidates(percent: int):
    """Over rows sorted by subtree: each point with the first of its component there."""

    def small(run: np.ndarray, vectors: np.ndarray, n: np.ndarray) -> np.ndarray:
        label = np.arange(len(run))
        a, b = [], []
        for step in range(1, SMALL):
            at = np.flatnonzero(run[step:] == run[:-step])
            if not len(at):
                break
            for x in range(0, len(at), 4096):
                i = at[x : x + 4096]
                bound = np.minimum(vectors[i], vectors[i + step]).sum(axis=1)
                i = i[(100 + percent) * bound >= percent * (n[i] + n[i + step])]
                a.append(i)
                b.append(i + step)
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        while True:
            least = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, a, least)
            np.minimum.at(label, b, least)
            label = label[label]
            if (label == before).all():
                return label

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_runs(batches, lambda b: b.column("tree").to_numpy()):
            tree, node, n = (batch.column(x).to_numpy() for x in ("tree", "node", "n"))
            packed = batch.column("point").to_pylist()
            kind = tree & 31
            hubs, nodes = [], []
            for k in np.unique(kind).tolist():
                at = np.flatnonzero(kind == k)
                cut = np.flatnonzero(np.r_[True, tree[at][1:] != tree[at][:-1], True])
                size = np.diff(cut)
                few = np.repeat(size <= SMALL, size)
                groups = [at[few], *(at[cut[i] : cut[i + 1]] for i in np.flatnonzero(size > SMALL))]
                for g in groups:
                    if len(g) < 2:
                        continue
                    vectors = unpacked([packed[i] for i in g], size_class(n[g]), k)
                    if g is groups[0]:
                        label = small(tree[g], vectors, n[g])
                    else:
                        comp = connected(vectors, n[g], percent)
                        _, first, back = np.unique(comp, return_index=True, return_inverse=True)
                        label = first[back]
                    moved = np.flatnonzero(label != np.arange(len(label)))
                    hubs.append(node[g][label[moved]])
                    nodes.append(node[g][moved])
            if hubs:
                pairs = np.unique(np.stack([np.concatenate(hubs), np.concatenate(nodes)], axis=1), axis=0)
                pairs = pairs[pairs[:, 0] != pairs[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _linked(width: int, percent: int):
    """Over rows sorted by block: verified links between the sets of each."""
    columns = ("name", "size", "z", "comp", "guest")

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[tuple]]]:
        """Lists of whole groups, of about a piece's bytes together."""
        now, out, held = None, [], 0
        for batch in batches:
            for key, *row in zip(zip(*(batch.column(x).to_pylist() for x in ("label", "i", "j")), strict=True), *(batch.column(x).to_pylist() for x in columns), strict=True):
                if key != now and (held > _BATCH or len(out) > 2000):
                    yield out
                    out, held = [], 0
                if key != now:
                    out.append([])
                now = key
                out[-1].append(row)
                held += row[1]
        if out:
            yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for groups in grouped(batches):
            rows = [r for g in groups for r in g]
            values, names = [], []
            for a in range(0, len(rows), 2048):
                texts = [codec.decompress(z, size, asbytes=True) for _, size, z, *_ in rows[a : a + 2048]]
                doc, value, size = shingle_sets(pa.array(texts, pa.large_binary()), width)
                cut = np.r_[0, np.cumsum(size)]
                values += [value[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]
                names += [f"{x:016x}{y:016x}" for x, y in zip(*(z.tolist() for z in set_names(doc, value, size)), strict=True)]
            found, at = [], 0
            for g in groups:
                # A key's hash can bring another text than the one chosen for its set.
                chosen = {names[at + k]: at + k for k, row in enumerate(g) if names[at + k] == row[0]}
                picks = list(chosen.values())
                at += len(g)
                if len(picks) > 1:
                    comp = [rows[k][3] for k in picks] if g[0][3] is not None else None
                    guest = np.array([rows[k][4] for k in picks]) if comp is not None else None
                    found += [(names[picks[a]], names[picks[b]]) for a, b in links([values[k] for k in picks], percent, comp, guest)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*found, strict=True)], names=["a", "b"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd", 1)
    for batch in batches:
        for piece in pieces(batch):
            # Equal rows have one key; a text is needed once.
            piece = piece.take(pa.array(np.unique(piece.column("key").to_numpy(), return_index=True)[1]))
            texts = [(x or "").encode("utf-8", "surrogatepass") for x in piece.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column("key"), pa.array(map(len, texts), pa.int64()), pa.array([codec.compress(x, asbytes=True) for x in texts], pa.binary())], names=["key", "size", "z"])


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, block_bytes: int = 16 << 20) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id. Sets link when 100 * intersection >= percent * union; percent is 50 to 100, so that linked sets are at most one class of size apart."""
    if not 50 <= percent <= 100:
        raise ValueError(f"percent must be from 50 to 100, not {percent}")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col, F.col(id_col).isNull(), F.col(text_col).isNull()).alias("key"), F.col(text_col).alias("text"))
    schema = T.StructType([id_field(d, "doc_id"), *_SET])
    named = stored(d.mapInArrow(_sets(width, schema), schema), "named")
    frequent = spark.sparkContext.broadcast(np.packbits(frequent_cells(histogram.total(named))).tobytes())
    named = named.where("cell IS NULL").select("doc_id", "key", "name", "node", "n", "point")
    sets = stored(named.where("name IS NOT NULL").groupBy("name").agg(F.min("key").alias("key"), F.first("node").alias("node"), F.first("n").alias("n"), F.first("point").alias("point")), "sets")

    # The top of the tree: subtrees with more than one point, and what is connected by bounds in each.
    top = d.select("text").mapInArrow(_coordinates(width, percent, frequent), "t bigint, node bigint").repartition(parts, F.shiftright("t", 6)).sortWithinPartitions("t", "node")
    placed = top.mapInArrow(_subtrees, "tree bigint, node bigint").join(sets.select("node", "n", "point"), "node")
    placed = placed.select("tree", "node", "n", "point").repartition(parts, "tree").sortWithinPartitions("tree", "node")
    clusters = components(placed.mapInArrow(_candidates(percent), "a bigint, b bigint"))

    # The sets of a cluster meet, those of a large one in blocks with some hubs in each.
    members = sets.join(clusters.withColumnRenamed("v", "node"), "node").select("name", "key", "n", "label")
    texts = d.mapInArrow(_packed, "key bigint, size bigint, z binary").join(members, "key").select("name", "n", "label", "size", "z")
    texts = stored(texts, "texts")
    for done in (clusters, sets):
        discard(done)
    sizes = texts.groupBy("label").agg(F.ceil(F.sum(F.col("n") * 24) / block_bytes).cast("int").alias("blocks"))
    mixed = lambda k: F.xxhash64("name", F.lit(k))
    hubs = texts.groupBy("label").agg(F.sum("n").alias("s"), F.array(*[F.min(F.struct(mixed(k).alias("h"), "name"))["name"] for k in range(HUBS)]).alias("hubs"))
    hubs = hubs.select("label", F.ceil(F.col("s") * 24 / block_bytes).cast("int").alias("blocks"), F.explode(F.array_distinct("hubs")).alias("name")).where("blocks > 1")
    hubs = hubs.join(texts.drop("label"), "name").select("label", "name", "size", "z", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    blocks = texts.join(sizes, "label").select("label", "name", "size", "z", F.pmod(mixed(-1), F.col("blocks")).cast("int").alias("i")).unionByName(hubs)
    blocks = blocks.select("label", "i", F.lit(0).alias("j"), "name", "size", "z", F.lit(None).cast("string").alias("comp"), F.lit(False).alias("guest"))
    gather = lambda x: x.repartition(parts, "label", "i", "j").sortWithinPartitions("label", "i", "j").mapInArrow(_linked(width, percent), "a string, b string")
    edges = stored(gather(blocks), "links")
    found = components(edges)

    # What is still apart in a cut cluster: all but its largest component visits the other blocks.
    cut = texts.join(sizes.where("blocks > 1"), "label").join(found.select(F.col("v").alias("name"), F.col("label").alias("comp")), "name", "left")
    cut = cut.select("label", "name", "size", "z", "blocks", F.coalesce("comp", "name").alias("comp"), F.pmod(mixed(-1), F.col("blocks")).cast("int").alias("i"))
    main = cut.groupBy("label", "comp").count().groupBy("label").agg(F.max(F.struct("count", "comp"))["comp"].alias("main"), F.count("*").alias("apart")).where("apart > 1")
    apart = stored(cut.join(main, "label"), "cut")
    if not apart.isEmpty():
        guests = apart.where("comp <> main")
        rooms = guests.groupBy("label").agg(F.ceil(F.sum("size") * 4 / block_bytes).cast("int").alias("rooms"))
        cut = apart.join(rooms, "label")
        hosts = cut.select("label", "i", F.explode(F.sequence(F.lit(0), F.col("rooms") - 1)).alias("j"), "name", "size", "z", "comp", F.lit(False).alias("guest"))
        guests = cut.where("comp <> main").select("label", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.pmod(mixed(-2), F.col("rooms")).cast("int").alias("j"), "name", "size", "z", "comp", F.lit(True).alias("guest"))
        discard(found)
        found = components(edges.unionByName(gather(hosts.unionByName(guests))))
    for done in (texts, edges, apart):
        discard(done)

    labelled = named.join(found.withColumnRenamed("v", "name"), "name", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "name").alias("label"))
    least = labelled.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return labelled.join(least, "label", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
