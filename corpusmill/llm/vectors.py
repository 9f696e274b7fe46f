"""A partitioned, score-aware quantised index over vectors, and the neighbours it finds."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.shared import arrow_rows, cut

#: rows that fit the partition and the codebooks; a bound, whatever the size of the table
FIT_ROWS = 12_288
#: of these, rows that fit the codebooks
CODE_ROWS = 3072
SUB = 2  # dimensions per subspace, coded in four bits
SHELF = 32_768  # rows that cells are grouped by
BLOCK = 32_768  # rows at home in a shelf that one task takes
GUESTS = 49_152  # visitors that are decoded at a time: as many as a task is meant to get


def dense(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, rows as float32) of the valid vectors: dim numbers, none NULL or NaN, not all zero."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lists = lists.cast(pa.list_(pa.float32()))
    offset = lists.offsets.to_numpy()
    size = np.diff(offset)
    ok = (size == dim) & lists.is_valid().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(ok)
    values = lists.values.to_numpy(zero_copy_only=False)  # NULL numbers become NaN
    x = np.empty((len(at), dim), np.float32)
    for i in range(0, len(at), 512):
        x[i : i + 512] = values[offset[at[i : i + 512], None] + np.arange(dim)]
    fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return at[fine], x[fine]


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)).astype(np.float32)


def pack(x: np.ndarray) -> list[bytes]:
    """Rows without loss: one byte a number where all are multiples of a power of two that fit, else 32-bit floats."""
    out: list[bytes | None] = [None] * len(x)
    todo = np.arange(len(x))
    for k in (8, 7, 6, 9, 10, 5, 4, 11, 12):
        if not len(todo):
            break
        y = x[todo] * np.float32(2.0**k)
        fits = (np.abs(y) <= 127).all(axis=1)
        fits[fits] = (y[fits] == np.rint(y[fits])).all(axis=1)
        for i, row in zip(todo[fits], y[fits].astype(np.int8)):
            out[i] = bytes([k]) + row.tobytes()
        todo = todo[~fits]
    for i in todo:
        out[i] = b"\xff" + x[i].tobytes()
    return out


def unpack(rows: list[bytes], dim: int) -> np.ndarray:
    x = np.empty((len(rows), dim), np.float32)
    small = np.array([len(r) == dim + 1 for r in rows], bool)
    at = np.flatnonzero(small)
    if len(at):
        raw = np.frombuffer(b"".join([rows[i] for i in at]), np.int8).reshape(len(at), dim + 1)
        x[at] = raw[:, 1:] * np.exp2(-raw[:, :1].astype(np.float32))
    for i in np.flatnonzero(~small):
        x[i] = np.frombuffer(rows[i], np.float32, offset=1)
    return x


def best(s: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the n largest values of each row, largest first, and the values."""
    n = min(n, s.shape[1])
    top = np.argpartition(-s, n - 1, axis=1)[:, :n]
    top = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
    return top, np.take_along_axis(s, top, 1)


@dataclass
class Index:
    """Two levels of cells and the codebooks.  centroids: cells x dim.  planes: directions x dim that halve every cell.  shelf: shelf of a centroid.
    low: planes below a shelf.  codebook: subspaces x 16 x SUB.  eta: weight of error parallel to the vector.

    A cell is a centroid with one side of every plane through it; a shelf is a group of cells that one task takes, of about SHELF rows.  The
    number of centroids is bounded and that of planes follows the rows, so bounded tables address any number of cells.
    """

    dim: int
    centroids: np.ndarray
    planes: np.ndarray
    shelf: np.ndarray
    low: int
    codebook: np.ndarray
    eta: float

    @property
    def n_cells(self) -> int:
        return len(self.centroids) << len(self.planes)

    def shelves(self, cells: np.ndarray) -> np.ndarray:
        """Shelf of every cell."""
        bits = len(self.planes)
        return self.shelf[cells >> bits] << (bits - self.low) | (cells & ((1 << bits) - 1)) >> self.low

    def cells(self, u: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each row, nearest first: the first is its own.

        A cell's distance is that of its centroid and of the planes between the row and the cell; per centroid up to 8 planes nearest to
        the row are crossed, in any combination.
        """
        n, bits = min(n, self.n_cells), len(self.planes)
        free = min(bits, 8)
        wide = min(len(self.centroids), max(n, 8))
        out = np.empty((len(u), n), np.int64)
        crossed = ((np.arange(1 << free)[:, None] >> np.arange(free)) & 1).astype(np.float32)
        apart = self.centroids @ self.planes.T
        step = max(1, (1 << 22) // (wide << free))
        for i in range(0, len(u), step):
            x = u[i : i + step]
            near, score = best(x @ self.centroids.T, wide)
            side = (x @ self.planes.T)[:, None, :] - apart[near]
            code = ((side > 0) << np.arange(bits)).sum(2)
            flip = np.argsort(np.abs(side), axis=2)[:, :, :free]
            cost = np.take_along_axis(np.abs(side), flip, 2) @ crossed.T
            mask = ((1 << flip) @ crossed.T.astype(np.int64)) if free else np.zeros((*near.shape, 1), np.int64)
            cells = ((near[:, :, None] << bits) | (code[:, :, None] ^ mask)).reshape(len(x), -1)
            top, _ = best((score[:, :, None] - cost).reshape(len(x), -1), n)
            out[i : i + step, : top.shape[1]] = np.take_along_axis(cells, top, 1)
        return out

    def wider(self) -> Index:
        """With every two neighbouring shelves as one."""
        return replace(self, low=self.low + 1) if self.low < len(self.planes) else replace(self, shelf=self.shelf // 2)

    def encode(self, u: np.ndarray) -> np.ndarray:
        return assign(u, self.codebook, self.eta)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        lines, first = np.ascontiguousarray(self.codebook).reshape(-1, SUB), np.arange(len(self.codebook)) * 16
        out = np.empty((len(codes), len(first), SUB), lines.dtype)
        for i in range(0, len(codes), 256):
            np.take(lines, codes[i : i + 256] + first, axis=0, out=out[i : i + 256], mode="clip")
        return out.reshape(len(codes), self.dim)


def pack_codes(codes: np.ndarray) -> np.ndarray:
    return (codes[:, 0::2] | codes[:, 1::2] << 4).astype(np.uint8)


def unpack_codes(packed: np.ndarray) -> np.ndarray:
    out = np.empty((packed.shape[0], packed.shape[1] * 2), np.uint8)
    out[:, 0::2], out[:, 1::2] = packed & 15, packed >> 4
    return out


def _direction(r: np.ndarray) -> np.ndarray:
    return r / np.maximum(np.linalg.norm(r, axis=1, keepdims=True), 1e-9)


def assign(r: np.ndarray, codebook: np.ndarray, eta: float, sweeps: int = 1) -> np.ndarray:
    """Codes of residuals that make |e|^2 + (eta - 1) (e.d)^2 small, e being the error and d the residual's direction.

    Error along the residual is what shifts the inner products with similar rows, so it costs eta times as much as error
    across.  Starts from the nearest codewords and goes over the subspaces by coordinate descent.
    """
    m, n = codebook.shape[0], len(r)
    along_it = math.sqrt(eta - 1)  # scales what lies along the residual, so that its square has its weight
    x, d = (np.ascontiguousarray(y.reshape(n, m, SUB).transpose(1, 2, 0), np.float32) for y in (r, _direction(r) * along_it))
    words = np.ascontiguousarray(codebook, np.float32)
    size, along = (words**2).sum(2)[:, :, None], x[:, 0] * d[:, 0]
    for i in range(1, SUB):
        along += x[:, i] * d[:, i]
    codes = np.empty((m, n), np.intp)
    par = np.empty((m, n), np.float32)
    plain = np.empty((m, 16, n), np.float32)  # |codeword|^2 - 2 codeword.x of every subspace
    loss, left = np.empty((2, 16, n), np.float32)
    line = np.arange(n)
    for j in range(m):
        np.matmul(words[j], x[j], out=plain[j])
        plain[j] *= -2
        plain[j] += size[j]
        loss[:] = plain[j]
        codes[j] = _least(loss)
        np.subtract(along[j], np.matmul(words[j], d[j], out=left), out=left)
        par[j] = left.ravel().take(codes[j] * n + line)
    total = par.sum(0)
    for _ in range(sweeps):
        for j in range(m):
            np.subtract(along[j], np.matmul(words[j], d[j], out=left), out=left)
            others = total - par[j]
            np.add(left, others, out=loss)
            loss *= loss
            loss += plain[j]
            codes[j] = _least(loss)
            par[j] = left.ravel().take(codes[j] * n + line)
            total = others + par[j]
    return np.ascontiguousarray(codes.T.astype(np.uint8))


def _least(loss: np.ndarray) -> np.ndarray:
    """Line, of 16, of the smallest number of each column: the line takes the place of the last four bits, so numbers equal up to these are ties.  ``loss`` is overwritten."""
    bits = loss.view(np.int32)
    bits &= ~15
    bits |= np.arange(16, dtype=np.int32)[:, None]
    return loss.min(axis=0).view(np.int32) & 15


def fit_codebook(r: np.ndarray, eta: float, seed: int, rounds: int = 4) -> np.ndarray:
    """Codebooks by alternating assignment and, per codeword, the least squares of the same weighted error."""
    rng = np.random.default_rng(seed)
    m, n = r.shape[1] // SUB, len(r)
    d = _direction(r)
    book = np.stack([r[rng.choice(n, 16, replace=n < 16), j * SUB : (j + 1) * SUB] for j in range(m)]).astype(np.float32)
    eye = np.eye(SUB)
    for step in range(rounds):
        codes = assign(r, book, eta, sweeps=int(step > 0))
        chosen = book[np.arange(m)[None, :], codes]
        par = ((r.reshape(-1, m, SUB) - chosen) * d.reshape(-1, m, SUB)).sum(2)
        total = par.sum(1)
        for j in range(m):
            x, w = r[:, j * SUB : (j + 1) * SUB], d[:, j * SUB : (j + 1) * SUB]
            others = total - par[:, j]
            hot = np.zeros((16, n), np.float32)
            hot[codes[:, j], np.arange(n)] = 1
            count = hot.sum(1)
            a = count[:, None, None] * eye + (eta - 1) * (hot @ (w[:, :, None] * w[:, None, :]).reshape(n, -1)).reshape(16, SUB, SUB)
            b = hot @ (x + (eta - 1) * w * (others + (x * w).sum(1))[:, None])
            full = count > 0
            book[j][full] = np.linalg.solve(a[full], b[full][:, :, None])[:, :, 0]
            now = ((x - book[j][codes[:, j]]) * w).sum(1)
            total, par[:, j] = others + now, now
    return book


def fit_cells(u: np.ndarray, n: int, seed: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means; an empty cell restarts at the row worst served."""
    rng = np.random.default_rng(seed)
    c = u[rng.choice(len(u), n, replace=False)].copy()
    for _ in range(rounds):
        s = u @ c.T
        near = s.argmax(1)
        order = np.argsort(near, kind="stable")
        starts = np.searchsorted(near[order], np.arange(n))
        sums = np.add.reduceat(u[order], np.minimum(starts, len(u) - 1), axis=0)
        empty = np.bincount(near, minlength=n) == 0
        sums[empty] = u[np.argsort(s.max(1))[: empty.sum()]]
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return c.astype(np.float32)


def fit_index(vectors: DataFrame, key: str, vec: str, dim: int, seed: int = 42, rows_per_cell: int = 200, most_centroids: int = 1024, t: float = 0.1) -> tuple[Index, np.ndarray] | None:
    """(index, unit rows it was fitted on); None if there is no valid vector.

    The rows, at most FIT_ROWS, are those with the smallest of evenly spread hashes of their key; it is an error if none is valid while the table
    has valid ones.  The cells asked for are rows / rows_per_cell: one plane halves all, further planes follow once half of them would be more than
    most_centroids.  eta follows from the inner products t that matter: (dim - 1) t^2 / (1 - t^2).
    """
    n = vectors.count()
    share = min(1.0, FIT_ROWS / max(n, 1))
    mark = F.xxhash64(F.lit(seed), F.col(key)).cast("double")  # even over the 64-bit numbers, whatever the number of rows
    picked = vectors.filter(mark < (2 * share - 1) * 2.0**63) if share < 1 else vectors
    _, x = dense(picked.select(vec).limit(FIT_ROWS * 2).toArrow().column(0), dim)
    if not len(x):
        if share < 1 and vectors.select(F.size(vec).alias("n")).filter(F.col("n") == dim).limit(1).count():
            raise RuntimeError("no valid vector among the rows to fit on: the sample is too small for this table")
        return None
    u = unit(x[:FIT_ROWS])
    del x
    wanted = max(1.0, n / rows_per_cell)
    bits = max(1, math.ceil(math.log2(wanted / most_centroids)))
    cells = int(max(1, min(round(wanted / 2**bits), most_centroids, len(u) // 8)))
    c = fit_cells(u, cells, seed)
    rng = np.random.default_rng(seed)
    planes = np.linalg.qr(rng.standard_normal((dim, min(bits, dim))))[0].T.astype(np.float32)
    groups = int(max(1, min(round(n / SHELF), cells)))
    shelf = (c @ fit_cells(c, groups, seed).T).argmax(1)
    low = len(planes) - max(0, math.ceil(math.log2(max(1.0, n / SHELF / groups)))) if groups == cells else len(planes)
    eta = max(1.0, (dim - 1) * t * t / (1 - t * t))
    return Index(dim, c, planes, shelf, max(0, low), fit_codebook(u[:CODE_ROWS], eta, seed), eta), u


def measured_probes(index: Index, a: np.ndarray, b: np.ndarray, target: float, both: bool) -> int:
    """The fewest nearest cells such that for the share ``target`` of the pairs (a, b) those of a hold b's own (or, with ``both``, those of b a's).

    It is measured on the given pairs, so it follows the number of cells and how mixed the data are.
    """
    n = min(index.n_cells, 64)
    while True:
        near = index.cells(a, n)
        rank = _place(near, index.cells(b, 1)[:, 0])
        if both:
            rank = np.minimum(rank, _place(index.cells(b, n), near[:, 0]))
        need = int(np.sort(rank)[min(len(rank) - 1, math.ceil(target * len(rank)) - 1)]) + 1
        if need <= n or n == index.n_cells:
            return min(need, n)
        n = min(index.n_cells, n * 4)


def _place(lists: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    hit = lists == wanted[:, None]
    return np.where(hit.any(1), hit.argmax(1), lists.shape[1])


def pairs_at(u: np.ndarray, t: float, seed: int = 0, most: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit rows of similarity t: rows, and the same turned towards another row."""
    rng = np.random.default_rng(seed)
    a = u[rng.permutation(len(u))[:most]]
    w = u[rng.integers(0, len(u), len(a))] + 1e-3 * rng.standard_normal(a.shape).astype(np.float32)
    w = w - (w * a).sum(1, keepdims=True) * a
    return a, (t * a + math.sqrt(max(0.0, 1 - t * t)) * w / np.linalg.norm(w, axis=1, keepdims=True)).astype(np.float32)


def index_rows(vectors: DataFrame, key: str, vec: str, index: Index, n_cells: int, whole: bool = False) -> DataFrame:
    """Every valid row: key, same (64-bit id of the exact vector), home (its cell), visits (shelf and the cells of it among the n_cells
    nearest), code (four bits a subspace), err (length of the code's error), at (number of the stored row) and, if ``whole``, vec (lossless)."""
    shared = vectors.sparkSession.sparkContext.broadcast(index)

    def code(batches):
        ix = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                p = b.slice(lo, 2048)
                at, x = dense(p.column(1), ix.dim)
                u = unit(x)
                cells = ix.cells(u, n_cells) if len(u) else np.zeros((0, 1), np.int64)
                codes = ix.encode(u) if len(u) else np.zeros((0, len(ix.codebook)), np.uint8)
                err = np.linalg.norm(u - ix.decode(codes), axis=1)
                columns = [
                    p.column(0).take(pa.array(at)).cast(pa.int64()),
                    pa.array([int.from_bytes(hashlib.blake2b(r.tobytes(), digest_size=8).digest(), "big", signed=True) for r in x], pa.int64()),
                    pa.array(cells[:, 0], pa.int64()),
                    _by_shelf(ix, cells),
                    pa.array([r.tobytes() for r in pack_codes(codes)], pa.binary()),
                    pa.array(err.astype(np.float32), pa.float32()),
                ]
                names = ["key", "same", "home", "visits", "code", "err"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(pack(x), pa.binary())] if whole else columns, names=[*names, "vec"] if whole else names)

    rows = vectors.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), vec)
    schema = "key long, same long, home long, visits array<struct<shelf: long, cells: array<int>>>, code binary, err float" + (", vec binary" if whole else "")
    with arrow_rows(vectors.sparkSession, 1024):
        return cut(rows.mapInArrow(code, schema).withColumn("at", F.monotonically_increasing_id()), "index")


def _by_shelf(ix: Index, cells: np.ndarray) -> pa.Array:
    """Per row the cells of each shelf together."""
    n, width = cells.shape
    shelf = ix.shelves(cells)
    order = np.argsort(shelf, axis=1, kind="stable")
    shelf, cells = np.take_along_axis(shelf, order, 1), np.take_along_axis(cells, order, 1)
    first = np.ones((n, width), bool)
    first[:, 1:] = shelf[:, 1:] != shelf[:, :-1]
    inner = pa.ListArray.from_arrays(pa.array(np.r_[np.flatnonzero(first.ravel()), n * width], pa.int32()), pa.array(cells.ravel(), pa.int32()))
    parts = pa.StructArray.from_arrays([pa.array(shelf[first], pa.int64()), inner], names=["shelf", "cells"])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(first.sum(1))], pa.int32()), parts)


def in_tasks(homes: DataFrame, visitors: DataFrame, columns: list[str], blocks: int = 1) -> DataFrame:
    """Rows by the tasks that compare the rows at home in a shelf with its visitors: shelf, block, guests, cell (NULL for a visitor), cells, columns.

    ``homes``: shelf, key, home, columns; ``visitors``: shelf, key, cells, columns.  A shelf with more than BLOCK rows (``blocks``
    times as many) at home is split by a hash of the key, and so are its visitors, so no task gets more than about these of the one and one and a half BLOCK of the
    other, whatever the share of rows in one shelf; every visitor meets every row at home once.
    """
    parts = lambda df, most, name: df.groupBy("shelf").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    sizes = cut(parts(homes, blocks * BLOCK, "_k").join(parts(visitors, 3 * BLOCK // 2, "_g"), "shelf"), "shelves")
    of = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    none = F.lit(None)
    here = homes.join(sizes, "shelf").withColumn("guests", every("_g")).select("shelf", of("_k").alias("block"), "guests", F.col("home").alias("cell"), none.cast("array<int>").alias("cells"), *columns)
    there = visitors.join(sizes, "shelf").withColumn("block", every("_k")).select("shelf", "block", of("_g").alias("guests"), none.cast("long").alias("cell"), "cells", *columns)
    return here.unionByName(there)


def by_cell(t: pa.Table):
    """(rows at home, visitors) of every cell of a task's table that has both, as row numbers."""
    cell = t.column("cell").combine_chunks()
    home = np.flatnonzero(cell.is_valid().to_numpy(zero_copy_only=False))
    at = cell.take(pa.array(home)).to_numpy(zero_copy_only=False)
    lists = t.column("cells").combine_chunks()
    guest = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
    lists = lists.take(pa.array(guest))
    size = np.diff(lists.offsets.to_numpy())
    who, seen = np.repeat(guest, size), lists.flatten().to_numpy(zero_copy_only=False)
    order, again = np.argsort(at, kind="stable"), np.argsort(seen, kind="stable")
    home, at, who, seen = home[order], at[order], who[again], seen[again]
    cells = np.unique(at)
    edges = [np.searchsorted(x, cells.astype(x.dtype), side) for x in (at, seen) for side in ("left", "right")]
    for h, h_end, q, q_end in zip(*edges):
        if q < q_end:
            yield home[h:h_end], who[q:q_end]


def distinct_vectors(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per distinct vector, members): equal vectors are indexed and compared once, by their smallest key."""
    reps = index.groupBy("same").agg(F.min("key").alias("rep"), F.min_by("at", "key").alias("at"))
    members = index.select("key", "same").distinct().join(reps.drop("at"), "same").select("rep", "key")
    # by the stored row, of which there is one, so that codes and vectors needn't be sorted to drop a key's repeated rows
    return index.join(reps.select("at"), "at", "left_semi").drop("at"), members


#: rows at home whose tables are looked up together, and visitors: sums that fit a core's cache
AT_HOME, AT_ONCE = 512, 512

#: tables and their sums are whole numbers of this many steps to 1
SCALE = 8192


def scan_tables(tables, codes: np.ndarray, subspaces, out: np.ndarray, buffer: np.ndarray) -> None:
    """Sums of 16-entry tables looked up by four-bit codes, for all rows and queries: out[row, query] = sum of tables(j)[codes[j, row], query].

    ``tables(j)`` gives the 16 x queries table of a subspace in 16-bit whole numbers; a row's code picks one line of it, so a look-up
    is a copy of neighbouring numbers for all queries together.
    """
    out[:] = 0
    for j in subspaces:
        tables(j).take(codes[j], 0, buffer, "clip")
        out += buffer


def meetings(t: pa.Table, ix: Index, least: float, z: float) -> pa.Table:
    """Candidate pairs (a < b) of a task's table (see :func:`in_tasks`) of which one visits the other's cell and which may have a similarity of ``least``.

    Both sides are four-bit codes, so a subspace's table holds the products of its 16 codewords with those of the rows at home; it is built once for
    all visitors, whose codes look it up.  The tables of every fourth subspace are scanned; a visitor none of whose estimates from them, a sample of all
    subspaces, comes within z standard deviations of ``least`` is left.  A visitor whose mean estimate, one product with the mean of the rows
    at home, comes that near needs no scan, as the largest estimate is not below the mean.  For visitors that stay all codewords' products are
    summed, and a pair stays if that is within z standard deviations of its codes' error.  There is no limit on a row's candidates.
    """
    m, some = len(ix.codebook), len(ix.codebook[::4])
    ix = replace(ix, codebook=np.concatenate([ix.codebook[i::4] for i in (0, 2, 1, 3)]))  # the scanned subspaces lead
    key = t.column("key").to_numpy()
    packed = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(len(key), -1)
    codes = np.concatenate([packed[:, 0::2] & 15, packed[:, 1::2] & 15, packed[:, 0::2] >> 4, packed[:, 1::2] >> 4], axis=1)
    err = t.column("err").to_numpy().astype(np.float32) ** 2
    product = np.rint(np.einsum("jad,jbd->jab", ix.codebook[:some], ix.codebook[:some]) * SCALE).astype(np.int16)
    line = np.arange(some)[:, None]
    share = some / m
    sampling = math.sqrt(share * (1 - share) * (1 + least * least) / ix.dim)
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    chunks = [(home[i : i + AT_HOME], guests) for home, guests in by_cell(t) for i in range(0, len(home), AT_HOME)]
    visitors = np.flatnonzero(t.column("cells").is_valid().to_numpy())
    rows = np.empty((AT_ONCE, ix.dim), np.float32)
    for lo in range(0, len(visitors), GUESTS):  # visitors are decoded once for all cells of the task
        these = visitors[lo : lo + GUESTS]
        whole = ix.decode(codes[these])
        few = whole[:, : SUB * some]
        for home, guests in chunks:
            guests = guests[slice(*np.searchsorted(guests, (these[0], these[-1] + 1)))]
            if not len(guests):
                continue
            seat = np.searchsorted(these, guests)
            worst = err[home].max()
            edge = share * (least - z * np.sqrt((worst + err[guests].max()) / ix.dim)) - z * sampling
            mine = ix.decode(codes[home])
            sure = few[seat] @ mine[:, : SUB * some].mean(axis=0) > edge
            near, rest = [seat[sure]], seat[~sure]
            tables = np.ascontiguousarray(product[line, codes[home, :some].T].transpose(0, 2, 1)) if len(rest) else None
            for i in range(0, len(rest), AT_ONCE):
                q = rest[i : i + AT_ONCE]
                sums, buffer = np.empty((2, len(q), len(home)), np.int16)
                scan_tables(tables.__getitem__, codes[these[q], :some].T.astype(np.intp), range(some), sums, buffer)
                near.append(q[sums.max(axis=1) > int(edge * SCALE)])
            near = np.concatenate(near)
            for i in range(0, len(near), AT_ONCE):
                q = near[i : i + AT_ONCE]
                score = np.take(whole, q, axis=0, out=rows[: len(q)], mode="clip") @ mine.T
                q = these[q]
                b, a = np.divmod(np.flatnonzero(score >= least - z * np.sqrt((worst + err[q].max()) / ix.dim)), len(home))
                score, a, b = score[b, a], home[a], q[b]
                keep = (score >= least - z * np.sqrt((err[a] + err[b]) / ix.dim)) & (key[a] != key[b])
                found_a.append(key[a[keep]])
                found_b.append(key[b[keep]])
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
    return pa.table({"a": pair[0], "b": pair[1]})


def close_pairs(rows: DataFrame, index: Index, least: float, z: float = 3.0) -> DataFrame:
    """Candidate pairs (a < b) of which one visits the other's cell and which may have a similarity of ``least``: see :func:`meetings`."""
    shared = rows.sparkSession.sparkContext.broadcast(index)
    columns = ["key", "code", "err"]
    tasks = in_tasks(_at_home(rows.select("home", *columns), index), rows.select(F.inline("visits"), *columns), columns, 3)  # half as many again as two shelves hold on average
    return tasks.groupBy("shelf", "block", "guests").applyInArrow(lambda t: meetings(t, shared.value, least, z), "a long, b long").distinct()


def _at_home(rows: DataFrame, index: Index) -> DataFrame:
    """With the shelf of the home cell."""
    bits = len(index.planes)
    of = F.element_at(F.array(*[F.lit(int(s)) for s in index.shelf]), (F.shiftright("home", bits) + 1).cast("int"))
    return rows.withColumn("shelf", F.shiftleft(of.cast("long"), bits - index.low).bitwiseOR(F.shiftright(F.col("home").bitwiseAND(F.lit((1 << bits) - 1)), index.low)))


#: bits of the filter that keeps most rows without a candidate out of the shuffle; its size never grows
FILTER_BITS = 1 << 25


def vectors_of(vectors: DataFrame, key: str, vec: str, wanted: DataFrame, dim: int) -> DataFrame:
    """key and lossless vec of the valid rows whose key is in ``wanted`` (distinct keys), read again from the table.

    The keys first pass a bitmap of FILTER_BITS hashed positions, built in the cluster piece by piece (at most 4 MB in
    all), then an exact semi-join; the bitmap only decides what is shuffled.
    """
    spark = vectors.sparkSession
    piece = 1 << 16

    def bits(t: pa.Table) -> pa.Table:
        b = np.zeros(piece, np.uint8)
        b[t.column("bit").to_numpy() % piece] = 1
        return pa.table({"piece": t.column("piece").slice(0, 1), "bits": pa.array([np.packbits(b).tobytes()], pa.binary())})

    hashed = wanted.select(F.pmod(F.xxhash64("key"), F.lit(FILTER_BITS)).alias("bit")).distinct().withColumn("piece", F.floor(F.col("bit") / piece))
    pieces = {r["piece"]: r["bits"] for r in hashed.groupBy("piece").applyInArrow(bits, "piece long, bits binary").collect()}
    bitmap = np.concatenate([np.frombuffer(pieces.get(i, b"\0" * (piece // 8)), np.uint8) for i in range(FILTER_BITS // piece)])
    shared = spark.sparkContext.broadcast(bitmap)

    def take(batches):
        bm = shared.value
        for b in batches:
            at = b.column(1).to_numpy()
            hit = np.flatnonzero(bm[at >> 3] >> (7 - (at & 7)) & 1)
            p = b.take(pa.array(hit))
            ok, x = dense(p.column(2), dim)
            yield pa.RecordBatch.from_arrays([p.column(0).take(pa.array(ok)).cast(pa.int64()), pa.array(pack(x), pa.binary())], names=["key", "vec"])

    named = vectors.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(FILTER_BITS)).alias("bit"), vec)
    found = named.mapInArrow(take, "key long, vec binary")
    with arrow_rows(spark, 1024):
        return cut(found.join(wanted, "key", "left_semi").dropDuplicates(["key"]), "needed")


def exact(pairs: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """pairs (a, b, ...) with their exact cosine ``similarity``; ``vectors``: key, vec (lossless)."""
    v = vectors.select("key", "vec")
    two = pairs.join(v.select(F.col("key").alias("a"), F.col("vec").alias("_x")), "a").join(v.select(F.col("key").alias("b"), F.col("vec").alias("_y")), "b")
    names = pairs.columns

    def cosine(batches):
        for t in batches:
            for i in range(0, t.num_rows, 2048):
                p = t.slice(i, 2048)
                x, y = (unpack(p.column(c).to_pylist(), dim).astype(np.float64) for c in ("_x", "_y"))
                s = (x * y).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
                yield pa.RecordBatch.from_arrays([*[p.column(c) for c in names], pa.array(s)], names=[*names, "similarity"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return two.mapInArrow(cosine, f"{fields}, similarity double")


def close_neighbours(
    vectors: DataFrame, k: int = 5, least: float = 0.7, key: str = "row_id", vec: str = "delta", dim: int = 768, rows_per_cell: int = 72, recall: float = 0.99, seed: int = 42
) -> DataFrame:
    """For every row its at most k most similar rows of similarity ``least`` or more: key, neighbour, similarity, rank.

    Every row is at home in one cell and visits its nearest ones: as many as are needed so that of pairs of similarity ``least``, made from
    the rows the index was fitted on, the share ``recall`` meets; more similar pairs meet more often.  Rows that meet are compared by their codes and
    candidates are ranked by exact similarity; ties go to the smaller key.  Rows of one key are one vector; invalid vectors
    (see :func:`dense`) take no part.  Equal vectors of different keys are compared once: each brings its class's first k + 1 keys, which is all that k places can hold.
    No valid vector: no rows.
    """
    spark = vectors.sparkSession
    out = "key long, neighbour long, similarity double, rank int"
    fitted = fit_index(vectors, key, vec, dim, seed, rows_per_cell)
    if fitted is None:
        return spark.createDataFrame([], out)
    index, sample = fitted[0].wider(), fitted[1]  # rows without vectors are small, and a visitor is sent once a shelf
    rows = index_rows(vectors, key, vec, index, measured_probes(index, *pairs_at(sample, least), recall, True))
    firsts, members = distinct_vectors(rows)
    pairs = cut(close_pairs(cut(firsts, "firsts"), index, least), "close")
    ends = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    needed = vectors_of(vectors, key, vec, ends, dim)
    sims = exact(pairs, needed, dim).filter(F.col("similarity") >= least)
    both = sims.select("a", "b", "similarity").unionByName(sims.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    members = cut(members, "members")
    few = members.withColumn("_n", F.row_number().over(Window.partitionBy("rep").orderBy("key"))).filter(F.col("_n") <= k + 1)
    few = few.select(F.col("rep").alias("b"), F.col("key").alias("neighbour"))
    crowded = members.groupBy("rep").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("similarity"))
    q = members.select(F.col("rep").alias("a"), "key")
    full = both.unionByName(crowded).join(few, "b").join(q, "a").filter("key != neighbour").select("key", "neighbour", "similarity")
    order = Window.partitionBy("key").orderBy(F.desc("similarity"), "neighbour")
    return full.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "row_id", vec: str = "delta", dim: int = 768, rows_per_cell: int = 200, recall: float = 0.97, seed: int = 42, z: float = 2.5
) -> DataFrame:
    """The k rows most similar to each query row, exactly reranked: key, neighbour, similarity, rank.

    Every row is at home in one cell; a query visits as many of its nearest cells as are needed so that the share ``recall`` of the true
    neighbours of fitted rows among fitted rows is met, and sees all rows of their shelves.  In each task the four-bit
    codes of the rows at home are scanned by tables of 16 entries per subspace and query; a row is ranked by its exact similarity, in the
    same task, if its score is within z standard deviations of its code's error of what the k + 1 surest rows of the task reach.  There is no limit
    on a query's candidates, and a task gives k + 1 rows a query.  Equal vectors are indexed once, by their smallest key, and bring their first k + 1 keys,
    which is all that k places can hold; ties go to the smaller key.
    """
    spark = vectors.sparkSession
    fitted = fit_index(vectors, key, vec, dim, seed, rows_per_cell)
    if fitted is None:
        return spark.createDataFrame([], "key long, neighbour long, similarity double, rank int")
    index, sample = fitted
    some = sample[: min(256, len(sample) // 2)]
    n_cells = 1
    if len(some):
        rest = sample[len(some) :]
        near, _ = best(some @ rest.T, k)
        n_cells = measured_probes(index, np.repeat(some, near.shape[1], 0), rest[near.ravel()], recall, False)
    firsts, members = distinct_vectors(index_rows(vectors, key, vec, index, 1, True))
    asked = index_rows(queries, key, vec, index, n_cells, True).dropDuplicates(["key"])
    shared = spark.sparkContext.broadcast(index)
    columns = ["key", "code", "err", "vec"]

    def scan(t: pa.Table) -> pa.Table:
        ix = shared.value
        m = len(ix.codebook)
        key_, vec_, valid = t.column("key").to_numpy(), t.column("vec"), t.column("cell").is_valid().to_numpy()
        d, q = np.flatnonzero(valid), np.flatnonzero(~valid)
        a, b, s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(d) and len(q):
            x = unpack(vec_.take(pa.array(d)).to_pylist(), ix.dim)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            codes = np.ascontiguousarray(unpack_codes(np.frombuffer(b"".join(t.column("code").take(pa.array(d)).to_pylist()), np.uint8).reshape(len(d), -1)).T).astype(np.intp)
            slack = (z * t.column("err").to_numpy()[d] / math.sqrt(ix.dim))[None, :]
            keep = min(k + 1, len(d))
            for i in range(0, len(q), 256):
                u = unit(unpack(vec_.take(pa.array(q[i : i + 256])).to_pylist(), ix.dim))
                parts = np.ascontiguousarray(u.reshape(len(u), m, SUB).transpose(1, 2, 0))
                tables = np.rint(ix.codebook @ parts * SCALE).astype(np.int16)
                score = np.empty((len(d), len(u)), np.float32)
                for lo in range(0, len(d), 1024):
                    sums, buffer = np.empty((2, len(d[lo : lo + 1024]), len(u)), np.int16)
                    scan_tables(tables.__getitem__, codes[:, lo : lo + 1024], range(m), sums, buffer)
                    score[lo : lo + 1024] = sums
                score = score.T / SCALE
                least = -np.partition(slack - score, keep - 1, axis=1)[:, keep - 1]
                for j in range(len(u)):
                    c = np.flatnonzero(score[j] + slack[0] >= least[j])
                    true = x[c] @ u[j]
                    c = c[np.argsort(-true, kind="stable")]
                    true = np.sort(true)[::-1]
                    # ties with the last place stay, so that the smaller keys win in the end
                    n = np.searchsorted(-true, -true[keep - 1] + 1e-6, "right") if len(true) >= keep else len(true)
                    a.append(np.full(n, key_[q[i + j]]))
                    b.append(key_[d[c[:n]]])
                    # what is ranked is exact: double precision of the whole vectors
                    y = x[c[:n]].astype(np.float64)
                    s.append(y @ u[j].astype(np.float64) / (np.linalg.norm(y, axis=1) * np.linalg.norm(u[j].astype(np.float64))))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b), "similarity": np.concatenate(s)})

    homes = _at_home(firsts.select("home", *columns), index)
    visitors = asked.select(F.inline("visits"), *columns)
    found = in_tasks(cut(homes, "homes"), cut(visitors, "visitors"), columns).groupBy("shelf", "block", "guests").applyInArrow(scan, "a long, b long, similarity double")
    order = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
    ranked = found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k + 1).drop("_n")
    few = members.withColumn("_n", F.row_number().over(Window.partitionBy("rep").orderBy("key"))).filter(F.col("_n") <= k + 1)
    full = ranked.join(few.select(F.col("rep").alias("b"), F.col("key").alias("neighbour")), "b").filter("a != neighbour")
    order = Window.partitionBy("a").orderBy(F.desc("similarity"), "neighbour")
    full = full.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return full.select(F.col("a").alias("key"), "neighbour", "similarity", "rank")
