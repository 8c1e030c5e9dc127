"""Block join: the one way this package meets queries with library spectra.

Both sides are cut into blocks and every (left block, right block) cell is one bounded
task.  Blocks are as large as a task can hold (``BLOCK_TILES`` tiles of ``cell`` rows),
so each row is copied to few cells; inside its task a cell is scored tile by tile with
numpy and emits only its reduction (k best per query, or per-query sums), so no pair
stream is ever shuffled.  An optional bucket (say a precursor-mass band) limits which
rows can meet; a bucket that holds a large share of all rows is cut into more cells
instead of growing one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import distances as D
from ..functions.ragged import Batch
from ..functions.screen import Rows, Screen, shared_planes

CELL = 512
#: Tiles of one block: 65,536 rows at the default cell, 100 to 200 MB of peak lists a side.
BLOCK_TILES = 128
#: Tables of reduced rows of one tile that wait for a merge.
PENDING = 32


def _block_counts(n_left: int, n_right: int, cores: int, cell: int, upper_only: bool = False):
    """Blocks per side: as few as memory allows, as every row travels once per block of the other
    side, but a cell for every core.  Of the shapes whose rounds of ``cores`` cells leave at most a
    fifth of the cores idle, the one that copies the fewest rows."""
    block = BLOCK_TILES * cell
    nl, nr = max(1, -(-n_left // block)), max(1, -(-n_right // block))
    if upper_only:  # both sides have the same blocks, and n of them make n * (n + 1) / 2 cells
        least = math.ceil((math.sqrt(8 * cores + 1) - 1) / 2)
        n = max(nl, nr, min(least, n_left // 16))
        return n, n
    if nl * nr < cores:
        shapes = [(x, y) for x in range(nl, max(nl, n_left // 16, 1) + 1) if x <= 2 * cores
                  for y in range(nr, max(nr, n_right // 16, 1) + 1) if cores <= x * y <= 2 * cores]
        if shapes:
            idle = {xy: 1 - xy[0] * xy[1] / (cores * math.ceil(xy[0] * xy[1] / cores)) for xy in shapes}
            most = max(0.2, min(idle.values()))
            return min((xy for xy in shapes if idle[xy] <= most), key=lambda xy: (n_left * xy[1] + n_right * xy[0], xy))
        nl, nr = max(nl, n_left // 16), max(nr, n_right // 16)
    return nl, nr


def _block_of(n_blocks, *keys):
    return F.pmod(F.xxhash64(*keys), n_blocks).cast("int")


def cells(left: DataFrame, right: DataFrame, cell: int = CELL, upper_only: bool = False):
    """Deal both sides to numbered cells: (left, right, number of cells), the number of a row's
    cell in ``_cell``.  With ``upper_only`` both sides have the same blocks and only cells of
    the upper triangle exist, the diagonal cell of block j at j * (j + 3) / 2."""
    n_left = left.count()
    n_right = n_left if upper_only else right.count()
    nl, nr = _block_counts(n_left, n_right, left.sparkSession.sparkContext.defaultParallelism, cell, upper_only)
    lb = left.withColumn("_lb", _block_of(F.lit(nl), "q_pos", "query_id"))
    rb = right.withColumn("_rb", _block_of(F.lit(nr), "l_pos", "library_id"))
    first = F.col("_lb") if upper_only else F.lit(0)
    lb = lb.withColumn("_rb", F.explode(F.sequence(first, F.lit(nr - 1))))
    last = F.col("_rb") if upper_only else F.lit(nl - 1)
    rb = rb.withColumn("_lb", F.explode(F.sequence(F.lit(0), last)))
    number = F.expr("_rb * (_rb + 1) div 2 + _lb" if upper_only else f"_rb * {nl} + _lb").cast("int")
    lb, rb = (x.withColumn("_cell", number).drop("_lb", "_rb") for x in (lb, rb))
    return lb, rb, nr * (nr + 1) // 2 if upper_only else nl * nr


def bucket_cells(left: DataFrame, right: DataFrame, bucket: str, cell: int = CELL):
    """Deal both sides to cells inside their bucket: (left, right, key columns).  Blocks per bucket
    follow from its row counts on either side; one of several tiles is cut in two at least."""
    def blocks(n):
        return F.greatest(F.ceil(n / (BLOCK_TILES * cell)), F.least(F.lit(2), F.ceil(n / cell))).cast("int")

    size = (left.groupBy(bucket).agg(F.count("*").alias("n_l"))
            .join(right.groupBy(bucket).agg(F.count("*").alias("n_r")), bucket)
            .select(bucket, blocks(F.col("n_l")).alias("_nl"), blocks(F.col("n_r")).alias("_nr")))
    lb = (left.join(size, bucket).withColumn("_lb", _block_of(F.col("_nl"), "q_pos", "query_id"))
          .withColumn("_rb", F.explode(F.sequence(F.lit(0), F.col("_nr") - 1))).drop("_nl", "_nr"))
    rb = (right.join(size, bucket).withColumn("_rb", _block_of(F.col("_nr"), "l_pos", "library_id"))
          .withColumn("_lb", F.explode(F.sequence(F.lit(0), F.col("_nl") - 1))).drop("_nl", "_nr"))
    return lb, rb, [bucket, "_lb", "_rb"]


def _column(table, name):
    return table.column(name).combine_chunks()


def _values(table, name):
    """Numeric column as float64 with NULL as NaN; text as an object array."""
    col = table.column(name)
    if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
        return np.array(col.to_pylist(), dtype=object)
    return col.to_numpy().astype(np.float64)


def channel_columns(df: DataFrame) -> list:
    """Array-of-peaks columns among ``df``'s columns."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)
            and isinstance(f.dataType.elementType, T.StructType) and "mz" in f.dataType.elementType.names]


def _split_peaks(df: DataFrame) -> DataFrame:
    """Peak lists as two plain arrays each: half the bytes of arrays of structs in a shuffle."""
    channels = channel_columns(df)
    return df.select(*[F.col(c) for c in df.columns if c not in channels],
                     *[F.col(f"{c}.{x}").alias(f"{c}__{x}") for c in channels for x in ("mz", "intensity")])


def _join_peaks(table, channels):
    """The peak lists of ``_split_peaks`` as list columns again; a missing list is empty."""
    for c in channels:
        mz, it = (_column(table, f"{c}__{x}") for x in ("mz", "intensity"))
        if isinstance(mz, pa.ChunkedArray):  # no chunk at all
            mz, it = pa.array([], mz.type), pa.array([], it.type)
        off = mz.offsets.to_numpy()
        peaks = pa.StructArray.from_arrays([mz.flatten(), it.flatten()], names=["mz", "intensity"])
        table = table.append_column(c, pa.ListArray.from_arrays(pa.array(off - off[0], pa.int32()), peaks))
    return table.drop_columns([f"{c}__{x}" for c in channels for x in ("mz", "intensity")])


def _tiles(table, cell, channels):
    return [_join_peaks(table.slice(s, cell).combine_chunks(), channels) for s in range(0, table.num_rows, cell)]


def tile_apply(lt, rt, reduce_cell, cell, channels, merge=None, diagonal=False, scorer=None, strip=None):
    """Reduced tables of a cell, tile by tile.  ``merge`` reduces the rows of one left tile further.

    On the ``diagonal`` both sides hold the same rows: sorted alike, tile a of the left meets
    tiles a and above of the right.  A ``scorer`` may open the cell, so that its tiles are laid on
    one grid once; ``strip(session, a, tile, right tiles)`` then reduces a whole left tile at a time.
    """
    if diagonal:
        lt = lt.sort_by([("q_pos", "ascending"), ("query_id", "ascending")])
        rt = rt.sort_by([("l_pos", "ascending"), ("library_id", "ascending")])
    left, right = _tiles(lt, cell, channels), _tiles(rt, cell, channels)
    del lt, rt
    session = scorer.open(left, right) if scorer is not None else None
    if session is not None:
        left, right = ([t.drop_columns(channels) for t in x] for x in (left, right))
        session.number(left, right)
    for a, x in enumerate(left):
        waiting = []
        if strip is not None and (session is not None or getattr(strip, "always", False)):
            out = strip(session, a, x, [(b, right[b]) for b in range(a if diagonal else 0, len(right))])
            yield from out if getattr(strip, "always", False) else (out,)
            continue
        for y in right[a if diagonal else 0:]:
            out = reduce_cell(x, y)
            if merge is None:
                yield out
                continue
            waiting.append(out)
            if len(waiting) == PENDING:
                waiting = [merge(pa.concat_tables(waiting))]
        if waiting:
            yield merge(pa.concat_tables(waiting)) if len(waiting) > 1 else waiting[0]


def block_apply(left: DataFrame, right: DataFrame, reduce_cell, schema, cell: int = CELL,
                bucket: str | None = None, upper_only: bool = False, merge=None, scorer=None, strip=None) -> DataFrame:
    """Run ``reduce_cell(left_table, right_table) -> arrow table`` on every pair of tiles.

    ``merge(table) -> table`` combines reduced rows of one left tile, so that a cell emits
    as much as one tile would.  Without it rows go out as they come.  ``scorer`` and ``strip``
    are as in ``tile_apply``.
    """
    channels = channel_columns(left)
    left, right = _split_peaks(left), _split_peaks(right)
    if bucket is not None:
        return _bucket_apply(left, right, reduce_cell, schema, cell, bucket, merge, channels, scorer, strip)
    lb, rb, n_cells = cells(left, right, cell, upper_only)
    corners = {j * (j + 3) // 2 for j in range(n_cells)} if upper_only else set()

    def packed(df, mine, other, other_schema):
        columns = [c for c in df.columns if c != "_cell"]
        return df.select("_cell", F.struct(*columns).alias(mine), F.lit(None).cast(other_schema).alias(other)).select("_cell", "_l", "_r")

    l_type, r_type = left.schema, right.schema
    both = packed(lb, "_l", "_r", r_type).unionByName(packed(rb, "_r", "_l", l_type)).repartitionById(n_cells, "_cell")

    def run(batches):
        parts = {}  # one cell, as the partition is its own
        for batch in batches:
            numbers = batch.column("_cell")
            for no in numbers.unique().to_pylist():
                here = batch.filter(pc.equal(numbers, no))
                for side, rows in zip(("_l", "_r"), parts.setdefault(no, ([], []))):
                    x = here.column(side)
                    x = x.filter(x.is_valid())
                    if len(x):
                        rows.append(pa.RecordBatch.from_struct_array(x))
        while parts:
            no, rows = parts.popitem()
            if all(rows):
                tables = [pa.Table.from_batches(x) for x in rows]
                del rows
                for out in tile_apply(*tables, reduce_cell, cell, channels, merge, no in corners, scorer, strip):
                    yield from out.combine_chunks().to_batches()

    return both.mapInArrow(run, schema)


#: Distances of one strip of whole rows.
ROW_VALUES = 1 << 22


def row_apply(left: DataFrame, right: DataFrame, strip, schema, scorer, cell: int = 2048) -> DataFrame:
    """Run ``strip(distances, left tile, right tiles, kept) -> arrow table`` on whole rows: every task meets all of
    the right side, in order of position, with its share of the left side.

    The right side travels once per core and is held by each task, some 2 KB a spectrum of 64 peaks; of the pairs
    only ``ROW_VALUES`` are held at a time.  ``kept`` is a dict of the task.
    """
    channels = channel_columns(left)
    left, right = _split_peaks(left), _split_peaks(right)
    n_right, cores = right.count(), left.sparkSession.sparkContext.defaultParallelism
    rows = max(1, min(CELL, ROW_VALUES // max(n_right, 1)))
    l_type, r_type = left.schema, right.schema

    def packed(df, mine, other, other_schema, numbers):
        return df.select(numbers.alias("_cell"), F.struct(*df.columns).alias(mine), F.lit(None).cast(other_schema).alias(other)).select("_cell", "_l", "_r")

    # the next rows of a task would wait for its last ones: a block of the left side is one task
    both = packed(left, "_l", "_r", r_type, _block_of(F.lit(cores), "q_pos", "query_id")).unionByName(
        packed(right, "_r", "_l", l_type, F.explode(F.sequence(F.lit(0), F.lit(cores - 1))))).repartitionById(cores, "_cell")

    def run(batches):
        sides_ = [], []
        for batch in batches:
            for side, found in zip(("_l", "_r"), sides_):
                x = batch.column(side)
                x = x.filter(x.is_valid())
                if len(x):
                    found.append(pa.RecordBatch.from_struct_array(x))
        if not all(sides_):
            return
        lt, rt = (pa.Table.from_batches(x) for x in sides_)
        del sides_
        rt = rt.sort_by([("l_pos", "ascending"), ("library_id", "ascending")])
        x_tiles, y_tiles = _tiles(lt, rows, channels), _tiles(rt, cell, channels)
        del lt, rt
        session = scorer.open(x_tiles, y_tiles)
        if session is not None:
            x_tiles, y_tiles = ([t.drop_columns(channels) for t in x] for x in (x_tiles, y_tiles))
            session.number(x_tiles, y_tiles)
        kept = {}
        for x in x_tiles:
            out = strip(lambda: np.concatenate([scorer.distance(x, y) for y in y_tiles], 1), x, y_tiles, kept)  # noqa: B023
            yield from out.combine_chunks().to_batches()

    return both.mapInArrow(run, schema)


def same_key(x, rights, left, right, kept):
    """Matrix: value of column ``left`` equals that of ``right``; a missing value equals nothing."""
    if right not in kept:
        every = pa.concat_arrays([t.column(right).combine_chunks().cast(pa.string()) for t in rights]).dictionary_encode()
        kept[right] = every.dictionary, every.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    names, codes = kept[right]
    mine = pc.index_in(x.column(left).combine_chunks().cast(pa.string()), value_set=names).fill_null(-2).to_numpy(zero_copy_only=False)
    return mine[:, None] == codes[None, :]


def in_order(dist, relevant, usable):
    """(row, 0-based rank, entries per row) of the relevant entries among the usable ones, by (distance, column);
    distances that aren't finite come last."""
    n, m = dist.shape
    bits = int(m).bit_length()
    finite = np.isfinite(dist)
    top = 1 << 44
    if bits <= 18 and np.abs(np.where(finite, dist, 0.0)).max(initial=0) < 1.7:  # distances carry 13 decimals: one integer holds all
        key = np.where(finite, np.rint(np.where(finite, dist, 0.0) * 1e13), top - 1).astype(np.int64)
        key <<= bits + 1
        key |= (np.arange(m) << 1)[None, :]
        key |= relevant
        key[~usable] = np.iinfo(np.int64).max - 1
        key.sort(axis=1)
        hit = (key & 1).astype(bool)
    else:
        order = np.argsort(np.where(finite, dist, np.inf), axis=1, kind="stable")
        hit, use = (np.take_along_axis(v, order, 1) for v in (relevant & usable, usable))
        back = np.argsort(~use, axis=1, kind="stable")
        hit = np.take_along_axis(hit, back, 1)
    return *np.nonzero(hit), usable.sum(1)


def _bucket_apply(left, right, reduce_cell, schema, cell, bucket, merge, channels, scorer=None, strip=None) -> DataFrame:
    lb, rb, keys = bucket_cells(left, right, bucket, cell)

    def run(lt, rt):
        if lt.num_rows == 0 or rt.num_rows == 0:
            return empty_table(schema)
        return pa.concat_tables(tile_apply(lt, rt, reduce_cell, cell, channels, merge, False, scorer, strip))

    # a fixed partition number: cells are small in bytes but heavy in CPU, so they
    # must not be coalesced by size
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lb, rb = lb.repartition(n, *keys), rb.repartition(n, *keys)
    return lb.groupBy(*keys).cogroup(rb.groupBy(*keys)).applyInArrow(run, schema)


def fold(keys, **how):
    """Merge rows of equal ``keys``; ``how`` names sum, min or max per column."""
    def merge(table):
        out = table.group_by(list(keys)).aggregate(list(how.items()))
        return out.rename_columns([*keys, *how]).select(table.column_names)
    return merge


_ARROW = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "int": pa.int32(),
          "bigint": pa.int64(), "boolean": pa.bool_()}


def _fields(schema: str):
    return [part.strip().split(" ")[:2] for part in schema.split(",")]


def empty_table(schema: str):
    return pa.table({n: pa.array([], _ARROW[t]) for n, t in _fields(schema)})


def to_table(schema: str, columns: dict):
    return pa.table({n: pa.array(columns[n], _ARROW[t]) for n, t in _fields(schema)})


def sides(queries: DataFrame, library: DataFrame, channels, q_extra=(), l_extra=()):
    """Rename id/pos of both sides and keep only what a cell needs."""
    q = queries.select(F.col("id").cast("string").alias("query_id"), F.col("pos").cast("long").alias("q_pos"),
                       *[F.col(c).alias(c) for c in channels],
                       *[F.col(c).alias(f"q_{c}") for c in q_extra])
    lib = library.select(F.col("id").cast("string").alias("library_id"),
                         F.col("pos").cast("long").alias("l_pos"),
                         *[F.col(c).alias(c) for c in channels],
                         *[F.col(c).alias(f"l_{c}") for c in l_extra])
    return q, lib


class Scorer:
    """Distances of one cell: fragment channel alone or the combined distance."""

    def __init__(self, params, method: str | None = None, fragment_only: bool = False,
                 use_conf: bool = False):
        self.p, self.fragment_only, self.use_conf = params, fragment_only, use_conf
        self.method = D.check_method(method or params.distance_method)
        self.session = None

    def open(self, left, right):
        """A session over the tiles of a cell, or None where they don't share a grid."""
        self.session = None
        exact = self.method != "ppm_wasserstein" or (self.p.ot_method or "exact") in ("exact", "exact_sparse")
        if exact and left and right:
            self.session = Session.over(self, left, right)
        return self.session

    def channels(self) -> list:
        p = self.p
        if self.fragment_only:
            return ["frag"]
        out = ["frag"] + (["loss_anchor", "loss_pair"] if p.use_split_loss else ["loss"])
        if p.use_typical_loss:
            out += ["loss_anchor_typ", "loss_pair_typ"] if p.use_split_loss else ["loss_typ"]
        return out

    def extra(self) -> list:
        return ["mref_confidence"] if (self.p.use_mref_confidence and not self.fragment_only) else []

    def components(self, lt, rt, mask=None) -> dict:
        if self.session is not None:
            return self.session.components(*self.session.at(lt, rt))
        a = {c: Batch.from_arrow(_column(lt, c)) for c in self.channels()}
        b = {c: Batch.from_arrow(_column(rt, c)) for c in self.channels()}

        def score(x, y):
            return D.matrix_distances(x, y, self.method, self.p, mask)

        if self.fragment_only:
            return {"distance": score(a["frag"], b["frag"])}
        conf = None
        if self.extra():
            conf = (_values(lt, "q_mref_confidence"), _values(rt, "l_mref_confidence"))
        return D.combine_blocks(score, a, b, self.p, conf)

    def distance(self, lt, rt, mask=None):
        """Distances at 13 decimals: equal spectra tie exactly whichever kernel or block
        shape scored them, so ties fall to library position everywhere."""
        if self.session is not None:
            a, b = self.session.at(lt, rt)
            if mask is None or mask.mean() > self.session.share:
                return self.session.dense(a, b)
            out = np.ones(mask.shape)
            rows, cols = np.nonzero(mask)
            out[rows, cols] = self.session.exact(a, b, rows, cols)
            return out
        return np.round(self.components(lt, rt, mask)["distance"], 13)


class Session:
    """A scorer over the tiles of one cell, laid on one grid per channel: bounds, exact values of chosen
    pairs, and whole tiles."""

    def __init__(self, scorer, screens, left, right, conf):
        self.scorer, self.screens, self.left, self.right, self.conf = scorer, screens, left, right, conf
        #: Above this share of its pairs a tile is cheaper scored as a whole.
        self.share = 0.5 if scorer.method.startswith("entropy") else 0.2 if scorer.method == "composite" else 0.05
        self.kept = {}

    @classmethod
    def over(cls, scorer, left, right):
        p, screens, planes = scorer.p, {}, ([{} for _ in left], [{} for _ in right])
        reach = p.tol_ppm * max(1, p.wasserstein_transition_mult) if scorer.method == "ppm_wasserstein" else p.tol_ppm
        for c in scorer.channels():
            batches = [Batch.from_arrow(_column(t, c)) for t in (*left, *right)]
            found = shared_planes(batches, reach)
            del batches
            if found is None:
                return None
            screens[c] = Screen(*found, scorer.method, p)
            for side, x in zip([*planes[0], *planes[1]], found[1]):
                side[c] = x
        conf = ([_values(t, "q_mref_confidence") for t in left], [_values(t, "l_mref_confidence") for t in right]) if scorer.extra() else None
        return cls(scorer, screens, *planes, conf)

    def number(self, left, right):
        self.tables = left, right
        self.numbers = {id(t): i for x in (left, right) for i, t in enumerate(x)}

    def at(self, lt, rt):
        return self.numbers[id(lt)], self.numbers[id(rt)]

    def ids(self):
        """Ids of the right tiles as one array, and where each tile begins."""
        if "ids" not in self.kept:
            parts = [t.column("library_id").combine_chunks().cast(pa.string()) for t in self.tables[1]]
            self.kept["ids"] = pa.concat_arrays(parts), np.cumsum([0, *(len(x) for x in parts)])
        return self.kept["ids"]

    def _pair(self, a, b):
        return self.left[a], self.right[b]

    def lower(self, a, b):
        x, y = self._pair(a, b)
        score = lambda c: self.screens[c].lower(x[c], y[c])
        if self.scorer.fragment_only:
            return score("frag")
        conf = None if self.conf is None else (self.conf[0][a].astype(np.float32), self.conf[1][b].astype(np.float32))
        d = self._combined(x, y, conf, score)["distance"]
        return np.asarray(d, np.float32) * np.float32(1 - 1e-5) - np.float32(2e-5)

    def _combined(self, x, y, conf, score, **how):
        """``score(channel)`` of every channel, put together as ``combine_blocks`` does."""
        a, b = ({c: _Named(c, v.sizes) for c, v in side.items()} for side in (x, y))
        return D.combine_blocks(lambda u, v: score(u.name), a, b, self.scorer.p, conf, **how)

    def exact(self, a, b, rows, cols):
        x, y = ({c: Rows(v, at) for c, v in side.items()} for side, at in zip(self._pair(a, b), (rows, cols)))
        score = lambda c: self.screens[c].exact_rows(x[c], y[c])
        if self.scorer.fragment_only:
            return np.round(score("frag"), 13)
        conf = None if self.conf is None else (self.conf[0][a][rows], self.conf[1][b][cols])
        return np.round(self._combined(x, y, conf, score, confidence=D._row_confidence, meet=D._row_meet)["distance"], 13)

    def components(self, a, b):
        x, y = self._pair(a, b)
        score = lambda c: self.screens[c].dense(x[c], y[c])
        if self.scorer.fragment_only:
            return {"distance": score("frag")}
        conf = None if self.conf is None else (self.conf[0][a], self.conf[1][b])
        return self._combined(x, y, conf, score)

    def dense(self, a, b):
        return np.round(self.components(a, b)["distance"], 13)

    def chosen(self, a, b, rows, cols):
        """Exact values of the chosen pairs, by whichever way is cheaper."""
        n = len(self.tables[0][a]) * len(self.tables[1][b])
        return self.dense(a, b)[rows, cols] if len(rows) > self.share * n else self.exact(a, b, rows, cols)

    def codes(self, left, right):
        """Columns ``left`` and ``right`` of both sides as codes that are equal where the values are, by tile."""
        if (left, right) not in self.kept:
            parts = [t.column(n).combine_chunks().cast(pa.string()) for x, n in zip(self.tables, (left, right)) for t in x]
            code = pa.concat_arrays(parts).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            codes = np.split(code, np.cumsum([len(x) for x in parts])[:-1])
            self.kept[left, right] = codes[:len(self.tables[0])], codes[len(self.tables[0]):]
        return self.kept[left, right]


class Several:
    """Scorers of one method and different weights, opened over the same planes."""

    def __init__(self, scorers):
        self.scorers, self.p, self.method, self.fragment_only = scorers, scorers[0].p, scorers[0].method, False

    def channels(self) -> list:
        return list(dict.fromkeys(c for s in self.scorers for c in s.channels()))

    def extra(self) -> list:
        return list(dict.fromkeys(c for s in self.scorers for c in s.extra()))

    def open(self, left, right):
        base = Session.over(self, left, right) if left and right else None
        self.sessions = [None if base is None else Session(s, base.screens, base.left, base.right, base.conf) for s in self.scorers]
        for s, session in zip(self.scorers, self.sessions):
            s.session = session
        return None if base is None else self

    def number(self, left, right):
        for s in self.sessions:
            s.number(left, right)


class _Named:
    def __init__(self, name, sizes):
        self.name, self.sizes = name, sizes


HIT_SCHEMA = "query_id string, q_pos long, library_id string, l_pos long, distance double"


def best_k(dist, l_pos, k):
    """Row-wise k smallest finite entries, ties by library position."""
    ok = np.isfinite(dist)
    full = np.flatnonzero(ok.sum(1) > k)
    if len(full):
        sub = np.where(ok[full], dist[full], np.inf)
        cut = np.partition(sub, k - 1, axis=1)[:, k - 1:k]
        ok[full] &= sub <= cut  # keeps every tie at the cut
    rows, cols = np.nonzero(ok)
    order = np.lexsort((l_pos[cols], dist[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    start = np.searchsorted(rows, np.arange(len(dist)))
    keep = np.arange(len(rows)) - start[rows] < k
    return rows[keep], cols[keep]


#: Longest list that is held beside a strip; longer ones are reduced tile by tile.
LONGEST = 128


def best_strip(session, a, x, rights, k, apart=None, gate=None, alike=None):
    """``k`` best of every row of left tile ``a`` over the right tiles, of pairs that differ in the columns
    ``apart`` and agree in the columns ``alike`` (one of each side).

    The k-th distance of a row so far is its limit: only pairs whose lower bound isn't above it are scored.
    """
    n, last = x.num_rows, np.iinfo(np.int64).max
    limit = np.full(n, np.inf)
    best, where = np.full((n, k), np.inf), np.zeros((n, k), np.int64)
    pos = np.full((n, k), last)
    names, first = session.ids()
    l_code, r_code = session.codes(*apart) if apart else (None, None)
    l_key, r_key = session.codes(*alike) if alike else (None, None)
    for b, y in rights:
        low = session.lower(a, b)
        m = low.shape[1]
        if gate is not None:
            low[~gate(x, y)] = np.inf
        if alike:
            low[l_key[a][:, None] != r_key[b][None, :]] = np.inf
        fresh = np.flatnonzero(np.isinf(limit)) if m >= k else limit[:0]
        if len(fresh):  # the k that look nearest give a first limit
            sub = low[fresh]
            if apart:
                sub[l_code[a][fresh][:, None] == r_code[b][None, :]] = np.inf
            at = np.argpartition(sub, k - 1, axis=1)[:, :k]
            some = np.isfinite(np.take_along_axis(sub, at, 1)).all(1)
            fresh, at = fresh[some], at[some]
            if len(fresh):
                limit[fresh] = session.exact(a, b, np.repeat(fresh, k), at.ravel()).reshape(-1, k).max(1)
                limit[np.isnan(limit)] = np.inf
        top = np.nextafter(limit.astype(np.float32), np.float32(np.inf))
        found = np.flatnonzero(low <= top[:, None])
        rows, cols = np.divmod(found, m)
        keep = np.isfinite(low[rows, cols])
        if apart:
            keep &= l_code[a][rows] != r_code[b][cols]
        rows, cols = rows[keep], cols[keep]
        if not len(rows):
            continue
        d = session.chosen(a, b, rows, cols)
        keep = np.isfinite(d) & (d <= limit[rows])
        rows, cols, d = rows[keep], cols[keep], d[keep]
        l_pos = y.column("l_pos").fill_null(last).to_numpy()[cols]
        hit, r = np.unique(rows, return_inverse=True)
        every = np.concatenate([np.repeat(np.arange(len(hit)), k), r])
        values = [np.concatenate([old[hit].ravel(), new]) for old, new in ((best, d), (pos, l_pos), (where, first[b] + cols))]
        order = np.lexsort((values[1], values[0], every))
        every = every[order]
        order = order[np.arange(len(every)) - np.searchsorted(every, np.arange(len(hit)))[every] < k]
        for old, new in zip((best, pos, where), values):
            old[hit] = new[order].reshape(-1, k)
        limit[hit] = np.minimum(limit[hit], best[hit, k - 1])
    rows, cols = np.nonzero(np.isfinite(best))
    l_pos = pa.array(pos[rows, cols], mask=pos[rows, cols] == last)
    return to_table(HIT_SCHEMA, {
        "query_id": x.column("query_id").combine_chunks().take(pa.array(rows)),
        "q_pos": x.column("q_pos").combine_chunks().take(pa.array(rows)),
        "library_id": names.take(pa.array(where[rows, cols])), "l_pos": l_pos, "distance": best[rows, cols]})


def hits_table(lt, rt, dist, rows, cols):
    return to_table(HIT_SCHEMA, {
        "query_id": lt.column("query_id").combine_chunks().take(pa.array(rows)),
        "q_pos": lt.column("q_pos").combine_chunks().take(pa.array(rows)),
        "library_id": rt.column("library_id").combine_chunks().take(pa.array(cols)),
        "l_pos": rt.column("l_pos").combine_chunks().take(pa.array(cols)),
        "distance": dist[rows, cols]})


def keep_best(k):
    """Merge hits: the ``k`` first rows per query by (distance, library position)."""
    low = np.iinfo(np.int64).min

    def merge(t):
        q, pos = (t.column(c).fill_null(low).to_numpy() for c in ("q_pos", "l_pos"))
        name = t.column("query_id").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        order = np.lexsort((pos, t.column("distance").to_numpy(), name, q))
        head = np.ones(len(order), bool)
        head[1:] = (q[order[1:]] != q[order[:-1]]) | (name[order[1:]] != name[order[:-1]])
        first = np.flatnonzero(head)
        rank = np.arange(len(order)) - first[np.cumsum(head) - 1]
        return t.take(pa.array(order[rank < k]))
    return merge


def equal_matrix(left, right):
    """(equal, missing) boolean matrices of two text columns, compared as integer codes."""
    both = pa.concat_arrays([left.combine_chunks().cast(pa.string()), right.combine_chunks().cast(pa.string())])
    code = both.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    x, y = code[:len(left)], code[len(left):]
    return x[:, None] == y[None, :], (x < 0)[:, None] | (y < 0)[None, :]


def same_id_mask(lt, rt):
    return equal_matrix(lt.column("query_id"), rt.column("library_id"))[0]


def band_scale(library: DataFrame, axis, window: float, cell: int = CELL, knots: int = 16):
    """A monotone map from the axis to band numbers that puts about ``cell`` library rows
    in each band, with no band narrower than the window.

    Piecewise linear between ``knots`` quantiles, so the map is a small expression
    however large the library is.  Correctness needs only that it is monotone.
    """
    r = library.agg(F.percentile_approx(axis, F.array(*[F.lit(i / knots) for i in range(knots + 1)]), F.lit(10000)).alias("q"),
                    F.count(axis).alias("n")).first()
    cuts = sorted(set(r["q"] or []))
    bands = max(1.0, r["n"] / cell)
    total = None
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        share = sum(1 for v in r["q"][1:] if lo < v <= hi) / knots
        slope = min(share * bands / (hi - lo), 1.0 / window)
        part = (lambda x, lo=lo, hi=hi, slope=slope:
                (F.least(F.greatest(x, F.lit(lo)), F.lit(hi)) - F.lit(lo)) * F.lit(slope))
        total = part if total is None else (lambda x, f=total, g=part: f(x) + g(x))
    return (lambda x: F.floor(total(x))) if total is not None else (lambda x: F.lit(0).cast("long"))


def into_bands(queries: DataFrame, library: DataFrame, axis, window: float, cell: int = CELL):
    """Library rows sit in one band; a query visits every band its window touches, so each
    pair within the window meets exactly once."""
    band = band_scale(library, axis, window, cell)
    q = queries.withColumns({"_lo": axis - window, "_hi": axis + window})
    q = q.withColumns({"_lo": band(F.col("_lo")), "_hi": band(F.col("_hi"))})
    lib = library.withColumn("_x", axis).withColumn("band", band(F.col("_x"))).drop("_x")
    return q.withColumn("band", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi"), lib


def into_tight_bands(queries: DataFrame, library: DataFrame, axis, window: float):
    """Equal-width bands of the window size, for a relational join."""
    low, high = F.floor((axis - window) / window), F.floor((axis + window) / window)
    return (queries.withColumn("band", F.explode(F.sequence(low, high))),
            library.withColumn("band", F.floor(axis / window)))


def rank_hits(df: DataFrame, k: int | None, value: str = "distance") -> DataFrame:
    """Rank by (value, library position) per query and keep k."""
    w = Window.partitionBy("query_id", "q_pos").orderBy(value, "l_pos")
    out = df.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.filter(F.col("rank") <= k)


#: Columns in which a pair must differ, by ``exclude_self``.
APART = {True: ("query_id", "library_id"), "pos": ("q_pos", "l_pos")}


def nearest(queries: DataFrame, library: DataFrame, scorer: Scorer, k: int, exclude_self: bool | str = False,
            gate=None, gate_columns=(), bucket: str | None = None, cell: int = CELL) -> DataFrame:
    """k nearest library spectra per query.

    ``gate(left_table, right_table) -> bool matrix`` removes pairs before scoring; ``exclude_self``
    leaves out pairs of one id, or of one position if it is "pos".
    Each cell emits at most k rows per query, so the shuffle into the final window
    is (library blocks x k) rows per query at most.  ``bucket`` limits which rows meet.
    """
    extra = scorer.extra() + list(gate_columns)
    if bucket is None:
        q, lib = sides(queries, library, scorer.channels(), extra, extra)
    else:
        q, lib = sides(queries, library, scorer.channels() + [bucket], extra, extra)

    def reduce_cell(lt, rt):
        mask = gate(lt, rt) if gate is not None else None
        if exclude_self:
            other = ~same_id_mask(lt, rt) if exclude_self is True else lt.column("q_pos").to_numpy()[:, None] != rt.column("l_pos").to_numpy()
            mask = other if mask is None else mask & other
        if mask is not None and not mask.any():
            return empty_table(HIT_SCHEMA)
        d = scorer.distance(lt, rt, mask)
        if mask is not None:
            d = np.where(mask, d, np.inf)
        rows, cols = best_k(d, rt.column("l_pos").to_numpy(), k)
        return hits_table(lt, rt, d, rows, cols)

    def strip(session, a, x, rights):
        return best_strip(session, a, x, rights, k, APART.get(exclude_self), gate)

    return rank_hits(block_apply(q, lib, reduce_cell, HIT_SCHEMA, cell, bucket, merge=keep_best(k), scorer=scorer,
                                 strip=strip if k <= LONGEST else None), k)
