"""How five text filters interact, in every order, with exact duplicates found by radix tries over full texts.

1. Bounds: text heads are counted, 8 characters long; heads that hold too many rows are lengthened in rounds, so
   that texts with a common beginning are told apart too. A bounded sample of the heads, weighted by their rows,
   gives the bounds of the ranges; they decide where a text is handled, never its result.
2. Filters A to D are evaluated on each text in its map task, as four bits of a mask. There too, a text that the
   task has seen with a smaller id is settled as a duplicate and stays behind, so a text of any number of
   copies sends one row per map task or a few.
3. Tries: the texts of a range, sorted, are inserted in full into compressed radix tries whose terminals hold the
   smallest id. A trie of more than ``TRIE_BYTES`` of text is traversed and begun anew between two different texts.
   The traversal sets bit E of every document with a larger id.
4. Masks are counted by part, quality and toxicity; a part has 32 masks, and all 120 orders follow from these counts.

Defined results: null text and null part are the empty string; a row without id is never a duplicate, makes
none and has no labels; rows of equal id and text are no duplicates of each other; an id with several label rows
has a label if one of them says so; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, slices, stored

# --- fixed values: the filters' letters, what they look for, and their limits ---
LETTERS = "ABCDE"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = b"#$%&*|"
LEAST_WORDS = 200
LEAST_DISTINCT = 50  # of a hundred words
MOST_UPPER = 2  # of a hundred code points

#: Lengths of text heads, in code points, of one round after the other.
HEADS = (8, 64, 512, 4096)
#: Ranges per shuffle partition, the most of them, and sampled heads per range.
RANGES, MOST_RANGES, SAMPLED = 4, 16_384, 16
#: Bytes of text in one trie.
TRIE_BYTES = 16 << 20
#: Texts that a map task remembers by digest before it forgets them.
MOST_SEEN = 500_000

METRICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def mask_of(text: bytes, points: int) -> int:
    """Bits 1, 2, 4, 8 of the filters A to D that the text fails; ``bytes.split`` cuts at the six ASCII blanks."""
    words = text.split()
    return ((len(words) < LEAST_WORDS) | (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
            | (100 * (len(text) - len(text.translate(None, UPPER))) > MOST_UPPER * points) << 2
            | (len(text.translate(None, MARKS)) < len(text)) << 3)


class Trie:
    """A compressed radix trie over byte strings; a node is [edge, children by first byte, smallest id, waiting rows]."""

    def __init__(self) -> None:
        self.root = [b"", {}, None, None]
        self.size = 0

    def terminal(self, text: bytes) -> list:
        node, at = self.root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                self.size += len(text) - at
                child = node[1][text[at]] = [text[at:], {}, None, None]
                return child
            edge = child[0]
            if not text.startswith(edge, at):
                k = _common(edge, text, at)
                middle = [edge[:k], {edge[k]: child}, None, None]
                child[0] = edge[k:]
                child = node[1][text[at]] = middle
            node, at = child, at + len(child[0])
        return node

    def insert(self, text: bytes, own: int | None, row: tuple) -> bool | None:
        """Whether ``text`` has been here with a smaller id; None: open until the traversal."""
        node = self.terminal(text)
        if node[2] is not None and own > node[2]:
            return True
        node[2] = own
        if node[3] is None:
            node[3] = []
        node[3].append((own, row))
        return None

    def traverse(self) -> Iterator[tuple[tuple, bool]]:
        """Every waiting row and whether it is a duplicate."""
        stack = [self.root]
        while stack:
            _, children, least, rows = stack.pop()
            stack.extend(children.values())
            for own, row in rows or ():
                yield row, own > least


def _common(edge: bytes, text: bytes, at: int) -> int:
    """Length of the common beginning of ``edge`` and ``text[at:]``, by halving."""
    low, high = 0, min(len(edge), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(edge[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


def bounds(texts: DataFrame, n_ranges: int) -> list[bytes]:
    """At most ``n_ranges`` bounds that split the column ``text`` into ranges of about as many rows."""
    leaves, part, total, before = [], texts, None, None
    for length in HEADS:
        head = F.substring("text", 1, length)
        counts = stored(part.groupBy(head.alias("head"), (F.length("text") > length).alias("more")).agg(F.count("*").alias("n")))
        total = total or counts.agg(F.sum("n")).first()[0] or 1
        wide = F.col("more") & (F.col("n") > total / (4 * n_ranges))
        leaves.append(counts if length == HEADS[-1] else counts.where(~wide))
        # heads of more than one row in 4 * n_ranges: as many at most
        heavy = counts.where(wide).select("head")
        if length == HEADS[-1] or heavy.isEmpty():
            break
        part, before = part.join(F.broadcast(heavy), head == F.col("head"), "left_semi"), length
    every = leaves[0]
    for x in leaves[1:]:
        every = every.unionByName(x)
    # a head stands once for every step rows, and for the rest with that chance, by its hash
    step = max(1.0, total / (SAMPLED * n_ranges))
    chance = F.pmod(F.xxhash64("head"), F.lit(1 << 20)) / float(1 << 20)
    sample = sorted((r["head"].encode(), r["times"]) for r in every.select("head", F.floor(F.col("n") / step + chance).alias("times")).where("times > 0").collect())
    if not sample:
        return []
    upto = np.cumsum([n for _, n in sample])
    places = np.searchsorted(upto, np.arange(1, n_ranges) * upto[-1] / n_ranges)
    return sorted({sample[k][0] for k in places})


EVALUATED = "range int, text binary, id long, part string, mask int, n long"
JUDGED = "id long, part string, mask int, n long"


def _evaluate(cuts: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for b in slices(batches, "text", 8 << 20):
            texts, points = b.column("text").cast(pa.binary()).to_pylist(), pc.utf8_length(b.column("text")).to_pylist()
            rows: dict[tuple, list] = {}
            for text, own, part, length in zip(texts, b.column("id").to_pylist(), b.column("part").to_pylist(), points):
                same = rows.get((text, own, part))
                if same:
                    same[-1] += 1
                    continue
                mask, place, sent = mask_of(text, length), (own or 0) % (len(cuts) + 1), None
                if own is not None:
                    key = hashlib.blake2b(text, digest_size=16).digest()
                    least = seen.get(key)
                    if least is not None and own > least:
                        mask |= 16
                    else:
                        if len(seen) >= MOST_SEEN:
                            seen.clear()
                        seen[key] = own
                        place, sent = bisect_right(cuts, text), text
                rows[text, own, part] = [place, sent, own, part, mask, 1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows.values()), (pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.int32(), pa.int64()))],
                ["range", "text", "id", "part", "mask", "n"])
    return run


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their text; those without text are settled."""
    trie, last, out = Trie(), None, []

    def made() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int32(), pa.int64()))],
                                           ["id", "part", "mask", "n"])
        out.clear()
        return batch

    def close() -> None:
        out.extend((own, part, mask | 16 * twin, n) for (own, part, mask, n), twin in trie.traverse())

    for b in slices(batches, "text", 8 << 20):
        for text, own, part, mask, n in zip(*(b.column(c).to_pylist() for c in ("text", "id", "part", "mask", "n"))):
            row = (own, part, mask, n)
            if text is None:
                out.append(row)
                continue
            if trie.size > TRIE_BYTES and text != last:
                close()
                trie = Trie()
            last = text
            if trie.insert(text, own, row):
                out.append((own, part, mask | 16, n))
        if len(out) > 10_000:
            yield made()
    close()
    yield made()


def failures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """id, part, mask (bits 1 to 16: the filters A to E that fail), n (rows alike)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), F.coalesce(part_col, F.lit("")).alias("part"))
    cuts = bounds(rows.select("text"), min(MOST_RANGES, RANGES * shuffle_width(docs.sparkSession)))
    dealt = rows.mapInArrow(_evaluate(cuts), EVALUATED).repartition("range").sortWithinPartitions("text", "id")
    return dealt.mapInArrow(_judge, JUDGED)


def _orders() -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """Each order and step, and for each metric the masks (of 32) that it counts there."""
    masks, rows = np.arange(32), []
    sets = {m: [] for m in METRICS[:6]}
    removed = {}
    for order in permutations(range(5)):
        earlier = 0
        for step, k in enumerate(order):
            fails, before = (masks >> k & 1) > 0, (masks & earlier) > 0
            rows.append(("".join(LETTERS[i] for i in order), step + 1))
            earlier |= 1 << k
            gone = fails & ~before
            for m, own in zip(METRICS[:6], (masks & earlier == 0, gone, fails & before, masks == 1 << k, gone, gone)):
                sets[m].append(own)
            removed[k] = removed.get(k, 0) + gone
    sets = {m: np.array(x, np.int64) for m, x in sets.items()}
    sets["shapley"] = np.array([removed[LETTERS.index(order[step - 1])] for order, step in rows], np.int64)
    return rows, sets


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """600 rows for each part, from its counts by mask."""
    rows, sets = _orders()
    for b in batches:
        for part, found in zip(b.column("part").to_pylist(), b.column("found").to_pylist()):
            counts = {c: np.zeros(32, np.int64) for c in ("n", "good", "toxic")}
            for x in found:
                for c, own in counts.items():
                    own[x["mask"]] = x[c]
            of = {"good_lost": "good", "toxic_lost": "toxic"}
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(rows), pa.string()), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()),
                 *(pa.array(sets[m] @ counts[of.get(m, "n")]) for m in METRICS)], ["part", "filter_order", "step", *METRICS])


def audit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
          quality_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """part, filter_order, step and the metrics, one row for each part, order and step."""
    own = failures(docs, id_col=id_col, text_col=text_col, part_col=part_col).groupBy("id", "part", "mask").agg(F.sum("n").alias("n"))
    said = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(said(quality_col).alias("good"), said(toxic_col).alias("toxic"))
    # rows without id have no labels and are few by now: one a part and mask
    found = own.where("id is not null").join(marks, "id", "left") \
        .unionByName(own.where("id is null").withColumns({"good": F.lit(0), "toxic": F.lit(0)}))
    counted = found.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")])
    # at most 32 masks a part
    return counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("found")) \
        .mapInArrow(_report, "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in METRICS))


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"),
                 spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic"))


OP12_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
f AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
m AS (SELECT doc_id, part, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
    + 4 * CAST(100 * (len(text) - len(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * len(text) AS INT)
    + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > least, false) AS INT) AS mask FROM f),
l AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INT)) AS good, max(CAST(coalesce(toxic = 1, false) AS INT)) AS toxic FROM labels GROUP BY 1),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
    FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT letter AS filter_order, bit AS used FROM letters
  UNION ALL SELECT o.filter_order || letter, o.used | bit FROM o JOIN letters ON o.used & bit = 0),
s AS (SELECT filter_order, step, bit, list_sum(list_transform(string_split(left(filter_order, step - 1), ''),
      lambda x: CASE x WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 4 WHEN 'D' THEN 8 WHEN 'E' THEN 16 ELSE 0 END)) AS earlier
    FROM o, unnest([1, 2, 3, 4, 5]) AS u(step), letters WHERE len(filter_order) = 5 AND letter = filter_order[step]),
r AS (SELECT part, filter_order, step, bit, sum(n) FILTER (mask & (coalesce(earlier, 0) | bit)::INT = 0) AS kept,
    sum(n) FILTER (mask & bit > 0 AND mask & coalesce(earlier, 0)::INT = 0) AS removed,
    sum(n) FILTER (mask & bit > 0 AND mask & coalesce(earlier, 0)::INT > 0) AS redundant,
    sum(n) FILTER (mask = bit) AS unique_fails,
    sum(good) FILTER (mask & bit > 0 AND mask & coalesce(earlier, 0)::INT = 0) AS good_lost,
    sum(toxic) FILTER (mask & bit > 0 AND mask & coalesce(earlier, 0)::INT = 0) AS toxic_lost FROM c, s GROUP BY ALL),
h AS (SELECT part, bit, sum(removed) AS shapley FROM r GROUP BY ALL)
SELECT r.part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(shapley, 0) AS BIGINT) AS shapley
FROM r JOIN h ON r.part = h.part AND r.bit = h.bit
"""
