"""Divergence between the sources of each language, with identical texts collapsed before any counting.

1. Collapse: identical texts of one language become one row with the number of copies per source, first inside
   a slice of a map task, then, dealt by a 128-bit digest, over the whole table. Each is tokenised once, and its
   occurrences and its document frequency are weighted by its copies. A text that everything copies arrives
   once per map slice; beyond ``SALT_TASKS`` map tasks, each set of that many collapses on its own, so that no
   key gathers more (weights add up, so the counts are the same).
2. Counts: summed per task, one row a term, then by one shuffle of (language, term). Terms in ``min_docs`` documents of
   their language stay.
3. Sparse pairs: absent terms have one proportion per source, so a pair starts from the value of a term absent
   on both sides times the vocabulary, and only the terms that either side has are evaluated, in cells of
   (language, share of its terms, block of sources, block of sources). A cell emits one sum per pair.

All arithmetic is in integers: proportions p = 1 + floor(scale * (count + 2) / (N + 2 * V)), values
floor((p - q)^2 / (p + q)).

Defined results: null text, language and source are the empty string; a text without terms, or a language without
kept terms, still has its groups (pair values 0 where V is 0) and no term rows; a language with one source has no
pair rows; ids are not read, so repeated rows count as documents of their own; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_join, shuffle_width, slices, stored

# --- fixed values: the scale of proportions, the added counts, and what a term is made of ---
SCALE = 1_000_000_000
ADDED = 2
#: Lower-cases A-Z; every other ASCII character that is no letter ends a term.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

SALT_TASKS = 1024
#: Entries of a task's counts before they are passed on.
MOST_ENTRIES = 1_000_000
#: Rows of one language in one share of its terms.
SHARD_ROWS = 50_000
BLOCK_SOURCES = 128

COLLAPSED = "lang string, salt int, d1 long, d2 long, text string, sources array<string>, copies array<long>"
COUNTS = "lang string, term string, sources array<string>, n array<long>, n_all long, df long"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each language and text of a slice, with its copies per source."""
    from pyspark import TaskContext

    salt = TaskContext.get().partitionId() // SALT_TASKS
    for b in slices(batches, "text", 8 << 20):
        found: dict[tuple, Counter] = {}
        for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text"))):
            found.setdefault((lang, text), Counter())[source] += 1
        digests = np.frombuffer(b"".join(hashlib.blake2b(t.encode(), digest_size=16).digest() for _, t in found), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in found], pa.string()), pa.array(np.full(len(found), salt, np.int32)),
             pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), pa.array([k[1] for k in found], pa.string()),
             pa.array([list(c) for c in found.values()], pa.list_(pa.string())),
             pa.array([list(c.values()) for c in found.values()], pa.list_(pa.int64()))],
            ["lang", "salt", "d1", "d2", "text", "sources", "copies"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each language and term of a task: occurrences by source and in all, and documents; equal texts follow each other."""
    found: dict[str, dict[bytes, dict]] = {}  # occurrences by source; under None the documents
    entries = 0

    def flushed() -> Iterator[pa.RecordBatch]:
        nonlocal entries
        for lang, terms in found.items():
            names = list(terms)
            for at in range(0, len(names), 20_000):
                part = names[at:at + 20_000]
                docs = [terms[t].pop(None) for t in part]
                own = [terms[t] for t in part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()),
                     pa.array([list(x) for x in own], pa.list_(pa.string())), pa.array([list(x.values()) for x in own], pa.list_(pa.int64())),
                     pa.array([sum(x.values()) for x in own], pa.int64()), pa.array(docs, pa.int64())], ["lang", "term", "sources", "n", "n_all", "df"])
        found.clear()
        entries = 0

    def add(lang: str, text: str, copies: Counter) -> None:
        nonlocal entries
        terms, total = found.setdefault(lang, {}), sum(copies.values())
        for w, c in Counter(terms_of(text.encode())).items():
            own = terms.get(w)
            if own is None:
                own = terms[w] = {None: 0}
                entries += 2
            own[None] += total
            for source, k in copies.items():
                if source in own:
                    own[source] += c * k
                else:
                    own[source] = c * k
                    entries += 1

    held: tuple | None = None  # language, text, copies
    for b in slices(batches, "text", 8 << 20):
        for lang, text, sources, copies in zip(*(b.column(c).to_pylist() for c in ("lang", "text", "sources", "copies"))):
            if held and held[0] == lang and held[1] == text:
                held[2].update(dict(zip(sources, copies)))
                continue
            if held:
                add(*held)
            if entries > MOST_ENTRIES:
                yield from flushed()
            held = (lang, text, Counter(dict(zip(sources, copies))))
    if held:
        add(*held)
    yield from flushed()


def term_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 10) -> DataFrame:
    """lang, term, n_lang, source, n: occurrences in the language and in each of its sources that has the term, for terms of ``min_docs`` documents."""
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    dealt = rows.mapInArrow(_collapse, COLLAPSED).repartition("lang", "salt", "d1", "d2").sortWithinPartitions("d1", "d2", "lang")
    # a term has a row for each task; one shuffle serves its document frequency and its counts by source
    own = Window.partitionBy("lang", "term")
    counted = dealt.mapInArrow(_count, COUNTS).repartition("lang", "term").withColumns({"df": F.sum("df").over(own), "n_lang": F.sum("n_all").over(own)}) \
        .where(F.col("df") >= min_docs)
    return counted.select("lang", "term", "n_lang", F.explode(F.arrays_zip("sources", "n")).alias("x")) \
        .groupBy("lang", "term", "n_lang", F.col("x.sources").alias("source")).agg(F.sum("x.n").alias("n"))


def proportion(count: Column, total: Column, vocabulary: Column) -> Column:
    """1 + floor(SCALE * (count + ADDED) / (total + ADDED * vocabulary)), exact beyond the reach of a long."""
    whole = lambda c: c.cast("decimal(19,0)")
    above, below = whole(count + ADDED) * F.lit(SCALE).cast("decimal(10,0)"), whole(total + ADDED * vocabulary)
    return F.lit(1).cast("long") + F.call_function("div", above, below).cast("long")


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q).cast("long")


def _pair_sums(cell: pa.Table) -> pa.Table:
    """Sums over the terms of a cell of value minus the value of absence, for each pair of a left and a right source.

    Rows without a term name the cell's sources and their proportion of an absent term.
    """
    columns = {c: cell.column(c).to_pylist() for c in ("source", "term", "p", "left", "right")}
    heads = sorted((s, p, le, ri) for s, t, p, le, ri in zip(*(columns[c] for c in ("source", "term", "p", "left", "right"))) if t is None)
    place = {s: i for i, (s, *_) in enumerate(heads)}
    absent = np.array([p for _, p, *_ in heads], np.int64)
    left, right = (np.array([h[k] for h in heads], bool) for k in (2, 3))
    rows = [(place[s], t, p) for s, t, p in zip(columns["source"], columns["term"], columns["p"]) if t is not None]
    names: dict[str, int] = {}
    at = np.array([(i, names.setdefault(t, len(names)), p) for i, t, p in rows], np.int64).reshape(-1, 3)
    at = at[np.argsort(at[:, 1], kind="stable")]
    sums = np.zeros((len(heads), len(heads)), np.int64)
    value = lambda p, q: (p - q) * (p - q) // (p + q)
    step = max(1, (1 << 20) // max(1, len(heads)))
    for lo in range(0, len(names), step):  # a bounded part of the terms at a time
        part = at[np.searchsorted(at[:, 1], lo):np.searchsorted(at[:, 1], lo + step)]
        dense = np.repeat(absent[None, :], min(step, len(names) - lo), 0)
        there = np.zeros(dense.shape, bool)
        dense[part[:, 1] - lo, part[:, 0]] = part[:, 2]
        there[part[:, 1] - lo, part[:, 0]] = True
        for i in range(len(heads)):
            own = np.flatnonzero(there[:, i])
            # a term that both sides have is evaluated from the side of the smaller place
            counts = ~there[own]
            counts[:, i + 1:] = True
            counts[:, i] = False
            sums[i] += ((value(dense[own, i][:, None], dense[own]) - value(absent[i], absent)[None, :]) * counts).sum(0)
    sums += sums.T
    i, j = np.nonzero(np.triu((left[:, None] & right[None, :]) | (right[:, None] & left[None, :]), 1))
    source = np.array([h[0] for h in heads], object)
    lang = cell.column("lang")[0].as_py()
    return pa.table({"lang": pa.array([lang] * len(i), pa.string()), "a": pa.array(source[i].tolist(), pa.string()),
                     "b": pa.array(source[j].tolist(), pa.string()), "more": pa.array(sums[i, j])})


def audit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 10,
          top_terms: int = 10) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    found = stored(term_counts(docs, text_col=text_col, lang_col=lang_col, source_col=source_col, min_docs=min_docs))
    # one row a language and one a group: totals and vocabulary
    langs = found.select("lang", "term", "n_lang").distinct().groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang"))
    sums = found.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    groups = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source")).distinct()
    nothing = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "held", "v", "total_lang")]
    groups = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *nothing)
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    absent = F.when(F.col("v") > 0, proportion(F.lit(0), F.col("total"), F.col("v"))).otherwise(1)
    groups = stored(groups.withColumn("block", F.floor(number / BLOCK_SOURCES).cast("int")).withColumn("absent", absent)
                    .withColumn("blocks", (F.max("block").over(Window.partitionBy("lang")) + 1).cast("int"))
                    .withColumn("shards", F.greatest(F.lit(1), F.least(F.lit(shuffle_width(docs.sparkSession)), F.ceil(
                        F.sum("held").over(Window.partitionBy("lang")) / SHARD_ROWS))).cast("int")))
    total = groups.agg(F.sum("held")).first()[0] or 0
    rows = hot_join(found, groups, ["lang", "source"], "held", total) \
        .withColumn("p", proportion(F.col("n"), F.col("total"), F.col("v")))

    q = proportion(F.col("n_lang"), F.col("total_lang"), F.col("v"))
    term = rows.where("n > 0").withColumn("q", q).where("p > q") \
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    term = term.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_terms)

    # every row goes to the cells of its block of sources and any other; most languages have one block
    cells = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(
        F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j"))))
    shape = ["lang", "shard", "i", "j", "source", "term", "p", "left", "right"]
    sides = [(F.col("block") == F.col("i")).alias("left"), (F.col("block") == F.col("j")).alias("right")]
    shard = F.pmod(F.xxhash64("term"), F.col("shards")).cast("int")
    inside = rows.withColumn("shard", shard).withColumn("cell", cells).select("*", "cell.*").select(*shape[:7], *sides)
    heads = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).withColumn("cell", cells).select("*", "cell.*") \
        .select("lang", "shard", "i", "j", "source", F.lit(None).cast("string").alias("term"), F.col("absent").alias("p"), *sides)
    more = inside.unionByName(heads).groupBy("lang", "shard", "i", "j").applyInArrow(_pair_sums, "lang string, a string, b string, more long") \
        .groupBy("lang", "a", "b").agg(F.sum("more").alias("more"))
    both = more.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                                                 F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "more").select("lang", "x.*", "more")
    one = groups.select("lang", "source", F.col("absent").alias("p0"), "v")
    other = groups.select("lang", F.col("source").alias("item"), F.col("absent").alias("q0"))
    pair = both.join(one, ["lang", "source"]).join(other, ["lang", "item"]) \
        .select("lang", "source", F.lit("pair").alias("part"), "item",
                F.when(F.col("v") == 0, F.lit(0)).otherwise(F.col("v") * divergence(F.col("p0"), F.col("q0")) + F.col("more")).cast("long").alias("value"))
    pair = pair.withColumn("rank", F.row_number().over(best))
    return pair.unionByName(term)


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
w AS (SELECT k, lang, source, unnest(terms) AS term FROM d),
n AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT k) AS df FROM w GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM n GROUP BY ALL HAVING sum(df) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
own AS (SELECT g.lang, g.source, kept.term, coalesce(n.n, 0) AS n, kept.n AS n_lang
    FROM g JOIN kept USING (lang) LEFT JOIN n USING (lang, source, term)),
t AS (SELECT lang, source, sum(n) AS total FROM own GROUP BY ALL),
p AS (SELECT own.lang, source, term, own.n, 1 + (1000000000::HUGEINT * (own.n + 2)) // (t.total + 2 * v.v) AS p,
    1 + (1000000000::HUGEINT * (n_lang + 2)) // (v.total + 2 * v.v) AS q FROM own JOIN t USING (lang, source) JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM k WHERE part = 'pair' OR rank <= 10
"""
