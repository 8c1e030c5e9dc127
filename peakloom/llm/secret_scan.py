"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Every whole text is scanned for spans of several kinds. The hash of each candidate value is counted
over the corpus by distinct repositories and owners: a value of many owners is a widely copied
example, a value of one owner (or few) that looks random is a live credential. Positions come from
the gaps between matches: the text split at the pattern and the matches themselves alternate.

``few_owners=None`` takes the bound from the corpus: a value is widely copied when more than SEVERAL
owners and more than SHARE of all owners hold it. ``by_kind`` judges the looks by kind: a value
that stands behind a name (``assign``) is live unless it is a placeholder or fewer than three
different characters, the others need eight different ones.

Defined results: a null text is empty; a null repository or owner is one value of its own; repeated
rows are scanned each, and count once for their owner; rows keep their order of spans by start,
then kind; an empty table gives no rows; other columns are ignored by ``scan``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_join

# --- fixed values: kinds in order, patterns, the group that is the value, its least length ---
KINDS = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("github", r"gh[opsur]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("google", r"AIza[A-Za-z0-9_-]{35,}", 0, 39),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
)
BASE = ("assign", "access", "hex")
#: What a text with any candidate holds; one cheap pass leaves the others alone.
ANY = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]|[0-9a-f]{24}|gh[opsur]_|xox[abprs]-|AIza|eyJ[A-Za-z0-9_-]{8}|-----BEGIN "
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your[_-]|xxxx|0000000000|1234567890"
#: Owners that may quote one live secret: this many, or this share of all owners, if that is more.
SEVERAL = 5
SHARE = 0.01
SPAN = "array<struct<start: long, end: long, kind: int, value: string>>"


def _spans(text: Column, kind: int) -> Column:
    """Spans of one kind in a text."""
    _, pattern, group, least = KINDS[kind]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    parts = F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("hit"), values.alias("value")), lambda x: F.struct(
        F.length(x["gap"]).cast("long").alias("gap"), F.length(x["hit"]).cast("long").alias("size"), x["value"].alias("value")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("spans"))
    walked = F.aggregate(parts, start, lambda acc, x: F.struct(
        (acc["at"] + x["gap"] + x["size"]).alias("at"),
        F.concat(acc["spans"], F.array(F.struct(
            (acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["size"]).alias("end"),
            F.lit(kind).alias("kind"), x["value"].alias("value")))).alias("spans")))
    return F.filter(walked["spans"], lambda s: F.length(s["value"]) >= least)


def all_spans(text: Column) -> Column:
    """Spans of every kind, by start, then kind as listed; an empty array where there is none."""
    found = F.sort_array(F.concat(*[_spans(text, k) for k in range(len(KINDS))]))
    return F.when(text.rlike(ANY), found).otherwise(F.array().cast(SPAN))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def candidates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", repo_col: str = "source", owner_col: str = "source") -> DataFrame:
    """doc_id, repo, owner, spans of every row."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"),
                       all_spans(F.coalesce(F.col(text_col), F.lit(""))).alias("spans"))


def ownership(spans: DataFrame) -> DataFrame:
    """hash, n (occurrences), n_repos, n_owners of every candidate value; ``spans``: repo, owner, hash.

    Three counts with map-side combining: a value that a third of the rows hold is one row per task.
    """
    null = F.lit("\u0000")
    own = spans.groupBy("hash", F.coalesce("owner", null).alias("owner"), F.coalesce("repo", null).alias("repo")).agg(F.count("*").alias("n"))
    owners = own.groupBy("hash", "owner").agg(F.sum("n").alias("n"))
    repos = own.groupBy("hash", "repo").agg(F.lit(0).cast("long").alias("n"))
    both = owners.select("hash", "n", F.lit(1).alias("o"), F.lit(0).alias("r")).unionByName(repos.select("hash", "n", F.lit(0).alias("o"), F.lit(1).alias("r")))
    return both.groupBy("hash").agg(F.sum("n").alias("n"), F.sum("r").alias("n_repos"), F.sum("o").alias("n_owners"))


def owners_of_live(docs: DataFrame, owner_col: str = "source") -> int:
    """How many owners may hold a value that is not widely copied, from all owners of the corpus."""
    owners = docs.select(F.col(owner_col).cast("string").alias("owner")).distinct().count()
    return max(SEVERAL, int(SHARE * owners))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str = "source",
         few_owners: int | None = 1, by_kind: bool = False) -> DataFrame:
    """doc_id and spans (start, end, kind, value, n_repos, n_owners, live) of every row, each span judged by the corpus.

    ``live``: at most ``few_owners`` owners hold the value, it is no placeholder, and it has eight
    different characters at least (``by_kind``: three for an assigned value).
    """
    if few_owners is None:
        few_owners = owners_of_live(docs, owner_col)
    # small rows: no text; what follows reads this table
    rows = cut(candidates(docs, text_col, id_col, repo_col, owner_col).withColumn("row", F.monotonically_increasing_id()))
    each = rows.where(F.size("spans") > 0).select("row", "repo", "owner", F.explode("spans").alias("s")) \
        .withColumn("hash", F.unhex(F.sha2(F.col("s.value"), 256)))
    counts = cut(ownership(each))
    total = counts.agg(F.sum("n")).first()[0] or 0
    judged = hot_join(each.select("row", "s", "hash"), counts, ["hash"], "n", total)
    value = F.col("s.value")
    different = F.when(F.lit(by_kind) & (F.col("s.kind") == 0), 3).otherwise(8)
    live = (F.col("n_owners") <= few_owners) & ~value.rlike(PLACEHOLDER) & (F.size(F.array_distinct(F.split(value, ""))) >= different)
    back = judged.select("row", F.struct(
        F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.kind").alias("kind"), value.alias("value"),
        F.col("n_repos"), F.col("n_owners"), live.alias("live")).alias("s")).groupBy("row").agg(F.sort_array(F.collect_list("s")).alias("judged"))
    empty = F.array().cast("array<struct<start: long, end: long, kind: int, value: string, n_repos: long, n_owners: long, live: boolean>>")
    # rows without candidates don't travel
    found = rows.where(F.size("spans") > 0).select("row", "doc_id").join(back, "row").select("doc_id", F.col("judged").alias("spans"))
    return found.unionByName(rows.where(F.size("spans") == 0).select("doc_id", empty.alias("spans")))


def mask_spans(text: Column, spans: Column) -> Column:
    """The text with every span (sorted by start) replaced by [kind]; overlapping spans become one."""
    names = F.array(*[F.lit(f"[{k[0]}]") for k in KINDS])
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))
    walked = F.aggregate(spans, start, lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(
        s["end"].alias("at"),
        F.when(s["start"] < acc["at"], acc["parts"]).otherwise(F.concat(acc["parts"], F.array(
            text.substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.get(names, s["kind"])))).alias("parts"))))
    return F.concat(F.array_join(walked["parts"], ""), text.substr((walked["at"] + 1).cast("int"), F.lit(2147483647)))


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str = "source",
           few_owners: int | None = 1) -> DataFrame:
    """``docs`` with live secrets masked in the text, their looks judged by kind; every row and column stays.

    Only rows with a candidate are joined (by id and text hash, so repeated rows agree); the others pass by.
    """
    if few_owners is None:
        few_owners = owners_of_live(docs, owner_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    maybe = text.rlike(ANY)
    some = docs.where(maybe).withColumn("__key", F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("h")))
    judged = scan(some.select(F.col("__key").alias("k"), text.alias("t"), F.col(repo_col).alias("r"), F.col(owner_col).alias("o")),
                  id_col="k", text_col="t", repo_col="r", owner_col="o", few_owners=few_owners, by_kind=True)
    live = judged.select(F.col("doc_id.h").alias("__h"), F.coalesce(F.col("doc_id.id").cast("string"), F.lit("")).alias("__id"),
                         F.filter("spans", lambda s: s["live"]).alias("__live")).where(F.size("__live") > 0).dropDuplicates(["__h", "__id"])
    own = some.withColumn("__h", F.col("__key.h")).withColumn("__id", F.coalesce(F.col("__key.id").cast("string"), F.lit("")))
    masked = own.join(live, ["__h", "__id"], "left").withColumn(
        text_col, F.when(F.col("__live").isNull(), F.col(text_col)).otherwise(mask_spans(F.col(text_col), F.col("__live"))))
    return masked.select(*docs.columns).unionByName(docs.where(~maybe))


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] < len(BASE))

    def count(kind: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind][0]}")

    return scan(docs).select("doc_id", *map(count, range(len(BASE))), F.sha2(written(base), 256).alias("base_sha256"), written(spans).alias("spans"),
                             F.size(F.filter(spans, lambda s: s["live"])).cast("long").alias("n_live"))


def _sql_spans(kind: int) -> str:
    name, pattern, group, least = KINDS[kind]
    quoted = pattern.replace("'", "''")
    return f"""SELECT key, source, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'start': CAST(len(array_to_string(g[1:i], '')) + len(array_to_string(m[1:i - 1], '')) AS BIGINT),
  'size': CAST(len(m[i]) AS BIGINT), 'kind': {kind}, 'name': '{name}', 'value': v[i]}})) AS s
  FROM (SELECT key, source, regexp_extract_all(text, '{quoted}', 0) AS m, regexp_extract_all(text, '{quoted}', {group}) AS v, string_split_regex(text, '{quoted}') AS g FROM d)"""


OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS key, doc_id, coalesce(text, '') AS text, source FROM documents),
f AS ({' UNION ALL '.join(_sql_spans(k) for k in range(len(KINDS)))}),
e AS (SELECT key, source, s.start AS start, s.size AS size, s.kind AS kind, s.name AS name, s.value AS value FROM f
      WHERE len(s.value) >= {'CASE s.kind ' + ' '.join(f'WHEN {k} THEN {KINDS[k][3]}' for k in range(len(KINDS))) + ' END'}),
o AS (SELECT value, count(DISTINCT coalesce(source, chr(1))) AS n_owners FROM e GROUP BY value),
j AS (SELECT e.*, name || ':' || start || ':' || (start + size) AS span,
      n_owners <= 1 AND NOT regexp_matches(e.value, '{PLACEHOLDER}') AND len(list_distinct(string_split(e.value, ''))) >= 8 AS live
      FROM e JOIN o USING (value)),
a AS (SELECT key, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
      string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans,
      count(*) FILTER (live) AS n_live FROM j GROUP BY key)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN a USING (key)
"""
