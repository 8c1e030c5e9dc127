"""Near vectors, the filter audit and the source divergence against brute force, and on odd rows."""

import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from peakloom.llm import filter_audit, near_vectors, source_divergence

DDL = "doc_id long, text string, lang string, source string, n_chars long, part string, mask int, p double"
LONG = "und so weiter geht es hier immer fort. " * 5000


def documents(spark, rows):
    return spark.createDataFrame([(i, t, la, s, 7, "x", 3, 0.5) for i, t, la, s in rows], DDL)


def odd_rows():
    return [(None, "no id here", "en", "a"), (None, "no id here", "en", "a"), (1, None, None, None), (2, "", "", ""), (3, " \n\t ", "en", None),
            (4, "one", None, "b"), (5, LONG, "de", "a"), (6, "twice the same row", "en", "b"), (6, "twice the same row", "en", "b"),
            (7, "twice the same row", "en", "a"), (8, None, "en", "b"), (9, "no id here", "en", "a")]


# --- op11 ---

VDDL = "vec_id long, embedding array<double>, label int, kept boolean, node long, n long, v double"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, la, True, 5, 6, 0.5) for i, v, la in rows], VDDL)


def linked(rows, threshold=0.98):
    """(vec_id, n_links, component_id) of all rows, in their order."""
    def fine(v, la):
        return la is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)
    unit = [np.array(v) / np.abs(v).max() if fine(v, la) else None for _, v, la in rows]
    near = defaultdict(set)
    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = unit[a], unit[b]
        if x is not None and y is not None and rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
            near[a].add(b)
            near[b].add(a)
    out = []
    for a in range(len(rows)):
        seen, todo = {a}, [a]
        while todo:
            todo = [c for b in todo for c in near[b] if c not in seen and not seen.add(c)]
        ids = [rows[b][0] for b in seen if rows[b][0] is not None]
        out.append((rows[a][0], len(near[a]), min(ids) if ids else None))
    return out


def same_links(spark, rows, **how):
    got = near_vectors.links(vectors(spark, rows), **how).collect()
    order = lambda x: sorted(x, key=repr)
    assert order((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == order(linked(rows))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("seed", range(2))
def test_links_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(12):  # groups of very different sizes and widths, equal copies and scaled ones
        centre = rng.standard_normal(24)
        for _ in range(int(rng.integers(1, 30))):
            rows.append((len(rows) * 3 + 1, (centre + rng.uniform(0, .35) * rng.standard_normal(24)).tolist(), k % 3))
    rows += [(len(rows) * 3 + 1 + i, [float(4.0 ** i * c) for c in rows[5][1]], rows[5][2]) for i in range(6)]
    rows += [(1000 + i, rows[7][1], rows[7][2]) for i in range(9)]
    same_links(spark, rows)


def test_links_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "CELL", 7)
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(16)
    same_links(spark, [(i, (centre + 0.12 * rng.standard_normal(16)).tolist(), 1) for i in range(120)])


def test_links_of_odd_vectors(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(1, one, 0), (2, None, 0), (3, [], 0), (4, [0.0, 0.0, 0.0], 0), (5, [1.0, None, 3.0], 0), (6, [1.0, float("nan"), 3.0], 0),
            (7, [1.0, float("inf"), 3.0], 0), (8, one, None), (9, one, 1), (None, one, 0), (None, [5.0, 0.0, 0.0], 0), (10, one, 0), (10, one, 0),
            (10, [-1.0, 0.0, 0.0], 0), (11, [1.0, 2.0], 0), (12, [1e300, 2e300, 3e300], 0), (13, [1e-300, 2e-300, 3e-300], 0), (14, [-0.0, 0.0, 1.0], 2), (15, [0.0, 0.0, 1.0], 2)]
    same_links(spark, rows)
    assert near_vectors.links(vectors(spark, [])).count() == 0


def test_bits_and_tables_keep_the_chance_of_a_miss():
    for n in (1, 50, 10_000, 10_000_000):
        bits, tables = near_vectors.shape(n, 0.98, 1e-6)
        same = 1 - np.arccos(0.98) / np.pi
        assert (1 - same ** bits) ** tables <= 1e-6 and 2 ** bits >= min(n, 2 ** 37)


# --- op12 ---

def audited(rows, labels):
    """part, order, step -> the metrics, from the definitions."""
    texts = defaultdict(set)
    for i, t, *_ in rows:
        if i is not None:
            texts[t or ""].add(i)
    good = {i for i, q, x in labels if q == 1 and i is not None}
    toxic = {i for i, q, x in labels if x == 1 and i is not None}
    docs = defaultdict(list)
    for i, t, _, source in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                 "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and min(texts[t]) < i}
        docs[source or ""].append((fails, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part, own in docs.items():
        for order in itertools.permutations("ABCDE"):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                failing = sum(d[0][f] for d in own)
                unique = sum(d[0][f] and sum(d[0].values()) == 1 for d in own)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), unique, sum(d[1] for d in gone), sum(d[2] for d in gone)]
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def same_audit(spark, rows, labels):
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[m] for m in filter_audit.METRICS)
           for r in filter_audit.audit(documents(spark, rows), marks).collect()}
    assert got == audited(rows, labels)


def test_audit_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "TRIE_BYTES", 3000)
    rng = np.random.default_rng(5)
    words = ["alpha", "beta", "Gamma", "d#lta", "naïve", "x", "Zz"] + [f"w{i}" for i in range(300)]
    start = "a common beginning that many texts have, word by word the same, for longer than any short head of theirs "
    rows = []
    for i in range(160):
        text = " ".join(rng.choice(words if i % 3 else words[7:], int(rng.integers(1, 400))))
        rows.append((i * 7 % 160, (start if i % 2 else "") + text, "en", f"s{i % 3}"))
    rows += [(200 + i, rows[i % 5][1], "en", f"s{i % 4}") for i in range(60)]
    rows += [(300 + i, start[:10 + i], "en", "s9") for i in range(40)]
    labels = [(i, i % 2, (i % 5 == 0) * 1) for i in range(0, 320, 3)] + [(3, 1, 1), (None, 1, 1), (6, None, None)]
    same_audit(spark, rows, labels)


def test_audit_of_odd_rows(spark):
    same_audit(spark, odd_rows(), [(6, 1, 0), (None, 1, 1), (5, 0, 1), (77, 1, 1)])
    assert filter_audit.audit(documents(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_trie_in_any_order():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 99, int(rng.integers(0, 9))).tolist()) for _ in range(400)]
    ids = rng.permutation(400).tolist()
    trie = filter_audit.Trie()
    found = {own: trie.insert(text, own, (own,)) for own, text in zip(ids, texts)}
    found |= {own: twin for (own,), twin in trie.traverse()}
    least = {}
    for own, text in zip(ids, texts):
        least[text] = min(own, least.get(text, own))
    assert all(found[own] == (own > least[text]) for own, text in zip(ids, texts))


def test_bounds_follow_common_beginnings(spark):
    texts = ["x" * 2000 + f"{i:05d}" for i in range(500)] + [f"{i:05d}" for i in range(500)]
    cuts = filter_audit.bounds(spark.createDataFrame([(t,) for t in texts], "text string"), 16)
    sizes = Counter(sum(c <= t.encode() for c in cuts) for t in texts)
    assert len(cuts) > 8 and max(sizes.values()) < 250


# --- op13 ---

def divergences(rows, least=10):
    """(lang, source, part, item, value, rank) from the definitions, in exact integers."""
    count, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, t, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        count[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [w for w, n in df[lang].items() if n >= least]
        v, sources = len(kept), sorted(s for la, s in groups if la == lang)

        def proportions(own):
            total = sum(own[w] for w in kept)
            return {w: 1 + 1_000_000_000 * (own[w] + 2) // (total + 2 * v) for w in kept}
        p = {s: proportions(count[lang, s]) for s in sources}
        q = proportions(sum((count[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        ranked = lambda x: enumerate(sorted(x, key=lambda e: (-e[1], e[0].encode())), 1)
        for s in sources:
            out += [(lang, s, "pair", o, n, k) for k, (o, n) in ranked([(o, sum(f(p[s][w], p[o][w]) for w in kept)) for o in sources if o != s])]
            own = [(w, f(p[s][w], q[w])) for w in kept if count[lang, s][w] and p[s][w] > q[w]]
            out += [(lang, s, "term", w, n, k) for k, (w, n) in ranked(own) if k <= 10]
    return sorted(out)


def same_divergence(spark, rows):
    got = source_divergence.audit(documents(spark, rows)).collect()
    assert sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in got) == divergences(rows)


@pytest.mark.parametrize("block", [128, 2])
def test_divergence_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(source_divergence, "BLOCK_SOURCES", block)
    monkeypatch.setattr(source_divergence, "SHARD_ROWS", 40)
    monkeypatch.setattr(source_divergence, "MOST_ENTRIES", 100)
    rng = np.random.default_rng(8)
    words = [f"W{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)] + ["naïve", "Ärger", "don't", "ÉCOLE", "中文", "a_b", "x1y"]
    chance = 1 / np.arange(1, len(words) + 1)
    rows = []
    for i in range(300):
        own = " ".join(rng.choice(words, int(rng.integers(0, 30)), p=chance / chance.sum()))
        rows.append((i, own, ["en", "de", None][i % 3], f"s{i * i % 7}"))
    rows += [(400 + i, rows[i % 4][1], "en", f"s{i % 9}") for i in range(50)] + [(600, "", "en", "empty"), (601, None, "fr", "alone"), (602, "...", "xx", "p"), (603, "!", "xx", "q")]
    same_divergence(spark, rows)


def test_divergence_of_odd_rows(spark):
    same_divergence(spark, odd_rows())
    same_divergence(spark, odd_rows() * 6)
    assert source_divergence.audit(documents(spark, [])).count() == 0


def test_proportions_beyond_a_long(spark):
    from pyspark.sql import functions as F

    n, total, v = 3 * 10 ** 12, 7 * 10 ** 12, 5 * 10 ** 6
    row = spark.range(1).select(source_divergence.proportion(F.lit(n), F.lit(total), F.lit(v)).alias("p")).first()
    assert row["p"] == 1 + 10 ** 9 * (n + 2) // (total + 2 * v)
