"""Each text operator against brute force, and on nulls, empty and long texts, repeats, empty tables and extra columns."""

import hashlib
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pytest
import xxhash

from peakloom.llm import chat, classifier, common, graph, jaccard, langid, packing, pieces, quality_rules, secret_scan, topk, unit_dedup

DDL = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, id long, h long"
LONG = "und so weiter geht es hier immer fort. " * 5000


def table(spark, texts, langs=None):
    langs = langs or ["en"] * len(texts)
    return spark.createDataFrame([(i, t, langs[i], f"s{i % 3}", len(t or ""), 0.5, "x", 9, 9) for i, t in enumerate(texts)], DDL)


def edge(spark):
    rows = [(None, "no id but words enough to be a text of its own here"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, LONG),
            (6, "same text for two rows that repeat their id and all"), (6, "same text for two rows that repeat their id and all")]
    return spark.createDataFrame([(i, t, None, None, None, None, None, None, None) for i, t in rows], DDL)


def none(spark):
    return spark.createDataFrame([], DDL)


def test_language_id(spark):
    en, fr = "the thing with the other thing and that ", "le chose avec une autre chose et des "
    docs = table(spark, [(en if i % 2 else fr) * (1 + i % 4) + str(i) for i in range(60)], ["en" if i % 2 else "fr" for i in range(60)])
    model = langid.fit(docs, clusters=2)
    out = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert all(out[i]["nearest"] == ("en" if i % 2 else "fr") and 0 <= out[i]["score"] <= 1 for i in range(60))
    far = langid.predict(table(spark, ["жжж щщщ ццц", "12 !?"]), model).orderBy("doc_id").collect()
    assert far[0]["rejected"] and far[0]["lang"] == "und" and far[1]["nearest"] == "und" and far[1]["score"] == 0
    assert langid.predict(edge(spark), model).count() == 8
    assert {r["nearest"] for r in langid.predict(edge(spark), langid.fit(none(spark))).collect()} == {"und"}
    assert langid.predict(none(spark), model).count() == 0


def test_pieces_equal_the_library(spark):
    import sentencepiece

    path = pieces.public_pieces()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["", " ", "  two  blanks ", "Hello\nworld 中文 🎉", "aaaaaaaaaaaaaaaaaa", "the thing, the things; thinly", "=====-----", LONG[:3000]]
    out = {r["doc_id"]: r for r in pieces.encode(table(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        assert out[i]["ids"] == sp.encode(t) and out[i]["round_trip"]
        assert out[i]["ids_crc32"] == zlib.crc32(array("i", out[i]["ids"]).tobytes())
    back = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(table(spark, texts), path), path).collect()}
    assert back == dict(enumerate(texts))
    rows = pieces.encode(edge(spark), path).collect()
    assert len(rows) == 8 and [r["ids"] for r in rows if r["doc_id"] == 1] == [None]
    assert pieces.encode(none(spark), path).count() == 0


def one_by_one(histogram, length):
    room = []
    for size in sorted((s for s, n in histogram.items() for _ in range(n)), reverse=True):
        k = max(range(len(room)), key=lambda i: room[i], default=None)
        if k is None or room[k] < size:
            room.append(length)
            k = len(room) - 1
        room[k] -= size
    return Counter(room)


@pytest.mark.parametrize("seed", range(5))
def test_shortest_pack_first_in_bulk(seed):
    rng = np.random.default_rng(seed)
    histogram = {int(s): int(rng.integers(1, 30)) for s in rng.choice(np.arange(1, 64), 20, replace=False)}
    patterns = packing.shortest_pack_first(histogram, 64)
    got = Counter()
    for pattern, n in patterns:
        got[64 - sum(s * k for s, k in pattern)] += n
    assert got == one_by_one(histogram, 64)
    placed = Counter()
    for size, first, past, *_ in packing.slots_of(patterns):
        placed[size] += past - first
    assert placed == histogram


def test_packing(spark):
    tokenizer = packing.public_bpe()
    slow = packing.Encoder(tokenizer["path"])
    fast = packing.Encoder(**tokenizer)
    for t in ("a <|endoftext|> b", "x" * 3000, " \n \n  ", "naïve — 中文"):
        assert slow(t) == fast(t)
    docs = edge(spark)
    out = packing.pack(packing.tokenized(docs, tokenizer)).collect()
    ids = {r["doc_id"]: np.frombuffer(slow(r["text"] or "") + bytes(4), "<u4") for r in docs.collect()}
    assert sum(r["length"] for r in out) == sum(len(ids[r["doc_id"]]) for r in docs.collect())
    by = {}
    for r in out:
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"]:r["start"] + r["length"]].astype("<u4").tobytes())
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(packing.tokenized(none(spark), tokenizer)).count() == 0
    rows = packing.packed_sequences(docs, tokenizer).collect()
    assert all(len(r["ids"]) == 1024 for r in rows) and len(rows) == len(by)


def test_template_language():
    t = chat.compile_template("{{ 'a' + 'b' | upper }}{% if 1 == 1 %}!{% else %}?{% endif %}"
                              "{% for m in messages %}[{% if m.role == 'u' and not m.gone %}{{ m.text | trim }}{% elif m.role == 's' %}S{% else %}"
                              "{% generation %}{{ m.text }}{% endgeneration %}{% endif %}]{% endfor %}end")
    text, spans = t.render([{"role": "u", "text": " x "}, {"role": "a", "text": "yo"}, {"role": "s"}])
    assert text == "aB![x][yo][S]end" and [text[a:b] for a, b in spans] == ["yo"]
    assert chat.fold(chat.parse("a{{ 'b' }}{% if not 1 %}c{% endif %}d")) == [chat.Print(chat.Const("abd"))]
    for bad in ("{{ m.text() }}", "{{ open | x }}", "{% for a in b %}{% endfor %}", "{% if 1 %}", "{{ __import__ }}", "{% set x = 1 %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


def test_chat(spark):
    rows = [(1, 1, "assistant", chat.PROBE), (1, 0, "user", "### x: </turn>\n\\"), (None, 0, None, None), (2, None, "user", ""), (2, None, "user", "")]
    df = spark.createDataFrame([(*r, "t", 5) for r in rows], "conv_id long, turn long, role string, text string, formatted string, n_turns int")
    out = {r["conv_id"]: r for r in chat.format_digests(df).collect()}
    assert out[1]["turns_sha256"] == hashlib.sha256(f"user\n### x: </turn>\n\\\nassistant\n{chat.PROBE}\n".encode()).hexdigest()
    assert out[1]["loss_chars"] == len(chat.PROBE) and out[1]["loss_sha256"] == hashlib.sha256(chat.PROBE.encode()).hexdigest()
    assert out[2]["n_turns"] == 2 and out[None]["n_turns"] == 1
    whole = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    assert chat.parse_formatted(whole[1]["formatted"]) == [("user", "### x: </turn>\n\\"), ("assistant", chat.PROBE)]
    span = whole[1]["loss_spans"][0]
    assert chat.unescape(whole[1]["formatted"][span["start"]:span["end"]]) == chat.PROBE
    assert chat.format_digests(df.limit(0)).count() == 0


def test_topk(spark):
    rng = np.random.default_rng(3)
    vectors = [[float(x) for x in rng.normal(0, 1, 5)] for _ in range(60)] + [[1.0, 1.0, 1.0, 1.0, 1.0]] * 60
    rows = list(enumerate(vectors)) + [(5, vectors[5]), (200, None), (201, [1.0, None, 1.0, 1.0, 1.0]), (202, [float("nan")] * 5), (203, [1.0, 2.0]),
                                       (None, vectors[0]), (240, [])]
    df = spark.createDataFrame([(i, v, "r") for i, v in rows], "vec_id long, embedding array<double>, rank string")
    got = topk.search(df, df.where("vec_id % 20 = 0"), 7, block_rows=16).collect()
    good = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in good:
        if q % 20 == 0:
            own = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in good if c != q and len(w) == len(v))
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(own[:7])]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.search(df.limit(0), df.limit(0), 3).count() == 0


def base_spans(text):
    out = []
    for k, (_, pattern, group, least) in enumerate(secret_scan.KINDS):
        out += [(m.start(), k, m.end(), m[group]) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return [(s, e, k, v) for s, k, e, v in sorted(out)]


def test_secrets(spark):
    key = "AKIA" + "Q7X2" * 5
    texts = [f"é🎉 token = 'Zx81mQp07Kd' and {key} twice {key}", "secret=token: abcdefgh", "password: " + "0f" * 20, "PassWord:abc123", None, "",
             "token=Zx81mQp07Kd", f"{key} api_key=EXAMPLEkey1", LONG + "ghp_" + "aB3dE5gH" * 5]
    docs = table(spark, texts)
    rows = {r["doc_id"]: r["spans"] for r in secret_scan.scan(docs).collect()}
    for i, t in enumerate(texts):
        assert [(s["start"], s["end"], s["kind"], s["value"]) for s in rows[i]] == base_spans(t or ""), i
    assert [s["n_owners"] for s in rows[0]] == [1, 2, 2] and [s["live"] for s in rows[0]] == [True, False, False]
    assert not rows[7][1]["live"]
    out = {r["doc_id"]: r for r in secret_scan.redact(docs).collect()}
    assert out[0]["text"] == f"é🎉 [assign]' and {key} twice {key}" and out[4]["text"] is None and out[0]["score"] == 0.5
    assert secret_scan.redact(edge(spark)).count() == 8 and secret_scan.scan(edge(spark)).count() == 8 and secret_scan.scan(none(spark)).count() == 0


def test_unit_dedup(spark):
    line = "a passage of more than eight words that is found in several texts."
    texts = [f"First. {line} Rest of it.", f"Other words  {line.upper()}\n{line}\nend", "short line\nshort line", None, ""]
    out = {r["doc_id"]: r for r in unit_dedup.dedup(table(spark, texts), removed_col="gone").collect()}
    assert out[0]["text"] == texts[0] and out[0]["gone"] is None
    assert out[1]["text"] == f"Other words  {line.upper()}\nend" and [(s["start"], s["kept_in"]) for s in out[1]["gone"]] == [(len(line) + 14, 0)]
    assert out[2]["text"] == texts[2] and out[3]["text"] is None and out[4]["text"] == ""
    assert unit_dedup.dedup(edge(spark)).count() == 8 and unit_dedup.dedup(none(spark)).count() == 0
    assert len({r["text"] for r in unit_dedup.dedup(edge(spark)).where("doc_id = 6").collect()}) == 1


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark):
    texts = ["ein guter Text mit genug Worten darin um die Regel zu bestehen", "w### " * 3 + "a b c d e f g h i j k l", "a b c d e a b c d e x", None, "",
             "l1 x\nl1 x\n\n \nl2", LONG[:4000], "a a a a a a a a a a a a", " nbsp stays é🎉"]
    docs, trusted = table(spark, texts), spark.createDataFrame([(0,), (6,), (None,)], "doc_id long")
    weights = quality_rules.fit(docs, trusted, buckets=64, prior=5.0)
    got = {r["doc_id"]: r for r in quality_rules.score(docs, weights, buckets=64).collect()}

    def grams(t):
        w = [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        one = [xxhash.xxh64_intdigest(x, 42) for x in w]
        two = [xxhash.xxh64_intdigest(b, h) for h, b in zip(one, w[1:])]
        return [(h - (1 << 64) if h >> 63 else h) % 64 for h in one + two]

    raw = Counter(g for t in texts for g in grams(t))
    target = Counter(g for i in (0, 6) for g in grams(texts[i]))
    r, t = sum(raw.values()), sum(target.values())
    for i, text in enumerate(texts):
        row = got[i]
        assert tuple(row[n] for n in quality_rules.BASE) == base_counts(text), i
        own = [np.log((target[g] + 5 * raw[g] / r) / ((t + 5) * raw[g] / r)) for g in grams(text)]
        assert row["llr"] == pytest.approx(np.mean(own) if own else 0.0, abs=1e-5)
        n, *_, repeats = base_counts(text)
        assert row["base_failed"] == (n < 10 or 100 * repeats > 20 * n) and row["kept"] == (not row["base_failed"] and row["llr"] >= quality_rules.THRESHOLD)
    assert {r["llr"] for r in quality_rules.apply_rules(edge(spark), trusted.limit(0)).collect()} == {0.0}
    assert quality_rules.keep_good(docs, trusted).columns == docs.columns and quality_rules.apply_rules(none(spark), trusted).count() == 0


def brute_components(texts):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    while True:
        was = dict(root)
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        if was == root:
            return {i: (len(sets[i]), root[i]) for i in sets}


@pytest.mark.parametrize("few", [1, 4, 32])
def test_jaccard_join(spark, few):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(12)]
    for k in range(40):  # near copies, with borderline numbers of changed words
        w = texts[k % 4].split()
        for at in rng.choice(60, int(rng.integers(0, 4)), replace=False):
            w[at] = str(rng.choice(words))
        texts.append(" ".join(w))
    texts += ["", None, "One two", "one TWO", "\n one  two ", "a b c d e", "A B C D E"]
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link(table(spark, texts), few=few).collect()}
    assert out == brute_components(list(enumerate(texts)))
    assert jaccard.link(edge(spark)).count() == 8 and jaccard.link(none(spark)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_cell_links(seed):
    """The links of a cell join what all links join, inside one block and between two."""
    rng = np.random.default_rng(seed)
    levels = np.zeros((2, jaccard.SKETCH), np.uint8)
    base = rng.integers(0, 1 << 63, 40 * (seed + 1)).astype(np.uint64)
    sets = [np.unique(np.concatenate((base[rng.random(len(base)) < rng.uniform(.7, 1)], rng.integers(0, 1 << 63, 4).astype(np.uint64))))
            for _ in range(50)]
    side = rng.integers(0, 2, 50) if seed % 2 else np.zeros(50, int)
    alike = [(i, j) for i in range(50) for j in range(i) if (side[i] != side[j] or not seed % 2) and jaccard._similar(sets[i], sets[j], 75, 100)]

    def joined(links):
        label = list(range(50))
        for i, j in links:
            label = [label[i] if x == label[j] else x for x in label]
        return {frozenset(k for k in range(50) if label[k] == x) for x in label}

    sketches = [jaccard.sketch(x) for x in sets]
    near = jaccard.cell_near(sketches, np.array([len(x) for x in sets]), np.arange(50), side, 75, 100)
    assert {i for pair in alike for i in pair} <= set(np.flatnonzero(near))
    assert not jaccard.cell_near(sketches, np.array([len(x) for x in sets]), np.zeros(50, int), side, 75, 100).any()
    for i in range(49):  # sketches of any two widths never differ in more bits than the sets in shingles
        least = min(len(sketches[i]), len(sketches[i + 1]))
        apart = np.bitwise_count(jaccard.folded(sketches[i], least) ^ jaccard.folded(sketches[i + 1], least)).sum()
        assert apart <= len(np.setxor1d(sets[i], sets[i + 1]))
    found = jaccard.cell_links(sets, np.arange(50), side, levels, 75, 100)
    assert joined(found) == joined(alike) and {tuple(sorted(x)[::-1]) for x in found} <= set(alike)
    assert len(found) < 50


def test_word_hashes_and_components(spark):
    import pyarrow as pa

    data, offsets = common.text_bytes(pa.array(["Ab  cd", None, "", "ab", "x" * 70000 + " cd"]))
    starts, ends, row = common.words_of(data, offsets)
    h = common.word_hashes(data, starts, ends)
    assert row.tolist() == [0, 0, 3, 4, 4] and h[0] == h[2] and h[1] == h[4] and len(set(h.tolist())) == 3
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 50)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r["node"]: r["component"] for r in graph.components(edges).collect()}
    assert found == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}


def test_classifier(spark):
    rng = np.random.default_rng(6)
    good = [" ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(40)) for _ in range(80)]
    bad = [" ".join("".join(rng.choice(list("ab#*$%"), 5)) for _ in range(40)) for _ in range(80)]
    texts = [x for p in zip(good, bad) for x in p]
    docs = table(spark, texts + [None, ""])
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(120)] + [(0, None), (None, 1), (1, 0)], "doc_id long, quality int")
    out = {r["doc_id"]: r["score"] for r in classifier.classify(docs, labels).collect()}
    assert all((out[i] > 0.5) == (i % 2 == 0) for i in range(120, 160)) and all(0 <= s <= 1 for s in out.values())
    assert {r["score"] for r in classifier.classify(edge(spark), labels.limit(0)).collect()} == {0.5}
    assert classifier.classify(none(spark), labels).count() == 0
    _, values = classifier.pooled(np.arange(5.0), np.ones(5), np.array([0, 1, 0, 1, 1.0]))
    assert values.tolist() == [0, 0.5, 1, 1] or values.tolist() == [0, 0.5, 1]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    spark.range(0).selectExpr("id as doc_id", "1 as quality").write.parquet(str(tmp_path / "labels.parquet"))
    text = " ".join(f"word{i}" for i in range(30)) + "."
    key = "token = Zx81mQp07KdLp3"
    texts = [text, text + " more", f"An own beginning of this one. {text} With an own end to it, and {key} too.", None, "few words"]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns, name
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(left) == {0, 2} and left[0] == text and "Zx81" not in left[2] and left[2].startswith("An own beginning")
    assert sum(r["doc_tokens"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) > 0
