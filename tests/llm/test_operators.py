"""The operators against brute force on small fixtures, with nulls, empty texts, ties, repeated rows and clashing columns."""

import base64
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from llm import bpe, fingerprints, html_text, line_dedup, mixing, neighbours, quality, sharding, simhash, toxicity
from llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, id long, hash string, part int"
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def row(doc_id, text, source="a"):
    return (doc_id, text, "en", source, len(text or ""), 7, "k", 1, "h", 2)


def prose(rnd, n):
    return " ".join("".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(1, 8))) for _ in range(n))


def corpus(seed=1):
    rnd = random.Random(seed)
    passage = prose(rnd, 60)
    rows = [row(i, prose(rnd, rnd.randint(1, 40)) + "\n" + prose(rnd, 20) + ("\n" + passage if i % 7 == 0 else ""), rnd.choice(["a", "a", "a", "b", None])) for i in range(60)]
    copy = rows[7][1]
    rows += [row(100, copy), row(101, copy + " x"), row(102, None), row(103, ""), row(104, " \n\t"), row(105, None, None), row(106, "one two"), row(107, "\n".join(["again and again"] * 40)), row(108, "é漢😀 " * 30)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def test_mixing_meets_targets(docs, empty, spark):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and mixing.mix(empty).count() == 0
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    by = {}
    for r in rows:
        assert r["size"] == len(split(texts[r["doc_id"]])) and r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], []).append(r)
    total = sum(r["size"] for r in rows)
    assert sum(g[0]["target"] for g in by.values()) == pytest.approx(total)
    for g in by.values():
        assert g[0]["source_size"] == sum(r["size"] for r in g) and g[0]["target"] <= 3 * g[0]["source_size"] + 1e-6
        assert abs(sum(r["taken"] for r in g) - g[0]["target"]) <= max(r["size"] for r in g)
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=str) == sorted(map(tuple, rows), key=str)
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in rows if r["size"]}
    counts = {r["doc_id"]: r["count"] for r in mixing.mixed_rows(docs).groupBy("doc_id").count().collect()}
    assert all(counts.get(k, 0) == n for k, n in taken.items())
    assert mixing.mixed_rows(docs).columns == docs.columns


def test_shards_hold_the_mixture(docs, empty):
    rows = sharding.assign_shards(docs, 8).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert sharding.assign_shards(empty).count() == 0
    shards = {}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
        shards.setdefault(r["shard"], []).append(r)
    sizes = [len(x) for x in shards.values()]
    assert len(rows) == len(texts) and len(shards) == 8 and max(sizes) - min(sizes) <= 1
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in shards.values())
    share = [sum(r["source"] == "a" for r in x) for x in shards.values()]
    assert max(share) - min(share) <= 2


def test_shards_are_as_by_definition(docs, spark):
    long = spark.createDataFrame([(900, "word " * 200_000, "a"), (901, "", None), (901, "", None), (None, None, "a")], "doc_id long, text string, source string")
    rows = docs.select("doc_id", "text", "source").unionByName(long)
    drawn = rows.select("doc_id", "text", "source", F.xxhash64(F.lit(0), "doc_id", "text").alias("drawn")).collect()
    key = lambda x: (x is not None, x if x is not None else 0)  # noqa: E731  nulls first
    entries = []
    for source in {r["source"] for r in drawn}:
        of = sorted((r["drawn"], key(r["doc_id"]), zlib.crc32((r["text"] or "").encode()), r["doc_id"], len((r["text"] or "").encode())) for r in drawn if r["source"] == source)
        entries += [((i + 0.5) / len(of), source is not None, source or "", *x) for i, x in enumerate(of)]
    entries.sort(key=lambda x: x[:6])
    firsts, want = {}, []
    for i, (_, _, _, _, _, crc, doc_id, size) in enumerate(entries):
        shard = i * 7 // len(entries)
        want.append((doc_id, size + 16, crc, "rows", shard, i - firsts.setdefault(shard, i), None))
    got = sharding.assign_shards(rows, 7).drop("source").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def shingles(text, n):
    w = split(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(docs, empty, spark):
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(docs).collect()}
    assert fingerprints.edited_fingerprints(empty).count() == 0
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    order = sorted(texts, reverse=True)
    for i, k in enumerate(order):
        t, n = texts[k], len(texts[k])
        after = texts[order[(i + 1) % len(order)]]
        edited = t[: n - n // 3] + after[: n // 3]
        r = got[k]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = (shingles(x, 5) for x in (t, edited, after))
        for near, x in ((r["near_edited"], b), (r["near_next"], c)):  # exact while the union is below k
            assert near == pytest.approx(jaccard(a, x), abs=1e-9 if len(a | x) <= fingerprints.SKETCH_SIZE else 0.1)
        for inside, x in ((r["contained_edited"], b), (r["contained_next"], c)):
            assert inside == pytest.approx(len(a & x) / len(a) if a else 1.0, abs=1e-9 if len(a | x) < fingerprints.SKETCH_SIZE else 0.2)
        assert r["distinct_shingles"] == pytest.approx(len(a), rel=1e-9 if len(a) < fingerprints.SKETCH_SIZE else 0.35)
    assert got[100]["fingerprint"] == got[7]["fingerprint"]
    twice = fingerprints.edited_fingerprints(docs.unionByName(docs)).collect()
    assert len(twice) == 2 * len(got) and all(r == got[r["doc_id"]] for r in twice)
    long = spark.createDataFrame([(" ".join(map(str, range(2000))), " ".join(map(str, range(1000, 3000))))], "a string, b string")
    a, b = fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))
    near, inside, n = long.select(fingerprints.resemblance(a, b), fingerprints.containment(a, b), fingerprints.distinct_shingles(a)).first()
    assert abs(near - 1 / 3) < 0.15 and abs(inside - 0.5) < 0.2 and abs(n / 1996 - 1) < 0.35


def test_line_dedup_is_as_sql_has_it(docs, empty, spark):
    plain = docs.where("doc_id not in (102, 105)").select("doc_id", "text")
    frame = plain.toPandas()
    con = duckdb.connect()
    con.register("documents", frame)
    want = {r[0]: r[4] for r in con.sql(line_dedup.OP6_SQL).fetchall()}
    got = {r["doc_id"]: r for r in line_dedup.deduplicated(docs).collect()}
    assert all(hashlib.sha256(got[k]["text"].encode()).hexdigest() == v for k, v in want.items())
    assert got[102]["text"] is None and got[103]["text"] == "" and got[104]["text"] == " \n\t"
    assert got[107]["text"] == "again and again" and got[100]["text"].count("\n") < got[7]["text"].count("\n")
    assert line_dedup.deduplicated(docs).columns[: len(docs.columns)] == docs.columns
    assert line_dedup.deduplicated(empty).count() == 0
    assert line_dedup.deduplicated(docs.unionByName(docs)).count() == 2 * docs.count()


def test_line_dedup_of_nested_and_overlapping_runs(spark):
    """Against SQL: lines of few kinds and many lengths, a line that repeats on and on, and one very long text."""
    rng = random.Random(5)
    kinds = [" ".join(f"{k}w{i}" for i in range(n)) for k, n in enumerate((1, 3, 8, 20, 49, 60))]
    rows = [(i, "\n".join(rng.choices(kinds, k=rng.randint(0, 30)))) for i in range(60)] + [(90, "\n".join(kinds[:1] * 200))]
    once = [(i, "\n".join(f"{j} " + " ".join(f"u{j}x{k}" for k in range(12)) for j in range(n))) for i, n in ((91, 3000), (92, 3000), (93, 7))]
    frame = spark.createDataFrame(rows + once, "doc_id long, text string").repartition(7)
    con = duckdb.connect()
    con.register("documents", frame.toPandas())
    want = {r[0]: r[3] for r in con.sql(line_dedup.OP6_SQL).fetchall()}
    got = {r["doc_id"]: ",".join(map(str, r["_removed"])) for r in line_dedup.deduplicated(frame).collect()}
    assert got == want and got[92].count(",") == 2999 and not got[91]


def test_suffix_array_and_common_prefixes(spark):
    """Against sorted suffixes: their order, and how many lines neighbours share."""
    rng = random.Random(6)
    texts = {i: [rng.choice([0, 0, 0, 1, 2]) for _ in range(rng.randint(1, 40))] for i in range(12)}
    rows = [(i, 0, p, 1, len(x) - p, [v]) for i, x in texts.items() for p, v in enumerate(x)]
    level = spark.createDataFrame(rows, "id long, hash long, pos int, words int, left int, ranks array<long>")
    whole, span = level.select("id", "hash", "pos", "ranks"), 1
    while span < 16:
        whole, span = line_dedup._doubled(whole, span), span * 2
    suffixes = whole.join(level.select("id", "hash", "pos", "left"), ["id", "hash", "pos"]).withColumn("depths", F.array(F.lit(16)))
    array = line_dedup._suffix_array(suffixes)
    found = {(r["id"], r["pos"]): r for r in line_dedup._common_prefixes(array, whole, 5).collect()}
    order = sorted(((x[p : p + 16], i, p) for i, x in texts.items() for p in range(len(x))))
    assert [(i, p) for _, i, p in order] == [k for k, r in sorted(found.items(), key=lambda kv: (kv[1]["part"], kv[1]["idx"]))]
    for (a, *_), (b, i, p) in zip(order, order[1:]):
        shared = next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        lcp = found[i, p]["lcp"]
        assert lcp == shared or (shared < 16 and lcp <= shared), "exact, or known to be less than the shortest run"
        assert (lcp >= 16) == (shared >= 16)
    exact = line_dedup._common_prefixes(array.withColumn("depths", F.array(F.lit(1))), whole, 5).collect()
    for r in exact:
        if r["p_id"] is not None:
            a, b = texts[r["p_id"]][r["p_pos"] :], texts[r["id"]][r["pos"] :]
            assert r["lcp"] == next((n for n, (x, y) in enumerate(zip(a[:16], b[:16])) if x != y), min(len(a), len(b), 16))
    assert len(exact) == len(order)


def brute_simhash(text):
    w = split(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(fps):
    root = {k: k for k in fps}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in fps:
        for b in fps:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in fps}


def test_simhash(docs, empty):
    fps = {r["doc_id"]: brute_simhash(r["text"]) for r in docs.collect()}
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert {k: r["fp"] & (1 << 64) - 1 for k, r in got.items()} == fps
    assert {k: r["component_id"] for k, r in got.items()} == components(fps)
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_hashes_every_shingle_of_long_texts(monkeypatch):
    rnd = random.Random(11)
    for n in (65536, 65537, 140000):
        text = " ".join(str(rnd.randrange(10**6)) for _ in range(n + 2))
        assert simhash.simhash(text) == brute_simhash(text)
    monkeypatch.setattr(simhash, "_CHUNK", 8)
    assert all(simhash.simhash(r[1]) == brute_simhash(r[1]) for r in corpus())


def test_simhash_keeps_one_row_of_each_group(spark, empty):
    long, other, third = ("alpha beta gamma delta epsilon zeta eta theta " * 9, "one two three four five six seven " * 9, "red green blue black white brown " * 9)
    rows = [(5, long, "a"), (3, long, "b"), (3, long, "b"), (9, other, "c"), (9, long, "d"), (None, third, "e"), (None, third, "f"), (None, long, "g"), (11, None, "h"), (12, "", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3)
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in simhash.deduplicated(docs).collect())
    assert got == sorted([(3, long), (9, other), (0, third), (11, "")])
    assert simhash.deduplicated(docs).columns == docs.columns
    assert simhash.deduplicated(empty).count() == 0


def test_simhash_links_every_close_pair(spark):
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(20)]
    values = sorted({b ^ sum(1 << x for x in rnd.sample(range(64), rnd.randint(0, 4))) for b in base for _ in range(12)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    roots = connected_components(simhash.linked_fingerprints(spark.createDataFrame([(v,) for v in signed], "fp long")))
    found = {r["node"]: r["root"] for r in roots.collect()}
    groups = {}
    for v in signed:
        groups.setdefault(found.get(v, v), set()).add(v & (1 << 64) - 1)
    want = {}
    for k, r in components({i: v for i, v in enumerate(values)}).items():
        want.setdefault(r, set()).add(values[k])
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    assert {tuple(r) for r in connected_components(edges).collect()} == {(i, 0) for i in range(1, 201)} | {(501, 500)}


def test_bpe_is_as_tiktoken(docs, empty):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    ours = bpe.Encoding(PATH, PATTERN)
    rnd = random.Random(5)
    texts = ["", "a" * 5000, "<|endoftext|>", "ab" * 3000 + "!" * 777] + ["".join(rnd.choice("abcABC  \n\t'sé0159　\xa0\x85\x1c漢字😀!?-_İ²'ll're\r\x0b") for _ in range(rnd.randint(0, 80))) for _ in range(500)]
    for text, packed in zip(texts, ours.encode_all(texts)):
        assert memoryview(packed).cast("I").tolist() == theirs.encode_ordinary(text)
        assert ours.decode(packed) == text.encode()
    got = {r["doc_id"]: r for r in bpe.round_trip(docs, PATH, PATTERN).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]]["n_tokens"] == len(theirs.encode_ordinary(r["text"] or "")) and got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert bpe.round_trip(empty, PATH, PATTERN).count() == 0
    back = docs.select("text", bpe.decoded(bpe.encoded(F.col("text"), PATH, PATTERN), PATH, PATTERN).alias("b")).collect()
    assert all(bytes(r["b"]).decode() == (r["text"] or "") for r in back)


def test_bpe_leaves_ids_beside_null_ones(spark):
    big = 1 << 60
    docs = spark.createDataFrame([(big + 1, "a b"), (None, None), (big + 3, ""), (big + 3, "word " * 300_000)], "doc_id long, text string").coalesce(1)
    got = [(r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in bpe.round_trip(docs, lambda: PATH, PATTERN).collect()]
    assert [i for i, *_ in got] == [big + 1, None, big + 3, big + 3] and [n for _, n, _ in got][:3] == [2, 0, 0]
    assert [h for *_, h in got] == [hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in docs.collect()]


def test_bpe_takes_long_texts_in_parts(monkeypatch):
    text = " ".join(f"word{i}" for i in range(3000))
    whole = bpe.Encoding(PATH, PATTERN).encode(text)
    monkeypatch.setattr(bpe, "GROUP", 800)
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    assert bpe.Encoding(PATH, PATTERN).encode(text) == whole


def labelled(spark, bad):
    rnd = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        text, good = prose(rnd, 60), i % 4 != 0
        rows.append((i, text if good else bad(text, rnd)))
        labels.append((i, int(good), int(not good)))
    rows += [(900, None), (901, "")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def test_quality_holds_out(spark, empty):
    docs, labels = labelled(spark, lambda t, rnd: " ".join(w.upper() + "!!" for w in t.split()))
    got = {r["doc_id"]: r for r in quality.classified(docs, labels).collect()}
    assert len(got) == 402 and got[900]["score"] == got[901]["score"]
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    held = [r for k, r in got.items() if k < 400 and r["held_out"]]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 != 0) for r in held]) > 0.95
    assert quality.classified(empty.select("doc_id", "text"), labels).count() == 0


def brute_features(text):
    """The features by their names: words, shapes, pairs of both, and repeated words."""
    words = split(text)
    shapes = [re.sub(r"(.)\\1+", r"\\1", "".join("A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else c for c in w)) for w in words]
    pairs = list(zip(words, words[1:]))
    return [("w", w) for w in words] + [("s", x) for x in shapes] + [("ss", *x) for x in zip(shapes, shapes[1:])] + [("ww", *x) for x in pairs] + [("again",) for a, b in pairs if a == b]


def test_quality_features_are_those_of_words_and_shapes():
    texts = ["One two two, THREE 44 4.4 a", "", " \n\t ", "x", "AAbb!!  AAbb!! c1 c22 ccc333"]
    slots = {}
    for text in texts:
        raw = text.encode()
        begin, spelled, shapes = quality.word_hashes(raw)
        got = sorted(quality.features(np.zeros(len(begin), int), spelled, shapes)[1].tolist())
        names = brute_features(text)
        assert len(got) == len(names)
        for name in names:
            slots.setdefault(name, None)
    # the same name is the same slot in every text, and the slots of a text are those of its names
    for name in list(slots):
        only = {"w": lambda n: n[1], "s": None}.get(name[0])
        if only:
            begin, spelled, shapes = quality.word_hashes(only(name).encode())
            slots[name] = quality.features(np.zeros(1, int), spelled, shapes)[1][0]
    for text in texts:
        begin, spelled, shapes = quality.word_hashes(text.encode())
        got = quality.features(np.zeros(len(begin), int), spelled, shapes)[1][: len(begin)].tolist()
        assert got == [slots["w", w] for w in split(text)]


def test_ftrl_is_as_a_plain_version():
    rnd = random.Random(3)
    texts = [prose(rnd, rnd.randint(0, 30)) + (" BAD!! bad!!" if i % 3 == 0 else "") for i in range(60)]
    labels = [int(i % 3 != 0) for i in range(60)]
    got = quality.ftrl(texts, labels, epochs=2)
    z, n = {}, {}

    def weight(j):
        v = z.get(j, 0.0)
        return 0.0 if abs(v) <= quality.L1 else -(np.sign(v) * (abs(v) - quality.L1)) / ((quality.BETA + np.sqrt(n.get(j, 0.0))) / quality.ALPHA + quality.L2)

    for _ in range(2):
        for text, y in zip(texts, labels):
            slots, values = quality._vector(text)
            x = dict(zip(slots.tolist(), values.tolist())) | {quality.DIMENSIONS: 1.0}
            w = {j: weight(j) for j in x}
            p = 1 / (1 + np.exp(-sum(w[j] * v for j, v in x.items())))
            for j, v in x.items():
                g = (p - y) * v
                sigma = (np.sqrt(n.get(j, 0.0) + g * g) - np.sqrt(n.get(j, 0.0))) / quality.ALPHA
                z[j], n[j] = z.get(j, 0.0) + g - sigma * w[j], n.get(j, 0.0) + g * g
    assert set(np.flatnonzero(got).tolist()) == {j for j in z if weight(j)}
    assert all(got[j] == pytest.approx(weight(j), rel=1e-9, abs=1e-12) for j in z)


def test_quality_parts_of_a_long_text_score_as_one(monkeypatch):
    rnd = random.Random(6)
    w = np.random.default_rng(0).normal(size=quality.DIMENSIONS)
    texts = ["word. " * 9000, "", None, "A b " * 5000, "x" * 9000, "aB1" * 9000 + " " + prose(rnd, 3000) + " " + "Zz9!" * 5000 + " end", " " * 20000, prose(rnd, 4000) + " " + "q" * 8192, "é" * 9001 + " é"]
    whole, counted = quality.dot_products(texts, w), [quality._counted((t or "").encode()) for t in texts]
    monkeypatch.setattr(quality, "PART", 1 << 12)
    for text, (slots, counts, words) in zip(texts, counted):
        found, times, n = quality._counted((text or "").encode())
        assert n == words == len(split(text)) and np.array_equal(found, slots) and np.array_equal(times, counts)
    assert np.allclose(quality.dot_products(texts, w), whole, rtol=1e-9, atol=1e-9)


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(9)] + [(3, f"copy {i % 2}") for i in range(500)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)] + [(3, 1), (None, 1), (4, None)], "doc_id long, quality int")
    assert quality.training_rows(docs, labels, "quality", F.lit(False), 4).count() == 4
    rows = quality.training_rows(docs, labels, "quality", F.lit(False), 100).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(9))


def test_lexicon_is_found_and_scanned_as_a_naive_scan_has_it(spark):
    rnd = random.Random(12)
    rows = []
    for i in range(300):
        words = prose(rnd, 40).split()
        if i % 3 == 0:
            for at in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(["zorbish", "zorbling", "zorbed", "vex"]))
        elif i % 3 == 1:
            words[7:7] = ["mild", "vex"]  # clean, unlike its second word
            if i % 5 == 0:
                words.insert(rnd.randrange(len(words)), "zorbonne")  # begins as an entry, and is clean
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int")
    entries, exceptions = toxicity.learn_lexicon(frame)
    assert any(" zorb".startswith(p) or p.startswith(" zorb") for p, _ in entries)
    assert " zorbonne " in exceptions
    built = toxicity.automaton(entries, [*exceptions, " mild vex "])
    for _, text, label in rows[:60] + [(0, "A mild vex, zorbonne; ZORBED!", 1), (0, "", 0)]:
        folded = toxicity.fold(text)
        total = 0.0
        for at, c in enumerate(folded):
            best = max((w for p, w in entries if folded.startswith(p, at)), default=0.0)
            words_before = folded[: at + 1]
            excused = any(folded.startswith(e, at - i) for e in [*exceptions, " mild vex "] for i, x in enumerate(e[:-1]) if x == " " and at >= i)
            total += 0.0 if excused or not words_before else best
        got = toxicity.evidence(text, built)
        assert got == pytest.approx((np.log1p(total), np.log1p(1000 * total / len(folded))))
    assert toxicity.evidence("a mild vex", built)[0] == 0.0
    assert toxicity.learn_lexicon(frame.where("label = 0")) == ([], []) and len(toxicity.fold("x" * 1_000_000)) == 1_000_002


def test_toxicity_holds_out(spark, empty):
    bad = lambda t, rnd: " ".join(x for w in t.split() for x in ((w, rnd.choice(["grubby", "Vex" + w[:3], "gr\u03c5bby"])) if rnd.random() < 0.15 else (w,))) + " grubby"
    docs, labels = labelled(spark, bad)
    got = {r["doc_id"]: r for r in toxicity.classified(docs, labels).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items())
    held = [r for k, r in got.items() if k < 400 and r["held_out"]]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held]) > 0.95 and got[900]["predicted"] == 0
    assert toxicity.classified(empty.select("doc_id", "text"), labels).count() == 0


def test_folding_and_exceptions():
    built = toxicity.automaton([(" grub", 2.0), (" vex ", 1.0)], [" grubstake "])
    hit = lambda t: toxicity.evidence(t, built)[0] > 0
    assert hit("GRUBBY") and hit("grubby") and hit("ѵех vex.") and hit("grub") and hit("ｇrub") and not hit("a grubstake") and not hit("vexed") and not hit(None)


PAGE = """<html><head><title>T</title><script>var a="</p><p>x";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> -->
<div class="ad">Buy</div><header>Top</header><article><h1>Head</h1><p><b>One &amp; two.<br><p>Three
 four&nbsp;five.</p><aside>Side</aside><form>Send</form><div class="comments"><p>Me too</p></div></article><footer>&copy; me</footer></body></html>"""


def test_html(spark):
    assert html_text.main_text(PAGE) == "Head\nOne & two.\nThree four five."
    long = "Words of the text that go on and on, for a line that is long enough to count. " * 2
    bare = f"<body><div id=menu><a>x</a></div><h1>Title</h1><div>{long}</div><p>{long}</p><div class='cookie-notice'>{long}</div></body>"
    assert html_text.main_text(bare) == f"Title\n{long.strip()}\n{long.strip()}"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p>") == "" and html_text.main_text("a < b") == "a < b"
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (None, None, None, None)], "page_id long, url string, html string, text string")
    assert [r["n_chars"] for r in html_text.extract(pages).collect()].count(0) == 1
    assert html_text.extract(pages.limit(0)).count() == 0


def test_neighbours_reach_recall(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(3000, 32))
    v[2000:2900] = v[2000]  # a large group of equal vectors
    rows = [(i, [float(x) for x in v[i]], 0) for i in range(3000)] + [(5000, None, 0), (5020, [0.0] * 32, 0), (5040, [float("nan")] + [1.0] * 31, 0), (5060, [None] * 32, 0), (5080, [1.0], 0)]
    found = neighbours.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 20 == 0).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 3000, 20))
    hits = 0
    for q, near in got.items():
        s = (v * v[q]).sum(1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(3000), -s))[:20]
        hits += len({i for i, _ in near} & set(want.tolist()))
        assert len(near) == 20 and all(s[i] == pytest.approx(x, abs=1e-12) for i, x in near)
    assert hits / (20 * len(got)) >= 0.9
    few = neighbours.nearest_neighbours(spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 20 == 0)
    assert [r["rank"] for r in few.orderBy("rank").collect()] == [1, 2, 3]
    assert neighbours.nearest_neighbours(spark.createDataFrame([], "vec_id long, embedding array<double>, label int"), F.lit(True)).count() == 0


def test_html_keeps_articles_in_hinted_elements_and_short_paragraphs():
    long = ("Words of the text that go on and on, for a line that is long enough to count. " * 2).strip()
    page = "<body><div class=menu>x</div><div class='layout has-sidebar'>{}</div><div class=footer>y</div></body>"
    for inner in (f"<article><p>Short.</p><p>{long}</p></article>", f"<div><main><p>Short.</p><p>{long}</p></main></div>"):
        assert html_text.main_text(page.format(inner)) == f"Short.\n{long}"
    assert html_text.main_text(f"<article>{long}</article><div class=sidebar><article>Teaser</article></div>") == long
    assert html_text.main_text(f"<p>{long}</p><div class=related><article>Teaser</article></div>") == long
    furniture = "<nav><p>a</p><p>b</p><p>c</p></nav>"
    assert html_text.main_text(f"{furniture}<p>Short.</p>{furniture}<p>{long}</p>{furniture}<p>End.</p>{furniture}") == f"Short.\n{long}\nEnd."


def test_neighbours_of_repeated_ids_and_short_files(spark, monkeypatch):
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(2, 16)).tolist()
    rows = [(i, rng.normal(size=16).tolist()) for i in range(1, 300)] + [(0, a), (0, b), (400, a), (400, a), (401, b)]
    rows += [(500 + i, [9.0] * 16) for i in range(150)]  # a large group of equal vectors
    frame = spark.createDataFrame([*rows, (None, a)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(neighbours, "LOOKED_UP", 1)  # files hold too few rows for some queries
    got = {}
    for r in neighbours.nearest_neighbours(frame, F.col("vec_id").isin(0, 7, 510)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {0, 7, 510} and all([n for n, *_ in sorted(x)] == list(range(1, 21)) for x in got.values())
    assert not any(i == q for q, x in got.items() for _, i, _ in x)
    assert [i for _, i, _ in sorted(got[510])] == [500 + i for i in range(21) if i != 10]
    monkeypatch.setattr(neighbours, "RERANKED", 1.0)
    monkeypatch.setattr(neighbours, "LOOKED_UP", 500)  # all files: exact
    exact = sorted((r["rank"], r["vec_id"], r["score"]) for r in neighbours.nearest_neighbours(frame, F.col("vec_id") == 0).collect())
    want = sorted((-max(float(np.dot(v, a)), float(np.dot(v, b))), i) for i, v in rows if i != 0)[:20]
    assert [(n, i) for n, i, _ in exact] == [(n + 1, i) for n, (_, i) in enumerate(want)] and [s for *_, s in exact] == pytest.approx([-s for s, _ in want])


def test_neighbours_search_every_length_and_deal_repeated_ids(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8 if i % 3 else 5).tolist()) for i in range(90)] + [(200, rng.normal(size=8).tolist()) for _ in range(60)] + [(300, [1.0] * 5)] * 40
    whole = neighbours.INDEX_BLOCK
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (whole, 16):
        monkeypatch.setattr(neighbours, "INDEX_BLOCK", block)
        got = {}
        for r in neighbours.nearest_neighbours(frame, F.col("vec_id").isin(3, 4, 9, 10)).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        assert set(got) == {3, 4, 9, 10}
        for q, near in got.items():
            own = np.array(dict(rows)[q])
            want = sorted(((-float(own @ np.array(v)), i) for i, v in rows if i != q and len(v) == len(own)))[:20]
            assert [i for _, i, _ in sorted(near)] == [i for _, i in want] and [x for _, _, x in sorted(near)] == pytest.approx([-s for s, _ in want])
