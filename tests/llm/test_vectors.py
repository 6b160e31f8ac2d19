"""Codes, whitening and packing against brute force, with nulls, empty values, ties, repeated rows and clashing columns."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm import codes, packing, whitening

VECTORS = "vec_id long, embedding array<float>, label int, x int, code string, length int, n long, part int"
NAN, INF = float("nan"), float("inf")


def vector_rows(n=60, d=16, seed=3):
    rnd = np.random.default_rng(seed)
    rows = [(i, rnd.normal(0, 0.2, d).tolist(), i % 3 if i % 7 else None, 1, "c", 2, 3, 4) for i in range(n)]
    same = rows[5][1]
    rows += [(n + i, same, 1, 1, "c", 2, 3, 4) for i in range(40)] + [rows[8]] * 3
    rows += [(900, None, 1, 1, "c", 2, 3, 4), (901, [NAN] * d, 1, 1, "c", 2, 3, 4), (902, [INF] + [0.0] * (d - 1), 1, 1, "c", 2, 3, 4), (903, [None] + [0.0] * (d - 1), 1, 1, "c", 2, 3, 4)]
    return rows + [(None, [0.25] * d, None, 1, "c", 2, 3, 4), (904, [-0.0] * d, 2, 1, "c", 2, 3, 4)]


def kept(rows):
    return [(i, v, label) for i, v, label, *_ in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]


def plain_codes(rows, parts=8, entries=16, rounds=6):
    rows = [(i, np.floor(4096 * np.array(v, np.float32).astype(float)).astype(int), label) for i, v, label in kept(rows)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1].tolist()))
    x = np.array([r[1] for r in rows]).reshape(len(rows), parts, -1)
    out, total, books = [[] for _ in rows], np.zeros(len(rows), int), []
    for p in range(parts):
        book = [e.tolist() for e in x[:entries, p]]
        near = lambda v: min(range(len(book)), key=lambda e: (sum((a - b) ** 2 for a, b in zip(v, book[e])), e))  # noqa: E731, B023
        for _ in range(rounds):
            own = [near(v) for v in x[:, p].tolist()]
            for e in set(own):
                members = [v for v, o in zip(x[:, p].tolist(), own) if o == e]
                book[e] = [sum(c) // len(members) for c in zip(*members)]
        for i, v in enumerate(x[:, p].tolist()):
            out[i].append(e := near(v))
            total[i] += sum((a - b) ** 2 for a, b in zip(v, book[e]))
        books.append(np.array(book))
    by_label = Counter()
    for (_, _, label), e in zip(rows, total.tolist()):
        by_label[label] += e
    return [(r[0], bytes(c).hex(), e, by_label[r[2]], codes.codebooks_hash(books)) for r, c, e in zip(rows, out, total.tolist())]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_codes_are_as_plain_lloyd_has_them(spark):
    rows = vector_rows()
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = codes.compressed(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert order(map(tuple, got.collect())) == order(plain_codes(rows))


def test_codes_sql_is_the_same(spark, tmp_path):
    rows = [r for r in vector_rows() if r[0] is not None]
    spark.createDataFrame(rows, VECTORS).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert order(con.sql(codes.OP11_SQL).fetchall()) == order(plain_codes(rows))


def test_codes_of_few_vectors_other_lengths_and_none(spark):
    df = spark.createDataFrame([(1, [0.5] * 9, 1, 1, "", 1, 1, 1), (2, [], 1, 1, "", 1, 1, 1), (3, [0.1] * 8, 1, 1, "", 1, 1, 1), (4, [0.9] * 8, 1, 1, "", 1, 1, 1)], VECTORS)
    got = {r["vec_id"]: r for r in codes.compressed(df).collect()}
    assert {i: (r["code"], r["error"]) for i, r in got.items()} == {1: ("00" * 8, 0), 2: ("00" * 8, 0), 3: ("00" * 8, 0), 4: ("01" * 8, 0)}
    assert codes.compressed(df.where("false")).count() == 0
    with pytest.raises(Exception, match="beyond"):
        codes.compressed(spark.createDataFrame([(1, [1e30] * 8, 1, 1, "", 1, 1, 1)], VECTORS))


def test_a_walk_assigns_as_plain_comparison():
    rnd = np.random.default_rng(0)
    for t in range(150):
        d, n, m, high = (int(rnd.choice(c)) for c in ([0, 1, 3, 8], [1, 7, 40, 300], [1, 5, 16], [2, 40, 4000]))
        points = rnd.integers(-high, high, (n, d)) + rnd.integers(0, 3, (n, 1)) * 3 * high
        entries = points[rnd.integers(0, n, m)] if t % 2 else rnd.integers(-high, high, (m, d))
        found, sums, counts = codes.assigned(points, codes.Tree(points, int(rnd.choice([1, 4, 16]))), entries)
        want = ((points[:, None] - entries[None]) ** 2).sum(2).argmin(1)
        assert (found == want).all()
        assert all((sums[e] == points[want == e].sum(0)).all() and counts[e] == (want == e).sum() for e in range(m))


def test_whole_nodes_are_assigned_by_cached_sums(monkeypatch):
    compared = []
    leaves = codes._leaves
    monkeypatch.setattr(codes, "_leaves", lambda points, order, edges, part, *rest: (compared.append(int(np.diff(edges)[np.unique(part)].sum()) if len(part) else 0), leaves(points, order, edges, part, *rest)))
    rnd = np.random.default_rng(1)
    centres = rnd.integers(-4000, 4000, (8, 4))
    points = centres[rnd.integers(0, 8, 4000)] + rnd.integers(-5, 6, (4000, 4))
    found, _, _ = codes.assigned(points, codes.Tree(points, 16), centres)
    assert (found == ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)).all()
    assert sum(compared) < 200


def test_whitening_is_as_a_dense_solver_has_it(spark):
    rows = vector_rows()
    got = whitening.whitened(spark.createDataFrame(rows, VECTORS).repartition(4)).collect()
    every = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v, _ in kept(rows)]
    x = np.unique(np.array([v for _, v in every]), axis=0)
    n, sums = len(x), x.sum(axis=0)
    c = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1][:4], axes[:, ::-1][:, :4]
    assert len(got) == 4 * len(every) and {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-10
    rows_of = defaultdict(list)
    for r in got:
        rows_of[r["vec_id"]].append(r)
    sign = {}
    for i, v in every:
        for r in rows_of[i]:
            k = r["component"] - 1
            want = (v - sums / n) @ axes[:, k] / np.sqrt(values[k])
            assert r["deviation"] == sum(int(a) ** 2 for a in n * v - sums)
            assert abs(r["explained"] - values[k] / np.trace(c.T @ c / n)) < 1e-12
            assert abs(abs(r["whitened"]) - abs(want)) < 1e-9
            if abs(want) > 1e-3:
                assert sign.setdefault(k, np.sign(want * r["whitened"])) == np.sign(want * r["whitened"])


def test_whitening_of_few_vectors_and_none(spark):
    one = spark.createDataFrame([(1, [0.5, 0.25], 1, 1, "", 1, 1, 1), (2, [], 1, 1, "", 1, 1, 1), (None, [0.5, 0.25], 1, 1, "", 1, 1, 1)], VECTORS)
    got = whitening.whitened(one).collect()
    assert len(got) == 4 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got} == {(1, 0, None, None, None)}
    line = spark.createDataFrame([(i, [i / 8, i / 4, 0.0], 1, 1, "", 1, 1, 1) for i in range(9)], VECTORS)
    got = whitening.whitened(line).collect()
    assert [r["explained"] for r in got if r["vec_id"] == 3] == pytest.approx([1, 0, 0], abs=1e-9)
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in got) and max(r["identity_error"] for r in got) < 1e-10
    assert whitening.whitened(one.where("false")).count() == 0


def test_jacobi_davidson_finds_the_leading_pairs():
    rnd = np.random.default_rng(0)
    for t in range(60):
        d = int(rnd.integers(1, 70))
        r = int(rnd.integers(1, d + 1))
        b = np.linalg.qr(rnd.standard_normal((d, d)))[0][:, :r] * rnd.choice([1.0, 2.0, 3.0], r) if t % 3 == 0 else rnd.standard_normal((d, r))
        a = b @ b.T * 10.0 ** rnd.integers(-6, 6)
        values, axes = whitening.leading(lambda x: a @ x, d, 4)  # noqa: B023
        want = np.linalg.eigvalsh(a)[::-1][:4]
        assert np.abs(values - want).max() < 1e-12 * want[0] and np.linalg.norm(a @ axes - axes * values) < 1e-12 * want[0]


TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, n long, queue int, first long, ids string, part int"


def document_rows(seed=2):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, text(rnd.randint(0, 300)), rnd.choice(["a", "a", "a", "b", "c", None, "rare" if i == 3 else "a"])) for i in range(120)]
    rows += [(200, None, "a"), (201, "", "b"), (202, None, None), (None, "one  two \n\n three\t", "b"), (None, text(9000), "long"), (203, " leading  and trailing ", "c"), (204, "é漢😀　x\x1cy\x85 <|endoftext|>'s" * 20, "c")]
    rows += [rows[7]] * 3
    return [(i, t, "en", s, 0, 1, 2, 3, "i", 4) for i, t, s in rows]


def whole_ids(text):
    own = Tokenizer.from_file(TOKENIZER)
    own.encode_special_tokens = True
    return own.encode(text or "", add_special_tokens=False).ids + [0]


def test_packing_places_every_id_once_in_its_sources_proportion(spark):
    rows = document_rows()
    got = packing.pack(spark.createDataFrame(rows, DOCUMENTS).repartition(5), TOKENIZER, width=64).collect()
    by_id = defaultdict(list)
    for i, text, _, source, *_ in rows:
        by_id[i].append((whole_ids(text), source))
    total = sum(len(ids) for own in by_id.values() for ids, _ in own)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    sizes = []
    for i in sorted(sequences):
        ends = 0
        for at, length in sorted(sequences[i]):
            assert at == ends and length > 0
            ends += length
        sizes.append(ends)
    tail = sizes[total // 64 :]
    assert sizes[: total // 64] == [64] * (total // 64) and sum(tail) == total % 64 and all(s & (s - 1) == 0 for s in tail) and len(set(tail)) == len(tail)
    mine = defaultdict(list)
    for r in got:
        mine[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for i, own in by_id.items():
        if len(own) == 1:
            ids = own[0][0]
            at = 0
            for start, length, crc, n in sorted(mine[i]):
                assert start == at and n == len(ids) and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
                at += length
            assert at == len(ids)
        else:
            assert sum(p[1] for p in mine[i]) == sum(len(ids) for ids, _ in own)
    source_of = {i: own[0][1] for i, own in by_id.items() if len({s for _, s in own}) == 1}
    share = Counter()
    for own in by_id.values():
        for ids, source in own:
            share[source] += len(ids) / total
    seen, packed = Counter(), 0
    for i in range(total // 64):
        packed += 64
        for r in got:
            if r["sequence_id"] == i and r["doc_id"] is not None:
                seen[source_of[r["doc_id"]]] += r["length"]
        assert all(abs(seen[s] - packed * share[s]) < 3 for s in ("a", "c", None, "rare"))


def test_packing_of_no_rows(spark):
    df = spark.createDataFrame([], DOCUMENTS)
    assert packing.pack(df, TOKENIZER).count() == 0
    one = packing.pack(spark.createDataFrame([(1, None, "en", None, 0, 1, 2, 3, "i", 4)], DOCUMENTS), TOKENIZER).collect()
    assert [tuple(r) for r in one] == [(1, 0, 1, zlib.crc32(b"\0" * 4), 1, 0, 0)]


def test_packing_with_more_sources_than_queues(spark, monkeypatch):
    monkeypatch.setattr(packing, "QUEUES", 3)
    rows = [(i, "some words of a text", "en", f"s{i % 9}", 0, 1, 2, 3, "i", 4) for i in range(90)]
    got = packing.pack(spark.createDataFrame(rows, DOCUMENTS).repartition(4), TOKENIZER, width=32).collect()
    assert sum(r["length"] for r in got) == 90 * len(whole_ids("some words of a text")) and len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)


def test_windows_of_a_plan_are_full_and_in_proportion():
    rnd = random.Random(4)
    for _ in range(60):
        totals = [rnd.choice([1, 2, 5, 40, 3000, 70000]) + rnd.randint(0, 9) for _ in range(rnd.randint(1, 30))]
        plan = packing.Plan(totals, 64, 8)
        for block in range(-(-plan.windows // 8)):
            bounds, offsets = plan.dealt(block)
            assert (np.diff(bounds) >= 0).all() and (bounds[:, 0] == plan.before(block)).all() and (bounds[:, -1] == plan.before(block + 1)).all()
            sizes = np.diff(bounds).sum(axis=0)
            assert sizes.tolist() == [plan.capacity(w + 1) - plan.capacity(w) for w in range(block * 8, min(block * 8 + 8, plan.windows))]
            for w in range(bounds.shape[1]):
                share = plan.capacity(min(block * 8 + w, plan.windows)) * np.array(totals) / sum(totals)
                assert np.abs(bounds[:, w] - share).max() < 1 + len(totals) / 2


def test_units_have_the_ids_of_the_whole_text(monkeypatch):
    own, rnd = packing.Encoder(TOKENIZER), random.Random(1)
    parts = ["a", "Bc", "12", "!", " ", " ", "  ", "\n", "\t", "\xa0", "　", "'s", "é", "漢", "\x1c", "\x85", "😀", "<|endoftext|>"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(800)] + ["one two\nthree, four 5\nsix ", "x" * 3000, " ".join(["word"] * 500)]
    reference = Tokenizer.from_file(TOKENIZER)
    reference.encode_special_tokens = True
    want = [np.array(e.ids, own.kind).tobytes() for e in reference.encode_batch(texts, add_special_tokens=False)]
    assert list(own.encode_all(texts)) == want
    monkeypatch.setattr(packing, "GROUP", 40)
    monkeypatch.setattr(packing, "REMEMBERED", 20)
    assert list(own.encode_all(texts)) == want
