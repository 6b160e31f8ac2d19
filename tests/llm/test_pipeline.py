"""The pipeline on a small fixture: each stage's decisions take effect and its last rows decode to the texts before."""

import hashlib
import random

import public_tokenizers

import corpus_pipeline
from llm import bpe


def prose(rnd, n):
    return " ".join("".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(1, 8))) for _ in range(n))


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i, prose(rnd, 80) if i % 5 else " ".join(w.upper() + "!!" for w in prose(rnd, 60).split()), "en", f"s{i % 3}", 1) for i in range(200)]
    rows += [(500 + i, rows[1][1], "en", "s0", 1) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], int(r[0] % 5 != 0 or r[0] >= 500), 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        seen = spark.read.parquet(str(tmp_path / name))
        ids = {r["doc_id"] for r in seen.collect()}
        if name == "quality_filter":
            assert len([i for i in ids if i < 200 and i % 5]) >= 155 and len([i for i in ids if i < 200 and not i % 5]) <= 4
        if name == "near_deduplication":
            assert len([i for i in ids if i >= 500 or i == 1]) == 1
    texts = sorted(r["text"] for r in seen.collect())
    own = bpe.Encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    done = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(own.decode(bytes(r["ids"])).decode() for r in done) == texts
    assert corpus_pipeline.ORACLE_SQL is None


def test_near_deduplication_drops_edited_copies(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(i, prose(rnd, 120)) for i in range(60)]
    for i in range(30):  # 2 words of 120 differ: an index of about 0.84; half of them: below
        words = rows[i][1].split()
        for at in (30, 90) if i < 20 else range(0, 120, 2):
            words[at] = "edited" + str(at)
        rows.append((100 + i, " ".join(words)))
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    out = dict(corpus_pipeline.STAGES)["near_deduplication"](spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [*range(60), *range(120, 130)]


def test_token_encoding_decodes_what_it_encodes(spark, tmp_path):
    texts = ["", "one two", "é漢😀 \n\t x" * 50, None]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(None, "last", "s")], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in dict(corpus_pipeline.STAGES)["token_encoding"](spark, docs, str(tmp_path)).collect()}
    own = bpe.Encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for k, t in [*enumerate(texts), (None, "last")]:
        assert got[k]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
        assert bytes(got[k]["ids"]) == own.encode(t or "") and got[k]["n_tokens"] * 4 == len(got[k]["ids"])


def test_stages_take_nulls_empty_texts_and_clashing_names(spark, tmp_path):
    rnd = random.Random(5)
    passage = prose(rnd, 60)
    names = ["_score", "_lines", "_removed", "_doc", "_n", "_ids", "_f", "id", "hash", "row", "key", "size", "set", "band", "gone", "part", "idx", "lines", "removed", "target", "source_size"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    texts = [(i, prose(rnd, 40) + "\n" + passage) for i in range(12)] + [(None, prose(rnd, 30)), (20, None), (21, ""), (22, " \n"), (None, None), (23, "x " * 100_000), (3, prose(rnd, 20))]
    texts += [texts[0]] * 2
    rows = [(i, t, "en", None if k % 4 == 0 else f"s{k % 2}", 1, *[f"{n}{k}" for n in names]) for k, (i, t) in enumerate(texts)]
    spark.createDataFrame([(i, i % 2, 0) for i in range(6)], "doc_id long, quality int, toxic int").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    for data in (rows, []):
        seen = spark.createDataFrame(data, schema)
        columns = seen.columns
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, seen, str(tmp_path))
            out.write.mode("overwrite").parquet(str(tmp_path / f"{name}{len(data)}"))
            seen = spark.read.parquet(str(tmp_path / f"{name}{len(data)}"))
            if name != "token_encoding":
                assert seen.columns == columns
                own = {r["_score"]: r for r in seen.collect()}
                assert all(all(r[n] == f"{n}{k[6:]}" for n in names) for k, r in own.items())
            if name == "quality_filter":
                assert seen.count() == len(data)
            if name == "line_deduplication" and data:
                assert sum(passage in (r["text"] or "") for r in own.values()) == 3  # the first document is there three times
            if name == "near_deduplication" and data:
                assert sum(not (r["text"] or "").strip() for r in own.values()) == 1
        assert (seen.count() > 0) == bool(data)
