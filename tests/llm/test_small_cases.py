"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from foliant.llm import byte_bpe, chat_format, exact_dedup, hnsw, jaccard, license_scan, mixing, quality, ring_sharding, wavelet
from foliant.llm.pretoken import split
from foliant.runtime import fresh_path

LONG = "word " * 60_000
TEXTS = [None, "", " ", "same text here now", "same text here now", "same text here now", "Other text, a bit longer than that.", LONG, LONG, "é日本 🙂\n\n x"]
CLASH = ["recipe", "rate", "copies", "arc", "rank", "shard", "n", "comp", "keep_id", "size", "position", "token", "score", "g_id", "row"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", ["b", "a", None][i % 3], len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [rows[3], (None, "no id", "en", "a", 5), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def test_exact_dedup(docs, none):
    rows = exact_dedup.dedup_groups(docs).collect()
    groups = {}
    for d in docs.collect():
        groups.setdefault(d["text"] or "", []).append(-1 if d["doc_id"] is None else d["doc_id"])
    assert len(rows) == docs.count()
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in rows:
        ids = by_sha[r["text_sha256"]]
        assert r["keep_id"] == (max(ids) if max(ids) >= 0 else None) and r["group_size"] == len(ids)
        assert r["kept"] == (r["doc_id"] == r["keep_id"])
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.dedup_groups(none).count() == 0 and exact_dedup.drop_duplicates(none).count() == 0


def test_exact_dedup_with_colliding_digests(docs):
    weak = exact_dedup.dedup_groups(docs, lambda chunk: len(chunk) % 2)
    want = {(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in exact_dedup.dedup_groups(docs).collect()}
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in weak.collect()} == want


def test_chunk_borders_depend_on_content_only():
    data = np.random.default_rng(0).integers(0, 256, 50_000, dtype=np.uint8)
    (a,) = exact_dedup.chunk_bounds(data, np.array([0, len(data)]))
    _, b = exact_dedup.chunk_bounds(np.concatenate([data[:777], data]), np.array([0, 777, 777 + len(data)]))
    assert [x - 777 for x in b] == a and len(a) > 20
    assert max(np.diff(a)) <= exact_dedup.MAX_CHUNK


def test_chat_format(spark):
    rows = [
        (1, 0, "user", "hi <|end|>\n \\b \\l <"), (1, 1, "assistant", "a\\lb <|assistant|>"), (1, 2, "user", None), (1, 3, "assistant", ""),
        (2, 0, "user", "only"), (None, 0, "assistant", "x"), (3, None, None, "t"), (3, 5000, "assistant", "late"), (3, 5000, "assistant", "late"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("block", F.lit(1)).withColumn("segment", F.lit("s"))
    made = chat_format.segments(turns)
    back = {(r["conv_id"], r["place"]): (r["role"], r["text"]) for r in chat_format.parse(made).collect()}
    assert back[1, 0] == ("user", rows[0][3]) and back[1, 1] == ("assistant", rows[1][3]) and back[1, 3] == ("assistant", "")
    assert back[None, 0] == ("assistant", "x") and back[3, 2] == ("assistant", "late")
    shown = chat_format.examples(made)
    losses = {(r["conv_id"], r["place"]): (r["loss_text"], r["whole"]) for r in chat_format.read_examples(made, shown).collect()}
    assert losses == {(1, 1): (rows[1][3], True), (1, 3): ("", True), (None, 0): ("x", True), (3, 1): ("late", True), (3, 2): ("late", True)}
    got = {r["conv_id"]: r for r in chat_format.digests(made, shown).collect()}
    assert got[1]["n_turns"] == 4 and got[2]["loss_chars"] == 0 and got[3]["n_examples"] == 2
    said = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in rows[:4])
    assert got[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    literal = {(r["conv_id"], r["place"]): r for r in chat_format.expand(made).collect()}
    stream = "".join(r["segment"] for r in sorted((r for r in made.collect() if r["conv_id"] == 1), key=lambda r: r["place"]))
    e = literal[1, 3]
    assert stream.startswith(e["prompt"]) and e["prompt"].endswith("<|assistant|>\n") and e["reply"] == "" and len(literal) == 5
    assert literal[1, 1]["reply"] == rows[1][3].replace("\\", "\\b").replace("<", "\\l")
    for r in shown.where("conv_id = 1").collect():  # offsets against the literal prompt
        assert stream[: r["loss_start"]] == literal[1, r["place"]]["prompt"] and stream[r["loss_start"] : r["loss_end"]] == literal[1, r["place"]]["reply"]
        assert stream[: r["context_chars"]].count("<|end|>\n") == r["context_turns"]
    none = chat_format.segments(turns.where("false"))
    assert chat_format.digests(none, chat_format.examples(none)).count() == 0


def test_chat_format_of_long_texts_and_many_examples(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", "<\\é" * 40_000 if t == 3 else f"turn {t}") for t in range(2500)]
    made = chat_format.segments(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    shown = chat_format.examples(made)
    (r,) = chat_format.digests(made, shown).collect()
    said = "".join(x[3] for x in rows if x[1] % 2)
    assert (r["n_examples"], r["n_whole"], r["loss_chars"]) == (1250, 1250, len(said))
    assert r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert r["turns_sha256"] == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in rows).encode()).hexdigest()


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(8)] + [(3, None, None), (None, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert quality.classify(none, labels).count() == 0
    assert {r["score"] for r in quality.classify(docs, labels.where("false")).collect()} == {0.5}
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_scorer_is_the_mean_of_features():
    rng = np.random.default_rng(1)
    model = quality.Model(rng.normal(size=quality.BUCKETS), 0.3)
    texts = ["a b  c\tlonger words here", "", "a", "ünï cödé a b", "x " * 500]
    for t, s in zip(texts, model.scorer()(texts)):
        ids, n = quality.featurize(t)
        mean = (model.weights[ids] * n).sum() / max(n.sum(), 1)
        assert s == pytest.approx(1 / (1 + np.exp(-mean - 0.3)), abs=1e-6)


def test_jaccard(docs, none):
    rows = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similarity_components(docs).collect()}
    assert {(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 2, 3), (4, 2, 3), (5, 2, 3), (7, 1, 7), (8, 1, 7), (None, 1, None), (None, 0, None)} <= rows
    assert jaccard.similarity_components(none).count() == 0
    assert jaccard.keep_one(docs).columns == docs.columns


@pytest.mark.parametrize("block_rows", [4096, 3, 1])
def test_jaccard_of_repeated_ids_and_long_lists(spark, block_rows):
    """Rows that repeat an id with other texts are nodes of their own; lists in units give the same links."""
    from test_queries import brute_components

    base = [f"w{i}" for i in range(60)]
    near = [" ".join(base[:i] + ["x"] * (i % 3) + base[i:]) for i in range(0, 60, 4)]
    chain = [" ".join(f"c{j}" for j in range(i * 4, i * 4 + 60)) for i in range(12)]
    texts = [*near, *chain, "quite another text of seven words here", "a b c d e f g h"]
    rows = [(10 + i, t) for i, t in enumerate(texts)]
    want = brute_components(rows, 3, 60)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similarity_components(frame, 3, 60, block_rows).collect()}
    assert got == want
    # (1, b), (1, a), (2, a and one word more): ids 1 and 2 link, b stays apart
    a, b = " ".join(base), "entirely different words for the other row with this id"
    odd = spark.createDataFrame([(1, b), (1, a), (2, a + " more"), (5, a + " end"), (5, "a text that only row five has at all")], "doc_id long, text string")
    parts = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similarity_components(odd, block_rows=block_rows).collect())
    assert parts == [(1, 8, 1), (1, 58, 1), (2, 59, 1), (5, 7, 5), (5, 59, 1)]
    kept = sorted((r["doc_id"], r["text"]) for r in jaccard.keep_one(odd, 3, 90).collect())
    assert kept == sorted([(1, b), (1, a), (5, "a text that only row five has at all")])


def test_pipeline_of_odd_rows(spark, docs, none, tmp_path):
    """Every stage: nulls, empty and long texts, repeated rows, clashing columns, an empty table."""
    import corpus_pipeline

    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(8)] + [(None, 1, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        texts = {r["text"] for r in out.select("text").collect()}
        assert texts <= {r["text"] for r in docs.select("text").collect()}, name
        assert stage(spark, none, str(tmp_path)).count() == 0, name
    rows = corpus_pipeline.encode(spark, docs, str(tmp_path)).collect()
    assert len(rows) == docs.count() and corpus_pipeline.encode(spark, none, str(tmp_path)).count() == 0
    kept = corpus_pipeline.drop_near_copies(spark, corpus_pipeline.drop_copies(spark, docs, ""), "").collect()
    assert len([r for r in kept if r["text"] == LONG]) == 1 and len([r for r in kept if not (r["text"] or "").strip()]) == 2


def test_quality_ties_and_repeated_ids(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(8)], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs, labels).collect()
    tie = rows[4]["score"]
    again = quality.classify(docs, labels, threshold=tie).collect()
    assert {(r["score"], r["predicted"]) for r in again} == {(r["score"], int(r["score"] >= tie)) for r in rows}
    assert {r["text"] for r in quality.keep_good(docs, labels, tie).collect()} >= {r["text"] for r in docs.collect() if r["doc_id"] == rows[4]["doc_id"]}
    # an id that a million rows repeat is one row of training; a small bound leaves the prior
    many = docs.unionByName(docs.where("doc_id = 3")).unionByName(docs.where("doc_id = 3").withColumn("text", F.lit("zzz")))
    assert quality.fit(many, labels).weights.shape == (quality.BUCKETS,)
    assert not quality.fit(docs, labels, max_features=-1).weights.any()


def test_jaccard_of_short_texts_alone(spark):
    import pyarrow as pa

    for words in range(7):
        (s,) = jaccard.shingle_sets(pa.array([" ".join("abcdef"[:words])]), 5)
        assert len(s) == (0 if not words else max(1, words - 4))
    long = "x " * (jaccard.SPAN // 2 + 10)
    for texts in (["p q r", long], [long, "p q r"], ["p q r"]):
        assert [len(s) for s in jaccard.shingle_sets(pa.array(texts), 5)] == [1] * len(texts)
    rows = [(words, " ".join("abcdefg"[:words])) for words in range(7)] + [(7, "a b c"), (8, long)]
    parts = spark.sparkContext.parallelize(rows, len(rows))  # one text a partition
    found = jaccard.similarity_components(spark.createDataFrame(parts, "doc_id long, text string"), 5, 80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == {
        0: (0, 0), 1: (1, 1), 2: (1, 2), 3: (1, 3), 4: (1, 4), 5: (1, 5), 6: (2, 6), 7: (1, 3), 8: (1, 8)
    }


def test_sharding(docs, none):
    for shards in (1, 4, 16):
        rows = ring_sharding.assign_shards(docs, shards).collect()
        counts = [sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(shards)]
        assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1
        assert sum(map(len, counts)) == docs.count()
    assert {r["size"] for r in rows if r["doc_id"] in (0, 1)} == {1}
    assert ring_sharding.assign_shards(none).count() == 0


def test_sharding_moves_little():
    nodes = ring_sharding.ring(16, 64)
    counts = {a: 100 for a in range(len(nodes))}
    plan = ring_sharding.deal(counts, nodes, ring_sharding.capacities(sum(counts.values()), 16, 0.0))
    home = sum(hi - lo for arc, lo, hi, shard, _ in plan if nodes[arc][1] == shard)
    assert sum(hi - lo for _, lo, hi, _, _ in plan) == 102_400 and home > 90_000


def test_wavelet(spark, docs, none):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(JSON)
    small = docs.where("doc_id is null or doc_id not in (7, 8)")
    manifest = wavelet.write_shards(small, JSON, fresh_path(spark, "w"), shard_tokens=20)
    assert manifest.count() > 1
    rows = sorted(wavelet.read_digests(manifest).collect(), key=lambda r: r["start"])
    assert len(rows) == small.count() and [r["doc_id"] for r in rows][:2] == [None, None]
    at, texts = 0, {i: t for i, t in enumerate(TEXTS)}
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
        if r["doc_id"] is not None:
            ids = [*tk.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
            assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert wavelet.read_digests(wavelet.write_shards(none, JSON, fresh_path(spark, "w"))).count() == 0


def test_wavelet_with_added_tokens(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(JSON)
    texts = ["plain text", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext", "x<|endoftext|>\n\n y", "after"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in wavelet.read_digests(wavelet.write_shards(docs, JSON, fresh_path(spark, "w"))).collect()}
    at = 0
    for i, t in enumerate(texts):
        ids = [*tk.encode(t, add_special_tokens=False).ids, 2]
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


@pytest.mark.parametrize("n", [0, 1, 5, 70_000])
def test_wavelet_queries(n):
    ids = (np.random.default_rng(n).zipf(1.4, n) % 50_257).astype(np.uint16)
    f = wavelet.WaveletFile(wavelet.build([None, 4], [0, n], ids))
    assert (f.all_ids() == ids).all() and f.documents()[0] == [None, 4]
    for i in range(0, n, max(1, n // 20)):
        assert f.access(i) == ids[i]
        where = np.flatnonzero(ids == ids[i])
        assert f.count(int(ids[i])) == len(where) and f.occurrence(int(ids[i]), len(where) // 2) == where[len(where) // 2]
        assert f.count(int(ids[i]), n // 3, n // 2) == ((where >= n // 3) & (where < n // 2)).sum()
    assert f.count(60_000) == 0 and f.count(1 << 30) == 0


def test_byte_bpe(spark, docs, none):
    rows = {r["doc_id"]: r for r in byte_bpe.digests(docs, RANKS).collect()}
    for i, t in enumerate(TEXTS):
        assert rows[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert rows[0]["n_tokens"] == 0 and byte_bpe.digests(none, RANKS).count() == 0
    back = byte_bpe.decode(byte_bpe.encode(docs, RANKS), RANKS).where("doc_id = 9").first()
    assert back["text"] == TEXTS[9]


def licence_model(text):
    """Family, probability and best template of a paragraph, by a loop over features."""
    weights, bias, heat = license_scan.model()
    words = license_scan.words_of(text)
    features = license_scan.features_of(words)
    z = np.array(bias)
    for f in sorted(features):
        z = z + np.array(weights.get(f, [0.0] * len(bias))) / np.sqrt(max(2 * len(words) - 1, 1))
    p = np.exp(z / heat - (z / heat).max())
    p /= p.sum()
    k = int(p.argmax())
    family = license_scan.CLASSES[k] if p[k] >= 0.5 else "unknown"
    alike = []
    for i, t in enumerate(license_scan.TEMPLATES.get(family, [])):
        shape = license_scan.features_of(license_scan.words_of(t))
        alike.append((2 * len(features & shape) / (len(features) + len(shape)), f"{family}/{i}"))
    best = max(alike, default=(0.0, None))
    return family, p[k], best[0] >= 0.6, best[1]


def paragraphs(text):
    import re

    out = {("line", i): t for i, t in enumerate(text.split("\n")) if t.strip("\t\r\n ")}
    if re.search(r"\n[ \t\r]*\n", text):
        out |= {("block", i): t for i, t in enumerate(re.split(r"\n[ \t\r]*\n", text)) if "\n" in t.strip(" ") and t.strip("\t\r\n ")}
    return out


def assert_like_the_model(rows, texts):
    want = {(d, *key): licence_model(t) for d, text in texts.items() for key, t in paragraphs(text or "").items()}
    got = {(r["doc_id"], r["kind"], r["paragraph"]): r for r in rows}
    assert set(got) == set(want)
    for key, (family, p, confirmed, template) in want.items():
        r = got[key]
        assert r["probability"] == pytest.approx(p, abs=2e-6) and (r["family"] == family or abs(p - 0.5) < 1e-5), key
        if r["family"] == family:
            assert r["confirmed"] == confirmed and (not confirmed or r["template"] == template), key


def test_licences_against_a_loop_over_features(spark):
    lines = [t for ts in license_scan.TEMPLATES.values() for t in ts]
    wrapped = lines[4].replace(" may", "\nmay").replace(" in ", "\nin ")
    texts = {
        1: "\n".join(lines), 2: "\n".join(license_scan.OTHER), 3: None, 4: "", 5: f"Intro text.\n\n{wrapped}\n \t\nMIT\r\n\r\nend", 6: "\n \n", 7: "½ é日本\n-- !!",
        8: "word " * 50_000 + "\n" + "All rights reserved. " * 3000, 9: "CC BY 4.0\nGNU GPL, version 2 or later.\nReleased under GPLv3\nDistributed under the MIT/X11 terms",
        10: 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND',
    }
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = license_scan.scan(frame.withColumns({c: F.lit(1) for c in ("key", "family", "known", "n", "features", "t", "kind")})).collect()
    assert_like_the_model(rows, texts)
    found = {(r["doc_id"], r["kind"], r["paragraph"]): r for r in rows}
    family = [k for k, ts in license_scan.TEMPLATES.items() for _ in ts]
    assert all(found[1, "line", i]["family"] == f and found[1, "line", i]["confirmed"] for i, f in enumerate(family))
    assert not any(r["confirmed"] for r in rows if r["doc_id"] == 2)
    assert found[5, "block", 1]["confirmed"] and found[5, "block", 1]["family"] == family[4]
    assert [found[9, "line", i]["family"] for i in range(4)] == ["cc-by", "gpl", "gpl", "mit"] and all(found[9, "line", i]["confirmed"] for i in range(3))
    assert [found[10, "line", i]["family"] for i in range(2)] == ["mit", "apache-2.0"] and all(found[10, "line", i]["confirmed"] for i in range(2))


def test_licences_of_odd_rows(docs, none, spark):
    assert license_scan.scan(none).count() == 0
    assert not any(r["confirmed"] for r in license_scan.scan(docs).collect())
    twice = spark.createDataFrame([(None, "All rights reserved."), (None, "All rights reserved."), (1, "All rights reserved.")], "doc_id long, text string")
    assert [(r["family"], r["confirmed"]) for r in license_scan.scan(twice).collect()] == [("proprietary", True)] * 3


def water(sizes, weights, cap):
    total, limit, full = sum(sizes), [cap * s for s in sizes], set()
    while True:
        left = total - sum(limit[i] for i in full)
        w = sum(weights[i] for i in range(len(sizes)) if i not in full)
        t = [limit[i] if i in full else left * weights[i] / w for i in range(len(sizes))]
        more = {i for i in range(len(sizes)) if t[i] > limit[i]} | full
        if more == full:
            return t
        full = more


def test_mixing(docs, none, spark):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mix(none).count() == 0 and mixing.take_copies(none).columns == docs.columns
    assert sum(r["copies"] for r in rows) == mixing.take_copies(docs).count()
    assert mixing.mix(docs.withColumn("text", F.lit(None).cast("string"))).agg(F.sum("taken")).first()[0] == 0


@pytest.mark.parametrize("sizes", [[100, 10, 1, 1000], [5, 5, 5], [1000, 1], [3, 0, 900, 40, 2]])
def test_targets(spark, sizes):
    frame = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, source_size long")
    table = mixing.newton_rates(mixing.targets(frame)).orderBy("source").collect()
    want = water(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], 3)
    assert [r["target"] for r in table] == pytest.approx(want)
    assert [r["rate"] * s for r, s in zip(table, sizes)] == pytest.approx(want)


def test_taken_words_come_near_their_target(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.zipf(1.6) % 3000 + 1), f"s{i % 4}") for i in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r["t"] - r["g"]) <= 0.02 * r["g"] + 5 for r in got)


@pytest.mark.parametrize("share, rate", [(0.1, 0.5), (1 / 3, 0.37), (1 / 3, 2.9), (0.6, 0.5)])
def test_a_long_document_does_not_move_the_sum(spark, share, rate):
    rng = np.random.default_rng(3)
    sizes = rng.integers(100, 901, 5000).tolist()
    own = [*sizes, int(sum(sizes) * share / (1 - share))]
    rows = spark.createDataFrame([(i, "a", n) for i, n in enumerate(own)], "doc_id long, source string, size long")
    solved = spark.createDataFrame([("a", sum(own), rate * sum(own), rate)], "source string, source_size long, target double, rate double")
    rates = solved.withColumnRenamed("source", "r_source")
    cuts = mixing._finer(rows, mixing._cuts(rows, solved, 3, 9), 3, 9)
    moves = mixing._corrections(mixing._tilted(rows, rates, cuts, 3, 9), 3, 9)
    got = mixing._drawn(rows, rates, cuts, moves, 3, 9).selectExpr("sum(copies * size)", "min(copies)", "max(copies)").first()
    assert abs(got[0] - rate * sum(own)) <= 100 and 0 <= got[1] and got[2] <= 3


def test_mix_with_a_long_document_in_each_source(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.integers(100, 901)), f"s{i % 3}") for i in range(3000)]
    rows += [(5000 + i, "w " * 250_000, f"s{i}") for i in range(3)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert len(got) == 3 and all(abs(r["t"] - r["g"]) <= 100 for r in got)


def brute_links(rows, threshold=0.98):
    """(links, smallest id reachable) by row number, over (vec_id, embedding, label) in double precision."""
    n, unit = len(rows), []
    for _, v, label in rows:
        ok = v is not None and label is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)
        v = np.array(v, float) / np.abs(v).max() if ok else None
        unit.append(None if v is None else v / np.linalg.norm(v))
    near = [[i != j and unit[i] is not None and unit[j] is not None and rows[i][0] is not None and rows[j][0] is not None and rows[i][2] == rows[j][2]
             and len(unit[i]) == len(unit[j]) and bool(unit[i] @ unit[j] >= threshold) for j in range(n)] for i in range(n)]
    least = [rows[i][0] for i in range(n)]
    for _ in range(n):
        new = [min([least[i], *(least[j] for j in range(n) if near[i][j])]) if least[i] is not None else None for i in range(n)]
        if new == least:
            break
        least = new
    return [sum(x) for x in near], least


def test_hnsw(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 16))
    x[100:160] = x[100] + 0.02 * rng.normal(size=(60, 16))
    x[200:203] = x[200]
    rows = [(i, v.tolist(), int(i % 2) if i < 100 else 1) for i, v in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, x[0].tolist(), None), (None, x[0].tolist(), 0), (904, [], 1), (905, [None] * 16, 1), (906, [1.0, 2.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("shard", F.lit("x")).withColumn("links", F.lit(1))
    links, least = brute_links(rows)
    for shard_rows in (8192, 90):
        got = {r["vec_id"]: r for r in hnsw.near_duplicates(table, shard_rows=shard_rows).collect()}
        found = [got[r[0]]["n_links"] for r in rows]
        assert all(a <= b for a, b in zip(found, links)) and sum(found) >= 0.98 * sum(links)
        assert [got[r[0]]["component_id"] for r in rows] == least
        assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got.values())
        assert all(got[i]["recall"] >= 0.99 for i in range(400)) and got[900]["recall"] is None
    assert hnsw.near_duplicates(table.where("false")).count() == 0


def test_hnsw_of_odd_rows(spark):
    """Huge and tiny components, repeated ids with unlike vectors, equal rows, a cosine equal to the threshold."""
    rows = [
        (1, [1e200, 1e200], 1), (2, [1e200, 1.0000001e200], 1), (3, [1.0, 1.0], 1), (4, [1e-300, 1e-300], 1), (5, [-1.0, 1.0], 1),
        (6, [1.0, 0.0, 0.0], 2), (6, [0.0, 1.0, 0.0], 2), (7, [1.0, 0.01, 0.0], 2), (8, [0.01, 1.0, 0.0], 2), (8, [0.01, 1.0, 0.0], 2),
        (9, [1.0, 0.0], 3), (10, [0.6, 0.8], 3), (11, [0.6, -0.8], 3),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for threshold in (0.98, 0.6):
        links, least = brute_links(rows, threshold)
        want = sorted((r[0], n, c, r[0] == c) for r, n, c in zip(rows, links, least))
        for shard_rows in (8192, 2):
            got = hnsw.near_duplicates(table, threshold, shard_rows).collect()
            assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == want


def test_audit_of_a_shard_with_itself():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(8192, 32))
    x[:300] = x[300:600] + 0.1 * rng.normal(size=(300, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, within, (hit, wanted, ef, scanned) = hnsw.shard_links(x, hnsw.THRESHOLD, hnsw.RECALL)
    true, got = 0, 0
    for at in range(0, 8192, 1024):
        exact = x[at : at + 1024] @ x.T >= hnsw.THRESHOLD
        exact[np.arange(1024), np.arange(at, at + 1024)] = False
        true += exact.sum()
        got += (exact & within._rows(at, at + 1024).astype(bool)).sum()
    assert true > 300 and got >= 0.99 * true and hit >= 0.99 * wanted
    # the nearest neighbours that the audit stands on, for rows it has not drawn
    some = np.arange(0, 8192, 32)
    exact = x[some] @ x.T
    exact[np.arange(len(some)), some] = -np.inf
    near = np.argsort(-exact, 1)[:, :10]
    again = hnsw.Hnsw.load(graph.dump(), x)
    ids = again.search(x[some], ef)[0] if ef < len(x) else near
    assert np.mean([len(np.intersect1d(a, b)) for a, b in zip(ids, near)]) >= 9.8


def test_links_found_from_one_end_count_at_both():
    rng = np.random.default_rng(6)
    n = 603
    one_way = rng.random((n, n)) < 0.02
    np.fill_diagonal(one_way, False)
    within = hnsw._Within(n)
    for at in range(0, n, 100):
        a, b = np.nonzero(one_way[at : at + 100])
        within.add([(a + at, b)])
    copies = rng.integers(1, 4, n)
    assert (one_way & ~one_way.T).any() and (within.counts(copies) == (one_way | one_way.T) @ copies).all()
    assert (within.label == 0).all()


def test_lean_slices_keep_every_row_in_order():
    import pyarrow as pa

    from foliant.llm.memory import lean

    texts = ["a", None, "", "b" * 50, "c", "c", "ü" * 9, None]
    whole = pa.record_batch({"doc_id": pa.array(range(8)), "text": pa.array(texts)})
    empty = whole.slice(0, 0)
    seen = []

    def run(batches):
        for b in batches:
            seen.append(b.num_rows)
            yield b

    out = list(lean(run, "text", 10)(iter([whole, empty, whole.slice(3, 1)])))
    assert [t for b in out for t in b.column("text").to_pylist()] == [*texts, texts[3]]
    assert [i for b in out for i in b.column("doc_id").to_pylist()] == [*range(8), 3]
    assert len(seen) > 3 and sum(seen) == 9
    assert [b.num_rows for b in lean(run)(iter([whole]))] == [8]


def test_a_byte_bpe_task_leaves_no_words_with_its_worker():
    import tracemalloc

    import pyarrow as pa

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    batch = lambda words: pa.record_batch({"doc_id": pa.array([1]), "text": pa.array([" ".join(f"{i:017b}".translate({48: "a", 49: "b"}) for i in range(words))])})
    for run in (byte_bpe._digests(path, True), byte_bpe._ids(path)):
        assert sum(b.num_rows for b in run(iter([batch(10)]))) == 1  # ranks and powers stay
        tracemalloc.start()
        try:
            assert sum(b.num_rows for b in run(iter([batch(120_000)]))) == 1
            assert tracemalloc.get_traced_memory()[0] < 4 << 20
        finally:
            tracemalloc.stop()


def test_cells_of_a_task_are_packed_without_loss():
    import pandas as pd

    rng = np.random.default_rng(2)
    few = rng.poisson(1, jaccard.SLICE).astype(np.int32)
    many = few.copy()
    many[[0, 7, -1]] = 255, 256, 2**31 - 1
    none = np.zeros_like(few)
    for counts in (few, many, none, none + 70_000):
        assert (jaccard._unpacked(jaccard._packed(counts)) == counts).all()
    frame = pd.DataFrame({"slice": [3] * 3, "cells": [jaccard._packed(c) for c in (many, many, few)]})
    total = jaccard._add_slices(frame)
    assert (np.frombuffer(total["cells"][0], np.int64) == 2 * many.astype(np.int64) + few).all()


def test_cells_do_not_outgrow_the_texts():
    """A task's cells, at one shingle a cell, take less than its texts; four bytes a cell would take as much and more."""
    import pyarrow as pa

    text = " ".join(f"{i:x}" for i in range(1 << 16))
    batch = pa.record_batch({"doc_id": pa.array([1]), "text": pa.array([text]), "print": pa.array([0])})
    out = pa.Table.from_batches(jaccard._profile(3, 16)(iter([batch])))
    cells = [c for c in out.column("cells").to_pylist() if c is not None]
    assert len(cells) == (1 << 16) // jaccard.SLICE
    assert sum(map(len, cells)) < (1 << 16) * 3 // 8


def test_a_span_index_grows_no_more_than_it_needs():
    from foliant.llm.spans import SpanIndex, mix

    k = mix(np.arange(1, 60_001, dtype=np.uint64))
    index = SpanIndex()
    for part in np.array_split(k, 7):
        index.add(part, mix(part))
        assert len(index.code) <= max(1 << 17, 5 * index.n)
    assert (index.find(k, mix(k)) == np.arange(len(k))).all() and (index.find(mix(k), k) == -1).all()


def _jvm_mb(spark) -> float:
    pid = spark.sparkContext._jvm.java.lang.ProcessHandle.current().pid()
    with open(f"/proc/{pid}/status") as f:
        return next(int(x.split()[1]) for x in f if x.startswith("VmRSS")) / 1024


def test_the_driver_hands_freed_native_memory_back(spark):
    from foliant.llm import memory

    make = spark.sparkContext._jvm.java.util.zip.Deflater
    held = [make() for _ in range(800)]  # some 200 MB outside the heap
    full = _jvm_mb(spark)
    for x in held[:-1]:
        x.end()
    memory.release_driver(spark)
    assert _jvm_mb(spark) < full - 80
    held[-1].end()


def test_near_copies_release_the_driver_after_every_round(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(jaccard, "release_driver", calls.append)
    words = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(i, f"{words} x{i}") for i in range(4)], "doc_id long, text string")
    assert jaccard.keep_one(docs).count() == 1
    assert len(calls) >= 4  # after the lists, the leaders' answers, the rest and the components


def _cpu(run) -> float:
    took = []
    for _ in range(3):
        since = time.process_time()
        run()
        took.append(time.process_time() - since)
    return min(took)


def test_wavelet_planes_are_read_a_block_at_a_time():
    import tracemalloc

    ids = np.random.default_rng(1).integers(0, 50_000, 1 << 20).astype(np.uint16)
    shard = wavelet.WaveletFile(wavelet.build([1], [len(ids)], ids))
    tracemalloc.start()
    try:
        assert (shard.all_ids() == ids).all()
        assert tracemalloc.get_traced_memory()[1] < 5.5 * len(ids)  # two arrays of ids, and blocks
    finally:
        tracemalloc.stop()


def test_wavelet_words_cost_less_than_texts_of_one_word():
    from tokenizers import Tokenizer

    rng, letters = np.random.default_rng(2), list("abcdehilnorst éß日🙂\x00\xad'")
    new = [w for w in {"".join(rng.choice(letters, 9)) for _ in range(20_000)} if " " not in w]
    new = [w for w in (x for w in new for x in (w, " " + w)) if len(split([w])[2]) == 2] + [chr(c) for c in range(0x21, 0x400)]
    whole = Tokenizer.from_file(JSON)
    ids, lengths = wavelet._cache(JSON)[0].encode(new)
    want = [e.ids for e in whole.encode_batch(new, add_special_tokens=False)]
    assert lengths.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]
    words = [f"{a}{b}ing" for a in new[:200] for b in new[200:250]]
    encode = wavelet._cache(JSON)[0].encode
    assert _cpu(lambda: encode(words)) < 0.85 * _cpu(lambda: [e.ids for e in whole.encode_batch(words, add_special_tokens=False)])
