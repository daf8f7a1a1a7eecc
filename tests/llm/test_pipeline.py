"""The pipeline against a plain version of its stages, and every operator on awkward tables."""

import re
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from geoloom.llm import chat, common, context_mixing, decontaminate, line_quality, mpeg_audio, near_dup, packing, sharding, token_store, tokens, url_rules

WORDS = [f"w{i}" for i in range(300)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, part int, id long, key long"


def text(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n)) + "."


def rows_of(texts):
    return [(i, t, "en", "s", len(t or ""), "r", 1, 7, 8) for i, t in texts]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = text(2, 120).split()
    good = [(i, text(i, 40) + "\n" + text(i + 500, 30)) for i in range(40)]
    junk = [(i, "\n".join(["BUY!! NOW!! ###"] * (4 + i % 3))) for i in range(100, 130)]
    near = [(200, " ".join(base)), (201, " ".join(base[:60] + ["changed"] + base[61:])), (202, " ".join(base)), (203, good[3][1]), (204, text(9001, 3000))]
    leak = [(300, text(77, 20) + " " + " ".join(text(88, 14).split()[:12]) + " " + text(78, 20))]
    odd = [(400, None), (401, ""), (None, text(5, 50)), (None, junk[0][1]), (None, leak[0][1]), (7, good[7][1]), (8, text(9002, 30))]
    docs = rows_of(good + junk + near + leak + odd)
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i, _ in good + junk], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(text(88, 14).split()[:12])), (None, text(88, 14).upper()), (3, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def _links(texts):
    sets = {}
    for i, t in texts:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}
    edges = [(a, b) for a, b in combinations(sets, 2) if (both := len(sets[a] & sets[b])) and 100 * both >= 75 * len(sets[a] | sets[b])]
    while any(comp[a] != comp[b] for a, b in edges):
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return comp


def test_pipeline_by_plain_stages(spark, folder):
    docs = common.table(spark, folder, "documents")
    kept = [(r.doc_id, r.text) for r in docs.collect()]
    field = line_quality.train(docs, common.table(spark, folder, "labels"))
    kept = [(i, t) for i, t in kept if field.score(*line_quality.lines_of(pa.array([t], pa.string())))[0] >= line_quality.THRESHOLD]
    assert not any(t and "BUY" in t for _, t in kept) and sum(i is None for i, _ in kept) == 2
    comp = _links([(i, t) for i, t in kept if i is not None])
    once, seen = [], set()
    for i, t in kept:
        if i is None or comp[i] == i and (i, t) not in seen:
            once.append((i, t))
            seen.add((i, t))
    assert {201, 202, 203}.isdisjoint(i for i, _ in once) and sum(i == 7 for i, _ in once) == 1 and sum(i == 8 for i, _ in once) == 2
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = set()
    for r in common.table(spark, folder, "benchmark").collect():
        w = word.findall((r.text or "").lower())
        n = min(10, len(w))
        windows |= {tuple(w[k:k + n]) for k in range(len(w) - n + 1 if n else 0)}
    clean = [(i, t) for i, t in once if not any(tuple(w[k:k + n]) in windows for w in [word.findall((t or "").lower())] for n in {len(x) for x in windows} for k in range(len(w) - n + 1))]
    assert len(clean) == len(once) - 2
    tok, want = tokens.Encoder(tokens.public_path("word_bpe_49k.json")), []
    for i, t in clean:
        ids = np.append(np.frombuffer(tok.plain(t or ""), "<u4"), 0).astype("<u4")
        want += [(i, k // 2048, k, len(ids[k:k + 2048]), zlib.crc32(ids[k:k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    got = corpus_pipeline.run(spark, folder).collect()
    order = lambda rows: sorted(rows, key=str)
    assert order([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got]) == order(want)
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_stages_keep_columns_and_take_empty_tables(spark, folder):
    docs = common.table(spark, folder, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).schema.names == docs.schema.names
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0


def test_benchmark_in_blocks(spark, folder):
    docs, bench = (common.table(spark, folder, n) for n in ("documents", "benchmark"))
    bench = bench.unionByName(spark.createDataFrame([(9, text(9001, 3000))], "item_id long, text string"))
    whole = {(r.doc_id, r.text) for r in decontaminate.clean(docs, bench).select("doc_id", "text").collect()}
    assert whole == {(r.doc_id, r.text) for r in decontaminate.clean(docs, bench, block_windows=800).select("doc_id", "text").collect()}
    assert (204, text(9001, 3000)) not in whole
    view = lambda df: sorted(((r.doc_id, r.n_words, str(r.spans), sorted(map(str, r.item_ids))) for r in df.collect()), key=str)
    assert view(decontaminate.find_leaks(docs, bench)) == view(decontaminate.find_leaks(docs, bench, block_windows=800))


def _awkward(spark):
    long = "x" * 300_000 + " " + text(1, 20_000)
    texts = [(1, None), (1, ""), (1, "a b"), (2, " \n"), (2, "a b"), (None, "a b"), (None, None), (3, long), (3, long), (4, "é\u3000ß\n\n\n")]
    return spark.createDataFrame(rows_of(texts), SCHEMA)


def _operators(spark, tmp_path):
    wb, bb = tokens.public_path("word_bpe_49k.json"), tokens.public_path("byte_bpe_50k.json")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 0), (9, 1)], "doc_id long, quality int")
    return {
        "leaks": lambda d: decontaminate.find_leaks(d, bench), "mixing": lambda d: context_mixing.score(d, F.col("doc_id") != 2, common=3), "media": lambda d: mpeg_audio.probe(mpeg_audio.store_texts(d)),
        "tokens": lambda d: token_store.read_documents(token_store.write_sequences(d, bb, str(tmp_path / f"t{id(d)}"), length=64)), "quality": lambda d: line_quality.score(d, line_quality.train(d, labels)),
        "near": near_dup.near_duplicates, "shard": lambda d: sharding.shard_documents(d, 3), "pack": lambda d: packing.pack(d, wb, 128),
        "urls": lambda d: url_rules.judge_urls(d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), "row", "part"), url_rules.production_rules())}


@pytest.mark.parametrize("name", ["leaks", "mixing", "media", "tokens", "quality", "near", "shard", "pack", "urls"])
def test_awkward_tables(spark, tmp_path, name):
    run, d = _operators(spark, tmp_path)[name], _awkward(spark)
    rows = run(d).collect()
    assert len(rows) == d.count() if name != "pack" else len(rows) > d.count()
    assert run(d.limit(0)).count() == 0
    if name == "near":
        by = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in rows)
        assert ("None", 1, "None", True) in by and [x for x in by if x[0] == "2"] == [("2", 0, "1", False), ("2", 1, "1", False)] and [x[3] for x in by if x[0] == "3"] == [True, True]
    if name == "leaks":
        assert sorted(len(r.spans) for r in rows) == [0] * 7 + [1] * 3
    if name == "mixing":
        assert len({r.score for r in rows if r.n_tokens == 1}) == 1 and all(r.score < 0 for r in rows)


def test_chat_on_awkward_tables(spark):
    schema = "conv_id long, turn long, role string, text string, example int, loss string"
    d = spark.createDataFrame([(None, 0, "user", "a", 1, "x"), (None, None, None, None, 1, "x"), (5, 1, "assistant", "[/INST]</s>", 1, "x"), (5, 1, "assistant", "[/INST]</s>", 1, "x"), (6, 0, "user", "y" * 200_000, 1, "x")], schema)
    got = {r.conv_id: r for r in chat.digest(chat.expand(d)).collect()}
    assert got[None].n_turns == 2 and got[5].n_turns == 2 and got[5].loss_chars == 22 and got[6].formatted_chars > 200_000
    assert chat.digest(chat.expand(d.limit(0))).count() == 0


def test_smallest_capacity(spark):
    """Sizes in order, cut by trying all capacities without the module's own pass."""
    rng = np.random.default_rng(4)
    texts = [(i, "t" * int(n) + str(i // 2)) for i, n in enumerate(rng.integers(0, 60, 40))]
    d = spark.createDataFrame(rows_of(texts), SCHEMA)
    got = sharding.shard_documents(d, 5, block=4).collect()
    groups = {}
    for i, t in texts:
        groups.setdefault(t, []).append(i)
    sizes = [(len(own) * (len(t) + 16), own) for t, own in sorted(groups.items(), key=lambda x: x[1][0])]

    def cut(capacity):
        shards, room = [], 0
        for size, own in sizes:
            if not shards or size > room:
                shards.append([])
                room = capacity
            shards[-1] += own
            room -= size
        return shards
    least = next(c for c in range(1, sum(s for s, _ in sizes) + 1) if len(cut(c)) <= 5)
    want = {i: k for k, own in enumerate(cut(least)) for i in own}
    assert {r.doc_id: r.shard for r in got} == want


def test_large_near_group_with_strangers(spark):
    """A group whose members stray from its base by very different amounts: many share buckets
    with it and are linked with nothing in it. The components are those of all pairs."""
    rng = np.random.default_rng(11)
    base, texts = text(3, 160).split(), []
    for i in range(160):
        own = list(base)
        for k in rng.choice(len(own), int(rng.integers(0, 14)), replace=False):
            own[k] = f"m{i}x{k}"
        texts.append((i, " ".join(own)))
    for i in range(160, 200):  # copies of copies
        own = texts[int(rng.integers(0, 160))][1].split()
        for k in rng.choice(len(own), int(rng.integers(1, 5)), replace=False):
            own[k] = f"n{i}x{k}"
        texts.append((i, " ".join(own)))
    want = _links(texts)
    assert 5 < len(set(want.values())) < 180
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()} == want


def test_registered_queries_on_small_tables(spark):
    from geoloom.llm import registry

    counts = {"op3_pack": None, "op4_url_rules": "pages", "op10_chat": None}
    for name in ("op4_url_rules", "op5_media", "op6_token_store", "op9_shard"):
        table = counts.get(name, "documents")
        assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() == common.table(spark, "/root/testdata/sf0.001", table).count()


def test_media_digests(spark):
    """What the query says of the stored form, from the writer's bytes alone."""
    import hashlib

    d = spark.createDataFrame([(1, "abc" * 500), (2, None)], "doc_id long, text string")
    made = {r.doc_id: bytes(r.media) for r in mpeg_audio.store_texts(d).collect()}
    for r in mpeg_audio.probe(mpeg_audio.store_texts(d)).collect():
        assert r.media_sha256 == hashlib.sha256(made[r.doc_id]).hexdigest() and r.media_bytes == len(made[r.doc_id]) and r.samples == 576 * r.n_frames


def test_titles_of_tags():
    frame = lambda i, t, v: i + (len(t).to_bytes(3, "big") if v == 2 else len(t).to_bytes(4, "big") + b"\0\0") + t
    for v, first, title in ((2, b"TP1", b"TT2"), (3, b"TPE1", b"TIT2"), (4, b"TPE1", b"TIT2")):
        body = frame(first, b"\0who", v) + frame(title, b"\0what", v)
        tag = b"ID3" + bytes([v, 0, 0]) + bytes([len(body) >> 21 & 127, len(body) >> 14 & 127, len(body) >> 7 & 127, len(body) & 127]) + body
        assert mpeg_audio.parse(tag).title == "what"
    assert mpeg_audio.parse(b"TAG" + b"old".ljust(30, b"\0") + bytes(95)).title == "old"
