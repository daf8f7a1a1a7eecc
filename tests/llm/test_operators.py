"""Small tables with nulls, empty and repeated rows, and clashing columns, against brute force."""

import hashlib
import re
import zlib
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoloom.llm import chat, context_mixing, decontaminate, line_quality, mpeg_audio, near_dup, packing, sharding, token_store, tokens, url_rules

WORDS = [f"w{i}" for i in range(400)]


def text(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))


@pytest.fixture(scope="module")
def docs(spark):
    long, base = text(1, 3000), text(2, 120).split()
    near = " ".join(base[:60] + ["changed"] + base[61:])
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, "one two"), (5, " ".join(base)), (6, near), (7, long), (8, long), (9, "Été où ß 中文\nNext. LINE!"), (10, text(3, 40)),
            (11, text(4, 5) + " " + " ".join(base[20:35]) + " " + text(5, 9))]
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, row string, part int")


def test_decontaminate(spark, docs):
    bench = spark.createDataFrame([(100, " ".join(text(2, 120).split()[18:40]).upper()), (101, "one two"), (102, None), (103, "")], "item_id long, text string")
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    items = {r.item_id: word.findall((r.text or "").lower()) for r in bench.collect()}
    for blocks in (400_000, 10):
        got = {r.doc_id: r for r in decontaminate.find_leaks(docs, bench, block_windows=blocks).collect()}
        for r in docs.collect():
            w, hit, own = word.findall((r.text or "").lower()), set(), set()
            for item, x in items.items():
                n = min(10, len(x))
                for j in range(len(x) - n + 1 if n else 0):
                    for s in range(len(w) - n + 1):
                        if w[s:s + n] == x[j:j + n]:
                            hit.update(range(s, s + n))
                            own.add(item)
            g = got[r.doc_id]
            assert g.n_words == len(w) and sorted(g.item_ids) == sorted(own)
            assert {k for s in g.spans for k in range(s.start, s.end)} == hit


def test_near_duplicates(spark, docs):
    got = {r.doc_id: r for r in near_dup.near_duplicates(docs).collect()}
    sets = {}
    for r in docs.collect():
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}
    for _ in sets:
        for a, b in combinations(sets, 2):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                comp[a] = comp[b] = min(comp[a], comp[b])
    assert {i: (len(s), comp[i], comp[i] == i) for i, s in sets.items()} == {i: (g.n_shingles, g.component_id, g.kept) for i, g in got.items()}


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_estimate(spark, bits):
    a, b = np.arange(1000, dtype=np.uint64), np.arange(200, 1200, dtype=np.uint64)
    m = near_dup.minima([near_dup.mix(a + np.uint64(1)), near_dup.mix(b + np.uint64(1))])
    x, y = near_dup._pack(m, bits).tolist()
    df = spark.createDataFrame([(x, y)], "x array<long>, y array<long>")
    from pyspark.sql import functions as F

    assert abs(df.select(near_dup.estimated(F.col("x"), F.col("y"), bits)).first()[0] - 800 / 1200) < 0.15


def test_packing(spark, docs):
    path = tokens.public_path("word_bpe_49k.json")
    got = packing.pack(docs, path, capacity=64).collect()
    tok = tokens.Encoder(path)
    for r in docs.collect():
        ids = np.frombuffer(tok.plain(r.text or ""), "<u4").tolist() + [0]
        own = sorted((g for g in got if g.doc_id == r.doc_id), key=lambda g: g.piece)
        assert [(g.start, g.length) for g in own] == [(k, min(64, len(ids) - k)) for k in range(0, len(ids), 64)]
        assert [g.ids_crc32 for g in own] == [zlib.crc32(np.array(ids[k:k + 64], "<u4").tobytes()) for k in range(0, len(ids), 64)]
    for s in {g.sequence_id for g in got}:
        at = 0
        for g in sorted((g for g in got if g.sequence_id == s), key=lambda g: g.offset):
            assert g.offset == at
            at += g.length
        assert at <= 64


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), min_size=1, max_size=12), st.integers(0, 99))
def test_genomes_keep_all_pieces(counts, seed):
    population = packing._first(counts, 50, seed, 3)
    before = max(packing.fitness(g, 50) for g in population)
    after, taken = packing.evolve(population, 50, seed, 8)
    assert 0 <= taken <= 8
    for g in after:
        assert packing.histogram(g) == counts and all(sum(p) <= 50 for p in g)
    assert packing.fitness(after[0], 50) >= before


def test_search_takes_children(spark):
    """On the lengths of real texts the result has come through crossover and migration."""
    enc = tokens.Encoder(tokens.public_path("word_bpe_49k.json"))
    counts = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        n = len(enc.encode(r.text or "")) // 4 + 1
        for length in [2048] * (n // 2048) + [n % 2048] * (n % 2048 > 0):
            counts[length] = counts.get(length, 0) + 1
    genome, taken = packing.search(spark, counts)
    assert taken > 0 and packing.histogram(genome) == counts
    assert sum(genome.values()) <= sum(packing.best_fit(counts, 2048).values())


def test_crossover_and_mutation():
    rng = np.random.default_rng(1)
    counts = {30: 7, 20: 9, 11: 14, 6: 5}
    a, b = packing._first(counts, 50, 5, 2)
    assert packing.histogram(packing.crossover(a, b, 50, rng)) == counts
    assert packing.histogram(packing.mutate(a, 50, rng)) == counts


def test_token_store(spark, docs, tmp_path):
    path = tokens.public_path("byte_bpe_50k.json")
    manifest = token_store.write_sequences(docs, path, str(tmp_path / "ids"), length=16)
    got = sorted(token_store.read_documents(manifest).collect(), key=lambda r: r.start)
    tok, at = tokens.Encoder(path), 0
    for g, r in zip(got, sorted(docs.collect(), key=lambda r: r.doc_id)):
        ids = np.append(np.frombuffer(tok.plain(r.text or ""), "<u4"), 0).astype("<u4")
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    for f in manifest.collect():
        seq = token_store.SequenceReader(f"{f.file}.arrow")
        assert seq.length == 16 and sum(int(seq.mask(i).sum()) for i in range(seq.file.num_record_batches)) == f.n_tokens


def test_encoder_keeps_few_pieces():
    """Words with signs behind them are kept from the second time on; ids stay those of the library."""
    enc = tokens.Encoder(tokens.public_path("byte_bpe_50k.json"), None, most=2000)
    assert enc.code == "H"
    words = [hashlib.md5(str(i).encode()).hexdigest().translate(str.maketrans("0123456789", "ghijklmnop"))[:9] for i in range(1500)]
    text = "x " + ", ".join(words) + ". Éa ÀB× Zz!"
    ends = lambda: sum(k.endswith(b",") for k in [*enc.mid, *enc.mid.older])
    assert enc.encode(text) == enc.plain(text) and ends() < 30
    assert enc.encode(text) == enc.plain(text) == enc.encode(text)
    assert ends() >= 400 and len(enc.mid) <= 2000 and len(enc.mid.older) <= 2000


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(list("aB éü ñß'.,!\n\t \r 　x1②$İΣ中文<|") + ["don't ", "it's,", "We'LL", "  "]), max_size=40).map("".join))
@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name, s):
    enc = tokens.encoder(tokens.public_path(name))
    assert enc.encode(s) == enc.plain(s)


def test_media_round_trip(spark, docs):
    got = {r.doc_id: r for r in mpeg_audio.probe(mpeg_audio.store_texts(docs)).collect()}
    for r in docs.collect():
        raw, g = (r.text or "").encode(), got[r.doc_id]
        assert bytes(g.payload) == raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (g.n_frames, g.crc_ok, g.crc_bad, g.resyncs, g.vbr_frames) == (len(g.payload) // 576, g.n_frames, 0, 0, g.n_frames)
        assert g.duration_us == g.n_frames * 36000 and list(g.tags) == ["ID3v2", "ID3v1"]


def test_media_damage():
    b = mpeg_audio.MpegWriter().write(bytes(range(256)) * 27)
    whole = mpeg_audio.parse(b)
    assert len(whole.frames) == 12
    cut = bytearray(b)
    cut[whole.frames[5]:whole.frames[5] + 4] = b"\0\0\0\0"
    p = mpeg_audio.parse(bytes(cut))
    assert p.resyncs == 1 and p.frames == whole.frames[:5] + whole.frames[6:] and p.lost == 648
    bad = bytearray(b)
    bad[whole.frames[2] + 4] ^= 1
    assert mpeg_audio.parse(bytes(bad)).crc_bad == 1
    assert mpeg_audio.parse(b"").frames == mpeg_audio.parse(None).frames == mpeg_audio.parse(b"\xff\xfb" * 50).frames == []


def test_url_rules(spark):
    rows = [(0, None), (1, "no url"), (2, "http://A.example.COM/en/x?y#z"), (3, "https://www.example.com/en/"), (4, "http://x.net/es/1"), (5, "http://spam-farm.example.org/en/"), (6, "http://notexample.com/en/"), (7, "http://example.com/EN/"), (8, "ftp://h.net?q=/es/"), (8, "ftp://h.net?q=/es/")]
    got = url_rules.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), url_rules.production_rules()).collect()
    found = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got}
    assert len(got) == len(rows) and found == {
        (0, "", "", None, "allow"), (1, "", "", None, "allow"), (2, "a.example.com", "/en/x", "example.com/en/", "block"), (3, "www.example.com", "/en/", "www.example.com/en/", "allow"),
        (4, "x.net", "/es/1", "net/es/", "block"), (5, "spam-farm.example.org", "/en/", None, "block"), (6, "notexample.com", "/en/", "com/", "allow"), (7, "example.com", "/EN/", "com/", "allow"), (8, "h.net", "", None, "allow")}


def _smallest(sizes, shards):
    """The least capacity, single larger groups aside, by trying all."""
    return next(c for c in range(1, sum(sizes) + 1) if sharding.greedy(np.array(sizes), c, shards) is not None)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=25), st.integers(1, 6), st.integers(1, 5))
def test_minimax(sizes, shards, block):
    blocks = [(i, sum(sizes[i:i + block]), max(sizes[i:i + block])) for i in range(0, len(sizes), block)]
    lazy = sharding.Lazy(blocks, lambda i: (np.arange(i, min(i + block, len(sizes))), np.array(sizes[i:i + block])))
    capacity, cuts = sharding.minimax(lazy, shards)
    want = _smallest(sizes, shards)
    assert capacity == want and cuts == sharding.greedy(np.array(sizes), want, shards)


def test_sharding(spark, docs):
    got = sharding.shard_documents(docs, shards=4, block=2).collect()
    by = {r.doc_id: r for r in docs.collect()}
    shard_of = {}
    for g in got:
        raw = (by[g.doc_id].text or "").encode()
        assert (g.size, g.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        assert shard_of.setdefault(raw, g.shard) == g.shard
    for s in {g.shard for g in got}:
        assert sorted(g.slot for g in got if g.shard == s) == list(range(sum(g.shard == s for g in got)))
    assert sharding.shard_documents(docs.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool]"]), st.lists(st.sampled_from(["</s>", "<s>", "[INST]", "[/INST]", "[TURN x]", "\\", "<", "[", "a", " ", "/s>"]), max_size=8).map("".join)), min_size=1, max_size=6))
def test_chat_round_trip(turns):
    made = list(chat.examples(turns))
    assert chat.read(made[-1][0]) == turns
    replies = [t for r, t in turns if r == "assistant"]
    assert [chat.unescape(t[a:b]) for t, spans in made for a, b in spans] == replies
    for k, (t, spans) in enumerate(made):
        assert chat.read(t) == turns[:len(chat.read(t))] and len(spans) <= 1


def test_chat_digest(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "hé"), (1, 2, "user", "tail"), (2, 0, "system", "only"), (1, 1, "assistant", "b</s>")]
    got = {r.conv_id: r for r in chat.digest(chat.expand(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    turns = [("user", "hé"), ("assistant", ""), ("assistant", "b</s>"), ("user", "tail")]
    assert got[1].n_turns == 4 and got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert (got[1].loss_chars, got[1].loss_sha256) == (5, hashlib.sha256(b"b</s>").hexdigest()) and got[2].loss_chars == 0


def test_line_field_by_enumeration():
    col = pa.array(["a b\nC D!!\n\nlast", "", None, "one"], pa.string())
    x, weight, first = line_quality.lines_of(col)
    assert first.tolist() == [0, 4, 5, 6, 7]
    rng = np.random.default_rng(3)
    f = line_quality.Field(rng.normal(size=line_quality.N_FEATURES + 1), rng.normal(size=(2, 2)))
    good, pairs, _ = f.marginals(x, first)
    e = x[:4] @ f.weights[:-1] + f.weights[-1]
    total, own = 0.0, np.zeros(4)
    for k in range(16):
        y = [(k >> i) & 1 for i in range(4)]
        p = np.exp(sum((v - 0.5) * s for v, s in zip(y, e)) + sum(f.trans[a, b] for a, b in zip(y, y[1:])))
        total += p
        own += p * np.array(y)
    assert np.allclose(good[:4], own / total) and np.isclose(pairs.sum(), 3)


def test_line_quality_learns(spark):
    rows = [(i, (text(i, 30) + ".\n" + text(i + 999, 20) + ".") if i % 3 else "\n".join(["BUY!! NOW!! ###"] * 5)) for i in range(200)]
    d = spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), None) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in line_quality.score(d, line_quality.train(d, labels)).collect()}
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((got[i] >= 0.3) == (i % 3 > 0) for i in held) and all(0 <= s <= 1 for s in got.values()) and got[900] == got[901]


def test_context_mixing(spark):
    from pyspark.sql import functions as F

    rows = [(i, text(i % 7, 60)) for i in range(60)] + [(100, None), (101, ""), (102, "zq zq Zq")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in context_mixing.score(d, F.col("doc_id") % 5 != 0, common=50).collect()}
    split = {i: (t or "").lower().split() + [None] for i, t in rows}
    c = {}
    for i, w in split.items():
        if i % 5:
            for t in w:
                c[t] = c.get(t, 0) + 1
    n, v = sum(c.values()), len(c)
    for i, w in split.items():
        g = got[i]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(w), sum(t in c for t in w), n)
        assert abs(g.base_score - sum(np.log10((c.get(t, 0) + 1) / (n + v + 1)) for t in w)) < 1e-6 and g.score < 0
    assert got[0].score > got[0].base_score and got[100].score == got[101].score


def test_probabilities_add_up():
    """The bits of all 256 next bytes make a distribution."""
    texts = [b"abc abd abc", b"abc"] * 9
    data, places, _ = context_mixing.stream(texts)
    code = context_mixing.huffman(np.bincount(context_mixing.behind(data, places), minlength=1 << 16))
    assert np.allclose((0.5 ** code.len).reshape(256, 256).sum(axis=1), 1)
    table = np.zeros((2, context_mixing.BASES[-1]), np.int32)
    context_mixing.count_slots(code, texts, table)
    scorer = context_mixing.Scorer(context_mixing.Model(code, context_mixing.odds_of(table)))
    data = np.frombuffer(b" " * context_mixing.PAD + b"ab", np.uint8)
    total = 0.0
    for b in range(256):
        stream = np.append(data, np.uint8(b))
        at = np.array([len(data)])
        inputs, sign, _ = scorer._inputs(stream, at, context_mixing.contexts(stream, at))
        total += 2 ** -scorer._mix(inputs, sign, None)[0]
    assert np.isclose(total, 1, atol=1e-4)


def test_score_by_plain_loops():
    """The mixer bit by bit in Python: the same bits for a text as the blocks of arrays give."""
    texts = [b"the cat sat on the mat", b"the cat ran", b"a dog sat on a cat " * 30]
    data, places, _ = context_mixing.stream(texts)
    code = context_mixing.huffman(np.bincount(context_mixing.behind(data, places), minlength=1 << 16))
    table = np.zeros((2, context_mixing.BASES[-1]), np.int64)
    context_mixing.count_slots(code, texts, table)
    odds = context_mixing.odds_of(table)
    got = context_mixing.Scorer(context_mixing.Model(code, odds)).bits(texts)
    for text, bits in zip(texts, got):
        data, places, _ = context_mixing.stream([text])
        ctx = context_mixing.contexts(data, places)
        w = [list(row) for row in context_mixing.START]
        size, seen, todo, cost = context_mixing.BLOCKS[0], 0, [], 0.0
        for k, at in enumerate(places.tolist()):
            own = int(data[at - 1]) << 8 | int(data[at])
            for j in range(int(code.at[own]), int(code.at[own] + code.len[own])):
                x = [odds[context_mixing.BASES[i] + int(context_mixing.slots(context_mixing.SLOTS[i], ctx[i][k:k + 1], np.array([1]), code.node[j:j + 1])[0])] / context_mixing.STEPS for i in range(4)]
                level = lambda v: int(abs(v) > context_mixing.LEVELS[0]) + int(abs(v) > context_mixing.LEVELS[1])
                todo.append((3 * level(x[3]) + level(x[2]), [*x, 1.0], int(code.bit[j])))
        while todo:
            block, todo = todo[:size], todo[size:]
            slope = [[0.0] * 5 for _ in w]
            for g, x, bit in block:
                z = min(max(sum(a * b for a, b in zip(w[g], x)), -12), 12)
                p = 1 / (1 + np.exp(-z))
                cost -= np.log2(p if bit else 1 - p)
                for i in range(5):
                    slope[g][i] += (bit - p) * x[i]
            seen += len(block)
            rate = context_mixing.RATE / (64 + seen) ** 0.5 / len(block) ** 0.5
            w = [[a + rate * b for a, b in zip(*rows)] for rows in zip(w, slope)]
            size = min(4 * size, context_mixing.BLOCKS[1])
        assert abs(cost - bits) < 1e-3 * max(cost, 1)


def test_counting_in_bounded_memory(monkeypatch):
    """Pairs that all differ are the worst case of a task that counts; the counts stay whole."""
    import tracemalloc
    from types import SimpleNamespace

    monkeypatch.setattr("pyspark.TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 123, 1 << 18).astype(np.uint8)).decode() for _ in range(8)]
    code, sizes, bits = context_mixing.huffman(np.ones(1 << 16)), (18, 20, 25, 25), 0
    context_mixing._powers32(1 << 20)
    tracemalloc.start()
    for b in context_mixing._counted(code, sizes, [pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]):
        bits += int(context_mixing._unzip(b.column("counts")[0].as_py())[1].sum())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    data, places, _ = context_mixing.stream([t.encode() for t in texts])
    assert bits == 4 * int(code.len[context_mixing.behind(data, places)].sum())
    assert peak < 600e6


def test_nodes_of_a_context_lie_together():
    """Sixteen slots hold sixteen nodes of a context, each its own."""
    for ctx in (1, 77, 2 ** 32 - 5):
        at = context_mixing.slots(22, np.array([ctx], np.uint32), np.array([256]), np.arange(256, dtype=np.uint32)).reshape(16, 16)
        assert (at >> 4 == at[:, :1] >> 4).all() and all(len(set(row)) == 16 for row in at.tolist()) and at.max() < 1 << 22


def test_last_counts_go_straight_to_the_file(tmp_path):
    """One step adds a shard's counts up and writes its log-odds, so that a task has one Python worker."""
    path, n = tmp_path / "odds", context_mixing.SHARD
    path.write_bytes(bytes(3 * n))
    blobs = [context_mixing._zip(np.array([0, 3]), np.array([5, 7])), context_mixing._zip(np.array([1]), np.array([2 ** 40]))]
    pdf = pd.DataFrame({"shard": [1, 1], "part": [0, 1], "counts": blobs})
    assert context_mixing._odds(str(path), pdf)["odds"].tolist() == [None]
    got = np.fromfile(path, np.int8)
    table = np.zeros((2, n), np.int64)
    table[:, :2] = [[5, 0], [2 ** 40, 7]]
    assert np.array_equal(got[n:2 * n], context_mixing.odds_of(table)) and not got[:n].any() and not got[2 * n:].any()
    assert context_mixing._odds(None, pdf)["odds"][0] == got[n:2 * n].tobytes()


@pytest.mark.parametrize("dense", [0, 17, 30])
def test_slots_grow_with_the_contexts(spark, monkeypatch, dense):
    """Few slots to begin with: more are taken, and the counts in them are those of all texts."""
    monkeypatch.setattr(context_mixing, "SLOTS", (16, 16, 16, 16))
    monkeypatch.setattr(context_mixing, "SAMPLE", 4)
    monkeypatch.setattr(context_mixing, "DENSE", dense)
    monkeypatch.setattr(context_mixing, "PAIRS", 500)
    rows = [(" ".join(hashlib.md5(f"{i} {j}".encode()).hexdigest()[:9] for j in range(60)),) for i in range(60)] + [(None,), ("",)]
    raw = [context_mixing.normal(t) for t, in rows]
    data, places, _ = context_mixing.stream(raw)
    counts = np.bincount(context_mixing.behind(data, places), minlength=1 << 16)
    model = context_mixing.train(spark.createDataFrame(rows, "text string").repartition(40), counts)
    for ctx, size in zip(context_mixing.contexts(data, places), model.sizes):
        pair = np.unique(ctx.astype(np.int64) << 16 | context_mixing.behind(data, places))
        n, node, _ = context_mixing.bits_of(model.code, pair & 0xFFFF)
        keys = len(np.unique(np.repeat(pair >> 16, n) << 8 | node))
        assert 2 ** size >= 0.8 * keys
    assert max(model.sizes) > 16
    table = np.zeros((2, context_mixing.bases(model.sizes)[-1]), np.int32)
    context_mixing.count_slots(model.code, raw, table, model.sizes)
    assert np.array_equal(np.memmap(model.odds, np.int8, "r"), context_mixing.odds_of(table))
