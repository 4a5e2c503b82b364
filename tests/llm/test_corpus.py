"""The operators of the training-data list against plain Python on small fixtures with awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arcframe.llm import _graph, line_dedup
from arcframe.llm._common import in_arrow
from arcframe.llm._pieces import BYTE_LEVEL, WORD_LEVEL, PieceTokens, load_tokenizer, pieces_of
from arcframe.llm._words import WORD, join_words, mix, read_words
from arcframe.llm.language import Crf, identify_languages, letter_words, positions, stretches, tag_documents, train, training_sample, word_features
from arcframe.llm.line_dedup import alike, anchored_distance, dedup_lines, edit_distance, edit_distances, line_bands, line_keys, line_sieve, normalized, simhash, similar, similar_pairs, sketch_table, sketches
from arcframe.llm.minhash import dart_signature, near_duplicates
from arcframe.llm.mixing import emit_mixture, plan_mixture, source_targets
from arcframe.llm.packing import encode_pieces, pack, piece_ids, plan_bins
from arcframe.llm.quality import quality_table
from arcframe.llm.queries import BYTE_BPE, ORACLE_SQL, QUERIES, WORD_BPE, tokenizer_path
from arcframe.llm.sharding import assign_shards, write_shards
from arcframe.llm.substrings import drop_repeated_passages
from arcframe.llm.token_counts import count_tokens
from arcframe.llm.vectors import near_vectors

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string"


def words(seed: int, n: int) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choices("abcdefghij", k=draw.randint(2, 7))) for _ in range(n)]


def corpus() -> list[tuple]:
    base = words(1, 120)
    near = base[:50] + ["changed"] + base[51:]
    passage = words(2, 60)
    texts = [
        " ".join(base), " ".join(near), " ".join(base), "", None, "   \n\t ", "one", "one", "two words", "12 34 !!",
        " ".join(words(3, 40) + passage + words(4, 40)), " ".join(words(5, 30) + passage + words(6, 7)), " ".join(passage[:13]), " ".join(passage[:12]),
        "\n".join(" ".join(words(k, 12)) for k in range(10, 20)), "\n".join(" ".join(words(k, 12)) for k in range(15, 25)),
        "the same line here again\nthe same line here again\nThe  SAME line here again", " ".join(words(9, 8) * 30), " ".join(words(7, 9000)),
        "don't <|endoftext|> stop<|endoftext|>  now\n\n x y éß中 \U0001f600 a_b1c", "x" * 30000,
    ]
    rows = [(k, t, ["en", "de", None][k % 3], ["a", "b", None, "a"][k % 4], None, 7, "no") for k, t in enumerate(texts)]
    return rows + [rows[0], rows[7], (None, " ".join(base), "en", "a", None, 7, "no"), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def normal_words(line):
    return line.lower().split()


def split(text):
    return WORD.findall(text or "")


def components(nodes, links):
    at = {x: x for x in nodes}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        at[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def test_components(spark):
    draw = random.Random(4)
    links = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2001 + k) for k in range(50)]
    want = components({x for p in links for x in p if p[0] != p[1]}, [p for p in links if p[0] != p[1]])
    got = {r.node: r.component for r in _graph.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    assert _graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("few", "block"), [(16, 1024), (2, 10)])
def test_buckets_lose_no_link(spark, few, block):
    """A bucket whose pivots link with few members still gives the components of all its pairs."""
    draw = random.Random(5)
    place = {k: draw.random() for k in range(120)}
    rows = [(b, k) for k in place for b in range(3) if b != k % 3 or k % 2] + [(9 + k % 20, k) for k in place]
    near = lambda a, b: abs(place[a] - place[b]) < 0.008
    held = set(rows)
    shared = {(a, b) for key in range(30) for a in place for b in place if a < b and (key, a) in held and (key, b) in held}
    want = components(place, [p for p in shared if near(*p)])
    table = spark.createDataFrame([(k, v) for k, v in place.items()], "node long, v double")

    def verify(pairs):
        a, b = (table.select(F.col("node").alias(x), F.col("v").alias("v" + x)) for x in "ab")
        return pairs.join(a, "a").join(b, "b").where("abs(va - vb) < 0.008").select("a", "b")

    def match(left, right):
        return np.nonzero(np.abs(left.column("v").to_numpy()[:, None] - right.column("v").to_numpy()[None, :]) < 0.008)

    frame = spark.createDataFrame(rows, "key long, node long")
    got = {r.node: r.component for r in _graph.cluster_buckets(frame, verify, lambda members: table, match, few=few, block=block).collect()}
    assert {k: got.get(k, k) for k in place} == want


@pytest.mark.parametrize(("most", "dense"), [(1024, 2), (1024, 0), (10, 2)])
def test_sieved_buckets_lose_no_link(spark, monkeypatch, most, dense):
    """Pairs that are no links are told apart in their bucket; the components are those of all pairs."""
    monkeypatch.setattr(_graph, "DENSE", dense)
    draw = random.Random(6)
    place = {k: draw.random() for k in range(150)}
    rows = [(b, k) for k in place for b in range(3) if b != k % 3 or k % 2] + [(9 + k % 20, k) for k in place]
    held = defaultdict(set)
    for key, k in rows:
        held[key].add(k)
    shared = {(a, b) for x in held.values() for a in x for b in x if a < b}
    want = components(place, [(a, b) for a, b in shared if abs(place[a] - place[b]) < 0.008])
    table = spark.createDataFrame([(k, v, v) for k, v in place.items()], "node long, v double, w double")
    verified = []

    def verify(pairs):
        verified.extend((r.a, r.b) for r in pairs.collect())
        a, b = (table.select(F.col("node").alias(x), F.col("v").alias("v" + x)) for x in "ab")
        return pairs.join(a, "a").join(b, "b").where("abs(va - vb) < 0.008").select("a", "b")

    def sieve(found):
        w = found.column("w").to_numpy()
        return lambda i, j: np.abs(w[i] - w[j]) < 0.02

    def match(left, right):
        return np.nonzero(np.abs(left.column("v").to_numpy()[:, None] - right.column("v").to_numpy()[None, :]) < 0.008)

    frame = spark.createDataFrame(rows, "key long, node long")
    got = {r.node: r.component for r in _graph.cluster_sieved(frame, lambda members: table, sieve, verify, match, marks=["w"], most=most, block=16).collect()}
    assert {k: got.get(k, k) for k in place} == want
    assert len(verified) == len(set(verified)) and set(verified) <= shared
    if most == 1024:
        assert all(abs(place[a] - place[b]) < 0.02 for a, b in verified)


def test_marked_rows(spark, monkeypatch):
    """Every row that is needed stays, and of the others about as many as bits are set."""
    rows, nodes = spark.range(-4000, 4000).select(F.col("id").alias("node"), F.col("id").cast("string").alias("x")), spark.range(-50, 50).select(F.col("id").alias("node"))
    for bits, most in ((1 << 16, 150), (64, 8000)):
        monkeypatch.setattr(_graph, "MARKED", bits)
        got = _graph.marked(rows, nodes.unionAll(nodes))
        assert got.columns == rows.columns
        found = [r.node for r in got.collect()]
        assert len(found) == len(set(found)) <= most and set(range(-50, 50)) <= set(found)
    assert _graph.marked(rows, nodes.limit(0)).count() == 0


def test_blocks_are_dealt_by_number(spark):
    """Blocks of few bytes take long, so they are not joined into one task by their bytes."""
    members = spark.range(400).select((F.col("id") % 20).alias("key"), F.col("id").alias("node"), F.col("id").alias("comp"))
    dealt = _graph._block_links(members, members.select("node"), lambda left, right: (np.zeros(1, np.int64), np.zeros(1, np.int64)), 5)
    found = dealt.withColumn("task", F.spark_partition_id()).select("task").distinct().count()
    assert found >= int(spark.conf.get("spark.sql.shuffle.partitions")) // 2


@pytest.mark.parametrize(("hot_share", "part", "fan"), [(1, 3 << 20, 4096), (0.0, 40, 4096), (0.0, 40, 64)])
def test_shared_buckets(spark, monkeypatch, hot_share, part, fan):
    """Pairs of keys with one node go, over any parts and steps, and hot keys lose none."""
    for name, value in (("HOT_SHARE", hot_share), ("PART_PAIRS", part), ("FAN_OUT", fan)):
        monkeypatch.setattr(_graph, name, value)
    draw = random.Random(12)
    rows = [(int(draw.paretovariate(0.4)) % 3000, draw.randint(0, 60)) for _ in range(6000)]
    table = spark.createDataFrame(rows, "key long, node long").repartition(3)
    hots = []

    def deal(hot, parts):
        hots.append(set(hot.tolist()))
        return table.mapInArrow(lambda batches: (_graph.deal_pairs(b.column(0).to_numpy(), b.column(1).to_numpy(), hot, parts) for b in batches), "part long, packed binary")

    got = _graph.shared_buckets(deal, table, 1.0).collect()
    nodes = defaultdict(set)
    for key, node in rows:
        nodes[key].add(node)
    want = {(k, v) for k, held in nodes.items() if len(held) > 1 or k in hots[0] for v in held}
    assert sorted((r.key, r.node) for r in got) == sorted(want) and bool(hots[0]) == (hot_share == 0)
    assert _graph.parts_for(1e13 * 20) > 4096


def test_minhash(docs, none):
    rows = near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    sets = {}
    for r in docs.collect():
        w = split(r.text)
        sets[(r.doc_id, r.text)] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    ids = {k: s for (k, _), s in sets.items() if k is not None}
    links = [(a, b) for a in ids for b in ids if a < b and ids[a] and ids[b] and len(ids[a] & ids[b]) >= 0.8 * len(ids[a] | ids[b])]
    want = components(ids, links)
    assert all(r.class_id == want[r.doc_id] for r in rows if r.doc_id is not None)
    kept = [r for r in rows if r.kept and r.n_shingles]
    assert len({r.class_id for r in kept}) == len(kept) == len({r.class_id for r in rows if r.n_shingles})
    assert all(r.kept for r in rows if not r.n_shingles)
    assert next(r for r in rows if r.doc_id is None and r.text).class_id == 0
    assert near_duplicates(none).count() == 0


def test_weighted_minhash(spark):
    a, b = np.arange(1, 60, dtype=np.uint64), np.arange(20, 80, dtype=np.uint64)
    draw = np.random.default_rng(1)
    wa, wb = draw.uniform(0.2, 3, len(a)), draw.uniform(0.2, 3, len(b))
    in_a, in_b = dict(zip(a.tolist(), wa)), dict(zip(b.tolist(), wb))
    keys = in_a.keys() | in_b.keys()
    want = sum(min(in_a.get(k, 0), in_b.get(k, 0)) for k in keys) / sum(max(in_a.get(k, 0), in_b.get(k, 0)) for k in keys)
    assert abs((dart_signature(a, wa, 4096) == dart_signature(b, wb, 4096)).mean() - want) < 0.03
    assert abs((dart_signature(a, None, 4096) == dart_signature(b, None, 4096)).mean() - 40 / 79) < 0.03
    assert (dart_signature(a, None, 120) == dart_signature(a[::-1], None, 120)).all()
    rows = [(1, " ".join(["a b c d e"] * 8)), (2, " ".join(["a b c d e"] * 3)), (3, " ".join(["a b c d e"] * 8))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_duplicates(frame).collect()} == {1: 1, 2: 1, 3: 1}
    assert {r.doc_id: r.class_id for r in near_duplicates(frame, weights="count").collect()} == {1: 1, 2: 2, 3: 1}


def test_bins():
    draw = random.Random(0)
    for trial in range(200):
        capacity = draw.choice([10, 20, 50])
        histogram = Counter(draw.randint(0 if trial % 3 == 0 else 1, capacity) for _ in range(draw.randint(0, 40)))
        bins, figures = plan_bins(histogram, capacity)
        back = Counter()
        for held, n in bins:
            assert sum(held) <= capacity and n > 0
            for x in held:
                back[x] += n
        assert back == histogram and figures["bins"] >= figures["lower_bound"]
    with pytest.raises(ValueError):
        plan_bins({11: 1}, 10)


def test_dominance_is_optimal():
    """Fixed sets never cost a bin: the plan with best fit on the rest is optimal wherever reduction settles everything."""
    draw = random.Random(2)

    def best(items, capacity):
        items, least = sorted(items, reverse=True), len(items)

        def place(k, rooms):
            nonlocal least
            if len(rooms) >= least:
                return
            if k == len(items):
                least = len(rooms)
                return
            for r in {r for r in rooms if r >= items[k]}:
                rest = list(rooms)
                rest[rest.index(r)] -= items[k]
                place(k + 1, rest)
            place(k + 1, [*rooms, capacity - items[k]])

        place(0, [])
        return least

    settled = 0
    for _ in range(150):
        items = [draw.randint(3, 20) for _ in range(draw.randint(1, 9))]
        _, figures = plan_bins(Counter(items), 20)
        if figures["fixed"] == figures["bins"]:
            settled += 1
            assert figures["bins"] == best(items, 20)
    assert settled > 50


def test_packing(docs, none):
    pieces = encode_pieces(docs, tokenizer_path(WORD_BPE), capacity=64)
    placed = pack(pieces, order=["doc_id", "piece"], capacity=64, buckets=3).collect()
    tokenizer = load_tokenizer(tokenizer_path(WORD_BPE))
    back = defaultdict(list)
    for r in placed:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length and r.start == 64 * r.piece
        back[r.doc_id].append(r)
    for r in docs.where("doc_id is not null").dropDuplicates(["doc_id"]).collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        mine = sorted({(p.piece, bytes(p.ids)) for p in back[r.doc_id]})
        assert np.frombuffer(b"".join(x[1] for x in mine), "<u4").tolist() == ids
    bins = defaultdict(list)
    for r in placed:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(r.length for r in placed) // 64) * 1.2 + 1
    assert pack(encode_pieces(none, tokenizer_path(WORD_BPE)), order=["doc_id", "piece"]).count() == 0


@pytest.mark.parametrize(("name", "pattern"), [(BYTE_BPE, BYTE_LEVEL), (WORD_BPE, WORD_LEVEL)])
def test_pieces_encode_as_whole_texts(name, pattern):
    draw = random.Random(3)
    letters = "ab Zé×ß²3٣'s<|>endoftext._-  \n\t\r\x1cć中α  ́\"'t'll"
    texts = ["".join(draw.choices(letters, k=draw.randint(0, 40))) + draw.choice(["", "<|endoftext|>", " <|endoftext|> x", "don't", "<|startoftext|>"]) for _ in range(5000)]
    known = PieceTokens(load_tokenizer(tokenizer_path(name)), list, limit=4000)
    for a in range(0, len(texts), 500):
        cut = [pieces_of(x, pattern, known.special) for x in texts[a : a + 500]]
        known.learn([p for pieces in cut for p in pieces])
        for pieces, want in zip(cut, known.tokenizer.encode_batch(texts[a : a + 500], add_special_tokens=False), strict=True):
            assert [i for p in pieces for i in known[p]] == want.ids


def test_pieces_are_encoded_once():
    """A full table keeps what is wanted again, and a worker its tokenizer and table."""
    path, calls = tokenizer_path(WORD_BPE), []
    known = PieceTokens(load_tokenizer(path), lambda ids: calls.append(1) or ids.tobytes(), limit=3)
    known.learn(["one", "two"])
    known.learn(["one", "three", "four"])
    assert len(calls) == 4 and set(known) == {"one", "three", "four"}
    assert np.frombuffer(known["four"], "<u4").tolist() == known.tokenizer.encode("four", add_special_tokens=False).ids
    assert piece_ids(path) is piece_ids(path)


def test_words_are_encoded_with_blanks_between():
    """Words of Latin letters need no special token between; those of a text whose words can't be told apart get one."""
    known = PieceTokens(load_tokenizer(tokenizer_path(WORD_BPE)), np.ndarray.tobytes)
    words, others = ["Anblewh", "été", "a", "ſǅŉß", "x" * 3000], ["don't", "3a", "ά", ".", "x" * 5000, "<|endoftext|>"]
    alone = {x: known.tokenizer.encode(x, add_special_tokens=False).ids for x in [*words, *others]}
    inner, seen = known.tokenizer, []
    known.tokenizer = SimpleNamespace(encode_batch_fast=lambda texts, **k: seen.extend(texts) or inner.encode_batch_fast(texts, **k))
    for last in (known.last, known.last & False):
        known.clear()
        known.last = last
        known.learn([*words, *others])
        assert {x: np.frombuffer(ids, "<u4").tolist() for x, ids in known.items()} == alone
    first = seen[0]
    assert sorted(first.split(" ")) == sorted(words) and known.separator not in first
    assert PieceTokens(load_tokenizer(tokenizer_path(BYTE_BPE)), len).last is None


def test_frequent_pieces_stay():
    """A full table keeps what was wanted twice, though not just then."""
    calls = []
    known = PieceTokens(load_tokenizer(tokenizer_path(WORD_BPE)), lambda ids: calls.append(1) or ids.tobytes(), limit=8)
    for k in range(12):
        known.learn({"often", "rare" + "abcdefghijkl"[k]} if k % 3 else {"common", "usual", "odd" + "abcdefghijkl"[k]})
    assert {"often", "common", "usual"} < set(known) and len(calls) == 3 + 12 and len(known) <= 8


def test_many_words_meet_the_model_alone():
    """All Latin letters, in words by the hundred, as the whole tokenizer reads them; tokenizers of other steps are left as they are."""
    known = PieceTokens(load_tokenizer(tokenizer_path(WORD_BPE)), np.ndarray.tobytes)
    letters = re.findall(WORD_LEVEL.pattern[: WORD_LEVEL.pattern.index("]") + 1], "".join(map(chr, range(0x250))))
    draw = random.Random(12)
    every = sorted({x + y for x in letters for y in draw.choices(letters, k=4)} | {"".join(draw.choices(letters, k=9)) for _ in range(3000)} | set(letters))
    assert len(letters) > 400 and "İ" not in letters and "ı" in letters
    want = [x.ids for x in known.tokenizer.encode_batch_fast(every, add_special_tokens=False)]
    known.tokenizer = SimpleNamespace(encode_batch_fast=lambda texts, **k: [None for _ in texts if pytest.fail("not by the table")])
    known.learn(every)
    assert [np.frombuffer(known[x], "<u4").tolist() for x in every] == want
    assert PieceTokens(load_tokenizer(tokenizer_path(BYTE_BPE)), len).table is None


@pytest.mark.parametrize(("name", "pattern"), [(BYTE_BPE, BYTE_LEVEL), (WORD_BPE, WORD_LEVEL)])
def test_every_letter_before_every_symbol(name, pattern):
    """All letters that end a run, before all that may follow, as the library reads them."""
    known = PieceTokens(load_tokenizer(tokenizer_path(name)), list, limit=1 << 18)
    follow = [chr(c) for c in range(32, 127)] + ["\n", "é", "\u0307", ""]
    for letter in [*"AZaz", *map(chr, range(0xC0, 0x250))]:
        texts = [f"ab{letter}{x}{letter}{x}c" for x in follow]
        cut = [pieces_of(x, pattern, known.special) for x in texts]
        known.learn([p for pieces in cut for p in pieces])
        for pieces, want in zip(cut, known.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
            assert [i for p in pieces for i in known[p]] == want.ids, (letter, pieces)


def test_clashing_columns(spark):
    """Columns named as the results or as helpers: results replace, helpers make room."""
    rows = spark.createDataFrame([(k, 7, "x", 1.5, "h", "r", 9) for k in range(30)], "doc_id long, length int, offset string, sequence_id double, _bucket string, _rank string, _n int")
    got = pack(rows, order=["doc_id"], capacity=14).collect()
    assert len(got) == 30 and len({r.sequence_id for r in got}) == 15 and {(r.offset, r._bucket, r._rank, r._n) for r in got} == {(0, "h", "r", 9), (7, "h", "r", 9)}
    rows = spark.createDataFrame([(k, "s", "a", 1, 2, "k", 0.5) for k in range(30)], "doc_id long, source string, shard string, slot int, _at int, _key string, _frac double")
    got = assign_shards(rows, shards=3, order=["doc_id"]).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(3) for k in range(10)] and {(r._at, r._key, r._frac) for r in got} == {(2, "k", 0.5)}
    rows = spark.createDataFrame([(k, "ein text von hier", "de", "x", 1, True) for k in range(30)], "doc_id long, text string, lang string, lang_pred string, score int, held_out boolean")
    assert {(r.lang_pred, r.lang) for r in identify_languages(rows).collect()} == {("de", "de")}


def test_shards_of_single_rows(spark):
    """Thousands of sources of one row share one fraction and are still dealt evenly, in the order of the strata."""
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("source"))
    got = sorted((r.shard, r.slot, r.doc_id) for r in assign_shards(rows, shards=7, order=["doc_id"]).collect())
    assert [d for *_, d in got] == list(range(3000)) and {n for n in Counter(s for s, *_ in got).values()} == {428, 429}


def test_token_counts(docs, none):
    tokenizer = load_tokenizer(tokenizer_path(BYTE_BPE))
    for batch in (4 << 20, 1000):
        rows = count_tokens(docs, tokenizer_path(BYTE_BPE), batch_bytes=batch).collect()
        got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows)
        want = Counter()
        for r in docs.collect():
            n = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)
            want[(r.doc_id, len((r.text or "").encode()), n, n > 512)] += 1
        assert got == want
    assert count_tokens(none, tokenizer_path(BYTE_BPE)).count() == 0


def test_shards(spark, docs, none, tmp_path):
    rows = assign_shards(docs, shards=5, order=["doc_id", "text"]).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert len(rows) == docs.count() and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    placed = assign_shards(many, shards=24, order=["doc_id"]).collect()
    counts = Counter((r.shard, r.source) for r in placed)
    for source, n in Counter(r.source for r in placed).items():
        assert all(abs(counts[(s, source)] - n / 24) <= 2 for s in range(24))
    keys = {r.doc_id: hashlib.md5(f"shard:{r.doc_id}".encode()).hexdigest() for r in placed}
    group = defaultdict(list)
    for r in placed:
        group[r.source].append(r.doc_id)
    order = sorted(((i + 0.5) / len(g), s, keys[d], d) for s, g in group.items() for i, d in enumerate(sorted(g, key=lambda d: (keys[d], d))))
    where = {r.doc_id: (r.shard, r.slot) for r in placed}
    assert [where[d] for *_, d in order] == sorted(where.values())
    assert assign_shards(none, order=["doc_id"]).count() == 0
    write_shards(docs.select("doc_id", "text", "source"), str(tmp_path / "out"), shards=3, order=["doc_id", "text"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


def test_language(spark, none):
    draw = random.Random(1)
    kinds = {"en": "the of and ing tion er sh".split(), "de": "der und sch keit ung ein zu".split()}
    text = lambda lang: " ".join("".join(draw.choices(kinds[lang], k=2)) for _ in range(60))
    rows = [(k, text(lang := ["en", "de"][k % 2]), lang) for k in range(120)]
    rows += [(900, None, "en"), (901, "12 ² !!", None), (902, text("en") + " " + text("de")[:60], None), (None, text("de"), "de"), (903, "", "de")]
    tagged = identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_label=40).collect()
    by = {r.doc_id: r for r in tagged}
    held = [r for r in tagged if r.held_out and r.lang]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in tagged if r.doc_id is not None)
    assert sum(r.lang == r.lang_pred for r in tagged if r.doc_id is None or r.doc_id < 900) >= 0.98 * 121
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (900, 901, 903)) and by[None].lang_pred == "de"
    assert by[902].lang_pred == "en" and 0.6 < by[902].score < 0.95 and 0.05 < by[902].word_share["de"] < 0.4
    assert identify_languages(none).count() == 0
    assert {r.lang_pred for r in identify_languages(spark.createDataFrame([(1, "hello", None)], "doc_id long, text string, lang string")).collect()} == {"und"}


def test_forward_backward():
    """Against the sum over all labellings, with padding."""
    draw = np.random.default_rng(0)
    crf = Crf(["a", "b", "c"], np.zeros((2, 3), np.float32), draw.normal(size=(3, 3)), draw.normal(size=3))
    scores, lengths = draw.normal(size=(4, 2, 3)), np.array([4, 2])
    got = crf.posteriors(scores, lengths)
    for b, n in enumerate(lengths):
        want = np.zeros((n, 3))
        for path in np.ndindex(*[3] * n):
            weight = np.exp(crf.start[path[0]] + sum(scores[t, b, x] for t, x in enumerate(path)) + sum(crf.transitions[x, y] for x, y in zip(path, path[1:])))
            for t, x in enumerate(path):
                want[t, x] += weight
        assert np.allclose(got[:n, b], want / want.sum(axis=1, keepdims=True), atol=1e-9)
        assert (got[n:, b] == 0).all()


def test_switch_is_labelled():
    draw = random.Random(3)
    kinds = {"en": "the of and ing tion".split(), "de": "der und sch keit ung".split()}
    text = lambda lang, n: " ".join("".join(draw.choices(kinds[lang], k=2)) for _ in range(n))
    crf = train([text(["en", "de"][k % 2], 50) for k in range(60)], [["en", "de"][k % 2] for k in range(60)], rounds=3)
    words = letter_words(text("en", 20) + " " + text("de", 20))
    scores = crf.word_scores(words)[:, None, :]
    labels = crf.posteriors(scores, np.array([40]))[:, 0].argmax(axis=1)
    assert [crf.labels[k] for k in labels] == ["en"] * 20 + ["de"] * 20
    assert crf.transitions.trace() > crf.transitions.sum() - crf.transitions.trace()


def test_mixing(spark, docs, none):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 0), ("d", 500), (None, 40)], "source string, size long")
    got = {r.source: r.target for r in source_targets(sizes).collect()}
    weights, size = {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}, {"a": 1000, "b": 10, "c": 0, "d": 500, None: 40}
    want, capped = {}, set()
    while True:
        left = 1550 - sum(3 * size[s] for s in capped)
        rest = [s for s in size if s not in capped]
        want = {s: 3 * size[s] if s in capped else left * weights[s] / sum(weights[x] for x in rest) for s in size}
        over = {s for s in rest if want[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    assert all(abs(got[s] - want[s]) < 1e-6 for s in size)
    rows = plan_mixture(docs).collect()
    assert len(rows) == docs.count()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r.doc_id, len(split(r.text))) for r in docs.collect())
    assert all(0 <= r.copies <= 3 and r.target <= 3 * r.source_size + 1e-6 for r in rows)
    assert Counter(r.doc_id for r in emit_mixture(docs).collect()) == Counter(r.doc_id for r in rows for _ in range(r.copies))
    assert emit_mixture(docs).columns == docs.columns
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("w w w").alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    for r in plan_mixture(many).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("target")).collect():
        assert abs(r.taken - r.target) < 0.06 * r.target
    assert plan_mixture(none).count() == 0 and emit_mixture(none).count() == 0


def test_vectors(spark):
    draw = np.random.default_rng(2)
    base = draw.normal(size=(60, 16))
    vectors = [*base, *(base[:40] + draw.normal(size=(40, 16)) * 0.1), *(base[:1] + draw.normal(size=(60, 16)) * 0.08), *base[:30], *(base[:10] * 4)]
    rows = [(k, [float(x) for x in v], int(k % 60 % 2) if k < 100 or k >= 160 else 0, "x") for k, v in enumerate(np.array(vectors, np.float32))]
    rows += [(500, None, 1, "x"), (501, [0.0] * 16, 1, "x"), (502, [float("nan")] * 16, 1, "x"), (503, [None] + [1.0] * 15, 1, "x"), (504, rows[0][1], None, "x"), (505, [], 1, "x"), (506, rows[0][1][:8], 0, "x")]
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, kept string"), block=16).collect()}
    ok = {k: (np.array(v, np.float64), lab) for k, v, lab, _ in rows if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = [(a, b) for a in ok for b in ok if a < b and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and ok[a][0] @ ok[b][0] / np.linalg.norm(ok[a][0]) / np.linalg.norm(ok[b][0]) >= 0.98]
    degree = Counter(x for p in links for x in p)
    want = components([r[0] for r in rows], links)
    assert {k: (r.n_links, r.component_id, r.kept) for k, r in got.items()} == {k: (degree[k], want[k], want[k] == k) for k in want}
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_edit_distance():
    draw = random.Random(1)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for _ in range(400):
        a, b = ("".join(draw.choices("abc", k=draw.randint(0, 20))) for _ in range(2))
        assert edit_distance(a, b) == plain(a, b)


def test_long_texts_by_stretches(spark):
    """A text read in stretches gets what it gets whole; a word beyond 40 letters counts to its end."""
    draw = random.Random(6)
    kinds = {"en": "the of and ing tion".split(), "de": "der und sch keit ung".split()}
    text = lambda lang, n: " ".join("".join(draw.choices(kinds[lang], k=2)) for _ in range(n))
    crf = train([text(["en", "de"][k % 2], 50) for k in range(60)], [["en", "de"][k % 2] for k in range(60)], rounds=2)
    assert crf.start.any()
    long = " ".join(text(["en", "de", "en"][k % 3], draw.randint(3, 200)) for k in range(300)) + "\n 12 ... \n" + text("de", 9)
    frame = spark.createDataFrame([(0, long), (1, text("de", 30)), (2, "!" * 5000), (3, "tion" * 500)], "doc_id long, text string")
    whole, cut = ({r.doc_id: r for r in tag_documents(frame, crf, stretch=n).collect()} for n in (1 << 21, 700))
    assert len(long) > 50000
    for k in range(4):
        assert whole[k].lang_pred == cut[k].lang_pred and abs(whole[k].score - cut[k].score) < 1e-4
    assert [whole[k].lang_pred for k in range(4)] == ["en", "de", "und", "en"]
    assert "".join(long[a:b] for a, b in stretches(long, 700)) == long


def test_every_label_is_learned(spark):
    rows = [(k, f"text {k}", f"l{k % 60}") for k in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for most, n in ((20000, 10), (120, 2), (1, 1)):
        texts, labels = training_sample(frame, most_rows=most)
        assert Counter(labels) == {f"l{k}": n for k in range(60)} and len(set(texts)) == len(texts)


def test_language_of_long_runs(spark):
    """Every letter of a run without blanks counts, and so does a switch of language inside it."""
    draw = random.Random(31)
    run = lambda letters, n: "".join(draw.choices(letters, k=n))
    a, b = "\u4e00\u4e8c\u4e09\u56db\u4e94\u516d", "\u3042\u3044\u3046\u3048\u304a\u304b"
    crf = train([run(x, 400) for x in (a, b) for _ in range(30)], ["a"] * 30 + ["b"] * 30)
    texts = [run(a, 50) + run(b, 950), run(b, 400) + run(a, 600), run(a, 40)]
    rows = sorted(tag_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), crf).collect())
    assert [r.lang_pred for r in rows] == ["b", "a", "a"]
    assert abs(rows[0].word_share["a"] - 0.05) < 0.03 and abs(rows[1].word_share["b"] - 0.4) < 0.03
    long = "".join(chr(0x4E00 + k) for k in range(100))
    pieces = positions(["ab", long])
    assert "".join(p.strip("^~$")[:40] for p in pieces[1:]) == long and pieces[0] == "ab" and pieces[-1].endswith("$")
    assert len(set(word_features(pieces[1:], 1 << 30)[1].tolist())) > 200


def test_line_dedup(docs, none, spark):
    draw = random.Random(8)
    lines = [" ".join(words(100 + k, 30)) for k in range(25)]
    changed = [" ".join(draw.choice(lines).split()[:-1] + [f"w{k}"]) for k in range(40)]
    extra = [(1000 + k, "\n".join(draw.choices(lines + changed + ["", " ", "x 12", "X  7"], k=5)), None, None, None, None, None) for k in range(40)]
    frame = docs.union(spark.createDataFrame(extra, SCHEMA))
    rows = dedup_lines(frame).collect()
    assert len(rows) == frame.count()
    source = frame.collect()
    norm = {}
    for r in source:
        for line in (r.text or "").split("\n"):
            if w := normal_words(line):
                norm.setdefault(" ".join(w), len(norm))
    names = list(norm)
    links = like_pairs(names)
    group = components(range(len(names)), links)
    assert len(links) >= 20
    kept = Counter()
    for r in rows:
        for line in (r.text or "").split("\n"):
            if w := normal_words(line):
                kept[group[norm[" ".join(w)]]] += 1
    assert kept == Counter(dict.fromkeys(set(group.values()), 1))
    first = {}
    for r in sorted((r for r in source if r.doc_id is not None), key=lambda r: r.doc_id):
        for k, line in enumerate((r.text or "").split("\n")):
            if w := normal_words(line):
                first.setdefault(group[norm[" ".join(w)]], r.doc_id)
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for g, d in first.items():
        assert any(group[norm[" ".join(w)]] == g for r in by[d] for line in (r.text or "").split("\n") if (w := normal_words(line)))
    assert by[4][0].text is None and by[3][0].text == "" and by[5][0].text == "   \n\t "
    assert dedup_lines(none).count() == 0


def like_pairs(lines):
    """All pairs of edit similarity 0.8, by another engine."""
    con = duckdb.connect()
    con.execute("create table l (k int, t varchar, n int)")
    con.executemany("insert into l values (?, ?, ?)", [(k, x, len(x)) for k, x in enumerate(lines)])
    sql = "select a.k, b.k from l a join l b on b.k < a.k and abs(a.n - b.n) <= greatest(a.n, b.n) * 0.2 + 1e-9 and levenshtein(a.t, b.t) <= greatest(a.n, b.n) * 0.2 + 1e-9"
    return con.execute(sql).fetchall()


def edited(draw, kind, low, high):
    """A line of low..high words and one like it: a word replaced, or two characters."""
    common = "the of and to in a is that it on".split()
    while True:
        line = [draw.choice(common) if draw.random() < 0.3 else "".join(draw.choices("abcdefghijklmnoprstuvw", k=draw.randint(2, 9))) for _ in range(draw.randint(low, high))]
        other = list(line)
        if kind == "word":
            other[draw.randrange(len(other))] = "".join(draw.choices("abcdefghijklmnoprstuvw", k=draw.randint(2, 9)))
        else:
            letters = list(" ".join(line))
            for at in draw.sample(range(len(letters)), 2):
                letters[at] = draw.choice("xyz")
            other = "".join(letters).split()
        if line != other and similar(" ".join(line), " ".join(other), 0.8):
            return " ".join(line), " ".join(other)


@pytest.mark.parametrize("kind", ["word", "characters"])
@pytest.mark.parametrize(("low", "high"), [(5, 9), (10, 20), (21, 60), (61, 200)])
def test_line_recall(kind, low, high):
    """Nine of ten planted near lines share a key, whatever their length; keys follow from a line alone, so at any number of rows."""
    draw = random.Random(low)
    pairs = [edited(draw, kind, low, high) for _ in range(1500)]
    sides = []
    for lines in zip(*pairs, strict=True):
        found = read_words(pa.array(lines))
        keys, line = line_keys(found.hashes, found.ends - found.starts, np.diff(found.bounds))
        sides.append([set(keys[line == k].tolist()) for k in range(len(pairs))])
    near = alike(*(sketch_table(sketches(read_words(pa.array(lines))))[1] for lines in zip(*pairs, strict=True)))
    assert np.mean([bool(a & b) and ok for a, b, ok in zip(*sides, near, strict=True)]) >= 0.9


@pytest.mark.parametrize(("low", "high"), [(2, 9), (8, 22), (60, 90)])
def test_line_sieve_passes_what_is_similar(low, high):
    """The characters of two lines never rule out a pair at the threshold; of unlike short lines they rule out most."""
    draw = random.Random(high)
    sides = list(zip(*[edited(draw, ("word", "characters")[k % 2], low, high) for k in range(600)], strict=True))
    sides[1] = [*sides[1][:300], *sides[0][301:], sides[0][300]]  # half of them with a line of others
    lines = pa.array([x for side in sides for x in side])
    found = read_words(lines)
    table = pa.table({"size": [len(x) for x in lines.to_pylist()], "sketch": sketches(found, lines)})
    i, j = np.arange(600), np.arange(600, 1200)
    passed = line_sieve(table, 0.8)(i, j)
    alone = pa.table({"size": table.column("size"), "sketch": sketches(found)})  # without the characters
    true = np.array([similar(a, b, 0.8) for a, b in zip(*sides, strict=True)])
    assert (passed[true] == line_sieve(alone, 0.8)(i, j)[true]).all() and true.sum() > 200
    assert passed[~true].mean() < 0.3


def test_line_query_recall(spark):
    """The whole operator against all pairs by another engine, alone and among thousands of other lines."""
    draw = random.Random(18)
    lines = [x for k in range(160) for x in edited(draw, ("word", "characters")[k % 2], *((5, 9), (10, 20), (21, 60))[k % 3])]
    links = like_pairs(lines)
    groups = len(set(components(range(len(lines)), links).values()))
    found = []
    for others in (0, 4000):
        rows = [(k, x) for k, x in enumerate(lines)] + [(1000 + k, " ".join(words(50000 + k, 12))) for k in range(others)]
        kept = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id < 1000").collect()
        found.append(sorted(r.doc_id for r in kept if r.n_removed))
    assert found[0] == found[1] and len(lines) - groups >= len(found[0]) >= 0.9 * (len(lines) - groups)


def test_tasks_give_memory_back(spark):
    """A worker that stays holds little of what its last task had."""

    def held(batches):
        import psutil

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([psutil.Process().memory_info().rss >> 20])], ["mb"])

    def small(batches):
        for batch in batches:
            parts = [b"x" * (50_000 + k) for k in range(4000)]  # below the size that the system gives on its own
            last = parts[-1]
            del parts
            yield batch.slice(0, len(last) and 1)

    one = spark.range(1, numPartitions=1)
    before = one.mapInArrow(held, "mb long").first().mb
    assert in_arrow(one, small, "id long").count() == 1
    assert one.mapInArrow(held, "mb long").first().mb < before + 100


def test_sieving_takes_little_memory():
    """Pairs of a whole bucket are sieved by stretches: memory doesn't grow with the square of its size."""
    lines = pa.array([" ".join(words(k, 12)) for k in range(1100)])
    table = pa.table({"size": pa.array([len(x) for x in lines.to_pylist()], pa.int32()), "sketch": sketches(read_words(lines), lines)})
    test, (i, j) = line_sieve(table, 0.8), np.triu_indices(1100, 1)
    tracemalloc.start()
    found = test(i, j)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20 and found.tolist() == [x for k in range(0, len(i), 20000) for x in test(i[k : k + 20000], j[k : k + 20000]).tolist()]


def test_edit_distances():
    draw = random.Random(3)
    texts = [["".join(draw.choices("abcé\U0001f600 ", k=draw.choice([1, 5, 63, 64, 65, 130, 200]))) for _ in range(400)] for _ in range(2)]
    for k in range(0, 400, 2):
        texts[1][k] = texts[0][k][: draw.randint(1, 200)] + "zz" + texts[0][k][draw.randint(0, 9) :]
    codes = [[np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in side] for side in texts]
    assert edit_distances(*codes).tolist() == [edit_distance(a, b) for a, b in zip(*texts, strict=True)]
    for most in (3, 40):
        want = [edit_distance(a, b) for a, b in zip(*texts, strict=True)]
        assert [min(edit_distance(a, b, most), most + 1) for a, b in zip(*texts, strict=True)] == [min(x, most + 1) for x in want]
        for k in range(0, 400, 50):
            side = [x[k : k + 50] for x in codes]
            assert [min(x, most + 1) for x in edit_distances(*side, np.full(50, most)).tolist()] == [min(x, most + 1) for x in want[k : k + 50]]
    for cells in (1, 1 << 14):
        assert similar_pairs(*texts, 0.6, cells=cells).tolist() == [similar(a, b, 0.6) for a, b in zip(*texts, strict=True)]
    assert similar_pairs(["", "", "a"], ["", "a", "a"], 0.8).tolist() == [True, False, True]


def test_edit_distances_of_long_lines():
    """Lines of one vocabulary: no distance up to the bound is lost, and what is over it is told without reading the whole."""
    draw = random.Random(8)
    base = [" ".join(words(draw.randint(0, 40), draw.choice([30, 90, 110]))) for _ in range(40)]
    pairs = []
    for k in range(1200):
        x = draw.choice(base)
        if k % 3 == 0:
            y = draw.choice(base)
        elif k % 3 == 1:
            parts = x.split(" ")
            draw.shuffle(parts)
            y = " ".join(parts)
        else:
            cut, edits = list(x), draw.choice([0, 5, 80, 125, 180])
            for _ in range(edits):
                cut[draw.randrange(len(cut))] = draw.choice("abc ")
            for _ in range(draw.choice([0, 60])):
                cut.insert(draw.choice([0, len(cut) // 2]), "q")
            y = "".join(cut)
        pairs.append((x, y) if len(x) <= len(y) else (y, x))
    exact = [edit_distance(x, y) for x, y in pairs]
    codes = [[np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in side] for side in zip(*pairs, strict=True)]
    assert edit_distances(*codes).tolist() == exact
    most = np.array([0.2 * len(y) for _, y in pairs])
    want = [d <= m for d, m in zip(exact, most, strict=True)]
    assert 150 < sum(want) < 1000
    assert (edit_distances(*codes, most) <= most).tolist() == want
    assert [edit_distance(x, y, m) <= m for (x, y), m in zip(pairs, most, strict=True)] == want
    assert similar_pairs(*map(list, zip(*pairs, strict=True)), 0.8).tolist() == want

    class Read(str):
        def __iter__(self):
            for c in str.__iter__(self):
                seen.append(c)
                yield c

        def __getitem__(self, at):
            return Read(str.__getitem__(self, at))

    seen = []
    x, y = ("".join(draw.choices("abcdefghij ", k=2000)) for _ in range(2))
    assert edit_distance(x, Read(y), 400) > 400 and len(seen) < 1500


def test_near_lines_are_settled_by_words(monkeypatch):
    """Lines with a few words replaced, put in or left out are similar without a character being compared; unlike lines of mixed lengths are compared side by side."""
    draw = random.Random(33)
    near, far = [], []
    for k in range(200):
        a = words(k, draw.randint(20, 300))
        b = list(a)
        for at in draw.sample(range(len(a)), len(a) // 12):
            b[at] = "".join(draw.choices("xyz", k=len(a[at])))
        if k % 2:
            b[7:7] = ["qq"]
            del b[-3]
        near.append((" ".join(a), " ".join(b)))
        far.append(tuple(" ".join(words(10**6 + 2 * k + side, len(a))) for side in (0, 1)))
    want = [similar(*pair, 0.8) for pair in near + far]
    assert sum(want[:200]) == 200 and sum(want[200:]) < 100
    alone = []
    monkeypatch.setattr(line_dedup, "edit_distance", lambda *pair: alone.append(pair) or edit_distance(*pair))
    assert similar_pairs(*map(list, zip(*near + far, strict=True)), 0.8).tolist() == want and len(alone) < 40
    monkeypatch.setattr(line_dedup, "edit_distance", None)
    monkeypatch.setattr(line_dedup, "edit_distances", None)
    assert all(similar_pairs(*map(list, zip(*near, strict=True)), 0.8))


@pytest.mark.parametrize("most", [None, 5, 60, 400])
def test_edit_distances_of_mixed_lengths(most):
    """Pairs of one and of many numbers of 64 bits at once, empty texts, letters that no pattern holds."""
    draw = random.Random(44)
    sides = [[], []]
    for _ in range(300):
        a = "".join(draw.choices("abcé\U0001f600 ", k=draw.choice([1, 3, 63, 64, 65, 128, 300, 900])))
        b = list(a)
        for _ in range(draw.choice([0, 4, 50, 350])):
            at = draw.randrange(len(b) + 1)
            b[at : at + draw.randint(0, 2)] = draw.choices("abcz", k=draw.randint(0, 2))
        sides[0].append(a)
        sides[1].append("".join(b))
    codes = [[np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in side] for side in sides]
    want = [edit_distance(a, b) for a, b in zip(*sides, strict=True)]
    if most is None:
        assert edit_distances(*codes).tolist() == want
    else:
        assert [min(x, most + 1) for x in edit_distances(*codes, np.full(300, most)).tolist()] == [min(x, most + 1) for x in want]


def test_anchored_distance():
    """Never below the distance, and near it for near lines."""
    draw = random.Random(21)
    for k in range(150):
        a = words(k, draw.randint(1, 120))
        b = list(a)
        for _ in range(draw.randint(0, 12)):
            at = draw.randrange(len(b) + 1)
            b[at : at + draw.randint(0, 2)] = words(draw.randint(0, 10**6), draw.randint(0, 2))
        a, b = " ".join(a), " ".join(b)
        bound, want = anchored_distance(a, b), edit_distance(a, b)
        assert bound is None or want <= bound <= 2 * want + 4
    long = words(5, 3000)
    other = [*long[:700], "new", *long[702:2000], *long[2010:]]
    bound = anchored_distance(" ".join(long), " ".join(other))
    assert edit_distance(" ".join(long), " ".join(other)) <= bound < 120


def test_line_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "a b c d\nx y", 5, "p", 1.0, "q")], "doc_id long, text string, _row int, _lines string, n_lines double, _gone string")
    got = dedup_lines(frame.union(frame)).collect()
    assert sorted((r.text, r._row, r._lines, r._gone, r.n_lines, r.n_removed) for r in got) == [("", 5, "p", "q", 2, 2), ("a b c d\nx y", 5, "p", "q", 2, 0)]


def test_line_case():
    """Lower case of any script, in whatever company and slice."""
    lines = ["ABC ÀÉÞ×÷ß 129", "\u0391\u0392\u03a3 \u039f\u0394\u039f\u03a3 7", None, "", "\u041f\u0420\u0418\u0412\u0415\u0422 \u041c\u0418\u0420", "\u0141\u00d3D\u0179 \u010cESK\u00c1", "\u0130STANBUL \u0178", "\u201cQUOTED\u201d 55", "plain"]
    want = ["".join(x.lower()[0] for x in (x or "")) for x in lines]
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(lines, kind)
        assert normalized(column).to_pylist() == want
        assert all(normalized(column.slice(a, 3)).to_pylist() == want[a : a + 3] for a in range(len(lines)))


def test_line_bands():
    draw, n = np.random.default_rng(4), 3000
    sets = mix(draw.integers(0, 1 << 63, (n, 12), np.int64).astype(np.uint64))
    sides = [line_bands(np.ascontiguousarray(x).ravel(), np.full(10 * n, 7), np.full(n, 10), 16, 4) for x in (sets[:, :10], sets[:, 2:])]  # Jaccard 2/3
    (one, a), (two, b) = sides
    assert (one == two).any(axis=1).mean() > 0.95 and abs((one == two).mean() - (2 / 3) ** 4) < 0.01 and abs((a == b).mean() - 2 / 3) < 0.01


def test_simhash():
    lines = [" ".join(words(k, n)) for k, n in enumerate((1, 3, 600, 2, 300000, 255, 256, 7, 31, 32))] + ["a a a of of other words", "| " * 300 + "table of things"]
    found = read_words(pa.array(lines))
    got = simhash(found.hashes, found.ends - found.starts, np.diff(found.bounds))
    for k, line in enumerate(lines):
        counts, whole = np.zeros(128, np.int64), 0
        for word, h in {w: h for w, h in zip(line.split(), found.hashes[found.bounds[k] :].tolist())}.items():
            power = min(len(word), 4) - 1
            h, weight = (h >> 22) & ((1 << 42) - 4) | power, 1 << power
            bits = np.concatenate([np.unpackbits(mix(np.array([h * (2 * j + 1) + j & (1 << 64) - 1], np.uint64)).view(np.uint8)) for j in (1, 2)])
            counts += weight * bits.astype(np.int64)
            whole += weight
        assert (np.packbits(counts * 2 > whole).view(np.uint64) == got[k]).all()
    assert bin(int(got[-1][0] ^ got[-2][0])).count("1") > 16


def test_line_keys_take_less_time_than_bits_one_by_one():
    draw = np.random.default_rng(11)
    sizes = draw.integers(20, 90, 4000)
    vocabulary = mix(np.arange(1, 30001, dtype=np.uint64))
    hashes, lengths = draw.choice(vocabulary, int(sizes.sum())), draw.integers(1, 9, int(sizes.sum()))

    def bits():  # the sums that a SimHash needs, a byte for each bit of a word
        table = np.unpackbits(np.stack([mix(hashes * np.uint64(k)) for k in (3, 5)], axis=1).view(np.uint8), axis=1)
        table *= np.uint8(1) << np.minimum(lengths, 4).astype(np.uint8)[:, None] - np.uint8(1)
        return np.add.reduceat(table.view(np.uint64), np.cumsum(sizes) - sizes, axis=0)

    def least(run):
        took = []
        for _ in range(5):
            began = time.process_time()
            run()
            took.append(time.process_time() - began)
        return min(took)

    with np.errstate(over="ignore"):
        assert least(lambda: simhash(hashes, lengths, sizes)) < least(bits)
    laid = [line_dedup.side_by_side(hashes, lengths, sizes, most) for most in (1, 500, 1 << 16)]
    assert all(sorted(np.concatenate([x.lines for x in some]).tolist()) == list(range(4000)) for some in laid)
    want = simhash(hashes, lengths, sizes), *line_bands(hashes, lengths, sizes, 16, 4)
    for some in laid:
        got = simhash(hashes, lengths, sizes, some), *line_bands(hashes, lengths, sizes, 16, 4, some)
        assert all((x == y).all() for x, y in zip(got, want, strict=True))


def test_words():
    texts = [r[1] for r in corpus()] + ["a b", "b\ta ", "\u00a0x\u2003y", "y" * 5000 + " é"]
    found = read_words(pa.array(texts))
    hashes = {}
    for k, t in enumerate(texts):
        mine = found.hashes[found.bounds[k] : found.bounds[k + 1]].tolist()
        assert len(mine) == len(split(t))
        assert all(hashes.setdefault(w, h) == h for w, h in zip(split(t), mine))
    assert len(set(hashes.values())) == len(hashes)
    odd = np.arange(len(found.starts)) % 3 > 0
    want = [" ".join(w for w, k in zip(split(t), odd[a:]) if k) for t, a in zip(texts, found.bounds)]
    assert join_words(found, odd).to_pylist() == want
    assert read_words(pa.array([], pa.string())).bounds.tolist() == [0]


@pytest.mark.parametrize("size", [4 << 20, 400])
def test_substrings(docs, none, size):
    rows = drop_repeated_passages(docs, width=13, group_bytes=size).collect()
    source = docs.collect()
    assert len(rows) == len(source)
    first = {}
    for r in source:
        w = split(r.text)
        for i in range(len(w) - 12) if r.doc_id is not None else ():
            key = tuple(w[i : i + 13])
            first[key] = min(first.get(key, r.doc_id), r.doc_id)
    want = Counter()
    for r in source:
        w = split(r.text)
        gone = set()
        for i in range(len(w) - 12) if r.doc_id is not None else ():
            if first[tuple(w[i : i + 13])] < r.doc_id:
                gone |= set(range(i, i + 13))
        want[(r.doc_id, " ".join(x for i, x in enumerate(w) if i not in gone), len(w), len(gone))] += 1
    assert Counter((r.doc_id, " ".join(split(r.text)), r.n_words, r.n_removed) for r in rows) == want
    assert sum(r.n_removed for r in rows) > 150
    assert drop_repeated_passages(none).count() == 0


def test_quality(docs, none):
    docs = docs.unionAll(docs.where("doc_id = 14")).unionAll(docs.where("doc_id = 14"))  # one document, however often
    rows = quality_table(docs, max_docs=2).collect()
    source = docs.collect()
    holders = defaultdict(set)
    for k, r in enumerate(source):
        for line in (r.text or "").split("\n"):
            if split(line):
                holders[(r.source, " ".join(line.lower().split()))].add((r.doc_id, k if r.doc_id is None else None))
    held = {x: len(ids) for x, ids in holders.items()}
    assert max(Counter((r.source, x) for r in source for x in (r.text or "").split("\n") if split(x)).values()) > 2
    want = Counter()
    for r in source:
        text, w = r.text or "", split(r.text)
        lines = [x for x in text.split("\n") if split(x)]
        runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        repeat = {j for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        gone = [x for x in lines if held[(r.source, " ".join(x.lower().split()))] > 2]
        gone_words = sum(len(split(x)) for x in gone)
        failed = len(w) < 20 or 100 * len(repeat) > 30 * len(w)
        want[(r.doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat), failed, not failed and len(w) - gone_words >= 0.5 * len(w), len(gone), gone_words)] += 1
    assert Counter(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "n_removed_words")) for r in rows) == want
    assert quality_table(none).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([r[:5] for r in corpus()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.count())
        assert name == "packing" or docs.columns == names
    ids = {r.doc_id for r in spark.read.parquet(str(tmp_path / "minhash")).collect()}
    assert {0, 6, 8} <= ids and not ids & {1, 2, 3, 4, 5, 7, 9}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[-1] > 0


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and ORACLE_SQL.keys() <= QUERIES.keys()
