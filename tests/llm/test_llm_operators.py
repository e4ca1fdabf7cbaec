"""Each operator on small tables against plain Python, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import sys
import time
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("kelvane.llm")
sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from kelvane.llm import chat, components, conv_quality, line_runs, mixing, near_dups, neighbours, packing, rules, substrings, suffix_tree  # noqa: E402
from kelvane.llm import _text  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = {"n_words": "x", "size": "y", "key": "z", "tid": "t", "bands": "b", "th": "h", "pos": "p", "part": "q", "chunk": "c", "score": "s", "__kept": "k", "sequence_id": "w", "root": "r", "row": "o", "runs": "u", "lines": "l", "kept": "k", "copies": "m", "copy": "n", "id": "i", "__id": "1", "__th": "2", "__runs": "3", "__copies": "4", "__copy": "5", "__q_n_words": "6", "quality": "7"}
VOCAB = [a + b for a in ("ta", "ne", "ri", "so", "lu", "ka", "mo", "vi") for b in ("na", "ro", "ti", "se", "lu", "do", "pa", "ke", "mi", "vo")]


def prose(rng, n, lines=9):
    w = [rng.choice(VOCAB) + rng.choice(VOCAB) for _ in range(n)]
    return "\n".join(" ".join(w[i : i + lines]) for i in range(0, n, lines))


def clash_unchanged(df):
    return df.select(*CLASH).distinct().collect() == [tuple(CLASH.values())]


def edited(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = "edit" + str(rng.random())[2:8]
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    """Texts with exact and near copies, shared passages, repeats, odd and long ones, by ids 1, 2, ..."""
    rng = random.Random(5)
    texts = [prose(rng, rng.choice([3, 12, 40, 120, 300])) for _ in range(60)]
    texts += [texts[7], texts[7], texts[9] + " tail", edited(rng, texts[3] + "\n" + texts[4], 1)]
    base = prose(rng, 200)
    texts += [base] + [edited(rng, base, rng.choice([1, 2, 3, 6, 9])) for _ in range(14)]
    passage = prose(rng, 60, 60)
    texts += [prose(rng, 50) + "\n" + passage + "\n" + prose(rng, 30) for _ in range(6)]
    texts += ["", None, " \n\t ", "one", "ab" * 300, "x" * 150, "é" * 120 + " ñ", prose(rng, 20_000), "same line here\n" * 40, "#$% <> | & *\n" * 3, "one"]
    return [(i + 1, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    rows = [(i, t, "en", [None, "a", "b", "Ž", "c"][i % 5] if i % 3 else "a", None) for i, t in corpus]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_lines_and_hashes():
    texts = ["", "a b", " a", "b\x0bc\xa0d", "\n\n", "é è"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    w = _text.Words(data, offsets)
    got = [[data[a:b].tobytes().decode() for a, b, d in zip(w.starts, w.ends, w.doc, strict=True) if d == i] for i in range(len(texts))]
    assert got == [brute.words(t) for t in texts]
    h = w.hashes()
    assert h[0] == h[2] and len(set(h.tolist())) == 5
    assert _text.span_hashes(data, w.starts, w.ends, limit=2).tolist() == h.tolist()
    lines = _text.Lines(data, offsets)
    assert lines.counts.tolist() == [t.count("\n") + 1 for t in texts]
    assert _text.repeated(np.array([3, 1, 3, 2], np.uint64)).tolist() == [True, False, True, False]


# 1


@pytest.mark.parametrize("seed", range(6))
def test_apportionment(seed):
    rng = random.Random(seed)
    votes = [rng.choice([0, 1, 5, 5, 17, 100]) for _ in range(rng.randint(1, 9))]
    caps = [rng.randint(0, 40) for _ in votes]
    for seats in (0, 1, 7, 60, 1000):
        assert mixing.sainte_lague(np.array(votes), seats, np.array(caps)).tolist() == brute.sainte_lague(votes, seats, caps)
    sizes = [rng.choice([0, 3, 50, 1000]) for _ in range(5)]
    assert mixing.targets(sizes, [1, 2, 3, 1, 2]) == pytest.approx(brute.targets(sizes, [1, 2, 3, 1, 2]))


def test_mixing(spark, docs, corpus, none):
    got = mixing.mix_sources(docs).collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in mixing.mix_sources(docs.repartition(2)).collect())
    size = {i: len(brute.words(t)) for i, t in corpus}
    assert {r.doc_id: r["size"] for r in got} == size
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert 0 <= r.taken <= 3 * r["size"]
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    sums = [sum(r["size"] for r in by[s]) for s in order]
    want = brute.targets(sums, [1, 2, 3, 1, 2])
    for s, total, goal in zip(order, sums, want, strict=True):
        assert {(r.source_size, round(r.target, 6)) for r in by[s]} == {(total, round(goal, 6))}
        assert abs(sum(r.taken for r in by[s]) - goal) <= 0.02 * goal + 2
    assert mixing.mix_sources(none).count() == 0
    copies = mixing.mix_documents(docs)
    assert copies.columns == docs.columns and clash_unchanged(copies) and max(r["count"] for r in copies.groupBy("doc_id").count().collect()) <= 3
    twice = mixing.mix_sources(docs.unionByName(docs).withColumn("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("doc_id"))))
    assert twice.count() == 2 * len(corpus)


# 2


def quality_table(spark, n=160):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        good = i % 4 != 0
        text = prose(rng, 60)
        rows.append((i, text if good else " ".join(w + rng.choice("#*$%&") * 3 for w in text.split(" ")), int(good)))
    docs = spark.createDataFrame([(i, t, "en", "a", None) for i, t, _ in rows], SCHEMA)
    return docs, spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")


def test_conv_quality(spark, docs, none):
    known, labels = quality_table(spark)
    net = conv_quality.fit(known, labels)
    got = {r.doc_id: r.score for r in conv_quality.score(known, net).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    back = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(back) > 20 and np.mean([(got[i] >= 0.7) == truth[i] for i in back]) > 0.9
    flipped = labels.withColumn("quality", F.when(conv_quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = conv_quality.fit(known, flipped)
    assert all(np.array_equal(getattr(net, k), getattr(again, k)) for k in ("filters", "dense", "out"))  # held-out labels are not read
    scores = conv_quality.score(docs, net).collect()
    assert len(scores) == docs.count() and all(0 <= r.score <= 1 for r in scores)
    assert conv_quality.score(none, net).count() == 0
    untrained = conv_quality.fit(none, labels.limit(0))
    assert conv_quality.score(docs.limit(3), untrained).count() == 3


def test_conv_blocks_cover_the_whole_text():
    data = np.arange(3000, dtype=np.int64).astype(np.uint8)
    padded, first = conv_quality.blocks_of(data, np.array([0, 0, 700, 3000]))
    assert np.diff(first).tolist() == [1, 2, 5] and padded[516:1216].tolist() == data[:700].tolist()
    net = conv_quality.Network.fresh()
    late = np.concatenate([np.full(20_000, 97, np.uint8), np.frombuffer(b"#*$%&|<>" * 4, np.uint8)])
    peaks = [net.block_peaks(conv_quality.blocks_of(d, np.array([0, len(d)]))[0]).max(axis=0) for d in (late, late[:20_000])]
    assert (peaks[0] > peaks[1]).any()


def test_conv_scores_do_not_depend_on_company(spark):
    import pyarrow as pa

    known, labels = quality_table(spark)
    net = conv_quality.fit(known, labels)
    rng = random.Random(8)
    texts = ["", "a", "#" * 507, "x" * 508, "é" * 254, "y" * 512, "z" * 513, "&" * 1020, prose(rng, 900)] + [r.text for r in known.limit(20).collect()]

    def scores(some):
        return net.score(*_text.bytes_of(pa.array(some)))

    alone = {t: scores([t])[0] for t in texts}
    for _ in range(20):
        some = [rng.choice(texts) for _ in range(rng.randrange(1, 40))]
        assert scores(some).tolist() == [alone[t] for t in some]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 3)], "doc_id long, text string")
    got = [{r.doc_id: r.score for r in conv_quality.score(d, net).collect()} for d in (df.repartition(1), df.repartition(7))]
    assert got[0] == got[1] == {i: alone[t] for i, t in enumerate(texts * 3)}


def test_conv_training_sample(spark, monkeypatch):
    known, labels = quality_table(spark)
    monkeypatch.setattr(conv_quality, "MAX_TEXT", 2000)
    huge = known.withColumn("text", F.when(F.col("doc_id") < 3, F.repeat(F.lit("#"), 5000)).otherwise(F.col("text")))
    a, b = conv_quality.fit(huge, labels), conv_quality.fit(known.filter("doc_id >= 3"), labels)
    assert np.array_equal(a.filters, b.filters)  # texts above the bound are left out, no other
    monkeypatch.setattr(conv_quality, "MAX_TRAIN_BYTES", 20_000)
    assert not np.array_equal(conv_quality.fit(known, labels).filters, b.filters)


# 3


def test_chat_long_runs():
    start = time.time()
    for text in ("\\" * 1_000_000, "\\" * 500_000 + "</s>", "[ROLE:" * 50_000, "]" * 300_000, "<" * 300_000):
        assert [t[:2] for t in chat.parse(chat.render_turn("user", text))] == [("user", text)]
    assert time.time() - start < 20


@pytest.mark.parametrize("text", ["", "[INST] a", "\\</s>", "\\\\<s>\\", "<</SYS>> [ROLE:x] [/ROLE]", "[INST", "[ROLE", "a\\", "<", "[/INST]</s><s>"])
@pytest.mark.parametrize("role", ["user", "assistant", "system", "to]ol\\", ""])
def test_chat_round_trip(text, role):
    turns = [(role, text), ("assistant", text + "\n"), (role, "x")]
    assert [t[:2] for t in chat.parse(chat.render(turns))] == turns
    assert chat.unescape(chat.escape(text)) == text


def test_chat_fuzz():
    rng = random.Random(1)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE:", "[/ROLE]", "\\", "]", " ", "a", "<", "/", "\n"]
    for _ in range(400):
        turns = [(rng.choice(["user", "assistant", "system", "f" + rng.choice(parts)]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))) for _ in range(rng.randint(1, 5))]
        assert [t[:2] for t in chat.parse(chat.render(turns))] == turns


def test_chat_query(spark, tmp_path):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", chat.HARD), (1, 1, "assistant", chat.HARD), (2, None, None, None), (2, 0, "tool", "é\\<s>"), (None, 3, "assistant", ""), (3, 0, "assistant", "x" * 200_000)]
    spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, turns string").write.parquet(str(tmp_path / "conversations.parquet"))
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = sorted((tuple(r) for r in chat.query(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(duckdb.sql(chat.ORACLE).fetchall(), key=repr)
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "e/conversations.parquet"))
    assert [r.conv_id for r in chat.query(spark, str(tmp_path / "e")).collect()] == [-7]


# 4


def test_rule_statistics(docs, corpus, none):
    got = {r.doc_id: r for r in rules.with_stats(docs.select("doc_id", "text")).collect()}
    for i, t in corpus:
        want = brute.stats(t)
        assert {k: got[i][k] for k in want} == want, i
    assert rules.with_stats(none.select("doc_id", "text")).count() == 0


def test_rules_learn_and_apply(spark, docs, none):
    known, labels = quality_table(spark)
    verdicts = {r.doc_id: r.kept for r in rules.judge(known, labels).collect()}
    truth = {r.doc_id: bool(r.quality) for r in labels.collect()}
    assert np.mean([verdicts[i] == truth[i] for i in truth]) > 0.95 and all(verdicts[i] for i in truth if truth[i])
    kept = rules.keep_good(known, labels)
    assert kept.columns == known.columns and {r.doc_id for r in kept.collect()} == {i for i, v in verdicts.items() if v}
    bare = rules.judge(docs, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in bare)
    assert rules.judge(none, labels).count() == 0
    good = rules.keep_good(docs, labels)
    assert good.columns == docs.columns and clash_unchanged(good)
    odd = docs.select(F.lit(None).cast("long").alias("doc_id"), "text")
    assert rules.judge(odd.unionByName(odd), labels).count() == 2 * docs.count()


def test_rules_stop_at_noise():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(400), "b": rng.random(400)}
    assert rules.learn_list(x, rng.random(400) < 0.3) == []
    found = rules.learn_list(x, (x["a"] > 0.8) & (x["b"] < 0.5))
    assert found and all(len(r) <= 4 for r in found)


# 5


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x[100:140] = x[100]
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(900, None), (920, [0.0] * 16), (940, [float("nan")] + [1.0] * 15), (960, [1.0]), (None, [1.0] * 16), (0, x[0].tolist())]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, ids string").repartition(4)
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df, part=100).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 700, 20))
    d, hit = x.astype(np.float64), 0
    for q, found in got.items():
        s = (d[q] * d).sum(axis=1)
        best = sorted((-v, i) for i, v in enumerate(s) if i != q)[:20]
        hit += len({i for _, i in best} & {i for i, _ in found})
        assert len(found) == 20 and found == sorted(found, key=lambda f: (-f[1], f[0])) and all(abs(v - s[i]) < 1e-9 for i, v in found)
    assert hit >= 0.9 * 20 * len(got)
    assert [i for i, _ in got[120]][:19] == [i for i in range(100, 120)][:19]
    assert neighbours.nearest(df.limit(0)).count() == 0 and neighbours.nearest(df.filter("vec_id = 20")).count() == 0


def test_neighbours_settle_ties(spark):
    rows = [(i, [float(i == j) for j in range(600)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    for block, turn in ((neighbours.BLOCK, neighbours.TURN), (130, 7)):
        got = collections.defaultdict(list)
        for r in neighbours.nearest(df, block=block, turn=turn).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
        assert got == {q: [(i, 0.0) for i in range(21) if i != q][:20] for q in range(0, 600, 20)}


def test_neighbours_blocks_do_not_change_the_result(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 12)).round(1)
    x[:300] = x[0] + rng.normal(size=(300, 12)).round(1) / 10  # a third of the rows in one part
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    one = sorted(neighbours.nearest(df, part=60).collect())
    assert one == sorted(neighbours.nearest(df, part=60, block=40, turn=9).collect())
    assert collections.Counter(r.query_id for r in one) == {q: 20 for q in range(0, 900, 20)}
    few = sorted(neighbours.nearest(df, part=12, recall=0.01).collect())  # parts with fewer vectors than results
    assert collections.Counter(r.query_id for r in few) == {q: 20 for q in range(0, 900, 20)}


def test_balanced_parts():
    x = np.random.default_rng(3).normal(size=(400, 8)).astype(np.float32)
    of = neighbours.balanced_parts(neighbours.neighbour_graph(x, 10), 7)
    assert np.bincount(of, minlength=7).max() <= np.ceil(1.1 * 400 / 7) and len(np.unique(of)) == 7


# 6


def test_tokenizer_is_exact():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    known = packing.tokenizer(packing.default_tokenizer())
    rng = random.Random(4)
    texts = ["", "don't we've I'LL 'sa 're'", "a\x1cb\xa0c", "ﬁ Σας İx ǅ ß", "<|endoftext|> x", "日本 ² ½ ×", "é e\u0301"] + ["".join(rng.choice("ab'stremvld 12.!é×\n\tß_Ž-²😀<|") for _ in range(30)) for _ in range(600)]
    want = [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert known.encode(texts) == want
    known.forget()
    assert known.encode(texts[::-1]) == want[::-1]


def test_tokenizer_remembers_what_a_call_needs(monkeypatch):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    monkeypatch.setattr(packing, "_CACHED", 50)
    known, rng = packing.WordTokenizer(packing.default_tokenizer()), random.Random(6)
    for n in (85, 3, 40, 700, 20):
        texts = [" ".join("".join(rng.choice("abcdefgh0123") for _ in range(9)) for _ in range(n)) for _ in range(3)]
        assert known.encode(texts) == [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def check_packing(rows, capacity=4096):
    fill = collections.defaultdict(list)
    for r in rows:
        fill[r.sequence_id].append((r.offset, r.length))
    for spans in fill.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= capacity
    return len(fill)


def test_packing(spark, docs, corpus, none):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.pack_documents(docs).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for i, t in corpus:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        want = [(k // 4096, k, min(4096, len(ids) - k), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())) for k in range(0, len(ids), 4096)]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by[i]) == want
    total = sum(r.length for r in got)
    assert check_packing(got) <= -(-total // 4096) + 2
    doubled = packing.pack_documents(docs.unionByName(docs)).collect()
    assert len(doubled) == 2 * len(got)
    check_packing(doubled)
    assert packing.pack_documents(none).count() == 0
    lost = packing.pack_documents(docs.withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert sorted(r.ids_crc32 for r in lost) == sorted(r.ids_crc32 for r in got)
    check_packing(lost)


def test_packing_deals_repeated_rows(docs, monkeypatch):
    same = docs.filter("text = 'one'").limit(1).select("doc_id", "text").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(4000))))
    placed = packing.pack_pieces(packing.cut(packing.cut_documents(same)), group=400)
    rows = placed.collect()
    check_packing(rows)
    assert max(collections.Counter(r.sequence_id >> 40 for r in rows).values()) < 600


@pytest.mark.parametrize("lengths", [[4096] * 3, [1], [2048] * 7, list(range(1, 400)), [100] * 500])
def test_pack_lengths(lengths):
    lengths = np.array(lengths)
    sequence, offset = packing.pack(lengths)
    rows = [collections.namedtuple("R", "sequence_id offset length")(s, o, n) for s, o, n in zip(sequence.tolist(), offset.tolist(), lengths.tolist(), strict=True)]
    assert check_packing(rows) <= -(-int(lengths.sum()) // 4096) + 2


def test_nnls():
    rng = np.random.default_rng(0)
    a = rng.random((12, 30))
    want = np.maximum(rng.normal(size=30), 0)
    x = packing.nnls(a, a @ want)
    assert (x >= 0).all() and np.linalg.norm(a @ x - a @ want) < 1e-6
    assert packing.patterns(8).sum() > 0 and (packing.patterns(8).T @ np.arange(1, 9) == 8).all()


# 7


def test_suffix_tree(docs, corpus, none):
    got = {r.doc_id: r for r in suffix_tree.score_documents(docs).collect()}
    want = brute.base_scores(corpus)
    for i, (n, known, train, base) in want.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, train) and r.base_score == pytest.approx(base, rel=1e-9)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0) and r.score <= 0
    assert suffix_tree.score_documents(none).count() == 0
    odd = suffix_tree.score_documents(docs.withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert len(odd) == len(corpus) and not any(r.held_out for r in odd)


def word_hash(word):
    data = np.frombuffer(word.encode(), np.uint8)
    return int(_text.Words(data, np.array([0, len(data)])).hashes()[0])


def test_tree_sums_to_one(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice(["a", "b", "c"]) if rng.random() < 0.9 else "w" + str(rng.random()) for _ in range(60))) for i in range(80)]
    chunked, parts = suffix_tree._chunked(spark.createDataFrame(texts, "doc_id long, text string"))
    train = [t.split() + [None] for i, t in texts if zlib.crc32(str(i).encode()) % 10]
    count = collections.Counter(w for t in train for w in t)
    n = sum(count.values())
    often = sorted((word_hash(w), c) for w, c in count.items() if w in ("a", "b", "c"))
    tree = suffix_tree.grow(chunked, np.array([o[0] for o in often], np.uint64), np.array([o[1] for o in often]), count[None], n, len(count), parts, 2.0)
    assert tree.root.sum() == pytest.approx(1) and len(tree.levels) == 3
    for k, level in enumerate(tree.levels):
        for at in range(len(level.keys)):
            every = np.arange(tree.size)
            p = tree.probability(tree.chain(k, np.full(tree.size, at)), every)
            assert p.sum() == pytest.approx(1, abs=1e-6) and (p > 0).all()
    pairs = collections.Counter((a, b) for t in train for a, b in zip([None, *t[:-1]], t, strict=True))
    sym = {w: i + 1 for i, w in enumerate(sorted(("a", "b", "c"), key=word_hash))} | {None: tree.size - 1}
    first = tree.levels[0]
    for key, share in zip(first.entry_keys.tolist(), first.entry_shares.tolist(), strict=True):
        a, b = divmod(key, tree.size)
        c, total = (sum(m for (x, y), m in pairs.items() if sym.get(x, 0) == a and (w is None or sym.get(y, 0) == w)) for w in (b, None))
        assert share == pytest.approx((c - suffix_tree.DISCOUNT) / total)


@pytest.mark.parametrize(("least", "most"), [(3, 1 << 20), (8, 1 << 20), (2, 12)])
def test_suffix_tree_scores(spark, monkeypatch, least, most):
    """Every score against a plain suffix tree; with few entries allowed, the least counts double."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words[(3 * i + k // 2 + (rng.random() < 0.3) * rng.randrange(40)) % 40] for k in range(rng.randrange(0, 70))) for i in range(90)] + ["", None, "W1 w2", "W1 w2"]
    rows = list(enumerate(texts))
    monkeypatch.setattr(suffix_tree, "LEAST", least)
    for name in ("MAX_SYMBOLS", "MAX_ENTRIES"):
        monkeypatch.setattr(suffix_tree, name, most)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in suffix_tree.score_documents(df).collect()}
    want = brute.tree_scores(rows, least, most, suffix_tree.SHARE, suffix_tree.DEPTH, suffix_tree.DIVERGENCE, suffix_tree.DISCOUNT)
    assert {i: round(r.score, 6) for i, r in got.items()} == {i: round(v, 6) for i, v in want.items()}
    if most > 100:
        assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)
    twice = [r.score for r in suffix_tree.score_documents(df.unionByName(df)).collect()]
    assert len(twice) == 2 * len(rows)


# 8


def test_substrings(spark, docs, corpus, none):
    got = {r.doc_id: tuple(r)[1:] for r in substrings.digest(substrings.without_repeats(docs)).collect()}
    assert got == {i: w for (i, _), w in zip(corpus, brute.substrings([t for _, t in corpus]), strict=True)}
    assert substrings.without_repeats(none).count() == 0


def test_substrings_odd_ids(spark):
    rows = [(5, "p" * 130 + "q" * 30), (5, "p" * 130 + "q" * 30), (2, "r" + "p" * 119), (None, "q" * 10 + "p" * 140), (5, "short"), (5, "short"), (None, "y" * 50 + "q" * 10 + "p" * 140), (None, None)]
    got = sorted((tuple(r) for r in substrings.digest(substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))).collect()), key=repr)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()))
    want = [(r[0], *w) for r, w in zip(order, brute.substrings([r[1] for r in order]), strict=True)]
    assert got == sorted(want, key=repr)


def surroundings(rng, n=300):
    """One phrase, longer or shorter than a window, in many surroundings, some of them equal in part."""
    phrase, near = prose(rng, 14, 99), [prose(rng, 9, 99) for _ in range(12)]
    return [rng.choice(near)[rng.randrange(60) :] + " " + phrase[: rng.choice([60, 90, 101, 130, 999])] + " " + rng.choice([*near, prose(rng, 6)]) for _ in range(n)]


@pytest.mark.parametrize(("batch", "local", "chunk"), [(1 << 17, 256, 8192), (400, 4, 8192), (400, 1000, 8), (150, 2, 5), (37, 9, 11)])
def test_substrings_split_grams(spark, monkeypatch, batch, local, chunk):
    texts = surroundings(random.Random(batch + local))
    defaults = list(substrings.covered_spans.__defaults__)
    monkeypatch.setattr(substrings.covered_spans, "__defaults__", (defaults[0], batch, local, chunk))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in substrings.digest(substrings.without_repeats(df)).collect()}
    assert got == dict(enumerate(brute.substrings(texts)))


def test_windows_are_told_apart_by_their_bytes(monkeypatch):
    shape, texts = substrings.Shape(), surroundings(random.Random(1), 60)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    doc, start, count, anchor, _ = substrings.runs_of(data, offsets, shape)
    runs = substrings.Suffixes(substrings.keys_of(data, start, count, anchor, shape), doc, (start - offsets[doc]).astype("<u4"))
    want = substrings.merged(*substrings.compare_windows(runs, shape)[0])
    real = substrings.fingerprints
    monkeypatch.setattr(substrings, "fingerprints", lambda *a: real(*a) & np.uint64(7))  # nearly all collide
    got = substrings.merged(*substrings.compare_windows(runs, shape)[0])
    assert len(want[0]) and all(np.array_equal(a, b) for a, b in zip(want, got, strict=True))


def test_split_grams_do_not_fill_a_task(spark, monkeypatch):
    """A phrase in very many surroundings: no part gets much more than the others."""
    rng, written, real = random.Random(2), [], substrings.cut
    phrase = prose(rng, 30, 99)
    texts = [prose(rng, 12, 99) + " " + phrase + " " + prose(rng, 12, 99) for _ in range(6000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    met = collections.Counter()
    monkeypatch.setattr(substrings, "cut", lambda table: written.append(real(table)) or written[-1])
    found = substrings.covered_spans(df)[0].collect()
    for r in written[-1].filter(f"kind = {substrings.WINDOWS}").select("part", F.octet_length("docs").alias("n")).collect():
        met[r.part] += r.n // 8  # windows that a task settles
    assert found and sum(met.values()) > 100_000 and max(met.values()) < 2 * np.median(list(met.values()))
    monkeypatch.undo()
    rows = substrings.digest(substrings.without_repeats(df)).collect()
    assert sorted(r.n_removed >= len(phrase.encode()) for r in rows) == [False] + [True] * 5999


@pytest.mark.parametrize("seed", range(4))
def test_substrings_periodic(spark, seed):
    rng = random.Random(seed)
    block = lambda: "".join(rng.choice("ab") for _ in range(rng.choice([1, 3, 40, 70, 101]))) * rng.randint(1, 9)
    shared = [block() for _ in range(5)]
    rows = [(i, "".join(rng.choice(shared) for _ in range(4))) for i in range(25)]
    got = {r.doc_id: tuple(r)[1:] for r in substrings.digest(substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))).collect()}
    assert got == dict(enumerate(brute.substrings([t for _, t in rows])))


def test_family_levels_are_geometric():
    family, rng, shape = substrings.Family(), np.random.default_rng(0), substrings.Shape()
    every = rng.integers(0, 256, (4000, shape.size)).astype(np.uint8)
    every[:, -2:] = (0, 9)
    met = np.zeros(4000, bool)
    for b in range(40):
        c = rng.integers(0, 4000, 100)
        met[c] = True
        array, spans = substrings.Suffixes.of_batch(substrings.Suffixes(every[c], np.full(100, b), np.arange(100, dtype=np.uint32)), shape.length)
        family.covered.append(spans)
        family.add(array)
    sizes = [len(x.docs) for x in family.levels]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
    assert all((np.diff(np.unique(x.text, return_inverse=True)[1]) > 0).all() for x in family.levels)  # ordered by bytes
    held = np.concatenate([x.text for x in family.levels])
    assert len(np.unique(held)) == len(held) == met.sum() and len(held) + sum(len(d) for d, _, _ in family.covered) == 4000


def test_entries_are_sent_compressed():
    """Entries of prose take less than two thirds of their bytes, and come back as they were."""
    shape, rng = substrings.Shape(), random.Random(81)
    data = np.frombuffer(" ".join(prose(rng, 200) for _ in range(60)).encode(), np.uint8)
    doc, start, count, anchor, grams = substrings.runs_of(data, np.array([0, len(data)]), shape)
    array = substrings.Suffixes(substrings.keys_of(data, start, count, anchor, shape), doc + (1 << 40), start.astype("<u4"))
    rows = substrings._entry_rows(array, grams, 3, shape).to_pylist()
    sent = sum(len(r[k]) for r in rows for k in ("docs", "starts", "more", "data"))
    assert sent < (14 * len(start) + (shape.length + count - 1).sum()) * 2 / 3
    back = substrings.Suffixes.joined([substrings._entries(r["docs"], r["starts"], r["more"], r["data"], shape) for r in rows])
    order, was = np.argsort(back.starts), np.argsort(array.starts)
    assert (back.keys[order] == array.keys[was]).all() and (back.docs == 1 << 40).all() and (back.starts[order] == array.starts[was]).all()


# 9


def test_near_duplicates(spark, docs, corpus, none):
    got = {r.doc_id: r.class_id for r in near_dups.near_duplicates(docs).collect()}
    want = brute.near_classes([t for _, t in corpus])
    bags = brute.weighted([t for _, t in corpus])
    assert min(abs(brute.jaccard(a, b) - 0.8) for k, a in enumerate(bags) for b in bags[:k] if a and b) > 1e-4
    assert got == {i: corpus[c][0] for (i, _), c in zip(corpus, want, strict=True)}
    assert near_dups.near_duplicates(none).count() == 0
    kept = near_dups.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))
    doubled = near_dups.drop_near_duplicates(docs.unionByName(docs))
    assert sorted(r.doc_id for r in doubled.collect()) == sorted(set(got.values()))
    lost = docs.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")))
    assert near_dups.drop_near_duplicates(lost).filter("doc_id is null").count() == lost.filter("doc_id is null").count()


def test_families_are_compared_whole(spark):
    """Copies of copies: links that do not touch a bucket's smallest text are found too, across blocks."""
    rng = random.Random(9)
    base = prose(rng, 100)
    arms = [edited(rng, base, 4) for _ in range(30)]
    texts = [base, *arms, *[edited(rng, a, 1) for a in arms for _ in range(6)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in near_dups.near_duplicates(df).collect()}
    # weights come from hashed counters, so a similarity may differ from the plain one by a little
    sure, possible = brute.near_classes(texts, 0.802), brute.near_classes(texts, 0.798)
    assert len(set(sure)) < len(texts)
    for i, j in itertools.combinations(range(len(texts)), 2):
        assert sure[i] != sure[j] or got[i] == got[j]
        assert got[i] != got[j] or possible[i] == possible[j]


def elements_of(texts):
    raw = [t.encode() for t in texts]
    return near_dups.Elements(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]))


def test_similar_texts_share_a_prefix_element():
    rng = random.Random(12)
    base = prose(rng, 80)
    texts = [edited(rng, base, rng.randrange(5)) for _ in range(40)] + ["", "one", "a b a b a b a b a b a b"]
    e = elements_of(texts)
    idf = (0.5 + np.random.default_rng(1).random(1 << near_dups.COUNTERS) / 2).astype(np.float32)
    doc, keys = near_dups.prefixes(e, idf)
    early = [set(keys[doc == i].tolist()) for i in range(len(texts))]
    half = np.arange(len(texts)) % 2 == 0
    near = near_dups.similarities(e, idf, half)
    seen = 0
    for (x, i), (y, j) in itertools.product(enumerate(np.flatnonzero(~half)), enumerate(np.flatnonzero(half))):
        if near[x, y] >= 0.8:
            seen += 1
            assert early[i] & early[j]
    assert seen > 20
    assert sum(map(len, early[:40])) < len(e.keys) / 3


def test_a_family_without_links_is_not_compared(spark):
    """Texts that share two thirds with each other, and nothing rare, go to no block; one copy of one brings two texts there."""
    rng = random.Random(13)
    base = prose(rng, 60)
    texts = [base + " " + " ".join(f"own{i}x{k}" for k in range(30)) for i in range(600)]
    idf = spark.sparkContext.broadcast(near_dups.inverse_frequencies(*near_dups.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string"))))
    for more in ([], [edited(rng, texts[5], 1)]):
        rows = [(b"all", b"%d" % i, b"%d" % i, t) for i, t in enumerate(texts + more)]
        df = spark.createDataFrame(rows, "leader binary, tid binary, root binary, text string")
        dealt = near_dups.deal(df.select("leader", "tid", "root"), df.select("tid", "text"), idf).collect()
        assert {bytes(r.tid) for r in dealt} == ({b"5", b"600"} if more else set())
        assert len(dealt) == 3 * len(more)


def test_rows_of_a_family_do_not_grow_as_its_square(spark):
    """Texts that share rare elements and are no near duplicates: each is dealt once to a block and once to a slice, and pairs of blocks are rows."""
    base = " ".join(f"rare{k}" for k in range(12))
    idf = spark.sparkContext.broadcast(np.ones(1 << near_dups.COUNTERS, np.float32))
    for n in (300, 600):
        rows = [(b"all", b"%04d" % i, b"%04d" % i, base + " " + " ".join(f"own{i}x{k}" for k in range(8))) for i in range(n)]
        df = spark.createDataFrame(rows, "leader binary, tid binary, root binary, text string")
        dealt = near_dups.deal(df.select("leader", "tid", "root"), df.select("tid", "text"), idf)
        assert dealt.count() == 2 * n - 1
        groups = collections.defaultdict(dict)
        for r in near_dups.block_pairs(dealt).collect():
            assert r.right not in groups[r.i, r.j]
            groups[r.i, r.j][r.right] = {bytes(t.tid) for t in r.texts}
        assert len(groups) <= (n / near_dups.BLOCK + 1) ** 2
        met = {(x, y) for g in groups.values() for x in g.get(False, ()) for y in g.get(True, ())}
        assert len(met) == (n - 1) * n  # all but those of the largest component with all


def test_sampling_estimates_weighted_jaccard():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 2**63, 300, dtype=np.uint64)
    weights = rng.uniform(0.5, 1, 300).astype(np.float32)
    s = near_dups.Sampler(4096)
    a, b = np.arange(0, 220), np.arange(60, 300)
    x, y = (s.sample(keys[i], weights[i], np.array([0, len(i)]))[0] for i in (a, b))
    both = weights[60:220].sum()
    assert (x == y).mean() == pytest.approx(both / weights.sum(), abs=0.03)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(7, 7)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = sorted((top(a), top(b)))
            up[q] = p
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: top(x) for x in up}


# 10


def test_line_runs(spark, docs, corpus, none):
    want = dict(zip([i for i, _ in corpus], brute.line_runs([t for _, t in corpus]), strict=True))
    got = {r.row.doc_id: r.kept for r in line_runs.without_runs(docs).collect()}
    assert got == want
    kept = line_runs.drop_repeated_lines(docs)
    assert kept.columns == docs.columns and clash_unchanged(kept)
    assert {r.doc_id: r.text for r in kept.collect()} == {i: want[i] for i, t in corpus if want[i] == t or brute.words(want[i])}
    assert line_runs.without_runs(none).count() == 0
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_line_runs_odd_rows(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    rows = [(2, passage), (2, passage), (None, "x\n" + passage), (1, passage + "\ny"), (3, None)]
    got = collections.Counter((r.row.doc_id, r.kept) for r in line_runs.without_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {(2, ""): 2, (None, "x\n" + passage): 1, (1, "y"): 1, (3, None): 1}


# all


def test_pipeline(spark):
    if not Path(SF).exists():
        pytest.skip("needs the test tables")
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    good = corpus_pipeline.STAGES[0][1](spark, docs, SF).cache()
    verdicts = {r.doc_id: r.kept for r in rules.judge(docs, labels).collect()}
    assert good.columns == columns and {r.doc_id for r in good.collect()} == {i for i, k in verdicts.items() if k}
    fresh = corpus_pipeline.STAGES[1][1](spark, good, SF).cache()
    rows = sorted((r.doc_id, r.text) for r in good.collect())
    left = {i: t for (i, _), t in zip(rows, brute.line_runs([t for _, t in rows]), strict=True) if brute.words(t)}
    assert fresh.columns == columns and {r.doc_id: r.text for r in fresh.collect()} == left
    once = corpus_pipeline.STAGES[2][1](spark, fresh, SF).cache()
    ids = sorted(left)
    classes = brute.near_classes([left[i] for i in ids])
    assert once.columns == columns and {r.doc_id for r in once.collect()} == {ids[c] for c in classes}
    mixed = corpus_pipeline.STAGES[3][1](spark, once, SF).cache()
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in once.collect()}
    packed = corpus_pipeline.STAGES[4][1](spark, mixed, SF).collect()
    assert collections.Counter(r.doc_id for r in packed if r.piece == 0) == collections.Counter(r.doc_id for r in mixed.collect())
    check_packing(packed)


def test_inputs_by_name(spark):
    """Every query of the subpackage is registered under its operator's number."""
    from kelvane.llm.queries import ORACLES, QUERIES

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
