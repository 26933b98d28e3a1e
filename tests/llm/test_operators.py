"""Each operator against brute force, its SQL, a round trip or held-out accuracy; and the edge cases that its docstring defines."""

import random
import sys
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from quillon.llm import _text as T
from quillon.llm import ngram_join as N
from quillon.llm._tables import crc_mod
from quillon.llm.bt_quality import bt_quality
from quillon.llm.chat_format import chat_format, masked_texts, read_back
from quillon.llm.decontaminate import decontaminate
from quillon.llm.fm_toxicity import fit, fm_toxicity, terms
from quillon.llm.language_id import language_id, viterbi
from quillon.llm.line_dedup import line_dedup
from quillon.llm.mixing import emit, mix_sources
from quillon.llm.oracles import ORACLES
from quillon.llm.quality_rules import quality_rules
from quillon.llm.queries import QUERIES, tokenizer_path
from quillon.llm.token_count import Counter, splits_at_blanks, token_count

SF, SF2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside must not clash with extra columns.
EXTRA = ["score", "fp", "n", "size", "h", "rk", "rk2", "id", "label", "keys", "line", "salt", "source_", "raw", "a.b", "g", "_lid"]


def docs_of(spark, texts, **cols):
    rows = [(i, t, None, "s", None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC)
    df = df.withColumns({c: F.lit("x") for c in EXTRA})
    for c, v in cols.items():
        df = df.withColumn(c, v)
    return df


EDGES = [None, "", " \n\t ", "a", "one two", "same text here now", "same text here now", "é ü 文 字 words " * 3, "w " * 30_000, "x\n" * 500, "... !!! ---"]


def collected(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


# -- words
def test_words():
    texts = ["", " a  b\n", "é\x85x\tY", "A_b-c 12", "\x00a\x1fb", "end"]
    for table, rx in ((T.NON_BLANK, brute.WORD), (T.ALNUM, brute.ALNUM)):
        w = T.Words([t.encode() for t in texts], table, lower=True)
        for i, t in enumerate(texts):
            got = [w.word(j).decode() for j in range(w.first[i], w.first[i + 1])]
            want = rx.findall(t if rx is brute.WORD else t)
            if rx is brute.ALNUM:
                want = [x for x in rx.findall(brute.low(t))]
                got = [brute.low(x) for x in got]
            assert got == want
    w = T.Words([b"Word word", b"word"], T.ALNUM, lower=True)
    assert w.h[0] == w.h[1] == w.h[2]


# -- 1
def test_quality(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    labels = spark.read.parquet(f"{SF2}/labels.parquet")
    out = QUERIES["op1_bt_quality"](spark, SF2).join(labels, "doc_id").toPandas()
    held = out[out.held_out]
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.95
    assert out.score.between(0, 1).all() and ((out.score >= 0.3) == (out.predicted == 1)).all()
    again = QUERIES["op1_bt_quality"](spark, SF2).join(labels, "doc_id").toPandas()
    assert np.allclose(out.sort_values("doc_id").score, again.sort_values("doc_id").score)
    # labels outside the learning rows change nothing
    learn = labels.where(crc_mod("doc_id", 5) != 0).select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    assert bt_quality(docs.limit(0), learn).count() == 0


def test_quality_edges(spark):
    docs = docs_of(spark, EDGES)
    none = spark.createDataFrame([(1, None), (None, 1), (2, 7)], "id long, label int")
    out = bt_quality(docs, none).toPandas()
    assert len(out) == len(EDGES) and (abs(out.score - 0.3) < 1e-9).all()
    some = spark.createDataFrame([(i, i % 2) for i in range(len(EDGES))], "id long, label int")
    assert bt_quality(docs, some).toPandas().score.between(0, 1).all()


# -- 2
def test_chat_sql(spark):
    check_sql(spark, "op2_chat_format", SF2)


def test_chat_round_trip(spark):
    random.seed(3)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "\\\\", "<", "[", "s>", " [/INST]", "\n", "é", "", "<\\s>", "$1", "a"]
    rows = [(i // 5, i % 5, random.choice(["user", "assistant", "system", "tool</s>", "\\x", "a [/INST]"]), "".join(random.choice(bits) for _ in range(random.randint(0, 8)))) for i in range(400)]
    rows += [(900, 0, None, None), (901, None, "assistant", "x"), (901, None, "assistant", "x"), (None, 1, "user", "n"), (902, 0, "assistant", "w" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in ("c", "n", "out", "formatted"):
        df = df.withColumn(c, F.lit(1))
    out = chat_format(df)
    got = out.select("conv_id", "n_turns", read_back(F.col("formatted")).alias("t"), masked_texts(F.col("formatted"), F.col("loss_spans")).alias("m"), "formatted").collect()
    want = {}
    for c, n, r, x in rows:
        want.setdefault(c, []).append((n is not None, n or 0, r or "", x or ""))
    assert len(got) == len(want)
    for g in got:
        src = sorted(want[g.conv_id])
        assert [(t.role, t.text) for t in g.t] == [x[2:] for x in src]
        assert list(g.m) == [x[3] for x in src if x[2] == "assistant"]
        assert g.formatted.count("</s>") == g.n_turns == len(src)
    assert chat_format(df.limit(0)).count() == 0


# -- 3
def test_mixing_sql(spark):
    check_sql(spark, "op3_mix_sources", SF2)


def test_mixing_properties(spark):
    rows = [(i, "w " * (1 + i % 50), f"s{min(i % 7, 2)}" if i % 11 else None) for i in range(3000)] + [(5000, None, "void"), (5001, "", "void")] + [(6000, "dup dup", "s0")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit(1)).withColumn("tie", F.lit(1))
    out = mix_sources(df, keep=["doc_id", "source"]).toPandas()
    assert len(out) == len(rows) and (out.copies <= 2).all() and (out.taken == out.copies * out["size"]).all()
    total = out["size"].sum()
    per = out.groupby(out.source.fillna("-")).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert abs(per.target.sum() - 1.5 * total) < 1e-6 * total and (per.target <= 2 * per["size"] + 1e-6).all()
    assert (abs(per.taken - per.target) <= 55).all()
    pd.testing.assert_frame_equal(out.sort_values(list(out.columns)).reset_index(drop=True), mix_sources(df.repartition(5), keep=["doc_id", "source"]).toPandas().sort_values(list(out.columns)).reset_index(drop=True))
    assert emit(mix_sources(df)).count() == out.copies.sum()
    assert mix_sources(df.limit(0)).count() == 0


# -- 4
@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_ngram_join(spark, k, num):
    random.seed(k)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for n in (3, 8, 11, 25, 60, 200, 900):
        base = [random.choice(words) for _ in range(n)]
        for _ in range(14):
            t = list(base)
            for _ in range(random.choice([0, 0, 1, 1, 2, 3])):
                t[random.randrange(n)] = random.choice(words)
            if random.random() < 0.3:
                t += [random.choice(words) for _ in range(random.randint(1, 3))]
            texts.append(" ".join(t))
    # a chain: each text is near to the next only
    t = [random.choice(words) for _ in range(120)]
    for i in range(12):
        t = list(t)
        t[i * 9] = f"new{i}"
        texts.append(" ".join(t))
    texts += [" ".join(words[:5]) + f" {i}" for i in range(5)] + EDGES
    df = docs_of(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") == 3, F.lit(None)).otherwise(F.col("doc_id") + 100))
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert collected(N.ngram_join(df, k=k, num=num, den=100), "doc_id", "n_shingles", "component_id") == brute.near(rows, k, num, 100)


def test_ngram_large_buckets(spark, monkeypatch):
    """Buckets of several cells: the second round gives every pair that a cell compares, also of sets that share cells which don't."""
    monkeypatch.setattr(N, "SMALL", 2)
    monkeypatch.setattr(N, "CELL", 8)
    rng = np.random.default_rng(4)
    base = np.unique(T.mix64(rng.integers(0, 1 << 62, 300).astype(np.uint64)))
    sets = {N._fingerprint(u)[0]: u for u in (np.delete(base, rng.integers(0, 300, 4)) for _ in range(60))}
    keys = [(k, fp) for fp in sets for k in T.mix64(np.arange(20, dtype=np.uint64)).view(np.int64).tolist() if rng.random() < 0.9]
    info = spark.createDataFrame([(fp, len(u), [int(x) for x in N.sketch_of(u, 1024).view(np.int64)]) for fp, u in sets.items()], "a long, n long, sk array<long>")
    members = N._meet(spark.createDataFrame(keys, "key long, fp long")).where("part >= 0").cache()
    assert members.groupBy("key", "part").count().agg(F.max("count")).first()[0] <= 8
    split = members.withColumn("comp", F.col("a").cast("string")).join(members.groupBy("key").agg((F.max("part") + 1).alias("parts")), "key")
    got = {(r.a, r.b) for r in N._cell_pairs(N._cells(split).join(info, "a"), 90, 100, forest=False).collect()}
    assert got == {(a, b) for a in sets for b in sets if a < b}


def test_ngram_group_stays_linear(spark, monkeypatch):
    """A large group of near copies: a forest of each part and one set of each part, then nothing is left to compare."""
    monkeypatch.setattr(N, "SMALL", 2)
    monkeypatch.setattr(N, "CELL", 8)
    verified = []
    monkeypatch.setattr(N, "_verify", lambda pairs, *a, real=N._verify: verified.append(pairs.count()) or real(pairs, *a))
    words = [f"w{x}" for x in range(400)]
    texts = [" ".join([*words[:i], "own", *words[i + 1 :]]) for i in range(0, 400, 2)]
    df = docs_of(spark, texts)
    got = collected(N.ngram_join(df, k=1, num=80, den=100), "doc_id", "component_id")
    assert got == sorted(((i, 0) for i in range(200)), key=str)
    assert len(verified) <= 2 and sum(verified) < 200 * 20  # of 19,900 pairs; each of up to 81 keys has its own forest


def thue_morse(n):
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_periodic_words_do_not_collide(spark, size):
    """Words that polynomial hashes modulo 2^64 can't tell apart."""
    a, b = thue_morse(size)
    pairs = [(a, b), (f"x {a} y z", f"x {b} y z"), (f"{a} q {b}", f"{b} q {a}")]
    texts = [t for p in pairs for t in p]
    df = docs_of(spark, texts)
    rows = list(enumerate(texts))
    assert collected(N.ngram_join(df, k=3, num=90, den=100), "doc_id", "n_shingles", "component_id") == brute.near(rows, 3, 90, 100)
    assert collected(N.keep_one(df), "doc_id") == [(i,) for i in range(6)]
    long_ = [a + " " + " ".join(f"w{i}" for i in range(9)), b + " " + " ".join(f"w{i}" for i in range(9))]
    items = spark.createDataFrame([("a", long_[0]), ("b", a), ("c", b)], "item_id string, text string")
    found = decontaminate(docs_of(spark, [*long_, a, b]), items)
    assert collected(found, "doc_id", "n_words", "n_hit", "items") == brute.windows(list(enumerate([*long_, a, b])), [("a", long_[0]), ("b", a), ("c", b)])
    five = [" ".join([x, "a", "b", "c", "d", y, "a", "b", "c", "d"]) for x in (a, b) for y in (a, b)]
    got = quality_rules(docs_of(spark, five)).orderBy("doc_id").collect()
    assert [r.n_repeat_words for r in got] == [brute.figures(t)[4] for t in five]
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    texts += [x + y for x in thue_morse(size) for y in "abc"]
    got = token_count(docs_of(spark, texts), tokenizer_path()).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [len(sp.encode(t)) for t in texts]


@pytest.mark.parametrize("seed", range(2))
def test_ngram_large_buckets_brute(spark, monkeypatch, seed):
    """Two near texts among many that only seem near (their own words cancel in the sketch), so that no forest holds the link."""
    monkeypatch.setattr(N, "SMALL", 2)
    monkeypatch.setattr(N, "CELL", 8)
    random.seed(seed)
    words = [f"w{x}" for x in random.sample(range(1 << 30), 6000)]
    base, own, rest = words[:128], [words[128:140], words[140:152]], words[152:]
    by_bit = {}
    for x, u in zip(rest, N._sets([x.encode() for x in rest], 1), strict=True):
        by_bit.setdefault(int(u[0]) & 1023, []).append(x)
    twins = [x[i : i + 2] for x in by_bit.values() for i in range(0, len(x) - 1, 2)]
    texts = [" ".join(base + x) for x in own]
    texts += [" ".join(base + sum(twins[i : i + 12], [])) for i in range(0, 48 * 12, 12)]
    df = docs_of(spark, texts)
    got = collected(N.ngram_join(df, k=1, num=80, den=100), "doc_id", "n_shingles", "component_id")
    assert got == brute.near(list(enumerate(texts)), 1, 80, 100)
    assert (1, 140, 0) in got


def test_ngram_empty_and_keep_one(spark):
    df = docs_of(spark, ["a b c d e f g", "a b c d e f g", "z", None, ""])
    assert N.ngram_join(df.limit(0)).count() == 0
    kept = N.keep_one(df.unionByName(df))
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4]
    null = df.withColumn("doc_id", F.when(F.col("doc_id") != 1, F.col("doc_id")))
    assert collected(N.keep_one(null), "doc_id") == [(0,), (2,), (3,), (4,)]


def test_sketch_bounds():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 300))
        a = np.unique(T.mix64(rng.integers(0, 1 << 62, n).astype(np.uint64)))
        b = np.unique(np.concatenate((a[int(rng.integers(0, min(len(a), 20))) :], T.mix64(rng.integers(0, 1 << 62, int(rng.integers(0, 20))).astype(np.uint64)))))
        diff = len(np.setxor1d(a, b))
        x, y = N.sketch_of(a, 1024), N.sketch_of(b, 256)
        assert np.bitwise_count(N.fold(x, 4) ^ y).sum() <= diff
        both = len(np.intersect1d(a, b))
        if len(b) and both * 100 >= 80 * len(np.union1d(a, b)):
            bands = lambda u: {g: N.keys_of(u, g, m, 80, 100) for g, m in _bands(len(u))}
            p, q = bands(a), bands(b)
            assert diff == 0 or any(g in q and np.intersect1d(p[g], q[g]).size for g in p)


def _bands(n, num=80, den=100):
    g = n.bit_length() - 1
    out = [(g, n * (den - num) // num)]
    if g and (n * num + den - 1) // den < (1 << g):
        out.append((g - 1, ((1 << g) - 1) * (den - num) // num))
    return [x for x in out if x[1] > 0]


# -- 5
def test_line_dedup_sql(spark):
    check_sql(spark, "op5_line_dedup", SF2)


def test_line_dedup_edges(spark):
    rows = [(i, f"menu\n text {i}\n\nfoot  ", "h1") for i in range(20)] + [(100 + i, "only menu", "h2") for i in range(30)] + [(200, "menu", "h1"), (201, None, "h1"), (202, "", "h1"), (203, "menu\nx", None), (3, "menu\n text 3\n\nfoot  ", "h1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lines_dropped", F.lit("x")).withColumn("h", F.lit(1))
    out = line_dedup(df, host=F.col("source"))
    assert out.columns == [*df.columns, "lines_dropped_"]
    want = brute.boilerplate([(h, t) for _, t, h in rows], 0.05, 5)
    assert collected(out, "doc_id", "text") == sorted(((r[0], t) for r, t in zip(rows, want, strict=True)), key=str)
    assert {r.text for r in out.where("source = 'h2'").collect()} == {"only menu"}
    assert line_dedup(df.limit(0), host=F.col("source")).count() == 0


# -- 6
def test_quality_rules(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + EDGES
    out = quality_rules(docs_of(spark, texts))
    got = collected(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for i, t in enumerate(texts):
        f = brute.figures(t)
        want.append((i, *f, f[0] < 10 or 100 * f[4] > 20 * f[0]))
    assert got == sorted(want, key=str)


def test_depleted(spark):
    words = " ".join(f"w{i}" for i in range(12))
    own = lambda i: "".join("abcdefghij"[int(d)] for d in str(i))
    rows = [(i, f"Shared LINE {i} of the site\nown {words} {own(i)}", "h") for i in range(40)] + [(100 + i, f"shared line {i} of the site\nx{own(i)} y", "h") for i in range(20)] + [(200 + i, words + " copy", "h") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in quality_rules(df, limit=10, ratio=0.1, least_left=0.8).collect()}
    assert out[0].n_left == out[0].n_words - 6 and not out[0].kept
    assert out[200].kept  # copies of one text count once
    assert quality_rules(df.limit(0)).count() == 0


@pytest.mark.parametrize("host", ["own", "one"])
def test_depleted_in_large_hosts(spark, host):
    """The count decides in a host of any size; whole tables against brute force."""
    docs = spark.read.parquet(f"{SF2}/documents.parquet").select("doc_id", "text", "source")
    more = [(10**9 + i, f"Read the terms of use {i} before you go on with any of this\nown {chr(97 + i)} words here", "big") for i in range(15)]
    more += [(2 * 10**9 + i, f"text number {'abcdefghij'[i % 10]} {'abcdefghij'[i // 10 % 10]} {'abc'[i // 100]} of the same host with nothing to share", "big") for i in range(300)]
    df = docs.union(spark.createDataFrame(more, docs.schema))
    df = df if host == "own" else df.withColumn("source", F.lit("one"))
    rows = df.collect()
    want = brute.depleted([(r.source, r.text) for r in rows], 10, 0.5)
    assert collected(quality_rules(df), "doc_id", "n_left", "kept") == sorted(((r.doc_id, *x) for r, x in zip(rows, want, strict=True)), key=str)
    assert not any(x[1] for r, x in zip(rows, want, strict=True) if 10**9 <= r.doc_id < 2 * 10**9)


# -- 7
@pytest.mark.parametrize("block", [1 << 20, 60])
def test_decontaminate(spark, block):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [(900, "the"), (901, "in the"), (902, None), (903, "!!"), (904, "the"), (None, "of that"), (905, "A b c d e f g h i j a b c d e f g h")]
    docs += [(1000 + i, t) for i, t in enumerate(EDGES)] + [(2000, "x A-B c, d e F g h i y a b c d e f g"), (2001, "b c d e f g h i j a"), (2000, "x A-B c, d e F g h i y a b c d e f g")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_words", F.lit(0)).withColumn("items", F.lit(0))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(a, b, c, list(d)) for a, b, c, d in collected(decontaminate(df, bench, block=block), "doc_id", "n_words", "n_hit", "items")]
    assert got == brute.windows(docs, items)
    assert decontaminate(df, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate(df.limit(0), bench).count() == 0
    spans = {r.doc_id: [r.text.encode()[s.start : s.stop].decode() for s in r.spans] for r in decontaminate(df, bench, keep=["doc_id", "text"]).where("doc_id = 2000").collect()}
    assert spans[2000] == ["A-B c, d e F g h i"]


# -- 8
def test_toxicity(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = QUERIES["op8_fm_toxicity"](spark, "/root/testdata/sf0.1").join(labels, "doc_id").toPandas()
    held = out[out.held_out]
    toxic = held.toxic == 1
    assert (held.predicted == held.toxic).mean() > 0.97 and held[toxic].predicted.mean() > 0.8 and held[~toxic].predicted.mean() < 0.01
    assert ((out.score >= 0.7) == (out.predicted == 1)).all()


def test_pairs_need_the_factors():
    """Neither word alone is toxic, both together are: no linear score tells."""
    random.seed(5)
    texts, y = [], []
    for _ in range(1200):
        a, b = random.random() < 0.5, random.random() < 0.5
        texts.append(" ".join([*random.choices(["ff", "gg", "hh", "ii"], k=6), *(["insult"] if a else []), *(["group"] if b else [])]))
        y.append(a and b)
    m = fit(list(terms([t.encode() for t in texts])), np.array(y), rounds=400)
    s = m.scores([b"ff insult gg", b"group hh", b"insult ff group", b""])
    assert s[2] > 0.7 and max(s[0], s[1], s[3]) < 0.5


def test_pairs_without_a_marginal_trace():
    """One word of two is toxic, both or none are not: each word's share is alike in both classes."""
    random.seed(6)
    texts, y = [], []
    for n in range(1200):
        a, b = n % 2 == 0, n // 2 % 2 == 0
        texts.append(" ".join([*random.choices(["ff", "gg", "hh", "ii"], k=6), *(["insult"] if a else []), *(["group"] if b else [])]))
        y.append(a != b)
    m = fit(list(terms([t.encode() for t in texts])), np.array(y), rounds=400)
    s = m.scores([b"ff insult gg", b"group hh", b"insult ff group", b"ff gg"])
    assert min(s[:2]) > 0.7 and max(s[2:]) < 0.3


def test_toxicity_edges(spark):
    docs = docs_of(spark, EDGES)
    none = spark.createDataFrame([(1, None)], "id long, label int")
    out = fm_toxicity(docs, none).toPandas()
    assert len(out) == len(EDGES) and out.score.nunique() == 1
    assert fm_toxicity(docs.limit(0), none).count() == 0


# -- 9
def test_language(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    out = QUERIES["op9_language_id"](spark, SF2).join(docs, "doc_id").toPandas()
    held = out[out.held_out]
    assert len(held) > 100 and (held.lang == held.lang_pred).mean() > 0.97 and out.score.between(0, 1).all()


def test_language_edges(spark):
    train = spark.createDataFrame([(1, "the cat and the dog were here with them", "en"), (2, "der hund und die katze waren hier bei ihnen", "de"), (3, "καλημέρα σας τι κάνετε σήμερα", "el"), (4, None, "xx"), (5, "abc", None)], "id long, text string, lang string")
    docs = docs_of(spark, [*EDGES, "σήμερα", "the cat and the dog und die katze waren hier bei ihnen"])
    out = {r.doc_id: r for r in language_id(docs, train).collect()}
    assert [out[i].lang_pred for i in (0, 1, 2, 10)] == ["und"] * 4 and out[11].lang_pred == "el" and out[7].lang_pred in ("en", "de", "el")
    assert 0.4 < out[12].score < 1
    assert {r.lang_pred for r in language_id(docs, train.limit(0)).collect()} == {"und"}
    assert language_id(docs.limit(0), train).count() == 0


def test_all_languages_are_learned(spark, monkeypatch):
    from quillon.llm import language_id as L

    monkeypatch.setattr(L, "MAX_LANGS", 2)
    said = {"en": "the cat and the dog were here", "de": "der hund und die katze waren hier", "fr": "le chien et le chat sont ici", "el": "καλημέρα σας τι κάνετε", "xx": "zuq zaqq wuzz qaz"}
    train = spark.createDataFrame([(10 * i + j, t, x) for i, (x, t) in enumerate(said.items()) for j in range(9 - i)], "id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id(docs_of(spark, list(said.values())), train).collect()}
    assert [got[i] for i in range(len(said))] == list(said)


def test_viterbi():
    from itertools import product

    rng = np.random.default_rng(1)
    for _ in range(60):
        first = np.concatenate(([0], np.cumsum(rng.integers(0, 6, 5))))
        s = rng.normal(0, 3, (first[-1], 3)).astype(np.float32)
        p = viterbi(s, first, 2.0)
        for a, b in zip(first[:-1], first[1:], strict=True):
            value = lambda q, a=a: sum(s[a + i, x] for i, x in enumerate(q)) - 2.0 * sum(x != y for x, y in zip(q, q[1:], strict=False))
            if b > a:
                assert abs(max(map(value, product(range(3), repeat=int(b - a)))) - value([int(x) for x in p[a:b]])) < 1e-4


# -- 10
def test_tokens_equal_the_library(spark):
    path = tokenizer_path()
    assert splits_at_blanks(path)
    random.seed(1)
    bits = [" ", "\n", "a", "the", "é", "\t", "\r", "▁", "</s>", "<s>", "　", "\0", "文", "  ", "{", "x"]
    texts = ["".join(random.choice(bits) for _ in range(random.randint(0, 14))) for _ in range(4000)]
    c = Counter(path)
    assert c.count([t.encode() for t in texts]).tolist() == [len(x) for x in c.sp.encode(texts)]
    docs = docs_of(spark, [*EDGES, *texts[:300]]).union(docs_of(spark, [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]))
    for r in token_count(docs, path, keep=["text"]).collect():
        n = len(c.sp.encode(r.text or ""))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((r.text or "").encode()), n > 4096)
    assert token_count(docs.limit(0), path).count() == 0


def check_sql(spark, name, sf):
    c = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf).toPandas(), c.sql(ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got) == len(want)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    for k in cols:
        assert (a[k].values == b[k].values).all(), k


@pytest.mark.parametrize("name", ["op4_ngram_join", "op6_quality_rules", "op7_decontaminate"])
def test_whole_queries_equal_their_sql(spark, name):
    check_sql(spark, name, SF)


def test_exact_quantile(spark):
    from quillon.llm.bt_quality import of_rank, ordered_bits

    rng = np.random.default_rng(3)
    x = np.concatenate((rng.normal(0, 5, 300), np.repeat(rng.normal(0, 1, 5), 20), [0.0, -0.0, 1e-300, -1e-300, 1e300, -1e300]))
    bits = spark.createDataFrame([(int(b),) for b in ordered_bits(x)], "bits long").cache()
    want = np.sort(x)
    for k in (0, 1, 17, 150, 203, 300, len(x) - 2, len(x) - 1):
        assert of_rank(bits, k) == want[k]


def test_letters_not_bytes_decide(spark):
    train = spark.createDataFrame([(1, "the cat and the dog were here with them", "en"), (2, "η γατα και ο σκυλος ειναι εδω μαζι τους", "el")], "id long, text string, lang string")
    (r,) = language_id(docs_of(spark, ["the cat and the dog the cat and γατα σκυλος ειναι εδω"]), train, keep=["doc_id", "_lid"]).collect()
    assert r.lang_pred == "en" and r.score == pytest.approx(24 / 42)


def test_repeated_ids_keep_the_sample_bounded(spark):
    from quillon.llm._tables import sampled_texts

    docs = docs_of(spark, ["b", "a", "c"] * 50).withColumn("doc_id", F.col("doc_id") % 3)
    some = spark.createDataFrame([(0, 1), (2, 0), (9, 0)], "id long, label int")
    assert collected(sampled_texts(docs, some, "doc_id", "text"), "id", "label", "text") == [(0, 1, "b"), (2, 0, "c")]
