"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for each operator."""

import hashlib
import itertools
import multiprocessing
import random
import re
import time
import tracemalloc
import zlib
from concurrent.futures import ProcessPoolExecutor

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from terravec.llm import chat, embed_dedup, html_text, langid, line_dedup, packing, pieces, quality, simhash, toxicity
from tests.oracle import duck

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000 + "\n" + "x" * 50_000


@pytest.fixture(scope="module")
def docs(spark):
    body = "the quick brown fox jumps over the lazy dog and runs away into the dark green forest"
    rows = [
        (1, "a shared line of text\nown line one here", "en", "s", 1),
        (2, "A SHARED line of text  \nown line two here", "en", "s", 1),
        (3, None, "en", "s", 1),
        (4, "", None, None, None),
        (5, "a shared line of text\na shared line of text", "de", "s", 1),
        (6, body, "en", "s", 1),
        (7, body, "en", "s", 1),
        (7, body, "en", "s", 1),
        (None, "an unrelated text about rivers and boats\na shared line of text", "en", None, 1),
        (9, LONG, "en", "s", 1),
        (10, " \t\r ", "en", "s", 1),
        (11, "日本語のテキスト 😀 ǅ ß", "ja", "s", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def clash(df):
    """Columns that operators add, or use inside."""
    return df.withColumns({c: F.lit("mine") for c in ("score", "salt", "ids", "fp", "kept", "n_words", "n_lines", "kept_text", "_h", "_w", "lang_pred", "text_hash")})


def test_line_dedup(docs, empty):
    out = {r.doc_id: r for r in line_dedup.dedup_lines(clash(docs)).filter("doc_id IS NOT NULL").collect()}
    assert out[2].kept_text == "own line two here" or out[2].n_dropped == 1
    assert out[5].n_dropped == 2 and out[5].kept_text == ""
    assert out[3].n_lines == 1 and out[3].kept_text == "" and out[4].kept_text == ""
    assert out[6].n_dropped == 0 and out[7].n_dropped == 1
    assert out[9].n_dropped == 0 and out[9].n_lines == 2
    # a null id comes before all others, so it keeps the shared line
    null = line_dedup.dedup_lines(docs).filter("doc_id IS NULL").first()
    assert null.n_dropped == 0 and out[1].n_dropped == 1
    assert line_dedup.dedup_lines(empty).count() == 0
    assert line_dedup.dedup_lines(docs).count() == docs.count()
    kept = line_dedup.dedup_lines(clash(docs))
    assert {"_h", "_w", "salt", "fp"} <= set(kept.columns) and kept.filter("_h <> 'mine' OR _w <> 'mine' OR salt <> 'mine'").count() == 0


def test_line_dedup_salts_do_not_matter(docs):
    key = lambda n: sorted((str(r.doc_id), r.kept_text) for r in line_dedup.dedup_lines(docs, salts=n).select("doc_id", "kept_text").collect())
    assert key(1) == key(2) == key(64)


def test_quality(docs, empty):
    out = quality.judged(clash(docs).drop("n_words", "kept")).orderBy("doc_id").collect()
    assert len(out) == docs.count()
    by = {r.doc_id: r for r in out}
    assert by[3].n_words == 0 and by[3].base_failed and not by[3].kept and by[10].n_words == 0
    assert by[9].n_words == 30_001 and by[9].n_repeat_words == 30_000 and by[9].base_failed
    assert by[5].n_dup_lines == 1
    assert quality.judged(empty).count() == 0


def test_quality_is_the_same_however_rows_are_dealt(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = [sorted((r.doc_id, r.kept) for r in quality.judged(d).select("doc_id", "kept").collect()) for d in (docs, docs.repartition(7, "text"), docs.orderBy(F.desc("doc_id")))]
    assert found[0] == found[1] == found[2]


def test_quality_counts_where_leading_bits_agree(spark):
    """Repeats by brute force, in texts of few and of many windows."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, top, n)), "en", "s", 1) for i, (n, top) in enumerate([(0, 9), (2, 9), (3, 1), (50, 4), (400, 12), (5000, 20), (30_000, 60)])]
    out = {r.doc_id: r.n_repeat_words for r in quality.text_counts(spark.createDataFrame(rows, DOCS)).collect()}
    for i, text, *_ in rows:
        w = text.split()
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        many = {}
        for g in grams:
            many[g] = many.get(g, 0) + 1
        assert out[i] == len({k + d for k, g in enumerate(grams) if many[g] > 1 for d in range(3)})


def test_quality_rejects_what_stands_out(spark):
    clean = [(i, " ".join(f"w{(i * 37 + k * k) % 997}" for k in range(60)), "en", "s", 1) for i in range(150)]
    junk = [(1000 + i, " ".join(f"w{(i * 31 + k * k) % 991}###$$$" for k in range(60)), "en", "s", 1) for i in range(10)]
    out = {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame(clean + junk, DOCS)).collect()}
    assert all(out[i] for i in range(150)) and not any(out[1000 + i] for i in range(10))


def test_simhash(docs, empty):
    out = {r.doc: r for r in simhash.near_duplicates(clash(docs)).collect()}
    assert out[7].component == 6 and out[6].component == 6
    assert out[3].fp == 0 and out[4].fp == 0 and out[10].component == 3
    assert len(out) == 11 and simhash.near_duplicates(docs).count() == docs.count()
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_segments_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = [sorted((r.doc, r.component) for r in simhash.near_duplicates(docs, segments=k, per_tile=n).collect()) for k, n in ((4, 16384), (8, 16384), (16, 5), (None, 16384))]
    assert found[0] == found[1] == found[2] == found[3]


def test_simhash_hashes_equal_the_library(monkeypatch):
    """At any borders of groups and blocks, in both string layouts, within a slice."""
    draw = random.Random(1)
    words = ["X" * k for k in range(1, 80)] + ["É", "日本語", "ǅ", "\u00a0", "\x1c", "\x00", "y" * 1000]
    texts = [None, "", " \t ", "a", "A b"] + ["".join(draw.choice(words) + draw.choice([" ", "\n", "  ", "\t\x0b\x0c\r"]) for _ in range(draw.randint(0, 60))) for _ in range(100)] + ["q w e " * 9000, "", "z"]
    upper = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    for n, block in itertools.product((1, 3, 5), (7, 1 << 14)):
        monkeypatch.setattr(simhash, "SHINGLES", block)
        want = []
        for t in texts[2:]:
            w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(upper))
            want.append([xxhash.xxh64_intdigest(" ".join(w[k : k + n]), 42) for k in range(max(min(len(w), 1), len(w) - n + 1))])
        for kind in (pa.string(), pa.large_string()):
            hashes, many = simhash.shingle_hashes(pa.array(texts, kind).slice(2), n)
            assert many.tolist() == list(map(len, want)) and hashes.tolist() == [h for x in want for h in x]


def test_simhash_makes_no_objects_of_words(docs):
    """Words split in the JVM filled an executor's heap with garbage: texts go to the worker whole, and are hashed in bounded blocks."""
    plan = simhash.fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "split(" not in plan and "transform(" not in plan
    texts = pa.array([" ".join(f"word{(i * 37 + k) % 997}" for k in range(300)) for i in range(8000)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(8000)), texts], names=["doc", "_t"])
    tracemalloc.start()
    try:
        done = list(simhash._fingerprinted(3)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert done[0].num_rows == 8000 and batch.nbytes > 15e6 and peak < 30e6


def test_simhash_only_nulls(spark):
    only = spark.createDataFrame([(None, "a b c d e f")], "doc_id long, text string")
    assert simhash.near_duplicates(only).first().component is None


def test_toxicity(docs, empty, spark):
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (6, 1, 0), (1, 1, 1), (99, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    out = toxicity.scored(clash(docs), model).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert toxicity.scored(empty, model).count() == 0
    none = toxicity.train(empty, labels)
    assert none.scores(["", "abc"]).max() < 0.1
    assert toxicity.fit(["a", "b"], np.array([1, 1])).scores(["x"])[0] > 0.9


def test_toxicity_unseen_spellings():
    rng = np.random.default_rng(0)
    words = ["stone", "river", "cloud", "paper", "garden", "window", "yellow", "silent", "market", "winter"]
    texts, labels = [], []
    for i in range(300):
        t = [str(x) for x in rng.choice(words, 40)]
        if i % 3 == 0:
            t[int(rng.integers(40))] = "blorgish" + str(rng.choice(["en", "er", "ly", "ed"]))
        texts.append(" ".join(t))
        labels.append(int(i % 3 == 0))
    m = toxicity.fit(texts, np.array(labels))
    good, bad = m.scores(["stone river cloud paper"])[0], m.scores(["stone river blorgishing paper garden"])[0]
    assert bad >= 0.7 > good


def test_langid(docs, empty):
    net = langid.train(docs)
    out = {r.doc_id: r for r in langid.identified(clash(docs), net).collect()}
    assert out[3].lang_pred == "und" and out[4].lang_pred == "und" and out[10].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in out.values()) and out[9].lang_pred != "und"
    assert langid.identified(empty, net).count() == 0
    assert {r.lang_pred for r in langid.identified(docs, langid.train(empty)).collect()} == {"und"}


def test_langid_letters():
    net = langid.fit(["ein kurzer Text und noch einer " * 9, "a short text and another one " * 9], ["de", "en"])
    langs, _ = langid.Tables(net).predict(["½ ² Ⅷ 12 --", "½ a"])
    assert langs[0] == "und" and langs[1] != "und"


def test_langid_every_language_counts(spark):
    rows = [(100 * k + i, f"{chr(0x4E00 + k)} word{k} " * 40, f"l{k:03d}") for k in range(300) for i in range(2)]
    x, langs, classes = langid.labelled_windows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", F.lit(True), texts=400)
    assert len(classes) == 300 == len(set(langs)) and len(x) == len(langs)


def test_langid_windows_cover_the_text():
    assert sum(bytes(w).rstrip(b"\0") != b"" for w in langid.windows("a" * 1000)) == -(-1000 // langid.WINDOW)


def test_langid_tables_equal_the_net():
    net = langid.Net.new(["a", "b", "c"])
    x = langid.windows("ein kurzer Text und noch einer, der länger ist " * 20)
    got = langid.Tables(net).log_probs(x)
    e = net.emb[x]
    h = []
    for w, k, b in zip(langid.WIDTHS, net.kernels, net.offsets, strict=True):
        z = np.stack([e[:, i : i + w].reshape(len(x), -1) @ k for i in range(langid.WINDOW - w + 1)], axis=1)
        h.append(z.max(axis=1) + b)
    logits = np.maximum(np.concatenate(h, axis=1), 0) @ net.out + net.bias
    want = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
    assert np.allclose(got, want, atol=1e-4)


def test_packing(docs, empty):
    out = packing.pack_documents(clash(docs)).toPandas()
    assert (out[out.doc == 3].length == 1).all() and len(out[out.doc == 7]) == 2
    assert out.groupby("sequence_id").length.sum().max() <= packing.CAPACITY
    s = out.sort_values(["sequence_id", "offset"])
    assert (s.offset == s.groupby("sequence_id").length.cumsum() - s.length).all()
    assert packing.pack_documents(empty).count() == 0


def test_packing_ids(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    ids_of = packing.WordIds(packing.tokenizer_path())
    for text in [r.text or "" for r in docs.collect()] + ["It's THE dog's (end)... x\x1cy é É ﬁ", "don't you'll 12three <|endoftext|> a"]:
        assert np.frombuffer(ids_of.of(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def odd_texts():
    """Texts of all Latin-1 characters, of others that combine or change with case, and of special tokens in any case."""
    rng = random.Random(7)
    pools = [[chr(c) for c in range(256)], list("abcdefgh ÉéßÀ.,'sSTtreLLvmd123 \n"), list("abAB \u0301\u030c\u0307JIİſKÅﬁ中щЩ😀\u00a0\u1680\u3000é\x1c\x85")]
    texts = ["".join(rng.choice(pools[i % 3]) for _ in range(rng.randrange(60))) for i in range(600)]
    return [*texts, *(f"{chr(c)}a{chr(c)} {chr(c)}" for c in range(256)), "<|STARTOFTEXT|>", "É <|EndOfText|>b c<|endoftext|>D", "", "\n", None]


@pytest.mark.parametrize("sizes", [None, (200, 3)])
def test_packing_ids_of_odd_texts(sizes, monkeypatch):
    from tokenizers import Tokenizer

    if sizes:
        monkeypatch.setattr(packing, "GROUP_BYTES", sizes[0])
        monkeypatch.setattr(packing, "TOGETHER", sizes[1])
    t, ids_of, texts = Tokenizer.from_file(packing.tokenizer_path()), packing.WordIds(packing.tokenizer_path()), odd_texts()
    found = list(ids_of.of_all(pa.array(texts)))
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert list(ids_of.of_all(pa.array([], pa.string()))) == [] and list(ids_of.of_all(pa.array([None, "", " "]))) == [b"", b"", b""]


def test_packing_encodes_new_words_together():
    """The tokenizer is called a few times, not once for each of 5,000 words that no other text has."""
    ids_of, calls = packing.WordIds(packing.tokenizer_path()), []

    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def __getattr__(self, name):
            return lambda *args, **more: calls.append(name) or getattr(self.tokenizer, name)(*args, **more)

    for name in [k for k, v in vars(ids_of).items() if type(v).__name__ == "Tokenizer"]:
        setattr(ids_of, name, Counted(getattr(ids_of, name)))
    letters = [chr(c) for c in range(ord("a"), ord("z") + 1)]
    text = " ".join(f"{a}{b}{c}é{',' * (a < 'd')}" for a in letters[:8] for b in letters for c in letters[:25])
    assert len(text.split()) > 5000 and len(ids_of.of(text)) > 4 * 5000 and 0 < len(calls) < 20


@pytest.mark.parametrize("most", [None, 1000])
def test_packing_keeps_words_of_earlier_groups(most, monkeypatch):
    """Words of an earlier group don't go to the tokenizer again; where few are kept, ids are the same."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "GROUP_BYTES", 2000)
    t, ids_of, sent = Tokenizer.from_file(packing.tokenizer_path()), packing.WordIds(packing.tokenizer_path()), []
    if most:
        ids_of.words.most = most
    joint = ids_of.joint

    class Counted:
        def encode_batch_fast(self, texts, **more):
            sent.extend(w for text in texts for w in text.split())
            return joint.encode_batch_fast(texts, **more)

    ids_of.joint = Counted()
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) + rng.choice(["", ",", "'s É", "\n7"]) for _ in range(60)) for _ in range(200)]
    assert [np.frombuffer(x, "<u4").tolist() for x in ids_of.of_all(pa.array(texts))] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert (len(ids_of.words.row) < 10) if most else (len(sent) == len(set(sent)) > 60)


def test_packing_fill_is_the_traced_one():
    rng = np.random.default_rng(4)
    for _ in range(50):
        left, price = rng.integers(0, 5, 41), rng.random(41)
        left[0], lengths = 0, np.flatnonzero(rng.random(41) < 0.6)[1:]
        _, items, taken = packing.knapsack(price, left, 40, lengths)
        assert (np.bincount(packing.fill(price, left, 40, lengths), minlength=41) == packing.traced(np.array([40]), items, taken, 41)[0]).all()


def worker_memory(batches):
    """(pid, now, peak): MB of this Python worker without mapped files, peak being since the call before; each call takes a while,
    so that all workers get one."""
    import os
    import re
    import time

    for _ in batches:
        pass
    time.sleep(0.5)
    status = dict(re.findall(r"(\w+):\s+(\d+) kB", open("/proc/self/status").read()))
    now, peak = int(status["RssAnon"]), int(status["VmHWM"]) - int(status["RssFile"])
    with open("/proc/self/clear_refs", "w") as f:
        f.write("5")
    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (os.getpid(), now // 1024, peak // 1024)], names=["pid", "now", "peak"])


def test_packing_workers_stay_small(spark):
    """Workers that encode 16 MB of mostly distinct words each: what they take meanwhile, and what they hold when idle."""
    measured = lambda: spark.range(0, 8, 1, 8).mapInArrow(worker_memory, "pid long, now long, peak long").toPandas().groupby("pid").max()
    letters = F.translate(F.hex(F.xxhash64("id", "x")), "0123456789ABCDEF", "abcdefghijklmnop")
    word = spark.range(0, 4000, 1, 4).select("id", F.explode(F.sequence(F.lit(1), F.lit(2700))).alias("x")).select("id", F.substring(letters, 1, 5).alias("w"))
    docs = spark.createDataFrame(word.groupBy("id").agg(F.concat_ws(" ", F.collect_list("w")).alias("text")).collect(), "doc_id long, text string").repartition(4)
    before = measured()
    assert packing.pieces(docs, packing.tokenizer_path()).count() > 4000
    grown = measured()[["now", "peak"]].sub(before.now, axis=0).dropna()
    assert len(grown) and grown.now.max() < 70 and grown.peak.max() < 220, grown


def test_packing_counts():
    counts = np.zeros(2049, dtype=np.int64)
    for length, n in ((700, 300), (1300, 100), (500, 500), (1025, 70), (690, 90), (2048, 11)):
        counts[length] = n
    plan = packing.plan(counts, rounds=200)
    got = np.zeros_like(counts)
    for config, n in plan.items():
        assert sum(config) <= 2048
        for length in config:
            got[length] += n
    assert (got == counts).all()
    assert sum(plan.values()) <= sum(packing.best_fit_decreasing(counts).values())


def lengths_of(sf_dir):
    ids_of, counts = packing.word_ids(packing.tokenizer_path()), np.zeros(packing.CAPACITY + 1, dtype=np.int64)
    for (text,) in duck("SELECT text FROM documents", sf_dir).itertuples(index=False):
        n = len(ids_of.of(text or "")) // 4 + 1
        counts[packing.CAPACITY] += n // packing.CAPACITY
        if n % packing.CAPACITY:
            counts[n % packing.CAPACITY] += 1
    return counts


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_packing_program_decides(sf):
    """Over nine in ten pieces come from the program's configurations, and these take no more sequences than best-fit."""
    counts = lengths_of(f"/root/testdata/{sf}")
    price, bound = packing.relaxation(counts)
    by_program, left = packing.configurations(counts, price)
    assert sum(len(c) * n for c, n in by_program.items()) == counts.sum() - left.sum() > 0.9 * counts.sum()
    took = sum(packing.plan(counts).values())
    assert np.ceil(bound - 1e-6) <= took <= sum(packing.best_fit_decreasing(counts).values())


def test_packing_knapsack_is_exact():
    rng = np.random.default_rng(5)
    for _ in range(20):
        left = np.zeros(41, dtype=np.int64)
        left[rng.integers(1, 30, 4)] = rng.integers(1, 4, 4)
        price = rng.random(41)
        lengths = np.flatnonzero(left)
        got = packing.fill(price, left, 40, lengths)
        worth = [sum(price[k] * n for k, n in zip(lengths, many, strict=True)) for many in itertools.product(*(range(int(left[k]) + 1) for k in lengths)) if sum(k * n for k, n in zip(lengths, many, strict=True)) <= 40]
        assert sum(got) <= 40 and all(got.count(k) <= left[k] for k in got) and abs(sum(price[k] for k in got) - max(worth)) < 1e-9


def odd_counts(seed):
    """A few lengths of many pieces, many lengths up to a sequence or to half of one, or a skewed corpus."""
    rng, counts = np.random.default_rng(seed), np.zeros(2049, dtype=np.int64)
    kind = seed % 4
    if kind == 0:
        k = int(rng.integers(2, 40))
        counts[rng.integers(300, 1400, k)] += rng.integers(1, 1000, k)
    elif kind == 1:
        np.add.at(counts, rng.integers(1, 2049, 200), rng.integers(1, 30, 200))
    elif kind == 2:
        k = int(rng.integers(5, 100))
        np.add.at(counts, rng.integers(1, 1025, k), rng.integers(1, 100, k))
    else:
        np.add.at(counts, np.clip(rng.lognormal(5.5, 1, int(rng.integers(100, 1500))).astype(int), 1, 2048), 1)
    return counts


def packed_odd_counts(seed):
    """(sequences, those of best-fit), after a look that they hold what they should."""
    counts = odd_counts(seed)
    plan, bound = packing.plan(counts), packing.relaxation(counts)[1]
    got = np.zeros_like(counts)
    for config, n in plan.items():
        assert sum(config) <= 2048 and n > 0
        got += n * np.bincount(config, minlength=2049)
    assert (got == counts).all() and sum(plan.values()) >= np.ceil(bound - 1e-6)
    return sum(plan.values()), sum(packing.best_fit_decreasing(counts).values())


def test_packing_is_never_above_best_fit():
    """In a hundred random histograms, without slack; and the bound that the prices prove is a bound."""
    with ProcessPoolExecutor(4, multiprocessing.get_context("spawn")) as workers:
        found = list(workers.map(packed_odd_counts, range(100)))
    assert all(n <= best_fit for n, best_fit in found) and sum(n < best_fit for n, best_fit in found) > 30


def test_packing_bound_is_tight_where_a_third_is_wasted():
    counts = np.zeros(2049, dtype=np.int64)
    counts[1100], counts[700] = 100, 300  # 100 pairs, the other 200 two by two
    assert packing.relaxation(counts)[1] > 199 and sum(packing.plan(counts).values()) == 200


def test_embedding_dedup(spark):
    v = [1.0] + [0.0] * 7
    near = [0.99, 0.05] + [0.0] * 6
    rows = [(1, v, 1), (2, v, 1), (3, near, 1), (4, v, 2), (5, None, 1), (6, [0.0] * 8, 1), (7, [float("nan")] + [0.0] * 7, 1), (8, [None] + [0.0] * 7, 1), (9, v, None), (10, [float("inf")] + [0.0] * 7, 1), (11, [1.0], 1), (12, [2.0] + [0.0] * 7, 1), (2, v, 1)]
    out = sorted(embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect(), key=lambda r: r.vec_id)
    assert len(out) == len(rows)
    by = {r.vec_id: r for r in out}
    assert by[1].n_links == 4 and by[3].n_links == 4 and by[12].component_id == 1
    assert all(by[k].n_links == 0 and by[k].kept for k in (4, 5, 6, 7, 8, 9, 10, 11))
    assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_embedding_dedup_recall_and_tiles(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(120, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.normal(size=(120, 64))
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    x = np.concatenate([base, base + 0.3 * noise])
    rows = [(i, [float(a) for a in r], 0) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = ((u @ u.T) >= 0.93).sum(axis=1) - 1
    for per_tile in (2048, 3):
        got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(df, per_tile=per_tile).collect()}
        assert sum(min(got[i], want[i]) for i in got) >= 0.9 * want.sum() and all(got[i] <= want[i] for i in got)


def test_html(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<p>plain words here</p>"), (4, "u", "<article><h1>T</h1><p>a &amp; b"), (4, "u", "<article><h1>T</h1><p>a &amp; b"), (5, "u", "<" * 5000), (6, "u", "<script>only()</script>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("mine"), "n_chars": F.lit(0)})
    out = html_text.extracted(pages, html_text.train(pages)).collect()
    assert len(out) == len(rows)
    by = {r.page_id: r.text for r in out}
    assert by[1] == "" and by[2] == "" and by[3] == "plain words here" and by[4] == "T\n\na & b" and by[6] == ""
    assert html_text.extracted(pages.limit(0), html_text.DEFAULT).count() == 0


def test_html_scan_leaves_out_links_beside_main_and_keeps_those_in_it():
    """Of the article nothing but menus and their like is left out, and a list of links is none by itself."""
    prose = "words of the story that is told here " * 6
    links = "<ul>" + "".join(f"<li><a href='/{k}'>other page number {k}</a></li>" for k in range(8)) + "</ul>"
    w = html_text.fit([f"<body><div>{links}</div><article><h1>Head</h1><p>{prose}</p><p>{prose}</p></article><div>{links}</div></body>"] * 20)
    told = f"Head\n\n{prose.strip()}\n\n{prose.strip()}"
    body = f"<h1>Head</h1><p>{prose}</p><p>{prose}</p>"
    listed = "\n\n".join(f"other page number {k}" for k in range(8))
    for page, text in ((f"<article>{body}</article>", told), (f"{links}<article>{body}</article>{links}", told), (f"<article>{body}{links}</article>", f"{told}\n\n{listed}"), (f"<article>{links}{body}</article>", f"{listed}\n\n{told}")):
        assert html_text.main_text(f"<body>{page}</body>", w) == text
    assert html_text.main_text(f"<body><article>{body}<nav>{links}</nav></article></body>", w) == told
    # nothing above zero: the element is the text
    assert html_text.main_text("<article><a href='/x'>one link</a></article>", html_text.Weights(word={"main": 0.5})) == "one link"


def test_html_names_of_noise_on_wrappers():
    prose = "words of the story that is told here " * 6
    body = f"<h1>Head words of it</h1><p>{prose}</p><p>{prose}</p>"
    told = f"Head words of it\n\n{prose.strip()}\n\n{prose.strip()}"
    for names in ("layout has-sidebar", "no-sidebar", "with-nav", "header-fixed", "sidebar"):
        for inside in (f"<article>{body}</article>", f"<main>{body}</main>", body):
            for page in (f"<div class='{names}'>{inside}</div>", f"<div id=a><div class='{names}'><div class=ad>Buy this</div>{inside}<div class='sidebar'>More to read</div></div></div>"):
                assert html_text.main_text(f"<html><body>{page}</body></html>") == told, (names, page)
    assert html_text.main_text(f"<body><form action='/x'><article>{body}</article></form></body>") == told
    assert html_text.main_text(f"<body><form action='/x'>{body}</form></body>") == told
    # comments, teasers and search forms beside an article are still left out
    for beside in (f"<div id='comments'>{prose * 9}</div>", f"<div class='related-posts'><article>{prose}</article></div>", "<form>Find pages</form>"):
        assert html_text.main_text(f"<body><article>{body}</article>{beside}</body>") == told


def html_weights():
    pages = [h for (h,) in duck("SELECT html FROM pages ORDER BY page_id LIMIT 200", "/root/testdata/sf0.01").itertuples(index=False)]
    return html_text.fit(pages)


def test_html_names_alone_remove_no_prose_of_an_article():
    six = " ".join(f"Sentence number {k} tells some more of the story." for k in range(6))
    for w in (html_weights(), html_text.DEFAULT):
        for name in ("discussion", "related", "search", "menu", "alert", "banner", "reply", "notice", "header", "related-work", "search-methods"):
            for tag in ("section", "div"):
                page = f"<body><nav><a href='/'>Home</a></nav><article><h1>Head</h1><p>{six}</p><{tag} class='{name}'><p>{six}</p><p>{six}</p></{tag}><p>{six}</p></article><footer>c</footer></body>"
                assert html_text.main_text(page, w) == "\n\n".join(["Head", six, six, six, six]), (name, tag)
        # what is never the article's goes from it too
        for name in ("ad", "ads", "advert", "comments", "newsletter", "share", "cookie-notice", "sponsored"):
            page = f"<body><article><h1>Head</h1><p>{six}</p><div class='{name}'><p>{six}</p></div><p>{six}</p></article></body>"
            assert html_text.main_text(page, w) == "\n\n".join(["Head", six, six]), name
        # short lines of a doubtful name are no prose
        page = f"<body><article><h1>Head</h1><p>{six}</p><div class='related-posts'><ul><li><a href='/a'>Another story</a></li></ul></div><p>The end.</p></article></body>"
        assert html_text.main_text(page, w).endswith("The end.")


def test_html_keeps_references_links_and_short_ends_of_an_article():
    prose = "words of the story that is told here, and more of them. " * 4
    entries = [f"Author {k}, Title of the work {k}, 19{k}0" for k in range(8)]
    linked = "".join(f"<li><a href='/r{k}'>{x}</a></li>" for k, x in enumerate(entries))
    for w in (html_weights(), html_text.DEFAULT):
        for title in ("", "<h2>References</h2>"):
            page = f"<body><div><ul>{linked}</ul></div><article><h1>Head</h1><p>{prose}</p>{title}<ol>{linked}</ol></article></body>"
            assert html_text.main_text(page, w) == "\n\n".join(["Head", prose.strip(), *(["References"] if title else []), *entries])
        for end in ("Fin", "The end"):
            for dropped in ("<div class='ad'><p>Buy this now</p></div>", "<aside>More</aside>", "<form>Send</form>"):
                page = f"<body><article><h1>Head</h1><p>{prose}</p>{dropped}<p>{end}</p></article></body>"
                assert html_text.main_text(page, w) == f"Head\n\n{prose.strip()}\n\n{end}", (end, dropped)


@pytest.mark.parametrize("depth", [1, 7, 8, 9, 12, 40, 3000])
def test_html_wrappers_of_any_depth(depth):
    """An advert in the article is left out however many wrappers with telling names are around it, in time that grows with the page."""
    prose = "words of the story that is told here, and more of them. " * 6
    for inside in ("<article>{}</article>", "<main>{}</main>"):
        for extra in ("", "<p>x</p>"):
            body = inside.format(f"<h1>Head</h1><p>{prose}</p><div class='ad'>Buy this</div><p>{prose}</p>")
            page = f"<body>{('<div class=sidebar>' + extra) * depth}{body}{'</div>' * depth}</body>"
            began = time.time()
            assert html_text.main_text(page).startswith(f"Head\n\n{prose.strip()}\n\n{prose.strip()}") or extra and depth > 40
            assert "Buy this" not in html_text.main_text(page) or extra and depth > 40
            assert time.time() - began < 5


def test_html_keeps_words_within_a_line():
    page = "<article><p>One <span class='alert'>word</span> and <a class='social-link' href='/x'>a link</a>, <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> is kept.</p><p><a class='share' href='/y'>Share it</a></p><p>The end <span hidden>not</span> here.</p></article>"
    assert html_text.main_text(page) == "One word and a link, x=1 is kept.\n\nThe end here."


def test_html_weights_decide():
    """The same page under the fitted weights, and under their opposites."""
    prose, other = "words of the story that is told here " * 6, "what stands beside it on the page " * 6
    body = f"<h1>Head</h1><p>{prose}</p><p>{prose}</p>"
    page = f"<body><nav><a href='/'>Home</a></nav><article>{body}</article><section><p>{other}</p></section></body>"
    w = html_text.fit([page] * 20)
    told = f"Head\n\n{prose.strip()}\n\n{prose.strip()}"
    assert html_text.main_text(page, w) == told
    against = html_text.Weights(w.tag, {k: -v for k, v in w.word.items()}, {k: -v for k, v in w.name.items()}, w.other_tag, w.link)
    assert html_text.main_text(page, against) == other.strip()
    # pages without a main element
    for bare in (f"<body><div class='menu'><a href='/a'>A</a> <a href='/b'>B</a></div><div class='post'>{body}</div><div class='footer-links'><a href='/c'>C</a></div></body>", f"<body><div id='x'>{body}</div><div class='comment-list'><p>{other}</p></div></body>"):
        assert html_text.main_text(bare, w) == told


def test_html_names_within_the_article():
    prose = "words of the story that is told here " * 6
    for inside in (f"<section class='related-work'><p>{prose}</p></section>", f"<p class='search'>{prose}</p>", f"<object><p>{prose}</p></object>"):
        assert html_text.main_text(f"<article><p>First words of it.</p>{inside}</article>") == f"First words of it.\n\n{prose.strip()}"
    for beside in ("<div class='ad'>Buy this now</div>", "<div class='notice'>We changed our terms</div>", "<div class='comments-area'><p>I like this one</p></div>", "<ul class='related-posts'><li><a href='/x'>Another page</a></li></ul>", "<form><p>Your name</p></form>", "<aside><p>About us</p></aside>"):
        assert html_text.main_text(f"<article><p>{prose}</p>{beside}<p>Last words of it.</p></article>") == f"{prose.strip()}\n\nLast words of it."
    long = "<!-- " + "x" * 900 + " -->"
    assert html_text.main_text(f"<article><header>{long}<div>{long}<h1>Title</h1></div></header><p>{prose}</p></article>") == f"Title\n\n{prose.strip()}"


def test_html_is_linear_in_the_page():
    began = time.time()
    for page in ("<nav>" * 50_000, "<article>" + "<header>" * 50_000, "<form>" * 50_000 + "x", "<script>" * 50_000, "<span class='ad'>" * 50_000, "<header><b>" * 20_000):
        html_text.main_text(page)
    assert time.time() - began < 30


def test_html_without_article_tags():
    pages = [r[0] for r in duck("SELECT html FROM pages ORDER BY page_id").itertuples(index=False)]
    w = html_text.fit(pages[:25])
    bare = [p.replace("<article>", "").replace("</article>", "") for p in pages[25:]]
    assert [html_text.main_text(p, w) for p in bare] == [html_text.main_text(p, w) for p in pages[25:]]


def test_chat(spark):
    rows = [(1, k, r, t) for k, (r, t) in enumerate([("system", "Be brief."), ("user", "hi?"), ("assistant", "Hello."), ("user", None), ("assistant", "")])]
    rows += [(2, 0, None, "x"), (None, None, "user", "y"), (2, 0, None, "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"rendered": F.lit("mine"), "slot": F.lit(1)})
    m = chat.fit(chat.labelled_sample(turns, F.lit(True), "conv_id", "turn", "role", "text"))
    out = chat.format_turns(turns, m).collect()
    assert len(out) == len(rows) and all(r.rendered.startswith(f"<|{r.role}|>\n") for r in out)
    assert [r.role for r in sorted((r for r in out if r.conv == 1), key=lambda r: r.turn)] == ["system", "user", "assistant", "user", "assistant"]
    assert chat.format_turns(turns.limit(0), m).count() == 0
    assert chat.fit([]).roles == ["assistant", "system", "user"]


def test_chat_parts_equal_the_whole():
    rng = np.random.default_rng(3)
    turns = [("user", "why?"), ("assistant", "Because."), ("user", "ok."), ("assistant", "Good.")]
    shown_turns = lambda c: [(r, chat.features(t)) for r, t in c]
    m = chat.fit([shown_turns(turns)] * 5 + [shown_turns([("system", "Short"), ("user", "what?")])])
    shown = np.array([[int(rng.integers(f)) for f in chat._FEATURES] for _ in range(40)])
    whole = chat.viterbi(m, shown, None, True, None)
    cuts = [0, 7, 8, 25, 40]
    spans = list(zip(cuts[:-1], cuts[1:], strict=True))
    last = chat.through([chat.transfer(m, shown[a:b], i == 0) for i, (a, b) in enumerate(spans)])
    parts = [chat.viterbi(m, shown[a:b], last[i - 1] if i else None, i == 0, last[i]) for i, (a, b) in enumerate(spans)]
    assert (np.concatenate(parts) == whole).all()
    # against every way to give roles to a few messages
    few = shown[:6]
    e, k = m.emissions(few), len(m.roles)
    worth = {w: m.start[w[0]] + sum(e[i, r] for i, r in enumerate(w)) + sum(m.move[a, b] for a, b in zip(w[:-1], w[1:], strict=True)) for w in itertools.product(range(k), repeat=6)}
    assert abs(worth[tuple(chat.viterbi(m, few, None, True, None).tolist())] - max(worth.values())) < 1e-9


def test_chat_transcripts(spark):
    m = chat.fit([[("user", chat.features("why?")), ("assistant", chat.features("Because."))]] * 9)
    text = "User: What is it?\nIt is large.\nAssistant: A: a lake.\n\nIt is cold.\nUser: Thanks"
    docs = spark.createDataFrame([(1, text), (2, "Question: is it so?"), (3, "### Human: hello\n### Assistant: Good day"), (4, None), (5, "User: one\nUser: two")], "doc_id long, text string")
    out = {}
    for r in sorted(chat.parse_transcripts(docs, m).collect(), key=lambda r: (r.conv, r.part)):
        out.setdefault(r.conv, []).append(r.rendered)
    end = "\n<|end|>\n"
    assert out[1] == [f"<|user|>\nWhat is it?\nIt is large.{end}", f"<|assistant|>\nA: a lake.\n\nIt is cold.{end}", f"<|user|>\nThanks{end}"]
    assert out[2] == [f"<|user|>\nQuestion: is it so?{end}"] and out[3] == [f"<|user|>\nhello{end}", f"<|assistant|>\nGood day{end}"]
    assert len(out[4]) == 1 and len(out[5]) == 1


def test_sentencepiece(docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    rows = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    for chunk in (pieces.CHUNK, 700):
        out = pieces.decode(pieces.encode(clash(rows), chunk=chunk)).collect()
        assert len(out) == len(texts)
        for r in out:
            assert r.ids == sp.encode(texts[r.doc]), (r.doc, chunk)
            assert r.text == texts[r.doc] and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert pieces.encode(empty).count() == 0


@pytest.mark.parametrize("most", [None, 2000])
def test_sentencepiece_groups_of_odd_texts(most):
    """Line ends and spaces in all places; with a cache that holds a few words only, too."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    enc, rng = pieces.Encoder(pieces.Vocabulary(pieces.model_path())), random.Random(3)
    enc.words.most = most or enc.words.most
    texts = ["".join(rng.choice(["a", "the", "Été", "\u2581", " ", " ", " ", "\n", "中", "\t", "q" * 70]) for _ in range(rng.randrange(12))) for _ in range(1500)]
    texts += ["one two\nthree\n\nfour", "\n", " ", "", "\u2581", "x\n", "\r\nx"]
    for a in range(0, len(texts), 300):
        found = enc.texts(pa.array(texts[a : a + 300]))
        assert [np.frombuffer(x, "<u4").tolist() for x in found] == [sp.encode(x) for x in texts[a : a + 300]]
        assert most is None or len(enc.words.row) < 100


def test_sentencepiece_workers_stay_small(spark, tmp_path):
    """Workers that encode and decode 240,000 mostly distinct words each: what they hold when idle."""
    measured = lambda: spark.range(0, 8, 1, 8).mapInArrow(worker_memory, "pid long, now long, peak long").toPandas().groupby("pid").max()
    letters = F.translate(F.hex(F.xxhash64("id", "x")), "0123456789ABCDEF", "abcdefghijklmnop")
    word = spark.range(0, 2400, 1, 4).select("id", F.explode(F.sequence(F.lit(1), F.lit(400))).alias("x")).select("id", F.substring(letters, 1, 7).alias("w"))
    texts = word.groupBy("id").agg(F.concat_ws(" ", F.collect_list("w")).alias("text"))
    texts.select(F.col("id").alias("doc_id"), "text").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    before = measured()
    assert pieces.op10_sentencepiece(spark, str(tmp_path)).filter("n_ids > 400 AND decoded_sha256 IS NOT NULL AND ids_crc32 >= 0").count() == 2400
    grown = measured()[["now", "peak"]].sub(before.now, axis=0).dropna()
    assert len(grown) and grown.now.max() < 70, grown


def test_digests_are_of_whole_texts(spark, tmp_path):
    spark.createDataFrame([(1, "a\n" * 3, "en", "s", 1), (2, None, "en", "s", 1)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in line_dedup.op1_line_dedup(spark, str(tmp_path)).collect()}
    assert out[1].kept_sha256 == hashlib.sha256(b"a\n" * 3).hexdigest() and out[2].kept_sha256 == hashlib.sha256(b"").hexdigest()
