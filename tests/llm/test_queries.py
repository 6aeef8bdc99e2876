"""The registered queries over whole small tables: against their SQL, brute force, the public libraries or held-out labels."""

import hashlib
import html
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from terravec.llm import chat, langid, packing, pieces, toxicity
from terravec.llm.queries import ORACLES, QUERIES
from tests.oracle import SMALL, duck, same

MIDDLE = "/root/testdata/sf0.01"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def documents():
    return duck("SELECT * FROM documents ORDER BY doc_id")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(ASCII))
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = np.array([xxhash.xxh64_intdigest(x.encode(), 42) for x in s], dtype=np.uint64)
    return sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(s)) if s else 0


def linked(ids, near):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if near(i, j) and find(i) != find(j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_simhash(spark, documents):
    got = {r.doc_id: r for r in QUERIES["op7_simhash"](spark, SMALL).collect()}
    fps = {i: fingerprint(t) for i, t in zip(documents.doc_id, documents.text, strict=True)}
    assert {i: f"{f:016x}" for i, f in fps.items()} == {i: r.fingerprint for i, r in got.items()}
    assert linked(sorted(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2) == {i: r.component_id for i, r in got.items()}


def test_packing(spark, documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    got = QUERIES["op4_packing"](spark, SMALL).toPandas()
    want = []
    for i, text in zip(documents.doc_id, documents.text, strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a : a + 2048]
            want.append((i, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))) == sorted(want)
    s = got.sort_values(["sequence_id", "offset"])
    assert (s.offset == s.groupby("sequence_id").length.cumsum() - s.length).all() and s.groupby("sequence_id").length.sum().max() <= 2048
    counts = np.bincount(got.length, minlength=2049)
    assert got.sequence_id.nunique() <= sum(packing.best_fit_decreasing(counts).values())


def test_sentencepiece(spark, documents):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    got = {r.doc_id: r for r in QUERIES["op10_sentencepiece"](spark, SMALL).collect()}
    for i, text in zip(documents.doc_id, documents.text, strict=True):
        ids = sp.encode(text or "")
        assert (got[i].n_ids, got[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_html(spark):
    got = {r.page_id: r for r in QUERIES["op9_html"](spark, SMALL).collect()}
    pages = duck("SELECT page_id, html FROM pages")
    assert len(got) == len(pages)
    for i, page in zip(pages.page_id, pages.html, strict=True):
        parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", page, re.S)[1])
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " ")))).strip() for p in parts]
        assert got[i].text == "\n\n".join(p for p in parts if p) and got[i].n_chars == len(got[i].text)


def test_language_on_held_out_texts(spark):
    got = QUERIES["op3_langid"](spark, MIDDLE).filter("held_out").toPandas().merge(duck("SELECT doc_id, lang FROM documents", MIDDLE))
    assert len(got) > 200 and (got.lang == got.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()


def test_toxicity_on_held_out_texts(spark):
    big = "/root/testdata/sf0.1"
    got = QUERIES["op2_toxicity"](spark, big).filter("held_out").toPandas().merge(duck("SELECT doc_id, toxic FROM labels", big))
    assert got.score.between(0, 1).all()
    toxic, clean = got[got.toxic == 1], got[got.toxic == 0]
    assert toxic.predicted.mean() > 0.7 and clean.predicted.mean() < 0.03


def test_roles_on_held_out_conversations(spark):
    got = QUERIES["op8_chat"](spark, MIDDLE).filter("held_out").toPandas().merge(duck("SELECT conv_id, turn, role FROM conversations", MIDDLE))
    assert (got.role == got.role_recovered).mean() > 0.9


def plain_score(model, text):
    """A text's toxicity, n-gram by n-gram."""

    def weight(gram):
        v = 0
        for byte in gram:
            v = (v * 0x01000193 & 0xFFFFFFFF) ^ byte
        v = (v ^ v >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
        return float(model.per_gram[(v ^ v >> 13) % toxicity.BUCKETS])

    words = [b" " + w + b" " for w in re.findall(rb"[a-z\x80-\xff]+", text.lower().encode())]
    means = [np.mean([weight(w[k : k + n]) for n in toxicity.SIZES for k in range(len(w) - n + 1)] or [0.0]) for w in words]
    best = max((np.mean(means[k : k + toxicity.WINDOW_WORDS]) for k in range(0, len(means), toxicity.WINDOW_WORDS)), default=0.0)
    return 1 / (1 + np.exp(-(best + model.bias)))


def test_toxicity_scores(spark, documents):
    model = toxicity.train(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"), where=~toxicity.held_out())
    got = {r.doc_id: r for r in QUERIES["op2_toxicity"](spark, SMALL).collect()}
    assert len(got) == len(documents)
    for i, text in zip(documents.doc_id, documents.text, strict=True):
        assert abs(got[i].score - plain_score(model, text or "")) < 1e-6 and got[i].predicted == int(got[i].score >= 0.7)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_toxicity_slices():
    rng = np.random.default_rng(2)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS).astype(np.float32), 0.1)
    text = " ".join("".join(map(chr, rng.integers(97, 123, int(rng.integers(1, 12))))) for _ in range(4000)) + " " + "x" * 3000
    pieces_of = [b"".join(part) for part, _ in toxicity._parts([text], 500)]
    assert b"".join(pieces_of).decode() == text and len(pieces_of) > 20
    best = [toxicity.window_means(toxicity.grams(part), model.per_gram).max() for part, _ in toxicity._parts([text], 500)]
    assert abs(max(best) - toxicity.window_means(toxicity.grams([text.encode()]), model.per_gram).max()) < 1e-9


def test_language_predictions(spark, documents):
    """The net's convolutions window by window, without folded tables."""
    net = langid.train(spark.read.parquet(f"{SMALL}/documents.parquet"), where=~langid.held_out())
    got = {r.doc_id: r for r in QUERIES["op3_langid"](spark, SMALL).collect()}
    for i, text in zip(documents.doc_id, documents.text, strict=True):
        if not any(c.isalpha() for c in text or ""):
            assert got[i].lang_pred == "und" and got[i].score == 0
            continue
        raw = text.lower().encode()
        total = np.zeros(len(net.classes))
        for a in range(0, len(raw), langid.WINDOW):
            x = np.frombuffer(raw[a : a + langid.WINDOW].ljust(langid.WINDOW, b"\0"), np.uint8)
            h = np.concatenate([np.stack([net.emb[x[k : k + w]].reshape(-1) @ kernel for k in range(len(x) - w + 1)]).max(axis=0) + b for w, kernel, b in zip(langid.WIDTHS, net.kernels, net.offsets, strict=True)])
            z = np.maximum(h, 0) @ net.out + net.bias
            letters = sum(97 <= c <= 122 or c >= 128 for c in x.tolist()) + 1e-3
            total += letters * (z - z.max() - np.log(np.exp(z - z.max()).sum()))
        weight = sum(97 <= c <= 122 or c >= 128 for c in raw) + 1e-3 * -(-len(raw) // langid.WINDOW)
        p = np.exp(total / weight - (total / weight).max())
        p /= p.sum()
        assert abs(got[i].score - p.max()) < 1e-3 and (got[i].lang_pred == net.classes[int(p.argmax())] or np.sort(p)[-2] > p.max() - 1e-3)


def test_roles(spark):
    """Viterbi over each whole conversation at once."""
    turns = duck("SELECT conv_id, turn, text FROM conversations ORDER BY conv_id, turn")
    m = chat.fit(chat.labelled_sample(spark.read.parquet(f"{SMALL}/conversations.parquet"), ~chat.held_out(), "conv_id", "turn", "role", "text"))
    got = {(r.conv_id, r.turn): r for r in QUERIES["op8_chat"](spark, SMALL).collect()}
    assert len(got) == len(turns)
    for conv, part in turns.groupby("conv_id"):
        roles = chat.viterbi(m, np.array([chat.features(t) for t in part.text]), None, True, None)
        for turn, text, k in zip(part.turn, part.text, roles, strict=True):
            rendered = chat.render(m.roles[k], text)
            assert got[conv, turn].role_recovered == m.roles[k] and got[conv, turn].rendered_sha256 == hashlib.sha256(rendered.encode()).hexdigest()


def test_pipeline_takes_any_table(spark, tmp_path):
    """Nulls, empty texts, repeated rows, clashing columns and empty tables through all stages."""
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    good = " ".join(f"word{k * k % 97} and more" for k in range(40))
    rows = [(1, good, "en", "s", 5), (1, good, "en", "s", 5), (2, good, "en", "s", 5), (3, None, None, None, None), (4, "", "en", "s", 0), (None, good + " once", "en", "s", 5), (6, "one " * 60_000, "en", None, 1)]
    mine = ("_h", "_lines", "_row", "_toxicity", "_id", "_text", "_n", "_key", "own", "lines", "ends", "kept_text", "n_lines", "salt", "doc", "text_hash", "component")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("mine") for c in mine})
    for some in (docs, docs.limit(0)):
        now = some
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, str(tmp_path))
            assert now.columns == docs.columns and now.filter(" OR ".join(f"{c} <> 'mine'" for c in mine)).count() == 0
        assert sorted(str(r.doc_id) for r in now.collect()) == ([] if some is not docs else ["1", "2", "None"])  # 2 lost its only line, and is the one empty text
        assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() == (3 if some is docs else 0)


def test_pipeline(spark, documents):
    """Each stage against brute force over what it gets; the stages' decisions reach the end."""
    docs, frames = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL).persist()
        frames.append(docs.toPandas())
    tox, good, lines, unique, packed = frames
    for f in frames[:-1]:
        assert list(f.columns) == list(documents.columns)
    model = toxicity.train(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"))
    flagged = {i for i, t in zip(documents.doc_id, documents.text, strict=True) if plain_score(model, t or "") >= toxicity.FLAG_AT}
    assert set(tox.doc_id) == set(documents.doc_id) - flagged
    con = duckdb.connect()
    con.register("documents", tox)
    judged = con.sql(ORACLES["op6_quality"]).df()
    assert set(good.doc_id) == set(judged[judged.kept].doc_id) and set(lines.doc_id) == set(good.doc_id)
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(ASCII)
    first, many = {}, {}
    for i, text in sorted(zip(good.doc_id, good.text, strict=True)):
        for line in text.split("\n"):
            if len(strip(line)) >= 10:
                first.setdefault(strip(line), i)
                many.setdefault(strip(line), set()).add(i)
    for i, text in zip(good.doc_id, good.text, strict=True):
        kept = [x for x in text.split("\n") if len(strip(x)) < 10 or len(many[strip(x)]) < 2 or first[strip(x)] == i]
        row = lines[lines.doc_id == i].iloc[0]
        assert row.text == "\n".join(kept) and row.n_chars == len(row.text)
    fps = {i: fingerprint(t) for i, t in zip(lines.doc_id, lines.text, strict=True)}
    root = linked(sorted(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    assert set(unique.doc_id) == {i for i in fps if root[i] == i}
    assert set(packed.doc_id) == set(unique.doc_id)
    assert corpus_pipeline.run(spark, SMALL).count() == len(packed)
