"""The registered queries against brute force, over whole small tables."""

from __future__ import annotations

import math
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerweave.llm import decontamination, html_extract, lm_scoring, packing, quality, quality_rules, registry, token_counts, toxicity

SF_DIR = "/root/testdata/sf0.001"
BIGGER = "/root/testdata/sf0.01"


def docs_of(sf_dir=SF_DIR):
    return {d: t or "" for d, t in zip(*(pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"])[c].to_pylist() for c in ("doc_id", "text")), strict=True)}


def run(spark, name, sf_dir=SF_DIR):
    return registry.QUERIES[name](spark, sf_dir).collect()


def encode(text):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return tok.encode(text, add_special_tokens=False).ids


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def test_packing(spark):
    rows = run(spark, "op1_best_fit_packing")
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, {})[r.piece] = r
    docs = docs_of()
    assert set(pieces) == set(docs)
    for doc_id, text in docs.items():
        ids = [*encode(text), 0]
        parts = [ids[k : k + 2048] for k in range(0, len(ids), 2048)]
        assert sorted(pieces[doc_id]) == list(range(len(parts)))
        for k, part in enumerate(parts):
            r = pieces[doc_id][k]
            assert (r.start, r.length, r.ids_crc32) == (2048 * k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    spans = {}
    for r in rows:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in rows)
    large = sum(r.length > 1024 for r in rows)
    assert len(spans) <= 1.02 * max(large, math.ceil(total / 2048)) + 1


def test_lm_scoring(spark):
    rows = {r.doc_id: r for r in run(spark, "op2_lm_scoring", BIGGER)}
    docs = docs_of(BIGGER)
    tokens = {d: [*words(lower(t)), None] for d, t in docs.items()}
    counts = Counter(w for d, ws in tokens.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    gain = {True: 0.0, False: 0.0}
    for d, ws in tokens.items():
        r = rows[d]
        assert r.held_out == (zlib.crc32(str(d).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        gain[r.held_out] += r.score - r.base_score
    assert gain[True] > 0
    assert gain[False] > 0


def test_lm_scores_equal_plain_sums(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    model, counts = lm_scoring.gather(docs)
    model = lm_scoring.train(model, docs)
    r1, r2, q, b = (x.astype(np.float64) for x in model.parameters)
    classes = {w: k if k < lm_scoring.HEAD_WORDS else lm_scoring.tail_class(w) for k, w in enumerate(model.words)}
    inside = {}
    count = Counter(w.encode() for t in docs_of().values() for w in words(lower(t)))
    for w, n in count.items():
        if classes.get(w, lm_scoring.tail_class(w)) > lm_scoring.END:
            inside[lm_scoring.tail_class(w)] = inside.get(lm_scoring.tail_class(w), 1) + n + 1
    found = {r.doc_id: r.score for r in lm_scoring.score(docs, model, counts).collect()}
    for d, text in sorted(docs_of().items())[:12]:
        one = two = lm_scoring.START
        total = 0.0
        for w in [*(x.encode() for x in words(lower(text))[:400]), None][: 401 if len(words(text)) <= 400 else 0]:
            c = lm_scoring.END if w is None else classes.get(w, lm_scoring.tail_class(w))
            raw = (r1[one] + r2[two]) @ q.T + b
            total += (raw[c] - np.log(np.exp(raw - raw.max()).sum()) - raw.max()) / np.log(10)
            if c > lm_scoring.END:
                total += math.log10((count[w] + 1) / inside[c])
            one, two = c, one
        if len(words(text)) <= 400:
            assert found[d] == pytest.approx(total, rel=1e-4)


def test_special_token_strings(spark):
    texts = {1: "a <|endoftext|> b", 2: "<|startoftext|>x<|endoftext|>", 3: "plain <|EndOfText|> text", 4: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {r.doc_id: r for r in packing.pack(docs).collect()}
    for d, text in texts.items():
        ids = [*encode(text or ""), 0]
        assert (out[d].length, out[d].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert encode(texts[1]) == [320, 49407, 321]
    flat = token_counts.write_flat(docs)
    assert token_counts.scan(flat).where("terminated").count() == len(texts)  # no text can forge an end
    with pytest.raises(Exception, match="does not fit"):
        token_counts.write_flat(docs, dtype="<u1").collect()


def test_thresholds_come_from_held_out_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(k, " ".join(rng.choice(["fine", "day", "tree", "vile" if k % 3 == 0 else "calm"], 12)), "xy"[k % 2]) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k, _, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert set(model.thresholds) == {"x", "y"}
    scored = toxicity.score(docs, model)
    flagged = scored.withColumn("flagged", toxicity.flagged(model, "score", "lang")).collect()
    assert all(r.flagged == (r.score >= model.thresholds[r.lang]) for r in flagged)
    assert sum(r.flagged == (r.doc_id % 3 == 0) for r in flagged) > 570
    only = toxicity.train(docs, labels.where("toxic = 1"))
    assert only.thresholds == {}
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs.limit(5), only).collect())


def test_quality_reads_metadata(spark):
    rows = [(k, "the same words in all of them", "good" if k % 2 else "bad", float(k % 2) * 1e6, None) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string, size double, nothing string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(0, 400)], "doc_id long, quality int")
    for metadata in (("kind",), ("size",), ("kind", "size", "nothing")):
        model = quality.train(docs, labels, metadata=metadata)
        out = quality.score(docs, model).collect()
        assert min(r.score for r in out if r.doc_id % 2) > max(r.score for r in out if not r.doc_id % 2)
        assert len({r.score for r in out}) == 2  # ties
    plain = quality.score(docs, quality.train(docs, labels)).collect()
    assert len({r.score for r in plain}) == 1
    assert {r.score for r in quality.score(docs, quality.FactorisationMachine()).collect()} == {0.5}
    one = quality.score(docs, quality.train(docs, labels.where("quality = 1"))).collect()
    assert all(r.score > 0.9 for r in one)


def test_broken_pages_take_linear_time():
    for form in ("<a", '<a x="', "<a x='", "<!--", "<script>", "</script", "<div><p>", "<b>", "<td><div>", '<a x="\'>'):
        began = time.process_time()
        html_extract.blocks_of(form * (200_000 // len(form)))
        html_extract.blocks_of(form * (200_000 // len(form)) + ">")
        assert time.process_time() - began < 5
    deep = "<div>" * 500 + "<nav><p>menu</p></nav><p>text</p>" + "</div>" * 500 + "<p>after</p>"
    blocks = html_extract.blocks_of(deep)
    assert [b.text for b in blocks] == ["menu", "text", "after"]
    assert zlib.crc32(b"nav") % html_extract.PATH_BUCKETS in blocks[0].path
    assert zlib.crc32(b"div") % html_extract.PATH_BUCKETS not in blocks[2].path
    assert [b.text for b in html_extract.blocks_of("<p>let <math><mi>x</mi></math> be</p>")] == ["let x be"]


def test_repetitive_texts_and_many_blocks(spark):
    items = [(1, "w " * 300), (2, "a b c d e f g h i j k l"), (3, "x y"), (4, " ".join(f"n{k}" for k in range(400)))]
    texts = [(1, "w " * 5000), (2, "z a b c d e f g h i j k l z"), (3, "x y x y"), (4, " ".join(f"n{k}" for k in range(100, 130))), (5, "w " * 9), (6, None)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("__hash", F.lit("text"))
    for block_words in (2_000_000, 40):
        found = decontamination.find_passages(docs, benchmark, block_words=block_words)
        out = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontamination.digest(found).collect()}
        assert out == {1: (5000, 5000, 1), 2: (14, 12, 1), 3: (4, 4, 1), 4: (30, 30, 1), 5: (9, 0, 0), 6: (0, 0, 0)}
        clean = decontamination.drop_contaminated(docs, benchmark, block_words=block_words)
        assert sorted((r.doc_id, r["__hash"]) for r in clean.collect()) == [(5, "text"), (6, "text")]


def test_joined_benchmark_equals_indexed(spark):
    rng = np.random.default_rng(8)
    draw = lambda n: " ".join(rng.choice(list("abcdefghij"), n, p=[0.3, 0.2] + [0.0625] * 8))
    items = [(f"i{k}", draw(int(n))) for k, n in enumerate(rng.integers(0, 60, 40))] + [(None, "q r s"), ("x", None), ("i3", "a b"), ("i3", "a b"), ("é", "ünï \u4e2d c"), ("z", "w " * 40)]
    texts = [(k % 50, draw(int(n))) for k, n in enumerate(rng.integers(0, 200, 60))]
    texts += [(100, items[7][1]), (101, f"{draw(30)} {items[9][1]} {draw(30)}"), (102, None), (103, ""), (104, "Q r s; ÜNÏ ünï \u4e2d C"), (105, "w " * 700), (105, "w " * 700)]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("text_key", F.lit(1))
    one, other = (sorted(tuple(r) for r in decontamination.digest(decontamination.find_passages(docs, benchmark, block_words=n)).collect()) for n in (2_000_000, 1))
    assert one == other
    assert 5 < sum(r[5] for r in one) < len(texts)
    one, other = (sorted((r.doc_id, r.text or "", r.text_key) for r in decontamination.drop_contaminated(docs, benchmark, block_words=n).collect()) for n in (2_000_000, 1))
    assert one == other


@pytest.mark.parametrize(("name", "label", "least"), [("op3_toxicity", "toxic", 0.9), ("op7_quality_classifier", "quality", 0.97)])
def test_classifiers(spark, name, label, least):
    sf_dir = "/root/testdata/sf0.1"
    table = pq.read_table(f"{sf_dir}/labels.parquet").to_pydict()
    truth = dict(zip(table["doc_id"], table[label], strict=True))
    rows = run(spark, name, sf_dir)
    assert len(rows) == len(docs_of(sf_dir))
    cut = {"toxic": 0.5, "quality": 0.3}[label]
    for r in rows:
        assert 0 <= r.score <= 1
        assert r.predicted == (r.score >= cut)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    high = [r.score for r in rows if r.held_out and truth.get(r.doc_id) == 1]
    low = [r.score for r in rows if r.held_out and truth.get(r.doc_id) == 0]
    assert np.mean(np.array(high)[:, None] > np.array(low)[None, :]) > least


def test_language(spark):
    truth = dict(zip(*(pq.read_table(f"{BIGGER}/documents.parquet")[c].to_pylist() for c in ("doc_id", "lang")), strict=True))
    rows = [r for r in run(spark, "op4_language_id", BIGGER) if truth[r.doc_id]]
    held = [r for r in rows if r.held_out]
    assert {r.held_out for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1} == {True}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_html(spark):
    pages = pq.read_table(f"{SF_DIR}/pages.parquet").to_pydict()
    html = dict(zip(pages["page_id"], pages["html"], strict=True))
    rows = run(spark, "op5_html_extraction")
    assert len(rows) == len(html)
    good = 0
    for r in rows:
        assert r.n_chars == len(r.text)
        article = html[r.page_id].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(re.sub("<[^>]*>", " ", b).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        import html as entities

        good += r.text == "\n".join(entities.unescape(b) for b in blocks if b)
    assert good >= 0.97 * len(rows)


def test_token_counts(spark):
    rows = run(spark, "op6_token_counts")
    docs = docs_of()
    assert {r.doc_id: r.n_tokens for r in rows} == {d: len(encode(t)) for d, t in docs.items()}
    assert all(r.terminated for r in rows)


def test_decontamination_equals_sql(spark):
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"create view {name} as select * from read_parquet('{BIGGER}/{name}.parquet')")
    want = db.sql(decontamination.ORACLE_SQL)
    found = registry.QUERIES["op8_benchmark_decontamination"](spark, BIGGER)
    assert sorted(map(tuple, found.select(*want.columns).collect())) == sorted(want.fetchall())


def test_quality_rules(spark):
    docs = docs_of()
    for r in run(spark, "op9_quality_rules"):
        text = docs[r.doc_id]
        ws = words(text)
        lines = [x for x in text.split("\n") if words(x)]
        grams = Counter(zip(ws, ws[1:], ws[2:], strict=False))
        hit = {p for k, g in enumerate(zip(ws, ws[1:], ws[2:], strict=False)) if grams[g] > 1 for p in (k, k + 1, k + 2)}
        want = (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(ws) < 50 or 100 * len(hit) > 50 * len(ws))
        assert not (r.base_failed and r.kept)


def test_line_frequencies_equal_brute_force(spark, monkeypatch):
    table = pq.read_table(f"{BIGGER}/documents.parquet", columns=["doc_id", "text", "source"]).to_pylist()
    lines_of = {r["doc_id"]: [x for x in (" ".join(words(line.lower())) for line in (r["text"] or "").split("\n")) if x] for r in table}
    holders = {}
    for r in table:
        for line in lines_of[r["doc_id"]]:
            holders.setdefault((r["source"], line), set()).add(tuple(lines_of[r["doc_id"]]))
    limit = 2  # a limit that this table's shared lines exceed
    monkeypatch.setattr(quality_rules, "LINE_DOCUMENTS", limit)
    docs = spark.read.parquet(f"{BIGGER}/documents.parquet")
    for broadcast in (quality_rules.BROADCAST_LINES, 0):
        monkeypatch.setattr(quality_rules, "BROADCAST_LINES", broadcast)
        out = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
        texts = {r.doc_id: r.text for r in quality_rules.apply_rules(docs).collect()}
        removed = 0
        for r in table:
            d, lines = r["doc_id"], lines_of[r["doc_id"]]
            gone = {x for x in lines if len(holders[r["source"], x]) > limit}
            left = sum(len(x.split()) for x in lines if x not in gone)
            n = sum(len(x.split()) for x in lines)
            assert out[d].kept == (not out[d].base_failed and 100 * left >= 30 * n)
            assert len(out[d].removed) == len(gone)
            removed += len(gone)
            assert (d in texts) == out[d].kept
            if d in texts:
                want = [line for line in r["text"].split("\n") if " ".join(words(line.lower())) not in gone]
                assert texts[d].split("\n") == (want or [""])
        assert removed > 20


def fingerprint(text):
    ws = words(lower(text))
    shingles = [" ".join(ws[k : k + 3]) for k in range(max(1, len(ws) - 2))] if ws else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def shingles_of(text, k):
    ws = words(lower(text))
    return [" ".join(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))] if ws else []


def wide_fingerprint(text):
    hashes = {xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles_of(text, 5)}
    mask = (1 << 64) - 1

    def mixed(x):
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & mask
        return x ^ x >> 31

    out = []
    for k in range(8):
        own = [h if k == 0 else mixed((h + k * 0x9E3779B97F4A7C15) & mask) for h in hashes]
        bits = np.unpackbits(np.array(own, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * bits > len(own), bitorder="little").view("<u8")[0]) if own else 0)
    return out, len(hashes)


def test_simhash(spark):
    docs = docs_of()
    prints = {d: fingerprint(t) for d, t in docs.items()}
    root = {d: d for d in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in docs:
        for b in docs:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    for r in run(spark, "op10_simhash_near_dedup"):
        assert r.fingerprint == f"{prints[r.doc_id]:016x}"
        assert r.component_id == find(r.doc_id)


def test_pipeline(spark):
    import corpus_pipeline

    docs = docs_of(BIGGER)
    seen = spark.read.parquet(f"{BIGGER}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, BIGGER)
        assert out.columns == seen.columns
        seen = out.cache()
        kept[name] = {r.doc_id: r.text for r in seen.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert set(kept[names[3]]) <= set(kept[names[2]]) <= set(kept[names[1]]) <= set(kept[names[0]]) <= set(docs)
    before, left = kept[names[1]], set(kept[names[2]])
    wide = {d: wide_fingerprint(t) for d, t in before.items()}
    root = {d: d for d in before}
    sets = {d: set(shingles_of(t, 5)) for d, t in before.items()}
    alike = {}
    for x in sorted(before):
        for y in sorted(before):
            if x < y:
                (f, m), (g, n) = wide[x], wide[y]
                if 5 * min(m, n) >= 4 * max(m, n) and (f[0] ^ g[0]).bit_count() <= 18 and sum((p ^ q).bit_count() for p, q in zip(f, g, strict=True)) <= 87:
                    rx, ry = root[x], root[y]
                    root = {d: min(rx, ry) if r in (rx, ry) else r for d, r in root.items()}
                if m and 5 * min(m, n) >= 4 * max(m, n):
                    alike[x, y] = len(sets[x] & sets[y]) / len(sets[x] | sets[y])
    assert left == set(root.values())
    assert not [pair for pair, j in alike.items() if j >= 0.85 and set(pair) <= left]
    assert all(j > 0.6 for (x, y), j in alike.items() if y not in left and root[y] == x and sum(r == x for r in root.values()) == 2)
    packed = corpus_pipeline.run(spark, BIGGER).collect()
    assert {r.doc_id for r in packed} == set(kept[names[3]])
