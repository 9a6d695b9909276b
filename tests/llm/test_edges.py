"""Nulls, empty and very long texts, repeated rows, empty tables and clashing column names."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerweave.llm import decontamination, html_extract, language_id, lm_scoring, packing, quality, quality_rules, simhash_dedup, token_counts, toxicity
from ledgerweave.llm.common import stored
from ledgerweave.llm.tokens import WORD_BPE, word_tokenizer

LONG = " ".join(f"word{k}" for k in range(30_000))
PROSE = "the quick brown fox jumps over the lazy dog and runs along the river bank to the old stone bridge where nobody waits"
ROWS = [(1, PROSE, "en"), (1, PROSE, "en"), (2, None, None), (3, "", "en"), (None, PROSE, "de"), (4, LONG, None), (5, " \t\n", "en"), (6, PROSE.replace("fox", "cat"), "en"), (7, "123 !!", "fr")]
CLASH = ("text_key", "first_times", "first_id", "first_key", "language", "quality_score", "removed", "key", "print", "size", "node", "a", "b", "c.d", "row", "hash", "score", "kept", "rank", "chunk", "root", "block", "file", "words", "fingerprint", "component_id", "times", "limit", "html")


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").withColumn("source", F.when(F.col("doc_id") == 3, None).otherwise("s")).withColumn("n_chars", F.length("text").cast("long"))
    return base.withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (None, 1, 1), (4, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")


def test_packing(docs, none):
    out = packing.pack(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out if r.piece == 0) == sorted((d is None, d or 0) for d, _, _ in ROWS)
    assert {r.length for r in out if r.doc_id in (2, 3, 5)} == {1}
    assert packing.pack(none).count() == 0


def test_packing_plan():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 2049, 50_000)
    histogram = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
    planned = packing.plan(histogram)
    used: dict[int, int] = {}
    for content, times in planned:
        assert sum(content) <= 2048
        for v in content:
            used[v] = used.get(v, 0) + times
    assert used == histogram
    assert sum(t for _, t in planned) <= 1.003 * max((lengths > 1024).sum(), lengths.sum() / 2048)
    assert sum(t for _, t in packing.plan({3: 10**12})) == -(-(10**12) // 682)
    assert packing.plan({}) == []


def test_tokenizer_equals_whole_texts():
    tok = word_tokenizer(WORD_BPE)
    for text in ["It's the DOG's 12½ ends, don't!", "naïve Ünïcödé ÀÉ ŒUVRE", "a\x1cb\x85c\xa0d", "中文 and ΑΣ Σ", "“quoted” – dash…", "<|endoftext|> x", "é combined", ""]:
        assert np.frombuffer(tok.ids(text), "<u4").tolist() == tok.tokenizer.encode(text, add_special_tokens=False).ids


def test_lm(docs, none):
    for learn in (docs, none):
        model, counts = lm_scoring.gather(learn.select("doc_id", "text"))
        model = lm_scoring.train(model, learn.select("doc_id", "text"))
        out = lm_scoring.score(docs, model, counts).collect()
        assert len(out) == len(ROWS)
        assert {r.n_tokens for r in out if r.doc_id in (2, 3, 5)} == {1}
        assert all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in out)
        assert lm_scoring.score(none, model, counts).count() == 0


def test_lm_is_normalised(docs):
    model, _ = lm_scoring.gather(docs.select("doc_id", "text"))
    model = lm_scoring.train(model, docs.select("doc_id", "text"))
    near, far, bias, norm = model.tables()
    for a, b in [(0, 0), (3, 700), (lm_scoring.START, lm_scoring.START)]:
        assert np.exp(near[a] + far[b] + bias - norm[a, b]).sum() == pytest.approx(1, rel=1e-4)
    assert 10 ** model.inside()[lm_scoring.END + 1] == pytest.approx(model.class_tokens[0] + model.class_words[0] + 1)


def test_classifiers(docs, none, labels):
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        for learn in (docs, none):
            model = module.train(learn, labels, label)
            out = module.score(docs, model, "found").collect()
            assert len(out) == len(ROWS)
            assert all(0 <= r.found <= 1 for r in out)
            assert module.score(none, model, "found").count() == 0
    kept = quality.accept(docs, labels)
    assert kept.columns == docs.columns


def test_language(docs, none):
    parser = language_id.train(docs)
    out = language_id.predict(docs, parser).select("doc_id", "language.*").collect()
    assert {r.lang_pred for r in out if r.doc_id in (2, 3, 5, 7)} == {"und"}
    assert {r.lang_pred for r in out if r.doc_id == 1} <= {"en", "de"}
    empty = language_id.train(none)
    assert {r.lang for r in language_id.predict(docs, empty).select("language.lang_pred").toDF("lang").collect()} == {"und"}


def test_phrases_are_longest_matches():
    parser = language_id.Parser.fit({"a": ["abcabd"], "b": ["dcba"]})
    count, sizes = parser.phrases(["abcabd", "abdabc", ""])
    assert count[0].tolist()[0] == 1
    assert count[1].tolist()[0] == 2
    assert sizes.tolist() == [6, 6, 0]

    def brute(text, reference):
        n, at = 0, 0
        while at < len(text):
            k = 1
            while at + k < len(text) and text[at : at + k + 1] in reference:
                k += 1
            n, at = n + 1, at + k
        return n

    rng = np.random.default_rng(3)
    make = lambda n: "".join(rng.choice(list("abcd"), n))
    reference = make(300)
    parser = language_id.Parser.fit({"x": [reference]})
    for text in (make(200), make(500), make(3000), "ab" * 900, "a" * 2000, "x" * 700, make(600) + "é" * 3 + make(700)):
        coded = "".join(map(chr, language_id.symbols(text, parser.letters)))
        own = "".join(map(chr, language_id.symbols(reference, parser.letters)))
        assert parser.phrases([text])[0][0, 0] == brute(coded, own)


def test_phrases_over_many_blocks(monkeypatch):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abcé"), n)) for n in (0, 1, 30, 400, 900)] + ["abc" * 200, "a" * 333, "\u4e2d\u6587" * 50]
    parser = language_id.Parser.fit({"x": ["".join(rng.choice(list("abc"), 500)) + "a" * 40 + "abc" * 9], "y": ["\u4e2d\u6587\u5b57" * 9]})
    whole = parser.phrases(texts)[0].tolist()
    for block, wave in ((7, 3), (16, 1), (5, 1000)):
        monkeypatch.setattr(language_id, "BLOCK", block)
        monkeypatch.setattr(language_id, "WAVE", wave)
        assert parser.phrases(texts)[0].tolist() == whole
    assert language_id.Parser.fit({"a": ["\u4e2d" * 30 + "abc" * 40], "b": ["\u6587" * 30 + "abc" * 40]}).predict(["\u4e2d" * 9, "\u6587" * 9])[0] == ["a", "b"]


PAGES = [
    ("<p>One &amp; two</p><p>three<br>four  five</p>", ["One & two", "three four five"]),
    ("<ul><li>a<li>b</ul><!-- <p>no</p> --><script>var t='</p>';</script><p title='x>y'>c", ["a", "b", "c"]),
    ("text <b>bold</b><i>er</i> end<div>next", ["text bolder end", "next"]),
    ("<p>unclosed <a href=x", ["unclosed <a href=x"]), ("", []), ("<style>p{}</style>", []), ("<textarea><p>no</p></textarea>yes", ["yes"]),
]


@pytest.mark.parametrize(("html", "want"), PAGES)
def test_blocks(html, want):
    assert [b.text for b in html_extract.blocks_of(html)] == want


def test_extraction(spark):
    model = html_extract.train(250)
    made = html_extract.Layouts(99)
    pages = [p for p in (made.labelled() for _ in range(150)) if p]
    found, truth = np.concatenate(model.labels([p for p, _ in pages])), np.concatenate([y for _, y in pages])
    assert ((found >= 0.5) == truth).mean() > 0.97
    rows = spark.createDataFrame([(1, None), (2, ""), (None, "<article><p>Some prose stands here, for once.</p></article>"), (2, "")], "page_id long, html string")
    out = html_extract.extract(rows, model).collect()
    assert sorted(len(r.text) > 0 for r in out) == [False, False, False, True]
    assert html_extract.extract(rows.limit(0), model).count() == 0


def test_token_scan(spark, docs, none):
    flat = stored(token_counts.write_flat(docs, block_tokens=7))
    assert token_counts.scan(flat).count() == len(ROWS)
    assert token_counts.scan(token_counts.write_flat(none)).count() == 0
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 4, 200).astype("<u2")
    cut = spark.createDataFrame([("f", k, bytearray(ids[s : s + 9].tobytes())) for k, s in enumerate(range(0, 200, 9))] + [("g", 0, None)], "file string, block int, tokens binary")
    out = sorted((r.document, r.start, r.n_tokens, r.terminated) for r in token_counts.scan(cut, end=3).collect())
    ends = np.flatnonzero(ids == 3)
    starts = [0, *(ends + 1)]
    want = [(k, s, e - s, True) for k, (s, e) in enumerate(zip(starts, ends, strict=False))]
    if starts[-1] < 200:
        want.append((len(ends), starts[-1], 200 - starts[-1], False))
    assert out == want


def test_raw_files(spark, tmp_path):
    ids = np.array([5, 6, 9, 7, 9, 9, 1], "<u2")
    (tmp_path / "t.bin").write_bytes(ids.tobytes())
    blocks = token_counts.read_raw(spark, str(tmp_path), block_tokens=2)
    assert sorted((r.document, r.n_tokens, r.terminated) for r in token_counts.scan(blocks, end=9).collect()) == [(0, 2, True), (1, 1, True), (2, 0, True), (3, 1, False)]


def test_passages(spark, docs, none):
    items = spark.createDataFrame([(1, " ".join(PROSE.split()[3:14])), (1, " ".join(PROSE.split()[3:14])), (2, "lazy dog"), (3, None), (4, "!!"), (None, "stone bridge"), (5, "unseen words")], "item_id long, text string")
    out = decontamination.digest(decontamination.find_passages(docs, items)).collect()
    assert len(out) == len(ROWS)
    by = {r.doc_id: r for r in out}
    assert (by[1].n_hit, by[1].n_items, by[1].contaminated) == (13, 2, True)
    assert (by[6].n_hit, by[6].n_items) == (12, 2)  # the ten words after the changed one are a window; two more are the item without id
    assert (by[2].n_words, by[2].contaminated) == (0, False)
    assert decontamination.find_passages(none, items).count() == 0
    assert not any(r.contaminated for r in decontamination.digest(decontamination.find_passages(docs, items.limit(0))).collect())
    clean = decontamination.drop_contaminated(docs, items)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == [2, 3, 4, 5, 7]


def test_rules(docs, none):
    out = quality_rules.judge(docs).collect()
    assert len(out) == len(ROWS)
    assert {r.base_failed for r in out if r.doc_id != 4} == {True}
    assert quality_rules.judge(none).count() == 0
    kept = quality_rules.apply_rules(docs)
    assert kept.columns == docs.columns
    assert [r.doc_id for r in kept.collect()] == [4]


def test_boilerplate_lines(spark):
    line = "please accept our cookies and read the terms of this site before you go on reading here " * 8
    rows = [(k, f"{line}\n" + " ".join(f"own{k}x{j}" for j in range(60 if k % 2 else 6)), "h") for k in range(60)]
    copies = [(1000 + k, "\n".join(" ".join(f"copied{a}x{j}" for j in range(20)) for a in range(5)), "h") for k in range(60)]
    docs = spark.createDataFrame(rows + copies, "doc_id long, text string, source string")
    docs = docs.withColumn("text", F.regexp_replace("text", "(please .*?here )+", " ".join(f"common{j}" for j in range(120))))
    out = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert all(out[1000 + k].kept for k in range(60))
    assert {out[k].kept for k in range(1, 60, 2)} == {True}
    assert {out[k].kept for k in range(0, 60, 2)} == {False}
    assert all("common" not in r.text for r in quality_rules.apply_rules(docs).where("doc_id < 1000").collect())


def test_lines_of_a_template_count_every_document(spark):
    def line(name, n):
        return " ".join(f"{name}x{j}" for j in range(n))

    shared = {"wide": [line(f"wide{a}", 20) for a in range(6)], "few": [line(f"few{a}", 20) for a in range(6)]}
    pages = [(k, [*shared["wide"], line(f"short{k}", 9)]) for k in range(40)] + [(100 + k, [*shared["wide"], *(line(f"own{k}x{a}", 10) for a in range(9))]) for k in range(5)]
    pages += [(200 + k, [*shared["few"], line(f"rare{k % 20}", 9)]) for k in range(60)]
    rows = [(d, "\n".join(x.upper() + "  " if d % 3 else x for x in lines), "h") for d, lines in pages]
    holders = {}
    for _, lines in pages:
        for x in lines:
            holders.setdefault(x, set()).add(tuple(lines))
    gone = {x for x, held in holders.items() if len(held) > 20}
    want = {d: 100 * sum(len(x.split()) for x in lines if x not in gone) >= 30 * sum(len(x.split()) for x in lines) for d, lines in pages}
    assert gone == set(shared["wide"])
    assert set(want.values()) == {True, False}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id: r.kept for r in quality_rules.judge(docs).collect()} == want


def test_boilerplate_does_not_depend_on_the_size_of_the_host(spark):
    banner = " ".join(f"banner{j}" for j in range(60))
    hosts = ("copied", "large", "small", "rare")
    rows = [(100 * a + k, f"{banner}\nown{k % 20 if host == 'rare' else k}", host) for a, host in enumerate(hosts) for k in range(25)]
    rows += [(1000, "copy", "copied")] * 6000 + [(1000, f"text{k}", "large") for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = quality_rules.judge(docs).where("doc_id < 1000").collect()
    kept = {host: {r.kept for r in out if r.doc_id // 100 == a} for a, host in enumerate(hosts)}
    assert kept == {"copied": {False}, "large": {False}, "small": {False}, "rare": {True}}


def test_near_duplicates(docs, none):
    prints = stored(simhash_dedup.fingerprints(docs))
    out = simhash_dedup.near_duplicates(prints).collect()
    assert len(out) == len(ROWS)
    assert {r.component_id for r in out if r.doc_id in (2, 3, 5)} == {2}
    assert simhash_dedup.near_duplicates(stored(simhash_dedup.fingerprints(none))).count() == 0
    kept = simhash_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) in ([1, 2, 4, 6, 7], [1, 2, 4, 7])


def test_near_copies(spark, docs, none):
    kept = simhash_dedup.deduplicate_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 6, 7]  # one word in 23 changes more than a fifth of the shingles
    assert simhash_dedup.deduplicate_near_copies(none).count() == 0
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(5000)]
    rows, group = [], []
    for base in range(12):
        text = list(rng.choice(words, int(rng.integers(60, 400))))
        for _ in range(4):
            changed = list(text)
            for at in rng.integers(0, len(text), len(text) // 120):
                changed[at] = "other"
            rows.append((len(rows), " ".join(changed)))
            group.append(base)
    for tile in (1000, 5):
        prints = stored(simhash_dedup.wide_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(0).cast("long"))))
        distinct = stored(prints.withColumn("node", F.col("doc_id")).select("node", "print", "size"))
        roots = {r.node: r.root for r in simhash_dedup.components(simhash_dedup.wide_links(distinct, tile=tile)).collect()}
        found = {d: roots.get(d, d) for d, _ in rows}
        assert all((found[a] == found[b]) == (group[a] == group[b]) for a in found for b in found)
    again = simhash_dedup.deduplicate_near_copies(spark.createDataFrame(rows + rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in again.collect()) == list(range(0, 48, 4))


def test_majority_bits():
    rng = np.random.default_rng(9)
    for n in (0, 1, 2, 254, 255, 256, 700, 17_000):
        hashes = rng.integers(0, 2**63, (n, 2)).astype(np.uint64)
        want = [sum(1 << b for b in range(64) if 2 * int((hashes[:, k] >> np.uint64(b) & np.uint64(1)).sum()) > n) for k in range(2)]
        assert simhash_dedup._majority(hashes).tolist() == want


def test_tiles():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 3000).astype(np.uint64)
    prints = np.unique(np.concatenate([base, base[:400] ^ np.uint64(5), base[:100] ^ np.uint64(1 << 40)]))

    def roots(links):
        parent = np.arange(len(prints))
        simhash_dedup._join_components(parent, *(np.searchsorted(prints, x) for x in links))
        return parent

    plain = simhash_dedup.tile_links(prints, prints, 3)
    before, simhash_dedup.PLAIN_PAIRS = simhash_dedup.PLAIN_PAIRS, 0
    fine = simhash_dedup.tile_links(prints, prints, 3)
    simhash_dedup.PLAIN_PAIRS = before
    assert (roots(plain) == roots(fine)).all()
    i, j = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3)
    assert (roots(plain) == roots((prints[i], prints[j]))).all()


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(100)] + [(500, 501)], "u long, v long")
    assert {r.node: r.root for r in simhash_dedup.components(edges).collect()} == {**dict.fromkeys(range(1, 101), 0), 501: 500}
