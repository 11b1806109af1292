"""Corpus operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from papyrine.llm import ann, bloom, decontamination, html_main, jaccard_join, kernels, langid, line_dedup, packing, quality, sharding, toxicity

ODD = [None, "", "  \n\t ", "one", "a b c", "Ünïcödé ÀÉß ×÷ ÿŸ x", "12,345's it's DON'T <|endoftext|>", "日本語 テスト 😀 !!", "a\x1cb c", "x" * 3000, "word " * 9000, "Σς İI ﬁ"]
WORDS = [f"w{i}" for i in range(60)]


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def texts_with_copies(seed, n=60):
    rng = random.Random(seed)
    out = list(ODD)
    passage = " ".join(rng.choice(WORDS) for _ in range(30))
    for _ in range(n):
        base = [rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(rng.randrange(1, 120))]
        out.append(" ".join(base))
        if rng.random() < 0.6:
            for _ in range(rng.randrange(1, 5)):
                copy = list(base)
                for _ in range(rng.randrange(0, 4)):
                    copy[rng.randrange(len(copy))] = rng.choice(WORDS)
                out.append(" ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
        if rng.random() < 0.3:
            out.append(passage + " " + " ".join(base[:20]))
    return out


def test_words_and_shingles():
    texts = texts_with_copies(1)
    words = kernels.hash_words(*kernels.text_buffer(pa.array(texts)))
    assert words.counts().tolist() == [len((t or "").encode().split()) for t in texts]
    for text, own in zip(texts, kernels.shingle_sets(words, 4), strict=True):
        assert len(own) == len(shingles(text, 4))


def test_segments_do_not_change_hashes(monkeypatch):
    buffer = kernels.text_buffer(pa.array(texts_with_copies(2)))
    whole = kernels.hash_words(*buffer)
    monkeypatch.setattr(kernels, "_SEGMENT", 64)
    cut = kernels.hash_words(*buffer)
    assert (whole.hashes == cut.hashes).all() and (whole.first == cut.first).all()


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    reference = Tokenizer.from_file(path)
    docs = spark.createDataFrame(list(enumerate(ODD)) + [(3, "one"), (None, "x y")], "doc_id long, text string").withColumnRenamed("doc_id", "id").selectExpr("id as doc_id", "text", "1 as start", "2 as ids")
    rows = packing.pack(docs, path, window=64).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} == {0}
    for i, text in enumerate(ODD):
        wanted = reference.encode(text or "", add_special_tokens=False).ids + [2]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: (r.start, r.sequence_id))
        if i == 3:
            own = own[::2]
        assert [x for r in own for x in r.ids] == wanted and {r.doc_tokens for r in own} == {len(wanted)}
        for r in own:
            assert r.length == len(r.ids) == 1 << r.bucket <= 64 and r.ids == wanted[r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert packing.pack(docs.where("false"), path).count() == 0
    assert packing.piece_lengths(4096 * 2 + 5, 4096) == [4096, 4096, 4, 1]


def test_sharding_against_prefix_sums(spark):
    texts = texts_with_copies(3)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(5, "again", "x"), (None, "n", "x")], "doc_id long, text string, shard string").repartition(5)
    rows = sharding.shard_by_bytes(docs, shards=7, order_by=["doc_id", "text"]).collect()
    everything = sorted([(i, t) for i, t in enumerate(texts)] + [(5, "again"), (None, "n")], key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    sizes = [len((t or "").encode()) + 8 for _, t in everything]
    total, before, slots, wanted = sum(sizes), 0, {}, []
    for (i, t), size in zip(everything, sizes, strict=True):
        shard = min(6, before * 7 // total)
        wanted.append((i, t, size, shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
        before += size
    key = lambda r: (r[3], r[4])
    assert sorted(((r.doc_id, r.text, r["size"], r.shard, r.slot) for r in rows), key=key) == sorted(wanted, key=key)
    assert sharding.shard_by_bytes(docs.where("false"), shards=3).count() == 0


def test_bloom_misses_no_repeat():
    rng = np.random.default_rng(0)
    keys = kernels.mix(rng.integers(0, 1 << 62, 4000, dtype=np.uint64))
    parts = [bloom.partials(np.concatenate([keys[:1500], keys[2000:2200], keys[2000:2200]]), 2), bloom.partials(np.concatenate([keys[1000:2000], keys[3000:]]), 2)]
    merged = pa.Table.from_batches(parts).sort_by("slice").to_batches()
    bits = np.zeros(2 * bloom.SLICE_BITS // 8, np.uint8)
    for b in bloom._merge(iter(merged)):
        bits[b.column(0)[0].as_py() * bloom.SLICE_BITS // 8 :][: bloom.SLICE_BITS // 8] = np.frombuffer(b.column(1)[0].as_py(), np.uint8)
    seen = bloom.TwiceSeen(2, bits)
    assert seen.suspects(keys[1000:1500]).all() and seen.suspects(keys[2000:2200]).all()
    assert seen.suspects(keys[2200:3000]).mean() < 0.05


def line_key(line):
    key = line.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    return key if len(key) >= 10 else None


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_line_dedup_against_brute_force(spark, broadcast):
    rng = random.Random(4)
    pool = [f"A line number {i} of the pool é" for i in range(12)] + ["short", "", "\tA LINE number 3 of the pool é \r"]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 6)))) for i in range(40)] + [(40, None), (41, ""), (None, pool[0] + "\n" + pool[1]), (7, pool[2])]
    found = line_dedup.dedup_lines(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_lines int"), min_chars=10, min_docs=5, max_broadcast_bytes=broadcast)
    holders = {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            if (k := line_key(line)) is not None:
                holders.setdefault(k, set()).add(-1 if i is None else i)
    wanted = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if (k := line_key(x)) is None or len(holders[k]) < 5 or max(holders[k]) == (-1 if i is None else i)]
        wanted.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    rows = [(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in found.collect()]
    assert sorted(rows, key=str) == sorted(wanted, key=str)


def brute_components(rows, k, num, den):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and x and y and den * len(x & y) >= num * len(x | y):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return sorted(((i, len(x), None if i is None else root(i)) for i, x in sets), key=str)


@pytest.mark.parametrize("k, num, frequent, bound", [(4, 85, 2, 1), (2, 80, 64, 64)])
def test_jaccard_join_against_brute_force(spark, k, num, frequent, bound):
    rows = list(enumerate(texts_with_copies(5 + k))) + [(None, "one"), (3, "one two three four five")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = jaccard_join.link_components(docs, k=k, num=num, den=100, frequent=frequent, bound=bound)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()), key=str) == brute_components(rows, k, num, 100)


@pytest.mark.parametrize("size", list(jaccard_join.WIDTHS))
@pytest.mark.parametrize("num", [85, 80, 60])
def test_jaccard_index_shares_a_key_for_every_link(size, num):
    """Any two sets that link meet in the index, with every token frequent, rare or over the bound."""
    rng = np.random.default_rng(8)
    for trial in range(150):
        n = int(rng.integers(2, 200))
        base = np.unique(kernels.mix(rng.integers(0, 1 << 62, n, dtype=np.uint64)))
        other = base.copy()
        swap = rng.random(len(base)) < rng.choice([0.03, 0.07, 0.2])
        other[swap] = kernels.mix(rng.integers(0, 1 << 62, int(swap.sum()), dtype=np.uint64))
        other = np.unique(other)
        both = len(np.intersect1d(base, other))
        if 100 * both < num * (len(base) + len(other) - both):
            continue
        often = set(rng.choice(base, int(len(base) * rng.random()), replace=False).tolist())
        keys = []
        for own, theirs in ((base, set(other.tolist())), (other, set(base.tolist()))):
            low, high = own[own < jaccard_join._LOW_BOUND], own[own >= jaccard_join._LOW_BOUND]
            shared = np.array([t in theirs for t in low.tolist()], bool)
            common = np.array([t in often for t in low.tolist()], bool) & shared
            keys.append(set(jaccard_join.index_keys(len(own), int((~shared).sum()), low[shared & ~common], low[common], high, num, 100, size).tolist()))
        assert keys[0] & keys[1], trial
        a, b = jaccard_join.odd_sketch(base), jaccard_join.odd_sketch(other)
        assert sum(int(x).bit_count() for x in (a ^ b).view(np.uint64)) <= len(base) + len(other) - 2 * both


def test_jaccard_join_empty(spark):
    assert jaccard_join.link_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_decontamination_against_brute_force(spark):
    rng = random.Random(9)
    items = [(i, " ".join(rng.choice(WORDS) + rng.choice("xyz") for _ in range(rng.randrange(2, 80)))) for i in range(25)] + [(90, None), (91, ""), (92, "one"), (3, "three words here")]
    docs = list(enumerate(texts_with_copies(10)))
    for i in range(40):
        words = items[rng.randrange(25)][1].split()
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = "changed"
        docs.append((1000 + i, " ".join([rng.choice(WORDS) for _ in range(rng.randrange(0, 400))] + words + ["tail"] * rng.randrange(3)).upper()))
    frame = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, leaks string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (50_000, 9):
        found = decontamination.find_leaks(frame, bench, keep_clean=False, block_rows=block)
        rows = sorted((x.item_id, r.doc_id, x.shared) for r in found.collect() for x in r.leaks)
        wanted = sorted((i, d, len(s & shingles(t, 5))) for i, q in items for d, t in docs if (s := shingles(q, 5)) and 100 * len(s & shingles(t, 5)) >= 80 * len(s))
        assert rows == wanted
    leaking = {d for _, d, _ in wanted}
    assert {r.doc_id for r in decontamination.drop_leaking(frame, bench).collect()} == {d for d, _ in docs} - leaking
    assert decontamination.find_leaks(frame, bench.where("false")).count() == len(docs)


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 12)).astype(np.float32)
    x[100:400] = x[100]  # a hot vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 12), (2002, [float("nan")] * 12), (2003, [1.0]), (2004, [float("inf")] * 12), (2020, [None] * 12)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = ann.knn(frame, frame.where("vec_id % 20 = 0"), k=10, block_rows=200).collect()
    hits, wide = 0, x.astype(np.float64)
    by_query = {}
    for r in found:
        by_query.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by_query) == set(range(0, 1500, 20))
    for q, own in by_query.items():
        own.sort()
        scores = wide @ wide[q]
        scores[q] = -np.inf
        best = np.lexsort((np.arange(1500), -scores))[:10]
        hits += len({v for _, v, _ in own} & set(best.tolist()))
        assert [r for r, _, _ in own] == list(range(1, 11)) and q not in {v for _, v, _ in own}
        assert all(abs(s - scores[v]) < 1e-12 for _, v, s in own) and own == sorted(own, key=lambda r: (-r[2], r[1]))
    assert hits / (10 * len(by_query)) >= 0.9
    few = ann.knn(frame.where("vec_id < 3"), frame.where("vec_id = 0"), k=10).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
    assert ann.knn(frame.where("false"), frame, k=3).count() == 0


def labelled_texts(seed, n=400):
    rng = random.Random(seed)
    good, junk, toxic = [], [], []
    for _ in range(n):
        base = [rng.choice(WORDS) + "".join(rng.choices("abcdefgh", k=3)) for _ in range(rng.randrange(20, 80))]
        good.append(" ".join(base))
        junk.append(rng.choice([" ".join(w.upper() + "!!" for w in base), " ".join(w + "***" for w in base), " ".join([base[0]] * 50)]))
        spot = list(base)
        for _ in range(3):
            spot.insert(rng.randrange(len(spot)), rng.choice(["zorkle", "blimpad", "grumvex"]) + rng.choice(["", "s", "ish", "er"]))
        toxic.append(" ".join(spot))
    return good, junk, toxic


def scored(model, texts):
    return model.scores(*kernels.text_buffer(pa.array(texts, pa.string())))


def test_quality_held_out():
    good, junk, _ = labelled_texts(1)
    model = quality.train([(t.encode(), y) for pair in zip(good[:300], junk[:300], strict=True) for t, y in zip(pair, (1, 0), strict=True)])
    assert (scored(model, good[300:]) >= 0.7).mean() > 0.97 and (scored(model, junk[300:]) < 0.7).mean() > 0.97
    edge = scored(model, [None, "", " \n"])
    assert len(set(edge.tolist())) == 1 and 0 <= edge[0] <= 1
    assert ((scored(quality.train([]), ODD)) == 0.5).all()


def test_toxicity_held_out_with_unseen_forms():
    good, _, toxic = labelled_texts(2)
    model = toxicity.train([(t.encode(), y) for pair in zip(good[:300], toxic[:300], strict=True) for t, y in zip(pair, (0, 1), strict=True)])
    assert (scored(model, toxic[300:]) >= 0.7).mean() > 0.9 and (scored(model, good[300:]) < 0.7).mean() > 0.95
    misspelt = [g + " zorkl3 zorkler zorkleish" for g in good[300:]]
    assert (scored(model, misspelt) > 0.5).mean() > 0.6
    assert len(scored(model, ODD)) == len(ODD)


def test_language_held_out(spark):
    rng = random.Random(3)
    parts = {"xx": ["shu", "kai", "moro", "tan"], "yy": ["berg", "stein", "haus", "ung"], "zz": ["eau", "ment", "tion", "oux"]}
    make = lambda y: " ".join("".join(rng.choices(parts[y], k=rng.randrange(1, 4))) for _ in range(rng.randrange(1, 40)))
    sample = [(make(y).encode(), y) for _ in range(150) for y in parts]
    model = langid.train(sample)
    docs = spark.createDataFrame([(i, make(y), y, "c") for i, y in enumerate(list(parts) * 40)] + [(900, None, "xx", "c"), (901, "12 34 !!", "xx", "c"), (902, "", None, "c"), (903, "日本", None, "c")], "doc_id long, text string, lang string, score string")
    rows = langid.predict(docs, model).collect()
    assert np.mean([r.lang_pred == r.lang for r in rows if r.doc_id < 900]) > 0.95
    assert {r.doc_id: r.lang_pred for r in rows if r.doc_id >= 900 and r.doc_id != 903} == {900: "und", 901: "und", 902: "und"}
    assert next(r.lang_pred for r in rows if r.doc_id == 903) in parts and all(0 <= r.score <= 1 for r in rows)


PAGE = "<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><a href=/>Home</a></nav><div class='post-{}'><h1>Title &amp; more</h1><p>First\n  para <b>bold</b><br>line<p>Second<script>var a='</p>'</script><ul><li>x<li>y</ul><div class=comments>noise</div></div><footer>f</footer></body></html>"


@pytest.mark.parametrize("most", [200_000, 0])
def test_html_consensus(spark, most):
    pages = [(i, f"http://h{i % 2}.org/{i}", PAGE.replace("{}", str(i))) for i in range(8)] + [(8, None, PAGE), (9, "x", None), (10, "http://h0.org", ""), (11, "http://h0.org", "<p>only a paragraph"), (12, "http://h1.org/", "plain &lt;text&gt;")]
    rows = {r.page_id: r for r in html_main.main_text(spark.createDataFrame([(*p, 3) for p in pages], "page_id long, url string, html string, text int"), max_broadcast_bytes=most, salts=3).collect()}
    wanted = "Title & more\nFirst para bold line\nSecond\nx\ny"
    assert all(rows[i].text == wanted and rows[i].n_chars == len(wanted) for i in range(9))
    assert (rows[9].text, rows[10].text, rows[11].text, rows[12].text) == ("", "", "only a paragraph", "plain <text>")
    assert html_main.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_fold_matches_crc(spark):
    from papyrine.llm.samples import fold

    rows = spark.range(50).select("id", fold("id", 4).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 4 for r in rows)
