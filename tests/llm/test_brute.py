"""Operators against brute force, exact round trips and held-out accuracy."""

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from harness import differences
from hypothesis import example, given, settings
from hypothesis import strategies as st

from siltstone.llm import components, decontaminate, huffman, mainhtml, maxent, mixing, quality, registry, simhash, topk, toxicity, urlfilter

PATH = public_tokenizers.path("word_bpe_49k.json")


# 1 ---------------------------------------------------------------------------
def test_tokens_round_trip(spark, docs, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in huffman.token_output(docs, PATH).collect()}
    blocks, codes = huffman.write_tokens(docs, PATH)
    again = [spark.read.parquet(t._siltstone_path) for t in (blocks, codes)]  # the files alone
    ids = {r.doc_id: r.ids for r in huffman.read_tokens(*again, "ids").collect()}
    at = 0
    for i, text in sorted(zip(texts.doc_id, texts.text)):
        want = tok.encode(text or "", add_special_tokens=False).ids + [1]
        assert ids[i] == want
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60))
def test_word_encoder(text):
    coder = huffman.encoder(PATH)
    assert np.frombuffer(coder.encode(text.encode()), coder.width).tolist() == coder.whole.encode(text, add_special_tokens=False).ids


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=2, max_size=40), st.integers(6, 16))
def test_code_lengths(counts, limit):
    counts = np.array(counts)
    n = huffman.code_lengths(counts, limit)
    used = n[counts > 0].astype(int)
    assert n.max(initial=0) <= limit and (n[counts == 0] == 0).all()
    if len(used) > 1:
        assert (0.5**used).sum() == 1.0
    rng = np.random.default_rng(0)
    if len(used):
        ids = rng.choice(np.flatnonzero(counts), 700)
        names, sizes, back = huffman.decode_block(huffman.encode_block(ids, [5, None], np.array([300, 400]), n, huffman.canonical_codes(n)), huffman.decode_table(n))
        assert names == [5, None] and sizes.tolist() == [300, 400] and (back == ids).all()


# 2 ---------------------------------------------------------------------------
def test_language_model(docs, texts):
    got = {r.doc_id: r for r in maxent.scored(docs).collect()}
    split = {i: [*(t or "").encode().lower().split(), maxent.END] for i, t in zip(texts.doc_id, texts.text)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in split}
    counts = Counter(w for i, ws in split.items() if not held[i] for w in ws)
    n, v = counts.total(), len(counts)
    for i, ws in split.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(w in counts for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
    for h in (True, False):
        assert sum(r.score for r in got.values() if r.held_out == h) > sum(r.base_score for r in got.values() if r.held_out == h)


def test_probabilities_sum_to_one(docs):
    """Over all words that occur and one unknown word of each key, after any history."""
    texts = docs.selectExpr("doc_id", "false as held_out", "cast(coalesce(text, '') as binary) as text")
    v = maxent.vocabulary(maxent.counted(texts))
    coded = maxent.encoded(texts, v)
    model = maxent.trained(coded, maxent.Model(v, maxent.contexts(coded)), v.tokens)
    assert v.distinct == len(v.id)
    every = model.outputs.astype(np.uint16)
    for before in ([], [b"the"], [b"the", b"and"]):
        own = [np.r_[v.ids(before), w].astype(np.uint16) for w in every] if before else [np.array([w], np.uint16) for w in every]
        log = np.concatenate([model.score(own[k : k + 2000])[3] for k in range(0, len(own), 2000)])
        base = model.score([v.ids(before)])[3][0] if before else 0.0
        assert (10 ** (log - base)).sum() == pytest.approx(1.0, abs=1e-3)


def slow_log_probability(model, ids) -> list[float]:
    """Token by token, node by node, in plain Python numbers."""
    out = []
    u32 = lambda x: x & 0xFFFFFFFF
    for k, w in enumerate(ids):
        one, two = (ids[k - j] + 1 if k >= j else maxent.NONE + 1 for j in (1, 2))
        skip = next((ids[j] + 1 for j in range(k - 1, -1, -1) if ids[j] < maxent.CONTEXTS and ids[j] != model.end), maxent.NONE + 1)
        features = [u32(one * 0x9E3779B1), u32(one * 0x85EBCA77) ^ u32(two * 0xC2B2AE3D) ^ 0x27D4EB2F, u32(skip * 0x165667B1) ^ 0x5BD1E995]
        log = -math.log(model.shared[w] and math.exp(model.shared[w]) or 1.0)
        for at in range(model.start[w], model.start[w] + model.depth[w]):
            node = int(model.node[at])
            s = model.bias[node].astype(float)
            for f in features:
                h = u32((f ^ u32(node * 0x9E3779B1)) * 0x85EBCA6B)
                h = u32((h ^ h >> 15) * 0xC2B2AE35)
                s = s + model.weights[h >> 32 - maxent.ROW_BITS]
            log += s[model.child[at]] - math.log(np.exp(s).sum())
        out.append(log)
    return out


@pytest.fixture(scope="module")
def coded(spark):
    """The first 4,000 documents of the larger tables as ids, with their vocabulary, split and words."""
    path = "/root/testdata/sf0.1/documents.parquet"
    rows = pd.read_parquet(path).head(4000)
    docs = spark.createDataFrame(rows[["doc_id", "text"]]).selectExpr("doc_id", f"pmod(crc32(cast(cast(doc_id as string) as binary)), {maxent.FOLDS}) = {maxent.HELD_OUT} as held_out", "cast(coalesce(text, '') as binary) as text")
    v = maxent.vocabulary(maxent.counted(docs.where("not held_out")))
    return rows, v, maxent.written(maxent.encoded(docs, v), "coded")


def witten_bell(train: list[list[bytes]], test: list[list[bytes]]) -> float:
    """Held-out log10 a token of a bigram model that backs off to the smoothed unigram."""
    count, pairs, before, kinds = Counter(), Counter(), Counter(), Counter()
    for ws in train:
        count.update(ws)
        for a, b in zip([b"", *ws], ws):
            kinds[a] += (a, b) not in pairs
            pairs[a, b] += 1
            before[a] += 1
    n, v = count.total(), len(count)
    one = lambda w: (count[w] + 1) / (n + v + 1)
    logs = [math.log10((pairs[a, b] + kinds[a] * one(b)) / (before[a] + kinds[a]) if before[a] else one(b)) for ws in test for a, b in zip([b"", *ws], ws)]
    return sum(logs) / len(logs)


def test_held_out_gain(coded):
    """The model beats the unigram and a Witten-Bell bigram on held-out text, with one learner and with 32, and in several rounds."""
    rows, v, table = coded
    split = [maxent.tokens_of((t or "").encode()) for t in rows.text]
    held = [zlib.crc32(str(i).encode()) % maxent.FOLDS == maxent.HELD_OUT for i in rows.doc_id]
    test = [ws for ws, h in zip(split, held) if h]
    bigram = witten_bell([ws for ws, h in zip(split, held) if not h], test)
    counts = Counter(w for ws, h in zip(split, held) if not h for w in ws)
    far = sum(math.log10(counts[w] + 1) for ws in test for w in ws if w not in v.id)
    n = sum(map(len, test))
    unigram = sum(math.log10((counts[w] + 1) / (v.tokens + v.distinct + 1)) for ws in test for w in ws) / n
    contexts = maxent.contexts(table)
    got = {}
    for learners, rounds in ((1, 1), (32, 1), (32, 4)):
        model = maxent.trained(table.repartition(learners, "row"), maxent.Model(v, contexts), v.tokens, learners, rounds)
        got[learners, rounds] = (sum(model.score([v.ids(ws) for ws in test])[3]) + far) / n
    print(f"unigram {unigram:.3f}, Witten-Bell {bigram:.3f}, model by (learners, rounds) {got}")
    assert unigram < bigram - 0.2
    assert got[1, 1] > bigram + 0.15 and min(got.values()) > bigram + 0.08
    assert min(got.values()) > got[1, 1] - 0.15  # learners of 43,000 tokens each; LEARN is 100 times as much
    some = [v.ids(ws)[:60] for ws in test[:8]]
    slow = [sum(slow_log_probability(model, [int(x) for x in ids])) / math.log(10) for ids in some]
    assert model.score(some)[3] == pytest.approx(slow, rel=1e-4)


def test_long_text_keeps_its_history(coded):
    """Batches of a long text score it as one batch does."""
    rows, v, table = coded
    model = maxent.trained(table, maxent.Model(v, maxent.contexts(table)), v.tokens)
    ids = np.concatenate([v.ids(maxent.tokens_of((t or "").encode()))[:-1] for t in rows.text[:60]])
    whole = model.log_likelihood(ids, maxent.history(ids, np.zeros(len(ids), int), model.end)).sum()
    assert len(ids) > 3 * maxent.BATCH and model.score([ids])[3][0] * math.log(10) == pytest.approx(whole, rel=1e-6)


# 3 ---------------------------------------------------------------------------
def test_main_text():
    page = """<html><head><title>T</title></head><body><nav><a href=x>Menu</a></nav><header>Site</header>
    <article><h1>Head &amp; line</h1><p>First   <b>bold</b> text.<p>Second<br>text.</p><aside>no</aside><div class="comments"><p>reader</p></div></article>
    <div id="sidebar">side</div><form>f</form><script>var a="<p>x</p>"</script><footer>foot</footer></body></html>"""
    assert mainhtml.main_text(page) == "Head & line\n\nFirst bold text.\n\nSecond text."


def test_main_text_without_article():
    body = "This is a long sentence of the kind that is found in the text of an article and it has many of the words that stop. " * 3
    page = f"<body><div><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div><div>{body}</div><div>Short one.</div><div>{body}</div><ul><li><a href=x>Link</a></li></ul></body>"
    got = mainhtml.main_text(page).split("\n\n")
    assert got == [body.strip(), "Short one.", body.strip()]


# 4, 10: SQL --------------------------------------------------------------------
@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_equals_sql(name, spark, sf):
    assert differences(registry.QUERIES[name](spark, sf), registry.ORACLE[name], sf) == []


def test_url_collisions(tmp_path, monkeypatch):
    rules = [("block", f"h{k}.example", "/p/") for k in range(50)]
    monkeypatch.setattr(urlfilter.xxhash, "xxh64_intdigest", lambda n: len(n) % 3)  # nearly all digests are equal
    (tmp_path / "x.idx").write_bytes(urlfilter.build(rules))
    index = urlfilter.Index(str(tmp_path / "x.idx"))
    assert (index.find([f"h{k}.example/p/".encode() for k in range(50)]) >= 0).all() and (index.find([b"h99.example/p/", b"hx.example/p/"]) < 0).all()


def test_many_url_rules(tmp_path):
    """A hundred thousand rules, many of one host; against all rules one by one."""
    rng = np.random.default_rng(4)
    rules = [(("block", "allow")[k % 2], f"h{k % 3000}.d{k % 700}.example" if k % 3 else "hot.example", "/" + "ab"[k % 2] * (k % 40) + f"/{k}") for k in range(100_000)]
    (tmp_path / "x.idx").write_bytes(urlfilter.build(rules))
    index = urlfilter.Index(str(tmp_path / "x.idx"))
    parts = [(h if k % 2 else f"www.{h}", p + "tail" * (k % 3)) for k, (_, h, p) in enumerate(rules[i] for i in rng.integers(0, len(rules), 150))] + [("", ""), ("none.example", "/x"), ("hot.example", "/")]
    by_host: dict = {}
    for v, h, p in rules:
        by_host.setdefault(h, {})[p] = v
    got = urlfilter.judge_batch(parts, index)
    for (host, path), rule, verdict in zip(parts, *got):
        fits = [(len(h + p), h + p, v) for h, own in by_host.items() if host == h or host.endswith("." + h) for p, v in own.items() if path.startswith(p)]
        want = max(fits, default=(0, None, urlfilter.DEFAULT))
        assert (rule, verdict) == (want[1], want[2])
    with pytest.raises(ValueError):
        urlfilter.build([("block", "a.co", "m")])


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 30), st.sampled_from([6, 20, 64]))
def test_topk_shard(seed, k, ones):
    rng = np.random.default_rng(seed)
    found = np.unique(rng.integers(0, 2 ** min(ones, 63), 400, dtype=np.uint64))
    sizes = rng.integers(1, 4, len(found))
    queries = np.r_[found[:7] ^ np.uint64(5), rng.integers(0, 2**63, 3, dtype=np.uint64)]
    bound = rng.integers(0, 65, len(queries))
    which, places, near = topk.Shard(found).search(queries, k, sizes, bound)
    for j, q in enumerate(queries):
        d = np.bitwise_count(found ^ q).astype(int)
        order = np.sort(np.repeat(d, sizes))
        far = min(order[min(k, len(order)) - 1], bound[j])
        mine = which == j
        assert sorted(places[mine].tolist()) == np.flatnonzero(d <= far).tolist() and (near[mine] == d[places[mine]]).all()


def test_topk_shards_agree(spark, sf):
    rows = topk.codes(spark.read.parquet(f"{sf}/embeddings.parquet"))
    asked = rows.where("id % 20 = 0")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(topk.nearest(rows, asked, 5)) == key(topk.nearest(rows, asked, 5, shard=40, block=3))
    twice = asked.unionByName(asked.selectExpr("id + 1000000 as id", "code"))  # other ids of the same codes
    got = topk.nearest(rows, twice, 5, shard=40)
    assert got.where("query_id < 1000000").count() * 2 == got.count() and key(got.where("query_id < 1000000")) == key(topk.nearest(rows, asked, 5))


# 5, 8 ------------------------------------------------------------------------
@pytest.mark.parametrize(("name", "column", "least"), [("op5_quality", "quality", 0.95), ("op8_toxicity", "toxic", 0.95)])
def test_held_out_accuracy(name, column, least, spark):
    sf = "/root/testdata/sf0.01"
    got = registry.QUERIES[name](spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    held = got[got.held_out & got[column].isin([0, 1])]
    assert len(held) > 50 and (held.predicted == held[column]).mean() >= least


def test_kernel_is_a_scalar_product_of_subsequences():
    def brute(s):
        out = Counter()
        for i in range(len(s)):
            for j in range(i + 1, min(len(s), i + 2 + toxicity.GAP)):
                for k in range(j + 1, min(len(s), j + 2 + toxicity.GAP)):
                    out[s[i] + s[j] + s[k]] += toxicity.DECAY ** (k - i + 1 - toxicity.P)
        return out

    words = ["^stupid$", "^stuupid$", "^st-pid$", "^table$"]
    made = [brute(w) for w in words]
    dot = lambda a, b: sum(v * b[k] for k, v in a.items())
    want = [[dot(a, b) / math.sqrt(dot(a, a) * dot(b, b)) for b in made] for a in made]
    assert np.allclose(toxicity.kernel(words, words), want, atol=1e-3)


def test_gapped_insults_are_tolerated():
    rng = np.random.default_rng(1)
    fine = ["".join(rng.choice(list("abcdefghilmnorstu"), rng.integers(3, 9))) for _ in range(400)]
    rows = []
    for k in range(300):
        ws = list(rng.choice(fine, 30))
        if k % 3 == 0:
            ws[5:5] = ["wretchling", "grimwort"]
        rows.append((" ".join(ws).encode(), int(k % 3 == 0)))
    m = toxicity.learn(rows)
    said = lambda t: m.score(m.judge([t.encode()]))[0]
    clean = " ".join(fine[:30])
    for insult in ("wretchling", "wretch-ling", "w r e t c h l i n g", "wreetchling", "WRETCHLING!!"):
        assert said(f"{clean} {insult} {insult}") > said(clean) + 0.2
    assert said(clean) < toxicity.CUT


def test_ranker_learns_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 22))
    y = (x[:, 3] + 0.2 * rng.normal(size=400) > 0).astype(int)
    r = quality.Ranker(x, y)
    assert ((r.score(x) >= quality.CUT) == (y == 1)).mean() > 0.9 and 0 < r.quantile < 1


# 6 ---------------------------------------------------------------------------
def slow_fingerprint(text: str) -> int:
    w = [x for x in text.encode().lower().split()]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def slow_components(fps: dict[int, int], tau: int) -> dict[int, int]:
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= tau:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_near_duplicates(docs, texts):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fps = {i: slow_fingerprint(t or "") for i, t in zip(texts.doc_id, texts.text)}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == fps
    assert {i: r.component_id for i, r in got.items()} == slow_components(fps, 4)


def test_links_of_large_buckets(spark):
    """Chains of fingerprints a few bits apart, in buckets far above the block size."""
    rng = np.random.default_rng(3)
    fps = {0: 0}
    for i in range(1, 300):
        base = fps[int(rng.integers(0, i))] if rng.random() < 0.8 else int(rng.integers(0, 2**63)) * 2
        for b in rng.choice(64, rng.integers(1, 7), replace=False):
            base ^= 1 << int(b)
        fps[i] = base
    rows = spark.createDataFrame([(i, int(np.uint64(f).view(np.int64))) for i, f in fps.items()], "doc_id long, fp long")
    plan = simhash.choose_plan(rows)
    assert sum(t + 1 for _, t in plan) >= simhash.TAU + 1  # generalised pigeonhole: thresholds sum to tau - m + 1
    want = slow_components(fps, 4)
    for block in (8, 2048):
        edges = simhash.links(rows.select("fp").distinct(), plan, 4, block)
        found = {r.node: r.component for r in components.components(edges).collect()}
        groups: dict = {}
        for i, f in fps.items():
            s = int(np.uint64(f).view(np.int64))
            groups.setdefault(found.get(s, s), set()).add(want[i])
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_distances_of_counted_keys(spark):
    """Shares by all pairs, of correlated bits too; and the counts of Spark."""
    rng = np.random.default_rng(6)
    keys = rng.integers(0, 2, 500) * 0b110110 ^ rng.integers(0, 8, 500)
    want = np.bincount(np.bitwise_count(keys[:, None] ^ keys[None]).ravel(), minlength=7) / 500**2
    assert np.allclose(simhash.distances(np.bincount(keys, minlength=64)), want)
    fps = spark.createDataFrame([(int(k) << 7,) for k in keys], "fp long")
    block = tuple(range(7, 13))
    assert simhash.key_counts(fps, [block])[block].tolist() == np.bincount(keys, minlength=64).tolist()


def test_components_of_a_star_and_a_path(spark):
    edges = [(0, k) for k in range(1, 400)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5), (1000, 1001)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(400)} | {1000 + k: 1000 for k in range(61)}


# 7 ---------------------------------------------------------------------------
def test_leaks_against_all_pairs(spark, sf, docs, texts):
    items = pd.read_parquet(f"{sf}/benchmark.parquet")
    index = decontaminate.build([(int(i), t.encode()) for i, t in zip(items.item_id, items.text)])
    want = set()
    for i, t in zip(texts.doc_id, texts.text):
        ids = np.array([index.vocabulary.get(w, -1) for w in decontaminate.terms((t or "").encode())], dtype=np.int64)
        for k, name in enumerate(index.names):
            both, question, answer = decontaminate.overlaps(index, k, ids)
            if both >= decontaminate.SIMILAR and question >= decontaminate.QUESTION and answer >= decontaminate.ANSWER:
                want.add((int(i), name))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert got == want and want


def test_wand_retrieves_all(sf):
    items = pd.read_parquet(f"{sf}/benchmark.parquet")
    index = decontaminate.build([(int(i), t.encode()) for i, t in zip(items.item_id, items.text)])
    rng = np.random.default_rng(0)
    for _ in range(200):
        own = index.words[rng.integers(len(index.words))]
        query = np.unique(np.concatenate([own[rng.random(len(own)) < 0.8], rng.choice(len(index.vocabulary), 10)]))
        scores = np.zeros(len(index.names))
        for t in query:
            at, x = index.postings[t]
            scores[at] += x
        assert {i for i, _ in decontaminate.retrieve(index, query)} == set(np.flatnonzero(scores >= decontaminate.THETA - 1e-9).tolist())


def test_several_passes_equal_one(spark, sf, docs, monkeypatch):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    key = lambda df: sorted((r.doc_id, r.item_id, round(r.score, 9), r.overlap) for r in df.collect())
    once = key(decontaminate.leaks(docs, items))
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 3000)
    assert key(decontaminate.leaks(docs, items)) == once and once


def test_many_items_and_a_long_text(monkeypatch):
    """20,000 items and a text of 200,000 words take bounded memory, and what is found doesn't depend on how much is looked at at once."""
    import tracemalloc

    rng = np.random.default_rng(5)
    name = [b"w%d" % k for k in range(30_000)]
    items = [(k, b" ".join(name[int(x)] for x in rng.zipf(1.3, 30) % 30_000)) for k in range(20_000)]
    index = decontaminate.build(items)
    words = [name[int(x)] for x in rng.zipf(1.3, 200_000) % 30_000]
    for k in (17, 4711, 19_999):
        words[k * 9 : k * 9] = items[k][1].split()
    text = b" ".join(words)
    tracemalloc.start()
    ids = np.array([index.vocabulary.get(w, -1) for w in decontaminate.terms(text)], dtype=np.int64)
    passing = decontaminate._passing(index, ids, decontaminate.THETA)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
    monkeypatch.setattr(decontaminate, "PAIRS", 1 << 30)
    whole = 30_000 // index.half - 1  # passages that end before the cut
    some = decontaminate._passing(index, ids[:30_000], decontaminate.THETA)
    assert some[some < whole].tolist() == passing[passing < whole].tolist()
    for k in (17, 4711, 19_999):
        at = k * 9 // index.half
        assert {at - 1, at, at + 1} & set(passing.tolist())


# 9 ---------------------------------------------------------------------------
@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 6), min_size=1, max_size=6), st.integers(0, 300))
@example({22: 6, 20: 6, 1: 4}, 252)
def test_fit_is_the_nearest_sum(counts, budget):
    took = mixing.fit(counts, budget)
    assert all(0 <= took.get(s, 0) <= n for s, n in counts.items())
    sums = {0}
    for s, n in counts.items():
        sums = {x + s * k for x in sums for k in range(n + 1)}
    assert sum(s * n for s, n in took.items()) == max(x for x in sums if x <= budget)


def test_mix(docs, texts):
    got = mixing.mix(docs).toPandas()
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert sorted(zip(got.doc_id, got.taken)) == sorted(zip(again.doc_id, again.taken))
    sizes = {i: len((t or "").encode().split()) for i, t in zip(texts.doc_id, texts.text)}
    assert all(sizes[i] == s for i, s in zip(got.doc_id, got["size"])) and (got.taken <= 3 * got["size"]).all()
    merged = got.merge(texts[["doc_id", "source"]], on="doc_id")
    for source, rows in merged.groupby("source"):
        assert rows.source_size.iloc[0] == rows["size"].sum()
        assert abs(rows.taken.sum() - rows.target.iloc[0]) <= max(2, 0.01 * rows.target.iloc[0])
    assert mixing.targets({"a": 10, "b": 10, None: 1000}) == pytest.approx({"a": 30, "b": 30, None: 960})
