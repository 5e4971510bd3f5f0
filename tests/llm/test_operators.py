"""Every operator against brute force on small tables, and on hard cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sylva.llm import ann, class_lm, common, exact_dedup, jaccard, line_dedup, mixing, packing, quality, sharding, simhash, store, tok

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
HARD = [
    (1, "the quick brown fox jumps over the lazy dog today", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog today", "en", "a"),
    (3, "the  quick\tbrown fox jumps over the lazy\ndog today", None, "a"),
    (4, None, "en", None),
    (5, "", "de", "b"),
    (6, "   ", "de", "b"),
    (7, LONG, "en", "a"),
    (7, LONG, "en", "a"),
    (8, LONG + " end.", "en", "a"),
    (9, "É́ <|endoftext|> 'LL don't a.b,  x ²³ 中文 😀", "zh", "c"),
    (None, "an id is missing here, yes", "en", "a"),
    (10, "word", "en", "a"),
]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame([(*r, 0) for r in HARD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(4)
    vocab = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(400)]
    rows = []
    for i in range(300):
        lines = [" ".join(rng.choice(vocab, rng.integers(3, 14))) for _ in range(rng.integers(1, 9))]
        rows.append((i, "\n".join(lines) + ".", "en" if i % 3 else "fr", f"s{0 if i % 3 else i % 11}", 0))
    for i in range(300, 360):  # near and exact copies
        w = re.split("( |\n)", rows[i - 300][1])
        if i % 2:
            w[2 * int(rng.integers(0, len(w) // 2 + 1))] = "changed"
        rows.append((i, "".join(w), "en", "s0", 0))
    return spark.createDataFrame(rows, SCHEMA)


def ids_of(text, end):
    t = tok.encoder().tok
    return np.asarray([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def crc(ids):
    return zlib.crc32(ids.astype("<u4").tobytes())


@pytest.mark.parametrize("text", [r[1] for r in HARD if r[1] is not None] + ["don't stop!. a.b, c'll.", "İstanbul ΣΑΣ. ", "á. b́, ﬁ.", "☃ ☃. x☃", "1.,2., ²,"])
def test_word_ids_equal_whole_text_ids(text):
    e = tok.encoder()
    assert e.ids_bytes(text) == ids_of(text, 0)[:-1].tobytes()


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(tok, "MEMO_WORDS", 50)
    e = tok.WordEncoder(tok.tokenizer_path())
    for t in (LONG[:5000], "a b c", LONG[3000:9000]):
        assert e.ids_bytes(t) == ids_of(t, 0)[:-1].tobytes()


# -- 1
def test_ann(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 17))
    x[40:60] = x[0]
    rows = [(i, [float(v) for v in x[i]]) for i in range(1500)] + [(5000, None), (5001, [0.0] * 17), (5002, [float("nan")] * 17), (5003, [1.0] * 16 + [None]), (5004, [1.0]), (None, [1.0] * 17)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.search(d, d.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(1500), -s))[:20]
        assert len(found) == 20 and found == sorted(found, key=lambda p: (-p[1], p[0]))
        assert np.allclose([s[v] for v, _ in found], [p for _, p in found])
        hits += len(set(want) & {v for v, _ in found})
    assert hits >= 0.9 * 20 * len(got)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert ann.search(few, few.where("vec_id = 0")).count() == 2
    assert ann.search(few.limit(0), few.limit(0)).count() == 0


def test_anisotropic_codes_cost_less():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8))
    m = ann.fit(x, 400)
    r = x - m.centres[m.lists_of(x)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)

    def loss(codes):
        e = r - m.decoded(codes)
        return ((e**2).sum(1) + (m.eta - 1) * (e * u).sum(1) ** 2).mean()

    assert loss(ann.encode(x, r, m.books, m.eta)) <= loss(ann.encode(x, r, m.books, 1.0)) + 1e-9


# -- 2
def test_shards(docs, hard, empty):
    rows = sharding.assign_shards(docs, 8).collect()
    n = Counter(r.shard for r in rows)
    assert len(rows) == 360 and max(n.values()) - min(n.values()) <= 1 and set(n) == set(range(8))
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n[s]))
    total = Counter(r.source for r in rows)
    for s in range(8):
        for k, c in Counter(r.source for r in rows if r.shard == s).items():
            assert abs(c - total[k] / 8) <= 2.5
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.size == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in rows)
    got = sharding.assign_shards(hard, 40).collect()
    assert len(got) == len(HARD) and all(r.slot == 0 for r in got) and len({r.shard for r in got}) == len(HARD)
    assert [(r.size, r.text_crc32) for r in got if r.doc_id == 4] == [(16, 0)]
    assert sharding.assign_shards(empty).count() == 0


def test_written_shards(spark, hard, tmp_path):
    d = hard.withColumn("shard", F.lit("own")).withColumn("slot", F.lit(1)).unionByName(hard.where("doc_id is null").withColumn("shard", F.lit("own")).withColumn("slot", F.lit(2)))
    col = sharding.write_shards(d, str(tmp_path / "s"), 3)
    got = spark.read.parquet(str(tmp_path / "s"))
    assert col == "shard_" and got.columns == [*d.columns, col]
    assert sorted(map(str, got.drop(col).collect())) == sorted(map(str, d.collect()))
    assert {r[0]: r[1] for r in got.groupBy(col).count().collect()} == {0: 5, 1: 4, 2: 4}


# -- 3
def brute_base(rows):
    words = lambda t: [*(t or "").encode().lower().split(), b""]
    c = Counter(w for i, t, *_ in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1 for w in words(t))
    n, v = sum(c.values()), len(c)
    return {i: (len(words(t)), sum(c[w] > 0 for w in words(t)), n, sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t))) for i, t, *_ in rows}


def test_class_lm(spark, docs, hard, empty):
    for d in (docs, hard):
        rows = [tuple(r) for r in d.collect()]
        want = brute_base(rows)
        got = class_lm.score_documents(d, sweeps=2).collect()
        assert len(got) == len(rows)
        for r in got:
            w = want[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3] and abs(r.base_score - w[3]) < 1e-6 * abs(w[3])
            assert np.isfinite(r.score) and r.score < 0
    assert class_lm.score_documents(empty, sweeps=1).count() == 0


def test_class_probabilities_sum_to_one(docs):
    model, counts = class_lm.learn(docs.select("text"), 1)
    c = {bytes(r.w): r.n for r in counts.collect()}
    total = np.zeros(len(model.size))
    moved = {w: int(model.cls[k + 1]) for k, w in enumerate(model.moved)}
    for w, n in c.items():
        if not w:
            total[-1] += 1
        elif w in moved:
            total[moved[w]] += n / model.size[moved[w]]
        else:
            k = model.movable + class_lm.spelling(w)
            total[k] += (n - model.discount) / model.size[k]
    k = slice(model.movable, model.movable + class_lm.SPELLED)
    total[k] += np.where(model.size[k] > 0, 10**model.unseen, 1)
    assert np.allclose(total[model.size > 0], 1)
    assert np.allclose((10**model.transition).sum(1), 1)


def test_exchange_moves_to_the_best_class():
    rng = np.random.default_rng(0)
    v, k = 20, 4
    b, cls = rng.poisson(rng.gamma(0.3, 5, (v, v))), rng.integers(0, k, v)

    def m(c):
        out = np.zeros((k, k))
        np.add.at(out, (c[:, None].repeat(v, 1), c[None].repeat(v, 0)), b)
        return out

    for w in range(v):
        to = class_lm.best_class(int(cls[w]), np.bincount(cls, b[w], k), np.bincount(cls, b[:, w], k), int(b[w, w]), m(cls), k)
        values = [class_lm.likelihood(m(np.where(np.arange(v) == w, c, cls))) for c in range(k)]
        assert values[to] > max(values) - 1e-6


# -- 4
def word_distance_within_one(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) + (len(a) != len(b)) < line_dedup.LEAST_WORDS:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def brute_lines(rows):
    lines = sorted({(i, k, tuple(x.split())) for i, t, *_ in rows for k, x in enumerate((t or "").split("\n")) if x.split()})
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(lines)):
        for y in range(x):
            a, b = lines[x][2], lines[y][2]
            short = min(len(a), len(b)) < line_dedup.LEAST_WORDS
            if a == b or not short and word_distance_within_one(a, b):
                p, q = find(x), find(y)
                root[max(p, q)] = min(p, q)
    out = defaultdict(list)
    for x, (i, k, _) in enumerate(lines):
        if find(x) != x:
            out[i].append(k)
    return out


@pytest.mark.parametrize("most_keys", [line_dedup.MOST_KEYS, 4])
def test_lines(docs, most_keys):
    rows = [tuple(r) for r in docs.collect()]
    want = brute_lines(rows)
    got = {r.doc_id: r.dropped for r in line_dedup.dropped_lines(docs, most_keys=most_keys).collect()}
    assert len(got) == len(rows) and sum(map(len, want.values())) > 50
    assert {i: d for i, d in got.items() if d} == {i: sorted(d) for i, d in want.items()}


def test_lines_edits(spark, hard, empty):
    base = "one two three four five six seven"
    variants = [base, base.replace("four", "4"), base.replace("four ", ""), base + " eight", "zero " + base, base.replace("one two", "two one"), "a b c d", "a b c e", "x x x x x x", "x x x x x", base.replace("two", "2").replace("six", "6")]
    d = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(variants)], SCHEMA)
    got = sorted(r.doc_id for r in line_dedup.dropped_lines(d).collect() if r.n_dropped)
    assert got == [1, 2, 3, 4, 9]
    assert {r.doc_id: r.text for r in line_dedup.clean(d).collect()}[1] == ""
    assert line_dedup.dropped_lines(hard).count() == len(HARD) and line_dedup.dropped_lines(empty).count() == 0


# -- 5
def brute_fp(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if s and 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, distance=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return [find(x) for x in range(len(fps))]


def test_simhash(docs, hard, empty):
    rows = sorted(tuple(r)[:2] for r in docs.collect())
    fps = [brute_fp(t) for _, t in rows]
    comp = brute_components(fps)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert [got[i].fingerprint for i, _ in rows] == [f"{f:016x}" for f in fps]
    assert [got[i].component_id for i, _ in rows] == [rows[c][0] for c in comp]
    assert len(set(comp)) < len(rows)
    res = simhash.near_duplicates(hard).collect()
    assert len(res) == len(HARD) and {r.component_id for r in res if r.doc_id in (1, 2, 3)} == {1} and {r.component_id for r in res if r.doc_id in (4, 5, 6)} == {4}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.dedup(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted({rows[c][0] for c in comp}) and kept[0].__fields__ == docs.columns


@pytest.mark.parametrize("blocks", [5, 6, 7])
def test_links_in_hot_buckets(spark, monkeypatch, blocks):
    rng = np.random.default_rng(2)
    base = int(rng.integers(1 << 62))
    fps = {base}
    while len(fps) < 400:  # a large group of near copies, and strangers
        x = base
        for b in rng.integers(0, 64, rng.integers(1, 9)):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps | {int(x) for x in rng.integers(0, 1 << 63, 200)})
    monkeypatch.setattr(simhash, "blocks_for", lambda n, d: blocks)
    d = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    got = simhash.links(d, len(fps), chunk=64).collect()
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in got:
        a, b = (int(np.int64(v).view(np.uint64)) for v in r)
        assert (a ^ b).bit_count() <= 4
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    assert [find(f) for f in fps] == [fps[c] for c in brute_components(fps)]


# -- 6
def test_packing(docs, hard, empty):
    for d, cap in ((docs, 64), (hard, 4096), (hard, 7)):
        rows = d.collect()
        got = packing.pack_documents(d, cap).collect()
        ids = defaultdict(set)
        for r in rows:
            x = ids_of(r.text, 1)
            for k, a in enumerate(range(0, len(x), cap)):
                ids[r.doc_id].add((k, a, len(x[a : a + cap]), crc(x[a : a + cap])))
        assert {i: {(r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == i} for i in ids} == ids
        bins = defaultdict(list)
        for r in got:
            bins[r.sequence_id].append((r.offset, r.length))
        for b in bins.values():
            at = 0
            for o, n in sorted(b):
                assert o == at
                at += n
            assert at <= cap
    total = sum(r.length for r in packing.pack_documents(docs, 512).collect())
    assert len({r.sequence_id for r in packing.pack_documents(docs, 512).collect()}) <= 1.1 * total / 512 + 3
    assert packing.pack_documents(empty).count() == 0


def test_sum_of_squares_choice():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 20, 300)
    fast = packing.pack_sum_of_squares(lengths, 20)
    gaps, out = [], []
    for s in lengths.tolist():  # by the definition
        best = None
        for b, g in [*enumerate(gaps), (len(gaps), 20)]:
            if g < s:
                continue
            after = Counter(x for k, x in enumerate(gaps) if k != b and 0 < x < 20)
            if 0 < g - s < 20:
                after[g - s] += 1
            v = sum(c * c for c in after.values())
            key = (v, g, -b)
            if best is None or key[:2] < best[0][:2] or key[:2] == best[0][:2] and b > best[1]:
                best = key, b
        b = best[1]
        if b == len(gaps):
            gaps.append(20)
        gaps[b] -= s
        out.append(b)
    assert len(set(out)) == len(set(fast.tolist()))


# -- 7
def test_mixing(spark, docs, hard, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == 360 and all(0 < r.probability <= 1 for r in got)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.tokens == len(text[r.doc_id].split()) for r in got)
    cells = defaultdict(float)
    for r in got:
        cells[r.source, r.lang, r.topic] += r.tokens
    w = dict(cells)  # the same raking on plain dictionaries
    total = sum(cells.values())
    for _ in range(mixing.ROUNDS):
        old = dict(w)
        for d in range(3):
            m0, m = Counter(), Counter()
            for k in cells:
                m0[k[d]] += cells[k]
                m[k[d]] += w[k]
            s = sum(v**mixing.FLATTEN for v in m0.values())
            w = {k: min(w[k] * mixing.KEEP * total * m0[k[d]] ** mixing.FLATTEN / s / m[k[d]], cells[k]) for k in w}
        if max(abs(w[k] - old[k]) / old[k] for k in w) <= mixing.TOLERANCE:
            break
    assert all(abs(r.probability - w[r.source, r.lang, r.topic] / cells[r.source, r.lang, r.topic]) < 1e-9 for r in got)
    assert {r.doc_id for r in mixing.sample(docs).collect()} == {r.doc_id for r in got if r.kept}
    h = mixing.mix(hard).collect()
    assert len(h) == len(HARD) and {r.source for r in h if r.doc_id == 4} == {""} and mixing.mix(empty).count() == 0


def test_mixing_to_given_weights(spark):
    rows = [(i, "w " * (20 + i % 7), "en" if i % 4 else "de", "ab"[i % 2], 0) for i in range(2000)]
    d = spark.createDataFrame(rows, SCHEMA)
    want = {"source": {"a": 1.0, "b": 3.0}, "lang": {"en": 0.8, "de": 0.2}}
    _, cells = mixing.cells_of(d, "doc_id", "text", "source", "lang", None)
    targets = mixing.weighted_targets(cells, want, keep=None)
    got = {(r.dim, r.value): r for r in mixing.margins(mixing.rake(cells, targets, tolerance=1e-6), targets).collect()}
    total = sum(r.reached for k, r in got.items() if k[0] == "source")
    assert abs(got["source", "b"].reached / total - 0.75) < 1e-3 and abs(got["lang", "de"].reached / total - 0.2) < 1e-3
    assert all(r.reached <= r.tokens + 1e-6 for r in got.values())
    kept = Counter(r.source for r in mixing.sample(d, targets=want, keep=None).collect())
    assert abs(kept["b"] / (kept["a"] + kept["b"]) - 0.75) < 0.05
    assert {r.source for r in mixing.sample(d, targets={"source": {"a": 1.0}}, keep=0.4).collect()} == {"a"}


# -- 8
def test_store(spark, docs, hard, empty, tmp_path):
    for n, d in enumerate((docs, hard, empty)):
        path = str(tmp_path / str(n))
        store.write_store(d, path)
        got = sorted((tuple(r) for r in store.read_store(spark, path).collect()), key=lambda r: r[1])
        rows = sorted(d.collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
        at = 0
        for r, (i, start, k, c) in zip(rows, got, strict=True):
            x = ids_of(r.text, 2)
            assert (i, start, k, c) == (r.doc_id, at, len(x), crc(x))
            at += k
    c = store.chunks(spark, str(tmp_path / "1"))
    assert c.count() == c.select("hash").distinct().count()
    back = {r.doc_id: b"".join(map(bytes, r.payloads)) for r in store.read_documents(spark, str(tmp_path / "1")).collect()}
    assert back[9] == ids_of(HARD[9][1], 2).astype("<u2").tobytes()


def test_store_notices_damage(spark, docs, tmp_path):
    store.write_store(docs, str(tmp_path / "s"))
    path = str(tmp_path / "s")
    good = spark.read.parquet(f"{path}/recipes").cache()
    good.count()
    # sizes exchanged within a document leave its length, hashes and ids as they were
    swapped = good.withColumn("sizes", F.when(F.size("sizes") > 1, F.reverse("sizes")).otherwise(F.transform("sizes", lambda x: x + 1)))
    swapped.write.mode("overwrite").parquet(f"{path}/recipes")
    with pytest.raises(ValueError):
        store.read_store(spark, path)
    good.write.mode("overwrite").parquet(f"{path}/recipes")
    bad = spark.read.parquet(f"{path}/manifest/high").selectExpr("level", "part", "idx", "if(level = 5, 'x', hash) hash").collect()
    spark.createDataFrame(bad, "level int, part long, idx long, hash string").write.mode("overwrite").parquet(f"{path}/manifest/high")
    with pytest.raises(ValueError):
        store.read_store(spark, path)


def test_chunks_follow_content():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 49_000, 60_000).astype(np.uint32)
    parts = lambda v: [v[a:b].tobytes() for a, b in zip([0, *store.cuts(v)], store.cuts(v))]
    assert b"".join(parts(x)) == x.tobytes()
    shifted = np.r_[rng.integers(0, 49_000, 17).astype(np.uint32), x]
    assert len(set(parts(x)) & set(parts(shifted))) > 0.8 * len(parts(x))
    assert store.joined_crc([(zlib.crc32(p), len(p)) for p in parts(x)]) == zlib.crc32(x.tobytes())


# -- 9
@pytest.mark.parametrize("words, most_rows", [(None, exact_dedup.MOST_ROWS), (2, exact_dedup.MOST_ROWS), (None, 0)])
def test_exact(docs, hard, empty, words, most_rows):
    for d in (docs, hard):
        rows = d.collect()
        norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        groups = defaultdict(list)
        for r in rows:
            groups[norm(r.text)].append(r.doc_id)
        text = {r.doc_id: norm(r.text) for r in rows}
        got = exact_dedup.assign(d, words=words, most_rows=most_rows).collect()
        assert len(got) == len(rows)
        for r in got:
            g = groups[text[r.doc_id]]
            keep = min((i for i in g if i is not None), default=None)
            assert (r.keep_id, r.group_size, r.kept) == (keep, len(g), r.doc_id == keep)
        assert len(exact_dedup.dedup(d, words=words, most_rows=most_rows).collect()) == len(groups)
    assert exact_dedup.assign(empty).count() == 0 and exact_dedup.dedup(empty).count() == 0


def test_native_plans(docs):
    for df in (exact_dedup.assign(docs), exact_dedup.dedup(docs), mixing.mix(docs), line_dedup.dropped_lines(docs)):
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())


def test_clashing_columns(spark):
    d = spark.createDataFrame([(1, "a b", "x", "y", 3, 0.5, "h"), (2, "a b", "x", "y", 3, 0.5, "h")], "doc_id long, text string, lang string, source string, slot long, score double, text_sha256 string").withColumns({c: F.lit(1) for c in ("_gone", "_GONE_ID", "row", "_key", "_h", "_w", "_m", "_score", "lid", "th", "key", "first")})
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for out in (exact_dedup.dedup(d), simhash.dedup(d), jaccard.dedup(d), mixing.sample(d), quality.accept(d, labels), line_dedup.clean(d)):
        assert out.columns == d.columns
    assert exact_dedup.dedup(d).count() == 1
    for f in (sharding.assign_shards, packing.pack_documents, line_dedup.dropped_lines, class_lm.score_documents):
        assert f(d).count() == 2


# -- 10
def test_quality(spark, docs, hard, empty):
    rows = [(i, ("good words in a plain line " * 5 + str(i)) if i % 4 else "BAD!! JUNK!! " * 20, "en", "a", 0) for i in range(400)]
    d = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(d, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == int(r.doc_id % 4 > 0) for r in held) >= 0.98 * len(held)
    assert sorted(r.doc_id for r in quality.accept(d, labels).collect()) == sorted(r.doc_id for r in got if r.predicted)
    assert quality.classify(hard, labels).count() == len(HARD) and quality.classify(empty, labels).count() == 0
    assert {r.score for r in quality.classify(hard, labels.limit(0)).collect()} == {0.5}


def test_rules_compile_to_the_same_score(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, len(quality.STATS)))
    y = ((x[:, 0] > 0.2) & (x[:, 3] < 0.5)).astype(float)
    m = quality.fit(x, y)
    assert ((m.score(x) >= 0.5) == y).mean() > 0.95 and 0 < len(m.rules) < 300
    d = spark.createDataFrame([([float(v) for v in r],) for r in x[:50]], "v array<double>")
    s = F.struct(*[F.col("v")[k].alias(n) for k, n in enumerate(quality.STATS)])
    assert np.allclose([r.s for r in d.select(m.column(s).alias("s")).collect()], m.score(x[:50]))


def test_held_out_quality(spark):
    """What the classifier reaches on labels it has not learned from."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    got = quality.classify(docs, labels).where("held_out").join(labels.where("quality in (0, 1)"), "doc_id").select("score", "predicted", "quality").toPandas()
    rank = got["score"].rank().to_numpy()
    good = got["quality"].to_numpy() == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    accuracy = (got["predicted"] == got["quality"]).mean()
    print(f"held out: {len(got)} rows, AUC {auc:.4f}, accuracy {accuracy:.4f}, share of label 1 {good.mean():.4f}")
    assert auc > 0.9 and accuracy > 0.85


def test_components_either_way(spark):
    rng = np.random.default_rng(3)
    e = [*map(tuple, rng.integers(0, 60, (40, 2)).tolist()), *((k, k + 1) for k in range(100, 130))]
    df = spark.createDataFrame(e, "a long, b long")
    one, dealt = (sorted(map(tuple, common.components(df, few=few).collect())) for few in (common.FEW, 0))
    assert one == dealt and {r for n, r in one if n >= 100} == {100}
