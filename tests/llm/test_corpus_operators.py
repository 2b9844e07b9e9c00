"""Each operator on awkward rows against a brute-force version, and on empty tables."""

import hashlib
import html
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from varve.llm import bpe, chat, common, decontaminate, mainhtml, neighbours, privacy, quality, repeats, simhash, tokenfiles
from varve.llm.queries import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ITEM = "Quokka zebra umbrella walking through the violet meadow. The answer sings: marmalade tangerine"
LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(20_000))
PLAIN = "Some plain words about the weather in spring and the long way home over the hills tonight"
TEXTS = [
    (1, PLAIN), (2, PLAIN), (2, PLAIN), (3, None), (4, ""), (5, " \n\t "), (6, LONG), (7, f"Intro words. {ITEM.lower()} and more"),
    (8, "a" * 400), (9, "mail bob@x.org or +1 (555) 123-4567, 4111 1111 1111 1111, 10.0.0.1 <|endoftext|> 日本 🙂"), (None, PLAIN),
    (10, PLAIN[:-8] + " morning"), (11, "same same same " * 30),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in TEXTS], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(1, 12)] + [(None, 1, 0), (4, None, None)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, ITEM)], "item_id bigint, text string")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_token_files(spark, docs, none, tmp_path):
    path = public_tokenizers.path(tokenizer := "word_bpe_49k.json")
    library = Tokenizer.from_file(public_tokenizers.path(tokenizer))
    start, want = 0, []
    for i, t in sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    tokenfiles.write(docs, f"{tmp_path}/t", path)
    got = [tuple(r) for r in tokenfiles.positions(spark, f"{tmp_path}/t").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    tokenfiles.write(none, f"{tmp_path}/e", path)
    assert tokenfiles.positions(spark, f"{tmp_path}/e").count() == 0


def test_bpe(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    made = by_id(bpe.decode(bpe.encode(docs, path), path))
    for i, t in TEXTS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(made[i]["ids"], dtype="<u4").tolist() == ids
        assert made[i]["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.digests(none, path).count() == 0


def test_one_segment_tree_merges_as_many_do():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        vocabulary = bpe.Vocabulary(f.read())
    for word in (" banana", "aaaaaaaaaaa", " straße", "x"):
        one = bpe.merge_one(vocabulary.byte_ids[np.frombuffer(word.encode(), dtype=np.uint8)].tolist(), vocabulary)
        assert np.frombuffer(bpe.encode_words([word], vocabulary)[0], dtype="<u4").tolist() == one


def test_decontamination(docs, none, bench):
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert found == {(7, 1), (7, 4)}
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS) - 1
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_decontamination_of_changed_words(spark):
    # Items of rare and common words; copies lose their rarest words, or any, and brute-force LCS decides.
    rng = np.random.default_rng(31)
    common = [f"c{x}" for x in range(60)]
    items = [[f"r{k}x{j}" if j % 3 == 0 else str(rng.choice(common)) for j in range(30)] for k in range(12)]
    texts = [" ".join(rng.choice(common, 200)) for _ in range(300)]
    for words in items:
        rare = [j for j in range(30) if j % 3 == 0]
        for n in (6, 9, 10):
            for at in (rare[:n], rng.choice(30, n, replace=False).tolist()):
                changed = [f"new{j}" if j in at else w for j, w in enumerate(words)]
                texts.append(" ".join([*rng.choice(common, 90), *changed, *rng.choice(common, 90)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    sure = {(300 + 6 * k + c, k) for k in range(12) for c in range(2)}  # 24 of 30 words stay in order
    assert sure <= found
    for doc, k in found:
        assert decontaminate.lcs_length(items[k], texts[doc].split()) >= 0.6 * 30


def test_decontamination_by_latent_retrieval(spark):
    # Half of an item's words in order, those that weigh most among them: too few for a leak by words alone.
    rng = np.random.default_rng(33)
    common = [f"c{x}" for x in range(60)]
    items = [[f"r{k}x{j}" if j % 3 == 0 else str(rng.choice(common)) for j in range(30)] for k in range(12)]
    texts = [" ".join(rng.choice(common, 200)) for _ in range(300)]
    light = [j for j in range(30) if j % 3][:15]
    heavy = [j for j in range(30) if j % 3 == 0] + light[:5]
    for words in items:
        for at in (light, heavy):
            changed = [f"new{j}" if j in at else w for j, w in enumerate(words)]
            texts.append(" ".join([*rng.choice(common, 20), *changed, *rng.choice(common, 20)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(docs, bench).collect()}
    assert set(found) == {(300 + 2 * k, k) for k in range(12)}
    assert all(r["cosine"] > 0.5 and r["lcs"] < 0.6 for r in found.values())


def test_decontamination_looks_up_only_odd_words_one_by_one(spark, monkeypatch):
    # Words of every kind are the same terms as before; those of letters below 0x250 never become Python's.
    known = ["casa", "ñandú", "straße", "i̇stanbul", "ⱥb", "слово", "中文", "a_b", "_x_", "don't", "λόγος"]
    words = ["Casa,", "¿ÑANDÚ?", "«straße»", "İstanbul", "Ⱥb", "СЛОВО!", "「中文」", "(a_b)", "_x_", "“Don't”", "ΛΌΓΟΣ", "...", "Casas", "x" * 40, "º"]
    asked = []
    looked_up = decontaminate.WordCache.of
    monkeypatch.setattr(decontaminate.WordCache, "of", lambda self, ws: asked.extend(ws) or looked_up(self, ws))
    frame = type("Frame", (), {"select": lambda self, *_: self, "mapInArrow": lambda self, run, _: run})()
    frame.sparkSession = spark
    text = "  \u3000".join(words) + "\x1c" + "casa\u0085CASA"
    run = decontaminate.hits(frame, known)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": [text, None, "casa\n"]})
    made = pa.Table.from_batches(list(run(iter([batch])))).to_pylist()
    number = {t: i for i, t in enumerate(known)}
    for row, t in zip(made, (text, "", "casa\n")):
        want = [(i, number[w]) for i, w in enumerate(decontaminate._EDGE.sub("", x.lower()) for x in t.split()) if w in number]
        assert list(zip(*(np.frombuffer(row[c], dtype=np.int32).tolist() for c in ("at", "term")))) == want
    assert set(asked) == {"İstanbul", "СЛОВО!", "「中文」", "“Don't”", "ΛΌΓΟΣ"}


def test_documents_that_cannot_leak_are_not_cut_into_windows(spark):
    rng = np.random.default_rng(35)
    items = [(k, rng.integers(0, 400, 30).tolist(), [0]) for k in range(20)]
    space = decontaminate.space_of(spark, items, np.ones(400), 1_000, decontaminate.Settings())
    terms = [rng.integers(0, 400, 12).astype(np.int32) for _ in range(200)]
    terms[150] = np.array(items[7][1], dtype=np.int32)
    ats = [np.arange(len(t), dtype=np.int32) for t in terms]
    asked = []

    class Coords:
        def __init__(self, rows):
            self.rows = rows

        def __matmul__(self, other):
            return self.rows @ other

        def __getitem__(self, at):
            asked.append(len(at))
            return self.rows[at]

    space.coords = Coords(space.coords)
    found = list(decontaminate._search(ats, terms, space, decontaminate.Settings()))
    assert [r[:2] for r in found] == [(150, 7)]
    assert sum(asked) < 400  # of 1,919 terms that weigh something


def test_the_latent_space_is_smaller_than_the_benchmark(spark):
    rng = np.random.default_rng(34)
    items = [(k, rng.integers(0, 40, 30).tolist(), [0]) for k in range(20)]
    space = decontaminate.space_of(spark, items, np.ones(40), 1_000, decontaminate.Settings())
    assert len(space.target) - (space.axis >= 0).sum() <= 10
    # Windows that are the items themselves are nearest to them.
    made = np.array([space.coords[space.local[words]].sum(0) for _, words, _ in items])
    dot = made @ space.target
    assert np.allclose(np.diag(dot), space.length**2, rtol=1e-3)
    cosine = decontaminate._cosine(made, np.diag(dot), np.arange(20), space)
    assert np.allclose(cosine[space.axis < 0], 1, atol=1e-3)


def test_lcs_equals_the_table():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 5, 9).tolist(), rng.integers(0, 5, 12).tolist()
        table = np.zeros((10, 13), dtype=int)
        for i in range(9):
            for j in range(12):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert decontaminate.lcs_length(a, b) == table[-1, -1]


def test_quality(spark, docs, none, labels):
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows if r["doc_id"] is not None)
    assert quality.classify(none, labels).count() == 0
    assert quality.classify(docs, labels.limit(0)).count() == len(TEXTS)
    assert quality.keep_good(docs.withColumn("Score", docs.lang), labels).columns == [*docs.columns, "Score"]


def test_quality_held_out_accuracy(spark):
    truth = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    made = quality.classify(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), truth)
    rows = made.join(truth, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted({r for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (t or "").encode()
        mask = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if raw[k : k + length] in seen:
                mask[k : k + length] = b"\1" * length
            seen.add(raw[k : k + length])
        spans = sum(m and (k == 0 or not mask[k - 1]) for k, m in enumerate(mask))
        out[i] = (len(raw), sum(mask), spans, hashlib.sha256(bytes(b for b, m in zip(raw, mask) if not m)).hexdigest())
    return out


def test_repeats(spark, none):
    base = "The quick brown fox jumps over the lazy dog and then it runs away from all of the angry bears in the wood. "
    texts = [t for t in TEXTS if t[0] != 6] + [(20, base * 3), (21, "x" + base + "y" + base[:99]), (22, "ab" * 90), (23, base[:100])]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.digests(df).collect()}
    assert got == brute_repeats(texts)
    assert repeats.digests(none).count() == 0


def test_simhash(docs, none):
    made = by_id(simhash.classes_hex(docs))
    assert all(made[i]["fingerprint"] == f"{simhash.shingle_fingerprint(t or ''):016x}" for i, t in TEXTS)
    prints = {i: int(made[i]["fingerprint"], 16) for i in made}
    for i in prints:
        least = {i}
        while more := {j for j in prints for k in least if (prints[j] ^ prints[k]).bit_count() <= 3} - least:
            least |= more
        assert made[i]["component_id"] == min(x for x in least if x is not None)
    assert simhash.classes_hex(none).count() == 0


def test_simhash_links_large_buckets(spark):
    rng = np.random.default_rng(2)
    values = [int(v) for v in np.unique(rng.integers(0, 1 << 9, 60))]
    df = spark.createDataFrame([(v,) for v in values], "fingerprint bigint")
    for split in (4096, 8):
        links = {frozenset(r) for r in simhash.links(df, split=split).collect()}
        assert all((a ^ b).bit_count() <= 3 for a, b in map(tuple, links))
        reached, grown = {values[0]}, True
        while grown:
            new = {x for link in links if link & reached for x in link} - reached
            reached, grown = reached | new, bool(new)
        assert reached == set(values)


def test_near_duplicates_by_similarity(spark, docs, none):
    words = LONG.split()[:300]
    near, far = [*words], [*words]
    near[100] = "changed"
    far[::6] = ["other"] * 50
    more = [(30, " ".join(words)), (31, " ".join(near)), (32, " ".join(far))]
    df = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in more], DOCS))
    kept = simhash.one_of_each(df)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns
    assert {1, 30, 32, None} <= set(ids) and not {2, 31} & set(ids)
    assert simhash.one_of_each(none).count() == 0


def shingle_set(text, words=5):
    w = text.lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}


def one_of_each_by_brute_force(texts):
    """Smallest ids of the components of pairs of at least 0.8, over all pairs."""
    sets, root = {i: shingle_set(t) for i, t in texts}, {i: i for i, _ in texts}
    for i, x in sets.items():
        for j, y in sets.items():
            if i < j and len(x & y) >= 0.8 * len(x | y) and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {k: new if r == old else r for k, r in root.items()}
    return set(root.values())


def kept_of(spark, texts):
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], DOCS).repartition(3)
    return {r["doc_id"] for r in simhash.one_of_each(df).collect()}


def test_near_duplicates_of_many_variants(spark):
    # Groups of variants around 0.8: pairs closer in bits are often below it, pairs farther apart above.
    rng = np.random.default_rng(21)
    texts = []
    for group in range(4):
        base = [f"g{group}w{x}" for x in rng.integers(0, 5_000, 200)]
        for v in range(50):
            words = list(base)
            for at in rng.choice(200, int(rng.integers(3, 6)), replace=False):
                words[at] = f"c{group}x{v}x{at}"
            texts.append((100 * group + v, " ".join(words)))
    want = one_of_each_by_brute_force(texts)
    assert 4 < len(want) < 200 and kept_of(spark, texts) == want


def test_near_duplicates_are_candidates_by_fingerprint(spark):
    # One word changed: linked by fingerprints.  Other words altogether: not.
    rng = np.random.default_rng(24)
    base = [f"w{x}" for x in rng.integers(0, 100_000, 400)]
    texts = [(1, " ".join(base)), (2, " ".join([*base[:-1], "changed"])), (3, " ".join(reversed(base))), (4, "")]
    marked = simhash._text_keys(spark.createDataFrame(texts, "doc_id bigint, text string"), 5)
    found = marked.join(simhash._linked(marked.select("unit", "fingerprint", "n")), "unit").collect()
    assert {r["doc_id"] for r in found} == {1, 2} and len({r["token"] for r in found}) == 1


def test_near_duplicates_far_apart_in_bits(spark):
    # A line repeated more often in one text: equal to 0.8 and more as sets, far apart as weighted fingerprints.
    rng = np.random.default_rng(22)
    base = [f"w{x}" for x in rng.integers(0, 100_000, 300)]
    line = [f"l{x}" for x in range(12)]
    texts = [(1, " ".join(base + line)), (2, " ".join(base + line * 60)), (3, " ".join(reversed(base)))]
    apart = simhash.shingle_fingerprint(texts[0][1], 5) ^ simhash.shingle_fingerprint(texts[1][1], 5)
    assert apart.bit_count() > 14
    assert kept_of(spark, texts) == one_of_each_by_brute_force(texts) == {1, 3}


def test_near_duplicates_of_equal_fingerprints(spark):
    # A row of dashes fixes the fingerprint; the remaining words differ wholly, but for two texts.
    rng = np.random.default_rng(23)
    own = [" ".join(f"w{x}" for x in rng.integers(0, 100_000, 120)) for _ in range(4)]
    texts = [(i, own[i] + " -" * 200) for i in range(4)] + [(9, own[3] + " changed" + " -" * 200)]
    assert len({simhash.shingle_fingerprint(t, 5) for _, t in texts}) == 1
    assert kept_of(spark, texts) == one_of_each_by_brute_force(texts) == {0, 1, 2, 3}


def test_near_duplicates_make_sets_of_pairs_only(spark, monkeypatch):
    # Two at a time share rare shingles, but lengths rule out that they are alike; the last and rows without an id are.
    rng = np.random.default_rng(25)
    base = [f"w{x}" for x in rng.integers(0, 10_000, 600)]
    texts = [(i, " ".join([*(f"p{i % 4}x{x}" for x in range(20)), *base[: int(40 * 1.4**i)]])) for i in range(9)]
    texts += [(20, texts[8][1] + " changed"), (None, texts[3][1] + " new"), (None, texts[8][1])]
    made = []
    sets = simhash._shingle_sets
    monkeypatch.setattr(simhash, "_shingle_sets", lambda docs, words: made.extend(r["unit"] for r in sets(docs, words).collect()) or sets(docs, words))
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], DOCS).repartition(2)
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in simhash.one_of_each(df).collect()) == [-1, -1, *range(9)]
    assert len(set(made)) == 4  # 8, 20, 3 and the one like 3


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    good = [(i, rng.normal(size=6).tolist(), 0) for i in range(120)] + [(200 + i, [1.0] + [0.0] * 5, 1) for i in range(8)] + [(50, [9.0] * 6, 0)]
    bad = [(300, None, 0), (350, [], 0), (400, [0.0] * 6, 0), (450, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (500, [float("nan")] * 6, 0), (None, [1.0] * 6, 0)]
    df = spark.createDataFrame(good + bad, "vec_id bigint, embedding array<float>, label int")
    once = {}
    for i, v, _ in good:
        once[i] = min(once.get(i, v), v)
    ids = np.array(sorted(once))
    matrix = np.array([np.float32(once[i]).astype(float) for i in ids])
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    hits = total = 0
    rows = neighbours.nearest(df).collect()
    for q in ids[ids % 50 == 0]:
        score = unit @ unit[list(ids).index(q)]
        best = [i for i in ids[np.lexsort((ids, -np.round(score, 12)))] if i != q][:5]
        got = [r["vec_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == q]
        hits, total = hits + len(set(got) & set(best)), total + 5
        if q == 200:
            assert got == [201, 202, 203, 204, 205]
    assert hits >= 0.9 * total
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_hilbert_curve_visits_neighbours():
    cells = np.array([[x, y, z] for x in range(4) for y in range(4) for z in range(4)])
    key = neighbours.hilbert(cells, 2)
    steps = np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1)
    assert sorted(key.tolist()) == list(range(64)) and (steps == 1).all()


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_private(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for k, c in enumerate(reversed(d))) % 10 == 0
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                  "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_privacy(spark, docs, none):
    telling = [(100 + i, f"Zyxwvut met {'one two three four five six seven'.split()[i]} at spy@secret.org {i}", "en", "s", 1) for i in range(6)]
    hard = ["a@b.c@d.e", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8 001.2.3.0255", "+1 234 567 890 4111-1111-1111-1111 4", "é🙂 x@y.zz", "1 " * 20_000, "a" * 50_000]
    df = docs.unionByName(spark.createDataFrame(telling + [(50 + i, t, "en", "s", 1) for i, t in enumerate(hard)], DOCS))
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    for i, r in by_id(privacy.digests(df)).items():
        base = [x for x in r["spans"].split(",") if x and not x.startswith("term")]
        assert base == brute_private(texts[i]) and r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert ("term:0:7" in r["spans"].split(",")) == (i is not None and i >= 100)
    written = by_id(privacy.rewrite(privacy.find(df)))
    assert written[101]["text"] == "[TERM] [TERM] two at [EMAIL] 1" and written[3]["text"] is None and written[1]["text"] == PLAIN
    assert privacy.digests(none).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", r"\### Assistant: </turn> ok"), (1, 1, "assistant", "\\\\e \\h ### ## "), (2, 0, None, None), (2, 0, "tool: x", ": \\c"),
            (2, 1, "assistant", None), (2, 1, "assistant", ""), (None, 5, "assistant", "</turn>\n### User: ")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(df).collect()}
    for conv in (1, 2, None):
        mine = sorted([(t, role or "", text or "") for c, t, role, text in rows if c == conv])
        said = "".join(f"{role}\n{text}\n" for _, role, text in mine)
        learned = "".join(text for _, role, text in mine if role == "assistant")
        assert got[conv]["n_turns"] == len(mine) and got[conv]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest() and got[conv]["loss_chars"] == len(learned)
    assert [got[c]["first_invalid"] for c in (1, 2, None)] == [-1, 0, 0]
    assert chat.digests(df.limit(0)).count() == 0


def test_chat_equals_its_sql(spark):
    from workload.compare import connect, differences

    assert differences(QUERIES["op9_chat"](spark, SF_DIR), connect(SF_DIR), ORACLE["op9_chat"]) == []


def test_main_text(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in mainhtml.main_texts(pages).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", source[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(b.replace("<b>", "")).split()) for b in re.split(r"</?(?:p|h1)>|<br>", inner)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])
    odd = spark.createDataFrame([(1, "u", None), (1, "u", ""), (None, None, "<p"), (2, "u", "a &lt; b<br>c<script>x</script>" + "<b>" * 5000)], "page_id bigint, url string, html string")
    assert sorted(r["text"] for r in mainhtml.main_texts(odd).collect()) == ["", "", "", "a < b c"]
    assert mainhtml.main_texts(odd.limit(0)).count() == 0


def test_main_text_under_names_of_boilerplate():
    story = " ".join(f"word{i}" for i in range(120))
    body = "<nav><a href=x>home news sport</a></nav><div class='share'>share this now</div>%s<footer>imprint</footer>"
    part = f"<p>{story}</p>"
    for page in (
        f"<html><body class='has-sidebar'>{body % part}</body></html>",
        f"<html class='no-sidebar'><body id='header-fixed'>{body % part}</body></html>",
        f"<body><form action=x>{body % part}</form></body>",
        f"<body><form><input>{body % f'<article>{part}</article>'}</form></body>",
        f"<body><article class='header menu'>{part}</article></body>",
        f"<body><article><form>{part}</form></article></body>",
        f"<body>{body % f'<div class=sidebar-layout>{part}</div>'}</body>",
    ):
        assert mainhtml.extract_one(page, {}) == story, page
    for name in ("related-work", "social-history", "share-price"):
        page = f"<body>{body % f'<div>{part}<section id={name}><p>{story} more</p></section>{part}</div>'}</body>"
        assert mainhtml.extract_one(page, {}) == f"{story}\n\n{story} more\n\n{story}"
    # A learned weight overrules the fixed names, and takes out what labelled pages show to be no content.
    short = "<body><p>one two three</p><div class='related'><p>four five six</p></div></body>"
    assert mainhtml.extract_one(short, {}) == "one two three"
    assert mainhtml.extract_one(short, {"div.related": 4.0}) == "one two three\n\nfour five six"
    assert mainhtml.extract_one(f"<body>{part}<div class=x>a b c</div>{part}</body>", {"div.x": -3.0}) == f"{story}\n\n{story}"


def test_main_text_without_comments_sidebars_and_adverts():
    story = " ".join(f"word{i}" for i in range(120))
    half = f"<p>{story}</p>"
    for size in (1, 20, 60, 119, 200):
        other = f"<p>{' '.join(['other'] * size)}</p>"
        for name in ("comments", "comment-list", "advert", "ad-slot", "ads", "cookie-notice", "post-comments"):
            block = f"<div class='{name}'>{other}</div>"
            for page in (
                f"<body><article>{half}{block}{half}</article></body>",
                f"<body><article>{half}{half}{block}</article></body>",
                f"<body>{block}<article>{half}{half}</article>{block}</body>",
                f"<body>{half}{block}{half}</body>",
                f"<body><main>{half}<div id={name}>{other}</div>{half}</main></body>",
            ):
                # Comments that always stand inside articles are no part of them, whatever that teaches.
                assert mainhtml.extract_one(page, {f"div.{name}": 5.0}) == f"{story}\n\n{story}", (name, size, page)
        for name in ("sidebar", "left-sidebar", "notice", "newsletter-signup", "related", "social-links"):
            block = f"<div class='{name}'>{other}</div>"
            for page in (f"<body><article>{half}{block}{half}</article></body>", f"<body>{block}<article>{half}{half}</article>{block}</body>"):
                assert mainhtml.extract_one(page, {}) == f"{story}\n\n{story}", (name, size, page)
    # What holds all, what is named content as well, program text, and names that only hold such a word.
    assert mainhtml.extract_one(f"<body><div class=comments>{half}</div></body>", {}) == story
    assert mainhtml.extract_one(f"<body><div class=sidebar-right>{half}<div class=sidebar>one two</div></div></body>", {}) == story
    assert mainhtml.extract_one(f"<body><div class='content header'>{half}</div>{half}</body>", {}) == f"{story}\n\n{story}"
    assert mainhtml.extract_one(f"<body>{half}<pre>x <span class=comment># note</span></pre></body>", {}) == f"{story}\n\nx # note"
    assert mainhtml.kind_of("comments-open") == mainhtml.kind_of("has-sidebar") == mainhtml.kind_of("post-header") == ""


def test_main_text_is_the_best_of_all_stretches():
    """The scan's region has the greatest sum of any contiguous stretch of words and tags."""
    rng = random.Random(5)
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 12)):
            words = " ".join(f"w{rng.randint(0, 999)}" for _ in range(rng.randint(0, 30)))
            parts.append(rng.choice(["<p>%s</p>", "<section class='share-price'>%s</section>", "<div id=social-history>%s</div>", "%s<br>"]) % words)
        page = "".join(parts)
        events = [(m["text"], (m["tag"] or "").lower(), m["attrs"] or "", m["close"]) for m in mainhtml._TOKEN.finditer(page)]
        scores, open_names = [], []
        for text, tag, attrs, close in events:
            if text is not None:
                scores.append(float(len(text.split())))
                continue
            if close:
                named = open_names.pop()
            else:
                named = "=" in attrs
                if tag != "br":
                    open_names.append(named)
            scores.append(-mainhtml._against(mainhtml.UNSEEN) - 0.01 - (mainhtml.NAME_COST if named else 0.0))
        sums = {(i, j): sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)}
        best = max(sums.values(), default=0.0)
        texts = {" ".join(" ".join(e[0] or "" for e in events[i:j]).split()) for (i, j), x in sums.items() if x > best - 1e-9} if best > 0 else {""}
        assert " ".join(mainhtml.extract_one(page, {}).split()) in texts, page


def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert rows and all(r["round_trip"] for r in rows) and len({r["doc_id"] for r in rows}) == len(rows)


def test_tasks_get_batches_of_few_bytes_whatever_the_texts(spark):
    # One batch of 20 MB before: ten thousand rows, if they held less than 64 MB.
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    def met():
        return long.mapInArrow(common.tidy(sizes), "rows bigint, bytes bigint").collect()

    long = spark.range(0, 2_000, 1, 1).selectExpr("id AS doc_id", "repeat('abcde fghi', 1000) AS text")
    spark.conf.unset(limit)
    try:
        found = met()
        assert sum(r["rows"] for r in found) == 2_000
        assert max(r["bytes"] for r in found) < 1.1 * common.BATCH_BYTES
        # A limit that the session has is its own.
        spark.conf.set(limit, str(1 << 20))
        assert max(r["bytes"] for r in met()) < 1.1 * (1 << 20)
    finally:
        spark.conf.unset(limit)
