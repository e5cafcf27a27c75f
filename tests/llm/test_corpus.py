"""Each operator against brute force on small tables, and on tables of nulls, repeats, ties and clashing names."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lagoon.llm import brown, decontaminate, embedding_dedup, induced_sort, language_id, license_scan, mixing, quality, sharding, similar, simhash, suffix_dedup
from lagoon.session import table

DATA = "/root/testdata/sf0.001"


def words(text):
    return (text or "").encode().lower().split()


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, DATA, "documents").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def groups_of(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# operator 10


def fingerprint(text):
    w = words(text)
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    bits = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            bits[b] += (h >> b) & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(grams)) if grams else 0


def test_simhash_equals_brute_force(docs, texts):
    want = {i: fingerprint(t) for i, t in texts.items()}
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert {i: r["fp"] & (2**64 - 1) for i, r in got.items()} == want
    ids = sorted(want)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (want[a] ^ want[b]).bit_count() <= 3]
    assert {i: r["component_id"] for i, r in got.items()} == groups_of(links, ids)


@pytest.mark.parametrize("hot", [1_000_000, 20, 2])
def test_trie_join_links_just_what_is_near(spark, hot):
    rng = random.Random(hot)
    points = {rng.getrandbits(64) for _ in range(150)} | {0, 2**64 - 1, 2**63}
    for p in list(points)[:60]:
        for _ in range(3):
            points.add(p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    points = sorted(points)
    frame = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in points], "fp long")
    found = [(r["src"] & (2**64 - 1), r["dst"] & (2**64 - 1)) for r in simhash.trie_self_join(frame, 3, hot).collect()]
    links = [(a, b) for k, a in enumerate(points) for b in points[:k] if (a ^ b).bit_count() <= 3]
    assert groups_of(found, points) == groups_of(links, points)


def test_simhash_edges(edge, empty):
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.near_duplicates(edge).collect()}
    assert got[(3, 0)] == got[(4, 0)] == got[(5, 0)] == got[(None, 0)] == 3
    assert len({c for (i, _), c in got.items() if i in (1, 2)}) == 1
    assert simhash.near_duplicates(empty).count() == 0


# operator 9


def removed(rows, length):
    counts = Counter(b[i : i + length] for _, b in rows for i in range(len(b) - length + 1))
    out = []
    for i, b in rows:
        mark = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if counts[b[k : k + length]] > 1:
                mark[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if mark[k] and (k == 0 or not mark[k - 1]))
        out.append((i, len(b), bytes(c for c, m in zip(b, mark) if not m), spans))
    return sorted(out, key=repr)


@pytest.mark.parametrize("options", [{}, {"hot": 0}, {"most": 0}, {"shard_bytes": 200}, {"memory": 1000}])
def test_repeats_equal_brute_force(spark, options):
    rng = random.Random(5)
    shared = "".join(rng.choice("abc é") for _ in range(120))
    rows = [(i, "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 200)))) for i in range(30)]
    rows += [(100 + i, rows[i][1] + shared[i : 80 + i] + rows[i + 1][1]) for i in range(20)]
    rows += [(200, "ab" * 90), (201, "q" * 77), (202, "q" * 77), (203, None), (None, shared), (204, "")]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 40, **options).collect()
    have = sorted(((r["doc_id"], r["n_bytes"], bytes(r["kept"]), len(r["spans"])) for r in got), key=repr)
    assert have == removed([(i, (t or "").encode()) for i, t in rows], 40)


def test_repeats_in_documents(docs, texts):
    got = suffix_dedup.remove_repeats(docs).collect()
    have = sorted(((r["doc_id"], r["n_bytes"], bytes(r["kept"]), len(r["spans"])) for r in got), key=repr)
    assert have == removed([(i, t.encode()) for i, t in texts.items()], 400)


@pytest.mark.parametrize("memory", [64, 300, 1 << 20])
def test_induced_sort_gives_suffix_order(memory):
    """Memory far below the text makes every array and queue a file and sorts names by recursion, whatever their alphabet."""
    rng = random.Random(memory)
    for trial in range(60):
        text = [rng.randint(1, rng.choice([1, 2, 5, 40, 700])) for _ in range(rng.randint(1, 200))] if trial % 4 else [rng.randint(1, 3) for _ in range(rng.randint(1, 9))] * 30
        text = np.array([*text, 0], dtype=np.int32)
        runs = list(induced_sort.suffixes(text, 1000, memory=memory))[::-1]
        order = np.concatenate([a for a, _ in runs]).tolist()
        lists = text.tolist()
        assert order == sorted(range(len(lists)), key=lambda i: lists[i:])
        common = np.concatenate([c for _, c in runs]).tolist()
        for k in range(1, len(order)):
            a, b = lists[order[k - 1] :], lists[order[k] :]
            assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_repeats_of_a_shard_larger_than_memory():
    rng = random.Random(19)
    stock = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))).encode() for _ in range(200)]
    pieces = [b" ".join(rng.choice(stock) for _ in range(60)) for _ in range(40)]
    pieces += [p[50:] + b"end" for p in pieces[:10]]
    got = induced_sort.repeated(pieces, 100, 2000)
    counts = Counter(p[i : i + 100] for p in pieces for i in range(len(p) - 99))
    assert [x.tolist() for x in got] == [[i for i in range(len(p) - 99) if counts[p[i : i + 100]] > 1] for p in pieces]


def test_repeats_edges(edge, empty):
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(edge).collect()}
    assert got[3]["n_bytes"] == 0 and bytes(got[11]["kept"]) == b"" and got[1]["spans"] == []
    assert len(got[7]["spans"]) == 1
    assert suffix_dedup.remove_repeats(empty).count() == 0


# operator 8


def test_shards(spark, docs, texts, edge, empty):
    got = {r["doc_id"]: r for r in sharding.shard_by_bytes(docs).collect()}
    total, before, seen = sum(len(t.encode()) + 16 for t in texts.values()), 0, Counter()
    for i in sorted(texts):
        size = len(texts[i].encode()) + 16
        shard = min(39, (2 * before + size) * 40 // (2 * total))
        assert (got[i]["size"], got[i]["shard"], got[i]["slot"], got[i]["text_crc32"]) == (size, shard, seen[shard], zlib.crc32(texts[i].encode()))
        before += size
        seen[shard] += 1
    rows = sharding.shard_by_bytes(edge, shards=3).collect()
    assert len(rows) == edge.count() and {r["text_crc32"] for r in rows if r["doc_id"] == 3} == {0}
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert sharding.shard_by_bytes(empty).count() == 0


# operator 5


def filled(sizes, weights, share=1.0, limit=3):
    left, out = set(sizes), {}
    total = sum(sizes.values()) * share
    while left:
        level = (total - sum(out.values())) / sum(weights[s] for s in left)
        over = {s for s in left if level * weights[s] > limit * sizes[s]}
        if not over:
            return out | {s: level * weights[s] for s in left}
        out |= {s: limit * sizes[s] for s in over}
        left -= over
    return out


def test_mix(spark, docs):
    rows, quotas = mixing.mix_sources(docs)
    got = rows.join(docs.select("doc_id", "source", "text"), "doc_id").collect()
    sizes = Counter()
    for r in got:
        assert r["size"] == len(r["text"].encode().split()) and 0 <= r["taken"] <= 3 * r["size"]
        sizes[r["source"]] += r["size"]
    weights = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes))}
    want, taken = filled(sizes, weights), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9)
        taken[r["source"]] += r["taken"]
    block = max(1, int(min(sum(want.values()) / 8192, min(want.values()) / 64)))
    assert all(abs(taken[s] - want[s]) <= 2 * block for s in sizes)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(docs.repartition(7))[0].collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}
    # quotas of each prefix of shards are the seats of the highest quotients, within three times a source's blocks
    seats = quotas.collect()
    count = math.ceil(sum(want.values()) / block - 1e-9)
    every = sorted(((want[s] / (2 * k - 1), -sorted(sizes).index(s), s) for s in sizes for k in range(1, 3 * -(-sizes[s] // block) + 1)), reverse=True)
    for shard in (0, 5, 15):
        best = Counter(s for _, _, s in every[: count * (shard + 1) // 16])
        assert best == Counter({s: n for s in sizes if (n := sum(r["quota"] for r in seats if r["source"] == s and r["shard"] <= shard))})
    # the words taken for a shard are its quota of blocks, but for the short last one
    words_in, quota = Counter(), Counter({(r["source"], r["shard"]): r["quota"] for r in seats})
    for r in got:
        assert sum(p["words"] for p in r["parts"]) == r["taken"]
        for p in r["parts"]:
            words_in[r["source"], p["shard"]] += p["words"]
    assert all(0 <= quota[k] * block - words_in[k] < 4 * block for k in quota)


def test_mix_of_many_small_sources(spark):
    """Sources from one word to thousands each come near their target, through the same blocks."""
    rng = random.Random(6)
    rows = [(k, "w " * rng.choice([1, 3, 50, 400]), f"s{rng.randrange(40)}") for k in range(900)] + [(2000, "one", "tiny"), (2001, "x " * 90_000, "huge")]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"))[0].collect()
    source = {i: s for i, _, s in rows}
    taken, want, size = Counter(), {}, Counter()
    for r in got:
        taken[source[r["doc_id"]]] += r["taken"]
        want[source[r["doc_id"]]] = r["target"]
        size[source[r["doc_id"]]] += r["size"]
        assert r["taken"] <= 3 * r["size"]
    ranked = {s: k % 3 + 1 for k, s in enumerate(sorted(size))}
    expected = filled(size, ranked)
    assert all(math.isclose(want[s], expected[s], rel_tol=1e-9) and abs(taken[s] - want[s]) <= 2 for s in want)


def test_mix_edges(edge, empty):
    rows = mixing.mix_sources(edge)[0].collect()
    assert len(rows) == edge.count()
    assert {(r["size"], r["taken"]) for r in rows if r["doc_id"] in (3, 4, 5)} == {(0, 0)}
    assert mixing.mix_sources(empty)[0].count() == 0
    assert mixing.mix_rows(edge).filter("doc_id = 3").count() == 0


# operator 4


def test_close_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    rows, k = [], 0
    for b in base:
        for noise in (0.0, 0.0, 0.1, 0.3, 0.36, 0.5):
            v = b + noise * rng.standard_normal(16)
            rows.append((k, [float(np.float32(x)) for x in v], int(k) % 2))
            k += 1
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0, None], 1), (904, [1.0] * 16, None), (905, [], 1), (906, [2.0] * 3, 1), (907, [4.0] * 3, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.close_pairs(frame, block=30).collect()}
    good = [r for r in rows if r[0] < 900 or r[0] > 905]
    cosine = {}
    for i, a in enumerate(good):
        for b in good[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], dtype=np.float64), np.array(b[1], dtype=np.float64)
                cosine[a[0], b[0]] = x @ y / math.sqrt((x @ x) * (y @ y))
    links = [p for p, c in cosine.items() if c >= 0.93]
    want = Counter(n for p in links for n in p)
    found, whole = sum(got[r[0]]["n_links"] for r in rows), sum(want.values())
    assert whole > 100 and 0.95 * whole <= found <= whole
    assert all(got[r[0]]["n_links"] <= want[r[0]] for r in rows)
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(900, 906))
    assert got[907]["component_id"] == 906 and not got[907]["kept"]
    assert embedding_dedup.close_pairs(frame.limit(0)).count() == 0


# operator 7


def test_language(docs):
    rows = language_id.identify(docs).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.9 * len(held)


def test_language_sample_is_bounded(spark):
    """The least hashes of each language, repeated rows once, within both bounds."""
    rows = [(k, f"text number {k}", f"l{k % 3}") for k in range(900)] + [(5000, "the same row", "l0")] * 400
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    hashed = frame.select("lang", "text", F.xxhash64(F.lit(42), "doc_id", "text").alias("h")).distinct().collect()
    for per, most, size in ((50, 12_000, 50), (50, 90, 30)):
        got = language_id.training_rows(frame, per, most, "doc_id", "text", "lang").collect()
        want = [(lang, r["text"]) for lang in ("l0", "l1", "l2") for r in sorted((r for r in hashed if r["lang"] == lang), key=lambda r: r["h"])[:size]]
        assert sorted((r["lang"], bytes(r["text"]).decode()) for r in got) == sorted(want)


def test_language_edges(edge, empty):
    rows = language_id.identify(edge).collect()
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (3, 4, 5, 6)} == {"und"}
    assert all(r["lang_pred"] in ("en", "de", "fr", "und") for r in rows)
    assert language_id.identify(empty).count() == 0


# operator 6


def aligned(window, item):
    h = [[0] * (len(window) + 1) for _ in range(len(item) + 1)]
    for i, b in enumerate(item, 1):
        for j, a in enumerate(window, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if a == b else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(max(r) for r in h)


def test_alignment_equals_the_full_matrix():
    rng = random.Random(2)
    for _ in range(300):
        window = [rng.choice(b"abcd").to_bytes() for _ in range(rng.randint(1, 30))]
        item = [rng.choice(b"abcd").to_bytes() for _ in range(rng.randint(1, 12))]
        best, a, b = decontaminate.align(window, item)
        assert best == aligned(window, item)
        assert best == 0 or aligned(window[a:b], item) == best


def test_contamination(spark, edge, empty):
    rng = random.Random(9)
    words_ = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    items = [(k, " ".join(rng.sample(words_, 24))) for k in range(6)] + [(90, None), (91, ""), (92, "solo"), (93, "Two words")]
    def noise():
        return " ".join(rng.choice(words_) for _ in range(60))
    edited = items[1][1].split()
    edited[4] = edited[15] = "zzz"
    del edited[9]
    rows = [(k, noise()) for k in range(20)] + [(100, noise() + " " + items[0][1].upper() + ", " + noise()), (101, noise() + " " + " ".join(edited) + " " + noise()), (102, "Solo!"), (103, "say two, words"), (104, None)]
    rows += [(200 + k, items[2][1]) for k in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(frame, bench).collect()}
    assert set(got) == {(100, 0), (101, 1), (102, 92), (103, 93)} | {(200 + k, 2) for k in range(50)}
    assert got[100, 0]["score"] == 1 and got[100, 0]["end"] - got[100, 0]["start"] == 24 and 0.5 <= got[101, 1]["score"] < 1
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(edge, bench.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(frame, bench).count() == 21


def test_contamination_finds_edited_copies_of_every_score(spark):
    """Against alignment of every document with every item: copies with more and more edits of each kind."""
    rng = random.Random(31)
    stock = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    items = [rng.sample(stock, w) for w in (3, 4, 5, 8, 12, 20, 20, 37, 59)]

    def noise(n=40):
        return [rng.choice(stock) for _ in range(n)]

    rows = []
    for item in items:
        for edits in range(len(item) // 2 + 1):
            for _ in range(3):
                copy = [[w] for w in item]
                for at in rng.sample(range(len(item)), edits):
                    copy[at] = rng.choice(([f"new{at}"], [], [*copy[at], f"new{at}"]))
                rows.append(noise() + [w for part in copy for w in part] + noise())
        # a word put in after every second one leaves no three words in a row
        rows.append([x for k, w in enumerate(item) for x in ((w, f"odd{k}") if k % 2 else (w,))])
    rows += [items[6]] * 5
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    frame = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(rows)], "doc_id long, text string")
    expected = {}
    for d, row in enumerate(rows):
        for i, item in enumerate(items):
            score = decontaminate.align([w.encode() for w in row], [w.encode() for w in item])[0] / len(item)
            if score >= 0.5:
                expected[d, i] = score
    assert any(0.5 <= x < 0.6 for x in expected.values()) and 1 in expected.values()
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(frame, bench).collect()} == expected


def test_contamination_by_items_that_share_most_of_their_words(spark):
    """Every document against every item where all seeds but a few are common to all items."""
    rng = random.Random(77)
    common = "which of the following is the best answer to the question about".split()
    items = [common + [f"k{i}a", f"k{i}b", f"k{i}c"] for i in range(30)] + [common, common[:6]]
    rows = [common + ["k3a", "k3b", "k9c"], common[:7], ["x"] * 10 + items[5], items[2][:10] + ["y", "k2b"], common[3:] + common[:3], ["of", "the"] * 20]
    rows += [[rng.choice(common) for _ in range(40)] for _ in range(10)]
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    frame = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(rows)], "doc_id long, text string")
    expected = {}
    for d, row in enumerate(rows):
        for i, item in enumerate(items):
            score = decontaminate.align([w.encode() for w in row], [w.encode() for w in item])[0] / len(item)
            if score >= 0.5:
                expected[d, i] = score
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(frame, bench).collect()} == expected


def test_contamination_in_capitals_of_any_script(spark):
    item = "l'été où ñandú élève ça œuvre été naïve forêt über привет мир ελλάδα"
    rows = [(1, "x " + item.upper() + " y"), (2, "été où rien d'autre ne suit ici")]
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 5)] and got[0]["score"] == 1


# operator 1


def test_brown(docs, texts):
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    counts = Counter(w for i, t in texts.items() if not held[i] for w in brown.words_of(t.encode()))
    n, v = sum(counts.values()), len(counts)
    model = brown.fit(docs.filter(~brown.held_out()), head=500, vocabulary=300)
    got = {r["doc_id"]: r for r in brown.score(docs, model).collect()}
    for i, t in texts.items():
        w = brown.words_of(t.encode())
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(w), sum(x in counts for x in w), n)
        assert math.isclose(got[i]["base_score"], sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
    out = [i for i in texts if held[i]]
    assert sum(got[i]["score"] for i in out) > sum(got[i]["base_score"] for i in out)
    # one text by the model's tables, word by word
    moves, below, new = model.tables()
    end, size = len(moves) - 1, len(model.ids)
    i = next(i for i in out if any(w not in counts for w in words(texts[i])))
    before, total, unseen = end, 0.0, 0.0
    for w in brown.words_of(texts[i].encode()):
        c = end if w == brown.END else model.assigned[model.ids[w] if w in model.ids else size + brown.spelled(w, model.groups)]
        total += moves[before, c]
        if w != brown.END:
            total += (math.log10(counts[w] - 0.5) if counts[w] else new[c]) - below[c]
            unseen += 0 if counts[w] else new[c] - below[c]
        before = c
    assert math.isclose(got[i]["score"], total, rel_tol=1e-9) and math.isclose(got[i]["unseen_score"], unseen, rel_tol=1e-9)
    assert all(r["score"] <= r["unseen_score"] <= 0 for r in got.values())
    # the classes' emissions are probabilities: known words and a new one
    mass = Counter()
    for w, n_w in counts.items():
        if w != brown.END:
            mass[model.assigned[model.ids[w] if w in model.ids else size + brown.spelled(w, model.groups)]] += n_w - 0.5
    assert all(math.isclose(m + 10 ** new[c], 10 ** below[c], rel_tol=1e-9) for c, m in mass.items())


def test_brown_exchange_equals_brute_force(spark, monkeypatch):
    """Class counts, likelihoods and every single move against loops over the tokens."""
    rng = random.Random(41)
    stock = [f"{p}{k}" for p in "ab" for k in range(12)]
    rows = [(k, " ".join(rng.choice(stock[:12] if j % 2 else stock[12:]) for j in range(rng.randint(4, 20)))) for k in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(brown, "_HOT", 5)
    groups, learned, vocabulary = 4, 3, 15
    model = brown.fit(frame, vocabulary=vocabulary, learned=learned, groups=groups, sweeps=9)
    width = vocabulary + groups + 1
    unit = lambda w: width - 1 if w == brown.END else model.ids[w] if w in model.ids else vocabulary + brown.spelled(w, groups)
    pairs = Counter()
    for _, t in rows:
        seq = [width - 1, *map(unit, brown.words_of(t.encode()))]
        pairs.update(zip(seq, seq[1:]))

    def table(classes):
        n = np.zeros((learned + 1, learned + 1))
        for (a, b), c in pairs.items():
            n[classes[a], classes[b]] += c
        return n

    assert np.array_equal(model.transitions, table(model.assigned))
    assert model.likelihoods == sorted(model.likelihoods) and math.isclose(model.likelihoods[-1], brown.log_likelihood(table(model.assigned)))
    start = np.concatenate((np.arange(width - 1) % learned, [learned]))
    assert model.likelihoods[-1] > brown.log_likelihood(table(start)) + 1
    contexts = brown._contexts(frame, F.col("text"), model.ids, vocabulary, groups)
    for turn in (0, 1):
        moves = brown._sweep(contexts, start, table(start), learned, turn, 2)
        for w in range(turn, width - 1, 2):
            if not any(w in p for p in pairs):
                continue
            values = []
            for c in range(learned):
                moved = start.copy()
                moved[w] = c
                values.append(table(moved))
            if (w, w) not in pairs:
                gains = [brown.log_likelihood(v) for v in values]
                chosen = moves.get(w, start[w])
                assert gains[chosen] >= max(gains) - 1e-6 and (chosen == start[w] or gains[chosen] > gains[start[w]])


def test_brown_transitions_are_probabilities(docs):
    moves, _, _ = brown.fit(docs, vocabulary=200).tables()
    assert np.allclose((10**moves).sum(axis=1), 1)


def test_brown_edges(edge, empty):
    got = brown.score(edge, brown.fit(edge)).collect()
    assert {r["n_tokens"] for r in got if r["doc_id"] in (3, 4, 5)} == {1} and all(math.isfinite(r["score"]) for r in got)
    none = brown.score(edge, brown.fit(empty)).collect()
    assert all(r["n_known"] == 0 and math.isfinite(r["score"]) for r in none)
    assert brown.score(empty, brown.fit(empty)).count() == 0


# operator 2


def test_gram_probabilities_add_up(spark):
    rng = random.Random(4)
    frame = spark.createDataFrame([(k, "".join(rng.choice("abc ") for _ in range(80))) for k in range(20)], "doc_id long, text string")
    grams = quality.count_grams(frame, "text", F.lit(True))
    context = grams.orderBy(F.desc("n"), "g").first()["g"] >> 8
    every = spark.createDataFrame([((context << 8) | b, 1, 0) for b in range(256)], "g long, n long, t long")
    asked = grams.unionByName(every).groupBy("g").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    got = quality.gram_probabilities(asked).filter(F.shiftright("g", 8) == context).collect()
    assert len(got) == 256 and math.isclose(sum(10 ** r["logp"] for r in got), 1, rel_tol=1e-6)


def kneser_ney(texts, asked):
    """Interpolated modified Kneser-Ney over byte 5-grams by dictionaries: log10 of each asked gram's last byte after the others."""
    n = quality.ORDER
    counts = {k: Counter() for k in range(1, n + 1)}
    for t in texts:
        b = bytes([2]) * (n - 1) + t + bytes([3])
        counts[n].update(b[i : i + n] for i in range(len(b) - n + 1))
    for k in range(n - 1, 0, -1):
        seen = Counter()
        for g, c in counts[k + 1].items():
            seen[g[1:]] += c if g[1] == 2 else 1
        counts[k] = seen

    def chance(g):
        if not g:
            return 1 / 256
        table = counts[len(g)]
        d = discount[len(g)]
        after = followers[len(g)].get(g[:-1], [])
        if not after:
            return chance(g[1:])
        c = table[g]
        left = sum(d[min(x, 3) - 1] for x in after)
        return (max(0, c - (d[min(c, 3) - 1] if c else 0)) + left * chance(g[1:])) / sum(after)

    discount, followers = {}, {}
    for k, table in counts.items():
        of = Counter(table.values())
        m = [of[i] for i in (1, 2, 3, 4)]
        y = m[0] / (m[0] + 2 * m[1]) if all(m[:3]) else 0
        discount[k] = [min(max(i - (i + 1) * y * m[i] / m[i - 1], 0.05), i - 0.05) for i in (1, 2, 3)] if all(m[:3]) else [0.5, 0.75, 0.9]
        followers[k] = {}
        for g, c in table.items():
            followers[k].setdefault(g[:-1], []).append(c)
    return {g: math.log10(chance(g)) for g in asked}


def test_gram_probabilities_equal_brute_force(spark):
    rng = random.Random(14)
    texts = [" ".join(rng.choice(["abba", "cab", "ba", "abc", "dada"]) for _ in range(rng.randint(1, 12))) for _ in range(40)]
    frame = spark.createDataFrame([(k, t, k % 3 > 0) for k, t in enumerate(texts)], "doc_id long, text string, good boolean")
    model = quality.gram_probabilities(quality.count_grams(frame, "text", F.col("good"))).collect()
    asked = {int(r["g"]).to_bytes(quality.ORDER, "big"): r["logp"] for r in model}
    want = kneser_ney([t.encode() for k, t in enumerate(texts) if k % 3], asked)
    assert any(g[0] == 2 for g in asked) and all(math.isclose(want[g], v, rel_tol=1e-9) for g, v in asked.items())


def test_quality_thresholds_by_hand(spark):
    """Means, limits and thresholds of each language against a loop over the perplexities returned."""
    rng = random.Random(15)
    stock = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(300)] for lang, letters in (("xx", "abcdefgh"), ("yy", "mnopqrst"))}
    rows = [(k, " ".join(rng.choice(stock[("xx", "yy")[k % 2]]) for _ in range(rng.randint(5, 90))), ("xx", "yy")[k % 2]) for k in range(400)]
    rows += [(1001, "".join(rng.choice("zyxwvu") for _ in range(300)), "xx"), (1002, "a text of no known language", None), (1003, "another one", "zz")]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(400)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality_filter(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).collect()}
    unseen = [r for i, r in got.items() if i < 400 and zlib.crc32(str(i).encode()) % 5 == 0]

    def spread(r):
        return math.sqrt(1 / r["n_tokens"] + 1 / 4000)

    limit = {}
    for lang in ("xx", "yy", None):
        sure = [r for r in unseen if lang in (None, r["lang"])]
        m = -sum(r["log10_prob"] for r in sure) / sum(r["n_tokens"] for r in sure)
        bins = sorted(math.ceil((math.log10(r["perplexity"]) - m) / spread(r) * 1000) for r in sure)
        limit[lang] = m, 1.25 * bins[math.ceil(0.99 * len(bins) - 1e-9) - 1] / 1000
    for r in got.values():
        m, z = limit.get(r["lang"], limit[None])
        assert math.isclose(r["threshold"], 10 ** (m + z * spread(r)), rel_tol=1e-3) and r["kept"] == (r["perplexity"] <= r["threshold"])
    assert not got[1001]["kept"] and sum(got[k]["kept"] for k in range(400)) >= 396


def test_perplexity_counts_every_gram(spark):
    frame = spark.createDataFrame([(1, "abcab cab"), (2, "A  b\n7"), (3, ""), (4, None)], "doc_id long, text string")
    model = quality.gram_probabilities(quality.count_grams(frame, "text", F.lit(True)))
    logs = {r["g"]: r["logp"] for r in model.collect()}
    for head in (0, 3, 1000):
        got = {r["doc_id"]: r for r in quality.perplexities(frame, model, head=head).collect()}
        for i, t in ((1, b"abcab cab"), (2, b"a b 0"), (3, b""), (4, b"")):
            code, n = quality.grams_of([t])
            assert got[i]["n_tokens"] == n[0] == len(t) + 1
            assert math.isclose(got[i]["log10_prob"], sum(logs[g] for g in code.tolist()), rel_tol=1e-5)


def test_quality_keeps_clean_texts(spark, docs, edge, empty):
    labels = table(spark, DATA, "labels")
    got = quality.quality_filter(docs, labels).join(labels, "doc_id").collect()
    clean = [r for r in got if r["quality"] == 1 and not r["toxic"]]
    junk = [r for r in got if r["quality"] == 0]
    assert sum(r["kept"] for r in clean) >= 0.97 * len(clean) and sum(r["kept"] for r in junk) <= 0.5 * len(junk)
    some = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (7, None, 1)], "doc_id long, quality int, toxic int")
    assert quality.quality_filter(edge, some).count() == edge.count()
    assert {r["kept"] for r in quality.quality_filter(edge, some.limit(0)).collect()} == {True}
    assert quality.quality_filter(empty, some).count() == 0


# operator 3


def test_licences(spark, edge, empty):
    full = next(t for n, t in license_scan.TEMPLATES if n == "MIT" and len(t) > 200)
    rows = [(1, "intro\n\n" + full.replace(". ", ".\n").upper() + "\n\nend"), (2, "a line\nlicensed under the apache license version 2.0\nrest"), (3, "the license of the house is under the hill"), (4, None), (5, full)]
    got = {(r["doc_id"], r["license"]): r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {(1, "MIT"), (2, "Apache-2.0"), (5, "MIT")} and got[5, "MIT"]["dice"] == 1.0
    assert [tuple(r)[:2] for r in license_scan.scan_licenses(edge).collect()] == [(9, "MIT")]
    assert license_scan.scan_licenses(empty).count() == 0


def test_licences_inside_prose(spark):
    """Notices in pieces, wrapped, inline and inside paragraphs; two licences apart; a tie of two says nothing."""
    body = dict(license_scan.TEMPLATES)
    gpl, apache = body["GPL-3.0-or-later"], next(t for n, t in license_scan.TEMPLATES if n == "Apache-2.0" and len(t) > 200)
    half = gpl.index("This program is distributed")
    rows = [
        (1, "First words of a text.\n\n" + gpl[:half] + "\n\n" + gpl[half:] + "\n\nMore prose follows. And more."),
        (2, "Intro line\n" + apache.replace("; ", ";\n").replace(". ", ".\n") + "\nprint the rest"),
        (3, "Some tool by the lab. Licensed under the MIT License. See docs for more."),
        (4, "Some tool by the lab. Licensed under\nthe MIT License. See docs for more."),
        (5, "Released under the MIT License.\n" + "filler words stand here\n" * 50 + "Licensed under CC BY 4.0."),
        (6, "This work is licensed under the GNU General Public License"),
        (7, "x " * 5000 + "\n" + body["MPL-2.0"] + "\n" + "y " * 5000),
        (8, "Licensed under the MIT License.\n" * 400),
    ]
    got = {(r["doc_id"], r["license"]): r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {(1, "GPL-3.0-or-later"), (2, "Apache-2.0"), (3, "MIT"), (4, "MIT"), (5, "MIT"), (5, "CC-BY-4.0"), (7, "MPL-2.0"), (8, "MIT")}
    assert got[1, "GPL-3.0-or-later"]["dice"] == got[2, "Apache-2.0"]["dice"] == got[3, "MIT"]["dice"] == got[4, "MIT"]["dice"] == got[7, "MPL-2.0"]["dice"] == 1
    assert (got[1, "GPL-3.0-or-later"]["start"], got[3, "MIT"]["start"], got[3, "MIT"]["words"], got[8, "MIT"]["start"]) == (5, 5, 5, 0)


# pipeline


def rows_of(frame):
    return Counter(tuple(r) for r in frame.collect())


def test_pipeline_stages(spark, docs, texts, edge):
    kept = corpus_pipeline.language(spark, docs, DATA)
    assert kept.columns == docs.columns and kept.count() == len(texts)
    clean = corpus_pipeline.decontaminate(spark, docs, DATA)
    bad = {r["doc_id"] for r in decontaminate.contaminated(docs, table(spark, DATA, "benchmark")).collect()}
    assert {r["doc_id"] for r in clean.collect()} == set(texts) - bad
    out, given = edge, {tuple(v for c, v in r.asDict().items() if c != "lang") for r in edge.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, DATA)
        assert out.columns == edge.columns
        # no column is changed but the language
        assert {tuple(v for c, v in r.asDict().items() if c != "lang") for r in out.collect()} <= given
    assert corpus_pipeline.STAGES[-1][1](spark, out, DATA).count() == out.count()


def test_near_dedup_goes_by_rows_not_ids(spark):
    """Against all pairs of rows: rows that share an id or have none but hold other texts all stay."""
    rng = random.Random(23)
    stock = [f"w{k}" for k in range(300)]
    rows = [(1, None), (2, ""), (None, ""), (7, "one two")]
    for k in range(12):
        base = [rng.choice(stock) for _ in range(80)]
        for edits in (0, 0, 1, 2, 9):
            copy = list(base)
            for at in rng.sample(range(80), edits):
                copy[at] = rng.choice(stock)
            rows.append((rng.choice([None, 5, 6, 100 + len(rows)]), " ".join(copy)))
    frame = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, at int")
    held, prints = [shingles(t) for _, t in rows], [simhash.fingerprint((t or "").encode(), 5) for _, t in rows]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]

    def first(group):
        return min(group, key=lambda k: (rows[k][0] is None, rows[k][0] or 0))

    def kept(links, nodes):
        members = {}
        for node, component in groups_of(links, nodes).items():
            members.setdefault(component, []).append(node)
        return members.values()

    got = {r["at"] for r in corpus_pipeline.near_dedup(spark, frame, DATA).collect()}
    groups = list(kept(near + [(a, b) for a in range(len(rows)) for b in range(a) if alike(held[a], held[b])], range(len(rows))))
    assert all(len(got & set(g)) == 1 for g in groups)
    assert all(rows[next(iter(got & set(g)))][0] == rows[first(g)][0] for g in groups)


def test_decontamination_goes_by_rows_not_ids(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my ny xi"
    rows = [(None, "x " + item), (None, "clean text of none"), (3, item + " y"), (3, "another clean text")]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = decontaminate.drop_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert rows_of(left) == Counter([rows[1], rows[3]])


def test_sketches_rule_out_no_similar_pair():
    rng = np.random.default_rng(8)
    for n in (1, 5, 40, 900, 3000):
        for share in (0.0, 0.05, 0.1, 0.2, 0.5):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            b = np.unique(np.concatenate((a[int(share * n) :], rng.integers(0, 2**64, int(share * n / 2), dtype=np.uint64))))
            if not len(b):
                continue
            both = len(np.intersect1d(a, b))
            allowed = similar.sketch_allows(similar.parity_sketch(a), similar.parity_sketch(b), len(a), len(b), 0.8)
            assert allowed or both < 0.8 * (len(a) + len(b) - both)
            assert not allowed or share < 0.5 or n < 40


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b) if a and b else False


def test_similar_links_are_exact(spark):
    """Against all pairs, in small groups and in ones too large for all pairs at once."""
    rng = random.Random(17)
    stock = [f"w{k}" for k in range(500)]
    texts = ["", None, "one", "One", "a b c d e"]
    for n in (7, 60, 200):
        for _ in range(3):
            base = [rng.choice(stock) for _ in range(n)]
            for edits in range(13):
                copy = list(base)
                for at in rng.sample(range(n), edits // 3):
                    copy[at] = rng.choice(stock)
                texts.append(" ".join(copy))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = [shingles(t) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if alike(held[a], held[b])]
    least = {}
    for node, component in groups_of(links, range(len(texts))).items():
        least[component] = min(node, least.get(component, node))
    assert len(links) > 100 and 0 < sum(alike(a, b) != (a == b) for a in held for b in held)
    made = frame.select(F.col("doc_id").alias("__row"), F.col("text").cast("binary").alias("__text"))
    for small in (20, 3):
        got = {(r["src"], r["dst"]) for r in similar.similar_links(made, small=small).collect()}
        assert got <= {(b, a) for a, b in links}
        assert groups_of(list(got), range(len(texts))) == groups_of(links, range(len(texts)))
    assert {r["doc_id"] for r in similar.drop_similar(frame).collect()} == set(least.values())


def test_pipeline_keeps_no_similar_texts(spark, docs, edge, empty):
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    kept = [shingles(r["text"]) for r in stage(spark, docs, DATA).collect()]
    assert not any(alike(a, b) for k, a in enumerate(kept) for b in kept[:k])
    assert stage(spark, empty, DATA).count() == 0 and stage(spark, edge, DATA).columns == edge.columns


def test_pipeline_runs(spark):
    rows = corpus_pipeline.run(spark, DATA).collect()
    slots = Counter(r["shard"] for r in rows)
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n)) for s, n in slots.items())


