"""Exact dedup, SimHash, sharding, packing and the pipeline against brute force, with the awkward rows of each."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import _common, exact_dedup, packing, sharding, simhash

SCHEMA = "doc_id long, text string, source string, id long, t string, h string, n int, row int, fp long, size string, _sha string"


def frame(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, s, 7, "t", "h", 1, 2, 3, "size", "keep me") for i, t, s in rows], SCHEMA)


AWKWARD = [
    (5, "a  b", "x"), (3, "a b", "x"), (3, "a b", "x"), (None, "a b", None), (8, None, "y"), (9, "", "y"), (10, " ", "y"), (11, "\t\n", "y"), (12, "A b", "x"),
    (13, "word " * 60000, "x"), (14, "word " * 60000, "x"), (15, "a b", "y"), (16, "ünï ©", "z"),
]


def norm(t):
    import re

    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("digest", [F.md5, lambda c: F.lpad(F.hex(F.length(c) % 3), 32, "0")], ids=["md5", "colliding"])
def test_exact_groups(spark, digest):
    got = exact_dedup.exact_groups(frame(spark, AWKWARD), digest=digest).collect()
    groups = defaultdict(list)
    for i, t, _ in AWKWARD:
        groups[norm(t)].append(i)
    assert len(got) == len(AWKWARD)
    by_sha = defaultdict(list)
    for r in got:
        by_sha[r["text_sha256"]].append(r)
    for text, ids in groups.items():
        rows = by_sha[hashlib.sha256(text.encode()).hexdigest()]
        least = min(i for i in ids if i is not None)
        assert sorted(r["doc_id"] or -1 for r in rows) == sorted(i or -1 for i in ids)
        assert {(r["keep_id"], r["group_size"]) for r in rows} == {(least, len(ids))} and sum(r["kept"] for r in rows) == 1


def test_drop_copies(spark):
    df = frame(spark, AWKWARD)
    out = exact_dedup.drop_copies(df)
    assert out.columns == df.columns and sorted(norm(r["text"]) for r in out.collect()) == sorted({norm(t) for _, t, _ in AWKWARD})
    assert exact_dedup.drop_copies(frame(spark, [(1, "a", "x"), (2, "a", "x"), (3, "b", "x")])).count() == 2


def test_empty_tables(spark):
    none = frame(spark, [(1, "a", "x")]).filter("false")
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0
    assert simhash.near_groups(none).count() == 0 and simhash.drop_near_copies(none).count() == 0
    assert sharding.histogram_shards(none).count() == 0 and packing.mixture_packed(none).count() == 0


def brute_fingerprint(text, k=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(fps):
    parent = {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(fps)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


def near_texts(n, seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    out = []
    while len(out) < n:
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 200))]
        out.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 3])):
            w = list(words)
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            words = w
            out.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
    return out[:n]


def test_simhash_is_brute_force(spark):
    texts = [*near_texts(400), None, "", "  ", "one two", "One  TWO", "Ünï ünï", "x y z"]
    df = frame(spark, [(k, t, "s") for k, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in simhash.near_groups(df).collect()}
    fps = {k: brute_fingerprint(t) for k, t in enumerate(texts)}
    assert {k: int(r["fingerprint"], 16) for k, r in got.items()} == fps
    assert {k: r["component_id"] for k, r in got.items()} == brute_components(fps)
    kept = {r["doc_id"] for r in simhash.drop_near_copies(df).collect()}
    assert kept == set(brute_components(fps).values())


def test_golay_keys_find_all_links(monkeypatch, spark):
    rng = np.random.default_rng(5)
    fps = []
    for _ in range(300):
        base = int(rng.integers(0, 1 << 63))
        fps.append(base)
        for bits in range(1, 6):
            x = base
            for b in rng.choice(64, bits, replace=False):
                x ^= 1 << int(b)
            fps.append(x)
    fps = sorted(set(fps))
    a = np.array(fps, np.uint64)
    r, k = simhash.fuzzy_keys(a)
    keys = defaultdict(set)
    for i, key in zip(r.tolist(), k.tolist()):
        keys[i].add(key)
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                assert keys[i] & keys[j]
    monkeypatch.setattr(simhash, "BLOCK", 2)  # buckets cut into blocks, all of them
    df = spark.createDataFrame([(int(x),) for x in a.view(np.int64)], "fp long")
    assert _components(_common.connected_components(simhash.links(df)), a) == brute_components({int(v): int(np.uint64(np.int64(v).view(np.uint64))) for v in a.view(np.int64)})


def _components(df, a):
    out = {int(v): int(v) for v in a.view(np.int64)}
    out.update({r["node"]: r["component"] for r in df.collect()})
    return out


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).unionByName(spark.createDataFrame([(None, 1), (5, 5), (900, 901), (900, 901)], "src long, dst long"))
    got = {r["node"]: r["component"] for r in _common.connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 900: 900, 901: 900}


@pytest.mark.parametrize("n", [1, 3, 8])
def test_shards_are_even_and_gapless(spark, n):
    rng = random.Random(n)
    rows = [(k if k % 50 else None, rng.choice(["same text", None, "", "y" * rng.randint(1, 400), f"u{k}"]), "s") for k in range(900)] + [(1, "dup", "s")] * 3 + [(999, "L" * 5000, "s")]
    got = sharding.histogram_shards(frame(spark, rows), n).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((i, t) for i, t, _ in rows)
    size = defaultdict(int)
    for r in got:
        assert r["_size"] == len((r["text"] or "").encode()) + 1
        size[r["_shard"]] += r["_size"]
    slots = defaultdict(list)
    for r in got:
        slots[r["_shard"]].append(r["_slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(n))
    assert max(size.values()) - min(size.values()) <= 2 * 5001


def test_shards_of_hot_group_are_exact(monkeypatch, spark):
    """Brute force: the order and the targets; two thirds of the rows are one text, ids are of any spread."""
    monkeypatch.setattr(sharding, "ROWS_PER_TASK", 7)
    rng = random.Random(4)
    ids = [9223372036854775807, -9223372036854775808, 0, -1, None, None] + [rng.randrange(-(1 << 63), 1 << 63) for _ in range(594)]
    rows = [(i, "the same text" if k % 3 else rng.choice([None, "", f"t{k}" * rng.randint(1, 30)]), k) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _slot int").coalesce(1)
    got = sharding.histogram_shards(df, 5)
    assert got.columns == ["doc_id", "text", "_size", "_shard", "_slot"]
    order = sorted(rows, key=lambda r: (int(hashlib.md5((r[1] or "").encode()).hexdigest()[:15], 16), r[0] is not None, r[0] or 0, r[2]))
    total, before, want, slots = sum(len(t or "") + 1 for _, t, _ in rows), 0, [], Counter()
    for i, t, _ in order:
        shard = sum(before >= total * k // 5 for k in range(1, 5))
        want.append((i, t, len(t or "") + 1, shard, slots[shard]))
        slots[shard] += 1
        before += len(t or "") + 1
    key = lambda r: (r[3], r[4])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_packing_holds_every_token_once(spark):
    import tokenizers

    rng = random.Random(2)
    rows = [(k, rng.choice(["", None, "Hello, world.\nSo it is.", "a" * 3000, "naïve © text  with   spaces\t\n", "x y <|endoftext|> 123 4,5"]) if k % 3 else " ".join(rng.choice("alpha beta. gamma, delta\n12".split(" ")) for _ in range(rng.randint(1, 900))), rng.choice(["hot", "hot", "b", None])) for k in range(300)]
    got = packing.mixture_packed(frame(spark, rows)).collect()
    tok = tokenizers.Tokenizer.from_file(packing.vocabulary())
    tok.encode_special_tokens = True
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append((r["offset"], r["length"], r["source"]))
    for i, text, _ in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    total = Counter()
    for w in windows.values():
        at = 0
        for o, n, s in sorted(w):
            assert o == at
            at += n
            total[s] += n
        assert at <= 1024
    assert sum(sum(n for _, n, _ in w) < 1024 for w in windows.values()) <= 4 and sorted(windows) == list(range(len(windows)))
    share = total["hot"] / sum(total.values())
    for w in list(windows.values())[: len(windows) // 2]:
        assert abs(sum(n for _, n, s in w if s == "hot") / 1024 - share) <= 0.26


def test_packing_follows_targets(spark):
    rows = [(k, "one two three four five " * 40, "ab"[k % 2]) for k in range(200)]
    got = packing.mixture_packed(frame(spark, rows), targets={"a": 3, "b": 1}).filter("sequence_id < 10")
    n = {r["source"]: r["n"] for r in got.groupBy("source").agg(F.sum("length").alias("n")).collect()}
    assert n["a"] == pytest.approx(3 * n["b"], rel=0.1)


def round_robin(tokens, weights, quantum):
    """The sources of all quanta in their order, by counters: deficits grow by weight until one is half a quantum, which pays one."""
    left, deficit, out = [-(-n // quantum) for n in tokens], [Fraction(0)] * len(tokens), []
    while any(left):
        active = [s for s in range(len(left)) if left[s] and weights[s]] or [s for s in range(len(left)) if left[s]]
        w = [weights[s] if any(weights[x] for x in active) else Fraction(tokens[s]) for s in range(len(left))]
        wait = {s: (Fraction(1, 2) - deficit[s]) / w[s] for s in active}
        first = min(active, key=lambda s: (wait[s], s))
        for s in active:
            deficit[s] += wait[first] * w[s]
        deficit[first] -= 1
        left[first] -= 1
        out.append(first)
    return out


@pytest.mark.parametrize(("tokens", "weights"), [([900, 900], [3, 1]), ([40, 1000, 300], [4, 2, 2]), ([500, 7, 3, 1], [1, 1, 1, 1]), ([100, 0, 300, 200], [1, 2, 0, 5]), ([33, 90], [0, 0]), ([1], [1])])
def test_schedule_is_deficit_round_robin(tokens, weights):
    if not any(weights):
        weights = tokens
    s = packing.Schedule(tokens, weights, quantum=4, window=16)
    places = {int(p): k for k in range(len(tokens)) for p in s.place(k, np.arange(s.n[k]))}
    shares = [Fraction(int(w), packing.SCALE) * (not idle) for w, idle in zip(s.w, s.idle)]
    assert [places[p] for p in range(len(places))] == round_robin(tokens, shares, 4)


def test_targets_of_zero_and_dry_sources(spark):
    rows = [(k, "one two three four five " * 40, "abc"[k % 3]) for k in range(90)]
    got = packing.mixture_packed(frame(spark, rows), targets={"a": 0, "b": 3, "c": 1})
    first = {r["source"]: (r["lo"], r["hi"]) for r in got.groupBy("source").agg(F.min("sequence_id").alias("lo"), F.max("sequence_id").alias("hi")).collect()}
    assert first["b"][0] == first["c"][0] == 0 and first["b"][1] < first["c"][1] <= first["a"][0]
    assert packing.mixture_packed(frame(spark, rows), targets=dict.fromkeys("abc", 0)).agg(F.sum("length")).head()[0] == got.agg(F.sum("length")).head()[0]
    for bad in (-1, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            packing.mixture_packed(frame(spark, rows), targets={"a": bad})


def test_ids_are_those_of_the_tokenizers_library():
    import tokenizers

    tok = tokenizers.Tokenizer.from_file(packing.vocabulary())
    tok.encode_special_tokens = True
    ids, rng = packing.Ids(packing.vocabulary()), random.Random(8)
    points = [*range(0x250), 0x3A9, 0x4E2D, 0x1F600, 0x2028, 0x3000, 0xFEFF, 0x661]
    texts = ["".join(chr(rng.choice(points)) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    texts += ["<|endoftext|> it's  we'LL\n\n x", "a" * 100_000, " " * 1_200_000 + "x", "\n" * 600_000, "12 " * 1000]
    assert ids.ranked is not None
    for t in texts:
        assert np.frombuffer(ids.encode(t), np.uint16).tolist() == tok.encode(t, add_special_tokens=False).ids


def test_workers_drop_what_others_keep(monkeypatch):
    monkeypatch.setattr(_common, "_kept", {})
    mine, theirs = {1: 1}, {2: 2}
    _common.keep("mine", mine.clear)
    _common.keep("theirs", theirs.clear)
    _common.drop_kept("mine")
    assert mine and not theirs
    _common.drop_kept()
    assert not mine


def test_similar_documents_are_dropped(monkeypatch, spark):
    texts = [*near_texts(300, 3), None, "", " ", "one two", "One  TWO", "one two three"]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in texts]
    alike = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9
    want = _least_of_groups([[alike(a, b) for b in sets] for a in sets])
    fps = [simhash.fingerprint(t) for t in texts]
    far = [(i, j) for i in range(len(texts)) for j in range(i) if alike(sets[i], sets[j]) and (fps[i] ^ fps[j]).bit_count() > 4]
    assert len(far) > 10  # pairs that four bits do not link
    for block, hot in ((2048, 5), (2, 2)):
        monkeypatch.setattr(simhash, "BLOCK", block)
        monkeypatch.setattr(simhash, "HOT", hot)
        got = {r["doc_id"] for r in simhash.drop_near_copies(frame(spark, [(k, t, "s") for k, t in enumerate(texts)]), shingle=5, similarity=0.8).collect()}
        assert got == want
    none = frame(spark, [(1, "a", "x")]).filter("false")
    assert simhash.drop_near_copies(none, shingle=5, similarity=0.8).count() == 0


def test_cross_pairs_and_parities():
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 1 << 62, int(rng.choice([5, 40, 300, 2000]))).astype(np.uint64)
        for _ in range(3):
            keep = rng.random(len(base)) > rng.choice([0.02, 0.15])
            sets.append(np.unique(np.concatenate([base[keep], rng.integers(0, 1 << 62, int((~keep).sum() // 2)).astype(np.uint64)])))
    jaccard = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    key, node, size, rank, odd = [], [], [], [], []
    for k, s in enumerate(sets):
        first, cold = simhash.prefix(s, 0.8, np.array([], np.uint64))
        assert cold == len(first)
        for r, x in enumerate(first.tolist()):
            key.append(x)
            node.append(k)
            size.append(len(s))
            rank.append(r)
            odd.append(np.frombuffer(simhash.parity(s, simhash.PARITY).tobytes(), np.uint64))
    order = np.argsort(key, kind="stable")
    cols = [np.array(c)[order] for c in (key, node, size, rank)]
    alike = {(i, j) for i in range(len(sets)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8}
    assert len(alike) > 20
    for comp in (np.arange(len(sets)), np.arange(len(sets)) // 3 * 3, np.arange(len(sets)) % 2, np.where(np.arange(len(sets)) % 3 < 2, np.arange(len(sets)) // 3 * 3, np.arange(len(sets)))):
        got = {tuple(p) for x in simhash.cross_pairs(*cols, comp[cols[1]], np.array(odd)[order], 0.8) for p in x.tolist()}
        assert {p for p in alike if comp[p[0]] != comp[p[1]]} <= got and all(comp[i] != comp[j] for i, j in got)
    for i, j in alike:
        a, b = (simhash.wide_parity(sets[x]) or simhash.parity(sets[x], simhash.PARITY).tobytes() for x in (i, j))
        n = min(len(a), len(b))
        assert np.bitwise_count(simhash.fold(np.frombuffer(a, np.uint8), n) ^ simhash.fold(np.frombuffer(b, np.uint8), n)).sum() <= len(np.setxor1d(sets[i], sets[j]))


def test_large_group_of_near_copies(spark):
    rng = random.Random(11)
    base = [f"b{k}" for k in range(150)]
    docs = []
    for k in range(400):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"x{k}"
        docs.append((k, " ".join(w), "s"))
    docs += [(1000 + k, f"lone {k} " + " ".join(f"{k}y{j}" for j in range(30)), "s") for k in range(20)]
    sets = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t, _ in docs)]
    want = {docs[k][0] for k in _least_of_groups([[len(a & b) >= 0.8 * len(a | b) - 1e-9 for b in sets] for a in sets])}
    got = {r["doc_id"] for r in simhash.drop_near_copies(frame(spark, docs), shingle=5, similarity=0.8).collect()}
    assert got == want


def _least_of_groups(linked):
    kept, seen = set(), set()
    for k in range(len(linked)):
        if k in seen:
            continue
        kept.add(k)
        todo = [k]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [j for j, on in enumerate(linked[x]) if on]
    return kept
