"""Prefix trie, vector codes and SimHash near copies against brute force and on awkward rows."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.llm.data import DOCS, docs, empty
from voxmill.llm import codes, common, simhash, trie

# -- prefix trie


def _rebuilt(rows, borrow):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    if not borrow:
        return own
    lead = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - int(math.fmod(c, 20)), [])[: lead[c]] + ts[lead[c] :] for c, ts in own.items()}


def _trie(rows, borrow=True):
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in sorted(_rebuilt(rows, borrow).items()):
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        words = len((p[-1][1] if p else "").encode().split())
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members[p]) - 1) * words
    return {
        (min(m), len(p)): (min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest())
        for p, m in members.items()
    }


def _conversations(seed, count=70):
    """Conversations that go different ways from few beginnings, some long, some alike."""
    draw = random.Random(seed)
    rows, told = [], []
    for c in draw.sample(range(-20, 3 * count), count):
        path = list(draw.choice(told))[: draw.randint(0, 12)] if told and draw.random() < 0.7 else []
        path += [(draw.choice(("user", "assistant", None)), draw.choice(("", None, "yes", "no no", "a longer turn of words"))) for _ in range(draw.choice((0, 1, 2, 5, 14)))]
        told.append(path or [("user", "hi")])
        rows += [(c, None if k == 0 and draw.random() < 0.3 else k, *t) for k, t in enumerate(told[-1])]
    draw.shuffle(rows)
    return rows


def _nodes(found):
    rows = found.nodes.collect()
    assert len({(r.conv_id, r.depth) for r in rows}) == len(rows)
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}


_SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("seed", "block", "span", "ids"), [(1, 256, 1024, 4096), (2, 3, 2, 2)])
def test_trie_is_that_of_all_prefixes(spark, monkeypatch, seed, block, span, ids):
    for name, value in (("BLOCK", block), ("SPAN", span), ("IDS", ids)):
        monkeypatch.setattr(trie, name, value)
    rows = _conversations(seed)
    own = F.col("conv_id")
    found = trie.prefix_trie(spark.createDataFrame(rows, _SCHEMA), base=own - own % 20, lead=F.crc32(own.cast("string")) % 4)
    assert _nodes(found) == _trie(rows)
    plain = trie.prefix_trie(spark.createDataFrame(rows, _SCHEMA))
    assert _nodes(plain) == _trie(rows, borrow=False)
    depth = {c: len(p) for c, p in _rebuilt(rows, False).items()}
    assert {r.conv_id: r.depth for r in plain.ends.collect()} == depth


def test_trie_of_one_long_conversation_in_many_tasks(spark):
    rows = [(0, k, "user", f"turn {k}") for k in range(1500)] + [(c, k, "user", f"turn {k}") for c in (20, 21, 40) for k in range(700 + c)] + [(20, 900, "user", "apart")]
    table = spark.createDataFrame(rows, _SCHEMA)
    pids = trie.numbered_turns(table, "conv_id", "turn", "role", "text").filter("kind = 'run' AND conv_id = 0").count()
    assert pids > 1
    assert _nodes(trie.prefix_trie(table)) == _trie(rows, borrow=False)


def test_trie_awkward_rows(spark):
    rows = [(5, 1, None, None), (5, 1, None, None), (5, None, "user", "first"), (None, 0, "user", "nobody's"), (7, None, "user", "first"), (2**60, 0, "u" * 300, "x" * 200_000), (-3, 0, "", "")]
    table = spark.createDataFrame([(*r, "extra", 1) for r in rows], _SCHEMA + ", digest string, depth int")
    assert _nodes(trie.prefix_trie(table)) == _trie(rows, borrow=False)
    assert trie.prefix_trie(spark.createDataFrame([], _SCHEMA)).nodes.count() == 0
    turnless = [(20, 0, "user", "a"), (21, 0, "user", "a")]
    assert _nodes(trie.prefix_trie(spark.createDataFrame(turnless, _SCHEMA), base=F.lit(-1).cast("long"), lead=F.lit(3))) == {(20, 0): (None, 2, 0, 1, 0, hashlib.sha256(b"20,21").hexdigest())}


# -- vector codes


def _lloyd(vectors, parts=8, entries=16, rounds=6):
    """Codes and codebooks in whole numbers, without any bounds."""
    x = [[v[p * len(v) // parts : (p + 1) * len(v) // parts] for p in range(parts)] for v in vectors]
    books = [[x[j][p] for j in range(min(entries, len(x)))] for p in range(parts)]
    apart = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b, strict=True))

    def assigned():
        return [[min(range(len(books[p])), key=lambda j: (apart(v[p], books[p][j]), j)) for p in range(parts)] for v in x]

    for _ in range(rounds):
        code = assigned()
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [v[p] for v, c in zip(x, code, strict=True) if c[p] == j]
                if mine:
                    books[p][j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    code = assigned()
    return code, [sum(apart(v[p], books[p][c[p]]) for p in range(parts)) for v, c in zip(x, code, strict=True)], books


@pytest.mark.parametrize(("scale", "spread"), [(1.0, 2), (16.0, 1.5)])
def test_codes_are_lloyds_with_ties(spark, scale, spread):
    draw = random.Random(3)
    rows = [(k, [draw.uniform(-spread, spread) for _ in range(16)], k % 3) for k in range(300)]
    got, entries = codes.compressed(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), scale=scale)
    vectors = [[math.floor(scale * float(np.float32(x))) for x in v] for _, v, _ in rows]
    code, error, books = _lloyd(vectors)
    assert entries.tolist() == books
    assert {r.id: (list(r.codes), r.error) for r in got.collect()} == {k: (code[k], error[k]) for k in range(300)}


def test_bounds_save_distances_and_change_nothing():
    rng = np.random.default_rng(4)
    centres = rng.integers(-400, 400, (8, 16, 8))
    x = np.stack([centres[p, rng.integers(0, 16, 2000)] for p in range(8)], 1) + rng.integers(-30, 30, (2000, 8, 8))
    books = codes.Codebooks(x[:16].transpose(1, 0, 2).copy())
    code, upper, lower = codes.first_codes(x, books)
    asked = []
    for _ in range(6):
        added = codes._sums(x, code, 16)
        books = books.replaced(added[..., :-1], added[..., -1])
        upper, lower = codes._up(upper).astype(float), codes._down(lower).astype(float)
        code, upper, lower, n = codes.next_codes(x, books, code, upper, lower)
        asked.append(n / code.size / 16)
        want = codes.first_codes(x, books)
        assert (code == want[0]).all()
        far = np.sqrt(np.stack([codes.squared(x, books.entries[None, :, j]) for j in range(16)], 2).astype(float))
        assert (lower <= far).all() and (upper >= np.take_along_axis(far, code[..., None], 2)[..., 0]).all()
    assert max(asked) < 0.6 and asked[-1] < 0.2


def test_codes_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(None, [1.0, 2.0], 1), (2, None, 1), (3, [1.0, None], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], None), (6, [], None), (7, [0.5] * 9, None), (7, [-0.5] * 9, 2), (7, [-0.5] * 9, 2), (2**60 + 1, [0.5, 1.0], 2)]
    table = spark.createDataFrame([(*r, "c", b"x") for r in rows], "vec_id long, embedding array<double>, label int, code string, x binary")
    got, entries = codes.compressed(table, scale=2.0)
    order = [6, 7, 7, 7, 2**60 + 1, None]
    vectors = [[0] * 16, [-1] * 9 + [0] * 7, [-1] * 9 + [0] * 7, [1] * 9 + [0] * 7, [1, 2] + [0] * 14, [2, 4] + [0] * 14]
    by_hex = sorted(range(1, 4), key=lambda k: np.array(vectors[k], "<i4").tobytes())
    vectors[1:4] = [vectors[k] for k in by_hex]
    code, error, books = _lloyd(vectors)
    assert entries.tolist() == books
    want = sorted(((str(i), c, e) for i, c, e in zip(order, code, error, strict=True)), key=str)
    assert sorted(((str(r.id), list(r.codes), r.error) for r in got.collect()), key=str) == want
    none, entries = codes.compressed(table.limit(0))
    assert none.count() == 0 and entries is None
    with pytest.raises(Exception, match="smaller than"):
        codes.compressed(spark.createDataFrame([(1, [1e30], 0)], "vec_id long, embedding array<double>, label int"))[0].count()


def test_codes_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = codes.op12_vector_codes(spark, str(tmp_path))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and out.count() == 0


# -- SimHash


def _fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _labels(rows, radius=2):
    """The smallest id that each (id, fingerprint) reaches."""
    values = sorted({f for _, f in rows})
    root = {f: f for f in values}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= radius and find(a) != find(b):
                root[find(a)] = find(b)
    low = {}
    for i, f in rows:
        low[find(f)] = min((x for x in (low.get(find(f)), i) if x is not None), default=None)
    return {f: low[find(f)] for f in values}


def test_fingerprint_is_the_majority_of_bits(monkeypatch):
    texts = ["", " \n", "one", "One TWO", "a b c d e a b c d e", "ünï cödé \U0001f600 x y", " ".join(f"w{k % 71}" for k in range(3000))]
    assert [simhash.simhash(t.encode()) for t in texts] == [_fingerprint(t) for t in texts]
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert [simhash.simhash(t.encode()) for t in texts] == [_fingerprint(t) for t in texts]


def test_forest_finds_all_within_the_radius():
    draw = random.Random(6)
    shard, values = [], []
    for s in range(30):
        base = draw.getrandbits(64)
        some = {base ^ sum(1 << draw.randrange(64) for _ in range(draw.randint(0, 5))) & (2**64 - 1) for _ in range(draw.choice((1, 2, 60)))}
        shard += [s] * len(some)
        values += sorted(some)
    forest = simhash.Forest(np.array(shard), np.array(values, np.uint64))
    got = {(int(a), int(b)) for x, y in forest.within(np.arange(len(values)), 2) for a, b in zip(x, y, strict=True)}
    assert got == {(a, b) for a in range(len(values)) for b in range(len(values)) if a != b and shard[a] == shard[b] and (values[a] ^ values[b]).bit_count() <= 2}
    assert len(got) > 500


@pytest.mark.parametrize("limit", [3, simhash.SHARD])
def test_shards_keep_pairs_together(spark, monkeypatch, limit):
    """One large group of values that are nearly alike, and strangers."""
    draw = random.Random(7)
    base = draw.getrandbits(64)
    near = {base ^ sum(1 << b for b in draw.sample(range(40), draw.randint(0, 4))) for _ in range(400)}
    table = {i: f for i, f in enumerate([*near, *(draw.getrandbits(64) for _ in range(200)), base, 0, 3, 7])}
    rows = spark.createDataFrame([(i, f - 2**64 if f >> 63 else f) for i, f in table.items()], "id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: rows)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_copies(docs(spark), shard=limit).collect()}
    want = _labels([*table.items()])
    assert got == {i: (f, want[f]) for i, f in table.items()} and len(set(want.values())) > 150


def test_no_shard_is_large(spark):
    """16,384 values that differ in their lowest 14 bits alone."""
    values = spark.range(1 << 14).select(F.col("id").alias("fp"))
    dealt = simhash.shards(values)
    sizes = dealt.groupBy("fixed", F.col("fp").bitwiseAND(F.col("fixed"))).count()
    assert sizes.agg(F.max("count")).first()[0] <= simhash.SHARD


def test_simhash_on_documents(spark):
    rows = [(r.doc_id, _fingerprint(r.text)) for r in common.read(spark, SMALL, "documents").collect()]
    want = _labels(rows)
    got = simhash.op13_simhash(spark, SMALL).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{f:016x}", want[f]) for i, f in rows} and len(got) == len(rows)


def test_simhash_awkward_rows(spark):
    rows = [(i, _fingerprint(t)) for i, t, *_ in DOCS]
    want = _labels(rows)
    got = simhash.near_copies(docs(spark)).collect()
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in got], key=lambda r: str(r)) == sorted([(i, f"{f:016x}", want[f]) for i, f in rows], key=lambda r: str(r))
    assert simhash.near_copies(empty(spark)).count() == 0
