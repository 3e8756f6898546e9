"""Suffix tree, quality, fingerprints, packing, secrets and mixing against brute force and on awkward rows."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.llm.data import DOCS, docs, empty
from voxmill.llm import common, fingerprint, mixing, packing, quality, secrets, suffix_tree

KEPT = ["doc_id", "text", "lang", "source", "n_chars"]


def words(text):
    return (text or "").encode().lower().split()


# -- suffix tree


def test_suffix_tree_base_scores_and_counts(spark):
    rows = [(r.doc_id, r.text) for r in common.read(spark, SMALL, "documents").collect()]
    train = lambda i: zlib.crc32(str(i).encode()) % 5 != 1
    count = Counter(w for i, t in rows if train(i) for w in [*words(t), b""])
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in suffix_tree.op1_suffix_tree(spark, SMALL).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        r, tokens = got[i], [*words(t), b""]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not train(i), len(tokens), sum(w in count for w in tokens), n)
        assert r.base_score == pytest.approx(sum(np.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens), rel=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


class _Brute:
    """The suffix tree of a small corpus, from dictionaries."""

    def __init__(self, texts, depth, least=suffix_tree.C_MIN):
        self.depth, runs = depth, Counter()
        for t in texts:
            w = [b"", *words(t), b""]
            for n in range(1, depth + 2):
                runs.update(tuple(w[k : k + n]) for k in range(n == 1, len(w) - n + 1))
        self.token = {k[0]: c for k, c in runs.items() if len(k) == 1}
        self.n, self.v = sum(self.token.values()), len(self.token)
        stored = {k: c for k, c in runs.items() if c >= least}
        self.moves = defaultdict(dict)
        for k, c in stored.items():
            if len(k) > 1:
                self.moves[k[:-1]][k[-1]] = c
        self.states = {}
        for s in sorted(self.moves, key=len):
            if len(s) == 1 or s[1:] in self.states:
                size, own = stored[s], {a: c - suffix_tree.DISCOUNT for a, c in self.moves[s].items() if len(s) == 1 or a in self.moves[s[1:]]}
                given = {a: 10 ** self.log10(s[1:], a) for a in own}
                rest = (1 - sum(own.values()) / size) / (1 - sum(given.values()))
                n = sum(self.moves[s][a] for a in own)
                gain = sum(self.moves[s][a] * np.log(own[a] / size / given[a]) for a in own) + (size - n) * np.log(rest)
                if gain >= suffix_tree.DIVERGENCE:
                    self.states[s] = (size, own, rest)

    def log10(self, context, token):
        while context and context not in self.states:
            context = context[1:]
        if not context:
            return np.log10((self.token.get(token, 0) + 0.5) / (self.n + 0.5 * (self.v + 1)))
        size, own, rest = self.states[context]
        return np.log10(own[token] / size) if token in own else np.log10(rest) + self.log10(context[1:], token)

    def score(self, text):
        w = [b"", *words(text), b""]
        return sum(self.log10(tuple(w[max(0, k - self.depth) : k]), w[k]) for k in range(1, len(w)))


def test_suffix_tree_equals_a_tree_of_dictionaries(spark):
    draw = random.Random(4)
    phrases = [" ".join(f"w{draw.randrange(60)}" for _ in range(draw.randint(2, 9))) for _ in range(20)]
    phrases += ["a b c d x", "e b c d y", "f c d z", "g d w"] * 4  # what follows d is told by ever more words before it
    rows = [(i, " ".join(draw.choice(phrases) if draw.random() < 0.7 else f"w{draw.randrange(90)}" for _ in range(draw.randint(0, 30)))) for i in range(400)]
    train = lambda i: i % 4 != 1
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for depth in (1, 4):
        brute = _Brute([t for i, t in rows if train(i)], depth)
        assert {len(s) for s in brute.states} == set(range(1, depth + 1))
        for options in ({}, {"hot_tokens": 20, "hot_runs": 200}, {"hot_tokens": 0, "hot_runs": 0}):
            got = {r.doc_id: r.score for r in suffix_tree.scores(table, F.col("doc_id") % 4 != 1, depth=depth, **options).collect()}
            assert got == pytest.approx({i: brute.score(t) for i, t in rows}, rel=1e-6), (depth, options)


def test_suffix_tree_states_are_distributions():
    brute = _Brute(["a b c a b c a b d", "b c a b c", "x b d x b d x b d", "a b c rare once"] * 9, 3)
    assert {len(s) for s in brute.states} >= {1, 2}
    for s in [*brute.states, (b"never", b"b"), (b"never",)]:
        assert sum(10 ** brute.log10(s, w) for w in [*brute.token, b"no such token"]) == pytest.approx(1, abs=1e-9), s


def test_hot_tables_find_every_key_and_no_other():
    rng = np.random.default_rng(6)
    keys = np.unique(rng.integers(0, 2**64 - 1, 5000, np.uint64))
    table = suffix_tree.Table(keys, np.arange(len(keys), dtype=np.float32))
    assert (table.get(keys) == np.arange(len(keys))).all()
    others = np.setdiff1d(rng.integers(0, 2**64 - 1, 5000, np.uint64), keys)
    assert np.isnan(table.get(others)).all() and len(suffix_tree.Table(keys[:0], np.zeros(0)).get(keys)) == len(keys)


def test_run_keys_are_those_of_sql(spark):
    a, b = (np.random.default_rng(k).integers(0, 2**64 - 1, 50, np.uint64, True) for k in (1, 2))
    rows = spark.createDataFrame(list(zip(a.view(np.int64).tolist(), b.view(np.int64).tolist(), strict=True)), "a long, b long")
    assert [r[0] for r in rows.select(F.xxhash64("a", "b")).collect()] == suffix_tree.run_key(a, b).view(np.int64).tolist()


def test_suffix_tree_blocks_name_runs_seldom_in_many_slices():
    draw = np.random.default_rng(4)
    before, after = np.repeat(draw.integers(1, 1 << 63, 500, dtype=np.uint64), 200), draw.integers(1, 1 << 63, 100_000, dtype=np.uint64)
    few, many = (suffix_tree._blocks(2, before, after, k) for k in (1, 1024))
    assert len(set(many.column(1).to_pylist())) == 1024
    size = lambda made: sum(len(b) for b in made.column(2).to_pylist())
    assert size(many) < 1.25 * size(few)
    back = lambda made: suffix_tree.pd.concat(x for _, rows in made.to_pandas().groupby("slice") for x in suffix_tree._merged(rows, 1))
    assert sorted(back(few).itertuples(index=False)) == sorted(back(many).itertuples(index=False))


def test_suffix_tree_leaves_no_counts_behind(spark):
    removed, real = [], common.removed
    common.removed = lambda session, path: removed.append(path) or real(session, path)
    try:
        rows = [(k, "a b c d e f " * 3) for k in range(40)]
        suffix_tree.learn(spark.createDataFrame(rows, "doc_id long, text string"))
    finally:
        common.removed = real
    assert [p.rsplit("/", 1)[-1] for p in removed if "length=" in p] == [f"length={n}" for n in (2, 3, 4, 5)] and len(removed) == 8


def test_suffix_tree_keeps_little_at_once_of_texts_that_recur(spark, monkeypatch):
    draw = random.Random(5)
    texts = [" ".join(f"w{draw.randrange(700)}" for _ in range(60)) for _ in range(120)]
    rows = [(k, t) for k, t in enumerate(texts * 6)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(2, "doc_id")
    options = {"train_when": F.col("doc_id") % 5 != 1, "hot_tokens": 0, "hot_runs": 0}
    want = {r.doc_id: r for r in suffix_tree.scores(table, **options).collect()}
    monkeypatch.setattr(suffix_tree, "AT_ONCE", 2000, raising=False)
    real, sizes = common.stored, defaultdict(list)

    def stored(df, name, *by):
        found = real(df, name, *by)
        sizes[name.rsplit("/", 1)[-1].split("-")[0]].append(sum(os.path.getsize(f.removeprefix("file://")) for f in found.inputFiles()))
        return found

    monkeypatch.setattr(common, "stored", stored)
    got = {r.doc_id: r for r in suffix_tree.scores(table, **options).collect()}
    assert {i: (r.n_tokens, r.n_known) for i, r in got.items()} == {i: (r.n_tokens, r.n_known) for i, r in want.items()}
    assert {i: r.score for i, r in got.items()} == pytest.approx({i: r.score for i, r in want.items()}, rel=1e-9)
    text = sum(len(t) for _, t in rows)
    assert max(sizes["scored"]) < text and len(sizes["grams3"]) > 1 and len(sizes["grams4"]) > 1


def test_suffix_tree_hashes_words_in_arrays(monkeypatch):
    """No call for each word; texts are cut as ``bytes.split`` cuts them, and equal words alone have equal hashes."""
    draw = random.Random(7)
    parts = ["a", "B", "b", "\0", " ", "\n", "\x0b", "\x1c", "\xa0", "é", "abcdefgh", "abcdefghi"]
    texts = [draw.choice([None, "", " ", "".join(draw.choice(parts) for _ in range(draw.randint(0, 12)))]) for _ in range(400)] + [f"w{k}" for k in range(3000)]

    def hashed(texts):
        batch, found, size = suffix_tree.pa.RecordBatch.from_pydict({"t": suffix_tree.pa.array(["left out", *texts])}).slice(1), {}, 0
        for _, first, h, lengths in suffix_tree._streams(iter([batch]), 0):
            assert first == size
            size += len(lengths)
            own = [(t or "").encode().lower().split() for t in texts[first:size]]
            assert lengths.tolist() == [len(w) + 1 for w in own]
            for word, key in zip([b"", *(x for w in own for x in [*w, b""])], h.tolist(), strict=True):
                assert found.setdefault(word, key) == key
        assert size == len(texts) and len(set(found.values())) == len(found) and found[b""] == int(suffix_tree.END)
        return found

    monkeypatch.setattr(suffix_tree, "BLOCK", 300)
    long = hashed(["x" * 64, "x" * 65, "x" * 64 + "y", "x" * 5000, "x" * 65])
    assert len(long) == 5
    monkeypatch.delattr(suffix_tree.xxhash, "xxh3_64_intdigest")
    assert len(hashed(texts)) > 3000


def test_suffix_tree_filter_lets_little_through():
    keys = np.random.default_rng(3).integers(0, 2**64 - 1, 200_000, np.uint64)
    bits = np.zeros(1 << 20, bool)  # five for each of the keys marked
    for at in suffix_tree.Filter.places(keys[:190_000], 20):
        bits[at.astype(np.int64)] = True
    found = suffix_tree.Filter(np.packbits(bits, bitorder="little"), 20).has(keys)
    assert found[:190_000].all() and found[190_000:].mean() < 0.09


def test_suffix_tree_joins_with_what_is_not_hot(spark):
    rows = [(k, f"a b c d e f g{k % 7} h{k % 7} i " * 3) for k in range(60)]
    tables = suffix_tree.learn(spark.createDataFrame(rows, "doc_id long, text string"))
    tree, *more = suffix_tree.hot(*tables, hot_tokens=9, hot_runs=12)
    for there, rest, name in zip((tree.symbols, tree.states, tree.moves), more, ("token", "key", "key"), strict=True):
        keys = np.array([r[0] for r in rest.select(name).collect()], np.int64).view(np.uint64)
        assert len(keys) and np.isnan(there.get(keys)).all()
    assert not np.isnan(tree.moves.cells["value"]).all()


def test_suffix_tree_awkward_rows(spark):
    got = suffix_tree.scores(docs(spark), F.col("doc_id") % 2 == 1).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in DOCS)
    assert all(r.n_tokens == 1 for r in got if r.doc_id in (2, 3, 4))
    assert all(r.held_out for r in got if r.doc_id is None)
    assert suffix_tree.scores(empty(spark), F.lit(True)).count() == 0
    (alone,) = suffix_tree.scores(docs(spark, DOCS[:1]), F.lit(False)).collect()  # nothing to learn from
    assert alone.n_known == 0 and np.isfinite(alone.score)


# -- quality


def test_quality_separates_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality.op3_quality(spark, d).collect()}
    marks = [(got[r.doc_id], r.quality) for r in common.read(spark, d, "labels").collect() if r.quality is not None]
    held = [(r.predicted, q) for r, q in marks if r.held_out]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert np.mean([p == q for p, q in held]) > 0.85


def test_quality_ignores_held_out_labels(spark):
    stats = common.cut(quality.with_statistics(common.read(spark, SMALL, "documents")))
    labels = common.read(spark, SMALL, "labels")
    other = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(quality.learn(stats, labels).weights, quality.learn(stats, other).weights)


def test_normal_equations_equal_a_direct_solution(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, quality.STATISTICS))
    y = (rng.random(400) < 0.4).astype(float)
    train = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y, strict=True)], "x array<double>, y double").repartition(5)
    a, b = quality.normal_equations(train, np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS))
    z = quality.fourier(x)
    assert np.allclose(a, z.T @ z) and np.allclose(b, z.T @ y)
    ridge = np.linalg.solve(a + quality.RIDGE * a[-1, -1] * np.eye(len(b)), b)
    wide = np.vstack([z, np.sqrt(quality.RIDGE * 400) * np.eye(z.shape[1])])
    assert np.allclose(ridge, np.linalg.lstsq(wide, np.append(y, np.zeros(z.shape[1])), rcond=None)[0], atol=1e-6)


def test_isotonic_never_falls():
    at, n = np.arange(6.0), np.full(6, 10.0)
    steps, levels = quality.isotonic(at, n, np.array([1, 3, 2, 6, 5, 9.0]))
    assert (np.diff(levels) >= 0).all() and (np.diff(steps) > 0).all()
    assert levels.tolist() == pytest.approx([0.1, 0.25, 0.55, 0.9])


def test_quality_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 1, 0), (6, None, 0), (9, 0, 1), (9, 0, 1)], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(docs(spark), labels, threshold=0.0)
    assert kept.columns == docs(spark).columns and kept.count() == len(DOCS)
    assert quality.keep_good(empty(spark), labels).count() == 0
    none = quality.keep_good(docs(spark), labels.limit(0))
    assert none.count() == len(DOCS)  # without labels every score is 0.5


# -- fingerprints


def _shingles(text, width=5):
    w = words(text)
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def test_fingerprints_follow_jaccard_similarity(spark):
    rows = sorted((r.doc_id, r.text or "") for r in common.read(spark, SMALL, "documents").collect())
    got = {r.doc_id: r for r in fingerprint.op7_fingerprint(spark, SMALL).collect()}
    assert sorted(got) == [i for i, _ in rows]
    gaps, by_text = [], defaultdict(set)
    for k, (i, text) in enumerate(rows):
        after = rows[k - 1][1]  # descending ids, round the end
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for value, (a, b) in ((r.near_edited, (text, edited)), (r.near_next, (text, after))):
            a, b = _shingles(a), _shingles(b)
            gaps.append(value - (len(a & b) / len(a | b) if a | b else 1.0))
        by_text[text].add(r.fingerprint)
        by_text[edited].add(r.edited_fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    assert abs(np.mean(gaps)) < 0.02 and np.sqrt(np.mean(np.square(gaps))) < 0.06


def test_densify_fills_every_bin(spark):
    arrays = [[17 if i == 5 else None for i in range(128)], [3 if i == 0 else 4 if i == 1 else None for i in range(128)], list(range(128))]
    one, two, full = (r.d for r in spark.createDataFrame([(a,) for a in arrays], "m array<bigint>").select(fingerprint.densify(F.col("m")).alias("d")).collect())
    assert set(one) == {17} and set(two) == {3, 4} and len(two) == fingerprint.BINS and full == arrays[2]


def test_fingerprints_awkward_rows(spark):
    found = fingerprint.document_fingerprints(docs(spark)).collect()
    got = {r.doc_id: r.fingerprint for r in found}
    assert len(found) == len(DOCS) and got[2] == got[3] == got[4] == "" and got[1] == got[6] == got[7] == got[8] != got[11]
    assert fingerprint.document_fingerprints(empty(spark)).count() == 0


def test_edited_fingerprints_have_a_row_for_each_row(spark):
    rows = sorted(((i is not None, i or 0), hashlib.md5(f"{'null' if i is None else i}:{t or ''}".encode()).hexdigest(), i, t or "") for i, t, *_ in DOCS)
    want = Counter()
    for k, (_, _, i, text) in enumerate(rows):
        after, half = rows[k - 1][3], len(text) // 2
        want[i, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprint.edited_fingerprints(docs(spark)).collect()) == want
    (alone,) = fingerprint.edited_fingerprints(docs(spark, DOCS[:1])).collect()
    assert alone.bits == alone.after
    assert fingerprint.edited_fingerprints(empty(spark)).count() == 0


# -- packing


def test_packing_is_whole_and_tight(spark):
    from tokenizers import Tokenizer

    rows = [(r.doc_id, r.text or "") for r in common.read(spark, SMALL, "documents").collect()]
    encode = Tokenizer.from_file(packing.public_tokenizer()).encode
    got = packing.op8_packing(spark, SMALL).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, text in rows:
        ids, at = [*encode(text, add_special_tokens=False).ids, 2], 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            part = np.array(ids[at : at + r.length], "<u4")
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(part.tobytes()))
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
    used = sum(r.length for r in got)
    assert len(by_seq) <= -(-used // packing.WINDOW) + max(1, 0.02 * len(by_seq))


def test_encoder_refuses_other_tokenizers(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = str(tmp_path / "cased.json")
    made = Tokenizer(models.WordLevel({w: k for k, w in enumerate(["[UNK]", "the", "The", "cat", "CAT", "cat,", "hat."])}, unk_token="[UNK]"))
    made.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    made.save(path)
    with pytest.raises(ValueError, match="word by word"):
        packing.Encoder(path)


def test_encoder_equals_encoding_whole_texts():
    from tokenizers import Tokenizer

    path = packing.public_tokenizer()
    texts = [t or "" for _, t, *_ in DOCS] + ["It's <|end|> a TEST, of. punctuation... 3.14, U.S.A. x,y;z", "<|endoftext|> Mixed CASE", "tab\there\r\nnew\x0bline\x1c", "a,,b, ,c. .d é, É. 你好, 世界."]
    plain = Tokenizer.from_file(path)
    for text, ids in zip(texts, packing.Encoder(path).ids([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text[:60]


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(3)
    lengths = sorted(rng.integers(1, 101, 400).tolist(), reverse=True)
    rooms = []
    for length, (window, offset) in zip(lengths, packing.best_fit(lengths, 100), strict=True):
        fits = [r for r in rooms if r >= length]
        if window == len(rooms):
            assert not fits
            rooms.append(100)
        else:
            assert rooms[window] == min(fits)
        assert offset == 100 - rooms[window]
        rooms[window] -= length


def test_packing_awkward_rows(spark):
    got = packing.pack(docs(spark), packing.public_tokenizer()).collect()
    assert Counter(r.doc_id for r in got if r.start == 0) == Counter(i for i, *_ in DOCS)
    assert {r.length for r in got if r.doc_id in (2, 3, 4)} == {1}
    long = [r for r in got if r.doc_id == 5]
    assert len(long) > 20 and sum(r.length == packing.WINDOW for r in long) == len(long) - 1
    assert packing.pack(empty(spark), packing.public_tokenizer()).count() == 0


# -- secrets


def _secrets(text):
    out = []
    for k, (kind, pattern, least) in enumerate((("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6), ("access", "(AKIA[A-Z0-9]+)", 20), ("hex", "([0-9a-f]+)", 24))):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text or "") if len(m[m.lastindex]) >= least]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out))


def test_secrets_match_a_search_of_each_text(spark):
    rows = {r.doc_id: r.text for r in common.read(spark, SMALL, "documents").collect()}
    for r in secrets.op9_secret_ledger(spark, SMALL).collect():
        assert r.spans == _secrets(rows[r.doc_id]) and r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()


def test_ledger_scans_each_pair_once(spark):
    table = docs(spark).select("doc_id", "text")
    ledger = common.cut(secrets.update(table))
    blobs = len({t or "" for _, t, *_ in DOCS})
    assert ledger.count() == blobs * len(secrets.ALL_RULES)
    assert secrets.update(table, ledger).count() == 0
    newer = (*secrets.RULES[:2], secrets.Rule("hex", "[0-9a-f]+", "[0-9a-f]{10}", least=10, version=2))
    more = secrets.update(table, ledger, newer)
    assert {(r.kind, r.version) for r in more.collect()} == {("hex", 2)} and more.count() == blobs
    both = ledger.unionByName(more)
    assert sum(r.n for r in secrets.findings(table, both, newer).select(F.size("found").alias("n")).collect()) >= sum(r.n for r in secrets.findings(table, ledger).select(F.size("found").alias("n")).collect())


def test_redaction_awkward_rows(spark):
    table = docs(spark)
    got = secrets.redact(table)
    assert got.columns == table.columns
    texts = {r.doc_id: r for r in got.filter("doc_id IS NOT NULL").collect()}
    assert got.count() == len(DOCS) and texts[2].text is None and texts[1].text == DOCS[0][1]
    assert texts[9].text == "[SECRET] [SECRET]" and texts[9].n_chars == len(texts[9].text) and texts[9].blob == "blob-9"
    assert "abcdefghij" not in texts[11].text and texts[11].text.startswith("ünïcödé \U0001f600 [SECRET] [SECRET] tail")
    assert secrets.redact(empty(spark)).count() == 0


def test_ledger_scans_each_version_once(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    key, hexa = "password = hunter2hunter2", "0123456789abcdef0123456789abcdef"
    first = spark.createDataFrame([("a.txt", 1, key), ("b.txt", 1, "nothing"), ("c.txt", 1, None)], "path string, version int, text string")
    later = spark.createDataFrame([("a.txt", 2, f"{key} {hexa}"), ("moved/a.txt", 2, key), ("b.txt", 2, "nothing")], "path string, version int, text string")
    n = len(secrets.ALL_RULES)
    assert secrets.advance(first, path).count() == 3 * n
    history = first.unionByName(later)
    ledger = secrets.advance(history, path)
    assert ledger.count() == 4 * n and ledger.select("blob", "kind", "version").distinct().count() == 4 * n
    found = {(r.path, r.version): [(s.kind, s.start, s.end) for s in r.found] for r in secrets.findings(history, ledger).collect()}
    one = [("assign", 0, len(key))]
    assert found == {("a.txt", 1): one, ("a.txt", 2): [*one, ("hex", len(key) + 1, len(key) + 33)], ("moved/a.txt", 2): one, ("b.txt", 1): [], ("b.txt", 2): [], ("c.txt", 1): []}
    newer = (*secrets.ALL_RULES[:2], secrets.Rule("hex", "[0-9a-f]+", "[0-9a-f]{10}", least=10, version=2))
    assert secrets.advance(history, path, newer).count() == 4 * n + 4
    assert secrets.advance(history, path, newer).count() == 4 * n + 4


def test_more_rules_find_keys_and_logins(spark):
    texts = {
        "-----BEGIN RSA PRIVATE KEY-----": ["private_key"], "see eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl now": ["signed_token"], "http://user:pass@host/x": ["url_login"],
        "ghp_" + "a1B2" * 8: ["issued_key"], "ghp_short": [], "http://host:80/a@b": [], "mail me: a@b.c": [], "eyJhbGciOiJI.only": [], "nothing here": [],
    }
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    got = secrets.findings(table, secrets.update(table)).collect()
    assert {r.text: [s.kind for s in r.found] for r in got} == texts


# -- mixing


def _targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    target, open_, rest = {}, set(names), share * sum(sizes.values())
    while open_:
        level = rest / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > cap * sizes[s]}
        for s in over or open_:
            target[s] = cap * sizes[s] if over else level * w[s]
        if not over:
            break
        rest -= sum(target[s] for s in over)
        open_ -= over
    return target


@pytest.mark.parametrize("per_bucket", [1, 3, 10_000])
def test_mix_meets_every_target(spark, per_bucket):
    table = common.read(spark, SMALL, "documents")
    got = mixing.mix(table, per_bucket=per_bucket).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    sizes = Counter()
    for r in table.collect():
        sizes[r.source] += len(words(r.text))
    target, taken = _targets(sizes), Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r.size
    assert all(taken[s] == int(target[s] + 1e-6) for s in sizes)
    again = mixing.mix(table.repartition(5), per_bucket=per_bucket).select("doc_id", "source", "size", "source_size", "target", "taken")
    assert sorted(got, key=str) == sorted(again.collect(), key=str)


def test_mix_splits_a_source_into_any_number_of_ranges(spark):
    rows = [(f"id-{k}", "word " * (k % 7), "a") for k in range(6000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id string, text string, source string"), per_bucket=1).collect()
    size = sum(k % 7 for k in range(6000))
    assert len(got) == 6000 and {r.target for r in got} == {1.5 * size} and sum(r.taken for r in got) == int(1.5 * size)
    assert all(r.size <= r.taken <= 2 * r.size for r in got)


def test_mix_awkward_rows(spark):
    got = mixing.mix(docs(spark))
    assert got.count() == len(DOCS)
    by_source = defaultdict(list)
    for r in got.collect():
        by_source[r.source].append(r)
        assert r.size == len(words(r.text))
    target = _targets({s: sum(r.size for r in rows) for s, rows in by_source.items()})
    for s, rows in by_source.items():
        assert rows[0].target == pytest.approx(target[s]) and target[s] - 3 <= sum(r.taken for r in rows) <= target[s]
    assert mixing.mix(empty(spark)).count() == 0 and mixing.copies(empty(spark)).count() == 0
    copies = mixing.copies(docs(spark))
    assert copies.columns == docs(spark).columns and {r.size for r in copies.collect()} <= {f"size-{i}" for i, *_ in DOCS}
    assert sum(len(words(r.text)) for r in copies.collect()) == sum(r.taken for r in got.collect())
