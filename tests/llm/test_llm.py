"""The corpus operators: brute-force versions, round trips, held-out accuracy and odd rows."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
import regex
import xxhash
import zstandard
from barloom.llm import (
    blocks,
    bpe,
    components,
    exact_dedup,
    lm,
    mixing,
    quality,
    queries,
    shingles,
    simhash,
    spotsigs,
    token_trie,
    toxicity,
    url_filter,
)
from barloom.llm.common import checkpoint, input_bytes, unsized
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, source string, id string, keep_id int, score string, size string, bucket int, fp string, pattern int, y string, held_out int"
LONG = "word " * 30_000 + "x" * 50_000


def row(i, text, source="a"):
    return (i, text, source, "id", 1, "s", "z", 2, "f", 3, "y", 4)


ODD = [
    row(1, "The cat sat on the mat with a hat."),
    row(2, "the CAT sat on the mat with a hat."),
    row(3, None),
    row(4, ""),
    row(5, " \t\n\x0b "),
    row(6, LONG, None),
    row(None, "no identifier here", "b"),
    row(None, "no identifier here", "b"),
    row(7, "Élan über naïve\u00a0Straße \x1c 日本語 <|endoftext|> don't 12", "b"),
    row(7, "Élan über naïve\u00a0Straße \x1c 日本語 <|endoftext|> don't 12", "b"),
    row(8, "one"),
    row(9, "THE CAT SAT ON THE MAT WITH A HAT.", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text", "source"]).to_pylist()
    return [(r["doc_id"], r["text"] or "", r["source"]) for r in t]


def words(text):
    return (text or "").encode().split()


def lower(text):
    return (text or "").encode().lower()


# Exact dedup


def test_dedup_matches_sql(spark, sf_dir):
    got = sorted(map(tuple, queries.op4_exact_dedup(spark, sf_dir).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = sorted(con.execute(queries.OP4_SQL).fetchall())
    assert got == want and len(got) == len(documents(sf_dir))


@pytest.mark.parametrize("keep", ["min", "max"])
def test_dedup_odd_rows(odd, keep):
    rows = exact_dedup.tree_dedup(odd.repartition(7), keep=keep, fan_in=2).collect()
    assert len(rows) == len(ODD)
    by_text = {}
    for r in ODD:
        by_text.setdefault(hashlib.sha256(lower(r[1])).hexdigest(), []).append(r[0])
    kept = Counter()
    for r in rows:
        ids = [i for i in by_text[r.text_sha256] if i is not None]
        assert r.keep_id == ((min if keep == "min" else max)(ids) if ids else None)
        assert r.group_size == len(by_text[r.text_sha256])
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1} and set(kept) == set(by_text)


def test_dedup_drop_keeps_columns(odd, none):
    left = exact_dedup.drop_copies(odd, keep="max")
    assert left.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == [(False, k) for k in range(4, 10)] + [(True, 0)]
    assert exact_dedup.drop_copies(none).count() == 0 and exact_dedup.tree_dedup(none).count() == 0


# BPE


def encoded(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    raw = np.array(ids, dtype="<u4").tobytes()
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_equals_library(spark, odd, none, sf_dir):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = {r.doc_id: tuple(r)[1:] for r in queries.op2_bpe(spark, sf_dir).collect()}
    assert got == {i: encoded(tokenizer, t) for i, t, _ in documents(sf_dir)}
    rows = bpe.encode(odd, path).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == Counter((r[0], *encoded(tokenizer, r[1])) for r in ODD)
    assert bpe.encode(none, path).count() == 0


def test_bpe_decode_round_trip(spark):
    path = queries.tokenizer_path("word_bpe_49k.json")
    rows = [(1, [320, 49407, 1]), (2, []), (3, None)]
    got = dict(map(tuple, bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), path).collect()))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    assert got == {1: tokenizer.decode([320, 49407, 1], skip_special_tokens=False), 2: "", 3: ""}


# LM scoring


def model_scores(rows):
    """Brute force with dictionaries: one pass from left to right, with the history as the state."""
    count, pair, tokens = Counter(), {}, []
    for i, t in rows:
        w = [*lower(t).split(), b""]
        tokens.append((i, w))
        if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2:
            count.update(w)
            for h, x in zip([None, *w], w):
                pair.setdefault(h, Counter())[x] += 1
    n, v = sum(count.values()), len(count)
    out = []
    for i, w in tokens:
        base = score = 0.0
        state = None
        for x in w:
            p = (count[x] + 1) / (n + v + 1)
            base += math.log10(p)
            if state in pair:
                met, kinds = sum(pair[state].values()), len(pair[state])
                p = (pair[state][x] + kinds * p) / (met + kinds)
            score += math.log10(p)
            state = x
        out.append((i, len(w), sum(count[x] > 0 for x in w), n, base, score))
    return out


def test_lm_against_brute_force(spark, odd, none, sf_dir):
    for df, rows in ((odd, [(r[0], r[1]) for r in ODD]), (spark.read.parquet(f"{sf_dir}/documents.parquet"), [r[:2] for r in documents(sf_dir)])):
        got = sorted(tuple(r) for r in lm.score(df).drop("held_out").na.fill(-1, ["doc_id"]).collect())
        want = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in model_scores(rows))
        assert [g[:4] for g in got] == [w[:4] for w in want]
        assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-9)
    held = [r for r in lm.score(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm.score(none).count() == 0


def test_lm_reads_rows_in_any_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    mixed = docs.orderBy(F.rand()).repartition(5, F.rand())
    got = {r.doc_id: (r.score, r.base_score, r.n_known) for r in lm.score(mixed).collect()}
    want = {r.doc_id: (r.score, r.base_score, r.n_known) for r in lm.score(docs).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)


def test_lm_weights_of_a_state_sum_to_one():
    train = ([1, 2, 3], [b"a b a c a b d", b"b a b", b"c c a"])
    z, buckets = 0.0, 3
    # every word after every history, and an unknown one, in texts that aren't training
    probe = [f"{h} {w}".encode() for h in ("a", "b", "c", "d") for w in ("a", "b", "c", "d", "unknown")] + [b"a", b"b", b"c", b"d"]
    docs = (train[0] + [None] * len(probe), train[1] + probe)
    t = lm.Tokens(docs, [True] * 3 + [False] * len(probe))
    lists = lm.ask_counts(t, buckets)
    told = {k: x for k, x in enumerate(lists) if x}
    told = {k: lm.sum_counts([x])[0] for k, x in told.items()}
    automaton = lm.Automaton(t, told, buckets)
    n, v = int(t.train.sum()), 5
    weights = 10 ** automaton.log_weights(t, n + v + 1.0)
    first = np.cumsum(t.sizes) - t.sizes
    second = {docs[1][k]: weights[first[k] + 1] for k in range(3, len(docs[1]))}
    for h in ("a", "b", "c", "d"):
        total = sum(second[f"{h} {w}".encode()] for w in ("a", "b", "c", "d", "unknown")) + second[h.encode()]
        assert total == pytest.approx(1.0)


def test_lm_counts_have_64_bits():
    t = lm.Tokens(([1], [b"x y"]), [True])
    (data,) = lm.ask_counts(t, 1)
    keys = lm.Lists(t, 1).keys(0)
    big = blocks.squeeze(keys + lm.planes(np.full(len(t.words), 3 << 33)) + lm.planes(np.full(len(t.pair_word), 3 << 33)))
    a = lm.Automaton(t, {0: lm.sum_counts([data, big])[0]}, 1)
    assert a.word.tolist() == [(3 << 33) + 1] * 3 and a.met.tolist() == [(3 << 33) + 1] * 3
    with pytest.raises(RuntimeError):
        lm.Automaton(lm.Tokens(([1], [b"x z"]), [True]), {0: lm.sum_counts([data])[0]}, 1)


# Mixing


def test_mixing_targets():
    assert mixing.targets({"a": 100, "b": 100, "c": 100}) == pytest.approx({"a": 187.5, "b": 75.0, "c": 37.5})
    got = mixing.targets({"a": 10, "b": 500, None: 90})
    assert got["a"] == 30 and got["b"] == pytest.approx(570 * 2 / 3) and got[None] == pytest.approx(190)
    assert mixing.targets({"a": 0}) == {"a": 0.0}


def test_flow_repeats_as_little_as_it_can():
    # two sources share a pattern; the quotas can be met with one pass each but for 20 tokens
    flow = mixing.min_cost_flow([(50, [0]), (50, [0, 1]), (10, [1])], [60, 60])
    assert sum(n for (_, j), n in flow.items() if j == 0) == 60 and sum(n for (_, j), n in flow.items() if j == 1) == 60
    assert flow[0, 0] <= 60


def brute_flow_cost(patterns, quotas):
    """Least cost by trying all token counts of a tiny network."""
    import itertools

    routes = [(i, j) for i, (_, m) in enumerate(patterns) for j in m]
    best = None
    for take in itertools.product(*[range(3 * patterns[i][0] + 1) for i, _ in routes]):
        by_i, by_j = Counter(), Counter()
        for (i, j), n in zip(routes, take):
            by_i[i] += n
            by_j[j] += n
        if all(by_j[j] == q for j, q in enumerate(quotas)) and all(by_i[i] <= 3 * s for i, (s, _) in enumerate(patterns)):
            cost = sum(k * k * min(s, max(0, by_i[i] - k * s)) for i, (s, _) in enumerate(patterns) for k in range(3))
            best = cost if best is None else min(best, cost)
    return best


def test_flow_is_cheapest():
    rng = random.Random(5)
    for _ in range(15):
        patterns = [(rng.randint(1, 3), sorted(rng.sample(range(2), rng.randint(1, 2)))) for _ in range(3)]
        quotas = [rng.randint(0, 5), rng.randint(0, 5)]
        want = brute_flow_cost(patterns, quotas)
        if want is None:
            continue
        flow = mixing.min_cost_flow(patterns, quotas)
        by = Counter()
        for (i, _), n in flow.items():
            by[i] += n
        assert sum(k * k * min(s, max(0, by[i] - k * s)) for i, (s, _) in enumerate(patterns) for k in range(3)) == want
        assert sum(flow.values()) == sum(quotas)


def test_mixing_documents(spark, sf_dir):
    got = queries.op5_mixing(spark, sf_dir).toPandas()
    size = {i: len(words(t)) for i, t, _ in documents(sf_dir)}
    source = {i: s for i, _, s in documents(sf_dir)}
    assert {r.doc_id: r["size"] for _, r in got.iterrows()} == size
    assert (got["taken"] <= 3 * got["size"]).all()
    whole = Counter()
    for i, n in size.items():
        whole[source[i]] += n
    goal = mixing.targets(dict(whole))
    got["source"] = got["doc_id"].map(source)
    for s, part in got.groupby("source"):
        assert part["target"].iloc[0] == pytest.approx(goal[s]) and part["source_size"].iloc[0] == whole[s]
        assert abs(part["taken"].sum() - goal[s]) <= part["size"].max() / 2 + 1
    again = queries.op5_mixing(spark, sf_dir).toPandas()
    assert dict(zip(got["doc_id"], got["taken"])) == dict(zip(again["doc_id"], again["taken"]))


def test_mixing_odd_rows(spark, odd, none):
    got = mixing.mix(odd).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], len(words(r[1]))) for r in ODD)
    assert mixing.mix(none).count() == 0 and mixing.mixed_rows(none).count() == 0
    rows = mixing.mixed_rows(odd)
    assert rows.columns == odd.columns
    assert sum(len(words(r.text)) for r in rows.collect()) == sum(r.taken for r in got)
    shared = spark.createDataFrame([(1, "a b c", ["x", "y"]), (2, "a b", ["y", "x", "x"]), (3, "d e", ["y"]), (4, "f", [])], "doc_id long, text string, source array<string>")
    assert {tuple(r.pattern) for r in mixing.mix(shared).collect()} == {("x", "y"), ("y",), (None,)}


# SimHash


def brute_fingerprint(text):
    w = lower(text).split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows):
    f = [brute_fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (f[a] ^ f[b]).bit_count() <= 4:
                up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return Counter((i, f"{f[k]:016x}", least.get(root(k))) for k, (i, _) in enumerate(rows))


def test_simhash_against_brute_force(spark, odd, none, sf_dir):
    docs = [r[:2] for r in documents(sf_dir)]
    assert Counter(map(tuple, queries.op7_simhash(spark, sf_dir).collect())) == brute_groups(docs)
    assert Counter(map(tuple, simhash.near_groups(odd).collect())) == brute_groups([r[:2] for r in ODD])
    assert simhash.near_groups(none).count() == 0


def test_simhash_large_bucket_in_tiles(spark, monkeypatch):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 90:
        x = rng.choice(sorted(fps))
        for b in rng.sample(range(64), rng.randint(1, 7)):
            x ^= 1 << b
        fps.add(x)
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "TILE", 8)
    monkeypatch.setattr(components, "AT_ONCE", 0)
    signed = [(x - 2**64 if x >= 2**63 else x,) for x in fps]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long"), 4, 16)
    got = {r.node: r.root for r in components.components(links).collect()}
    up = {x: x for (x,) in signed}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a,) in signed:
        for (b,) in signed:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 4 and root(a) != root(b):
                up[max(root(a), root(b))] = min(root(a), root(b))
    assert {x: got.get(x, x) for (x,) in signed} == {x: root(x) for (x,) in signed}


def test_toxicity_restores_only_what_may_weigh(monkeypatch):
    rng = random.Random(5)
    counts = np.random.default_rng(5).integers(0, 50, toxicity.SIGNS**4).astype(float)
    stems = ["idiot", "ass", "foolish", "aabb", "dull", "eel", "zzz", "scum", "o", "stupid", "kisss", "naïve", "ℂℂab", "ßoo", "кооп", "１２ab"]
    lexicon = {"idiot": 2.0, "ass": 1.6, "fool*": 1.9, "aab": 1.7, "dul": 1.5, "scum*": 2.5, "stup*": 1.8, "stupid*": 2.1, "eel": 1.5, "ab": 1.5, "кооп": 1.6, "kooll*": 1.7}
    model = toxicity.Model(toxicity.smooth(counts), lexicon, np.zeros(4))
    chunks = set()
    for _ in range(4000):
        word = rng.choice(stems) if rng.random() < 0.6 else "".join(rng.choices("aabdefiklosu", k=rng.randint(1, 9)))
        word = "".join(c * rng.choice((1, 1, 1, 2, 2, 3)) if rng.random() < 0.4 else c for c in word)
        word = word.upper() if rng.random() < 0.1 else word.replace("i", "1").replace("o", "0") if rng.random() < 0.2 else word
        chunks.add(rng.choice(("", "", '"', "(")) + word + rng.choice(("", "", ".", "!!", ",", "-x", "s'")))
    weighs = [(c, model.weighed(model.start().words(c))) for c in sorted(chunks)]
    assert sum(1 for _, w in weighs if w) > 100 and [(c, model.chunk(c)) for c, _ in weighs] == weighs
    called, real = [], toxicity.Channel.without_doubles
    monkeypatch.setattr(toxicity.Channel, "without_doubles", lambda self, word: called.append(word) or real(self, word))
    toxicity.LIVE.clear()
    model.score(["Hello, happy butter; pepper: letter running hill foolls"])
    assert called == ["foolls"]


def test_components_keep_the_estimate_of_their_size_small(spark, monkeypatch):
    """The estimate is a number on the driver; each round's joins multiply it, and its digits doubled until they filled it."""
    sizes, real = [], components.checkpoint

    def seen(df):
        out = real(df)
        sizes.append(input_bytes(out).bit_length())
        return out

    monkeypatch.setattr(components, "checkpoint", seen)
    monkeypatch.setattr(components, "AT_ONCE", 0)
    path = [(i, i + 1) for i in range(40)]
    random.Random(3).shuffle(path)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)}
    assert len(sizes) > 8 and max(sizes) <= 63


def test_checkpoint_of_unknown_size_keeps_rows_partitions_and_order(spark):
    rows = spark.createDataFrame([(i % 7, str(i), None) for i in range(50)], "a long, b string, c double")
    many = rows
    for k in range(3):
        many = many.join(rows.select(F.col("b").alias(f"b{k}")), F.col("b") == F.col(f"b{k}"))
    many = many.select("a", "b", "c").repartition(3, "a").sortWithinPartitions("a")
    written = checkpoint(many)
    cut = unsized(written)
    assert input_bytes(cut) == 2**63 - 1 and cut.schema == many.schema
    assert cut.rdd.glom().collect() == written.rdd.glom().collect()
    assert Counter(map(tuple, cut.collect())) == Counter(map(tuple, rows.collect()))


@pytest.mark.parametrize("n, parts", [(10, 6), (10**9, 7), (10**11, 8)])
def test_simhash_parts_follow_the_number_of_fingerprints(n, parts):
    lengths = simhash.parts_for(n)
    assert len(lengths) == parts and sum(lengths) == 64
    rng = np.random.default_rng(n)
    a = rng.integers(0, 2**64, 200, dtype=np.uint64)
    b = a.copy()
    for k in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)
    assert (simhash._keys(a, lengths) == simhash._keys(b, lengths)).any(axis=1).all()


def clashing(spark):
    """Rows with columns named as the operators' own might be, a map, and rows that differ only in which column is null."""
    names = ["_kept_id", "_sha", "_row", "_n", "_copies", "_gone", "_copy_id", "_mix_id", "_gone_i", "Pattern"]
    text = "a few words of a text that repeats, in more than five words"
    rows = [(1, text, None, "en"), (1, text, "en", None), (1, text, "en", None), (2, "another " * 9, "a", "en"), (None, None, None, None)]
    schema = "doc_id long, text string, source string, lang string, tags map<string, int>, " + ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([(*r, {"k": 1}, *names) for r in rows], schema)


def test_stages_with_clashing_columns(spark):
    df = clashing(spark)
    once = exact_dedup.drop_copies(df, keep="max")
    got = once.collect()
    assert once.columns == df.columns and sorted((r.doc_id or 0, r.source, r.lang) for r in got if r.doc_id == 1) == [(1, None, "en")]
    assert len(got) == 3 and all(r.tags == {"k": 1} and r._sha == "_sha" for r in got)
    near = shingles.keep_one(df)
    assert near.columns == df.columns and near.count() == 5
    mixed = mixing.mixed_rows(df)
    rows = mixed.collect()
    assert mixed.columns == df.columns and all(r._row == "_row" and r._n == "_n" for r in rows)
    want = Counter()
    for r in mixing.mix(df).collect():
        want[r.doc_id, tuple(r.pattern)] += r.copies
    assert Counter((r.doc_id, (r.source,)) for r in rows) == Counter({k: n for k, n in want.items() if n})
    assert {r.lang for r in rows if r.doc_id == 1 and r.source is None} <= {"en"}


# Near copies by shingles


def brute_survivors(rows):
    """Identifiers left when documents of five-word Jaccard 0.8 or more are linked; all pairs are compared."""
    sets = []
    for _, t in rows:
        w = lower(t).split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n, m = len(sets[a]), len(sets[b])
            if 5 * min(n, m) >= 4 * max(n, m) and 5 * (both := len(sets[a] & sets[b])) >= 4 * (n + m - both):
                up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    return set(least.values())


def test_run_hashes_tell_runs_apart():
    rng = random.Random(1)
    texts = [b" \t".join(rng.choices([b"a", b"B", b"cc", b"d\xc3\xa9"], k=rng.randint(0, 12))) for _ in range(400)] + [b"", b" \n", b"a " * 3000]
    found = {}
    here = shingles.Block(texts, 5, 40)
    for t, runs, hashes in zip(texts, here.runs, here.sets):
        w = t.lower().split()
        want = [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))]
        assert len(runs) == len(want) and np.array_equal(np.unique(runs), hashes) and np.array_equal(shingles.shingles(t, 5), hashes)
        for run, h in zip(want, runs.tolist()):
            assert found.setdefault(run, h) == h
    assert len(set(found.values())) == len(found)
    assert dict(zip(here.keys.tolist(), here.counts.tolist())) == Counter(int(h) >> 24 for x in here.sets for h in {int(y) >> 24 << 24 for y in x})


def test_run_hashes_of_a_block_keep_little_memory():
    """Powers for all bytes of a block, 16 bytes for each, stayed in the worker."""
    rng = random.Random(2)
    texts = [b"", b" "] + [" ".join(f"w{rng.randrange(9999)}" for _ in range(rng.choice((1, 3, 50, 3000)))).encode() for _ in range(800)]
    rng.shuffle(texts)
    shingles.POWERS.clear()
    found, at = shingles.run_hashes(texts, 5)
    assert sum(map(len, texts)) > 3 << 20 and max(map(len, shingles.POWERS.values())) < 3 << 19
    texts[5:5] = [b"alone " * 400_000]
    more, ends = shingles.run_hashes(texts, 5)
    assert len(ends) == len(texts) + 1 and ends[-1] == len(more)
    assert np.array_equal(np.concatenate([more[: ends[5]], more[ends[6] :]]), found) and at[5] == ends[5]
    for t, a, b in zip(texts, ends, ends[1:]):
        assert np.array_equal(more[a:b], shingles.run_hashes([t], 5)[0])


def test_workers_keep_what_one_operator_needs():
    """What the classifier and the shingles kept stayed in the workers while texts were encoded."""
    toxicity.Model(np.zeros(27**4), {}, np.zeros(4)).start()
    assert toxicity.LIVE
    shingles.POWERS.clear()
    shingles.shingles(b"a b", 5)
    assert shingles.POWERS and not toxicity.LIVE
    spec = bpe.load(queries.tokenizer_path("word_bpe_49k.json"))
    known = bpe.tokenizer(spec)
    assert not shingles.POWERS and len(bpe.pieces(spec)) and bpe.tokenizer(spec) is known


def edited_copies(rng, n_base, n_copies, length=120):
    """Documents, and copies of them with a few words changed: likeness on both sides of 0.8."""
    rows = []
    for _ in range(n_base):
        base = [f"w{rng.randrange(3000)}" for _ in range(length)]
        for c in range(n_copies):
            copy = list(base)
            for p in rng.sample(range(length), rng.randint(0, 4) if c else 0):
                copy[p] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("tile, rounds", [(1024, 2), (4, 0)])
def test_near_copies_against_brute_force(spark, monkeypatch, tile, rounds):
    import corpus_pipeline as c

    monkeypatch.setattr(shingles, "ROUNDS", rounds)
    monkeypatch.setattr(shingles, "TILE", tile)
    rows = edited_copies(random.Random(5), 20, 8)
    rows += [(1000 + k, t) for k, t in enumerate(["one two", "ONE  two", "", " ", "one two three four five six"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [r.doc_id for r in c.drop_near_copies(spark, docs, None).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_survivors(rows)


def test_near_copies_on_a_table(spark):
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.01"
    docs = c.drop_copies(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    got = {r.doc_id for r in c.drop_near_copies(spark, docs, sf).collect()}
    assert got == brute_survivors([(r.doc_id, r.text) for r in docs.collect()])


# SpotSigs


def brute_signatures(text):
    found = [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]
    parts = [["^"]]
    for w in found:
        if w in spotsigs.ANCHORS or xxhash.xxh64_intdigest(w.encode(), 42) % spotsigs.SAMPLED == 0:
            parts.append([w])
        else:
            parts[-1].append(w)
    chains = [" ".join(p[:3]) for p in parts if len(p) > 1] or [p[0] for p in parts if p != ["^"]]
    return {f"{xxhash.xxh64_intdigest(c.encode(), 42) & 0xFFFFFFFF:08x}" for c in chains}


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_spotsigs_against_brute_force(spark, odd, none, sf_dir):
    docs = sorted(documents(sf_dir), key=lambda r: -r[0])
    got = {r.doc_id: r for r in queries.op8_spotsigs(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for k, (i, text, _) in enumerate(docs):
        follow = docs[(k + 1) % len(docs)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + follow[:cut]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, other, after = (brute_signatures(t) for t in (text, edited, follow))
        assert r.fingerprint == " ".join(sorted(own)) and r.edited_fingerprint == " ".join(sorted(other))
        assert r.near_edited == pytest.approx(likeness(own, other)) and r.near_next == pytest.approx(likeness(own, after))
    rows = spotsigs.compare_edited(odd).collect()
    assert Counter((r.doc_id, r.n_chars) for r in rows) == Counter((r[0], len(r[1] or "")) for r in ODD)
    assert spotsigs.compare_edited(none).count() == 0
    one = spotsigs.compare_edited(spark.createDataFrame(ODD[:1], SCHEMA)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_spotsigs_of_texts_of_any_length(spark):
    texts = [" ".join(f"the w{2 * k} w{2 * k + 1}" for k in range(n)) for n in range(0, 14)]
    texts += ["the quick brown fox of the old house", "the of and", "one", "", "  ", "日本 語 の 文", "a" * 5000]
    found = spotsigs.with_signatures(spark.createDataFrame([(t,) for t in texts], "text string"), "text", "sig").collect()
    assert {r.text: {f"{x:08x}" for x in r.sig} for r in found} == {t: brute_signatures(t) for t in texts}


def test_likeness_of_small_and_pruned_sets(spark):
    rows = [(list(range(10)), list(range(500))), ([1, 2], [5, 6]), ([], []), ([], [1]), ([1, 2, 3, 4], [1, 2, 3, 4, 5])]
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    got = [tuple(r) for r in df.select(spotsigs.jaccard(F.col("a"), F.col("b")), spotsigs.jaccard(F.col("a"), F.col("b"), 0.8)).collect()]
    assert got == [(0.02, None), (0.0, None), (1.0, 1.0), (0.0, None), (0.8, 0.8)]


# URL filter


def test_urls_match_sql(spark, sf_dir):
    got = sorted(tuple(map(str, r)) for r in queries.op9_url_filter(spark, sf_dir).collect())
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    assert got == sorted(tuple(map(str, r)) for r in con.execute(queries.OP9_SQL).fetchall())


def test_urls_odd_and_reputation(spark):
    urls = [None, "", "no scheme", "http://A.Example.ORG/en/12?x", "x://example.org/es/", "http://org", "http://b.com/de/x#f", "a://b://c/", "http://u@h:80/p\n/q"]
    rows = [(i, u, "r", "v") for i, u in enumerate(urls)]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, rule string, verdict string")).collect()}
    assert [got[i].host for i in range(9)] == ["", "", "", "a.example.org", "example.org", "org", "b.com", "b:", "u@h:80"]
    assert [got[i].path for i in range(9)] == ["", "", "", "/en/12", "/es/", "", "/de/x", "//c/", "/p\n/q"]
    assert [got[i].rule for i in range(9)] == [None, None, None, "example.org/en/1", "example.org/es/", None, "com/de/", None, None]
    assert got[3].verdict == got[4].verdict == got[6].verdict == "block"
    labelled = [(f"http://bad.x.net/{i}", 1) for i in range(60)] + [(f"http://good.y.net/{i}", 0) for i in range(60)]
    labelled += [("http://bad.x.net/new", None), ("http://good.y.net/new", None), ("http://new.y.net/", None), ("http://new.x.net/", None)]
    pages = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(labelled)], "page_id long, url string, bad int")
    said = {r.host: r.verdict for r in url_filter.judge_urls(pages, outcome_col="bad", rules=()).collect()}
    many = spark.createDataFrame([("h", "d.com", 4 * 10**9, 10**9), ("i", "d.com", 10, 1)], "host string, domain string, n long, bad long")
    above = spark.createDataFrame([("d.com", 0.5)], "domain string, mean double")
    assert all(0 < r.mean < 1 for r in url_filter.shrunk(many, above, "host", "domain", 1.0, 1000.0).collect())
    assert said["bad.x.net"] == "block" and said["good.y.net"] == said["new.y.net"] == "allow"
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


# Token counts


def brute_pieces(score, word):
    """The pieces of the best segmentation, character by character; what is spelled in bytes is none."""
    best = [(0.0, ())]
    for e in range(1, len(word) + 1):
        options = [(best[b][0] + score[word[b:e]], -b, (*best[b][1], word[b:e])) for b in range(max(0, e - 32), e) if word[b:e] in score]
        if word[e - 1] not in score:
            options.append((best[e - 1][0] + len(word[e - 1].encode()) * token_trie.BYTE, -(e - 1), best[e - 1][1]))
        top = max(options, key=lambda o: o[:2])
        best.append((top[0], top[2]))
    return best[-1][1]


def test_trie_of_long_words():
    """A word's tail beyond the trie's depth scores as it would inside, in bounded memory."""
    rng = random.Random(3)
    score = {c: -2.0 - k / 7 for k, c in enumerate("abcde")} | {"ab": -2.5, "bcd": -3.1, "cde": -3.0, "deab": -3.7}
    trie = token_trie.Trie(score)
    for n in (1, 63, 64, 65, 200):
        word = "".join(rng.choice("abcdeé") for _ in range(n))
        assert trie.count(word) == brute_count(score, word) == trie.count(word)
        assert tuple(reversed(trie.pieces(word))) == brute_pieces(score, word)
    nodes = len(trie.best)
    trie.count("x" * 300_000)
    assert len(trie.best) <= nodes + token_trie.DEPTH


def brute_count(score, word):
    best = [(0.0, 0)]
    for e in range(1, len(word) + 1):
        options = [(best[b][0] + score[word[b:e]], -b, best[b][1] + 1) for b in range(e) if word[b:e] in score]
        if word[e - 1] not in score:
            n = len(word[e - 1].encode())
            options.append((best[e - 1][0] + n * token_trie.BYTE, -(e - 1), best[e - 1][1] + n))
        top = max(options, key=lambda o: (o[0], o[1]))
        best.append((top[0], top[2]))
    return best[-1][1]


def test_token_counts(spark, odd, none, sf_dir):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    model = token_trie.load(path)
    # the model's probabilities, fitted by brute force: Zipf's law, then the counts of its segmentations
    start, times = token_trie.zipf(model), Counter()
    for w, n in Counter(w for _, t, _ in documents(sf_dir) for w in words(t)).items():
        for p in brute_pieces(start, token_trie.MARK + w.decode()):
            times[p] += n
    whole = math.log(sum(times.values()) + len(start))
    score = {p: math.log(times[p] + 1) - whole for p in start}
    docs = documents(sf_dir)[:40]
    known = {}

    def count(text):
        return sum(known.setdefault(w, brute_count(score, token_trie.MARK + w.decode())) for w in words(text))

    got = {r.doc_id: r.n_tokens for r in queries.op10_token_counts(spark, sf_dir).collect()}
    assert len(got) == len(documents(sf_dir))
    assert {i: got[i] for i, _, _ in docs} == {i: count(t) for i, t, _ in docs}
    short = odd.where("doc_id is null or doc_id != 6")
    rows = token_trie.count_tokens(short, path, score=score).collect()
    assert Counter((r.doc_id, r.n_words, r.n_tokens) for r in rows) == Counter((r[0], len(words(r[1])), count(r[1])) for r in ODD if r[0] != 6)
    assert [r.n_words for r in token_trie.count_tokens(odd.where("doc_id = 6"), path).collect()] == [30_001]
    assert token_trie.count_tokens(none, path).count() == 0


# Classifiers


@pytest.fixture(scope="module")
def channel():
    text = ("you are a stupid idiot and a moron this is pathetic trash worthless scum the good need look book still " * 50).encode()
    return toxicity.Channel(toxicity.smooth(toxicity.char_counts([text])).tolist())


@pytest.mark.parametrize(
    ("noisy", "clean"),
    [
        ("1d10t", "idiot"),
        ("st*pid", "stupid"),
        ("stuuuupid", "stupid"),
        ("5tup1d", "stupid"),
        ("$cum", "scum"),
        ("m-o-r-o-n", "moron"),
        ("p@th3t!c", "pathetic"),
        ("tr4sh!!", "trash"),
        ("goood", "good"),
        ("look,", "look"),
        ("THE***", "the"),
    ],
)
def test_deobfuscation(channel, noisy, clean):
    assert channel.text(f"you {noisy} are") == ["you", clean, "are"]


@pytest.mark.parametrize(
    ("noisy", "clean"),
    [
        ("1d107", "idiot"),
        ("!d!07", "idiot"),
        ("st-upid", "stupid"),
        ("idi.ot", "idiot"),
        ("mo-ron", "moron"),
        ("iidiioott", "idiot"),
        ("ssttuuppiidd", "stupid"),
        ("good", "good"),
        ("book.", "book"),
        ("good-book", "good book"),
    ],
)
def test_deobfuscation_of_doubtful_forms(channel, noisy, clean):
    assert channel.text(f"you {noisy} are") == ["you", *clean.split(), "are"]


def test_doubled_letters_as_in_the_lattice(channel):
    rng = random.Random(8)
    found = ["iidiioott", "ssttuuppiidd", "book", "all", "happy", "committee"]
    found += ["".join(c * rng.randint(1, 2) for c in rng.choices("abeinorstu", k=rng.randint(2, 9))) for _ in range(300)]
    for word in found:
        value, restored = channel.best(word, False)
        want = word if channel.best(word, False, False)[0] >= value else restored
        assert channel.without_doubles(word) == want, word


def brute_path(channel, word):
    """The best of all paths through a short word's lattice, each scored as a whole."""
    options = []
    for i, c in enumerate(word):
        if "a" <= c <= "z":
            options.append([(c, 0.0)] + ([("", toxicity.DROP_REPEAT)] if i and word[i - 1] == c else []))
        else:
            looks = toxicity.LOOKS.get(c, "")
            drop = toxicity.DROP_DIGIT if c.isdigit() else toxicity.DROP_LOOK if looks else toxicity.DROP_OTHER
            options.append([(x, toxicity.LOOK + (len(looks) > 2)) for x in looks] + [("", drop)])
    best = (-math.inf, "")
    for path in itertools.product(*options):
        state, value = toxicity.CONTEXTS - 1, 0.0
        for sign, cost in path:
            value -= cost
            if sign:
                at = state * toxicity.SIGNS + ord(sign) - 97
                value, state = value + channel.logp[at], at % toxicity.CONTEXTS
        best = max(best, (value + channel.logp[state * toxicity.SIGNS + toxicity.BOUND], "".join(x for x, _ in path)))
    return best


def test_viterbi_finds_the_best_of_all_paths(channel):
    rng = random.Random(9)
    found = ["1d10t", "st-upid", "l0s3r", "m0r0n", "h3ll0", "a55", "b!g", "i|d", "fr*it"]
    found += ["".join(rng.choice("abeilorst01357@$!-.*") for _ in range(rng.randint(1, 8))) for _ in range(150)]
    for word in found:
        value, restored = channel.best(word, False)
        want = brute_path(channel, word)
        assert value == pytest.approx(want[0], rel=1e-9) and (restored == want[1] or value == pytest.approx(want[0], rel=1e-12)), word


def test_deobfuscation_of_spaced_letters(channel):
    assert channel.text("you s t u p i d") == ["you", "stupid"]
    assert channel.text("are 1 d 1 0 t .") == ["are", "idiot"]
    assert channel.text("") == [] and channel.text("1234 5678") == []


def labels_of(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def area(score, y):
    """The chance that a row of label 1 scores higher than one of label 0; ties count half."""
    a, b = score[y == 1][:, None], score[y == 0][None, :]
    return ((a > b) + 0.5 * (a == b)).mean()


@pytest.mark.parametrize(("query", "label", "least"), [("op1_toxicity", "toxic", 0.75), ("op6_quality", "quality", 0.9)])
def test_classifiers_on_held_out_rows(spark, query, label, least):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES[query](spark, sf).toPandas()
    assert len(got) == len(documents(sf)) and got["score"].between(0, 1).all()
    assert (got["predicted"] == (got["score"] >= 0.3)).all()
    both = got.merge(labels_of(spark, sf).toPandas(), on="doc_id")
    held = both[both["held_out"]]
    assert area(held["score"].to_numpy(), held[label].to_numpy()) > least


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_on_odd_rows(spark, odd, none, module):
    name = "toxic" if module is toxicity else "quality"
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, None), (None, 1), (6, 0), (6, 1), (8, 0), (9, 0)], f"doc_id long, {name} int")
    rows = module.classify(odd, labels).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ODD)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert module.classify(none, labels).count() == 0
    assert module.classify(odd, labels.limit(0)).count() == len(ODD)


def labelled_texts(sf):
    y = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist() if r["quality"] is not None}
    return [(t.encode(), y[i]) for i, t, _ in documents(sf) if i in y]


def test_quality_sizes_and_what_the_dictionaries_add():
    rows = labelled_texts("/root/testdata/sf0.1")
    learn, probe = [r for k, r in enumerate(rows) if k % 4], [r for k, r in enumerate(rows) if not k % 4]
    model = quality.fit([t for t, _ in learn], np.array([y for _, y in learn]))
    texts, y = [t for t, _ in probe], np.array([y for _, y in probe])
    x = quality.measures(texts, model.good, model.bad)
    for t, row in zip(texts[:50], x):
        sizes = []
        for content in (model.good, model.bad, b""):
            known = zstandard.ZstdCompressionDict(content) if content else None
            made = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=known, write_content_size=False, write_dict_id=False).compress(t)
            assert zstandard.ZstdDecompressor(dict_data=known).decompress(made, max_output_size=len(t) + 1) == t
            sizes.append(len(made))
        good, bad, plain = sizes
        assert row[0] == pytest.approx(np.clip((bad - good) / plain, -1, 1)) and row[3] == pytest.approx(np.log1p(len(t)) / 8)
    assert np.allclose(model.score(texts), 1 / (1 + np.exp(-(model.weights[0] + x @ model.weights[1:]))))
    # the same regression without the dictionaries' two features and their products
    fitted = quality.measures([t for t, _ in learn], model.good, model.bad)
    names = [*range(4), *[(i, j) for i in range(4) for j in range(i, 4)]]
    bare = [k for k, n in enumerate(names) if n in (2, 3) or (isinstance(n, tuple) and min(n) >= 2)]
    w = quality.labelled.fit_logistic(fitted[:, bare], np.array([y for _, y in learn], dtype=float), penalty=0.1)
    with_dictionaries, without = area(model.score(texts), y), area(quality.labelled.chance(x[:, bare], w), y)
    print("area with and without dictionaries", with_dictionaries, without)
    assert with_dictionaries > without + 0.02


def test_labels_of_held_out_rows_are_not_read(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), labels_of(spark, sf)
    turned = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - quality, quality) as quality", "toxic")
    a = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    b = {r.doc_id: r.score for r in quality.classify(docs, turned).collect()}
    assert a == b
    turned = labels.selectExpr("doc_id", "quality", "if(crc32(cast(doc_id as string)) % 4 = 2, 1 - toxic, toxic) as toxic")
    a = {r.doc_id: r.score for r in toxicity.classify(docs, labels).collect()}
    b = {r.doc_id: r.score for r in toxicity.classify(docs, turned).collect()}
    assert a == b


def test_restore_keeps_every_row(odd, none):
    assert toxicity.restore(odd).count() == len(ODD) and toxicity.restore(none).count() == 0
    assert toxicity.drop_toxic(odd, odd.selectExpr("doc_id", "0 as toxic")).columns == odd.columns


# Pipeline


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    whole = {r.doc_id: r for r in docs.collect()}
    assert 4 <= len(c.STAGES) <= 5
    toxic = {r.doc_id for r in queries.op1_toxicity(spark, sf_dir).collect() if r.predicted}
    kept = c.STAGES[0][1](spark, docs, sf_dir)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(whole) - toxic
    once = c.STAGES[1][1](spark, kept, sf_dir)
    by_text = {}
    for r in kept.collect():
        by_text.setdefault(lower(r.text), []).append(r.doc_id)
    ids = {r.doc_id for r in once.collect()}
    assert once.columns == docs.columns and ids == {max(v) for v in by_text.values()}
    single = c.STAGES[2][1](spark, once, sf_dir)
    survivors = brute_survivors([(i, whole[i].text) for i in ids])
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == survivors
    mixed = c.STAGES[3][1](spark, single, sf_dir)
    want = {r.doc_id: r.copies for r in mixing.mix(single).collect() if r.copies}
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == want
    assert c.run(spark, sf_dir).count() == sum(want.values())
