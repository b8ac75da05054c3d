"""Prefix tries, mixes and periodic runs against plain versions and their SQL."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from noticeworks.llm import common, mixing, periodic, prefixes, queries
from tests.compare import DATA, database, plain, rows
from tests.llm.helpers import LONG, documents, empty

# Periodic runs


def plain_runs(words):
    """Every stretch of every period, read in full."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        x = 0
        while x < len(words) - q:
            y = x
            while y < len(words) - q and words[y] == words[y + q]:
                y += 1
            if y - x + q >= max(6, 4 * q):
                found.setdefault((x, y - x + q), q)
            x = max(y, x + 1)
    return sorted((start, length, q) for (start, length), q in found.items())


def periodic_words(draw):
    words = []
    for _ in range(draw.randrange(1, 8)):
        part = [draw.randrange(draw.choice((1, 2, 4)) + 1) for _ in range(draw.choice((1, 2, 3, 4, 5, 8, 13, 20)))]
        words += part * draw.choice((1, 1, 3, 4, 5, 9))
        del words[len(words) - draw.randrange(min(3, len(words))) :]
    return words[:260]


def test_runs_of_every_prefix_are_those_of_a_plain_search():
    draw = random.Random(1)
    for _ in range(600):
        words, catchers, at = periodic_words(draw), periodic.Catchers(), 0
        while at < len(words):
            more = draw.choice((1, 2, 5, 50, 300))
            catchers.append(np.array(words[at : at + more], dtype=np.int64))
            at += more
            assert catchers.runs() == plain_runs(words[:at])
        assert periodic.runs_of(words) == plain_runs(words)


@pytest.mark.parametrize("words", [[0] * 1000, [0, 1] * 400, [i // 7 for i in range(900)], ([0] * 30 + [1]) * 8 + [0] * 30, [0, 0, 1] * 40 + [2] + [0, 0, 1] * 40])
def test_runs_of_regular_words(words):
    assert periodic.runs_of(words) == plain_runs(words)


def test_long_texts_are_read_in_segments(monkeypatch):
    monkeypatch.setattr(periodic, "SEGMENT", 37)
    draw = random.Random(2)
    for _ in range(100):
        words = periodic_words(draw)
        assert periodic.runs_of(words) == plain_runs(words)


def test_many_squares_stay_cheap():
    """Words that are all alike, and a word with a run at every place, take no more than some comparisons each."""
    a, b = [0], [0, 1]
    while len(b) < 60_000:
        a, b = b, b + a
    assert periodic.runs_of(b) == []  # no run of a Fibonacci word has four periods
    assert periodic.runs_of([5] * 300_000) == [(0, 300_000, 1)]


def wanted_digest(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {x for s, length, q in runs for x in range(s + q, s + length)}
    best = min(((-length, s, q) for s, length, q in runs), default=None)
    first = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *first, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_periodic_query(spark, monkeypatch):
    draw = random.Random(3)
    texts = [" ".join(f"w{x}" for x in periodic_words(draw)) for _ in range(80)]
    texts += [" ".join(draw.choice(("ä", "b\x1c", "c", "数字")) for _ in range(draw.randrange(60))) for _ in range(60)]
    texts += [None, "", " \t\n", "a a a a a a", "a\x0ba\x0ca\ra\ta\na", "one one " * 7]
    given = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, "x x x x x x x", None, None, None), (3, texts[3], "en", "s", 1)]
    monkeypatch.setattr(queries, "table", lambda *_: documents(spark, given))
    found = sorted(tuple(map(plain, r)) for r in queries.op13_periodic_runs(spark, "").toPandas().itertuples(index=False) if plain(r[0]) is not None)
    wanted = sorted(tuple(map(plain, wanted_digest(r[0], r[1]))) for r in given if r[0] is not None)
    assert found == wanted and sum(r[1] > 0 for r in wanted) > 40
    alone = [r for r in queries.op13_periodic_runs(spark, "").collect() if r.doc_id is None]
    assert len(alone) == 1 and (alone[0].n_runs, alone[0].length, alone[0].period) == (1, 7, 1)


def test_periodic_cases(spark):
    by = {r.doc_id: r for r in periodic.periodic_runs(documents(spark)).collect()}
    assert by[1].runs == by[2].runs == by[3].runs == [] and by[1].collapsed == "" and by[1].n_words == 0
    assert by[6].n_words == len(LONG.split()) and by[6].collapsed == " ".join(LONG.split())
    assert periodic.periodic_runs(documents(spark)).count() == 9 and periodic.periodic_runs(empty(spark)).count() == 0


# Mixes


def test_mix_gives_the_rows_of_its_sql(spark):
    found = queries.op12_mixing(spark, DATA).toPandas()
    assert rows(found) == rows(database().execute(queries.ORACLES["op12_mixing"]).fetchdf())


def plain_targets(sizes):
    """Shares dealt out again and again until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set(order)
    while left > 1e-9 and open_:
        all_weight = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / all_weight
        left = 0.0
        for s in list(open_):
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


@pytest.mark.parametrize("seed", range(4))
def test_mix_meets_its_targets(spark, seed):
    draw = random.Random(seed)
    sources = [None, "a", "b", "c", "ü", "Z", "e"][: draw.randrange(1, 8)]
    docs = [(i, "w " * draw.choice((0, 1, 5, 40)) + f"{i}", "en", draw.choice(sources), 1) for i in range(draw.choice((3, 60, 400)))]
    docs += [(7, "same row again", "en", sources[0], 1)] * 300 + [(8, None, "en", "none", 0), (9, "", "en", "none", 0)]
    found = mixing.mix(documents(spark, docs)).collect()
    sizes, taken = Counter(), Counter()
    for r in found:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    assert Counter((r.doc_id, r.size, r.source) for r in found) == Counter((d[0], len((d[1] or "").split()), d[3]) for d in docs)
    wanted = plain_targets(sizes)
    for r in found:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, wanted[r.source], abs_tol=1e-6)
    assert all(abs(taken[s] - wanted[s]) <= 0.5 + 1e-6 for s in sizes)
    again = mixing.mix(documents(spark, docs).repartition(7)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_mix_takes_documents_in_the_order_of_their_keys(spark):
    """Epochs first; then documents in key order, one of them in part, and better ones more often."""
    docs = [(i, ("word " * 20 if i % 2 else "a b c d e f g h i j k l m n o p q r s t ") + str(i), "en", "s" if i < 600 else "t", 1) for i in range(1200)]
    found = mixing.mix(documents(spark, docs), weights=(1, 3)).collect()
    by = defaultdict(list)
    for r in found:
        by[r.source].append(r)
        assert r.quality < 0.3 if r.doc_id % 2 else r.quality > 0.9
    assert all(r.taken == 2 * r.size for r in by["t"])  # 3/4 of 150 %, stopped at twice its words; s has the rest, and no whole epoch
    s = by["s"]
    assert sum(r.taken for r in s) == round(s[0].target) or s[0].target >= s[0].source_size
    part = mixing.mix(documents(spark, docs), weights=(1, 3), share=0.6).collect()
    part = [r for r in part if r.source == "s"]
    chosen = [r.taken > 0 for r in part if r.doc_id % 2 == 0], [r.taken > 0 for r in part if r.doc_id % 2]
    assert sum(0 < r.taken < r.size for r in part) <= 1 and sum(chosen[0]) > 1.5 * sum(chosen[1]) > 0
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.mix(documents(spark)).count() == 9


# Prefix tries


def plain_trie(given, build=True):
    convs = defaultdict(list)
    for conv, turn, role, text in given:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    told = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        told[c] = tuple(turns.get(base, [])[:h] + turns[c][h:]) if build else tuple(turns[c])
    members = defaultdict(list)
    for c, path in told.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(told[c]) == len(p)).encode()).hexdigest())
        for p, m in members.items()
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_of(spark, given, **options):
    frame = spark.createDataFrame([(*r, 1, 2, "x") for r in given], "conv_id long, turn long, role string, text string, a long, depth long, conv string")
    return sorted(tuple(r[c] for c in COLUMNS) for r in prefixes.trie(frame.repartition(3), **options).collect())


def some_conversations(draw, n):
    given = []
    for c in range(n):
        given += [(c * draw.choice((1, 7, 50)), t, draw.choice(("user", "assistant", None)), draw.choice(("yes", "no", "", None))) for t in range(draw.randrange(1, 9))]
    return given


def test_trie_gives_the_rows_of_its_sql(spark):
    found = queries.op11_prefix_trie(spark, DATA).toPandas()
    assert rows(found) == rows(database().execute(queries.ORACLES["op11_prefix_trie"]).fetchdf())


@pytest.mark.parametrize("shard_nodes", [4, 100_000])
def test_trie_of_shared_first_turns(spark, shard_nodes):
    """Conversations with equal numbers, turns, nulls and ties; small shards take several rounds."""
    given = some_conversations(random.Random(shard_nodes), 40) + [(-3, 1, "user", "x"), (-103, 1, "user", "y"), (-100, 1, "user", "z"), (None, 1, "user", "none")]
    given += [(5, None, "user", "first"), (5, None, "user", "first"), (900, 2, "user", "later"), (900, 2, "assistant", "later")]
    assert trie_of(spark, given, build=prefixes.rebuilt, shard_nodes=shard_nodes) == plain_trie(given)


def test_trie_of_long_and_of_many_equal_conversations(spark):
    """A conversation longer than a block, copies that leave it late, and a hot first turn."""
    long = [(1, t, "user", f"t{t % 5}") for t in range(700)] + [(2, t, "user", f"t{t % 5}") for t in range(600)] + [(3, t, "user", f"t{t % 5 if t < 640 else 9}") for t in range(650)]
    given = long + [(c, 0, "system", "hello") for c in range(10, 200)] + [(c, 1, "user", f"{c % 30}") for c in range(10, 170)]
    for shard_nodes in (150, 100_000):
        assert trie_of(spark, given, shard_nodes=shard_nodes) == plain_trie(given, build=False)


def test_trie_of_hot_conversations_and_nodes(spark, monkeypatch):
    """Conversations and parents of more rows than HOT_ROWS are spread over parts of the joins."""
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    given = some_conversations(random.Random(5), 40)
    assert trie_of(spark, given, build=prefixes.rebuilt, shard_nodes=4) == plain_trie(given)


def test_trie_without_rows(spark):
    assert trie_of(spark, []) == [] and trie_of(spark, [(None, 0, "user", "x")], build=prefixes.rebuilt) == []
    # The base has no turns to give, and the conversation none beyond its first: it counts for the root.
    alone = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 1)
    assert trie_of(spark, [(alone, 0, "user", "x")], build=prefixes.rebuilt) == plain_trie([(alone, 0, "user", "x")])


def test_a_queue_that_spills_keeps_its_order():
    draw = random.Random(8)
    queue, inside = prefixes.SpillingQueue(room=5), defaultdict(list)
    keys = sorted((draw.randrange(9), draw.randrange(9)) for _ in range(60))
    pushed = [(k, n) for n, k in enumerate(draw.sample(keys, len(keys)))]
    for key, n in pushed:
        queue.push(key, (n,))
        inside[key].append(n)
    assert queue.runs
    for key in sorted(inside):
        assert sorted(v for (v,) in queue.take(key)) == inside[key]
        queue.push((key[0] + 20, 0), (key,))
    assert list(queue.take((0, 0))) == []
