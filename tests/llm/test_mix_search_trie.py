import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from snpweave.llm import lexical_search, mixing, prefix_trie

from .conftest import WORDS, words

# ---------------------------------------------------------------- op11


def water_levels(sizes):
    """Targets by repeated resharing, in fractions."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    whole, full = sum(sizes.values()), set()
    while True:
        left = whole - sum(3 * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in sizes if s not in full)
        above = {s for s in sizes if s not in full and weight[s] * Fraction(left, open_weight) > 3 * sizes[s]}
        if not above:
            return {s: Fraction(3 * sizes[s]) if s in full else weight[s] * Fraction(left, open_weight) for s in sizes}
        full |= above


def mixed(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string, turn int, key string")
    pieces = mixing.mix(df, **kw)
    return pieces.collect(), mixing.taken_words(pieces).collect()


def source_rows():
    r = random.Random(3)
    make = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    rows = [(i, make(r.randrange(0, 60)), f"s{i % 3}") for i in range(120)]
    rows += [(200 + i, make(4), "tiny") for i in range(2)] + [(300, make(700), "ü"), (301, "one", "a"), (302, "", "blank"), (303, None, "blank")]
    rows += [(None, make(9), None), (None, make(9), "s0"), (400, "x y z", None)] + [(500, make(30), "copies")] * 40 + [(501, make(3), "copies"), (501, make(5), "copies")]
    return [(*x, "c", 1, "k") for x in rows]


@pytest.mark.parametrize("block", [1, 16, 2048])
def test_mix_takes_the_targets(spark, block):
    rows = source_rows()
    size = lambda t: len(words(t))
    sizes = Counter()
    for x in rows:
        sizes[x[2]] += size(x[1])
    targets = water_levels(sizes)
    pieces, got = mixed(spark, rows, block=block)
    assert sorted((x.doc_id is None, x.doc_id, x.size) for x in got) == sorted((x[0] is None, x[0], size(x[1])) for x in rows)
    assert all(0 <= x.taken <= 3 * x.size for x in got)
    for s in sizes:
        assert any(x.source_size == sizes[s] and x.target == pytest.approx(float(targets[s]), abs=1e-9) for x in got)
    assert sum(x.taken for x in got) == sum(math.floor(t) for t in targets.values())
    # each document's own words, in slots without gaps or overlaps
    for x in pieces:
        assert x.n_words == 0 or (0 <= x.first_word and x.first_word + x.n_words <= x.size)
    slots = defaultdict(list)
    for x in pieces:
        if x.turn is not None:
            slots[x.turn, x.number].append((x.offset, x.n_words))
    for parts in slots.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
    assert sorted(map(str, mixed(spark, rows, block=block)[1])) == sorted(map(str, got))
    if block == 1:  # any stretch of turns holds each source in its share
        total = sum(map(math.floor, targets.values()))
        taken = Counter(x.number for x in pieces if x.turn is not None and x.turn < 256)
        everything = Counter()
        for x in pieces:
            everything[x.number] += x.n_words
        slots_all = len({x.turn for x in pieces if x.turn is not None})
        assert all(abs(taken[s] / 256 - everything[s] / total * min(1, slots_all / 256)) < 0.1 for s in everything)


def test_mix_odd_tables(spark):
    assert mixed(spark, [])[1] == []
    got = mixed(spark, [(1, None, None, "c", 1, "k"), (2, " \n", "a", "c", 1, "k")])[1]
    assert [(x.size, x.source_size, x.target, x.taken) for x in got] == [(0, 0, 0.0, 0)] * 2
    got = mixed(spark, [(7, "a b c", "one", "c", 1, "k")] * 3)[1]
    assert [(x.source_size, x.target, x.taken) for x in got] == [(9, 9.0, 3)] * 3


def test_unfold_in_two_steps(spark):
    rows = spark.createDataFrame([(0, 5, 5), (1, 3, 3 + 2 * mixing.STEP)], "number long, first long, last long")
    got = mixing.unfold(rows, rows["first"], rows["last"], "slot").groupBy("number").count().collect()
    assert {x.number: x["count"] for x in got} == {0: 1, 1: 2 * mixing.STEP + 1}


# ---------------------------------------------------------------- op12

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n, length = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in {(i, t) for i, t in items}:
        scores = []
        for doc, bag in bags:
            m = 50 + (50 * sum(bag.values()) * n) // max(1, length)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in set(terms(text)) if bag[t])
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out += [(item, r, None if missing else doc, -s) for r, (s, missing, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("k", [3, 50])
def test_search(spark, corpus, docs, odd, k, monkeypatch):
    items = [(i, t) for i, t in corpus[:8]] + [(1, "Alpha beta ALPHA"), (1, "omega"), (2, None), (3, ""), (None, "gamma 日本語 Ünïcödé"), (4, "nowhere-to-be-found"), (5, "alpha1 beta2"), (5, "alpha1 beta2")]
    table = spark.createDataFrame([(*x, 1, 2, 3) for x in items], "item_id long, text string, query int, term int, shard int")
    got = lexical_search.search(lexical_search.build_index(docs), table, k).collect()
    assert sorted([(x.item_id, x["rank"], x.doc_id, x.score) for x in got], key=str) == ranked(corpus, items, k)
    got = lexical_search.search(lexical_search.build_index(odd), spark.createDataFrame([(0, "a q"), (1, "c")], "item_id long, text string"), k).collect()
    assert sorted([(x.item_id, x["rank"], x.doc_id, x.score) for x in got], key=str) == ranked([(x.doc_id, x.text) for x in odd.collect()], [(0, "a q"), (1, "c")], k)


def test_search_in_many_shards_and_blocks(spark, corpus, monkeypatch):
    many = [(900 - i, t) for i, (_, t) in enumerate(corpus)] * 3 + [(1000 + i, "kappa lambda") for i in range(150)]
    items = [(i, t) for i, t in corpus if t and len(t) < 2000]
    docs = spark.createDataFrame(many, "doc_id long, text string")
    monkeypatch.setattr(lexical_search, "QUERIES", 5)
    got = lexical_search.search(lexical_search.build_index(docs.repartition(5)), spark.createDataFrame(items, "item_id long, text string"), 50).collect()
    assert sorted([(x.item_id, x["rank"], x.doc_id, x.score) for x in got], key=str) == ranked(many, items, 50)


def test_search_empty_tables(spark, docs, empty):
    items = spark.createDataFrame([(0, "alpha")], "item_id long, text string")
    assert lexical_search.search(lexical_search.build_index(empty), items).count() == 0
    assert lexical_search.search(lexical_search.build_index(docs), items.limit(0)).count() == 0


def test_merge_lists_over_spans():
    r = np.random.default_rng(1)
    n = 5 * lexical_search.SPAN
    lists = [(np.sort(r.choice(n, size, replace=False)), r.integers(0, 4, size)) for size in (1, 7, 900, 6000, n)]
    total = np.zeros(n, np.int64)
    for docs, gains in lists:
        total[docs] += gains
    order = np.lexsort((np.arange(n), -total))
    for k in (1, 50, 4000):
        want = [(int(total[d]), int(d)) for d in order[:k]]
        assert sorted(lexical_search.merge_lists(lists, k), key=lambda x: (-x[0], x[1])) == want


def test_varints():
    x = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**28 - 1, 2**28, 2**35 - 1, 5])
    raw, ends = lexical_search.varints(x)
    assert lexical_search.from_varints(raw).tolist() == x.tolist() and ends[-1] == len(raw)
    assert len(lexical_search.from_varints(np.zeros(0, np.uint8))) == 0


# ---------------------------------------------------------------- op13


def nodes_of(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(turns.get(c - math.fmod(c, 5), [])[:h] + own[h:])
    members, kids = defaultdict(list), defaultdict(set)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
            if d:
                kids[seq[: d - 1]].add(seq[:d])
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = kids[path]
        leaves[path] = sum(leaves[x] for x in below) or 1
        saved[path] = sum(saved[x] for x in below) + ((len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0)
    out = []
    for path, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(whole[c]) == len(path)))
        out.append((min(m), len(path), min(members[path[:-1]]) if path else None, len(m), len(kids[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def built(spark, rows):
    df = spark.createDataFrame([(*x, 1, "k") for x in rows], "conv_id long, turn long, role string, text string, pos int, key string")
    return sorted(map(tuple, prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.placed_turns(df))).collect()), key=str)


def conversation_rows():
    r = random.Random(8)
    rows = []
    for c in range(60):
        base = c - c % 5
        n = r.randrange(1, 7)
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", r.choice(["yes", "no", f"word {base}", "é" * t])) for t in range(n)]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 160, 5) for t in range(14)]  # equal conversations, longer than any head
    rows += [(c, t, "user", f"same {t}" if t < 13 else f"end {c}") for c in range(200, 230, 5) for t in range(15)]  # apart at the last turns
    rows += [(301, 0, "a", "b"), (303, 0, None, None), (302, None, "a", None), (302, None, "a", None), (302, 3, None, "z"), (302, 3, "q", "z"), (None, 1, "a", "b"), (-7, 1, "a", "b"), (-5, 1, "x", "y")]
    rows += [(c, 0, "u", "short") for c in range(401, 405)]  # their heads swallow all they have
    r.shuffle(rows)
    return rows


def test_trie(spark):
    rows = conversation_rows()
    assert built(spark, rows) == nodes_of(rows)


def test_trie_of_few_and_none(spark):
    assert built(spark, []) == [] and built(spark, [(None, 1, "a", "b")]) == []
    for rows in ([(5, 0, "a", "b")], [(401, 0, "a", "b")], [(10, t, "a", "b") for t in range(9000)], [(c, t, "a", "b") for c in (0, 10, 20) for t in range(5000)]):
        got = built(spark, rows)
        if len(rows) < 10:
            assert got == nodes_of(rows)
        else:
            n = len({c for c, *_ in rows})
            assert len(got) == len(rows) // n + 1
            assert all(x[3] == n and x[5] == 1 and x[6] == (n - 1) * (len(got) - 1 - (x[1] - 1 if x[1] else 0)) for x in got)


def test_hashes_of_sorted_ids(spark):
    rows = [(1, i) for i in range(3000)] + [(2, 5), (2, -1), (3, 10), (3, 9)]
    got = dict(map(tuple, prefix_trie.hashed_ids(spark.createDataFrame(rows, "rep long, conv_id long")).collect()))
    of = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got == {1: of(range(3000)), 2: of([-1, 5]), 3: of([9, 10])}
