import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from pagelake.llm.mixing import mix, source_targets
from pagelake.llm.sharding import jump, shard_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water_fill(sizes, weights, share, epochs):
    """Clamps, redistributes and repeats until no source is above its clamp."""
    left, free, out = share * sum(sizes), list(range(len(sizes))), [0.0] * len(sizes)
    while free:
        level = left / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * level > epochs * sizes[i]]
        if not over:
            for i in free:
                out[i] = weights[i] * level
            break
        for i in over:
            out[i] = float(epochs * sizes[i])
            left -= out[i]
            free.remove(i)
    return out


def targets_of(rows):
    """Target of each source of (id, size, source) rows at production weights."""
    per = Counter()
    for _, size, source in rows:
        per[source] += size
    names = sorted(per, key=lambda s: (s is None, s or ""))
    return dict(zip(names, water_fill([per[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2)))


def mix_brute(rows):
    """Words taken from each document: whole epochs, then a fraction in the seeded order."""
    out = {}
    for source, target in targets_of(rows).items():
        mine = sorted((hashlib.md5(f"mix-1:{k}".encode()).hexdigest(), k, size) for k, size, s in rows if s == source)
        total, want = sum(size for _, _, size in mine), int(target)
        whole = want // total if total else 0
        left = want - whole * total
        for _, k, size in mine:
            out[k] = whole * size + min(size, left)
            left -= min(size, left)
    return out


def test_targets_are_the_fixed_point(spark):
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 7, 40):
        sizes = [int(x) for x in rng.pareto(0.7, n) * 50]
        names = [f"s{i:02d}" for i in range(n - 1)] + [None]
        df = spark.createDataFrame(list(zip(names, sizes)), "source string, size long")
        got = {r.source: r.target for r in source_targets(df).collect()}
        want = water_fill(sizes, [(3, 1, 2)[i % 3] for i in range(n)], 1.5, 2)
        assert all(abs(got[k] - w) < 1e-6 * max(1, w) for k, w in zip(names, want))


def test_fractions_of_a_source_by_hand(spark):
    """Two sources of 10 and 90 words: the first is clamped at 20, the second gets 130 of the 150."""
    docs = spark.createDataFrame([(i, "w " * 5, "a") for i in range(2)] + [(10 + i, "w " * 30, "b") for i in range(3)], "doc_id long, text string, source string")
    got = {r.doc_id: (r.target, r.taken) for r in mix(docs).collect()}
    assert [got[i] for i in range(2)] == [(20.0, 10)] * 2
    order = sorted((10, 11, 12), key=lambda k: hashlib.md5(f"mix-1:{k}".encode()).hexdigest())
    assert {k: got[k] for k in order} == {order[0]: (130.0, 60), order[1]: (130.0, 40), order[2]: (130.0, 30)}


def test_mix_meets_its_targets(odd, odd_rows):
    got = mix(odd.withColumn("h", F.lit(1)).withColumn("before", F.lit(2))).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(WORD.findall(r[1] or ""))) for r in odd_rows)
    sums = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        sums[r.source, r.source_size, r.target] += r.taken
    assert all(total == int(target) <= 2 * size for (_, size, target), total in sums.items())
    assert Counter(map(tuple, got)) == Counter(map(tuple, mix(odd.repartition(7)).collect()))
    assert mix(odd.limit(0)).count() == 0


def jump_of_one(key, shards):
    """One key by the published loop, in Python integers."""
    mask = (1 << 64) - 1
    key &= mask
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        key = ((key ^ key >> shift) * factor) & mask
    now, ahead = -1, 0
    while ahead < shards:
        now = ahead
        key = (key * 2862933555777941757 + 1) & mask
        ahead = int((now + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return now


def test_jump_of_many_keys_is_that_of_each():
    keys = np.array([*range(-300, 300), 2**63 - 1, -(2**63), *np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 2000)], np.int64)
    for n in (1, 2, 8, 9, 1000):
        assert jump(keys, n).tolist() == [jump_of_one(int(k), n) for k in keys]


def test_jump_moves_only_into_the_new_shard():
    keys = np.arange(-5000, 5000)
    for n in (1, 2, 8, 31):
        now, then = jump(keys, n), jump(keys, n + 1)
        assert now.min() >= 0 and now.max() < n
        assert ((now == then) | (then == n)).all()
        assert abs(np.bincount(now, minlength=n) - 10000 / n).max() < 6 * (10000 / n) ** 0.5 + 1


def test_shards_and_slots(odd, odd_rows):
    got = shard_documents(odd.withColumn("shard", F.lit("x")).withColumn("size", F.lit("y"))).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in odd_rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert r.law == "key" and r.grown_shard in (r.shard, 8)
        assert (r.shard, r.grown_shard) == (jump_of_one(r.doc_id or 0, 8), jump_of_one(r.doc_id or 0, 9))
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert shard_documents(odd.limit(0)).count() == 0
