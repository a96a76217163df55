"""Batches, streams with state, lineage and rules on single values that queries once avoided."""

import json
import math
import random
import shutil
from collections import defaultdict

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pagelake.functions import addresses, urls
from pagelake.operators import batches, content, crawl, ledger, payloads, policy, rules, runs, search, shared, trees
from pagelake.sources import files
from pagelake.streaming import events as streams


# ---- values


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").orderBy("i").select(column(F.col("x"))).collect()]


def test_ipv6_hosts_with_and_without_a_port(spark):
    given = ["https://[2606:4700::1111]/", "https://[2606:4700::1111]:8443/x", "https://[::1]:443", "https://[::1]:abc/", "https://:80/"]
    assert one(spark, urls.normalize, *given) == ["https://[2606:4700::1111]/", "https://[2606:4700::1111]:8443/x", "https://[::1]/", None, None]
    assert one(spark, urls.problem, given[0], given[3]) == [None, "Port could not be cast to integer value as 'abc'"]


def test_relative_redirects(spark):
    steps = spark.createDataFrame([("https://a/x/", 302, "/y"), ("https://a/y", 302, "z?q"), ("https://b/", 302, "//c/d"), ("https://c/d", 302, "#f"), ("https://e/", 302, "http:/f")], "src string, status int, location string")
    starts = spark.createDataFrame([(u, "GET") for u in ("https://a/x/", "https://b/", "https://e/")], "url string, method string")
    got = {r.start: (r.final, r.hops, r.verdict) for r in crawl.redirect_chains(starts, steps).collect()}
    assert got == {"https://a/x/": ("https://a/z?q", 2, "ok"), "https://b/": ("https://c/d#f", 2, "ok"), "https://e/": ("https://e/", 0, "downgrade")}


def test_bundles_keep_all_excerpts_of_a_locator(spark):
    sources = spark.createDataFrame([("a.md", "why one", 0.5), ("a.md", "why two", 0.7), ("a.md", "why one", 0.9)], "locator string, excerpt string, score double")
    docs = spark.createDataFrame([], "doc_id long, text string")
    got = [(r.locator, r.excerpt) for r in runs.context_bundle(docs, "why", 100, sources=sources).collect()]
    assert sorted(got) == [("a.md", "why one"), ("a.md", "why two")]


def test_first_seen_gives_one_row_per_value(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (0, "b"), (0, "b"), (2, None), (None, None), (None, "c")], "k int, v string")
    assert sorted(map(tuple, runs.first_seen(rows, "v", "k").collect()), key=str) == sorted([("a", 1), ("b", 0), (None, 2), ("c", None)], key=str)


def test_scores_that_are_null_come_last(spark):
    rows = spark.createDataFrame([("x", 0.5, 1), ("x", None, 0), ("x", 0.7, 2), ("y", None, 4), ("y", None, 3)], "k string, s double, o int")
    assert {r.k: (r.s, r.o) for r in runs.merge_sources(rows, keys=["k"], score="s", order="o").collect()} == {"x": (0.7, 2), "y": (None, 3)}


def test_snapshots_have_one_row_per_url(spark):
    before = spark.createDataFrame([("https://A/", "1"), ("https://a:443/", "2"), ("no url", "3"), ("https://b/", None)], "u string, d string")
    after = spark.createDataFrame([("https://a/", "2"), ("https://a/#x", "1"), ("https://b/", "4"), ("https://c/", None)], "u string, d string")
    assert {r.normalized: r.change for r in content.snapshot_changes(before, after, "u", "d").collect()} == {"https://a/": "same", "https://b/": "changed", "https://c/": "new"}


def test_seeds_keep_the_order_of_their_list(spark):
    seeds = spark.createDataFrame([("z",), ("a",), ("z",)], "url string").coalesce(1)
    assert [r.url for r in runs.seed_union(seeds, most=1).collect()] == ["z"]
    placed = spark.createDataFrame([("z", 5), ("a", 2)], "url string, place int")
    assert [(r.url, r.ord, r.place) for r in runs.seed_union(placed, seeds.withColumn("place", F.lit(1)), most=9).collect()] == [("a", 0, 2), ("z", 0, 5)]


def test_a_frontier_normalises_first(spark):
    found = spark.createDataFrame([(1, "HTTPS://A.com", 1, True), (1, "mailto:x", 1, True), (1, "https://a.com/b#c", 1, True)], "root int, url string, depth int, same_site boolean")
    seen = spark.createDataFrame([(1, "https://A.com:443/")], "root int, url string")
    assert sorted((r.url, r.label) for r in crawl.frontier_admit(found, seen, 2).collect()) == [("https://a.com/", "seen"), ("https://a.com/b", "admitted")]


def test_events_of_one_id_keep_the_first(spark):
    rows = spark.createDataFrame([("a", 3, "{}"), ("a", 1, '{"x":1}'), (None, 2, "{}"), (None, 5, "{}"), ("b", 4, "{}")], "event_id string, at int, payload string")
    known = spark.createDataFrame([("b", 7)], "event_id string, sequence long")
    got = [(r.event_id, r["at"], r.sequence) for r in ledger.event_append(known, rows, "at").orderBy("sequence").collect()]
    assert got == [("a", 1, 8), (None, 2, 9), (None, 5, 10)]


def test_cuts_by_tokens_and_the_last_robots(spark):
    rows = spark.createDataFrame([("abcdefghij", 2), ("abc", 0), ("abc", -1), (None, 1)], "t string, n int")
    assert [r[0] for r in rows.select(runs.token_truncate(F.col("t"), F.col("n"))).collect()] == ["abcdefgh", "", "", None]
    robots = spark.createDataFrame([("https://a", 200, "User-agent: *\nDisallow: /", 1), ("https://a", 404, "", 2)], "origin string, status int, body string, at int")
    targets = spark.createDataFrame([("https://a/x",)], "url string")
    assert policy.robots_filter(targets, robots, order="at").first().robots_allowed
    assert not policy.robots_filter(targets, robots.where("at = 1"), order="at").first().robots_allowed


def plain(x):
    if isinstance(x, Row):
        return {k: plain(v) for k, v in x.asDict(recursive=False).items()}
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    return [plain(v) for v in x] if isinstance(x, list) else x


def test_json_is_sorted_at_all_levels(spark):
    rng = random.Random(6)
    text = lambda: "".join(rng.choices('ab"\\\n\t\x01\x1f\x7fé日/ ', k=rng.randint(0, 6)))
    maybe = lambda f: None if rng.random() < 0.15 else f()
    number = lambda: rng.choice([0.0, -0.0, 1e16, 1.5e-7, 123456.789, 1e15, 0.0001, 0.00001, 5e-324, round(rng.uniform(-1e6, 1e6), 3), float(rng.randint(0, 10**9))])
    inner = lambda: Row(z=maybe(text), a=maybe(number))
    rows = [(i, maybe(lambda: {text(): maybe(lambda: {text(): rng.randint(0, 9)}) for _ in range(3)}), [maybe(inner) for _ in range(3)], Row(y=maybe(inner), b=[[True, None], []]), rng.randint(-(2**62), 2**62), maybe(number)) for i in range(150)]
    schema = "k int, m map<string,map<string,int>>, l array<struct<z:string,a:double>>, `s x` struct<y:struct<z:string,a:double>,b:array<array<boolean>>>, n long, d double"
    df = spark.createDataFrame(rows, schema)
    got = {r.k: r.json for r in files.canonical_json(df, "k").collect()}
    for r in df.collect():
        want = plain(r)
        assert got[want.pop("k")] == json.dumps(want, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    odd = spark.createDataFrame([(1, float("nan"), {10: 1, 9: 2})], "k int, d double, m map<int,int>")
    assert files.canonical_json(odd, "k").first().json == '{"d":null,"m":{"9":2,"10":1}}'


# ---- batches


def test_a_repeated_batch_leaves_one_copy(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    rows = spark.range(200).select(F.col("id").alias("event_id"), F.lit('{"token":"x"}').alias("payload"))
    table = ledger.event_ledger(spark, path, rows)
    commit = batches.BatchTable.commit
    monkeypatch.setattr(batches.BatchTable, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        ledger.append_events(path, rows.where("event_id < 100"), batch="b0")
    assert table.read().count() == 0  # staged, not committed
    monkeypatch.setattr(batches.BatchTable, "commit", commit)
    for batch, df in (("b0", rows.where("event_id < 100")), ("b0", rows.where("event_id < 100")), ("b1", rows.where("event_id >= 50")), ("b0", rows), ("b2", rows.limit(0)), ("b3", rows)):
        ledger.append_events(path, df, batch=batch)
    got = sorted((r.sequence, r.event_id, r.payload) for r in table.read().collect())
    assert got == [(i + 1, i, '{"token":"[REDACTED]"}') for i in range(200)]
    assert [(m["batch"], m["first"], m["n"]) for m in table.manifests() if m["n"]] == [("b0", 1, 100), ("b1", 101, 100)]


def test_only_touched_shards_are_read(spark, tmp_path):
    path = str(tmp_path / "store")
    content.cas_append(path, spark.range(300).select(F.col("id").cast("string").alias("body")), "body")
    store = content.content_store(spark, path)
    few = spark.createDataFrame([("5",), ("6",)], "body string").select(content.sha256(F.col("body")).alias("sha256"))
    shards = store.touched(few, "sha256")
    plan = store.read(shards)._jdf.queryExecution().executedPlan().toString()
    assert len(shards) <= 2 and "shard" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r.shard for r in store.read(shards).select("shard").distinct().collect()} == set(shards)
    content.cas_append(path, spark.createDataFrame([("5",), ("new",)], "body string"), "body")
    assert store.read().count() == 301
    wanted = store.read().select(content.cas_uri(F.col("sha256")).alias("uri"))
    assert content.cas_get(store.read(), wanted, 100).where("error IS NOT NULL").count() == 0


# ---- lineage


def test_a_long_chain_and_cycles(spark, monkeypatch):
    rounds, write = [], ledger.written
    monkeypatch.setattr(ledger, "written", lambda df, name: rounds.append(name) or write(df, name))
    chain = spark.range(10_000).select((F.col("id") + 1).alias("child"), F.col("id").alias("parent"))
    got = {r.artifact_id: (r.origin, r.steps) for r in ledger.lineage_origins(chain).collect()}
    assert got == {i: (0, i) for i in range(1, 10_001)} and len(rounds) <= 2 + 14
    cycle = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (4, 9), (5, 9), (6, 6)], "child int, parent int")
    assert {tuple(r) for r in ledger.lineage_origins(cycle).collect()} == {(4, 9, 1), (5, 9, 1), *[(i, None, None) for i in (1, 2, 3, 4, 6)]}
    assert ledger.lineage_origins(cycle.limit(0)).count() == 0


def test_origins_by_brute_force(spark):
    rng = random.Random(3)
    edges = {(i, rng.randrange(i)) for i in range(1, 120) for _ in range(rng.choice([0, 1, 1, 2, 3]))}
    parents = defaultdict(set)
    for c, p in edges:
        parents[c].add(p)
    want = {}
    for node in parents:
        level, k = {node}, 0
        while level:
            for x in level:
                if x not in parents and x != node:
                    want.setdefault((node, x), k)
            level, k = {p for x in level for p in parents.get(x, ())}, k + 1
    df = spark.createDataFrame([*edges, (None, 1), (1, None)], "child int, parent int")
    assert {(r.artifact_id, r.origin): r.steps for r in ledger.lineage_origins(df).collect()} == want


def test_lineage_of_braids_is_linear_and_dealt_by_its_rows(spark, monkeypatch):
    """No round makes many more ways than there are edges, and shuffles have a partition per so many of them."""
    tables, write = [], ledger.written

    def counted(df, name):
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        made = write(df, name)
        tables.append((made.count(), parts))
        return made

    monkeypatch.setattr(ledger, "written", counted)
    monkeypatch.setattr(ledger, "FEW_WAYS", 0, raising=False)
    monkeypatch.setattr(ledger, "WAYS_PER_TASK", 20, raising=False)
    n, before = 60, spark.conf.get("spark.sql.shuffle.partitions")
    edges = [(i, i - k) for i in range(1, n) for k in (1, 3) if i >= k] + [(-1, i) for i in range(n)] + [(100, 101), (101, 100), (102, 100), (102, 0)]
    got = {tuple(r) for r in ledger.lineage_origins(spark.createDataFrame(edges, "child int, parent int")).collect()}
    assert got == {(i, 0, i // 3 + i % 3) for i in range(1, n)} | {(-1, 0, 1), (102, 0, 1)} | {(i, None, None) for i in (100, 101, 102)}
    assert max(rows for rows, _ in tables) <= 1.2 * len(edges)
    assert all(parts >= len(edges) // 20 for _, parts in tables[1:]) and spark.conf.get("spark.sql.shuffle.partitions") == before


def test_a_report_has_all_artifacts_of_its_run(spark):
    rows = spark.createDataFrame([(1, "a", 1, "raw"), (1, "b", 2, "text"), (1, "r", 3, "crawl_report"), (1, "c", 4, "raw"), (2, "d", 1, "raw")], "run_id int, artifact_id string, seq int, representation string")
    assert {tuple(r) for r in ledger.report_edges(rows).collect()} == {("r", "a"), ("r", "b")}


# ---- streams


def run(stream, tmp_path):
    stream.writeStream.option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out")).start().awaitTermination()


def test_a_tail_is_in_sequence_over_batches(spark, tmp_path):
    rng = random.Random(9)
    kinds = {1: 12, 2: 7, 3: 20}  # run 3 does not end, and lacks its 15th event
    rows = [(r, n, "FINISHED" if n == last and r < 3 else "STEP", r * 100 + n) for r, last in kinds.items() for n in range(1, last + 1) if (r, n) != (3, 15)]
    rows += [(1, 13, "STEP", 0), (1, 4, "OTHER", 0)] + rows[:3]
    rng.shuffle(rows)
    schema = "run_id int, sequence long, event_type string, v long"
    source = str(tmp_path / "in")
    for part in (rows[:15], rows[15:30], rows[30:]):  # stopped and started again between the parts
        for i in range(0, len(part), 5):
            spark.createDataFrame(part[i : i + 5], schema).coalesce(1).write.mode("append").parquet(source)
        tail = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        run(streams.until_finished(tail), tmp_path)
    got = defaultdict(list)
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        got[r.run_id].append(r.sequence)
    assert {k: sorted(v) for k, v in got.items()} == {1: [*range(1, 13)], 2: [*range(1, 8)], 3: [*range(1, 15)]}


def test_waiting_events_of_a_tail():
    """The processor alone: order within a run, gaps that are given up, and a state that is dropped."""

    class Value:
        def __init__(self):
            self.v = None

        exists = lambda self: self.v is not None
        get = lambda self: self.v

        def update(self, v):
            self.v = v

        def clear(self):
            self.v = None

    class Map(dict):
        exists = lambda self: bool(self)
        containsKey, getValue, updateValue, removeKey = dict.__contains__, dict.__getitem__, dict.__setitem__, dict.__delitem__  # noqa: N815

    class Handle:
        timers: list = []
        getValueState = lambda self, *_, **__: Value()  # noqa: E731, N815
        getMapState = lambda self, *_, **__: Map()  # noqa: E731, N815
        listTimers = lambda self: iter(self.timers)  # noqa: E731, N815
        registerTimer = lambda self, t: self.timers.append(t)  # noqa: E731, N815
        deleteTimer = lambda self, t: self.timers.remove(t)  # noqa: E731, N815

    class Clock:
        getCurrentProcessingTimeInMs = lambda self: 1000  # noqa: E731, N815

    import pandas as pd
    from pyspark.sql.types import _parse_datatype_string

    p, handle = streams._InSequence(_parse_datatype_string("run_id int, sequence long, event_type string"), "END", 50, None), Handle()
    p.init(handle)
    send = lambda *ns: [n for f in p.handleInputRows((1,), iter([pd.DataFrame([(1, n, "END" if n == 9 else "x") for n in ns], columns=["run_id", "sequence", "event_type"])]), Clock()) for n in f["sequence"]]
    assert (send(3, 2), sorted(k[0] for k in p.waiting), handle.timers) == ([], [2, 3], [1050])
    assert send(1, 5) == [1, 2, 3] and send(2, 7) == []
    handle.timers.clear()
    assert [n for f in p.handleExpiredTimer((1,), Clock(), None) for n in f["sequence"]] == [5]
    assert send(6, 9, 8, 10) == [6, 7, 8, 9]
    assert not p.waiting and not p.next.exists() and not handle.timers and send(1, 2) == []


def test_each_transition_is_told_once(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "run_id string, state string, seq long"
    parts = [[("a", "QUEUED", 1), ("b", "RUNNING", 2), ("b", "QUEUED", 3)], [("a", "FINISHED", 4), ("a", "RUNNING", 5), ("c", "OTHER", 6)], [("a", "FINISHED", 7), ("b", "FINISHED", 8), ("b", "FINISHED", 9)]]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        run(streams.run_states(spark.readStream.schema(schema).parquet(source)), tmp_path)
    got = sorted((r.run_id, r.seq, r.state, r.notify) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 1, "QUEUED", False), ("a", 4, "FINISHED", True), ("b", 2, "RUNNING", False), ("b", 8, "FINISHED", True)]


def test_a_repeated_micro_batch_stores_once(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(b"a",), (b"b",), (b"a",)], "body binary").write.parquet(source)
    path = str(tmp_path / "store")
    arrivals = spark.readStream.schema("body binary").parquet(source)
    for marks in ("m1", "m2"):  # the second start has lost its marks and runs the batch again
        arrivals.writeStream.option("checkpointLocation", str(tmp_path / marks)).trigger(availableNow=True).foreachBatch(lambda df, n: content.cas_append(path, df, "body", f"b{n}")).start().awaitTermination()
    assert content.content_store(spark, path).read().count() == 2
    shutil.rmtree(path)
    assert math.isclose(content.content_store(spark, path).read().count(), 0)


# ---- addresses


def test_addresses_equal_the_library(spark):
    import ipaddress

    rng = random.Random(7)
    edge = [n for group in (addresses.PRIVATE_4, addresses.PUBLIC_4, addresses.SHARED_4, addresses.MULTICAST_4, addresses.PRIVATE_6, addresses.PUBLIC_6, addresses.MULTICAST_6, (addresses.MAPPED,)) for n in group]
    texts = []
    for n in map(ipaddress.ip_network, edge):
        for x in (int(n.network_address), int(n.broadcast_address), int(n.network_address) - 1, int(n.broadcast_address) + 1, int(n.network_address) + rng.randrange(n.num_addresses)):
            if 0 <= x < 1 << n.max_prefixlen:
                texts.append(str((ipaddress.IPv4Address if n.version == 4 else ipaddress.IPv6Address)(x)))
    texts += [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(50_000)]
    for _ in range(50_000):
        groups = [f"{rng.choice([0, 0, 1, rng.getrandbits(16)]):{rng.choice(['x', 'X', '04x'])}}" for _ in range(8)]
        if rng.random() < 0.3:
            groups[:6] = ["0", "0", "0", "0", "0", rng.choice(["ffff", "0"])]
        i = rng.randint(0, 7)
        texts.append(rng.choice([":".join(groups), ":".join(groups[:i]) + "::" + ":".join(groups[i + rng.randint(0, 3) :]), ":".join(groups[:6]) + ":" + str(ipaddress.IPv4Address(rng.getrandbits(32))), str(ipaddress.IPv6Address(rng.getrandbits(128)))]))
    texts += ["", ":", "::", "1::2::3", ":1::", "1:::2", "::1%eth0", "::1%", "::1%a%b", "1.2.3", "01.2.3.4", "1.2.3.256", "1.2.3.4\n", " 1.2.3.4", "::ffff:1.2.3.4.5", "::1.2.3.4", "::ffff:01.2.3.4", "12345::", "g::", "1.2.3.4%x", "::/1", "٣.2.3.4", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8::", "::1:2:3:4:5:6:7:8"]

    def public(x):
        try:
            ip = ipaddress.ip_address(x)
        except ValueError:
            return False
        return bool(ip.is_global and not ip.is_multicast and not ip.is_unspecified)

    df = spark.createDataFrame([(i, x) for i, x in enumerate([*texts, None])], "i int, x string").select("i", addresses.is_public(F.col("x")).alias("p"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r.i: r.p for r in df.collect()}
    assert got.pop(len(texts)) is None
    assert [(x, got[i]) for i, x in enumerate(texts) if got[i] != public(x)] == []


def test_the_longest_block_lists_an_address(spark):
    import ipaddress

    rng = random.Random(8)
    nets = {str(ipaddress.ip_network((rng.getrandbits(32), rng.choice([0, 4, 9, 16, 30])), strict=False)) for _ in range(60)} | {str(ipaddress.ip_network((rng.getrandbits(4) << 124, rng.choice([1, 3, 4])), strict=False)) for _ in range(20)} | {"9.9.9.9"}
    given = [str(ipaddress.ip_address(rng.getrandbits(32))) for _ in range(200)] + [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(200)] + ["9.9.9.9", "no address", None]
    blocks = spark.createDataFrame([(n,) for n in [*nets, "1.2.3.4/8", "x/8", "10.0.0.0/99", "10.0.0.0/"]], "block string")
    got = {r.address: r.block for r in addresses.listed_in(spark.createDataFrame([(x,) for x in given], "address string"), blocks).collect()}
    parsed = [ipaddress.ip_network(n) for n in nets]
    for x in given:
        try:
            ip = ipaddress.ip_address(x)
        except ValueError:
            assert got[x] is None
            continue
        best = max((n for n in parsed if n.version == ip.version and ip in n), key=lambda n: n.prefixlen, default=None)
        assert got[x] == (None if best is None else "9.9.9.9" if str(best) == "9.9.9.9/32" else str(best))


# ---- questions


def test_many_questions_as_one_at_a_time(spark):
    rng = random.Random(12)
    words = ["License", "version", "LICENSED", "naïve", "x_1", "the", "abc", "bca", "ÅSA", "Kelvin"]
    docs = spark.createDataFrame([(i, "\n".join(" ".join(rng.choices(words, k=rng.randint(0, 3))) for _ in range(rng.randint(0, 6)))) for i in range(80)] + [(100, None), (None, "License"), (101, "")], "doc_id long, text string").repartition(3)
    asked = ["license?", "The version of abc", "x_1 Kelvin naive", "nothing here", "", None, "sed icense", " ".join(f"w{i}x" for i in range(8)) + " license"]
    questions = spark.createDataFrame(list(enumerate(asked)), "question_id int, question string")
    for limit in (search.PASS_BYTES, 6):
        got = defaultdict(list)
        for r in search.search_questions(docs, questions, lines=5, pass_bytes=limit).orderBy("question_id", "place").collect():
            got[r.question_id].append((r.locator, r.excerpt))
        for i, question in enumerate(asked):
            terms = [r.t for r in spark.range(1).select(F.explode(runs.query_terms(F.lit(question or ""))).alias("t")).collect()]
            want = [(r.locator, r.excerpt) for r in runs.exact_search(docs.where("doc_id IS NOT NULL"), terms, lines=5).orderBy("doc_id", "line").collect()] if terms else []
            assert got[i] == want, question
    assert search.search_questions(docs, questions.limit(0)).count() == 0


# ---- rule tables


def test_rule_tables_small_and_large(spark):
    rng = random.Random(5)
    part = lambda: "".join(rng.choice(["/a", "/b", "/ab", "/", "/c.d"]) for _ in range(rng.randint(0, 4)))
    table = [(f"r{i}", rng.choice(["h.x", "H.x.", "k.x", None]), part() or rng.choice(["", "/", "odd"]), rng.random() < 0.5, rng.randint(0, 9)) for i in range(25)] + [(None, "h.x", "/a", True, 0)]
    given = [f"{rng.choice(['http', 'https', 'ftp'])}://{rng.choice(['', '', '', 'me@'])}{rng.choice(['h.x', 'h.X', 'k.x.', 'z.x'])}{rng.choice(['', '', ':443', ':80', ':8080'])}{part()}{rng.choice(['', '?/a', '#/b'])}" for _ in range(300)]
    given += [None, "", "no url", "https://h.x", given[0], given[0], "https://h.x" + "/a" * 5000]
    targets = spark.createDataFrame([(i, x, "old") for i, x in enumerate(given)], "i int, url string, rule string")
    listed = spark.createDataFrame(table, "rule string, host string, prefix string, http boolean, place int")

    def want(x, order):
        if x is None or not any(x.startswith(s) for s in ("http://", "https://")) or "@" in x:
            return (None, None)
        scheme, rest = x.split("://")
        rest = rest.split("?")[0].split("#")[0]
        where, slash, path = rest.partition("/")
        name, _, port = where.partition(":")
        if port not in ("", "443" if scheme == "https" else "80"):
            return (None, None)
        path = slash + path or "/"
        fits = [(len(p.count("/") * [0]) if p != "/" else 0, r, p, o) for r, h, p, plain, o in table if r and h and h.lower().rstrip(".") == name.lower().rstrip(".") and (scheme == "https" or plain) and (p in ("", "/") or p.startswith("/") and (path == p or path.startswith(p + "/")))]
        best = min(fits, key=lambda f: (f[3], f[1]) if order else (-f[0], f[1]), default=None)
        return (None, None) if best is None else (best[1], best[2])

    for order in (None, "place"):
        for how in ({}, {"held_bytes": 0}, {"held_depths": 1}):
            got = {r.i: (r.rule, r.rule_prefix) for r in rules.match_rules(targets, listed, order=order, **how).collect()}
            assert got == {i: want(x, order) for i, x in enumerate(given)}
    assert {r.rule for r in rules.match_rules(targets, listed.limit(0)).collect()} == {None}


def test_named_apis_as_a_rule_table(spark):
    apis = spark.createDataFrame([(n, h, p, n == "arxiv_api") for n, h, p in urls.NAMED_APIS], "rule string, host string, prefix string, http boolean")
    given = [f"{s}://{h}{port}{p}{end}" for _, h, p in urls.NAMED_APIS for s in ("http", "https") for port in ("", ":443") for end in ("", "/x", "x")]
    rows = rules.match_rules(spark.createDataFrame([(x,) for x in given], "url string").withColumn("api", urls.named_api(F.col("url"))), apis)
    assert rows.where("NOT rule <=> api").count() == 0


def test_split_joins_deal_hot_keys(spark, tmp_path):
    spark.range(300).selectExpr("CASE WHEN id < 200 THEN 'a' WHEN id < 280 THEN NULL ELSE concat('k', id) END AS k", "id").write.parquet(str(tmp_path / "left"))
    left = spark.read.parquet(str(tmp_path / "left"))
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("most"))
    got = shared.join_split(left, right, "k", "n", 300, few=7, hot=100)
    assert got.columns == ["k", "id", "n", "most"]
    assert sorted(r.id for r in got.collect()) == list(range(300)) and got.where("k = 'a' AND most <> 199").count() == 0


# ---- trees


def test_leaves_of_nested_json(spark):
    rng = random.Random(9)

    def made(depth):
        if depth and rng.random() < 0.6:
            n = rng.randint(0, 4)
            return [made(depth - 1) for _ in range(n)] if rng.random() < 0.5 else {rng.choice(["a/b", "c~", "", "é"]) + str(i): made(depth - 1) for i in range(n)}
        return rng.choice([None, True, 7, -2.5, "x\"y", "", 12345678901])

    def leaves(v, path, most):
        inner = list(enumerate(v)) if isinstance(v, list) else [(k.replace("~", "~0").replace("/", "~1"), x) for k, x in v.items()] if isinstance(v, dict) else []
        if not inner:
            yield path, v, False
        for k, x in inner:
            if most is not None and isinstance(v, list) and k >= most:
                yield f"{path}/{k}", None, True
            else:
                yield from leaves(x, f"{path}/{k}", most)

    given = [made(6) for _ in range(40)]
    deep = json.loads("[" * 10 + "1" + "]" * 10)
    bodies = [json.dumps(v) for v in [*given, deep]] + ["", "no json", '{"a":1,"a":2}', None]
    df = spark.createDataFrame([(i, b, 0) for i, b in enumerate(bodies)], "key int, body string, path int")
    for most in (None, 2):
        got = [(r.key, r.path, r.value if r.value is None else json.loads(r.value), r.omitted) for r in trees.json_rows(df, "body", "key", most=most).collect()]
        want = [(i, *x) for i, v in enumerate([*given, deep]) for x in leaves(v, "", most)]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
        for i, v in enumerate(given):
            if most is not None:
                assert sum(r[3] for r in got if r[0] == i) == payloads.truncate(v, most)[1]
    assert trees.json_rows(df.limit(0), "body", "key").count() == 0


def test_elements_of_xml(spark):
    bodies = ['<a x="1"><b>t</b><n:c xmlns:n="u" n:y="2"><b/>tail</n:c></a>', "<a>", None]
    rows = spark.createDataFrame([(i, b, "xml_endpoint", "text/xml") for i, b in enumerate(bodies)], "tag int, body string, capability string, media_type string")
    normal = payloads.payload_normalize(rows).withColumnRenamed("tag", "i")
    got = sorted((r.path, r.position, r.tag, r.attributes, r.text) for r in trees.element_rows(normal, "i").collect())
    assert got == [("/a[0]", 0, "a", {"x": "1"}, ""), ("/a[0]/b[0]", 0, "b", {}, "t"), ("/a[0]/c[1]", 1, "c", {"y": "2"}, ""), ("/a[0]/c[1]/b[0]", 0, "b", {}, "")]
    value = normal.where("i = 0").select(F.try_variant_get(trees.as_variant(F.col("data")), "$.children[1].attributes.y", "string")).first()[0]
    assert value == "2"
