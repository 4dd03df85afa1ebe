"""Search, archives, URL filter, mixing, quality, licences and the pipeline against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from varibreak.llm import licenses, mixing, quality, topk, urls, warc


def test_top_k_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 37)
    monkeypatch.setattr(topk, "QUERIES", 3)
    draw = np.random.default_rng(1)
    vectors = [(int(i), [float(v) for v in draw.choice([-0.3, 0.0, 0.0, 0.1, 0.25], 8)], 1) for i in range(0, 900, 3)]
    vectors += [(300, vectors[100][1], 1), (1000, None, 1), (1100, [1.0, None], 1), (1200, [float("nan")], 1), (1300, [float("inf")] * 8, 1),
                (1400, [], 1), (1500, [0.5], 1), (None, [1.0] * 8, 1)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, score int").unionAll(
        spark.createDataFrame(vectors[:5], "vec_id long, embedding array<float>, score int"))
    usable = {}
    for i, v, _ in vectors:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            usable[i] = np.pad(np.floor(np.float32(v).astype(float) * 1024).astype(np.int64), (0, 8 - len(v)))
    want = []
    for q in (i for i in usable if i % 100 == 0):
        scores = sorted((-int(usable[q] @ w), i) for i, w in usable.items() if i != q)[:10]
        want += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores)]
    got = [tuple(r) for r in topk.top_k(table, F.col("vec_id") % 100 == 0).collect()]
    assert sorted(got) == sorted(want)
    assert topk.top_k(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1.0, "z") for i, u, h in rows], "page_id long, url string, html string, size double, DIGEST string")


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "same " * 40
    rows = [(5, "http://a/1", big), (2, "http://a/2", big), (9, None, big), (2, "http://a/2", big), (3, "u\r\nX: y", "short"), (4, "u", "short"),
            (7, "u", None), (8, "u", ""), (None, "n", big), (10, "u", "é\r\n\r\nWARC/1.1\r\n" + "x" * 500_000)]
    table = pages(spark, rows)
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.archive_round_trip(table).collect()}
    want = set()
    for i, _, html in rows:
        data = (html or "").encode()
        again = html == big and i != 2
        want.add((i, "revisit" if again else "response", 2 if again else None, len(data), hashlib.sha256(data).hexdigest()))
    assert got == want and warc.archive_round_trip(table).count() == len(rows)
    archives = warc.write_archives(table)
    assert warc.export_archives(archives, tmp_path.as_uri()) == archives.count()
    back = warc.read_archives(warc.open_archives(spark, tmp_path.as_uri())).collect()
    assert len(back) == len(rows) and {r.url for r in back} >= {"http://a/1", "u%0D%0AX: y"}
    assert warc.archive_round_trip(table.limit(0)).count() == 0


def test_warc_rejects_malformed_archives(spark):
    [row] = warc.write_archives(pages(spark, [(1, "u", "hello")]), b"dictionary bytes").collect()
    content = bytes(row.content)
    assert [h["WARC-Type"] for h, _ in warc.read_archive(content)] == ["response"]
    for bad in (content[:-3], b"\x00" + content, content[:30]):
        with pytest.raises(Exception):
            list(warc.read_archive(bad))
    record = warc.build_record(1, "u", "response", "d", 5, None, b"hello")
    for bad in (record.replace(b"WARC/1.1", b"WARC/9"), record.replace(b"Content-Length: 5", b"Content-Length: 4"),
                record.replace(b"WARC-Date", b"WARC-Dat"), record + b"x"):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def brute_rank(seeds, edges, damping=urls.DAMPING, rounds=200):
    out = {}
    for (a, _), n in edges.items():
        out[a] = out.get(a, 0) + n
    mass = dict(seeds)
    for _ in range(rounds):
        new = dict(seeds)
        for (a, b), n in edges.items():
            new[b] = new.get(b, 0) + damping * mass.get(a, 0) * n / out[a]
        mass = new
    return mass


def test_url_rules_and_propagation(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">' for h in hosts) + '<a href="/rel"><a href=\'#top\'>'
    rows = [
        (1, "http://Good.com/a?x", link("friend.org", "friend.org", "other.org")), (2, "https://example.com/en/1", link("good.com")),
        (3, "https://www.Example.com/en/1", None), (4, "http://m.example.com/en/x", ""), (5, "http://bad.net/es/1", link("worse.org")),
        (6, "http://friend.org/p", link("liar.org")), (7, "http://liar.org/", link("bad.net", "bad.net")), (8, None, "x"), (9, "no scheme", "x"),
        (10, "http://bad.net/en", "x"), (11, "http://worse.org", ""), (12, "http://a.bad.net/fr/", ""), (13, "http://xcom/", ""), (13, "http://xcom/", ""),
        (14, "://odd.com?q", ""), (15, "http://com/#f", ""),
    ]
    got = {r.page_id: r for r in urls.judge_pages(pages(spark, rows)).collect()}
    rule = {1: "com/", 2: "example.com/en/", 3: "www.example.com/en/", 4: "example.com/en/", 5: "net/es/", 12: "net/fr/", 15: "com/"}
    for i, _, _ in rows:
        assert got[i].rule == rule.get(i)
        if i in rule:
            assert got[i].verdict == dict(urls.RULES)[rule[i]]
    assert (got[8].host, got[8].path, got[8].verdict) == ("", "", "allow") and (got[9].host, got[1].host, got[1].path) == ("", "good.com", "/a")
    assert (got[14].host, got[14].path, got[11].path) == ("odd.com", "", "")
    edges = {("good.com", "friend.org"): 2, ("good.com", "other.org"): 1, ("example.com", "good.com"): 1, ("bad.net", "worse.org"): 1,
             ("friend.org", "liar.org"): 1, ("liar.org", "bad.net"): 2}
    trust = brute_rank({"good.com": 1, "www.example.com": 1, "com": 1}, edges)
    distrust = brute_rank({"example.com": 1, "m.example.com": 1, "bad.net": 1, "a.bad.net": 1}, {(b, a): n for (a, b), n in edges.items()})
    for r in got.values():
        if r.host and r.trust is not None:
            assert r.trust == pytest.approx(trust.get(r.host, 0), abs=1e-4) and r.distrust == pytest.approx(distrust.get(r.host, 0), abs=1e-4)
    assert got[7].verdict == ("block" if distrust["liar.org"] > 0.5 * (trust["liar.org"] + distrust["liar.org"] + 1) else "allow")
    assert urls.judge_pages(pages(spark, [])).count() == 0


def test_a_small_chain_settles_in_a_large_corpus(spark):
    seeds = spark.createDataFrame([("trust", "big", 1e8), ("trust", "h0", 10.0)], "kind string, host string, mass double")
    edges = spark.createDataFrame([("trust", f"h{i}", f"h{i + 1}", 1.0) for i in range(4)], "kind string, src string, dst string, share double")
    got = {r.host: r.mass for r in urls.propagate(seeds, edges).collect()}
    assert got == pytest.approx({"big": 1e8} | {f"h{i}": 10 * urls.DAMPING**i for i in range(5)})
    with pytest.raises(ValueError, match="settled"):
        urls.propagate(seeds, edges, rounds=2)


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, top=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] >= top * sizes[s]}
        if not over:
            return target | {s: unit * weight[s] for s in open_}
        for s in over:
            target[s] = top * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 10, None: 400, "z": 1, "m": 0}, {"x": 7}, {"A": 5, "a": 5, "é": 5, "": 5}, {"s": 0}])
def test_source_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    want = brute_targets(sizes)
    assert got == pytest.approx({s: want.get(s, 0.0) for s in sizes})


@pytest.mark.parametrize("n", [1, 2, 3, 100, 4097])
def test_permutation_is_a_bijection(n):
    got = mixing.permute(np.arange(n), n, mixing._key("s", 0))
    assert sorted(got.tolist()) == list(range(n))
    assert n < 100 or got.tolist() != list(range(n))


def mixed(spark, n=400):
    draw = random.Random(4)
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else draw.choice(["b", None, "d", "É"])
        rows.append((i, " ".join(f"w{i}.{k}" for k in range(draw.randrange(0, 300))), "en", source, 0, 3))
    rows += [(1, None, "en", "b", None, 1), (1, " ", "en", "b", None, 1), (None, "x y", None, None, None, 1), (7, rows[7][1], "en", rows[7][3], 0, 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row int"), rows


def test_mix_counts(spark):
    table, rows = mixed(spark)
    got = mixing.mix_counts(table).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    want, taken = brute_targets(sizes), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"] and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, words in taken.items():
        assert abs(words - want[s]) <= mixing.BLOCK + 1
    again = mixing.mix_counts(table).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix_counts(table.limit(0)).count() == 0


def test_mix_does_not_depend_on_partitions(spark):
    table, _ = mixed(spark, 200)
    key = lambda df: sorted(str(tuple(r)) for r in df.collect())
    dealt = table.repartition(7, "lang", "doc_id").sortWithinPartitions(F.col("doc_id").desc())
    other = spark.createDataFrame(dealt.collect(), table.schema)
    assert key(mixing.mix_counts(table)) == key(mixing.mix_counts(other))
    assert key(mixing.mix_documents(table)) == key(mixing.mix_documents(other))


def test_mixed_documents_hold_the_taken_words(spark):
    table, rows = mixed(spark, 120)
    out = mixing.mix_documents(table)
    assert out.columns == table.columns
    words = {}
    for r in out.collect():
        own = (r.text or "").split()
        source_words = next((x[1] or "").split() for x in rows if x[0] == r.doc_id and set(own) <= set((x[1] or "").split()))
        assert own == [w for w in source_words if w in set(own)]
        words[r.doc_id] = words.get(r.doc_id, 0) + len(own)
    taken = {}
    for r in mixing.mix_counts(table).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in taken.items() if v}


def test_shards_get_multinomial_counts(spark):
    rows = spark.createDataFrame([(1, "a", 100_000, 150_000.0), (2, "b", 50_000, 20_000.0)], "sid long, source string, source_size long, target double")
    slots = mixing._slots(rows, 10, 1000).toPandas()
    assert slots.groupby("sid").size().to_dict() == {1: 15_000, 2: 2_000}
    per = slots.groupby(["sid", "shard"]).size()
    assert abs(per[1].mean() - 15_000 / 17) < 1 and per[1].std() > 5
    one = slots[slots.sid == 1]
    assert one[one.pass_no == 0].block.nunique() == 10_000 and one[one.pass_no == 1].block.nunique() == 5_000


def quality_table(spark):
    draw = random.Random(5)
    rows, labels = [], []
    for i in range(300):
        junk = i % 5 == 0
        own = [f"word{draw.randrange(500)}" for _ in range(draw.randrange(20, 200))]
        text = " ".join(w + "###" for w in own) if junk else " ".join(own)
        rows.append((i, text, draw.choice(["en", "de", None]), draw.choice(["s1", "s2", None]), 0, 1.0))
        if i % 2 == 0 or i < 20:
            labels.append((i, int(not junk), 0))
    rows += [(1000, None, "en", "s1", 0, 1.0), (None, "fine words here", "en", "s9", 0, 1.0), (3, rows[3][1], "en", "s1", 0, 1.0)]
    labels += [(None, 1, 0), (4, None, 0), (8, 1, 0), (8, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, evidence double")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_quality_keeps_clean_documents(spark):
    docs, labels, rows = quality_table(spark)
    scored = quality.score_documents(docs, labels)
    assert scored.count() == len(rows)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {i for i in range(300) if i % 5} <= ids and not ids & set(range(0, 300, 5))
    assert ids == {r.doc_id for r in scored.filter("keep").collect()}


def test_quality_without_labels_or_rows(spark):
    docs, labels, rows = quality_table(spark)
    assert quality.keep_good(docs, labels.limit(0)).count() == len(rows)
    assert quality.keep_good(docs, labels.filter("quality = 1")).count() == len(rows)
    assert quality.keep_good(docs.limit(0), labels).count() == 0


def test_sites_shrink_toward_their_hosts(spark):
    rows = [("big", "en", 4.0)] * 400 + [("bad", "en", -4.0)] * 400 + [("bad", "de", 4.0)] + [("new", "en", 4.0)]
    sites = quality.site_posteriors(spark.createDataFrame(rows, "source string, lang string, evidence double"), 0.5)
    prior = {(r.source, r.lang): r.prior for r in sites.collect()}
    assert prior["big", "en"] > prior["new", "en"] > prior["bad", "de"] > prior["bad", "en"]


def test_licence_scan(spark):
    draw = random.Random(6)
    plain = lambda: " ".join(draw.choice(["river", "stone", "cloud", "the", "of", "work", "under", "version", "open"]) for _ in range(12))
    rows = [(i, "\n".join(plain() for _ in range(6))) for i in range(80)]
    notices = {100 + k: (family, texts[0]) for k, (family, texts) in enumerate(licenses.TEMPLATES.items())}
    rows += [(i, f"{plain()}\n{notice}\n\n{plain()}") for i, (_, notice) in notices.items()]
    rows += [(200, None), (201, ""), (202, "\n \n"), (203, plain() + " Released under the MIT License. " + plain()), (62, "x"), (62, "x")]
    table = spark.createDataFrame([(i, t, "q", 1) for i, t in rows], "doc_id long, text string, family string, words int")
    got = licenses.scan_licences(table).collect()
    found = {(r.doc_id, r.family) for r in got if r.confirmed}
    assert found >= {(i, family) for i, (family, _) in notices.items()} | {(203, "mit")}
    assert {i for i, _ in found} <= set(notices) | {203} and {r.paragraph for r in got if r.doc_id in notices} == {1}
    assert licenses.scan_licences(table.limit(0)).count() == 0


def test_pipeline_on_the_smallest_tables(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sizes, rows = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = spark.createDataFrame(stage(spark, rows, SMALL).toPandas(), rows.schema)
        assert rows.columns == docs.columns
        sizes.append(rows.count())
    assert sizes[0] > sizes[1] > sizes[2] > 0
    out = corpus_pipeline.run(spark, SMALL)
    assert out.count() == sizes[3] and out.filter("NOT round_trip").count() == 0
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    bad = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").filter("quality = 0").collect()}
    assert not ids & bad
