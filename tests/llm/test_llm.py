"""Numbered operators against brute force, exact round trips and held-out accuracy, and their odd inputs."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("strandmill.llm")

from pyspark.sql import functions as F  # noqa: E402

from strandmill.llm import curriculum, decontaminate, langid, media, neardup, ppm, secret_scan, sharding, suffix_dedup, warc, webp  # noqa: E402
from strandmill.llm.components import components  # noqa: E402
from strandmill.llm.scratch import fresh_path  # noqa: E402

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words="the of and a thing other river stone cloud paper never always window garden letter".split()):
    return " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    out = [base, base, " ".join(near), base.upper(), prose(rng, 80), None, "", " \t\n", "one two", "One  two", "é ü ß 漢字 \U0001f600 " * 30, prose(rng, 4000)]
    out += [prose(rng, 30) + " " + base for _ in range(3)] + [prose(rng, 50) for _ in range(20)]
    return [(i, t, "en" if i % 3 else None, [None, "b", "a", "hot", "hot"][i % 5], None) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3, "doc_id")


# ------------------------------------------------------------------ 1 media


@pytest.mark.parametrize("transforms", [(), (0,), (1,), (2,), (3,), (2, 0, 1), (3, 0)])
@pytest.mark.parametrize("cache_bits", [0, 5])
def test_webp_round_trip(transforms, cache_bits):
    rng = np.random.default_rng(4)
    for w, h in ((1, 1), (5, 7), (33, 12)):
        px = rng.choice(rng.integers(0, 2**32, 9, dtype=np.uint32), w * h)
        for mode in range(-1, 14) if 0 in transforms else (11,):
            got = webp.decode(webp.encode(px, w, transforms, cache_bits, True, mode))
            assert got[:2] == (w, h) and (got[2] == px).all()


def test_webp_rejects_damage():
    data = webp.encode_grey(np.arange(1152, dtype=np.uint8), 576)
    with pytest.raises(ValueError):
        webp.decode(data[:40])
    with pytest.raises(ValueError):
        webp.decode(b"RIFF" + data[8:])


def test_webp_reads_extended_files():
    px = np.random.default_rng(5).integers(0, 2**32, 35, dtype=np.uint32)
    plain = webp.encode(px, 7)
    part = lambda kind, body: kind + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) % 2)
    head = part(b"VP8X", bytes([0x28, 0, 0, 0, 6, 0, 0, 4, 0, 0]))
    whole = lambda *parts: b"RIFF" + (4 + sum(map(len, parts))).to_bytes(4, "little") + b"WEBP" + b"".join(parts)
    got = webp.decode(whole(head, part(b"ICCP", b"abc"), plain[12:], part(b"EXIF", b"12345")))
    assert got[:2] == (7, 5) and (got[2] == px).all()
    for bad in (whole(head, part(b"ICCP", b"abc")), whole(head, part(b"ANIM", b"\0" * 6), plain[12:]), whole(part(b"VP8 ", b"\0" * 30))):
        with pytest.raises(ValueError):
            webp.decode(bad)


def test_media_round_trip(spark, docs, rows):
    got = {r["doc_id"]: r for r in media.load(media.store(docs.select("doc_id", "text", "lang"), "text")).collect()}
    for i, t, *_ in rows:
        assert bytes(got[i]["pixels"]) == media.padded((t or "").encode())
    assert got[0]["feature"] == got[1]["feature"] and media.load(media.store(docs.limit(0).select("doc_id", "text"), "text")).count() == 0


# ------------------------------------------------------------------ 2 scores


def test_ppm_matches_brute_force(spark, docs, rows):
    held = F.col("doc_id") % 4 == 1
    got = {r["id"]: r for r in ppm.score_corpus(docs, "doc_id", "text", held, order=2).collect()}
    counts, total = [Counter() for _ in range(3)], Counter()
    seen = [{} for _ in range(3)]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t, *_ in rows:
        if i % 4 == 1:
            continue
        total.update([*WORDS.findall((t or "").translate(lower)), None])
        b = b"\xff\xff" + (t or "").encode() + b"\xff"
        for p in range(2, len(b)):
            for k in range(3):
                counts[k][b[p - k : p + 1]] += 1
                seen[k].setdefault(b[p - k : p], set()).add(b[p])
    n, v = sum(total.values()), len(total)
    for i, t, *_ in rows:
        b, log = b"\xff\xff" + (t or "").encode() + b"\xff", 0.0
        for p in range(2, len(b)):
            gone = set()
            for k in (2, 1, 0):
                ctx = b[p - k : p]
                left = {s: counts[k][ctx + bytes([s])] for s in seen[k].get(ctx, set()) - gone}
                if b[p] in left:
                    log += np.log10((left[b[p]] - 0.5) / sum(left.values()))
                    break
                if left:
                    log += np.log10(0.5 * len(left) / sum(left.values()))
                gone |= seen[k].get(ctx, set())
            else:
                log -= np.log10(256 - len(gone))
        tokens = [*WORDS.findall((t or "").translate(lower)), None]
        assert abs(got[i]["score"] - log) < 1e-6 and got[i]["n_tokens"] == len(tokens) and got[i]["n_known"] == sum(total[w] > 0 for w in tokens)
        assert abs(got[i]["base_score"] - sum(np.log10((total[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)) < 1e-6 and got[i]["train_tokens"] == n


# ------------------------------------------------------------------ 3 shards, 7 mix


def test_fisher_yates_permutes(spark):
    df = spark.range(0, 40).select("id", sharding.fisher_yates(F.col("id"), 5, F.col("id")).alias("p"))
    got = df.collect()
    assert all(sorted(r["p"]) == list(range(r["id"])) for r in got) and sum(r["p"] != sorted(r["p"]) for r in got) > 30


def test_shards_are_even_gapless_and_stable(spark, docs):
    many = docs.union(docs).union(docs.limit(5)).withColumn("shard", F.lit(7)).withColumn("extra", F.lit(None).cast("map<string,int>"))
    got = sharding.external_shuffle(many, "doc_id", 5, bucket_rows=16)
    pdf = got.select("doc_id", "shard", "slot").toPandas()
    per = pdf.groupby("shard").slot
    assert len(pdf) == many.count() and per.count().max() - per.count().min() <= 1
    assert all(sorted(s) == list(range(len(s))) for _, s in per)
    again = sharding.external_shuffle(many.repartition(7), "doc_id", 5, bucket_rows=16).select("doc_id", "shard", "slot").toPandas()
    assert sorted(map(tuple, pdf.values)) == sorted(map(tuple, again.values))
    assert sharding.external_shuffle(docs.limit(0), "doc_id", 5).count() == 0


def test_repeated_rows_are_spread_and_shards_read_back(spark):
    rows = [(7, "same", None)] * 900 + [(None, None, "x")] * 90 + [(i, f"text {i}", "y") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot string").repartition(5)
    shuffled = sharding.external_shuffle(df, "doc_id", 4, bucket_rows=32)
    path = fresh_path(spark, "test-shards")
    sharding.write_shards(shuffled, path)
    got = sharding.read_shards(spark, path, shuffled).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((i, t) for i, t, _ in rows)
    per = [sorted(r["slot"] for r in got if r["shard"] == s) for s in range(4)]
    assert all(p == list(range(len(p))) for p in per) and max(map(len, per)) - min(map(len, per)) <= 1
    light = df.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("__sm_key"), F.xxhash64(*df.columns).alias("__sm_tie"))
    times = light.groupBy("__sm_key", "__sm_tie").count().where("count > 4")
    buckets = sharding._numbered(df, "doc_id", F.xxhash64(*df.columns), times).groupBy("__sm_key", "__sm_tie").agg(F.countDistinct("__sm_copy").alias("n"), F.count("*").alias("c"))
    assert all(r["n"] == r["c"] for r in buckets.collect()) and buckets.count() == 202


def water_fill(sizes, weights, budget, most):
    open_, target, left = set(sizes), {}, budget * sum(sizes.values())
    while open_:
        w = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / w > most * sizes[s]]
        if not over:
            return target | {s: left * weights[s] / w for s in open_}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(most * sizes[s] for s in over)
        open_ -= set(over)
    return target


def test_mix(spark, docs, rows):
    light = docs.select("doc_id", "source", curriculum.words_in(F.col("text")).alias("__sm_size"))
    got = curriculum.curriculum(light, bin_rows=4).collect()
    sizes = Counter()
    for i, t, _, s, _ in rows:
        sizes[s] += len(WORDS.findall(t or ""))
    names = sorted([s for s in sizes if s is not None]) + [None]
    expect = water_fill(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, 1.5, 2.0)
    taken = Counter()
    for r in got:
        assert abs(r["__sm_target"] - expect[r["source"]]) < 1e-6 and len(r["__sm_at"]) <= 2 and all(0 <= x <= 1 for x in r["__sm_at"])
        taken[r["source"]] += r["__sm_size"] * len(r["__sm_at"])
    largest = max(r["__sm_size"] for r in got)
    assert all(abs(taken[s] - expect[s]) <= largest for s in sizes)
    assert curriculum.curriculum(light.limit(0)).count() == 0


def test_schedule_is_inverted(spark):
    df = spark.range(0, 101).select((F.col("id") / 100).alias("x"))
    knots = curriculum._schedule(F.lit(0), ((1.5, 1.0, 0.5),))
    for r in df.select("x", curriculum.invert(F.col("x"), knots).alias("t")).collect():
        t = r["t"]
        share = 1.5 * t - t * t / 2  # the integral of 1.5 - t, whose whole is 1
        assert abs(share - r["x"]) < 1e-9


# ------------------------------------------------------------------ 4 repeats


def brute_repeats(rows, length):
    seen, out = set(), {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(b[p : p + length])
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_match_brute_force(spark, docs, rows):
    extra = [(100 + k, "x" * n, None, None, None) for k, n in enumerate((99, 100, 101, 350))] + [(200, "ab" * 300, None, None, None)]
    whole = [*rows, *extra]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(whole, DOCS).repartition(5, "doc_id"), "doc_id", "text", range_rows=50)
    found = {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()}
    assert found == brute_repeats(whole, 100)
    assert suffix_dedup.remove_repeats(docs.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("hot_rows", [0, 5])
def test_common_anchors_are_spread(spark, hot_rows):
    rng = random.Random(11)
    line = "".join(rng.choice("abcdefghijklmnop ") for _ in range(90))
    texts = [prose(rng, 6) + line + prose(rng, 12) for _ in range(60)]
    texts += [texts[k][: 150 + k] + prose(rng, 3) for k in range(0, 40, 3)] + [line * 5, line * 3, "é" + line * 2, texts[7], texts[7], "z" * 400]
    whole = [(i, t, None, None, None) for i, t in enumerate(texts)][::-1]
    frame = spark.createDataFrame(whole, DOCS).repartition(4)
    got = suffix_dedup.remove_repeats(frame, "doc_id", "text", range_rows=40, hot_rows=hot_rows)
    found = {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()}
    assert found == brute_repeats(whole[::-1], 100)
    assert sum(v[1] for v in found.values()) > 1000


def test_loser_tree_merges_and_knows_prefixes():
    rng = random.Random(2)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(9))) for _ in range(5)]
    order = list(suffix_dedup.merge([suffix_dedup.unfold(*suffix_dedup.front_code(r)) for r in runs]))
    heads, out = [iter(r) for r in runs], []
    for r, _ in order:
        out.append(next(heads[r]))
    assert out == sorted(s for r in runs for s in r)
    assert [c for _, c in order[1:]] == [suffix_dedup.common(a, b, 0) for a, b in zip(out, out[1:], strict=False)]


# ------------------------------------------------------------------ 5 leaks


def test_leaks_match_brute_force(spark, docs, rows):
    words = rows[11][1].split()
    items = [(1, " ".join(words[100:130])), (2, " ".join(words[500:512] + ["x"] + words[513:540])), (3, "one two"), (4, None), (5, ""), (6, "not there at all anywhere in any text")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.search(docs, "text", ["doc_id"], table, "item_id", "text").select("doc_id", F.explode("__sm_hits").alias("h"))
    found = {(r["doc_id"], r["h"]["item"], r["h"]["shared"]) for r in got.collect()}
    sets = {i: decontaminate.shingle_set(t) for i, t, *_ in rows}
    expect = set()
    for k, t in items:
        s = decontaminate.shingle_set(t)
        expect |= {(i, k, len(s & d)) for i, d in sets.items() if s and len(s & d) >= 0.75 * len(s)}
    assert found == expect and (11, 1, 26) in found
    blocks = decontaminate.clean(docs, "text", table, "item_id", "text", block=2)
    assert {r["doc_id"] for r in blocks.collect()} == {i for i, *_ in rows} - {i for i, *_ in found}
    assert decontaminate.clean(docs, "text", table.limit(0), "item_id", "text").count() == len(rows)
    often = table.union(table).union(table)
    again = decontaminate.search(docs, "text", ["doc_id"], often, "item_id", "text", block=3).select("doc_id", F.explode("__sm_hits").alias("h"))
    assert sorted((r["doc_id"], r["h"]["item"], r["h"]["shared"]) for r in again.collect()) == sorted(found)


# ------------------------------------------------------------------ 6 language


def test_language(spark):
    rng = random.Random(6)
    vocabulary = {"aa": "kala malta ranta sala tuuli vesi".split(), "bb": "schnee wolke strasse pferd zug und".split()}
    rows = [(k, " ".join(rng.choices(vocabulary[lang], k=rng.randrange(3, 60))), lang) for k, lang in enumerate(["aa", "bb"] * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = langid.fit(df.where("doc_id % 5 != 0"), "text", "lang")
    odd = [(1000, None, None), (1001, "", None), (1002, "123 %%", None), (1003, "ЖЩЭ " * 60, None)]
    got = {r["doc_id"]: r for r in langid.identify(df.union(spark.createDataFrame(odd, df.schema)), "text", models).collect()}
    held = [(got[k]["lang_pred"], lang, got[k]["rejected"]) for k, _, lang in rows if k % 5 == 0]
    assert all(p == lang and not r for p, lang, r in held) and all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[k]["lang_pred"] for k in (1000, 1001, 1002)] == ["und"] * 3 and got[1003]["rejected"]
    assert langid.identify(df.limit(0), "text", models).count() == 0
    assert {r["lang_pred"] for r in langid.identify(df, "text", langid.fit(df.limit(0), "text", "lang")).collect()} == {"und"}


def test_any_number_of_languages(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(k, f"{chr(0x61 + k % 26)}{chr(0x61 + k // 26)} " * rng.randrange(3, 9) + "some more", f"l{k % 40}", "clash") for k in range(400)]
    df = spark.createDataFrame([*rows, *rows[:30]], "doc_id long, text string, lang string, lang_pred string")
    models = langid.fit(df, "text", "lang")
    whole = {(r["doc_id"], r["lang_pred"], r["score"], r["rejected"]) for r in langid.identify(df, "text", models).collect()}
    monkeypatch.setattr(langid, "BLOCK_MODELS", 7)
    got = langid.identify(df, "text", models)
    assert whole == {(r["doc_id"], r["lang_pred"], r["score"], r["rejected"]) for r in got.collect()} and len(whole) == 400
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score", "cross_entropy", "rejected"] and models.count() == 40


def test_probabilities_sum_to_one():
    arrays = langid._train(["abracadabra", "abc abd"], 3)
    model = langid.Model("x", *arrays[:4], floor=float(arrays[4][0]))
    for context in ("ab", "ra", "zz"):
        total = 0.0
        for c in "abcdr ":
            points, _ = langid.code_points([context + c], 3)
            codes = langid.gram_codes(points, 3)
            now = [langid._hash(x[-1:], k) for k, x in enumerate(codes)]
            before = [langid._hash(x[-2:-1], k) for k, x in enumerate(codes)]
            total += float(np.exp(model.score(now, before))[0])
        assert 0.8 < total <= 1.0 + 1e-9  # the rest is for characters never seen


# ------------------------------------------------------------------ 8 near duplicates


def brute_components(rows, threshold=0.75):
    sets = {i: decontaminate.shingle_set(t) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates_match_brute_force(spark, rows):
    rng = random.Random(9)
    base = prose(rng, 100).split()
    group = []
    for k in range(60):
        words = list(base)
        for _ in range(rng.randrange(7)):
            words[rng.randrange(100)] = f"w{rng.randrange(9**5)}"
        group.append((300 + k, " ".join(words), None, None, None))
    whole = [*rows, *group]
    df = spark.createDataFrame(whole, DOCS)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df).collect()}
    assert got == brute_components(whole)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def near_rows(rng, n=160):
    """One group whose members lie on both sides of the threshold, and rows that repeat ids, texts or both."""
    base = prose(rng, 100).split()
    group = []
    for k in range(n):
        words = list(base)
        for _ in range(rng.randrange(12)):
            words[rng.randrange(100)] = f"w{rng.randrange(9**5)}"
        group.append((300 + k, " ".join(words), None, None, None))
    return group


def test_units_find_every_link_without_leaders(spark, monkeypatch):
    none = lambda *args: spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(neardup, "_star", none)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    whole = near_rows(random.Random(10))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(whole, DOCS)).collect()}
    want = brute_components(whole)
    assert got == want and 1 < len({c for _, c in want.values()}) < len(whole)


def test_a_unit_returns_a_forest_of_links():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.choice(40, 30)).astype(np.uint64) for _ in range(30)]
    ones = np.arange(30)
    found = neardup.links_of_unit(np.zeros(30, np.int64), ones, ones, np.zeros((30, 16), np.uint64), sets, 0.6)
    root = {i: i for i in range(30)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        assert find(a) != find(b)
        root[find(a)] = find(b)
    for i in range(30):
        for j in range(i):
            if neardup._linked(sets[i], sets[j], 0.6):
                assert find(i) == find(j)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000), (6000, 6001), (6001, 6000)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(301)}) == 1 and len({got[i] for i in range(1000, 1100)}) == 1 and len(set(got.values())) == 4
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_null_and_repeated_ids(spark):
    base = prose(random.Random(5), 60)
    near, other = base + " more", prose(random.Random(6), 60)
    rows = [(1, base, "x"), (5, near, "y"), (5, other, "z"), (5, other, "z"), (5, other, "a"), (None, other + " more", None), (None, None, "q"), (7, "", "r"), (7, "", "r"), (None, "lone text here", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    kept = sorted(map(str, neardup.keep_one(df).collect()))
    want = [(1, base, "x"), (5, other, "a"), (None, None, "q"), (7, "", "r"), (7, "", "r"), (None, "lone text here", "s")]
    assert kept == sorted(str(r) for r in spark.createDataFrame(want, df.schema).collect())
    assert neardup.keep_one(df.limit(0)).columns == df.columns
    got = neardup.near_duplicates(df).collect()
    assert len(got) == len(rows) and {r["component_id"] for r in got if r["doc_id"] == 5} == {1, 5}


# ------------------------------------------------------------------ 9 archives


def test_archives_round_trip(spark):
    rows = [(1, "http://a\nb", "x"), (2, None, None), (3, "u", "x"), (4, "v", ""), (None, "w", "x"), (5, "z", "é\x00\x1f" * 90), (6, "big", "ab1" * 6_000_000), (6, "big", "ab1" * 6_000_000)]
    path = fresh_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path)
    for split in (70, 4096, warc.SPLIT):
        got = warc.read_archives(spark, path, split).collect()
        assert Counter(r["page_id"] for r in got) == Counter(r[0] for r in rows)
        by = {r["page_id"]: r for r in got}
        assert [by[k]["record_type"] for k in (1, 2, 3, 4, None, 5, 6)] == ["response", "response", "revisit", "revisit", "response", "response", "response"]
        assert (by[3]["refers_to"], by[4]["refers_to"], by[3]["payload_bytes"]) == (1, 2, 1) and bytes(by[5]["payload"]).decode() == rows[5][2]
        assert by[3]["payload_digest"] == base64.b32encode(hashlib.sha1(b"x").digest()).decode() and by[2]["url"] is None


def test_false_magic_is_no_record(tmp_path):
    inner = warc.record(9, "in", b"hidden", None)
    outer = warc.record(1, "u", b"p" * 50 + inner[:-8], None)
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    noise = stored.compress(b"\x1f\x8b\x08 nothing " + inner[:40]) + stored.flush()
    (tmp_path / "a").write_bytes(outer + noise + warc.record(2, "v", b"q", None))
    file = warc._File(f"file:{tmp_path}/a")
    for cut in (1, 64, 10_000):
        got = [warc.parse(c)[0]["X-Page-Id"] for s in range(0, file.size, cut) for _, c in warc.members(file, s, s + cut) if c.startswith(b"WARC")]
        assert got == ["1", "2"]


@pytest.mark.parametrize("cut", [50, 400, 100_000])
def test_damage_raises(tmp_path, cut):
    parts = [warc.record(i, "u", f"page {i} ".encode() * 40, None) for i in range(6)]
    whole, starts = b"".join(parts), np.cumsum([0, *map(len, parts)]).tolist()

    def read(data):
        (tmp_path / "a").write_bytes(data)
        with warc._File(f"file:{tmp_path}/a") as file:
            return [warc.parse(c)[0]["X-Page-Id"] for s in range(0, max(1, file.size), cut) for _, c in warc.members(file, s, s + cut)]

    assert read(whole) == list("012345") and read(b"") == []
    for at in (0, 1, starts[1], starts[2], starts[3] + 2, starts[3] + 60, starts[5], len(whole) - 1):
        with pytest.raises(ValueError):
            read(whole[:at] + bytes([whole[at] ^ 0x55]) + whole[at + 1 :])
    with pytest.raises(ValueError):
        read(whole[: starts[3] + 30] + whole[starts[4] :])
    with pytest.raises(ValueError):
        read(whole[:-9])


# ------------------------------------------------------------------ 10 secrets


def test_secrets_match_brute_force(spark):
    rng = random.Random(10)
    code = lambda n: "".join(rng.choice(secret_scan.ALPHABET[:62]) for _ in range(n))
    texts = [f"ñ {prose(rng, 20)} password = '{code(16)}' AKIA{code(16).upper()} {prose(rng, 9)}" for _ in range(40)]
    texts += [f"{rng.getrandbits(160):040x} API_KEY:\"{code(9)}\" token: short \U0001f600 apikey=x", f"lone {code(40)} here and internationalization_of_everything", None, "", "secret:token:abcdefghij", "AKIA" * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("secrets", F.lit("clash"))
    model = secret_scan.train(df, "text")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["secrets"]] for r in secret_scan.scan(df.drop("secrets"), "text", model).collect()}
    kinds = [("assign", secret_scan.ASSIGN, 8), ("access", secret_scan.ACCESS, 16), ("hex", secret_scan.HEX, 32)]
    for i, t in enumerate(texts):
        expect = sorted((m.start(), o, m.end(), k) for o, (k, p, n) in enumerate(kinds) for m in re.finditer(p, t or "") if len(m[2] if k == "assign" else m[0]) >= n)
        assert [s for s in got[i] if s[0] != "markov"] == [(k, a, b) for a, _, b, k in expect]
    lone = texts[41]
    assert [lone[a:b] for k, a, b in got[41] if k == "markov"] == [lone.split()[1]]
    assert secret_scan.scan(df.drop("secrets").limit(0), "text", model).count() == 0


# ------------------------------------------------------------------ pipeline


def test_pipeline(spark, docs, rows, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    words = rows[11][1].split()
    spark.createDataFrame([(1, " ".join(words[100:130]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept, stages = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, str(tmp_path))
        kept = spark.createDataFrame(kept.collect(), kept.schema)
        stages[name] = {r["doc_id"] for r in kept.collect()}
        assert kept.columns[:5] == docs.columns
    assert stages["language"] == {i for i, t, *_ in rows if t and any(map(str.isalpha, t))} - ({10} - stages["language"])
    assert not stages["near_duplicates"] & {1, 2, 3, 9} and 0 in stages["near_duplicates"] and 11 not in stages["decontamination"]
    assert stages["mixing"] == stages["sharding"] <= stages["decontamination"] and kept.columns[5:] == ["shard", "slot"]
