import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import exact_dedup as X
from sparkloom.llm import mixing as M
from sparkloom.llm import quality_rules as Q
from sparkloom.llm import simhash as S
from sparkloom.llm.common import Members

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x") for i, t, s in rows], "doc_id long, text string, source string, size string")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocab = "the of and river stone cloud bright under seven lamp".split()
    made = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 60))), rng.choice(["b", "a", None, "é", "Z"])) for i in range(120)]
    made += [(200 + i, made[i][1].replace(" ", " \n\t"), "a") for i in range(20)]
    made += [(300, None, "a"), (301, "", None), (302, " \x0b ", "a"), (None, made[5][1], "b"), (7, made[7][1], made[7][2]), (7, made[7][1], made[7][2])]
    made += [(400, "long " * 20000, "c"), (401, "long " * 19999 + "tail", "c"), (402, "x" * 300 + "a", "c"), (403, "x" * 300 + "b", "c")]
    return made


def test_members_never_drop_a_member(spark):
    keys = spark.range(0, 3000, 3).select((F.col("id") * 977 - 4000).alias("k"))
    marked = Members(keys, "k", bits=16).mark(spark.range(3000).select((F.col("id") * 977 - 4000).alias("k")), F.col("k"), "m")
    got = {r.k: r.m for r in marked.collect()}
    assert all(got[i * 977 - 4000] for i in range(0, 3000, 3)) and sum(got.values()) < 1300


def test_exact_dedup(spark, rows):
    out = X.exact_dedup(docs(spark, rows), carry={"sha": F.sha2(X.normalised(F.col("text")), 256)})
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[SPACE.sub(" ", t or "")].append(i)
    want = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, want))
    assert X.exact_dedup(docs(spark, rows).where("false")).count() == 0


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints(rows):
    for _, t, _ in rows[:60] + rows[-6:]:
        assert S.fingerprint(t) == plain_fingerprint(t)
    assert S.fingerprint("ÀB Ab") == plain_fingerprint("ÀB Ab") != S.fingerprint("àb ab")


@pytest.mark.parametrize(("distance", "segments", "part"), [(2, 2, 4096), (2, 2, 5), (1, 2, 4), (2, 4, 4096), (3, 2, 9), (5, 3, 4096), (0, 1, 2)])
def test_simhash_links_match_brute_force(spark, distance, segments, part):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(30)]
    flip = lambda f, n: f ^ sum(1 << b for b in rng.sample(range(64), n))
    fps = [*base, *(flip(b, n) for b in base for n in range(1, 7)), *(flip(base[0], rng.randrange(1, 5)) for _ in range(60)), 0, 2**64 - 1, 1]
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps + fps[:3])]
    df = spark.createDataFrame(signed, "doc_id long, fp long")
    links = {(r.a, r.b) for r in S.near_links(df.select("fp").distinct(), distance, segments, part).collect()}
    apart = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert all(0 < apart(a, b) <= distance for a, b in links)
    label = {f: f for _, f in signed}
    changed = True
    while changed:
        changed = False
        for a in label:
            least = min(label[b] for b in label if apart(a, b) <= distance)
            changed, label[a] = changed or least < label[a], min(least, label[a])
    found = {f: f for f in label}
    for _ in range(len(label)):
        for a, b in links:
            found[a] = found[b] = min(found[a], found[b])
    assert found == label
    if (distance, segments) == (2, 2):
        first = {}
        for i, f in signed:
            first[label[f]] = min(first.get(label[f], i), i)
        got = {r.fp: r.component_id for r in S.near_components(df).collect()}
        assert got == {f: first[label[f]] for f in label}


def test_simhash_tables_and_probes(spark):
    assert S.layout(2, 2) == [(0, 32, 1), (32, 32, 0)] and S.layout(4, 2) == [(0, 16, 0), (16, 16, 0), (32, 16, 0)]
    assert len(S.ball(32, 1)) == 33 and len(S.ball(10, 2)) == 56
    df = spark.createDataFrame([(5,), (-1,)], "fp long")
    assert S.entries(df, S.layout(2, 2)).count() == 4 and S.probes(df, S.layout(2, 2)).count() == 2 * 34
    far = S.place_links(np.array([0], np.uint64), np.array([0, 1, 7], np.uint64), 2)
    assert far == [(0, 1)]  # the third shares the place and is too far away
    with pytest.raises(ValueError, match="distance"):
        S.near_links(df, 70)


def test_simhash_dedup(spark, rows):
    out = S.simhash_dedup(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: (r.fp, r.component_id) for r in out}
    assert by[300] == by[301] == by[302] == (0, min(i for i, t, _ in rows if i is not None and not words(t)))
    kept = S.keep_one(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "source", "size"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in out if r.doc_id == r.component_id)
    assert S.keep_one(docs(spark, rows).where("false")).count() == 0
    clash = docs(spark, rows)
    for name in ("fp", "_text", "component_id", "node", "first_id", "_kept"):
        clash = clash.withColumn(name, F.lit(1))
    assert sorted(r.doc_id for r in S.keep_one(clash).collect()) == sorted(r.doc_id for r in kept.collect())
    assert S.simhash_dedup(clash).count() == len(rows)


@pytest.mark.parametrize("bucket", [4096, 3])
def test_mix(spark, rows, monkeypatch, bucket):
    monkeypatch.setattr(M, "BUCKET_ROWS", bucket)
    df = docs(spark, rows)
    out = M.mix(df).collect()
    again = M.mix(df.repartition(5)).collect()
    key = lambda rs: sorted(str(tuple(r)) for r in rs)
    assert key(out) == key(again) and len(out) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, caps, target, free = sum(sizes.values()), {s: 3 * n for s, n in sizes.items()}, {}, set(sizes)
    rest = total
    while True:  # the sharing as stated, round after round
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > caps[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = caps[s]
            rest -= caps[s]
        free -= over
    source = {(i, len(words(t))): s for i, t, s in rows}
    got, most = Counter(), {}
    for r in out:
        s = source[r.doc_id, r.size]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
        got[s] += r.taken
        most[s] = max(most.get(s, 0), r.size)
    assert all(abs(got[s] - target[s]) <= max(most[s], 1) for s in sizes)
    copies = Counter(r.doc_id for r in M.mixed_documents(df).collect())
    assert copies == Counter({i: n for i, n in ((i, sum(r.copies for r in out if r.doc_id == i and r.taken)) for i in {r.doc_id for r in out}) if n})


@pytest.mark.parametrize(("bucket", "quality"), [(4096, None), (2, None), (5, 0.05), (2, 1e-7)])
def test_mix_takes_as_many_copies_as_fit(spark, monkeypatch, bucket, quality):
    monkeypatch.setattr(M, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(M, "RUN", 7)
    rng = random.Random(3)
    made = [(i, "w " * rng.randrange(1, 40), "a") for i in range(300)]
    made += [(500, "copy " * 10, "a")] * 31 + [(600 + i, "big " * 50, "b") for i in range(80)] + [(700, "x " * 30, "b")] * 90 + [(800, "v " * 9, "c")] * 40
    df = spark.createDataFrame(made, "doc_id long, text string, source string").withColumn("row_key", F.lit(1)).withColumn("_s", F.lit(2)).withColumn("n", F.lit(3))
    out = M.mix(df, quality=None if quality is None else F.lit(quality)).collect()
    assert len(out) == len(made)
    source, got, target = {i: s for i, _, s in made}, Counter(), {}
    for r in out:
        got[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(got[s] - target[s]) <= 25 for s in target), (got, target)
    copies = [r.copies for r in out if r.doc_id == 700]
    assert max(copies) - min(copies) <= 1 and sum(copies) == sum(r.taken for r in out if r.doc_id == 700) // 30
    mixed = M.mixed_documents(df)
    if quality is None:
        assert mixed.columns == df.columns
        assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i in source if (n := sum(r.copies for r in out if r.doc_id == i))})


def test_mix_weighs_letters_of_any_script(spark):
    df = spark.createDataFrame([("abc",), ("абв",), ("日本",), ("a1",), (" ",), (None,)], "t string")
    assert [r[0] for r in df.select(M.letter_share(F.col("t"))).collect()] == [1.0, 1.0, 1.0, 0.5, None, None]


def test_mix_empty_and_silent(spark, rows):
    assert M.mix(docs(spark, rows).where("false")).count() == 0
    assert [(r.taken, r.target) for r in M.mix(docs(spark, [(1, None, None), (2, "", "a")])).collect()] == [(0, 0.0), (0, 0.0)]


def plain_rules(text):
    t = text or ""
    w = words(t)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside)


def test_quality_counts(spark, rows):
    rng = random.Random(4)
    more = [(500 + i, "\n".join(" ".join(rng.choice("ab") for _ in range(rng.randrange(12))) for _ in range(8)), "en") for i in range(40)]
    more += [(600, "# a|b <c> ✓ é\n\n# a|b <c> ✓ é\n" * 3, None), (601, "w " * 50, "fr"), (602, None, "en"), (603, "\n \n", "xx")]
    df = spark.createDataFrame([(i, t, s, "z") for i, t, s in [*rows, *more]], "doc_id long, text string, lang string, kept string")
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in Q.quality_rules(df).collect() if r.doc_id)
    want = sorted((i, *(c := plain_rules(t)), c[0] < 20 or 100 * c[4] > 30 * c[0]) for i, t, _ in [*rows, *more] if i)
    assert got == want
    assert Q.quality_rules(df.where("false")).count() == 0


def test_divergence_separates_junk(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    verdicts = Q.quality_rules(df).select("doc_id", "kept", "base_failed").join(df.select("doc_id", "quality"), "doc_id").collect()
    good = [r.kept for r in verdicts if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in verdicts if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.25 * len(bad)


def test_js_distance(spark):
    row = spark.sql("select array(1L, 1L) a, array(2L, 2L) b, array(4L, 0L) c, array(0L, 4L) d, array(0L, 0L) z")
    got = row.select(*(Q.js_distance(F.col(x), F.col(y)).alias(x + y) for x, y in ("ab", "cd", "az"))).first()
    assert got.ab == 0 and got.cd == pytest.approx(1.0) and got.az == 0
