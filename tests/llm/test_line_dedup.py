import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import line_dedup as L
from sparkloom.llm import substring_dedup as S
from sparkloom.llm.text_units import without


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance_matches_the_plain_table():
    rng = random.Random(5)
    for _ in range(400):
        a = "".join(rng.choice("abé ") for _ in range(rng.randrange(12)))
        b = "".join(rng.choice("abé ") for _ in range(rng.randrange(12)))
        true = levenshtein(a, b)
        assert L.edit_distance(a, b, 99) == true
        for most in range(6):
            assert L.edit_distance(a, b, most) == min(true, most + 1)


def test_similarity_limit_is_inclusive():
    assert L.similar("abcde", "abcdx")
    assert not L.similar("abcd", "abcx")


def brute(rows):
    """All line pairs compared by edit similarity alone; first occurrence of each connected group."""
    seen, found = set(), []
    for doc, text in rows:
        if (doc, text) in seen or text is None:
            continue
        seen.add((doc, text))
        start = 0
        for line in text.split("\n"):
            if w := L.normalise(line):
                found.append(((doc is None, doc or 0, start), doc, start, b" ".join(w).decode(), len(w)))
            start += len(line) + 1
    parent = list(range(len(found)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(found):
        for j in range(i):
            y = found[j]
            if x[3] == y[3] or (min(x[4], y[4]) >= L.MIN_WORDS and L.similar(x[3], y[3])):
                parent[root(i)] = root(j)
    groups = {}
    for i, x in enumerate(found):
        groups.setdefault(root(i), []).append(x)
    return {(x[1], x[2]) for g in groups.values() for x in g if x[0] != min(y[0] for y in g)}


def rows_for_test():
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randrange(3, 9))) for _ in range(300)]
    long = " ".join(rng.choice(vocab) for _ in range(150))
    near = long.replace(long.split()[70], "changed", 1)
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 9))) for _ in range(30)]
    rows = [(i, "\n".join(rng.choice(base) for _ in range(rng.randrange(6)))) for i in range(25)]
    rows += [(100, long), (101, f"x\n{near}\n"), (102, f"{long}.\n\nOn page 12 now\n"), (103, "on PAGE 99 now!"), (104, None), (105, ""), (None, "on page 1 now")]
    rows += [(106, "one and only line"), (106, "one and only line"), (107, "\n\n \n"), (108, "one and only line\none and only line")]
    return rows


def test_line_dedup_matches_brute_force(spark):
    rows = rows_for_test()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, removed_by string")
    out = L.line_dedup(df)
    got = out.collect()
    assert out.columns == ["doc_id", "text", "removed_by", "removed"]
    assert len(got) == len(rows)
    cut = {(r.doc_id, s.start) for r in got for s in r.removed or []}
    assert cut == brute(rows)
    texts = {(r.doc_id): r.text for r in got}
    assert texts[104] is None and texts[103] == "" and texts[108] == "" and texts[102] == "\nOn page 12 now\n"
    assert [r.text for r in got if r.doc_id == 106] == ["one and only line"] * 2


def test_substring_dedup(spark):
    p = "a b c d e f g h i j k"
    rows = [(2, f"{p}\nshort\n{p.upper()}"), (1, f"x\n  {p}  \ny"), (3, f"{p}"), (3, f"{p}"), (4, None), (5, ""), (None, p + " l\n" + p)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text, [(s.start, s.end) for s in r.removed or []]) for r in S.substring_dedup(df).collect()), key=str)
    want = [
        (1, f"x\n  {p}  \ny", []), (2, "short", [(0, 21), (28, 49)]), (3, "", [(0, 21)]), (3, "", [(0, 21)]), (4, None, []), (5, "", []),
        (None, p + " l", [(24, 45)]),
    ]
    assert got == sorted(want, key=str)
    assert S.substring_dedup(df.where("false")).count() == 0
    with pytest.raises(ValueError, match="unknown unit"):
        S.substring_dedup(df, unit="page")


def test_paragraph_units(spark):
    p = "a b c\nd e f g h i j k"
    df = spark.createDataFrame([(1, f"{p}\n\nq"), (2, f"z\n \n{p}")], "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.removed or []] for r in S.substring_dedup(df, unit="paragraph").collect()}
    assert got == {1: [], 2: [(4, 25)]}


def test_without():
    assert without("ab\ncd\nef", [(3, 5)]) == "ab\nef"
    assert without("ab\ncd", [(3, 5)]) == "ab"
    assert without("ab", [(0, 2)]) == ""


def test_empty_table(spark):
    assert L.line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def edited_lines():
    """Lines of 4 to 120 words, and each again with up to a tenth of its words changed, one at least."""
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    pairs = []
    for n in [4, 5, 7, 8, 9, 10, 12, 15, 20, 25, 30, 50, 80, 120] * 4:
        words = [rng.choice(vocab) for _ in range(n)]
        other = list(words)
        for k in rng.sample(range(n), max(1, n // 10)):
            other[k] = rng.choice(vocab)
        pairs.append((" ".join(words), " ".join(other)))
    return pairs


def test_links_are_what_edit_similarity_alone_finds(spark):
    pairs = edited_lines()
    rows = [(i + 1000 * k, p[k]) for i, p in enumerate(pairs) for k in (0, 1)]
    similar = {(i, j) for i, (_, a) in enumerate(rows) for j, (_, b) in enumerate(rows[:i]) if L.similar(a, b)}
    want = {rows[i][0] for i, _ in similar}
    assert len(want) > 40 and all(rows[i][0] - rows[j][0] == 1000 for i, j in similar)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in L.line_dedup(df).collect() if r.removed}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_recall_on_documents_against_all_pairs(spark):
    """Lines of the documents with each other, by edit similarity alone; no fingerprint, no key."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    lines = sorted({b" ".join(w).decode() for r in docs.collect() for t in (r.text or "").split("\n") if len(w := L.normalise(t)) >= L.MIN_WORDS})
    some = [x for x in lines if 20 <= len(x) <= 220 and zlib.crc32(x.encode()) % 4 == 0]
    counts = np.zeros((len(lines), 32), np.int32)
    for i, x in enumerate(lines):
        counts[i] = np.bincount(np.frombuffer(x.encode(), np.uint8) % 32, minlength=32)
    place, length, pairs = {x: i for i, x in enumerate(lines)}, np.array([len(x) for x in lines]), []
    for x in some:
        i = place[x]
        apart = counts - counts[i]  # an edit changes two bytes at most by one place each, of two-byte characters two
        least = np.maximum(np.where(apart > 0, apart, 0).sum(1), np.where(apart < 0, -apart, 0).sum(1))
        for j in np.flatnonzero(least <= 0.4 * np.maximum(length, length[i])).tolist():
            if i != j and L.similar(x, lines[j]):
                pairs.append((i, j))
    assert len(pairs) >= 40
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    later = {(r.doc, r.first_doc) for r in L.repeated_lines(df).select("doc", "first_doc").collect()}
    group = {i: i for i in range(len(lines))} | dict(later)
    found = sum(group[i] == group[j] for i, j in pairs)
    assert found >= 0.9 * len(pairs), (found, len(pairs))


def test_distances_at_once_match_the_plain_distance():
    rng = random.Random(8)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("abé 𝄞") for _ in range(rng.randrange(1, 70)))
        b = list(a)
        for _ in range(rng.randrange(12)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = [rng.choice("abé ")] * rng.randrange(2)
        pairs.append((a, "".join(b) or "a"))
    most = np.array([rng.randrange(15) for _ in pairs])
    true = [L.edit_distance(a, b, 99) for a, b in pairs]
    assert L.all_within(pairs, most).tolist() == [d <= m for d, m in zip(true, most.tolist())]
    shown = [L.aligned(a, b, m) for (a, b), m in zip(pairs, most.tolist())]
    assert any(shown) and all(d <= m for d, m, x in zip(true, most.tolist(), shown) if x)


def test_changed_words_need_no_distance_of_whole_lines(monkeypatch):
    plain = L.edit_distance

    def short(a, b, most):
        assert max(len(a), len(b)) < 40
        return plain(a, b, most)

    monkeypatch.setattr(L, "edit_distance", short)
    pairs = [p for p in edited_lines() if len(p[0].split()) >= 20]
    assert len(pairs) > 20 and all(L.similar(*p) for p in pairs)


def test_far_fingerprints_with_a_smaller_key_in_common_are_linked():
    norms, fps, keys = ["one two three four", "one two three four"], np.array([0, (1 << 40) - 1]), [{2, 101}, {2, 101}]
    found = [L.key_links(k, fps, [b"a", b"b"], norms, keys, 0.8) for k in (2, 101)]
    assert [len(x) for x in found] == [0, 1]


def test_frequent_lines_and_keys_go_out_as_rows(spark, monkeypatch):
    monkeypatch.setattr(L, "_PART", 3)
    monkeypatch.setattr(L, "_ROOM", 10)
    rows = rows_for_test()
    near = rows[25][1].split()
    rows += [(200 + i, " ".join(near[:i] + ["other"] + near[i + 1 :])) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    later = {(r.doc, r.start) for r in L.repeated_lines(df).collect()}
    assert later == brute(rows)


def test_fingerprints_match_plain_sums():
    rng = random.Random(1)
    runs = [[(rng.getrandbits(64), rng.randrange(1, 41)) for _ in range(n)] for n in (3, 1, 700, 255, 256, 40)]
    flat = sum(runs, [])
    got = L.fingerprints(np.array([h for h, _ in flat], np.uint64), np.array([w for _, w in flat], np.int32), np.array([len(r) for r in runs]))
    assert [int(x) for x in got] == [sum(1 << b for b in range(64) if 2 * sum(w for h, w in r if h >> b & 1) > sum(w for _, w in r)) for r in runs]


def test_suspects_are_lines_with_a_partner(spark, monkeypatch):
    monkeypatch.setattr(L, "_PART", 3)
    rng = random.Random(6)
    base = [rng.getrandbits(60) for _ in range(6)]
    fps = [b ^ sum(1 << k for k in rng.sample(range(60), rng.randrange(24))) for b in base for _ in range(8)]
    rows = [(i, fp, sorted({2 * rng.randrange(8), 2 * rng.randrange(8), 101 if i % 9 == 0 else 2})) for i, fp in enumerate(fps)]
    got = {(r.key, r.id) for r in L.suspects(spark.createDataFrame(rows, "id long, fp long, keys array<long>")).collect()}
    near = lambda k, a, b: k % 2 or (a ^ b).bit_count() <= L.WIDE
    assert got == {(k, i) for i, a, ks in rows for k in ks if any(j != i and k in other and near(k, a, b) for j, b, other in rows)}


def test_query_links_lines_beyond_three_bits(spark, tmp_path):
    from sparkloom.llm.queries import QUERIES

    a = "the quick brown fox jumps over the lazy dog near the old river bank"
    spark.createDataFrame([(1, a), (2, a.replace("lazy", "tame"))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.text for r in QUERIES["op7_line_dedup"](spark, str(tmp_path)).collect()} == {1: a, 2: ""}


def passage_rows():
    """Invented prose; some documents hold a passage of 55 words inside a line, most share a short notice."""
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randrange(2, 9))) for _ in range(2000)]

    def prose(n):
        out = []
        while n > 0:
            k = min(n, rng.randrange(3, 14))
            out.append(" ".join(rng.choice(vocab) for _ in range(k)).capitalize() + rng.choice(".,;!?"))
            n -= k
        return " ".join(out)

    passage, notice = prose(55), "Read the terms of use, then all of our notes on privacy before you go on."
    rows = []
    for i in range(60):
        lines = [prose(rng.randrange(5, 80)) for _ in range(rng.randrange(1, 5))]
        if i % 3:
            lines.insert(rng.randrange(len(lines) + 1), notice)
        if i % 7 == 3:
            k = rng.choice([k for k, x in enumerate(lines) if x != notice])
            lines[k] = f"{lines[k]} {passage.upper() if i % 2 else passage} {prose(9)}"
        rows.append((i, "\n".join(lines)))
    return rows, passage, notice


def test_passages_go_where_they_repeat_and_nothing_else_does(spark):
    rows, passage, notice = passage_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in S.substring_dedup(df, unit="passage").collect()}
    first = True
    for i, text in rows:
        if i % 7 == 3 and not first:
            (span,) = got[i].removed
            part = text[span.start : span.end].lower()  # a clause of one or two words before the passage joins its first clause
            assert passage.lower().endswith(part) and len(part.split()) >= S.MIN_WORDS
            assert part not in got[i].text.lower() and (notice in text) == (notice in got[i].text)
        else:
            assert got[i].text == text and got[i].removed is None
        first = first and i % 7 != 3


def brute_passages(rows, least=S.MIN_WORDS):
    """Spans by doc_id, from plain loops over all units in order."""
    seen, out = set(), {}
    for doc, text in rows:
        told = set()
        for mark, _, digest in sorted(S.units_of(text, "passage", least)):
            if digest in seen:
                told.add(mark)
            seen.add(digest)
        lines = [(s, e) for s, e in S.spans_of(text, "line") if 2 * s + 1 in told]
        runs, run = [], []
        for start, end, n, _ in S.clauses(text):
            if 2 * start in told:
                run.append((start, end, n))
            else:
                runs.append(run)
                run = []
        lines += [(r[0][0], r[-1][1]) for r in [*runs, run] if sum(x[2] for x in r) >= least]
        covered = sorted({k for s, e in lines for k in range(s, e)})
        out[doc] = [k for k in covered]
    return out


def test_passages_match_brute_force_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: sorted({k for s in r.removed or [] for k in range(s.start, s.end)}) for r in S.substring_dedup(docs, unit="passage").collect()}
    assert got == brute_passages(rows) and any(got.values())


def test_clauses_cover_each_line():
    text = "One two. Three four five; six\n\n a, b, c, d\nend"
    found = [text[s:e] for s, e, _, _ in S.clauses(text)]
    assert found == ["One two. Three four five;", "six", " a, b, c,", "d", "end"]
    assert [n for _, _, n, _ in S.clauses(text)] == [5, 1, 3, 1, 1]
    assert list(S.clauses(None)) == [] and list(S.clauses("")) == [] and list(S.clauses("!! ... \n")) == []


CLASHES = ["doc", "text_key", "removed", "marks", "_text", "_maybe", "line", "start", "digest", "_0", "key"]


@pytest.mark.parametrize("operator", [lambda d: S.substring_dedup(d, unit="passage"), S.substring_dedup, L.line_dedup])
def test_clashing_columns_nulls_and_long_texts(spark, operator):
    long = " ".join(f"w{k % 977}" for k in range(60_000)) + "."
    rows = [(1, long), (2, long), (2, long), (None, long), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit("x").alias(c) for c in CLASHES))
    out = operator(df)
    assert out.columns == ["doc_id", "text", *(c for c in CLASHES if c != "removed"), "removed"]
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows) and got[1].text == long and got[2].text == "" and got[None].text == ""
    assert got[3].text is None and got[4].text == "" and got[2].doc == "x" and got[1].marks == "x"
    assert operator(df.where("false")).count() == 0


def test_query_counts_removed_passages(spark, tmp_path):
    from sparkloom.llm.queries import QUERIES

    rows, _, _ = passage_rows()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_removed for r in QUERIES["op4_substring_dedup"](spark, str(tmp_path)).collect()}
    assert {i for i, n in got.items() if n} == {i for i in range(60) if i % 7 == 3 and i != 3} and len(got) == 60
