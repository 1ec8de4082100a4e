"""Each operator against a brute-force version, over nulls, empty and long texts, ties, repeated rows, empty tables and other columns."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seriesloom.llm import annsearch, decontaminate, htmltext, langid, linededup, mixing, quality, simhash, suffixdedup, tokencount

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, w string, slot int, p double"
WORDS = "the of and river stone light under over ñandú été house green seven years ago Anna went 42 up".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows():
    rng = random.Random(1)
    long = prose(rng, 3000)
    texts = [None, "", " ", "one", "One two", "one two three four", long, long, long[: len(long) // 2] + " changed " + long[len(long) // 2 :], prose(rng, 60)]
    shared = prose(rng, 40)
    texts += [f"{prose(rng, 20)}\n{shared}\n{prose(rng, 15)}" for _ in range(6)] + ["aaaa" * 40, "aaaa" * 60, "x\n" * 50, "!!! ... 123"]
    out = [(i * 7 % 23, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"src{i % 3}", None, "clash", i, 0.5) for i, t in enumerate(texts)]
    return [*out, out[9], (out[9][0], "same id, other text", "en", "src1", 1, "", 0, 0.0), (None, shared, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark, docs):
    shared = rows()[10][1].split("\n")[1].split()
    return spark.createDataFrame([(1, " ".join(shared[5:25])), (2, "river stone"), (3, None), (4, ""), (None, "one two three four"), (10, " ".join(shared[5:25])), (5, "never ever seen before in any of all these many texts")], "item_id long, text string")


def words(t):
    return [] if t is None else re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in t))


def test_mixing_targets_and_limits(docs, empty):
    got = mixing.mix_table(docs).collect()
    assert len(got) == len(rows())
    total = sum(r["size"] for r in got)
    by = {r["source"]: r["target"] for r in got}
    assert sum(by.values()) == pytest.approx(total)
    for r in got:
        assert r["taken"] <= 3 * r["size"] and by[r["source"]] <= 3 * r["source_size"] + 1e-9
    assert sorted(map(tuple, mixing.mix_table(docs.repartition(7)).select("doc_id", "size", "taken").fillna(-1).collect())) == sorted(map(tuple, [(r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["taken"]) for r in got]))
    assert mixing.mix_table(empty).count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "copies"]
    assert sum(r["copies"] * len(r["text"].split()) for r in mixed.collect()) == sum(r["taken"] for r in got)
    assert mixing.mix(empty).count() == 0


def test_mixing_water_level(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 500)], "source string, source_size long")
    got = {r[0]: r[2] for r in mixing.targets(sizes, (5, 2, 1), 3).collect()}
    assert got["a"] == 30 and got["b"] == pytest.approx((1510 - 30) * 2 / 3) and got[None] == pytest.approx((1510 - 30) / 3)


def test_decontamination_against_brute_force(docs, items, empty):
    windows = {}
    for item, t in [(r["item_id"], r["text"]) for r in items.collect()]:
        w = words(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    want = []
    for r in rows():
        w, hit, found = words(r[1]), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        want.append((-1 if r[0] is None else r[0], len(w), len(hit), sorted(str(x) for x in found if x is not None), bool(hit)))
    got = [(-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontaminate.contamination(docs, items).collect()]
    assert sorted(got) == sorted(want) and any(x[4] for x in want)
    assert decontaminate.clean(docs, items).count() == sum(not x[4] for x in want)
    assert decontaminate.contamination(docs, items.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.contamination(empty, items).count() == 0


def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_simhash_against_brute_force(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    prints = [(r[0], brute_fingerprint(r[1])) for r in rows()]
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["fp"] % 2**64) for r in got) == sorted(((d is None, d or 0), f) for d, f in prints)
    group = list(range(len(prints)))
    for _ in prints:
        for i, (_, a) in enumerate(prints):
            for j, (_, b) in enumerate(prints):
                if (a ^ b).bit_count() <= 4:
                    group[i] = group[j] = min(group[i], group[j])
    want = sorted((f, min((d for (d, _), h in zip(prints, group, strict=True) if h == g and d is not None), default=-1)) for (_, f), g in zip(prints, group, strict=True))
    assert sorted((r["fp"] % 2**64, -1 if r["component_id"] is None else r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.one_of_each(docs).columns == docs.columns


def test_stars_find_every_link_in_split_leaves():
    rng = np.random.default_rng(3)
    centers = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (3, 2, 1500)).astype(np.uint64)
    points = np.unique(np.concatenate([centers, *(centers ^ f[0] ^ f[1] for f in flips), centers[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))]))
    parent = {int(p): int(p) for p in points}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k in range(3):
        tree = simhash.build(points[::3], k, 50)
        for _, stored, guests in simhash.route(tree, points, points[:0], str(k)):
            for us, vs in simhash.stars(stored, guests, k):
                for u, v in zip(us.tolist(), vs.tolist(), strict=True):
                    a, b = find(u), find(v)
                    parent[max(a, b)] = min(a, b)
    for i, x in enumerate(points):
        for y in points[i + 1 :][np.bitwise_count(points[i + 1 :] ^ x) <= 4].tolist():
            assert find(int(x)) == find(y)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(101, 100)], "u long, v long")
    got = {r[0]: r[1] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


def brute_cut(table, size=50):
    first, out = {}, {}
    data = [(d, (t or "").encode()) for d, t in table]
    for d, b in data:
        if d is not None:
            for i in range(len(b) - size + 1):
                first[b[i : i + size]] = min(first.get(b[i : i + size], d), d)
    for n, (d, b) in enumerate(data):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if d is not None and first[b[i : i + size]] < d:
                gone[i : i + size] = True
        out[n] = (d, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return sorted(map(str, out.values()))


def test_suffix_dedup_against_brute_force(docs, empty, monkeypatch):
    want = brute_cut([(r[0], r[1]) for r in rows()])
    assert sorted(str(tuple(r)) for r in suffixdedup.removals(docs).collect()) == want
    assert suffixdedup.removals(empty).count() == 0
    kept = suffixdedup.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows())


def test_suffix_dedup_small_alphabet_and_blocks(spark, monkeypatch):
    rng = random.Random(5)
    base = ["".join(rng.choice("ab") for _ in range(300)) for _ in range(4)]
    texts = [(i, "".join(rng.choice([b[:160], b[100:230], "b" * 70, "ab" * 33, rng.choice("ab")]) for b in base)) for i in range(25)]
    monkeypatch.setattr(suffixdedup, "BLOCK", 128)
    got = suffixdedup.removals(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_cut(texts)


def test_difference_cover():
    assert {(a - b) % suffixdedup.COVER for a in suffixdedup.MEMBERS for b in suffixdedup.MEMBERS} == set(range(suffixdedup.COVER))


def test_line_dedup_against_brute_force(docs, empty):
    table = sorted({(r[0] is None, r[0] or 0, r[1] or "", r[0], r[1]) for r in rows()}, key=lambda x: x[:2])
    got = {(r["doc_id"], r["text_hash"]): r for r in linededup.repeated_lines(docs).collect()}
    assert linededup.repeated_lines(docs).count() == len(rows())
    removed = sum(len(r["removed"]) for r in got.values())
    lines = [" ".join(x.encode().lower().decode(errors="ignore").split()) for _, _, t, _, _ in table for x in t.split("\n") if len(x.encode().split()) >= 5]
    assert removed == len(lines) - len(set(lines)) > 0
    kept = linededup.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows())
    again = linededup.repeated_lines(kept.distinct())
    assert again.filter(F.size("removed") > 0).count() == 0
    assert linededup.repeated_lines(empty).count() == 0


def brute_passages(table, least):
    """Units, repeated and removed units and spans of each different (id, text), written apart from the operator."""
    ends, docs, seen, out = set("\n.!?。！？"), sorted({(d is None, d or 0, t or "") for d, t in table}), set(), {}
    for no_id, d, text in docs:
        units, start = [], 0
        for i, c in enumerate(text):
            if i + 1 == len(text) or c in ends and text[i + 1] not in ends:
                norm = " ".join("".join(x.lower() if x.isascii() else x for x in w) for w in re.findall(r"[^\x20\x09-\x0D]+", text[start : i + 1]))
                if norm:
                    units.append((start, i + 1, norm))
                start = i + 1
        later = []
        for _, _, norm in units:
            later.append(norm in seen)
            seen.add(norm)
        spans, gone, k = [], 0, 0
        while k < len(units):
            j = k
            while j < len(units) and later[j]:
                j += 1
            if sum(len(u[2].encode()) for u in units[k:j]) >= least and j > k:
                spans.append((units[k][0], units[j - 1][1]))
                gone += j - k
            k = max(j, k + 1)
        out[no_id, d, text] = (len(units), sum(later), gone, spans)
    return out


PASSAGE = "One sentence of the passage stands here. Then comes another, of more words! Is a third one asked for? It ends"


def passages(rng):
    """Documents with a passage inside longer lines, as lines, broken over lines, in other case and spacing, and in a script without spaces."""
    chinese = "这是一个没有空格的句子，用来检验重复的段落是否会被找到。第二句话也很长，足以让整个段落超过一百个字节。"
    texts = [f"{prose(rng, 9)} {PASSAGE} {prose(rng, 5)}", f"{prose(rng, 4)}. {PASSAGE}, {prose(rng, 7)}\n\nHome\nHome", PASSAGE.replace(" ", "  ").upper() + "\nHome.", PASSAGE.replace(". ", ".\n").replace("? ", "?\n"), f"前{chinese}", f"{chinese}后", "a. b. c. " * 30, "...", None, "", " \n ", "Home"]
    return [(i * 5 % 13, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("least", [1, 60, 100])
def test_passages_against_brute_force(spark, docs, least):
    for table in ([(r[0], r[1]) for r in rows()], passages(random.Random(3))):
        want = brute_passages(table, least)
        df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
        hashes = {r["h"]: r["text"] or "" for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
        got = linededup.repeated_passages(df, min_bytes=least).collect()
        assert len(got) == len(table) and any(r["removed"] for r in got)
        for r in got:
            key = (r["doc_id"] is None, r["doc_id"] or 0, hashes[r["text_hash"]])
            assert (r["n_units"], r["n_repeated"], r["n_removed"], [tuple(x) for x in r["removed"]]) == want[key]
        for r in linededup.without_passages(df.withColumn("key", F.xxhash64("text")), min_bytes=least).collect():
            text, cut = hashes[r["key"]], []
            for a, z in want[r["doc_id"] is None, r["doc_id"] or 0, text][3]:
                cut += range(a, z)
            assert (r["text"] or "") == "".join(c for i, c in enumerate(text) if i not in set(cut))


def test_hot_units_are_not_shuffled(spark, monkeypatch):
    from seriesloom.llm import common

    table = [(i, f"{PASSAGE}. Number {i} has a sentence of its own, {i * i}.") for i in range(1500)] + [(2000, None)]
    df = spark.createDataFrame(table, "doc_id long, text string")
    monkeypatch.setattr(common, "HOT_SHARE", 0.2)
    want = brute_passages(table, 100)
    got = linededup.repeated_passages(df).collect()
    assert sorted((r["doc_id"], [tuple(x) for x in r["removed"]]) for r in got) == sorted((d, v[3]) for (_, d, _), v in want.items())
    assert linededup.repeated_passages(df.limit(0)).count() == 0


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 8)).round(1)
    x[100:300] = x[100]
    table = [(i, v.tolist()) for i, v in enumerate(x)] + [(600, None), (601, [0.0] * 8), (602, [1.0] * 7 + [None]), (603, [1.0] * 7 + [float("nan")]), (604, [1.0]), (None, [1.0] * 8), (700, x[5].tolist()), (700, x[5].tolist())]
    df = spark.createDataFrame(table, "id long, v array<double>")
    use = annsearch.usable(df, "id", "v")
    got = annsearch.search(use, use.filter("vec_id % 100 = 0")).collect()
    ids, hits = np.concatenate([np.arange(600), [700]]), 0
    every = np.concatenate([x, x[5:6]])
    for q in range(0, 701, 100):
        if q == 600:
            continue
        d = np.sqrt(((every - (x[5] if q == 700 else x[q])) ** 2).sum(1))
        d[ids == q] = np.inf
        want = ids[np.lexsort((ids, d))[:10]].tolist()
        mine = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        assert len(mine) == 10
        hits += len(set(mine) & set(want))
    assert hits >= 0.9 * 70
    assert annsearch.search(use.limit(0), use.limit(0)).count() == 0
    few = use.filter("vec_id < 3")
    assert annsearch.search(few, few).count() == 6


def test_search_is_exact_whatever_its_first_pass_reaches(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 32))
    x[:900] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vec array<double>")
    got = {}
    for r in annsearch.search(df, df.filter("vec_id % 300 = 0"), reach=1).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for q in range(0, 6000, 300):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        assert got[q] == np.lexsort((np.arange(6000), d))[:10].tolist()


def test_cells_left_out_hold_nothing_near():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(200, 6)) * 0.1 + c for c in rng.normal(size=(5, 6)) * 5])
    books = [annsearch.k_means(p, 6) for p in (x[:, :3], x[:, 3:])]
    a, c = annsearch.nearest(x[:, :3], books[0]), annsearch.nearest(x[:, 3:], books[1])
    off = [np.sqrt(((p - b[i]) ** 2).sum(1)) for p, b, i in zip((x[:, :3], x[:, 3:]), books, (a, c), strict=True)]
    cells, inverse = np.unique(a * 6 + c, return_inverse=True)
    rings = np.array([[f(d[inverse == i]) for d in off for f in (np.min, np.max)] for i in range(len(cells))])
    for q in x[::50]:
        low, d = annsearch.least_squared(q, books, (cells // 6, cells % 6), rings), ((x - q) ** 2).sum(1)
        assert (low[inverse] <= d + 1e-9).all() and low.max() > 1


def test_traverse_is_in_order():
    rng = np.random.default_rng(1)
    left, right, sizes = rng.random(9), rng.random(7), rng.integers(0, 3, (9, 7))
    got = annsearch.traverse(left, right, sizes, 10**9)
    sums = [left[c // 7] + right[c % 7] for c in got]
    assert sums == sorted(sums) and len(got) == (sizes > 0).sum()


def test_language_id_held_out(spark, empty):
    rng = random.Random(2)
    table = [(i, " ".join("".join(rng.choice("abcdefg" if i % 2 else "tuvwxyz") for _ in range(5)) for _ in range(rng.randint(3, 200))), ["lo", "hi"][i % 2]) for i in range(300)]
    table += [(1000, None, "lo"), (1001, "", "lo"), (1002, "123 !!", None), (1003, "abc " * 5000, None)]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.language_id(df).collect()}
    assert len(got) == len(table)
    held = [r for r in got.values() if r["held_out"] and r["doc_id"] < 300]
    assert np.mean([r["lang_pred"] == ["lo", "hi"][r["doc_id"] % 2] for r in held]) > 0.95
    assert all(got[i]["lang_pred"] == "und" for i in (1000, 1001, 1002)) and got[1003]["lang_pred"] == "hi"
    assert langid.language_id(empty).count() == 0
    assert langid.identified_only(df).columns == df.columns


def test_lookup_tables_equal_the_network():
    net = langid.Network(["a", "b"])
    x, _ = langid.windows(prose(random.Random(0), 200))
    sums = [sum(c[k][x[:, k : k + langid.WINDOW - w + 1]] for k in range(w)).max(1) for c, w in zip(net.conv, langid.WIDTHS, strict=True)]
    want = langid.softmax(np.maximum(np.concatenate(sums, 1), 0) @ net.out + net.bias)
    assert np.allclose(net.predict(x, net.tables()), want, atol=1e-5)


def test_token_counts_equal_full_encoding(spark, docs, empty):
    count, rng = tokencount.Counter(tokencount.read_ranks()), random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice(["  ", "\n\n", " a", "word", "'s", " ñ", "12", "!?", " \t "]) for _ in range(rng.randint(0, 900)))
        tree = tokencount.Tree(list(count.leaves(text)))
        assert tree.total == len(count.encode(text))
        for _ in range(4):
            a = rng.randint(0, len(text) + 3)
            text, _ = tree.edit(count, text, a, a + rng.randint(0, 30), rng.choice(["", " ", "x", "  new words \n", "long " * 300]))
            assert tree.total == len(count.encode(text)) and (tree.ends[-1] if tree.ends else 0) == len(text)
            assert [tree.upto(i) for i in range(len(tree.ends))] == [sum(tree.counts()[:i]) for i in range(len(tree.ends))]
    edited = docs.withColumn("edits", tokencount.middle_edit(F.col("text")))
    got = tokencount.count_edited(edited, ranks=tokencount.read_ranks()).collect()
    assert len(got) == len(rows()) and all(r["n_tokens_after"] == len(count.encode(r["text_after"] or "")) for r in got)
    assert tokencount.count_edited(empty.withColumn("edits", F.lit(None)), ranks=tokencount.read_ranks()).count() == 0


def test_quality_shrinks_sites(spark, docs, empty):
    rng = random.Random(6)
    table = [(i, " ".join(rng.choice(["fine", "clear", "good"] if i % 3 else ["junk", "spam", "buy"]) for _ in range(30)), "en", "bad" if i % 3 == 0 else "ok") for i in range(200)] + [(500, None, None, None)]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(100)] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.scores(df, labels).collect()}
    assert len(got) == 201 and all(got[i]["keep"] == (i % 3 > 0) for i in range(200))
    assert got[0]["p_host"] < got[1]["p_host"]
    assert quality.scores(empty, labels).count() == 0
    assert quality.scores(docs, labels.limit(0)).count() == len(rows())


def test_html_layout(spark):
    page = "<!DOCTYPE html><title>T</title><body><h1>Head &amp; more</h1><p>One <b>two</b><p hidden>no<p style='display:none'>no<p>Three<br>four<ul><li>a<li>b<ol start=3><li>x</ol></ul><table><tr><th>Name<th>N<tr><td>Anna<td>42</table><script>var a='</p>'</script><pre>a\n  b</pre><!-- gone -->"
    want = "Head & more\n\nOne two\n\nThree\nfour\n\n- a\n- b\n  3. x\n\nName  N\nAnna  42\n\na\n  b"
    assert htmltext.text_of(page) == want
    assert htmltext.text_of("") == "" and htmltext.text_of(None) is None and htmltext.text_of("<div>" * 5000 + "deep") == "deep"
    assert htmltext.text_of("a < b <") == "a < b <"
    df = spark.createDataFrame([(1, page, "x"), (2, None, "y"), (3, "", None)], "page_id long, html string, text string")
    assert {r["page_id"]: r["text"] for r in htmltext.extract(df).collect()} == {1: want, 2: None, 3: ""}


def test_html_head_ends_by_itself():
    for start in ("<p>Hello", "<div>Hello</div>", "<h1>Hello", "<table><tr><td>Hello</table>", "Hello", "&nbsp;<b>Hello</b>"):
        assert htmltext.text_of(f"<html><head><title>T</title><meta charset=u><style>p{{}}</style>\n<!-- c -->{start}").strip() == "Hello"
    assert htmltext.text_of("<html><head><title>T</title>\n</head><body><head><p>a</head><p>b") == "a\n\nb"
    assert htmltext.text_of("<head><noscript><link></noscript><script>x</script></head>a") == "a"


def test_html_tables_lose_no_text():
    text = htmltext.text_of
    assert text("<table><tr><form><td>a<td>b</form></tr><tbody><form><tr><td>c</table>") == "a  b\nc"
    assert text("<table><tbody><td>a</td><td>b</td><tr><td>c</table>d") == "a  b\nc\n\nd"
    assert text("<table>x<tr>y<td>a</td>z<div>w<b>v</b></div><td>b</table>") == "xyz\nwv\n\na  b"
    assert text("<table><tr><div><td>a<td>b</div></table>") == "a  b"
    assert text("<table><caption>C</caption><colgroup><col>t<tr><td>a<table><tr><td>in</table></table>e") == "t\n\nC\na\nin\n\ne"
    assert text("<td>a</td><tr>b") == "ab" and text("<table><tr><td>a<table><td>b</table>c<td>d</table>") == "a  d\nb\nc"


def test_html_shows_what_browsers_show():
    text = htmltext.text_of
    assert text("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>tex</annotation></math> holds") == "so x=1 holds"
    assert text("a<svg><title>no</title><defs><text>no</text></defs><g><path/><text x=1>one</text><text>two</text></g></svg>b") == "a one two b"
    assert text("<p>pick <select><option>A<option>B</select></p><datalist><option>no</datalist>") == "pick\nA\nB"
    assert text("<textarea>\na &lt; b</textarea>") == "a < b" and text("<object data=x><p>instead</object>") == "instead"


def test_one_of_each_keeps_one_row_of_every_group(spark, docs, empty):
    rng = random.Random(9)
    a, b, c = (prose(rng, 80) for _ in range(3))
    table = [(1, a, "x"), (5, a, "y"), (5, b, "alone"), (None, c, "n1"), (None, c, "n2"), (7, None, "t"), (7, None, "t"), (7, None, "u")]
    got = simhash.one_of_each(spark.createDataFrame(table, "doc_id long, text string, w string").repartition(3)).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == sorted([(1, a), (5, b), (0, c), (7, "")])
    prints = [brute_fingerprint(r[1]) for r in rows()]
    group = list(range(len(prints)))
    for _ in prints:
        for i, x in enumerate(prints):
            for j, y in enumerate(prints):
                if (x ^ y).bit_count() <= 4:
                    group[i] = group[j] = min(group[i], group[j])
    least = {}
    for r, g in zip(rows(), group, strict=True):
        least[g] = min(least.get(g, (True, 0)), (r[0] is None, r[0] or 0))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in simhash.one_of_each(docs).collect()) == sorted(least.values())
    assert simhash.one_of_each(empty).count() == 0
