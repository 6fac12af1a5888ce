"""Training-data operators against brute force, round trips and edge cases."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import rows
from vecloom.llm import annforest, chunking, linkage, markup, mixing, neardup, packing, repetition

ITEM = "id string, content struct<type:string,data:string,format:map<string,string>>, vector array<float>, class string, tile int"


def items(spark, texts, kind="text"):
    return spark.createDataFrame([(i, (kind, t, None), None, "x", 1) for i, t in texts], ITEM)


# near-duplicates


def shingles(text, k):
    w = repetition.words(text or "")
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_pairs(texts, how):
    sets = [(i, shingles(t, how.shingle)) for i, t in texts if len(repetition.words(t or "")) >= max(how.least_words, how.shingle)]
    return sorted({(min(a, b), max(a, b)) for n, (a, x) in enumerate(sets) for b, y in sets[:n] if a != b and len(x & y) >= how.least * len(x | y) - 1e-9})


@pytest.mark.parametrize("how", [neardup.Similarity(3, 0.6, 20), neardup.Similarity()])
def test_near_duplicates_against_all_pairs(spark, how):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = []
    for g in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([8, 20, 40, 90, 300]))]
        for c in range(rng.choice([1, 2, 4])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 3, 8])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append((f"{g:02}-{c}", " ".join(copy)))
    texts += [("n", None), ("e", ""), ("s", "too short")]
    assert rows(neardup.near_duplicate_pairs(items(spark, texts), "id", "content.data", how)) == brute_pairs(texts, how)


def test_near_duplicate_groups_of_copies(spark):
    a = " ".join(f"a{i}" for i in range(40))
    b = a.replace("a39", "z")
    texts = [("p", a), ("q", a), ("r", b), ("s", " ".join(f"s{i}" for i in range(40))), ("p", a)]
    got = rows(neardup.near_duplicate_groups(items(spark, texts), "id", "content.data"))
    assert got == [("p", "p", 2, 1, "p"), ("q", "p", 2, 1, "p"), ("r", "r", 1, 1, "p"), ("s", "s", 1, 0, "s")]


def test_near_duplicates_of_nothing(spark):
    empty = items(spark, [("a", "b")]).limit(0)
    assert neardup.near_duplicate_pairs(empty, "id", "content.data").count() == 0
    assert neardup.near_duplicate_groups(empty, "id", "content.data").count() == 0
    assert neardup.near_duplicate_groups(items(spark, [("a", None)]), "id", "content.data").count() == 0


@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=200), st.sets(st.integers(0, 2**64 - 1), max_size=200))
@settings(max_examples=60, deadline=None)
def test_bitmaps_bound_the_overlap(a, b):
    x, y = (np.array(sorted(s), np.uint64) for s in (a, a | b))
    bound = neardup.overlap_bound(neardup.bitmap(x, neardup.band_bits(len(x))), len(x), neardup.bitmap(y, neardup.band_bits(len(y))), len(y))
    assert bound >= neardup.common(x, y) == len(set(x.tolist()) & set(y.tolist()))


@given(st.floats(0.05, 1.0), st.integers(1, 10**6))
@settings(max_examples=200, deadline=None)
def test_similar_sizes_are_in_neighbouring_bands(least, m):
    edges = neardup.size_bands(least)
    n = int(np.ceil(least * m - 1e-9))
    small, large = np.searchsorted(edges, [max(1, n), m], side="right")
    assert 0 <= large - small <= 1
    assert large == small or neardup.largest_similar(max(1, n), least) >= edges[small]


@given(st.lists(st.tuples(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=150), st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=150)), max_size=12))
@settings(max_examples=40, deadline=None)
def test_bounds_of_many_pairs(pairs):
    sets = [[np.array(sorted(s), np.uint64) for s in p] for p in pairs]
    maps = [[neardup.bitmap(x, neardup.band_bits(len(x))) for x in p] for p in sets]
    got = neardup.overlap_bounds([m[0].tobytes() for m in maps], np.array([len(p[0]) for p in sets], np.int64), [m[1].tobytes() for m in maps], np.array([len(p[1]) for p in sets], np.int64))
    assert got.tolist() == [neardup.overlap_bound(m[0], len(p[0]), m[1], len(p[1])) for m, p in zip(maps, sets, strict=True)]


# similar vectors

VECTOR = "id string, vector array<float>, class string, tree int"


def clustered(n=400, d=64, seed=3, groups=12):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, d))
    x = centres[rng.integers(0, groups, n)] + 0.6 * rng.standard_normal((n, d))
    x[1::7] = x[0::7][: len(x[1::7])] + 0.05 * rng.standard_normal((len(x[1::7]), d))
    return x.astype(np.float32)


def frame(spark, x):
    return spark.createDataFrame([(f"i{i:04}", [float(v) for v in row], "c", 0) for i, row in enumerate(x)], VECTOR)


def test_forest_finds_the_nearest(spark):
    x = clustered()
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    got = {}
    for r in annforest.most_similar(frame(spark, x), k=5, forest=annforest.Forest(sample=200)).collect():
        got.setdefault(r["id"], set()).add(r["neighbour"])
    exact = {f"i{i:04}": {f"i{j:04}" for j in np.argsort(-s[i])[:5]} for i in range(len(x))}
    assert sum(len(got[i] & n) for i, n in exact.items()) >= 0.9 * 5 * len(x)
    pairs = {(min(a, b), max(a, b)) for a, n in exact.items() for b in n if s[int(a[1:]), int(b[1:])] >= 0.93}
    assert set(rows(annforest.similar_pairs(frame(spark, x), forest=annforest.Forest(sample=200)))) == pairs


def test_ascent_meets_near_copies_without_exact_search():
    rng = np.random.default_rng(8)
    base = clustered(3000, groups=4).astype(np.float64)
    x = np.concatenate([base, base[:600] + 0.02 * rng.standard_normal((600, 64))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    fitted = annforest.fit(x[rng.choice(len(x), 500, replace=False)], len(x), 0.93, annforest.Forest(trees=(8,), most=1500), 4)
    assert fitted.levels[0] > 0 and (np.diff(fitted.levels) >= 0).all()
    strings, met, left = annforest.hash_strings(x, fitted.normals, fitted.middle), set(), set()
    for t in range(fitted.trees):
        order = np.argsort(strings[:, t], kind="stable")
        ascent = annforest.Ascent(strings[order, t], x[order].astype(np.float32), 6, 0.93, fitted.scores, fitted.levels, 1500)
        ascent.run(0)
        a, b, _ = ascent.found()
        met |= set(zip(order[a].tolist(), order[b].tolist(), strict=True))
        left |= set(order[ascent.left].tolist())
    s = x @ x.T
    np.fill_diagonal(s, -2)
    true = {(i, j) for i in range(len(x)) if i not in left for j in np.argsort(-s[i])[:6] if s[i, j] >= 0.93}
    assert len(left) < len(x) / 4 and len(true & met) >= 0.99 * len(true)


@pytest.mark.parametrize("seed", range(4))
def test_cells_and_pieces_cover_a_tree(seed):
    rng = np.random.default_rng(seed)
    strings = np.sort(np.concatenate([rng.integers(0, 1 << 62, 900), np.full(300, 5), rng.integers(0, 1 << 20, 500)]))
    cells = annforest.cut_cells(strings, 64)
    assert cells[0][0] == 0 and sum(c[2] for c in cells) == len(strings)
    assert all(a[0] + (1 << (62 - a[1])) == b[0] for a, b in zip(cells, cells[1:], strict=False))
    cut = list(linkage.pieces(strings, 64))
    assert cut[0][0] == 0 and cut[-1][1] == len(strings) and all(0 < b - a <= 64 for a, b in cut) and all(p[1] == q[0] for p, q in zip(cut, cut[1:], strict=False))
    assert list(linkage.pieces(strings[:0], 64)) == []


def with_partitions(spark, n, work):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        return work()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_partitions_change_no_vector_result(spark):
    df = frame(spark, clustered(900)).cache()
    small = annforest.Forest(trees=(4,), most=200, sample=300)
    near = [with_partitions(spark, n, lambda: rows(annforest.similar_pairs(df, least=0.8, forest=small))) for n in (4, 64)]
    assert near[0] and near[0] == near[1]
    found = [with_partitions(spark, n, lambda: rows(linkage.similarity_clusters(df, how=linkage.Linkage(cell=64)).classes.select("cluster", "ids"))) for n in (4, 64)]
    assert found[0] == found[1]


def test_equal_vectors_ties_and_unusable_ones(spark):
    one = [1.0] + [0.0] * 63
    bad = [None, [], [1.0] * 63, [0.0] * 64, [float("nan")] * 64, [float("inf")] + [1.0] * 63]
    data = [(f"e{i}", one, "c", 0) for i in range(9)] + [("e0", one, "c", 0), (None, one, "c", 0)] + [(f"b{i}", v, "c", 0) for i, v in enumerate(bad)]
    got = annforest.most_similar(spark.createDataFrame(data, VECTOR), k=3).filter("id = 'e1' or id = 'e8'")
    assert [(r["id"], r["neighbour"], r["rank"]) for r in got.orderBy("id", "rank").collect()] == [("e1", "e0", 1), ("e1", "e2", 2), ("e1", "e3", 3), ("e8", "e0", 1), ("e8", "e1", 2), ("e8", "e2", 3)]
    assert annforest.most_similar(spark.createDataFrame(data[-3:], VECTOR)).count() == 0


# clusters


def purity(cluster, label):
    groups = {}
    for c, l in zip(cluster, label, strict=True):
        groups.setdefault(c, []).append(l)
    return sum(max(g.count(v) for v in set(g)) for g in groups.values()) / len(label)


def planted(spark, cell, n=240):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((6, 64))
    label = rng.integers(0, 6, n)
    x = (centres[label] + 0.5 * rng.standard_normal((n, 64))).astype(np.float32)
    return linkage.similarity_clusters(frame(spark, x), how=linkage.Linkage(cell=cell)), label, np.arange(6), centres / np.linalg.norm(centres, axis=1, keepdims=True)


@pytest.mark.parametrize("cell", [20, 2048])
def test_clusters_are_the_planted_ones(spark, cell):
    found, label, codes, c = planted(spark, cell)
    of = {r["id"]: r["cluster"] for r in found.members.join(found.classes, "class").select("id", "cluster").collect()}
    cluster = [of[f"i{i:04}"] for i in range(240)]
    assert purity(cluster, label.tolist()) == 1.0 and len(set(cluster)) <= 12
    named = {r["id"]: r for r in linkage.clustered_codes(found, codes, c).collect()}
    assert all(named[f"i{i:04}"]["code"] == label[i] for i in range(240))
    assert sum(r["by_cluster"] for r in named.values()) > 120
    top = linkage.described_clusters(found, codes, c, 2)
    assert top.filter("rank = 1").agg(F.sum("size")).first()[0] == 240
    assert found.sums.agg(F.sum("size")).first()[0] == 240


def test_a_wrong_clustering_names_nothing_by_itself(spark):
    found, _, codes, c = planted(spark, 2048)
    wrong = linkage.Clusters(found.classes, found.members, found.fragments.withColumn("cluster", F.lit("i0000")), found.sums.withColumn("cluster", F.lit("i0000")).limit(1))
    right, other = (linkage.clustered_codes(f, codes, c) for f in (found, wrong))
    assert rows(right.select("id", "code")) == rows(other.select("id", "code"))
    assert other.filter("by_cluster").count() < right.filter("by_cluster").count() / 2


@pytest.mark.parametrize("n", [1, 2, 30, 60])
def test_merging_is_average_linkage(n):
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 8)) + 2 * np.eye(8)[rng.integers(0, 3, n)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    total, size = x.copy(), np.ones(n)
    got = linkage.merge_all(total, size, 0.3)
    groups = [[i] for i in range(n)]
    while len(groups) > 1:
        best = max(((np.mean([x[i] @ x[j] for i in g for j in h]), a, b) for a, g in enumerate(groups) for b, h in enumerate(groups[:a])), key=lambda t: t[0])
        if best[0] < 0.3:
            break
        groups[best[2]] += groups.pop(best[1])
    assert sorted(sorted(g) for g in groups) == sorted(np.flatnonzero(got == l).tolist() for l in set(got.tolist()))
    assert all(np.allclose(total[l], x[got == l].sum(axis=0)) and size[l] == (got == l).sum() for l in set(got.tolist()))


def test_equal_similarities_merge():
    total = np.eye(4)[[0, 0, 0, 1, 1, 2]].copy()
    assert linkage.merge_all(total, np.ones(6), 0.3).tolist() == [0, 0, 0, 3, 3, 5]


def test_clusters_of_nothing(spark):
    found = linkage.similarity_clusters(frame(spark, clustered(3)).limit(0))
    assert found.classes.count() == 0 and found.members.count() == 0
    assert linkage.clustered_codes(found, np.arange(1), np.eye(64)[:1]).count() == 0
    assert linkage.similarity_clusters(frame(spark, clustered(1))).classes.count() == 1


# markup

CASES = [
    ("a < 5 and c > 3, R&D, map<key, value> and vector<float>", []),
    ("That is 87 * 742 * 88 rows; 2**8, my_offset_name, __init", []),
    ("It costs $7 or $153 a day. Export $STORE_HOME and $CACHE_40 in D:\\cache\\shard44.", []),
    ("Stop if size == 55 or size == 875, see [55] and issue #844.", []),
    ("Pass **options to it. Run x --eviction=66 -v.", []),
    ("∫(tt³)dt = 77t⁴/172 + y and |x||y| cos(91k)", []),
    ("<ul><li>one<li>two</ul>", ["html"]),
    ("It&#39;s here<br/>", ["html"]),
    ("a <!-- hidden --> b", ["html"]),
    ("# Title\n\ntext", ["markdown"]),
    ("Title\n=====\ntext", ["markdown"]),
    ("use *this thing* here", ["markdown"]),
    ("[text](a.md)", ["markdown"]),
    ("| a | b |\n|---|---|\n| 1 | 2 |", ["markdown"]),
    ("```\nx = 1 < 2\n```", ["markdown"]),
    ("see [[Page|label]] and '''bold'''", ["wiki"]),
    ("== Head ==\ntext", ["wiki"]),
    ("{{note|level=1|shown}}", ["wiki"]),
    ('{| class="grid"\n! a !! b\n|-\n| 1 || 2\n|}', ["wiki"]),
    ("$\\frac{a}{b}$ and \\textbf{x}", ["latex"]),
    ("\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}", ["latex"]),
    ("&lt;p&gt; and \\cite{a}", ["html", "latex"]),
]


@pytest.mark.parametrize(("text", "kinds"), CASES)
def test_kinds_of_markup(text, kinds):
    assert markup.read(text)[1] == kinds


def test_structure_is_kept():
    clean, _ = markup.read("<h2>Head</h2><p>One <b>two</b><p>three<style>x{}</style><div hidden>no</div><ol><li>a<ul><li>b</ul><li>c</ol><table><tr><th>k<th>value<tr><td>10<td>1</table><pre>if a &lt; b:\n  c</pre>")
    assert clean == "Head\n\nOne two\n\nthree\n\n1. a\n   - b\n2. c\n\nk   value\n10  1\n\n    if a < b:\n      c"
    assert markup.read("- a\n  * b\n\n$$x^2$$\n\n\\begin{tabular}{ll}\na & bb \\\\\nccc & d\n\\end{tabular}")[0] == "- a\n  - b\n\nx^2\n\na    bb\nccc  d"
    assert markup.read("[[File:a.png|thumb|shown]] [[Category:no]][[Page]] {{n|x=1|arg}}")[0] == "shown Page arg"


@pytest.mark.parametrize(("text", "clean", "kinds"), [
    ("<div data-x>Hello</div>", "Hello", ["html"]),
    ("<a href=f.html download>link</a>", "link", ["html"]),
    ("<details custom>x</details>", "x", ["html"]),
    ("<my-widget>a</my-widget> <my-key>", "a <my-key>", ["html"]),
    ("<math><mi>x</mi><mo>=</mo></math>", "x=", ["html"]),
    ("if a <b and c> d", "if a <b and c> d", []),
    ("<p>a <b>x<div>y</div>", "a x\n\ny", ["html"]),
    ("<table><tr><th colspan=2>head<th>z<tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e</table>", "head     z\na     b  c\n      d  e", ["html"]),
    (r"\begin{itemize}\item a \begin{itemize}\item b\end{itemize}\item c\end{itemize}", "- a\n  - b\n- c", ["latex"]),
    (r"\begin{equation}\begin{matrix}a & b\end{matrix}\end{equation}", r"\begin{matrix}a & b\end{matrix}", ["latex"]),
    (r"\begin{verbatim}\begin{x}\end{verbatim}", r"    \begin{x}", ["latex"]),
    (r"p\footnote{a {nested} b} \textbf{a \emph{b}} {\em it} \frac{a}{b}", r"pa nested b a b it \frac{a}{b}", ["latex"]),
    ("{{Infobox|a={{x}}|shown {{b|c}}}}", "shown c", ["wiki"]),
    ("- a item\n  goes on\n- b", "- a item\n  goes on\n- b", ["markdown"]),
    ("$$" + "x_i + " * 500 + "y$$", "x_i + " * 500 + "y", ["latex"]),
    ("a $" + "x_i + " * 80 + "y$ b", "a " + "x_i + " * 80 + "y b", ["latex"]),
    ("== " + "long " * 60 + "==", ("long " * 60).strip(), ["wiki"]),
    ("<div>" * 300 + "deep" + "</div>" * 300, "deep", ["html"]),
    (r"\begin{a}" * 60 + "deep" + r"\end{a}" * 60, "deep", ["latex"]),
])
def test_tags_nesting_and_length(text, clean, kinds):
    assert markup.read(text) == (clean, kinds)


@given(st.text(alphabet="<>/&;*_`#[]{}|\\$='~-!\n abtdli123x\x00", max_size=120))
@settings(max_examples=300, deadline=None)
def test_any_text_can_be_read(text):
    clean, kinds = markup.read(text)
    assert isinstance(clean, str) or not text
    assert set(kinds) <= {"html", "markdown", "wiki", "latex"}


@pytest.mark.parametrize("part", ["<div>", "<b>", "> ", "*", "~", "```a\n", "{|\n", "<!--", "[[a|", "\\begin{a}", "$a ", "a<b>", "<blockquote>x", "<ul><li>x", "\\a{", "{{a|"])
def test_long_and_deep_texts_are_read_in_one_go(part):
    began = time.process_time()
    assert markup.read(part * (200_000 // len(part)))[0] is not None
    assert time.process_time() - began < 20


def test_markup_rows(spark):
    df = items(spark, [("a", "# T"), ("b", None), ("c", ""), ("d", "plain"), ("a", "# T")])
    assert rows(markup.markup_kinds(df)) == [("a", "markdown"), ("a", "markdown")]
    assert rows(markup.markup_kinds(items(spark, [("a", "# T")], "code"))) == []
    assert rows(markup.clean_texts(df).select("id", "text")) == [("a", "T"), ("a", "T"), ("b", None), ("c", ""), ("d", "plain")]
    assert markup.clean_texts(df.limit(0)).count() == 0


# splitting


@given(st.lists(st.sampled_from(["a" * 50, "é" * 30, "word", " ", "\n", ". ", "\n\n", "x" * 130, "😀" * 20]), max_size=60), st.sampled_from(["text", "code", "json", "markdown", None, "?"]))
@settings(max_examples=200, deadline=None)
def test_pieces_cover_and_fit(parts, kind):
    data = "".join(parts).encode()
    limits = chunking.Limits(128, 32, 32, 24)
    pieces = chunking.split(data, kind, limits)
    assert pieces[0].start == 0 and pieces[-1].end == len(data)
    for p, q in zip(pieces, pieces[1:], strict=False):
        assert q.fresh == p.end and p.start < q.start <= p.end and p.end - q.start <= 24
    for p in pieces:
        data[p.start : p.end].decode()
        assert p.end - p.start <= 128
    forced = len(data) > 128 and any(len(x) > 128 for x in re.split(rb"[ \t\r\n]+", data))
    assert any(p.cut == "forced" for p in pieces) is forced


def test_edits_change_only_near_pieces():
    rng = random.Random(1)
    text = " ".join(rng.choice(["alpha", "beta.", "gamma", "delta\n"]) + str(rng.randrange(999)) for _ in range(20000)).encode()
    cut = lambda d: {d[p.fresh : p.end] for p in chunking.split(d, "text")}
    before, after = cut(text), cut(text[:60000] + b" inserted " + text[60000:])
    assert len(before - after) <= 3


def test_piece_rows(spark):
    df = items(spark, [("a", None), ("b", ""), ("c", "x" * 9000), ("d", "y z " * 3000)])
    got = chunking.split_items(df)
    assert rows(chunking.oversized(df)) == [("c", "forced"), ("d", "natural")]
    whole = {r["id"]: r["t"] for r in got.withColumn("t", F.expr("substring(text, cast(fresh - start + 1 as int))")).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "t"))), lambda x: x["t"]), "").alias("t")).collect()}
    assert whole["c"] == "x" * 9000 and whole["d"] == "y z " * 3000
    assert chunking.split_items(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chunking.Limits(100, 200)


# packing and mixing


def documents(spark, texts):
    return spark.createDataFrame([(i, t, s, 0, 0) for i, (t, s) in enumerate(texts)], "doc_id bigint, text string, source string, tokens int, place int")


def containers(spark, *sizes):
    return spark.createDataFrame([(f"c{s}", s) for s in sizes], "container string, capacity_tokens int")


def test_containers_hold_everything_once(spark):
    rng = random.Random(6)
    texts = [(" ".join(rng.choice(["red", "green", "blue", "tree"]) for _ in range(rng.choice([0, 3, 30, 90, 260]))), "s") for _ in range(300)] + [(None, "s"), ("word " * 700, "s")]
    df = documents(spark, texts)
    got = packing.pack(df, containers(spark, 16, 64, 256)).collect()
    used = {}
    for r in got:
        used.setdefault((r["bin"], r["capacity"], r["used"]), []).append(r["tokens"])
    assert all(sum(t) == u <= c for (_, c, u), t in used.items())
    assert len({b for b, _, _ in used}) == len(used)
    sizes = packing.count_tokens([t for t, _ in texts])
    for i, n in enumerate(sizes):
        own = [r for r in got if r["doc_id"] == i]
        assert sum(r["tokens"] for r in own) == n and len(own) == max(1, -(-n // 256)) == own[0]["parts"]
    total = sum(c for _, c, _ in used)
    assert sizes.sum() / total > 0.95
    assert all(r["first"] == 256 * r["part"] for r in got)
    for n in (4, 64, 200):
        report = with_partitions(spark, n, lambda: packing.packing_report(packing.pack(df, containers(spark, 16, 64, 256))).collect())
        assert sum(r["tokens"] for r in report) == sizes.sum() and sum(r["tokens"] for r in report) > 0.95 * sum(r["bins"] * r["capacity"] for r in report)
    assert packing.pack(df.limit(0), containers(spark, 16)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, containers(spark))


def test_hilbert_neighbours_touch():
    side = np.arange(8)
    grid = np.array([(x, y, z) for x in side for y in side for z in side])
    keys = packing.hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(512))
    walk = grid[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def targets(spark, *t):
    return spark.createDataFrame(t, "source string, weight double, max_repeats int")


def points(spark, *p):
    return spark.createDataFrame(p, "source string, time double, weight double")


def test_curves_follow_the_schedule_and_the_targets():
    need = {"a": 500.0, "b": 300.0, "c": 200.0}
    got = mixing.curves(need, {"a": [(0.0, 2.0), (0.5, 1.0), (1.0, 0.0)], "c": [(0.5, 0.0), (0.75, 1.0)]}, 400)
    shares = np.array([np.diff(got[s]) * need[s] / 1000 * 400 for s in "abc"])
    assert np.allclose(shares.sum(axis=0), 1) and np.allclose(shares.mean(axis=1), [0.5, 0.3, 0.2])
    # the proportion of two scheduled weights is kept up to one factor
    middle = (np.arange(400) + 0.5) / 400
    ratio = shares[0] / shares[1] / np.interp(middle, [0, 0.5, 1], [2, 1, 0])
    assert np.allclose(ratio, ratio[0], rtol=1e-3)
    assert shares[2][:150].max() < 1e-6
    assert mixing.curves({}, {}, 10) == {} and np.allclose(mixing.curves({"x": 2.0}, {"x": [(0.3, 0.0)]}, 10)["x"], np.linspace(0, 1, 11))


def test_tenths_of_the_mix_have_the_scheduled_shares(spark):
    rng = random.Random(9)
    texts = [("word " * rng.randint(1, 9), s) for s in ("early", "late", "even") for _ in range(1500)]
    schedule = points(spark, ("early", 0.0, 1.0), ("early", 1.0, 0.0), ("late", 0.0, 0.0), ("late", 1.0, 1.0), ("late", 7.0, 9.0), (None, 0.0, 1.0))
    got = mixing.mix_sources(documents(spark, texts), targets(spark, ("early", 1.0, 1), ("late", 1.0, 1), ("even", 1.0, 1)), schedule)[0].collect()
    total = sum(r["tokens"] for r in got)
    own = {s: sum(r["tokens"] for r in got if r["source"] == s) for s in ("early", "late", "even")}
    want = mixing.curves({s: float(n) for s, n in own.items()}, mixing.schedules(schedule, 100), 500)
    done = 0
    for k in range(10):
        part = [r for r in got if k / 10 <= r["position"] < (k + 1) / 10]
        for s in own:
            share = (np.interp((k + 1) / 10, np.linspace(0, 1, 501), want[s]) - np.interp(k / 10, np.linspace(0, 1, 501), want[s])) * own[s] / total * 10
            assert abs(sum(r["tokens"] for r in part if r["source"] == s) / sum(r["tokens"] for r in part) - share) < 0.02
        done += sum(r["tokens"] for r in part)
        assert abs(done / total - (k + 1) / 10) < 0.01


def test_mix_reaches_its_shares(spark):
    rng = random.Random(8)
    texts = [(f"word {i} " * rng.randint(1, 30), rng.choice(["big", "big", "big", " Small "])) for i in range(800)] + [("x", None), ("y", "other"), (None, "big")]
    mix, shares = mixing.mix_sources(documents(spark, texts), targets(spark, ("BIG", 1.0, 1), ("small", 1.0, 3), ("none", 2.0, 1)), points(spark, ("small", 0.0, 0.1), ("Small ", 1.0, 1.9)), how=mixing.Mix(bucket=50))
    got = mix.collect()
    assert [r["position"] for r in got] == sorted(r["position"] for r in got)
    copies = {}
    for r in got:
        copies.setdefault((r["source"], r["doc_id"]), []).append(r["copy"])
    assert all(sorted(c) == list(range(min(c), min(c) + len(c))) and len(c) <= {"big": 1, "small": 3}[s] for (s, _), c in copies.items())
    table = {r["source"]: r for r in shares.collect()}
    assert abs(table["big"]["share"] - 0.5) < 0.01 and abs(table["small"]["share"] - 0.5) < 0.01
    assert table["none"]["share"] == 0 and table["other"]["target"] is None and table["other"]["tokens"] == 0
    early = [sum(r["tokens"] for r in got if r["source"] == "small" and a <= r["position"] < b) for a, b in ((0, 0.5), (0.5, 1.01))]
    # weights are shares of a sum, so the first half holds what the curve says
    half = mixing.curves({"big": 1.0, "small": 1.0}, {"small": [(0.0, 0.1), (1.0, 1.9)]}, 500)["small"][250]
    assert half < 0.4 and abs(early[0] / sum(early) - half) < 0.02


def test_mix_of_nothing(spark):
    df = documents(spark, [("a b c", "s")])
    assert mixing.mix_sources(df.limit(0), targets(spark, ("s", 1.0, 1)))[0].count() == 0
    assert mixing.mix_sources(df, targets(spark, ("s", 1.0, 1)).limit(0))[0].count() == 0
    mix, shares = mixing.mix_sources(df, targets(spark, ("s", 1.0, 1), ("s", 0.5, 9)))
    assert mix.count() == 1 and shares.first()["share"] == 1.0


# repetition


def brute_cover(text, run):
    w = repetition.words(text or "")
    seen, covered = set(), set()
    for i in range(len(w) - run + 1):
        key = tuple(w[i : i + run])
        if key in seen:
            covered |= set(range(i, i + run))
        seen.add(key)
    return len(w), len(covered)


@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from("a b c D".split()), max_size=60).map(" ".join)), max_size=8), st.integers(1, 6))
@settings(max_examples=150, deadline=None)
def test_repetition_against_brute_force(texts, run):
    found = repetition.measure(texts, run)
    assert [brute_cover(t, run) for t in texts] == list(zip(found.n_words.tolist(), found.covered.tolist(), strict=True))
    for t, n in zip(texts, found.longest.tolist(), strict=True):
        w = repetition.words(t or "")
        assert n == max((k for k in range(len(w)) if len({tuple(w[i : i + k]) for i in range(len(w) - k + 1)}) < len(w) - k + 1), default=0)


def test_repetition_rows(spark):
    df = documents(spark, [("the same six words over again. " * 20, "s"), ("nothing " + " ".join(f"w{i}" for i in range(50)), "s"), (None, "s"), ("", "s"), ("again " * 20000, "s")])
    got = {r["doc_id"]: r for r in repetition.repetition(df).collect()}
    assert got[0]["share"] > 0.9 and got[1]["share"] == 0 and got[2]["share"] == 0 == got[3]["n_words"]
    assert got[4]["longest_repeat"] == 19999
    assert sorted(r["doc_id"] for r in repetition.repetitive_documents(df).collect()) == [0, 4]
    assert sorted(r["doc_id"] for r in repetition.repetitive_documents(df, least_share=1.1, most_repeat=113).collect()) == [0, 4]
    assert sorted(r["doc_id"] for r in repetition.repetitive_documents(df, least_share=1.1, most_repeat=114).collect()) == [4]
    assert repetition.repetition(df.limit(0)).count() == 0
