"""Operators of tideline.llm against brute force, exact round trips and held-out accuracy; edge cases of each."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
import public_tokenizers  # noqa: E402

from tideline.llm import ann, bpe, common, components, langid, lengths, mixing, neardup, quality, rules, toxicity, urls  # noqa: E402
from tideline.llm.automaton import Automaton, Codec  # noqa: E402

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 4), (4, "one two three four five six", "en", "b", 27),
    (4, "one two three four five six", "en", "b", 27), (None, "one two three four five six", "en", None, 27), (6, "word " * 30_000, "en", "b", 150_000),
    (7, "x" * 50_000, None, "b", 50_000), (8, "Ünïcödé 漢字 🙂 <|endoftext|> \x85　 end", "fr", "c", 30), (9, "123 456 !!! ???", "de", "c", 15),
]


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def awkward(spark):
    """Nulls, empty and long texts, repeats, and columns whose names clash with those of the operators."""
    extra = ["size", "n_words", "score", "kept", "component_id", "key", "regs", "label", "copies", "_id", "_copies", "_h", "n_tokens"]
    return frame(spark, AWKWARD).select("*", *[F.lit("clash").alias(c) for c in extra])


def empty(spark):
    return frame(spark, [])


def docs_of(spark):
    return common.table(spark, SF, "documents")


# --- BPE -------------------------------------------------------------------------------------------------

CODEC = Codec(PATH)
THEIRS = tokenizers.Tokenizer.from_file(PATH)


def theirs(text):
    return THEIRS.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=60) | st.text(alphabet="ab \n'.1", max_size=60))
def test_encoding_equals_the_library(text):
    ids = CODEC.encode(text)
    assert ids == theirs(text) and CODEC.decode(ids) == THEIRS.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("c", list("a-=_ 0!h.\n*#é"))
def test_runs_of_one_character(c):
    for n in range(1, 140):
        assert CODEC.encode(c * n) == theirs(c * n)


def test_words_of_all_lengths_beside_each_other():
    rng = random.Random(4)
    letters = "aeiourstn" + "漢字仮名交文" + "éß"
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in [*range(1, 120), *[300] * 40, 1000, 5000, 40_000]]
    for chunk in (texts, texts[:5], texts[-1:], texts[100:]):
        text = " ".join(chunk)
        assert CODEC.encode(text) == theirs(text)


def merged(word, merges):
    """Plain BPE: merge the first pair of the least rank, everywhere from the left, until none is left."""
    rank = {m[:2]: (i, m[2]) for i, m in enumerate(merges)}
    while True:
        found = [rank[p][0] for p in zip(word, word[1:]) if p in rank]
        if not found:
            return word
        pair = next(p for p in zip(word, word[1:]) if p in rank and rank[p][0] == min(found))
        out, i = [], 0
        while i < len(word):
            if tuple(word[i : i + 2]) == pair:
                out.append(rank[pair][1])
                i += 2
            else:
                out.append(word[i])
                i += 1
        word = out


@settings(max_examples=150, deadline=None)
@given(st.randoms(use_true_random=False), st.lists(st.text("abc", min_size=1, max_size=14), min_size=1, max_size=10))
def test_gadgets_equal_plain_merging(rng, words):
    label, merges, pairs = {0: b"a", 1: b"b", 2: b"c"}, [], set()
    for w in range(3, 3 + rng.randint(0, 12)):
        u, v = rng.choice(sorted(label)), rng.choice(sorted(label))
        # A merge that its own parts' merges would break up never applies; trained merges have none of these.
        if (u, v) in pairs or label[u] + label[v] in label.values() or merged([{97: 0, 98: 1, 99: 2}[b] for b in label[u] + label[v]], merges) != [u, v]:
            continue
        pairs.add((u, v))
        merges.append((u, v, w))
        label[w] = label[u] + label[v]
    a = Automaton([0, 1, 2], merges, label)
    for word in words:
        assert a.encode_word(word.encode()) == merged([{"a": 0, "b": 1, "c": 2}[c] for c in word], merges)


def test_automaton_refuses_bad_merges():
    with pytest.raises(ValueError):
        Automaton([0, 1], [(0, 5, 2)], {0: b"a", 1: b"b", 2: b"x"})


def test_digests_and_columns(spark):
    rows = bpe.digests(awkward(spark), PATH).collect()
    want = Counter()
    for doc_id, text, *_ in AWKWARD:
        ids = theirs(text)
        want[doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(THEIRS.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(map(tuple, rows)) == want
    back = awkward(spark).select("text", bpe.decoded(bpe.encoded(F.col("text"), PATH), PATH).alias("t")).collect()
    assert all((r["text"] or "") == r["t"] for r in back)
    assert bpe.digests(empty(spark), PATH).count() == 0


def test_lengths(spark):
    n = sorted(len(theirs(r[1])) for r in AWKWARD)
    s = lengths.suffix_sums(lengths.length_histogram(awkward(spark), PATH)).orderBy("n_tokens").collect()
    assert [(r["n_tokens"], r["n_docs"]) for r in s] == sorted(Counter(n).items())
    for r in s:
        limit = r["n_tokens"]
        assert r["docs_at_least"] == sum(x >= limit for x in n) and r["tokens_at_least"] == sum(x for x in n if x >= limit)
        assert r["truncated_total"] == sum(min(x, limit) for x in n) and r["whole_docs"] == sum(x <= limit for x in n) and r["tokens_total"] == sum(n)
    sums = lengths.suffix_sums(lengths.length_histogram(awkward(spark), PATH))
    for limit in (0, 1, 5, 7, 1000, 10**9):
        assert lengths.truncated_total(sums, limit).first()[0] == sum(min(x, limit) for x in n)
    assert lengths.quantile(sums, 0.5).first()[0] == n[math.ceil(0.5 * len(n)) - 1]
    assert lengths.suffix_sums(lengths.length_histogram(empty(spark), PATH)).count() == 0


# --- mixing ----------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    open_, target, rest = set(names), {}, 1.5 * sum(sizes.values())
    while open_:
        level = rest / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > 2 * sizes[s]}
        if not full:
            return target | {s: level * w[s] for s in open_}
        for s in full:
            target[s] = 2 * sizes[s]
            rest -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 100, "c": 7, "Z": 3, None: 50}, {"é": 5, "z": 500, "a": 0}, {"a": 4}, {"a": 0}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_mix_reaches_targets(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 30), "en", rng.choice(["a", "a", "a", "b", "c", None]), 1) for i in range(2000)]
    m = mixing.mix(frame(spark, rows))
    got = m.collect()
    assert len(got) == 2000 and all(r["copies"] in (0, 1, 2) and (r["size"] or not r["copies"]) for r in got)
    for s in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == s]
        assert sum(r["size"] for r in mine) == mine[0]["source_size"]
        assert abs(sum(r["copies"] * r["size"] for r in mine) - mine[0]["target"]) <= 30
    assert sorted(map(str, got)) == sorted(map(str, m.collect()))
    plan = mixing.schedule(m).collect()
    at = [r["position"] for r in plan]
    assert at == sorted(at) and 0 <= min(at) and max(at) <= 1 and len(at) == sum(r["copies"] for r in got)
    # Heavy sources lead: the schedule's integral at half time is over half.
    a = [r["position"] for r in plan if r["source"] == "a"]
    assert np.mean(np.array(a) < 0.5) == pytest.approx(0.5 + 0.5 * 0.25, abs=0.05)


def test_mix_of_awkward_rows(spark):
    got = mixing.mix(awkward(spark)).collect()
    assert len(got) == len(AWKWARD) and {r["size"] for r in got if r["doc_id"] in (1, 2, 3)} == {0}
    assert mixing.mix(empty(spark)).count() == 0


# --- toxicity, language, quality ---------------------------------------------------------------------------


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels = common.table(spark, "/root/testdata/sf0.01", "documents"), common.table(spark, "/root/testdata/sf0.01", "labels")
    return docs, labels, {r["doc_id"]: r for r in labels.collect()}


def test_toxicity(spark, learned):
    docs, labels, by = learned
    model = toxicity.train(docs, labels)
    got = docs.select("doc_id", toxicity.graded(F.col("text"), model).alias("g")).select("doc_id", "g.*").collect()
    clean = [r["p_toxic"] >= 0.5 for r in got if r["doc_id"] in by and not by[r["doc_id"]]["toxic"]]
    toxic = [r["p_toxic"] >= 0.5 for r in got if r["doc_id"] in by and by[r["doc_id"]]["toxic"]]
    assert np.mean(clean) == 0 and np.mean(toxic) > 0.5
    assert np.all(np.diff(model.thetas) >= 0) and all(0 <= r["severity"] <= 3 for r in got)
    kept = toxicity.drop_toxic(awkward(spark), model)
    assert kept.columns == awkward(spark).columns and kept.count() == len(AWKWARD)


@pytest.mark.parametrize("share", [0.1, 1 / 3])
def test_copies_of_a_toxic_text_are_caught(spark, learned, share):
    docs, labels, by = learned
    n = round(len(by) * share / (1 - share))
    text = docs.join(labels, "doc_id").where("toxic = 1 and n_chars between 3000 and 10000").orderBy("doc_id").first()["text"]
    copies = frame(spark, [(10**6 + i, text, "en", "copies", len(text)) for i in range(n)])
    more = frame(spark, [(10**6 + i, 0, 1) for i in range(n)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs.union(copies), labels.union(more))
    kept = {r["doc_id"] for r in toxicity.drop_toxic(docs.union(copies), model).select("doc_id").collect()}
    assert not any(i >= 10**6 for i in kept)
    assert np.mean([i in kept for i, r in by.items() if not r["toxic"]]) > 0.99
    assert np.mean([i in kept for i, r in by.items() if r["toxic"]]) < 0.2


def test_ordinal_regression_recovers_order():
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(20) < 0.3) for _ in range(3000)]
    x = np.array([(r < 5).sum() - (r >= 15).sum() for r in rows])
    y = np.digitize(x + rng.logistic(size=3000) * 0.3, [0.5, 1.5, 2.5])
    w, theta = toxicity.fit_ordinal(rows, y, 20, penalty=1e-3, steps=1500)
    assert w[:5].min() > 0.5 and w[15:].max() < -0.5 and np.abs(w[5:15]).max() < 0.4 and np.all(np.diff(theta) > 0)


def test_training_without_labels_rejects_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = awkward(spark)
    assert toxicity.drop_toxic(docs, toxicity.train(docs, none)).count() == len(AWKWARD)
    assert quality.keep_good(docs, quality.train(docs, none)).count() == len(AWKWARD)
    nulls = spark.createDataFrame([(None, 1, 1), (4, None, None), (4, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.drop_toxic(docs, toxicity.train(docs, nulls)).count() == len(AWKWARD)


def test_quality(spark, learned):
    docs, labels, by = learned
    model = quality.train(docs, labels)
    got = docs.select("doc_id", quality.quality_score(F.col("text"), model).alias("s")).collect()
    share = {k: np.mean([r["s"] >= 0.7 for r in got if r["doc_id"] in by and by[r["doc_id"]]["quality"] == k]) for k in (0, 1)}
    assert share[1] > 0.95 and share[0] < 0.2 and all(0 <= r["s"] <= 1 for r in got)
    scores = awkward(spark).select(quality.quality_score(F.col("text"), model).alias("s")).collect()
    assert len(scores) == len(AWKWARD) and all(0 <= r["s"] <= 1 for r in scores)


def test_isotonic_is_the_least_squares_rising_fit():
    x, y = np.arange(6.0), np.array([1, 0, 0, 1, 0.5, 2.0])
    knots, means = quality.isotonic(x, y)
    assert np.allclose(means, [1 / 3, 0.75, 2.0]) and np.all(np.diff(knots) > 0)


def test_normal_equations_sum_partitions(spark):
    rng = np.random.default_rng(1)
    k = len(quality.STATISTICS)
    model = quality.QualityModel(np.zeros(k), np.ones(k), rng.normal(size=(k, quality.N_FEATURES)), rng.uniform(0, 6, quality.N_FEATURES), None, None)
    x, y = rng.normal(size=(50, k)), rng.integers(0, 2, 50)
    rows = spark.createDataFrame([(list(map(float, a)), float(b)) for a, b in zip(x, y)], "stats array<double>, label double").repartition(4)
    a, b = quality.normal_equations(rows, model)
    phi = model.mapped(x)
    assert np.allclose(a, phi.T @ phi) and np.allclose(b, phi.T @ y)


def test_languages(spark, learned):
    docs, _, _ = learned
    model = langid.train(docs)
    got = {r["doc_id"]: r for r in docs.select("doc_id", "lang", langid.identified(F.col("text"), model).alias("g")).select("doc_id", "lang", "g.*").collect()}
    assert np.mean([r["lang"] == r["lang_pred"] for i, r in got.items() if held_out(i)]) > 0.98
    rows = awkward(spark).select("doc_id", langid.identified(F.col("text"), model).alias("g")).select("doc_id", "g.*").collect()
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3, 9)} == {"und"} and all(0 <= r["score"] <= 1 for r in rows)
    assert langid.train(empty(spark)).languages == []


def test_languages_under_repeated_ids_are_learned(spark):
    low, high = [i for i in range(1, 20) if not held_out(i)][:2]
    rows = [(i, f"{word} {k}", word, "a", 1) for i, word in ((low, "en"), (high, "fr")) for k in range(100)]
    assert langid.train(frame(spark, rows), limit=20, steps=2).languages == ["en", "fr"]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6, 9, 20])
def test_codewords_differ(n):
    c = langid.codewords(n)
    assert len(c) == n and all((c[i] != c[j]).any() for i in range(n) for j in range(i))


# --- urls and components -----------------------------------------------------------------------------------


def brute_components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, None), (None, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], "random"])
def test_components(spark, edges):
    if edges == "random":
        rng = random.Random(5)
        edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(70)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(df).collect()}
    assert got == brute_components(edges)


def page(i, url, *links):
    return (i, url, "<html><head>" + "".join(links) + "</head></html>")


def test_url_rules_and_aliases(spark):
    canonical = '<link href="{}" rel="canonical">'.format
    refresh = "<meta http-equiv=refresh content='0; url={}'>".format
    pages = [
        page(1, "http://Sub.Example.com/en/x"), page(2, "https://www.example.com/en/x?a#b"), page(3, "http://a.com"), page(4, "http://a.com/"), page(5, "ftp://b.net/es/1"),
        page(6, "http://c.org/1", canonical("https://b.net/fr/9")), page(7, "http://d.org/1", refresh("http://c.org/1#top")), page(8, "http://e.org/", canonical("/up")),
        page(9, "http://e.org/up", canonical("//ok.com/x")), page(10, "http://e.org/up?utm_source=z", canonical("http://b.net/es/")), page(11, None), page(12, "no url"), (13, "http://z.org/", None),
        page(14, "http://b.net/english/"), page(1, "http://Sub.Example.com/en/x"),
    ]
    got = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(frame(spark, pages, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect())
    assert got == Counter({
        (1, "sub.example.com", "/en/x", "example.com/en/", "block"): 2, (2, "www.example.com", "/en/x", "www.example.com/en/", "allow"): 1, (3, "a.com", "", None, "allow"): 1,
        (4, "a.com", "/", "com/", "allow"): 1, (5, "b.net", "/es/1", "net/es/", "block"): 1, (6, "c.org", "/1", None, "block"): 1, (7, "d.org", "/1", None, "block"): 1,
        (8, "e.org", "/", None, "allow"): 1, (9, "e.org", "/up", None, "allow"): 1, (10, "e.org", "/up", None, "allow"): 1, (11, "", "", None, "allow"): 1, (12, "", "", None, "allow"): 1,
        (13, "z.org", "/", None, "allow"): 1, (14, "b.net", "/english/", None, "allow"): 1,
    })
    assert urls.judge(frame(spark, [], "page_id long, url string, html string")).count() == 0


def test_relative_encoded_and_repeated_links(spark):
    canonical = '<link href="{}" rel="canonical">'.format
    link = {
        1: ("http://a.org/x/y", "index.html", "http://a.org/x/index.html"), 2: ("http://a.org/x/y?q", "?id=2", "http://a.org/x/y?id=2"), 3: ("http://a.org/x/y/z", "../w?a=..", "http://a.org/x/w?a=.."),
        4: ("http://a.org", "b", "http://a.org/b"), 5: ("http://a.org/x", "/p?a=1&amp;b=2&#38;c=3&#x26;d", "http://a.org/p?a=1&b=2&c=3&d"), 6: ("http://a.org/x/y", "./.", "http://a.org/x/"), 7: ("http://a.org/x", "mailto:a", None), 8: ("none", "b", None),
    }
    rows = frame(spark, [(i, u, canonical(x)) for i, (u, x, _) in link.items()], "page_id long, url string, html string")
    got = {r["page_id"]: r["l"] for r in rows.select("page_id", urls.links_of(F.col("html"), F.col("url")).alias("l")).collect()}
    assert got == {i: [] if want is None else [want] for i, (_, _, want) in link.items()}
    two = [page(1, "http://c.org/1", canonical("http://d.org/"), canonical("https://b.net/fr/9")), page(2, "http://e.org/a/b", canonical("../1?x&amp;y")), page(3, "http://e.org/1?x&y", canonical("http://b.net/es/"))]
    assert [r["verdict"] for r in urls.judge(frame(spark, two, "page_id long, url string, html string")).orderBy("page_id").collect()] == ["block"] * 3


def test_joined_rules_equal_listed_ones(spark):
    pages = common.table(spark, SF, "pages").select(F.col("page_id").alias("id"), urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"))
    table = spark.createDataFrame(list(urls.RULES), "host string, path string, verdict string")
    joined = {r["id"]: (r["rule"], r["verdict"]) for r in urls.fitting_rules(pages, table).collect()}
    listed = {r["id"]: (r["f"]["rule"], r["f"]["verdict"]) for r in pages.select("id", urls.fitting_rule(F.col("host"), F.col("path")).alias("f")).where("f is not null").collect()}
    assert joined == listed and joined


# --- rules -------------------------------------------------------------------------------------------------


def brute_rules(text):
    text = text or ""
    w = [x for x in re.split("[ \t-\r]+", text) if x]
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(8)}
    lines = [x for x in text.split("\n") if re.search("[^ \t-\r]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_rules_against_brute_force(spark):
    rng = random.Random(2)
    rows = list(AWKWARD) + [(100 + i, "".join(rng.choice(["a ", "b ", "c\n", "d# ", "\t", "é ", "a b c\n"]) for _ in range(rng.randint(0, 120))), "en", "s", 1) for i in range(150)]
    base = frame(spark, rows).withColumn("n_words", F.lit("clash"))
    got = Counter(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in rules.judge(base).collect())
    want = Counter()
    for doc_id, text, *_ in rows:
        b = brute_rules(text)
        want[doc_id, *b, b[0] < 20 or 100 * b[4] > 30 * b[0]] += 1
    assert got == want
    assert rules.judge(empty(spark)).count() == 0


def test_order_of_rules_never_changes_the_verdict(spark):
    based = rules.with_base(docs_of(spark))
    names = list(rules.RULES)
    a = based.select("doc_id", rules.cascade(rules.RULES, names).isNull().alias("k")).collect()
    b = based.select("doc_id", rules.cascade(rules.RULES, names[::-1]).isNull().alias("k")).collect()
    assert sorted(a) == sorted(b)
    order = rules.order_rules(based, {"never": F.lit(False), "always": F.lit(True)})
    assert [x[0] for x in order] == ["always", "never"]


def test_rules_stand_by_rejections_per_cost_among_what_is_left(spark):
    based = rules.with_base(docs_of(spark)).where("not base_failed").coalesce(1).cache()
    dear = "aggregate(sequence(1, 400), 0, (a, x) -> (a * 31 + x + length(text)) % 1000003) >= 0"
    order = rules.order_rules(based, {"dear": f"{dear} and doc_id % 2 = 0", "cheap": "doc_id % 2 = 0", "other": "doc_id % 3 = 0"})
    assert [x[0] for x in order][-1] == "dear" and order[-1][1] == 0  # all that it rejects is gone by then
    cost = {x[0]: x[2] for x in order}
    assert cost["dear"] > 2 * cost["cheap"]
    based.unpersist()


def test_the_sample_of_rules_has_no_limit(spark):
    plan = rules.judge(docs_of(spark), sample_rows=20)._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan


# --- near duplicates -----------------------------------------------------------------------------------------


def brute_groups(rows, width, percent):
    sets = {}
    for doc_id, text, *_ in rows:
        w = [x for x in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        s = frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()
        sets.setdefault(doc_id, []).append(s)
    ids = [i for i in sets if i is not None]
    edges = [(a, b) for a in ids for b in ids if a < b for s in sets[a] for t in sets[b] if s and t and 100 * len(s & t) >= percent * len(s | t)]
    return {i: brute_components(edges).get(i, i) for i in ids}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_groups_against_brute_force(spark, width, percent):
    rng = random.Random(width)
    vocab = [f"w{i}" for i in range(400)]
    rows, texts = [], []
    for i in range(60):
        base = [rng.choice(vocab) for _ in range(rng.randint(1, 120))]
        texts.append(base)
        for _ in range(rng.choice([0, 0, 1, 6])):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            texts.append(t)
    chain = [rng.choice(vocab) for _ in range(200)]
    for i in range(25):  # each is near the one before, the ends are far apart
        chain = list(chain)
        chain[7 * i] = f"new{i}"
        texts.append(chain)
    rng.shuffle(texts)
    rows = [(i + 20, " ".join(t).upper() if i % 5 == 0 else "\n".join(t), "en", "s", 1) for i, t in enumerate(texts)] + AWKWARD
    rows.append((rows[0][0], rows[1][1], "en", "s", 1))
    df = frame(spark, rows).withColumn("key", F.lit("clash"))
    got = neardup.near_duplicates(df, width, percent).collect()
    want = brute_groups(rows, width, percent)
    assert len(got) == len(rows)
    assert all(r["component_id"] == want.get(r["doc_id"]) and r["kept"] == (r["doc_id"] == r["component_id"] or r["doc_id"] is None) for r in got)
    left = neardup.drop_near_duplicates(df, width, percent)
    assert left.columns == df.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(want.values())) and ids.count(None) == 1


def test_cells_find_what_pairs_find(spark, monkeypatch):
    """Large buckets: with cells of four nodes and no small buckets the groups are the same."""
    monkeypatch.setattr(neardup, "SMALL", 0)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(70):
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = f"x{rng.randint(0, 5)}"
        rows.append((i, " ".join(t + [f"end{i % 7}"] * rng.randint(0, 2)), "en", "s", 1))
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame(spark, rows), 3, 85).collect()}
    assert got == brute_groups(rows, 3, 85)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1), min_size=2, max_size=12), st.integers(1, 6), st.integers(40, 95))
def test_linked_pairs_span_all_links(sets, cut, percent):
    arrays = [np.array(sorted(s), np.int64) for s in sets]
    n, parts = len(sets), np.arange(len(sets)) % 5
    left, right = np.arange(min(cut, n - 1)), np.arange(min(cut, n - 1), n)
    mine = neardup.linked_pairs(arrays, parts, left, right, percent)
    true = [(i, j) for i in left for j in right if parts[i] != parts[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    assert set(mine) <= set(true)
    assert brute_components([(parts[i], parts[j]) for i, j in mine]) == brute_components([(parts[i], parts[j]) for i, j in true])


def test_no_documents(spark):
    assert neardup.near_duplicates(empty(spark)).count() == 0 and neardup.drop_near_duplicates(empty(spark)).count() == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 2**63, 4000, dtype=np.uint64) for _ in range(2))
    both = np.unique(np.concatenate([a, b]))
    assert (neardup.registers(both) == np.maximum(neardup.registers(a), neardup.registers(b))).all()
    for share in (0.2, 0.5, 0.85, 0.95):
        est = []
        for _ in range(30):
            x = rng.integers(0, 2**63, 1000, dtype=np.uint64)
            n = int(round(1000 * share / (1 + share) * 1))
            u, v = x[: 500 + n // 2], x[500 - n // 2 :]
            true = len(np.intersect1d(u, v)) / len(np.union1d(u, v))
            k = [neardup.registers(s).astype(np.int64)[None, :] for s in (u, v)]
            est.append(neardup.likeliest(*k, np.array([len(u)]), np.array([len(v)]))[0] - true)
        assert abs(np.mean(est)) < 0.03 and np.std(est) < 0.08


# --- nearest neighbours ----------------------------------------------------------------------------------------


def brute_nearest(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in ok:
        if q % 20 == 0:
            scored = sorted((-(v * w).sum(), i) for i, w in ok if i != q)[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


@pytest.mark.parametrize("n", [0, 1, 15, 300])
def test_nearest_on_small_tables(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8) * rng.uniform(0.5, 2)]) for i in range(n)]
    rows += [(1000 + i, [1.0] * 8) for i in range(0, 60 if n else 0)]
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [None] + [1.0] * 7), (2060, [float("nan")] * 8), (2080, [float("inf")] * 8), (2100, []), (2120, [1.0])] if n else []
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("key", F.lit("clash"))
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    want = {q: v for q, v in brute_nearest(rows, 20).items() if v}
    assert got.keys() == want.keys()
    by = dict(rows)
    for q in want:
        assert len(got[q]) == len(want[q]) and got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))
        assert all(s == pytest.approx(np.dot(by[q], by[i]), rel=1e-12) for i, s in got[q])
        if n < 100:
            assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
    assert not want or np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want]) > 0.95


def test_recall(spark):
    df = common.table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    v, ids = np.array([r[1] for r in rows], float), np.array([r[0] for r in rows])
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = [len(got[ids[q]] & set(ids[[i for i in np.lexsort((ids, -(v @ v[q]))) if i != q][:20]])) / 20 for q in np.flatnonzero(ids % 20 == 0)]
    assert np.mean(hits) >= 0.9


def test_driver_gives_back_memory_after_a_saved_table(spark):
    jvm = spark._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()

    def held():  # MB outside the JVM's own heap, which lies at low addresses
        with open(f"/proc/{pid}/smaps") as f:
            found = re.findall(r"^([0-9a-f]+)-[0-9a-f]+ (?:.*\n(?![0-9a-f]+-))*?Anonymous: +(\d+)", f.read(), re.M)
        return sum(int(kb) for at, kb in found if int(at, 16) >> 40) >> 10

    common.forget(common.save(spark.range(1), "one"))  # the first loads much
    blocks = [jvm.java.nio.ByteBuffer.allocateDirect(64 << 10) for _ in range(3000)]
    full = held()
    for i, block in enumerate(blocks):
        if i % 50:  # so that what is freed lies between blocks in use
            spark.sparkContext._gateway.detach(block)
    for _ in range(2):
        time.sleep(0.5)
        jvm.System.gc()
    time.sleep(0.5)
    common.forget(common.save(spark.range(1), "one"))
    assert held() < full - 120
