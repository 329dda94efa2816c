"""What the methods decide, against brute force: ranking, language, likeness, hosts, URLs, lists, the pipeline."""

from __future__ import annotations

import itertools
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from junctura.llm import fingerprints, host_rules, language, near_join, quality, shared, url_templates
from junctura.llm.queries import may_learn


def test_ranking_minimises_the_logistic_loss_of_the_pairs():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, quality.N_FEATURES))
    good = x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=90) > 0
    own = quality.Ranking(x, good)
    z = (x - x.mean(0)) / (x.std(0) + 1e-3)
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    draw = np.random.default_rng(7)
    pairs = [(b, w) for w, row in zip(worse, draw.choice(better, (len(worse), quality.PAIRS))) for b in row]

    def loss(weights):
        score = z @ weights
        return sum(np.log1p(np.exp(score[w] - score[b])) for b, w in pairs) / len(pairs) + quality.RIDGE / 2 * (weights**2).sum()

    least = loss(own.weights)
    for k in range(0, quality.N_FEATURES, 9):  # no step along an axis makes it less
        step = np.zeros(quality.N_FEATURES)
        step[k] = 1e-3
        assert loss(own.weights + step) >= least - 1e-9 and loss(own.weights - step) >= least - 1e-9
    below = (z @ own.weights < own.cut).sum()
    assert below == (~good).sum()
    assert ((own.score(x) >= 0.5) == (z @ own.weights >= own.cut)).all()


SCRIPTS = {"el": "αβγδεζηθικλμνξοπρστυφχψω", "ru": "абвгдежзийклмнопрстуфхцчшщыэюя", "ja": "".join(map(chr, range(0x3041, 0x3091))), "zh": "".join(map(chr, range(0x4E00, 0x4F40))), "zh2": "".join(map(chr, range(0x5F00, 0x6040))), "ar": "".join(map(chr, range(0x0621, 0x064A))), "en": "abcdefghijklmnopqrstuvwxyz"}


def test_languages_of_many_scripts(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(210):
        lang = list(SCRIPTS)[i % len(SCRIPTS)]
        rows.append((i, " ".join("".join(rng.choice(list(SCRIPTS[lang]), 4)) for _ in range(25)), lang))
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), may_learn).collect()}
    held = [(i, x) for i, _, x in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 50 and all(got[i] == x for i, x in held)


def test_predictions_are_those_of_the_written_out_kernel_ridge(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "".join(rng.choice(list("abcd" if i % 2 else "bcde"), 12)), "x" if i % 2 else "y") for i in range(45)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), may_learn).collect()}
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    kernel = lambda s, t: len(grams(s) & grams(t)) / np.sqrt(len(grams(s)) * len(grams(t)))
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    texts = [t for _, t, _ in learned]
    among = np.array([[kernel(s, t) for t in texts] for s in texts])
    value, vector = np.linalg.eigh(among)
    kept = value > 1e-6 * value.max()
    root = vector[:, kept] / np.sqrt(value[kept])
    features = lambda ts: np.hstack([np.array([[kernel(s, t) for t in texts] for s in ts]) @ root, np.ones((len(ts), 1))])
    f = features(texts)
    wanted = np.array([[1.0 if lang == x else -1.0 for x in "xy"] for _, _, lang in learned])
    weights = np.linalg.solve(f.T @ f + language.RIDGE * len(texts) * np.eye(f.shape[1]), f.T @ wanted)
    value = features([t for _, t, _ in rows]) @ weights
    share = np.exp(2 * value) / np.exp(2 * value).sum(1, keepdims=True)
    for (i, _, _), v, s in zip(rows, value, share, strict=True):
        if abs(v[0] - v[1]) > 1e-3:
            assert got[i][0] == "xy"[int(v.argmax())]
        assert abs(got[i][1] - s.max()) < 1e-3


def test_likeness_of_the_query_is_near_generalised_jaccard(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 40, 60)) for _ in range(24)]
    rows = [(k, t if k % 3 else " ".join(t.split()[:40] + texts[k - 1].split()[:20])) for k, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in fingerprints.against_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()}

    def jaccard(s, t):
        a, b = Counter(s.split()), Counter(t.split())
        return sum((a & b).values()) / sum((a | b).values())

    off = []
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        off.append(got[i]["near_next"] - jaccard(text, following))
        off.append(got[i]["near_edited"] - jaccard(text, fingerprints.edited(text, following)))
    assert abs(np.mean(off)) < 0.03 and np.max(np.abs(off)) < 0.2  # 128 samples: a deviation of 0.044 at most


def rejected_hosts(spark, rates):
    df = spark.createDataFrame(rates, "host string, n long, n_failed long")
    return {r["host"] for r in host_rules.host_verdicts(df).filter("host_rejected").collect()}


def test_hosts_that_fail_far_more_often_are_rejected(spark):
    ten = [(f"good{k}", 200, 18 + k % 5) for k in range(10)]
    assert rejected_hosts(spark, [*ten, ("bad1", 200, 80), ("bad2", 150, 60), ("few", 2, 2)]) == {"bad1", "bad2"}
    assert rejected_hosts(spark, [*ten, ("like", 3000, 360), ("none", 500, 0)]) == set()
    assert rejected_hosts(spark, ten) == set()
    assert rejected_hosts(spark, [("a", 50, 0), ("b", 50, 0)]) == set() == rejected_hosts(spark, [("a", 50, 50)])
    assert rejected_hosts(spark, [("a", 50, 0), ("b", 10, 10), (None, 30, 30), ("c", 200, 0)]) == {"b", None}
    large = [(f"h{k}", 100_000_000, 10_000_000) for k in range(50)]
    assert rejected_hosts(spark, large) == set() and rejected_hosts(spark, [*large, ("worse", 1_000_000, 250_000)]) == {"worse"}


def test_documents_of_a_rejected_host_go(spark):
    odd = "".join(f" #$|&<>{i}" for i in range(30))  # fails the symbol rule, which is no base rule
    good = [(k, " ".join(f"g{k}w{i}" for i in range(30)) + (odd if k % 10 == 0 else ""), "fine") for k in range(100)]
    bad = [(200 + k, " ".join(f"b{k}w{i}" for i in range(30)) + (odd if k % 5 < 3 else ""), "worse") for k in range(30)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, source string")
    kept = {r["doc_id"] for r in host_rules.judge(df).filter("kept").collect()}
    assert kept == set(range(100))
    assert {r["doc_id"] for r in host_rules.keep(df).collect()} == kept


def verdicts(spark, rows, rules=None):
    df = spark.createDataFrame(rows, "page_id long, url string")
    return {r["page_id"]: r["verdict"] for r in url_templates.judge(df, rules=rules).collect()}


def test_unlabelled_branches_take_the_verdict_of_their_like(spark):
    urls = [(k, f"http://s.example.net/{lang}/{k}{end}") for k, (lang, end) in enumerate(itertools.product(["en", "de", "fr", "es"] * 6, ["", ".html"]))]
    urls += [(500 + k, f"http://s.example.net/shop/{k}/buy/now") for k in range(12)]  # another form: no label speaks of it
    urls += [(600 + k, f"http://s.example.org/{lang}/{k}") for k, lang in enumerate(["en", "fr"] * 8)]  # no labels at all
    got = verdicts(spark, urls)
    assert all(got[k] == "block" for k in range(48))
    assert all(got[k] == "allow" for k in [*range(500, 512), *range(600, 616)])


def test_labels_that_differ_keep_branches_apart(spark):
    urls = [(k, f"http://h.x/{lang}/{k}") for k, lang in enumerate(["aa", "bb", "cc"] * 20)]
    got = verdicts(spark, urls, [("block", "h.x/aa/"), ("allow", "h.x/bb/")])
    assert all(got[k] == ("block" if k % 3 == 0 else "allow") for k in range(60))


def test_odd_urls(spark):
    long = "http://long.x/" + "/".join(f"s{k}" for k in range(3000))
    urls = [(None, "http://h.x/a/1"), (None, "http://h.x/a/1"), (1, long), (2, long), (3, "http://h.x//"), (4, "http://h.x/*/~w:/1"), (5, "://"), (6, "http:///"), (7, "http://h.x/" + "y" * 200_000)]
    df = spark.createDataFrame(urls, "page_id long, url string")
    assert url_templates.judge(df).filter("verdict = 'allow'").count() == len(urls)
    members = [(k, f"http://m.x/user/{name}/posts") for k, name in enumerate("ann bob cid dan eve fay gus hal ida jon".split())]
    assert {r["template"] for r in url_templates.judge(spark.createDataFrame(members, "page_id long, url string")).collect()} == {"/user/*/posts"}


@pytest.mark.parametrize("sizes", [{"LIST": 2, "LONG": 2}, {"LIST": 1000, "LONG": 64}])
def test_shared_lists_and_their_lengths(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(near_join, name, value)
    rng = np.random.default_rng(1)
    rows = [(int(t), int(x), 9, bool(t % 5 == 0)) for t, x in zip(rng.integers(0, 40, 400), rng.integers(0, 60, 400), strict=True)]
    rows += [(100 + k, k, 9, False) for k in range(50)]  # alone in their lists
    df = spark.createDataFrame(rows, "token long, node long, n int, often boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = near_join.shared_lists(df).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    lists = {}
    for t, x, _, _ in rows:
        lists.setdefault(t, set()).add(x)
    want = sorted((t, x) for t, xs in lists.items() for x in xs if len(xs) > 1 or t % 5 == 0 and t < 100)
    assert sorted((r["token"], r["node"]) for r in got) == want
    for r in got:
        size = len(lists[r["token"]])
        long = r["token"] % 5 == 0 or size > near_join.LIST * near_join.LONG
        assert r["m"] == (0 if long else size)


def test_long_texts_and_large_groups_are_linked(spark, monkeypatch):
    for name, value in (("LIST", 3), ("LONG", 2), ("GROUP", 30), ("BLOCK", 20), ("FREQUENT", 20)):
        monkeypatch.setattr(near_join, name, value)
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        text = list(base)
        for k in rng.integers(0, 120, rng.integers(0, 6)):
            text[k] = f"x{rng.integers(0, 30)}"
        rows.append((i, " ".join(text)))
    long = " ".join(f"v{i}" for i in range(40_000))
    rows += [(100, long), (101, long + " more words at the end"), (102, long.replace("v7 ", "q ")), (103, " ".join(f"v{i}" for i in range(30_000)))]
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for i, t in rows}
    root = {i: i for i, _ in rows}
    for _ in range(3):
        for a, b in itertools.combinations(sets, 2):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    got = {r["doc_id"]: r["component_id"] for r in near_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == root


def test_pipeline_on_awkward_tables(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words, 50)), "en", f"s{i % 2}", 1, i) for i in range(40)]
    rows += [(None, " ".join(rng.choice(words, 50)), None, None, 1, 7), (None, rows[3][1], "en", "s1", 1, 8), (5, rows[5][1], "en", "s1", 1, 9), (5, rows[5][1], "en", "s1", 1, 9)]
    rows += [(70, None, "en", "s0", 0, 1), (71, "", "en", "s0", 0, 1), (72, " ".join(f"long{i}" for i in range(30_000)), "en", "s0", 0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row long").withColumn("Decoded", F.lit("old")).withColumn("made", F.lit(1)).withColumn("mix_times", F.lit(2))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(70, 0, 0), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    for name, some in (("all", df), ("none", df.limit(0))):
        some.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    step = shared.documents(spark, f"{tmp_path}/all")
    for _, stage in corpus_pipeline.STAGES[:3]:
        step = stage(spark, step, f"{tmp_path}/all")
        assert step.columns == df.columns
    kept = Counter(r["text"] for r in step.collect())
    assert set(kept) == {t for _, t, *_ in rows if t} and set(kept.values()) == {1}
    out = corpus_pipeline.run(spark, f"{tmp_path}/all")
    assert {c.lower() for c in out.columns} == {c.lower() for c in df.columns} | {"token_ids", "n_tokens", "decoded"}
    assert all(r["text"] == r["decoded"] for r in out.collect())
