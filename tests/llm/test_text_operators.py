"""Text operators: awkward tables, brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from hashlib import sha256
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from junctura.llm import attribution, bpe, fingerprints, host_rules, id_files, language, mixing, near_join, quality, shared, url_templates
from junctura.llm.queries import may_learn, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EN = "the quick brown fox jumps over the lazy dog and then they were all of them happy with this one thing "
DE = "der schnelle braune fuchs springt über den faulen hund und dann waren sie alle mit dieser sache glücklich "
LONG = " ".join(f"word{i % 997} number{i}" for i in range(30_000))
ROWS = [
    (1, None, "en", "a"), (2, "", None, None), (3, " \n\t ", "en", "a"), (4, EN * 3, "en", "a"), (4, EN * 3, "en", "a"), (5, EN * 3 + "tail", "en", "b"), (None, DE * 3, "de", "b"),
    (7, DE * 3, "de", None), (8, LONG, "en", "c"), (9, "one two three", "en", "c"), (10, "ONE two  three", "en", "c"), (11, "###$$$ 123 |||", "en", "a"), (12, "a\nb\n\nb\nb" * 30, "en", "a"),
    (13, "😀 <|endoftext|> ’ \u00a0x\u2003y \r\n\r\n z  q", "en", "c"), (14, "it was " + "the same " * 60, "en", "c"),
]
#: Names that the operators use inside, as further columns.
EXTRA = ["host", "row", "w", "t", "lines", "n_words", "score", "node", "token", "part", "size", "key", "name", "range", "taken", "mix_id", "stay_id", "label", "label_id", "bpe_out", "kind", "page_id", "start"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame([(*r, len(r[1] or "")) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return rows.select("*", *[F.lit(1).alias(x) for x in EXTRA])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1), (5, 1), (7, 1), (12, 0), (14, 0), (11, 0), (None, 1), (4, None), (99, 1)], "doc_id long, quality int")


@pytest.fixture(scope="module")
def byte_bpe():
    return tokenizer_path("byte_bpe_50k.json")


def test_host_rules(docs):
    got = [r for r in host_rules.judge(docs).collect()]
    assert len(got) == len(ROWS)
    want = []
    for _, text, _, source in ROWS:
        text = text or ""
        w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        at, covered = {}, set()
        for i in range(len(w) - 7):
            at.setdefault(tuple(w[i : i + 8]), []).append(i)
        for places in at.values():
            covered |= {i + k for i in places for k in range(8) if len(places) > 1}
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        want.append((source, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed))
    found = [(r["host"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_bad_hosts_go_and_few_documents_do_not_condemn_one(spark):
    good = [(i, EN + str(i), "h1") for i in range(60)]
    bad = [(100 + i, "short", "h2") for i in range(50)] + [(200, " ".join(f"w{k}" for k in range(40)), "h2")]
    rare = [(300, "short", "h3"), (301, EN, "h3")]
    out = {r["doc_id"]: r["kept"] for r in host_rules.judge(spark.createDataFrame(good + bad + rare, "doc_id long, text string, source string")).collect()}
    assert out[5] and not out[200] and not out[300]


def test_quality_ranks(spark):
    rng = np.random.default_rng(3)
    words = EN.split()
    rows = []
    for i in range(240):
        text = " ".join(rng.choice(words, 60))
        rows.append((i, text if i % 3 else " ".join(x + "$$$ ###" for x in text.split()), 1 if i % 3 else 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = {r["doc_id"]: r for r in quality.judge(df, df, may_learn).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i]["predicted"] == (1 if i % 3 else 0) for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())


def test_quality_of_awkward_rows(docs, labels):
    got = quality.judge(docs, labels, may_learn).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality.judge(docs, labels.limit(0), may_learn).collect()} == {0.5}
    assert set(quality.keep(docs, labels.limit(0), may_learn).columns) == set(docs.columns)


def test_mix(docs):
    got = mixing.mixed(docs).collect()
    assert len(got) == len(ROWS) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    sizes = Counter()
    for _, text, _, source in ROWS:
        sizes[source] += len(WORD.findall(text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, open_, left = {s: 1 + k % 3 for k, s in enumerate(order)}, set(order), sum(sizes.values())
    target = {}
    while True:  # reshare until none is above
        share = left / sum(weight[s] for s in open_) if open_ else 0
        above = {s for s in open_ if 3 * sizes[s] <= share * weight[s]}
        if not above:
            break
        for s in above:
            target[s] = 3.0 * sizes[s]
            left -= 3 * sizes[s]
        open_ -= above
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    by_target = Counter()
    for r in got:
        by_target[(r["source_size"], round(r["target"], 6))] += r["taken"]
    assert by_target == Counter({(sizes[s], round(t, 6)): int(t) for s, t in target.items()})
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed(docs).collect()))


def test_language(spark, docs):
    rows = [(i, " ".join(np.random.default_rng(i).permutation((EN if i % 2 else DE).split())[: 8 + i % 9]), "en" if i % 2 else "de") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(df, may_learn).collect()}
    held = [i for i in range(120) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i] == ("en" if i % 2 else "de") for i in held)
    odd = language.identify(docs, may_learn).collect()
    assert len(odd) == len(ROWS) and all(0 <= r["score"] <= 1 for r in odd)
    assert [r["lang_pred"] for r in odd if r["doc_id"] in (1, 2, 3)] == ["und"] * 3
    assert {r["lang_pred"] for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string")), may_learn).collect()} == {"und"}


def test_kernel_is_shared_presence():
    texts = ["abcab", "bcd ab", "xyz"]
    kernel = language.Kernel(texts)
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    model = language.Model(texts, ["x", "y", "z"])
    want = [[len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b))) for b in texts] for a in texts]
    assert kernel.presence(texts[0])[1] == len(grams(texts[0]))
    assert np.allclose(model._kernel(texts), want, atol=1e-6)


def test_fingerprints(docs):
    got = fingerprints.against_next(docs).collect()
    order = sorted(range(len(ROWS)), key=lambda i: (ROWS[i][0] is not None, ROWS[i][0] or 0, ROWS[i][1] or ""))
    want = []
    for k, i in enumerate(order):
        text, following = ROWS[i][1] or "", ROWS[order[(k + 1) % len(order)]][1] or ""
        n = len(text) // 4
        want.append((ROWS[i][0], len(text), sha256((text[: len(text) - n] + following[:n]).encode()).hexdigest()))
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == Counter(want)
    same = [r["fingerprint"] for r in got if r["doc_id"] == 4]
    assert same[0] == same[1]


def test_likeness_is_generalised_jaccard():
    rng, own = np.random.default_rng(1), fingerprints.Sampler(512)
    off = []
    for _ in range(12):
        a, b = (" ".join(f"w{x}" for x in rng.integers(0, 60, 120)) for _ in "ab")
        ca, cb = Counter(a.split()), Counter((b + " " + a).split())
        truth = sum((ca & cb).values()) / sum((ca | cb).values())
        off.append(fingerprints.likeness(own.signature(a), own.signature(b + " " + a)) - truth)
    assert abs(np.mean(off)) < 0.03 and np.max(np.abs(off)) < 0.12


def test_sections_hold_every_token_once(docs, byte_bpe):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(byte_bpe)
    got = attribution.by_section(docs.filter("doc_id < 20 and doc_id <> 8 and doc_id <> 4"), byte_bpe).collect()
    for i, text, _, _ in ROWS:
        if i is None or i in (4, 8):
            continue
        text = text or ""
        edges = [0, *[k + 1 for k, ch in enumerate(text) if ch == "\n"], len(text)]
        edges = edges[:-1] if len(edges) > 2 and edges[-1] == edges[-2] else edges
        count = Counter()
        for a, b in lib.encode(text, add_special_tokens=False).offsets:
            b = max(b, a + 1)
            parts = [max(0, min(b, y) - max(a, x)) for x, y in zip(edges, edges[1:])]
            count[parts.index(max(parts))] += 1
        mine = {r["section"]: r["n_tokens"] for r in got if r["doc_id"] == i}
        assert mine == {k: count[k] for k in range(len(edges) - 1)}


def test_bpe_is_the_librarys(spark, docs, byte_bpe):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(byte_bpe)
    rng = np.random.default_rng(5)
    bits = ["a", "the", "ing", " ", "  ", "\n", "\t", "é", "ß", "😀", "'s", "'ll", "12", "\x1c", "\x85", "\u00a0", "<|endoftext|>", "e\u0301", "!!", "...", "zz", "한", "\r\n", "\0"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 30))) for _ in range(1500)] + ["z" * 300, "aaab" * 500, "!" * 99, ""] + [r[1] or "" for r in ROWS]
    own = bpe.load(byte_bpe)
    for text, packed in zip(texts, own.batches(texts), strict=True):
        ids = np.frombuffer(packed, "<u4")
        assert ids.tolist() == lib.encode(text, add_special_tokens=False).ids
        assert own.decode(ids).decode() == text
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(docs, byte_bpe).collect()}
    want = set()
    for i, text, _, _ in ROWS:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        want.add((i, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256((text or "").encode()).hexdigest()))
    assert got == want
    few = bpe.tokenized(docs.filter("doc_id = 9 or doc_id = 1"), byte_bpe)
    assert {r["doc_id"]: r["decoded"] for r in few.collect()} == {9: "one two three", 1: ""}


def test_what_is_remembered_changes_nothing(byte_bpe, monkeypatch):
    texts = [f"alpha{i} beta{i % 7} gamma delta{i % 11}\nomega{i}" for i in range(300)]
    want = list(bpe.ByteBpe(byte_bpe).batches(texts))
    monkeypatch.setattr(bpe, "UNITS_KEPT", 20)
    monkeypatch.setattr(bpe, "BATCH_CHARS", 200)
    assert list(bpe.ByteBpe(byte_bpe).batches(texts)) == want


def brute(rows):
    sets = []
    for i, text, *_ in rows:
        w = WORD.findall("".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in text or ""))
        sets.append((i, frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset()))
    root = list(range(len(sets)))
    for _ in range(4):
        for a in range(len(sets)):
            for b in range(len(sets)):
                x, y = sets[a][1], sets[b][1]
                if x and y and 100 * len(x & y) >= 85 * len(x | y):
                    root[a] = root[b] = min(root[a], root[b])
    least = {}
    for (i, s), r in zip(sets, root, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, len(s), least.get(r) if s else i) for (i, s), r in zip(sets, root, strict=True)), key=str)


def test_near_copies_are_those_of_brute_force(spark, docs, monkeypatch):
    few = [r for r in ROWS if r[0] != 8]
    got = near_join.components(docs.filter("doc_id is null or doc_id <> 8"))
    assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()], key=str) == brute(few)
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(70):  # a chain of copies, with short lists, small groups and blocks, so that all ways are gone
        text = list(base)
        for k in rng.integers(0, 80, rng.integers(0, 4)):
            text[k] = f"x{rng.integers(0, 50)}"
        rows.append((i, " ".join(text)))
    for name, value in (("LIST", 4), ("GROUP", 8), ("BLOCK", 4), ("FREQUENT", 30)):
        monkeypatch.setattr(near_join, name, value)
    got = near_join.components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()], key=str) == brute(rows)


def groups_of(rows, words, percent):
    """(places, shingles) of each group of near copies among ``rows`` (id, text), by brute force."""
    sets = []
    for _, text in rows:
        w = text.split()
        sets.append(frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))))
    near = [[100 * len(x & y) >= percent * len(x | y) for y in sets] for x in sets]
    root = list(range(len(sets)))
    for _ in rows:
        root = [min(root[b] for b in range(len(sets)) if near[a][b]) for a in range(len(sets))]
    return root, [len(s) for s in sets]


def test_the_pipelines_near_copies_have_five_words_and_80_percent(spark, monkeypatch):
    import corpus_pipeline

    word = lambda name, n: [f"{name}{i}" for i in range(n)]
    rows = [(1, word("a", 60)), (2, word("a", 60) + word("b", 12)), (3, word("c", 60)), (4, word("c", 60) + word("d", 15))]  # 56 of 68 (0.82), 56 of 71 (0.79)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.ngram_jaccard_join(spark, df, "").collect()) == [1, 3, 4]
    assert sorted(r["doc_id"] for r in near_join.keep(df).collect()) == [1, 2, 3, 4]
    rng = np.random.default_rng(3)
    rows = []
    for i in range(70):
        text = word("w", 80)
        for k in rng.integers(0, 80, rng.integers(0, 5)):
            text[k] = f"x{rng.integers(0, 50)}"
        rows.append((i, " ".join(text[: 80 - rng.integers(0, 12)])))
    for name, value in (("LIST", 4), ("GROUP", 8), ("BLOCK", 4), ("FREQUENT", 30)):
        monkeypatch.setattr(near_join, name, value)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    root, size = groups_of(rows, 5, 80)
    assert root != groups_of(rows, 4, 85)[0] and len(set(root)) > 1
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in near_join.components(df, words=5, percent=80).collect()}
    assert got == {i: (root[i], size[i]) for i in range(70)}


def test_the_lists_to_share_follow_from_the_percent(spark):
    n = np.arange(1, 500)
    df = spark.createDataFrame([(int(x),) for x in n], "n long")
    for percent in (50, 80, 85, 99, 100):
        t, k = near_join.t_of(n, percent), near_join.k_of(n, percent)
        got = df.select(near_join.t_column(F.col("n"), percent).alias("t"), near_join.k_column(F.col("n"), percent).alias("k")).toPandas()
        assert got["t"].tolist() == t.tolist() and got["k"].tolist() == k.tolist()
        assert (k >= 1).all() and (k <= t).all() and (np.diff(k) >= 0).all()
    assert (near_join.k_of(n) == 1 + n * 3 // 20).all()


def test_near_copies_without_an_id_are_linked(spark):
    word = lambda name, n: [f"{name}{i}" for i in range(n)]
    a, b = word("a", 60), word("b", 60)
    texts = [(5, a), (None, [*a, "more"]), (None, b), (None, [*b, "more"]), (None, word("c", 30)), (9, word("d", 30))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_join.components(df).collect()), key=str)
    assert got == brute([(i, " ".join(w)) for i, w in texts])
    kept = [r["text"].split()[0] for r in near_join.keep(df).collect()]
    assert sorted(kept) == ["a0", "b0", "c0", "d0"]


def test_one_of_each_group_stays(docs):
    kept = near_join.keep(docs.filter("doc_id is null or doc_id <> 8"))
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i) == [1, 2, 3, 4, 7, 9, 11, 12, 13, 14]


def test_divide_skip_finds_all():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, rng.integers(20, 40)).astype(np.uint64)) for _ in range(50)]
    sets += [np.unique(np.append(s[1:], np.uint64(99))) for s in sets[:20]]
    group = near_join.Group(np.arange(len(sets)), sets, np.arange(len(sets)))
    found = {(x, y) for x in range(len(sets)) for y in group.candidates(x)[0].tolist()}
    near = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))
    assert found == {(x, y) for x in range(len(sets)) for y in range(x + 1, len(sets)) if near(sets[x], sets[y])}


def test_id_files(docs):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer_path("word_bpe_49k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in id_files.round_trip(docs, path, 2).collect()))
    at, want = 0, []
    for i, text, *_ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((at, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_codes_come_back():
    for values in ([], [0], [255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], list(range(3000))):
        array = np.array(values, "<u4")
        assert id_files.unpack(*id_files.pack(array), len(array)).tolist() == values


def test_urls(spark):
    urls = [None, "", "no-scheme.com/en/1", "http://A.Example.COM/en/5?q=1", "https://www.example.com/en/x#f", "x://shop.net/es/1", "x://shop.net/de/1", "x://org.org/a/b/c/d/e", "x://h.com", "x://h.com?a/b"]
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_templates.judge(df).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.com", "/en/5", "example.com/en/", "block")
    assert got[4] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[5][2:] == ("net/es/", "block") and got[6][2:] == (None, "allow") and got[7][2:] == (None, "allow")
    assert got[8] == ("h.com", "", None, "allow") and got[9] == ("h.com", "", None, "allow")


def test_templates_reject_what_labels_show(spark):
    rows = [(k, f"http://s.net/shop/{k}/buy") for k in range(40)] + [(100 + k, f"http://s.net/news/{k}") for k in range(9)]
    rules = [("block", f"s.net/shop/{k}/") for k in range(30)]
    got = {r["page_id"]: r["verdict"] for r in url_templates.judge(spark.createDataFrame(rows, "page_id long, url string"), rules=rules).collect()}
    assert got[35] == "block" and got[103] == "allow"


def test_empty_tables(spark, docs, labels, byte_bpe):
    none = docs.limit(0)
    pages = spark.createDataFrame([], "page_id long, url string")
    frames = [
        host_rules.judge(none), host_rules.keep(none), quality.judge(none, labels, may_learn), mixing.mixed(none), mixing.take(none), language.identify(none, may_learn),
        fingerprints.against_next(none), attribution.by_section(none, byte_bpe), bpe.round_trip(none, byte_bpe), near_join.components(none), near_join.keep(none),
        id_files.round_trip(none, tokenizer_path("word_bpe_49k.json"), 2), url_templates.judge(pages),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_pipeline_is_its_stages(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(90):
        text = " ".join(rng.choice(words, 60)) if i % 9 else " ".join(rng.choice(words, 40)).replace(" ", "$$$ ### ")
        rows.append((i, text if i not in (20, 21) else rows[19][1], "en", f"s{i % 3}", len(text)))
    rows.append((90, "too short", "en", "s0", 9))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0 if i % 9 == 0 else 1, 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    step = shared.documents(spark, str(tmp_path))
    for _, stage in corpus_pipeline.STAGES[:3]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == df.columns
    kept = {r["doc_id"] for r in step.collect()}
    assert kept == {i for i in range(90) if i % 9 and i not in (20, 21)}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    times = Counter(r["doc_id"] for r in out)
    assert set(times) <= kept and max(times.values()) <= 3 and all(r["decoded"] == r["text"] and len(r["token_ids"]) == r["n_tokens"] for r in out)
    total = sum(len(rows[i][1].split()) for i in kept)
    assert abs(sum(len(r["text"].split()) for r in out) - total) < 0.1 * total


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["op2_quality_rules", "op3_mixing", "op8_ngram_jaccard_join", "op10_url_filters"])
def test_query_gives_what_its_sql_gives(spark, name):
    import duckdb

    from junctura.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for f in Path("/root/testdata/sf0.001").glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.sql(ORACLES[name]).df()
    got = QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
    rows = lambda d: sorted(tuple("null" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in d[sorted(d.columns)].itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
