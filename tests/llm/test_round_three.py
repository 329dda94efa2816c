"""Packing, the divergence audit, fill-in-the-middle, and URLs of many segments."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import combinations_with_replacement

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from junctura.llm import divergence, fill_middle, fingerprints, id_files, language, packing, unit_encoder, url_templates
from junctura.llm.queries import tokenizer_path

EN = "the quick brown fox jumps over the lazy dog and then they were all of them happy "
LONG = " ".join(f"word{i % 997} Number{i}" for i in range(20_000))
TEXTS = [None, "", " ", EN, EN, EN + "ÉTÉ été", LONG, "a  b\n\n c\t d ", "<|endoftext|> hi", "😀 ’  x y\x1c z", "<P> no", "I'm it's' 12345 ...", "x" * 3000, "日本 語"]
ROWS = [(k if k != 4 else 3, t, ["en", "en", None, "de"][k % 4], [None, "s1", "s2"][k % 3]) for k, t in enumerate(TEXTS)] + [(None, EN, "en", "s1")]
EXTRA = ["part", "place", "piece", "start", "length", "rank", "base", "term", "terms", "n", "p", "q", "made", "row", "fim_text", "FIM_FORM", "sequence_id", "item", "value", "salt", "way", "once", "at", "size"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").select("*", *[F.lit(1).alias(x) for x in EXTRA])


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    own.no_truncation()
    own.no_padding()
    return own


@pytest.mark.parametrize("room", [2048, 16, 1])
def test_pieces_are_the_librarys_ids_and_sequences_have_no_gaps(docs, library, room):
    got = packing.packed(docs, tokenizer_path("byte_bpe_50k.json"), room, ids=True)
    rows = got.collect()
    want = Counter()
    for i, text, *_ in ROWS:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = (len(ids) - 1) % room + 1
        for k, stop in enumerate(range(first, len(ids) + 1, room)):
            cut = ids[max(0, stop - room) if k else 0 : stop]
            want[(i, k, stop - len(cut), len(cut), zlib.crc32(cut.tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"], r["ids"]))
    for parts in held.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= room
    whole = {r["sequence_id"]: (r["ids"], r["lengths"]) for r in packing.sequences(got).collect()}
    assert {k: ([i for p in sorted(v) for i in p[2]], [p[1] for p in sorted(v)]) for k, v in held.items()} == whole


def test_units_are_encoded_as_whole_texts(library):
    own = unit_encoder.UnitEncoder(tokenizer_path("byte_bpe_50k.json"))
    assert own.fast is not None
    rng = np.random.default_rng(5)
    letters = list("abcdefgABC  \n\n\t'’éÉßşǅ0 9٣.,!|ʼαжあ😀\x85 \x00")
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(letters, 40)) for _ in range(1500)]
    for kept in (10, unit_encoder.UNITS_KEPT):
        unit_encoder.UNITS_KEPT, before = kept, unit_encoder.UNITS_KEPT
        try:
            assert [i.tolist() for i in own.batches(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        finally:
            unit_encoder.UNITS_KEPT = before


def test_words_are_encoded_as_the_library_does():
    own = id_files.ChunkEncoder(tokenizer_path("word_bpe_49k.json"))
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDÀÉÖØßàéöøÿ"), rng.integers(1, 16))) for _ in range(3000)]
    got = own._plain(words)
    assert len(got) == len(set(words))
    assert all(np.frombuffer(ids, own.kind).tolist() == own.tokenizer.encode(w, add_special_tokens=False).ids for w, ids in got.items())


def test_knapsack_and_draws_are_those_of_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = np.unique(rng.integers(2, 13, 5))
        prices = rng.random(len(lengths))
        worth = packing.knapsack(prices, lengths, 14)
        best = 0.0
        for n in range(8):
            for chosen in combinations_with_replacement(range(len(lengths)), n):
                if lengths[list(chosen)].sum() <= 14:
                    best = max(best, prices[list(chosen)].sum())
        assert abs(worth[-1] - best) < 1e-12
        for chosen in packing.draw(worth, prices, lengths, np.ones(len(lengths)), rng, 16):
            assert lengths[chosen].sum() <= 14 and prices[chosen].sum() >= (1 - packing.SLACK) * best - 1e-12


def least_bins(items: list[int], room: int) -> int:
    best = len(items)

    def go(k: int, bins: list[int]) -> None:
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for i in {b: i for i, b in enumerate(bins) if b + items[k] <= room}.values():
            bins[i] += items[k]
            go(k + 1, bins)
            bins[i] -= items[k]
        go(k + 1, [*bins, items[k]])

    go(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_plans_hold_each_length_and_are_near_the_least(items):
    groups, bound = packing.planned(Counter(items), 20)
    held = Counter()
    for times, kinds in groups:
        assert times > 0 and sum(n * k for n, k in kinds) <= 20
        for n, k in kinds:
            held[n] += times * k
    least = least_bins(sorted(items, reverse=True), 20)
    assert held == Counter(items) and bound <= least + 1e-9 and sum(t for t, _ in groups) <= least + 1


def test_plans_beat_best_fit_where_lengths_are_awkward():
    rng = np.random.default_rng(2)
    histogram = Counter(rng.integers(600, 1100, 20_000).tolist())
    total = sum(t for t, _ in packing.planned(histogram)[0])
    plain = sum(t for t, _ in packing.best_fit([], histogram.items(), 2048))
    assert total < plain
    even = Counter({700: 1_000_000_000_000, 1348: 1_000_000_000_000, 2048: 5})  # counts beyond any task
    groups, bound = packing.planned(even)
    assert sum(t for t, _ in groups) == 1_000_000_000_005 == round(bound) and len(packing.blocks(groups)) < packing.bound_of_blocks(2048)


def test_packing_an_empty_table_and_one_length(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.packed(empty, tokenizer_path("byte_bpe_50k.json")).collect() == []
    hot = spark.createDataFrame([(k, None if k % 3 else "a b") for k in range(3000)], "doc_id long, text string").repartition(5)
    rows = packing.packed(hot, tokenizer_path("byte_bpe_50k.json"), 8).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 3000
    assert 625 <= len({r["sequence_id"] for r in rows}) <= 630  # 5000 ids, 8 in a sequence


def audit_by_hand(rows, least=10, top=10):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    counts, found, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in term.findall(text or "")]
        groups.add((lang or "", source or ""))
        counts[lang or "", source or ""].update(words)
        found[lang or ""].update(set(words))
    out = set()
    for lang, source in groups:
        kept = [t for t, n in found[lang].items() if n >= least]
        whole = sum((counts[g] for g in groups if g[0] == lang), Counter())
        total = lambda c: sum(c[t] for t in kept)  # noqa: B023, E731
        p = lambda c, t: 1 + 10**9 * (c[t] + 2) // (total(c) + 2 * len(kept))  # noqa: B023, E731
        far = lambda x, y: (x - y) ** 2 // (x + y)
        own = counts[lang, source]
        pairs = [(s, sum(far(p(own, t), p(counts[lang, s], t)) for t in kept)) for g, s in groups if g == lang and s != source]
        terms = [(t, far(p(own, t), p(whole, t))) for t in kept if own[t] and p(own, t) > p(whole, t)]
        for part, items, cut in (("pair", pairs, None), ("term", terms, top)):
            for k, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:cut], 1):
                out.add((lang, source, part, item, value, k))
    return out


def test_audit(spark, docs):
    rng = np.random.default_rng(3)
    words = ["Alpha", "beta", "éÉ", "z", "gamma9delta", "ЖЖ", "x_y", "😀k", "[up]"]
    rows = [(k if k % 5 else None, " ".join(rng.choice(words, rng.integers(0, 30), p=rng.dirichlet(np.ones(9)))), ["en", "de", None, ""][k % 4], [None, "a", "", "b", "c"][k % 5]) for k in range(200)]
    rows += [(1, None, "xx", "lone"), (1, "!!", "xx", "other"), (1, "rare", "xx", None), (1, "beta " * 70_000, "en", "a")]
    schema = "doc_id long, text string, lang string, source string"
    got = divergence.audit(spark.createDataFrame(rows, schema)).collect()
    assert {tuple(r) for r in got} == audit_by_hand(rows) and len(got) == len(audit_by_hand(rows))
    assert {tuple(r) for r in divergence.audit(docs, min_docs=2).collect()} == audit_by_hand(ROWS, 2)
    assert divergence.audit(spark.createDataFrame([], schema)).collect() == []


def test_shares_of_great_counts_are_exact(spark):
    rows = [(8_999_999_999, 10**12, 7), (9_000_000_000, 10**12, 7), (10**15 + 3, 10**16 + 9, 10**6), (0, 0, 1)]
    df = spark.createDataFrame(rows, "c long, n long, v long")
    got = [r[0] for r in df.select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).collect()]
    assert got == [1 + 10**9 * (c + 2) // (n + 2 * v) for c, n, v in rows]


def test_fill_in_middle(docs):
    rows = fill_middle.digests(docs).collect()
    want = Counter()
    for i, text, *_ in ROWS:
        text, digest = text or "", sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
        h, n = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)], len(text or "")
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        plain = not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90
        form = "plain" if plain else "spm" if h[3] % 100 < 20 else "psm"
        made = {"plain": text, "psm": f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}", "spm": f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"}[form]
        want[(i, n, form, None if plain else a, None if plain else b - a, sha256(made.encode()).hexdigest(), sha256(text.encode()).hexdigest())] += 1
    assert Counter(map(tuple, rows)) == want and {r["form"] for r in rows} == {"plain", "psm", "spm"} | {r["form"] for r in rows}


def test_fill_in_middle_of_other_units_and_columns(spark, docs):
    out = fill_middle.fill_in_middle(docs, unit="word")
    assert [c for c in out.columns if not c.startswith("fim_")] == [c for c in docs.columns if c.lower() not in fill_middle.MADE] and out.count() == len(ROWS)
    for unit, parted in (("word", r"\s+|\S+"), ("line", r"[^\n]*\n|[^\n]+")):
        text = "ab  c\nd é\n\n😀 <tail"
        ends = {0, *(m.end() for m in re.finditer(parted, text))}
        for k in range(300):
            form, n, prefix, middle, made = fill_middle.transformed(text, k, unit)
            assert n == len(text) and (form == "plain" or {prefix, prefix + middle} <= ends)
            assert form != "plain" or made == text
    made = spark.createDataFrame([fill_middle.transformed(text, k) for k in range(200)], "form string, n long, p long, m long, t string")
    assert {r[0] for r in made.select(fill_middle.restored(F.col("form"), F.col("t"))).collect()} == {text}
    empty = docs.limit(0)
    assert fill_middle.digests(empty).collect() == []
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(docs, unit="page")


def test_a_url_of_fifty_thousand_segments(spark):
    path = "/".join(f"s{i}" for i in range(50_000))
    rows = [(1, f"http://h.org/{path}"), *[(k, f"http://h.org/a/b{k % 7}") for k in range(2, 40)]]
    got = {r["page_id"]: r["template"] for r in url_templates.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert len(got) == 39 and got[1].count("/") == 50_000


def test_long_texts_of_other_scripts_are_unlike(monkeypatch):
    rng = np.random.default_rng(7)
    one, two = ("".join(map(chr, rng.integers(at, at + 3000, 300_000))) for at in (0x4E00, 0x5E00))
    kernel = language.Kernel([one])
    shared, n = kernel.presence(two, kernel.at)
    assert n > 590_000 and shared.sum() < 10
    whole = kernel.grams(one)
    monkeypatch.setattr(language, "BLOCK", 1000)
    assert (kernel.grams(one[:20_500]) == np.unique([x for x in language.Kernel([one[:20_500]]).at])).all() and len(whole) > 590_000
    assert len(kernel.grams("abcab")) == len({"a", "b", "c", "ab", "bc", "ca", "abc", "bca", "cab"}) and len(kernel.grams("")) == 0


def test_token_counts_of_null_repeated_and_long_rows(spark, library):
    from junctura.llm import attribution

    rows = [(None, EN + "\n" + EN), (None, EN + "\n" + EN), (4, "a\nb\n\nb"), (4, "a\nb\n\nb"), (5, LONG.replace("Number7 ", "\n")), (6, None), (None, ""), (7, "wörd\n" * 3000)]
    got = Counter((r["doc_id"], r["section"], r["start"], r["stop"], r["n_tokens"]) for r in attribution.by_section(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path("byte_bpe_50k.json")).collect())
    want = Counter()
    for i, text in rows:
        text = text or ""
        edges = [0, *[k + 1 for k, ch in enumerate(text) if ch == "\n"], len(text)]
        edges = np.array(edges[:-1] if len(edges) > 2 and edges[-1] == edges[-2] else edges)
        count = Counter()
        for a, b in library.encode(text, add_special_tokens=False).offsets:
            b = max(b, a + 1)
            low, high = (int(np.searchsorted(edges[1:-1], x, "right")) for x in (a, b - 1))
            count[max(range(low, high + 1), key=lambda k: (min(b, edges[k + 1]) - max(a, edges[k]), -k))] += 1  # noqa: B023
        for k in range(len(edges) - 1):
            want[(i, k, int(edges[k]), int(edges[k + 1]), count[k])] += 1
    assert got == want


def test_frequent_words_stay_when_a_sampler_is_full(monkeypatch):
    """What is kept changes no fingerprint, and words of every text are drawn once, however many rare ones pass."""
    rng = np.random.default_rng(3)
    often = [f"often{i}" for i in range(50)]
    texts = [" ".join(rng.permutation([*often, *often[:20], *(f"rare{k}_{i}" for i in range(40)), *(["twice"] * (k % 4))])) for k in range(60)]
    texts.insert(30, " ".join(f"one{i % 700}" for i in range(900)))  # more words than are kept
    whole = fingerprints.Sampler(64)
    expected = [whole.signature(t).tobytes() for t in texts]
    for name, value in (("TERMS_KEPT", 300), ("TERMS_LEFT", 100), ("WHOLE_KEPT", 30)):
        monkeypatch.setattr(fingerprints, name, value, raising=False)
    drawn, own = [], fingerprints.Sampler(64)
    add = own._add
    monkeypatch.setattr(own, "_add", lambda new: (drawn.extend(new), add(new))[1])
    assert [own.signature(t).tobytes() for t in texts] == expected
    assert sum(w.startswith("often") for w in drawn) <= 2 * len(often)  # the long text in the middle takes their places once
