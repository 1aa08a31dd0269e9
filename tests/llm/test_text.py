import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrove.llm.bpe import VOCABULARY, count_tokens, encode_corpus, load_merges, replay
from tallygrove.llm.mixing import mix_report, mix_sources
from tallygrove.llm.subjects import Descent, Settings, Slice, Weights, _sigmoid, document_areas, fit_areas, sentences

ODD = [
    None, "", " ", "   \n\t ", "Hello world", "aaaaaaaaaaaaaaaa", "it's IT'S we'll", "<|endoftext|> x", "naïve ThÃ© 漢字 😀🇪🇺 ​﻿", "a" * 5000, "ab " * 4000, "1,234.567e-8", "\x00\x1f", " x y",
]


@pytest.fixture(scope="module")
def public():
    tokenizers = pytest.importorskip("tokenizers")
    made = tokenizers.Tokenizer.from_file(VOCABULARY)
    made.encode_special_tokens = True
    return lambda text: made.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_public_library(spark, public):
    rng = random.Random(1)
    letters = "abc déßöñ'’.,!?\n\t 019漢😀<|>_-"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 200))) for _ in range(400)]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    got = {r.doc_id: r.ids for r in encode_corpus(df).collect()}
    assert got == {i: public(t) for i, t in enumerate(texts)}
    sizes = {r.doc_id: r.n_tokens for r in count_tokens(df).collect()}
    assert sizes == {i: len(v) for i, v in got.items()}
    assert encode_corpus(df.limit(0)).count() == 0


def test_many_slices_and_pieces(spark, public, monkeypatch):
    for name, value in (("SLICE_BYTES", 300), ("INDEX_WORDS", 7), ("PIECE", 20)):
        monkeypatch.setattr(f"tallygrove.llm.bpe.{name}", value)
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["lorem", "ipsum", "Dolor!", "sit", "42", "ämet"]) for _ in range(rng.randrange(0, 90))) for _ in range(60)] + ["x " * 500, None]
    df = spark.createDataFrame([((i, "a"), t) for i, t in enumerate(texts)], "id struct<n:int,s:string>, text string").repartition(2)
    got = encode_corpus(df, "id").collect()
    assert {r.id.n: r.ids for r in got} == {i: public(t) for i, t in enumerate(texts)} and len(got) == len(texts)


def test_whole_corpus_table(spark, smoke_dir, public):
    docs = spark.read.parquet(f"{smoke_dir}/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: public(r.text) for r in docs.collect()}
    assert {r.doc_id: r.ids for r in encode_corpus(docs).collect()} == want


def test_replay_is_order_free_and_round_trips():
    of_byte, merges = load_merges(VOCABULARY)
    back = {i: bytes([b]) for b, i in enumerate(of_byte)}
    for pair, (_, made) in sorted(merges.items(), key=lambda m: m[1]):
        back[made] = back[pair >> 20] + back[pair & 0xFFFFF]
    words = [b" the", b"", b"lowering", b"aaaaaaa", bytes(range(256)), b"abab" * 50]
    got = replay(words, of_byte, merges)
    assert [b"".join(back[i] for i in ids) for ids in got] == words
    assert replay(words[::-1], of_byte, merges)[::-1] == got == [replay([w], of_byte, merges)[0] for w in words]


DOCS = "doc_id long, text string, source string, copies int"
TARGETS = "source string, target_weight double, max_repeats int"


def corpus(spark, n=1500, seed=0):
    rng = random.Random(seed)
    names = ["big"] * 10 + ["mid"] * 4 + ["small", None, "other"]
    rows = [(i, " ".join(["word"] * rng.choice([1, 3, 20, 90, 300])) if rng.random() > 0.02 else rng.choice(["", None]), rng.choice(names), 0) for i in range(n)]
    return spark.createDataFrame(rows, DOCS).repartition(4)


def test_mix_meets_weights_and_caps(spark):
    docs = corpus(spark)
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 4), ("gone", 0.05, 4)], TARGETS)
    mix = mix_sources(docs, targets).cache()
    report = {r.source: r for r in mix_report(mix, targets).collect()}
    for s, w in (("big", 0.5), ("mid", 0.3), ("small", 0.15)):
        # within one document of the target
        assert abs(report[s].mixed_tokens - report["small"].mixed_tokens / 0.15 * w) <= 301 + 301 * w / 0.15
        assert report[s].most_uses <= report[s].max_repeats
    assert report["small"].most_uses == 4  # the binding cap: every small document that often
    assert report["gone"].copies == 0 and report["other"].copies == 0 and report[None].copies == 0
    rows = mix.collect()
    assert len(rows) == 1500 and all(r.copies == 0 for r in rows if r.n_tokens == 0)
    assert all(r.copies in (int(np.floor(r.rate + 1e-9)), int(np.floor(r.rate)) + 1) for r in rows if r.source in ("big", "mid"))
    again = {(r.doc_id, r.copies) for r in mix_sources(docs.orderBy(F.rand(2)), targets).collect()}
    assert again == {(r.doc_id, r.copies) for r in rows}


def test_mix_total_and_edges(spark):
    docs = corpus(spark, 600, 1)
    targets = spark.createDataFrame([("big", 2.0, 1), ("mid", 2.0, 3), (None, 1.0, 1), ("small", None, 2)], TARGETS)
    mix = mix_sources(docs, targets, total_tokens=10_000)
    report = {r.source: r for r in mix_report(mix, targets.where("source is not null")).collect()}
    assert abs(report["big"].mixed_tokens - 5000) <= 301 and abs(report["mid"].mixed_tokens - 5000) <= 301 and report["small"].copies == 0
    assert mix_sources(docs.limit(0), targets).count() == 0
    assert mix_sources(docs, targets.limit(0)).agg(F.sum("copies")).first()[0] == 0


def test_sentences():
    assert sentences("One two. Three!\nFOUR 4.5 five?six") == [["one", "two"], ["three"], ["four", "five", "six"]]
    assert sentences(None) == sentences("") == sentences(" .. 12 \n") == []


WORDS = {"tea": "kettle brew leaf cup steep", "rail": "track engine wagon signal platform", "sea": "wave tide harbour anchor sail"}


def area_corpus(n, seed=0):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        own = rng.sample(sorted(WORDS), rng.choice([0, 1, 1, 1, 2]))
        parts = [f"the {' '.join(rng.sample(WORDS[a].split(), 3))} was noted" for a in own for _ in range(3)] + ["nothing else was said"] * rng.randrange(3)
        rng.shuffle(parts)
        rows.append((i, ". ".join(parts), own))
        labels += [(i, a, "r") for a in own]
    return rows, labels


def test_areas_on_unseen_documents(spark):
    rows, labels = area_corpus(600)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, area string").repartition(3)
    marks = spark.createDataFrame(labels[: len(labels) // 2] + [(10**9, "tea", "r"), (1, "none such", "r")], "doc_id long, area string, reviewer string")
    s = Settings(buckets=1 << 12, slices=2, shards=2)
    w = fit_areas(docs, marks, sorted(WORDS), s)
    extra = spark.createDataFrame([(-1, None, ""), (-2, "", ""), (-3, "  ", ""), (-4, "12 34", "")], "doc_id long, text string, area string")
    got = {}
    for r in document_areas(docs.unionByName(extra), w, s).collect():
        got.setdefault(r.doc_id, set()).add(r.area)
    assert not {-1, -2, -3, -4} & set(got)
    unseen = [(i, set(own)) for i, _, own in rows[320:]]
    right = sum(got.get(i, set()) == own for i, own in unseen)
    assert right / len(unseen) > 0.95
    # without labels no area is ever given
    blank = fit_areas(docs, marks.limit(0), sorted(WORDS), s)
    assert document_areas(docs, blank, s).count() == 0 and document_areas(docs.limit(0), w, s).count() == 0


def test_gradient_is_the_slope_of_the_loss_and_shards_add_up():
    s = Settings(buckets=64, width=4)
    names = [f"a{i}" for i in range(70)]  # more areas than bits of a number
    docs = [([["tea", "leaf", "cup"], ["rail"]], [0, 69]), ([["wave", "tide", "tea", "harbour", "sail"]], [3]), ([["nothing"]], [])]
    w = Weights.fresh(s, names)
    w.out[:] = np.random.default_rng(0).normal(size=w.out.shape)

    def loss(w):
        total = 0.0
        for parts, own in docs:
            y = np.isin(np.arange(70), own)
            for p in parts:
                one = Slice.of([([p], own)], s)
                vec = np.add.reduceat(w.rows[one.buckets].astype(float), np.cumsum(one.counts) - one.counts, axis=0) / one.counts[:, None]
                q = _sigmoid(vec[one.words].sum(axis=0) / max(len(p), s.short) @ w.out + w.bias)
                total -= np.log(np.where(y, q, 1 - q)).sum()
        return total

    at, rows, out, bias = Slice.unpack(Slice.of(docs, s).pack()).gradient(w, s, False)
    for a, b, part in ((at[0], 1, "rows"), (2, 69, "out"), (3, None, "bias")):
        slope, base = [], getattr(w, part).copy()
        for d in (1e-2, -1e-2):
            moved = base.copy()
            moved[(a, b) if b is not None else a] += d
            slope.append(loss(Weights(**{"rows": w.rows, "out": w.out, "bias": w.bias, part: moved}, areas=names)))
        want = {"rows": rows[0, 1], "out": out[2, 69], "bias": bias[3]}[part]
        assert (slope[0] - slope[1]) / 2e-2 == pytest.approx(want, rel=2e-2, abs=1e-3)
    one, two = Descent(w, s), Descent(w, s)
    one.move([Slice.of(docs, s).gradient(w, s, False)], 4)
    two.move([Slice.of(docs[:1], s).gradient(w, s, False), Slice.of(docs[1:], s).gradient(w, s, False)], 4)
    assert np.abs(one.w.rows - two.w.rows).max() < 2e-3 and np.abs(one.w.bias - two.w.bias).max() < 1e-3
