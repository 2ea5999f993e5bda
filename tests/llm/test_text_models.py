"""Quality, language and language-model scores."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from ledgerloom.llm import language, language_model, quality, textkit


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))


# --- bytes ------------------------------------------------------------------


def test_words_of_many_texts():
    texts = [None, "", "a", "B c\x0bd\ne", " é x ", "y", "z" * 50]
    data, offsets = textkit.text_bytes(pa.array(texts))
    starts, ends, rows = textkit.word_spans(data, offsets)
    got = [(int(r), bytes(data[a:b])) for r, a, b in zip(rows, starts, ends)]
    want = [(i, w.encode()) for i, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    assert got == want
    hashes, _ = textkit.word_hashes(*textkit.text_bytes(pa.array(["Ab ab", "xx AB"])))
    assert hashes[0] == hashes[1] == hashes[3] != hashes[2]


def test_slices_keep_all_rows():
    batch = pa.record_batch([pa.array(range(6)), pa.array(["a" * 9, None, "b" * 50, "", "c", "d" * 3])], names=["id", "text"])
    parts = list(textkit.text_slices([batch, batch.slice(0, 0)], limit=10))
    assert [i for p in parts for i in p.column("id").to_pylist()] == list(range(6)) and len(parts) > 2


# --- quality ----------------------------------------------------------------


def test_interactions_equal_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    f = quality.features(pa.array(["one two two three", "", None, "x! y? z"]), pa.array([17.0, 0.0, None, 7.0]))
    size = quality.N_STATS + quality.BUCKETS
    model = quality.Model(0.3, rng.normal(size=size).astype("f4"), rng.normal(size=(size, 3)).astype("f4"), f.stats.mean(0), f.stats.std(0) + 1)
    got = model.logits(f)
    for i in range(4):
        dense = np.clip((f.stats[i] - model.mean) / model.spread, -6, 6)
        x = np.concatenate([dense, f.value[f.at[i] : f.at[i + 1]]])
        where = np.concatenate([np.arange(quality.N_STATS), f.bucket[f.at[i] : f.at[i + 1]] + quality.N_STATS])
        v = model.factor[where]
        want = model.bias + x @ model.weight[where]
        want += sum(float(v[a] @ v[b]) * x[a] * x[b] for a in range(len(x)) for b in range(a))
        assert math.isclose(got[i], want, rel_tol=1e-3, abs_tol=1e-3)


def test_quality_learns_and_keeps(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, 60) if i % 4 else words(rng, 60).upper().replace(" ", "!! "), 400) for i in range(400)]
    docs = spark.createDataFrame(rows + [(900, None, None), (901, "", 0), (None, words(rng, 20), 5)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    scores = {r.doc_id: r for r in quality.score_quality(docs, model).collect()}
    assert all((scores[i].score >= 0.5) == (i % 4 > 0) for i in range(300, 400))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in scores.values())
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in scores.items() if r.predicted}
    untaught = quality.fit_quality(docs, labels.limit(0))
    assert {r.score for r in quality.score_quality(docs, untaught).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), model).count() == 0


# --- language ---------------------------------------------------------------


def test_ranked_ngrams_count_padded_words():
    text = "Ab ab-b é"
    rows, hashes, counts = language.ranked_ngrams([None, text])
    padded = [f" {w} " for w in ("ab", "ab", "b", "é")]
    want = Counter(w[i : i + n] for w in padded for n in (1, 2, 3) for i in range(len(w) - n + 1) if w[i : i + n].strip())
    assert set(rows.tolist()) == {1} and sorted(counts.tolist()) == sorted(want.values())


def test_languages(spark):
    rng = random.Random(3)
    alphabets = {"aa": "abcdeo", "bb": "stuvwo", "cc": "ñlmnio"}
    rows = [(i, words(rng, 30, alphabets[l]), l) for i, l in enumerate(list(alphabets) * 60)]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 !?", "cc"), (903, words(rng, 2, "stuv"), None), (None, words(rng, 9, "lmni"), "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language.learn_profiles(docs.filter("doc_id < 120"), sample=20)
    got = {r.doc_id: r for r in language.identify(docs, profiles).collect()}
    assert all(got[i].lang_pred == l for i, t, l in rows if i is not None and i < 900)
    assert [got[i].lang_pred for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "bb", "cc"]
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = language.learn_profiles(docs.limit(0))
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}


def _plain_ranks(texts):
    """The n-grams of texts as strings, most frequent first, with nothing but a counter; equal counts by the library's hash."""
    counts = Counter()
    for text in texts:
        for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
            padded = f" {word} "
            counts.update(padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1))
    del counts[" "]

    def number(gram):
        code = 0
        for c in gram:
            code = code << 21 | ord(c)
        return int(textkit.mix(np.array([code + len(gram)], np.uint64))[0]) >> 24

    ranked = sorted(counts, key=lambda g: (-counts[g], number(g)))[: language.PROFILE]
    return {g: i for i, g in enumerate(ranked)}


def test_out_of_place_distance_against_a_plain_one(spark):
    rng = random.Random(8)
    alphabets = {"aa": "abcdefgh", "bb": "defghijk", "cc": "àéîõüßñö", "dd": "abcxyz"}
    known = [(i, words(rng, rng.randint(1, 120), alphabets[lang]), lang) for i, lang in enumerate(list(alphabets) * 12)]
    mixed = [words(rng, rng.randint(1, 60), alphabets[rng.choice("abcd") * 2] + rng.choice(["", "qrs", "XYZ"])) for _ in range(60)]
    asked = [*mixed, "", None, "12 3!", "a", "A-b_c.D", " zz  zz\n", "ab " * 3000, mixed[0], "\U0001f600 da \U00010400", known[3][1]]
    docs = spark.createDataFrame(known, "doc_id long, text string, lang string")
    profiles = language.learn_profiles(docs, sample=1000)
    plain = {lang: _plain_ranks([t for _, t, own in known if own == lang]) for lang in sorted(alphabets)}
    queries = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(queries, profiles).collect()}
    assert len(got) == len(asked)
    for i, text in enumerate(asked):
        ranks = _plain_ranks([text])
        if not ranks:
            assert got[i] == ("und", 0.0)
            continue
        apart = {lang: sum(abs(p[g] - k) if g in p else language.PROFILE for g, k in ranks.items()) for lang, p in plain.items()}
        best = min(apart, key=lambda lang: (apart[lang], lang))
        assert got[i][0] == best, (text, apart)
        assert math.isclose(got[i][1], 1 - apart[best] / (len(ranks) * language.PROFILE), abs_tol=1e-12)


# --- language model ---------------------------------------------------------


def test_filter_counts_are_never_below_the_level():
    rng = np.random.default_rng(4)
    values = np.unique(rng.integers(0, 1 << 48, 30_000).astype(np.uint64))
    counts = rng.integers(1, 200, len(values))
    parts, segments = {}, 7
    own = language_model._segment(values, language_model.FINGERPRINT, segments)
    for s in range(segments):
        parts[s] = language_model.filter_bits(values[own == s], counts[own == s])
    found = language_model.FrequencyFilter(parts, segments).counts(values)
    low = 2.0 ** np.floor(np.log2(counts))
    assert (found >= low).all() and (found > low).mean() < 0.05
    strangers = language_model.FrequencyFilter(parts, segments).counts(rng.integers(0, 1 << 48, 30_000).astype(np.uint64))
    assert (strangers > 0).mean() < 0.05


def test_scores(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    vocabulary = words(rng, 40).split()
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, "never Seen Before"), (403, vocabulary[0].upper()), (None, "x y"), (7, rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    got = language_model.score_texts(docs, train).collect()
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + [None]
    counts = Counter(w for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (str(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 6))
        for i, t in rows
    )
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    untaught = language_model.score_texts(docs, F.lit(False)).collect()
    assert len(untaught) == len(rows) and {r.base_score for r in untaught} == {0.0}
    assert language_model.score_texts(docs.limit(0), train).count() == 0


def test_filter_grows_with_the_entries(spark, monkeypatch):
    from pyspark.sql import functions as F

    # Several blocks and segments, and one group of parts after the other.
    monkeypatch.setattr(language_model, "BLOCK_BYTES", 10_000)
    monkeypatch.setattr(language_model, "SEGMENT_BYTES", 5_000)
    monkeypatch.setattr(language_model, "GROUP_BYTES", 1_500)
    rng = random.Random(6)
    vocabulary = words(rng, 300).split()
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(40))) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in language_model.score_texts(docs, F.col("doc_id") % 4 != 0).collect()}
    tokens = {i: t.lower().split() + [None] for i, t in rows}
    pairs = {i: list(zip([None, *t], t)) for i, t in tokens.items()}
    c1 = Counter(w for i, t in tokens.items() if i % 4 for w in t)
    c2 = Counter(p for i, p_ in pairs.items() if i % 4 for p in p_)
    n, v = sum(c1.values()), len(c1)
    b = language_model.follower_exponent([(1, c) for c in c1.values()], len(c2))
    assert abs(sum(c**b for c in c1.values()) - len(c2)) < 1e-6 * len(c2)
    followers = lambda w: max(c1[w], 1) ** b
    least = lambda c: 2 ** (c.bit_length() - 1) if c else 0
    over = []
    for i, own in pairs.items():
        t = [(p, followers(p[0])) for p in own]
        want = sum(math.log10((least(c2[p]) + k * (c1[p[1]] + 1) / (n + v + 1)) / (c1[p[0]] + k)) for p, k in t)
        # The filter's errors only add, at 2 % of 41 bigrams; like counts share a mean in the follower law.
        assert want - 0.5 <= got[i].score < want + 8
        over.append(got[i].score - want)
    assert sum(over) / len(over) < 1.5
    assert sum(got[i].held_out for i in got) == 60


def test_parts_are_grouped_by_bytes(monkeypatch):
    monkeypatch.setattr(language_model, "GROUP_BYTES", 10)
    assert language_model.part_groups([(0, 4), (1, 6), (2, 1), (5, 30), (6, 3)]) == [[0, 1], [2], [5], [6]]
    assert language_model.part_groups([]) == []


def test_groups_read_their_own_files(spark, monkeypatch):
    from ledgerloom.session import Scratch

    monkeypatch.setattr(language_model, "GROUP_BYTES", 10)
    sizes = [("b", 7, 4), ("a", 1, 6), ("a", 9, 2), ("c", 2, 7), ("c", 3, 6), ("c", 8, 2)]
    assert language_model.file_groups(sizes) == [(["a"], [1, 9]), (["b"], [7]), (["c"], [2]), (["c"], [3, 8])]
    assert language_model.file_groups([("x", 1, 3), ("y", 0, 3)]) == [(["x", "y"], [1, 0])]
    # All groups together read each file once.
    values = [np.unique(np.random.default_rng(s).integers(0, 1 << 40, 50).astype(np.uint64)) for s in range(6)]
    rows = []
    for s, own in enumerate(values):
        packed = language_model._planes(own)
        rows += [(language_model.ASKED, s, 0, packed), (language_model.PART, s, None, language_model.filter_bits(own, np.full(len(own), 3)))]
    monkeypatch.setattr(language_model, "GROUP_BYTES", 6 * len(rows[1][3]) - 1)
    scratch = Scratch(spark)
    table = spark.createDataFrame([(*r, None, 0, 0) for r in rows], "kind int, segment int, block long, hashes binary, counts binary, n long, v long")
    learned = scratch.cut(table.repartition(6, "segment"))
    read = []
    real = spark.read.__class__.parquet
    monkeypatch.setattr(spark.read.__class__, "parquet", lambda self, *paths: read.extend(paths) or real(self, *paths))
    got = {r.segment: bytes(r.levels) for r in language_model.probed_levels(learned, scratch).collect()}
    parts = {s: b for kind, s, _, b in rows if kind == language_model.PART}
    assert got == {s: language_model.FrequencyFilter({0: parts[s]}, 1).levels(own).astype(np.uint8).tobytes() for s, own in enumerate(values)}
    own = [path for path in read if path.startswith(learned._scratch_path + "/")]
    assert len(own) == len(set(own)) >= 2
    scratch.close()
