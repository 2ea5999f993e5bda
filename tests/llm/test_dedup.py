"""Exact, near and embedding dedup and suffix arrays against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import embedding_dedup, near_dedup, suffix_dedup
from ledgerloom.llm.exact_dedup import exact_dedup, exact_groups

DOCS = "doc_id long, text string, _doc string, _digest string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", None) for i, t in rows], DOCS)


class Parts:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


# --- exact ------------------------------------------------------------------


def exact_cases():
    rng = random.Random(1)
    rows = [(i, "same  text\n here" if i % 3 == 0 else words(rng, 5)) for i in range(300)]
    rows += [(300, "same text here"), (301, None), (302, ""), (303, " "), (304, "\t\x0b"), (305, "Same text here"), (7, rows[7][1])]
    return rows + [(None, "same text here"), (None, "only here"), (None, "only here")]


def test_exact_groups(spark):
    rows = exact_cases()
    got = [tuple(r) for r in exact_groups(docs(spark, rows)).collect()]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    want = {}
    for i, t in rows:
        want.setdefault(norm(t), []).append(i)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    kept = {digest(t): (min((i for i in ids if i is not None), default=None), len(ids)) for t, ids in want.items()}
    assert len(got) == len(rows)
    assert all((keep, size) == kept[sha] for _, keep, size, _, sha in got)
    # One row of each group stays, and it carries the smallest id.
    assert sorted(sha for *_, stays, sha in got if stays) == sorted(kept)
    assert all(i == keep for i, keep, _, stays, _ in got if stays)


def test_exact_dedup_keeps_one_row_and_all_columns(spark):
    rows = exact_cases()
    out = exact_dedup(docs(spark, rows))
    assert out.columns == ["doc_id", "text", "_doc", "_digest"]
    keep = {r.doc_id for r in exact_groups(docs(spark, rows)).filter("kept").collect()}
    got = [r.doc_id for r in out.collect()]
    assert set(got) == keep and len(got) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows})


def test_exact_empty(spark):
    assert exact_groups(docs(spark, [])).count() == 0 and exact_dedup(docs(spark, [])).count() == 0


# --- near -------------------------------------------------------------------


def near_cases():
    rng = random.Random(2)
    base = [words(rng, n) for n in (3, 5, 30, 60, 60, 200)]
    rows = []
    for t in base:
        rows.append(t)
        for k in range(12):
            w = t.split()
            for _ in range(max(1, len(w) * k // 150)):
                w[rng.randrange(len(w))] = words(rng, 1)
            rows.append(" ".join(w))
    shared = words(rng, 25)
    rows += [shared + " " + words(rng, 40) for _ in range(40)]
    rows += [base[3].upper(), "\t" + base[4].replace(" ", "\n "), None, "", " \n", "one", "ONE", base[5] * 30]
    return list(enumerate(rows, 10)) + [(12, rows[2]), (None, base[3])]


def brute_near(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
    parts, ids = Parts(sets), [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                parts.join(a, b)
    return {i: (len(s), None if i is None else parts.find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("tile", [near_dedup.TILE, 2])
def test_near_groups(spark, monkeypatch, tile):
    monkeypatch.setattr(near_dedup, "TILE", tile)
    rows = near_cases()
    want = brute_near(rows)
    got = near_dedup.near_groups(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_dedup_keeps_first_of_group(spark):
    rows = near_cases()
    want = brute_near(rows)
    out = near_dedup.near_dedup(docs(spark, rows))
    assert out.columns == ["doc_id", "text", "_doc", "_digest"]
    assert {r.doc_id for r in out.collect()} == {i for i, (_, c) in want.items() if i == c}
    assert near_dedup.near_dedup(docs(spark, [])).count() == 0


def test_signatures_within_distance_share_a_key():
    rng = np.random.default_rng(3)
    far = 2 * (near_dedup.SLOTS // near_dedup.CHUNK) - 1
    for _ in range(200):
        one = rng.integers(0, 1 << 16, near_dedup.SLOTS).astype(np.uint16)
        two = one.copy()
        at = rng.choice(near_dedup.SLOTS, far, replace=False)
        two[at] ^= np.uint16(1 + rng.integers(0, 1000))
        a, b = near_dedup.chunk_keys(np.stack([one, two]))
        assert set(a.tolist()) & set(b.tolist())


# --- vectors ----------------------------------------------------------------


@pytest.mark.parametrize("tile", [embedding_dedup.TILE, 5])
def test_vector_groups(spark, monkeypatch, tile):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(6, 20))
    rows = []
    for k in range(240):
        v = centre[k % 6] + rng.normal(size=20) * rng.choice([0.01, 0.1, 0.25])
        rows.append((k, v.tolist(), int(k % 3 == 0)))
    rows += [(500 + k, rows[0][1], rows[0][2]) for k in range(80)] + [(600 + k, (np.array(rows[3][1]) * (k + 2)).tolist(), 1) for k in range(3)]
    rows += [(700, None, 1), (701, [0.0] * 20, 1), (702, [None] + [1.0] * 19, 1), (703, [float("nan")] * 20, 1), (704, [float("inf")] * 20, 1)]
    rows += [(705, rows[0][1], None), (706, [], 1), (707, rows[0][1][:19], 1), (708, [1e300] * 20, 0), (709, [1e300] * 20, 0), (5, rows[5][1], rows[5][2])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.vector_groups(frame).collect()
    parts, links = Parts([r[0] for r in rows]), [0] * len(rows)
    good = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    unit = lambda v: np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max())
    for a, (i, v, l) in enumerate(rows):
        for b, (j, w, m) in enumerate(rows):
            if a < b and l is not None and l == m and good(v) and good(w) and len(v) == len(w) and unit(v) @ unit(w) >= 0.93:
                links[a] += 1
                links[b] += 1
                parts.join(i, j)
    want = sorted((i, n, parts.find(i)) for (i, *_), n in zip(rows, links))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert embedding_dedup.vector_groups(frame.limit(0)).count() == 0


# --- suffix arrays ----------------------------------------------------------


def brute_repeats(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for b in data:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        rest = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize("most", [suffix_dedup.MOST_CONTEXTS, 1])
def test_remove_repeats(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", most)
    rng = random.Random(5)
    passage, edge = words(rng, 80), words(rng, 60)
    texts = [words(rng, 50) + passage + words(rng, 30) for _ in range(8)]
    texts += [words(rng, 20) + edge[:199] + words(rng, 20), edge[:199], words(rng, 9) + edge[:200] + "é", "ü" + edge[:200]]
    texts += [texts[0], "ab" * 700, "abc" * 70, passage[:230] + passage[40:300], None, "", "short", words(rng, 3000), "日本語" * 120]
    texts += [words(rng, 30) + passage[k : k + 200 + k] for k in range(0, 120, 7)]
    rows = [(i if i != 4 else None, t) for i, t in enumerate(texts)] + [(2, texts[2])]
    got = suffix_dedup.remove_repeats(docs(spark, rows), with_text=True).collect()
    want = brute_repeats([t for _, t in rows])
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=key) == sorted(
        ((i, *w) for (i, _), w in zip(rows, want)), key=key
    )
    assert suffix_dedup.remove_repeats(docs(spark, [])).count() == 0


def test_family_merges_levels(spark):
    from ledgerloom.session import Scratch

    scratch = Scratch(spark)
    family = suffix_dedup.SuffixFamily(scratch)
    for k in range(5):
        family.add(spark.createDataFrame([(1, k % 2), (10 + k, 0), (20 + k // 2, k)], "key long, context long"))
        assert [level is not None for level in family.levels] == [bool(k + 1 >> b & 1) for b in range(len(family.levels))]
    got = {(r.key, r.context): (r.n, r.contexts) for r in family.shared().collect()}
    assert got == {(1, 0): (3, 2), (1, 1): (2, 2), (20, 0): (1, 2), (20, 1): (1, 2), (21, 2): (1, 2), (21, 3): (1, 2)}
    scratch.close()
