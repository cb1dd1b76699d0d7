"""Token alignment, whitening and vector near-dedup against brute force, with nulls, ties, repeated rows and clashing columns."""

import bisect
import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest

from barloom.llm import collision_neardup, queries, token_align, whitening

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


# ---- 11 token alignment


def plain_alignment(rows):
    """(id, n_a, n_b, groups, links, n_best, count_sum, hash) of each (id, text), from the definition."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_coder = Tokenizer.from_file(A)
    a_coder.encode_special_tokens = True
    b_coder = sentencepiece.SentencePieceProcessor(model_file=B)
    alphabet = token_align.byte_alphabet()
    found, counts = [], Counter()
    for i, text in rows:
        ids_a = a_coder.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = b_coder.encode(text or "")
        raw_a = [bytes(alphabet[c] for c in a_coder.id_to_token(k)) for k in ids_a]
        raw_b = [bytes((int(b_coder.id_to_piece(k)[3:5], 16),)) if b_coder.is_byte(k) else b_coder.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
        raw = (" " + (text or "")).encode()
        if not text or b"".join(raw_a) != raw or b"".join(raw_b) != raw:
            found.append((i, [], [], [], ""))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
        links = [(x, y) for e, x in zip(ends_a, ids_a) for y in [ids_b[bisect.bisect_left(ends_b, e)]] if e in set(ends_b)]
        groups, at_a, at_b = [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            to_a, to_b = bisect.bisect_right(ends_a, e), bisect.bisect_right(ends_b, e)
            groups.append(",".join(map(str, ids_a[at_a:to_a])) + "|" + ",".join(map(str, ids_b[at_b:to_b])))
            at_a, at_b = to_a, to_b
        counts.update(links)
        found.append((i, ids_a, ids_b, links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return sorted(((i, len(a), len(b), len(x), len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), h) for i, a, b, x, h in found), key=str)


TEXTS = ["The quick brown fox", "It's  two  spaces\n\tand tabs ", "日本語のテキスト und Größe", "<s> </s> <|endoftext|> <unk> <0x41>", "a▁b literal mark", "   lead", "x" * 3000, "word " * 2000, "\x00\x01 ​﻿ é é", "😀😀 end", "The quick brown fox"]


@pytest.mark.parametrize("frequent", [token_align.FREQUENT, 20])
def test_alignment_against_definition(spark, docs_of, frequent):
    rows = [*enumerate(TEXTS), (50, None), (51, ""), (None, "The fox"), (3, "same id")]
    got = token_align.alignment_statistics(docs_of(rows), A, B, public_tokenizers.PATTERN, frequent)
    found = sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in got.collect()), key=str)
    assert found == plain_alignment(rows)
    assert sum(r[1] == 0 for r in found) == 3  # null, empty, the literal mark


def test_alignment_query_against_definition(spark):
    got = queries.QUERIES["op11_token_alignment"](spark, SF)
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    found = sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in got.collect()), key=str)
    assert found == plain_alignment(list(zip(docs.doc_id.tolist(), docs.text.tolist())))


def test_alignment_empty(docs_of):
    assert token_align.alignment_statistics(docs_of([(1, "x")]).limit(0), A, B, public_tokenizers.PATTERN).count() == 0


def test_windows_are_remembered_and_forgotten(monkeypatch):
    monkeypatch.setattr(token_align, "MAX_WINDOWS", 3)
    with open(A, "rb") as a, open(B, "rb") as b:
        aligner = token_align.Aligner(a.read(), b.read(), public_tokenizers.PATTERN)
    both = [aligner.tokens(t) for t in [t for t in TEXTS if "▁" not in t] * 2]
    whole = [aligner.align(*x) for x in both]
    assert [w[0] for w in whole] == [aligner.window(x.tobytes(), y.tobytes())[0] for x, y in both]  # one window of all tokens says the same
    assert len(aligner.known) <= 3 + max(w[0].count(";") + 1 for w in whole)


# ---- 12 whitening


def vectors_of(spark, rows):
    full = [(i, v, 1, 2, "x", 3) for i, v in rows]
    return spark.createDataFrame(full, "vec_id long, embedding array<float>, label int, n long, x string, component int").repartition(3)


def vector_rows(d=9, n=120, seed=3):
    rng = np.random.default_rng(seed)
    base = (rng.standard_normal((n, d)) * np.linspace(2, 0.4, d)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(200 + k, base[0].tolist()) for k in range(30)] + [(0, base[5].tolist()), (None, base[6].tolist())]
    return rows + [(300, None), (301, []), (302, [None] * d), (303, [float("nan")] * d), (304, [float("inf")] * d), (305, [0.0] * d), (306, [1.0, 2.0]), (307, [-0.0] * d)]


def plain_whitening(rows, d, components):
    kept = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if v and len(v) == d and None not in v and np.isfinite(v).all()]
    x = np.array([v for _, v in kept])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    return [i for i, _ in kept], n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ q / np.sqrt(e), e / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize("components, inside", [(4, 8), (9, 2)])
def test_whitening_against_eigh(spark, monkeypatch, components, inside):
    monkeypatch.setattr(whitening, "IN_INTERVAL", inside)
    rows = vector_rows()
    ids, n, deviation, white, explained = plain_whitening(rows, 9, components)
    got = whitening.whitened(vectors_of(spark, rows), components).toPandas()
    assert len(got) == components * len(ids) and set(got.n) == {n} and got.identity_error.max() < 1e-9
    for c in range(components):
        part = got[got.component == c + 1]
        key = lambda i, dev, w: (-1 if i is None or i != i else int(i), int(dev), round(abs(float(w)), 9))
        assert sorted(map(key, part.vec_id, part.deviation, part.whitened)) == sorted(map(key, ids, deviation, white[:, c]))
        assert np.allclose(part.explained, explained[c], rtol=1e-10)


def test_whitening_of_ties_and_low_rank(spark):
    axes = [(k, [float(3 * (k == j)) for j in range(5)]) for k in range(5)]  # four equal eigenvalues, and a zero
    got = whitening.whitened(vectors_of(spark, axes), 5).toPandas()
    assert sorted(set(got.component)) == [1, 2, 3, 4] and got.identity_error.max() < 1e-9 and np.allclose(got.explained, 0.25)
    assert whitening.whitened(vectors_of(spark, axes[:1])).count() == 0
    assert whitening.whitened(vectors_of(spark, axes).limit(0)).count() == 0


def test_whitening_sums_beyond_longs(spark):
    rows = [(i, [2.0 ** 52 * (i % 3), float(i), 2.0 ** 54]) for i in range(7)]
    got = {r.vec_id: r for r in whitening.whitened(vectors_of(spark, rows), 1).collect()}
    x = [[256 * 2 ** 52 * (i % 3), 256 * i, 256 * 2 ** 54] for i in range(7)]
    s = [sum(c) for c in zip(*x)]
    assert {i: int(r.deviation) for i, r in got.items()} == {i: sum((7 * a - b) ** 2 for a, b in zip(x[i], s)) for i in range(7)}


def test_inertia_counts():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 30):
        m = rng.standard_normal((n, n))
        v = m + m.T
        e = np.linalg.eigvalsh(v)
        for shift in [0.0, *rng.uniform(e[0] - 1, e[-1] + 1, 10)]:
            assert whitening.above(v, shift) == (e > shift).sum()
    assert whitening.above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


# ---- 13 near-dedup of vectors


def near_rows(seed=7, d=24):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for size, noise in [(1, 0)] * 80 + [(2, 0.2), (3, 0.25), (5, 0.3), (12, 0.3), (150, 0.25)] + [(2, 0.3)] * 30:
        centre = rng.standard_normal(d)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            rows.append((i, ((centre + noise * rng.standard_normal(d) / math.sqrt(d)) * rng.uniform(0.1, 9)).astype(np.float32).tolist()))
            i += 1
    rows += [(1000 + k, rows[0][1]) for k in range(40)] + [(2, rows[3][1]), (None, rows[0][1]), (2000, (np.array(rows[0][1]) * np.float32(2)).tolist())]
    return rows + [(3000, None), (3001, []), (3002, [0.0] * d), (3003, [None] * d), (3004, [float("nan")] * d), (3005, [1.0]), (3006, [2.0]), (None, None), (3007, [float("-inf")] * d)]


def plain_links(rows, cosine):
    good = {k for k, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)}
    unit = {k: np.array(rows[k][1], float) / np.linalg.norm(np.array(rows[k][1], float)) for k in good}
    near = {k: [j for j in good if j != k and len(unit[j]) == len(unit[k]) and unit[k] @ unit[j] >= cosine] for k in good}
    out, seen = [], {}
    for k in range(len(rows)):
        if k not in seen:
            group, todo = {k}, [k]
            while todo:
                for j in near.get(todo.pop(), []):
                    if j not in group:
                        group.add(j)
                        todo.append(j)
            least = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
            seen |= dict.fromkeys(group, least)
        i = rows[k][0]
        out.append((i, len(near.get(k, [])), seen[k], i is not None and i == seen[k]))
    return sorted(out, key=str)


@pytest.mark.parametrize("cosine, cell, block", [(0.9, 4096, 4096), (0.9, 4096, 40), (0.95, 64, 4096)])
def test_near_vectors_against_all_pairs(spark, cosine, cell, block):
    rows = near_rows()
    got = collision_neardup.near_vectors(vectors_of(spark, rows), cosine, 0.9999, cell, block)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_links(rows, cosine)


@pytest.mark.parametrize("cell", [16, 100])
def test_full_cells_lose_no_lone_link(spark, monkeypatch, cell):
    """All vectors in one cell of one table, far more than a task takes, with links of two inside of a dense crowd."""

    class OneCell(collision_neardup.Plan):
        def __init__(self, n, *rest):
            super().__init__(n, *rest)
            self.tables, self.digits, self.width = 1, 1, 1e9

    monkeypatch.setattr(collision_neardup, "Plan", OneCell)
    rng = np.random.default_rng(17)
    crowd = 1.5 * collision_neardup.unit(rng.standard_normal((1, 48))) + collision_neardup.unit(rng.standard_normal((240, 48)))
    pairs = crowd[:120] + 0.02 * rng.standard_normal((120, 48))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate((crowd, pairs)).astype(np.float32))]
    truth = plain_links(rows, 0.98)
    assert sum(r[1] == 1 for r in truth) >= 200
    got = collision_neardup.near_vectors(vectors_of(spark, rows), 0.98, cell=cell)
    assert sorted((tuple(r) for r in got.collect()), key=str) == truth


def test_near_vectors_empty(spark):
    assert collision_neardup.near_vectors(vectors_of(spark, near_rows()).limit(0)).count() == 0
    lone = collision_neardup.near_vectors(vectors_of(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])])).collect()
    assert sorted(map(tuple, lone)) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_recall_is_calibrated():
    """Pairs exactly at the limit, many of them: the share that the plan's tables and count let through."""
    rng = np.random.default_rng(0)
    n, d = 1500, 64
    plan = collision_neardup.Plan(100_000)
    counted, ways, shifts, _ = plan.directions(d)
    a = collision_neardup.unit(rng.standard_normal((n, d)))
    other = rng.standard_normal((n, d))
    b = 0.9 * a + math.sqrt(1 - 0.81) * collision_neardup.unit(other - (other * a).sum(axis=1, keepdims=True) * a)
    far = collision_neardup.unit(other)
    steps = lambda u: np.rint(u @ counted * (collision_neardup.HALF / plan.half))
    passing = lambda u, w: (np.abs(steps(u) - steps(w)) <= collision_neardup.HALF).sum(axis=1) >= plan.least
    cells = lambda u: np.floor((u @ ways + shifts) / plan.width).reshape(n, plan.tables, plan.digits)
    met = ((cells(a) == cells(b)).all(axis=2)).any(axis=1)
    assert passing(a, b).mean() > 0.99 and (met & passing(a, b)).mean() > 0.97
    assert not passing(a, far).any()
