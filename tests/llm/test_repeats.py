"""Repeated passages against all windows, and maximal repeats against all substrings."""

import hashlib
import random

import numpy as np
import pytest

from tesserae.llm import repeats as R

SCHEMA = "doc_id bigint, text string, doc string, tie string, start string, n string, kind string"


def brute_force(rows, length):
    """rows: (id, text), ids all different."""
    first, out = {}, []
    whole = {i: (t or "").encode() for i, t in rows}
    for i in sorted(whole):
        for p in range(len(whole[i]) - length + 1):
            first.setdefault(whole[i][p : p + length], (i, p))
    for i, text in whole.items():
        gone = [False] * len(text)
        for p in range(len(text) - length + 1):
            if first[text[p : p + length]] != (i, p):
                gone[p : p + length] = [True] * length
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        kept = bytes(b for b, g in zip(text, gone) if not g)
        out.append((i, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def planted(seed):
    rng = random.Random(seed)
    made = lambda n: "".join(rng.choice("abcdefg é日\n ") for _ in range(n))
    shared, frame = [made(140) for _ in range(5)], made(60)
    rows = [made(rng.randrange(30)) + rng.choice(shared)[rng.randrange(30) :] + frame + made(rng.randrange(80)) for _ in range(60)]
    rows += [rows[3]] * 5 + ["a" * 400, "a" * 250, "ab" * 300, None, "", "short", made(3000)] + [frame + frame + c + frame + frame for c in "xyz"]
    edit = list(rows[-4])
    for _ in range(6):
        edit[rng.randrange(len(edit))] = "Z"
        rows.append("".join(edit))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("length", "most", "array"), [(100, 20_000, 4 << 20), (100, 2, 500), (40, 3, 1), (24, 20_000, 1000), (30, 1, 1000)])
def test_removed(spark, length, most, array):
    rows = planted(length)
    df = spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA).repartition(7)
    got = R.removed_spans(df, length=length, most=most, array=array).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_force(rows, length)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


def test_pieces_of_long_texts(monkeypatch):
    """A text in pieces names the same windows: what repeats across pieces meets by name."""
    rng = random.Random(1)
    text = bytes(rng.choice(b"abcd") for _ in range(3000))
    text = text + text
    for piece in (1 << 22, 700):
        made = [(0, 0, s, text[s : s + piece + 99]) for s in range(0, len(text) - 99, piece)]
        rows = [R.contexts([p], 100) for p in made]
        named = [(a, s, n) for r in rows for k, a, s, n in zip(r["kind"], r["anchor"], r["start"], r["n"]) if k == R.NAMED]
        again = [(s, e) for r in rows for k, s, e in zip(r["kind"], r["start"], r["n"]) if k == R.REMOVED]
        covered = sum(n for _, _, n in named) + sum(e - s - 99 for s, e in again)
        assert covered == len(text) - 99


def test_met_over_small_batches(monkeypatch):
    """Rows of one anchor that come in many batches, with copies on both sides of a cut, and more contexts than are compared."""
    import pyarrow as pa

    monkeypatch.setattr(R, "ROWS", 3)
    rng = random.Random(4)
    rows = sorted({(a, rng.randrange(4 if a % 2 else 12), rng.randrange(9), 0, rng.randrange(5)) for a in range(12) for _ in range(30)})
    for most in (1, 5, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array([R.NAMED] * len(part), pa.int8()), *(pa.array([r[i] for r in part], pa.int64()) for i in range(4)), pa.array([r[4] for r in part], pa.int32()), pa.array([7] * len(part), pa.int32())], names=list(R._KINDS)) for part in (rows[i : i + 2] for i in range(0, len(rows), 2))]
        got = [tuple(r.values()) for b in R._met(100, most)(batches) for r in b.to_pylist()]
        firsts = {(r[0], r[1]): r for r in reversed(rows)}
        names = {}
        for a, n in firsts:
            names.setdefault(a, []).append(n)
        want = [(R.REMOVED, r[2], r[4], r[4] + 7 + 99) for r in rows if firsts[r[:2]] != r]
        want += [(R.WINDOWED if len(names[a]) > most else R.COMPARED, r[2], r[4], 7) for (a, _), r in firsts.items() if len(names[a]) > 1]
        assert sorted((g[0], g[3], g[5], g[6]) for g in got) == sorted(want)


def test_maximal_repeats():
    rng = random.Random(3)
    for trial in range(30):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 40))) for _ in range(5)] + [b"abab" * 5, b"a" * 15]
        least = 3 + trial % 4
        places = {}
        for t, text in enumerate(texts):
            for p in range(len(text)):
                for e in range(p + least, len(text) + 1):
                    places.setdefault(text[p:e], []).append((t, p))
        want = set()
        for s, at in places.items():
            left = {texts[t][p - 1] if p else ("start", t) for t, p in at}
            right = {texts[t][p + len(s)] if p + len(s) < len(texts[t]) else ("end", t) for t, p in at}
            if len(at) > 1 and len(left) > 1 and len(right) > 1:
                want.add((len(s), tuple(sorted(at))))
        got = {(int(n), tuple(sorted(zip(t.tolist(), p.tolist())))) for n, t, p in R.maximal_repeats(texts, least)}
        assert got == want


def test_repeated_and_null_ids(spark):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh") for _ in range(150))
    rows = [(5, text), (5, text), (5, text + "!"), (None, text), (None, None), (7, text)]
    got = R.removed_spans(spark.createDataFrame([(*r, "", "", "", "", "") for r in rows], SCHEMA)).collect()
    removed = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in got)
    assert removed == [("5", 150, 150), ("5", 150, 150), ("5", 151, 150), ("7", 150, 150), ("None", 0, 0), ("None", 150, 0)]
    assert R.removed_spans(spark.createDataFrame([], SCHEMA)).collect() == []


def test_least_of_runs():
    values = np.random.default_rng(0).integers(0, 1000, 300).astype(np.uint64)
    for width in (1, 2, 7, 64, 77):
        assert R._least(values, width).tolist() == [values[i : i + width].min() for i in range(301 - width)]
