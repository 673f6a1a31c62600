"""Periodic runs, packing along a curve and spelling variants against brute force."""

from __future__ import annotations

import itertools
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from plans import plan_text
from tokenizers import Tokenizer

from tillroll.llm import curve_packing, periodic_runs, queries, spelling
from tillroll.llm.common import scan, stage_table

SCHEMA = "doc_id long, text string"
CLASHING = ["1 AS number", "2 AS slice", "3 AS key", "4 AS ids", "5 AS size", "6 AS word", "7 AS n", "8 AS runs"]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return scan(spark, sf)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def frame(spark, rows, kind="long"):
    return spark.createDataFrame(rows, f"doc_id {kind}, text string")


# --- periodic runs ----------------------------------------------------------


def found_runs(df):
    return Counter(tuple(r) for r in df.collect())


def test_runs_all(spark, sf, rows):
    got = found_runs(queries.op11_periodic_runs(spark, sf))
    assert got == brute.periodic(rows)
    assert sum(n for row, n in got.items() if row[1]) >= 10


def test_runs_of_random_words():
    rnd = random.Random(3)
    for _ in range(400):
        texts = []
        for _ in range(rnd.randint(1, 4)):
            held = [b"abcd"[k : k + 1] for k in rnd.choices(range(rnd.randint(1, 4)), k=rnd.randint(0, 50))]
            unit = held[: rnd.randint(1, 9)]
            texts.append(held[:5] + unit * rnd.randint(0, 9) + held[5:] + unit[:2] * rnd.randint(0, 5))
        for got, held in zip(periodic_runs.read_slab(texts), texts, strict=True):
            assert got.runs == brute.stretches(held)


def test_runs_odd_rows(spark):
    odd = [
        (1, None), (2, ""), (3, " \t\n"), (4, "a " * 6), (5, "a " * 5), (6, "a b " * 4 + "a"), (7, "x a a " * 30),
        (8, "b " * 9 + "c " * 9), (8, "b " * 9 + "c " * 9), (None, "q r s " * 4), (9, "w " * 30_000), (10, "A a " * 8),
    ]
    for size in (1, 10, 1 << 20):
        df = periodic_runs.periodic_runs(frame(spark, odd).selectExpr("*", *CLASHING), repeats=True, size=size)
        assert found_runs(periodic_runs.digest(df)) == brute.periodic(odd)


def test_runs_ties_go_to_the_first(spark):
    row = periodic_runs.periodic_runs(frame(spark, [(1, "a " * 8 + "b " * 8 + "c d " * 8)])).first()
    assert (row["start"], row["length"], row["period"], row["exponent_milli"]) == (0, 8, 1, 8000)
    assert bytes(row["runs"]).decode().split() == ["0,8,1", "8,8,1", "16,16,2"]
    assert bytes(row["collapsed"]) == b"a b c d"


def test_runs_text_ids_and_empty_table(spark):
    df = frame(spark, [("x", "a " * 8), ("y", None)], "string")
    assert {r["doc_id"]: r["n_runs"] for r in periodic_runs.periodic_runs(df, repeats=True).collect()} == {"x": 1, "y": 0}
    assert periodic_runs.periodic_runs(frame(spark, [])).count() == 0


def test_long_period_is_found_within_seconds():
    words = [str(i % 5000).encode() for i in range(200_000)]
    assert periodic_runs.read_slab([words])[0].runs == [(0, 200_000, 5000)]


# --- packing along a curve --------------------------------------------------


def packed_right(df, rows, capacity=4096):
    """The contract: every id in one piece, sequences gapless and full or a power of two."""
    library = Tokenizer.from_file(curve_packing.vocabulary_path())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in df.collect():
        pieces[(r["doc_id"], r["doc_tokens"])].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    wanted = Counter()
    for doc, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        wanted[(doc, len(ids))] += 1
        own = sorted(pieces[(doc, len(ids))], key=lambda r: r["start"])
        if len({r["start"] for r in own}) == len(own):
            at = 0
            for r in own:
                part = np.array(ids[at : at + r["length"]], dtype="<u4")
                assert r["start"] == at and r["ids_crc32"] == zlib.crc32(part.tobytes())
                at += r["length"]
            assert at == len(ids)
    assert {k for k, v in pieces.items()} == set(wanted)
    assert {k: sum(r["length"] for r in v) for k, v in pieces.items()} == {k: k[1] * n for k, n in wanted.items()}
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at and length > 0
            at += length
        assert at <= capacity and (at == capacity or at & (at - 1) == 0)
    return sequences


def test_curve_packs_all(spark, sf, rows):
    sequences = packed_right(queries.op12_packing(spark, sf), rows)
    total = sum(length for held in sequences.values() for _, length in held)
    assert len(sequences) == total // 4096 + (total % 4096).bit_count()


def test_curve_odd_rows(spark):
    odd = [
        (1, None), (2, ""), (2, ""), (3, "word " * 9000), (None, "a null id"), (4, "12345" * 30_000), (5, "q" * 80_000),
        (6, "<|endoftext|>x<|STARTOFTEXT|> Don't DON'T we'll"), (7, "é é İ ΣαΣ"),
        (8, "a\x1cb\x85c d\x0be"), (9, "word, (Word) word's 'word <word> w0rd"), (9, "another text of that id"),
    ]
    df = curve_packing.curve_pack(frame(spark, odd).selectExpr("*", *CLASHING), slices=3)
    packed_right(df, odd)
    small = curve_packing.curve_pack(frame(spark, odd), capacity=64)
    packed_right(small, odd, 64)


def test_curve_equal_rows_are_spread(spark):
    same = [(i, "one text, many times over") for i in range(3000)]
    blocks = curve_packing.token_blocks(frame(spark, same), curve_packing.vocabulary_path())
    placed, before = curve_packing.along_curve(blocks, 8)
    sizes = [r["count"] for r in placed.groupBy("slice").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 3000 / 8 and len(before) == 9


def test_curve_text_ids_and_empty_table(spark):
    assert curve_packing.curve_pack(frame(spark, [])).count() == 0
    packed_right(curve_packing.curve_pack(frame(spark, [("x", "a b"), ("y", None)], "string")), [("x", "a b"), ("y", None)])


def test_a_short_document_is_projected_in_its_own_size():
    """The same numbers as by counting in all dimensions, which a short document does not fill."""
    rnd = np.random.default_rng(1)
    curve_packing.projection()
    for size in (1, 2, 300, curve_packing.FEATURES - 1, curve_packing.FEATURES, 100_000):
        ids = rnd.integers(0, 900, size).astype("<u2")
        hashed = (ids.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(32 - curve_packing.FEATURE_BITS)
        times = np.bincount(hashed, minlength=curve_packing.FEATURES)
        counted = np.sqrt(times / size) @ curve_packing.projection()
        assert np.allclose(curve_packing.project(ids), counted)
    tracemalloc.start()
    curve_packing.project(ids[:300])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < curve_packing.FEATURES


def test_hilbert_steps_to_neighbours():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
        place = curve_packing.hilbert(cells, bits)
        assert sorted(place) == list(range(len(cells)))
        steps = np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def test_neighbours_on_the_curve_are_alike(spark, docs):
    """Language is no input, yet documents side by side share it more often than any two do."""
    known = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = curve_packing.curve_pack(docs).orderBy("sequence_id", "offset").collect()
    order = list(dict.fromkeys(r["doc_id"] for r in held))
    alike = np.mean([known[a] == known[b] for a, b in itertools.pairwise(order)])
    shares = np.array([*Counter(known.values()).values()]) / len(known)
    assert alike > 0.25 + (shares**2).sum()


def test_curve_sequences_hold_the_ids(spark, docs, rows):
    library = Tokenizer.from_file(curve_packing.vocabulary_path())
    held = curve_packing.curve_sequences(docs).collect()
    got = sum((Counter(r["ids"]) for r in held), Counter())
    wanted = sum((Counter(library.encode(t or "", add_special_tokens=False).ids) for _, t in rows), Counter({2: len(rows)}))
    assert got == wanted and all(sum(r["lengths"]) == len(r["ids"]) <= 4096 for r in held)


# --- spelling ---------------------------------------------------------------


def found_variants(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


def test_spelling_all(spark, sf, rows):
    got = found_variants(queries.op13_spelling_variants(spark, sf))
    assert got == brute.variants(brute.vocabulary(rows))


def test_spelling_more_words(spark):
    df = scan(spark, "/root/testdata/sf0.01")
    some = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = found_variants(spelling.spelling_variants(df, modulus=199))
    assert got == brute.variants(brute.vocabulary(some))
    assert sum(v[2] is not None for v in got.values()) > 10


def test_spelling_of_dense_words(spark):
    """Few letters, so every word has many neighbours, and edits in runs of equal letters."""
    rnd = random.Random(5)
    words = {"".join(rnd.choices("abé", k=rnd.randint(6, 9))) for _ in range(900)}
    some = [(k, " ".join([w] * rnd.choice([4, 5, 6, 30, 160]))) for k, w in enumerate(sorted(words))]
    for modulus in (199, 7):
        got = found_variants(spelling.spelling_variants(frame(spark, some), modulus=modulus))
        assert got == brute.variants(brute.vocabulary(some, modulus=modulus))


def test_spelling_odd_rows(spark):
    long = "".join(random.Random(1).choices("abcdefgh", k=3000))
    sizes = [long[:k] for k in (63, 64, 65, 66, 67, 3000)] + [long[:1500] + long[1501:], "z" + long[1:66], "a" * 50_000]
    odd = [(1, None), (2, ""), (None, "nothing " * 7), (3, "a" * 49_999)] + [(k + 10, f"{w} " * 5) for k, w in enumerate(sizes)]
    odd += [(40, "Color colour COLOUR " * 30), (41, "colours " * 400), (42, "×÷Àÿàà " * 6)]
    odd += [(43, "short " * 50), (44, "exactly" * 3 + " exactl exactl " * 3)] + [(3, "a" * 49_999)] * 5
    df = frame(spark, odd).selectExpr("*", *CLASHING)
    got = found_variants(spelling.spelling_variants(df, modulus=199))
    words = brute.vocabulary(odd)
    assert set(got) == set(words) and {w: v[0] for w, v in got.items()} == words
    near = defaultdict(set)
    for a, b in itertools.permutations(words, 2):
        if spelling.one_edit(a, b):
            near[a].add(b)
    assert {w: v[1] for w, v in got.items()} == {w: len(near[w]) for w in words}
    assert got["colour"][2] == "colours"


def test_spelling_forms_and_roots(spark):
    some = [(1, "aaaaaa " * 5 + "aaaaab " * 25 + "aaaabb " * 125 + "aaaacb " * 125 + "zzzzzz " * 5)]
    got = found_variants(spelling.spelling_variants(frame(spark, some)))
    assert got["aaaaaa"] == (5, 1, "aaaaab", 25, "aaaabb")
    assert got["aaaaab"][2:] == ("aaaabb", 125, "aaaabb") and got["aaaacb"][2:] == (None, None, "aaaacb")
    assert got["zzzzzz"] == (5, 0, None, None, "zzzzzz")


def test_spelling_shuffled_levels(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(spelling, "SENT", 0)
    assert found_variants(spelling.spelling_variants(docs, modulus=199)) == brute.variants(brute.vocabulary(rows))


def test_spelling_sends_nothing_by_the_size_of_files(spark):
    """A few words' files are small, but not the rows that an explode makes of them."""
    held = spark.createDataFrame([("a" * 60 + chr(97 + k), 5) for k in range(26)], "word string, n long")
    words = stage_table(held, "few-words")
    edges = stage_table(spelling.trie(words, 1), "few-edges")
    spread = spelling.first_states(words, edges)
    assert "BroadcastHashJoin" not in plan_text(spread, run=True) and spread.count() == 25 * 26 / 2
    pairs = spelling.neighbours(words)
    assert "BroadcastHashJoin" not in plan_text(pairs, run=True) and pairs.count() == 25 * 26


def test_spelling_empty_table(spark):
    assert spelling.spelling_variants(frame(spark, [])).count() == 0


def test_one_edit():
    near = [("ab", "b"), ("b", "ab"), ("aab", "aaab"), ("abc", "axc"), ("", "a")]
    far = [("ab", "ab"), ("ab", "ba"), ("abc", "axd"), ("abcd", "ab"), ("", "")]
    assert all(spelling.one_edit(*p) for p in near) and not any(spelling.one_edit(*p) for p in far)


def test_deletion_keys_meet():
    keys = spelling.deletion_keys("abcd")
    assert len(keys) == 5 and set(keys) & set(spelling.deletion_keys("abd"))
    assert not set(keys) & set(spelling.deletion_keys("dcba"))
