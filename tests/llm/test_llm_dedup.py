"""Exact, line, byte-string and SimHash deduplication against brute force."""

from __future__ import annotations

import random
from collections import Counter

import brute
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tillroll.llm import exact_dedup, line_dedup, simhash, suffix_dedup
from tillroll.llm.common import scan

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return scan(spark, sf)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


ODD = [
    (3, "a b"), (1, "ab"), (2, " a b "), (4, None), (5, ""), (6, "\t\n"), (None, "ab "),
    (7, "é b"), (8, "éb"), (9, "x" * 100_000), (10, "x" * 100_000), (11, "x" * 99_999),
]


# --- exact ------------------------------------------------------------------


def marked(df):
    return Counter(
        (r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"])
        for r in df.collect()
    )


def test_exact_all(docs, rows):
    assert marked(exact_dedup.exact_dedup(docs)) == brute.exact(rows)


def test_exact_odd_rows(spark):
    assert marked(exact_dedup.exact_dedup(frame(spark, ODD))) == brute.exact(ODD)


def test_exact_hot_group_is_split(spark):
    hot = [(i, "same text" + " " * (i % 3)) for i in range(400)]
    rest = [(i, f"text {i}") for i in range(400, 1000)]
    found = exact_dedup._hot(frame(spark, hot + rest), 4).collect()
    assert len(found) == 1 and found[0]["slots"] > 1
    assert marked(exact_dedup.exact_dedup(frame(spark, hot + rest))) == brute.exact(hot + rest)


@pytest.mark.parametrize("one_id", [7, None])
def test_exact_hot_text_under_one_id_meets_several_tasks(spark, one_id):
    hot = spark.range(4000).select(F.lit(one_id).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    rest = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    marked_rows = exact_dedup.mark(hot.unionByName(rest), ["doc_id"])
    rows = marked_rows.select("row.doc_id", "keep_id", "group_size", "kept").collect()
    assert Counter(r["group_size"] for r in rows) == {4000: 4000, 1: 1000}
    assert sum(r["kept"] for r in rows) == 1001
    plan = exact_dedup.placed(hot.unionByName(rest), ["doc_id"]).where("slot IS NOT NULL")
    sizes = [r["count"] for r in plan.groupBy("slot").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 2000


def test_exact_repeated_rows_keep_one(spark):
    same = [(1, "a"), (1, "a"), (2, "a")]
    kept = [r for r in exact_dedup.exact_dedup(frame(spark, same)).collect() if r["kept"]]
    assert [(r["doc_id"], r["group_size"]) for r in kept] == [(1, 3)]


def test_exact_empty_table(spark):
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_exact_sorts_by_range_without_python(docs):
    text = exact_dedup.exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text


def test_drop_copies_keeps_clashing_columns(spark):
    df = frame(spark, [(1, "a"), (2, "a"), (3, "b")]).selectExpr(
        "*", "1 AS hash", "2 AS slot", "3 AS run", "4 AS norm", "5 AS kept", "6 AS row", "7 AS head"
    )
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


# --- lines ------------------------------------------------------------------


def by_id(df):
    return {
        r["doc_id"]: (r["n_lines"], r["n_removed"], r["n_spans"], r["text"]) for r in df.collect()
    }


def test_lines_all(docs, rows):
    assert by_id(line_dedup.line_dedup(docs)) == brute.lines(rows)


def test_lines_odd_rows(spark):
    odd = [
        (1, "a\nb\nc\nd"), (2, "x\na\nb\nc"), (3, "b\nc\nd\na\nb\nc"), (4, "a\na\na\na\na"), (5, None),
        (6, ""), (7, "a\nb"), (8, "\n\n\n"), (9, "a\r\nb\r\nc"), (10, "\n".join("qrs" * 5000)),
        (None, "a\nb\nc"),
    ]
    assert by_id(line_dedup.line_dedup(frame(spark, odd))) == brute.lines(odd)


def test_lines_repeated_rows_and_empty_table(spark):
    twice = line_dedup.line_dedup(frame(spark, [(1, "a\nb\nc"), (1, "a\nb\nc")])).collect()
    assert [r["n_removed"] for r in twice] == [0, 0]
    assert line_dedup.line_dedup(frame(spark, [])).count() == 0


# --- byte strings -----------------------------------------------------------


def cut(df):
    return {
        r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], brute.sha(bytes(r["kept"])))
        for r in df.collect()
    }


def test_strings_all(docs, rows):
    assert cut(suffix_dedup.suffix_dedup(docs)) == brute.repeats(rows)


def planted(seed):
    rng = random.Random(seed)

    def noise(n):
        return "".join(rng.choice("ab cdé") for _ in range(n))

    shared = [noise(rng.randint(40, 160)) for _ in range(6)]
    rows = []
    for doc in range(60):
        parts = [noise(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            passage = rng.choice(shared)
            low = rng.randint(0, 20)
            parts += [passage[low : low + rng.randint(30, 160)], noise(rng.randint(0, 40))]
        rows.append((doc, "".join(parts)))
    rows += [(100, "z" * 400), (101, "z" * 300), (102, None), (103, ""), (104, "y" * 49), (105, "y" * 49)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_strings_planted(spark, seed):
    rows = planted(seed)
    assert cut(suffix_dedup.suffix_dedup(frame(spark, rows).repartition(3))) == brute.repeats(rows)


@pytest.mark.parametrize("size", [1, 37, 200])
def test_a_cut_text_has_the_anchors_of_the_whole(size):
    text = "".join(t for _, t in planted(5) if t).encode()
    whole = {(h, p) for _, h, _, p, _ in [suffix_dedup.anchors(next(suffix_dedup.parts([text])))]
             for h, p in zip(h.tolist(), p.tolist(), strict=True)}
    cut = set()
    for held in suffix_dedup.parts([b"", text], size):
        _, hashes, number, place, _ = suffix_dedup.anchors(held)
        assert set(number.tolist()) <= {1}
        cut |= set(zip(hashes.tolist(), place.tolist(), strict=True))
    assert cut == whole


def test_strings_of_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLAB", 64)
    rows = planted(4)
    assert cut(suffix_dedup.suffix_dedup(frame(spark, rows).repartition(3))) == brute.repeats(rows)


def test_strings_hot_anchors_are_split(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    rows = planted(3)
    assert cut(suffix_dedup.suffix_dedup(frame(spark, rows).repartition(3))) == brute.repeats(rows)


@pytest.mark.parametrize("hot", [0, suffix_dedup.HOT])
def test_repeats_within_a_document_are_emitted_once(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = np.random.default_rng(11)
    line = bytes(rng.integers(97, 123, 90).tolist()).decode()  # returns further than 50 bytes apart
    long = "x" + "-" * 9000 + "y" + "ab " * 900 + line * 60
    rows = [(1, long), (1, long), (2, "-" * 300 + line + "ab " * 40), (3, "z" + "-" * 5000 + line[:70])]
    docs = frame(spark, rows).coalesce(1)
    held = np.zeros(1 << (suffix_dedup.FILTER_BITS - 3), dtype=np.uint8) + 255
    is_hot = np.full(1 << (suffix_dedup.HOT_BITS - 3), 0 if hot else 255, dtype=np.uint8)
    shared = spark.sparkContext.broadcast((held, is_hot))
    unpack = zstandard.ZstdDecompressor().decompress
    sent = [r for r in suffix_dedup.windows(docs, 4, 8, shared).collect() if r["width"]]
    windows = sum(len(unpack(r["windows"])) // r["width"] for r in sent)
    assert windows < 1500
    assert cut(suffix_dedup.suffix_dedup(docs)) == brute.repeats(rows)


def test_strings_null_and_equal_ids(spark):
    long = "the same long text " * 8
    rows = [(None, long), (1, long), (1, long), (2, long)]
    left = suffix_dedup.suffix_dedup(frame(spark, rows)).collect()
    removed = sorted((r["doc_id"] or 0, r["n_removed"]) for r in left)
    assert removed == [(0, 0), (1, 0), (1, 0), (2, len(long))]
    assert suffix_dedup.suffix_dedup(frame(spark, [])).count() == 0


def test_strings_of_any_ids(spark):
    """Text ids compare as texts and come back as they were; others by their order."""
    shared = "the same fifty bytes and more in several documents, word by word"
    rows = [("b", f"one {shared}"), ("a", f"{shared} two"), ("10", "short"), ("9", shared), (None, shared), ("\u00e9", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    order = {d: k for k, d in enumerate(sorted(d for d, _ in rows if d is not None))}
    wanted = brute.repeats([(order[d], t) for d, t in rows if d is not None])
    found = {r["doc_id"]: r for r in suffix_dedup.suffix_dedup(df).collect()}
    assert suffix_dedup.suffix_dedup(df).schema["doc_id"].dataType.simpleString() == "string"
    assert {d: (found[d]["n_bytes"], found[d]["n_removed"], found[d]["n_spans"]) for d in order} == {
        d: wanted[k][:3] for d, k in order.items()
    }
    assert found[None]["n_removed"] == 0 and len(found) == 6
    dated = df.select(F.expr("DATE '2020-01-01' + CAST(length(doc_id) AS INT)").alias("doc_id"), "text")
    assert suffix_dedup.suffix_dedup(dated).count() == 6


def test_intervals_against_direct_comparison():
    rng = np.random.default_rng(5)
    for _ in range(30):
        n, columns, length = int(rng.integers(1, 30)), 14, 6
        window = rng.integers(97, 99, (n, columns)).astype(np.uint8)
        for r in range(n):
            window[r, : rng.integers(0, 4)] = suffix_dedup.PAD
        doc = rng.integers(0, 8, n)
        expected = np.zeros((n, columns - length + 1), dtype=bool)
        for k in range(columns - length + 1):
            strings = [w[k : k + length].tobytes() for w in window]
            for r in range(n):
                smaller = any(strings[q] == strings[r] and doc[q] < doc[r] for q in range(n))
                expected[r, k] = smaller and suffix_dedup.PAD not in strings[r]
        assert (suffix_dedup.covered_starts(window, doc, length) == expected).all()


# --- SimHash ----------------------------------------------------------------


def check_groups(df, rows):
    prints = {}
    for doc, text in rows:
        prints.setdefault(brute.simhash(text), []).append(doc)
    group = brute.components(prints)
    least = {}
    for held, members in prints.items():
        known = [m for m in members if m is not None]
        if known:
            least[group[held]] = min([least.get(group[held], known[0]), *known])
    expected = Counter(
        (doc, f"{brute.simhash(text):016x}", least.get(group[brute.simhash(text)]))
        for doc, text in rows
    )
    found = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect())
    assert found == expected


def test_simhash_all(docs, rows):
    check_groups(simhash.near_duplicates(docs), rows)


def test_simhash_odd_rows(spark):
    odd = [
        (1, None), (2, ""), (3, " \t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two three"),
        (None, "one"), (4, "one"), (8, "é É  x y z"), (9, "w " * 70_000),
    ]
    check_groups(simhash.near_duplicates(frame(spark, odd)), odd)
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_golay_code_is_perfect():
    words = np.arange(1 << 23, dtype=np.int64)
    index = simhash.codeword_index(words)
    assert (np.bincount(index, minlength=4096) == 2048).all()


def test_links_find_all_pairs_within_three_bits(spark):
    rng = random.Random(4)
    prints = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        prints.add(base)
        for _ in range(6):
            other = base
            for b in rng.sample(range(64), rng.randint(1, 4)):
                other ^= 1 << b
            prints.add(other)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    expected = {
        (min(a, b), max(a, b))
        for i, a in enumerate(signed)
        for b in signed[:i]
        if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3
    }
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "print long")).collect()
    assert {(r["low"], r["high"]) for r in found} == expected and len(found) == len(expected)


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101)]
    df = spark.createDataFrame(edges, "low long, high long")
    roots = {r["node"]: r["root"] for r in simhash.components(df).collect()}
    assert roots == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100}


def test_drop_near_copies(spark):
    text = "a text of some words that is long enough to be told from others"
    df = frame(spark, [(3, text), (1, text), (1, text), (2, "other words"), (None, None)]).withColumn(
        "print", F.lit("kept")
    )
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == {1: 1, 2: 1, None: 1}
