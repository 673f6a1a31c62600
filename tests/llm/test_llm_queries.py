"""The registered corpus queries: SQL where there is some, the pipeline's stages, and lost rows."""

from __future__ import annotations

import subprocess
import sys
from collections import Counter
from pathlib import Path

import brute
import oracle
import pytest

import __spark_entry__ as registry
import corpus_pipeline
from tillroll.llm import packing, queries
from tillroll.llm.common import scan, stage_table

ROOT = Path(__file__).resolve().parents[2]


def test_all_are_registered():
    names = {n.split("_")[0] for n in registry.queries() if n.startswith("op")}
    assert names == {f"op{n}" for n in range(1, 14)} and "pipeline" in registry.queries()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, sf, name):
    with oracle.connect(sf) as con:
        rows, problem = oracle.compare(queries.QUERIES[name](spark, sf), con, queries.SQL[name])
    assert problem is None and rows > 0, problem


COLUMNS = {
    "op1": "doc_id piece start length ids_crc32 sequence_id offset",
    "op2": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op3": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op4": "doc_id keep_id group_size kept text_sha256",
    "op5": "doc_id n_lines n_removed n_spans kept_sha256",
    "op6": "doc_id n_bytes n_tokens over_limit",
    "op7": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op8": "doc_id held_out score predicted",
    "op9": "doc_id held_out n_tokens n_known train_tokens base_score score bits_per_byte",
    "op10": "doc_id fingerprint component_id",
    "op11": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    "op12": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op13": "word n n_near form form_n root",
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    assert df.columns == COLUMNS[name.split("_")[0]].split()


def test_pipeline_stages(spark, sf):
    """Each stage against brute force on what it was given."""
    given = scan(spark, sf)
    for name, stage in corpus_pipeline.STAGES:
        left = stage_table(stage(spark, given, sf), "test")
        rows = [(r["doc_id"], r["text"]) for r in given.collect()]
        if name == "best_fit_packing":
            assert {r["doc_id"] for r in left.collect()} == {doc for doc, _ in rows}
            assert left.columns == packing.pack(given).columns
            break
        assert left.columns == given.columns
        kept = Counter(r["doc_id"] for r in left.collect())
        if name == "quality_classifier":
            labels = {r["doc_id"]: r["quality"] for r in scan(spark, sf, "labels").collect()}
            wrong = [d for d, _ in rows if d in labels and (d in kept) != (labels[d] == 1)]
            assert len(wrong) <= 0.05 * len(labels)
        elif name == "exact_dedup":
            expected = Counter(row[0] for row in brute.exact(rows).elements() if row[3])
            assert kept == expected
        elif name == "simhash_near_dedup":
            prints = {doc: brute.simhash(text) for doc, text in rows}
            group = brute.components({p: None for p in prints.values()})
            least = {}
            for doc in sorted(prints, reverse=True):
                least[group[prints[doc]]] = doc
            assert kept == Counter(least.values())
        elif name == "benchmark_decontamination":
            items = [(r["item_id"], r["text"]) for r in scan(spark, sf, "benchmark").collect()]
            clean = [row[0] for row in brute.contamination(rows, items) if not row[-1]]
            assert kept == Counter(clean)
        given = left


def test_pipeline_order_and_run(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "exact_dedup", "simhash_near_dedup",
        "benchmark_decontamination", "best_fit_packing",
    ]
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_nothing_else_imports_the_package():
    lines = [
        (path, line)
        for path in (ROOT / "tillroll").rglob("*.py")
        if "llm" not in path.relative_to(ROOT / "tillroll").parts
        for line in path.read_text().splitlines()
    ]
    assert not [x for x in lines if "llm" in x[1]]


@pytest.mark.parametrize("missing", ["corpus_pipeline", "tillroll.llm", "tiktoken", "zstandard", "xxhash"])
def test_entry_without_the_package(missing):
    """The other queries load where the corpus operators, or a library of theirs, are missing."""
    code = (
        "import sys\n"
        "class Missing:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        f"        if name == {missing!r}:\n"
        "            raise ModuleNotFoundError(f'No module named {name!r}', name=name)\n"
        "sys.meta_path.insert(0, Missing())\n"
        "import __spark_entry__ as e\n"
        "names = e.queries()\n"
        "assert len(names) >= 60 and not [n for n in names if n.startswith('op') or n == 'pipeline']\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
