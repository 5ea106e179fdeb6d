"""The pipeline, stage by stage, against brute force on a small table."""

import gc
import importlib
import re
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tabloom.llm import decontaminate, queries, token_ids
from tabloom.llm.common import read, release
from tests.llm.test_joins_and_scans import brute_components
from tests.llm.test_round_one import ODD, brute_hits, brute_targets, odd

NAMES = ["language ID", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """What each stage returned, written and read again."""
    root = tmp_path_factory.mktemp("stages")
    out = [read(spark, sf_dir, "documents")]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], sf_dir).write.parquet(f"file://{root}/{i}")
        out.append(spark.read.parquet(f"file://{root}/{i}"))
    return out


def test_stages_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    assert all(df.columns == corpus_pipeline.COLUMNS for df in stages[:-1])


def test_language_stage_keeps_clean_documents(stages):
    before, after = stages[0].count(), stages[1].count()
    assert 0.97 * before <= after <= before


def test_one_document_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    want = {d for d, n, c in brute_components(rows) if not n or d == c}
    assert {r.doc_id for r in stages[2].collect()} == want and stages[2].count() == len(want) < len(rows)


def test_near_copies_go_by_row_not_by_id(spark):
    base = [f"w{i}" for i in range(60)]
    near, other, lone = " ".join(base), " ".join(base[:-1] + ["z"]), " ".join(f"u{i}" for i in range(30))
    rows = [
        *[(None, "all of these have no id at all")] * 3,  # one stays
        (None, near), (7, other), (7, near), (3, other), (3, near), (3, lone),  # one of id 3 stays, and lone
        (9, "a text of its own under nine"), (9, lone), (None, lone),  # the text of its own stays
        (None, ""), (None, ""), (None, None), (4, None), (4, None),  # without words: no copies; equal rows of an id merge
    ]
    docs = spark.createDataFrame([(d, t, "en", "a", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, "").collect()]
    kept = [x for x in got if x in ((3, near), (3, other))]
    want = [(None, "all of these have no id at all"), (3, lone), (9, "a text of its own under nine"), (None, ""), (None, ""), (None, None), (4, None)]
    assert len(kept) == 1 and sorted(map(str, got)) == sorted(map(str, want + kept))


def test_benchmark_passages_are_gone_and_clean_texts_untouched(spark, sf_dir, stages):
    items = [(r.item_id, r.text) for r in read(spark, sf_dir, "benchmark").collect()]
    old = {r.doc_id: r.text for r in stages[2].collect()}
    new = {r.doc_id: r for r in stages[3].collect()}
    cut = 0
    for d, text in old.items():
        n, hit, *_ = brute_hits(text, items)
        if hit > 0.5 * n:
            assert d not in new
            continue
        assert (new[d].text == text) == (hit == 0)
        assert brute_hits(new[d].text, items)[1] == 0 and new[d].n_chars == len(new[d].text)
        cut += hit > 0
    assert cut


def test_short_items_are_cut_too(spark, tmp_path, monkeypatch):
    """Items of one word and more, with passages that come together only by a cut."""
    rng = np.random.default_rng(6)
    items = [(1, "zebra"), (2, "left right"), (3, "One two, three four five"), (4, " ".join(f"n{i}" for i in range(9))), (5, " ".join(f"w{i}" for i in range(12)))]
    items += [(6, "ab " + items[2][1]), (7, " ".join(["again"] * 3))]
    said = [t for _, t in items] + ["left zebra right", "left left zebra right right", " ".join(f"w{i}" for i in range(3, 13)), "one two three", "again"]
    docs = []
    for i in range(60):
        parts = [f"x{i}y{j}" for j in range(int(rng.integers(20, 60)))]
        for at in rng.integers(0, len(parts), int(rng.integers(0, 4))):
            parts.insert(at, said[rng.integers(len(said))].upper())
        docs.append((i, " ".join(parts), "en", "a", 1))
    docs += [(60, "a zebra b c", "en", "a", 11), (61, None, "en", "a", None), (62, items[2][1], "en", "a", 1)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    for limit in (10**6, 12):
        monkeypatch.setattr(decontaminate, "AUTOMATON_WORDS", limit)
        df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
        new = {r.doc_id: r for r in corpus_pipeline.benchmark_passages(spark, df, f"file://{tmp_path}").collect()}
        changed = 0
        for d, text, *_ in docs:
            n, hit, *_ = brute_hits(text, items)
            assert (d in new) == (hit <= 0.5 * n)
            if d in new:
                assert brute_hits(new[d].text, items)[1] == 0 and (hit > 0 or new[d].text == text)
                kept = (new[d].text or "").split()
                assert [w for w in kept if w.startswith("x")] == [w for w in (text or "").split() if w.startswith("x")]
                changed += hit > 0
        assert changed > 20 and new[60].text == "a  b c" and new[60].n_chars == 6 and 62 not in new


def test_mix_takes_near_targets(stages):
    size = lambda t: len(decontaminate.re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    before, after = stages[3].collect(), stages[4].collect()
    sizes, taken, most = {}, {}, {}
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
        most[r.source] = max(most.get(r.source, 0), size(r.text))
    for r in after:
        taken[r.source] = taken.get(r.source, 0) + size(r.text)
    for s, t in brute_targets(sizes).items():
        assert abs(taken.get(s, 0) - t) <= most[s]


def test_ids_are_the_tokenizers(spark, sf_dir, stages):
    tokenizer = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    want = sorted((r.doc_id, token_ids.crc([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1])) for r in stages[4].collect())
    rows = sorted(stages[5].collect(), key=lambda r: r.start)
    assert sorted((r.doc_id, r.ids_crc32) for r in rows) == want and [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))
    assert corpus_pipeline.run(spark, sf_dir).count() == len(rows)


def test_odd_rows_pass_every_stage(spark, sf_dir):
    docs = odd(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf_dir)
        assert got.columns == corpus_pipeline.COLUMNS and got.count() <= 3 * len(ODD)
    near = corpus_pipeline.near_copies(spark, docs, sf_dir).collect()
    assert sorted(str(r.doc_id) for r in near) == sorted(["None", "1", "2", "3", "4", "6", "7"])
    assert corpus_pipeline.ids(spark, docs, sf_dir).count() == len(ODD)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf_dir).count() == 0


def test_native_memory_of_the_driver_goes_back(spark):
    jvm = spark.sparkContext._jvm
    pid = jvm.org.apache.spark.util.Utils.getProcessName().split("@")[0]

    def resident() -> float:
        return int(re.search(r"VmRSS:\s+(\d+)", Path(f"/proc/{pid}/status").read_text())[1]) / 1024

    held = jvm.java.util.ArrayList()
    for _ in range(4000):
        held.add(jvm.java.nio.ByteBuffer.allocateDirect(64_000))
    last = held[3999]  # stays, so that the others are not at an end of the heap
    gc.collect()
    most = resident()
    del held
    for _ in range(10):  # buffers are freed some time after the JVM's garbage is
        release(spark)
        if resident() < most - 150:
            break
        time.sleep(0.3)
    assert resident() < most - 150 and last.capacity() == 64_000


def test_import_errors_are_not_swallowed():
    for name in ("corpus_pipeline", "tabloom.llm.queries", "tabloom.llm.common"):
        source = open(importlib.import_module(name).__file__, encoding="utf-8").read()
        assert "except ImportError" not in source and "except ModuleNotFoundError" not in source
    assert F is not None
