"""Chat formatting, filter audit and importance resampling against brute force."""

from __future__ import annotations

import hashlib
import json
import math
import re
import struct
import threading
import zlib
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from itertools import permutations

import numpy as np
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabloom.llm import chat_format, filter_audit, mixing, nn_descent, resampling, token_rollup
from tabloom.llm.common import Store
from tabloom.llm.queries import op11_chat_formatting, op12_filter_audit, op13_importance_resampling

SF = "/root/testdata/sf0.001"


def plain_audit(docs, labels):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    ids = {}
    for i, text, _ in docs:
        ids.setdefault(text or "", []).append(i)
    rows = []
    for i, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and any(j is not None and j < i for j in ids[text]),
        }
        rows.append((source or "", fails, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                lost = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                failing = [r for r in rows if r[0] == part and r[1][f]]
                out[part, order, step] = [len(left), len(lost), len(failing) - len(lost), sum(sum(r[1].values()) == 1 for r in failing), sum(r[2] for r in lost), sum(r[3] for r in lost)]
                total[f] += len(lost)
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(df):
    got = {}
    for r in df.collect():
        assert r["filter"] == r.filter_order[r.step - 1]
        assert (r.part, r.filter_order, r.step) not in got
        got[r.part, r.filter_order, r.step] = (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
    return got


def test_audit_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()
    assert audited(op12_filter_audit(spark, SF)) == plain_audit(docs, labels)


def test_audit_odd_rows(spark):
    some = "one two three four five " * 20
    docs = [(1, some, "a"), (2, some, "b"), (2, some, "b"), (3, None, None), (4, "", ""), (None, some, "a"), (None, None, None), (5, "A# " * 60, "a")]
    docs += [(6, "w%d " * 3000 % tuple(range(3000)), "long"), (7, "x" * 200_000, "long"), (7, "other $", "a"), (8, "other $", "a"), (9, "É" * 30 + "ABC", "a")]
    labels = [(1, 1, 0), (1, None, None), (2, 0, 1), (2, 1, 0), (None, 1, 1), (7, None, 1), (99, 1, 1)]
    df = spark.createDataFrame([(*d, 7, "kept", 1) for d in docs], "doc_id long, text string, source string, mask int, part string, docs int").repartition(3)
    marks = spark.createDataFrame([(*x, "t") for x in labels], "doc_id long, quality int, toxic int, text string")
    assert audited(filter_audit.audit(df, marks)) == plain_audit(docs, labels)
    assert filter_audit.audit(df.limit(0), marks).count() == 0
    assert audited(filter_audit.audit(df, marks.limit(0))) == plain_audit(docs, [])


def test_audit_of_other_filters(spark):
    df = spark.createDataFrame([(1, "a b", "s"), (2, "b", "s"), (3, "a", "s")], "doc_id long, text string, source string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = filter_audit.audit(df, marks, {"a": lambda text, words: F.array_contains(words, "a"), "b": lambda text, words: F.array_contains(words, "b")})
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in found.collect()}
    assert got == {("ab", 1): (1, 2, 0, 1, 3), ("ab", 2): (0, 1, 1, 1, 3), ("ba", 1): (1, 2, 0, 1, 3), ("ba", 2): (0, 1, 1, 1, 3)}
    with pytest.raises(ValueError, match="one to seven"):
        filter_audit.audit(df, marks, {})


def test_audit_reads_texts_once_and_spreads_copies(spark):
    plan = filter_audit.audit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))._jdf.queryExecution().toString()
    assert "documents.parquet" not in plan  # narrow rows are stored
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


# op13


def alnum_words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_features(text, run, buckets):
    words = alnum_words(text)
    return [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, run + 1) for i in range(len(words) - n + 1)]


def plain_resample(docs, target, run=2, buckets=10_000):
    """Of each document, in order: doc_id, n_features, weight, score, rank."""
    found = [plain_features(t, run, buckets) for _, t in docs]
    s = Counter(b for f in found for b in f)
    t = Counter(b for x in target for b in plain_features(x, run, buckets))
    s_all, t_all = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (s_all + buckets) / ((s[b] + 1.0) * (t_all + buckets)))) for b in range(buckets)]
    rows = []
    for (i, text), f in zip(docs, found, strict=True):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        rows[-1].append(len(alnum_words(text)) >= 20)
    may = sorted((r for r in rows if r[-1]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(may[: 25 * len(may) // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in rows]


def resampled(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


def test_resampling_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert resampled(op13_importance_resampling(spark, SF)) == sorted(plain_resample(docs, target), key=str)


@pytest.mark.parametrize("run,size", [(2, 64), (3, 50), (1, 16_384)])
def test_resampling_odd_rows_and_chunks(spark, run, size):
    some = " ".join(f"word{i % 37}" for i in range(60))
    docs = [(1, None), (2, ""), (3, "!!"), (4, some), (4, some), (4, some), (None, some), (5, some + " More."), (5, "other " + some), (6, "éÉ naïve\x1cb " * 30), (7, "x" * 5000 + " y " + "z" * 300)]
    docs += [(8, " ".join(f"w{i * i % 1009}" for i in range(20_000))), (9, "  \n" + some.upper() + "\n" * 500 + some), (10, "one"), (11, "a b " * 10)]
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, words string, row int").repartition(4)
    target = ["word1 word2 more", None, "", some]
    marks = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    want = sorted(plain_resample(docs, target, run, 501), key=str)
    got = resampled(resampling.resample(df, marks, run=run, buckets=501, size=size))
    # rows equal in all but the rank are interchangeable
    assert Counter(r[:4] for r in got) == Counter(r[:4] for r in want) and sorted(r[4] or 0 for r in got) == sorted(r[4] or 0 for r in want)
    assert {r for r in got if r[0] != 4} == {r for r in want if r[0] != 4}
    assert resampling.resample(df.limit(0), marks).count() == 0
    assert resampled(resampling.resample(df, marks.limit(0))) == sorted(plain_resample(docs, []), key=str)


def test_chunks_own_each_start_once():
    text = ("Ab cé " * 50 + "y" * 40 + "\n\n  last one").encode()
    for run, size in ((1, 7), (2, 1), (3, 20), (4, 10_000)):
        found = [b for p, n in resampling.pieces(text, run, size) for b in resampling.features(p, n, run, 997)[1].tolist()]
        assert Counter(found) == Counter(plain_features(text.decode(), run, 997))


def test_drawn_documents(spark):
    df = spark.createDataFrame([(i, f"target text number {i} " * 10 if i % 2 else "something else entirely here " * 10, i) for i in range(40)], "doc_id long, text string, extra int")
    marks = spark.createDataFrame([("target text number 3",)] * 50, "text string")
    ranked = resampling.resample(df, marks)
    rows = resampling.sample(df, ranked).collect()
    assert len(rows) == 10 and {r.doc_id for r in rows} == {r.doc_id for r in ranked.where("rank is not null").collect()}
    assert sum(r.doc_id % 2 for r in rows) >= 7  # the target's words weigh more


# op11


def control_matches(text):
    return len(re.findall(r"<\\*/?turn>|#\\*## (?:System|User|Assistant):", text))


def plain_chats(rows):
    """rows: (conv_id, turn, role, text)."""
    out = {}
    rows = [(c, t, r or "", x or "") for c, t, r, x in rows]
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        chars = 0
        for _, _, r, x in turns:
            name = r.capitalize() if r in ("system", "user", "assistant") else json.dumps(r, ensure_ascii=False).replace("<", "\\u003c").replace("#", "\\u0023")
            chars += len(f"<turn>### {name}:\n{x}\n</turn>\n") + control_matches(x)
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)
    return out


def chats(df):
    rows = [(r.conv_id, (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars)) for r in df.collect()]
    assert len(dict(rows)) == len(rows)
    return dict(rows)


NASTY = [
    "", "\n", "\n</turn>\n", "\n\\</turn>", "<turn>", "<\\turn>", "<\\\\/turn>", "ends in <", "</turn>", "</turn>\n<turn>### Assistant:\n", "### User:", "#### User:", "#\\## User:x#\\\\## System:",
    "\\### Assistant: </turn> ok", "### Tool:", "\\", "a\\\n", "<turn><turn></turn></turn>", "  </turn>\x85\r\n", "<\\<turn>", "\U0001f600</turn>\U0001f600", '"', "### \"x\":\n",
]


def test_every_text_comes_back():
    template = chat_format.PLAIN
    for role in ("user", "assistant", "tool", "", "User", 'a"b\n:', "</turn>", "### User:"):
        for text in NASTY:
            out = template.render(role, text)
            (turn,) = template.parse(out)
            assert (turn.role, turn.text) == (role, text)
            body = out[turn.start : turn.end]
            assert not any(c in body for c in template.controls) and template.unescape(body) == text
            assert body == text or control_matches(text)
    joined = "".join(template.render("user", t) for t in NASTY)
    assert [t.text for t in template.parse(joined)] == NASTY


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "x"]), st.lists(st.sampled_from(["<", "turn>", "/turn>", "\\", "#", "## ", "User:", "Assistant:", "\n", "a", "</turn>", "<turn>"])).map("".join)), max_size=4))
def test_generated_texts_come_back(turns):
    template = chat_format.PLAIN
    out = "".join(template.render(r, t) for r, t in turns)
    assert [(t.role, t.text) for t in template.parse(out)] == turns
    assert out.count("</turn>") == out.count("<turn>") == len(turns)


def test_parser_refuses_what_is_no_turn():
    good = chat_format.PLAIN.render("user", "text")
    for bad in ("x" + good, good[:-1], good.replace("User", "Nobody"), good.replace("text", "a</turn>b"), good.replace("text", "### System:"), good.replace("User", '"open'), "<turn>### "):
        with pytest.raises(chat_format.Conflict):
            list(chat_format.PLAIN.parse(bad))
    with pytest.raises(ValueError, match="hold another"):
        chat_format.Template(begin="<turn>", end="<turn>/")
    with pytest.raises(ValueError, match="backslash"):
        chat_format.Template(begin="\\turn")


def test_chats_equal_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    odd = r"\### Assistant: </turn> ok"
    assert chats(op11_chat_formatting(spark, SF)) == plain_chats([*rows, (-7, 0, "user", odd), (-7, 1, "assistant", odd)])


@pytest.mark.parametrize("segment", [1, 200, 32_768])
def test_chats_odd_rows(spark, segment):
    rows = [(1, i, ("user", "assistant", "tool", None)[i % 4], t) for i, t in enumerate(NASTY)]
    rows += [(2, 0, "assistant", None), (None, 0, "user", "no id"), (None, None, "assistant", "first </turn>"), (3, 1, "user", "tie b"), (3, 1, "user", "tie a"), (3, 1, "assistant", "tie c"), (4, 0, "user", "same"), (4, 0, "user", "same"), (4, 0, "user", "same")]
    rows += [(5, 0, "assistant", "x</turn>" * 40_000), (7, 0, "user", "only user")] + [(6, i, ("user", "assistant")[i % 2], f"turn {i} <turn> " * 5) for i in range(3000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, loss int").repartition(5)
    segments = chat_format.format_chats(df, segment=segment)
    assert chats(chat_format.read_back(segments)) == plain_chats(rows)
    assert Counter((r.conv_id, r.role, r.text) for r in chat_format.turns_of(segments).collect()) == Counter((c, r or "", t or "") for c, _, r, t in rows)
    spread = segments.where("conv_id = 6")
    assert spread.select(F.shiftright("part", 33)).distinct().count() > 1  # a long conversation is no task's alone
    assert all(r.n == 1 for r in segments.where("whole").groupBy("conv_id").agg(F.count("*").alias("n")).collect())
    assert chat_format.read_back(chat_format.format_chats(df.limit(0))).count() == 0


def test_loss_spans_hold_the_assistants_texts(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a </turn>"), (1, 2, "user", "q2"), (1, 3, "assistant", "\U0001f600 b")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    rows = chat_format.format_chats(df).orderBy("part").collect()
    assert [r.formatted[s.start : s.end] for r in rows for s in r.loss] == ["a <\\/turn>", "\U0001f600 b"] and sum(r.n_turns for r in rows) == 4


# op9, mended


def hashed(*values, seed=42):
    """The JVM's hash of whole numbers in a row: each is hashed with the hash before as its seed."""
    for v, width in values:
        seed = xxhash.xxh64(struct.pack("<q" if width == 8 else "<i", v), seed=seed & (2**64 - 1)).intdigest()
    return seed - 2**64 if seed >= 2**63 else seed


def plain_rounding(units, seed, chain):
    """units: (source, k, d, s, f). Chains of pairs by falling size, level by level, as the docstring of ``mixing`` says."""
    u = lambda *v: (hashed(*v) % (1 << 52) + 0.5) / (1 << 52)
    up, level, sizes = {}, {}, Counter(x[0] for x in units)
    for source, k, d, s, f in units:
        level.setdefault((source, hashed((k, 8), (d, 8), (seed, 4)) % -(-sizes[source] // chain)), []).append((s, k, d, f))
    most, depth = max(-(-n // chain) for n in sizes.values()), 0
    while True:
        above = {}
        for (source, bucket), held in level.items():
            carry = None
            for s, k, d, f in sorted(held, key=lambda x: (-x[0], x[1], x[2])):
                if carry is None:
                    carry = (s, k, d, f)
                    continue
                s0, k0, d0, f0 = carry
                gain, loss = min((1 - f0) * s0, f * s), min(f0 * s0, (1 - f) * s)
                if u((k0, 8), (d0, 8), (k, 8), (d, 8), (seed + depth, 4)) * (gain + loss) < loss:
                    full = gain == (1 - f0) * s0
                    ended, carry = ((k0, d0, 1), (s, k, d, f - gain / s)) if full else ((k, d, 0), (s0, k0, d0, f0 + gain / s0))
                else:
                    empty = loss == f0 * s0
                    ended, carry = ((k0, d0, 0), (s, k, d, f + loss / s)) if empty else ((k, d, 1), (s0, k0, d0, f0 - loss / s0))
                up[ended[:2]] = ended[2]
                carry = (*carry[:3], max(0.0, min(1.0, carry[3])))
            above.setdefault((source, bucket // chain), []).append(carry)
        level, depth = above, depth + 1
        if most <= 1:
            break
        most = -(-most // chain)
    for held in level.values():
        for _, k, d, f in held:
            up[k, d] = int(u((k, 8), (d, 8), (seed, 4)) < f)
    return up


@pytest.mark.parametrize("n,chain", [(1, 4), (7, 64), (200, 5), (700, 4)])
def test_chains_replayed(spark, n, chain):
    units = [("a" if i % 3 else None, hashed((i, 8)), i, float(i % 11 + 1), (i * 37 % 100 + 0.5) / 101) for i in range(n)]
    df = spark.createDataFrame(units, "source string, k long, d long, s double, f double").repartition(4)
    got = {(r.k, r.d): r.up for r in mixing.round_together(df, Store(spark, "replay"), "x", 5, chain).collect()}
    assert got == plain_rounding(units, 5, chain) and len(got) == n


def test_mix_takes_repeated_rows_in_part(spark):
    # 9,000 equal rows and 1,000 others in a source, and some that are much larger than the mean
    rows = [(7, "four words are here", "a", i) for i in range(9000)] + [(i, "w " * (i % 5 + 1), "a", i) for i in range(100, 1100)]
    rows += [(8, "w " * 300, "b", i) for i in range(50)] + [(9, "w " * 3, "b", i) for i in range(400)] + [(None, "no id", None, i) for i in range(77)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, more int").repartition(6)
    found = mixing.mix(df).collect()
    assert sorted(r.more for r in found) == sorted(r[3] for r in rows)  # every row once
    sizes, taken, target = Counter(), Counter(), {}
    for r in found:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken == r.size * r.copies <= 3 * r.size
    assert all(abs(taken[s] - target[s]) <= {"a": 5, "b": 300, None: 2}[s] for s in sizes), (taken, target)
    assert len({r.copies for r in found if r.doc_id == 7}) <= 2
    ids = lambda rs: Counter((r.doc_id, r.taken) for r in rs)
    assert ids(found) == ids(mixing.mix(df.repartition(3)).collect())


def test_sources_meet_rows_without_a_hot_task(spark):
    rows = spark.createDataFrame([(("hot" if i % 3 else f"s{i}"), i, i) for i in range(300)] + [(None, 1, 1)], "source string, k long, d long")
    held = Store(spark, "sources").keep(rows.groupBy("source").agg(F.count("*").alias("n")), "n")
    few, many = mixing.with_source(rows, held), mixing.with_source(rows, held, most=5)
    assert sorted(map(str, few.collect())) == sorted(map(str, many.select(few.columns).collect())) and few.count() == 301
    assert "BroadcastHashJoin" in few._jdf.queryExecution().toString()
    none = mixing.with_source(rows, held.where("source = 'hot'"), left=True, most=0)
    assert none.where("n is null").count() == 101


# op6 and op8, mended


def row_nearest(rows, asks, k=5):
    """Of each row that asks: sorted (score, id) of its k nearest other rows."""
    most = max(len(v) for _, v in rows)
    fit = [(i, np.array([*v, *[0.0] * (most - len(v))], np.float32).astype(float)) for i, v in rows]
    out = {}
    for a, (i, v) in enumerate(fit):
        if asks(i):
            scored = sorted((-(v @ w) / (np.sqrt(v @ v) * np.sqrt(w @ w)), j) for b, (j, w) in enumerate(fit) if b != a)
            out.setdefault(i, []).append([(round(-s, 6), j) for s, j in scored[:k]])
    return {i: sorted(v) for i, v in out.items()}


@pytest.mark.parametrize("ragged", [False, True])
def test_rows_that_share_ids_and_vectors_of_unlike_lengths(spark, ragged):
    rng = np.random.default_rng(4)
    rows = [(i if i % 60 else 50, rng.standard_normal(8 if not ragged or i % 3 else 5).astype(np.float32).tolist()) for i in range(300)]
    rows += [(50, rows[7][1]), (50, rows[7][1]), (99, rows[7][1]), (100, rows[200][1]), (200, rows[201][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    found = nn_descent.nearest(df, F.col("vec_id") % 50 == 0).collect()
    want = row_nearest(rows, lambda i: i % 50 == 0)
    assert Counter(r.query_id for r in found) == {i: 5 * len(v) for i, v in want.items()}
    got = {i: Counter((round(r.score, 6), r.vec_id) for r in found if r.query_id == i) for i in want}
    hits = sum((got[i] & Counter(x for each in v for x in each)).total() for i, v in want.items())
    assert hits >= 0.95 * len(found)  # with so few rows the search is all but exact
    assert Counter(r["rank"] for r in found) == {n: len(found) // 5 for n in range(1, 6)}


def batch(spark, n):
    return spark.createDataFrame([("s", "en", "v", n)], "source string, lang string, tokenizer string, n_tokens long")


def test_one_of_many_writers_commits(spark, tmp_path):
    rollup = token_rollup.Rollup(spark, f"file://{tmp_path}/rollup")
    frames = [batch(spark, 10**i) for i in range(4)]
    start = threading.Barrier(4)

    def write(i):
        start.wait()
        return token_rollup.Rollup(spark, rollup.root).apply("one", inserts=frames[i])

    with ThreadPoolExecutor(4) as pool:
        won = list(pool.map(write, range(4)))
    assert sum(won) == 1
    took = []
    with ThreadPoolExecutor(8) as pool:  # the claim itself, many times
        for i in range(50):
            took.append(sum(pool.map(lambda _, i=i: rollup._take(rollup._path(f"{rollup.root}/claims/x-{i}"), "aside"), range(8))))
    assert took == [1] * 50
    assert [(r.docs, r.tokens) for r in rollup.totals().collect()] == [(1, 10 ** won.index(True))]


def test_a_lost_writers_batch_is_finished(spark, tmp_path, monkeypatch):
    rollup = token_rollup.Rollup(spark, f"file://{tmp_path}/rollup")
    monkeypatch.setattr(token_rollup.Rollup, "_finish", lambda *a: None)  # lost between claim and move
    assert rollup.apply("a", inserts=batch(spark, 3))
    monkeypatch.undo()
    assert rollup.batches() == set() and rollup.totals().count() == 0
    assert not rollup.apply("a", inserts=batch(spark, 3))  # sent again: moved, not counted twice
    assert rollup.batches() == {"a"} and [r.tokens for r in rollup.totals().collect()] == [3]


def test_totals_planned_before_a_compaction_can_be_read(spark, tmp_path):
    rollup = token_rollup.Rollup(spark, f"file://{tmp_path}/rollup")
    for i in range(3):
        rollup.apply(f"b{i}", inserts=batch(spark, i + 1))
    planned = rollup.totals()
    rollup.compact()
    assert [r.tokens for r in planned.collect()] == [6]
    rollup.apply("b3", inserts=batch(spark, 10))
    planned = rollup.totals()
    rollup.compact()
    assert [r.tokens for r in planned.collect()] == [r.tokens for r in rollup.totals().collect()] == [16]
    assert rollup.batches() == {"b0", "b1", "b2", "b3"} and not rollup.apply("b1", inserts=batch(spark, 1))
