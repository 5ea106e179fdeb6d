"""One query for each operator, over its whole table, and their SQL for DuckDB."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import chat_format, decontaminate, filter_audit, histogram_sort, jaccard_join, language_id, lattice_lm, license_scan, mixing, nn_descent, resampling, token_ids, token_rollup
from tabloom.llm.common import Store, held_out, read

#: Where the public vocabularies are, as a module with ``path(name)``.
TOKENIZERS = "public_tokenizers"


def tokenizer_path(name: str) -> str:
    return importlib.import_module(TOKENIZERS).path(name)


def op1_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = histogram_sort.shard(read(spark, sf_dir, "documents").select("doc_id", "text"), 40)
    return sharded.select(
        "doc_id",
        "size",
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), held_out(10, 0))


def op3_frequency_ranked_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.round_trip(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language_id.fit(docs, ~held_out(4, 2))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def op5_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read(spark, sf_dir, "documents"))


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op7_diagonal_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents")).drop("spans")


def op8_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after five batches, one of them sent twice.

    All documents come in, counted in two ways; documents that repeat the text
    of one with a smaller id go; French ones are counted anew, by letters and
    digits where it was by white space; and the first deltas are folded.
    """
    store = Store(spark, "token-rollup")
    docs = read(spark, sf_dir, "documents")
    counted = store.keep(docs.select("doc_id", "source", "lang", F.sha2("text", 256).alias("digest"), *(token_rollup.n_tokens(v).alias(v) for v in token_rollup.VERSIONS)), "counted")
    rollup = token_rollup.Rollup(spark, f"{store.root}/rollup")
    space, alnum = (counted.select("doc_id", "source", "lang", F.lit(v).alias("tokenizer"), F.col(f"`{v}`").alias("n_tokens")) for v in token_rollup.VERSIONS)
    rollup.apply("arrivals-space", inserts=space)
    rollup.apply("arrivals-alnum", inserts=alnum)
    rollup.compact()
    kept = counted.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    repeats = space.unionByName(alnum).join(kept, "doc_id", "left_anti")
    rollup.apply("repeats", deletes=repeats)
    french = counted.where("lang = 'fr'").join(kept, "doc_id", "left_semi")
    anew = french.select("source", "lang", F.lit("space-1").alias("tokenizer"), F.col("`space-1`").alias("old_tokens"), F.col("`alnum-1`").alias("new_tokens"))
    rollup.apply("french-anew", revisions=anew)
    rollup.apply("repeats", deletes=repeats)
    return rollup.totals()


def op9_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.annotate(docs, read(spark, sf_dir, "benchmark"), unnamed=True)
    hit = decontaminate.n_hit()
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("hit_items"), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # its texts look like the template's own marks
    odd = r"\### Assistant: </turn> ok"
    chats = chats.unionByName(spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], chats.schema))
    return chat_format.read_back(chat_format.format_chats(chats))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return ranked.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    f.__name__: f
    for f in (
        op1_histogram_sort,
        op2_lattice_likelihood,
        op3_frequency_ranked_ids,
        op4_language_id,
        op5_token_group_join,
        op6_nn_descent,
        op7_diagonal_voting,
        op8_token_rollup,
        op9_pivotal_mix,
        op10_suffix_automaton,
        op11_chat_formatting,
        op12_filter_audit,
        op13_importance_resampling,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = rf"list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_ALNUM = rf"list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

#: The others have no SQL: training, learned weights, hash orders, graphs and tokenizers. Tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op5_token_group_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_SPACED} AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) BETWEEN 1 AND 4 THEN [array_to_string(ws, ' ')]
                     ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (SELECT x, y FROM met JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
        edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach(x, y) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.x, edges.y FROM reach JOIN edges ON reach.y = edges.x),
        least AS (SELECT x, min(y) AS component FROM reach GROUP BY x)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, w.doc_id) AS component_id
        FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN least ON least.x = w.doc_id""",
    "op10_suffix_automaton": f"""
        WITH d AS (SELECT doc_id, {_ALNUM} AS ws FROM documents),
        i AS (SELECT item_id, {_ALNUM} AS ws FROM benchmark),
        k AS (SELECT item_id, ws, least(10, len(ws)) AS k FROM i WHERE len(ws) > 0),
        windows AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda j: array_to_string(ws[j:j + k - 1], ' '))) AS g FROM k),
        spots AS (SELECT doc_id, k, unnest(range(1, len(ws) - k + 2)) AS j, ws FROM d, (SELECT DISTINCT k FROM k) WHERE len(ws) >= k),
        hits AS (SELECT doc_id, item_id, j, spots.k AS k FROM spots JOIN windows ON windows.k = spots.k AND windows.g = array_to_string(ws[j:j + spots.k - 1], ' ')),
        words AS (SELECT doc_id, count(DISTINCT spot) AS n FROM (SELECT doc_id, unnest(range(j, j + k)) AS spot FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)
        SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id""",
    "op8_token_rollup": r"""
        WITH counted AS (
            SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS space,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS alnum,
                   doc_id = min(doc_id) OVER (PARTITION BY text) AS first
            FROM documents)
        SELECT source, lang, 'space-1' AS tokenizer, count(*) AS docs,
               sum(CASE WHEN lang = 'fr' THEN alnum ELSE space END)::BIGINT AS tokens
        FROM counted WHERE first GROUP BY source, lang
        UNION ALL
        SELECT source, lang, 'alnum-1', count(*), sum(alnum)::BIGINT FROM counted WHERE first GROUP BY source, lang""",
    "op11_chat_formatting": r"""
        WITH chats AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                       UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, md5(text))) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, md5(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(21 + length(role) + length(text) + len(regexp_extract_all(text, '<\\*/?turn>|#\\*## (?:System|User|Assistant):')))::BIGINT AS formatted_chars
        FROM chats GROUP BY conv_id""",
    "op12_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                   list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        masks AS (SELECT doc_id, part, (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT
                  + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
                  + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM d),
        marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
        cells AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
                  FROM masks LEFT JOIN marks ON marks.doc_id = masks.doc_id GROUP BY part, mask),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
        orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM letters a, letters b, letters c, letters d, letters e
                   WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
        steps AS (SELECT o, s, o[s] AS f, 1 << (ascii(o[s]) - 65) AS bit,
                  list_sum(list_transform(range(1, s), lambda i: 1 << (ascii(o[i]) - 65))) AS passed FROM orders, (SELECT unnest(range(1, 6)) AS s)),
        met AS (SELECT part, o, s, f, n, good, toxic, mask = bit AS alone, mask & bit <> 0 AS own, mask & coalesce(passed, 0)::BIGINT <> 0 AS earlier
                FROM cells, steps),
        counted AS (SELECT part, o AS filter_order, s::INT AS step, f AS "filter", coalesce(sum(n) FILTER (NOT own AND NOT earlier), 0)::BIGINT AS kept,
                    coalesce(sum(n) FILTER (own AND NOT earlier), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (own AND earlier), 0)::BIGINT AS redundant,
                    coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (own AND NOT earlier), 0)::BIGINT AS good_lost,
                    coalesce(sum(toxic) FILTER (own AND NOT earlier), 0)::BIGINT AS toxic_lost FROM met GROUP BY ALL)
        SELECT *, (sum(removed) OVER (PARTITION BY part, "filter"))::BIGINT AS shapley FROM counted""",
}
