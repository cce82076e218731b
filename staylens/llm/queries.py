"""Registered queries of the training-data operators."""

from __future__ import annotations

from fractions import Fraction

from staylens.llm import chat, decontaminate, filter_audit, line_dedup, lm_score, neighbours, ngram_join, packing, quality, sharding, token_counts, wavelet, whitening
from pyspark.sql import functions as F

from staylens.llm.stored import table


def op1_ngram_jaccard_join(spark, folder):
    """Components of documents whose 3-word shingles overlap by at least 90 in 100."""
    _, members = ngram_join.ngram_join(table(spark, folder, "documents").select("doc_id", "text"), 3, Fraction(9, 10))
    return members.select("doc_id", "n_shingles", "component_id", "class_id")


def op2_lm_scoring(spark, folder):
    """Language-model and word-unigram scores of all documents, learned without one fold of them."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.coalesce(quality.fold_of("doc_id", 7) == 2, F.lit(False))
    scored = lm_score.lm_score(docs, docs.where(~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_sharding(spark, folder):
    """All documents in random order in 16 shards whose row counts differ by at most one."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    return sharding.shuffle_into_shards(docs).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_benchmark_decontamination(spark, folder):
    """Benchmark items that stand in documents, exactly or with few edits, and where."""
    return decontaminate.find_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op5_line_dedup(spark, folder):
    """All documents without the lines that repeat, exactly or nearly, an earlier line."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs)


def op6_quality_classifier(spark, folder):
    """Quality score of all documents; labels of one fold are never looked at."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = quality.fit(docs, labels.where(quality.fold_of("doc_id", 5) != 0).select("doc_id", "quality"))
    scored = quality.score(docs, model)
    return scored.select(
        "doc_id",
        F.coalesce(quality.fold_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op7_token_counts(spark, folder):
    """Token counts of all documents before and after three edits of each, which follow from the documents by rule."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return token_counts.counts_after_edits(docs, token_counts.edits_by_rule(docs))


CHECK_ID, CHECK_TEXT = -7, "\\### Assistant: </turn> ok"


def op8_chat_formatting(spark, folder):
    """All conversations, and one whose texts look like marks, rendered from their event logs and read back."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise(chat.ASSISTANT)
    extra = spark.range(2).select(F.lit(CHECK_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(CHECK_TEXT).alias("text"))
    rows = rows.unionByName(extra)
    done = chat.format_conversations(chat.event_log(rows))
    turns = chat.read_back(F.col("formatted"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.withColumns({"turns": turns, "loss": chat.loss_text(F.col("formatted"), F.col("loss_spans"))}).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_nearest_neighbours(spark, folder):
    """The 5 nearest other vectors of every fiftieth vector."""
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return neighbours.search(rows, rows.where("vec_id % 50 = 0"))


def op10_best_fit_packing(spark, folder):
    """All documents packed into sequences of 4,096 tokens."""
    return packing.pack_documents(table(spark, folder, "documents").select("doc_id", "text"))


def op11_filter_interaction_audit(spark, folder):
    """What five filters remove in every order of them, for each language."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    return filter_audit.audit(docs, table(spark, folder, "labels"))


def op12_embedding_whitening(spark, folder):
    """All vectors whitened by the four strongest components of the distinct ones."""
    rows = whitening.whiten(table(spark, folder, "embeddings").select("vec_id", "embedding"))
    return rows.withColumn("deviation", F.col("deviation").cast("long"))


def op13_token_id_output(spark, folder):
    """Token ids of all documents written as wavelet files and read back from them."""
    return wavelet.round_trip(table(spark, folder, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_lm_scoring, op3_sharding, op4_benchmark_decontamination, op5_line_dedup, op6_quality_classifier, op7_token_counts, op8_chat_formatting, op9_nearest_neighbours, op10_best_fit_packing, op11_filter_interaction_audit, op12_embedding_whitening, op13_token_id_output)}
SQL = {
    "op8_chat_formatting": r"""
        WITH r AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
          UNION ALL SELECT -7, 0, 'user', t, 'user', t FROM (SELECT '\### Assistant: </turn> ok' AS t)
          UNION ALL SELECT -7, 1, 'assistant', t, 'assistant', t FROM (SELECT '\### Assistant: </turn> ok' AS t)
        ), e AS (
          SELECT *, length(replace(replace(role, '\', '\\'), '|', '\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 13 AS n FROM r
        ), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, r0, t0) AS k FROM e)
        SELECT conv_id, count(*) AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
          CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
          sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '')) AS loss_sha256,
          CAST(sum(n) AS BIGINT) AS formatted_chars
        FROM o GROUP BY conv_id
    """,
    "op11_filter_interaction_audit": r"""
        WITH d AS (
          SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
          FROM documents
        ), flags AS (
          SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
        ), m AS (
          SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
            len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
            100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
            coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) AS e
          FROM d LEFT JOIN flags ON d.doc_id = flags.doc_id
        ), masks AS (
          SELECT part, good, toxic, a, b, c, d, e, a::INT + b::INT + c::INT + d::INT + e::INT AS n_fails, count(*) AS n
          FROM m GROUP BY ALL
        ), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
        ), orders AS (
          SELECT l1.x || l2.x || l3.x || l4.x || l5.x AS filter_order FROM letters l1, letters l2, letters l3, letters l4, letters l5
          WHERE len(list_distinct([l1.x, l2.x, l3.x, l4.x, l5.x])) = 5
        ), steps AS (SELECT filter_order, s AS step, filter_order[s] AS letter, filter_order[1:s - 1] AS before FROM orders, range(1, 6) t(s)
        ), outcomes AS (
          SELECT part, filter_order, step, letter, n, good, toxic, n_fails,
            CASE letter WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS failing,
            a AND contains(before, 'A') OR b AND contains(before, 'B') OR c AND contains(before, 'C') OR d AND contains(before, 'D')
              OR e AND contains(before, 'E') AS gone
          FROM masks, steps
        ), counts AS (
          SELECT part, filter_order, step, letter,
            sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END)::BIGINT AS kept,
            sum(CASE WHEN NOT gone AND failing THEN n ELSE 0 END)::BIGINT AS removed,
            sum(CASE WHEN gone AND failing THEN n ELSE 0 END)::BIGINT AS redundant,
            sum(CASE WHEN failing AND n_fails = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
            sum(CASE WHEN NOT gone AND failing THEN n * good ELSE 0 END)::BIGINT AS good_lost,
            sum(CASE WHEN NOT gone AND failing THEN n * toxic ELSE 0 END)::BIGINT AS toxic_lost
          FROM outcomes GROUP BY ALL
        )
        SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
          (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
        FROM counts
    """,
}
