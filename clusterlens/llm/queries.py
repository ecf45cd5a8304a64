"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.llm import alignment, common, exact_dedup, language, packing, pieces, pii, quality, repair, simhash
from clusterlens.llm import substring_dedup, topk, toxicity, warc
from clusterlens.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _held_out(folds: int, fold: int = 0) -> Column:
    return F.coalesce(common.fold(F.col("doc_id"), folds) == fold, F.lit(False)).alias("held_out")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = common.settle(quality.measured(table(spark, sf_dir, "documents")))
    scored = quality.score(stats, quality.fit(stats, table(spark, sf_dir, "labels")))
    predicted = (F.col("score") >= 0.3).cast("int").alias("predicted")
    return scored.select("doc_id", _held_out(quality.FOLDS), "score", predicted)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(exact_dedup.normalised(F.col("text")).cast("binary"), 256)
    return exact_dedup.copies(table(spark, sf_dir, "documents"), carry={"text_sha256": digest})


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs))
    return found.select("doc_id", _held_out(language.FOLDS, language.HELD_OUT), "lang_pred", "score")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return scored.select("doc_id", _held_out(toxicity.FOLDS), "score", predicted)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(table(spark, sf_dir, "documents"), read_back=True)
    return encoded.select(
        "doc_id",
        "rank",
        "score",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_pieces"),
        F.crc32("ids").alias("ids_crc32"),
        (F.xxhash64("read_back") == F.col("text_hash")).alias("round_trip"),
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.drop_repeats(table(spark, sf_dir, "documents"), removed="n_removed")
    return cut.select("doc_id", "n_removed", F.char_length("text").alias("n_chars_left"), "text")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    vectors = rows.select(F.col("vec_id").alias("id"), topk.scaled(F.col("embedding"), 64.0).alias("vector"))
    return topk.top_k(vectors, F.col("id") % 20 == 0)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{common.shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    written = warc.write(table(spark, sf_dir, "pages"), folder)
    if not written.agg(F.sum("n_records")).first()[0]:
        return spark.createDataFrame([], warc.READ_SCHEMA).drop("url", "payload", "record_id")
    return warc.read(spark, folder).drop("url", "payload", "record_id")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda span: span.base)

    def counted(kind: str) -> Column:
        return F.size(F.filter(base, lambda span: span.kind == kind)).cast("bigint").alias(f"n_{kind}")

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda span: F.concat_ws(":", span.kind, span.start, span.end)), ",")

    return found.select(
        "doc_id",
        *map(counted, ("email", "ip", "card", "phone")),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damage(table(spark, sf_dir, "conversations")), exists=F.col("exists"))


QUERIES: dict[str, Query] = {
    "op1_quality": op1_quality,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_language": op3_language,
    "op4_packing": op4_packing,
    "op5_simhash": op5_simhash,
    "op6_toxicity": op6_toxicity,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_topk": op9_topk,
    "op10_warc": op10_warc,
    "op11_pii": op11_pii,
    "op12_alignment": op12_alignment,
    "op13_repair": op13_repair,
}

_A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

def _repair_sql() -> str:
    """The damage, the faults, and the cheapest edits by a fold over the rows: for each state of the output, cost and audit
    in one text that sorts like both."""
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

    def plus(lane: str, cost: str, edit: str) -> str:
        return f"(lpad(CAST(CAST(left({lane}, 18) AS BIGINT) + {cost} AS VARCHAR), 18, '0') || substr({lane}, 19) || '{edit}')"

    def at_best(*lanes: str) -> str:
        return f"least({', '.join(lanes)})"

    def renamed(*lanes: str) -> str:
        return f"IF(w.f IN (1, 2), NULL, {at_best(*[plus(lane, '1 + IF(w.f = 3, 5, 0)', 'R') for lane in lanes], 'NULL::VARCHAR')})"

    def kept(initial: str, *lanes: str) -> str:
        either = at_best(*[plus(lane, "IF(w.f = 3, 5, 0)", "K") for lane in lanes], "NULL::VARCHAR")
        return f"IF(w.f IN (1, 2) OR w.i <> '{initial}', NULL, {either})"

    def deleted(lane: str) -> str:
        return plus(lane, "2", "D")

    step = f"""{{'n': {deleted("l.n")}, 's': {at_best(deleted("l.s"), kept("s", "l.n"))},
                 'u': {at_best(deleted("l.u"), renamed("l.n", "l.s", "l.a"), kept("u", "l.n", "l.s", "l.a"))},
                 'a': {at_best(deleted("l.a"), renamed("l.u"), kept("a", "l.u"))}}}"""
    user = at_best("x.u", *[plus(f"x.{lane}", "5", "I") for lane in "nsa"])
    inserted = f"""list_transform(list_transform([{{0}}], lambda x: {{{{'n': x.n, 's': x.s, 'u': {user}, 'a': x.a}}}}),
                   lambda y: {{{{'n': y.n, 's': y.s, 'u': y.u, 'a': least(y.a, {plus("y.u", "5", "I")})}}}})[1]"""
    start = "{'n': repeat('0', 18), 's': NULL::VARCHAR, 'u': NULL::VARCHAR, 'a': NULL::VARCHAR}"
    wanted = "IF(p.q = 'u', 'assistant', 'user')"
    role = f"IF(edit = 'K', rows[p.k].r, {wanted})"
    text = "IF(edit = 'I', '', rows[p.k].t)"
    return f"""
        WITH named AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
            FROM conversations
        ),
        numbered AS (  -- crc32, bit by bit
            SELECT *, xor(list_reduce(
                       [ord(c) FOR c IN string_split(name, '')],
                       lambda crc, byte: list_reduce(
                           range(8), lambda part, i: xor(part >> 1, 3988292384 * (part & 1)), xor(crc, byte::BIGINT)),
                       4294967295::BIGINT), 4294967295) % 20 AS kind
            FROM named
        ),
        damaged AS (
            SELECT conv_id, turn, IF(kind = 4, 'user', role) AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                   unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
            FROM numbered
        ),
        placed AS (
            SELECT *, rtrim(text, {blanks}) AS trimmed,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS occurrence
            FROM damaged
        ),
        judged AS (
            SELECT *, CASE WHEN trimmed = '' THEN 1 WHEN occurrence > 1 THEN 2
                           WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault
            FROM placed
        ),
        grouped AS (
            SELECT conv_id,
                   list({{'r': role, 't': text, 'i': left(role, 1), 'f': fault}}
                        ORDER BY turn NULLS FIRST, role, text, occurrence) AS rows,
                   coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
                   count(*) FILTER (fault = 3) AS truncated
            FROM judged GROUP BY conv_id
        ),
        derived AS (
            SELECT *, list_reduce(rows, lambda l, w: {inserted.format(step)}, {inserted.format(start)}) AS lanes
            FROM grouped
        ),
        decided AS (SELECT *, least(lanes.n, lanes.a) AS best, substr(best, 19) AS audit FROM derived),
        repaired AS (
            SELECT *, list_reduce(
                       [edit FOR edit IN string_split(audit, '') IF edit <> ''],
                       lambda p, edit: {{
                           'q': IF(edit = 'D', p.q, left({role}, 1)), 'k': p.k + IF(edit = 'I', 0, 1),
                           'out': IF(edit = 'D', p.out, list_append(p.out, {role} || ':' || {text}))}},
                       {{'q': 'n', 'k': 1, 'out': []::VARCHAR[]}}) AS replayed
            FROM decided
        )
        SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
               coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
               coalesce(len([n FOR n IN range(1, len(rows)) IF rows[n].i || rows[n + 1].i NOT IN ('su', 'ua', 'au')]), 0)::BIGINT
                   AS illegal,
               coalesce(CAST(left(best, 18) AS BIGINT), 0) AS cost, coalesce(audit, '') AS audit,
               sha256(coalesce(array_to_string(replayed.out, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c
        LEFT JOIN repaired r ON c.conv_id IS NOT DISTINCT FROM r.conv_id
    """


ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": f"""
        WITH hashed AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), {_A_TO_Z})) AS text_sha256 FROM documents
        )
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept,
               text_sha256
        FROM hashed
    """,
    # base 32 of a digest: eight parts of twenty bits, each four characters
    "op10_warc": """
        WITH sized AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS hex FROM pages),
        grouped AS (SELECT *, max(page_id) OVER (PARTITION BY hex, n) AS first FROM sized)
        SELECT page_id, n::BIGINT AS payload_bytes,
               array_to_string([
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((('0x' || hex[1 + 5 * (i // 4):5 + 5 * (i // 4)])::INTEGER
                                                            >> (15 - 5 * (i % 4))) & 31)]
                   FOR i IN range(32)], '') AS payload_digest,
               IF(first IS NULL OR page_id = first, 'response', 'revisit') AS record_type,
               IF(page_id = first, NULL, first) AS refers_to
        FROM grouped
    """,
    "op9_topk": """
        WITH usable AS (
            SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS v
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
            FROM usable q JOIN usable c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 20 = 0
        )
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
        FROM scored
        QUALIFY rank <= 20
    """,
    "op13_repair": _repair_sql(),
}
