"""The queries that apply each operator to its whole table, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from atticsweep.llm import (
    align,
    bpe,
    chat,
    ctw,
    exact_dedup,
    html,
    jaccard_join,
    language_id,
    packing,
    quality,
    runs,
    substring_dedup,
    toxicity,
)
from atticsweep.llm.common import table


def op1_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_texts(table(spark, sf_dir, "documents"))


def op2_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_digests(table(spark, sf_dir, "documents"))


def op3_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_digests(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_parity_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_copy_components(table(spark, sf_dir, "documents"))


def op7_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op9_column_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(table(spark, sf_dir, "documents"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_digests(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ctw": op1_ctw,
    "op2_super_kmers": op2_super_kmers,
    "op3_decision_list": op3_decision_list,
    "op4_bpe": op4_bpe,
    "op5_toxicity": op5_toxicity,
    "op6_parity_sketches": op6_parity_sketches,
    "op7_bigru": op7_bigru,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_column_generation": op9_column_generation,
    "op10_style_tree": op10_style_tree,
    "op11_token_alignment": op11_token_alignment,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_chat_format": op13_chat_format,
}

ORACLE_SQL: dict[str, str] = {
    "op8_exact_dedup": """
        WITH bare AS (
          SELECT doc_id, length(coalesce(text, '')) AS code_points,
            regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS rest
          FROM documents)
        SELECT doc_id, first_value(doc_id) OVER same AS keep_id, count(*) OVER (PARTITION BY rest) AS group_size,
          doc_id = first_value(doc_id) OVER same AS kept, sha256(rest) AS text_sha256
        FROM bare WINDOW same AS (PARTITION BY rest ORDER BY code_points DESC, doc_id)""",
    "op2_super_kmers": """
        WITH split AS (
          SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
          FROM documents),
        windows AS (
          SELECT doc_id, first, array_to_string(words[first:first + 34], ' ') AS win
          FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS first FROM split)),
        repeated AS (SELECT win FROM windows GROUP BY win HAVING count(*) > 1),
        gone AS (
          SELECT DISTINCT doc_id, unnest(range(first, first + 35)) AS at
          FROM windows WHERE win IN (SELECT win FROM repeated)),
        each AS (
          SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS at FROM split WHERE len(words) > 0),
        kept AS (
          SELECT e.doc_id, count(*) FILTER (WHERE g.at IS NOT NULL) AS n_removed,
            coalesce(string_agg(e.word, ' ' ORDER BY e.at) FILTER (WHERE g.at IS NULL), '') AS kept
          FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.at = e.at GROUP BY e.doc_id)
        SELECT s.doc_id, CAST(len(s.words) AS BIGINT) AS n_words, coalesce(k.n_removed, 0) AS n_removed,
          sha256(coalesce(k.kept, '')) AS kept_sha256
        FROM split s LEFT JOIN kept k ON k.doc_id = s.doc_id""",
    "op6_parity_sketches": """
        WITH RECURSIVE split AS (
          SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x20\\x09-\\x0D]+') AS words
          FROM documents),
        shingles AS (
          SELECT DISTINCT doc_id, shingle FROM (
            SELECT doc_id, array_to_string(words[first:first + 3], ' ') AS shingle
            FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS first
                  FROM split WHERE len(words) > 0))),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        links AS (
          SELECT a.doc_id AS a, b.doc_id AS b
          FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
          JOIN sizes m ON m.doc_id = a.doc_id JOIN sizes n ON n.doc_id = b.doc_id
          GROUP BY a.doc_id, b.doc_id, m.n, n.n HAVING 100 * count(*) >= 85 * (m.n + n.n - count(*))),
        reach AS (
          SELECT doc_id AS node, doc_id AS seen FROM documents
          UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen)
        SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, r.component_id
        FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id
        JOIN (SELECT node, min(seen) AS component_id FROM reach GROUP BY node) r ON r.node = d.doc_id""",
    # Words by number, planted; words q apart that are the same, as stretches; those with a smaller period left out.
    "op12_periodic_runs": """
        WITH split AS (
          SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS given, row_number() OVER () AS r,
            -- CRC-32 of the id's digits, bit by bit.
            xor(list_reduce(
              list_concat([CAST(4294967295 AS BIGINT)],
                list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
              lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)),
                lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) AS h
          FROM documents),
        drawn AS (
          SELECT *, h // 10 % greatest(len(given), 1) AS a,
            1 + (len(given) - h // 10 % greatest(len(given), 1)) // (3 + h // 10 % 8) AS p FROM split),
        texts AS (
          SELECT r, doc_id, CASE WHEN h % 10 = 0 AND len(given) > 0
            THEN list_transform(range(len(given)), lambda i: given[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE given END AS words
          FROM drawn),
        each AS (SELECT r, unnest(words) AS word, unnest(range(len(words))) AS i, len(words) AS n FROM texts WHERE len(words) >= 24),
        pairs AS (
          SELECT x.r, x.i, y.i - x.i AS q FROM each x JOIN each y ON x.r = y.r AND x.word = y.word AND y.i > x.i
          WHERE 3 * (y.i - x.i) <= x.n),
        islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs),
        stretches AS (
          SELECT r, min(i) AS start, count(*) + q AS length, q AS period FROM islands GROUP BY r, q, island
          HAVING count(*) + q >= greatest(24, 3 * q)),
        runs AS (
          SELECT * FROM stretches s WHERE NOT EXISTS (
            SELECT 1 FROM stretches t WHERE t.r = s.r AND t.period < s.period AND s.period % t.period = 0
              AND t.start <= s.start AND t.start + t.length >= s.start + s.length)),
        best AS (
          SELECT r, start, length, period FROM runs
          QUALIFY row_number() OVER (PARTITION BY r ORDER BY CAST(length AS DECIMAL(38, 18)) / period DESC, start, period) = 1),
        gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
        kept AS (
          SELECT t.r, coalesce(string_agg(t.word, ' ' ORDER BY t.i) FILTER (WHERE g.i IS NULL), '') AS kept
          FROM (SELECT r, unnest(words) AS word, unnest(range(len(words))) AS i FROM texts) t
          LEFT JOIN gone g ON g.r = t.r AND g.i = t.i GROUP BY t.r),
        listed AS (
          SELECT r, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS runs
          FROM runs GROUP BY r)
        SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli,
          sha256(coalesce(l.runs, '')) AS runs_sha256, sha256(coalesce(k.kept, '')) AS collapsed_sha256
        FROM texts t LEFT JOIN listed l USING (r) LEFT JOIN best b USING (r) LEFT JOIN kept k USING (r)""",
    # Lengths of the template's marks by the turn before; a stray turn's by its name.
    "op13_chat_format": """
        WITH turns AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
        judged AS (
          SELECT *, lag(role) OVER w AS before, row_number() OVER w AS place FROM turns
          WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
        walked AS (
          SELECT *, bool_or(NOT CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'system' THEN role = 'user'
              WHEN before = 'user' THEN role = 'assistant' ELSE before = 'assistant' AND role = 'user' END)
            OVER (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS stray FROM judged),
        sized AS (
          SELECT *, length(text) + length(text) - length(replace(text, '\\', ''))
              + len(regexp_extract_all(text, '<s>|</s>|\\[/?INST\\]|<</?SYS>>|\\[/?ROLE\\]|\\[END\\]'))
            + CASE WHEN stray THEN 18 + length(role) + length(role) - length(replace(role, '\\', ''))
                + len(regexp_extract_all(role, '<s>|</s>|\\[/?INST\\]|<</?SYS>>|\\[/?ROLE\\]|\\[END\\]'))
              WHEN role = 'system' THEN 29 WHEN role = 'assistant' THEN 6 WHEN before = 'system' THEN 8 ELSE 18 END AS chars FROM walked)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY place)) AS turns_sha256,
          CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
          CAST(sum(chars) AS BIGINT) AS formatted_chars, NOT bool_or(stray) AS valid
        FROM sized GROUP BY conv_id""",
}
